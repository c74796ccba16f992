"""Joins that stay even when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from strandloom.runtime import cut, observed, small

#: Fewer rows of a key than this are never split, as a task takes them anyway.
LEAST_ROWS = 20_000


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hot_keys(df: DataFrame, key: Column, least: int | None = None) -> DataFrame | None:
    """(_k, _parts): the keys of `df` with more rows than half of a task's mean, and into how many parts of that size they go; None when there is none.

    One map-side combined count over all rows. With p shuffle partitions the mean is rows / p, so there are
    fewer than 2 p hot keys and 4 p parts, whatever the data: the table may be broadcast. Null keys are left out.
    """
    p = partitions(df)
    counted = df.select(key.alias("_k")).where("_k is not null").groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
    floor = LEAST_ROWS if least is None else least
    # the counts are summed up as they pass; only what may be hot is written
    seen, facts = Observation(), [F.sum("_n").alias("total"), F.max("_n").alias("most")]
    kept = cut(counted.observe(seen, *facts).where(F.col("_n") > floor))
    facts = observed(seen) or counted.agg(*facts).first().asDict()
    share = max(floor, (facts["total"] or 0) / (2 * p))
    if (facts["most"] or 0) <= share:
        return None
    return kept.where(F.col("_n") > share).select("_k", F.ceil(F.col("_n") / share).cast("int").alias("_parts"))


def keyed_left_join(left: DataFrame, right: DataFrame, key: str, spread: list[str], how: str = "left", fits: bool | None = None) -> DataFrame:
    """left join right on the string column `key`; `left` may have hot keys.

    A right side of a counted small size is broadcast (`fits` tells it when it is known). Otherwise rows of hot
    keys on the left are split by a hash of the columns `spread`, and only those keys' right rows are repeated, once
    per part. Null keys on the left match nothing and stay (how=left) or go (how=inner, left_semi).
    """
    if small(right) if fits is None else fits:
        return left.join(F.broadcast(right), key, how)
    hot = hot_keys(left, F.col(key))
    if hot is None:
        return left.join(right, key, how)
    parts = F.broadcast(hot.withColumnRenamed("_k", key))  # fewer than two keys per shuffle partition
    salted = left.join(parts, key, "left").withColumn("_salt", F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64(*spread), F.col("_parts")).cast("int")).otherwise(0)).drop("_parts")
    repeated = right.join(parts, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return salted.join(repeated, [key, "_salt"], how).drop("_salt")
