"""Per-key results over equal-sized chunks, so that a key with most of the rows occupies many tasks.

The rows of a key are numbered exactly: they are counted per input partition, the counts' prefix sums are
the offsets of the partitions, and a row's number is its partition's offset plus its place there. Chunks of
so many numbers are processed apart, whichever key they belong to, and the states at their boundaries are
merged in order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.runtime import cut, fits, measured, norm, table

CHUNK_ROWS = 50_000


def numbered(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """`df` with `_part`, and `_no`: the row's number within its key from 0, by the order of the columns `order`.

    Range partitioning on (key, order) sends a key's rows to as many partitions as they need; the partitions
    follow each other in order. No task holds a key as a whole. Rows whose key and order columns are all
    equal stay in one partition, so `order` should end with a unique column. A null key is a key here.
    """
    by = [F.col(key), *map(F.col, order)]
    # written once: the counts and the rows must see the same partitions
    ranged = cut(df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    local = F.row_number().over(Window.partitionBy("_part", key).orderBy(*by[1:])) - 1
    counts = ranged.groupBy(F.col("_part"), F.col(key)).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(F.col("_part").alias("_p"), F.col(key).alias("_key"), "_before")
    at = ranged.withColumn("_local", local)
    return at.join(offsets, (F.col("_part") == F.col("_p")) & F.col(key).eqNullSafe(F.col("_key"))).withColumn("_no", F.col("_local") + F.col("_before")).drop("_p", "_key", "_local", "_before")


def _place_in_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to (_part, key) the row's place among the partition's rows of its key; one count per key is held."""
    seen: dict = {}
    for b in batches:
        if not b.num_rows:
            continue
        coded = b.column(1).dictionary_encode(null_encoding="encode")
        codes, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
        order = np.argsort(codes, kind="stable")
        sizes = np.bincount(codes, minlength=len(names))
        place = np.empty(b.num_rows, np.int64)
        before = np.array([seen.get(k, 0) for k in names], np.int64)
        place[order] = np.arange(b.num_rows) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(before, sizes)
        seen.update((k, int(n)) for k, n in zip(names, before + sizes, strict=True))
        yield pa.record_batch([*b.columns, pa.array(place)], names=["_part", "_key", "_place"])


def numbered_as_stored(df: DataFrame, key: str) -> DataFrame:
    """(key, _no): the rows of each key numbered from 0 in the order of the input partitions and of the rows in them.

    No row moves to be counted. The numbers are the partitions' offsets plus the places, which meet in a join on
    (partition, key); a pair of them has a partition's rows at most, so a hot key is spread over all partitions.
    A null key is a key here.
    """
    kind = df.schema[key].dataType.simpleString()
    # written once: counts and rows must see the same partitions
    placed = cut(df.select(F.spark_partition_id().alias("_part"), F.col(key).alias("_key")).mapInArrow(_place_in_partition, f"_part int, _key {kind}, _place bigint"))
    counts = placed.groupBy("_part", "_key").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets, facts = measured(counts.select(F.col("_part").alias("_p"), F.col("_key").alias("_k"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    same = (F.col("_part") == F.col("_p")) & F.col("_key").eqNullSafe(F.col("_k"))
    return placed.join(F.broadcast(offsets) if fits(facts) else offsets, same).select(F.col("_key").alias(key), (F.col("_place") + F.col("_before")).alias("_no"))


def chunk_states(df: DataFrame, key: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(key, chunk, rows, first_no, last_no): each equal-sized chunk of a key processed on its own."""
    at = numbered_as_stored(df, key)
    return at.groupBy(key, (F.col("_no") / chunk_rows).cast("long").alias("chunk")).agg(F.count("*").alias("rows"), F.min("_no").alias("first_no"), F.max("_no").alias("last_no"))


def merged_counts(states: DataFrame, key: str) -> DataFrame:
    """(key, rows, joined): the chunks' states merged in their order; `joined` tells that each chunk goes on where the one before ends."""
    order = Window.partitionBy(key).orderBy("chunk")
    meets = F.col("first_no") == F.coalesce(F.lag("last_no").over(order) + 1, F.lit(0))
    return states.withColumn("_meets", meets & (F.col("last_no") - F.col("first_no") + 1 == F.col("rows"))).groupBy(key).agg(F.sum("rows").alias("rows"), F.bool_and("_meets").alias("joined"))


def key_profiles(df: DataFrame, key: str, order: Sequence[str], label: Column, value: Column, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Per key, over its rows in order: rows, value_sum, value_min, value_max, and changes (how often `label` differs from the row before).

    Each chunk gives a state that holds its first and last label; states of neighbouring chunks merge in
    order, a change between two chunks being counted there. Null keys are left out; a null label is a label.
    """
    at = numbered(df.withColumn("_label", label).withColumn("_value", value).where(F.col(key).isNotNull()).select(key, *dict.fromkeys(order), "_label", "_value"), key, order)
    at = at.withColumn("_chunk", (F.col("_no") / chunk_rows).cast("long"))
    inside = Window.partitionBy(key, "_chunk").orderBy("_no")
    turned = F.when(F.col("_no") % chunk_rows == 0, 0).otherwise((~F.col("_label").eqNullSafe(F.lag("_label").over(inside))).cast("int"))
    states = at.withColumn("_turn", turned).groupBy(key, "_chunk").agg(F.count("*").alias("_n"), F.sum("_value").alias("_sum"), F.min("_value").alias("_min"), F.max("_value").alias("_max"), F.sum("_turn").alias("_turns"), F.min_by(F.struct("_label"), "_no").alias("_head"), F.max_by(F.struct("_label"), "_no").alias("_tail"))
    order_of = Window.partitionBy(key).orderBy("_chunk")
    joint = F.when(F.col("_chunk") == 0, 0).otherwise((~F.col("_head").eqNullSafe(F.lag("_tail").over(order_of))).cast("int"))
    return states.withColumn("_joint", joint).groupBy(key).agg(F.sum("_n").alias("rows"), F.sum("_sum").alias("value_sum"), F.min("_min").alias("value_min"), F.max("_max").alias("value_max"), (F.sum("_turns") + F.sum("_joint")).alias("changes"))


def heavy_keys(df: DataFrame, key: str, share: float, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(key, rows): the non-null keys with at least `share` of all rows; null keys count among all rows.

    The rows are numbered, processed in chunks, and the chunks' states merged in order. An empty table gives no row.
    """
    merged, facts = measured(merged_counts(chunk_states(df, key, chunk_rows), key), total=F.sum("rows"), sound=F.bool_and("joined"))
    if facts["sound"] is False:
        raise RuntimeError("the numbers of a key have holes: its input changed between two reads")
    return merged.where(F.col(key).isNotNull() & (F.col("rows") >= (facts["total"] or 0) * share)).select(key, "rows")


def found(spark, sf: str) -> DataFrame:
    """p5_found: the keys with at least 3 % of the rows of annotation (gene_id) and feature (seqname)."""
    parts = [heavy_keys(table(spark, sf, t).select(norm(c).alias("key_value")), "key_value", 0.03).select(F.lit(t).alias("src_table"), "key_value") for t, c in (("annotation", "gene_id"), ("feature", "seqname"))]
    return parts[0].unionByName(parts[1])


def profiles(spark, sf: str) -> DataFrame:
    """p5_profiles: per gene_id of annotation, its rows as stored in the order of annotation_id, region and pos."""
    rows = table(spark, sf, "annotation").select(norm("gene_id").alias("gene_id"), "annotation_id", "region", "pos")
    return key_profiles(rows, "gene_id", ["annotation_id", "region", "pos"], F.col("region"), F.col("pos"))
