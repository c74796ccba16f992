"""References to records that do not exist, at the time the referring record was loaded."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.operators.skew import keyed_left_join
from strandloom.runtime import norm, table

SEP = "\x1f"


def null_mask(cols: Sequence[str]) -> Column:
    """Bit i is set when column i is null."""
    return sum((F.when(F.col(c).isNull(), 1 << i).otherwise(0) for i, c in enumerate(cols)), F.lit(0))


def lifetimes(target: DataFrame, key: Column, since: str, until: str | None) -> DataFrame:
    """One row per key: first load, start of the open-ended lifetime, and the closed lifetimes before that.

    Everything is a map-side combined aggregate; the array holds the deleted versions of one key only.
    A row without a load time serves at no time; rows without key are left out.
    """
    rows = target.select(key.alias("_key"), F.col(since).alias("_from"), (F.col(until) if until else F.lit(None).cast("timestamp")).alias("_to")).where("_key is not null")
    return rows.groupBy("_key").agg(
        F.count("*").alias("_rows"),
        F.min("_from").alias("_first"),
        F.min(F.when(F.col("_to").isNull(), F.col("_from"))).alias("_open"),
        F.collect_set(F.when(F.col("_to").isNotNull(), F.struct("_from", "_to"))).alias("_closed"),
    )


def orphan_references(child: DataFrame, refs: Sequence[str], at: str | None, target: DataFrame, keys: Sequence[str], since: str | None = None, until: str | None = None, semantics: str = "simple", spread: Sequence[str] = ()) -> DataFrame:
    """The rows of `child` whose reference (`refs` -> `keys`) no row of `target` serves, with `_status`.

    References are grouped by null mask, and each mask is anti-joined on its non-null columns only: the key of the
    join holds the mask and these columns, so child and target are read once for all masks.

    semantics: `simple` - a reference with any null isn't checked; `partial` - the non-null columns must
    match some target row, an all-null reference isn't checked; `full` - a reference must be all null (not
    checked) or have no null (a mixed one is an orphan of status `incomplete`).
    With `at`/`since`/`until` a target row serves while since <= at < until (a null until: still valid);
    without them any row serves. Status: `missing` no target row has the key, `late` all were loaded after
    `at`, `deleted` otherwise. A row without load time is served by nothing and counts as `deleted` when the
    key exists. Keys compare trimmed, regardless of case; an empty string is a key, a null isn't.
    Repeated rows stay repeated; extra columns of `child` stay, those of `target` don't enter.
    """
    if semantics not in ("simple", "partial", "full"):
        raise ValueError(f"unknown match semantics {semantics!r}")
    if len(refs) != len(keys) or not refs:
        raise ValueError("refs and keys must name as many columns, one at least")
    every = (1 << len(refs)) - 1
    clash = {"_key", "_mask", "_status", "_rows", "_first", "_open", "_closed", "_salt", "_parts"} & set(child.columns)
    if clash:
        raise ValueError(f"reserved column names: {sorted(clash)}")
    timed = since is not None and at is not None
    masked = child.withColumn("_mask", null_mask(refs))
    # the masks that are looked up; the key holds the mask, so one join serves all of them
    masks = range(every) if semantics == "partial" else [0]
    looked = masked.where(F.col("_mask").isin(*masks)).withColumn("_key", masked_key(F.col("_mask"), refs))
    usable = target.withColumn("_null", null_mask(keys)).withColumn("_mask", F.explode(F.array(*map(F.lit, masks)))).where((F.col("_null").bitwiseAND(F.bitwise_not("_mask"))) == 0)
    target_key = masked_key(F.col("_mask"), keys)
    tell = list(spread) or list(refs)
    if timed:
        joined = keyed_left_join(looked, lifetimes(usable, target_key, since, until), "_key", tell)
        t = F.col(at)
        served = F.coalesce(F.col("_open") <= t, F.lit(False)) | F.coalesce(F.exists("_closed", lambda x: (x["_from"] <= t) & (x["_to"] > t)), F.lit(False))
        status = F.when(F.col("_rows").isNull(), "missing").when(F.col("_first") > t, "late").otherwise("deleted")
        lost = joined.where(~served).withColumn("_status", status).drop("_key", "_rows", "_first", "_open", "_closed")
    else:
        lost = keyed_left_join(looked, usable.select(target_key.alias("_key")).distinct(), "_key", tell, "left_anti").withColumn("_status", F.lit("missing")).drop("_key")
    if semantics == "full" and every > 1:
        lost = lost.unionByName(masked.where((F.col("_mask") != 0) & (F.col("_mask") != every)).withColumn("_status", F.lit("incomplete")))
    return lost.drop("_mask")


def masked_key(mask: Column, cols: Sequence[str]) -> Column:
    """One text for a null mask and the columns that it leaves."""
    return F.concat_ws(SEP, mask.cast("string"), *[F.when(mask.bitwiseAND(F.lit(1 << i)) == 0, norm(c)) for i, c in enumerate(cols)])


def contig_names(contig: DataFrame, alias: DataFrame) -> DataFrame:
    """Every name by which a contig can be called (key, added_at, retired_at): its own, and the aliases that aren't names of contigs themselves."""
    own = contig.select(norm("name").alias("key"), "added_at", "retired_at")
    other = alias.select(norm("alias").alias("key"), norm("name").alias("_name")).where("key is not null").distinct()
    other = other.join(own.select("key").distinct(), "key", "left_anti")
    return own.unionByName(other.join(own.withColumnRenamed("key", "_name"), "_name").drop("_name"))


def references(spark, sf: str) -> tuple[DataFrame, DataFrame]:
    """All references as (child_table, child_key, ref_field, target, ref, at), and all that can be referred to as (target, key, since, until).

    A reference is a composite one: the kind of its target, and a key of that kind.
    """
    gene, transcript, feature, annotation = (table(spark, sf, t) for t in ("gene", "transcript", "feature", "annotation"))
    names = contig_names(table(spark, sf, "contig"), table(spark, sf, "chrom_alias"))
    children = []
    for name, child, child_key, fields in (
        ("transcript", transcript, norm("transcript_id"), {"gene_id": "gene"}),
        ("annotation", annotation, F.col("annotation_id").cast("string"), {"gene_id": "gene"}),
        ("feature", feature, F.col("feature_id").cast("string"), {"transcript_id": "transcript", "seqname": "contig"}),
    ):
        each = F.array(*[F.struct(F.lit(f).alias("ref_field"), F.lit(t).alias("target"), F.col(f).alias("ref")) for f, t in fields.items()])
        children.append(child.select(F.lit(name).alias("child_table"), child_key.alias("child_key"), F.col("loaded_at").alias("at"), F.explode(each).alias("r")).select("child_table", "child_key", "at", "r.*"))
    targets = [rows.select(F.lit(kind).alias("target"), F.col(key).alias("key"), F.col(since).alias("since"), F.col(until).alias("until")) for kind, rows, key, since, until in (("gene", gene, "gene_id", "loaded_at", "deleted_at"), ("transcript", transcript, "transcript_id", "loaded_at", "deleted_at"), ("contig", names, "key", "added_at", "retired_at"))]
    return reduce(DataFrame.unionByName, children), reduce(DataFrame.unionByName, targets)


def found(spark, sf: str) -> DataFrame:
    """p1_found: the orphan references of transcript, annotation and feature."""
    children, targets = references(spark, sf)
    lost = orphan_references(children, ["target", "ref"], "at", targets, ["target", "key"], "since", "until", spread=["child_key"])
    return lost.select("child_table", "child_key", "ref_field", F.col("_status").alias("status"), F.date_format("at", "yyyy-MM").alias("period")).distinct()


def report(spark, sf: str) -> DataFrame:
    """p1_report: the orphans counted by table, field, status and month."""
    return found(spark, sf).groupBy("child_table", "ref_field", "status", "period").agg(F.count("*").alias("orphans"))


def composite(spark, sf: str) -> DataFrame:
    """p1_composite: transcripts whose (gene_id, seqname, strand) agrees with no gene row, nulls matching anything."""
    child = table(spark, sf, "transcript").select("transcript_id", "gene_id", "seqname", "strand", "loaded_at")
    lost = orphan_references(child, ["gene_id", "seqname", "strand"], None, table(spark, sf, "gene"), ["gene_id", "seqname", "strand"], semantics="partial", spread=["transcript_id"])
    return lost.select(norm("transcript_id").alias("transcript_id"), norm("gene_id").alias("gene_id"), norm("seqname").alias("seqname"), "strand", "_status").withColumnRenamed("_status", "status").distinct()
