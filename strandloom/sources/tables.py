"""Site files, annotation tables, alias files, motif lists, FASTA and its index, and the built-in references."""

from __future__ import annotations

import os
from collections.abc import Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.operators.skew import keyed_left_join
from strandloom.runtime import cut

REQUIRED = ("chromosome", "start", "end", "strand", "gene_id", "transcript_id", "start_exon", "end_exon", "transcript_length")
# The chromosome names of the two common styles.
U2E = {**{f"chr{i}": str(i) for i in range(1, 100)}, "chrX": "X", "chrY": "Y", "chrM": "MT"}


def read_table(spark: SparkSession, path: str, header: bool = False, sep: str = "\t") -> DataFrame:
    """A delimited file, all columns text, quotes being data; without header columns are c0, c1, ..."""
    df = spark.read.option("sep", sep).option("header", header).option("quote", "").option("inferSchema", False).csv(path)
    return df if header else df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def with_place(df: DataFrame) -> DataFrame:
    """Adds `_file`, `_block` and `_row`: the file a row comes from, the start of the split in it, and a number that grows
    within the split. Spark hands out splits by size over all files, so partitions tell no order.

    A frame that doesn't come straight from files has one file, and its partitions for blocks.
    """
    try:
        placed = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    except AnalysisException:
        placed = df.select("*", F.lit("").alias("_file"), F.spark_partition_id().cast("long").alias("_block"))
    return placed.withColumn("_row", F.monotonically_increasing_id())


def with_record_id(df: DataFrame, name: str = "record_id") -> DataFrame:
    """Dense row numbers from 0 in input order, files by name: splits are counted, and each gets an offset."""
    return numbered_rows(with_place(df), name).drop("_file", "_block", "_row")


def numbered_rows(placed: DataFrame, name: str) -> DataFrame:
    """As with_record_id, for a frame of with_place."""
    counts = placed.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)  # one row per split
    offsets = counts.select("_file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(offsets, ["_file", "_block"]).withColumn(name, F.col("_row") - F.col("_first") + F.col("_before")).drop("_first", "_before")


def sites(df: DataFrame, columns: Sequence[int]) -> DataFrame:
    """Adds chrom, start, end, strand (0-based, half-open) from three columns (chrom, 1-based site, strand) or
    four (chrom, start, end, strand as they are). Columns of these names are renamed `_original_...` before.
    A position that isn't a number is null.
    """
    for c in ("chrom", "start", "end", "strand"):
        if c in df.columns:
            df = df.withColumnRenamed(c, f"_original_{c}")
    if len(columns) not in (3, 4) or max(columns) >= len(df.columns):
        raise ValueError("three or four existing columns are needed")
    names = [F.col(df.columns[i]) for i in columns]
    first = names[1].try_cast("bigint")
    start, end = (first - 1, first) if len(columns) == 3 else (first, names[2].try_cast("bigint"))
    return df.withColumns({"chrom": names[0], "start": start, "end": end, "strand": names[-1]})


def site_columns(df: DataFrame, columns: Sequence[int] = (0, 1, 2, 5)) -> list[int]:
    """The given columns, or the first three when the file has only three."""
    return [0, 1, 2] if len(df.columns) == 3 else list(columns)


def read_reference(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    df = df.toDF(*[c.lower() for c in df.columns])
    if missing := [c for c in REQUIRED if c not in df.columns]:
        raise ValueError(f"{path} lacks the columns {missing}; build it with exon_reference()")
    return df


def span_list(spans: Column) -> Column:
    """`s-e,s-e` (1-based closed) to array<struct<e_start, e_end>> (0-based half-open), order kept."""
    part = lambda x, i: F.get(F.split(x, "-"), F.lit(i)).try_cast("bigint")
    return F.transform(F.split(spans, ","), lambda x: F.struct((part(x, 0) - 1).alias("e_start"), part(x, 1).alias("e_end")))


def annotation_exons(table: DataFrame) -> DataFrame:
    """(gene_id, transcript_id, chrom, strand, e_start, e_end, offset): the exons of an annotation table with their
    5' offset in the listed order of spans. transcript_id defaults to gene_id; rows without a span list are skipped; `ord`, the table's order, stays.
    """
    rows = table.where("gene_id is not null and spans is not null")
    tx = F.coalesce("transcript_id", "gene_id") if "transcript_id" in table.columns else F.col("gene_id")
    size = lambda e: e["e_end"] - e["e_start"]
    order = [c for c in ("ord",) if c in table.columns]
    rows = rows.select("gene_id", tx.alias("transcript_id"), "chrom", "strand", span_list(F.col("spans")).alias("_x"), *order)
    rows = rows.select("*", F.posexplode("_x").alias("_i", "_e")).where("_e.e_start < _e.e_end")
    before = F.aggregate(F.slice("_x", F.lit(1), F.col("_i")), F.lit(0).cast("long"), lambda a, e: a + size(e))
    return rows.select("gene_id", "transcript_id", "chrom", "strand", F.col("_e.e_start").alias("e_start"), F.col("_e.e_end").alias("e_end"), before.alias("offset"), F.col("_i").alias("exon_no"), *order)


def read_faidx(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path).select(F.col("c0").alias("chrom"), F.col("c1").cast("bigint").alias("length"))


def read_motifs(spark: SparkSession, path: str) -> DataFrame:
    """(idx, motif, weight): one motif a line, perhaps a weight behind a tab; # lines are skipped, a bad weight is 1."""
    f = F.split("value", "\t")
    rows = with_record_id(spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith("#")), "idx")
    return rows.select("idx", F.trim(F.get(f, F.lit(0))).alias("motif"), F.coalesce(F.get(f, F.lit(1)).try_cast("double"), F.lit(1.0)).alias("weight"))


def builtin_names(spark: SparkSession, style: str) -> DataFrame:
    """(old, new) of the style U2E or E2U."""
    if style not in ("U2E", "E2U"):
        raise ValueError("style is U2E or E2U")
    return spark.createDataFrame([(a, b) if style == "U2E" else (b, a) for a, b in U2E.items()], "old string, new string")


def read_fasta(spark: SparkSession, path: str, chunk: int = 65536) -> DataFrame:
    """(chrom, chunk, offset, seq): sequences in fixed-size chunks, so that a base is found by an equi-join.

    The lines are split over tasks; a running length over the lines of a record places each of them.
    """
    text = with_place(spark.read.text(path))
    lines = text.where(F.trim("value") != "").withColumn("_head", F.when(F.col("value").startswith(">"), F.regexp_extract("value", r"^>(\S+)", 1)))
    named = fill_down(lines, "_head", "_row").withColumnRenamed("_filled", "chrom").where("_head is null and chrom is not null")
    size = F.length("value")
    split = ["_file", "_block", "chrom"]
    local = F.sum(size).over(Window.partitionBy(*split).orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)) - size
    sums = named.groupBy(*split).agg(F.sum(size).alias("_n"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("chrom").orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    placed = named.withColumn("_local", local).join(before, split)
    return chunked(placed.select("chrom", (F.col("_local") + F.col("_before")).alias("at"), F.col("value").alias("seq")), chunk)


def fill_down(df: DataFrame, column: str, order: str) -> DataFrame:
    """Adds `_filled`: the last non-null value of `column` up to each row of the same file. `df` has `_file` and `_block`, whose
    rows are consecutive in `order`; only one value per block is carried over to the next ones."""
    block = ["_file", "_block"]
    tails = df.groupBy(*block).agg(F.max_by(column, F.when(F.col(column).isNotNull(), F.col(order))).alias("_tail"))
    carry = tails.select(*block, F.last("_tail", ignorenulls=True).over(Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    local = F.last(column, ignorenulls=True).over(Window.partitionBy(*block).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_local", local).join(carry, block, "left").withColumn("_filled", F.coalesce("_local", "_carry")).drop("_local", "_carry")


def chunked(parts: DataFrame, chunk: int) -> DataFrame:
    """(chrom, at, seq) of any lengths to chunks of a fixed size."""
    end = F.col("at") + F.length("seq")
    cut = parts.where(F.length("seq") > 0).select("*", F.explode(F.sequence((F.col("at") / chunk).cast("long"), ((end - 1) / chunk).cast("long"))).alias("chunk"))
    a = F.greatest(F.col("at"), F.col("chunk") * chunk)
    piece = F.col("seq").substr((a - F.col("at") + 1).cast("int"), (F.least(end, (F.col("chunk") + 1) * chunk) - a).cast("int"))
    return cut.select("chrom", "chunk", a.alias("a"), piece.alias("s")).groupBy("chrom", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", "s"))), lambda x: x["s"]), "").alias("seq")).withColumn("offset", F.col("chunk") * chunk)


def fetch(chunks: DataFrame, spans: DataFrame, record: str, start: str, end: str, chunk: int = 65536) -> DataFrame:
    """spans (record, chrom, start, end) with `seq`, the bases of each; parts beyond a contig are left out."""
    want = spans.where(F.col(start) < F.col(end)).select(F.col(record).alias("_r"), "chrom", F.greatest(F.col(start), F.lit(0)).alias("_s"), F.col(end).alias("_e"))
    want = want.where("_s < _e").withColumn("chunk", F.explode(F.sequence((F.col("_s") / chunk).cast("long"), ((F.col("_e") - 1) / chunk).cast("long"))))
    # a chunk under many spans is split over tasks
    cell = F.concat_ws("\x1f", "chrom", F.col("chunk").cast("string"))
    got = keyed_left_join(want.withColumn("_cell", cell).drop("chrom"), chunks.withColumn("_cell", cell).drop("chrom", "chunk"), "_cell", ["_r"], "inner").drop("_cell")
    a = F.greatest(F.col("_s"), F.col("offset"))
    piece = F.col("seq").substr((a - F.col("offset") + 1).cast("int"), (F.least(F.col("_e"), F.col("offset") + chunk) - a).cast("int"))
    whole = got.groupBy("_r").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", piece.alias("s")))), lambda x: x["s"]), "").alias("seq"))
    return spans.join(whole, spans[record] == whole["_r"], "left").drop("_r").withColumn("seq", F.coalesce("seq", F.lit("")))


def rename_fasta(lines: DataFrame, names: DataFrame | None = None, search: str | None = None) -> DataFrame:
    """FASTA lines (no, value) with renamed headers, sequences whose new name doesn't match left out."""
    head = lines.withColumn("_old", F.when(F.col("value").startswith(">"), F.regexp_extract("value", r"^>(\S+)", 1)))
    if names is not None:
        head = head.join(names.withColumnRenamed("old", "_old"), "_old", "left").withColumn("_new", F.coalesce("new", "_old")).drop("new")
    else:
        head = head.withColumn("_new", F.col("_old"))
    ranged = cut(head.repartitionByRange("no").withColumn("_file", F.lit("")).withColumn("_block", F.spark_partition_id()))
    at = fill_down(ranged, "_new", "no").withColumnRenamed("_filled", "chrom")
    at = at.where(F.col("chrom").rlike(search)) if search else at
    return at.select("no", F.when(F.col("_old").isNotNull(), F.concat(F.lit(">"), "_new")).otherwise(F.col("value")).alias("value"), "chrom")


class References:
    """A registry of exon references by name: a folder with one Parquet table each. Nothing is downloaded; a missing one says where to put it."""

    def __init__(self, folder: str):
        self.folder = folder

    def names(self) -> list[str]:
        return sorted(x.removesuffix(".parquet") for x in os.listdir(self.folder) if x.endswith(".parquet")) if os.path.isdir(self.folder) else []

    def resolve(self, value: str, kind: str = "parquet") -> str:
        """A path stays; a known name gives its artifact of the kind (parquet, table, gtf, fasta, fai)."""
        if os.path.exists(value):
            return value
        path = os.path.join(self.folder, f"{value}.{kind}")
        if not os.path.exists(path):
            raise ValueError(f"{value} is neither a file nor one of {self.names()}; expected {path}")
        return path

    def table(self, spark: SparkSession) -> DataFrame:
        size = lambda p: sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(p) for f in fs) if os.path.isdir(p) else os.path.getsize(p)
        return spark.createDataFrame([(n, size(os.path.join(self.folder, f"{n}.parquet"))) for n in self.names()], "name string, bytes bigint")

    def load(self, spark: SparkSession, name: str) -> DataFrame:
        return read_reference(spark, self.resolve(name))


@F.pandas_udf(T.StringType())
def six_digits(s: pd.Series) -> pd.Series:
    """A number with six significant digits, as C's %.6g writes it; a null is nan."""
    return s.map(lambda v: "nan" if v != v else f"{v:.6g}")
