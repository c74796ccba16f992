"""GTF and GFF3 files: lossless rows, attributes, and the writer."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.sources.tables import numbered_rows, with_place, with_record_id

COLUMNS = ("seqname", "source", "feature", "start", "end", "score", "strand", "frame", "attributes")
# What a key and its value look like in the two formats.
GTF_PAIR = r'(\w+)\s+"(.*?)"(?:;|$)'
GFF_PAIR = r"(\w+)=([^;]*)"


def is_gff(path: str) -> bool:
    return re.search(r"\.gff3?(?:\.gz)?$", path) is not None


def pairs(attributes: Column, gff: bool = False) -> Column:
    """The attributes in order as array<struct<key, value>>; a quoted `;` is part of the value."""
    pattern = F.lit(GFF_PAIR if gff else GTF_PAIR)
    keys, values = F.regexp_extract_all(attributes, pattern, F.lit(1)), F.regexp_extract_all(attributes, pattern, F.lit(2))
    return F.transform(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda x: F.struct(x["k"].alias("key"), x["v"].alias("value")))


def first_value(attributes: Column, key: str) -> Column:
    """The first value of a key; null when it isn't there."""
    return F.get(F.filter(pairs(attributes), lambda x: x["key"] == key), F.lit(0))["value"]


def with_values(df: DataFrame, attributes: str, keys: Sequence[str]) -> DataFrame:
    """`df` with a column per key, its first value; the text is parsed once for all of them."""
    parsed = df.withColumn("_pairs", pairs(F.col(attributes)))
    return parsed.withColumns({k: F.get(F.filter("_pairs", _has(k)), F.lit(0))["value"] for k in keys}).drop("_pairs")


def _has(key: str):
    return lambda x: x["key"] == key


def attribute_map(attributes: Column, gff: bool = False) -> Column:
    """Key to value; the values of a key that comes several times are joined by `; `."""
    got = pairs(attributes, gff)
    keys = F.array_distinct(F.transform(got, lambda x: x["key"]))
    joined = F.transform(keys, lambda k: F.array_join(F.transform(F.filter(got, lambda x: x["key"] == k), lambda x: x["value"]), "; "))
    return F.map_from_arrays(keys, joined)


def parse_lines(lines: DataFrame, line: str = "value", gff: bool = False) -> DataFrame:
    """The nine columns, typed, with the attribute map; lines without nine fields or with other coordinates than integers, and comments, are skipped. Blanks in source become `_`. Other columns of `lines` stay."""
    f = F.split(F.regexp_replace(line, r"\r$", ""), "\t", -1)
    rows = lines.where(F.col(line).isNotNull() & ~F.col(line).startswith("#")).withColumn("_f", f).where(F.size("_f") == 9)
    for i, c in enumerate(COLUMNS):
        v = F.get("_f", F.lit(i))
        rows = rows.withColumn(c, v.try_cast("bigint") if c in ("start", "end") else F.replace(v, F.lit(" "), F.lit("_")) if c == "source" else v)
    return rows.where(F.col("start").isNotNull() & F.col("end").isNotNull()).withColumn("attrs", attribute_map(F.col("attributes"), gff)).drop("_f")


def read_gtf(spark: SparkSession, path: str, gff: bool | None = None, names: DataFrame | None = None, search: str | None = None, strict: bool = False) -> DataFrame:
    """The rows of a file, a folder or a pattern, with `_ord`, their place in it (files by name). In each file, lines from `##FASTA` on are left out.

    names (old, new) renames sequences - a name that isn't there stays; search keeps those whose new name
    matches. strict ends with an error where a line that is no comment doesn't parse.
    """
    text = numbered_rows(with_place(spark.read.text(path)), "_ord").drop("_block", "_row")
    stops = text.where(F.col("value").startswith("##FASTA")).groupBy("_file").agg(F.min("_ord").alias("_stop"))
    kept = text.join(stops, "_file", "left").where("_stop is null or _ord < _stop").drop("_file", "_stop")
    rows = parse_lines(kept, gff=is_gff(path) if gff is None else gff)
    if strict:
        data = kept.where((F.trim("value") != "") & ~F.col("value").startswith("#"))
        if lost := data.join(rows.select("_ord"), "_ord", "left_anti").limit(1).collect():
            raise ValueError(f"{path}: line {lost[0]['_ord'] + 1} doesn't parse: {lost[0]['value'][:80]!r}")
    rows = rows.drop("value")
    if names is not None:
        rows = rows.join(names.select(F.col("old").alias("seqname"), "new"), "seqname", "left").withColumn("seqname", F.coalesce("new", "seqname")).drop("new")
    return rows.where(F.col("seqname").rlike(search)) if search else rows


def read_comments(spark: SparkSession, path: str) -> list[str]:
    """The comment lines before the first row of a file, in order: a header, so that they fit the driver."""
    text = with_record_id(spark.read.text(path), "_ord").where(F.trim("value") != "")
    first = text.where(~F.col("value").startswith("#")).agg(F.min("_ord")).first()[0]
    head = text.where(F.col("value").startswith("#"))
    return [r["value"] for r in (head if first is None else head.where(F.col("_ord") < first)).orderBy("_ord").collect()]


def format_attributes(items: Sequence[tuple[str, Column]]) -> Column:
    """`key "value";` for each non-null value, in the given order."""
    return F.array_join(F.filter(F.array(*[F.when(v.isNotNull(), F.concat(F.lit(f'{k} "'), v.cast("string"), F.lit('";'))) for k, v in items]), lambda x: x.isNotNull()), " ")


def gtf_line() -> Column:
    return F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in COLUMNS])


def write_gtf(rows: DataFrame, path: str, order: str | None = None, comments: Sequence[str] = ()) -> None:
    """Text files sorted by (seqname, start, end, order); gzip when the path ends with .gz. Comments come first."""
    if rows.where(F.col("seqname").isNull() | F.col("start").isNull() | (F.col("start") > F.col("end"))).limit(1).count():
        raise ValueError("rows without sequence name or with reversed coordinates")
    by = ["seqname", "start", "end", *([order] if order else [])]
    lines = rows.orderBy(*by).select(gtf_line().alias("value"))
    if comments:
        head = rows.sparkSession.createDataFrame([(c if c.startswith("#") else f"#{c}",) for c in comments], "value string").coalesce(1)
        lines = head.union(lines)
    lines.write.mode("overwrite").option("compression", "gzip" if path.endswith(".gz") else "none").text(path)
