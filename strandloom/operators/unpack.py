"""Several values packed in one field, with separators that differ from row to row.

The separators of a source are inferred: each field is reduced to its shape (quoted texts, words or numbers
become one sign), shapes are counted, and every candidate set of separators is scored on the counted shapes:
piece-count consistency (the share of fields with as many pieces as their words or numbers make values) times
piece type regularity (the share of pieces that have the type). The best set wins; of equal ones that with the
fewest separators. A source may mix separators, also within a field, so candidates are sets.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.operators.skew import keyed_left_join
from strandloom.runtime import fits, measured, norm, table

BLANKS = " \t\r\n"
#: What may join the two numbers of a span.
JOINS = "-–.:"
SPAN_SIGNS = (",", ";", "|", "\t", " ")
PAIR_SIGNS = (";", ",", "|")


def candidates(signs: tuple[str, ...]) -> list[str]:
    """All sets of separators, small ones first."""
    return ["".join(c) for n in range(1, len(signs) + 1) for c in combinations(signs, n)]


def span_split(seps: str) -> str:
    """The regular expression that parts spans: a blank parts only where it doesn't stand beside a joining sign."""
    parts = ["[" + "".join(s for s in seps if s != " ") + "]"] if seps.strip(" ") else []
    if " " in seps:
        parts.append(f"(?<![{JOINS} ]) +(?![{JOINS} ])")
    return "|".join(parts)


def pair_take(seps: str) -> str:
    """The regular expression of one item: no separator outside double quotes; a quote that isn't closed goes on to the end."""
    return f'[^{seps}"]*+(?:"[^"]*+(?:"|\\z)[^{seps}"]*+)*+'


def pieces(field: Column, seps: str | Column, pairs: bool) -> Column:
    """The non-blank pieces of a field, trimmed. `seps` is a pattern from span_split or pair_take, as text or column."""
    pattern = F.lit(seps) if isinstance(seps, str) else seps
    got = F.regexp_extract_all(field, pattern, F.lit(0)) if pairs else F.split(field, pattern)
    return F.filter(F.transform(got, lambda x: F.btrim(x, F.lit(BLANKS))), lambda x: x != "")


#: Signs in shapes: a quoted text, a word, a number.
QUOTED, WORD, NUMBER = "\x01", "w", "N"


def shape(field: Column, pairs: bool) -> Column:
    """A field's shape. Of three and more neighbouring values of one form two are kept, so that shapes stay few however long fields are."""
    if pairs:
        signs = F.regexp_replace(F.regexp_replace(F.regexp_replace(field, r'"[^"]*+"', QUOTED), rf'[^\s;,|="{QUOTED}]++', WORD), r"\s++", " ")
        return F.regexp_replace(signs, r"([^;,|]++[;,|] ?)\1{2,}+", "$1$1")
    signs = F.regexp_replace(field, "[0-9]++", NUMBER)
    return F.regexp_replace(signs, r"(N[^N]++N[^N]++)\1{2,}+", "$1$1")


#: The type of a piece, on its shape.
PAIR_TYPE = rf"^[{WORD}{QUOTED}]++(?:\s*=\s*|\s+)[{WORD}{QUOTED}]++$"
SPAN_TYPE = rf"^[\s\"'()\[\]]*N\s*[{JOINS}]+\s*N[\s\"'()\[\]]*$"


def infer_separators(df: DataFrame, field: str, source: str, pairs: bool) -> DataFrame:
    """(_source, _seps, _pattern): the separators of each source, inferred from all its fields.

    A value has two parts (key and value, or two numbers), so a field with 2 n words or numbers has n values; a
    candidate's piece count is consistent in the fields where it is n.
    """
    shapes = df.where(F.col(field).isNotNull()).groupBy(F.col(source).alias("_source"), shape(F.col(field), pairs).alias("_shape")).agg(F.count("*").alias("_n"))
    typed = PAIR_TYPE if pairs else SPAN_TYPE
    make = pair_take if pairs else span_split
    options = candidates(PAIR_SIGNS if pairs else SPAN_SIGNS)
    blank = "" if pairs else "\"'()[] "
    parts = F.length(F.regexp_replace("_shape", f"[^{WORD}{QUOTED}]" if pairs else f"[^{NUMBER}]", ""))

    def counts(seps: str) -> Column:
        got = F.filter(pieces(F.col("_shape"), make(seps), pairs), lambda x: F.btrim(x, F.lit(BLANKS + blank)) != "")
        return F.struct(F.lit(seps).alias("seps"), F.lit(make(seps)).alias("pattern"), F.size(got).alias("all"), F.size(F.filter(got, lambda x: x.rlike(typed))).alias("good"))

    scored = shapes.select("_source", "_n", parts.alias("_parts"), F.explode(F.array(*map(counts, options))).alias("c")).where("c.all > 0")
    by = scored.groupBy("_source", F.col("c.seps").alias("_seps"), F.col("c.pattern").alias("_pattern")).agg(
        F.sum(F.when(F.col("c.all") * 2 == F.col("_parts"), F.col("_n")).otherwise(0)).alias("_even"),
        F.sum("_n").alias("_fields"),
        F.sum(F.col("_n") * F.col("c.good")).alias("_good"),
        F.sum(F.col("_n") * F.col("c.all")).alias("_all"),
    )
    score = F.col("_even") / F.col("_fields") * F.col("_good") / F.col("_all")
    best = F.max_by(F.struct("_seps", "_pattern"), F.struct(score, -F.length("_seps"), F.col("_seps")))
    return by.groupBy("_source").agg(best.alias("b")).select("_source", "b._seps", "b._pattern")


def unpack(df: DataFrame, row_id: str, field: str, source: str | None = None, pairs: bool = True) -> DataFrame:
    """(row_id, item_no, item_key, item_value): one row per value of `field`, item_no from 1 by place.

    pairs: items are key and value, parted by blanks, `=` or both; quotes around a value are dropped, its
    text is kept. Otherwise items are spans `start-end`. Null, empty and blank fields and a lone `.` or pair
    of quotes give no row; empty items are neither shown nor counted. An item without value has a null
    value; a span piece that isn't two numbers keeps its text. Repeated rows give repeated items.
    """
    rows = df.select(F.col(row_id).alias("_id"), F.col(field).alias("_field"), (F.coalesce(F.lower(F.trim(F.col(source).cast("string"))), F.lit("")) if source else F.lit("all")).alias("_source")).where(~F.btrim("_field", F.lit(BLANKS + ("" if pairs else "\"'()[]"))).isin("", "."))
    inferred, facts = measured(infer_separators(rows, "_field", "_source", pairs))
    if source:
        split = keyed_left_join(rows, inferred, "_source", ["_id"], fits=fits(facts))
    else:  # one source: its one pattern goes into the plan
        only = inferred.first()
        split = rows.withColumn("_pattern", F.lit(only["_pattern"] if only else None).cast("string"))
    items = F.coalesce(pieces(F.col("_field"), F.col("_pattern"), pairs), F.array("_field"))
    if not pairs:
        items = F.filter(items, lambda x: F.btrim(x, F.lit(BLANKS + "\"'()[]")) != "")
        one = split.select("_id", F.posexplode(items).alias("_at", "_item"))
        value = F.regexp_replace("_item", "^[^0-9]*+([0-9]++)[^0-9]++([0-9]++)[^0-9]*+$", "$1-$2")
        return one.select(F.col("_id").alias(row_id), (F.col("_at") + 1).cast("long").alias("item_no"), F.lit("span").alias("item_key"), value.alias("item_value"))
    one = split.select("_id", F.posexplode(items).alias("_at", "_item")).withColumn("_kv", F.split("_item", r"\s*=\s*|\s+", 2))
    value = F.get("_kv", F.lit(1))
    bare = F.when((F.length(value) >= 2) & value.startswith('"') & value.endswith('"'), value.substr(F.lit(2), F.length(value) - 2)).otherwise(value)
    return one.select(F.col("_id").alias(row_id), (F.col("_at") + 1).cast("long").alias("item_no"), F.get("_kv", F.lit(0)).alias("item_key"), bare.alias("item_value"))


def found(spark, sf: str) -> DataFrame:
    """p2_found: the values of liftover_annot.spans and feature.attributes."""
    spans = unpack(table(spark, sf, "liftover_annot"), "annot_id", "spans", pairs=False)
    pairs = unpack(table(spark, sf, "feature"), "feature_id", "attributes", "source")
    return spans.select(F.lit("liftover_annot").alias("src_table"), F.col("annot_id").alias("row_id"), "item_no", "item_key", "item_value").unionByName(pairs.select(F.lit("feature").alias("src_table"), F.col("feature_id").alias("row_id"), "item_no", "item_key", "item_value"))


def separators(spark, sf: str) -> DataFrame:
    """p2_separators: the separators inferred for each source of feature.attributes."""
    rows = table(spark, sf, "feature").select("attributes", F.coalesce(F.lower(F.trim("source")), F.lit("")).alias("_source")).where(~F.btrim("attributes", F.lit(BLANKS)).isin("", "."))
    return infer_separators(rows, "attributes", "_source", True).select(F.col("_source").alias("source"), F.col("_seps").alias("separators"))


def by_key(spark, sf: str) -> DataFrame:
    """p2_by_key: how often each key occurs in feature.attributes, with the number of distinct values."""
    return unpack(table(spark, sf, "feature"), "feature_id", "attributes", "source").groupBy("item_key").agg(F.count("*").alias("items"), F.count_distinct(norm("item_value")).alias("item_values"))
