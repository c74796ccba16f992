"""Rows that fail to parse: valid lines load, the others come out with a reason.

Structural checks (quoting, column count) are made on the line. Then every distinct value of a column is cast and
checked once; the invalid ones form a dictionary (column, value, reason) that is joined back to the lines. Where
lines are loaded, the typed values come from the same dictionary.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.operators.skew import keyed_left_join
from strandloom.runtime import cut, fits, measured, table

LARGEST = 2147483647


def first_of(*rules: tuple[Column, str]) -> Column:
    """The word of the first rule that holds, null when none does."""
    out = F.when(F.coalesce(rules[0][0], F.lit(False)), rules[0][1])
    for bad, why in rules[1:]:
        out = out.when(F.coalesce(bad, F.lit(False)), why)
    return out


def position_fault(c: Column) -> Column:
    """ASCII digits only, 1 to 2147483647; leading zeros are fine."""
    bare = F.regexp_replace(c, "^0+", "")
    return first_of((F.trim(c) == "", "empty"), (~c.rlike("^[0-9]+\\z"), "not a number"), ((F.length(bare) > 10) | ~F.coalesce(bare.try_cast("bigint"), F.lit(0)).between(1, LARGEST), "out of range"))


def strand_fault(c: Column) -> Column:
    return first_of((c == "", "empty"), (~c.isin("+", "-", "."), "not one of + - ."))


def allele_fault(c: Column) -> Column:
    return first_of((c == "", "empty"), (~c.rlike("^(?:[ACGTNacgtn]+|[.-])\\z"), "not bases"))


def score_fault(c: Column) -> Column:
    return first_of((c == "", "empty"), (~c.rlike("^(?:\\.|[+-]?(?:[0-9]+(?:\\.[0-9]*)?|\\.[0-9]+))\\z"), "not a number"))


def frame_fault(c: Column) -> Column:
    return first_of((c == "", "empty"), (~c.isin(".", "0", "1", "2"), "not one of . 0 1 2"))


def name_fault(c: Column) -> Column:
    return first_of((F.trim(c) == "", "empty"))


def greater(a: Column, b: Column) -> Column:
    """Whether the digits of a make a greater number than those of b; texts are compared, nothing is cast."""
    x, y = F.regexp_replace(a, "^0+", ""), F.regexp_replace(b, "^0+", "")
    return (F.length(x) > F.length(y)) | ((F.length(x) == F.length(y)) & (x > y))


def quoted_texts_closed(c: Column) -> Column:
    """Each double quote is closed, and a closing one is followed, blanks aside, by `;` or the end."""
    parts = F.split(c, '"', -1)
    last = F.size(parts) - 1
    after = F.transform(parts, lambda x, i: F.when((i == 0) | (i % 2 == 1), True).otherwise(F.ltrim(x).startswith(";") | ((i == last) & (F.ltrim(x) == ""))))
    return (F.size(parts) % 2 == 1) & F.forall(after, lambda x: x)


def attribute_value(c: Column, key: str) -> Column:
    """The value of `key` in a GTF attribute text, outside quotes of other values; null when it isn't there."""
    items = F.regexp_extract_all(c, F.lit('[^;"]*+(?:"[^"]*+"[^;"]*+)*+'), F.lit(0))
    return F.regexp_extract(F.get(F.filter(items, lambda x: x.rlike(f"^\\s*{key}[\\s=]")), F.lit(0)), f'^\\s*{key}(?:\\s*=\\s*|\\s+)(?:"([^"]*)"|([^\\s"]*))', 0)


def gene_text(c: Column) -> Column:
    """The gene_id of an attribute text without quotes and blanks; empty when there is none."""
    got = F.regexp_replace(F.regexp_replace(attribute_value(c, "gene_id"), r"^\s*gene_id(?:\s*=\s*|\s+)", ""), r'["\s]', "")
    return F.coalesce(got, F.lit(""))


@dataclass(frozen=True)
class Layout:
    """A kind of file: its columns, whether fields may be quoted, the fault of each column's values (null for a sound
    one) and the part of a column that is checked, if not all of it; the fault of a whole line; and types."""

    columns: tuple[str, ...]
    quoted_fields: bool = False
    quoted_column: str | None = None
    faults: Mapping[str, Callable[[Column], Column]] = field(default_factory=dict)
    parts: Mapping[str, Callable[[Column], Column]] = field(default_factory=dict)
    rows: Callable[[], Column] | None = None
    types: Mapping[str, str] = field(default_factory=dict)


SITES = Layout(
    columns=("chrom", "pos", "strand", "ref", "alt", "note"),
    quoted_fields=True,
    faults={"chrom": name_fault, "pos": position_fault, "strand": strand_fault, "ref": allele_fault, "alt": allele_fault},
    types={"pos": "bigint"},
)
FEATURES = Layout(
    columns=("seqname", "source", "feature", "start", "end", "score", "strand", "frame", "attributes"),
    quoted_column="attributes",
    faults={"start": position_fault, "end": position_fault, "score": score_fault, "strand": strand_fault, "frame": frame_fault, "attributes": lambda c: first_of((c == "", "no gene_id"))},
    parts={"attributes": gene_text},
    rows=lambda: greater(F.col("start"), F.col("end")),
    types={"start": "bigint", "end": "bigint"},
)


def quoted_fields(line: Column, most: int) -> Column:
    """The fields of a tab-parted line in which a field that starts with `"` ends at the closing one, as
    struct(bad, n, open, text, values): bad - a quote fails; n - how many fields; values - the first `most`.

    The line is parted at each tab and folded from left to right; while a quote is open, parts are joined.
    """
    start = F.struct(F.lit(False).alias("bad"), F.lit(0).alias("n"), F.lit(False).alias("open"), F.lit("").alias("text"), F.array().cast("array<string>").alias("values"))

    def step(s: Column, part: Column) -> Column:
        opens = ~s["open"] & part.startswith('"')
        body = F.when(opens, part.substr(F.lit(2), F.length(part))).otherwise(part)
        rest = F.replace(body, F.lit('""'), F.lit(""))
        quoted = opens | s["open"]
        closes = quoted & (F.length(rest) - F.length(F.replace(rest, F.lit('"'), F.lit(""))) == 1) & rest.endswith('"')
        bad = quoted & rest.contains('"') & ~closes
        stays = quoted & ~rest.contains('"')
        plain = F.replace(F.when(closes, body.substr(F.lit(1), F.length(body) - 1)).otherwise(body), F.lit('""'), F.lit('"'))
        text = F.when(~quoted, part).when(opens, plain).otherwise(F.concat(s["text"], F.lit("\t"), plain))
        done = ~stays
        n = s["n"] + F.when(done, 1).otherwise(0)
        return F.struct(
            (s["bad"] | bad).alias("bad"),
            n.alias("n"),
            stays.alias("open"),
            F.when(stays, text).otherwise("").alias("text"),
            F.when(done & (n <= most), F.array_append(s["values"], text)).otherwise(s["values"]).alias("values"),
        )

    return F.aggregate(F.split(line, "\t", -1), start, step)


def parsed(df: DataFrame, row_id: str, line: str, layout: Layout) -> DataFrame:
    """(_id, _reason, columns): each line that is neither null, blank nor a comment, with its fields as text and its structural reason, if any."""
    size = len(layout.columns)
    text = F.when(F.col(line).endswith("\r"), F.expr(f"left(`{line}`, length(`{line}`) - 1)")).otherwise(F.col(line))
    rows = df.select(F.col(row_id).alias("_id"), text.alias("_line")).where(~F.col("_line").startswith("#") & F.col("_line").rlike(r"[^ \t\r\n\f\x0b]"))
    plain = F.split("_line", "\t", -1)
    if layout.quoted_fields:
        simple = F.struct(F.lit(False).alias("bad"), F.size(plain).alias("n"), F.lit(False).alias("open"), F.lit("").alias("text"), F.slice(plain, 1, size).alias("values"))
        rows = rows.withColumn("_f", F.when(F.col("_line").rlike('(?:^|\t)"'), quoted_fields(F.col("_line"), size)).otherwise(simple))
        bad = F.when(F.col("_f.bad") | F.col("_f.open"), "quoting").when(F.col("_f.n") != size, "column_count")
        values = F.col("_f.values")
    else:
        rows = rows.withColumn("_f", plain)
        bad = F.when(F.size("_f") != size, "column_count")
        values = F.col("_f")
    rows = rows.select("_id", bad.alias("_reason"), *[F.get(values, F.lit(i)).alias(c) for i, c in enumerate(layout.columns)])
    if layout.quoted_column:
        rows = rows.withColumn("_reason", F.coalesce("_reason", F.when(~quoted_texts_closed(F.col(layout.quoted_column)), "quoting")))
    return rows


def cells_of(rows: DataFrame, layout: Layout, columns: Sequence[str] | None = None) -> DataFrame:
    """(_id, _c, _v): the checked columns of the structurally sound lines, one value per row."""
    sound = rows.where(F.col("_reason").isNull())
    value = lambda c: F.coalesce(layout.parts.get(c, lambda x: x)(F.col(c)), F.lit(""))
    return sound.select("_id", F.explode(F.array(*[F.struct(F.lit(c).alias("_c"), value(c).alias("_v")) for c in (columns or layout.faults)])).alias("x")).select("_id", "x.*")


def value_dictionary(cells: DataFrame, layout: Layout, typed: bool) -> DataFrame:
    """(_key, _c, _why, _typed): each distinct value of each column is cast and checked once. Sound values are kept only where their type is wanted."""
    values = cells.select("_c", "_v").distinct()
    why = F.lit(None).cast("string")
    for c, fault in layout.faults.items():
        why = F.when(F.col("_c") == c, fault(F.col("_v"))).otherwise(why)
    cast = F.when(F.col("_c").isin(*layout.types), F.col("_v").try_cast("bigint")) if layout.types else F.lit(None).cast("bigint")
    checked = values.select(F.concat_ws("\x1f", "_c", "_v").alias("_key"), "_c", F.concat_ws(": ", "_c", why).alias("_why"), why.isNull().alias("_sound"), cast.alias("_typed"))
    kept = checked.where(~F.col("_sound") | (F.lit(typed) & F.col("_c").isin(*layout.types)))
    return kept.select("_key", F.col("_c").alias("_column"), F.when(~F.col("_sound"), F.col("_why")).alias("_why"), F.when(F.col("_sound"), F.col("_typed")).alias("_typed"))


def split_lines(df: DataFrame, row_id: str, line: str, layout: Layout, load: bool = True) -> DataFrame:
    """(row_id, reason, detail, columns): all lines but null, blank and comment lines; reason is null for a valid line.

    reason: `quoting`, `column_count` or `value`, the first that the layout's order gives; detail names the
    invalid columns and why. Columns are typed for valid lines and null for others; without `load` they are left out.
    `row_id` must be unique; a final carriage return is dropped; a line of any size is read whole.
    """
    rows = parsed(df, row_id, line, layout)
    # parsed once; without load only what is checked
    rows = cut(rows if load else rows.select("_id", "_reason", *[c for c in layout.columns if c in layout.faults]))
    cells = cells_of(rows, layout)
    dictionary, facts = measured(value_dictionary(cells, layout, load))
    met = keyed_left_join(cells.withColumn("_key", F.concat_ws("\x1f", "_c", "_v")), dictionary, "_key", ["_id"], "inner", fits(facts))
    by_line = met.groupBy("_id").agg(F.array_join(F.array_sort(F.collect_set("_why")), ", ").alias("_why"), *[F.max(F.when(F.col("_column") == c, F.col("_typed"))).alias(f"_typed_{c}") for c in layout.types if load])
    both = rows.join(by_line, "_id", "left")
    wrong = F.coalesce(F.col("_why"), F.lit("")) != ""
    crossed = F.lit(False) if layout.rows is None else F.coalesce(layout.rows(), F.lit(False))
    reason = F.coalesce(F.col("_reason"), F.when(wrong | crossed, "value"))
    detail = F.when(wrong, F.col("_why")).when(F.col("_reason").isNull() & crossed, "columns disagree")
    ready = both.withColumn("_reason", reason).withColumn("_why", detail)
    out = ready.select(F.col("_id").alias(row_id), F.col("_reason").alias("reason"), F.col("_why").alias("detail"), *[F.when(F.col("_reason").isNull(), F.col(f"_typed_{c}").cast(layout.types[c]) if c in layout.types else F.col(c)).alias(c) for c in layout.columns if load])
    return out


def found(spark, sf: str) -> DataFrame:
    """p6_found: the lines of site_lines and feature_lines that don't parse, with the reason."""
    parts = [split_lines(table(spark, sf, t), "line_no", "line", k, load=False).where("reason is not null").select(F.lit(t).alias("src_table"), "line_no", "reason") for t, k in (("site_lines", SITES), ("feature_lines", FEATURES))]
    return parts[0].unionByName(parts[1])


def sites(spark, sf: str) -> DataFrame:
    """p6_sites: the valid lines of site_lines, loaded."""
    return split_lines(table(spark, sf, "site_lines"), "line_no", "line", SITES).where("reason is null").drop("reason", "detail")


def features(spark, sf: str) -> DataFrame:
    """p6_features: the valid lines of feature_lines, loaded."""
    return split_lines(table(spark, sf, "feature_lines"), "line_no", "line", FEATURES).where("reason is null").drop("reason", "detail")
