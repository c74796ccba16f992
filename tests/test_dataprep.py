"""The data-preparation operators against brute force, and on nulls, empties, ties, repeats and clashing columns."""

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from strandloom import runtime
from strandloom.operators import chunking, lineparse, orphans, runbitmap, skew, unpack

T = [dt.datetime(2024, m, 1) for m in range(1, 13)]


# ---- p1 ----------------------------------------------------------------------------------------------


def test_orphans_timed(spark, rows):
    target = spark.createDataFrame([("a", T[2], None), ("b", T[1], T[3]), ("b", T[5], None), ("c", T[8], None), (None, T[0], None), ("d", None, None)], "k string, since timestamp, until timestamp")
    child = spark.createDataFrame([(1, " A ", T[2]), (2, "a", T[0]), (3, "b", T[4]), (4, "B", T[6]), (5, "c", T[1]), (6, "x", T[1]), (7, None, T[1]), (8, "d", T[1]), (9, "a", None), (9, "a", None), (10, "b", T[3]), (11, "", T[3])], "id int, ref string, at timestamp")
    got = rows(orphans.orphan_references(child, ["ref"], "at", target, ["k"], "since", "until"), "id", "_status")
    assert got == [(2, "late"), (3, "deleted"), (5, "late"), (6, "missing"), (8, "deleted"), (9, "deleted"), (9, "deleted"), (10, "deleted"), (11, "missing")]


def test_orphans_null_masks(spark, rows):
    target = spark.createDataFrame([("a", "1", "+"), ("b", "2", None), (None, "3", "-")], "k1 string, k2 string, k3 string")
    data = [("a", "1", "+"), ("a", None, "+"), ("a", "2", None), (None, "3", None), (None, None, None), ("b", None, "-"), (None, None, "-")]
    child = spark.createDataFrame([(i, *x) for i, x in enumerate(data)], "id int, r1 string, r2 string, r3 string")
    run = lambda how: rows(orphans.orphan_references(child, ["r1", "r2", "r3"], None, target, ["k1", "k2", "k3"], semantics=how), "id", "_status")
    assert run("simple") == []
    assert run("partial") == [(2, "missing"), (5, "missing")]
    assert run("full") == [(i, "incomplete") for i in (1, 2, 3, 5, 6)]
    with pytest.raises(ValueError):
        run("other")


def test_orphans_empty_and_clashing(spark, rows):
    child = spark.createDataFrame([(1, "x", "k")], "id int, ref string, k string")
    none = spark.createDataFrame([], "k string")
    assert rows(orphans.orphan_references(child, ["ref"], None, none, ["k"]), "id", "k", "_status") == [(1, "k", "missing")]
    assert rows(orphans.orphan_references(child.limit(0), ["ref"], None, none, ["k"])) == []
    with pytest.raises(ValueError):
        orphans.orphan_references(child.withColumn("_key", F.lit(1)), ["ref"], None, none, ["k"])


def test_contig_alias(spark, rows):
    contig = spark.createDataFrame([("1", T[0], None), ("X", T[0], None)], "name string, added_at timestamp, retired_at timestamp")
    alias = spark.createDataFrame([("chr1", "1"), ("X", "1"), ("chrW", "W"), (None, "1")], "alias string, name string")
    assert rows(orphans.contig_names(contig, alias), "key") == [("1",), ("CHR1",), ("X",)]


def test_hot_keys_store_only_what_may_be_hot(spark, monkeypatch):
    df = spark.range(3000).select(F.when(F.col("id") < 600, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    stored = []
    real = runtime.cut
    keep = lambda x: stored.append(real(x)) or stored[-1]
    monkeypatch.setattr(runtime, "cut", keep)
    monkeypatch.setattr(skew, "cut", keep, raising=False)
    assert [tuple(r) for r in skew.hot_keys(df, F.col("k"), 100).collect()] == [("hot", 2)]
    assert [x.count() for x in stored] == [1]


def test_keyed_join_salts_hot_keys(spark, monkeypatch):
    left = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 50).cast("string")).alias("k"), "id").union(spark.createDataFrame([(None, -1)], "k string, id long"))
    right = spark.createDataFrame([("hot", 1), ("7", 2)], "k string, v int")
    monkeypatch.setattr(skew, "LEAST_ROWS", 100)
    assert [(r["_k"], r["_parts"] > 1) for r in skew.hot_keys(left, F.col("k")).collect()] == [("hot", True)]
    assert skew.hot_keys(left.where("k is null"), F.col("k")) is None and skew.hot_keys(left.limit(0), F.col("k")) is None
    got = Counter(r["v"] for r in skew.keyed_left_join(left, right, "k", ["id"], fits=False).select("v").collect())
    assert got[1] == 20_000 and sum(got.values()) == 60_001 and got[2] == sum(i % 3 != 0 and i % 50 == 7 for i in range(60_000))


def test_keyed_join_with_many_hot_keys(spark, monkeypatch):
    """However many keys are hot: all of them are split, and no row is lost or repeated."""
    monkeypatch.setattr(skew, "LEAST_ROWS", 10)
    monkeypatch.setattr(skew, "partitions", lambda df: 200)
    left = spark.range(30_000).select((F.col("id") % 300).cast("string").alias("k"), "id").union(spark.range(30_000, 31_000).select((F.col("id") % 900 + 1000).cast("string").alias("k"), "id"))
    assert skew.hot_keys(left, F.col("k")).count() == 300
    right = spark.range(0, 1300).select(F.col("id").cast("string").alias("k"), (F.col("id") * 2).alias("v"))
    got = skew.keyed_left_join(left, right, "k", ["id"], "inner", fits=False)
    want = sum(1 for i in range(30_000)) + sum(1 for i in range(30_000, 31_000) if i % 900 + 1000 < 1300)
    assert got.count() == want and got.where("cast(k as bigint) * 2 <> v").count() == 0 and got.select("id").distinct().count() == want


def test_small_counts_rows_and_bytes(spark):
    assert runtime.small(spark.range(10)) and not runtime.small(spark.range(20), 10)
    wide = spark.range(20).select(F.expr("repeat('x', 1 << 20)").alias("s"), F.array("id").alias("a"))
    assert not runtime.small(wide) and runtime.small(wide.limit(1)) and runtime.small(wide.limit(0))
    table, facts = runtime.measured(wide.limit(3), most=F.max("a"))
    assert facts["rows"] == 3 == table.count() and facts["bytes"] > 3 << 20 and facts["most"] and not runtime.fits({"rows": 1, "bytes": 1 << 40})


# ---- p2 ----------------------------------------------------------------------------------------------


def test_unpack_pairs(spark, rows):
    data = [
        (1, "s1", 'gene_id "A"; note "x; y, z|w"; n=3'),
        (2, "s1", "gene_id=A,tag = b | tag  \"c\" ,; "),
        (3, "s2", "a=1;b=2"),
        (4, "s2", " "),
        (5, "s2", "."),
        (6, None, None),
        (7, None, ""),
        (8, "s1", 'k "merged  twice"; e ""'),
        (9, "s3", 'k "open; never'),
    ]
    df = spark.createDataFrame(data, "id long, source string, f string")
    got = rows(unpack.unpack(df, "id", "f", "source"))
    assert got == sorted([
        (1, 1, "gene_id", "A"), (1, 2, "note", "x; y, z|w"), (1, 3, "n", "3"), (2, 1, "gene_id", "A"), (2, 2, "tag", "b"), (2, 3, "tag", "c"),
        (3, 1, "a", "1"), (3, 2, "b", "2"), (8, 1, "k", "merged  twice"), (8, 2, "e", ""), (9, 1, "k", '"open; never'),
    ])
    seps = {r["_source"]: r["_seps"] for r in unpack.infer_separators(df.where("f is not null").withColumn("_source", F.coalesce("source", F.lit(""))), "f", "_source", True).collect()}
    assert set(seps["s1"]) == set(";,|") and seps["s2"] == ";"


def test_separators_are_told_apart_by_piece_counts(spark):
    """Sources with one separator each: a wrong candidate gives other piece counts than there are values."""
    make = {"semi": "a 1; b 2, c 3; d 4", "comma": "a 1, b 2, c 3", "bar": "a=1|b=2|c=3|d=4", "both": "a 1; b 2, c 3"}
    data = [(s, f) for s, f in make.items() for _ in range(5)]
    data += [("semi", 'a "x, y"; b "z"')] * 9 + [("quoted", 'k "a, b"; m "c, d"; n "e"')] * 3
    df = spark.createDataFrame(data, "_source string, f string")
    got = {r["_source"]: set(r["_seps"]) for r in unpack.infer_separators(df, "f", "_source", True).collect()}
    assert got["comma"] == {","} and got["bar"] == {"|"} and got["both"] == {";", ","} and got["quoted"] == {";"}
    shapes = {r[0] for r in spark.createDataFrame([("; ".join(f'k{i} "v"' for i in range(n)) + ";",) for n in range(3, 40)], "f string").select(unpack.shape(F.col("f"), True)).collect()}
    assert len(shapes) <= 3


def test_unpack_spans(spark, rows):
    text = ['"1-2", (3–4) ; [5..6]|7:8', "1 - 2 3 - 4  5 -6", "9-10,,11-12", '""', ".", " ", None, "[13 - 14, 15-16]", "17-18\t19-20"]
    df = spark.createDataFrame(list(enumerate(text)), "id long, f string")
    got = defaultdict(list)
    for r in sorted(rows(unpack.unpack(df, "id", "f", pairs=False))):
        got[r[0]].append(r[3])
    assert got == {0: ["1-2", "3-4", "5-6", "7-8"], 1: ["1-2", "3-4", "5-6"], 2: ["9-10", "11-12"], 7: ["13-14", "15-16"], 8: ["17-18", "19-20"]}


def test_unpack_long_and_empty(spark):
    long = ";".join(f'k{i} "{"v;" * 50}"' for i in range(3000))
    df = spark.createDataFrame([(1, "s", long)], "id long, source string, f string")
    assert unpack.unpack(df, "id", "f", "source").count() == 3000
    assert unpack.unpack(df.limit(0), "id", "f", "source").count() == 0


# ---- p3 ----------------------------------------------------------------------------------------------


def brute_periods(data):
    out = []
    for e in {x[0] for x in data if x[0] is not None}:
        spans = sorted((s, t) for k, s, t in data if k == e and s is not None and t is not None and s <= t)
        runs = []
        for s, t in spans:
            if runs and s <= runs[-1][1] + 1:
                runs[-1][1] = max(runs[-1][1], t)
            else:
                runs.append([s, t])
        out += [(e, "period", s, t) for s, t in runs] + [(e, "gap", a[1] + 1, b[0] - 1) for a, b in zip(runs, runs[1:])]
    return sorted(out)


@pytest.mark.parametrize("scale", [60, 3_000, 70_000, 400_000])
def test_periods_brute(spark, rows, scale):
    r = random.Random(scale)
    data = [(r.choice(["a", "b", "c", None]), s := r.choice([None, r.randint(-scale, scale)]), None if s is None else s + r.choice([-1, 0, 1, 5, scale // 20, scale // 2])) for _ in range(150)]
    data += data[:20] + [("edge", 65530, 65535), ("edge", 65536, 65540), ("edge", 65542, 65542), ("long", 1, 1_000_000), ("long", 1_000_001, 1_000_001), ("long", 2_000_000, 2_000_000)]
    got = rows(runbitmap.periods_and_gaps(spark.createDataFrame(data, "e string, s long, t long").withColumn("kind", F.lit(1)), "e", "s", "t"))
    assert got == brute_periods(data)


def test_periods_empty(spark):
    assert runbitmap.periods_and_gaps(spark.createDataFrame([], "e string, s long, t long"), "e", "s", "t").count() == 0


@pytest.mark.parametrize("most", [0, 1, 64])
def test_periods_long(spark, rows, monkeypatch, most):
    monkeypatch.setattr(runbitmap, "LONG_SHARDS", most)
    r = random.Random(most)
    data = [(r.choice("abcd"), s := r.randint(-400_000, 400_000), s + r.choice([0, 9, 70_000, 200_000])) for _ in range(40)]
    data += [("huge", 5, (1 << 62)), ("huge", -10, 3), ("huge", -100, -100), ("neg", -(1 << 60), -1), ("neg", 1, 70_000), ("pair", 0, 10_000_000), ("pair", 10_000_001, 10_000_001), ("pair", 20_000_000, 40_000_000)]
    assert rows(runbitmap.periods_and_gaps(spark.createDataFrame(data, "e string, s long, t long"), "e", "s", "t")) == brute_periods(data)


def test_periods_flush(spark, rows, monkeypatch):
    monkeypatch.setattr(runbitmap, "FLUSH_ROWS", 16)
    monkeypatch.setattr(runbitmap, "FLUSH_BYTES", 64)
    r = random.Random(1)
    data = [(f"e{r.randint(0, 30)}", s := r.randint(0, 200_000), s + r.randint(0, 400)) for _ in range(3000)]
    assert rows(runbitmap.periods_and_gaps(spark.createDataFrame(data, "e string, s long, t long").repartition(3), "e", "s", "t")) == brute_periods(data)


# ---- p5 ----------------------------------------------------------------------------------------------


def test_chunks_and_numbers(spark, rows):
    r = random.Random(4)
    data = [(r.choice(["hot"] * 6 + ["a", "b", None]), i, r.choice("xy"), r.randint(0, 9)) for i in range(2000)]
    df = spark.createDataFrame(data, "k string, i long, lab string, v long").repartition(5)
    counts = Counter(x[0] for x in data)
    chunks = rows(chunking.chunk_states(df, "k", 100))
    assert all(n <= 100 for _, _, n, _, _ in chunks) and all(sum(n for k, _, n, _, _ in chunks if k == key) == c for key, c in counts.items())
    assert all(n == 100 for k, c, n, _, _ in chunks if c < counts[k] // 100) and all(a // 100 == c == b // 100 for _, c, _, a, b in chunks)
    stored = chunking.numbered_as_stored(df, "k").collect()
    assert all(sorted(x["_no"] for x in stored if x["k"] == key) == list(range(c)) for key, c in counts.items())
    assert all(r["joined"] for r in chunking.merged_counts(chunking.chunk_states(df, "k", 100), "k").collect())
    nos = chunking.numbered(df, "k", ["i"]).select("k", "i", "_no").collect()
    for key in counts:
        assert [x["_no"] for x in sorted((x for x in nos if x["k"] == key), key=lambda x: x["i"])] == list(range(counts[key]))
    got = {x["k"]: x for x in chunking.key_profiles(df, "k", ["i"], F.col("lab"), F.col("v"), 37).collect()}
    for key in counts:
        if key is not None:
            mine = sorted((x for x in data if x[0] == key), key=lambda x: x[1])
            assert (got[key]["rows"], got[key]["value_sum"], got[key]["changes"]) == (len(mine), sum(x[3] for x in mine), sum(a[2] != b[2] for a, b in zip(mine, mine[1:])))
    assert None not in got
    assert {x["k"] for x in chunking.heavy_keys(df, "k", 0.03, 100).collect()} == {k for k, c in counts.items() if k and c >= 60}
    assert chunking.heavy_keys(df.limit(0), "k", 0.03).count() == 0
    again = chunking.key_profiles(df.union(df.where("k = 'a'")), "k", ["i"], F.col("lab"), F.col("v"), 37).where("k = 'a'").first()
    assert (again["rows"], again["changes"]) == (2 * counts["a"], got["a"]["changes"])


# ---- p6 ----------------------------------------------------------------------------------------------

SITES = {
    "1\t5\t+\tA\tc\tnote": None, '"1"\t007\t.\t.\t-\t"a\tb ""q"""': None, "1\t5\t+\tA\tc\t\r": None, "": "skip", "  \t ": "skip", "#x": "skip", None: "skip", "1\t5\t+\tA\tc": "column_count", "1\t5\t+\tA\tc\tn\tm": "column_count",
    '"1\t5\t+\tA\tc\tn': "quoting", '1\t5\t+\t"A"G\tc\tn': "quoting", '1\t5\t+\tA\tc\t"x" y': "quoting", " \t5\t+\tA\tc\tn": "value", '""\t5\t+\tA\tc\tn': "value", "1\t0\t+\tA\tc\tn": "value", "1\t2147483648\t+\tA\tc\tn": "value",
    "1\t2147483647\t+\tA\tc\tn": None, "1\t٣\t+\tA\tc\tn": "value", "1\t+5\t+\tA\tc\tn": "value", "1\t5\t*\tA\tc\tn": "value", "1\t5\t+\tAZ\tc\tn": "value", "1\t5\t+\tA\t..\tn": "value", '1\t5\t+\tA\tc\tunit 7"': None,
    "1\t" + "9" * 5000 + "\t+\tA\tc\tn": "value", '1\t5\t+\tA\tc\t"' + '""' * 20000 + '"': None, '1\t5\t+\tA\tc\t"' + "\t" * 3000 + '"': None, '1\t5\t+\tA\tc\t""': None, '1\t5\t+\tA\tc\t"""': "quoting",
}


def test_site_lines(spark):
    keys = list(SITES)
    df = spark.createDataFrame(list(enumerate(keys)), "line_no long, line string").withColumn("reason", F.lit("other"))
    got = {r["line_no"]: r for r in lineparse.split_lines(df, "line_no", "line", lineparse.SITES).collect()}
    for i, k in enumerate(keys):
        assert (got[i]["reason"] if i in got else "skip") == SITES[k], (k or "")[:60]
    assert got[1]["chrom"] == "1" and got[1]["pos"] == 7 and got[1]["note"] == 'a\tb "q"' and got[2]["note"] == ""
    assert lineparse.split_lines(df.limit(0), "line_no", "line", lineparse.SITES).count() == 0
    why = {k: got[i]["detail"] for i, k in enumerate(keys) if i in got}
    assert why["1\t0\t+\tA\tc\tn"] == "pos: out of range" and why["1\t٣\t+\tA\tc\tn"] == "pos: not a number" and why['""\t5\t+\tA\tc\tn'] == "chrom: empty"
    short = {r["line_no"]: (r["reason"], r["detail"]) for r in lineparse.split_lines(df, "line_no", "line", lineparse.SITES, load=False).collect()}
    assert short == {i: (r["reason"], r["detail"]) for i, r in got.items()}


def test_values_are_cast_once_each(spark):
    lines = ["1\t7\t+\tA\tc\tn"] * 50 + ["1\tx\t+\tA\tc\tn"] * 50 + ["1\tx\t*\tA\tc\tn"]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no long, line string")
    cells = lineparse.cells_of(lineparse.parsed(df, "line_no", "line", lineparse.SITES), lineparse.SITES)
    d = sorted(tuple(r) for r in lineparse.value_dictionary(cells, lineparse.SITES, False).select("_column", "_why").collect())
    assert d == [("pos", "pos: not a number"), ("strand", "strand: not one of + - .")]
    loaded = lineparse.split_lines(df, "line_no", "line", lineparse.SITES).where("reason is null").collect()
    assert len(loaded) == 50 and {r["pos"] for r in loaded} == {7}
    assert lineparse.split_lines(df, "line_no", "line", lineparse.SITES).where("line_no = 100").first()["detail"] == "pos: not a number, strand: not one of + - ."


def feature(attrs, start="1", end="9", score=".", strand="+", frame="."):
    return "\t".join(["c", "s", "exon", start, end, score, strand, frame, attrs])


FEATURES = {
    feature('gene_id "a"; note "x;y"'): None, feature('gene_id "a" ;'): None, feature("gene_id a"): None, feature("gene_id=a"): None, feature('gene_id ""'): "value", feature(""): "value", feature('note "gene_id b; lost"'): "value",
    feature('gene_id "a" x'): "quoting", feature('gene_id "a'): "quoting", feature('gene_id "a"', "9", "1"): "value", feature('gene_id "a"', "x"): "value", feature('gene_id "a"', score="1e"): "value", feature('gene_id "a"', score="-1.5"): None,
    feature('gene_id "a"', score="1,5"): "value", feature('gene_id "a"', strand="++"): "value", feature('gene_id "a"', frame="3"): "value", feature('gene_id "a"') + "\tx": "column_count", feature('gene_id "' + "a" * 30000 + '"'): None,
}


def test_feature_lines(spark):
    keys = list(FEATURES)
    df = spark.createDataFrame(list(enumerate(keys)), "line_no long, line string")
    got = {r["line_no"]: r["reason"] for r in lineparse.split_lines(df, "line_no", "line", lineparse.FEATURES).collect()}
    assert [got[i] for i in range(len(keys))] == list(FEATURES.values())
