"""The top items of groups against brute force."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandloom.llm import toprank


def test_loser_tree():
    r = random.Random(2)
    for _ in range(200):
        runs = [sorted((r.choice("abc"), r.randint(0, 5), r.randint(0, 9)) for _ in range(r.randint(0, 12))) for _ in range(r.randint(0, 7))]
        n = r.randint(1, 4)
        want = []
        for g in "abc":
            want += [(i, x) for i, x in enumerate(sorted({x for run in runs for x in run if x[0] == g})[:n], 1)]
        assert list(toprank.merge_top(runs, n)) == want


def test_top_items(spark, rows):
    r = random.Random(3)
    data = {(r.choice(["g", "h", "hot", None]), f"i{r.randint(0, 300)}"): (r.choice([None, 1, 2]), r.choice([None, 5, 6, 7])) for _ in range(900)}
    data |= {("one", "x"): (None, None), ("g", None): (0, 9)}
    df = spark.createDataFrame([(*k, *v) for k, v in data.items()], "g string, i string, a int, b int").repartition(7)
    want = []
    for g in {k[0] for k in data if k[0]}:
        items = sorted(((a is None, a or 0, b is None, -(b or 0), k[1]) for k, (a, b) in data.items() if k[0] == g and k[1] is not None))
        want += [(g, x[-1], i) for i, x in enumerate(items[:3], 1)]
    assert rows(toprank.top_items(df.union(df.limit(5)), "g", "i", [F.col("a"), -F.col("b")], 3)) == sorted(want)
    assert toprank.top_items(df.limit(0), "g", "i", [F.col("a")], 3).count() == 0
    with pytest.raises(ValueError):
        toprank.top_items(df, "g", "i", [F.col("a")], 0)


def test_top_items_repeats_in_one_run(spark, rows):
    data = [("g", "A", 1)] * 3 + [("g", "B", 2), ("h", "C", 1), ("h", "C", 1), ("h", "D", None), ("h", "D", None), ("h", "E", 3)]
    df = spark.createDataFrame(data, "g string, i string, a int").coalesce(1)
    assert rows(toprank.top_items(df, "g", "i", [F.col("a")], 3)) == [("g", "A", 1), ("g", "B", 2), ("h", "C", 1), ("h", "D", 3), ("h", "E", 2)]
    assert rows(toprank.top_items(df, "g", "i", [F.col("a")], 1)) == [("g", "A", 1), ("h", "C", 1)]
    # repeats over the end of a batch
    sizes = [pa.RecordBatch.from_pydict({"_run": [0] * len(x), "_g": ["g"] * len(x), "_i": x}) for x in (["A", "A"], [], ["A", "A", "B"], ["B"], ["C", "D"])]
    assert [i for b in toprank._cut_runs(3)(iter(sizes)) for i in b.column(2).to_pylist()] == ["A", "B", "C"]


@pytest.mark.parametrize("fan", [2, 3, 256])
def test_rounds_of_many_runs(spark, rows, monkeypatch, fan):
    monkeypatch.setattr(toprank, "FAN_IN", fan)
    monkeypatch.setattr(toprank, "BUCKET_ROWS", 20)
    r = random.Random(fan)
    data = {(r.choice(["hot"] * 5 + ["a", "b"]), f"i{k}"): r.randint(0, 40) for k in range(1200)}
    df = spark.createDataFrame([(*k, v) for k, v in data.items()], "g string, i string, a int").repartition(23)
    want = [(g, x[1], i) for g in ("hot", "a", "b") for i, x in enumerate(sorted((v, k[1]) for k, v in data.items() if k[0] == g)[:4], 1)]
    assert rows(toprank.top_items(df, "g", "i", [F.col("a")], 4)) == sorted(want)


def test_seek_moves_only_the_runs_of_a_group():
    runs = [[(f"g{k:04d}", i) for i in range(3)] for k in range(500)]
    tree, beats = toprank.LoserTree(runs), 0
    plain = tree.beats

    def counted(a, b):
        nonlocal beats
        beats += 1
        return plain(a, b)

    tree.beats = counted
    for k in range(500):
        assert tree.pop() == (f"g{k:04d}", 0)
        tree.seek(f"g{k:04d}")
    # two replays of one path for each group, not a new tree
    assert tree.pop() is None and beats < 500 * 2 * 11
