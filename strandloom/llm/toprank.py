"""Top N items of every group by merging sorted runs with a loser tree."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.runtime import cut, norm, table


class LoserTree:
    """Merges sorted runs. Each run is a sequence of (group, score...) tuples; `pop` gives the smallest head.

    Inner nodes hold the loser of their match, so a pop replays one path only. `seek` moves the runs that hold
    a group past it by binary search, and replays one path for each of them.
    """

    def __init__(self, runs: Sequence[Sequence[tuple]]):
        self.runs, self.at = list(runs), [0] * len(runs)
        self.build()

    def beats(self, a: int, b: int) -> bool:
        """Whether run a's head comes before run b's; exhausted runs come last, equal heads by run."""
        x, y = self.at[a] < len(self.runs[a]), self.at[b] < len(self.runs[b])
        if not (x and y):
            return x or not y and a < b
        p, q = self.runs[a][self.at[a]], self.runs[b][self.at[b]]
        return p < q or p == q and a < b

    def build(self) -> None:
        n = len(self.runs)
        self.loser, winner = [0] * n, [0] * n + list(range(n))
        for node in range(n - 1, 0, -1):
            a, b = winner[2 * node], winner[2 * node + 1]
            winner[node], self.loser[node] = (a, b) if self.beats(a, b) else (b, a)
        self.top = winner[1] if n > 1 else 0

    def replay(self, run: int) -> None:
        n, node, best = len(self.runs), (run + len(self.runs)) // 2, run
        while node and n > 1:
            if self.beats(self.loser[node], best):
                self.loser[node], best = best, self.loser[node]
            node //= 2
        self.top = best

    def peek(self) -> tuple | None:
        if not self.runs or self.at[self.top] >= len(self.runs[self.top]):
            return None
        return self.runs[self.top][self.at[self.top]]

    def pop(self) -> tuple | None:
        head = self.peek()
        if head is not None:
            run = self.top
            self.at[run] += 1
            self.replay(run)
        return head

    def seek(self, group: str) -> None:
        """Go on after `group`. Only the runs that stand at it are moved: each of them comes to the top in turn."""
        while (head := self.peek()) is not None and head[0] == group:
            run = self.top
            self.at[run] = bisect_right(self.runs[run], group, self.at[run], key=lambda x: x[0])
            self.replay(run)


def merge_top(runs: Sequence[Sequence[tuple]], n: int) -> Iterator[tuple]:
    """(place, item) of the first n items of every group over all runs; an item that is in two runs counts once."""
    tree = LoserTree(runs)
    group, place, last = None, 0, None
    while (head := tree.pop()) is not None:
        if head[0] != group:
            group, place, last = head[0], 0, None
        if head == last:
            continue
        last, place = head, place + 1
        yield place, head
        if place == n:
            tree.seek(group)


def _cut_runs(n: int):
    """Of a sorted run, the first n different rows of each group: all that any later merge can need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, seen, last = object(), 0, None
        for b in batches:
            if not b.num_rows:
                continue
            # equal rows lie side by side, also over the end of a batch; no column has nulls
            first = [c[0].as_py() for c in b.columns[1:]]
            pairs = [pc.equal(c.slice(1), c.slice(0, b.num_rows - 1)) for c in b.columns[1:]]
            again = [first == last, *reduce(pc.and_, pairs).to_pylist()]
            last = [c[b.num_rows - 1].as_py() for c in b.columns[1:]]
            keep = []
            for i, (g, repeat) in enumerate(zip(b.column(1).to_pylist(), again, strict=True)):
                if repeat:
                    continue
                if g != group:
                    group, seen = g, 0
                seen += 1
                if seen <= n:
                    keep.append(i)
            yield b.take(pa.array(keep, pa.int64()))

    return run


def _merge_runs(n: int, names: list[str]):
    def out(bucket: int, runs: list[list[tuple]]) -> pa.RecordBatch | None:
        got = [(bucket, place, *item) for place, item in merge_top(runs, n)]
        return pa.record_batch([pa.array(c) for c in zip(*got, strict=True)], names=["_bucket", "place", *names]) if got else None

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come ordered by bucket, run, group and score: one bucket's runs are held at a time
        bucket, run, runs = None, None, []
        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            for place, (k, r) in enumerate(zip(columns[0], columns[1], strict=True)):
                if k != bucket:
                    if runs and (done := out(bucket, runs)) is not None:
                        yield done
                    bucket, run, runs = k, None, []
                if r != run:
                    run = r
                    runs.append([])
                runs[-1].append(tuple(c[place] for c in columns[2:]))
        if runs and (done := out(bucket, runs)) is not None:
            yield done

    return merge


#: About so many rows of runs go into one bucket, which a task holds while it merges them.
BUCKET_ROWS = 100_000
#: So many runs are merged at once; more are merged in rounds.
FAN_IN = 256


def top_items(df: DataFrame, group: str, item: str, keys: Sequence[Column], n: int) -> DataFrame:
    """(group, item, place): the first n items of each group by `keys`, then by item; place from 1.

    `keys` are bigint columns of `df`, smaller first, nulls last; `df` has one row per (group, item). Rows
    with a null group or item are left out, and a row that is repeated as a whole counts once. Ties of all
    keys go to the smaller item, so the result doesn't depend on the partitioning. Groups with fewer items
    give what they have.

    Every input partition is sorted into a run and cut to n different rows per group, so that however many items a
    group has, at most n per run go on. The runs are stored once, with the bucket of their groups; the number of
    buckets follows from the stored rows. In each bucket a loser tree merges the runs and seeks the next group after
    n outputs. More than FAN_IN runs are merged in rounds, each leaving one run of FAN_IN; so a task holds a bucket of
    about BUCKET_ROWS rows, and of one group at most FAN_IN times n.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    never = (1 << 63) - 1
    flat = df.select(F.col(group).cast("string").alias("_g"), *[p for i, k in enumerate(keys) for p in (F.when(k.isNull(), 1).otherwise(0).cast("long").alias(f"_n{i}"), F.coalesce(k.cast("long"), F.lit(never)).alias(f"_k{i}"))], F.col(item).cast("string").alias("_i")).where("_g is not null and _i is not null")
    order = [c for c in flat.columns if c != "_g"]
    types = ", ".join(f"{c} {t}" for c, t in flat.dtypes)
    run = flat.withColumn("_run", F.spark_partition_id()).select("_run", *flat.columns).sortWithinPartitions("_g", *order)
    stored = cut(run.mapInArrow(_cut_runs(n), f"_run int, {types}"))
    rows, last = stored.agg(F.count("*"), F.max("_run")).first()  # from the stored table's statistics
    buckets = max(1, -(-rows // BUCKET_ROWS), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    left = stored.withColumn("_bucket", F.pmod(F.xxhash64("_g"), F.lit(buckets)).cast("int"))
    runs = (last or 0) + 1
    while True:
        wide = runs > FAN_IN
        # in a round of many runs, a bucket is merged for each FAN_IN of them
        at = F.floor(F.col("_run") / FAN_IN).cast("int") if wide else F.lit(0)
        placed = left.select((F.col("_bucket").cast("long") * (1 << 31) + at).alias("_bucket"), "_run", *flat.columns)
        ordered = placed.repartition(buckets, "_bucket").sortWithinPartitions("_bucket", "_run", "_g", *order)
        merged = ordered.mapInArrow(_merge_runs(n, flat.columns), f"_bucket bigint, place bigint, {types}")
        if not wide:
            break
        left = merged.select(F.shiftright("_bucket", 31).cast("int").alias("_bucket"), (F.col("_bucket") % (1 << 31)).cast("int").alias("_run"), *flat.columns)
        runs = -(-runs // FAN_IN)
    kinds = dict(df.dtypes)
    return merged.select(F.col("_g").cast(kinds[group]).alias(group), F.col("_i").cast(kinds[item]).alias(item), "place")


def ranked_transcripts(spark, sf: str) -> DataFrame:
    """One row per gene and transcript of exon_ref: its smallest level and largest length."""
    return table(spark, sf, "exon_ref").select(norm("gene_id").alias("gene_id"), norm("transcript_id").alias("transcript_id"), "transcript_level", "transcript_length").where("gene_id is not null and transcript_id is not null").groupBy("gene_id", "transcript_id").agg(F.min("transcript_level").alias("level"), F.max("transcript_length").alias("length"))


def found(spark, sf: str) -> DataFrame:
    """p4_found: the three best transcripts of each gene."""
    return top_items(ranked_transcripts(spark, sf), "gene_id", "transcript_id", [F.col("level"), -F.col("length")], 3)


def spread(spark, sf: str) -> DataFrame:
    """p4_longest: the five longest transcripts of each chromosome, whatever their level."""
    longest = table(spark, sf, "exon_ref").select(norm("chromosome").alias("chromosome"), norm("transcript_id").alias("transcript_id"), "transcript_length").groupBy("chromosome", "transcript_id").agg(F.max("transcript_length").alias("length"))
    return top_items(longest, "chromosome", "transcript_id", [-F.col("length")], 5)
