"""Continuous periods and gaps of intervals, by compressed run bitmaps.

Positions are cut into shards of 65,536. The covered positions of an entity in a shard are a bitmap, held
as runs (16-bit first, 16-bit length - 1), so it has 32,768 runs at most however many intervals there are.
Bitmaps are united before and after a shuffle on (entity, shard); their set runs are periods, the clear
runs between them gaps. Only what touches a shard's edge is put together per entity afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from strandloom.runtime import cut, norm, observed, table

BITS = 16
WIDTH = 1 << BITS
#: Rows that are united at once in a Python worker.
FLUSH_ROWS = 400_000
#: Bytes of bitmaps that are united at once.
FLUSH_BYTES = 32 << 20
#: An interval over more shards than this is long: the shards that it fills are one block, not a bitmap each.
LONG_SHARDS = 64
#: Positions of group g start at g * STRIDE, so that runs of two groups never touch.
STRIDE = WIDTH + 2


def _groups(entity: pa.Array, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number each (entity, shard), and give each group's first row. Null entities don't occur."""
    codes = entity.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.lexsort((shard, codes))
    new = np.ones(len(order), bool)
    new[1:] = (codes[order][1:] != codes[order][:-1]) | (shard[order][1:] != shard[order][:-1])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return group, order[new]


def unite(group: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The set runs of each group's united bitmap, ordered by group and position."""
    if not len(group):
        return group, low, high
    first, last = group * STRIDE + low, group * STRIDE + high
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(last[order])
    new = np.ones(len(first), bool)
    new[1:] = first[1:] > reach[:-1] + 1
    ends = np.append(np.flatnonzero(new)[1:] - 1, len(first) - 1)
    first, reach = first[new], reach[ends]
    return first // STRIDE, first % STRIDE, reach % STRIDE


def _pack(entity: pa.Array, shard: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
    """One row per (entity, shard), its runs as bytes."""
    group, heads = _groups(entity, shard)
    g, lo, hi = unite(group, low, high)
    pairs = np.column_stack((lo, hi - lo)).astype("<u2")
    offsets = np.searchsorted(g, np.arange(len(heads) + 1)).astype(np.int32) * 4
    runs = pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(offsets), pa.py_buffer(pairs.tobytes())])
    return pa.record_batch([entity.take(pa.array(heads)), pa.array(shard[heads]), runs], ["_e", "_s", "_runs"])


def _flat(batches: list[pa.RecordBatch], column: str) -> pa.Array:
    got = pa.chunked_array([b.column(column) for b in batches]).combine_chunks()
    return got.combine_chunks() if isinstance(got, pa.ChunkedArray) else got


def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unite an input partition's pieces (_e, _s, _lo, _hi), some hundred thousand at a time."""
    held, rows = [], 0

    def out() -> pa.RecordBatch:
        return _pack(_flat(held, "_e"), *(_flat(held, c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("_s", "_lo", "_hi")))

    for b in batches:
        if b.num_rows:
            held.append(b)
            rows += b.num_rows
        if rows >= FLUSH_ROWS:
            yield out()
            held, rows = [], 0
    if held:
        yield out()


def _extract(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Set and clear runs of whole (entity, shard) groups; kind 0 = inner period, 1 = inner gap, 2 = edge, 3 = edge after a gap that has been given."""
    entity, shard, runs = _flat(batches, "_e"), _flat(batches, "_s").to_numpy(zero_copy_only=False), _flat(batches, "_runs")
    group, heads = _groups(entity, shard)
    sizes = pc.binary_length(runs).to_numpy(zero_copy_only=False) // 4
    pairs = np.frombuffer(b"".join(runs.to_pylist()), "<u2").reshape(-1, 2).astype(np.int64)
    g, lo, hi = unite(np.repeat(group, sizes), pairs[:, 0], pairs[:, 0] + pairs[:, 1])
    base = shard[heads][g] * WIDTH
    first, last = np.ones(len(g), bool), np.ones(len(g), bool)
    first[1:] = last[:-1] = g[1:] != g[:-1]
    kind = np.where(first, 2, np.where(last, 3, 0)).astype(np.int8)
    hole = np.flatnonzero(~first)
    who = np.concatenate((g, g[hole]))
    start = np.concatenate((base + lo, base[hole] + hi[hole - 1] + 1))
    end = np.concatenate((base + hi, base[hole] + lo[hole] - 1))
    kinds = np.concatenate((kind, np.ones(len(hole), np.int8)))
    return pa.record_batch([entity.take(pa.array(heads[who])), pa.array(kinds), pa.array(start), pa.array(end)], ["_e", "_kind", "_a", "_b"])


def _by_bytes(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about FLUSH_BYTES of bitmaps."""
    if not b.num_rows:
        return
    part = np.cumsum(pc.binary_length(b.column("_runs")).to_numpy(zero_copy_only=False)) // FLUSH_BYTES
    starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    for a, z in zip(starts, np.append(starts[1:], b.num_rows), strict=True):
        yield b.slice(a, z - a)


def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As compress, for bitmaps that arrive ordered by entity and shard: a group is held back until it is complete."""
    held, rows, size = [], 0, 0
    for whole in batches:
        for b in _by_bytes(whole):
            if rows >= FLUSH_ROWS // 8 or size >= FLUSH_BYTES:
                end = (b.column("_e")[0], b.column("_s")[0])
                # the last held group may go on in this batch: cut where it starts
                tail = held[-1]
                if (tail.column("_e")[-1], tail.column("_s")[-1]) != end:
                    yield _extract(held)
                    held, rows, size = [], 0, 0
            held.append(b)
            rows += b.num_rows
            size += pc.sum(pc.binary_length(b.column("_runs"))).as_py() or 0
    if held:
        yield _extract(held)


def periods_and_gaps(df: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """(entity, kind, start_pos, end_pos): the continuous periods of each entity's closed intervals, and the gaps between them.

    Touching intervals (end + 1 = start) form one period. Rows with a null entity, start or end, and
    reversed ones (start > end), play no part. Repeats, nested and unordered rows change nothing; an
    entity with one period has no gap; an empty table gives an empty result. Positions may be negative. An
    interval over more than LONG_SHARDS shards takes two bitmaps and one block, however long it is.
    """
    kind = dict(df.dtypes)[entity]
    rows = df.select(F.col(entity).cast("string").alias("_e"), F.col(start).cast("long").alias("_x"), F.col(end).cast("long").alias("_y")).where("_e is not null and _x <= _y")
    first, last = F.shiftright("_x", BITS), F.shiftright("_y", BITS)
    long = last - first > LONG_SHARDS
    seen = Observation()
    shards = F.when(first == last, F.array(first)).when(long, F.array(first, last)).otherwise(F.sequence(first, F.when(long, first).otherwise(last)))
    pieces = rows.observe(seen, F.count_if(long).alias("long")).select("_e", "_x", "_y", F.explode(shards).alias("_s")).select(
        "_e",
        "_s",
        (F.greatest(F.col("_x"), F.col("_s") * WIDTH) - F.col("_s") * WIDTH).cast("int").alias("_lo"),
        (F.least(F.col("_y"), F.col("_s") * WIDTH + (WIDTH - 1)) - F.col("_s") * WIDTH).cast("int").alias("_hi"),
    )
    maps = pieces.mapInArrow(compress, "_e string, _s bigint, _runs binary").repartition("_e", "_s").sortWithinPartitions("_e", "_s")
    runs = cut(maps.mapInArrow(extract, "_e string, _kind tinyint, _a bigint, _b bigint"))
    facts = observed(seen)
    if not (facts["long"] if facts else rows.where(long).limit(1).count()):
        return _result(_joined(runs), kind, entity)
    blocks = rows.where(long).select("_e", ((first + 1) * WIDTH).alias("_a"), (last * WIDTH - 1).alias("_b"))
    own = blocks.select("_e").distinct()
    with_blocks = runs.where("_kind <> 1").join(own, "_e", "left_semi").select("_e", "_a", "_b").unionByName(blocks)
    return _result(_joined(runs.join(own, "_e", "left_anti")).unionByName(_swept(with_blocks)), kind, entity)


def _result(found: DataFrame, kind: str, entity: str) -> DataFrame:
    return found.select(F.col("_e").cast(kind).alias(entity), "kind", "start_pos", "end_pos")


def _swept(runs: DataFrame) -> DataFrame:
    """Periods and gaps of entities with long intervals: their runs and blocks swept in order of position."""
    by = Window.partitionBy("_e").orderBy("_a", "_b")
    reach = F.max("_b").over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = runs.withColumn("_reach", reach).withColumn("_new", F.when(F.col("_reach").isNull() | (F.col("_a") > F.col("_reach") + 1), 1).otherwise(0))
    islands = new.withColumn("_island", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    whole = islands.groupBy("_e", "_island").agg(F.min("_a").alias("_a"), F.max("_b").alias("_b"), F.max(F.when(F.col("_new") == 1, F.col("_reach"))).alias("_before"))
    return _spelled(whole)


def _spelled(whole: DataFrame) -> DataFrame:
    """Rows (_e, _a, _b, _before) as a period each, and as a gap behind `_before` when there is one."""
    both = F.array(F.struct(F.lit("period").alias("kind"), F.col("_a").alias("start_pos"), F.col("_b").alias("end_pos")), F.when(F.col("_before").isNotNull(), F.struct(F.lit("gap").alias("kind"), (F.col("_before") + 1).alias("start_pos"), (F.col("_a") - 1).alias("end_pos"))))
    return whole.select("_e", F.explode(both).alias("x")).where("x is not null").select("_e", "x.*")


def _joined(runs: DataFrame) -> DataFrame:
    """(_e, kind, start_pos, end_pos): the runs of all shards, those that touch a shard's edge put together."""
    inner = runs.where("_kind < 2").select("_e", F.when(F.col("_kind") == 0, "period").otherwise("gap").alias("kind"), F.col("_a").alias("start_pos"), F.col("_b").alias("end_pos"))
    by = Window.partitionBy("_e").orderBy("_a")
    before = F.lag("_b").over(by)
    edges = runs.where("_kind >= 2").withColumn("_before", before).withColumn("_new", F.when(F.col("_before").isNull() | (F.col("_a") > F.col("_before") + 1), 1).otherwise(0)).withColumn("_island", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    pulled = edges.groupBy("_e", "_island").agg(
        F.min("_a").alias("_a"),
        F.max("_b").alias("_b"),
        # the island's first edge carries what lies before it
        F.min(F.when((F.col("_new") == 1) & (F.col("_kind") == 2), F.col("_before"))).alias("_before"),
    )
    return inner.unionByName(_spelled(pulled))


def found(spark, sf: str) -> DataFrame:
    """p3_found: periods and gaps of the exon, CDS and codon rows of each transcript."""
    rows = table(spark, sf, "feature").where(F.col("feature").isNotNull() & ~F.col("feature").isin("gene", "transcript")).select(norm("transcript_id").alias("transcript_id"), "start", "end")
    return periods_and_gaps(rows, "transcript_id", "start", "end")


def coverage(spark, sf: str) -> DataFrame:
    """p3_coverage: per transcript the number of periods and gaps and the positions in them."""
    return found(spark, sf).groupBy("transcript_id").agg(*[f((F.col("kind") == k).cast("long") * x).alias(n) for k in ("period", "gap") for f, x, n in ((F.sum, F.lit(1), f"{k}s"), (F.sum, F.col("end_pos") - F.col("start_pos") + 1, f"{k}_positions"))])
