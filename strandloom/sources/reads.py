"""Aligned reads: SAM text and BAM files in, SAM text out. CRAM isn't read."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.sources.tables import with_record_id

SAM = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")
SCHEMA = "qname string, flag int, rname string, pos bigint, mapq int, cigar string, rnext string, pnext bigint, tlen bigint, seq string, qual string, tags map<string,string>, ord bigint"


def parse_sam(lines: DataFrame, line: str = "value", order: str = "ord") -> DataFrame:
    """SAM lines to reads with 0-based pos and pnext, and tags as `type:value` by name; header lines are skipped."""
    f = F.split(line, "\t", -1)
    rows = lines.where(~F.col(line).startswith("@") & (F.col(line) != "")).withColumn("_f", f).where(F.size("_f") >= 11)
    kinds = {"flag": "int", "pos": "bigint", "mapq": "int", "pnext": "bigint", "tlen": "bigint"}
    cols = [F.get("_f", F.lit(i)).try_cast(kinds.get(c, "string")).alias(c) for i, c in enumerate(SAM)]
    tags = F.transform(F.slice("_f", F.lit(12), F.greatest(F.size("_f"), F.lit(1))), lambda t: F.struct(F.substring(t, 1, 2).alias("k"), t.substr(F.lit(4), F.length(t)).alias("v")))
    unique = F.map_from_entries(F.filter(tags, lambda t: F.length(t["k"]) == 2))
    got = rows.select(*cols, unique.alias("tags"), order)
    return got.withColumn("pos", F.col("pos") - 1).withColumn("pnext", F.col("pnext") - 1)


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    return parse_sam(with_record_id(spark.read.text(path), "ord"))


def _inflate(data: bytes) -> Iterator[bytes]:
    """The contents of a BGZF file's blocks, one after another; each tells its size, so nothing is copied or read twice."""
    view, at = memoryview(data), 0
    while at + 18 <= len(view):
        extra, size = struct.unpack_from("<H", view, at + 10)[0] if view[at + 3] & 4 else 0, None
        p = at + 12
        while p < at + 12 + extra:
            tag, n = bytes(view[p : p + 2]), struct.unpack_from("<H", view, p + 2)[0]
            if tag == b"BC":
                size = struct.unpack_from("<H", view, p + 4)[0] + 1
            p += 4 + n
        if size is None:  # a plain gzip member
            d = zlib.decompressobj(31)
            yield d.decompress(view[at:])
            size = len(view) - at - len(d.unused_data)
        else:
            yield zlib.decompress(view[at : at + size], 31)
        at += size


_BASES, _OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
_SIZES = {"c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}


def _tags(data: bytes) -> dict[str, str]:
    out, at = {}, 0
    while at + 3 <= len(data):
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind == "A":
            out[name], at = f"A:{chr(data[at])}", at + 1
        elif kind in "ZH":
            end = data.index(0, at)
            out[name], at = f"{kind}:{data[at:end].decode()}", end + 1
        elif kind == "B":
            sub, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            out[name] = f"B:{sub}," + ",".join(map(str, struct.unpack_from(f"<{n}{sub}", data, at + 5)))
            at += 5 + n * _SIZES[sub]
        else:
            v = struct.unpack_from(f"<{kind.replace('c', 'b').replace('C', 'B').replace('s', 'h').replace('S', 'H')}", data, at)[0]
            out[name], at = f"{'f' if kind == 'f' else 'i'}:{v}", at + _SIZES[kind]
    return out


def decode_bam(data: bytes) -> Iterator[dict]:
    """The records of a BAM file's bytes."""
    raw = b"".join(_inflate(data))
    if raw[:4] != b"BAM\1":
        raise ValueError("not a BAM file")
    at = 8 + struct.unpack_from("<i", raw, 4)[0]
    refs, at = struct.unpack_from("<i", raw, at)[0], at + 4
    names = []
    for _ in range(refs):
        n = struct.unpack_from("<i", raw, at)[0]
        names.append(raw[at + 4 : at + 3 + n].decode())
        at += 8 + n
    ref = lambda i: names[i] if 0 <= i < len(names) else "*"
    no = 0
    while at + 4 <= len(raw):
        size = struct.unpack_from("<i", raw, at)[0]
        rid, pos, l_name, mapq, _, n_ops, flag, l_seq, next_id, next_pos, tlen = struct.unpack_from("<iiBBHHHiiii", raw, at + 4)
        p = at + 36
        name, p = raw[p : p + l_name - 1].decode(), p + l_name
        ops = struct.unpack_from(f"<{n_ops}I", raw, p)
        p += 4 * n_ops
        packed, p = raw[p : p + (l_seq + 1) // 2], p + (l_seq + 1) // 2
        seq = "".join(_BASES[b >> 4] + _BASES[b & 15] for b in packed)[:l_seq]
        qual, p = raw[p : p + l_seq], p + l_seq
        yield {
            "qname": name, "flag": flag, "rname": ref(rid), "pos": pos, "mapq": mapq, "cigar": "".join(f"{o >> 4}{_OPS[o & 15]}" for o in ops) or "*",
            "rnext": ref(next_id) if next_id != rid or next_id < 0 else "=", "pnext": next_pos, "tlen": tlen, "seq": seq or "*",
            "qual": "*" if not qual or qual[:1] == b"\xff" else "".join(chr(q + 33) for q in qual), "tags": _tags(raw[p : at + 4 + size]), "ord": no,
        }
        at, no = at + 4 + size, no + 1


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    """The reads of BAM files, one task per file: large inputs should come as many files."""
    if path.endswith(".cram"):
        raise ValueError("CRAM isn't supported; convert it to BAM or SAM")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content in f["content"]:
                rows = list(decode_bam(bytes(content)))
                for i in range(0, len(rows), 20_000):
                    yield pd.DataFrame(rows[i : i + 20_000])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, SCHEMA)


def sam_lines(reads: DataFrame) -> DataFrame:
    """Reads as SAM lines, in no order; tags by name."""
    t = F.array_join(F.transform(F.array_sort(F.map_entries("tags")), lambda x: F.concat(x["key"], F.lit(":"), x["value"])), "\t")
    cols = [(F.col(c) + 1 if c in ("pos", "pnext") else F.col(c)).cast("string") for c in SAM]
    return reads.select(*[c for c in ("rname", "pos", "ord") if c in reads.columns], F.concat_ws("\t", *[F.coalesce(c, F.lit("*")) for c in cols], F.when(t != "", t)).alias("value"))


def write_sam(reads: DataFrame, lengths: DataFrame, path: str, sort: bool = False) -> None:
    """SAM text: a header line per reference, then the reads in the order of `ord`, or by reference and position."""
    lines = sam_lines(reads)
    lines = lines.orderBy(*(("rname", "pos", "ord") if sort else ("ord",))).select("value")
    head = lengths.orderBy("chrom").select(F.concat(F.lit("@SQ\tSN:"), "chrom", F.lit("\tLN:"), F.col("length").cast("string")).alias("value"))
    first = reads.sparkSession.createDataFrame([(f"@HD\tVN:1.6\tSO:{'coordinate' if sort else 'unsorted'}",)], "value string")
    first.union(head).coalesce(1).union(lines).write.mode("overwrite").text(path)
