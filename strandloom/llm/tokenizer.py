"""Byte-pair encoding as a streaming transducer with bounded lookahead.

A text is parted into words by the tokenizer's pattern, and each word's bytes are read from left to right.
For each prefix of a word there is exactly one token that ends its encoding; it is the one that is
compatible with the token that ends the encoding of what is left of it, two tokens being compatible when
the merges leave them apart. So every position points back to where its last token starts, and the
positions form a tree. `lookahead` computes from the merge list how far what is read can still change what was
read before: a later token starts less than the longest token's length before the end, so only the paths from
those last positions matter, and the tokens on the part which all of them share are stable; and behind the
sufficient lookahead all paths are one in any case. Stable tokens are emitted and their positions forgotten, so
the memory of a word is bounded by the merge list, however long the word is.
"""

from __future__ import annotations

import base64
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.runtime import table

#: Where the public tokenizers lie, unless a caller names another file.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the word pattern of this tokenizer's vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words of up to so many characters are remembered, so many of them per Python worker.
WORD_CHARS, WORDS = 48, 200_000


class Transducer:
    """The encoder of one merge list; `ranks` maps a token's bytes to its id, which is also its priority."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import regex

        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        ends: dict[bytes, set[int]] = {}
        for t in ranks:
            ends.setdefault(t[-2:], set()).add(len(t))
        self.ends = {k: sorted(v, reverse=True) for k, v in ends.items()}
        # \s of some engines takes four control characters as blanks; White_Space doesn't
        self.words = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).finditer
        self.live, self.bound = self.lookahead()
        self.apart: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    def lookahead(self) -> tuple[int, int]:
        """(live, bound), in bytes: how far back from the end a later token can start, and after how many bytes
        of lookahead the tokens before are certain in any case: merges times the longest merged text, since
        in a longer chain of pending tokens one merge would have to occur twice."""
        return max(1, self.longest - 1), sum(len(t) > 1 for t in self.ranks) * self.longest

    def merge(self, text: bytes) -> list[int]:
        """Plain merging, lowest rank first; used on the bytes of one or two tokens only."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        """Whether token b can follow a; a = -1 stands for the word's start."""
        got = self.apart.get((a, b))
        if got is None:
            if len(self.apart) > 2_000_000:
                self.apart.clear()
            text = self.tokens[b] if a < 0 else self.tokens[a] + self.tokens[b]
            got = self.apart[a, b] = self.merge(text) == ([b] if a < 0 else [a, b])
        return got

    def stream(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """The ids of one word that comes in pieces of bytes. What is held is what isn't stable yet."""
        live = self.live + 1
        text, last, back = bytearray(), [-1], [-1]  # by position since the last emitted token; last[0] is that token
        ranks, ends = self.ranks, self.ends
        for chunk in chunks:
            for byte in chunk:
                text.append(byte)
                n = len(text)
                for size in ends.get(bytes(text[-2:]), ()) if n > 1 else ():
                    if size <= n and (t := ranks.get(bytes(text[n - size :]))) is not None and last[n - size] is not None and self.compatible(last[n - size], t):
                        break
                else:
                    size, t = 1, ranks[bytes(text[-1:])]
                    if last[n - 1] is None or not self.compatible(last[n - 1], t):
                        size, t = 0, None
                last.append(t)
                back.append(n - size)
                if n >= 4 * live:
                    shared = self.shared(back, n, live, last)
                    if not shared and n > self.bound + live:  # behind the sufficient lookahead any path is the one
                        shared = self.cut(back, n, last)
                    if shared:
                        yield from self.path(last, back, shared)
                        keep = last[shared]
                        del text[:shared]
                        last, back = [keep, *last[shared + 1 :]], [-1, *(b - shared for b in back[shared + 1 :])]
        yield from self.path(last, back, len(text))

    def shared(self, back: list[int], n: int, live: int, last: list[int | None]) -> int:
        """The last position that lies on the path of every live position."""
        heads = {p for p in range(max(0, n - live), n + 1) if last[p] is not None}
        while len(heads) > 1:
            p = max(heads)
            heads.discard(p)
            heads.add(back[p])
        return max(0, min(heads, default=0))

    def cut(self, back: list[int], n: int, last: list[int | None]) -> int:
        """The last position before the sufficient lookahead, on the path of the last live position."""
        p = next(p for p in range(n, -1, -1) if last[p] is not None)
        while p > n - self.bound:
            p = back[p]
        return max(0, p)

    def path(self, last: list[int | None], back: list[int], end: int) -> list[int]:
        got = []
        while end > 0:
            got.append(last[end])
            end = back[end]
        return got[::-1]

    def encode(self, text: str) -> list[int]:
        """The ids of a text, special tokens' strings taken as text."""
        known, ids = self.known, []
        for m in self.words(text):
            w = m.group()
            got = known.get(w)
            if got is None:
                raw = w.encode("utf-8", "surrogatepass")
                whole = self.ranks.get(raw)
                got = (whole,) if whole is not None and self.compatible(-1, whole) else tuple(self.stream((raw,)))
                if len(w) <= WORD_CHARS:
                    if len(known) >= WORDS:
                        known.clear()
                    known[w] = got
            ids.extend(got)
        return ids


class Utf8:
    """Bytes to text, one at a time: the state is the bytes still wanted, the code point so far and the range of the next byte. Whatever isn't UTF-8 gives U+FFFD."""

    def __init__(self):
        self.wanted, self.point, self.low, self.high = 0, 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        out = []
        for b in data:
            if self.wanted:
                if self.low <= b <= self.high:
                    self.point, self.wanted, self.low, self.high = self.point << 6 | b & 0x3F, self.wanted - 1, 0x80, 0xBF
                    if not self.wanted:
                        out.append(chr(self.point))
                    continue
                out.append("�")
                self.wanted = 0
            self.low, self.high = 0x80, 0xBF
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                self.wanted, self.point = 1, b & 0x1F
            elif 0xE0 <= b <= 0xEF:
                self.wanted, self.point = 2, b & 0x0F
                self.low, self.high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F)}.get(b, (0x80, 0xBF))
            elif 0xF0 <= b <= 0xF4:
                self.wanted, self.point = 3, b & 0x07
                self.low, self.high = {0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(b, (0x80, 0xBF))
            else:
                out.append("�")
        return "".join(out)

    def close(self) -> str:
        rest, self.wanted = "�" * bool(self.wanted), 0
        return rest


def decode(transducer: Transducer, ids: Iterable[int]) -> str:
    """The text of ids, token by token; a character may spread over tokens."""
    machine = Utf8()
    return "".join(machine.feed(transducer.tokens[i]) for i in ids) + machine.close()


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The tokens of a file of ranks: a token in base64 and its rank on each line. A file of another kind is refused, as its words are cut otherwise."""
    try:
        return {base64.b64decode(t, validate=True): int(i) for t, i in (line.split() for line in data.splitlines() if line)}
    except ValueError as e:
        raise ValueError("this is no file of byte-level ranks (token in base64, rank); other kinds of tokenizers part words otherwise") from e


def worker_transducer(data: bytes) -> Transducer:
    """The transducer of a Python worker, kept with the words it knows while the worker lives."""
    store = sys.__dict__.setdefault("_strandloom_transducers", {})
    key = hash(data)
    if key not in store:
        store[key] = Transducer(read_ranks(data))
    return store[key]


def _shared(spark, path: str):
    """The tokenizer's file, under 1 MB, read by the driver and sent to each executor once."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_texts(df: DataFrame, doc_id: str, text: str, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, ids): the ids of each text. An empty and a null text give an empty list; repeated rows stay."""
    shared = _shared(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = worker_transducer(shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                got = [t.encode(x) if x else [] for x in part.column(1).to_pylist()]
                offsets = np.zeros(len(got) + 1, np.int32)
                np.cumsum([len(x) for x in got], out=offsets[1:])
                flat = np.fromiter((i for x in got for i in x), np.int32, offsets[-1])
                yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["_id", "ids"])

    kind = df.schema[doc_id].dataType.simpleString()
    return df.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text")).mapInArrow(run, f"_id {kind}, ids array<int>").withColumnRenamed("_id", doc_id)


def token_sizes(df: DataFrame, keys: list[str], text: str, path: str = TOKENIZER) -> DataFrame:
    """`keys` and `tokens` of each row: how many tokens its text has; 0 for an empty and a null text."""
    shared = _shared(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = worker_transducer(shared.value)
        for b in batches:
            sizes = [len(t.encode(x)) if x else 0 for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.record_batch([*b.columns[:-1], pa.array(sizes, pa.int64())], [*b.schema.names[:-1], "tokens"])

    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, F.col(text).cast("string").alias("_text")).mapInArrow(run, f"{schema}, tokens bigint")


def ids(spark, sf: str) -> DataFrame:
    """p7_ids: the ids of every document."""
    return encode_texts(table(spark, sf, "documents"), "doc_id", "text")


def roundtrip(spark, sf: str, path: str = TOKENIZER) -> DataFrame:
    """p7_roundtrip: (doc_id, same): whether the decoded ids give the text again."""
    shared = _shared(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = worker_transducer(shared.value)
        for b in batches:
            same = [decode(t, t.encode(x or "")) == (x or "") for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(same)], ["doc_id", "same"])

    return table(spark, sf, "documents").select("doc_id", "text").mapInArrow(run, "doc_id bigint, same boolean")
