"""Grouping of small RNA genes: name families, containment, clusters and consensus sequences."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Name patterns of small nuclear RNAs and what they become, in order.
SNRNA = (
    (r"RNU(\d+)(?:-\d+.*)?$", "U$1"), (r"RNU(\d+[A-Z]+)(?:-\d+.*)?$", "U$1"), (r"RNU(\d+)ATAC.*", "U$1atac"), (r"Rnu(\d+)(?:-\d+.*)?$", "U$1"), (r"Rnu(\d+[a-z]+)(?:-\d+.*)?$", "U$1"),
    (r"Rnu(\d+)atac.*", "U$1atac"), (r"RNVU(\d+)-\d+.*", "U$1V"), (r"[Uu](\d+)ATAC$", "U$1atac"), (r"u(\d+)$", "U$1"), (r"^snrnau(.*)$", "U$1"),
)


def snrna_name(name: Column) -> Column:
    """The family of a small nuclear RNA gene (RNU2-27P gives U2)."""
    out = name
    for pattern, new in SNRNA:
        out = F.regexp_replace(out, pattern, new)
    return F.when(name.startswith("snRNA:"), F.get(F.split(name, ":"), F.lit(1))).otherwise(out)


# Other names of small nucleolar RNAs (in capitals) and what they become; names of misc_RNA genes and their
# kinds, pseudogenes first. The first pattern that matches counts.
SNORNA = ((r"^ACA(\d+)([A-Z]?).*$", "SNORA$1$2"), (r"^U8.*$", "SNORD118"), (r"^U(\d+)([A-Z]).*$", "SNORD$1$2"), (r"^U(\d+).*$", "SNORD$1A"), (r"^Z6$", "Z6"))
MISC = (
    (r"^VTRNA.*P", "Vault_RNA_pseudogene"), (r"^RN7SL.*P$", "scRNA"), (r"^RN7SKP", "snRNA"), (r"^RNY.*P", "Y_RNA_pseudogene"), (r"^(?:RN7SL|Metazoa_SRP$|7SL$)", "scRNA"), (r"^(?:RNY|Y_RNA$)", "Y_RNA"),
    (r"^(?:RN7SK|7SK)$", "snRNA"), (r"^Vault$", "vault_RNA"), (r"^SCARNA", "scaRNA"),
)


def snorna_name(name: Column) -> Column:
    """The family of a small nucleolar RNA gene known by another name (ACA64, U3, U8, Z6)."""
    up, out = F.upper(name), name
    for pattern, new in reversed(SNORNA):
        out = F.when(up.rlike(pattern), F.regexp_replace(up, pattern, new)).otherwise(out)
    return out


def misc_biotype(biotype: Column, name: Column) -> Column:
    """The kind of a misc_RNA gene by its name; other kinds stay."""
    kind = biotype
    for pattern, new in reversed(MISC):
        kind = F.when(name.rlike(pattern), new).otherwise(kind)
    return F.when(biotype == "misc_RNA", kind).otherwise(biotype)


# The kinds of small RNAs that are grouped, the placeholders of unnamed ones, and what products call them.
KINDS = ("tRNA", "rRNA", "Mt_rRNA", "Mt_tRNA", "ribozyme", "vault_RNA", "Y_RNA", "miRNA", "scaRNA", "snoRNA", "snRNA", "scRNA", "ncRNA", "misc_RNA", "vault_RNA_pseudogene", "pseudogene")
PLACEHOLDERS = {"snoRNA": "SNORx", "miRNA": "MIRx", "snRNA": "Ux", "Y_RNA": "RNYx"}
NUCLEAR, NUCLEOLAR, CAJAL = ("small nuclear RNA", "spliceosomal RNA"), ("small nucleolar RNA", "small nucleolar"), ("small Cajal body-specific RNA",)


def settled_biotype(biotype: Column, name: Column) -> Column:
    """The kind under which a gene is grouped: a misc_RNA by its name, and Mir3535 with the small nucleolar RNAs."""
    kind = misc_biotype(biotype, name)
    return F.when((kind == "miRNA") & (F.get(F.split(snrna_name(name), "-"), F.lit(0)) == "Mir3535"), "snoRNA").otherwise(kind)


def named_by(product: Column, phrases: tuple[str, ...]) -> Column:
    """The first word of a product text without the phrases; null when none of them is in it."""
    told, rest = F.lit(False), product
    for p in phrases:
        told, rest = told | product.contains(p), F.replace(rest, F.lit(p), F.lit(""))
    return F.when(told, F.get(F.split(F.trim(rest), r"\s+"), F.lit(0)))


def family(biotype: Column, name: Column, product: Column | None = None) -> Column:
    """The gene family's name: numbered copies of small RNAs fall together, unknown ones are named by their product or become a placeholder (Ux, RNYx, SNORx, MIRx)."""
    product = F.coalesce(product, F.lit("")) if product is not None else F.lit("")
    first = snrna_name(name)
    up = F.upper(first)
    head = F.get(F.split(first, "-"), F.lit(0))
    trna = F.when(first.contains("_tRNA-"), F.concat(F.lit("tRNA-"), F.regexp_extract(first, r"_tRNA-(.*)$", 1))).when((biotype == "tRNA") & ~first.startswith("tRNA"), F.concat(F.lit("tRNA-"), F.when(first == "", "unknown").otherwise(first))).otherwise(first)
    other = F.when(trna.startswith("tRNA-"), F.regexp_replace(trna, "[0-9-]+$", "")).otherwise(trna)
    nuclear, nucleolar, cajal = named_by(product, NUCLEAR), named_by(product, NUCLEOLAR), named_by(product, CAJAL)
    renamed = snorna_name(nucleolar)
    by_product = (
        F.when(first.startswith("Gm") | first.startswith("AF") | first.startswith("DQ"), F.replace(F.replace(nucleolar, F.lit("SNORD"), F.lit("Snord")), F.lit("SNORA"), F.lit("Snora")))
        .when(F.upper(nucleolar).startswith("SNOR"), nucleolar)
        .when(renamed.startswith("SNOR"), renamed)
        .otherwise("SNORx")
    )
    return (
        F.when(biotype == "snRNA", F.when(up.startswith("7SK"), "7SK").when(up.startswith("SNAR-"), F.regexp_replace(first, "[0-9-]+$", "")).when(up.startswith("U"), first).when(nuclear.isNotNull(), snrna_name(nuclear)).otherwise("Ux"))
        .when(biotype == "Y_RNA", F.when(up == "Y_RNA", "RNYx").otherwise(first))
        .when(biotype == "snoRNA", F.when(up.startswith("SNOR"), head).when(up.startswith("U") | up.startswith("RNU"), snorna_name(first)).when(nucleolar.isNotNull(), by_product).otherwise("SNORx"))
        .when((biotype == "scaRNA") & cajal.isNotNull() & ~up.startswith("SCARNA"), F.concat(F.lit("SCARNA"), cajal))
        .when(biotype == "miRNA", F.when(head == "Mir3535", "SNORx").when(up.startswith("MIR"), head).when(up.contains("LET") | up.contains("MIR"), first).otherwise("MIRx"))
        .otherwise(other)
    )


def contained_in(items: DataFrame, by: str, k: int = 16) -> DataFrame:
    """(id, target): for each placeholder item the first other item (by name, ord) whose sequence holds it and isn't
    twice as long, or which it holds and which has more than 90 % of its length; within equal `by` only.

    items: id, name, ord, seq, placeholder, `by`. A held sequence shares its first k bases with the holder, so
    candidates meet on k-base words; items shorter than k meet by an equal word of their whole length.
    """
    word = lambda s, i, n: s.substr(i, n)

    def words(n: int) -> Column:
        at = F.when(size >= n, F.sequence(F.lit(1), size - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(F.lit(n).alias("n"), word(F.col("seq"), i, F.lit(n)).alias("w")))

    size = F.length("seq")
    heads = items.where("seq <> ''").select(F.col("id").alias("h_id"), by, F.col("name").alias("h_name"), F.col("ord").alias("h_ord"), F.col("placeholder").alias("h_p"), F.col("seq").alias("h_seq"), F.least(size, F.lit(k)).alias("n"), word(F.col("seq"), F.lit(1), F.least(size, F.lit(k))).alias("w"))
    lens = [r["n"] for r in heads.select("n").distinct().collect()]  # at most k rows
    every = items.where("seq <> ''").select(F.col("id").alias("c_id"), by, F.col("name").alias("c_name"), F.col("ord").alias("c_ord"), F.col("placeholder").alias("c_p"), F.col("seq").alias("c_seq"), F.explode(F.flatten(F.array(*map(words, lens)) if lens else F.array().cast("array<array<struct<n:int,w:string>>>"))).alias("x")).select("*", "x.*").drop("x").distinct()
    pairs = heads.join(every, [by, "n", "w"]).where("h_id <> c_id and contains(c_seq, h_seq)")
    into = pairs.where("h_p and not c_p").where(F.length("h_seq") > F.length("c_seq") * 0.5).select(F.col("h_id").alias("id"), F.col("c_id").alias("target"), F.col("c_name").alias("name"), F.col("c_ord").alias("ord"))
    over = pairs.where("c_p and not h_p").where(F.length("h_seq") > F.length("c_seq") * 0.9).select(F.col("c_id").alias("id"), F.col("h_id").alias("target"), F.col("h_name").alias("name"), F.col("h_ord").alias("ord"))
    return into.union(over).groupBy("id").agg(F.min_by("target", F.struct("name", "ord")).alias("target"))


LETTERS = "ACGTUN-"


def column_counts(x: list[str]) -> np.ndarray:
    """How often each of LETTERS stands in each column of aligned rows; other signs count as N."""
    out = np.zeros((len(x[0]), len(LETTERS)), dtype=np.int64)
    for s in x:
        out[np.arange(len(s)), [LETTERS.find(ch) if ch in LETTERS else 5 for ch in s.upper()]] += 1
    return out


def best_path(p: np.ndarray, q: np.ndarray, gap: int) -> list[int]:
    """The steps of the best global alignment of two alignments by their column counts: 0 both, 1 a gap in the second, 2 in the first.

    Scores are whole numbers (match 1, mismatch -1 and gap -2, times both numbers of rows), so equal ones are equal; of
    them 0 goes before 1 before 2. A column of the table is filled at once: the gaps within it are a running maximum.
    """
    n, m = len(p), len(q)
    p6, q6 = p[:, :6], q[:, :6]
    score = 2 * (q6 @ p6.T) - q6.sum(1)[:, None] * p6.sum(1)[None, :]
    slope = gap * np.arange(n + 1)
    best = np.empty((m + 1, n + 1), dtype=np.int64)
    best[0] = -slope
    for j in range(1, m + 1):
        last, now = best[j - 1], best[j]
        np.subtract(last, gap, out=now)
        np.maximum(now[1:], last[:-1] + score[j - 1], out=now[1:])
        now += slope
        np.maximum.accumulate(now, out=now)
        now -= slope
    steps = np.full((m + 1, n + 1), 2, dtype=np.int8)
    steps[:, 1:][best[:, 1:] == best[:, :-1] - gap] = 1
    steps[1:, 1:][best[1:, 1:] == best[:-1, :-1] + score] = 0
    table, path = steps.tolist(), []
    i, j = n, m
    while i or j:
        step = table[j][i]
        path.append(step)
        i, j = i - (step != 2), j - (step != 1)
    return path[::-1]


def align(seqs: list[str]) -> list[str]:
    """A progressive alignment, most similar length first; equal sequences are aligned once.

    The counts of the columns are kept, and the rows are touched only where a new sequence opens a column.
    """
    distinct = sorted(dict.fromkeys(seqs), key=lambda s: (-len(s), s))
    if len(distinct) < 2:
        return list(seqs)
    counts = column_counts(distinct[:1])
    done, width = [list(range(len(distinct[0])))], len(distinct[0])  # each row's columns
    opened: list[tuple[int, list[int]]] = []  # (rows before, where its old columns go)
    for k, s in enumerate(distinct[1:], 1):
        own = column_counts([s])
        path = best_path(counts, own, 2 * k)
        if 2 in path:
            moved = [i for i, step in enumerate(path) if step != 2]
            opened.append((k, moved))
            wider = np.zeros((len(path), len(LETTERS)), dtype=np.int64)
            wider[:, 6] = k
            wider[moved] = counts
            counts, width = wider, len(path)
        mine = [i for i, step in enumerate(path) if step != 1]
        counts[mine] += own
        counts[:, 6] += 1
        counts[mine, 6] -= 1
        done.append(mine)
    # columns opened later shift the earlier ones: from the last row back, one map to the final columns
    final, at = np.arange(width), {}
    for k in range(len(distinct) - 1, -1, -1):
        row = ["-"] * width
        for i, ch in zip(final[done[k]].tolist(), distinct[k], strict=True):
            row[i] = ch
        at[distinct[k]] = "".join(row)
        if opened and opened[-1][0] == k:
            final = final[opened.pop()[1]]
    return [at[s] for s in seqs]


def near_pairs(rows: list[str], threshold: float, size: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, share): the pairs a < b of aligned rows of which at most the threshold of columns differ, those with a gap in both left out.

    The pairs of `size` rows are held at once.
    """
    x = np.array([list(map(ord, r)) for r in rows], dtype=np.uint32).reshape(len(rows), -1)
    signs, x = np.unique(x, return_inverse=True)
    x = np.ascontiguousarray(x.reshape(len(rows), -1).T.astype(np.uint16 if len(signs) > 255 else np.uint8))
    gaps = x == np.searchsorted(signs, ord("-")) if ord("-") in signs else np.zeros(x.shape, dtype=bool)
    gapped = np.flatnonzero(gaps.any(1))
    counter = np.uint8 if len(x) < 256 else np.int32
    most = np.array([np.floor(threshold * n + 1e-9) for n in range(len(x) + 1)]).clip(0, len(x)).astype(counter)
    found = []
    for start in range(0, len(rows), size):
        stop = min(start + size, len(rows))
        differ = np.zeros((stop - start, len(rows) - start), dtype=counter)
        for col in x:
            differ += col[start:stop, None] != col[None, start:]
        both = np.full(differ.shape, len(x), dtype=counter)
        for c in gapped:
            both[np.ix_(np.flatnonzero(gaps[c, start:stop]), np.flatnonzero(gaps[c, start:]))] -= 1
        a, b = np.nonzero(differ <= most[both])
        d, n = differ[a, b].astype(float), both[a, b].astype(float)
        a, b = a + start, b + start
        found.append((a[a < b], b[a < b], np.divide(d, n, out=np.zeros_like(d), where=n > 0)[a < b]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def gap_hamming(rows: list[str]) -> np.ndarray:
    """The shares of differing columns of all pairs of rows, those with a gap in both left out."""
    out = np.zeros((len(rows), len(rows)))
    a, b, share = near_pairs(rows, 1.0)
    out[a, b] = out[b, a] = share
    return out


def linked(d: np.ndarray, threshold: float) -> list[list[int]]:
    """The clusters of average linkage up to the threshold; of equally near ones the first are joined. Means are compared to 12 digits."""
    k = len(d)
    total, many, groups = d.copy(), np.ones(k), [[i] for i in range(k)]
    mean = np.where(np.triu(np.ones((k, k), dtype=bool), 1), np.round(d, 12), np.inf)
    near = mean.min(1)
    while k > 1:
        i = int(near.argmin())
        if not near[i] <= threshold:
            break
        j = int(mean[i].argmin())
        groups[i] += groups[j]
        groups[j] = []
        total[i] += total[j]
        total[:, i] = total[i]
        many[i] += many[j]
        new = np.round(total[i] / (many[i] * many), 12)
        new[[not g for g in groups]] = np.inf
        lost = np.flatnonzero((mean[:, i] == near) | (mean[:, j] == near))
        mean[j], mean[:, j] = np.inf, np.inf
        mean[i, i + 1 :], mean[:i, i] = new[i + 1 :], new[:i]
        near[:i] = np.minimum(near[:i], new[:i])
        lost = np.union1d(lost, [i, j])
        near[lost] = mean[lost].min(1)
    return [g for g in groups if g]


def cluster(rows: list[str], threshold: float) -> list[int]:
    """Average linkage up to the threshold; clusters numbered from 1 by size, then by first member.

    Clusters are joined only where two of their rows are that near, so what such pairs connect is clustered by itself.
    """
    root = list(range(len(rows)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for a, b in zip(*(c.tolist() for c in near_pairs(rows, threshold)[:2]), strict=True):
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    parts: dict[int, list[int]] = {}
    for i in range(len(rows)):
        parts.setdefault(top(i), []).append(i)
    groups = [[p[i] for i in g] for p in parts.values() for g in (linked(gap_hamming([rows[i] for i in p]), threshold) if len(p) > 1 else [[0]])]
    out = [0] * len(rows)
    for n, g in enumerate(sorted(groups, key=lambda g: (-len(g), min(g))), 1):
        for i in g:
            out[i] = n
    return out


def consensus(rows: list[str]) -> str:
    """The most frequent sign of each column, of equal ones the smallest (so a gap wins)."""
    if len(rows) == 1:
        return rows[0]
    return "".join(min(set(col), key=lambda ch: (-col.count(ch), ch)) for col in zip(*rows, strict=True))


def gapless_positions(row: str) -> list[tuple[int, int, int]]:
    """(first column, last column, first base) of the stretches of an aligned row without gap, from 0."""
    out, base = [], 0
    for i, ch in enumerate(row):
        if ch == "-":
            continue
        if out and out[-1][1] == i - 1:
            out[-1] = (out[-1][0], i, out[-1][2])
        else:
            out.append((i, i, base))
        base += 1
    return out


def cluster_families(genes: DataFrame, threshold: float = 0.1) -> DataFrame:
    """(family, gene_id, cluster_id, aligned, consensus): families aligned, clustered, and each cluster aligned again.

    genes: family, gene_id, seq. Families of small RNAs are small; equal sequences of a family are reduced to
    one with its gene ids before they meet in a task.
    """
    distinct = genes.where("seq <> ''").groupBy("family", "seq").agg(F.sort_array(F.collect_set("gene_id")).alias("ids"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("seq").reset_index(drop=True)
        seqs = list(frame["seq"])
        ids = cluster(align(seqs), threshold)
        out, members = [], {}
        for i, n in enumerate(ids):
            members.setdefault(n, []).append(i)
        for n, mine in sorted(members.items()):
            rows = align([seqs[i] for i in mine])
            whole = consensus(rows).replace("-", "")
            out += [(frame["family"][0], g, n, r, whole) for i, r in zip(mine, rows, strict=True) for g in frame["ids"][i]]
        return pd.DataFrame(out, columns=["family", "gene_id", "cluster_id", "aligned", "consensus"])

    return distinct.groupBy("family").applyInPandas(run, "family string, gene_id string, cluster_id int, aligned string, consensus string")


def column_consensus(rows: DataFrame, by: str, row: str) -> DataFrame:
    """(by, consensus) of aligned rows of any number: counts per column, so that no group is collected."""
    each = rows.select(by, F.posexplode(F.split(row, "")).alias("i", "ch")).where("ch <> ''").groupBy(by, "i", "ch").agg(F.count("*").alias("n"))
    best = each.groupBy(by, "i").agg(F.min_by("ch", F.struct(-F.col("n"), "ch")).alias("ch"))
    return best.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "ch"))), lambda x: x["ch"]), "").alias("consensus"))


def admitted(clusters: DataFrame) -> DataFrame:
    """The clusters whose consensus is written: the first five of a family, those of three genes or more, placeholders, and any with a gene that has a name of its own."""
    size = clusters.groupBy("family", "cluster_id").agg(F.count("*").alias("size"), F.min("consensus").alias("consensus"), F.bool_or(~F.col("gene_id").rlike("^(?:ENS|LOC|Gm)")).alias("named"))
    return size.where((F.col("cluster_id") <= 5) | (F.col("size") >= 3) | F.col("family").isin("Ux", "RNYx", "SNORx", "MIRx") | F.col("named"))


def fasta_lines(df: DataFrame, name: Column, seq: Column, width: int = 0) -> DataFrame:
    """FASTA records as text, wrapped at `width` when it isn't 0."""
    body = F.array_join(F.transform(F.sequence(F.lit(0), F.greatest((F.length(seq) - 1) / width, F.lit(0)).cast("int")), lambda i: seq.substr(i * width + 1, F.lit(width))), "\n") if width else seq
    return df.select(F.concat(F.lit(">"), name, F.lit("\n"), body).alias("value"))
