"""Mixing sources to target shares of tokens by entropy balancing.

Of all ways to give the documents of a source rates (how often each is taken) between 0 and the source's
repeat cap, whose tokens add up to the source's target, the one with the least entropy distance from
"each once" tilts the rates exponentially by length: rate = min(cap, exp(tilt * tokens / mean tokens)).
The tilt is found by Newton iterations on the convex dual. Targets, their tilts and the sums over the
histogram (source, tokens, documents) are tables; each iteration is one distributed job for all targets, and
the driver sees only how many are open. A dual that runs to its bound - every document at the cap, the
target still ahead - tells that the target can't be reached.

Rates become copies by systematic rounding: along a source's documents in the order of length, a document
is taken as often as the running sum of the rates, moved by an offset, passes a whole number. So what is taken of
any number of first documents is less than one off, and the tokens of a source miss its aim by less than two of
its longest documents whatever the offset; of 64 offsets the one that comes nearest to the aim is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.tokenizer import TOKENIZER, token_sizes
from strandloom.operators.chunking import numbered
from strandloom.operators.skew import keyed_left_join
from strandloom.runtime import broadcast_if_small, cut, fits, measured, table

STEPS, CLOSE = 80, 1e-9
INFINITE = float("inf")
OFFSETS = 64


def name(c: str) -> Column:
    """A source name as it compares and prints."""
    return F.lower(F.trim(F.col(c)))


def sized_documents(docs: DataFrame, targets: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens) of the documents whose source some mix names; written once, as counting tokens costs most."""
    wanted = targets.select(name("source").alias("_s")).where("_s is not null").distinct()
    rows = docs.withColumn("_s", name("source")).select("doc_id", "_s", "text").join(broadcast_if_small(wanted), "_s", "left_semi").select("doc_id", F.col("_s").alias("source"), "text")
    return cut(token_sizes(rows, ["doc_id", "source"], "text", path))


def lengths(sized: DataFrame) -> DataFrame:
    """(source, tokens, docs): how many documents of a source have so many tokens; as many rows as there are lengths."""
    return cut(sized.groupBy("source", "tokens").agg(F.count("*").alias("docs")))


def constraints(targets: DataFrame, histogram: DataFrame) -> DataFrame:
    """One row per row of `targets` (no): its share of the mix, the wanted tokens, the cap, and what the source has.

    A null share counts as 0, a null cap as 1, a negative value as 0; a null source has no documents.
    """
    mass = F.col("tokens") * F.col("docs")
    totals = histogram.groupBy(F.col("source").alias("_s")).agg(F.sum(mass).alias("have"), (F.sum(mass) / F.sum("docs")).alias("mean"))
    rows = targets.select("mix_id", name("source").alias("source"), F.greatest(F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("_share"), F.greatest(F.coalesce(F.col("max_repeats").cast("long"), F.lit(1)), F.lit(0)).alias("cap"))
    rows = cut(rows.withColumn("no", F.monotonically_increasing_id()))  # the numbers stay
    known = rows.join(broadcast_if_small(totals), F.col("source") == F.col("_s"), "left").drop("_s").withColumn("have", F.coalesce("have", F.lit(0)))
    mix = Window.partitionBy("mix_id")
    once = F.row_number().over(Window.partitionBy("mix_id", "source").orderBy("no")) == 1
    sizes = known.withColumn("_once", F.when(once, F.col("have")).otherwise(0)).withColumn("size", F.sum("_once").over(mix)).withColumn("_all", F.sum("_share").over(mix))
    share = F.when(F.col("_all") > 0, F.col("_share") / F.col("_all")).otherwise(0.0)
    want = F.when(F.col("_all") > 0, F.col("_share") / F.col("_all") * F.col("size")).otherwise(0.0)
    return cut(sizes.select("no", "mix_id", "source", share.alias("share"), "cap", want.alias("want"), "have", "size", "mean"))


def tilted(x: Column, tokens: Column, mean: Column, cap: Column) -> tuple[Column, Column]:
    """The rate of a document under the tilt x, and whether it is below the cap. All tokens are taken never at -inf, cap times at inf."""
    power = x * tokens / mean
    free = (x != INFINITE) & (cap > 0) & (power < F.log(cap))
    return F.when(x == -INFINITE, 0.0).when(free, F.exp(power)).otherwise(cap.cast("double")), free


def newton(histogram: DataFrame, goals: DataFrame) -> DataFrame:
    """(no, x, bound): the tilt of each goal (no, source, cap, mean, aim, x), and whether its dual ran to the bound.

    Newton steps between bounds that close in; where a step leaves them, they are halved or, when one is infinite,
    the tilt is doubled. A goal is done when its sum is the aim but for CLOSE, or when every document is at the cap.
    """
    inf = F.lit(INFINITE)
    start = goals.select("no", "source", F.col("cap").cast("double").alias("cap"), "mean", "aim", F.when(F.col("aim") <= 0, -inf).otherwise(F.coalesce("x", F.lit(0.0))).alias("x"), (-inf).alias("low"), inf.alias("high"), (F.col("aim") <= 0).alias("done"), F.lit(False).alias("bound"))
    state, facts = measured(start, open=F.count_if(~F.col("done")))
    for _ in range(STEPS):
        if not facts["open"]:
            break
        active = state.where(~F.col("done"))
        at = active.select("no", F.col("source").alias("_s"), "cap", "mean", "x")
        rate, free = tilted(F.col("x"), F.col("tokens"), F.col("mean"), F.col("cap"))
        mass = F.col("docs") * F.col("tokens")
        sums = histogram.where("tokens > 0").join(F.broadcast(at) if fits(facts) else at, F.col("source") == F.col("_s")).groupBy("no").agg(F.sum(mass * rate).alias("f"), F.sum(F.when(free, mass * F.col("tokens") / F.col("mean") * rate).otherwise(0.0)).alias("d"))
        met = active.join(sums, "no", "left").withColumn("f", F.coalesce("f", F.lit(0.0))).withColumn("d", F.coalesce("d", F.lit(0.0)))
        miss = F.col("f") - F.col("aim")
        bound = (miss < 0) & (F.col("d") == 0)
        done = bound | (F.abs(miss) <= CLOSE * F.col("aim"))
        low, high = F.when(miss < 0, F.col("x")).otherwise(F.col("low")), F.when(miss < 0, F.col("high")).otherwise(F.col("x"))
        moved = met.withColumn("_done", done).withColumn("bound", bound).withColumn("low", low).withColumn("high", high).withColumn("_step", F.when(F.col("d") > 0, F.col("x") - miss / F.col("d")))
        outside = F.when(F.col("high") == inf, F.greatest(F.col("x") * 2, F.lit(1.0))).when(F.col("low") == -inf, F.least(F.col("x") * 2, F.lit(-1.0))).otherwise((F.col("low") + F.col("high")) / 2)
        step = F.when((F.col("_step") > F.col("low")) & (F.col("_step") < F.col("high")), F.col("_step")).otherwise(outside)
        moved = moved.select("no", "source", "cap", "mean", "aim", F.when(F.col("bound"), inf).when(F.col("_done"), F.col("x")).otherwise(step).alias("x"), "low", "high", F.col("_done").alias("done"), "bound")
        state, facts = measured(state.where("done").unionByName(moved), open=F.count_if(~F.col("done")))
    return state.select("no", "x", "bound")


def solve(targets: DataFrame, histogram: DataFrame) -> DataFrame:
    """The constraints with the tilt `x` of their wanted tokens and `reachable`: false where the dual runs to its bound."""
    goals = constraints(targets, histogram)
    solved = newton(histogram, goals.withColumn("aim", F.col("want")).withColumn("x", F.lit(0.0)))
    # within CLOSE of the bound the exact totals decide
    short = F.col("cap") * F.col("have") < F.col("want")
    return cut(goals.join(solved, "no").withColumn("reachable", ~(F.col("bound") | short)).drop("bound"))


def rescaled(solved: DataFrame) -> DataFrame:
    """Adds `aim`: the wanted tokens, or, where sources of the mix fall short, what keeps the shares of the others.

    Sources that can't reach their target give all they may, u tokens; if the others' shares add up to r, the mix
    gets the size u / (1 - r), in which each of the others has its share. Sources without any token leave nothing
    to keep to: the others keep their wanted tokens.
    """
    mix = Window.partitionBy("mix_id")
    most = F.col("cap") * F.col("have")
    kept = F.sum(F.when(F.col("reachable"), F.col("share")).otherwise(0.0)).over(mix)
    given = F.sum(F.when(F.col("reachable"), 0).otherwise(most)).over(mix)
    at = solved.withColumn("_r", kept).withColumn("_u", given)
    size = F.when((F.col("_u") > 0) & (F.col("_r") < 1), F.col("_u") / (1 - F.col("_r")))
    return at.withColumn("aim", F.when(~F.col("reachable"), most.cast("double")).when(size.isNotNull(), F.col("share") * size).otherwise(F.col("want"))).drop("_r", "_u")


def balance(docs: DataFrame, targets: DataFrame, path: str = TOKENIZER) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sized documents, their histogram, and the goals with aims and the tilts for them."""
    sized = sized_documents(docs, targets, path)
    histogram = lengths(sized)
    goals = rescaled(solve(targets, histogram))
    again = newton(histogram, goals.where("reachable").withColumn("x", F.when(F.abs("x") < INFINITE, F.col("x")).otherwise(0.0))).select("no", F.col("x").alias("_x"))
    tilts = goals.join(again, "no", "left").withColumn("x", F.when(F.col("reachable"), F.col("_x")).otherwise(F.lit(INFINITE))).drop("_x")
    return sized, histogram, cut(tilts)


def copies(sized: DataFrame, histogram: DataFrame, goals: DataFrame) -> DataFrame:
    """(mix_id, source, no, doc_id, tokens, copies): how often each document is taken, documents taken never left out.

    Systematic rounding in the order of (tokens, doc_id): the same input gives the same copies, whatever its
    partitions, and no document passes its source's cap.
    """
    key = F.concat_ws("\x1f", "source", F.col("tokens").cast("string"))
    rate, _ = tilted(F.col("x"), F.col("tokens"), F.col("mean"), F.col("cap"))
    own = goals.where("source is not null and have > 0").select("no", "mix_id", F.col("source").alias("_s"), "cap", "mean", "x")
    rates = histogram.join(broadcast_if_small(own), F.col("source") == F.col("_s")).withColumn("_rate", rate)
    before = Window.partitionBy("no").orderBy("tokens").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as lengths
    rates = cut(rates.withColumn("_sum", F.coalesce(F.sum(F.col("docs") * F.col("_rate")).over(before), F.lit(0.0))).select(key.alias("_length"), "no", "mix_id", "cap", F.col("tokens").alias("_tokens"), "docs", "_rate", "_sum"))
    upto = lambda k, offset: F.floor(F.col("_sum") + k * F.col("_rate") + offset)
    tried = rates.withColumn("_try", F.explode(F.sequence(F.lit(0), F.lit(OFFSETS - 1)))).withColumn("_offset", (F.col("_try") + 0.5) / OFFSETS)
    reached = tried.groupBy("no", "_offset").agg(F.sum(F.col("_tokens") * (upto(F.col("docs"), F.col("_offset")) - upto(F.lit(0), F.col("_offset")))).alias("_reached"))
    best = reached.join(broadcast_if_small(goals.select("no", "aim")), "no").groupBy("no").agg(F.min_by("_offset", F.struct(F.abs(F.col("_reached") - F.col("aim")), "_offset")).alias("_offset"))
    placed, facts = measured(rates.join(broadcast_if_small(best), "no").drop("_tokens", "docs"))
    docs = numbered(sized.withColumn("_length", key), "_length", ["doc_id"])
    at = keyed_left_join(docs, placed, "_length", ["doc_id"], "inner", fits(facts))
    n = F.when(F.col("_rate") == F.col("cap"), F.col("cap")).otherwise(F.least(upto(F.col("_no") + 1, F.col("_offset")) - upto(F.col("_no"), F.col("_offset")), F.col("cap")))
    return at.select("mix_id", "source", "no", "doc_id", "tokens", n.cast("long").alias("copies")).where("copies > 0")


def found(spark, sf: str) -> DataFrame:
    """p8_found: the targets that can't be reached however often the source may be repeated: their duals run to the bound."""
    targets = table(spark, sf, "mix_targets")
    return solve(targets, lengths(sized_documents(table(spark, sf, "documents"), targets))).where(~F.col("reachable")).select("mix_id", "source")


def mixed(spark, sf: str) -> DataFrame:
    """p8_copies: the documents of each mix with their copies."""
    return copies(*balance(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))).select("mix_id", "source", "doc_id", "tokens", "copies")


def shares(sized: DataFrame, histogram: DataFrame, goals: DataFrame) -> DataFrame:
    """Per target the wanted share, what is aimed at, and the share reached of the mix's tokens, with the documents taken and their copies."""
    got = copies(sized, histogram, goals).groupBy("no").agg(F.count("*").alias("documents"), F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("tokens")).alias("tokens"))
    rows = goals.join(got, "no", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0))).withColumn("_mix", F.sum("tokens").over(Window.partitionBy("mix_id")))
    reached = F.when(F.col("_mix") > 0, F.col("tokens") / F.col("_mix"))
    return rows.select("mix_id", "source", "share", "reachable", F.col("have").alias("source_tokens"), F.round("want", 3).alias("wanted_tokens"), F.round("aim", 3).alias("aimed_tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("copies", F.lit(0)).alias("copies"), "tokens", reached.alias("reached_share"))


def report(spark, sf: str) -> DataFrame:
    """p8_report: per target the wanted and reached share of the mix's tokens, the documents taken and their copies."""
    return shares(*balance(table(spark, sf, "documents"), table(spark, sf, "mix_targets")))
