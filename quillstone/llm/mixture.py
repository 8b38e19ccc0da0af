"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

Sizes are tokens of a public tokenizer. With source sizes T, target weights w and repetition limits r, the
mixture family is ``p(x) ~ w^(1-x) * T^x``: x = 0 gives the targets, x = 1 the natural proportions. The
exponent is found by bisection: the smallest x at which no source would have to be repeated more than its
limit for the wanted total (or at which the weights reach a wanted entropy). Without a wanted total the
largest one is taken that the targets allow, so x stays 0 and every share is met. With ``at_least_all`` that
total is not taken below the tokens of all sources that can be used, so a scarce source bends the shares
instead of shrinking the mixture. Sources without a single token, or that may not be used even once, cannot
be used: their weight is spread over the others in proportion, and the report shows a share of 0. If even the natural proportions break a limit, the limited sources are filled up and the rest of the
budget is spread over the others, as far as it goes.

Each source's budget is realised as whole passes over its documents and a part of one more pass, in an
order given by a seeded permutation of blocks (documents are spread over blocks by hash). Block sizes are
summed before anything is ordered, whole blocks are taken as long as they fit, and only the one block in
which the budget ends is ordered by document, so no source is ever sorted as a whole and no running sum
crosses more than one block. The share reached is within one document of the budget.

Edge cases: documents with null or empty text have no tokens and are left out; so are documents without a
source or of a source that is not listed. A listed source with weight null or 0 gets nothing; a null
``max_repeats`` counts as 1. An empty table gives an empty mixture and a report of zeros.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.llm.tokenize import VOCABULARIES, count_tokens
from quillstone.session import cut

BLOCKS = 1024
#: At most so many listed sources are handled on the driver (their totals are one row each).
MAX_SOURCES = 100_000


def normalised(weights: dict[str, float]) -> dict[str, float]:
    whole = math.fsum(weights.values())
    return {s: w / whole for s, w in weights.items()} if whole > 0 else dict.fromkeys(weights, 0.0)


def tempered(targets: dict[str, float], sizes: dict[str, int], x: float) -> dict[str, float]:
    """Weights w^(1-x) * T^x, normalised, over sources with both above 0."""
    live = [s for s in targets if targets[s] > 0 and sizes.get(s, 0) > 0]
    logs = {s: (1 - x) * math.log(targets[s]) + x * math.log(sizes[s]) for s in live}
    top = max(logs.values(), default=0.0)
    return normalised({s: math.exp(v - top) for s, v in logs.items()})


def entropy(weights: dict[str, float]) -> float:
    return -math.fsum(w * math.log(w) for w in weights.values() if w > 0)


def _bisect(good, lo: float = 0.0, rounds: int = 60) -> float:
    """The smallest x in lo..1 with good(x), for good that stays true once true; 1 if there is none."""
    if good(lo):
        return lo
    hi = 1.0
    for _ in range(rounds):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if good(mid) else (mid, hi)
    return hi


def _within(targets: dict[str, float], sizes: dict[str, int], room: dict[str, int], total: float) -> float:
    """The smallest x at which no source has to give more than its room; 1 if there is none.

    A source's log share is concave in x, so from a point where it is over its room it comes back once for all;
    while x moves on, others may go over theirs.
    """
    over = lambda v: {s for s, w in tempered(targets, sizes, v).items() if w * total > room[s] * (1 + 1e-12)}
    x = 0.0
    while x < 1.0 and (bad := over(x)):
        x = _bisect(lambda v: not bad & over(v), x)
    return x


def plan_mixture(targets: dict[str, float], sizes: dict[str, int], repeats: dict[str, int], total: int | None = None, min_entropy: float | None = None, at_least_all: bool = False) -> tuple[float, dict[str, int]]:
    """The exponent and each source's budget in tokens."""
    sizes = {s: t for s, t in sizes.items() if repeats.get(s, 0) > 0}
    at_targets = tempered(targets, sizes, 0.0)
    if not at_targets:
        return 0.0, dict.fromkeys(targets, 0)
    room = {s: repeats[s] * sizes[s] for s in at_targets}
    if min_entropy is not None:
        x = _bisect(lambda v: entropy(tempered(targets, sizes, v)) >= min_entropy)
        weights = tempered(targets, sizes, x)
        total = min(room[s] / w for s, w in weights.items()) if total is None else total
    else:
        if total is None:
            total = min(room[s] / w for s, w in at_targets.items())
            if at_least_all:
                total = max(total, sum(sizes[s] for s in at_targets))
        x = _within(targets, sizes, room, total)
        weights = tempered(targets, sizes, x)
    budget, left, open_ = {}, float(total), dict(weights)
    while open_:  # sources at their limit are filled up, the rest is spread over the others
        share = normalised(open_)
        full = [s for s in open_ if share[s] * left > room[s] * (1 + 1e-12)]
        if not full:
            budget |= {s: share[s] * left for s in open_}
            break
        for s in full:
            budget[s] = float(room[s])
            open_.pop(s)
        left = max(float(total) - math.fsum(budget.values()), 0.0)
    return x, {s: min(int(round(budget.get(s, 0.0))), room.get(s, 0)) for s in targets}


def _targets(mix: DataFrame) -> tuple[dict[str, float], dict[str, int]]:
    rows = mix.where("source IS NOT NULL").groupBy("source").agg(F.max("weight").alias("w"), F.max("max_repeats").alias("r")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} listed sources")
    return {r["source"]: max(float(r["w"] or 0.0), 0.0) for r in rows}, {r["source"]: 1 if r["r"] is None else max(int(r["r"]), 0) for r in rows}


def mix_sources(docs: DataFrame, mix: DataFrame, total: int | None = None, min_entropy: float | None = None, at_least_all: bool = False, seed: int = 42, vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> tuple[DataFrame, DataFrame]:
    """The mixture (doc_id, source, n_tokens, uses) and the report, one row for each listed source:
    source, target_share, share, tokens, source_tokens, n_docs, max_uses, exponent, target_met."""
    spark = docs.sparkSession
    targets, repeats = _targets(mix)
    listed = F.broadcast(mix.where("source IS NOT NULL").select("source").distinct())
    counted = count_tokens(docs.where("source IS NOT NULL AND length(text) > 0").select("doc_id", "source", "text").join(listed, "source", "left_semi"), "doc_id", "text", ("source",), vocabulary, folder)
    block = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(BLOCKS)).cast("int")
    sized = cut(counted.where("n_tokens > 0").select("doc_id", "source", "n_tokens", block.alias("block")))
    blocks = cut(sized.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens")))
    sizes = {r["source"]: r["t"] for r in blocks.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    exponent, budget = plan_mixture(targets, sizes, repeats, total, min_entropy, at_least_all)
    plan = []
    for s in targets:
        t = sizes.get(s, 0)
        passes = budget[s] // t if t else 0
        plan.append((s, passes, budget[s] - passes * t))
    passes = F.broadcast(spark.createDataFrame(plan, "source string, passes long, part long"))
    # blocks in permuted order with the tokens before each: at most BLOCKS rows per source
    order = Window.partitionBy("source").orderBy(F.xxhash64("block", F.lit(seed + 1)), "block").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.join(passes, "source").withColumn("before", F.coalesce(F.sum("tokens").over(order), F.lit(0)))
    fate = F.when(F.col("before") + F.col("tokens") <= F.col("part"), 1).when(F.col("before") >= F.col("part"), 0)
    fated = cut(placed.select("source", "block", "passes", (F.col("part") - F.col("before")).alias("room"), fate.alias("extra")))
    # a row for each source and block: bounded by the sources on the driver times BLOCKS
    joined = sized.join(F.broadcast(fated) if len(targets) * BLOCKS <= 200_000 else fated, ["source", "block"])
    whole = joined.where("extra IS NOT NULL").select("doc_id", "source", "n_tokens", (F.col("passes") + F.col("extra")).alias("uses"))
    inside = Window.partitionBy("source", "block").orderBy(F.xxhash64("doc_id", F.lit(seed + 2)), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    split = joined.where("extra IS NULL").withColumn("upto", F.sum("n_tokens").over(inside))
    # the document in which the budget ends is used if at least half of it fits and no limit is broken
    some = split.select("doc_id", "source", "n_tokens", (F.col("passes") + F.when(F.col("upto") - F.col("n_tokens") / 2 <= F.col("room"), 1).otherwise(0)).alias("uses"))
    limits = F.broadcast(spark.createDataFrame([(s, repeats[s]) for s in targets], "source string, most long"))
    mixture = cut(whole.unionByName(some).join(limits, "source").select("doc_id", "source", "n_tokens", F.least("uses", "most").cast("int").alias("uses")).where("uses > 0"))
    reached = mixture.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.count("*").alias("n_docs"), F.max("uses").alias("max_uses"))
    rows = [(s, targets[s], sizes.get(s, 0), float(exponent)) for s in targets]
    base = spark.createDataFrame(rows, "source string, target_share double, source_tokens long, exponent double")
    report = base.join(reached, "source", "left").na.fill({"tokens": 0, "n_docs": 0, "max_uses": 0})
    every = Window.partitionBy(F.lit(1))  # one row for each listed source
    report = report.withColumn("share", F.coalesce(F.col("tokens") / F.nullif(F.sum("tokens").over(every), F.lit(0)), F.lit(0.0)))
    report = report.withColumn("target_met", F.abs(F.col("share") - F.col("target_share")) <= 0.005)
    return mixture, report.select("source", "target_share", "share", "tokens", "source_tokens", "n_docs", "max_uses", "exponent", "target_met")
