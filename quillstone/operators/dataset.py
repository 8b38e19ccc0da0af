"""Building of labelled datasets: examples, negatives, splits, folds and their statistics.

Orders that the statement leaves to chance come from ``md5(seed|id)``, which any engine can reproduce:
sizes, disjointness and determinism per seed are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.functions.events import END_MARK, event_line
from quillstone.functions.text import squeeze, strip, text

TYPES = ("MIE", "KE", "AO")


def shuffled(seed: int, *ids: Column) -> Column:
    """A sort key that orders rows at random, the same for the same seed."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in ids]))


def valid_events(events: DataFrame, key: list[str], order: list[str], chemical: Column, event_type: Column, description: Column) -> DataFrame:
    """Events with a type of the three, a chemical and a description; the first of each triple per ``key``."""
    t = F.upper(strip(text(event_type)))
    rows = events.select(*key, *order, squeeze(chemical).alias("chemical"), t.alias("event_type"), squeeze(description).alias("description"))
    kept = rows.where(F.col("event_type").isin(*TYPES) & (F.col("chemical") != "") & (F.col("description") != ""))
    first = Window.partitionBy(*key, F.lower("chemical"), "event_type", F.lower("description")).orderBy(*order)
    return kept.withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r")


def chunk_examples(chunks: DataFrame, events: DataFrame, prompt: str) -> DataFrame:
    """paper_stem, chunk_id, chunk_text, events, n_events, positive, messages of every chunk with text.

    ``chunks``: one row per (paper_stem, chunk_id), text; ``events``: valid events with order ``pos``.
    """
    body = strip(text("text"))
    rows = chunks.select("paper_stem", "chunk_id", body.alias("chunk_text")).where("chunk_text <> ''")
    lists = events.groupBy("paper_stem", "chunk_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "chemical", "event_type", "description"))), lambda e: F.struct(e["chemical"].alias("chemical"), e["event_type"].alias("event_type"), e["description"].alias("description"))).alias("events"))
    empty = F.array().cast("array<struct<chemical:string,event_type:string,description:string>>")
    joined = rows.join(lists, ["paper_stem", "chunk_id"], "left").withColumn("events", F.coalesce("events", empty))
    lines = F.transform("events", lambda e: event_line(e["chemical"], e["event_type"], e["description"]))
    answer = F.array_join(F.concat(lines, F.array(F.lit(END_MARK))), "\n")
    said = F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit(prompt), F.col("chunk_text")).alias("content")), F.struct(F.lit("assistant").alias("role"), answer.alias("content")))
    return joined.withColumn("n_events", F.size("events")).withColumn("positive", F.col("n_events") > 0).withColumn("messages", said)


def split_papers(papers: DataFrame, ratio: float, seed: int = 42, key: str = "paper_stem") -> DataFrame:
    """key, split: the first max(1, floor(n ratio)) papers of the shuffled order are test; a single paper is train.

    The n-th smallest hash is found from block counts, so papers are never ranked in one task.
    """
    ids = papers.select(key).where(F.col(key).isNotNull()).distinct().withColumn("h", shuffled(seed, F.col(key)))
    n = ids.count()
    n_test = max(1, int(n * ratio)) if n > 1 else 0
    return _first_by_hash(ids, key, n_test).select(key, F.when(F.col("chosen"), "test").otherwise("train").alias("split"))


def _first_by_hash(ids: DataFrame, key: str, n: int) -> DataFrame:
    """``ids`` with ``chosen``: whether the row is among the first ``n`` by (h, key)."""
    block = F.substring("h", 1, 3)  # 4096 blocks
    sizes = {r["b"]: r["n"] for r in ids.groupBy(block.alias("b")).agg(F.count("*").alias("n")).collect()}
    left, edge = n, None
    for b in sorted(sizes):
        if left < sizes[b]:
            edge = b
            break
        left -= sizes[b]
    if edge is None:
        return ids.withColumn("chosen", F.lit(True))
    inside = Window.partitionBy("b").orderBy("h", key)
    whole = ids.where(block != edge).withColumn("chosen", block < edge)
    part = ids.where(block == edge).withColumn("b", block).withColumn("chosen", F.row_number().over(inside) <= left).drop("b")
    return whole.unionByName(part)


def assign_folds(papers: DataFrame, k: int, seed: int = 42, key: str = "paper_stem") -> DataFrame:
    """key, fold: round robin over the shuffled order, so that fold sizes differ by at most one.

    Blocks of the hash order are counted first; a paper's place is the count of the blocks before plus its
    place inside its block.
    """
    ids = papers.select(key).where(F.col(key).isNotNull()).distinct().withColumn("h", shuffled(seed, F.col(key)))
    ids = ids.withColumn("b", F.substring("h", 1, 3))
    sizes = ids.groupBy("b").agg(F.count("*").alias("n")).collect()
    n = sum(r["n"] for r in sizes)
    if k < 2 or k > n:
        raise ValueError(f"{k} folds of {n} papers")
    before, rows = 0, []
    for r in sorted(sizes, key=lambda r: r["b"]):
        rows.append((r["b"], before))
        before += r["n"]
    offsets = F.broadcast(papers.sparkSession.createDataFrame(rows, "b string, before long"))  # at most 4096 rows
    place = F.row_number().over(Window.partitionBy("b").orderBy("h", key)) - 1
    return ids.withColumn("place", place).join(offsets, "b").select(key, F.pmod(F.col("before") + F.col("place"), F.lit(k)).cast("int").alias("fold"))


def fold_copies(assigned: DataFrame, k: int) -> DataFrame:
    """Every paper in each of the ``k`` runs: as test in its own fold, as train in the others."""
    runs = assigned.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return runs.withColumn("split", F.when(F.col("run") == F.col("fold"), "test").otherwise("train"))


def sample_negatives(examples: DataFrame, ratio: float, seed: int = 42, split: str = "split") -> DataFrame:
    """All positive examples and, per split, min(floor(n_pos ratio), n_neg) negatives.

    Negatives are taken in hash order: blocks of the order are counted, whole blocks kept, and only the
    block in which the number is reached is ranked.
    """
    h = shuffled(seed + 999, F.col("paper_stem"), F.col("chunk_id"))
    rows = examples.withColumn("h", h).withColumn("b", F.substring("h", 1, 3))
    counted = rows.groupBy(split, "b").agg(F.count_if("positive").alias("pos"), F.count_if(~F.col("positive")).alias("neg"))
    by_split = Window.partitionBy(split)
    upto = by_split.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    room = F.least(F.floor(F.sum("pos").over(by_split) * F.lit(float(ratio))), F.sum("neg").over(by_split))
    limits = counted.select(split, "b", (room - F.coalesce(F.sum("neg").over(upto), F.lit(0))).alias("room"), "neg")
    joined = rows.join(limits, [split, "b"])
    keep_all = joined.where(F.col("positive") | (F.col("room") >= F.col("neg")))
    edge = joined.where(~F.col("positive") & (F.col("room") > 0) & (F.col("room") < F.col("neg")))
    place = F.row_number().over(Window.partitionBy(split, "b").orderBy("h", "paper_stem", "chunk_id"))
    some = edge.withColumn("__p", place).where("__p <= room").drop("__p")
    return keep_all.unionByName(some).drop("h", "b", "room", "neg")


def number_examples(examples: DataFrame, seed: int = 42, split: str = "split") -> DataFrame:
    """``examples`` in shuffled order with line_no (from 1) within each split: places in hash blocks plus the blocks before."""
    rows = examples.withColumn("h", shuffled(seed + 1, F.col("paper_stem"), F.col("chunk_id"))).withColumn("b", F.substring("h", 1, 3))
    counted = rows.groupBy(split, "b").agg(F.count("*").alias("n"))
    upto = Window.partitionBy(split).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.select(split, "b", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy(split, "b").orderBy("h", "paper_stem", "chunk_id"))
    return rows.withColumn("place", place).join(before, [split, "b"]).withColumn("line_no", (F.col("before") + F.col("place")).cast("int")).drop("h", "b", "before", "place")


def split_stats(examples: DataFrame, split: str = "split") -> DataFrame:
    """Per split and for all (split = 'all'): papers, chunks, positives, negatives, events, mean length (1 digit), events by type."""
    of = lambda t: F.sum(F.size(F.filter("events", lambda e: e["event_type"] == t)))
    grouped = examples.rollup(split).agg(
        F.grouping(split).alias("g"),
        F.countDistinct("paper_stem").alias("total_papers"),
        F.count("*").alias("total_chunks"),
        F.count_if("positive").alias("total_positive_chunks"),
        F.count_if(~F.col("positive")).alias("total_negative_chunks"),
        F.sum("n_events").alias("total_events"),
        F.bround(F.avg(F.length("chunk_text")), 1).alias("average_chunk_length"),
        *[of(t).alias(t) for t in TYPES],
    )
    return grouped.withColumn(split, F.when(F.col("g") == 1, "all").otherwise(F.col(split))).drop("g")


def split_papers_info(numbered: DataFrame, split: str = "split") -> DataFrame:
    """split, paper_stem, filename, chunk_ids (line numbers) of every paper, in order of the stem."""
    ids = numbered.groupBy(split, "paper_stem").agg(F.sort_array(F.collect_list("line_no")).alias("chunk_ids"))
    return ids.withColumn("filename", F.concat("paper_stem", F.lit(".json"))).select(split, "paper_stem", "filename", "chunk_ids").orderBy(split, "paper_stem")


def token_lengths(rows: DataFrame, group: str, tokens: str, limit: int) -> DataFrame:
    """group, n, shortest, longest, median (the upper one), over_limit, from exact counts of each length."""
    counted = rows.where(F.col(tokens).isNotNull()).groupBy(group, F.col(tokens).alias("t")).agg(F.count("*").alias("c"))
    upto = Window.partitionBy(group).orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # one row for each length, so the running sum is short however many rows there are
    ranked = counted.withColumn("upto", F.sum("c").over(upto)).withColumn("n", F.sum("c").over(Window.partitionBy(group)))
    return ranked.groupBy(group).agg(
        F.max("n").alias("n"), F.min("t").alias("shortest"), F.max("t").alias("longest"), F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("t"))).alias("median"), F.sum(F.when(F.col("t") > limit, F.col("c")).otherwise(0)).alias("over_limit")
    )


def longest_answer(rows: DataFrame, tokens: str, order: list[str]) -> DataFrame:
    """The row with the most tokens; the first in order among equals."""
    return rows.orderBy(F.desc(tokens), *order).limit(1)


