"""Comparison of predicted with gold events, per record and per paper."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.functions import fuzzy
from quillstone.functions.columns import once
from quillstone.functions.events import name_set, parse_events, prf
from quillstone.functions.text import norm
from quillstone.operators.skew import spread
from quillstone.session import balanced, cut

#: Gives the vector (array<double>) of a text as a column function.
Embedder = Callable[[Column], Column]

MIN_CHEMICAL = 0.4
SIM_THRESHOLD = 0.65
DEDUP_THRESHOLD = 0.85


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(length > 0, dot(a, b) / length).otherwise(0.0)


def chemical_similarity(a: Column, b: Column) -> Column:
    """1 if the chemicals share a name, else their fuzzy similarity."""
    return F.when(F.arrays_overlap(name_set(a), name_set(b)), 1.0).otherwise(fuzzy.fuzzy_score(a, b))


def event_similarity(df: DataFrame, chem_a: str, chem_b: str, description_sim: Column, name: str = "similarity") -> DataFrame:
    """0.4 chemical + 0.6 description; 0 where the chemicals are too unlike. Event types do not count."""
    gated = once(df, "__chem", chemical_similarity(F.col(chem_a), F.col(chem_b)))
    return gated.withColumn(name, F.when(F.col("__chem") < MIN_CHEMICAL, 0.0).otherwise(0.4 * F.col("__chem") + 0.6 * description_sim)).drop("__chem")


def first_events(events: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The first event of each (chemical, type, description) of a group, case and spacing aside."""
    w = Window.partitionBy(*group, norm(F.col("chemical")), F.upper("event_type"), norm(F.col("description"))).orderBy(*order)
    return events.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def semantic_dedup(events: DataFrame, group: list[str], order: str, embedding: str, threshold: float = DEDUP_THRESHOLD) -> DataFrame:
    """Per group, in order, the events whose vectors are below ``threshold`` to all kept before.

    A keep-first scan has no shorter form: the rows are sorted by group and order and stream through one Arrow
    function, which holds the vectors kept of the present group alone. Groups are the events of one answer with one
    chemical and type. A null vector or one of length 0 is like no other.
    """
    at, keys = events.columns.index(embedding), [events.columns.index(c) for c in group]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present, kept, size = None, np.empty((0, 0)), 0
        for batch in batches:
            names = list(zip(*(batch.column(i).to_pylist() for i in keys)))
            mask = np.ones(batch.num_rows, dtype=bool)
            for i, (name, v) in enumerate(zip(names, batch.column(at).to_pylist())):
                if name != present:
                    present, size = name, 0
                x = np.asarray(v if v is not None else [], dtype=float)
                n = float(np.sqrt(x @ x))
                if n:
                    x = x / n
                    if size and (kept[:size] @ x >= threshold).any():
                        mask[i] = False
                        continue
                    if size == len(kept) or not size:  # room doubles, so copying stays linear
                        grown = np.empty((max(2 * size, 4), len(x)))
                        grown[:size] = kept[:size] if size else 0
                        kept = grown
                    kept[size] = x
                    size += 1
            yield batch.filter(pa.array(mask))

    return events.repartition(*group).sortWithinPartitions(*group, order).mapInArrow(scan, events.schema)


def one_to_one(candidates: DataFrame, key: str, by: list[Column]) -> DataFrame:
    """The pairs (key, p, g) that are chosen by going through the candidates of a key in the order ``by``, p, g and
    taking each whose p and g are both still free.

    A candidate that comes first for its p and for its g is chosen in any case; so each round takes all
    of these at once, and drops what they rule out. No key's candidates ever meet in one task.
    """
    rows = cut(candidates.select(key, "p", "g", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(by)], F.col("p").alias("op"), F.col("g").alias("og")).alias("o"), *[c for c in candidates.columns if c not in (key, "p", "g")]))
    rest = [c for c in rows.columns if c != "o"]
    chosen = []
    while True:
        first_p = rows.groupBy(key, "p").agg(F.min("o").alias("fp"))
        first_g = rows.groupBy(key, "g").agg(F.min("o").alias("fg"))
        taken = cut(rows.join(first_p, [key, "p"]).join(first_g, [key, "g"]).where((F.col("o") == F.col("fp")) & (F.col("o") == F.col("fg"))).select(*rest))
        chosen.append(taken)
        rows = cut(rows.join(taken.select(key, "p"), [key, "p"], "left_anti").join(taken.select(key, "g"), [key, "g"], "left_anti"))
        if rows.isEmpty():
            break
    out = chosen[0]
    for more in chosen[1:]:
        out = out.unionByName(more)
    return out


def match_events(gold: DataFrame, pred: DataFrame, key: str, description_sim: Callable[[DataFrame], Column] | None = None, threshold: float = SIM_THRESHOLD) -> DataFrame:
    """key, p, g, how (exact or fuzzy), similarity: one-to-one matches of gold and predicted events.

    Both inputs have key, pos, chemical, description. Exact pairs (same normalised description, shared
    chemical name) are taken first, in prediction order: they come from an equi-join. Only what is left over is
    compared, gold with prediction of the same key, and the pairs at or above ``threshold`` are taken by falling
    similarity, ties in prediction, then gold order. A key may hold a tenth of all events: its predictions are
    spread over many tasks. ``description_sim(pairs)`` may replace the fuzzy similarity of descriptions, for
    example by the cosine of embeddings; the columns of either side stand in ``pairs`` as p_ and g_.
    """
    extra = [c for c in gold.columns if c not in (key, "pos", "chemical", "description") and c in pred.columns]

    def side(rows: DataFrame, x: str) -> DataFrame:
        named = rows.select(key, F.col("pos").alias(x), F.col("chemical").alias(f"{x}c"), F.col("description").alias(f"{x}d"), norm(F.col("description")).alias("said"), *[F.col(c).alias(f"{x}_{c}") for c in extra])
        return once(named, f"{x}n", name_set(F.col(f"{x}c")))

    g, p = cut(side(gold, "g")), cut(side(pred, "p"))
    equal = p.join(g, [key, "said"]).where(F.arrays_overlap("pn", "gn")).select(key, "p", "g")
    exact = one_to_one(equal, key, []).withColumn("how", F.lit("exact")).withColumn("similarity", F.lit(1.0))
    left_g = cut(g.join(exact.select(key, "g"), [key, "g"], "left_anti").drop("said"))
    left_p = cut(p.join(exact.select(key, "p"), [key, "p"], "left_anti").drop("said"))
    counts = cut(left_p.groupBy(key).agg(F.count("*").alias("n")))
    n_pairs = counts.join(left_g.groupBy(key).agg(F.count("*").alias("m")), key).agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0))).first()[0]
    pairs = balanced(spread(left_p, left_g, [key], counts, left_p.count()), n_pairs, key, "p", "g")
    gated = once(pairs, "chem", F.when(F.arrays_overlap("pn", "gn"), 1.0).otherwise(fuzzy.fuzzy_score(F.col("pc"), F.col("gc")))).where(F.col("chem") >= MIN_CHEMICAL)
    desc = fuzzy.fuzzy_score(F.col("pd"), F.col("gd")) if description_sim is None else description_sim(gated)
    near = once(gated, "similarity", 0.4 * F.col("chem") + 0.6 * desc).where(F.col("similarity") >= threshold).select(key, "p", "g", "similarity")
    close = one_to_one(near, key, [-F.col("similarity")]).withColumn("how", F.lit("fuzzy"))
    return exact.unionByName(close).select(key, "p", "g", "how", "similarity")


def compare_counts(gold: DataFrame, pred: DataFrame, matches: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Per key: n_gold, n_pred, exact_hits, fuzzy_hits, tp, fp, fn, precision, recall, f1."""
    hits = matches.groupBy(key).agg(F.count_if(F.col("how") == "exact").alias("exact_hits"), F.count_if(F.col("how") == "fuzzy").alias("fuzzy_hits"))
    n_gold, n_pred = gold.groupBy(key).agg(F.count("*").alias("n_gold")), pred.groupBy(key).agg(F.count("*").alias("n_pred"))
    every = keys.select(key).distinct().join(n_gold, key, "left").join(n_pred, key, "left").join(hits, key, "left").na.fill(0, ["n_gold", "n_pred", "exact_hits", "fuzzy_hits"])
    counted = every.withColumn("tp", F.col("exact_hits") + F.col("fuzzy_hits")).withColumn("fp", F.col("n_pred") - F.col("tp")).withColumn("fn", F.col("n_gold") - F.col("tp"))
    p, r, f1 = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return counted.withColumn("precision", F.bround(p, 4)).withColumn("recall", F.bround(r, 4)).withColumn("f1", F.bround(f1, 4))


def answer_events(preds: DataFrame, key: str, side: str) -> DataFrame:
    """key, pos, chemical, event_type, description of the sound rows of one side's answers."""
    return parse_events(preds.select(key, side), side, strict=True).select(key, F.col("line_pos").alias("pos"), "chemical", "event_type", "description")


def predicted_events(preds: DataFrame, key: str, embed: Embedder | None = None, threshold: float = DEDUP_THRESHOLD) -> DataFrame:
    """The events of the predictions; with ``embed`` those that say the same as an earlier one of the record, the
    chemical and the type are left out. ``embed`` gives the vector of a description as a column."""
    rows = answer_events(preds, key, "pred")
    if embed is None:
        return rows
    named = rows.withColumn("__name", norm(F.col("chemical"))).withColumn("__vector", embed(F.col("description")))
    return semantic_dedup(named, [key, "__name", "event_type"], "pos", "__vector", threshold).drop("__name", "__vector")


def evaluate_records(preds: DataFrame, key: str = "pair_id", embed: Embedder | None = None) -> DataFrame:
    """The comparison of every record; repeated predictions of a record count once, with ``embed`` also those that
    only say the same, and descriptions are then compared by the cosine of their vectors."""
    gold = cut(answer_events(preds, key, "gold"))
    pred = cut(first_events(predicted_events(preds, key, embed), [key], ["pos"]))
    cols = [key, "pos", "chemical", "description"]
    sim = None if embed is None else lambda pairs: cosine(F.col("p_vector"), F.col("g_vector"))
    if embed is not None:
        gold, pred = gold.withColumn("vector", embed(F.col("description"))), pred.withColumn("vector", embed(F.col("description")))
        cols.append("vector")
    return compare_counts(gold, pred, match_events(gold.select(cols), pred.select(cols), key, sim), preds, key)


def evaluate_groups(preds: DataFrame, groups: DataFrame, key: str = "pair_id", group: str = "paper_stem", embed: Embedder | None = None) -> DataFrame:
    """The comparison per group: events of a group's records count once; records without a group are left out."""
    mapped = cut(preds.join(groups.select(key, group), key).where(F.col(group).isNotNull()))

    def events(side: str) -> DataFrame:
        found = answer_events(mapped, key, side) if side == "gold" else predicted_events(mapped, key, embed)
        rows = found.join(mapped.select(key, group), key)
        first = first_events(rows, [group], [key, "pos"])
        order = Window.partitionBy(group).orderBy(key, "pos")
        return first.select(group, (F.row_number().over(order) - 1).alias("pos2"), "chemical", "description").withColumnRenamed("pos2", "pos")

    gold, pred = cut(events("gold")), cut(events("pred"))
    return compare_counts(gold, pred, match_events(gold, pred, group), mapped, group)


def score_summary(scored: DataFrame, group: list[str], score: str = "score", found: str = "chemical_found") -> DataFrame:
    """group, n, lowest, mean_score, highest and n_found: scores of predictions and how many name their chemical."""
    return scored.groupBy(*group).agg(F.count("*").alias("n"), F.min(score).alias("lowest"), F.avg(score).alias("mean_score"), F.max(score).alias("highest"), F.count_if(found).alias("n_found"))


def best_of_each(rows: DataFrame, group: list[str], order: list[Column], value: str, n: int) -> DataFrame:
    """group, best: ``value`` of the first ``n`` rows of each group in the order given."""
    ranked = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("__r") <= n)
    return ranked.groupBy(*group).agg(F.transform(F.sort_array(F.collect_list(F.struct("__r", value))), lambda x: x[value]).alias("best"))


def totals(counts: DataFrame) -> DataFrame:
    """One row: summed counts, and micro precision, recall and F1."""
    summed = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_gold", "n_pred", "exact_hits", "fuzzy_hits", "tp", "fp", "fn")])
    p, r, f1 = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return summed.withColumn("precision", p).withColumn("recall", r).withColumn("f1", f1)


def loss_summary(preds: DataFrame, loss: str = "loss") -> DataFrame:
    """n, mean_loss, perplexity (infinite at a mean of 50 or more)."""
    mean = F.avg(loss)
    return preds.agg(F.count(loss).alias("n"), mean.alias("mean_loss")).withColumn("perplexity", F.when(F.col("mean_loss") < 50, F.exp("mean_loss")).when(F.col("mean_loss").isNotNull(), F.lit(float("inf"))))


def sort_events(events: DataFrame) -> DataFrame:
    """By chemical, type (MIE, KE, AO, others) and description, case aside."""
    from quillstone.functions.events import type_rank

    return events.orderBy(F.lower("chemical"), type_rank(F.col("event_type")), F.lower("description"))
