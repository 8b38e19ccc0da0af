"""Queries of the training-data operators, and the SQL of those that SQL can express.

Every query runs over its whole tables with the operators' default (production) parameters; the mixture of p9
is wanted as large as all the sources' tokens at least.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import answers, mixture, overlap, pieces, scanned, spans, splits, tokenize, variants
from quillstone.llm.sql import ORACLE
from quillstone.session import stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlapping_records(_table(spark, d, "train_records"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(_table(spark, d, "train_records"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return variants.copies(_table(spark, d, "chunk_events"))


def p2_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return variants.collapsed(_table(spark, d, "chunk_events"))


def _scanned(spark: SparkSession, d: str) -> list[DataFrame]:
    return [_table(spark, d, t) for t in ("chunks", "papers", "journals", "lexicon")]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return scanned.line_defects(*_scanned(spark, d))


def p3_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scanned.repaired(*_scanned(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return pieces.oversized(_table(spark, d, "chunks"))


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.split_oversized(_table(spark, d, "chunks"))


def p4_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """The text of every chunk out of its pieces without their overlaps, and the largest piece: nothing is lost."""
    made = pieces.split_oversized(_table(spark, d, "chunks"))
    fresh = F.transform(F.sort_array(F.collect_list(F.struct("piece_no", "overlap_chars", "piece"))), lambda x: F.substr(x["piece"], x["overlap_chars"] + 1))
    return made.groupBy("chunk_key").agg(F.array_join(fresh, "").alias("rebuilt"), (F.max("n_tokens") <= 220).alias("within"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.grouped_records(*(_table(spark, d, t) for t in ("train_records", "papers", "split_info")))


def p5_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign_splits(*(_table(spark, d, t) for t in ("train_records", "papers", "split_info")))[0]


def p5_audit(spark: SparkSession, d: str) -> DataFrame:
    """One row: records, those without a split, groups torn between splits, and whether each share is near its target."""
    placed = p5_splits(spark, d)
    torn = placed.where("group_stem IS NOT NULL").groupBy("group_stem").agg(F.countDistinct("split").alias("k")).agg(F.count_if(F.col("k") > 1).alias("n_torn"))
    shares = [F.abs(F.count_if(F.col("split") == s) / F.count("*") - share) < 0.05 for s, share in zip(splits.SPLITS, splits.SHARES)]
    counts = placed.agg(F.count("*").alias("n_records"), F.count_if(F.col("split").isNull()).alias("n_open"), (shares[0] & shares[1] & shares[2]).alias("shares_met"))
    return counts.join(torn)  # one row each


def _resumed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Splits of every second build with its papers; their state is written, and a second run goes on over all rows."""
    records, papers, info = (_table(spark, d, t) for t in ("train_records", "papers", "split_info"))
    early = F.col("build_id") % 2 == 0
    old_records, old_info = records.where(early), info.where(early)
    seen = splits.listed_papers(old_info).select("paper_stem").unionByName(splits.record_papers(old_records, old_info).select("paper_stem")).distinct()
    state = stored(splits.assign_splits(old_records, papers.join(seen, "paper_stem", "left_semi"), old_info)[1])
    return splits.assign_splits(records, papers, info, state)


def p5_resumed(spark: SparkSession, d: str) -> DataFrame:
    return _resumed(spark, d)[0]


def p5_components(spark: SparkSession, d: str) -> DataFrame:
    return _resumed(spark, d)[1]


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return answers.defective_answers(_table(spark, d, "eval_preds"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode_corpus(_table(spark, d, "documents"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix_sources(_table(spark, d, "documents"), _table(spark, d, "mix_targets"), at_least_all=True)[0]


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix_sources(_table(spark, d, "documents"), _table(spark, d, "mix_targets"), at_least_all=True)[1]


def p9_audit(spark: SparkSession, d: str) -> DataFrame:
    """One row: listed sources, used documents of other sources, documents used too often or twice, and whether the
    shares of the report are those of the mixture."""
    docs, targets = _table(spark, d, "documents").select("doc_id", F.col("source").alias("theirs")), _table(spark, d, "mix_targets")
    made, report = mixture.mix_sources(_table(spark, d, "documents"), targets, at_least_all=True)
    limits = targets.select("source", F.coalesce("max_repeats", F.lit(1)).alias("most"))
    rows = made.join(docs, "doc_id", "left").join(limits, "source", "left")
    used = rows.agg(F.count_if(F.col("most").isNull() | ~F.col("theirs").eqNullSafe(F.col("source"))).alias("n_foreign"), F.count_if(F.col("uses") > F.col("most")).alias("n_overused"), (F.count("*") - F.countDistinct("doc_id")).alias("n_twice"), F.sum(F.col("n_tokens") * F.col("uses")).alias("t"))
    said = report.agg(F.count("*").alias("n_sources"), F.sum("tokens").alias("u"), F.sum("share").alias("whole"))
    both = used.join(said)  # one row each
    return both.select("n_sources", "n_foreign", "n_overused", "n_twice", ((F.col("t") == F.col("u")) & (F.abs(F.col("whole") - 1) < 1e-9)).alias("adds_up"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_pairs(_table(spark, d, "documents"))


def p10_shared(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_extent(_table(spark, d, "documents"))


def p10_kept(spark: SparkSession, d: str) -> DataFrame:
    return spans.drop_repeated_sentences(_table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_report": p1_report,
        "p2_found": p2_found,
        "p2_collapsed": p2_collapsed,
        "p3_found": p3_found,
        "p3_repaired": p3_repaired,
        "p4_found": p4_found,
        "p4_pieces": p4_pieces,
        "p4_rebuilt": p4_rebuilt,
        "p5_found": p5_found,
        "p5_splits": p5_splits,
        "p5_audit": p5_audit,
        "p5_resumed": p5_resumed,
        "p5_components": p5_components,
        "p7_found": p7_found,
        "p8_ids": p8_ids,
        "p9_mixture": p9_mixture,
        "p9_report": p9_report,
        "p9_audit": p9_audit,
        "p10_found": p10_found,
        "p10_shared": p10_shared,
        "p10_kept": p10_kept,
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
