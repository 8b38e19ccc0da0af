"""The three runs of the pipeline over tables: documents to scored events, labels to dataset, predictions to metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions.clean import clean_documents
from quillstone.functions.divide import ChunkBudget, build_chunks, document_parts
from quillstone.functions.events import parse_events
from quillstone.operators import dataset, evaluate, matching
from quillstone.session import cut, stored

#: Asks a model for event rows; a deterministic stand-in is used in tests.
Extractor = Callable[[DataFrame], DataFrame]


def extract_events(chunks: DataFrame, extractor: Extractor, key: str = "doc_id") -> DataFrame:
    """key, chunk_id, event_id and the parsed events of the answers. ``extractor`` adds the column ``answer``
    to (key, chunk_id, text); it is meant to be a ``mapInPandas`` with the model loaded once per worker."""
    answers = extractor(chunks.select(key, "chunk_id", "text"))
    events = parse_events(answers.select(key, "chunk_id", "answer"), "answer")
    lists = events.groupBy(key, "chunk_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("line_pos", "chemical", "event_type", "description"))), lambda e: F.struct(e["chemical"].alias("chemical"), e["event_type"].alias("event_type"), e["description"].alias("description"))).alias("events"))
    return matching.flatten_predictions(lists, key, "chunk_id", "events")


def score_documents(docs: DataFrame, extractor: Extractor, key: str = "doc_id", budget: ChunkBudget = ChunkBudget()) -> tuple[DataFrame, DataFrame]:
    """Markdown to (matches, flat report): clean, divide, extract, match; the stages in between are written to the shared folder."""
    cleaned = stored(clean_documents(docs.select(key, "text")))
    events = stored(extract_events(build_chunks(cleaned, key, budget=budget), extractor, key))
    blocks = stored(document_parts(cleaned, key, budget=budget))
    found = stored(matching.annotate(events, blocks, key, short_only=True))
    # what no block supports stays with the chunk it came from, with score 0
    matches = found.unionByName(matching.place_unmatched(events, found, blocks, key), allowMissingColumns=True)
    return matches, matching.best_for_csv(events, matches, key)


def label_dataset(chunks: DataFrame, events: DataFrame, prompt: str, test_ratio: float = 0.15, empty_ratio: float = 1.0, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scored chunks to (numbered examples with split, statistics, papers per split)."""
    examples = dataset.chunk_examples(chunks, events, prompt)
    split = examples.join(dataset.split_papers(examples, test_ratio, seed), "paper_stem")
    numbered = cut(dataset.number_examples(dataset.sample_negatives(cut(split), empty_ratio, seed), seed))
    return numbered, dataset.split_stats(numbered), dataset.split_papers_info(numbered)


def fold_datasets(chunks: DataFrame, events: DataFrame, prompt: str, k: int = 5, empty_ratio: float = 1.0, seed: int = 42) -> dict[int, DataFrame]:
    """The numbered examples of each of ``k`` folds."""
    examples = cut(dataset.chunk_examples(chunks, events, prompt))
    copies = cut(dataset.fold_copies(dataset.assign_folds(examples, k, seed), k))
    out = {}
    for i in range(k):  # one independent plan for each fold
        split = examples.join(copies.where(F.col("run") == i).select("paper_stem", "split"), "paper_stem")
        out[i] = dataset.number_examples(dataset.sample_negatives(split, empty_ratio, seed + i), seed + i)
    return out


def prediction_report(preds: DataFrame, groups: DataFrame | None = None, key: str = "pair_id", group: str = "paper_stem") -> tuple[DataFrame, DataFrame]:
    """(per record or group, totals); with ``groups`` events are counted once per group."""
    counts = cut(evaluate.evaluate_records(preds, key) if groups is None else evaluate.evaluate_groups(preds, groups, key, group))
    return counts, evaluate.totals(counts)
