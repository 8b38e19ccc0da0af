import importlib

from pyspark.sql import functions as F

from quillstone.operators import dataset, layout, tables
from quillstone.plans import pipeline, registry
from quillstone.sources import files
from quillstone.streaming import incremental


def _examples(spark, papers=40):
    chunks = [(f"p{i:02d}", c, f"text {i} {c}") for i in range(papers) for c in range(4)] + [("p00", 9, "  ")]
    ev = [(f"p{i:02d}", c, e, "zinc", "ke" if e else " MIE", "x") for i in range(papers) for c in (0, 1) for e in (0, 1, 2)] + [("p00", 2, 0, "", "KE", "x"), ("p00", 3, 0, "a", "XX", "x")]
    c = spark.createDataFrame(chunks, "paper_stem string, chunk_id int, text string")
    e = spark.createDataFrame(ev, "paper_stem string, chunk_id int, pos int, chemical string, event_type string, description string")
    valid = dataset.valid_events(e, ["paper_stem", "chunk_id"], ["pos"], F.col("chemical"), F.col("event_type"), F.col("description"))
    return c, valid


def test_examples(spark):
    c, valid = _examples(spark)
    assert valid.count() == 40 * 2 * 2
    ex = dataset.chunk_examples(c, valid, "Q\nText:\n")
    got = {(r.paper_stem, r.chunk_id): r for r in ex.where("paper_stem = 'p00'").collect()}
    assert set(k[1] for k in got) == {0, 1, 2, 3}
    assert got["p00", 0].messages[1].content == '"zinc","MIE","x"\n"zinc","KE","x"\n### END'
    assert got["p00", 2].messages[1].content == "### END" and not got["p00", 2].positive


def test_splits_and_folds(spark):
    c, valid = _examples(spark)
    papers = c.select("paper_stem").distinct()
    split = dataset.split_papers(papers, 0.15).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in split} == {"train": 34, "test": 6}
    assert dataset.split_papers(papers, 0.15).orderBy("paper_stem").collect() == dataset.split_papers(papers.repartition(7), 0.15).orderBy("paper_stem").collect()
    assert [r.split for r in dataset.split_papers(papers.limit(1), 0.5).collect()] == ["train"]
    folds = dataset.assign_folds(papers, 7)
    sizes = [r["count"] for r in folds.groupBy("fold").count().collect()]
    assert sum(sizes) == 40 and max(sizes) - min(sizes) <= 1 and len(sizes) == 7
    assert dataset.fold_copies(folds, 7).where("split = 'test'").count() == 40
    for k in (1, 41):
        try:
            dataset.assign_folds(papers, k)
        except ValueError:
            continue
        raise AssertionError(k)


def test_dataset_sizes_and_numbers(spark):
    c, valid = _examples(spark)
    numbered, stats, info = pipeline.label_dataset(c, valid, "Q\n", empty_ratio=0.5)
    per = {r.split: r for r in stats.collect()}
    assert per["train"].total_positive_chunks == 68 and per["train"].total_negative_chunks == 34
    assert per["all"].total_chunks == per["train"].total_chunks + per["test"].total_chunks and per["all"].MIE == per["all"].KE == 80
    lines = sorted(r.line_no for r in numbered.where("split = 'train'").collect())
    assert lines == list(range(1, 103))
    assert info.count() == 40 and sum(len(r.chunk_ids) for r in info.collect()) == per["all"].total_chunks


def test_token_lengths(spark):
    df = spark.createDataFrame([("a", 1), ("a", 5), ("a", 3), ("a", 9), ("b", 2), ("b", None)], "g string, t int")
    got = {r.g: tuple(r)[1:] for r in dataset.token_lengths(df, "g", "t", 4).collect()}
    assert got == {"a": (4, 1, 9, 5, 2), "b": (1, 2, 2, 2, 0)}


def test_tables(spark):
    rows = [["Sex", "Species", "n"], ["Female", "mouse", "1"], [None, " rat ", "2"], [None, None, None], ["", "", "7"], ["Male"]]
    df = spark.createDataFrame([(rows,), ([["1", "2"]],), ([[None]],), ([],)], "r array<array<string>>")
    got = [r.s for r in df.select(tables.serialise(F.col("r"), F.lit("T1")).alias("s")).collect()]
    assert got[0] == "T1:\nsex Female, species mouse, n 1. sex Female, species rat, n 2. sex Female, species rat, n 7. sex Male, species rat, n 7."
    assert got[1] == "T1:\n1, 2." and got[2] is None and got[3] is None


def test_fonts_and_overlap(spark):
    spans = [("d", 0, 0, "body text here", 10.04, 0, 0, 100, 10), ("d", 0, 1, "1", 6.0, 50, 2, 54, 6), ("d", 0, 2, "note", 6.0, 0, 100, 50, 106), ("d", 0, 3, " ", 99.0, 0, 0, 1, 1), ("d", 1, 4, "x", 0.0, 0, 0, 1, 1), ("e", 0, 0, "", 9.0, 0, 0, 1, 1)]
    df = spark.createDataFrame([(*s[:5], *map(float, s[5:])) for s in spans], "doc_id string, page int, pos int, text string, size double, x0 double, y0 double, x1 double, y1 double")
    dom = layout.dominant_size(df)
    assert {r.doc_id: r.dominant for r in dom.collect()} == {"d": 10.0, "e": 0.0}
    sized = df.where("doc_id = 'd'").join(dom, "doc_id")
    assert sorted(r.pos for r in layout.keep_spans(sized, "dominant").collect()) == [0, 1, 4]
    assert sorted(r.pos for r in layout.keep_spans(sized, "dominant", False).collect()) == [2, 4]


def test_boxes(spark):
    b = [("i", "Receptor", 0.9, 0, 0, 80, 12), ("i", "binding", 0.9, 85, 1, 140, 13), ("i", "falls", 0.9, 0, 16, 50, 28), ("i", "far away", 0.9, 900, 900, 980, 912), ("i", "low", 0.1, 0, 0, 80, 12), ("i", "***", 0.9, 0, 0, 80, 12), ("i", "FAR  away", 0.9, 900, 2000, 980, 2012)]
    df = spark.createDataFrame([(*x[:3], *map(float, x[3:])) for x in b], "image_id string, text string, score double, x0 double, y0 double, x1 double, y1 double")
    r = layout.image_texts(df).first()
    assert (r.n_blocks, r.figure_text) == (2, "Receptor binding falls. far away.")
    assert layout.image_texts(df.limit(0)).count() == 0


def test_combined_markdown(spark):
    df = spark.createDataFrame([("B", None, ["t1", "t2"], [])], "b string, s string, t array<string>, f array<string>")
    assert df.select(layout.combined_markdown(*map(F.col, "bstf")).alias("m")).first().m == "B\n\n# Tables\n\nt1\nt2\n"


def test_sources_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a b.md").write_bytes("# T\nx\xff y".encode("latin-1"))
    (tmp_path / "in" / "c.md").write_text("# U\nz")
    got = {r.doc_id: r.text for r in files.read_markdown(spark, str(tmp_path / "in")).collect()}
    assert got == {"a b": "# T\nx y", "c": "# U\nz"}
    (tmp_path / "r.jsonl").write_text('{"messages":[{"role":"user","content":"q"}]}\n\n{"messages":[]}\n')
    rec = files.read_jsonl(spark, str(tmp_path / "r.jsonl"), "records").collect()
    assert [(r.record_no, len(r.messages)) for r in rec] == [(1, 1), (2, 0)]
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "p.txt").write_text('"a",KE,s,l\nshort\nb,AO,"x, y",z\n')
    assert [(r.doc_id, r.event_id, r.description_short) for r in files.read_labels(spark, str(tmp_path / "l")).collect()] == [("p", 0, "s"), ("p", 2, "x, y")]
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    stage = lambda b: b.select("doc_id", F.length("text").alias("n"))
    incremental.run_stage(incremental.markdown_stream(spark, str(tmp_path / "in")), stage, out, ck).awaitTermination()
    (tmp_path / "in" / "d.md").write_text("new")
    incremental.run_stage(incremental.markdown_stream(spark, str(tmp_path / "in")), stage, out, ck).awaitTermination()
    done = spark.read.parquet(out)
    assert sorted(r.doc_id for r in done.collect()) == ["a b", "c", "d"] and done.select("batch").distinct().count() == 2
    left = files.pending(spark.createDataFrame([("a b",), ("zz",)], "doc_id string"), done)
    assert [r.doc_id for r in left.collect()] == ["zz"]


def test_documents_to_report(spark):
    docs = spark.createDataFrame([("p", "# Results.\nZinc oxide caused liver injury in rats.\n")], "doc_id string, text string")
    model = lambda chunks: chunks.withColumn("answer", F.lit('"zinc oxide","KE","liver injury"\n"lead","AO","death"\n### END'))
    matches, report = pipeline.score_documents(docs, model)
    assert {r.kind for r in matches.collect()} == {"sentences", "lines", "paragraphs", "chunks"}
    got = {r.chemical: (r.match_score, r.matched_text) for r in report.collect()}
    assert got == {"zinc oxide": (100.0, "Zinc oxide caused liver injury in rats."), "lead": (0.0, "")}


def test_registered_pipeline_runs_over_whole_tables(spark, tmp_path):
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))

    said = "# Results.\nZinc oxide caused liver injury in rats.\n"
    put("documents", [(1, said, "p00"), (2, said, "p00"), (3, said, None), (4, None, "p00")], "doc_id long, text string, paper_stem string")
    put("chunks", [(10 * i + c, f"p{i:02d}", c, f"text {i} {c}") for i in range(20) for c in range(2)], "chunk_key long, paper_stem string, chunk_id int, text string")
    ev = [(i, f"p{i:02d}", 0, "zinc oxide", "KE", "liver injury", "") for i in range(20)] + [(99, "p00", 0, "lead", "AO", "death", None), (100, "p00", 5, "lead", "AO", "no such chunk", None)]
    put("chunk_events", ev, "event_key long, paper_stem string, chunk_id int, chemical string, event_type string, description string, matched_chemical_variant string")
    put("eval_preds", [(7, '"zinc","KE","x"\n### END', '"zinc","KE","x"\n### END')], "pair_id long, gold string, pred string")
    run = lambda name: registry.queries()[name](spark, str(tmp_path)).collect()
    got = {(r.doc_id, r.chemical): (r.match_score, r.matched_text) for r in run("pipeline_report")}
    assert got == {(d, c): ((100.0, "Zinc oxide caused liver injury in rats.") if c == "zinc oxide" else (0.0, "")) for d in (1, 2) for c in ("zinc oxide", "lead")}
    assert {(r.doc_id, r.kind) for r in run("pipeline_matches")} == {(d, k) for d in (1, 2) for k in ("sentences", "lines", "paragraphs", "chunks")}
    data = run("pipeline_dataset")
    assert len(data) == 40 and {r.split for r in data} == {"train", "test"}
    assert {r.split: r.total_chunks for r in run("pipeline_dataset_stats")}["all"] == 40 and len(run("pipeline_dataset_papers")) == 20
    folds = run("pipeline_folds")
    assert {r.fold for r in folds} == set(range(5))
    assert sorted(r.paper_stem for r in folds if r.split == "test" and r.chunk_id == 0) == [f"p{i:02d}" for i in range(20)]
    assert {r.pair_id: (r.tp, r.fp, r.fn) for r in run("pipeline_predictions")} == {7: (1, 0, 0), None: (1, 0, 0)}


def test_registry_has_sql_only_for_its_queries():
    driver = importlib.import_module("__spark_entry__")
    assert set(driver.oracle_sql()) <= set(driver.queries())
