import random

from pyspark.sql import functions as F

from quillstone.functions import divide, fuzzy, text
from quillstone.operators import evaluate, matching, tables
from quillstone.plans import views
from quillstone.session import drop_stored, in_parallel, stored
from quillstone.sources import files


def greedy(pairs):
    taken_p, taken_g, out = set(), set(), []
    for _, p, g in sorted(pairs):
        if p not in taken_p and g not in taken_g:
            out.append((p, g)), taken_p.add(p), taken_g.add(g)
    return set(out)


def test_rounds_choose_as_the_ordered_scan_does(spark):
    rnd = random.Random(3)
    rows = [(k, p, g, rnd.choice([0.7, 0.8, 0.8, 0.9])) for k in range(12) for p in range(9) for g in range(8) if rnd.random() < 0.5]
    df = spark.createDataFrame(rows, "pair_id int, p int, g int, similarity double")
    got = {}
    for r in evaluate.one_to_one(df, "pair_id", [-F.col("similarity")]).collect():
        got.setdefault(r.pair_id, set()).add((r.p, r.g))
    assert got == {k: greedy([(-s, p, g) for kk, p, g, s in rows if kk == k]) for k in range(12)}
    assert evaluate.one_to_one(df.limit(0), "pair_id", []).count() == 0


def test_matching_equals_one_greedy_scan_over_all_pairs(spark):
    rnd = random.Random(9)
    chemicals, words = ["zinc oxide", "zinc", "lead (Pb)", "cadmium"], "liver injury in mice rats fish after days fell rose cell death".split()
    event = lambda k, i: (k, i, rnd.choice(chemicals), " ".join(rnd.sample(words, rnd.choice([2, 3, 4]))))
    gold = [event(k, i) for k in range(6) for i in range(rnd.randint(0, 7))]
    pred = [(k, i, c, d) if rnd.random() < 0.5 else event(k, i) for k, i, c, d in gold]
    schema = "pair_id int, pos int, chemical string, description string"
    got = {(r.pair_id, r.p, r.g, r.how) for r in evaluate.match_events(spark.createDataFrame(gold, schema), spark.createDataFrame(pred, schema), "pair_id").collect()}
    names = lambda c: {c.lower(), *(x.strip(" )") for x in c.lower().split(" (") if c.endswith(")"))}
    blend = lambda a, b: max(fuzzy.partial_ratio(a, b) * 0.7 + fuzzy.token_set_ratio(a, b) * 0.3, fuzzy.token_set_ratio(a, b) * 0.6 + fuzzy.partial_ratio(a, b) * 0.4) / 100
    want = set()
    for k in range(6):
        ps, gs = [x[1:] for x in pred if x[0] == k], [x[1:] for x in gold if x[0] == k]
        exact = greedy([(0, p[0], g[0]) for p in ps for g in gs if p[2] == g[2] and names(p[1]) & names(g[1])])
        left_p, left_g = [p for p in ps if p[0] not in {a for a, _ in exact}], [g for g in gs if g[0] not in {b for _, b in exact}]
        near = []
        for p in left_p:
            for g in left_g:
                chem = 1.0 if names(p[1]) & names(g[1]) else blend(p[1].lower(), g[1].lower())
                sim = 0.4 * chem + 0.6 * blend(p[2], g[2])
                if chem >= evaluate.MIN_CHEMICAL and sim >= evaluate.SIM_THRESHOLD:
                    near.append((-sim, p[0], g[0]))
        want |= {(k, p, g, "exact") for p, g in exact} | {(k, p, g, "fuzzy") for p, g in greedy(near)}
    assert got == want and {h for *_, h in want} == {"exact", "fuzzy"}


def test_same_meaning_is_kept_once_per_group(spark):
    rows = [("a", 1, [1.0, 0.0]), ("a", 2, [0.99, 0.05]), ("a", 3, [0.0, 1.0]), ("a", 4, None), ("a", 5, [0.0, 0.0]), ("b", 6, [0.99, 0.05]), (None, 7, [1.0, 0.0]), (None, 8, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "k string, pos int, v array<double>")
    assert sorted(r.pos for r in evaluate.semantic_dedup(df, ["k"], "pos", "v").collect()) == [1, 3, 4, 5, 6, 7]
    assert evaluate.semantic_dedup(df.limit(0), ["k"], "pos", "v").count() == 0


def test_vectors_compare_descriptions(spark):
    preds = spark.createDataFrame([(1, '"zinc","KE","liver injury"\n### END', '"zinc","KE","injury liver"\n"zinc","KE","liver injury"\n### END')], "pair_id long, gold string, pred string")
    row = evaluate.evaluate_records(preds, embed=views.letter_vector).first()
    assert (row.n_gold, row.n_pred, row.tp, row.fuzzy_hits) == (1, 1, 1, 1)
    assert evaluate.evaluate_records(preds).first().n_pred == 2


def test_places(spark):
    said = [("Aa receptor\nRECEPTORreceptor x", "Receptor"), ("none", "x.y"), (None, "a"), ("aaa", "aa"), ("a.b A.B", ".")]
    df = spark.createDataFrame(said, "h string, n string")
    assert [r.p for r in df.select(text.places(F.col("h"), F.col("n")).alias("p")).collect()] == [[4, 13, 21], [], [], [1], [2, 6]]
    for given, wanted in ((" a  b\n", [2, 3, 5]), (None, []), ("  ", []), ("x", [1])):
        assert spark.createDataFrame([(given,)], "t string").select(text.normal_places(F.col("t")).alias("p")).first().p == wanted


def test_failed_items_consume_a_number(spark):
    df = spark.createDataFrame([("d", 1, True), ("d", 2, False), ("d", 3, True), ("e", 1, True)], "doc string, pos int, ok boolean")
    got = {(r.doc, r.pos): r.heading for r in tables.numbered(df, "doc", ["pos"], F.col("ok"), "Figure").collect()}
    assert got == {("d", 1): "## Figure 1:", ("d", 3): "## Figure 3:", ("e", 1): "## Figure 1:"}


def test_a_score_function_may_be_given(spark):
    ev = spark.createDataFrame([("p", 1, "zinc", "KE", "injury", "")], "doc_id string, event_id int, chemical string, event_type string, description_short string, description_long string")
    bl = spark.createDataFrame([("p", "sentences", 0, "zinc was seen"), ("p", "sentences", 1, "zinc and more zinc")], "doc_id string, kind string, pos int, text string")
    got = matching.annotate(ev, bl, score_fn=lambda body, pairs: F.length(body).cast("double"), min_score=15.0).collect()
    assert [(r.pos, r.score) for r in got] == [(1, 18.0)]


def test_best_of_each_and_summary(spark):
    df = spark.createDataFrame([("a", 1, 5.0, True), ("a", 2, 9.0, False), ("a", 3, None, None), ("b", 4, 1.0, True)], "k string, id int, score double, chemical_found boolean")
    best = {r.k: r.best for r in evaluate.best_of_each(df, ["k"], [F.desc_nulls_last("score"), F.col("id")], "id", 2).collect()}
    assert best == {"a": [2, 1], "b": [4]}
    s = {r.k: (r.n, r.lowest, r.mean_score, r.highest, r.n_found) for r in evaluate.score_summary(df, ["k"]).collect()}
    assert s == {"a": (3, 5.0, 7.0, 9.0, 1), "b": (1, 1.0, 1.0, 1.0, 1)}


def test_reports_keep_their_order(spark, tmp_path):
    rows = spark.range(50).select(F.lit("r.txt").alias("file"), F.col("id").alias("at"), F.concat(F.lit("line "), "id").alias("line"))
    files.write_lines(rows.repartition(5), ["at"], str(tmp_path / "out"))
    parts = sorted((tmp_path / "out" / "file=r.txt").glob("part-*"))
    assert "".join(p.read_text() for p in parts).split("\n")[:-1] == [f"line {i}" for i in range(50)]


def test_blocks_of_all_kinds_come_from_one_row(spark):
    docs = spark.createDataFrame([(1, "before\n# One two.\nA b. C d.\n\n# References\nx"), (2, None), (3, "")], "doc_id int, text string")
    got = [(r.doc_id, r.kind, r.pos, r.title, r.text) for r in divide.document_parts(docs).collect()]
    assert got == [
        (1, "sentences", 0, None, "before"), (1, "sentences", 1, None, "A b."), (1, "sentences", 2, None, "C d."), (1, "sentences", 3, None, "x"),
        (1, "lines", 0, None, "before"), (1, "lines", 1, None, "A b. C d."), (1, "lines", 2, None, "x"),
        (1, "paragraphs", 0, "One two.", "A b. C d."), (1, "paragraphs", 1, "References", "x"), (1, "chunks", 0, "One two.", "## One two.\nA b. C d."),
    ]
    plan = divide.document_parts(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_stored_tables_are_dropped_and_small_scans_spread(spark):
    df = stored(spark.range(10))
    assert in_parallel(df, "id").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and df.count() == 10
    assert drop_stored(spark) >= 1 and drop_stored(spark) == 0


def test_lines_are_numbered_in_each_file(spark, tmp_path):
    import json

    (tmp_path / "in").mkdir()
    for name, n in (("a", 300), ("b", 7)):
        (tmp_path / "in" / f"{name}.jsonl").write_text("\n\n".join(json.dumps({"messages": [{"role": "user", "content": f"{name}{i}"}]}) for i in range(1, n + 1)) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")  # the first file has several blocks
    try:
        rows = files.read_jsonl(spark, str(tmp_path / "in"), "records").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 307 and all(r.messages[0].content == f"{r.doc_id}{r.record_no}" for r in rows)


def test_one_document_for_each_paper(spark):
    import json

    rows = spark.createDataFrame([("p", 2, "b", None), ("p", 1, "ü", 1), ("q", 1, None, 2)], "paper string, id int, t string, n int")
    got = {r.file: json.loads(r.content) for r in files.paper_documents(rows, "paper", ["id"], ["t", "n"], "events").collect()}
    assert got == {"p.json": {"paper": "p", "events": [{"t": "ü", "n": 1}, {"t": "b", "n": None}]}, "q.json": {"paper": "q", "events": [{"t": None, "n": 2}]}}


def test_corrupt_text_is_kept_for_faulty_rows_alone(spark):
    from quillstone.operators import parse_rows

    rows = spark.createDataFrame([(1, "p", 0, "a,KE,b,c"), (2, "p", 1, '"a","KE"')], "label_id long, paper_stem string, line_no int, raw_line string")
    got = {r.row_id: (r.reason, r.corrupt) for r in parse_rows.label_rows(rows).collect()}
    assert got == {1: (None, None), 2: ("column_count", '"a","KE"')}
