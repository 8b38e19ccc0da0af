import random

from pyspark.sql import functions as F

from quillstone.functions import bounds, events, fuzzy
from quillstone.functions.columns import once
from quillstone.operators import evaluate, matching, parse_rows
from quillstone.operators.skew import attach
from quillstone.plans import registry
from quillstone.sources import files


def test_faulty_rows(spark):
    labels = [
        (1, 'a,KE,b,c'), (2, '"a","ke "," b ",""'), (3, '"a" , "KE" , "b" , "c"'), (4, '"a","KE","b'), (5, '"a"x,KE,b,c'), (6, 'a,KE,5" b,c'), (7, 'a,KE,b'), (8, 'a,KE,b,c,d'),
        (9, 'KE,a,b,c'), (10, ',KE,b,c'), (11, 'a,KE, ,c'), (12, 'a,KE,b,�'), (13, 'a,KE,b,\x08'), (14, None), (15, ' \n'), (16, '### END'), (17, '"a ""q"", x","AO","b\nc","d,e"'), (18, '"a~c",KE,"~","~t"'), (19, '""""'),
    ]
    preds = [(1, 'a,KE,b\n\n"a","KE"\n### END'), (2, None), (3, ""), (3, "x")]
    lt = spark.createDataFrame([(i, "p", 0, raw) for i, raw in labels], "label_id long, paper_stem string, line_no int, raw_line string")
    pt = spark.createDataFrame(preds, "pair_id long, pred string")
    got = {(r.src[0], r.row_id, r.line_no): r.reason for r in parse_rows.faulty_rows(lt, pt).collect()}
    q, n, v = "broken_quoting", "column_count", "invalid_value"
    assert got == {("l", 4, 0): q, ("l", 5, 0): q, ("l", 6, 0): q, ("l", 7, 0): n, ("l", 8, 0): n, ("l", 9, 0): v, ("l", 10, 0): v, ("l", 11, 0): v, ("l", 12, 0): v, ("l", 13, 0): v, ("l", 19, 0): n, ("e", 1, 3): n, ("e", 3, 1): n}
    sound = {r.row_id: r for r in parse_rows.sound_rows(lt, pt).where("src = 'label_lines'").collect()}
    assert sorted(sound) == [1, 2, 3, 17, 18]
    assert (sound[2].event_type, sound[2].description_short, sound[2].description_long) == ("KE", "b", "")
    assert (sound[17].chemical, sound[17].description_short, sound[17].description_long) == ('a "q", x', "b\nc", "d,e")
    assert (sound[18].chemical, sound[18].description_short, sound[18].description_long) == ("a~c", "~", "~t")
    assert parse_rows.faulty_rows(lt.limit(0), pt.limit(0)).count() == 0


def test_lenient_fields_follow_a_plain_reader(spark):
    import csv

    raws = ['a,b,c', '"a","b, x","c ""q"""', '"a" , "b" , c', 'a "x",b', '"open,b', '"a"x,"b"', ' "a","b"', '""', 'a,,']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    got = {r.i: r.f for r in events.row_fields(df, "raw", "f").collect()}
    for i, raw in enumerate(raws):
        assert got[i] == [x.strip() for x in next(csv.reader([raw]))], raw


def test_label_events_keep_row_numbers(spark):
    rows = spark.createDataFrame([("p", 0, "short,row"), ("p", 1, '"a (b)",KE,s,l,extra'), ("p", 2, None)], "paper_stem string, line_no int, raw_line string")
    got = files.label_events(rows, "paper_stem", "line_no", "raw_line").collect()
    assert [(r.event_id, r.chemical, r.description_long) for r in got] == [(1, "a (b)", "l")]


def test_names(spark):
    cases = {"X [ab]": ("X", "ab"), "Y (q) (ab)": ("Y (q)", "ab"), "A / B / C": ("A", "B / C"), " plain ": ("plain", None), None: ("", None)}
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    for r in df.select("c", events.label_names(F.col("c")).alias("n")).collect():
        assert (r.n.base, r.n.abbr) == cases[r.c]
    sets = {r.c: set(r.s) for r in df.select("c", events.name_set(F.col("c")).alias("s")).collect()}
    assert sets["Y (q) (ab)"] == {"y (q) (ab)", "y (q)", "ab"} and sets["A / B / C"] == {"a / b / c", "a", "b", "c"} and sets[None] == set() and sets["X [ab]"] == {"x [ab]"}


def test_found_name(spark):
    cases = [("seen with DCF here", "Diclofenac (DCF)", True, "DCF"), ("Compounds 3 and 5 were", "compound 5", True, "compound 5"), ("compounds 3 and 15", "compound 5", False, "compound 5"), ("x", None, False, ""), (None, "a", False, "a")]
    df = spark.createDataFrame(cases, "t string, c string, f boolean, v string")
    for r in df.withColumn("g", events.found_name(F.col("t"), F.col("c"))).collect():
        assert (r.g.found, r.g.variant) == (r.f, r.v), r.c


def _lcs(a, b):
    prev = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b, 1):
            row.append(prev[j - 1] + 1 if x == y else max(prev[j], row[-1]))
        prev = row
    return prev[-1]


def test_partial_ratio_is_the_optimum_over_windows():
    rnd = random.Random(3)
    for _ in range(400):
        a, b = ("".join(rnd.choice("abc d") for _ in range(rnd.randint(0, n))) for n in (9, 30))
        s, t = (a, b) if len(a) <= len(b) else (b, a)
        if not s:
            wanted = 100.0 if not t else 0.0
        else:
            m = len(s)
            wanted = max(200 * _lcs(s, w) / (m + len(w)) for w in (t[max(e - m, 0) : min(e, len(t))] for e in range(1, len(t) + m)))
        assert abs(fuzzy.partial_ratio(a, b) - wanted) < 1e-9


def test_token_set_ratio():
    assert fuzzy.token_set_ratio("a b", "b a c") == 100.0
    assert fuzzy.token_set_ratio("", "a") == 0.0
    assert abs(fuzzy.token_set_ratio("ab cd", "ab ce") - 80.0) < 1e-9


def test_scores(spark):
    rows = [("The dose Caused  death.", "caused death", "x"), ("abc", "", ""), ("abc", "zzz", "..."), ("liver injury was seen", "liver injuries", "")]
    df = spark.createDataFrame(rows, "t string, s string, l string")
    df = once(df, "e", fuzzy.is_exact(F.col("t"), F.col("s"), F.col("l")))
    df = once(df, "es", fuzzy.is_exact(F.col("t"), F.col("s")))
    got = df.select(fuzzy.match_score(F.col("t"), F.col("s"), F.col("l"), F.col("e")).alias("a"), fuzzy.match_score_short(F.col("t"), F.col("s"), F.col("es")).alias("b")).collect()
    assert got[0].a == got[0].b == 100.0
    assert got[1].b == 10.0
    assert got[2].a == 100.0  # an ellipsis alone becomes a space, which is found in any text
    assert 10 <= got[3].a <= 90 and 10 <= got[3].b <= 90


def _pairs(spark):
    ev = [("d", 1, "zinc oxide", "KE", "liver injury", ""), ("d", 2, "Lead (Pb)", "AO", "death of cells", ""), ("d", 3, None, "AO", "liver injury", ""), ("e", 1, "zinc", "KE", "none", "")]
    bl = [("d", "sentences", 0, "Zinc oxide caused liver injury."), ("d", "sentences", 1, "Zinc oxide: liver injury."), ("d", "chunks", 0, "Zinc oxide caused liver injury. Pb: death of cells"), ("d", "lines", 0, "zinc oxides caused liver injury")]
    return (
        spark.createDataFrame(ev, "doc_id string, event_id int, chemical string, event_type string, description_short string, description_long string"),
        spark.createDataFrame([(d, k, p, None, t) for d, k, p, t in bl], "doc_id string, kind string, pos int, title string, text string"),
    )


def test_annotation(spark):
    ev, bl = _pairs(spark)
    got = {(r.event_id, r.kind, r.pos): (r.score, r.matched_variant) for r in matching.annotate(ev, bl).collect()}
    assert got == {(1, "sentences", 0): (100.0, "zinc oxide"), (1, "chunks", 0): (100.0, "zinc oxide"), (2, "chunks", 0): (100.0, "Pb")}
    missed = matching.unmatched(ev, matching.annotate(ev, bl))
    assert {(r.doc_id, r.event_id) for r in missed.collect()} == {("d", 3), ("e", 1)}
    loose = matching.annotate(ev, bl, require_chemical=False, top_k={"sentences": None})
    assert loose.where("event_id = 3").count() == 4
    best = {r.event_id: r.kind for r in matching.best_matches(matching.annotate(ev, bl)).collect()}
    assert best == {1: "sentences", 2: "chunks"}


def test_candidate_join_loses_nothing(spark):
    rnd = random.Random(5)
    words = ["zinc", "oxide", "pb-2", "β+", "compound 5", "no. 7", "(x)", "a"]
    ev = [("d", i, " ".join(rnd.sample(words, rnd.randint(1, 2))) + rnd.choice(["", " (ab)", " / q"]), "KE", "x", "") for i in range(40)]
    bl = [("d", "lines", i, None, " ".join(rnd.choice([*words, "ab", "q", "compounds 4, 5"]) for _ in range(4))) for i in range(40)]
    e = spark.createDataFrame(ev, "doc_id string, event_id int, chemical string, event_type string, description_short string, description_long string")
    b = spark.createDataFrame(bl, "doc_id string, kind string, pos int, title string, text string")
    slow = e.join(b, "doc_id").where(events.found_name(F.col("text"), F.col("chemical"))["found"]).select("event_id", "pos").collect()
    fast = matching.score_pairs(e, b, short_only=True).select("event_id", "pos").collect()
    assert sorted(map(tuple, fast)) == sorted(map(tuple, slow)) and slow


def test_pairs_below_the_threshold_are_not_scored(spark):
    rnd = random.Random(8)
    words = ["".join(rnd.choices("abcdefghijklmnoprstuvwy5", k=rnd.randint(2, 10))) for _ in range(400)]
    said = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    shorts, longs = [said(rnd.randint(5, 12)) for _ in range(60)], [said(16) for _ in range(60)]
    longs[:20], shorts[20:22], longs[22] = [""] * 20, ["", " "], " ... "
    ev = [("d", i, "Zinc oxide" if i % 3 else "zinc (Zn)", "KE", s, x) for i, (s, x) in enumerate(zip(shorts, longs))]
    worn = lambda x: "".join(c for c in x if rnd.random() < 0.93)
    bl = [("d", rnd.choice(matching.KINDS), i, None, f"{said(rnd.randint(0, 60))} {worn(rnd.choice(shorts))} Zinc  oxide {worn(rnd.choice(longs))} {said(rnd.randint(0, 60))}") for i in range(60)]
    e = spark.createDataFrame(ev, "doc_id string, event_id int, chemical string, event_type string, description_short string, description_long string")
    b = spark.createDataFrame(bl, "doc_id string, kind string, pos int, title string, text string")
    for short_only in (True, False):
        every = {(r.event_id, r.kind, r.pos): r.score for r in matching.score_pairs(e, b, short_only=short_only).collect()}
        true = {k for k, v in every.items() if v >= 68}
        near = {tuple(r) for r in matching.reaching_pairs(e, b, "doc_id", short_only, 68.0).select("event_id", "kind", "pos").collect()}
        assert len(every) == 60 * 60 and true <= near and 20 < len(near) < len(every) / 2
        top = {(r.event_id, r.kind, r.pos): r.score for r in matching.annotate(e, b, short_only=short_only, top_k={}).collect()}
        assert top == {k: round(every[k], 3) for k in true}


def _worn_texts(seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("abcdefghijklmnoprstuvwy5", k=rnd.randint(2, 10))) for _ in range(200)]
    said = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    worn = lambda x, share: "".join(c for c in x if rnd.random() < share)
    shorts, longs = [said(rnd.randint(1, 20)) for _ in range(12)], [said(rnd.randint(1, 40)) for _ in range(12)]
    texts = [" ".join(f"{said(rnd.randint(0, 90))} {worn(rnd.choice(shorts), rnd.choice([1, 0.95, 0.8, 0.6]))} {worn(rnd.choice(longs), rnd.choice([1, 0.9, 0.7]))}"[rnd.randint(0, 40) :].split()) for _ in range(40)]
    return shorts, longs, texts


def test_bounds_leave_what_reaches_the_threshold():
    shorts, longs, texts = _worn_texts(3)
    for least in (40.0, 68.0, 85.0):
        for quoted in ([""] * 12, longs):
            true = [[s in t or (x != "" and x in t) or (fuzzy.reached(t, s, x, least) or 0) >= least for t in texts] for s, x in zip(shorts, quoted)]
            assert bounds.may_reach(shorts, quoted, texts, least).tolist() == true and 0 < sum(map(sum, true)) < 12 * 40


def test_partial_ratio_sees_every_window():
    shorts, longs, texts = _worn_texts(4)
    for s, t in zip([*shorts, *longs], texts):
        m, n = sorted((len(s), len(t)))
        short, long_ = sorted((s, t), key=len)
        windows = [long_[max(0, i) : i + m] for i in range(1 - m, n)]
        best = 100.0 if short in long_ else max(fuzzy.ratio(short, w) for w in windows)
        assert abs(fuzzy.partial_ratio(s, t) - best) < 1e-9
        assert abs(fuzzy.partial_ratio(s, t, best - 1e-6) - best) < 1e-9 and (best == 100 or fuzzy.partial_ratio(s, t, best + 1) < best + 1)


def test_line_metrics(spark):
    df = spark.createDataFrame([([], []), (["a"], []), (["a", "b"], ["a", "c", "b"]), (["a", "a"], ["a"])], "p array<string>, g array<string>")
    got = [(r.o.ordered_exact, round(r.o.ordered_line_acc, 3), tuple(r.s)) for r in df.select(events.ordered_metrics(F.col("p"), F.col("g")).alias("o"), events.set_counts(F.col("p"), F.col("g")).alias("s")).collect()]
    assert got == [(1.0, 1.0, (0, 0, 0)), (0.0, 0.0, (0, 1, 0)), (0.0, 0.333, (2, 0, 1)), (0.0, 1.0, (1, 0, 0))]


def test_canonical_forms(spark):
    df = spark.createDataFrame([(" b\nA\n\n### END\nNO_EVENTS",), (None,)], "t string")
    got = df.select(events.canonical_answer(F.col("t")).alias("c"), events.canonical_target(F.col("t")).alias("d")).collect()
    assert (got[0].c, got[0].d) == ("A\nb", "### END\nA\nNO_EVENTS\nb") and (got[1].c, got[1].d) == ("", "")


def test_prompt_passage(spark):
    prefix = "Do it.\n\nText:\n"
    df = spark.createDataFrame([(prefix + "The context: and more",), (prefix + "plain",), ("x text: y",), ("none",), (None,)], "p string")
    assert [r.v for r in df.select(events.prompt_passage(F.col("p")).alias("v")).collect()] == ["The context: and more", "plain", "y", "none", ""]
    assert [r.v for r in df.select(events.prompt_passage(F.col("p"), prefix).alias("v")).collect()] == ["and more", "plain", "y", "none", ""]


def test_greedy_comparison(spark):
    gold = [(1, 0, "zinc", "liver injury"), (1, 1, "zinc", "liver injury"), (1, 2, "lead", "death of cells")]
    pred = [(1, 0, "Zinc", "Liver  injury"), (1, 1, "zinc (Zn)", "liver injury"), (1, 2, "lead", "death of many cells"), (1, 3, "gold", "x"), (2, 0, "a", "b")]
    schema = "pair_id int, pos int, chemical string, description string"
    g, p = spark.createDataFrame(gold, schema), spark.createDataFrame(pred, schema)
    got = sorted((r.p, r.g, r.how) for r in evaluate.match_events(g, p, "pair_id").collect())
    assert got == [(0, 0, "exact"), (1, 1, "exact"), (2, 2, "fuzzy")]
    keys = spark.createDataFrame([(1,), (2,), (3,)], "pair_id int")
    counts = {r.pair_id: (r.tp, r.fp, r.fn) for r in evaluate.compare_counts(g, p, evaluate.match_events(g, p, "pair_id"), keys, "pair_id").collect()}
    assert counts == {1: (3, 1, 0), 2: (0, 1, 0), 3: (0, 0, 0)}


def test_semantic_dedup(spark):
    rows = [(0, "g", [1.0, 0.0]), (1, "g", [0.99, 0.01]), (2, "g", [0.0, 1.0]), (3, "h", [1.0, 0.0]), (4, "g", [0.0, 0.0])]
    df = spark.createDataFrame(rows, "pos int, grp string, v array<double>")
    assert sorted(r.pos for r in evaluate.semantic_dedup(df, ["grp"], "pos", "v").collect()) == [0, 2, 3, 4]


def test_registered_dedup_drops_planted_near_copies_only(spark, tmp_path):
    # cosines to the first vector: 0.9 (a near copy), 0.8 and 0.5 (no copies)
    rows = [(0, 1, [1.0, 0.0, 0.0]), (1, 1, [0.9, 0.19**0.5, 0.0]), (2, 1, [0.8, -0.6, 0.0]), (3, 1, [0.5, 0.0, 0.75**0.5]), (4, 2, [0.9, 0.19**0.5, 0.0])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert sorted(r.vec_id for r in registry.queries()["semantic_dedup"](spark, str(tmp_path)).collect()) == [0, 2, 3, 4]


def test_hot_keys_join_alike(spark):
    rows = [(i, "hot" if i % 3 else f"k{i}") for i in range(6000)] + [(6000, None)]
    big = spark.createDataFrame(rows, "id int, k string")
    small = big.where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    for how in ("inner", "left"):
        got = attach(big, small, ["k"], "n", 6001, how).orderBy("id").collect()
        want = big.join(small.drop("n"), "k", how).select("id", "k", "top").orderBy("id").collect()
        assert got == want


def test_spread_salts_hot_keys(spark):
    from quillstone.operators.skew import spread

    big = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    other = spark.createDataFrame([(7, "a"), (7, "b"), (8, "c"), (None, "d")], "k long, w string")
    counts = big.groupBy("k").agg(F.count("*").alias("n"))
    got = spread(big, other, ["k"], counts, 6000)
    assert got.columns == ["k", "v", "w"] and sorted(map(tuple, got.collect())) == sorted(map(tuple, big.join(other, "k").collect()))
    assert spread(big, other.limit(0), ["k"], counts, 6000).count() == 0
