import random
import re

import pytest
from pyspark.sql import functions as F

from quillstone.llm import answers, mixture, overlap, pieces, queries, scanned, spans, splits, tokenize, variants

PATH = tokenize.vocabulary_path("byte_bpe_50k")


# ---------------------------------------------------------------- 1


def _records(spark, rows):
    schema = "record_id long, split string, source string, messages array<struct<role:string,content:string>>"
    return spark.createDataFrame(rows, schema)


def test_overlap_matches_brute_force(spark):
    rnd = random.Random(1)
    vocab = [f"w{i}" for i in range(400)]
    base = [[rnd.choice(vocab) for _ in range(80)] for _ in range(40)]
    rows, shingles = [], {}
    for i in range(160):
        words = list(rnd.choice(base)) if i % 2 else [rnd.choice(vocab) for _ in range(60)]
        for _ in range(rnd.choice([0, 0, 2])):
            words[rnd.randrange(len(words))] = "edit"
        split = rnd.choice(["train", "train", "validation", "test"])
        rows.append((i, split, "s" if i % 3 else None, [("system", "x"), ("user", f"Do.\nText:\n{' '.join(words)}"), ("assistant", "### END")]))
        shingles[i] = (split, {tuple(words[k : k + 3]) for k in range(len(words) - 2)})
    rows += [(900, "train", "s", None), (901, "test", "s", []), (902, "train", "s", [("user", "Text:\na b")]), (903, "test", "s", [("user", "Text:\na b")]), (904, "train", "s", [("user", None)])]
    want = set()
    for a, (sa, xa) in shingles.items():
        for b, (sb, xb) in shingles.items():
            if sa == "train" and sb != "train" and len(xa & xb) >= 0.5 * len(xa | xb):
                want.add((min(a, b), max(a, b)))
    df = _records(spark, rows)
    assert {tuple(r) for r in overlap.overlapping_records(df).collect()} == want and want
    report = overlap.overlap_report(df).agg(F.sum("n_pairs")).first()[0]
    assert report == len(want)
    assert overlap.overlapping_records(df.limit(0)).count() == 0


def test_passage(spark):
    said = ["Text:\nold\nText:\nnew", "no marker Text: here", "a\nText:  \r\nx", "Text:"]
    df = _records(spark, [(i, "train", "s", [("user", s)]) for i, s in enumerate(said)])
    got = [r.p for r in df.orderBy("record_id").select(overlap.user_passage(F.col("messages")).alias("p")).collect()]
    assert got == ["new", "no marker Text: here", "x", ""]


# ---------------------------------------------------------------- 2


def test_variants(spark):
    rows = [(5, "Zinc-2", "KE", "at 1.5 mg"), (3, "zinc 2", " ke. ", "AT 1.5  MG!"), (4, "KE", "zinc2", "at 1.5mg"), (6, "zinc 2", "KE", "at 15 mg"), (7, "zinc 2", "KE", None), (8, "…", "KE", "x"), (9, "Zinc-2", "KE", "at 1.5 mg"), (1, "1,000.5", "a", "b"), (2, "1,000.5.", "a", "b")]
    df = spark.createDataFrame(rows, "event_key long, chemical string, event_type string, description string").withColumn("key", F.lit(0)).withColumn("n", F.lit(0))
    assert {tuple(r) for r in variants.copies(df).collect()} == {(3, 4), (3, 5), (3, 9), (1, 2)}
    assert {(r.kept_key, r.n_copies) for r in variants.collapsed(df).collect()} == {(3, 4), (6, 1), (1, 2)}
    assert variants.copies(df.limit(0)).count() == 0


def test_variants_with_a_hot_record(spark):
    df = spark.range(5000).select(F.col("id").alias("event_key"), F.when(F.col("id") % 3 == 0, "Hot").otherwise(F.concat(F.lit("c"), F.col("id"))).alias("chemical"), F.lit("KE").alias("event_type"), F.when(F.col("id") % 3 == 0, "same").otherwise("d").alias("description"))
    got = variants.copies(df)
    assert got.count() == 1666 and got.select("kept_key").distinct().count() == 1


# ---------------------------------------------------------------- 3

LEXICON = "the receptor response of liver cells was increased in mice and binding fell after hours down regulation influence".split()
KNOWN = frozenset(LEXICON)


@pytest.fixture(scope="module")
def reader():
    return scanned.page_reader(tuple(sorted(LEXICON)))


def test_line_defects(reader):
    text = "The recept0r res-\n- l2 -\nRecept0r binding in rnice | 12\nponse fell after\ndown-\nregulation of the liver.\n47\n13\nx = 1.2"
    heads = scanned.heads_of("Receptor binding in mice", ["Doe", "Roe"], "Annals of Cells", "Ann. Cell.")
    found, _, _ = reader.read(text, 12, 13, heads, KNOWN)
    assert set(found) == {(1, "misread"), (1, "hyphenation"), (2, "page_number"), (3, "running_header"), (8, "page_number")}
    assert reader.repair(text, 12, 13, heads, KNOWN).startswith("The receptor response fell after down- regulation of the liver.")


def test_furniture_forms():
    for line, page in (("27", 27), ("- 28 -", 28), ("PAGE l7 OF 50", 17), ("9 / 23", 9), ("p. 8", 8), ("| 12 |", 12), ("[2O]", 20), ("n = 9", None), ("5.6", None), ("in 9 days", None)):
        assert scanned.page_number_of(line, 1, 60) == page, line
    assert scanned.page_number_of("27", 1, 20) is None and scanned.page_number_of("27", None, None) is None
    heads = scanned.heads_of("Zinc and death in mice", ["Doe"], "Annals of Cells", "Ann. Cell.")
    for line in ("ZINC AND DEATH IN MICE", "zlnc and cleath in mice  28", "2 DOE ET AL.", "Ann. Cell. 13 (1980)", "Annals of Cells, vol. 22, 1998    9"):
        assert scanned.running_head_of(line, heads), line
    for line in ("Zinc and death in mice were seen", "death", "", "in mice"):
        assert not scanned.running_head_of(line, heads), line


def test_editor_generates_the_edits(reader):
    for wrong, right in (("rcceptor", "receptor"), ("1iver", "liver"), ("bindmg", "binding"), ("cell5", "cells"), ("iipon", None), ("zinc", None), ("liver", None)):
        assert reader.editor.fix(wrong, KNOWN) == right, wrong


def test_look_alikes_count_both_ways():
    words = "muscle cell fall of body gene hand liquid".split()
    editor = scanned.CharacterEditor(words)
    for wrong, right in (("musde", "muscle"), ("eell", "cell"), ("tall", "fall"), ("af", "of"), ("hody", "body"), ("8ody", "body"), ("6ene", "gene"), ("liguid", "liquid"), ("l1quid", "liquid")):
        assert editor.fix(wrong, words) == right, wrong
    found = scanned.page_reader(tuple(words)).read("the musde of\nthe cell", None, None, [], frozenset(words))[0]
    assert found == [(1, "misread")]


def test_without_the_models_nothing_is_found():
    bare = scanned.PageReader(list(LEXICON))
    bare.editor.model.w.clear(), bare.pages.model.w.clear()
    assert bare.read("The recept0r res-\nponse\n12\nZinc in mice", 12, 13, ["zinc in mice"], KNOWN)[0] == []


def test_long_furniture_and_long_words(reader):
    head = "effects of " + " ".join(f"compound {chr(97 + i % 26)}" for i in range(40)) + " on mice"
    heads = scanned.heads_of(head, None, None, None)
    for line in (head.upper(), f"{head}    {'-' * 80} 13", f"vol. 3, 1999 {head} 12"):
        assert reader.read(f"of liver cells\n{line}\nfell after hours", 12, 13, heads, KNOWN)[0] == [(2, "running_header")], line
    assert reader.read(f"of liver cells\n{'=' * 300} page 12 of 400 {'=' * 300}\nfell", 12, 13, heads, KNOWN)[0] == [(2, "page_number")]
    assert scanned.page_number_of("9" * 5000, 1, 10**9) is None and scanned.page_number_of("0" * 5000 + "7", 1, 9) == 7
    long_word = "electroencephalograph" * 5
    editor = scanned.CharacterEditor([*LEXICON, long_word])
    assert editor.fix(long_word.replace("g", "q", 1), [*LEXICON, long_word]) == long_word
    assert editor.fix("x1" * 20_000, KNOWN) is None


def test_a_large_lexicon_stays_distributed(spark, monkeypatch):
    c = spark.createDataFrame([(1, "p", 12, 13, "The recept0r res-\n12\nponse fe11"), (2, None, None, None, "bindmg"), (1, "p", 12, 13, "of l1ver")], "chunk_key long, paper_stem string, page_first int, page_last int, text string")
    p = spark.createDataFrame([("p", "T", ["Doe"], 1)], "paper_stem string, short_title string, authors array<string>, journal_id int")
    j = spark.createDataFrame([(1, "J", "J.")], "journal_id int, journal string, abbrev string")
    lex = spark.createDataFrame([(w,) for w in LEXICON], "word string")
    near = sorted(map(tuple, scanned.line_defects(c, p, j, lex).collect())), sorted(map(tuple, scanned.repaired(c, p, j, lex).collect()))
    monkeypatch.setattr(scanned, "SHIPPED_WORDS", 3)
    far = sorted(map(tuple, scanned.line_defects(c, p, j, lex).collect())), sorted(map(tuple, scanned.repaired(c, p, j, lex).collect()))
    assert near == far and near[0]


def test_scanned_tables(spark):
    chunks = [(1, "p", 12, 13, "res-\nponse", None), (2, None, None, None, "rcceptor", None), (3, "p", 1, 1, None, None), (4, "p", 1, 1, " \n", None)]
    c = spark.createDataFrame(chunks, "chunk_key long, paper_stem string, page_first int, page_last int, text string, journal string")
    p = spark.createDataFrame([("p", "T", ["Doe"], 1)], "paper_stem string, short_title string, authors array<string>, journal_id int")
    j = spark.createDataFrame([(1, "J", "J.")], "journal_id int, journal string, abbrev string")
    lex = spark.createDataFrame([(w,) for w in LEXICON] + [(None,)], "word string")
    assert {tuple(r) for r in scanned.line_defects(c, p, j, lex).collect()} == {(1, 1, "hyphenation"), (2, 1, "misread")}
    fixed = {r.chunk_key: r.repaired_text for r in scanned.repaired(c, p, j, lex).collect()}
    assert fixed == {1: "response", 2: "receptor", 3: None, 4: " \n"}
    assert scanned.line_defects(c.limit(0), p, j, lex).count() == 0


# ---------------------------------------------------------------- 4


def test_pieces_cover_the_text():
    rnd = random.Random(2)
    texts = [None, "", "  ", "one", "x" * 50_000, "a," * 4000, "\n\n".join("word " * rnd.randint(1, 300) for _ in range(30)), "नम 中。" * 700]
    texts += ["".join(rnd.choice(["word", " ", ". ", "\n", "\n\n", ", ", "x"]) for _ in range(rnd.randint(1, 2500))) for _ in range(60)]
    for t in texts:
        for limit, back in ((220, 30), (10, 0), (5, 4)):
            got = pieces.split_text(t, limit, back)
            units = len(pieces.UNIT.findall(t or ""))
            assert (len(got) > 1) == (pieces.tokens_of(units) > limit)
            if units:
                assert "".join(t[s + o : e] for s, e, o, _ in got) == t
            for s, e, _, n in got:
                assert n == pieces.tokens_of(len(pieces.UNIT.findall(t[s:e]))) <= limit


def test_sparse_table_breaks_ties_rightward():
    import numpy as np

    values = np.array([1, 3, 2, 3, 0, 3, 1])
    table = pieces.SparseTable(values)
    for lo in range(7):
        for hi in range(lo, 7):
            part = values[lo : hi + 1]
            assert table.argmax(lo, hi) == lo + max(i for i, v in enumerate(part) if v == part.max())


def test_natural_boundary_is_preferred():
    text = "a " * 120 + "end.\n\n" + "b " * 120
    cut = pieces.split_text(text, 220, 30)[0][1]
    assert text[:cut].endswith("end.\n\n")


# ---------------------------------------------------------------- 5


def _split_tables(spark):
    papers = [("a", ["X"], [1], "ST-1"), ("b", ["Y"], [2], "st 1"), ("c", ["Y2"], [2], "N/A"), ("d", ["unknown"], [0], "n/a"), ("e", ["unknown"], [0], None), ("f", ["Q"], [9], "unknown"), ("g", None, None, "")]
    p = spark.createDataFrame(papers, "paper_stem string, authors array<string>, author_ids array<long>, study_id string")
    part = "struct<papers:array<struct<id:string,filename:string,chunk_ids:array<int>>>>"
    info = [(1, ([("f", "F1.json", [1, 2]), ("g", "f1.MD", [3])],), ([],), ([("d", "d.json", [1])],))]
    s = spark.createDataFrame(info, f"build_id int, train {part}, validation {part}, test {part}")
    recs = [(1, 1, "train", 1, None), (2, 1, "train", 9, "c"), (3, 1, "test", 1, "zzz"), (4, 1, "train", 8, None), (5, 2, "train", 1, "e"), (6, 1, "train", 3, "a")]
    return spark.createDataFrame(recs, "record_id long, build_id int, split string, line_no int, _paper_stem string"), p, s


def test_related_records(spark):
    got = {tuple(r) for r in splits.grouped_records(*_split_tables(spark)).collect()}
    assert got == {(1, "f"), (2, "a"), (6, "f")}


def test_components_match_union_find(spark):
    rnd = random.Random(8)
    edges = [(f"n{rnd.randrange(300):03d}", f"n{rnd.randrange(300):03d}") for _ in range(220)] + [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(100, 160)]
    parent = {f"n{i:03d}": f"n{i:03d}" for i in range(300)}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    nodes = spark.createDataFrame([(n,) for n in parent], "node string")
    got = splits.components(nodes, spark.createDataFrame(edges, "u string, v string").where("u <> v"))
    assert {r.node: r.root for r in got.collect()} == {n: find(n) for n in parent}


def test_splits_persist_and_conflicts_are_quarantined(spark):
    recs, papers, info = _split_tables(spark)
    first, state = splits.assign_splits(recs, papers, info)
    assert first.count() == 6 and first.where("split IS NULL OR conflict").count() == 0
    assert first.where("record_id IN (1, 6)").select("split").distinct().count() == 1
    old = {"a": "train", "b": "train", "c": "train", "d": "test", "e": "validation", "f": "train", "g": "train"}
    kept = state.select("paper_stem", "root", F.element_at(F.create_map(*[F.lit(x) for kv in old.items() for x in kv]), F.col("paper_stem")).alias("split"))
    linked = papers.withColumn("study_id", F.when(F.col("paper_stem").isin("d", "e"), "ST-7").otherwise(F.col("study_id"))).unionByName(spark.createDataFrame([("h", ["X"], [1], None)], papers.schema))
    again, table = splits.assign_splits(recs, linked, info, kept)
    got = {r.paper_stem: (r.split, r.conflict) for r in table.collect()}
    assert got["h"] == ("train", False) and got["d"] == ("test", True) and got["e"] == ("validation", True) and got["f"] == ("train", False)
    assert again.count() == 6


def test_registered_splits_go_on_from_the_written_state(spark, tmp_path):
    one = "struct<papers:array<struct<id:string,filename:string,chunk_ids:array<int>>>>"
    names = [f"p{i:02d}" for i in range(20)]
    listed = lambda ps: ([(x, f"{x}.json", [i]) for i, x in enumerate(ps)],)
    spark.createDataFrame([(2, listed(names[:16]), ([],), ([],)), (3, listed(names[16:]), ([],), ([],))], f"build_id int, train {one}, validation {one}, test {one}").write.parquet(str(tmp_path / "split_info.parquet"))
    # p16 of the later build ties every paper of the earlier one together; p17 belongs to p18
    ids = {x: [i + 1] for i, x in enumerate(names)} | {"p16": list(range(1, 17)), "p17": [19]}
    spark.createDataFrame([(x, [None] * len(a), a, None) for x, a in ids.items()], "paper_stem string, authors array<string>, author_ids array<long>, study_id string").write.parquet(str(tmp_path / "papers.parquet"))
    spark.createDataFrame([(100 * b + i, b, "train", i, None) for b, n in ((2, 16), (3, 4)) for i in range(n)], "record_id long, build_id int, split string, line_no int, _paper_stem string").write.parquet(str(tmp_path / "train_records.parquet"))
    table = {r.paper_stem: r for r in queries.queries()["p5_components"](spark, str(tmp_path)).collect()}
    assert len({table[x].split for x in names[:16]}) > 1 and all(table[x].split for x in names[:16])  # they keep their splits
    assert all(table[x].conflict for x in names[:17]) and table["p16"].split is None
    assert table["p17"].split == table["p18"].split is not None and not table["p17"].conflict
    rows = {r.record_id: r for r in queries.queries()["p5_resumed"](spark, str(tmp_path)).collect()}
    assert len(rows) == 20 and all(r.split == table[r.paper_stem].split and r.conflict == table[r.paper_stem].conflict for r in rows.values())


# ---------------------------------------------------------------- 7


def test_defects():
    prompt = "Do this.\nText:\nLiver injury was seen in mice at 2 uM. The dose caused death of rats. No change came."
    row = '"zinc","KE","injury of the liver in mice"'
    cases = {
        None: "empty", "": "empty", " \n": "empty", '"",""': "empty", "(none)": "empty", "N/A": "empty", "### END": None, row + "\n### END": None, row: None,
        "I'm sorry, but I can't help with this list.": "refusal", "CANNOT COMPLY": "refusal", "As an assistant I am unable to give these.\n### END": "refusal",
        '"a","KE","inability of mice to feed"\n### END': None,
        "Liver injury was seen in mice at 2 uM. The dose caused death of rats.": "copy", prompt: "copy", prompt.split("Text:\n")[1].upper() + "\n### END": "copy",
        '"Liver injury was seen in mice at 2 uM."\n"No change came."': "copy",
        '"zinc","KE","Entzündung der Leber bei Mäusen nach 3 Tagen"\n### END': "language",
        row + '\n"lead","AO","inj': "truncated", row + '\n"lead","AO"': "truncated", row + "\nx": "truncated", 'zinc,XX\n### END': None,
    }
    for answer, wanted in cases.items():
        assert answers.defect_of(answer, prompt) == wanted, answer
    assert answers.defect_of(row, None) is None


def test_defects_beyond_the_known_phrases():
    prompt = "Do this.\nText:\nLiver injury was seen in mice at 2 uM. The dose caused death of rats. No change came after the days."
    row = '"zinc","KE","{}"\n### END'
    cases = {
        "Nothing to report.": "empty", "No AOP events are described in this text.": "empty", "No change of the liver was found": "truncated",
        "Mi dispiace, non posso aiutare.": "refusal", "Desculpe, não posso fornecer isso.": "refusal", "Sorry, I can't.": "refusal", "抱歉，无法回答": "refusal", "Sorry state of mice was seen in text": "truncated",
        row.format("повреждение печени у мышей"): "language", row.format("小鼠肝损伤"): "language", row.format("skada på levern hos möss efter tre dagar"): "language", row.format("β-catenin of liver in mice"): None,
    }
    for answer, wanted in cases.items():
        assert answers.defect_of(answer, prompt) == wanted, answer


def test_terminal_contexts_of_held_out_answers():
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghij ") for _ in range(rnd.randint(3, 30))).strip() or "x"
    rows = [f'"{word()}","{rnd.choice(["MIE", "KE", "AO"])}","{word()}"' for _ in range(600)]
    model = answers.TerminalModel([f"{r}\n### END" for r in rows[:300]])
    wrong = 0
    for r in rows[300:]:
        part = r[: rnd.randint(1, len(r) - 1)]
        wrong += model.cut(r) + (not model.cut(part))
    assert wrong <= 6
    model.model.w.clear()
    assert not any(answers.is_truncated(r[:-3], model) for r in rows)


def test_copies_are_proposed_by_the_compressor(monkeypatch):
    prompt = "Do this.\nText:\nLiver injury was seen in mice at 2 uM. The dose caused death of rats."
    assert answers.defect_of(prompt, prompt) == "copy"
    monkeypatch.setattr(answers, "COPY_SHARE", -1.0)
    assert answers.defect_of(prompt, prompt) != "copy"


def test_defective_answers(spark):
    df = spark.createDataFrame([(1, None, "### END", None), (2, "Text:\nx", "null", '"a","KE","b"')], "pair_id long, prompt string, gold string, pred string").withColumn("side", F.lit("x"))
    assert {tuple(r) for r in answers.defective_answers(df).collect()} == {(1, "pred", "empty"), (2, "gold", "empty")}
    assert answers.defective_answers(df.limit(0)).count() == 0


# ---------------------------------------------------------------- 8


def test_encoding_equals_the_tokenizer(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(PATH.replace(".tiktoken", ".json"))
    whole.encode_special_tokens = True
    rnd = random.Random(4)
    signs = " \n\t\r  \xa0 　'sdtrevm.,;abcé日“”à\x1c\x85 x1 9<|endoftext|>"
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 25))) for _ in range(2000)]
    texts += ["It's à la  carte \n\n x", "à b\xa0 c", "a" * 20_000, " lead", "trail ", "  ", "x\n y", "don't 's"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(-1, None), (-2, "")], "doc_id long, text string").withColumn("ids", F.lit(1))
    got = {r.doc_id: r.ids for r in tokenize.encode_corpus(df).collect()}
    assert got[-1] == [] and got[-2] == []
    for i, t in enumerate(texts):
        assert got[i] == whole.encode(t, add_special_tokens=False).ids, repr(t)
    counts = {r.doc_id: r.n_tokens for r in tokenize.count_tokens(df).collect()}
    assert counts == {k: len(v) for k, v in got.items()}
    assert tokenize.encode_corpus(df.limit(0)).count() == 0


# ---------------------------------------------------------------- 9


def test_mixture(spark):
    rows = [(i, "the cell " * (3 + i % 7), "big") for i in range(900)] + [(1000 + i, "the cell " * 5, "small") for i in range(60)] + [(5000, None, "small"), (5001, "", "big"), (5002, "x", None), (5003, "x", "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = spark.createDataFrame([("big", 0.7, 1), ("small", 0.2, 3), ("absent", 0.1, 9)], "source string, weight double, max_repeats int")
    mixture_, report = mixture.mix_sources(docs, mix)
    got = {r.source: r for r in report.collect()}
    assert abs(got["big"].share - 0.7 / 0.9) < 0.01 and abs(got["small"].share - 0.2 / 0.9) < 0.01 and got["absent"].share == 0.0
    assert mixture_.where("uses > IF(source = 'big', 1, 3)").count() == 0 and mixture_.groupBy("doc_id").count().where("count > 1").count() == 0
    assert got["small"].max_uses == 3 and not got["absent"].target_met
    again, _ = mixture.mix_sources(docs.repartition(5), mix)
    assert again.orderBy("doc_id").collect() == mixture_.orderBy("doc_id").collect()
    assert mixture.mix_sources(docs.limit(0), mix)[1].agg(F.sum("tokens")).first()[0] == 0


def test_temperature():
    targets, sizes, reps = {"a": 0.5, "b": 0.5}, {"a": 1000, "b": 10}, {"a": 1, "b": 2}
    x, budget = mixture.plan_mixture(targets, sizes, reps, total=500)
    assert 0 < x < 1 and budget["b"] == 20 and abs(sum(budget.values()) - 500) <= 1
    assert mixture.plan_mixture(targets, sizes, reps)[1] == {"a": 20, "b": 20}
    assert mixture.plan_mixture(targets, sizes, reps, total=10_000)[1] == {"a": 1000, "b": 20}
    x, _ = mixture.plan_mixture({"a": 0.99, "b": 0.01}, {"a": 10, "b": 10}, {"a": 9, "b": 9}, min_entropy=0.5)
    assert abs(mixture.entropy(mixture.tempered({"a": 0.99, "b": 0.01}, {"a": 10, "b": 10}, x)) - 0.5) < 1e-6


def test_scarce_source_bends_the_registered_mixture(spark, tmp_path):
    rows = [(i, "the cell " * 5, "big") for i in range(400)] + [(1000 + i, "the cell " * 5, "mid") for i in range(200)] + [(2000, "the cell " * 5, "tiny"), (3000, "the cell", "barred")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    targets = [("big", 0.4, 2), ("mid", 0.4, 2), ("tiny", 0.1, 3), ("barred", 0.1, 0)]
    spark.createDataFrame(targets, "source string, weight double, max_repeats int").write.parquet(str(tmp_path / "mix_targets.parquet"))
    report = {r.source: r for r in queries.p9_report(spark, str(tmp_path)).collect()}
    assert 0 < report["big"].exponent < 1 and not report["tiny"].target_met and report["barred"].tokens == 0
    used, there = sum(r.tokens for r in report.values()), sum(r.source_tokens for s, r in report.items() if s != "barred")
    assert abs(used - there) <= 0.01 * there and report["tiny"].max_uses == 3
    assert queries.p9_mixture(spark, str(tmp_path)).selectExpr("sum(n_tokens * uses)").first()[0] == used


def test_exponent_is_the_smallest_that_keeps_all_limits():
    rng = random.Random(5)
    for _ in range(200):
        names = "abcd"
        targets = mixture.normalised({s: rng.random() ** 4 for s in names})
        sizes, reps = {s: rng.randint(1, 10**6) for s in names}, {s: rng.randint(1, 4) for s in names}
        x, budget = mixture.plan_mixture(targets, sizes, reps, at_least_all=True)
        total = max(sum(sizes.values()), min(reps[s] * sizes[s] / targets[s] for s in names))
        keeps = lambda v: all(w * total <= reps[s] * sizes[s] * (1 + 1e-9) for s, w in mixture.tempered(targets, sizes, v).items())
        assert keeps(x) and not any(keeps(k / 500) for k in range(500) if k / 500 < x - 1e-9)
        assert abs(sum(budget.values()) - total) <= 4


# ---------------------------------------------------------------- 10


def _noise(rnd, n):
    return "".join(rnd.choice("abcdefgh .,") for _ in range(n))


def test_spans_match_brute_force(spark):
    rnd = random.Random(6)
    shared = [_noise(rnd, n) for n in (199, 200, 201, 350)] + ["é" * 200 + "x", "Same sentence here. " * 12]
    texts = {}
    for i in range(70):
        parts = [_noise(rnd, rnd.randint(0, 300))]
        for s in rnd.sample(shared, rnd.choice([0, 1, 1, 2])):
            parts += [s, _noise(rnd, rnd.randint(0, 200))]
        texts[i] = "".join(parts)
    texts |= {100: None, 101: "", 102: "short", 103: texts[3], 104: texts[3], 105: "- " * 500, 106: "- " * 300}
    windows = {k: {t[i : i + 200] for i in range(len(t) - 199)} for k, t in texts.items() if t}
    want = {(a, b) for a in windows for b in windows if a < b and windows[a] & windows[b]}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("n", F.lit(0))
    assert {tuple(r) for r in spans.shared_pairs(df).collect()} == want and len(want) > 50
    covered = {}
    for k, t in texts.items():
        others = set().union(*(w for j, w in windows.items() if j != k))
        hit = [False] * len(t or "")
        for i in range(len(t or "") - 199):
            if t[i : i + 200] in others:
                hit[i : i + 200] = [True] * 200
        covered[k] = sum(hit)
    assert {r.doc_id: r.shared_chars for r in spans.shared_extent(df).collect()} == covered
    assert spans.shared_pairs(df.limit(0)).count() == 0


def test_hot_anchor_pairs_only_real_stretches(spark):
    rnd = random.Random(7)
    boiler = "This standard notice of one hundred and fifty characters or so stands in a great many of the texts. It has two sentences, and no more than that here."
    texts = {i: _noise(rnd, 150) + ". " + boiler + " " + _noise(rnd, 150) for i in range(60)}
    long_ = _noise(rnd, 60) + boiler + _noise(rnd, 60)
    for i in (3, 9, 27):
        texts[i] = _noise(rnd, 50) + long_ + _noise(rnd, 50)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {tuple(r) for r in spans.shared_pairs(df).collect()} == {(3, 9), (3, 27), (9, 27)}


def test_repeated_sentences_are_removed(spark):
    a = "One is here. Two is here. Three is here. Four is new."
    b = "Start. One is here. Two is here. Three is here. End."
    df = spark.createDataFrame([(1, a), (2, b), (3, None), (4, "x")], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, re.sub(r"\s+", " ", r.kept_text or "").strip()) for r in spans.drop_repeated_sentences(df).collect()}
    assert got[1] == (0, a) and got[2] == (3, "Start. End.") and got[3][0] == 0 and got[4] == (0, "x")


# ---------------------------------------------------------------- hot groups


def test_a_notice_in_most_texts_is_covered_without_pairs(spark):
    notice = "This standard notice stands in nearly all of the texts. " * 5
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 9, F.concat(F.lit("other "), F.col("id"))).otherwise(F.concat(F.lit("begin "), F.col("id"), F.lit(". "), F.lit(notice), F.lit(" end "), F.col("id") * 7919)).alias("text"))
    rows = spans.shared_extent(docs).selectExpr("doc_id % 10 = 9 AS other", "shared_chars").distinct().collect()
    assert {r.shared_chars for r in rows if r.other} == {0}
    # the blanks and signs around the notice are shared too; digits beside them may agree by chance
    assert all(len(notice) + 6 <= r.shared_chars <= len(notice) + 20 for r in rows if not r.other)
    assert spans.shared_extent(docs.limit(0)).count() == 0


def test_a_third_of_all_records_may_be_one_passage(spark):
    said = lambda t: F.array(F.struct(F.lit("user").alias("role"), t.alias("content")))
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.concat(F.lit("w"), F.hash("id", i))), " ")
    text = F.when(F.col("id") % 3 == 0, F.lit("the same passage stands here in very many of the records")).otherwise(words)
    split = F.when(F.col("id") < 6, "test").otherwise("train")
    df = spark.range(6000).select(F.col("id").alias("record_id"), split.alias("split"), F.lit("s").alias("source"), said(text).alias("messages"))
    got = overlap.overlapping_records(df)
    assert got.count() == 2 * 1998 and got.select("record_a").distinct().count() == 2 and got.where("record_a >= record_b").count() == 0
    assert {(r.n_pairs, r.n_records) for r in overlap.overlap_report(df).collect()} == {(2 * 1998, 2)}


def test_copies_of_one_text_pair_in_salted_tasks(spark):
    docs = spark.range(1400).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1100, F.repeat(F.lit("Same text. "), 30)).otherwise(F.concat(F.lit("x"), F.col("id"))).alias("text"))
    assert spans.shared_pairs(docs).count() == 1100 * 1099 // 2
