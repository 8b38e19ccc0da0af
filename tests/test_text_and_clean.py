from pyspark.sql import functions as F

from quillstone.functions import clean, divide, text
from quillstone.plans import registry


def one(spark, fn, *values, schema=None):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], schema or ", ".join(f"{n} string" for n in names))
    return df.select(fn(*[F.col(n) for n in names]).alias("v")).first()["v"]


def test_normalisation_is_null_safe(spark):
    assert one(spark, text.norm, None) == ""
    assert one(spark, text.norm, " A  b \nC\x1c") == "a b c"
    assert one(spark, text.csv_quote, 'a "b"') == '"a ""b"""'
    assert one(spark, text.csv_quote, None) == '""'


def test_containment(spark):
    assert one(spark, text.contains_normalised, "The  Liver cell", "liver CELL")
    assert not one(spark, text.contains_normalised, "x", "")
    assert one(spark, text.contains_normalised, "x", " ")  # a needle of white space is found
    assert one(spark, text.contains_words, "with Zinc\n oxide, 5 mg", "zinc oxide")
    assert not one(spark, text.contains_words, "zincoxide", "zinc")
    assert not one(spark, text.contains_words, "réactif", "r")
    assert one(spark, text.contains_words, "a (b).*\\E c", "(b).*\\E")


def test_lines(spark):
    assert one(spark, text.lines_of, "a\r\nb\rc d\n") == ["a", "b", "c", "d"]
    assert one(spark, text.lines_of, None) == []


def test_cleaning_rules(spark):
    cases = [
        (clean.fix_coding, "&amp;lt; a – b", "< a - b"),
        (clean.fix_coding, "a /uniFB01 n b /uniFB03x c/uniFB02 d", "afin bffix c fld"),
        (clean.strip_comments, "a<!-- x\ny -->b", "ab"),
        (clean.drop_meaningless_lines, "ab\nx\n\ncd", "ab\n\ncd"),
        (clean.drop_bare_links, "4  http://a.b/c\nkeep this. yes\n3.5\nfoo.bar", "keep this. yes"),
        (clean.drop_artifacts, "---\na\n* \n=·=", "a"),
        (clean.drop_tables, "x\n| a | b |\n|---|---|\n| 1 | 2 |\n| 3\ny\n| no |", "x\ny\n| no |"),
        (clean.drop_tables, "| a |\n| |\n| 1 |", "| a |\n| |\n| 1 |"),
        (clean.dehyphenate, "lipo-\nprotein and é-\nb", "lipoprotein and éb"),
        (clean.fix_linebreaks, "a\n\nb", "a\n b"),
        (clean.fix_linebreaks, "a.\nb\nc", "a.\nb c"),
        (clean.drop_citations, "x (Smith et al., 2020; Doe, 1999) [1, 2-4] (n = 2000) (ok)", "x    (ok)"),
        (clean.drop_citations, "(120034)", ""),
        (clean.fix_whitespace, " a \n\n\n\n b", "a\n\nb"),
        (clean.fix_spacing, "a  b\n , c", "a b, c"),
        (clean.drop_trailing_dashes, "apple- . pear-, x-y fig- and", "apple . pear, x-y fig and"),
        (clean.normalise_headings, "a\n# H\n\ntext", "a\n\n# H\ntext"),
        (clean.normalise_headings, "# H\n\n## I\n\nx", "# H\n\n## I\nx"),
        (clean.normalise_headings, "Fig. 2: x\nTABLE 3 | Doses", "## Fig. 2: x\n\n## TABLE 3\nDoses".replace("\n\n## TABLE", "\n## TABLE")),
    ]
    for rule, given, wanted in cases:
        assert one(spark, rule, given) == wanted, (rule.__name__, given)


def test_joining_pairs_lines():
    assert clean.join_broken_text("a\nb\nc\nd\ne") == "a b\nc d\ne"
    assert clean.join_broken_text("a\n\n\nb.\nc") == "a b.\nc"
    assert clean.join_broken_text("lipo-\nprotein") == "lipoprotein"
    assert clean.join_broken_text("a\n# H\nx\n\n") == "a\n# H\nx"


def test_pipeline_of_rules(spark):
    given = "<!-- c -->\n# Results\n\nThe lipo-\nprotein fell (Doe, 1999)\nby half.\nx\n"
    df = spark.createDataFrame([(1, given), (2, None), (3, "")], "k int, text string")
    got = {r.k: r.text for r in clean.clean_documents(df).collect()}
    assert got[2] == got[3] == ""
    assert "lipoprotein" in got[1] and "1999" not in got[1] and "<!--" not in got[1]


def test_tables_inside_whole_chunk_texts(spark, tmp_path):
    rows = [(1, 7, "one two\n| p | q |\n|---|---|\n| 1 | 2 |", "Title"), (2, 8, "abcd", None), (3, None, None, None)]
    spark.createDataFrame(rows, "chunk_key long, chunk_id int, text string, section_title string").write.parquet(str(tmp_path / "chunks.parquet"))
    got = {r.chunk_key: r.cleaned for r in registry.queries()["clean_tables_in_text"](spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 3} and got[2] == "abcd\nbefore\nafter\n| no | table |\n" and got[3] == "\nbefore\nafter\n| no | table |\n"
    assert got[1].startswith("one two\n") and got[1].endswith("\nTitle") and "| 7 |" not in got[1] and "| a | b |" not in got[1]


def test_sentences(spark):
    said = one(spark, divide.sentences, "In Fig. 2 we see 3.5 mg. The dose was high! (yes) e.g. This.  and lower. 'A' x")
    assert said == ["In fig. 2 we see 3.5 mg.", "The dose was high!", "(yes) e.g. This.  and lower.".replace("  ", " "), "'A' x"]
    assert one(spark, divide.sentences, "Seen in the animal. The next") == ["Seen in the animal. The next"]
    assert one(spark, divide.sentences, None) == []


def test_token_count(spark):
    for given, wanted in ((None, 0), (" ", 0), ("a", 1), ("a b", 2), ("a b c d.", 6)):
        assert one(spark, divide.token_count, given) == wanted


def test_headings(spark):
    assert one(spark, divide.is_blacklisted, " References  cited")
    assert not one(spark, divide.is_blacklisted, "Referenced")
    assert one(spark, divide.looks_like_sentence, "Dose leads to death")
    assert one(spark, divide.looks_like_sentence, "One two three four five six")
    assert not one(spark, divide.looks_like_sentence, "RESULTS")
    assert one(spark, divide.heading_level, "  ### X") == 3


def test_budget():
    assert divide.ChunkBudget().clamped() == (96, 160, 220)
    assert divide.ChunkBudget(context=1700).clamped() == (96, 104, 104)
    assert divide.ChunkBudget(context=0).clamped() == (32, 32, 32)


def test_injected_counter(spark):
    words = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    budget = divide.ChunkBudget(min_tokens=3, target_tokens=4, max_tokens=5)
    packed = lambda units: spark.range(1).select(divide.pack_units(F.array(*map(F.lit, units)), budget, words).alias("c")).first().c
    assert packed(["a b", "c d", "e f g h i", "j"]) == ["a b c d", "e f g h i", "j"]
    assert packed(["a b c d, e f g, h", "i"]) == ["a b c d,", "e f g, h i"] and packed(["a b c d e f g"]) == ["a b c d e", "f g"]
    merged = divide._with_successor(F.array(*map(F.lit, ["a", "b", "c d e", "f"])), words, 2, 3)
    assert spark.range(1).select(merged.alias("c")).first().c == ["a b", "c d e", "f"]


def _reference_chunks(title, body, most):
    import re

    def sents(t):
        return [s for s in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9(\[\"'])", " ".join(t.split())) if s]

    def count(t):
        return int(1.25 * len(re.findall(r"\w+|[^\w\s]", t)))

    units = [f"## {title}.\n"] + [s for line in body.split("\n") for s in sents(line)]
    out, cur = [], ""
    for u in units:
        cand = u if not cur else cur + ("" if cur.endswith("\n") else " ") + u
        if cur and count(cand) > most:
            out.append(cur)
            cur = u
        else:
            cur = cand
    return out + [cur]


def test_chunks_match_a_plain_packer(spark):
    body = "\n".join(f"Sentence {i} has {i * 7 % 13} words, more or less. Then another one follows here; short." for i in range(40))
    got = divide.build_chunks(spark.createDataFrame([(1, f"lost line\n# Results\n{body}\n# References\nnone")], "doc_id int, text string")).orderBy("chunk_id").collect()
    assert [r.text for r in got] == _reference_chunks("Results", body, 220)
    assert all(r.token_count <= 220 for r in got) and {r.section_index for r in got} == {0}


def test_oversized_units(spark):
    long_ = " ".join(f"w{i}" for i in range(300))
    listed = ", ".join("a b c d e f g" for _ in range(60))
    fn = lambda c: divide.split_oversized_unit(c, 176)
    words, parts = one(spark, fn, long_), one(spark, fn, listed)
    assert " ".join(words) == long_ and len(words) == 2
    assert " ".join(parts) == listed and len(parts) == 3
    assert one(spark, fn, "short") == ["short"]
