"""Splits that keep related records together: a persisted component table, merged by pointer jumping.

Papers are linked by keys (an author id, a study id, a file name). Each key links its papers to the
smallest of them, which gives one link per paper and key and no pairs. Labels start at each paper's own
stem (or, in a later run, at the root kept in the component table); each round every root takes the
smallest root it is linked to, then pointers are jumped until they point at roots. Rounds end when nothing
changes; their number grows with the logarithm of the longest chain. Each round is cut by a checkpoint. Hubs of
keys and roots of components may stand in a third of all rows: hubs and final roots meet their rows through ``attach``;
inside a round, where counting roots first would double the jobs, the adaptive skew join splits a large root.

The component table (paper_stem, root, split) is kept between runs. Components that have a split keep it;
new ones fill the deficits; a merge of components with different splits is a conflict: its papers keep
their old splits and are marked quarantined (``conflict``), and new papers of it get no split.

Edge cases: values that only say unknown or none, and ids that are null or not positive, link nothing; a
paper without links is its own component; papers named only in ``split_info`` or in records are papers
too; a record without any paper is a component of its own. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators.skew import attach
from quillstone.session import cut

#: What stands for a value that is not known, without case and separators.
NO_VALUE = (
    "", "unknown", "unknownstudy", "none", "na", "nan", "null", "nil", "nn", "notavailable", "notknown", "notapplicable",
    "notgiven", "notreported", "unspecified", "undefined", "undisclosed", "missing", "anonymous", "anon", "tbd", "etal", "unnamed", "nostudy", "noid", "noname",
)
SPLITS = ("train", "validation", "test")
SHARES = (0.8, 0.1, 0.1)
#: Components above 1/LARGE of all records are placed one by one (at most LARGE of them).
LARGE = 1000


def bare(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def says_something(c: Column) -> Column:
    return c.isNotNull() & ~bare(c).isin(*NO_VALUE)


def listed_papers(split_info: DataFrame) -> DataFrame:
    """build_id, split, paper_stem, filename, chunk_ids of every paper in the builds' lists."""
    parts = [split_info.select("build_id", F.lit(s).alias("split"), F.explode(F.col(f"{s}.papers")).alias("p")) for s in SPLITS]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.select("build_id", "split", F.col("p.id").alias("paper_stem"), F.col("p.filename").alias("filename"), F.col("p.chunk_ids").alias("chunk_ids"))


def record_papers(records: DataFrame, split_info: DataFrame) -> DataFrame:
    """record_id, paper_stem: the paper that lists the record's line, else the record's own stem."""
    lines = listed_papers(split_info).where("paper_stem IS NOT NULL").select("build_id", "split", "paper_stem", F.explode("chunk_ids").alias("line_no"))
    listed = lines.groupBy("build_id", "split", "line_no").agg(F.min("paper_stem").alias("listed"))
    return records.select("record_id", "build_id", "split", "line_no", "_paper_stem").join(listed, ["build_id", "split", "line_no"], "left").select("record_id", F.coalesce("listed", "_paper_stem").alias("paper_stem"))


def paper_links(papers: DataFrame, split_info: DataFrame) -> DataFrame:
    """paper_stem, link: the keys that tie papers together (distinct)."""
    named = papers.where("paper_stem IS NOT NULL")
    authors = named.select("paper_stem", F.explode(F.arrays_zip(F.col("author_ids").alias("id"), F.col("authors").alias("name"))).alias("a"))
    # an id under which only names for "unknown" stand is no person's id
    persons = authors.where((F.col("a.id") > 0) & (F.col("a.name").isNull() | says_something(F.col("a.name"))))
    by_author = persons.select("paper_stem", F.concat(F.lit("a:"), F.col("a.id").cast("string")).alias("link"))
    by_study = named.where(says_something(F.col("study_id"))).select("paper_stem", F.concat(F.lit("s:"), bare(F.col("study_id"))).alias("link"))
    base = F.regexp_replace(F.lower(F.trim("filename")), r"\.[^.]*$", "")
    by_file = listed_papers(split_info).where(F.col("paper_stem").isNotNull() & says_something(base)).select("paper_stem", F.concat(F.lit("f:"), base).alias("link"))
    return by_author.unionByName(by_study).unionByName(by_file).distinct()


def _star(links: DataFrame) -> DataFrame:
    """u, v: each paper of a key with the smallest paper of the key (u <> v), both directions."""
    keys = cut(links.groupBy("link").agg(F.min("paper_stem").alias("hub"), F.count("*").alias("n")).where("n > 1"))
    total = links.count()
    star = attach(links, keys, ["link"], "n", total).where("paper_stem <> hub").select(F.col("paper_stem").alias("u"), F.col("hub").alias("v")).distinct()
    return star


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable over ``edges`` (u, v), for every row of ``nodes`` (node).

    Each round hooks every node and its present root to the smallest root next to it and then jumps
    pointers once; it is one plan and one checkpoint.
    """
    total = edges.count()
    if not total:
        return nodes.distinct().withColumn("root", F.col("node"))
    both = cut(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    # the hub of a key may be linked to a third of all papers: it is met through attach
    degree = cut(both.groupBy(F.col("v").alias("node")).agg(F.count("*").alias("n")))
    linked = degree.select("node", F.col("node").alias("root"), F.lit(True).alias("moved"), "n")
    while True:
        known = linked.select(F.col("node").alias("v"), F.col("root").alias("root_v"), "n")
        near = attach(both, known, ["v"], "n", 2 * total).groupBy(F.col("u").alias("node")).agg(F.min("root_v").alias("near"))
        met = linked.join(near, "node").select("node", "root", "n", F.least("root", "near").alias("low"))
        hooks = met.select("node", "low").unionByName(met.select(F.col("root").alias("node"), "low")).groupBy("node").agg(F.min("low").alias("low"))
        hooked = linked.join(hooks, "node").select("node", "root", "n", F.least("root", "low").alias("low"))
        above = hooked.select(F.col("node").alias("low"), F.col("low").alias("next"))
        jumped = hooked.join(above, "low").select("node", F.least("low", "next").alias("root"), (F.col("root") != F.least("low", "next")).alias("moved"), "n")
        linked = cut(jumped)
        if linked.where("moved").isEmpty():
            break
    roots = linked.select("node", "root")
    return nodes.distinct().join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def paper_components(records: DataFrame, papers: DataFrame, split_info: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(record_id, paper_stem) of all records, and (node, root) of all papers."""
    owned = cut(record_papers(records, split_info))
    links = cut(paper_links(papers, split_info))
    nodes = papers.select(F.col("paper_stem").alias("node")).unionByName(links.select(F.col("paper_stem").alias("node"))).unionByName(owned.select(F.col("paper_stem").alias("node"))).where("node IS NOT NULL")
    return owned, cut(components(nodes, cut(_star(links))))


def grouped_records(records: DataFrame, papers: DataFrame, split_info: DataFrame) -> DataFrame:
    """record_id, group_stem: records of papers that belong together with at least one other paper."""
    owned, labels = paper_components(records, papers, split_info)
    # a component may hold a third of all papers
    several = cut(labels.groupBy("root").agg(F.count("*").alias("k")).where("k > 1"))
    total = several.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]
    grouped = attach(labels, several, ["root"], "k", total)
    sizes = owned.groupBy(F.col("paper_stem").alias("node")).agg(F.count("*").alias("n"))
    known = cut(grouped.join(sizes, "node").select(F.col("node").alias("paper_stem"), F.col("root").alias("group_stem"), "n"))
    return attach(owned, known, ["paper_stem"], "n", owned.count()).select("record_id", "group_stem")


def _choose(sized: DataFrame, have: dict[str, int], shares: tuple[float, ...], seed: int) -> DataFrame:
    """group, split for new groups (group, n): large ones by the largest deficit, the rest by hash."""
    total = (sized.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] or 0) + sum(have.values())
    least = max(total // LARGE, 1)
    need = {s: share * total - have.get(s, 0) for s, share in zip(SPLITS, shares)}
    placed = []
    # at most LARGE groups hold more than 1/LARGE of all records each
    for row in sized.where(F.col("n") > least).orderBy(F.desc("n"), "group").collect():
        best = max(SPLITS, key=lambda s: need[s])
        need[best] -= row["n"]
        placed.append((row["group"], best))
    spark = sized.sparkSession
    large = spark.createDataFrame(placed, f"group {sized.schema['group'].dataType.simpleString()}, split string")
    room = {s: max(v, 0.0) for s, v in need.items()}
    whole = sum(room.values()) or 1.0
    at = F.pmod(F.xxhash64(F.col("group"), F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    first, second = room["train"] / whole, (room["train"] + room["validation"]) / whole
    small = sized.where(F.col("n") <= least).select("group", F.when(at < first, "train").when(at < second, "validation").otherwise("test").alias("split"))
    return small.unionByName(large)


def assign_splits(records: DataFrame, papers: DataFrame, split_info: DataFrame, state: DataFrame | None = None, shares: tuple[float, ...] = SHARES, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(record_id, paper_stem, group_stem, split, conflict) and the new state (paper_stem, root, split, conflict).

    ``state`` is the table of the run before (null: first run); write the second result for the next run.
    Records without a paper are groups of their own.
    """
    owned, labels = paper_components(records, papers, split_info)
    if state is not None:
        # the old components are links too: what once belonged together stays together
        old = state.select(F.col("paper_stem").alias("u"), F.col("root").alias("v")).where("u <> v")
        nodes = labels.select("node").unionByName(state.select(F.col("paper_stem").alias("node")))
        now = labels.select(F.col("node").alias("u"), F.col("root").alias("v")).where("u <> v")
        labels = cut(components(nodes, cut(old.unionByName(now).distinct())))
    else:
        state = labels.select(F.col("node").alias("paper_stem"), "root").limit(0).withColumn("split", F.lit(None).cast("string"))
    kept = labels.join(state.select(F.col("paper_stem").alias("node"), F.col("split").alias("old_split")), "node", "left")
    by_root = cut(kept.groupBy("root").agg(F.min("old_split").alias("lo"), F.max("old_split").alias("hi")))
    with_paper = owned.where("paper_stem IS NOT NULL")
    sizes = with_paper.groupBy(F.col("paper_stem").alias("node")).agg(F.count("*").alias("n"))
    root_sizes = labels.join(sizes, "node", "left").groupBy("root").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    roots = cut(by_root.join(root_sizes, "root"))
    have = {r["lo"]: r["n"] for r in roots.where("lo = hi").groupBy("lo").agg(F.sum("n").alias("n")).collect()}
    loose = owned.where("paper_stem IS NULL").select(F.concat(F.lit("record:"), F.col("record_id").cast("string")).alias("group"), F.lit(1).cast("bigint").alias("n"))
    fresh = roots.where("lo IS NULL").select(F.concat(F.lit("paper:"), F.col("root")).alias("group"), "n").unionByName(loose)
    chosen = cut(_choose(cut(fresh), have, shares, seed))
    named = roots.withColumn("group", F.concat(F.lit("paper:"), F.col("root"))).join(chosen, "group", "left")
    settled = named.select("root", (F.col("lo") != F.col("hi")).alias("conflict"), F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("split")).alias("new_split"))
    papers_of = kept.groupBy("root").agg(F.count("*").alias("k"))
    table = cut(
        attach(kept, cut(settled.join(papers_of, "root")), ["root"], "k", kept.count()).select(
            F.col("node").alias("paper_stem"),
            "root",
            # papers of a conflicting merge keep the split they had
            F.when(F.coalesce("conflict", F.lit(False)), F.col("old_split")).otherwise(F.col("new_split")).alias("split"),
            F.coalesce("conflict", F.lit(False)).alias("conflict"),
        )
    )
    known = cut(table.join(sizes.withColumnRenamed("node", "paper_stem"), "paper_stem"))
    placed = attach(with_paper, known, ["paper_stem"], "n", owned.count()).select("record_id", "paper_stem", F.col("root").alias("group_stem"), "split", "conflict")
    single = chosen.where(F.col("group").startswith("record:")).select(F.substring_index("group", ":", -1).cast(records.schema["record_id"].dataType).alias("record_id"), "split")
    alone = owned.where("paper_stem IS NULL").join(single, "record_id").select("record_id", "paper_stem", F.lit(None).cast("string").alias("group_stem"), "split", F.lit(False).alias("conflict"))
    return placed.unionByName(alone), table
