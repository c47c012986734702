"""Plans that keep to their memory whatever a table's size on disk tells."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import measurements as M
from graphloom.operators import resolve as R
from graphloom.plans import paths as P


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def names(spark, tmp_path):
    """Names that are small on disk and many in memory: each stands twice under its id, and three ids share each text."""
    rows = spark.range(600).select((F.col("id") % 300).alias("id"), F.concat(F.lit("Red Ring "), (F.col("id") % 100).cast("string")).alias("name"), F.when(F.col("id") < 300, "Alpha, beta").otherwise("Alpha , gamma").alias("aliases"))
    rows.coalesce(1).write.parquet(str(tmp_path / "names"))
    return spark.read.parquet(str(tmp_path / "names"))


def test_contained_names_are_not_broadcast(spark, names):
    terms = spark.createDataFrame([(1, "ring 7"), (2, " RED RING 99"), (3, "blue"), (1, "ring 7")], "term_id int, term string")
    got = R.resolve_contains(terms, names)
    want = [(1, "ring 7", i, f"Red Ring {i % 100}") for i in range(300) if str(i % 100).startswith("7")] + [(2, " RED RING 99", i, "Red Ring 99") for i in (99, 199, 299)]
    assert "Broadcast" not in plan(got) and sorted(map(tuple, got.collect())) == sorted(want)
    pairs = R.contained_pairs(terms.select(F.col("term_id").alias("id"), F.lower("term").alias("text")), names.select("id", F.lower("name").alias("text")))
    assert "Broadcast" not in plan(pairs) and sorted(map(tuple, pairs.collect())) == sorted((t, i) for t, _, i, _ in want if t == 1)


def test_aliases_are_told_apart_by_id(spark, names):
    terms = spark.createDataFrame([(1, "alpha"), (2, "Gamma "), (3, "red ring 5"), (3, "red ring 5")], "term_id int, term string")
    got = R.resolve_alias(terms, names)
    want = [(t, w, i, f"Red Ring {i % 100}") for t, w in ((1, "alpha"), (2, "Gamma ")) for i in range(300)] + [(3, "red ring 5", i, "Red Ring 5") for i in (5, 105, 205)]
    assert "Broadcast" not in plan(got) and sorted(map(tuple, got.collect())) == sorted(want)
    scan = plan(got).index("hashpartitioning(id#")
    assert plan(got).rindex("HashAggregate", 0, scan) > 0  # ids are dealt before they are grouped


def test_counts_need_no_numbers(spark):
    rows = spark.createDataFrame([(1, "x", 5), (1, "y", None), (2, "x", 5)], "a_id int, b_id string, b_v int")
    found = P.facts(rows, ["a", "b"], ["b_v"], index=False)
    told = P.summary(found, "b", only="measured")
    assert "row_index" not in found.columns and "ranges-" not in plan(told)
    assert {r["metric"]: r["n"] for r in told.collect()} == {"measured:b_v=5": 1, "measured:b_v=": 1}


def test_only_the_joined_tables_are_stored(spark):
    node, edge = spark.createDataFrame([(1,)], "id int"), spark.createDataFrame([(1, 1)], "src_id int, dst_id int")
    g = P.Graph({k: node for k in "abcd"}, {("a", "b"): ("E", edge), ("b", "c"): ("F", edge), ("c", "d"): ("G", edge)})
    s = P.stored_graph(g, 2, ["c", "a"])
    assert {k for k, df in s.nodes.items() if df is not node} == set("abc") and set(s.backward) == {("a", "b"), ("b", "c")}
    assert all(df is edge for _, df in s.edges.values()) and P.path_join(s, ["c", "a"], limit=None).count() == 1


def test_edges_are_dealt_before_they_are_compared(spark):
    edges = spark.range(10).select(F.col("id").cast("string").alias("src_id"), F.lit("x").alias("dst_id"))
    both = plan(M.union_edges(edges, edges))
    assert both.rindex("HashAggregate") < both.index("REPARTITION_BY_NUM")


def test_labels_are_found_once(spark):
    from graphloom.functions import clean as C

    text = spark.createDataFrame([("S Kingdom: a, S Class: b",)], "t string").select(C.classification(F.col("t"), "S").alias("c")).select("c.*")
    assert plan(text).count("split(") <= 3 and tuple(text.first()) == ("a", "", "b", "")


def test_pages_are_taken_apart_where_they_lie(spark):
    from graphloom.functions import markup as K

    page = "<table><tr><th>Part<th>Of</tr><tr><td rowspan=2>a<table><tr><td>in</table></td><td> b&amp;<i>c</i></tr><tr><td>d</tr></table>"
    got = K.html_rows(spark.createDataFrame([(1, page), (1, "<p>")], "id int, html string"), "id", "html", "part", {"part": ["part"], "of": ["of"]})
    assert not any(step in plan(got) for step in ("Exchange", "Window", "Scan parquet"))
    assert sorted(map(tuple, got.collect())) == [(1, 0, 0, "a", "b& c"), (1, 0, 1, "a", "d")]


def test_a_counted_overview_multiplies_no_rows(spark):
    node = spark.createDataFrame([(1,)], "id int")
    edge = lambda *rows: ("E", spark.createDataFrame(list(rows), "src_id int, dst_id int"))
    g = P.Graph({k: node for k in "abcd"}, {("a", "b"): edge((1, 1), (1, 2), (1, 3)), ("b", "c"): edge((1, 7), (2, 7), (3, 7), (3, 8)), ("c", "d"): edge((7, 0), (7, 0), (8, 0))})
    told = [tuple(r) for r in P.overview(g, "a", F.col("id") == 1).collect()]
    counted = [tuple(r) for r in P.overview(g, "a", F.col("id") == 1, counted=True).collect()]
    assert sorted([r[:5] for r in counted for _ in range(r[5])], key=str) == sorted(told, key=str) and len(told) == 1 + 3 + 4 + 7
    assert sorted(r for r in counted if r[0] == "c") == [("c", "7", "E", "d", "0", 3)] * 2 + [("c", "8", "E", "d", "0", 1)]


def test_texts_of_other_lengths_have_no_pieces(spark):
    asked = spark.createDataFrame([("large ringg",), ("Customer#000000001",), ("large bolt",)], "t string")
    got = R.close_texts(asked, spark.createDataFrame([("large ring",), ("hot",)], "n string"), 0.85)
    told = plan(got)
    assert told.index("LeftSemi") > 0 and sorted(map(tuple, got.collect())) == [("large ringg", "large ring")]
