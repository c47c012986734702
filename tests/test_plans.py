"""What the plans look like, and small cases of facts, layers and lookups."""

import pytest
from pyspark.sql import functions as F

from graphloom import queries
from graphloom.operators import joins as J
from graphloom.plans import evidence as V
from graphloom.plans import paths as P

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def chain(spark):
    return spark.range(12).select(F.lit("n").alias("src_type"), F.col("id").cast("string").alias("src_id"), F.lit("NEXT").alias("rel"), F.lit("n").alias("dst_type"), (F.col("id") + 1).cast("string").alias("dst_id"))


def test_layers_grow_by_one_scan_a_hop(spark, chain):
    root = spark.createDataFrame([("n", "0"), ("n", "0")], "type string, id string")
    sizes = {}
    for depth in (2, 4, 8):
        got = P.bfs_layers(chain, root, depth)
        sizes[depth] = len(plan(got).splitlines())
        assert {r["id"]: r["depth"] for r in got.collect()} == {str(i): min(i, depth + 1) for i in range(13)}
        assert plan(got).count("Relation [") == depth + 2  # the nodes, the root's layer and one for each hop
    assert sizes[8] - sizes[4] == 2 * (sizes[4] - sizes[2])  # linear
    both = chain.select(F.col("src_type").alias("type"), F.col("src_id").alias("id"), F.col("dst_type").alias("t2"), F.col("dst_id").alias("i2"))
    stored = queries.S.stored(both, "t")
    step = P.next_layer(queries.S.stored(root, "t"), stored, queries.S.stored(root, "t"))
    assert plan(step).count("i2#") > 0 and sum("i2#" in line and "Relation [" in line for line in plan(step).splitlines()) == 1
    assert len(P.bfs_layers(chain.limit(0), root, 8).collect()) == 0


def test_type_paths_read_the_edges_once(spark):
    t = queries.Tables(spark, DATA)
    edges = P.edge_table(queries.graph(t))
    got = P.type_paths(edges)
    assert "l_orderkey" not in plan(got)  # the tables' columns don't stand in the recursion's plan
    assert {(r["path"], r["hops"]) for r in got.collect()} >= {("nation>customer>part>line>order", 4), ("line>order", 1)} and got.filter("hops > 4").count() == 0
    loop = spark.createDataFrame([("a", "b"), ("b", "a")], "src_type string, dst_type string")
    assert sorted(r["path"] for r in P.type_paths(loop).collect()) == ["a>b", "b>a"]


def test_summary_scans_the_facts_once(spark):
    rows = spark.createDataFrame([(1, "x", 5), (1, "x", 5), (2, "x", None)], "a_id int, b_id string, v int")
    found = queries.S.stored(P.facts(rows, ["a", "b"], ["v"]), "facts")
    told = P.summary(found, "a")
    assert sum("row_index#" in line or "path#" in line for line in plan(told).splitlines() if "Relation [" in line) == 1
    assert {r["metric"]: r["n"] for r in told.collect()} == {"facts": 3, "nodes": 3, "edges": 2, "nodes:a": 2, "nodes:b": 1, "edges:a>b": 2, "measured:v=5": 1, "measured:v=": 1}
    assert {r["metric"]: r["n"] for r in P.summary(found.limit(0)).collect()} == {"facts": 0, "nodes": 0, "edges": 0}


def test_evidence_facts(spark):
    nodes = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    edge = lambda *rows: spark.createDataFrame(rows, "src_id string, dst_id string")
    bio = spark.createDataFrame([("m1", "5", None), ("m2", None, None)], "id string, value string, unit string")
    graph = P.Graph({"part": nodes("p"), "use": nodes("u"), "bio": bio}, {("part", "use"): ("USED_FOR", edge(("p", "u"))), ("part", "bio"): ("HAS", edge(("p", "m1"), ("p", "m2")))})
    kinds = ["use", "part", "bio"]
    rows = P.path_join(graph, kinds, limit=None)
    got = V.evidence_facts(rows, graph, kinds, {"bio": ["value", "unit"]}).orderBy("row_index").collect()
    assert [[tuple(r) for r in f["path"]["relationships"]] for f in got] == [[("part|p|USED_FOR|use|u", "USED_FOR", "p", "u", False), (f"part|p|HAS|bio|{m}", "HAS", "p", m, True)] for m in ("m1", "m2")]
    assert [f["measurements"] for f in got] == [[{"value": "5"}], []]
    assert [f["provenance"]["node_ids"] for f in got] == [["u", "p", "m1"], ["u", "p", "m2"]] and [f["provenance"]["graph_row_index"] for f in got] == [0, 1]
    assert got[0]["entities"] == {"use": "u", "part": "p", "bio": "m1"}
    assert {(r["rel"], r["n"]) for r in V.relation_counts(V.evidence_facts(rows, graph, kinds)).collect()} == {("USED_FOR", 1), ("HAS", 2)}
    card = V.subject_card(spark.createDataFrame([("p", 2), ("?", 1)], "subject string, n int"), spark.createDataFrame([("p", " "), ("p", "b"), ("p", "a")], "key string, source string"), "key", ["source", "iucn_year"])
    assert sorted(map(tuple, card.collect())) == [("?", 1, False, None, None), ("p", 2, True, "a", None)]


def test_lookups(spark):
    rows = spark.createDataFrame([("k", "d1", "2020"), ("k", " D2 ", "2019"), ("k", "d3", "2024"), ("j", "d3", "x"), ("i", None, "2021")], "k string, doc string, y string")
    known = spark.createDataFrame([("D1",), ("d2",), (None,), (" ",)], "doc string")
    assert [tuple(r) for r in J.latest_known(rows, ["k"], F.col("y"), [F.col("doc")], known, "doc").collect()] == [("k", "d1", "2020")]
    names = spark.createDataFrame([("Acacia  nilotica", 7), ("acacia nilotica", 5), ("babul", 9), (" ", 1), ("void", None)], "name string, id int")
    asked = spark.createDataFrame([("ACACIA nilotica", "babul"), ("none", "Babul "), (None, "x"), (" ", None), ("void", "void")], "accepted string, given string")
    got = [(r["id"], r["found_by"]) for r in J.accepted_or_input(asked, names, "accepted", "given", "name", "id").collect()]
    assert sorted(got, key=str) == sorted([(5, "accepted"), (9, "input"), (None, None), (None, None), (None, None)], key=str)
    edges = spark.createDataFrame([("a", "R", "b"), ("b", "S", "c"), ("c", "R", None)], "src_type string, rel string, dst_type string")
    pick = lambda *a: sorted(r["rel"] + r["src_type"] for r in J.edges_of_types(edges, *a).collect())
    assert pick() == ["Ra", "Rc", "Sb"] and pick(["b"]) == ["Ra", "Sb"] and pick(["b", "c"], ["R"]) == ["Ra", "Rc"] and pick([]) == []


def exchanges_over_scans(df, table):
    """For each scan of a table whose name holds ``table``: how many exchanges stand between it and its join."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-*(0123456789)"))
    out = []
    for i, line in enumerate(lines):
        if "FileScan" in line and table in line:
            at, n = depth(line), 0
            for above in reversed(lines[:i]):
                if depth(above) < at:
                    at = depth(above)
                    if "Join" in above:
                        break
                    n += "Exchange" in above
            out.append(n)
    return out


def test_paths_over_stored_tables_move_no_edges(spark):
    t = queries.Tables(spark, DATA)
    plain, kept = queries.graph(t), {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for ends in (["nation", "supplier"], ["supplier", "nation"]):
            stored = P.stored_graph(plain, 4)
            df = P.path_join(stored, ends, limit=None)
            way = "_edge_" if ends[0] == "nation" else "_back_"
            scans = exchanges_over_scans(df, way)
            assert len(scans) >= 3 and set(scans) == {0}, df._jdf.queryExecution().executedPlan().toString()
            assert sorted(map(tuple, df.select("nation_id", "line_id").collect())) == sorted(map(tuple, P.path_join(plain, ends, limit=None).select("nation_id", "line_id").collect()))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_json_members(spark):
    from graphloom.functions import markup as K

    texts = [(1, '{"b": [{"k": 1.50}, {"x": {"k": [true, "é", {"k": null}]}}], "a": 3, "k": {"z": 1}}'), (2, "no json"), (3, None), (4, "[[[]]]"), (5, '{"k": []}'), (6, '"k"')]
    df = spark.createDataFrame(texts, "key int, text string").withColumn("place", F.lit("x"))
    got = K.json_members(df.drop("place"), "text", ["k"])
    found = {}
    for r in sorted(got.collect(), key=lambda r: (r["key"], r["place"])):
        found.setdefault(r["key"], []).append(r["value"])
    assert found == {1: ["1.5", "true", '"é"', '{"k":null}', "null", '{"z":1}']}
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString() and K.json_members(df.drop("place").limit(0), "text", ["k"]).count() == 0
