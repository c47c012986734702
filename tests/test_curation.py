"""Selection, scoping and profiling operators on small fixtures with nulls, blanks, ties and empty tables."""

from pyspark.sql import functions as F

from graphloom.functions import clean as C
from graphloom.operators import curation as Q


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_mentions_and_routing(spark):
    terms = {"compounds": "phytochemical", "target protein": "target", "target": "target"}
    df = spark.createDataFrame([(1, "Which compounds hit a TARGET-protein?"), (2, None), (3, ""), (4, "retargeted")], "id int, text string")
    assert rows(Q.mentions(df, "text", terms).select("id", "term", "required")) == [(1, "compounds", "phytochemical"), (1, "target protein", "target"), (1, "target", "target")]
    asked = spark.createDataFrame([(1, "Compounds"), (1, "compounds"), (1, "Aloe vera"), (2, None)], "request_id int, mention string")
    kept, required = Q.route_mentions(asked, terms)
    assert rows(kept) == [(1, "Aloe vera"), (2, None)] and rows(required) == [(1, "phytochemical")]


def test_split_metadata_and_edges(spark):
    df = spark.createDataFrame([("a", "leaf"), ("a", " "), ("a", None), ("b", "")], "subject string, part string")
    with_part, audit = Q.split_by_part(df, "part", ["subject"])
    assert rows(with_part) == [("a", "leaf")] and rows(audit) == [("a",), ("b",)]
    meta = spark.createDataFrame([("C01", "x"), ("C01; C02", "x"), ("{'a'", "x"), ("C01", "['x']"), (None, "x"), ("C02", None)], "category string, name string")
    assert rows(Q.usable_metadata(meta, ["category"], ["name"])) == [("C01", "x"), ("C02", None)]
    edges = spark.createDataFrame([(" a1", "b"), ("A1", "b "), ("a", None), (None, "b")], "s string, d string")
    assert rows(Q.normal_edges(edges, "s", "d", {"type": "HAS"})) == [("A1", "b", "HAS")]
    assert Q.normal_edges(edges.limit(0), "s", "d", {}).count() == 0


def test_scoped_resolution_and_status(spark):
    subjects = spark.createDataFrame([(1, "Aloe"), (2, "Twin"), (3, "twin"), (4, None)], "id int, name string")
    domain = spark.createDataFrame([(1, 10, "leaf"), (1, 11, "root"), (1, 12, "Root"), (2, 20, "leaf")], "subject_id int, id int, name string")
    asked = spark.createDataFrame([("aloe", "LEAF"), ("aloe", "root"), ("aloe", "bark"), ("twin", "leaf"), ("none", "leaf"), (None, None)], "subject string, term string")
    assert rows(Q.resolve_scoped(asked, subjects, domain)) == sorted([("aloe", "LEAF", 1, 10, "resolved"), ("aloe", "root", 2, 11, "ambiguous"), ("aloe", "bark", 0, None, "unresolved"), ("twin", "leaf", 0, None, "ambiguous"), ("none", "leaf", 0, None, "unresolved"), (None, None, 0, None, "unresolved")], key=repr)
    told = spark.createDataFrame([(1, "resolved"), (1, "resolved"), (2, "resolved"), (2, "unresolved"), (3, "unresolved"), (3, "ambiguous"), (4, None)], "request_id int, status string")
    assert rows(Q.request_status(told)) == [(1, "resolved", True), (2, "unresolved", False), (3, "ambiguous", False), (4, "unresolved", False)]
    assert [r["place"] for r in Q.scoped_domain(domain.withColumnRenamed("subject_id", "s"), "s", 2).orderBy("s", "place").collect()] == [1, 2, 1]


def test_parts_sources_and_names(spark):
    left = spark.createDataFrame([("a", "Leaves"), ("a", "moon"), ("a", None), ("b", "roots")], "k string, part string")
    right = spark.createDataFrame([("a", "leaf", 1), ("a", "moon", 2), ("b", "leaf", 3)], "k string, part string, n int")
    assert rows(Q.match_parts(left, right, ["k"]).select("k", "part", "n")) == [("a", "leaf", 1)]
    base = spark.createDataFrame([("a",), ("b",)], "k string")
    hits = spark.createDataFrame([("a", "Y"), ("a", "X"), ("a", "other"), ("b", None)], "k string, source string")
    assert rows(Q.supporting_sources(base, "k", "base", hits, ["X", "Y"])) == [("a", "base; X; Y"), ("b", "base")]
    edges = spark.createDataFrame([("s", "i"), ("s", None), ("s", "z")], "src_id string, identifier string")
    nodes = spark.createDataFrame([("i", 1), ("i", 2), (None, 3)], "identifier string, id int")
    assert rows(Q.expand_identifiers(edges, nodes)) == [("s", 1), ("s", 2)]
    names = spark.createDataFrame([("k", " ", "p", 0), ("k", "first", "p", 1), ("k", "later", "p", 2), ("j", "out", "q", 0)], "key string, name string, subject string, o int")
    assert rows(Q.preferred_names(names, "key", "name", [F.col("o")], spark.createDataFrame([("p",), ("p",)], "subject string"), "subject")) == [("k", "first")]


def test_profiles_and_sheets(spark):
    df = spark.createDataFrame([("a", 1), (" ", 2), (None, None)], "x string, y int")
    assert rows(Q.completeness(df, ["x", "y"])) == [(3, 1, 2)] and rows(Q.completeness(df.limit(0), ["x"])) == [(0, 0)]
    assert rows(Q.value_counts(df, "x", ["y"])) == [(" ", 1, 1), ("a", 1, 1), (None, 1, 0)]
    assert rows(Q.audit_rows(df, {"all": F.lit(True), "big": F.col("y") > 1})) == [("all", 3), ("big", 1)]
    old = spark.createDataFrame([("Aloe vera", "Leaf"), ("", "root")], "subject string, part string")
    new = spark.createDataFrame([("aloe  VERA", "leaves"), ("Ocimum sanctum", "root"), ("Ocimum sanctum", "moon"), (None, "root")], "subject string, part string")
    assert [tuple(r) for r in Q.merge_sheet(old, new, "base").collect()] == [("AL-VE-LE", "Aloe vera", "leaf", "base"), ("OC-SA-RO", "Ocimum sanctum", "root", "base")]


def test_labelled_text(spark):
    text = "Mass ClassyFire Kingdom : Organic , ClassyFire Superclass: Lipids; ClassyFire Class Prenol\n lipids NP Classifier Superclass: other"
    df = spark.createDataFrame([(text,), (None,), ("no labels",)], "t string")
    assert [tuple(r["c"]) for r in df.select(C.classification(F.col("t"), "ClassyFire").alias("c")).collect()] == [("Organic", "Lipids", "Prenol lipids", ""), ("", "", "", ""), ("", "", "", "")]
    html = "<p>Aloe <i>vera</i></p><script>Common name: bad</script> Common name: Burn plant Habit: herb Conservation Status: (LC) Literature: x"
    pages = spark.createDataFrame([(html, "aloe vera"), (html, "ocimum"), (None, "aloe vera"), ("Aloe vera", "Aloe vera"), (html, None)], "h string, s string")
    got = [r["r"] and tuple(r["r"]) for r in pages.select(C.page_record(F.col("h"), F.col("s")).alias("r")).collect()]
    assert got == [("Burn plant", "Least Concern"), None, None, ("", "Not Found"), None]
    shown = spark.createDataFrame([("target", {"target_name": " ", "uniprot_id": "P1"}, "k1"), ("other", {"target_name": "x"}, " k2"), (None, None, "k3")], "kind string, props map<string,string>, key string")
    assert [r[0] for r in shown.select(Q.display_name(F.col("kind"), F.col("props"), F.col("key"))).collect()] == ["P1", "k2", "k3"]
