"""Small cases of the functions, stores, facts and streams."""

import difflib

import pytest
from pyspark.sql import functions as F

from graphloom.functions import clean as C
from graphloom.functions import markup as K
from graphloom.operators import joins as J
from graphloom.operators import measurements as M
from graphloom.operators import resolve as R
from graphloom.sources import tables as S
from graphloom.streaming import jobs


def one(spark, values, f):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(f(F.col("v"))).collect()]


def test_scalars(spark):
    assert one(spark, ["900", "900.0", "9e2", "0.50", "1e-25", "n/a", "", "0.0"], C.canonical_number) == ["900", "900", "900", "0.5", "1e-25", "n/a", "", "0"]
    assert one(spark, ["MESH:D002492 , UMLS:C0007681", "d002492", "D12345", None], C.mesh_id) == ["D002492", "D002492", "", ""]
    assert one(spark, [" a  b\n", None], C.clean) == ["a b", ""]
    assert one(spark, ["leaves", "berries", "grass"], lambda c: F.array_join(C.tokens(c), ",")) == ["leaves,leaf", "berries,berry", "grass"]
    assert one(spark, ["LC", "Foo (EN)", "odd"], C.status_label) == ["Least Concern", "Endangered", "odd"]
    assert one(spark, ["Aloe vera", "the plant", "Aloe"], C.looks_scientific) == [True, False, False]
    assert one(spark, ["Acacia leucophloea", "x"], lambda c: C.part_id(c, F.lit("BA"))) == ["AC-LE-BA", "XX-XX-BA"]
    assert one(spark, ["1.50", "abc", "12.0"], C.number_15g) == ["1.5", "ABC", "12"]
    df = spark.createDataFrame([("tide", "diet"), ("diet", "tide")], "a string, b string")
    assert [r[0] for r in df.select(C.sequence_ratio(F.col("a"), F.col("b"))).collect()] == [difflib.SequenceMatcher(None, *p).ratio() for p in (("tide", "diet"), ("diet", "tide"))]


def test_qualify(spark):
    base = ("IC50", "=", "1000", "nM", 6.0, "T1")
    rows = [base, ("IC50", "=", "1000.1", "nM", None, "T1"), ("IC50", "=", "10", "µM", 6.0, "T1"), ("IC50", "=", "10.1", "μM", 6.0, "T1"), ("IC50", ">", "1", "nM", 6.0, "T1"), ("IC50", "=", "1", "mM", 6.0, "T1"), ("IC50", "=", "1", "nM", 5.0, "T1"), ("XX", "=", "1", "nM", 6.0, "T1"), ("Ki", "=", "x", "nM", 6.0, "T1"), ("Ki", "=", "1", "nM", 6.0, "T2")]
    acts = spark.createDataFrame(rows, "standard_type string, standard_relation string, standard_value string, standard_units string, assay_confidence_score double, target_id string")
    targets = spark.createDataFrame([("T1", "Homo sapiens", "SINGLE PROTEIN", "P1"), ("T2", "Mus musculus", "SINGLE PROTEIN", "P2")], "target_id string, target_organism string, target_type string, uniprot_id string")
    got = sorted((r["normalized_value_nm"], r["confidence_tier"]) for r in M.qualify_measurements(acts, targets).collect())
    assert got == [(1000.0, "HIGH"), (1000.1, "MEDIUM"), (10000.0, "MEDIUM")]


def test_typo_guard(spark):
    names = spark.createDataFrame([(1, "ocimum sanctum"), (2, "aloe vera"), (3, "abcdefghij"), (4, "abcdefghik")], "id long, name string")
    terms = spark.createDataFrame([("a", "ocimum sanctm"), ("b", "abcdefghi"), ("c", "aloe")], "term_id string, term string")
    got = {r["term_id"]: r["accepted"] for r in R.resolve_typo(terms, names).collect()}
    assert got == {"a": True, "b": False}


def test_merge_is_idempotent(spark):
    part = spark.createDataFrame([("p1", "Leaf"), ("p2", "Bark")], "id string, name string")
    edge = spark.createDataFrame([("p1", "p2", "x")], "src_id string, dst_id string, note string")
    inc = {"part": spark.createDataFrame([("q1", " leaf"), ("q2", "Root"), ("q3", "root")], "id string, name string"), "edge": spark.createDataFrame([("q1", "q3", "x")], "src_id string, dst_id string, note string")}
    spec = ({"part": ("id", C.normalized_text(F.col("name")))}, {"edge": ("part", "part")})
    out, _ = M.merge_batch({"part": part, "edge": edge}, inc, *spec)
    assert sorted(r["id"] for r in out["part"].collect()) == ["p1", "p2", "q2"]
    assert sorted((r["src_id"], r["dst_id"]) for r in out["edge"].collect()) == [("p1", "p2"), ("p1", "q2")]
    again, report = M.merge_batch(out, inc, *spec)
    assert {r["n_added"] for r in report.collect()} == {0}
    assert again["part"].count() == 3


def test_store(spark, tmp_path):
    df = spark.createDataFrame([("a", ""), ("b", "x")], "id string, v string")
    store = str(tmp_path / "store")
    S.publish(spark, store, {"t": df})
    assert S.current(spark, store)["t"].count() == 2
    with pytest.raises(ValueError, match="not published"):
        S.publish(spark, store, {"t": df}, violations=df)
    assert S.read_strings(spark, str(tmp_path / "none.csv"), ["a", "b"]).count() == 0
    (tmp_path / "names.txt").write_text("1. Aloe vera\n# no\n\n2) Ocimum\nAloe vera\n")
    assert sorted(r["name"] for r in S.read_name_list(spark, str(tmp_path / "names.txt")).collect()) == ["Aloe vera", "Ocimum"]
    with pytest.raises(ValueError, match="missing columns: z"):
        S.require_columns(df, ["id", "z"])
    assert not S.changed(S.digest(df, ["id"]), S.digest(df.orderBy(F.desc("id")), ["id"])).head(1)


def test_inference(spark):
    rows = lambda x: spark.createDataFrame(x, "subject string, item string, part string, refs array<string>")
    got = J.infer_by_shared_reference(rows([("s", "i", "leaf", ["r1"]), ("s", "j", "bark", ["r2"])]), rows([("s", "i", "", ["r1", "r9"]), ("s", "j", "", ["r7"])]))
    assert sorted(map(tuple, got.collect())) == [("s", "bark", "j", "HIGH"), ("s", "leaf", "i", "HIGH")]


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src = str(tmp_path / "src")
    events.repartition(3).write.parquet(src)
    stream = lambda: jobs.stream_of(spark, src, events)
    specs = {"users": ("event_id", F.col("user_id").cast("string")), "kinds": ("id", F.col("id"))}
    split = lambda b: {"users": b.select("event_id", "user_id"), "kinds": b.select(F.col("event_type").alias("id")).distinct(), "did": b.select(F.col("event_id").alias("src_id"), F.col("event_type").alias("dst_id"))}
    slow = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(src)
    query = jobs.merge_stream(slow, str(tmp_path / "store"), str(tmp_path / "c1"), split, specs, {"did": ("users", "kinds")})
    query.awaitTermination()
    last = query.lastProgress["batchId"]
    table = lambda name: S.current(spark, str(tmp_path / "store"))[name]
    assert last >= 1 and table("users").count() == events.select("user_id").distinct().count()
    did = table("did")
    assert did.join(table("users").select(F.col("event_id").cast("string").alias("src_id")), "src_id", "left_anti").count() == 0
    assert table("report").filter("table_name = 'users'").first()["n_after"] == table("users").count()
    before = {name: sorted(map(tuple, table(name).collect())) for name in ("users", "did")}
    jobs.merge_stream(stream(), str(tmp_path / "store"), str(tmp_path / "c1b"), split, specs, {"did": ("users", "kinds")}).awaitTermination()  # a new checkpoint forgets nothing
    assert before == {name: sorted(map(tuple, table(name).collect())) for name in before}
    users = events.select("user_id").distinct().filter("user_id % 2 = 0")
    got = jobs.run_to_parquet(jobs.missing_stream(stream(), users, "user_id"), str(tmp_path / "o1"), str(tmp_path / "c2"))
    assert got.count() == events.filter("user_id % 2 <> 0").count()
    got = jobs.run_to_parquet(jobs.enrich_stream(stream(), users, "user_id", F.col("value") > 0), str(tmp_path / "o2"), str(tmp_path / "c3"))
    assert got.count() == events.filter("user_id % 2 = 0 and value > 0").count()
    got = jobs.run_to_parquet(jobs.dedup_stream(stream(), "ts", ["event_type"], "3650 days"), str(tmp_path / "o3"), str(tmp_path / "c4"))
    assert got.count() == events.select("event_type").distinct().count()


def test_html_rows(spark):
    table = "<TABLE><tr><th>Plant</th><th>Plant part</th></tr><tr><td>A<td><i>leaf</i>&amp;<br>stem</tr><tr><td>B</td></tr></TABLE>"
    pages = [(1, f"<!-- {table} --><script>'{table}'</script><table><tr><td>x</td></tr></table>{table}"), (2, None), (3, ""), (4, "<table><tr><td>no header</td></tr></table>")]
    df = spark.createDataFrame(pages, "id long, html string")
    got = K.html_rows(df, "id", "html", "part", {"part": ["plant part"], "plant": ["plant name", "plant"]}).orderBy("row_no").collect()
    assert [tuple(r) for r in got] == [(1, 1, 0, "leaf & stem", "A"), (1, 1, 1, None, "B")]


def test_html_grids(spark):
    pages = [
        (1, "<table><tr><td>a<table><tr><td>in<td>ner</td></tr></table>b</td><td>c</td></tr><tr><td>d</td></tr></table>"),  # an inner table
        (2, "<table><tr><th rowspan=2>A<th colspan='2'>B</tr><tr><td>c<td>d</tr><tr><td>e</tr></table>"),  # spans
        (3, "</table><TABLE class=x><tr><td>unclosed<tr><td>next"),  # an end without a start, a table without an end
        (4, "<table><td>no row</td></table><tr><td>no table</td></tr>"), (5, None), (6, ""), (7, "<p>no table"),
        (8, "<table><tr><td rowspan=0>z<td>1</tr><tr></tr><tr><td>2<td>3</tr></table>"),  # to the last row, also over one without cells of its own
        (9, "<table><tr><td rowspan=2>x<td>1</tr><tr><td colspan=0>2<td colspan=9999999999>w</tr></table>"), (9, "<table><tr><td>twin</table>"), (9, "<table><tr><td>twin</table>"),
        (10, "<table><tr><td>o<table><tr><td>p<table><tr><td>q</table>r</table>s</table><table><tr><td>t</table>"),  # three deep, then one beside it
        (11, "<table><tr><td>a<td rowspan=2>b<td>c</tr><tr><td>d<td>e</tr></table>"),  # a hanging cell between others
    ]
    got = {}
    for r in K.html_grids(spark.createDataFrame(pages, "id long, html string"), "id", "html").collect():
        got.setdefault(r["id"], []).append((r["table_no"], r["grid"]))
    assert sorted(got.pop(9), key=lambda x: len(x[1])) == [(0, [["twin"]]), (0, [["twin"]]), (0, [["x", "1"], ["x", "2", *["w"] * 1000]])]
    assert {k: sorted(v) for k, v in got.items()} == {
        1: [(0, [["a b", "c"], ["d"]]), (1, [["in", "ner"]])], 2: [(0, [["A", "B", "B"], ["A", "c", "d"], ["e"]])], 3: [(0, [["unclosed"], ["next"]])],
        8: [(0, [["z", "1"], ["z"], ["z", "2", "3"]])], 10: [(0, [["o s"]]), (1, [["p r"]]), (2, [["q"]]), (3, [["t"]])], 11: [(0, [["a", "b", "c"], ["d", "b", "e"]])],
    }
    deep = spark.range(1).select("id", F.concat(F.lit("<table>"), F.repeat(F.lit("<tr><td>cell</td><td>cell</td></tr>"), F.lit(5000))).alias("html"))
    assert K.html_grids(deep, "id", "html").select(F.size("grid")).collect() == [(5000,)]


def test_json_values(spark):
    rows = [('{"@value": " a  b "}', "a b"), ('[{"label": ""}, "x", {"name": ["x", "y"]}, null]', "x; x; y"), ("plain {text}", "plain {text}"), ("{broken", "{broken"), (None, ""), ('"[1, 2]"', "1; 2"), ("7", "7")]
    got = spark.createDataFrame(rows, "t string, want string").select("want", K.json_text(F.col("t")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got), got
    deep = spark.createDataFrame([('{"a": {"k": [1, {"k": "é"}]}, "k": null}',), ("no json",), (None,)], "t string").select(K.json_values(F.col("t"), ["k"]).alias("v")).collect()
    assert [r["v"] for r in deep] == [["1", '{"k": "é"}', '"é"', "null"], [], []]


def test_taxon(spark):
    rows = [("<T><Taxon><TaxId>5</TaxId><ScientificName>A b</ScientificName></Taxon></T>",), ("<T><Taxon>",), (None,), ("<T><Taxon/></T>",)]
    got = [tuple(r) for r in spark.createDataFrame(rows, "x string").select(K.taxon(F.col("x")).alias("r")).select("r.*").collect()]
    assert got == [("5", "A b", "", "OK"), (None, None, None, "ERROR"), (None, None, None, "ERROR"), (None, None, None, "ERROR")]


def test_list_items_keep_digits(spark):
    got = spark.createDataFrame([("a0, 10,11 ,a0",), (None,)], "t string").select(C.split_list(F.col("t")).alias("v")).collect()
    assert [r["v"] for r in got] == [["a0", "10", "11"], []]
