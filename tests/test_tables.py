"""Sources, scalar functions, facts, checks and measurement merging on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom.functions import clean as C
from graphloom.operators import measurements as M
from graphloom.plans import evidence as V
from graphloom.plans import paths as P
from graphloom.sources import tables as S


def test_sources(spark, tmp_path):
    (tmp_path / "sheet.csv").write_text(" Plant Name ,Part\nAloe vera,leaf\nAloe vera,\nOcimum,root\n")
    sheet = S.read_sheet(spark, str(tmp_path / "sheet.csv"))
    assert sheet.columns == ["plant name", "part"] and sheet.filter("part = ''").count() == 1
    assert S.find_column(sheet, ["x", "PART"]) == "part" and S.find_column(sheet, ["x"]) is None
    (tmp_path / "names.csv").write_text("id,Plant\n1,Aloe vera\n2,\n3,Aloe vera\n4,Ocimum\n")
    assert [r["name"] for r in S.read_name_list(spark, str(tmp_path / "names.csv")).orderBy("ord").collect()] == ["Aloe vera", "Ocimum"]
    for i, ok in enumerate((True, False)):
        (tmp_path / f"p{i}.json").write_text(json.dumps({"data": {"activities": [{"activity_id": i, "standard_type": "Ki"}]}, "ok": ok}, indent=1))
    got = S.read_payloads(spark, str(tmp_path / "p*.json"), "struct<activity_id: bigint, standard_type: string>", "activities")
    assert [tuple(r) for r in got.collect()] == [(0, "Ki")]
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "a.html").write_text("<p>one\ntwo</p>")
    assert [r["html"] for r in S.read_pages(spark, str(tmp_path / "pages")).collect()] == ["<p>one\ntwo</p>"]
    strings = S.read_strings(spark, str(tmp_path / "names.csv"), ["Plant", "other"])
    assert [tuple(r) for r in strings.orderBy("Plant").collect()][0] == ("", "")
    S.write_tables({"t": sheet}, str(tmp_path / "out"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "t")).count() == 3
    assert S.keep_known(sheet, ["part", "none"]).columns == ["part"] and S.align(sheet, ["z", "part"]).first()["z"] == ""


def test_publish_again(spark, tmp_path):
    store = str(tmp_path / "store")
    for n in (2, 3):
        S.publish(spark, store, {"t": spark.range(n)})
        assert S.current(spark, store)["t"].count() == n
    assert len([p for p in (tmp_path / "store").iterdir() if p.name.startswith("2")]) == 2


def test_publish_beside_another(spark, tmp_path):
    store = str(tmp_path / "store")
    assert S.current(spark, store) == {} and S.current_version(spark, store) is None
    one = S.publish(spark, store, {"t": spark.range(2)})
    two = S.publish(spark, store, {"t": spark.range(5), "u": spark.range(1)}, base=one)
    with pytest.raises(ValueError, match="another version follows"):
        S.publish(spark, store, {"t": spark.range(9)}, base=one)
    assert S.current_version(spark, store) == two and S.current(spark, store)["t"].count() == 5 and S.current(spark, store, one)["t"].count() == 2
    with pytest.raises(ValueError, match="no version"):
        S.current(spark, store, "never")
    three = S.publish(spark, store, {"t": spark.range(4)}, base=two)
    rows = sorted(tuple(r) for r in S.history(spark, store).select("version", "table_name", "n_before", "n_after", "n_added").collect())
    assert rows == [(one, "t", 0, 2, 2), (two, "t", 2, 5, 3), (two, "u", 0, 1, 1), (three, "t", 5, 4, -1)]
    S.publish(spark, str(tmp_path / "empty"), {"none": spark.createDataFrame([], "a string"), "no": spark.range(3).filter("false"), "cut": spark.range(3).limit(0)})
    assert [r["n_after"] for r in S.history(spark, str(tmp_path / "empty")).collect()] == [0, 0, 0]
    assert [p.name for p in (tmp_path / "store" / "_current").iterdir() if p.name.startswith("_draft")] == []


def test_scalars(spark):
    one = lambda c, *values: spark.createDataFrame([values], [f"c{i}" for i in range(len(values))]).select(c).first()[0]
    assert one(C.strip_identifiers(F.col("c0")), "Fever , MESH:D005334 | UMLS:C0015967") == "Fever"
    assert one(C.species_name(F.col("c0")), "Mentha \u00d7 piperita L.") == "Mentha \u00d7 piperita" and one(C.species_name(F.col("c0")), "Acacia nilotica (L.) Delile subsp. indica (Benth.)") == "Acacia nilotica subsp. indica"
    assert one(C.looks_scientific(F.col("c0")), "Curry plant") is False and one(C.looks_scientific(F.col("c0")), "Murraya koenigii") is True
    assert one(C.first_filled(F.col("c0"), F.col("c1"), F.col("c2")), " ", "b", "c") == "b"
    assert one(C.labelled_value(F.col("c0"), "Kingdom", ["Class"]), "Kingdom: Organic\nClass: X") == "Organic"
    assert one(C.shortest_path(F.split("c0", ";")), "C01.2.3;C02.1;C03.9") == "C02.1"
    assert one(C.distinct_ignoring_case(F.split("c0", ";")), "Neem;neem;Margosa") == ["Neem", "Margosa"]
    assert one(C.signature(F.col("c0"), F.col("c1")), "ab", "c") != one(C.signature(F.col("c0"), F.col("c1")), "a", "bc")
    assert one(C.page_text(F.col("c0")), "<style>x</style><p>Aloe <b>vera</b></p><script>1</script>") == "Aloe vera"
    assert one(C.filled_properties(F.from_json("c0", "map<string,string>")), json.dumps({"a": "1", "b": "", "c": None})) == {"a": "1"}


def test_facts_and_checks(spark):
    rows = spark.createDataFrame([(1, "leaf", "fever"), (1, "leaf", "fever"), (2, "Leaf", "cough"), (2, "bark", None)], "plant_id long, part_id string, use_id string").withColumn("value", F.lit(5))
    found = P.facts(rows, ["plant", "part", "use"], ["value"])
    assert sorted(r["row_index"] for r in found.collect()) == [0, 1, 2, 3]
    assert {r["metric"]: r["n"] for r in P.summary(found, "part").collect()}["measured:value=5"] == 3
    explorer = V.part_explorer(found, "part", "use").orderBy("place").collect()
    assert [(r["part"], r["fact_count"], r["n_uses"], r["uses"]) for r in explorer] == [("Leaf", 3, 2, ["cough", "fever"]), ("bark", 1, 0, [])]
    assert sorted(r["row_index"] for r in V.fact_indices(found, "part", "use").filter("key = 'leaf' and use = 'fever'").collect()) == [0, 1]
    twice = P.facts(rows.withColumn("other_id", F.lit("z")), ["part", "part"]).first()
    assert list(twice["entities"]) == ["part"]
    line = found.select(P.fact_line(F.col("path"), F.col("measurements")).alias("l")).first()["l"]
    assert line.endswith('{"value":"5"}') and line.startswith("plant=")
    nodes = spark.createDataFrame([("plant", "1"), ("plant", "2"), ("part", "leaf"), ("part", "bark"), ("part", "Leaf"), ("use", "fever")], "type string, id string")
    bad = {(r["problem"], r["detail"]) for r in P.row_violations(found.filter("row_index < 3"), nodes, 4).collect()}
    assert bad == {("missing reference", "use:cough"), ("row count", "3")}
    plant = spark.createDataFrame([("a",), ("a",), ("",), ("b",)], "name string")
    part = spark.createDataFrame([(f"p{i}",) for i in range(3)], "id string")
    edge = spark.createDataFrame([("a", "p0"), ("b", "p9"), *[(f"x{i}", "p1") for i in range(9)]], "src_id string, dst_id string")
    told = P.store_violations({"plant": (plant, "name"), "part": (part, "id")}, {"has": (edge, "plant", "part")}).groupBy("table_name", "problem").count()
    assert {tuple(r) for r in told.collect()} == {("plant", "repeated key", 1), ("plant", "blank key", 1), ("has", "unknown src_id", 5), ("has", "unknown dst_id", 1)}
    wrong = P.edge_violations(edge.withColumn("Type", F.lit("HAS")), {"Type": "HAS"}, {"dst_id": "p", "src_id": "x"})
    assert {(r["src_id"], r["problem"]) for r in wrong.collect()} == {("a", "src_id"), ("b", "src_id")}


def test_families(spark):
    tables = {k: spark.createDataFrame([(f"{k}1",)], "id string") for k in ("plant", "plant_part", "phytochemical", "therapeutic_use", "bioactivity", "target", "document")}
    edge = lambda s, d: ("R", spark.createDataFrame([(f"{s}1", f"{d}1")], "src_id string, dst_id string"))
    kinds = [("plant", "plant_part"), ("plant_part", "phytochemical"), ("plant_part", "therapeutic_use"), ("phytochemical", "bioactivity"), ("bioactivity", "target"), ("bioactivity", "document")]
    graph = P.Graph(tables, {k: edge(*k) for k in kinds})
    assert len(P.FAMILIES) == 21 and all(P.path_family(graph, name, limit=None).columns for name in P.FAMILIES)
    assert P.path_family(graph, "plant_targets").count() == 1


def test_measurements(spark):
    names = "bioactivity_id string, standard_type string, standard_relation string, standard_value string, standard_units string, tier string"
    bio = spark.createDataFrame([("B1", "Ki", "=", "900", "nM", "HIGH"), ("B2", "Ki", "=", "900.0", "nM", "HIGH"), ("B3", "Ki", "", "900", "nM", "HIGH"), ("B4", "Ki", "NA", "900", "nM", "HIGH")], names)
    ends = lambda kind: spark.createDataFrame([(f"B{i}", kind) for i in range(1, 5)], "src_id string, dst_id string")
    edges = lambda rows: spark.createDataFrame(rows, "src_id string, dst_id string")
    out, log = M.normalize_measurements(bio, edges([("C1", "B1"), ("C2", "B2"), ("C3", "B4")]), ends("T"), ends("D"), ["tier"])
    assert {tuple(r) for r in log.collect()} == {("B2", "B1"), ("B4", "B3")}
    assert {tuple(r) for r in out["has"].collect()} == {("C1", "B1"), ("C2", "B1"), ("C3", "B3")}
    assert sorted(r["bioactivity_id"] for r in out["bio"].collect()) == ["B1", "B3"] and out["measured"].count() == 2
    with pytest.raises(ValueError, match="copies of others"):
        M.normalize_measurements(bio, edges([("C1", "B1"), ("C1", "B2")]), ends("T"), ends("D"), ["tier"])
    other = bio.withColumn("tier", F.when(F.col("bioactivity_id") == "B2", "MEDIUM").otherwise(F.col("tier")))
    with pytest.raises(ValueError, match="disagree"):
        M.normalize_measurements(other, edges([("C1", "B1")]), ends("T"), ends("D"), ["tier"])
    mapped = M.remap_edges(edges([(" a ", "x "), ("b", "y")]), spark.createDataFrame([("a", "A")], "raw_id string, canonical_id string"), spark.createDataFrame([], "raw_id string, canonical_id string"))
    assert {tuple(r) for r in mapped.collect()} == {("A", "x"), ("b", "y")}
