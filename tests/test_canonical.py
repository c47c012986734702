"""Bucketed tables, the canonical graph merge, its stateful stream, digests and labelled fields."""

import os

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from graphloom.functions import clean as C
from graphloom.operators import canonical as N
from graphloom.operators import joins as J
from graphloom.sources import buckets as B
from graphloom.sources import tables as S
from graphloom.streaming import stateful


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_a_batch_touches_its_buckets_only(spark, tmp_path):
    rows = spark.range(4000).select(F.col("id").cast("string").alias("key"), F.concat(F.lit("n"), "id").alias("name"), F.lit("x").alias("other"))
    table = B.Bucketed(str(tmp_path / "nodes"), rows.schema, ("key",), 256)
    table.write(rows)
    before = files(table.path)
    batch = rows.filter("cast(key as int) < 20").select("key", F.lit("a").alias("name")).unionByName(spark.createDataFrame([("3", "b"), ("new", "c"), ("new", "d")], "key string, name string"))
    touched = B.upsert_nodes_stored(table, batch, F.col("name"))
    assert 0 < len(touched) <= 21
    mine = {f for f in before if any(f"bucket={b}/" in f for b in touched)}
    assert files(table.path) & before == before - mine  # every other file stands as it was
    read = {r[0] for r in table.read(spark, touched).select(F.input_file_name()).distinct().collect()}
    assert read and "PartitionFilters: [isnotnull" in table.read(spark, touched)._jdf.queryExecution().toString() or "PartitionFilters: [bucket" in table.read(spark, touched)._jdf.queryExecution().toString()
    assert all(any(f"bucket={b}/" in f for b in touched) for f in read)
    assert table.read(spark, touched).count() < 4000 * 25 / 256 * 1.5
    got = {r["key"]: (r["name"], r["other"]) for r in table.read(spark).collect()}
    assert len(got) == 4001 == table.read(spark).count() and got["3"] == ("b", "x") and got["new"] == ("d", None) and got["19"] == ("a", "x") and got["20"] == ("n20", "x")
    again = files(table.path)
    assert B.upsert_nodes_stored(table, batch.limit(0)) == [] and files(table.path) == again
    with pytest.raises(Exception, match="blank key"):
        B.upsert_nodes_stored(table, spark.createDataFrame([(" ", "z")], "key string, name string"))


def test_edges_and_new_nodes_in_buckets(spark, tmp_path):
    edge = lambda rows: spark.createDataFrame(rows, "src_id string, dst_id string, note string")
    table = B.Bucketed(str(tmp_path / "edges"), edge([("a", "b", "c")]).schema, ("src_id", "dst_id"), 8)
    for _ in range(2):  # the second time adds nothing
        B.union_edges_stored(table, edge([("hot", str(i), None) for i in range(50)] + [("hot", "1", None), ("hot", "1", "n")]))
    assert table.read(spark).count() == 51
    nodes = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    B.upsert_edges_stored(table, edge([("hot", "1", "p"), ("hot", "1", "q"), ("gone", "1", "r")]), nodes("hot"), nodes("1", "2"), F.col("note"))
    assert {r["note"] for r in table.read(spark).filter("dst_id = '1'").collect()} == {"q"}
    people = B.Bucketed(str(tmp_path / "people"), spark.createDataFrame([("k", "v", 1)], "identity string, name string, n int").schema, ("identity",), 4)
    add = lambda rows: B.insert_new_stored(people, spark.createDataFrame(rows, people.schema), F.col("n"))
    add([("x", "X1", 2), ("x", "X0", 1)])
    add([("x", "late", 0), ("y", "Y", 5)])
    assert {(r["identity"], r["name"]) for r in people.read(spark).collect()} == {("x", "X0"), ("y", "Y")}


def graph(spark, plants, parts, bio, has, measured, reported):
    frame = lambda rows, columns: spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))
    edge = lambda rows: frame(rows, ["src_id", "dst_id", "label"])
    return {
        "plant": frame(plants, ["scientific_name", "source"]), "plant_part": frame(parts, ["plant_part_id"]), "phytochemical": frame([("C1",), ("C2",)], ["inchi_key"]), "therapeutic_use": frame([("D1",)], ["mesh_id"]),
        "target": frame([("T1",), ("T2",)], ["target_chembl_id"]), "document": frame([("DOC1",)], ["document_chembl_id"]),
        "bioactivity": frame(bio, ["bioactivity_id", "standard_type", "standard_relation", "standard_value", "standard_units"]),
        "HAS_PART": edge([(plants[0][0], parts[0][0], "l")]), "CONTAINS": edge([(parts[0][0], "C1", "l")]), "USED_FOR": edge([(parts[0][0], "D1", "l")]),
        "HAS_BIOACTIVITY": edge(has), "MEASURED_ON": edge(measured), "REPORTED_IN": edge(reported),
    }


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_merge_graph(spark, tmp_path):
    store = graph(spark, [("Aloe vera", "s")], [("AL-LE",)], [("BA_000007", "Ki", "=", "900", "nM")], [("C1", "BA_000007", "l")], [("BA_000007", "T1", "l")], [("BA_000007", "DOC1", "l")])
    bio = [("x1", "Ki", "=", "900.0", "nM"), ("x2", "Ki", "", "5", "nM"), ("x3", "Ki", "NA", "5.00", "nM"), ("x4", "Ki", "=", "900", "nM")]
    ends = lambda d: [("x1", d, "l"), ("x2", d, "l"), ("x3", d, "l")]
    incoming = graph(spark, [("ALOE  Vera", "new"), ("Ocimum", "o")], [("al-le",)], bio, [("c1", "x1", "l"), ("C1", "x2", "l"), ("C2", "x3", "l"), ("C2", "x4", "l")], [*ends("t1"), ("x4", "T2", "l")], [*ends("doc1"), (" x4 ", "DOC1", "l")])
    keys = lambda column, *values: spark.createDataFrame([(v,) for v in values], f"{column} string")
    incoming |= {"phytochemical": keys("inchi_key", "c1", "C1", "C2"), "target": keys("target_chembl_id", "t1", "T2"), "document": keys("document_chembl_id", "doc1", "DOC1")}
    incoming["plant"] = incoming["plant"].drop("source").withColumn("extra", F.lit("dropped"))
    merged = N.merge_graph(store, incoming)
    assert rows(merged.tables["plant"]) == [("Aloe vera", "s"), ("Ocimum", "")]
    assert rows(merged.tables["bioactivity"]) == [("BA_000007", "Ki", "=", "900", "nM"), ("BA_000008", "Ki", "", "5", "nM"), ("BA_000009", "Ki", "=", "900", "nM")]
    assert {tuple(r) for r in merged.maps["bioactivity"].collect()} == {("x1", "BA_000007"), ("x2", "BA_000008"), ("x3", "BA_000008"), ("x4", "BA_000009")}
    assert rows(merged.tables["HAS_BIOACTIVITY"]) == [("C1", "BA_000007", "l"), ("C1", "BA_000008", "l"), ("C2", "BA_000008", "l"), ("C2", "BA_000009", "l")]
    assert rows(merged.tables["MEASURED_ON"]) == [("BA_000007", "T1", "l"), ("BA_000008", "T1", "l"), ("BA_000009", "T2", "l")]
    assert rows(merged.tables["HAS_PART"]) == [("Aloe vera", "AL-LE", "l")]
    report = {r["table_name"]: tuple(r)[1:] for r in merged.write(str(tmp_path / "v1")).collect()}
    assert report["bioactivity"] == (1, 4, 2, 3) and report["plant"] == (1, 2, 1, 2) and report["HAS_PART"] == (1, 1, 0, 1)
    assert spark.read.json(str(tmp_path / "v1" / "_report")).count() == 13
    # what is contained already adds nothing, whatever its ids
    after = {name: spark.read.parquet(str(tmp_path / "v1" / name)) for name in merged.marked}
    again = N.merge_graph(after, incoming)
    assert all(rows(again.tables[n]) == rows(after[n]) for n in after)
    whole = N.merge_graph({}, incoming)  # into an empty store: the least raw key of an identity stays
    assert rows(whole.tables["bioactivity"])[0][0] == "BA_000001" and whole.tables["bioactivity"].count() == 3 and rows(whole.tables["phytochemical"]) == [("C1",), ("C2",)]
    part = N.merge_graph(store, {"plant": incoming["plant"]})
    assert part.tables["plant"].count() == 2 and rows(part.tables["MEASURED_ON"]) == rows(store["MEASURED_ON"])


def test_merge_graph_refuses(spark):
    one = lambda **over: graph(spark, **{"plants": [("A", "s")], "parts": [("p",)], "bio": [("x1", "Ki", "=", "1", "nM")], "has": [("C1", "x1", "l")], "measured": [("x1", "T1", "l")], "reported": [("x1", "DOC1", "l")]} | over)
    for over, message in (
        ({"measured": [("x9", "T1", "l")]}, "exactly one target"), ({"measured": [("x1", "T1", "l"), ("x1", "T2", "l")]}, "exactly one target"), ({"reported": [("x1", " ", "l")]}, "exactly one target"),
        ({"plants": [(" ", "s")]}, "without identity"), ({"bio": [("x1", "Ki", "=", "1", "nM"), ("x1", "Ki", "=", "2", "nM")]}, "more than one measurement"), ({"has": [("C9", "x1", "l")]}, "without their nodes"),
    ):
        with pytest.raises(ValueError, match=message):
            N.merge_graph({}, one(**over))
    with pytest.raises(ValueError, match="neither"):
        N.merge_graph({}, {})


SMALL = N.Spec({"part": ("p", N.identifier), "sup": ("s", C.normalized_text), "doc": ("d", N.identifier)}, {"HAS": ("part", "bio"), "ON": ("bio", "sup"), "IN": ("bio", "doc")}, N.Measured("bio", "b", ("t", "r", "v", "u"), "ON", "IN"))


def small(spark, bio, has, on, reported, ends=(("p1", "p2"), ("A b",), ("d1", "d2"))):
    frame = lambda rows, columns: spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns.split()))
    nodes = {name: frame([(i,) for i in ids], c) for (name, c), ids in zip((("part", "p"), ("sup", "s"), ("doc", "d")), ends, strict=True)}
    return nodes | {"bio": frame(bio, "b t r v u"), "HAS": frame(has, "src_id dst_id"), "ON": frame(on, "src_id dst_id"), "IN": frame(reported, "src_id dst_id")}


def test_measurements_may_tell_their_edges(spark):
    store = small(spark, [("BA_999998", "Ki", "=", "1", "nM")], [("p1", "BA_999998")], [("BA_999998", "A b")], [("BA_999998", "d1")])
    told = [("x1", "1.0", "P1", "d1"), ("x2", "2", "p1", "d1"), ("x2", "2.0", "p2", "D1"), ("x3", "2", "p1", "d1"), ("x4", "3", None, "d2"), ("X0", "4", "p2", "d2")]
    bio, ends = [(b, "Ki", "=", v, "nM") for b, v, _, _ in told], (("P1", "p2", "p1"), ("A  B",), ("d1", "D1", "d2"))
    extra = [("p2", "x4"), ("p2", "x3"), ("p1", "x1"), ("p2", "BA_999998")]
    tables = small(spark, bio, [(p, b) for b, _, p, _ in told if p] + extra, [(b, "A  B") for b, *_ in told], [(b, d) for b, _, _, d in told], ends)
    flat = small(spark, [], extra, [], [], ends)
    flat["bio"] = spark.createDataFrame([(b, "Ki", "=", v, "nM", p, "A  B", d) for b, v, p, d in told], "b string, t string, r string, v string, u string, HAS string, ON string, IN string")
    whole, same = N.merge_graph(store, tables, SMALL), N.merge_graph(store, flat, SMALL)
    assert all(rows(whole.marked[n]) == rows(same.marked[n]) for n in whole.marked) and rows(whole.maps["bio"]) == rows(same.maps["bio"])
    assert rows(same.maps["bio"]) == [("X0", "BA_999999"), ("x1", "BA_999998"), ("x2", "BA_1000000"), ("x3", "BA_1000000"), ("x4", "BA_1000001")]  # ids in the order of the raw ones, seven digits where six end
    assert rows(same.tables["HAS"]) == [("p1", "BA_1000000"), ("p1", "BA_999998"), ("p2", "BA_1000000"), ("p2", "BA_1000001"), ("p2", "BA_999998"), ("p2", "BA_999999")]
    assert same.n_incoming["HAS"] == whole.n_incoming["HAS"] == 9 and same.n_incoming["ON"] == 6
    with pytest.raises(ValueError, match="exactly one target and document"):
        N.merge_graph(store, flat | {"IN": spark.createDataFrame([("x1", "d2")], "src_id string, dst_id string")}, SMALL)
    with pytest.raises(ValueError, match="without their nodes"):
        N.merge_graph(store, flat | {"HAS": spark.createDataFrame([("p1", "BA_000001")], "src_id string, dst_id string")}, SMALL)


def test_a_merge_stores_its_measurements_once(spark, tmp_path, monkeypatch):
    n = 3000
    bio = spark.range(n).select(F.format_string("x%05d", "id").alias("b"), F.lit("Ki").alias("t"), F.lit("=").alias("r"), F.col("id").cast("string").alias("v"), F.lit("nM").alias("u"))
    edge = lambda a, b: bio.select(a.alias("src_id"), b.alias("dst_id"))
    batch = small(spark, [], [], [], []) | {"bio": bio, "HAS": edge(F.lit("p1"), F.col("b")), "ON": edge(F.col("b"), F.lit("A b")), "IN": edge(F.col("b"), F.lit("d2"))}
    monkeypatch.setattr(S, "shared_folder", lambda spark: str(tmp_path))
    merged = N.merge_graph({}, batch, SMALL)
    assert merged.tables["bio"].count() == n and all(merged.tables[e].distinct().count() == n for e in ("HAS", "ON", "IN"))
    assert sum(spark.read.parquet(str(p)).count() for p in tmp_path.iterdir()) < 1.1 * n


def test_stateful_merge_survives_a_new_checkpoint(spark, tmp_path):
    src, log = str(tmp_path / "src"), str(tmp_path / "log")
    batch = lambda rows: spark.createDataFrame(rows, "id string, name string, value int").write.mode("append").parquet(src)
    batch([("r2", "Aloe", 1), ("r1", "aloe ", 2), ("r1", "aloe ", 2), ("r3", "Neem", 3)])
    schema = spark.read.parquet(src).schema
    published = spark.createDataFrame([("neem", "n0", "n0")], "identity string, raw_id string, canonical_id string")
    read = lambda: spark.read.parquet(log)

    def run(state, checkpoint):
        pairs = stateful.canonical_stream(spark.readStream.schema(schema).parquet(src), state, "id", C.normalized_text(F.col("name")), ["value"])
        stateful.append_to_log(pairs, log, str(tmp_path / checkpoint)).awaitTermination()

    run(published, "c1")
    told = {("aloe", "r1", "r1", True, 2), ("aloe", "r2", "r1", False, None), ("neem", "r3", "n0", False, None)}
    assert sorted(map(str, map(tuple, read().collect()))) == sorted(map(str, told))
    batch([("r1", "ALOE", 9), ("r4", "aloe", 9), ("r5", "Tulsi", 5)])
    run(published, "c1")  # the same checkpoint: only what is new
    more = told | {("aloe", "r4", "r1", False, None), ("tulsi", "r5", "r5", True, 5)}
    assert sorted(map(str, map(tuple, read().collect()))) == sorted(map(str, more))
    old = files(log)
    run(stateful.id_pairs(published, read()), "c2")  # all rows again under a new checkpoint: nothing is added
    assert sorted(map(str, map(tuple, read().collect()))) == sorted(map(str, more))
    assert old <= files(log)  # and nothing was rewritten
    with pytest.raises(Exception, match="without identity"):
        batch([("r6", " ", 1)])
        run(published, "c1")


class Kept:
    """State of one identity; counts the calls."""

    def __init__(self, kind):
        self.kind, self.held, self.calls = kind, {}, 0

    def __getattr__(self, method):
        held = self.held
        does = {
            "exists": lambda: "v" in held, "get": lambda: held.get("v") if self.kind == "value" else iter(list(held.get("v", []))), "update": lambda v: held.update(v=v), "clear": lambda: held.pop("v", None),
            "getValue": lambda k: held.get(k), "updateValue": held.__setitem__, "containsKey": lambda k: k in held, "appendValue": lambda v: held.setdefault("v", []).append(v), "appendList": lambda v: held.setdefault("v", []).extend(v),
        }[method]

        def call(*args):
            self.calls += 1
            return does(*args)

        return call


def test_an_identity_asks_its_state_seldom():
    def processor(**kw):
        kept, one = {}, stateful._Identity([], **kw)
        state = lambda kind: lambda name, *_: kept.setdefault(name, Kept(kind))
        one.init(type("Handle", (), {"getValueState": staticmethod(state("value")), "getMapState": staticmethod(state("map")), "getListState": staticmethod(state("list"))}))
        ask = lambda raws: [tuple(r) for r in one.handleInputRows(("i",), iter([Row(raw_id=r) for r in raws]), None)]
        return ask, lambda: sum(k.calls for k in kept.values())

    ask, calls = processor()
    assert ask(["b", "a", "b"]) == [("i", "b", "a", False), ("i", "a", "a", True)]
    assert ask([f"c{i}" for i in range(100)] * 2) == [("i", f"c{i}", "a", False) for i in range(100)] and calls() <= 6
    ask, _ = processor(part=3, chunk=5)  # many parts and chunks, each id told once
    ids = [f"r{i:03}" for i in range(200)]
    told = ask(ids[50:120] + ids[60:90])
    assert sorted(told) == [("i", r, "r050", r == "r050") for r in ids[50:120]]
    for more in (ids[:80], ids[100:], ids):
        told += ask(more)
    assert sorted(told) == [("i", r, "r050", r == "r050") for r in ids]


def test_published_ids_are_told_in_parts(spark, tmp_path):
    rows = spark.range(2000).select(F.lit("x").alias("name"), F.format_string("r%04d", "id").alias("id"), F.lit(1).alias("value"))
    rows.write.parquet(str(tmp_path / "src"))
    published = rows.filter("id < 'r1500'").select(F.col("name").alias("identity"), F.col("id").alias("raw_id"), F.when(F.col("id") == "r0007", "b").otherwise("c").alias("canonical_id"))
    pairs = stateful.canonical_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "src")), published, "id", F.col("name"), ["value"])
    stateful.append_to_log(pairs, str(tmp_path / "log"), str(tmp_path / "c")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "log")).collect())) == [("x", f"r{i:04}", "b", False, None) for i in range(1500, 2000)]


def test_digests_see_what_moves(spark):
    frame = lambda rows: spark.createDataFrame(rows, "id int, a string, b string")
    base = [(i, "x", None) for i in range(300)]
    digest = lambda r: S.digest(frame(r), ["id"])
    assert S.changed(digest(base), digest(base[::-1])).count() == 0
    moved = [(7, None, "x") if i == 7 else (i, a, b) for i, a, b in base]
    assert S.changed(digest(moved), digest(base)).count() == 1  # a value between null columns
    for other in (base + [base[3]], base[:-1], [(7, "", None) if i == 7 else (i, a, b) for i, a, b in base], [(7, "x", "null") if i == 7 else (i, a, b) for i, a, b in base]):
        assert S.changed(digest(other), digest(base)).count() == 1
        assert S.digest_root(digest(other)).first()["digest"] != S.digest_root(digest(base)).first()["digest"]
    assert S.digest_root(digest(base[:0])).first()["n_rows"] == 0


def test_labels_and_status(spark):
    one = lambda c, *values: spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values)))).select(c).first()[0]
    labels = ["Habit", "Habitat", "Comments / notes", "Common name"]
    got = one(C.labelled_fields(F.col("c0"), labels), "x Habit: tree HABITAT : dry Comments/notes: none common  name: Neem: tree Cohabit: y")
    assert [tuple(r) for r in got] == [("Habit", "tree"), ("Habitat", "dry"), ("Comments / notes", "none"), ("Common name", "Neem: tree Cohabit: y")]
    assert one(C.labelled_fields(F.col("c0"), labels), None) in (None, []) and one(C.labelled_fields(F.col("c0"), labels), "") == []
    assert one(C.labelled_value(F.col("c0"), "Class", ["Subclass"]), "Subclass: b Class a") == "a" and one(C.labelled_value(F.col("c0"), "Class", []), "none") == ""
    for given, want in (("LC", "Least Concern"), ("re", "Regionally Extinct"), ("NA", "Not Applicable"), ("least  CONCERN", "Least Concern"), ("not assessed", "Not Evaluated"), ("Status (vu) 2020", "Vulnerable"), ("seen (zz)", "ZZ"), ("odd  text", "odd text"), (None, None)):
        assert one(C.status_label(F.col("c0")), given) == want


def test_small_repairs(spark, tmp_path):
    (tmp_path / "s.csv").write_text('Name,Note\n"a","two\nlines, ""quoted"""\nb,c\n')
    assert {r["note"] for r in S.read_sheet(spark, str(tmp_path / "s.csv")).collect()} == {'two\nlines, "quoted"', "c"}
    merged = J.merge_sources(spark.createDataFrame([("k", "b|a"), ("k", "a|c")], "k string, s string"), "k", "s", "|")
    assert merged.first()["s"] == "a|b|c"
    target, source = spark.createDataFrame([(1, "a", "x")], "id int, name string, other string"), spark.createDataFrame([(1, "b"), (1, "c"), (2, "d"), (2, "d")], "id int, name string")
    assert rows(S.upsert_nodes(target, source, "id").na.fill("")) == [(1, "c", "x"), (2, "d", "")]
