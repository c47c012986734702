"""Resolution against plain comparison of all pairs, and every tier of the cascade."""

import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from graphloom import queries
from graphloom.functions import clean as C
from graphloom.operators import joins as J
from graphloom.operators import resolve as R

ROWS = "term_id string, term string"


@pytest.fixture(scope="module")
def names(spark):
    draw = random.Random(1)
    words = ["".join(draw.choice("abcdeo") for _ in range(draw.randint(3, 9))) for _ in range(60)]
    rows = {" ".join(draw.sample(words, draw.randint(1, 3))) for _ in range(150)} | {"steel", "steelworks", "straw berry", "ab"}
    return sorted(rows)


def frame(spark, names):
    return spark.createDataFrame(list(enumerate(names)), "id long, name string")


def edited(name, draw):
    out = list(name)
    for _ in range(draw.randint(0, 2)):
        i = draw.randrange(len(out))
        out[i : i + 1] = draw.choice([[], [out[i], "x"], ["y"]])
    return "".join(out)


def test_typos_and_containment(spark, names):
    draw = random.Random(2)
    terms = [edited(n, draw) for n in names] + ["teel", "a", "ab", "", "straw"]
    t = spark.createDataFrame([(str(i), x) for i, x in enumerate(terms)], ROWS)
    n = frame(spark, names)
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    close = {(str(i), j) for i, a in enumerate(terms) for j, b in enumerate(names) if min(len(a.strip()), len(b)) >= 5 and abs(len(a.strip()) - len(b)) <= 2 and ratio(a.strip(), b) >= 0.85}
    got = {(r["term_id"], r["id"]) for r in R.typo_candidates(t, n).collect()}
    assert close <= got
    best = {r["term_id"]: r for r in R.resolve_typo(t, n).collect()}
    for i, a in enumerate(terms):
        scores = sorted((ratio(a.strip(), b) for b in names if min(len(a.strip()), len(b)) >= 5 and abs(len(a.strip()) - len(b)) <= 2), reverse=True)
        sure = bool(scores) and scores[0] >= 0.9 and round(scores[0] - (scores[1] if len(scores) > 1 else 0), 9) >= 0.05
        assert (str(i) in best and best[str(i)]["accepted"]) == sure
    inside = {(str(i), j) for i, a in enumerate(terms) for j, b in enumerate(names) if a.strip() and a.strip() in b}
    assert {(r["term_id"], r["id"]) for r in R.resolve_contains(t, n).collect()} == inside


def test_ranking(spark, names):
    draw = random.Random(3)
    terms = [edited(n, draw) for n in names[:60]] + ["steel", "steelworks of the north", "berry", " ".join(names[5].split()[::-1])]
    t, n = spark.createDataFrame([(str(i), x) for i, x in enumerate(terms)], ROWS), frame(spark, names)
    forms = lambda text: [f for w in text.split() for f in ([w, w[:-1]] if w.endswith("s") and not w.endswith("ss") else [w])]

    def score(a, b):
        ratio, x, y = difflib.SequenceMatcher(None, a, b).ratio(), set(forms(a)), set(forms(b))
        mixed = max(0.55 * len(x & y) / len(x) + 0.45 * ratio, 0.8 * ratio)
        shared = len((x - set(R.STOP_WORDS)) & y)
        return max(1.0 if a == b else 0.95 if a in b or b in a else mixed, min(0.94, 0.72 + 0.06 * (shared - 1)) if shared else 0)

    got = {r["term_id"]: r for r in R.rank_entities(t, n).collect()}
    for i, a in enumerate(terms):
        a = " ".join(a.split())
        scores = sorted((score(a, b) for b in names), reverse=True) if a else [0]
        sure = scores[0] >= 0.96 and round(scores[0] - scores[1], 9) > 0.12
        row = got.get(str(i))
        assert (row is not None and row["accepted"]) == sure
        if scores[0] >= 0.84:
            assert row["score"] == pytest.approx(scores[0])
        if row is not None and not sure:
            assert row["id"] == row["options"][0] and len(row["options"]) <= 5
    two = R.score_entities(spark.createDataFrame([("a", "tulsi")], ROWS), spark.createDataFrame([(1, "ocimum", "holy basil, tulsi")], "id long, name string, aliases string"), finite=False).first()
    primary = max(0.8 * difflib.SequenceMatcher(None, "tulsi", "ocimum").ratio(), 0.45 * difflib.SequenceMatcher(None, "tulsi", "ocimum").ratio())
    assert two["score"] == pytest.approx(0.85 * primary + 0.15 * 0.95)
    found = R.lexical_candidates(t, n, k=3)
    assert found.groupBy("term_id").count().filter("count > 3").count() == 0
    assert found.filter("term = 'steel'").orderBy("rank").first()["name"] == "steel"


def test_cascade(spark):
    names = spark.createDataFrame([(1, "Ocimum tenuiflorum", "tulsi, holy basil"), (2, "Hibiscus rosa-sinensis", "shoe flower"), (3, "Azadirachta indica", "neem, margosa"), (4, "Twin", "both"), (5, "twin", "both")], "id long, name string, aliases string")
    terms = spark.createDataFrame([("o", "Tulsi"), ("e", "azadirachta  INDICA"), ("t", "Hibiscus rosas-sinensis"), ("s", "Mangifera odorata"), ("a", "margosa"), ("m", "both"), ("d", "twin"), ("c", "Indian neem"), ("u", "zzz")], ROWS)
    overrides = spark.createDataFrame([("tulsi", "Ocimum tenuiflorum")], "term string, name string")
    got = {r["term_id"]: (r["tier"], r["status"], r["id"]) for r in R.cascade(terms, names, overrides).collect()}
    assert got == {"o": ("override", "resolved", 1), "e": ("exact", "resolved", 3), "t": ("typo", "resolved", 2), "s": ("scientific", "resolved", None), "a": ("alias", "resolved", 3), "m": ("alias", "ambiguous", None), "d": ("exact", "ambiguous", None), "c": ("candidates", "ambiguous", None), "u": (None, "unresolved", None)}
    assert {r["term_id"]: r["tier"] for r in R.cascade(terms, names).collect()}["o"] == "alias"


def test_identifiers(spark):
    known = spark.createDataFrame([("C1", "alpha", "K1"), ("C2", "beta", "K2"), ("C3", "beta", "K3")], "id string, name string, structure_key string")
    rows = spark.createDataFrame([("C1", "x", "K1"), ("C1", "x", "K2"), ("", "Beta", "K3"), (None, "beta", "K9"), ("C9", None, None)], "id string, name string, structure_key string")
    assert [(r["resolved"], r["tier"]) for r in J.match_by_structure(rows, known).orderBy("structure_key", "id").collect()] == [("NA", "none"), ("C1", "by_id"), ("C2", "by_key"), ("C3", "by_key"), ("NA", "none")]
    vocabulary = spark.createDataFrame([("D000001", "Skin Diseases"), ("D000002", "Fever")], "id string, name string")
    said = spark.createDataFrame([("1", "d000001", "?"), ("2", "", "fever MESH:D000001"), ("3", None, "Fever , UMLS:C0015967"), ("4", "", "none")], "k string, id string, text string")
    assert [(r["resolved"], r["tier"]) for r in J.vocabulary_terms(said, "text", vocabulary).orderBy("k").collect()] == [("D000001", "own"), ("D000001", "inside"), ("D000002", "name"), ("NA", "none")]
    taxa = spark.createDataFrame([(1, ["Holy Basil", "tulsi"]), (2, ["tulsi"])], "id long, vernaculars array<string>")
    got = {r["term"]: (r["status"], r["id"]) for r in J.vernacular_match(spark.createDataFrame([("a", "holy-basil"), ("b", "Tulsi"), ("c", "x")], ROWS), taxa).collect()}
    assert got == {"holy-basil": ("resolved", 1), "Tulsi": ("ambiguous", None)}
    status = spark.range(1).select(J.validation_status(F.lit("K"), F.lit("C"), F.lit(""), F.lit(True)).alias("a"), J.validation_status(F.lit("K"), F.lit("C"), F.lit("K")).alias("b")).first()
    assert tuple(status) == ("TEMPORARY_LOOKUP_FAILURE", "VALIDATED_MATCH")


def test_components(spark):
    targets = spark.createDataFrame([("t", [1, 2]), ("u", [1, 9]), ("v", [3])], "target_id string, component_ids array<long>")
    known = spark.createDataFrame([(1, "P1", "human"), (2, "P2", "human"), (3, "P3", None)], "component_id long, accession string, organism string")
    assert [tuple(r) for r in J.components_all(targets, known, F.col("organism") == "human").collect()] == [("t", "P1;P2")]


def test_parts(spark):
    parts = spark.createDataFrame([("Leaves",), (" root  bark ",), ("petiole",), (None,)], "p string")
    assert [r[0] for r in parts.select(C.normalize_part(F.col("p"))).collect()] == ["leaf", "root bark", "", ""]
    assert [r[0] for r in parts.select(C.normalize_part(F.col("p"), unknown="keep")).collect()] == ["leaf", "root bark", "petiole", ""]
    assert [r[0] for r in parts.select(C.part_code(F.col("p"))).collect()] == ["LE", "RB", None, None]
    both = J.parts_of_sources(*[spark.createDataFrame(x, "subject string, part string") for x in ([("b", "leaf"), ("a", "Seeds")], [("b", "Leaves"), ("b", "?")])])
    assert [tuple(r) for r in both.collect()] == [("a", "seed"), ("b", "leaf")]
    assert [r["x"] for r in J.single_subject(spark.createDataFrame([("q",)], "x string"), "x", ["only"]).collect()] == ["only"]
    tree = spark.createDataFrame([("C01.234.5",)], "t string")
    labels = spark.createDataFrame([("C01.234", "Infections")], "tree string, label string")
    assert J.hierarchy_labels(tree, F.col("t"), labels).first()["sub_category_name"] == "Infections"


def test_ids_that_share_a_name_do_not_compete(spark):
    names = spark.createDataFrame([(1, "steel nickel copper"), (2, "Steel nickel copper "), (3, "lead zinc tin")], "id long, name string")
    terms = spark.createDataFrame([("a", "stel nickel copper"), ("b", "lead zink tin"), ("c", "steel nickel copper")], ROWS)
    got = {r["term_id"]: (r["id"], r["accepted"], r["n_ids"]) for r in R.resolve_typo(terms, names).collect()}
    assert got == {"a": (1, True, 2), "b": (3, True, 1), "c": (1, True, 2)}
    told = {r["term_id"]: (r["tier"], r["status"], r["id"]) for r in R.cascade(terms, names).collect()}
    assert told == {"a": ("typo", "ambiguous", None), "b": ("typo", "resolved", 3), "c": ("exact", "ambiguous", None)}


def test_bounds_keep_the_winners(spark, names):
    draw = random.Random(4)
    t = spark.createDataFrame([(str(i), edited(n, draw)) for i, n in enumerate(names)], ROWS)
    close = R.close_texts(t.select(F.lower("term")), frame(spark, names).select("name"), 0.85)
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    for r in close.withColumn("b", R.ratio_bound(F.col("_t"), F.col("_n"))).collect():
        assert r["b"] >= ratio(r["_t"], r["_n"]) - 1e-12
    rows = R.scored_texts(close, 0.9, 0.05).collect()
    assert all(r["score"] == pytest.approx(ratio(r["_t"], r["_n"])) for r in rows) and 0 < len(rows) <= close.count()


def test_lexical_candidates_equal_all_pairs(spark, names):
    n = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(zip(names + names[:9], names[1:] + names[:10], strict=True))], "id long, name string, aliases string")
    terms = [names[3], names[40] + "s", names[7].split()[0] + " zzz", "berry straw", "zz", ""]
    t = spark.createDataFrame([(str(i), x) for i, x in enumerate(terms)], ROWS)
    forms = lambda text: list(dict.fromkeys(f for w in text.split() for f in ([w, w[:-1]] if w.endswith("s") and not w.endswith("ss") else [w])))
    for k in (1, 4, 25):
        want = []
        for i, term in enumerate(terms):
            asked = [w for w in forms(term) if len(w) >= 3]
            scored = []
            for r in n.collect():
                text = " ".join(f"{r['name']} {r['aliases']}".split())
                held = sum(w in text for w in asked)
                if held:
                    score = 0.55 * len(set(asked) & set(text.split())) / len(asked) + 0.30 * held / len(asked) + 0.15 * difflib.SequenceMatcher(None, term, text).ratio()
                    scored.append((-round(score, 9), r["name"], r["id"]))
            want += [(str(i), x[2]) for x in sorted(scored)[:k]]
        assert sorted((r["term_id"], r["id"]) for r in R.lexical_candidates(t, n, k).collect()) == sorted(want)


def plain_cascade(terms, parts):
    """Tier by tier over all pairs; names here are plain words of single spaces."""
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    key = lambda text: re.sub("[^a-z0-9_]+", " ", text.lower()).strip()
    by_name, by_alias = {}, {}
    for i, name, brand in parts:
        by_name.setdefault(name.lower(), set()).add(i)
        for alias in (name, *brand.split(",")):
            by_alias.setdefault(alias.strip().lower(), set()).add(i)
    sole = lambda tier, ids: (tier, "resolved", min(ids)) if len(ids) == 1 else (tier, "ambiguous", None)
    texts = {key(f"{n} {b}") for _, n, b in parts}
    out = {}
    for term, shaped in terms:
        low = term.lower()
        scores = sorted(((ratio(low, n), n) for n in by_name if min(len(n), len(low)) >= 5 and abs(len(n) - len(low)) <= 2), reverse=True)
        if low in by_name:
            out[term] = sole("exact", by_name[low])
        elif scores and scores[0][0] >= 0.9 and round(scores[0][0] - (scores[1][0] if len(scores) > 1 else 0), 9) >= 0.05:
            out[term] = sole("typo", by_name[scores[0][1]])
        elif shaped:
            out[term] = ("scientific", "resolved", None)
        elif low in by_alias:
            out[term] = sole("alias", by_alias[low])
        else:
            words = [f for w in key(term).split() for f in ([w, w[:-1]] if w.endswith("s") and not w.endswith("ss") else [w]) if len(f) >= 3]
            out[term] = ("candidates", "ambiguous", None) if any(w in text for w in words for text in texts) else (None, "unresolved", None)
    return out


def test_cascade_over_the_tables(spark):
    t = queries.Tables(spark, "/root/testdata/sf0.001")
    shaped = [(r["term"], r["s"]) for r in queries.cascade_terms(t).select("term", F.coalesce(C.looks_scientific(F.col("term")), F.lit(False)).alias("s")).collect()]
    parts = [tuple(r) for r in t.part.select("p_partkey", "p_name", "p_brand").collect()]
    got = {r["term"]: (r["tier"], r["status"], r["id"]) for r in queries.QUERIES["resolution_cascade_tiers"](spark, t.folder).collect()}
    assert got == plain_cascade(shaped, parts)
    assert {v[0] for v in got.values()} >= {"exact", "typo", "scientific", "alias", "candidates"}


def test_a_common_token_pairs_with_k_names(spark):
    draw = random.Random(6)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(["hot", *(["warm"] if i % 3 else []), *draw.sample(words, draw.randint(0, 2))])) for i in range(400)]
    n = spark.createDataFrame(rows, "id long, name string")
    terms = ["hot", "hot warm", "w1 hot", "w3 w4 hot", "warm w7", "none", "hot none"]
    t = spark.createDataFrame([(str(i), x) for i, x in enumerate(terms)], ROWS)
    for k in (1, 5, 30):
        want = []
        for i, term in enumerate(terms):
            asked = term.split()
            scored = sorted((-len(set(asked) & set(name.split())) / len(asked), name, j) for j, name in rows if set(asked) & set(name.split()))
            want += [(str(i), j) for _, _, j in scored[:k]]
        assert sorted((r["term_id"], r["id"]) for r in R.overlap_candidates(t, n, k).collect()) == sorted(want)
    every = sum(1 for x in terms for _, name in rows if set(x.split()) & set(name.split()))
    assert R.overlap_pairs(t, n, 5).count() < every / 2
