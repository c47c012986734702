"""Terms that give a protected entity away: one folding everywhere, and treated everywhere."""

import time
from collections import Counter

import brute
import pyarrow as pa

from graphloom.llm import pii
from graphloom.llm.text import chunks, words

SIDES = [("one", "red"), ("two", "blue"), ("three", "green"), ("four", "grey")]
FILL = [(i, "then left wrote plain words") for i in range(10, 200)]


def spans(spark, rows):
    return {r["doc_id"]: r["spans"].split(",") for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_one_rule_for_terms():
    texts = ["Émilie ÉMILIE émilie Иван иван ΟΔΥΣΣΕΥΣ İzmir Straße (((((((((Ökonom)))))))))) ... . a", "", None, "x Y Ж.,"]
    got = Counter()
    for _, _, data, offs in chunks(pa.array(texts, pa.string())):
        starts, ends, _ = words(data, offs)
        got.update(pii._term_hashes(data, *pii._trimmed(data, starts, ends)).tolist())
    terms = [pii._term(w) for t in texts for w in pii._WORD.findall(t or "")]
    assert got == Counter(pii._term_hash(pii.pd.Series(terms)).to_numpy().view("uint64").tolist())


def test_capitals_outside_a_to_z(spark):
    for name in ("Иван", "Émilie", "(((((((((Ökonom)))))))))"):
        found = spans(spark, [(i, f"{w} wrote {name} {v} a@b.com then {w} left {v}") for i, (w, v) in enumerate(SIDES)] + FILL)
        at = len("one wrote ") + len(name) - len(name.lstrip("("))
        assert f"term:{at}:{at + len(name.strip('()'))}" in found[0]
        assert found[10] == [""]


def test_capital_form_counts_with_the_lower_one(spark):
    common = [(1000 + i, "Ökonom arbeitet hier") for i in range(300)]
    found = spans(spark, [(i, f"{w} wrote ökonom {v} a@b.com then {w} left {v}") for i, (w, v) in enumerate(SIDES)] + FILL + common)
    assert "term:10:16" not in found[0]


def test_glued_terms_are_counted(spark):
    found = spans(spark, [(i, f"{w} wrote {v} Kennung:a@b.com then {w} left {v}") for i, (w, v) in enumerate(SIDES)] + FILL)
    assert "term:14:21" in found[0]
    others = [(500 + i, f"{i} Kennung:user{i}@d{i}.com plain") for i in range(100)]
    found = spans(spark, [(i, f"{w} wrote {v} Kennung:a@b.com then {w} left {v}") for i, (w, v) in enumerate(SIDES)] + FILL + others)
    assert "term:14:21" not in found[0]


def test_terms_are_treated_everywhere(spark):
    far = " ".join(f"w{i}" for i in range(12))
    rows = [(1000 + i, f"a{i} wrote Zorblatt b{i} a@b.com then c{i} left d{i}") for i in range(30)]
    rows[0] = (1000, rows[0][1] + f" {far} é Zorblatt.")
    rows.append((2000, "é (ZORBLATT) spoke"))
    found = spans(spark, rows + FILL)
    at = rows[0][1].rindex("Zorblatt")
    assert {"term:9:17", f"term:{at}:{at + 8}"} <= set(found[1000])
    assert found[2000] == ["term:3:11"] and found[10] == [""]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(spark.createDataFrame(rows + FILL, "doc_id long, text string")).collect()}
    assert not any("zorblatt" in t.lower() for t in clean.values())
    assert clean[10] == FILL[0][1]


def test_terms_inside_mentions_stay_out(spark):
    rows = [(1000 + i, f"a{i} wrote 555-7713 b{i} a@b.com then c{i} left d{i}") for i in range(30)]
    found = spans(spark, [*rows, (2000, "call 555-7713 or +1 (017) 555-7713"), *FILL])
    assert found[2000] == ["phone:17:34", "term:5:13"]


KEY = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"


def test_secrets(spark):
    rows = [(1, f'é token = "{KEY}" here'), (2, f"before password:{KEY[:20]}, after"), (3, "abcdefghijklmnopqrstuvwxyz 12345678901234567890 a1b2c3")]
    found = spans(spark, rows + FILL)
    assert found[1] == ["term:11:51"] and found[2] == ["term:16:36"] and found[3] == [""]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert KEY not in clean[1] and clean[1].startswith('é token = "')


def test_a_run_of_many_places_is_no_secret(spark):
    rows = [(i, f"word{i} {KEY} next{i}") for i in range(300)]
    assert set(map(tuple, spans(spark, rows + FILL).values())) == {("",)}
    copies = [(i, f"word {KEY} next") for i in range(300)]
    assert spans(spark, copies)[5] == ["term:5:45"]


def test_domains_are_entities(spark):
    rows = [(i, f"{w} wrote Zorblatt {v} user{i}@firm.org then {w} left {v}") for i, (w, v) in enumerate(SIDES)]
    assert "term:10:18" in spans(spark, rows + FILL)[0]


def test_parts_with_many_zeros(spark):
    assert spans(spark, [(1, "0" * 5000 + "1.2.3.4")])[1] == ["ip:0:5007"]


def test_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "mail a@b.com", "x", "y", 3, 4, 5)], "doc_id long, text string, base string, terms string, _d int, _doc_id int, _text_hash int")
    assert pii.sanitise(rows).first().asDict() == {"doc_id": 1, "text": "mail [EMAIL]", "base": "x", "terms": "y", "_d": 3, "_doc_id": 4, "_text_hash": 5}


def test_repeated_rows_hide_no_term(spark):
    rows = [(i, f"{w} wrote Zorblatt {v} user@firm.org then {w} left {v}") for i, (w, v) in enumerate(SIDES)]
    for times in (1, 41):
        assert "term:10:18" in spans(spark, rows * times + FILL)[0]


def test_many_mentions_in_one_text_take_linear_time():
    for text in ("\n".join(f"Name{i} Surname{i} user{i}@mail{i % 50}.example.com" for i in range(20_000)), "first " + ",".join(f"u{i}@m{i % 50}.example.com" for i in range(5_000))):
        began = time.perf_counter()
        near = pii._near(text, pii.base_spans(text))
        assert time.perf_counter() - began < 10 and near  # a quadratic walk takes minutes


def test_near_words_equal_the_plain_twin():
    texts = ["a b a@b.com,c@d.org,x e f 1.2.3.4 g", "x,a@b.com,y z " * 4, "one two (a@b.com) three +1 (017) 555-7713x four " * 3, "w" * 90 + ",a@b.com," + "v" * 90 + " end", " ".join(f"w{i}" for i in range(30)) + " a@b.com " + " ".join(f"v{i}" for i in range(30))]
    for text in texts:
        found = pii.base_spans(text)
        mine = [(term, start, end) for _, term, _, start, end, _ in pii._near(text, [s for s in found if s[0] != "email"])]
        plain = [(term, start, end) for _, term, _, start, end in brute.near_words(text, [s for s in found if s[0] != "email"])]
        assert mine == plain
        mail = [(term, start, end) for _, term, _, start, end, _ in pii._near(text, found)]
        assert sorted(set(mail)) == sorted({(term, start, end) for _, term, _, start, end in brute.near_words(text, found)})
