"""A family of many blocks whose members are mostly not linked: no link is lost, and the work grows with the family."""

import random

import brute
import pytest

from graphloom.llm import near_dup


def boilerplate(n, own, seed):
    """Texts that share 150 words beside ``own`` words each, and close copies of some of them."""
    draw = random.Random(seed)
    shared = [f"s{i}" for i in range(150)]
    rows = [(i, " ".join(shared + [f"o{i}x{j}" for j in range(own)])) for i in range(n)]
    for i in range(n, n + n // 4):
        words = rows[draw.randrange(n)][1].split()
        rows.append((i, " ".join(words[:-4] + [f"n{i}x{j}" for j in range(4)])))
    return rows


@pytest.fixture
def visits(monkeypatch):
    """Members that each exact round sends to its groups, and the largest of these groups."""
    rounds, exact = [], near_dup._exact

    def seen(members, *rest):
        counts = members.groupBy("family", "block").count().collect()
        rounds.append((sum(r["count"] for r in counts), max((r["count"] for r in counts), default=0)))
        assert members.groupBy("family", "block", "doc_id").count().filter("count > 1").count() == 0
        return exact(members, *rest)

    monkeypatch.setattr(near_dup, "_exact", seen)
    monkeypatch.setattr(near_dup, "FAMILY_ROWS", 16)
    return rounds


def components(spark, rows):
    found = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80)
    return {r["doc_id"]: r["component_id"] for r in found.collect()}


@pytest.mark.parametrize("own", [24, 30])
def test_no_link_is_lost(spark, visits, own):
    rows = boilerplate(150, own, 3)
    want = brute.components(dict(rows), 2, 80)
    assert components(spark, rows) == want and 100 < len(set(want.values())) < 188
    assert len(visits) > 1 and max(most for _, most in visits) <= 64


def test_visits_grow_with_the_family(spark, visits):
    totals = []
    for n in (150, 300):
        visits.clear()
        rows = boilerplate(n, 30, 5)
        assert len(set(components(spark, rows).values())) == n
        totals.append(sum(total for total, _ in visits[1:]))
    assert 0 < totals[1] <= 2.5 * totals[0]


def test_members_of_common_shingles(spark, visits, monkeypatch):
    """Texts drawn from few passages have no rare shingles: they meet block by block."""
    monkeypatch.setattr(near_dup, "COMMON", 2)
    draw = random.Random(7)
    passages = [" ".join(f"p{i}x{j}" for j in range(12)) for i in range(16)]
    rows = [(i, " ".join(passages[j] for j in sorted(draw.sample(range(16), 13)))) for i in range(120)]
    want = brute.components(dict(rows), 2, 80)
    assert components(spark, rows) == want
    assert max(most for _, most in visits) <= 64


def test_words_that_a_weak_hash_confuses(spark):
    """Thue-Morse words of equal length, which collide under polynomial hashes modulo a power of two."""
    bits = "a"
    for _ in range(11):
        bits += bits.translate(str.maketrans("ab", "ba"))
    other = bits.translate(str.maketrans("ab", "ba"))
    got = components(spark, [(1, bits), (2, other), (3, bits)])
    assert got == {1: 1, 2: 2, 3: 1}
