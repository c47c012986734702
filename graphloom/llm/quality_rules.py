"""Quality rules as a bitmask ledger, in DataFrame operations only.

``measure`` computes every measurement of a text once; ``ledger`` evaluates every rule once and
stores the failures as bits of one long beside the measurements. A policy is a named, versioned set
of rules, so applying one is a bitwise AND, and ``ablations`` counts from the bits alone what each
rule rejects on its own, with the others and without itself.

Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text. A null or empty text has no words: all its
measurements are 0. Repeated rows count each; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, inside one expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window of three words found twice or more in the text."""

    def covered(at: Column) -> Column:
        last = F.size(at)
        return F.aggregate(F.sequence(F.lit(1), last - 1), F.lit(3), lambda n, i: n + F.least(F.lit(3), F.element_at(at, i + 1) - F.element_at(at, i)))

    def repeated(seen: Column) -> Column:
        last = F.size(seen)
        h = lambda i: F.element_at(seen, i)["h"]
        twice = lambda i: ((i > 1) & (h(i) == h(F.greatest(i - 1, F.lit(1))))) | ((i < last) & (h(i) == h(F.least(i + 1, last))))
        at = F.array_sort(F.transform(F.filter(F.sequence(F.lit(1), last), twice), lambda i: F.element_at(seen, i)["p"]))
        return _let(at, lambda a: F.when(F.size(a) == 0, 0).when(F.size(a) == 1, 3).otherwise(covered(a)))

    windows = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.struct(F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)).alias("h"), i.alias("p")))
    return F.when(F.size(words) < 4, 0).otherwise(_let(F.array_sort(windows(words)), repeated))


def measure(docs: DataFrame) -> DataFrame:
    """One row of measurements per document."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select(F.col("doc_id").cast("long"), text.alias("_t"))

    def split(t: Column) -> Column:
        return F.filter(F.split(t, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).alias("n_words"),
            _repeat_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: x.rlike("\\p{L}"))).alias("n_letter_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct((F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"), F.size(lines).alias("n_lines"))

    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    rows = base.select(
        "doc_id",
        _let(split(F.col("_t")), of_words).alias("_w"),
        _let(lines, of_lines).alias("_l"),
        F.char_length(_without(F.col("_t"), SPACES)).cast("long").alias("word_chars"),
        (F.octet_length("_t") - F.octet_length(_without(F.col("_t"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.octet_length("_t") - F.octet_length(_without(F.col("_t"), "!"))).cast("long").alias("n_shouts"),
    )
    long = lambda c: F.col(c).cast("long").alias(c.partition(".")[2])
    return rows.select("doc_id", long("_w.n_words"), "word_chars", "n_symbols", long("_l.n_dup_lines"), long("_w.n_repeat_words"), long("_w.n_letter_words"), long("_l.n_lines"), "n_shouts")


#: name, SQL condition of failure on the measurements. A rule's bit is its place; never reorder, only append.
RULES = [
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("many_words", "n_words > 1000000"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("dup_lines", "10 * n_dup_lines > 5 * n_lines"),
    ("few_letter_words", "100 * n_letter_words < 60 * n_words"),
    ("shouting", "10 * n_shouts > 5 * n_words"),
    ("some_symbols", "10 * n_symbols > n_words"),
]
#: policy -> version -> rules
POLICIES = {
    "base": {1: ["few_words", "repeated_windows"]},
    "web": {
        1: ["few_words", "repeated_windows", "many_words", "short_words", "long_words", "symbols", "dup_lines", "few_letter_words", "shouting"],
        2: ["few_words", "repeated_windows", "many_words", "short_words", "long_words", "some_symbols", "dup_lines", "few_letter_words", "shouting"],
    },
}
_BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}


def mask(policy: str, version: int) -> int:
    """The bits of a policy's rules."""
    return sum(_BIT[r] for r in POLICIES[policy][version])


def ledger(measured: DataFrame) -> DataFrame:
    """The measurements with ``failed_rules``, one bit a rule."""
    bits = " | ".join(f"(CASE WHEN {rule} THEN {_BIT[name]}L ELSE 0L END)" for name, rule in RULES)
    return measured.withColumn("failed_rules", F.expr(bits))


def fails(policy: str, version: int) -> Column:
    """Whether a row of the ledger fails a policy."""
    return F.col("failed_rules").bitwiseAND(F.lit(mask(policy, version))) != 0


def ablations(entries: DataFrame, policy: str, version: int) -> DataFrame:
    """Per rule of a policy: documents it rejects, those only it rejects, and the kept ones without it."""
    own = entries.groupBy(F.col("failed_rules").bitwiseAND(F.lit(mask(policy, version))).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(_BIT[r]).alias("bit")) for r in POLICIES[policy][version]]))
    spread = own.select("bits", "n", rules.alias("r")).select("bits", "n", "r.rule", "r.bit")
    hit, rest = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0
    return spread.groupBy("rule").agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("rejected"), F.sum(F.when(hit & rest, F.col("n")).otherwise(0)).alias("rejected_alone"), F.sum(F.when(rest, F.col("n")).otherwise(0)).alias("kept_without"))


def verdicts(docs: DataFrame, policy: str = "web", version: int = 1) -> DataFrame:
    """The ledger of the documents with the base verdict and the policy's."""
    return ledger(measure(docs)).select("*", fails("base", 1).alias("base_failed"), (~fails("base", 1) & ~fails(policy, version)).alias("kept"))


def oracle_sql() -> str:
    """The verdicts of policy web, version 1, in DuckDB."""
    rules = " + ".join(f"(CASE WHEN {rule} THEN {_BIT[name]} ELSE 0 END)" for name, rule in RULES)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
rw AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS i FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rw.n, 0)::BIGINT AS n_repeat_words,
        len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}')))::BIGINT AS n_letter_words, len(lines)::BIGINT AS n_lines,
        (length(t) - length(replace(t, '!', '')))::BIGINT AS n_shouts
      FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w) w
      LEFT JOIN rw USING (doc_id)),
f AS (SELECT *, ({rules})::BIGINT AS failed_rules FROM m)
SELECT *, (failed_rules & {mask("base", 1)}) <> 0 AS base_failed,
       (failed_rules & {mask("base", 1) | mask("web", 1)}) = 0 AS kept FROM f
"""
