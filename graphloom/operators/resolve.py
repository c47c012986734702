"""Resolution of terms to entities, for whole tables of terms at once.

``terms`` has (term_id, term); ``names`` has (id, name) and may have ``aliases`` as comma-split text. All
candidate searches are equi-joins on keys (whole names, character grams, segments, tokens), never
comparisons of all terms with all names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.clean import alias_key, common_letters, looks_scientific, normalized_text, sequence_ratio, tokens
from graphloom.sources.tables import spread, stored

# Words that don't count as shared between a term and a name.
STOP_WORDS = ["a", "an", "and", "for", "from", "in", "of", "on", "the", "to", "with", "which", "what"]
GRAM = 3


def resolve_exact(terms: DataFrame, names: DataFrame) -> DataFrame:
    """Matches of the whole name, ignoring case and spacing."""
    n = names.select("id", "name", normalized_text(F.col("name")).alias("_k"))
    return terms.withColumn("_k", normalized_text(F.col("term"))).join(n, "_k").select("term_id", "term", "id", "name")


def _grams(c: Column, size: Column | int) -> Column:
    """The distinct runs of ``size`` characters of a text."""
    size = F.lit(size) if isinstance(size, int) else size
    n = F.length(c) - size + 1
    return F.when(n < 1, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(c, i, size))))


def contained_texts(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(_i, _o): the distinct texts of ``inner`` that stand inside distinct texts of ``outer``; both have a column ``text``.

    The join is on the inner text's rarest run of ``GRAM`` characters, or on the whole of a shorter text. Runs are made of each text
    once, however many ids share it. The joins are told to sort: a table's size on disk says little about its rows or runs in a broadcast.
    """
    i = inner.filter("text <> ''").select(F.col("text").alias("_i")).distinct().select("_i", F.explode(_grams(F.col("_i"), F.least(F.lit(GRAM), F.length("_i")))).alias("_g"))
    sizes = F.flatten(F.array(*[_grams(F.col("_o"), n) for n in range(1, GRAM + 1)]))
    o = outer.select(F.col("text").alias("_o")).distinct().select("_o", F.explode(sizes).alias("_g"))
    held = o.groupBy("_g").agg(F.count("*").alias("_n"))
    rarest = i.join(held.hint("merge"), "_g").groupBy("_i").agg(F.min_by("_g", F.struct("_n", "_g")).alias("_g"))
    return o.join(rarest.hint("merge"), "_g").filter(F.contains(F.col("_o"), F.col("_i"))).select("_i", "_o")


def contained_pairs(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(inner_id, outer_id) of (id, text) rows whose text stands inside the other's."""
    i = spread(inner.select(F.col("id").alias("inner_id"), F.col("text").alias("_i")), "inner_id").distinct()
    o = spread(outer.select(F.col("id").alias("outer_id"), F.col("text").alias("_o")), "outer_id").distinct()
    pairs = o.join(i.join(contained_texts(inner, outer).hint("merge"), "_i").hint("merge"), "_o")
    return pairs.select("inner_id", "outer_id").distinct()


def resolve_contains(terms: DataFrame, names: DataFrame) -> DataFrame:
    """Names that are or contain the term, each once (F8)."""
    low = lambda c: F.lower(F.trim(F.col(c)))
    t = terms.select("term_id", "term", low("term").alias("_i")).distinct()
    n = spread(names.select("id", "name", low("name").alias("_o")), "id").distinct()
    texts = contained_texts(t.select(F.col("_i").alias("text")), names.select(low("name").alias("text")))
    return n.join(t.join(texts.hint("merge"), "_i").hint("merge"), "_o").select("term_id", "term", "id", "name")


def resolve_alias(terms: DataFrame, names: DataFrame) -> DataFrame:
    """Matches of the name or of one of its aliases, each once.

    A term has one key, so distinct terms and distinct keys of names make no row twice.
    """
    parts = F.array_union(F.array("name"), F.coalesce(F.split("aliases", ","), F.array().cast("array<string>")))
    keys = F.array_distinct(F.transform(parts, lambda a: F.lower(F.trim(a))))
    n = spread(names, "id").select("id", "name", F.explode(keys).alias("_k")).filter("_k <> ''").distinct()
    t = terms.select("term_id", "term", F.lower(F.trim("term")).alias("_k")).distinct()
    return n.join(t.hint("merge"), "_k").select("term_id", "term", "id", "name")


def best_with_margin(scored: DataFrame, accept: float, margin: float, strict: bool = False) -> DataFrame:
    """The best (term_id, id, name, score) of each term, accepted if it beats the second by the margin."""
    w = Window.partitionBy("term_id").orderBy(F.desc("score"), "name", "id")
    ranked = scored.withColumn("_r", F.row_number().over(w)).withColumn("second", F.coalesce(F.lead("score").over(w), F.lit(0.0))).filter("_r = 1").drop("_r")
    gap = F.round(F.col("score") - F.col("second"), 9)
    return ranked.withColumn("accepted", (F.col("score") >= accept) & (gap > margin if strict else gap >= margin))


def close_texts(asked: DataFrame, known: DataFrame, floor: float) -> DataFrame:
    """(_t, _n) of the distinct texts of two one-column tables that can reach the floor ratio: lengths of 5 or more that differ by 2 at most, and close edit distance.

    A text within ``d`` edits of another keeps one of its ``d + 1`` segments whole, moved by ``d`` places at most, so known
    texts are keyed by their segments and asked ones by the pieces that may equal them. Pairs are tested before they are shuffled again.
    """
    edits = f"cast(floor({1 - floor:.6f} * (2 * _len + 2)) as int)"
    begin = lambda i: f"cast(floor({i} * _len / ({edits} + 1)) as int)"
    n = known.toDF("_n").filter("length(_n) >= 5").distinct().withColumn("_len", F.length("_n"))
    segment = f"struct(i as at, substring(_n, {begin('i')} + 1, {begin('(i + 1)')} - {begin('i')}) as piece)"
    keyed = n.withColumn("_s", F.explode(F.expr(f"transform(sequence(0, {edits}), i -> {segment})"))).select("_n", "_len", "_s.at", "_s.piece")
    t = asked.toDF("_t").filter("length(_t) >= 5").distinct().withColumn("_tl", F.length("_t"))
    t = t.withColumn("_len", F.explode(F.sequence(F.greatest(F.lit(5), F.col("_tl") - 2), F.col("_tl") + 2)))
    t = t.join(F.broadcast(n.select("_len").distinct()), "_len", "left_semi")  # as many rows as there are lengths; others have no piece to meet
    width = f"({begin('(i + 1)')} - {begin('i')})"
    moved = f"filter(transform(sequence(-{edits}, {edits}), m -> struct(i as at, {begin('i')} + 1 + m as first, {width} as width)), x -> x.first >= 1 and x.first + x.width - 1 <= _tl)"
    probes = F.expr(f"array_distinct(flatten(transform(sequence(0, {edits}), i -> transform({moved}, x -> struct(x.at as at, substring(_t, x.first, x.width) as piece)))))")
    pieces = t.withColumn("_s", F.explode(probes)).select("_t", "_tl", "_len", "_s.at", "_s.piece")
    near = F.levenshtein("_t", "_n") <= (1 - floor) * (F.col("_tl") + F.col("_len"))
    return pieces.join(keyed, ["_len", "at", "piece"]).filter(near).select("_t", "_n").distinct()


def _text(c: str) -> Column:
    return F.lower(F.trim(F.col(c)))


def typo_candidates(terms: DataFrame, names: DataFrame, floor: float = 0.85) -> DataFrame:
    """Pairs of terms and names that can reach the floor ratio."""
    close = close_texts(terms.select(_text("term")), names.select(_text("name")), floor)
    n = names.select("id", "name", _text("name").alias("_n"))
    return terms.withColumn("_t", _text("term")).join(close, "_t").join(n, "_n").select("term_id", "term", "_t", "id", "name", "_n")


def ratio_bound(a: Column, b: Column) -> Column:
    """What the sequence ratio of two texts is at most: the letters that they share, each as often as both have it."""
    return 2 * common_letters(a, b) / (F.length(a) + F.length(b))


def scored_texts(close: DataFrame, accept: float, margin: float) -> DataFrame:
    """(_t, _n, score) of the pairs that count for the guard; only those whose bound allows it reach the ratio.

    A pair below ``accept - margin`` neither wins nor takes a win away, and without a pair that can reach ``accept`` a text has no winner.
    """
    bound = close.withColumn("_b", ratio_bound(F.col("_t"), F.col("_n"))).filter(F.col("_b") >= accept - margin)
    hopeful = bound.withColumn("_most", F.max("_b").over(Window.partitionBy("_t"))).filter(F.col("_most") >= accept)
    same = hopeful.filter("_t = _n").select("_t", "_n", F.lit(1.0).alias("score"))
    other = hopeful.filter("_t <> _n").select("_t", "_n", sequence_ratio(F.col("_t"), F.col("_n")).alias("score"))
    return same.unionByName(other)


def resolve_typo(terms: DataFrame, names: DataFrame, accept: float = 0.90, margin: float = 0.05) -> DataFrame:
    """The typo guard: the best sequence ratio wins only with a margin before the next other name.

    Names are compared as texts, so ids that share one do not compete: ``n_ids`` tells how many the winner has, ``id`` is the
    least. Terms without a name that can reach ``accept`` have no row.
    """
    known = names.groupBy(_text("name").alias("_n")).agg(F.min("id").alias("id"), F.min_by("name", F.struct("id", "name")).alias("name"), F.count_distinct("id").alias("n_ids"))
    asked = terms.withColumn("_t", _text("term"))
    scored = scored_texts(close_texts(asked.select("_t"), known.select("_n"), accept - margin), accept, margin)
    best = best_with_margin(scored.select(F.col("_t").alias("term_id"), F.col("_n").alias("id"), F.col("_n").alias("name"), "score"), accept, margin)
    best = best.select(F.col("term_id").alias("_t"), F.col("id").alias("_n"), "score", "second", "accepted")
    return asked.join(best, "_t").join(known, "_n").select("term_id", "term", "id", "name", "score", "second", "accepted", "n_ids")


def token_overlap(a: Column, b: Column) -> Column:
    """Share of the first list's tokens that the second has."""
    return F.when(F.size(a) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def overlap_pairs(terms: DataFrame, names: DataFrame, k: int) -> DataFrame:
    """The pairs of terms and names among which the k of largest token overlap of each term are: term_id, term, _tt, id, name, _nt.

    A name that shares no token but the term's commonest has the least overlap above 0, so k of these in the order of names
    are enough; names that share another token are found by that one. So a token that most names have pairs a term with k of them, not with all.
    """
    n = names.select("id", "name", tokens(F.col("name")).alias("_nt")).withColumn("_w", F.explode("_nt"))
    held = n.groupBy("_w").agg(F.count("*").alias("_df"))
    t = terms.select("term_id", "term", tokens(F.col("term")).alias("_tt")).withColumn("_w", F.explode("_tt")).join(held, "_w")
    t = t.withColumn("_hottest", F.row_number().over(Window.partitionBy("term_id").orderBy(F.desc("_df"), "_w")) == 1).drop("_df")
    first = n.withColumn("_i", F.row_number().over(Window.partitionBy("_w").orderBy(F.lower("name"), "id"))).filter(F.col("_i") <= k).drop("_i")
    both = t.filter("not _hottest").join(n, "_w").unionByName(t.filter("_hottest").join(first, "_w"))
    return both.drop("_w", "_hottest").dropDuplicates(["term_id", "id"])


def overlap_candidates(terms: DataFrame, names: DataFrame, k: int) -> DataFrame:
    """The k names of each term with the largest token overlap above 0."""
    pairs = overlap_pairs(terms, names, k).withColumn("overlap", token_overlap(F.col("_tt"), F.col("_nt")))
    w = Window.partitionBy("term_id").orderBy(F.desc("overlap"), F.lower("name"), "id")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("term_id", "term", "id", "name", "overlap", "rank")


def _meaning(c: Column) -> Column:
    """Tokens without stop words."""
    return F.filter(tokens(c), lambda w: ~w.isin(STOP_WORDS))


def rank_candidates(terms: DataFrame, names: DataFrame) -> DataFrame:
    """(term_id, id, shared, same, inside) of each pair that shares a meaningful token or has one text inside the other's.

    ``shared`` counts the tokens in common, over the name and its aliases the larger; ``same`` and ``inside`` are of the name (J12).
    """
    n = names.select("id", F.col("name").alias("_name"), (F.col("aliases") if "aliases" in names.columns else F.lit(None).cast("string")).alias("_aliases"))
    t = terms.select("term_id", alias_key(F.col("term")).alias("text"), _meaning(F.col("term")).alias("_tt"))
    fields = n.select("id", F.explode(F.array("_name", F.coalesce("_aliases", F.lit("")))).alias("_f"))
    by_token = t.select("term_id", F.explode("_tt").alias("_w")).join(fields.select("id", F.explode(_meaning(F.col("_f"))).alias("_w")).distinct(), "_w").select("term_id", "id").distinct()
    n_text, t_text = n.select("id", alias_key(F.col("_name")).alias("text")), t.select(F.col("term_id").alias("id"), "text")
    within = contained_pairs(t_text, n_text).select(F.col("inner_id").alias("term_id"), F.col("outer_id").alias("id"))
    around = contained_pairs(n_text, t_text).select(F.col("outer_id").alias("term_id"), F.col("inner_id").alias("id"))
    pairs = by_token.unionByName(within).unionByName(around).distinct()
    rows = pairs.join(t, "term_id").join(n, "id")
    own = alias_key(F.col("_name"))
    shared = lambda c: F.size(F.array_intersect("_tt", _meaning(c)))
    inside = F.contains(own, F.col("text")) | F.contains(F.col("text"), own)
    return rows.select("term_id", "id", F.greatest(shared(F.col("_name")), shared(F.coalesce("_aliases", F.lit("")))).alias("shared"), (own == F.col("text")).alias("same"), inside.alias("inside"))


def _field_score(term: Column, field: Column) -> Column:
    """1 for equal texts, 0.95 for one inside the other, else a mix of token overlap and sequence ratio; 0 for a blank field."""
    t, v = alias_key(term), alias_key(F.coalesce(field, F.lit("")))
    ratio, overlap = sequence_ratio(t, v), token_overlap(tokens(term), tokens(F.coalesce(field, F.lit(""))))
    mixed = F.greatest(0.55 * overlap + 0.45 * ratio, 0.80 * ratio)
    return F.when(v == "", 0.0).when(t == v, 1.0).when(F.contains(v, t) | F.contains(t, v), 0.95).otherwise(mixed)


def score_entities(terms: DataFrame, names: DataFrame, finite: bool = True) -> DataFrame:
    """(term_id, term, id, name, score) of all candidates.

    With aliases the score is 0.85 of the name's and 0.15 of the aliases'; without that column it is the
    name's. In a finite domain a pair with shared tokens scores 0.72 at least, 0.06 more for each further one, up to 0.94.
    """
    typos = typo_candidates(terms, names).select("term_id", "id")
    told = rank_candidates(terms, names).select("term_id", "id", "shared")
    pairs = told.unionByName(typos.withColumn("shared", F.lit(0))).groupBy("term_id", "id").agg(F.max("shared").alias("shared"))
    rows = pairs.join(terms.select("term_id", "term"), "term_id").join(names, "id")
    score = _field_score(F.col("term"), F.col("name"))
    if "aliases" in names.columns:
        score = 0.85 * score + 0.15 * _field_score(F.col("term"), F.col("aliases"))
    if finite:
        least = F.when(F.col("shared") > 0, F.least(F.lit(0.94), 0.72 + 0.06 * (F.col("shared") - 1))).otherwise(0.0)
        score = F.greatest(score, least)
    return rows.select("term_id", "term", "id", "name", score.alias("score"))


def rank_entities(terms: DataFrame, names: DataFrame, accept: float = 0.96, margin: float = 0.12, finite: bool = True, k: int = 5) -> DataFrame:
    """The best candidate of each term, accepted by a clear margin; where it isn't, ``options`` has the ids of the k best."""
    scored = score_entities(terms, names, finite)
    w = Window.partitionBy("term_id").orderBy(F.desc("score"), normalized_text(F.col("name")), "id")
    top = scored.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
    options = top.groupBy("term_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "id"))), lambda x: x["id"]).alias("options"))
    best = best_with_margin(scored, accept, margin, strict=True).join(options, "term_id")
    return best.withColumn("options", F.when(~F.col("accepted"), F.col("options")))


def lexical_candidates(terms: DataFrame, names: DataFrame, k: int = 25) -> DataFrame:
    """The k names of each term by 0.55 token overlap, 0.30 tokens found inside and 0.15 sequence ratio, over name and aliases.

    Names in whose text no token of the term is found are left out. Each different text is scored once; ids of one text follow one another.
    """
    aliases = F.coalesce("aliases", F.lit("")) if "aliases" in names.columns else F.lit("")
    named = names.select("id", "name", alias_key(F.concat_ws(" ", "name", aliases)).alias("_text"), F.lower("name").alias("_low"))
    n = named.select("_text", "_low").distinct()
    t = terms.select(alias_key(F.col("term")).alias("_term"), F.filter(tokens(F.col("term")), lambda w: F.length(w) >= 3).alias("_tt")).distinct()
    words = t.select(F.explode("_tt").alias("id")).distinct().withColumn("text", F.col("id"))
    found = contained_pairs(words, n.select(F.col("_text").alias("id"), F.col("_text").alias("text")).distinct())
    pairs = t.select("_term", "_tt", F.explode("_tt").alias("inner_id")).join(found, "inner_id").select("_term", "_tt", F.col("outer_id").alias("_text")).distinct()
    inside = F.size(F.filter("_tt", lambda w: F.contains(F.col("_text"), w))) / F.size("_tt")
    plain = 0.55 * token_overlap(F.col("_tt"), F.split("_text", " ")) + 0.30 * inside
    # the ratio adds 0.15 at most: texts that k others pass without it are out
    bound = 0.15 * F.when(F.length("_term") > 0, ratio_bound(F.col("_term"), F.col("_text"))).otherwise(0.0)
    bounded = pairs.withColumns({"_plain": plain, "_least": plain, "_most": plain + bound})
    kth = Window.partitionBy("_term", "_tt").orderBy(F.desc("_least"))
    bar = bounded.withColumn("_r", F.row_number().over(kth)).filter(F.col("_r") == k).select("_term", "_tt", F.col("_least").alias("_bar"))
    able = bounded.join(bar, ["_term", "_tt"], "left").filter(F.col("_most") + 1e-9 >= F.coalesce("_bar", F.lit(0.0)))
    scored = able.select("_term", "_tt", "_text", (F.col("_plain") + 0.15 * sequence_ratio(F.col("_term"), F.col("_text"))).alias("score")).join(n, "_text")
    w = Window.partitionBy("_term", "_tt").orderBy(F.desc("score"), "_low")
    top = scored.withColumn("_r", F.rank().over(w)).filter(F.col("_r") <= k)
    first = named.withColumn("_i", F.row_number().over(Window.partitionBy("_text", "_low").orderBy("id"))).filter(F.col("_i") <= k).drop("_i")
    asked = terms.select("term_id", "term", alias_key(F.col("term")).alias("_term"), F.filter(tokens(F.col("term")), lambda w: F.length(w) >= 3).alias("_tt"))
    rows = asked.join(top.drop("_r"), ["_term", "_tt"]).join(first, ["_text", "_low"])
    w = Window.partitionBy("term_id").orderBy(F.desc("score"), "_low", "id")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("term_id", "term", "id", "name", "score", "rank")


def cascade(terms: DataFrame, names: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Override, exact name, typo guard, looks scientific, alias, candidates: the first tier that hits decides.

    ``overrides`` has (term, name). A term that looks like a new scientific name is resolved to itself, without an id.
    Several ids of the exact, typo or alias tier make a term ambiguous, as do candidates alone. Each tier is asked only for the terms that
    those before it leave, and stored once; names are compared as texts, with their least id and their number of ids.
    """
    key = lambda c: normalized_text(F.col(c))

    def tier(df: DataFrame, name: str) -> DataFrame:
        return df.select("term_id", F.col("id").alias(f"_{name}"), F.col("name").alias(f"_{name}_name"), F.col("n_ids").alias(f"_{name}_n"))

    def known(rows: DataFrame) -> DataFrame:
        return rows.groupBy("_k").agg(F.min("id").alias("id"), F.min_by("name", F.struct("id", "name")).alias("name"), F.count_distinct("id").alias("n_ids"))

    exact_names = known(names.select("id", "name", key("name").alias("_k")))
    exact = stored(terms.withColumn("_k", key("term")).join(exact_names, "_k").select("term_id", "term", "id", "name", "n_ids"), "exact")
    left = stored(terms.join(exact, "term_id", "left_anti"), "left")
    typo = stored(resolve_typo(left, names).filter("accepted"), "typo")
    left = left.join(typo, "term_id", "left_anti").filter(~F.coalesce(looks_scientific(F.col("term")), F.lit(False)))
    parts = F.array_union(F.array("name"), F.coalesce(F.split("aliases", ","), F.array().cast("array<string>"))) if "aliases" in names.columns else F.array("name")
    alias_names = known(names.select("id", "name", F.explode(parts).alias("_a")).select("id", "name", F.lower(F.trim("_a")).alias("_k")).filter("_k <> ''"))
    alias = stored(left.withColumn("_k", _text("term")).join(alias_names, "_k").select("term_id", "term", "id", "name", "n_ids"), "alias")
    rest = left.join(alias, "term_id", "left_anti")
    some = lexical_candidates(rest, names).groupBy("term_id").agg(F.min("id").alias("id"), F.min_by("name", F.struct("id", "name")).alias("name"), F.count_distinct("id").alias("n_ids"))
    out = terms
    for name, df in (("exact", exact), ("typo", typo), ("alias", alias), ("candidates", some)):
        out = out.join(tier(df, name), "term_id", "left")
    if overrides is not None:
        told = overrides.select(key("term").alias("_k"), F.col("name").alias("_given"))
        given = names.select(key("name").alias("_g"), F.col("id").alias("_override")).groupBy("_g").agg(F.min("_override").alias("_override"))
        told = told.groupBy("_k").agg(F.min("_given").alias("_given")).withColumn("_g", key("_given")).join(given, "_g", "left").drop("_g")
        out = out.withColumn("_k", key("term")).join(told, "_k", "left").drop("_k")
    else:
        out = out.withColumns({"_given": F.lit(None).cast("string"), "_override": F.lit(None).cast(names.schema["id"].dataType)})
    hit = lambda name: F.col(f"_{name}_n") >= 1
    shaped = looks_scientific(F.col("term"))
    pick = lambda *v: F.when(F.col("_given").isNotNull(), v[0]).when(hit("exact"), v[1]).when(hit("typo"), v[2]).when(shaped, v[3]).when(hit("alias"), v[4]).when(hit("candidates"), v[5])
    unique = lambda name: F.when(F.col(f"_{name}_n") == 1, "resolved").otherwise("ambiguous")
    which = pick("override", "exact", "typo", "scientific", "alias", "candidates")
    status = F.coalesce(pick(F.lit("resolved"), unique("exact"), unique("typo"), F.lit("resolved"), unique("alias"), F.lit("ambiguous")), F.lit("unresolved"))
    nothing = F.lit(None)
    sole = lambda name, c: F.when(F.col(f"_{name}_n") == 1, F.col(c))
    chosen = pick(F.col("_override"), sole("exact", "_exact"), sole("typo", "_typo"), nothing, sole("alias", "_alias"), nothing)
    name = pick(F.col("_given"), sole("exact", "_exact_name"), sole("typo", "_typo_name"), F.trim("term"), sole("alias", "_alias_name"), nothing)
    return out.select("term_id", "term", which.alias("tier"), status.alias("status"), chosen.alias("id"), name.alias("name"))


def retype_unique(terms: DataFrame, other: DataFrame) -> DataFrame:
    """Terms that equal exactly one name of another domain, with its id."""
    one = other.groupBy(normalized_text(F.col("name")).alias("_k")).agg(F.count_distinct("id").alias("_n"), F.min("id").alias("other_id")).filter("_n = 1")
    return terms.withColumn("_k", normalized_text(F.col("term"))).join(one, "_k").select("term_id", "term", "other_id")


def missing_keys(requests: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Requested keys that no node has, ignoring case and outer spaces."""
    have = nodes.select(F.lower(F.trim(F.col(key).cast("string"))).alias("_k")).distinct()
    return requests.withColumn("_k", F.lower(F.trim(F.col(key).cast("string")))).join(have, "_k", "left_anti").drop("_k")
