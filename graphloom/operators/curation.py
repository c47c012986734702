"""Selection, scoping, normalising and profiling of records before they become nodes and edges.

Nulls count as blank text throughout; empty tables give empty results, profiles of them one row of zeros.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.clean import alias_key, clean, clean_id, first_filled, normalize_part, normalized_text, part_code, part_id
from graphloom.operators.joins import drop_blank
from graphloom.sources.tables import first_per


def scoped_domain(names: DataFrame, scope: str | None = None, k: int | None = None, order: list[Column] | None = None) -> DataFrame:
    """The candidates (id, name) of each scope with their place by lower-cased name, or by ``order``; the first ``k`` if given.

    Without a scope the whole table is one domain: state ``k`` there, or take the rows as they are.
    """
    keys = order or [F.lower("name"), F.col("id")]
    w = Window.partitionBy(scope) if scope else Window.partitionBy(F.lit(0))
    out = names.withColumn("place", F.row_number().over(w.orderBy(*keys)))
    return out.filter(F.col("place") <= k) if k else out


def _runs(words: Column, n: int) -> Column:
    """All runs of ``n`` neighbouring words, joined by spaces."""
    starts = F.filter(F.sequence(F.lit(0), F.size(words)), lambda i: (i > 0) & (i <= F.size(words) - n + 1))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))


def mentions(df: DataFrame, text: str, terms: dict[str, str]) -> DataFrame:
    """``df`` once for each term of a stated dictionary that its text has as whole words, with the ``term`` and the ``required`` type."""
    words = F.filter(F.split(alias_key(F.col(text)), " "), lambda w: w != "")
    runs = F.array_distinct(F.concat(*[_runs(F.col("_words"), n) for n in sorted({len(t.split()) for t in terms})]))
    table = F.create_map(*[F.lit(x) for kv in terms.items() for x in kv])
    found = df.withColumn("_words", words).withColumn("term", F.explode(F.array_intersect(runs, F.array(*[F.lit(t) for t in terms]))))
    return found.withColumn("required", table[F.col("term")]).drop("_words")


def route_mentions(asked: DataFrame, terms: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Mentions (request_id, mention) that name an entity, and the distinct node types that the generic ones require."""
    table = F.create_map(*[F.lit(x) for kv in terms.items() for x in kv])
    told = asked.withColumn("required", F.try_element_at(table, alias_key(F.col("mention"))))
    return told.filter("required is null").drop("required"), told.filter("required is not null").select("request_id", "required").distinct()


def split_by_part(rows: DataFrame, part: str, audit: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with a part, and the distinct ``audit`` columns of those without one."""
    return drop_blank(rows, [part]), rows.filter(F.coalesce(F.trim(part), F.lit("")) == "").select(*audit).distinct()


def usable_metadata(rows: DataFrame, required: list[str], optional: list[str] | None = None) -> DataFrame:
    """Records whose required fields are filled and hold one value, and none of whose fields is a serialised object (F16)."""
    text = lambda c: clean(F.col(c).cast("string"))
    ok = F.lit(True)
    for c in required:
        ok &= (text(c) != "") & ~text(c).contains(";")
    for c in [*required, *(optional or [])]:
        ok &= ~text(c).startswith("{") & ~text(c).startswith("[")
    return rows.filter(ok)


def normal_edges(rows: DataFrame, src: str, dst: str, labels: dict[str, str], upper: bool = True) -> DataFrame:
    """Distinct (src_id, dst_id, labels...) with cleaned ids, blank ends dropped (F17). ``upper`` makes the sources upper-case."""
    one = clean_id(F.col(src)) if upper else clean(F.col(src))
    edges = rows.select(one.alias("src_id"), clean(F.col(dst)).alias("dst_id"), *[F.lit(v).alias(c) for c, v in labels.items()])
    return drop_blank(edges, ["src_id", "dst_id"]).distinct()


def resolve_scoped(asked: DataFrame, subjects: DataFrame, domain: DataFrame) -> DataFrame:
    """``asked`` (subject, term) resolved within its subject: rows with ``n`` hits, the least ``id`` and a status.

    ``subjects`` has (id, name), ``domain`` (subject_id, id, name). A subject of several ids is ambiguous, a term is looked for only under one.
    """
    s = subjects.groupBy(normalized_text(F.col("name")).alias("_s")).agg(F.count_distinct("id").alias("_ns"), F.min("id").alias("subject_id"))
    d = domain.groupBy("subject_id", normalized_text(F.col("name")).alias("_t")).agg(F.count("*").alias("n"), F.min("id").alias("id"))
    rows = asked.withColumns({"_s": normalized_text(F.col("subject")), "_t": normalized_text(F.col("term"))}).join(s, "_s", "left")
    hit = rows.withColumn("subject_id", F.when(F.col("_ns") == 1, F.col("subject_id"))).join(d, ["subject_id", "_t"], "left")
    many = (F.coalesce("_ns", F.lit(0)) > 1) | (F.coalesce("n", F.lit(0)) > 1)
    status = F.when(many, "ambiguous").when(F.col("n") == 1, "resolved").otherwise("unresolved")
    return hit.select(*asked.columns, F.coalesce("n", F.lit(0)).alias("n"), "id", status.alias("status"))


def request_status(resolved: DataFrame) -> DataFrame:
    """The status of each request from those of its terms (request_id, status), and whether it runs.

    One ambiguous term makes it ambiguous, else one that is not resolved makes it unresolved.
    """
    any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    told = resolved.groupBy("request_id").agg(any_of(F.col("status") == "ambiguous").alias("_a"), any_of(~F.col("status").eqNullSafe(F.lit("resolved"))).alias("_u"))
    status = F.when(F.col("_a"), "ambiguous").when(F.col("_u"), "unresolved").otherwise("resolved")
    return told.select("request_id", status.alias("status"), (status == "resolved").alias("runs"))


def match_parts(left: DataFrame, right: DataFrame, keys: list[str], part: str = "part", aliases: dict[str, str] | None = None) -> DataFrame:
    """Rows of both sides of equal keys and equal canonical part; what has no known part never matches."""
    known = lambda df: drop_blank(df.withColumn("_part", normalize_part(F.col(part), aliases=aliases)).drop(part), ["_part"])
    return known(left).join(known(right), [*keys, "_part"]).withColumnRenamed("_part", part)


def supporting_sources(df: DataFrame, key: str, base: str, hits: DataFrame, order: list[str], sep: str = "; ") -> DataFrame:
    """``df`` with ``source``: the base one and each of ``order`` that has hits for the key in ``hits`` (key, source)."""
    found = hits.groupBy(key).agg(*[F.bool_or(F.coalesce(F.col("source") == s, F.lit(False))).alias(f"_{i}") for i, s in enumerate(order)])
    named = F.array_compact(F.array(F.lit(base), *[F.when(F.col(f"_{i}"), F.lit(s)) for i, s in enumerate(order)]))
    return df.join(found, key, "left").withColumn("source", F.array_join(named, sep)).drop(*[f"_{i}" for i in range(len(order))])


def expand_identifiers(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (src_id, identifier) to every node (identifier, id) of the identifier, distinct."""
    held = drop_blank(nodes, ["identifier"]).select("identifier", F.col("id").alias("dst_id"))
    return drop_blank(edges, ["identifier"]).join(held, "identifier").select("src_id", "dst_id").distinct()


def preferred_names(names: DataFrame, key: str, name: str, order: list[Column], batch: DataFrame, on: str) -> DataFrame:
    """The first filled name of each key among the rows whose ``on`` the batch has."""
    some = drop_blank(names, [key, name]).join(batch.select(on).distinct(), on, "left_semi")
    return first_per(some, [key], order).select(key, F.col(name).alias("name"))


def value_counts(df: DataFrame, value: str, distinct: list[str] | None = None) -> DataFrame:
    """Rows of each value, and the distinct values of other columns in it."""
    return df.groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"), *[F.count_distinct(c).alias(f"n_{c}") for c in distinct or []])


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: all rows as ``n``, and those with a filled value of each column."""
    filled = lambda c: F.count(F.when(F.trim(F.col(c).cast("string")) != "", 1)).alias(c)
    return df.agg(F.count("*").alias("n"), *[filled(c) for c in columns])


def audit_rows(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """(metric, n) rows of the conditions that hold in a table, counted in one pass."""
    names = list(metrics)
    one = df.agg(*[F.count_if(F.coalesce(metrics[m], F.lit(False))).alias(f"m{i}") for i, m in enumerate(names)])
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"m{i}").alias("n")) for i, m in enumerate(names)])
    return one.select(F.inline(pairs))


def merge_sheet(old: DataFrame, new: DataFrame, source: str) -> DataFrame:
    """Old and new (subject, part) rows, one of each by cleaned text ignoring case, old ones first, with the id made anew.

    Rows without a subject or a known part are dropped; ties within a side go by the texts. The rows come in the order of subject and part.
    """
    both = old.select("subject", "part", F.lit(0).alias("_o")).unionByName(new.select("subject", "part", F.lit(1).alias("_o")))
    rows = drop_blank(both.select(clean(F.col("subject")).alias("subject"), normalize_part(F.col("part")).alias("part"), "_o"), ["subject", "part"])
    one = first_per(rows.withColumn("_k", F.lower("subject")), ["_k", "part"], [F.col("_o"), F.col("subject")])
    return one.select(part_id(F.col("subject"), part_code(F.col("part"))).alias("part_id"), "subject", "part", F.lit(source).alias("source")).orderBy(F.lower("subject"), "part")


# The fields that name a node of each type, the first filled one counts, and its key.
DISPLAY = {
    "plant": ["scientific_name", "common_names"],
    "plant_part": ["plant_part", "plant_part_id", "source_name"],
    "phytochemical": ["phytochemical_name", "inchi_key", "chembl_id", "imppat_id"],
    "therapeutic_use": ["therapeutic_use", "mesh_id", "mesh_category_name", "mesh_sub_category_name"],
    "bioactivity": ["bioactivity_id", "standard_type", "standard_relation", "standard_value", "standard_units", "normalized_value_nm", "high_confidence_tier"],
    "target": ["target_name", "target_chembl_id", "uniprot_id", "target_organism", "target_type"],
    "document": ["document_chembl_id", "source_id", "document_journal", "document_year"],
}


def display_name(kind: Column, props: Column, key: Column, fields: dict[str, list[str]] | None = None) -> Column:
    """The first filled display property of a node's type, else its key."""
    out = F.lit(None).cast("string")
    for name, order in (fields or DISPLAY).items():
        out = F.when(kind == name, first_filled(*[F.try_element_at(props, F.lit(f)) for f in order])).otherwise(out)
    return F.coalesce(out, F.trim(key))
