"""Joins that build and check edges."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.clean import alias_key, clean, clean_id, mesh_id, normalize_part, normalized_text, strip_identifiers
from graphloom.sources.tables import first_per, spread


def drop_blank(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose required fields are all filled."""
    ok = F.lit(True)
    for c in columns:
        ok &= F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != ""
    return df.filter(ok)


def lookup_first(df: DataFrame, mapping: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Left join to the mapping's first row of each key."""
    return df.join(first_per(mapping, [key], order), key, "left")


def bridge_edges(left: DataFrame, right: DataFrame, key: str, src: str, dst: str) -> DataFrame:
    """Distinct (src_id, dst_id) of rows that share a filled key."""
    a = drop_blank(left, [key]).select(key, F.col(src).alias("src_id")).distinct()
    b = drop_blank(right, [key]).select(key, F.col(dst).alias("dst_id")).distinct()
    return a.join(b, key).select("src_id", "dst_id").distinct()


def semi_edges(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with both endpoints, and the others with the reason."""
    s, t = (n.select(F.col("id").alias(c), F.lit(True).alias(f"_{c}")).distinct() for n, c in ((sources, "src_id"), (targets, "dst_id")))
    told = edges.join(s, "src_id", "left").join(t, "dst_id", "left")
    reason = F.when(F.col("_src_id").isNull(), "no source").when(F.col("_dst_id").isNull(), "no target")
    told = told.withColumn("reason", reason).drop("_src_id", "_dst_id")
    return told.filter("reason is null").drop("reason"), told.filter("reason is not null")


def composite_edges(rows: DataFrame, mapping: DataFrame, keys: list[str], src: str, dst: str) -> DataFrame:
    """Distinct edges through a mapping on several keys."""
    return drop_blank(rows, keys).join(mapping, keys).select(F.col(src).alias("src_id"), F.col(dst).alias("dst_id")).distinct()


def infer_by_shared_reference(explicit: DataFrame, blank: DataFrame) -> DataFrame:
    """Explicit (subject, part, item, refs) at HIGH, and blank rows promoted to each part that shares a reference, at MEDIUM.

    The overlap is an equi-join on exploded references, so it hashes. Each step's rows are dealt by its keys over all parts of a
    shuffle, so a task holds one part of them.
    """
    shared, own = ["subject", "item", "ref"], ["subject", "part", "item"]
    e = spread(explicit.select("subject", "item", "part", F.explode("refs").alias("ref")), *shared)
    b = spread(blank.select("subject", "item", F.explode("refs").alias("ref")), *shared).distinct()
    found = spread(e.join(b.hint("merge"), shared).select(*own), *own).distinct().withColumn("confidence", F.lit("MEDIUM"))
    high = spread(explicit.select(*own), *own).distinct().withColumn("confidence", F.lit("HIGH"))
    return high.unionByName(found.join(high.hint("merge"), own, "left_anti"))


def latest(df: DataFrame, keys: list[str], year: Column, ties: list[Column]) -> DataFrame:
    """The row of the newest year of each key, missing years last."""
    return first_per(df, keys, [year.try_cast("int").desc_nulls_last(), *ties])


def latest_known(df: DataFrame, keys: list[str], year: Column, ties: list[Column], documents: DataFrame, document: str) -> DataFrame:
    """``latest`` among the rows whose document is one of the known ones; keys without any are left out.

    ``document`` names the id column on both sides; ids are compared trimmed and in upper case.
    """
    known = documents.select(clean_id(F.col(document)).alias("_document")).filter("_document <> ''").distinct()
    return latest(df.withColumn("_document", clean_id(F.col(document))).join(known, "_document", "left_semi").drop("_document"), keys, year, ties)


def accepted_or_input(df: DataFrame, lookup: DataFrame, accepted: str, given: str, key: str, value: str) -> DataFrame:
    """``value`` looked up by the accepted name, by the input name where that has none, and ``found_by``.

    Names are compared collapsed and in lower case; of repeated keys the least value counts. A blank name finds nothing.
    """
    known = lookup.select(normalized_text(F.col(key)).alias("_k"), F.col(value).alias("_v")).filter("_k <> '' and _v is not null").groupBy("_k").agg(F.min("_v").alias("_v"))
    out = df
    for side, name in (("accepted", accepted), ("input", given)):
        one = known.withColumnsRenamed({"_k": f"_{side}_k", "_v": f"_{side}"})
        out = out.withColumn(f"_{side}_k", normalized_text(F.col(name))).join(one, f"_{side}_k", "left").drop(f"_{side}_k")
    by = F.when(F.col("_accepted").isNotNull(), "accepted").when(F.col("_input").isNotNull(), "input")
    return out.withColumn("found_by", by).withColumn(value, F.coalesce("_accepted", "_input")).drop("_accepted", "_input")


def edges_of_types(edges: DataFrame, node_types: list[str] | None = None, rels: list[str] | None = None) -> DataFrame:
    """Edges with an end of one of the node types, and of one of the relation types; None leaves a side open."""
    keep = F.lit(True)
    if node_types is not None:
        keep = F.coalesce(F.col("src_type").isin(node_types), F.lit(False)) | F.coalesce(F.col("dst_type").isin(node_types), F.lit(False))
    if rels is not None:
        keep = keep & F.coalesce(F.col("rel").isin(rels), F.lit(False))
    return edges.filter(keep)


def flagged_or_first(df: DataFrame, keys: list[str], flag: Column, order: Column) -> DataFrame:
    """The flagged row of each key, else its first."""
    return first_per(df, keys, [F.coalesce(flag, F.lit(False)).desc(), order])


def merge_sources(df: DataFrame, key: str, sources: str, sep: str = "; ") -> DataFrame:
    """The sorted union of list-valued text of each key, joined again (A10)."""
    items = df.select(key, F.explode(F.split(sources, re.escape(sep.strip()))).alias("s")).select(key, F.trim("s").alias("s")).filter("s <> ''").distinct()
    return items.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("s")), sep).alias(sources))


def priority_pick(df: DataFrame, key: str, value: str, priority: Column, order: Column) -> DataFrame:
    """The first filled value of each key by priority, then order."""
    return drop_blank(df, [value]).groupBy(key).agg(F.min_by(value, F.struct(priority, order)).alias(value))


def hierarchy(df: DataFrame, path: Column) -> DataFrame:
    """First segment and first two segments of a dotted path as category and sub-category."""
    parts = F.split(path, "\\.")
    return df.withColumn("category", F.element_at(parts, 1)).withColumn("sub_category", F.array_join(F.slice(parts, 1, 2), "."))


def components_all(targets: DataFrame, components: DataFrame, ok: Column) -> DataFrame:
    """Targets all of whose components are known and pass, with their accessions joined in order."""
    judged = components.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    each = targets.select("target_id", F.explode("component_ids").alias("component_id")).distinct().join(judged, "component_id", "left")
    return each.groupBy("target_id").agg(F.bool_and(F.coalesce("_ok", F.lit(False))).alias("all_ok"), F.array_join(F.array_sort(F.collect_set("accession")), ";").alias("accessions")).filter("all_ok").drop("all_ok")


def match_by_structure(df: DataFrame, known: DataFrame) -> DataFrame:
    """``df`` (id, name, structure_key) with the known id that is accepted for it and its tier.

    Tried in order: the row's own id, the structure key, the name; each hit must have the row's structure key.
    """
    k = known.select(F.col("id").alias("_kid"), F.lower(F.trim("name")).alias("_kname"), F.trim("structure_key").alias("_kkey")).filter("_kkey <> ''")
    by = {"id": k.select(F.col("_kid").alias("id"), F.col("_kkey").alias("_key"), "_kid"), "key": k.select(F.col("_kkey").alias("_key"), "_kid"), "name": k.select(F.col("_kname").alias("_name"), F.col("_kkey").alias("_key"), "_kid")}
    rows = df.withColumns({"_key": F.trim("structure_key"), "_name": F.lower(F.trim("name"))})
    return resolve_ids(rows, [("by_id", _least(by["id"], ["id", "_key"]), ["id", "_key"]), ("by_key", _least(by["key"], ["_key"]), ["_key"]), ("by_name", _least(by["name"], ["_name", "_key"]), ["_name", "_key"])], "_accepted").drop("_key", "_name")


def _least(lookup: DataFrame, keys: list[str]) -> DataFrame:
    return lookup.groupBy(*keys).agg(F.min("_kid").alias("_accepted"))


def vocabulary_terms(df: DataFrame, text: str, vocabulary: DataFrame) -> DataFrame:
    """``df`` with the vocabulary id of a text: its own id, an id inside the text, or the stripped name."""
    v = vocabulary.select(F.col("id").alias("_vid"), F.lower(F.trim("name")).alias("_vname"))
    rows = df.withColumns({"_key_own": F.upper(F.trim("id")), "_key_inside": mesh_id(F.col(text)), "_key_name": F.lower(F.trim(strip_identifiers(F.col(text))))})
    ids = v.select(F.upper("_vid").alias("_k"), F.col("_vid").alias("_accepted"))
    names = v.groupBy(F.col("_vname").alias("_key_name")).agg(F.min("_vid").alias("_accepted"))
    tiers = [("own", ids.withColumnRenamed("_k", "_key_own"), ["_key_own"]), ("inside", ids.withColumnRenamed("_k", "_key_inside"), ["_key_inside"]), ("name", names, ["_key_name"])]
    return resolve_ids(rows, tiers, "_accepted").drop("_key_own", "_key_inside", "_key_name")


def vernacular_match(terms: DataFrame, taxa: DataFrame) -> DataFrame:
    """Terms that equal a taxon's vernacular name: resolved to one taxon, or ambiguous (J30). ``taxa`` has (id, vernaculars array)."""
    names = taxa.select("id", F.explode("vernaculars").alias("v")).select("id", alias_key(F.col("v")).alias("_k")).filter("_k <> ''")
    found = terms.withColumn("_k", alias_key(F.col("term"))).join(names, "_k").groupBy("term_id", "term").agg(F.count_distinct("id").alias("_n"), F.min("id").alias("id"))
    return found.select("term_id", "term", F.when(F.col("_n") == 1, "resolved").otherwise("ambiguous").alias("status"), F.when(F.col("_n") == 1, F.col("id")).alias("id"))


def hierarchy_labels(df: DataFrame, tree: Column, labels: DataFrame) -> DataFrame:
    """``hierarchy`` with the label of the sub-category from (tree, label) rows."""
    names = labels.groupBy(F.col("tree").alias("sub_category")).agg(F.min("label").alias("sub_category_name"))
    return hierarchy(df, tree).join(names, "sub_category", "left")


def single_subject(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """The column overwritten by the batch's only subject; unchanged where it has several."""
    return df.withColumn(column, F.lit(names[0])) if len(names) == 1 else df


def parts_of_sources(*sources: DataFrame) -> DataFrame:
    """Distinct (subject, part) of several sources with normalised, known parts, ordered for export."""
    out = None
    for df in sources:
        one = df.select(clean(F.col("subject")).alias("subject"), normalize_part(F.col("part")).alias("part"))
        out = one if out is None else out.unionByName(one)
    return drop_blank(out, ["subject", "part"]).distinct().orderBy("subject", "part")


def resolve_ids(df: DataFrame, tiers: list[tuple[str, DataFrame, list[str]]], value: str = "id") -> DataFrame:
    """``resolved`` and ``tier`` from the first lookup (keys..., value) that has the row; NA when none has."""
    out = df
    for name, lookup, keys in tiers:
        one = lookup.groupBy(*keys).agg(F.min(value).alias(f"_{name}"))
        out = out.join(one, keys, "left")
    names = [n for n, _, _ in tiers]
    tier = F.coalesce(*[F.when(F.col(f"_{n}").isNotNull(), F.lit(n)) for n in names], F.lit("none"))
    return out.withColumn("resolved", F.coalesce(*[F.col(f"_{n}").cast("string") for n in names], F.lit("NA"))).withColumn("tier", tier).drop(*[f"_{n}" for n in names])


def validation_status(local_key: Column, remote_id: Column, remote_key: Column, failed: Column | None = None) -> Column:
    """Status of an id match by its structure key; ``failed`` marks lookups that could not be made."""
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return F.when(empty(local_key), "NO_LOCAL_KEY").when(empty(remote_id), "UNRESOLVED").when(F.coalesce(failed, F.lit(False)) if failed is not None else F.lit(False), "TEMPORARY_LOOKUP_FAILURE").when(empty(remote_key), "INVALID_ID").when(local_key == remote_key, "VALIDATED_MATCH").otherwise("MISMATCH")
