"""Qualification and merging of measurements, and the canonical store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.clean import canonical_number, signature, to_nanomolar
from graphloom.sources.tables import first_per, numbered, spread, stored

# Accepted measurement types.
TYPES = ["IC50", "Ki", "Kd", "EC50", "Potency"]


def qualify_measurements(acts: DataFrame, targets: DataFrame, types: list[str] | None = None, organism: str = "Homo sapiens", kind: str = "SINGLE PROTEIN", most: float = 10_000, high: float = 1_000, confidence: float = 6) -> DataFrame:
    """Measurements that pass every rule, with the value in nM and a HIGH or MEDIUM tier."""
    value = to_nanomolar(F.col("standard_value").try_cast("double"), F.col("standard_units"))
    rows = acts.filter(F.col("standard_type").isin(types or TYPES)).withColumn("normalized_value_nm", value)
    rows = rows.filter(F.col("normalized_value_nm").isNotNull() & (F.coalesce("standard_relation", F.lit("")) != ">") & (F.col("normalized_value_nm") <= most))
    rows = rows.filter(F.col("assay_confidence_score").isNull() | (F.col("assay_confidence_score") >= confidence))
    good = targets.filter((F.col("target_organism") == organism) & (F.col("target_type") == kind) & (F.coalesce(F.trim("uniprot_id"), F.lit("")) != ""))
    return rows.join(good, "target_id").withColumn("confidence_tier", F.when(F.col("normalized_value_nm") <= high, "HIGH").otherwise("MEDIUM"))


def merge_measurements(rows: DataFrame, identity: list[str], id_col: str, agree: list[str]) -> tuple[DataFrame, DataFrame]:
    """Canonical rows (the lowest id of each identity) with their number of members, and the log of merged ids.

    Members that disagree in an ``agree`` column give a conflict count above 0.
    """
    conflicts = F.lit(0)
    for c in agree:
        conflicts = conflicts + (F.count_distinct(F.col(c)) > 1).cast("int")
    groups = rows.groupBy(*identity).agg(F.min(id_col).alias("canonical_id"), F.count("*").alias("members"), conflicts.alias("conflicts"))
    log = rows.join(groups.filter("members > 1"), identity).filter(f"{id_col} <> canonical_id").select(F.col(id_col).alias("merged_id"), "canonical_id")
    return groups, log


def not_exactly_one(edges: DataFrame) -> DataFrame:
    """Sources that don't have exactly one target."""
    return edges.groupBy("src_id").agg(F.count_distinct("dst_id").alias("n")).filter("n <> 1")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that are blank or occur more than once."""
    return df.groupBy(key).agg(F.count("*").alias("n")).filter((F.col("n") > 1) | F.col(key).isNull() | (F.trim(F.col(key).cast("string")) == ""))


def new_nodes(current: DataFrame, incoming: DataFrame, identity: str, order: Column) -> DataFrame:
    """Incoming nodes of unseen identity, the first of each."""
    return first_per(incoming, [identity], [order]).join(current.select(identity), identity, "left_anti")


def id_map(current: DataFrame, incoming: DataFrame, added: DataFrame, identity: str, key: str) -> DataFrame:
    """(raw_id, canonical_id) of every incoming node."""
    canonical = current.select(identity, F.col(key).alias("canonical_id")).unionByName(added.select(identity, F.col(key).alias("canonical_id")))
    canonical = canonical.groupBy(identity).agg(F.min("canonical_id").alias("canonical_id"))
    return incoming.select(F.col(key).alias("raw_id"), identity).join(canonical, identity).select("raw_id", "canonical_id").distinct()


def remap_edges(edges: DataFrame, src_map: DataFrame, dst_map: DataFrame) -> DataFrame:
    """Edges with both ends mapped to canonical ids, unmapped ends trimmed as they are."""
    s = src_map.select(F.trim("raw_id").alias("_sk"), F.col("canonical_id").alias("_s")).distinct()
    d = dst_map.select(F.trim("raw_id").alias("_dk"), F.col("canonical_id").alias("_d")).distinct()
    rows = spread(edges.withColumns({"_sk": F.trim("src_id"), "_dk": F.trim("dst_id")}), "_sk")
    out = spread(rows.join(s, "_sk", "left"), "_dk").join(d, "_dk", "left")
    keep = [c for c in edges.columns if c not in ("src_id", "dst_id")]
    return out.select(F.coalesce("_s", "_sk").alias("src_id"), F.coalesce("_d", "_dk").alias("dst_id"), *keep)


def union_edges(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Full-row set union."""
    both = current.unionByName(incoming)
    return spread(both, *both.columns).distinct()


def last_number(id_col: str) -> Column:
    """The highest number that ids end with, 0 where there is none."""
    return F.coalesce(F.max(F.regexp_extract(id_col, "([0-9]+)$", 1).cast("long")), F.lit(0))


def id_text(prefix: str, number: Column) -> Column:
    """An id of a number, six digits or more: ids go on past 999,999 with seven."""
    text = number.cast("string")
    return F.concat(F.lit(prefix), F.lpad(text, F.greatest(F.length(text), F.lit(6)), "0"))


def new_ids(current: DataFrame, added: DataFrame, id_col: str, prefix: str, order: list[Column]) -> DataFrame:
    """Added rows with ids in the given order that go on after the store's highest number, six digits or more."""
    rows = numbered(added, order, "_k").crossJoin(F.broadcast(current.agg(last_number(id_col).alias("_start"))))  # one row
    return rows.withColumn(id_col, id_text(prefix, F.col("_start") + F.col("_k") + 1)).drop("_k", "_start")


def normalize_measurements(bio: DataFrame, has: DataFrame, measured: DataFrame, reported: DataFrame, agree: list[str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The four tables with one measurement per identity, and the log of merged ids.

    The identity is type, relation, canonical number, units, target and document; the lowest id stays. Members that
    differ in an ``agree`` column are an error, as is a mapping under which two different edges of ``has`` would
    become one: nothing is dropped silently.
    """
    ends = bio.join(measured.select(F.col("src_id").alias("bioactivity_id"), F.col("dst_id").alias("_target")), "bioactivity_id").join(reported.select(F.col("src_id").alias("bioactivity_id"), F.col("dst_id").alias("_document")), "bioactivity_id")
    relation = F.coalesce(F.nullif(F.trim("standard_relation"), F.lit("")), F.lit("NA"))
    rows = ends.withColumn("_signature", signature(F.col("standard_type"), relation, canonical_number(F.col("standard_value")), F.col("standard_units"), F.col("_target"), F.col("_document"))).filter("_signature is not null")
    groups, log = merge_measurements(rows, ["_signature"], "bioactivity_id", agree)
    log = stored(log.select("merged_id", "canonical_id"), "merge-log")
    if bad := groups.filter("conflicts > 0").head(1):
        raise ValueError(f"measurements of one identity disagree: {bad[0]['canonical_id']}")
    moved = log.withColumnsRenamed({"merged_id": "raw_id"})
    none = moved.limit(0)
    linked = remap_edges(has, none, moved)
    before, after = has.select("src_id", "dst_id").distinct().count(), linked.select("src_id", "dst_id").distinct().count()
    if before != after:
        raise ValueError(f"{before - after} edges would become copies of others")
    kept = bio.join(log.select(F.col("merged_id").alias("bioactivity_id")), "bioactivity_id", "left_anti")
    return {"bio": kept, "has": linked, "measured": remap_edges(measured, moved, none).distinct(), "reported": remap_edges(reported, moved, none).distinct()}, log


def merge_report(name: str, before: DataFrame, incoming: DataFrame, after: DataFrame) -> DataFrame:
    """Rows before, incoming, added and after of one table."""
    parts = [(before, "n_before"), (incoming, "n_incoming"), (after, "n_after")]
    out = None
    for df, column in parts:
        one = df.agg(F.count("*").alias(column))
        out = one if out is None else out.crossJoin(one)
    return out.select(F.lit(name).alias("table_name"), "*", (F.col("n_after") - F.col("n_before")).alias("n_added"))


def association_breaks(before: DataFrame, after: DataFrame) -> DataFrame:
    """Sources whose number of edges changed."""
    counts = lambda df: df.groupBy("src_id").agg(F.count("*").alias("n"))
    a, b = counts(before), counts(after)
    return a.exceptAll(b).unionByName(b.exceptAll(a)).select("src_id").distinct()


def merge_batch(store: dict[str, DataFrame], incoming: dict[str, DataFrame], specs: dict[str, tuple[str, Column]], edges: dict[str, tuple[str, str]]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Merge node tables by identity and edge tables by remapped full rows; the tables and a report, nothing written.

    ``specs`` names each node table's key and identity expression, ``edges`` each edge table's node tables.
    """
    out, maps, report = {}, {}, None
    for name, (key, identity) in specs.items():
        cur, inc = (t[name].withColumn("_identity", identity) for t in (store, incoming))
        if inc.filter("_identity is null or _identity = ''").head(1):
            raise ValueError(f"{name}: a row without identity")
        added = new_nodes(cur, inc, "_identity", F.col(key))
        maps[name] = id_map(cur, inc, added, "_identity", key)
        out[name] = store[name].unionByName(added.drop("_identity").select(*store[name].columns))
    for name, (s, d) in edges.items():
        out[name] = union_edges(store[name], remap_edges(incoming[name], maps[s], maps[d]).select(*store[name].columns))
    for name in out:
        one = merge_report(name, store[name], incoming[name], out[name])
        report = one if report is None else report.unionByName(one)
    return out, report
