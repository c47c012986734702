"""The canonical merge of a whole graph: node identity, measurement identity, edges remapped, all checked before anything counts.

Existing rows win and are never changed. A node is new when no stored row has its identity; a measurement when
none has its signature, made of its fields and the canonical target and document it is tied to by edges. New
measurements get ids that go on after the store's highest. Edges follow both kinds of ids and are united as full rows.

A batch's measurements are moved three times, with their edges beside them: to the edges of their raw id, to those of their
signature, and into the order of new ids. What a row holds twice is left out where it moves.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from graphloom.functions.clean import canonical_number, clean, normalized_text
from graphloom.operators.measurements import id_map, id_text, last_number, new_nodes, remap_edges
from graphloom.sources.tables import stored


def identifier(c: Column) -> Column:
    """A trimmed, lower-cased id; null becomes empty (IDN)."""
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))


@dataclass(frozen=True)
class Measured:
    """The measurement table: its id, its four fields, and the edges that tie it to exactly one target and document."""

    table: str = "bioactivity"
    key: str = "bioactivity_id"
    fields: tuple[str, str, str, str] = ("standard_type", "standard_relation", "standard_value", "standard_units")
    target: str = "MEASURED_ON"
    document: str = "REPORTED_IN"
    prefix: str = "BA_"


@dataclass(frozen=True)
class Spec:
    """Node tables with key and identity rule, edge tables (src_id, dst_id, ...) with their two node tables."""

    nodes: dict[str, tuple[str, Callable[[Column], Column]]]
    edges: dict[str, tuple[str, str]]
    measured: Measured = field(default_factory=Measured)


# The seven node and six edge tables of the evidence graph.
EVIDENCE = Spec(
    {"plant": ("scientific_name", normalized_text), "plant_part": ("plant_part_id", identifier), "phytochemical": ("inchi_key", identifier), "therapeutic_use": ("mesh_id", identifier), "target": ("target_chembl_id", identifier), "document": ("document_chembl_id", identifier)},
    {"HAS_PART": ("plant", "plant_part"), "CONTAINS": ("plant_part", "phytochemical"), "USED_FOR": ("plant_part", "therapeutic_use"), "HAS_BIOACTIVITY": ("phytochemical", "bioactivity"), "MEASURED_ON": ("bioactivity", "target"), "REPORTED_IN": ("bioactivity", "document")},
)

_ADDED = "_added"
_SIGNED = ["_kind", "_relation", "_number", "_units", "_target", "_document"]
_ROWS = 250_000  # rows a task, where a session has fewer tasks
_SENT = 500_000  # moved ids that go to every task
_PLACE = 33  # bits of a row's place in its partition (monotonically_increasing_id)


@dataclass(frozen=True)
class Merged:
    """The merged tables by name, with the mark ``_added``; the raw to canonical ids of each node table; rows of the batch by table."""

    marked: dict[str, DataFrame]
    maps: dict[str, DataFrame]
    n_incoming: dict[str, int]

    @property
    def tables(self) -> dict[str, DataFrame]:
        return {name: df.drop(_ADDED) for name, df in self.marked.items()}

    def write(self, path: str) -> DataFrame:
        """Write every table under its name; rows before, incoming, added and after are counted as they are written.

        The report is written beside them as ``_report``.
        """
        spark, told = next(iter(self.marked.values())).sparkSession, []
        for name, df in self.marked.items():
            seen = Observation()
            df.observe(seen, F.count("*").alias("n_after"), F.coalesce(F.sum(_ADDED), F.lit(0)).alias("n_added")).drop(_ADDED).write.mode("overwrite").parquet(f"{path}/{name}")
            n = seen.get
            told.append((name, n["n_after"] - n["n_added"], self.n_incoming[name], n["n_added"], n["n_after"]))
        report = spark.createDataFrame(told, "table_name string, n_before long, n_incoming long, n_added long, n_after long")
        report.coalesce(1).write.mode("overwrite").json(f"{path}/_report")
        return report


def merge_graph(store: dict[str, DataFrame], incoming: dict[str, DataFrame], spec: Spec = EVIDENCE, order: dict[str, Column] | None = None) -> Merged:
    """Merge a batch into the store (U1, U7, W1, A6, A9, J17); nothing is written.

    ``order`` tells which incoming row of an identity comes first, and the order of new ids, by table; the key by
    default. The stored columns count: ones that the batch lacks are blank, others are dropped. Errors: a node
    without identity, a measurement without exactly one target and document, a measurement id of two signatures, an edge without its nodes, a
    lost association. A table missing from the batch is empty, one missing from the store takes the batch's columns. The batch's
    measurements and their edges are read a few times: store them first where they are dear to make. A measurement may tell its edges
    itself, in columns by their tables' names that hold the other ends' ids (null for none); it moves once with them, not once for each.
    An edge of a measurement that neither the store nor the batch has is an error, also where a new one comes to its id by chance.
    """
    order, batch, have, seen, moved, m = dict(order or {}), {}, {}, {}, {}, spec.measured
    names = [*spec.nodes, m.table, *spec.edges]
    tied = [n for n, kinds in spec.edges.items() if kinds.count(m.table) == 1]
    for name in names:
        if name not in incoming and name not in store:
            raise ValueError(f"{name} is in neither the store nor the batch")
        have[name] = store.get(name, incoming.get(name)) if name in store else incoming[name].limit(0)
        rows = incoming.get(name, have[name].limit(0))
        flat = tied if name == m.table else []
        kept = [c for c in rows.columns if c not in have[name].columns and (name in order or c in flat)]
        fitted = rows.select(*[F.col(f"`{c}`") if c in rows.columns else F.lit("").cast(have[name].schema[c].dataType).alias(c) for c in have[name].columns], *kept)
        if name == m.table:
            batch[name] = fitted
        else:
            batch[name], seen[name] = (fitted, fitted.count()) if name in tied else _counted(fitted, "batch")
    measured = batch[m.table]
    told = [name for name in tied if name in measured.columns]
    # Ids in small letters are in order as rows come to their edges; others carry theirs along.
    cased = F.count_if(~F.col(m.key).cast("string").eqNullSafe(identifier(F.col(m.key)))).alias("cased")
    counts = measured.agg(F.count("*").alias(m.table), cased, *[F.count(f"`{name}`").alias(name) for name in told]).first()
    seen |= {m.table: counts[m.table]} | {name: seen[name] + counts[name] for name in told}
    if counts["cased"]:
        order.setdefault(m.table, F.col(m.key))
    marked, maps = {}, {}
    for name, (key, rule) in spec.nodes.items():
        cur, inc = (df.withColumn("_identity", rule(F.col(key))) for df in (have[name], batch[name]))
        _none(inc.filter("_identity = ''"), f"{name}: rows without identity")
        added = stored(new_nodes(cur, inc, "_identity", order.get(name, F.col(key))), "added")
        maps[name] = stored(id_map(cur, inc, added, "_identity", key).withColumn("raw_id", F.trim("raw_id")).distinct(), "ids")
        moved[name] = _counted(maps[name].filter("raw_id <> canonical_id"), "moved")
        marked[name] = _marked(have[name], added.select(*have[name].columns))
    found, maps[m.table], ends = _measurements(have, batch, maps, moved, spec, tied, order.get(m.table), seen)
    marked |= found
    for name, (s, d) in spec.edges.items():
        if name not in tied:
            marked[name] = _united(have[name], remap_edges(batch[name], maps[s], maps[d]).select(*have[name].columns))
    _check_ends(marked, have, ends, spec, tied)
    return Merged(marked, maps, seen)


def _counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    seen = Observation()
    return stored(df.observe(seen, F.count("*").alias("n")), name), seen.get["n"]


def _marked(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.withColumn(_ADDED, F.lit(0)).unionByName(new.withColumn(_ADDED, F.lit(1)))


def _united(old: DataFrame, new: DataFrame) -> DataFrame:
    """The set union of full rows, marked and stored."""
    return stored(_marked(old, new).groupBy(*[F.col(f"`{c}`") for c in old.columns]).agg(F.min(_ADDED).alias(_ADDED)), "edges")


def _none(bad: DataFrame, what: str) -> None:
    if found := bad.head(5):
        raise ValueError(f"{what}: {[tuple(r) for r in found]}")


def _text(c: str) -> Column:
    return F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))


def _canonical(edges: DataFrame, end: str, moved: tuple[DataFrame, int]) -> DataFrame:
    """The edges with the canonical id of an end as ``_to``; joined with the ids that move only, not at all where none does."""
    ids, n = moved
    if not n:
        return edges.withColumn("_to", _text(end))
    ids = ids.select(F.col("raw_id").alias("_end"), F.col("canonical_id").alias("_canonical"))
    found = edges.withColumn("_end", _text(end)).join(F.broadcast(ids) if n <= _SENT else ids, "_end", "left")
    return found.withColumn("_to", F.coalesce("_canonical", "_end")).drop("_end", "_canonical")


def _ends(edges: DataFrame, canonical: DataFrame | None, rule: Callable[[Column], Column], name: str) -> DataFrame:
    """(_id, name): the identity of the canonical node each measurement is tied to."""
    rows = edges.select(identifier(F.col("src_id")).alias("_id"), F.trim(F.col("dst_id").cast("string")).alias("raw_id"))
    if canonical is not None:
        rows = rows.join(canonical, "raw_id", "left").withColumn("raw_id", F.coalesce("canonical_id", "raw_id"))
    end = rule(F.col("raw_id"))
    return rows.filter(end != "").groupBy("_id").agg(F.min(end).alias(name))


def _fields(m: Measured, prefix: str = "") -> list[Column]:
    """The four fields of a measurement as its signature has them."""
    kind, relation, value, units = (clean(F.col(f"`{prefix}{c}`")) for c in m.fields)
    told = [kind, F.coalesce(F.nullif(relation, F.lit("")), F.lit("NA")), canonical_number(value), units]
    return [c.alias(name) for name, c in zip(_SIGNED, told, strict=False)]


def _signed(rows: DataFrame, target: DataFrame, document: DataFrame, m: Measured) -> DataFrame:
    """(the signature's six parts, _raw) of the measurements that have all of them."""
    tied = rows.select(_text(m.key).alias("_raw"), identifier(F.col(m.key)).alias("_id"), *_fields(m))
    return tied.join(target, "_id").join(document, "_id").select(*_SIGNED, "_raw").na.drop(subset=_SIGNED)


def _rows_of_ids(have: dict[str, DataFrame], batch: dict[str, DataFrame], moved: dict, spec: Spec, tied: list[str], order: Column | None, parts: int) -> DataFrame:
    """The batch's measurements, each with one of its edges of each kind beside it, in the order of their ids.

    Further edges of a measurement are rows of their own with its signature, edges whose measurement the batch lacks have their id as
    ``_own``. What the signature has as the row tells it anyway is null.
    """
    m = spec.measured
    bio, tag = F.col("_tag") == 0, F.col("_tag")
    flat = [c for c in tied if c in batch[m.table].columns]
    rows = batch[m.table].select(_text(m.key).alias("_raw"), F.lit(0).alias("_tag"), (F.lit(0) if order is None else order).alias("_order"), *[F.col(f"`{c}`").alias(f"_b_{c}") for c in have[m.table].columns if c != m.key], *flat)
    for i, name in enumerate(tied, 1):
        if name in flat:
            more = [f for f in have[name].schema if f.name not in ("src_id", "dst_id")]
            rows = _canonical(rows, name, moved[next(k for k in spec.edges[name] if k != m.table)]).withColumn("_to", F.when(F.col(name).isNotNull(), F.col("_to")))
            rows = rows.withColumns({f"_{i}_{f.name}": F.when(F.col(name).isNotNull(), F.lit("").cast(f.dataType)) for f in more}).withColumnRenamed("_to", f"_{i}_to")
    rows, slots = rows.drop(*flat), {}
    for i, name in enumerate(tied, 1):
        own, end = ("src_id", "dst_id") if spec.edges[name][0] == m.table else ("dst_id", "src_id")
        more = [c for c in have[name].columns if c not in (own, end)]
        slots[name] = (i, [f"_{i}_to", *[f"_{i}_{c}" for c in more]])
        found = _canonical(batch[name], end, moved[next(k for k in spec.edges[name] if k != m.table)])
        rows = rows.unionByName(found.select(_text(own).alias("_raw"), F.lit(i).alias("_tag"), F.col("_to").alias(f"_{i}_to"), *[F.col(f"`{c}`").alias(f"_{i}_{c}") for c in more]), allowMissingColumns=True)
    ends = {}
    for c, name in (("_target", m.target), ("_document", m.document)):
        i, rule = slots[name][0], spec.nodes[spec.edges[name][1]][1]
        ends[c] = (f"_{i}_to", F.when(F.col(f"_{i}_to").isNotNull(), F.nullif(rule(F.col(f"_{i}_to")), F.lit(""))))
    rows = rows.repartitionByRange(parts, F.lower("_raw")).withColumn("_id", F.lower("_raw"))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_id", "_raw", "_tag").orderBy("_order")))
    rows = rows.withColumns({"_fields": F.when(bio, F.struct(*_fields(m, "_b_")))} | {f"_end{c}": e for c, (_, e) in ends.items()})
    one, same = Window.partitionBy("_id", "_raw"), Window.partitionBy("_id")
    first = F.col("_n") == 1
    beside, alone = {}, {}
    for i, cs in slots.values():  # an edge goes beside its measurement's first row unless that has one already
        lone = F.max(F.when(bio & first & F.col(cs[0]).isNotNull(), 1)).over(one).isNull()
        alone[i] = (tag == i) & ~lone
        beside |= {c: F.when(bio & first & F.col(cs[0]).isNull(), F.first(F.when((tag == i) & first, F.col(f"`{c}`")), ignorenulls=True).over(one)).otherwise(F.col(f"`{c}`")) for c in cs}
    rows = rows.withColumns(beside | {"_stays": functools.reduce(Column.__or__, alone.values()), "_has": F.max(bio).over(one), "_least": F.min("_fields").over(one), "_most": F.max("_fields").over(one)})
    rows = rows.withColumns({f"_{side}{c}": f(f"_end{c}").over(same) for c in ends for side, f in (("least", F.min), ("most", F.max))})
    rows = rows.filter(bio | ~first | F.col("_stays") | ~F.col("_has"))
    single = F.lit(True)
    for c in ends:
        single &= F.coalesce(F.col(f"_least{c}") == F.col(f"_most{c}"), F.lit(False))
    parts_of = {c: F.when(F.col("_has"), F.nullif(F.col(f"_least.{c}"), F.col(f"`_b_{field}`"))) for c, field in zip(_SIGNED, m.fields, strict=False)}
    parts_of |= {c: F.when(F.col("_has"), F.nullif(F.col(f"_least{c}"), F.lower(to))) for c, (to, _) in ends.items()}
    flags = {"_own": F.when(~F.col("_has"), F.col("_raw")), "_untied": F.when(bio & ~single, F.col("_raw")), "_split": F.when(bio & (F.col("_least") != F.col("_most")), F.col("_raw")), "_row": F.monotonically_increasing_id()}
    kept = [c for c in rows.columns if c.startswith("_b_")] + [c for _, cs in slots.values() for c in cs]
    return rows.select("_tag", "_order", *[F.col(f"`{c}`") for c in kept], *[v.alias(k) for k, v in (parts_of | flags).items()])


def _measurements(have: dict[str, DataFrame], batch: dict[str, DataFrame], maps: dict, moved: dict, spec: Spec, tied: list[str], order: Column | None, seen: dict[str, int]) -> tuple[dict[str, DataFrame], DataFrame, dict]:
    """The measurements and the tables of their edges, marked; their raw to canonical ids; the ends that the batch's edges have, by table."""
    m = spec.measured
    spark, slot = batch[m.table].sparkSession, {name: i for i, name in enumerate(tied, 1)}
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = lambda n: max(least, -(-n // _ROWS))
    rows = _rows_of_ids(have, batch, moved, spec, tied, order, tasks(sum(seen[n] for n in (m.table, *tied))))
    rules = {name: spec.nodes[spec.edges[name][1]][1] for name in (m.target, m.document)}
    ends = lambda side, mapped: [_ends(side[e], maps[spec.edges[e][1]] if mapped else None, rules[e], c) for e, c in ((m.target, "_target"), (m.document, "_document"))]
    cur = _signed(have[m.table], *ends(have, False), m).withColumnRenamed("_raw", "_known").withColumn("_tag", F.lit(-1))
    both = rows.unionByName(cur, allowMissingColumns=True)
    told = [*[f"_b_{c}" for c in m.fields], f"_{slot[m.target]}_to", f"_{slot[m.document]}_to"]
    whole = {c: F.coalesce(F.col(c), F.lower(t) if i > 3 else F.col(f"`{t}`")) for i, (c, t) in enumerate(zip(_SIGNED, told, strict=True))}
    sign = {f"_is{c}": F.when(F.col("_own").isNull(), v) for c, v in whole.items()} | {"_is_own": F.col("_own")}
    both = both.repartition(tasks(seen[m.table]), *sign.values()).withColumns(sign)
    group, bio = Window.partitionBy(*sign), F.col("_tag") == 0
    both = both.withColumns({"_first": F.min(F.when(bio, F.struct("_order", "_row"))).over(group), "_known": F.min("_known").over(group), "_size": F.sum(F.when(F.col("_tag") >= 0, 1)).over(group)}).filter("_tag >= 0").drop(*sign)
    both = both.withColumns({"_new": bio & F.col("_known").isNull() & (F.col("_first._row") == F.col("_row")), "_at": F.coalesce("_first._row", "_row"), "_order": F.coalesce("_first._order", "_order")}).drop("_first")
    fields = [c for c in both.columns if c.startswith("_b_")]
    both = both.repartitionByRange(tasks(seen[m.table]), "_order", "_at").sortWithinPartitions(F.desc("_new"), "_order", "_at").drop("_order")
    found = stored(both.withColumn("_place", F.monotonically_increasing_id()), "numbered")
    _none(found.filter("_untied is not null").select("_untied"), f"{m.table}: rows without exactly one target and document")
    _none(found.filter("_split is not null").select("_split"), f"{m.table}: ids of more than one measurement")
    counts = found.agg(F.count(F.when(bio, 1)).alias(m.table), *[F.count(f"_{i}_to").alias(name) for name, i in slot.items()]).first()
    if lost := [name for name in (m.table, *tied) if counts[name] != seen[name]]:
        raise ValueError(f"lost associations: {[(name, seen[name], counts[name]) for name in lost]}")
    # A new measurement's number: its place among those of its range, after the sizes of the ranges before it.
    sizes = found.filter("_new").groupBy(F.shiftright("_place", _PLACE).alias("_range")).agg(F.count("*").alias("_n"))
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    before = before.crossJoin(have[m.table].agg(last_number(m.key).alias("_start")))
    number = F.col("_start") + F.col("_before") + F.col("_place").bitwiseAND((1 << _PLACE) - 1) + 1
    new = found.filter("_new").withColumn("_range", F.shiftright("_place", _PLACE)).join(F.broadcast(before), "_range").withColumn("_ba", id_text(m.prefix, number)).drop("_range", "_before", "_start")
    later = found.filter("not _new")
    again = later.filter("_known is null and _own is null").join(new.select(F.col("_row").alias("_at"), "_ba"), "_at")
    others = later.filter("_known is not null or _own is not null").withColumn("_ba", F.coalesce("_known", "_own")).unionByName(again).unionByName(new.filter("_size > 1"))
    alone = new.filter("_size = 1")

    def edges(rows: DataFrame, name: str) -> DataFrame:
        own, end = ("src_id", "dst_id") if spec.edges[name][0] == m.table else ("dst_id", "src_id")
        as_had = {own: F.col("_ba"), end: F.col(f"_{slot[name]}_to")}
        return rows.filter(f"_{slot[name]}_to is not null").select(*[as_had.get(c, F.col(f"`_{slot[name]}_{c}`")).alias(c) for c in have[name].columns])

    named = new.select(*[(F.col("_ba") if c == m.key else F.col(f"`_b_{c}`")).alias(c) for c in have[m.table].columns])
    marked = {m.table: _marked(have[m.table], named)}
    for name in tied:  # a new measurement's only row has no equal
        marked[name] = _united(have[name], edges(others, name)).unionByName(edges(alone, name).withColumn(_ADDED, F.lit(1)))
    canonical = others.unionByName(alone).filter("_own is null").select(*[v.alias(c) for c, v in whole.items()], "_ba").distinct()
    own = {e: batch[m.table].select(F.col(m.key).alias("src_id"), F.col(e).alias("dst_id")) for e in rules if e in batch[m.table].columns}
    whole_edges = {e: batch[e].select("src_id", "dst_id").unionByName(own[e]) if e in own else batch[e] for e in rules}
    ids = _signed(batch[m.table], *ends(whole_edges, True), m).join(canonical, _SIGNED).select(F.col("_raw").alias("raw_id"), F.col("_ba").alias("canonical_id")).distinct()
    return marked, ids, {name: found.select(F.trim(f"_{i}_to").alias("_key")) for name, i in slot.items()} | {m.table: found.select(F.col("_own").alias("_key"))}


def _check_ends(marked: dict[str, DataFrame], have: dict[str, DataFrame], ends: dict[str, DataFrame], spec: Spec, tied: list[str]) -> None:
    """Every edge's two nodes exist; the first five that don't are named.

    New edges of the batch's measurements have these by the way they are made: their other ends are looked up, and measurements that the batch lacks.
    """
    m, bad = spec.measured, None
    keys = {name: key for name, (key, _) in spec.nodes.items()} | {m.table: m.key}
    asked = {}
    for name, kinds in spec.edges.items():
        for side, kind in zip(("src_id", "dst_id"), kinds, strict=True):
            rows = (have if name in tied else marked)[name].select(_text(side).alias("_key"))
            if name in tied and kind != m.table:
                rows = rows.unionByName(ends[name].filter("_key is not null"))
            asked.setdefault(kind if name not in tied or kind != m.table else "", []).append((f"{name}.{side}", rows))
    asked.setdefault("", []).append((m.table, ends[m.table].filter("_key is not null")))
    for kind, all_ends in asked.items():
        nodes = (marked[kind] if kind else have[m.table]).select(_text(keys[kind or m.table]).alias("_key")).distinct()
        for end, rows in all_ends:
            lost = rows.distinct().join(nodes, "_key", "left_anti").select(F.lit(end).alias("end"), "_key")
            bad = lost if bad is None else bad.unionByName(lost)
    _none(bad, "edges without their nodes")
