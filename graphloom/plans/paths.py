"""Typed property graphs as tables, and joins along the smallest path of their schema."""

from __future__ import annotations

import uuid
from collections import deque
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.sources.tables import numbered, shared_folder, spread, stored

LIMIT = 5000


@dataclass(frozen=True)
class Graph:
    """Node tables by type with column ``id``, edge tables (src_id, dst_id) by (source type, target type) with their name."""

    nodes: dict[str, DataFrame]
    edges: dict[tuple[str, str], tuple[str, DataFrame]]
    filters: dict[str, str] = field(default_factory=dict)  # filter name -> node type that it forces into a path (J31)
    backward: dict[tuple[str, str], DataFrame] = field(default_factory=dict)  # the same edges laid out by dst_id, for joins that come from there


def schema_path(graph: Graph, a: str, b: str) -> list[str]:
    """Types on the shortest path between two types of the schema."""
    near: dict[str, list[str]] = {}
    for s, d in graph.edges:
        near.setdefault(s, []).append(d)
        near.setdefault(d, []).append(s)
    before, todo = {a: a}, deque([a])
    while todo:
        at = todo.popleft()
        for n in near.get(at, []):
            if n not in before:
                before[n] = at
                todo.append(n)
    path = [b]
    while path[-1] != a:
        path.append(before[path[-1]])
    return path[::-1]


def subtree(graph: Graph, terminals: list[str]) -> list[tuple[str, str]]:
    """Edges (known type, new type) that join the terminals, in an order in which each new type touches a known one."""
    order, seen = [], {terminals[0]}
    for t in terminals[1:]:
        for a, b in zip(path := schema_path(graph, terminals[0], t), path[1:], strict=False):
            if b not in seen:
                order.append((a, b))
                seen.add(b)
    return order


def _node(graph: Graph, kind: str, where: dict[str, Column]) -> DataFrame:
    df = graph.nodes[kind]
    df = df.filter(where[kind]) if kind in where else df
    return df.select(*[F.col(c).alias(f"{kind}_{c}") for c in df.columns])


def path_join(graph: Graph, terminals: list[str], where: dict[str, Column] | None = None, limit: int | None = LIMIT) -> DataFrame:
    """Rows of the inner join along the smallest subtree that holds the terminals and the filtered types.

    Bag semantics: branches multiply. The limit is clamped to 1..5000 and taken under a total order
    of ids; None means all rows.
    """
    where = where or {}
    kinds = list(dict.fromkeys([*terminals, *where]))
    rows = _node(graph, kinds[0], where)
    for known, new in subtree(graph, kinds):
        forward = (known, new) in graph.edges
        edge = graph.edges[(known, new)][1] if forward else graph.backward.get((new, known), graph.edges[(new, known)][1])
        s, d = ("src_id", "dst_id") if forward else ("dst_id", "src_id")
        edge = edge.select(F.col(s).alias(f"{known}_id"), F.col(d).alias(f"{new}_id"))
        rows = rows.join(edge, f"{known}_id").join(_node(graph, new, where), f"{new}_id")
    if limit is None:
        return rows
    ids = sorted(c for c in rows.columns if c.endswith("_id"))
    return rows.orderBy(*ids, *sorted(c for c in rows.columns if c not in ids)).limit(max(1, min(limit, LIMIT)))


def stored_graph(graph: Graph, buckets: int = 64, terminals: list[str] | None = None) -> Graph:
    """The graph with its tables in buckets, sorted: nodes by id, edges once by each end.

    With ``terminals`` only what ``path_join`` reads for these types, in this order, is stored: the tables along their
    subtree, edges by the end that it comes from.

    A path join over it moves only the rows it has so far; node and edge tables are read where they lie, however often they are
    joined. The tables are written under the shared folder.
    """
    spark, run = next(iter(graph.nodes.values())).sparkSession, uuid.uuid4().hex
    folder = shared_folder(spark)

    def save(df: DataFrame, key: str, what: str) -> DataFrame:
        table = f"graph_{run}_{what}"
        df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", f"{folder}/{table}").saveAsTable(table)
        return spark.table(table)

    walk = None if terminals is None else subtree(graph, terminals)
    kinds = graph.nodes if walk is None else {terminals[0], *[new for _, new in walk]}
    ahead = graph.edges if walk is None else {ends for ends in walk if ends in graph.edges}
    behind = graph.edges if walk is None else {(d, s) for s, d in walk if (s, d) not in graph.edges}
    nodes = {kind: save(df, "id", f"node_{i}") if kind in kinds else df for i, (kind, df) in enumerate(graph.nodes.items())}
    edges = {ends: (rel, save(df, "src_id", f"edge_{i}") if ends in ahead else df) for i, (ends, (rel, df)) in enumerate(graph.edges.items())}
    back = {ends: save(df, "dst_id", f"back_{i}") for i, (ends, (_, df)) in enumerate(graph.edges.items()) if ends in behind}
    return Graph(nodes, edges, graph.filters, back)


def overview(graph: Graph, root: str, where: Column, counted: bool = False) -> DataFrame:
    """The root and every edge downstream of it, one UNION ALL arm per edge type, multiplicity kept.

    A frontier that edges start from is stored, so its arms don't repeat the joins before it.
    Columns: src_type, src_id, rel, dst_type, dst_id; the root's arm has no edge. If ``counted``, a node goes on once however many
    paths reach it, and a row stands for ``n`` rows: their sum is the multiplicity.
    """
    start = _node(graph, root, {root: where}).select(F.col(f"{root}_id").cast("string").alias("id"))
    n = ["n"] if counted else []
    once = lambda df: df.groupBy("id").agg(F.sum("n").alias("n")) if counted else df
    start = once(start.withColumn("n", F.lit(1).cast("long"))) if counted else start
    null = F.lit(None).cast("string")
    out = start.select(F.lit(root).alias("src_type"), F.col("id").alias("src_id"), null.alias("rel"), null.alias("dst_type"), null.alias("dst_id"), *n)
    front, todo = {root: start}, [root]
    while todo:
        at = todo.pop(0)
        for (s, d), (rel, edge) in graph.edges.items():
            if s == at:
                cast = edge.select(F.col("src_id").cast("string").alias("id"), F.col("dst_id").cast("string").alias("to"))
                hop = front[s].join(cast, "id")
                hop = stored(hop, "frontier") if any(d == at for at, _ in graph.edges) else hop
                out = out.unionByName(hop.select(F.lit(s).alias("src_type"), F.col("id").alias("src_id"), F.lit(rel).alias("rel"), F.lit(d).alias("dst_type"), F.col("to").alias("dst_id"), *n))
                front[d] = once(hop.select(F.col("to").alias("id"), *n))
                todo.append(d)
    return out


def edge_table(graph: Graph, kinds: list[tuple[str, str]] | None = None) -> DataFrame:
    """All edges with types as one table of strings."""
    out = None
    for (s, d), (rel, edge) in graph.edges.items():
        if kinds is None or (s, d) in kinds:
            part = edge.select(F.lit(s).alias("src_type"), F.col("src_id").cast("string").alias("src_id"), F.lit(rel).alias("rel"), F.lit(d).alias("dst_type"), F.col("dst_id").cast("string").alias("dst_id"))
            out = part if out is None else out.unionByName(part)
    return out


def neighbours(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """One-hop neighbours of (type, id) rows with the edge's direction."""
    out = edges.select(F.col("src_type").alias("type"), F.col("src_id").alias("id"), F.lit("out").alias("direction"), "rel", F.col("dst_type").alias("n_type"), F.col("dst_id").alias("n_id"))
    back = edges.select(F.col("dst_type").alias("type"), F.col("dst_id").alias("id"), F.lit("in").alias("direction"), "rel", F.col("src_type").alias("n_type"), F.col("src_id").alias("n_id"))
    return out.unionByName(back).join(ids, ["type", "id"])


def bfs_layers(edges: DataFrame, root: DataFrame, max_depth: int) -> DataFrame:
    """Hop distance of each (type, id) from the root over undirected edges; unreached nodes get max + 1.

    At most ``max_depth`` hops, fewer where no node is new. Each hop joins the stored newest layer with the stored edges once and
    leaves out what is stored as seen, so a plan grows by one scan a hop.
    """
    pairs = edges.select(F.col("src_type").alias("type"), F.col("src_id").alias("id"), F.col("dst_type").alias("t2"), F.col("dst_id").alias("i2"))
    both = stored(pairs.unionByName(pairs.select(F.col("t2").alias("type"), F.col("i2").alias("id"), F.col("type").alias("t2"), F.col("id").alias("i2"))).distinct(), "pairs")
    layer = stored(root.select("type", "id", F.lit(0).alias("depth")).distinct(), "layer")
    seen = layer
    for depth in range(1, max_depth + 1):
        found = next_layer(layer, both, seen).withColumn("depth", F.lit(depth))
        layer = stored(found, "layer")
        if not layer.head(1):
            break
        seen = seen.unionByName(layer)
    every = both.select("type", "id").distinct().join(seen, ["type", "id"], "left")
    return every.withColumn("depth", F.coalesce("depth", F.lit(max_depth + 1)))


def next_layer(layer: DataFrame, both: DataFrame, seen: DataFrame) -> DataFrame:
    """The (type, id) one hop from the layer that are not seen yet."""
    step = layer.join(both, ["type", "id"]).select(F.col("t2").alias("type"), F.col("i2").alias("id")).distinct()
    return step.join(seen.select("type", "id"), ["type", "id"], "left_anti")


def facts(rows: DataFrame, kinds: list[str], measures: list[str] | None = None, index: bool = True) -> DataFrame:
    """Result rows as facts: index, ordered path, entities (the last of a type), measurements.

    Without ``index`` they have no numbers and nothing is sorted: enough for counts.
    """
    ids = [F.col(f"{k}_id").cast("string") for k in kinds]
    path = F.array(*[F.struct(F.lit(k).alias("type"), i.alias("id")) for k, i in zip(kinds, ids, strict=True)])
    last = dict(zip(kinds, ids, strict=True))
    entities = F.create_map(*[x for k, i in last.items() for x in (F.lit(k), i)])
    measured = F.create_map(*[x for m in measures or [] for x in (F.lit(m), F.col(m).cast("string"))]) if measures else F.create_map().cast("map<string,string>")
    told = numbered(rows, [*ids, *[F.col(m) for m in measures or []]], "row_index") if index else rows
    return told.select(*(["row_index"] if index else []), path.alias("path"), entities.alias("entities"), measured.alias("measurements"))


def distinct_nodes(found: DataFrame) -> DataFrame:
    """Distinct (type, id) of facts."""
    return found.select(F.explode("path").alias("n")).select("n.*").distinct()


def distinct_edges(found: DataFrame) -> DataFrame:
    """Distinct edges between neighbours on the facts' paths."""
    step = lambda i: F.struct(*[F.col("path")[i + j][c].alias(f"{side}_{c}") for j, side in ((0, "src"), (1, "dst")) for c in ("type", "id")])
    steps = F.transform(F.sequence(F.lit(0), F.size("path") - 2), step)
    return found.filter(F.size("path") > 1).select(F.explode(steps).alias("e")).select("e.*").distinct()


def summary(found: DataFrame, measured: str | None = None, only: str | None = None) -> DataFrame:
    """Counts of facts, distinct nodes and edges, and both by type (A1), from one scan of the facts.

    ``measured`` names the node type that measurements belong to; then distinct nodes of it are counted by each measured value.
    ``only`` leaves out all counts but those of one kind: facts, nodes, edges or measured.
    """
    item = lambda kind, of, key: F.struct(F.lit(kind).alias("kind"), of.alias("of"), key.alias("key"))
    null = F.lit(None).cast("string")
    ends = lambda i: F.to_json(F.struct(F.col("path")[i]["id"].alias("s"), F.col("path")[i + 1]["id"].alias("d")))
    types = lambda i: F.concat_ws(">", F.col("path")[i]["type"], F.col("path")[i + 1]["type"])
    steps = F.when(F.size("path") > 1, F.transform(F.sequence(F.lit(0), F.size("path") - 2), lambda i: item("edges", types(i), ends(i))))
    parts = {"facts": F.array(item("facts", null, null)), "nodes": F.transform("path", lambda n: item("nodes", n["type"], n["id"])), "edges": F.coalesce(steps, F.array().cast("array<struct<kind:string,of:string,key:string>>"))}
    if measured:
        parts["measured"] = F.transform(F.map_entries("measurements"), lambda m: item("measured", F.concat(m["key"], F.lit("="), F.coalesce(m["value"], F.lit(""))), F.col("entities")[measured]))
    kinds = [k for k in parts if only in (None, k)]
    rows = found.select(F.explode(F.concat(*[parts[k] for k in kinds])).alias("x")).select("x.*").groupBy("kind", "of", "key").agg(F.count("*").alias("times"))
    sums = rows.groupingSets([["kind", "of"], ["kind"]], "kind", "of").agg(F.count("*").alias("kinds"), F.sum("times").alias("times"), F.grouping("of").alias("whole"))
    label = F.when(F.col("whole") == 1, F.when(F.col("kind") != "measured", F.col("kind"))).when(F.col("kind") != "facts", F.concat_ws(":", "kind", "of"))
    told = sums.select(label.alias("metric"), F.when(F.col("kind") == "facts", F.col("times")).otherwise(F.col("kinds")).alias("n")).filter("metric is not null")
    none = found.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in kinds if x != "measured"]).cast("array<string>")).alias("metric"), F.lit(0).cast("long").alias("n"))
    return told.unionByName(none).groupBy("metric").agg(F.max("n").alias("n"))


def fact_line(path: Column, measurements: Column | None = None) -> Column:
    """One line of text for a fact's path, its measurements behind it as JSON in the order of their names."""
    line = F.array_join(F.transform(path, lambda n: F.concat_ws("=", n["type"], n["id"])), " > ")
    if measurements is None:
        return line
    ordered = F.map_from_entries(F.array_sort(F.map_entries(measurements)))
    return F.when(F.size(measurements) > 0, F.concat(line, F.lit(" "), F.to_json(ordered))).otherwise(line)


def context_size(found: DataFrame) -> DataFrame:
    """Facts, characters and UTF-8 bytes of their lines, and whether the numbers run from 0 without gaps."""
    line = fact_line(F.col("path"))
    sizes = [F.count("*").alias("n_facts"), F.sum(F.char_length(line)).alias("chars"), F.sum(F.octet_length(line)).alias("bytes")]
    whole = (F.count_distinct("row_index") == F.count("*")) & (F.min("row_index") == 0) & (F.max("row_index") + 1 == F.count("*"))
    return found.agg(*sizes, whole.alias("in_order"))


def violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Duplicate and blank node ids, dangling and duplicate edges, as (problem, detail).

    Nodes, and edges looked for twice, are dealt by what they are counted by before they are counted: ids seldom repeat, so counts in advance only fill a task.
    """
    key = F.concat_ws(":", "type", "id")
    dup = spread(nodes, "type", "id").groupBy("type", "id").count().filter("count > 1").select(F.lit("duplicate node").alias("problem"), key.alias("detail"))
    blank = nodes.filter("id is null or trim(id) = ''").select(F.lit("blank node").alias("problem"), F.col("type").alias("detail"))
    edge = F.concat_ws(":", "src_type", "src_id", "rel", "dst_type", "dst_id")
    out = dup.unionByName(blank)
    for side in ("src", "dst"):
        at = [f"{side}_type", f"{side}_id"]
        ends = spread(nodes.select(F.col("type").alias(at[0]), F.col("id").alias(at[1])), *at).distinct()
        out = out.unionByName(edges.join(ends, at, "left_anti").select(F.lit(f"dangling {side}").alias("problem"), edge.alias("detail")))
    whole = ["src_type", "src_id", "rel", "dst_type", "dst_id"]
    twice = spread(edges.select(*whole), *whole).groupBy(*whole).count().filter("count > 1")
    return out.unionByName(twice.select(F.lit("duplicate edge").alias("problem"), edge.alias("detail")))


def row_violations(found: DataFrame, nodes: DataFrame, n_rows: int) -> DataFrame:
    """Facts that refer to unknown nodes, and a fact count that isn't ``n_rows``, as (problem, detail)."""
    refs = found.select(F.explode("path").alias("n")).select("n.type", "n.id").distinct()
    missing = refs.join(nodes.select("type", "id").distinct(), ["type", "id"], "left_anti").select(F.lit("missing reference").alias("problem"), F.concat_ws(":", "type", "id").alias("detail"))
    counted = found.agg(F.count("*").alias("n")).filter(F.col("n") != n_rows)
    return missing.unionByName(counted.select(F.lit("row count").alias("problem"), F.col("n").cast("string").alias("detail")))


def store_violations(nodes: dict[str, tuple[DataFrame, str]], edges: dict[str, tuple[DataFrame, str, str]], most: int = 5) -> DataFrame:
    """Blank and repeated keys, and edges whose ends no node table has: the first ``most`` offenders of each.

    ``nodes`` gives each table and its key, ``edges`` each table (src_id, dst_id) and its two node tables.
    """
    out = None
    text = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit(""))
    for name, (df, key) in nodes.items():
        told = df.groupBy(text(key).alias("detail")).agg(F.count("*").alias("n")).filter("n > 1 or detail = ''")
        one = told.select(F.lit(name).alias("table_name"), F.when(F.col("detail") == "", "blank key").otherwise("repeated key").alias("problem"), "detail")
        out = one if out is None else out.unionByName(one)
    for name, (df, src, dst) in edges.items():
        for side, table in (("src_id", src), ("dst_id", dst)):
            known = nodes[table][0].select(text(nodes[table][1]).alias("detail")).distinct()
            lost = df.select(text(side).alias("detail")).distinct().join(known, "detail", "left_anti")
            out = out.unionByName(lost.select(F.lit(name).alias("table_name"), F.lit(f"unknown {side}").alias("problem"), "detail"))
    rank = F.row_number().over(Window.partitionBy("table_name", "problem").orderBy("detail"))
    return out.withColumn("_n", rank).filter(F.col("_n") <= most).drop("_n")


def edge_violations(edges: DataFrame, constants: dict[str, str], prefixes: dict[str, str]) -> DataFrame:
    """Edges with another value than the constant of a column, or an id without its prefix, with the column."""
    wrong = [F.when(~F.col(f"`{c}`").eqNullSafe(F.lit(v)), F.lit(c)) for c, v in constants.items()]
    wrong += [F.when(~F.coalesce(F.startswith(F.col(f"`{c}`"), F.lit(v)), F.lit(False)), F.lit(c)) for c, v in prefixes.items()]
    return edges.withColumn("_bad", F.array_compact(F.array(*wrong))).filter(F.size("_bad") > 0).select("*", F.explode("_bad").alias("problem")).drop("_bad")


def type_paths(edges: DataFrame, most: int = 4) -> DataFrame:
    """(path, hops) of the directed paths of at most ``most`` edges over the types that the edge table joins.

    The edge table is read once for its few distinct type pairs; the paths follow from these by recursion.
    """
    pairs = stored(edges.select(F.col("src_type").alias("s"), F.col("dst_type").alias("d")).distinct(), "types")
    return edges.sparkSession.sql(
        """WITH RECURSIVE walk(types, hops) AS (
             SELECT array(s, d), 1 FROM {pairs}
             UNION ALL
             SELECT concat(types, array(d)), hops + 1 FROM walk JOIN {pairs} ON element_at(types, -1) = s WHERE hops < {most} AND NOT array_contains(types, d))
           SELECT array_join(types, '>') AS path, hops FROM walk""", pairs=pairs, most=most)


# The named questions and the types that they join.
FAMILIES = {
    "plant_information": ["plant"], "plant_parts": ["plant", "plant_part"], "plant_phytochemicals": ["plant", "phytochemical"], "plant_therapeutic_uses": ["plant", "therapeutic_use"],
    "plant_bioactivities": ["plant", "bioactivity"], "plant_targets": ["plant", "target"], "plant_phytochemical_bioactivities": ["plant", "phytochemical", "bioactivity"], "plant_phytochemical_targets": ["plant", "phytochemical", "target"],
    "plant_therapeutic_use_phytochemicals": ["plant", "therapeutic_use", "phytochemical"], "phytochemical_information": ["phytochemical"], "phytochemical_plants": ["phytochemical", "plant"], "phytochemical_bioactivities": ["phytochemical", "bioactivity"],
    "phytochemical_targets": ["phytochemical", "target"], "therapeutic_use_plants": ["therapeutic_use", "plant"], "therapeutic_use_phytochemicals": ["therapeutic_use", "phytochemical"], "target_phytochemicals": ["target", "phytochemical"],
    "target_bioactivities": ["target", "bioactivity"], "bioactivity_information": ["bioactivity"], "bioactivity_targets": ["bioactivity", "target"], "bioactivity_documents": ["bioactivity", "document"], "document_information": ["document"],
}


def path_family(graph: Graph, name: str, where: dict[str, Column] | None = None, limit: int | None = LIMIT, types: dict[str, str] | None = None) -> DataFrame:
    """``path_join`` for a named question; ``types`` gives the graph's own names of the types."""
    return path_join(graph, [(types or {}).get(kind, kind) for kind in FAMILIES[name]], where, limit)
