"""Views over facts: explorer, cards, profiles and candidates. Facts come from ``plans.paths.facts``.

Indices of facts are rows of their own, never lists of a whole group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.paths import Graph, subtree
from graphloom.sources.tables import numbered


def _pairs(found: DataFrame, part: str, use: str) -> DataFrame:
    e = F.col("entities")
    return found.select("row_index", F.lower(e[part]).alias("key"), e[part].alias("part"), e[use].alias("use"), "path")


def part_explorer(found: DataFrame, part: str, use: str, k: int = 8) -> DataFrame:
    """Per part, ignoring case: facts, distinct nodes and uses, the first ``k`` uses by name, and its place by falling fact count (A2, L4)."""
    rows = _pairs(found, part, use)
    facts = rows.groupBy("key").agg(F.min("part").alias("part"), F.count("*").alias("fact_count"), F.min("row_index").alias("first_index"))
    nodes = rows.select("key", F.explode("path").alias("n")).distinct().groupBy("key").agg(F.count("*").alias("n_nodes"))
    uses = rows.filter("use is not null").groupBy("key", "use").agg(F.count("*").alias("n"))
    first = uses.withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy("use"))).filter(F.col("_r") <= k)
    first = first.groupBy("key").agg(F.array_sort(F.collect_list("use")).alias("uses"))
    out = facts.join(nodes, "key").join(uses.groupBy("key").agg(F.count("*").alias("n_uses")), "key", "left").join(first, "key", "left")
    place = F.row_number().over(Window.orderBy(F.desc("fact_count"), "key"))  # one row a part
    return out.select("part", "fact_count", "first_index", "n_nodes", F.coalesce("n_uses", F.lit(0)).alias("n_uses"), F.coalesce("uses", F.array().cast("array<string>")).alias("uses"), place.alias("place"))


def evidence_facts(rows: DataFrame, graph: Graph, kinds: list[str], measured: dict[str, list[str]] | None = None) -> DataFrame:
    """Joined rows as facts with their relationships and provenance (G1).

    The path has the nodes in the order of ``kinds`` and a relationship (id, rel, source, target) for each edge of the schema that
    joins them, directed as the graph stores it; ``positional`` tells for each whether it goes from one node of the path to the very
    next. ``measured`` gives the columns of a type that are measurements: one struct for each such node, of those that are not null.
    ``provenance`` has the ids of nodes and relationships, and the row's number. Of a type that repeats the last node is the entity.
    """
    ids = {k: F.col(f"{k}_id").cast("string") for k in kinds}
    nodes = F.array(*[F.struct(F.lit(k).alias("type"), ids[k].alias("id")) for k in kinds])
    steps = []
    for a, b in subtree(graph, kinds):
        s, d = (a, b) if (a, b) in graph.edges else (b, a)
        if s in ids and d in ids:
            rel = graph.edges[(s, d)][0]
            neighbours = any(x == s and y == d for x, y in zip(kinds, kinds[1:], strict=False))
            steps.append(F.struct(F.concat_ws("|", F.lit(s), ids[s], F.lit(rel), F.lit(d), ids[d]).alias("id"), F.lit(rel).alias("rel"), ids[s].alias("source"), ids[d].alias("target"), F.lit(neighbours).alias("positional")))
    links = F.array(*steps) if steps else F.array().cast("array<struct<id:string,rel:string,source:string,target:string,positional:boolean>>")
    entities = F.create_map(*[x for k, i in ids.items() for x in (F.lit(k), i)])
    values = [F.map_filter(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(f"{k}_{c}").cast("string"))]), lambda _, v: v.isNotNull()) for k, columns in (measured or {}).items() if k in ids]
    found = F.filter(F.array(*values), lambda m: F.size(m) > 0) if values else F.array().cast("array<map<string,string>>")
    order = [*ids.values(), *[F.col(f"{k}_{c}") for k, columns in (measured or {}).items() for c in columns]]
    told = numbered(rows, order, "row_index")
    return told.select(
        "row_index", F.struct(nodes.alias("nodes"), links.alias("relationships")).alias("path"), entities.alias("entities"), found.alias("measurements"),
        F.struct(F.array(*ids.values()).alias("node_ids"), F.transform(links, lambda r: r["id"]).alias("relationship_ids"), F.col("row_index").alias("graph_row_index")).alias("provenance"))


def relation_counts(found: DataFrame) -> DataFrame:
    """Distinct relationships of each name over ``evidence_facts`` (A1)."""
    return found.select(F.explode("path.relationships").alias("r")).select("r.rel", "r.id").distinct().groupBy("rel").agg(F.count("*").alias("n"))


def subject_card(profile: DataFrame, nodes: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """The subjects of ``subject_profile`` with their node's attributes; null where no node has the subject.

    Of nodes that share a key the least filled value of each attribute counts. Attributes that the nodes lack are null.
    """
    have = [c for c in attributes if c in nodes.columns]
    filled = nodes.select(F.col(key).cast("string").alias("subject"), *[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).alias(c) for c in have])
    one = filled.groupBy("subject").agg(F.lit(True).alias("known"), *[F.min(c).alias(c) for c in have])
    joined = profile.join(one, "subject", "left")
    return joined.select(*profile.columns, F.coalesce("known", F.lit(False)).alias("known"), *[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in attributes])


def fact_indices(found: DataFrame, part: str, use: str) -> DataFrame:
    """(part key, use, row_index) of every fact, to look up a part's or a use's facts (A2)."""
    return _pairs(found, part, use).select("key", "use", "row_index")


def overview_cards(found: DataFrame, part: str, use: str) -> DataFrame:
    """Per part: facts, distinct uses and distinct nodes of every other type (A3)."""
    rows = _pairs(found, part, use)
    others = rows.select("key", F.explode("path").alias("n")).select("key", "n.type", "n.id").filter(~F.col("type").isin(part, use)).distinct()
    counted = others.groupBy("key", "type").agg(F.count("*").alias("n")).groupBy("key").agg(F.array_sort(F.collect_list(F.concat_ws("=", "type", "n"))).alias("others"))
    cards = rows.groupBy("key").agg(F.min("part").alias("part"), F.count("*").alias("n_facts"), F.count_distinct("use").alias("n_uses"))
    return cards.join(counted, "key", "left").drop("key")


def subject_candidates(found: DataFrame) -> DataFrame:
    """The first fact of each (type, id) (A5)."""
    return found.select("row_index", F.explode("path").alias("n")).groupBy("n.type", "n.id").agg(F.min("row_index").alias("first_index"))


def subject_profile(found: DataFrame, subject: str, part: str, use: str) -> DataFrame:
    """Per subject: facts, distinct parts and uses, and the first fact."""
    e = F.col("entities")
    rows = found.select("row_index", e[subject].alias("subject"), F.lower(e[part]).alias("part"), e[use].alias("use"))
    return rows.groupBy("subject").agg(F.count("*").alias("n_facts"), F.count_distinct("part").alias("n_parts"), F.count_distinct("use").alias("n_uses"), F.min("row_index").alias("first_index"))


def touching(found: DataFrame, kind: str, value: str) -> DataFrame:
    """Facts that have a node."""
    return found.filter(F.exists("path", lambda n: (n["type"] == kind) & (n["id"] == value)))
