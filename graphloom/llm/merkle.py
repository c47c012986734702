"""Merkle manifest of a dataset, with octopus multiproofs.

Every row is a leaf, the SHA-256 of its fields. The leaves of a source, in order of doc_id, are the bottom
of a tree in which every ``FAN`` neighbours hash into one node; the sources' roots are the leaves of one more
tree, whose root stands for the whole dataset. All digests are lowercase hex and are hashed as such text.

The leaves lie in bounded partitions of neighbours. A partition does not fetch the path of each of its leaves:
it works out which node coordinates its leaves together need and cannot derive (``missing``), fetches these
once, hashes the interior nodes that its leaves share once, and expands the single proofs from them.

A null field is ``-``, any other its UTF-8 byte count, a colon and its value, so no two rows of different
fields share a leaf. Rows that repeat are leaves of their own; rows of one doc_id are ordered by their leaf
(equal leaves are alike). A null doc_id comes first, a null source is a source of its own and the first.
An empty table has no root and gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import scratch
from graphloom.sources.tables import numbered

FAN = 16
LEAVES = 8192  # leaves whose proofs are made together
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_WIDE = 64  # hex digits of a digest
_TOP = -1  # number of the tree over the sources


@dataclass(frozen=True)
class Manifest:
    """``leaves`` (doc_id, source, leaf, changed, tree, place, size, part, chunk), ``nodes`` (tree, level, place, size, digest), number of sources."""

    leaves: DataFrame
    nodes: DataFrame
    n_sources: int

    def roots(self) -> DataFrame:
        """(tree, digest) of every source's subroot, and of the root as tree -1."""
        return self.nodes.filter("size = 1").select("tree", "digest")


def leaf(fields: list[Column]) -> Column:
    """The digest of a row's fields."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*parts), 256)


def level_sizes(n: int) -> list[int]:
    """Nodes of each level of a tree of ``n`` leaves."""
    sizes = [n]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // FAN))
    return sizes


def _place(rows: DataFrame) -> tuple[DataFrame, int]:
    """The leaves with their tree, place and partition, and the number of sources."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("source"), F.col("doc_id"), F.col("leaf")]
    dealt = scratch.table(scratch.table(rows, "leaves").repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "leaves")
    runs = dealt.groupBy("part", "source").agg(F.count("*").alias("run"))
    upto = lambda w: F.coalesce(F.sum("run").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.withColumns({"before": upto(Window.partitionBy("source").orderBy("part")), "first": upto(Window.partitionBy("part").orderBy("source")), "size": F.sum("run").over(Window.partitionBy("source"))})
    sources = scratch.table(numbered(dealt.select("source").distinct(), [F.col("source")], "tree"), "sources")
    runs = runs.join(sources.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).select(F.col("part").alias("_part"), F.col("source").alias("_source"), "before", "first", "size", "tree")
    at = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    placed = dealt.withColumn("at", at).join(runs, (F.col("part") == F.col("_part")) & F.col("source").eqNullSafe(F.col("_source")))
    place = F.col("at") - F.col("first") + F.col("before")
    return scratch.table(placed.select("doc_id", "source", "leaf", "changed", "tree", place.alias("place"), "size", "part", F.floor(F.col("at") / LEAVES).alias("chunk")), "leaves"), sources.count()


def _grow(level: DataFrame, longest: int) -> list[DataFrame]:
    """All levels of the trees whose lowest is ``level`` (tree, place, size, digest)."""
    out = [level.withColumn("level", F.lit(0))]
    for depth in range(1, len(level_sizes(longest))):
        runs = out[-1].filter("size > 1").groupBy("tree", F.floor(F.col("place") / FAN).alias("place"))
        ordered = F.array_sort(F.collect_list(F.struct(F.col("place").alias("p"), F.col("digest").alias("d"))))
        up = runs.agg(F.ceil(F.first("size") / FAN).alias("size"), F.sha2(F.array_join(F.transform(ordered, lambda x: x["d"]), ""), 256).alias("digest"))
        out.append(scratch.table(up.withColumn("level", F.lit(depth)), "nodes"))
    return out


def manifest(docs: DataFrame, fields: list[str] | None = None, changes: dict[str, Column] | None = None, when: Column | None = None) -> Manifest:
    """The trees over all rows of a table with doc_id and source.

    ``changes`` are other values of fields: where ``when`` holds, the leaf of the row so changed is kept beside its own, for ``checked``.
    """
    fields = fields or FIELDS
    plain = {c: F.col(f"`{c}`") for c in fields}
    other = F.when(when, leaf([(changes or {}).get(c, plain[c]) for c in fields])) if when is not None else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), leaf(list(plain.values())).alias("leaf"), other.alias("changed"))
    leaves, n_sources = _place(rows)
    longest = leaves.agg(F.max("size")).first()[0] or 0
    trees = _grow(leaves.select("tree", "place", "size", F.col("leaf").alias("digest")), longest)
    subroots = scratch.table(_union(trees).filter("size = 1").select(F.lit(_TOP).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(n_sources).cast("long").alias("size"), "digest"), "nodes")
    return Manifest(leaves, _union([*trees, *_grow(subroots, n_sources)]), n_sources)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = None
    for p in parts:
        p = p.select("tree", F.col("level").cast("int").alias("level"), F.col("place").cast("long").alias("place"), F.col("size").cast("long").alias("size"), "digest")
        out = p if out is None else out.unionByName(p)
    return out


def missing(held: list[int], n: int) -> list[tuple[int, int]]:
    """The fewest (level, place) beyond the held leaves from which the proofs of all of them follow."""
    out, have = [], set(held)
    for level, size in enumerate(level_sizes(n)[:-1]):
        runs = {p // FAN for p in have}
        out += [(level, p) for r in sorted(runs) for p in range(FAN * r, min(FAN * (r + 1), size)) if p not in have]
        have = runs
    return out


class _Tree:
    """The runs of digests on the paths of some leaves, each interior node hashed once."""

    def __init__(self, n: int, held: list[int], known: dict[tuple[int, int], str]) -> None:
        self.runs: list[dict[int, str]] = []
        have = set(held)
        for level, size in enumerate(level_sizes(n)[:-1]):
            here = {r: "".join(known[level, p] for p in range(FAN * r, min(FAN * (r + 1), size))) for r in {p // FAN for p in have}}
            known |= {(level + 1, r): _sha(text) for r, text in here.items()}
            self.runs.append(here)
            have = set(here)
        self.root = known[len(self.runs), 0]

    def steps(self, place: int) -> list[tuple[str, str]]:
        """The digests left and right of the path's node, level by level."""
        out = []
        for here in self.runs:
            text, at = here[place // FAN], place % FAN * _WIDE
            out.append((text[:at], text[at + _WIDE :]))
            place //= FAN
        return out


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _held(table: pa.Table) -> dict[int, tuple[int, list[int]]]:
    """Of each tree its size and the places held."""
    out: dict[int, tuple[int, list[int]]] = {}
    for tree, place, size in zip(*(table.column(c).to_pylist() for c in ("tree", "place", "size")), strict=True):
        out.setdefault(tree, (size, []))[1].append(place)
    return out


def _expanded(m: Manifest, rows: Callable[..., tuple], schema: str) -> DataFrame:
    """``rows(leaf, changed, subroot, root, steps)`` of each leaf, beside its doc_id; its partition fetches what it misses once."""
    n_sources = m.n_sources
    asked = "part int, chunk long, tree long, level int, place long"

    def ask(table: pa.Table) -> pa.Table:
        part, chunk = table.column("part")[0].as_py(), table.column("chunk")[0].as_py()
        held = _held(table)
        want = [(t, level, p) for t, (size, places) in held.items() for level, p in missing(places, size)]
        want += [(_TOP, level, p) for level, p in missing(list(held), n_sources)]
        tree, level, place = (pa.array([w[i] for w in want], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.int64())))
        return pa.table({"part": pa.array([part] * len(want), pa.int32()), "chunk": pa.array([chunk] * len(want), pa.int64()), "tree": tree, "level": level, "place": place})

    def expand(table: pa.Table, fetched: pa.Table) -> pa.Table:
        known: dict[int, dict[tuple[int, int], str]] = {}
        for tree, level, place, digest in zip(*(fetched.column(c).to_pylist() for c in ("tree", "level", "place", "digest")), strict=True):
            known.setdefault(tree, {})[level, place] = digest
        for tree, place, digest in zip(*(table.column(c).to_pylist() for c in ("tree", "place", "leaf")), strict=True):
            known.setdefault(tree, {})[0, place] = digest
        held = _held(table)
        trees = {t: _Tree(size, places, known[t]) for t, (size, places) in held.items()}
        top = _Tree(n_sources, list(held), known.get(_TOP, {}) | {(0, t): tree.root for t, tree in trees.items()})
        upper = {t: top.steps(t) for t in held}
        columns = zip(*(table.column(c).to_pylist() for c in ("doc_id", "tree", "place", "leaf", "changed")), strict=True)
        out = [(doc_id, *rows(own, changed, trees[t].root, top.root, trees[t].steps(place) + upper[t])) for doc_id, t, place, own, changed in columns]
        return pa.Table.from_pylist([dict(zip(names, row, strict=True)) for row in out], target)

    spark = m.leaves.sparkSession
    result = spark.createDataFrame([], schema)
    names, target = result.columns, pa.schema([pa.field(f.name, _ARROW[f.dataType.simpleString()]) for f in result.schema])
    slim = m.leaves.select("part", "chunk", "doc_id", "tree", "place", "size", "leaf", "changed")
    coordinates = slim.select("part", "chunk", "tree", "place", "size").groupBy("part", "chunk").applyInArrow(ask, asked)
    fetched = coordinates.join(m.nodes.select("tree", "level", "place", "digest"), ["tree", "level", "place"]).select("part", "chunk", "tree", "level", "place", "digest")
    return slim.groupBy("part", "chunk").cogroup(fetched.groupBy("part", "chunk")).applyInArrow(expand, schema)


_STEPS = "array<struct<left:string,right:string>>"
_ARROW = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), _STEPS: pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))}


def fold(own: str, steps: list[tuple[str, str]]) -> str:
    """The root that a leaf and its steps give."""
    for left, right in steps:
        own = _sha(left + own + right)
    return own


def checked(m: Manifest) -> DataFrame:
    """Of each leaf the digest of its proof, and the root folded from its changed leaf (else its own) with the original siblings."""

    def rows(own: str, changed: str | None, subroot: str, root: str, steps: list[tuple[str, str]]) -> tuple:
        folded = fold(changed or own, steps)
        return own, subroot, root, _sha("".join(a + b for a, b in steps)), folded, folded == root

    return _expanded(m, rows, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def proofs(m: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root and the whole proof of each leaf: ``steps``, the digests left and right of its path."""

    def rows(own: str, changed: str | None, subroot: str, root: str, steps: list[tuple[str, str]]) -> tuple:
        return own, subroot, root, [{"left": a, "right": b} for a, b in steps]

    return _expanded(m, rows, f"doc_id long, leaf string, subroot string, root string, steps {_STEPS}")


def folded(own: Column, steps: Column) -> Column:
    """The root that a leaf and its stored proof give, to check a row without the manifest."""
    return F.aggregate(steps, own, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


_CRC = "xor(list_reduce(list_prepend(4294967295::UBIGINT, {0}), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1::UBIGINT)))), 4294967295::UBIGINT)"


def crc32_sql(text: str) -> str:
    """DuckDB expression for the unsigned CRC-32 of a text's UTF-8 bytes."""
    return _CRC.format(f"list_transform(range(1, 2 * octet_length(encode({text})), 2), lambda i: ('0x' || substr(hex(encode({text})), i, 2))::UBIGINT)")


def oracle_sql(levels: int = 6) -> str:
    """DuckDB SQL of the manifest query, for sources of at most ``FAN ** levels`` rows."""
    field = lambda c: f"coalesce(octet_length(encode(({c})::VARCHAR))::VARCHAR || ':' || ({c})::VARCHAR, '-')"
    own = lambda text: f"sha256({' || '.join(field(c) for c in [*FIELDS[:-1], text])})"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [f"""l AS (SELECT doc_id, source, {own('text')} AS leaf, CASE WHEN doc_id IS NOT NULL AND {crc32_sql('doc_id::VARCHAR')} % 5 = 0 THEN {own(lower)} ELSE {own('text')} END AS changed FROM documents),
s AS (SELECT source, count(*) AS size, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS tree FROM l GROUP BY source),
a0 AS (SELECT doc_id, leaf, changed, tree, size, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM l JOIN s ON l.source IS NOT DISTINCT FROM s.source)"""]

    def grow(name: str, first: str) -> list[str]:
        out = [f"{name}0 AS ({first})"]
        for i in range(levels):
            n = f"ceil(size / {FAN}.0)::BIGINT"
            out.append(f"{name}{i + 1} AS (SELECT tree, place // {FAN} AS place, CASE WHEN any_value(size) = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY place)) END AS digest, any_value({n}) AS size FROM {name}{i} GROUP BY tree, place // {FAN})")
        return out

    def walk(to: str, start: str, name: str) -> list[str]:
        out, before = [], start
        for i in range(levels):
            left, right = (f"coalesce((SELECT string_agg(digest, '' ORDER BY n.place) FROM {name}{i} n WHERE n.tree = r.tree AND n.place // {FAN} = r.place // {FAN} AND n.place {sign} r.place), '')" for sign in "<>")
            out.append(f"{to}{i + 1}l AS (SELECT *, CASE WHEN size = 1 THEN '' ELSE {left} END AS lt, CASE WHEN size = 1 THEN '' ELSE {right} END AS rt FROM {before} r)")
            out.append(f"{to}{i + 1} AS (SELECT doc_id, leaf, tree, source_tree, place // {FAN} AS place, ceil(size / {FAN}.0)::BIGINT AS size, proof || lt || rt AS proof, CASE WHEN size = 1 THEN folded ELSE sha256(lt || folded || rt) END AS folded FROM {to}{i + 1}l)")
            before = f"{to}{i + 1}"
        return out

    steps += grow("t", "SELECT tree, place, leaf AS digest, size FROM a0")
    steps += grow("u", f"SELECT 0 AS tree, tree AS place, digest, (SELECT count(*) FROM s) AS size FROM t{levels}")
    steps += ["w AS (SELECT doc_id, leaf, tree, tree AS source_tree, place, size, '' AS proof, changed AS folded FROM a0)"]
    steps += walk("p", "w", "t")
    steps += [f"v AS (SELECT doc_id, leaf, 0 AS tree, source_tree, source_tree AS place, (SELECT count(*) FROM s) AS size, proof, folded FROM p{levels})"]
    steps += walk("q", "v", "u")
    return "WITH " + ",\n".join(steps) + f"""
SELECT doc_id, leaf, t.digest AS subroot, u.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = u.digest AS verified FROM q{levels} q JOIN t{levels} t ON t.tree = source_tree CROSS JOIN u{levels} u"""
