"""The canonical merge as a stateful stream: each identity keeps its canonical id from batch to batch.

State is held by identity and starts from the published store, so a new checkpoint forgets nothing. A batch costs what
its own rows cost: new nodes and new id pairs are appended to a log, the store is the published table and the log, and nothing
is rewritten. Repeated and late rows add nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain, islice
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


PART = 256  # raw ids that are told in one piece of state
CHUNK = 4096  # rows of one identity that are held at once


class _Identity(StatefulProcessor):
    """The canonical id of one identity, the raw ids already told, and those that wait for the end of its first batch.

    Each call for a piece of state is a trip to the JVM, so told ids are kept in parts of about ``PART``, dealt by their checksum: the first part
    stands beside the canonical id, the others in a map. When the parts are full, each is split in two.
    """

    def __init__(self, values: list[str], part: int = PART, chunk: int = CHUNK) -> None:
        self.values, self.part, self.chunk = values, part, chunk

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "canonical_id string, n long, parts int, raw_ids array<string>")
        self.more = handle.getMapState("more", "part int", "raw_ids array<string>")
        self.waiting = handle.getListState("waiting", "raw_id string")

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        known = (initialState["canonical_id"], initialState["n"], initialState["parts"])
        if initialState["part"] == 0:
            self.known.update((*known, initialState["raw_ids"]))
            return
        self.more.updateValue((initialState["part"],), (initialState["raw_ids"],))
        if not self.known.exists():
            self.known.update((*known, []))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        known, n, parts, told = self.known.get() or (None, 0, 1, [])
        before, first, held, waits = n, None, [], False
        while chunk := list(islice(rows, self.chunk)):
            asked = {}
            for row in chunk:
                if known is None and (first is None or self._order(row) < self._order(first)):
                    first = row
                asked.setdefault(_part(row["raw_id"], parts), {})[row["raw_id"]] = None
            new = []
            for part, raws in asked.items():
                have = told if part == 0 else self._more(part)
                seen = set(have)
                fresh = [raw for raw in raws if raw not in seen]
                new += fresh
                if part == 0:
                    told = [*have, *fresh]
                elif fresh:
                    self.more.updateValue((part,), ([*have, *fresh],))
            n += len(new)
            while n > self.part * parts:
                told, parts = self._split(told, parts), 2 * parts
            if known is not None:
                for raw in new:
                    yield self._row(key, raw, known, None)
            else:
                if held:
                    self.waiting.appendList([(raw,) for raw in held])
                    waits = True
                held = new
        if n > before or first is not None:
            self.known.update((known if first is None else first["raw_id"], n, parts, told))
        if first is not None:
            for raw in chain((raw for (raw,) in self.waiting.get()) if waits else (), held):
                yield self._row(key, raw, first["raw_id"], first if raw == first["raw_id"] else None)
            if waits:
                self.waiting.clear()

    def _more(self, part: int) -> list[str]:
        found = self.more.getValue((part,))
        return found[0] if found else []

    def _split(self, told: list[str], parts: int) -> list[str]:
        """Deal each part's ids to it and the one ``parts`` further; gives the first part."""
        for part in range(parts):
            have = told if part == 0 else self._more(part)
            stay, go = ([raw for raw in have if _part(raw, 2 * parts) == at] for at in (part, part + parts))
            if go:
                self.more.updateValue((part + parts,), (go,))
                if part:
                    self.more.updateValue((part,), (stay,))
            if part == 0:
                first = stay
        return first

    def _order(self, row: Row) -> tuple:
        return row["raw_id"], [(row[v] is not None, str(row[v])) for v in self.values]

    def _row(self, key: Any, raw: str, canonical: str, node: Row | None) -> Row:
        return Row(identity=key[0], raw_id=raw, canonical_id=canonical, added=node is not None, **{v: node[v] if node else None for v in self.values})


def _part(raw: str | None, parts: int) -> int:
    return 0 if parts == 1 else zlib.crc32((raw or "").encode()) % parts


def canonical_stream(rows: DataFrame, published: DataFrame, key: str, identity: Column, values: list[str]) -> DataFrame:
    """New id pairs of a stream of nodes: identity, raw_id, canonical_id, and on the rows that ``added`` a node its values.

    ``published`` (identity, raw_id, canonical_id) is the state to start from, the id pairs of the store; the least raw id of
    an identity's first batch becomes its canonical id. A row without identity is an error. Only distinct raw ids are kept.
    """
    blank = F.coalesce(identity.cast("string"), F.lit("")) == ""
    keyed = rows.select(F.when(blank, F.raise_error(F.lit("a row without identity"))).otherwise(identity.cast("string")).alias("identity"), F.col(key).cast("string").alias("raw_id"), *values)
    kinds = {f.name: f for f in keyed.schema}
    out = StructType().add("identity", "string").add("raw_id", "string").add("canonical_id", "string").add("added", "boolean")
    for v in values:
        out = out.add(v, kinds[v].dataType, True)
    given = published.select(F.col("identity").cast("string"), F.col("raw_id").cast("string"), F.col("canonical_id").cast("string"))
    one = given.groupBy("identity").agg(F.min("canonical_id").alias("canonical_id"), F.count_distinct(F.struct("raw_id")).alias("n"))
    one = one.withColumn("parts", F.pow(F.lit(2), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / PART)))).cast("int"))
    part = F.pmod(F.crc32(F.coalesce("raw_id", F.lit("")).cast("binary")), F.col("parts")).cast("int").alias("part")
    dealt = given.select("identity", "raw_id").distinct().join(one, "identity").groupBy("identity", "canonical_id", "n", "parts", part)
    start = dealt.agg(F.transform(F.collect_list(F.struct("raw_id")), lambda x: x["raw_id"]).alias("raw_ids")).groupBy("identity")
    return keyed.groupBy("identity").transformWithState(_Identity(values), out, "Append", "None", initialState=start)


def append_to_log(pairs: DataFrame, log: str, checkpoint: str) -> StreamingQuery:
    """Start the stream into its log, over all that is there."""
    conf = pairs.sparkSession.conf
    before = conf.get(PROVIDER)
    conf.set(PROVIDER, ROCKSDB)
    try:
        return pairs.writeStream.format("parquet").option("path", log).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        conf.set(PROVIDER, before)


def id_pairs(published: DataFrame, log: DataFrame) -> DataFrame:
    """(identity, raw_id, canonical_id) of the published store and its log: the state of the next start."""
    columns = ["identity", "raw_id", "canonical_id"]
    return published.select(*columns).unionByName(log.select(*columns)).distinct()
