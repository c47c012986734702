"""Chat formatting from an event log.

A conversation is a log of events with a sequence number: ``message`` starts a turn, ``delta``
appends streamed text to it, ``edit`` replaces its text, ``regenerate`` empties it so that later
deltas write it anew. The log is partitioned by conversation, sorted by sequence and folded into
final messages turn by turn, which are rendered with a template. Rows stream through the fold: a
task holds the turns of one conversation, never a group of them.

The template marks turns as ``<|turn|>role\\ntext<|end|>\\n``. A control string inside a text gets a
backslash after its first character, one more than it may have already, so unescaping removes
exactly one and gives the text back. Null text and null role count as empty; events of a turn that
has no message yet start it; ties in sequence are broken by turn, kind and text. A message of a turn
that is already there is one more turn: a table's repeated rows count each, as do rows that repeat
a turn with another role or text. Rows without a conv_id are one conversation. An empty log gives an empty result; extra
columns are ignored, whatever their names and types.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>"
CONTROLS = [TURN, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>"]
_ANY = "|".join(f"({re.escape(c[0])})(\\\\*)({re.escape(c[1:])})" for c in CONTROLS)
_RAW, _DONE = re.compile(_ANY), re.compile(_ANY.replace("(\\\\*)", "\\\\(\\\\*)"))
_ORDER = {"graphloom.log_order": True}  # marks the column that orders the events of one turn in the logs made here
_PARTS = re.compile(r"<\|turn\|>([^\n]*)\n(.*?)<\|end\|>\n", re.S)


def escape(text: str) -> str:
    """The text with a backslash put into each control string."""
    if "<" not in text and "[" not in text:  # every control string begins with one of them
        return text
    return _RAW.sub(lambda m: "{0}\\{1}{2}".format(*[g for g in m.groups() if g is not None]), text)


def unescape(text: str) -> str:
    """The inverse of ``escape``."""
    if "\\" not in text:
        return text
    return _DONE.sub(lambda m: "{0}{1}{2}".format(*[g for g in m.groups() if g is not None]), text)


def _role(role: str) -> str:
    """A role on one line: line breaks and backslashes are written as escapes."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_back(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(role: str, text: str) -> tuple[str, tuple[int, int] | None]:
    """One formatted turn, and where in it the loss applies (an assistant's text)."""
    head, body = f"{TURN}{_role(role)}\n", escape(text)
    return f"{head}{body}{END}\n", (len(head), len(head) + len(body)) if role == "assistant" else None


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts back from formatted turns."""
    return [(_role_back(role), unescape(text)) for role, text in _PARTS.findall(formatted)]


def turn_events(conversations: DataFrame) -> DataFrame:
    """A table of turns as a log: each turn starts as a message without text and streams in as one delta.

    ``_within`` keeps the two events of a row together where rows share a turn.
    """
    kinds = F.explode(F.array(F.lit("message"), F.lit("delta")))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long").alias("turn"), "role", "text", F.xxhash64("role", "text").alias("_tie"))
    rows = rows.select("*", kinds.alias("kind"))
    return rows.select("conv_id", F.col("turn").alias("seq"), "kind", "turn", "role", F.when(F.col("kind") == "delta", F.col("text")).alias("text"), F.struct("_tie").alias("_within", metadata=_ORDER))


def streamed_events(conversations: DataFrame) -> DataFrame:
    """A table of turns as the log of a streaming chat, by a hash of each row.

    A third of the turns streams in as several deltas, a third begins with a draft that is regenerated before the
    deltas of its text, and a third with a draft that an edit replaces. What is folded from it is the table.
    """
    text = F.coalesce("text", F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long").alias("turn"), "role", text.alias("t"))
    rows = rows.withColumn("_tie", F.xxhash64("role", "t")).withColumn("_row", F.monotonically_increasing_id())
    third = (F.char_length("t") / 3).cast("int") + 1
    part = lambda i: F.substring(F.col("t"), i * third + 1, third)
    event = lambda kind, said=None: F.struct(F.lit(kind).alias("kind"), (F.lit(None).cast("string") if said is None else said).alias("text"))
    begin, deltas = event("message"), [event("delta", part(i)) for i in range(3)]
    draft = event("delta", F.concat(F.lit("draft "), F.reverse("t")))
    kind = F.pmod("_tie", F.lit(3))
    log = F.when(kind == 0, F.array(begin, *deltas)).when(kind == 1, F.array(begin, draft, event("regenerate"), *deltas)).otherwise(F.array(begin, draft, event("edit", F.col("t"))))
    rows = rows.select("conv_id", "turn", "role", "_tie", "_row", F.posexplode(log).alias("_step", "e"))
    return rows.select("conv_id", F.col("turn").alias("seq"), "e.kind", "turn", "role", "e.text", F.struct("_tie", "_row", "_step").alias("_within", metadata=_ORDER))


def _folded(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[int | None, list[list[str]]]]:
    """Each conversation with its turns [role, text parts...], in order of first event.

    A turn's deltas go to its oldest message that waits for its first one, else to the newest begun.
    """
    conv, started = None, False
    turns: list[list[str]] = []
    newest: dict[int | None, list[str]] = {}
    waiting: dict[int | None, deque[list[str]]] = {}
    for frame in frames:
        columns = (frame[c].tolist() for c in ("conv_id", "kind", "turn", "role", "text"))
        for key, kind, turn, role, text in zip(*columns, strict=True):
            key, turn = None if pd.isna(key) else int(key), None if pd.isna(turn) else int(turn)
            if started and key != conv:
                yield conv, turns
                turns, newest, waiting = [], {}, {}
            conv, started = key, True
            if kind == "message" or turn not in newest:
                state = newest[turn] = [role or ""]
                turns.append(state)
                if kind == "message" and not text:
                    waiting.setdefault(turn, deque()).append(state)
            elif kind == "delta" and waiting.get(turn):
                state = newest[turn] = waiting[turn].popleft()
            else:
                state = newest[turn]
            if kind in ("edit", "regenerate"):
                del state[1:]
            if role and not state[0]:
                state[0] = role
            if text:
                state.append(text)
    if started:
        yield conv, turns


def _over_conversations(events: DataFrame, make: Callable[[int | None, list[tuple[str, str]]], tuple], schema: str, names: list[str]) -> DataFrame:
    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for conv, turns in _folded(frames):
            rows.append(make(conv, [(t[0], "".join(t[1:])) for t in turns]))
            if len(rows) >= 500:
                yield pd.DataFrame(rows, columns=names)
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names)

    own = [F.col(f"`{f.name}`") for f in events.schema.fields if f.metadata.get("graphloom.log_order")]
    columns = [F.col(c) for c in ("conv_id", "seq", "kind", "turn", "role", "text")]
    log = events.select(*columns, (own[0] if own else F.lit(0)).alias("_within"), F.col("kind").isin("delta", "edit").cast("int").alias("_later"))
    log = log.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "turn", "_within", "_later", "text")
    return log.select("conv_id", "kind", "turn", "role", "text").mapInPandas(fold, schema)


def format_conversations(events: DataFrame) -> DataFrame:
    """conv_id, formatted text and loss spans (start, end in code points) of each conversation."""

    def make(conv: int | None, turns: list[tuple[str, str]]) -> tuple:
        parts, spans, at = [], [], 0
        for role, text in turns:
            part, span = render(role, text)
            if span:
                spans.append([at + span[0], at + span[1]])
            parts.append(part)
            at += len(part)
        return conv, "".join(parts), spans

    return _over_conversations(events, make, "conv_id long, formatted string, loss_spans array<array<long>>", ["conv_id", "formatted", "loss_spans"])


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations: turns, hashes and loss figures."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for conv, text, spans in zip(frame["conv_id"], frame["formatted"], frame["loss_spans"], strict=True):
                turns = parse(text)
                whole, loss = hashlib.sha256(), hashlib.sha256()
                for role, said in turns:
                    whole.update(f"{role}\n{said}\n".encode())
                masked = [unescape(text[a:b]) for a, b in spans]
                for said in masked:
                    loss.update(said.encode())
                rows.append((None if pd.isna(conv) else int(conv), len(turns), whole.hexdigest(), sum(map(len, masked)), loss.hexdigest(), len(text)))
            yield pd.DataFrame(rows, columns=names)

    return formatted.mapInPandas(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
