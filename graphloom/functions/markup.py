"""Records inside markup: table rows of pages, values anywhere in JSON, fields of XML."""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.clean import let as _let
from graphloom.sources.tables import stored

HEADER_ROWS = 5  # rows of a table among which its header is sought
# The most columns and rows that a cell may cover in HTML.
MOST_COLS, MOST_ROWS = 1000, 65534
# Keys that hold a JSON-LD object's text, in order of preference.
VALUE_KEYS = ("@value", "value")
LABEL_KEYS = ("prefLabel", "preferredTerm", "label", "name")
# Character entities; the ampersand comes last.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}
CELLS = 1 << 16  # cells of grids that a task holds before it passes them on
SHORT = 100  # characters of a cell that is read once for all that are like it
_TABLE = re.compile(r"(?i)</?table\b")
# Tags of tables and rows lose what stands in them; one without an end is text up to the next of them.
_BARE = re.compile(r"(?i)(?:^</?table|(<tr))\b[^<>]*(?:<(?!/?tr\b)[^<>]*)*>")
_ROW = re.compile(r"(?i)<tr\b([^<]*(?:<(?!/?tr\b)[^<]*)*)")
_CELL = re.compile(r"(?is)<t[hd]\b[^>]*>[^<]*(?:<(?!t[hd]\b|/t[hd]>)[^<]*)*")
_TAG, _SPACE = re.compile("<[^>]*>"), re.compile(r"(?a:[\s\u00a0]+)")
_SPANS = [re.compile(rf"(?ai:\s{name}\s*=\s*[\"']?\s*(\d{{1,9}}))") for name in ("colspan", "rowspan")]


def cell_text(html: str) -> str:
    """Text of a piece of HTML: tags become spaces, common entities characters, white space collapses."""
    out = _TAG.sub(" ", html).strip(" ") if "<" in html else html
    if out.isalnum():
        return out
    if "&" in out:
        for entity, text in ENTITIES.items():
            out = out.replace(entity, text)
    return _SPACE.sub(" ", out).strip(" ")


def _cell(html: str) -> tuple[str, int, int]:
    """A cell's text and how many columns and rows it covers."""
    tag, _, text = html.partition(">")
    cols = rows = 1
    if "span" in tag.lower():
        cols, rows = (int(found[1]) if (found := span.search(tag)) else 1 for span in _SPANS)
        cols, rows = max(1, min(MOST_COLS, cols)), min(MOST_ROWS, rows or MOST_ROWS)
    return cell_text(text), cols, rows


_short_cell = functools.lru_cache(1 << 14)(_cell)


def _grid(rows: list[list[tuple[str, int, int]]]) -> list[list[str | None]]:
    """Rows of cells as rows of texts: a cell stands in each column and row that it covers, others take the next free columns."""
    if all(cols == n == 1 for cells in rows for _, cols, n in cells):
        return [[text for text, _, _ in cells] for cells in rows if cells]
    grid, hung = [], []  # hung, by column: the text of the last row's cell and how many rows it still covers
    for cells in rows:
        own = [(text, n) for text, cols, n in cells for _ in range(cols)]
        line, free = [], iter(own)
        for above in hung:
            line.append(above if above[1] > 0 else next(free, (None, 0)))
        line += free
        while line and line[-1][0] is None:
            line.pop()
        hung = [(text, left - 1) for text, left in line]
        if line:
            grid.append([text for text, _ in line])
    return grid


def _grids(page: str) -> list[list[list[str | None]]]:
    """The grids of a page's tables in the order of their opening tags; of a table without cells an empty one."""
    tables, opened = [], []  # the tables' pieces of text, without inner tables; the tables that are open
    cuts = [tag.start() for tag in _TABLE.finditer(page)]
    for i, j in zip(cuts, [*cuts[1:], len(page)], strict=True):
        if page[i + 1] != "/":
            opened.append([])
            tables.append(opened[-1])
        elif opened:
            opened.pop()
        if opened:
            opened[-1].append(_BARE.sub(r"\1 ", page[i:j]))
    cell = lambda c: _short_cell(c) if len(c) <= SHORT else _cell(c)
    return [_grid([[cell(c) for c in _CELL.findall(row)] for row in _ROW.findall("".join(table))]) for table in tables]


def html_grids(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, table_no, grid): the tables of pages in the order of their opening tags, as rows of cell texts.

    Tags nest as they stand: a table inside a cell is a table of its own and leaves that cell's text; one without an end goes to the end
    of its page, an end without a start counts for nothing. A cell over several columns or rows has its text in each of them (a
    rowspan of 0 goes to the last row, spans end at the bounds of the HTML standard). Cells outside a row, rows outside a table and
    rows without cells are left out; tables in comments and scripts are none. Pages without a table, empty or null, give no rows; each of
    several pages with one key gives its own. A page is taken apart where it lies: nothing is shuffled or stored.
    """
    page = F.regexp_replace(F.col(f"`{html}`"), "(?is)<!--.*?-->|<(script|style)\\b.*?</\\1>", " ")
    cut = pages.select(F.col(f"`{key}`").alias("key"), page.alias("page")).filter(F.rlike("page", F.lit("(?i)<table\\b")))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0

        def out(keys: pa.Array) -> pa.RecordBatch:
            at, table_no, grid = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([keys.take(pa.array(at)), pa.array(table_no, pa.int64()), pa.array(grid, pa.list_(pa.list_(pa.string())))], ["key", "table_no", "grid"])

        for batch in batches:
            for i, page in enumerate(batch.column("page")):
                for n, grid in enumerate(_grids(page.as_py())):
                    if grid:
                        rows.append((i, n, grid))
                        size += sum(map(len, grid))
                if size >= CELLS:
                    yield out(batch.column("key"))
                    rows, size = [], 0
            if rows:
                yield out(batch.column("key"))
                rows, size = [], 0

    schema = T.StructType([cut.schema["key"], T.StructField("table_no", T.LongType()), T.StructField("grid", T.ArrayType(T.ArrayType(T.StringType())))])
    return cut.mapInArrow(told, schema).withColumnRenamed("key", key)


def html_rows(pages: DataFrame, key: str, html: str, required: str, columns: dict[str, list[str]]) -> DataFrame:
    """Rows below the header of every table that names the required column.

    ``columns`` gives each output column its accepted header texts; the header is the first of a
    table's first rows with the required one. Gives the key, table_no, row_no and the columns; a
    column that a table lacks, and a cell that a row lacks, is null. Whole pages are read, tables as ``html_grids`` gives them.
    """
    place = lambda low, names: F.coalesce(F.array_min(F.filter(F.array(*[F.array_position(low, n.lower()) for n in names]), lambda p: p > 0)), F.lit(0))
    grids = html_grids(pages, key, html).withColumnRenamed("grid", "_grid")
    tops = F.transform(F.slice("_grid", 1, HEADER_ROWS), lambda r, i: _let(F.transform(r, F.lower), lambda low: F.struct((i + 1).alias("at"), *[place(low, names).alias(c) for c, names in columns.items()])))
    head = F.try_element_at(F.filter(tops, lambda t: t[required] > 0), F.lit(1))
    found = grids.select(key, "table_no", "_grid", F.explode(F.filter(F.array(head), lambda h: h.isNotNull())).alias("_head"))
    below = found.select(key, "table_no", "_head", F.posexplode(F.slice("_grid", F.col("_head.at") + 1, F.size("_grid"))).alias("row_no", "_row"))
    cell = lambda c: F.when(F.col(f"_head.{c}") > 0, F.try_element_at("_row", F.col(f"_head.{c}").cast("int")))
    return below.select(key, "table_no", "row_no", *[cell(c).alias(c) for c in columns])


def html_links(html: Column) -> Column:
    """Targets of a page's links, in order."""
    return F.regexp_extract_all(html, F.lit('(?i)<a\\s[^>]*?href="([^"]*)"'), F.lit(1))


def _parsed(text: str | None) -> object:
    try:
        return None if text is None else json.loads(text)
    except ValueError:
        return text


def _plain(value: object) -> str:
    if value is None:
        return ""
    if isinstance(value, list):
        return "; ".join(dict.fromkeys(filter(None, map(_plain, value))))
    if isinstance(value, dict):
        held = next((k for k in VALUE_KEYS if k in value), None)
        return _plain(value[held]) if held else next(filter(None, (_plain(value[k]) for k in LABEL_KEYS if k in value)), "")
    text = " ".join(str(value).split())
    inner = _parsed(text) if text[:1] + text[-1:] in ("{}", "[]") else text
    return text if isinstance(inner, str) else _plain(inner)


def json_text(c: Column) -> Column:
    """Plain text of a JSON-LD value: its value or label, lists joined by ``; `` without repeats; other text as it is."""

    @F.pandas_udf("string")
    def flat(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([_plain(_parsed(t)) for t in texts], dtype="object")

    return flat(c)


def json_values(c: Column, keys: list[str]) -> Column:
    """Values of the keys wherever they stand in a JSON text, as JSON, in reading order; lists give their items."""
    wanted = frozenset(keys)

    def under(node: object) -> Iterator[object]:
        for key, value in node.items() if isinstance(node, dict) else enumerate(node) if isinstance(node, list) else ():
            if key in wanted:
                yield from value if isinstance(value, list) else [value]
            yield from under(value)

    @F.pandas_udf("array<string>")
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[json.dumps(v, ensure_ascii=False) for v in under(_parsed(t))] for t in texts], dtype="object")

    return search(c)


def json_members(rows: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """The values of the keys wherever they stand in a JSON text, one row each; lists give their items.

    Columns: those of ``rows`` but the text, ``place`` (where the value stands, to order by; an object's keys stand in order of
    their names) and ``value`` as JSON. Texts are parsed once and opened level by level, so the work is as deep as the deepest of them
    and stays in Spark. A text that is null or no JSON has no values.
    """
    keep = [c for c in rows.columns if c != text]
    own = [f"_own{i}" for i in range(len(keep))]  # names that the opened members cannot clash with
    spark, out = rows.sparkSession, None
    given = [F.col(f"`{c}`").alias(name) for c, name in zip(keep, own, strict=True)]
    members = lambda df: df.lateralJoin(spark.tvf.variant_explode(F.col("_node").outer()))
    level = stored(rows.select(*given, F.array().cast("array<int>").alias("_place"), F.try_parse_json(F.col(f"`{text}`")).alias("_node")).filter("_node is not null"), "json")
    while level.head(1):
        level = stored(members(level).select(*own, F.concat("_place", F.array("pos")).alias("_place"), F.col("key").alias("_key"), F.col("value").alias("_node")), "json")
        hit = level.filter(F.col("_key").isin(keys))
        is_list = F.startswith(F.schema_of_variant("_node"), F.lit("ARRAY<"))
        plain = hit.filter(~is_list).select(*own, F.col("_place").alias("place"), F.to_json("_node").alias("value"))
        items = members(hit.filter(is_list)).select(*own, F.concat("_place", F.array("pos")).alias("place"), F.to_json("value").alias("value"))
        out = plain.unionByName(items) if out is None else out.unionByName(plain).unionByName(items)
    if out is None:
        out = level.select(*own, F.col("_place").alias("place"), F.lit(None).cast("string").alias("value"))
    return out.toDF(*keep, "place", "value")


def taxon(xml: Column) -> Column:
    """taxonomy_id, scientific_name, distinct common names and status of a taxonomy record; broken XML or no id gives status ERROR."""
    record = F.from_xml(xml, "Taxon STRUCT<TaxId: STRING, ScientificName: STRING, OtherNames: STRUCT<CommonName: ARRAY<STRING>>>, _corrupt_record STRING", {"mode": "PERMISSIVE"})
    # a lambda: trim itself takes a second argument, which would be the index
    names = F.filter(F.array_distinct(F.transform(record["Taxon"]["OtherNames"]["CommonName"], lambda n: F.trim(n))), lambda n: n != "")
    ok = record["_corrupt_record"].isNull() & record["Taxon"]["TaxId"].isNotNull()
    held = lambda v: F.when(ok, v)
    return F.struct(
        held(F.trim(record["Taxon"]["TaxId"])).alias("taxonomy_id"), held(F.trim(record["Taxon"]["ScientificName"])).alias("scientific_name"),
        held(F.coalesce(F.array_join(names, "; "), F.lit(""))).alias("common_names"), F.when(ok, "OK").otherwise("ERROR").alias("status"),
    )


def cast_or_error(value: Column, kind: str) -> Column:
    """Struct of value, status and message: text that isn't of the kind stays as an ERROR row."""
    cast = value.try_cast(kind)
    bad = cast.isNull() & value.isNotNull()
    return F.struct(cast.alias("value"), F.when(bad, "ERROR").otherwise("OK").alias("status"), F.when(bad, F.concat(F.lit(f"not {kind}: "), value)).alias("message"))
