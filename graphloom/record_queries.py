"""Queries of the operators on markup, records and streams; tables and records are made from the given rows by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import clean as C
from graphloom.functions import markup as K
from graphloom.plans import evidence as V
from graphloom.plans import paths as P
from graphloom.queries import _FACTS, Tables, _facts, graph, query
from graphloom.sources import tables as S
from graphloom.streaming import jobs, stateful


@query("SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity)::INT - 1 AS row_no, l_partkey::VARCHAR AS part, l_returnflag || ' & ' || l_linestatus AS state, NULL::VARCHAR AS missing FROM lineitem")
def html_rows(t: Tables) -> DataFrame:
    """Every order as a page with a table of its lines, read back by its header."""
    tags = lambda tag, *cells: F.concat(F.lit("<tr>"), *[x for c in cells for x in (F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>"))], F.lit("</tr>"))
    row = tags("td", F.concat(F.lit("<b>"), F.col("l_partkey").cast("string"), F.lit("</b>")), F.concat("l_returnflag", F.lit(" &amp;\n"), "l_linestatus"))
    lines = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", row.alias("row")))).alias("rows"))
    head = F.concat(F.lit("<table><caption>Lines</caption><tr></tr>"), tags("th", F.lit("Part no"), F.lit("State")))
    pages = lines.select(F.col("l_orderkey").alias("page"), F.concat(F.lit("<html><table><tr><td>menu</td></tr></table>"), head, F.array_join("rows.row", ""), F.lit("</table></html>")).alias("html"))
    return K.html_rows(pages, "page", "html", "part", {"part": ["Part", "Part no"], "state": ["state"], "missing": ["weight"]}).drop("table_no")


@query("""SELECT l_orderkey AS page, 0 AS table_no, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity)::INT - 1 AS row_no, l_partkey::VARCHAR AS part, min(l_returnflag) OVER (PARTITION BY l_orderkey) AS flag FROM lineitem
UNION ALL SELECT l_orderkey, 1, 0, count(*)::VARCHAR, NULL FROM lineitem GROUP BY l_orderkey""")
def html_spans(t: Tables) -> DataFrame:
    """Every order as a page whose first cell hangs over all lines and holds a table of its own."""
    lines = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("rows"), F.min("l_returnflag").alias("flag"))
    n = F.size("rows").cast("string")
    inner = F.concat(F.lit("<table><tr><th>Part</th></tr><tr><td>"), n, F.lit("</table>"))
    hung = F.concat(F.lit("<td ROWSPAN='"), n, F.lit("'>"), "flag", inner, F.lit("</td>"))
    rows = F.transform("rows", lambda r, i: F.concat(F.lit("<tr>"), F.when(i == 0, hung).otherwise(""), F.lit("<td>"), r["l_partkey"].cast("string")))
    page = F.concat(F.lit("<p><table><tr><th>Flag<th>Part</tr>"), F.array_join(rows, "</tr>"), F.lit("</tr></table></p>"))
    return K.html_rows(lines.select(F.col("l_orderkey").alias("page"), page.alias("html")), "page", "html", "part", {"part": ["part"], "flag": ["flag"]})


@query("""SELECT url, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS url FROM pages) GROUP BY url""")
def html_links(t: Tables) -> DataFrame:
    return t.pages.select(F.explode(K.html_links(F.col("html"))).alias("url")).groupBy("url").agg(F.count("*").alias("n"))


@query("SELECT event_id, event_type || '; ' || user_id AS label, (props ->> '$.k')::BIGINT AS k, event_type = 'error' AS n_two FROM events")
def json_search(t: Tables) -> DataFrame:
    """JSON-LD labels and keys at any depth, in records made from the events."""
    kind = F.create_map(F.lit("@language"), F.lit("en"), F.lit("@value"), F.col("event_type"))
    label = F.concat(F.lit("["), F.to_json(kind), F.lit(", "), F.col("user_id").cast("string"), F.lit(', "'), F.col("event_type"), F.lit('"]'))
    deep = F.concat(F.lit('{"a": [{"b": '), "props", F.lit("}], "), F.when(F.col("event_type") == "error", '"k": [1]').otherwise('"c": null'), F.lit("}"))
    found = K.json_values(deep, ["k"])
    return t.events.select("event_id", K.json_text(label).alias("label"), found.alias("found")).select("event_id", "label", F.element_at("found", 1).cast("long").alias("k"), (F.size("found") == 2).alias("n_two"))


@query("""SELECT event_id, 'b' AS at, props ->> '$.k' AS value FROM events UNION ALL SELECT event_id, 'list', unnest(['1', '"x"']) FROM events WHERE event_type = 'error'""")
def json_keys(t: Tables) -> DataFrame:
    """Values of a key at any depth, by variants."""
    deep = F.concat(F.lit('{"a": [{"b": '), "props", F.lit("}], "), F.when(F.col("event_type") == "error", '"k": [1, "x"]').otherwise('"c": null'), F.lit("}"))
    found = K.json_members(t.events.select("event_id", deep.alias("text")), "text", ["k"])
    return found.select("event_id", F.when(F.size("place") > 2, "b").otherwise("list").alias("at"), "value")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 11 <> 0 THEN p_partkey::VARCHAR END AS taxonomy_id, CASE WHEN p_partkey % 11 <> 0 THEN p_name END AS scientific_name,
CASE WHEN p_partkey % 11 <> 0 THEN p_brand || '; ' || p_type END AS common_names, CASE WHEN p_partkey % 11 = 0 THEN 'ERROR' ELSE 'OK' END AS status FROM part""")
def xml_fields(t: Tables) -> DataFrame:
    """Taxonomy records made from the parts, every eleventh cut off."""
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c.cast("string"), F.lit(f"</{name}>"))
    names = F.concat(tag("CommonName", F.col("p_brand")), tag("CommonName", F.col("p_type")), tag("CommonName", F.col("p_brand")))
    xml = F.concat(F.lit("<TaxaSet><Taxon>"), tag("TaxId", F.col("p_partkey")), tag("ScientificName", F.col("p_name")), F.lit("<OtherNames>"), names, F.lit("</OtherNames>"))
    xml = F.when(F.col("p_partkey") % 11 == 0, xml).otherwise(F.concat(xml, F.lit("</Taxon></TaxaSet>")))
    return t.part.select("p_partkey", K.taxon(xml).alias("r")).select("p_partkey", "r.*")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN 'X' || p_partkey WHEN p_partkey % 2 = 0 THEN 'Q' || p_size END AS accession FROM part")
def accession_choice(t: Tables) -> DataFrame:
    own = F.when(F.col("p_partkey") % 3 == 0, " ").otherwise(F.concat(F.lit("X"), "p_partkey"))
    synonyms = F.array("p_brand", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Q"), "p_size")).otherwise(F.col("p_type")), F.lit("Z9"))
    return t.part.select("p_partkey", C.accession(own, synonyms).alias("accession"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN p_size::BIGINT END AS value, CASE WHEN p_partkey % 7 = 0 THEN 'ERROR' ELSE 'OK' END AS status, CASE WHEN p_partkey % 7 = 0 THEN 'not bigint: ' || p_name END AS message FROM part""")
def error_rows(t: Tables) -> DataFrame:
    text = F.when(F.col("p_partkey") % 7 == 0, F.col("p_name")).otherwise(F.col("p_size").cast("string"))
    return t.part.select("p_partkey", K.cast_or_error(text, "bigint").alias("r")).select("p_partkey", "r.*")


@query(_FACTS + " SELECT row_index::BIGINT AS row_index, 'nation:' || n_name || ',customer:' || c_custkey || ',segment:' || c_mktsegment AS node_ids, 3 AS n_nodes FROM f")
def fact_index(t: Tables) -> DataFrame:
    """Row index and node ids of each fact."""
    ids = F.transform("path", lambda n: F.concat_ws(":", n["type"], n["id"]))
    return _facts(t).select("row_index", F.array_join(ids, ",").alias("node_ids"), F.size("path").alias("n_nodes"))


@query(_FACTS + " SELECT n_name AS subject, count(*) AS n_facts, count(DISTINCT lower(c_mktsegment)) AS n_parts, count(DISTINCT c_custkey) AS n_uses, min(row_index)::BIGINT AS first_index FROM f GROUP BY n_name")
def subject_profile(t: Tables) -> DataFrame:
    """Counts of each subject over its facts."""
    return V.subject_profile(_facts(t), "nation", "segment", "customer")


@query(_FACTS + """ SELECT n_name AS subject, count(*) AS n_facts, count(DISTINCT lower(c_mktsegment)) AS n_parts, count(DISTINCT c_custkey) AS n_uses, min(row_index)::BIGINT AS first_index, true AS known, any_value(n_regionkey)::VARCHAR AS n_regionkey, NULL::VARCHAR AS common_names
FROM f JOIN nation USING (n_name) GROUP BY n_name""")
def subject_card(t: Tables) -> DataFrame:
    """Counts of each subject with its node's attributes."""
    return V.subject_card(V.subject_profile(_facts(t), "nation", "segment", "customer"), t.nation, "n_name", ["n_regionkey", "common_names"])


def _evidence(t: Tables) -> DataFrame:
    g = graph(t)
    g.nodes["customer"] = t.customer.select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") > 0, F.floor("c_acctbal")).alias("balance"))
    rows = P.path_join(g, ["nation", "segment"], limit=None)
    return V.evidence_facts(rows, g, ["nation", "customer", "segment"], {"customer": ["balance"]})


@query("""WITH r AS (SELECT n_name, c_custkey, c_mktsegment, CASE WHEN c_acctbal > 0 THEN floor(c_acctbal)::BIGINT END AS b FROM customer JOIN nation ON c_nationkey = n_nationkey),
f AS (SELECT row_number() OVER (ORDER BY n_name, c_custkey::VARCHAR, c_mktsegment, b) - 1 AS row_index, * FROM r)
SELECT row_index::BIGINT AS row_index, 'nation|' || n_name || '|HAS_CUSTOMER|customer|' || c_custkey || ';customer|' || c_custkey || '|IN_SEGMENT|segment|' || c_mktsegment AS relationship_ids, 2 AS n_positional, b::VARCHAR AS balance, n_name || ';' || c_custkey || ';' || c_mktsegment AS node_ids FROM f""")
def evidence_facts(t: Tables) -> DataFrame:
    """Facts with relationships, measurements and provenance (G1)."""
    positional = F.size(F.filter("path.relationships", lambda r: r["positional"]))
    balance = F.try_element_at("measurements", F.lit(1))["balance"]
    return _evidence(t).select("row_index", F.array_join("provenance.relationship_ids", ";").alias("relationship_ids"), positional.alias("n_positional"), balance.alias("balance"), F.array_join("provenance.node_ids", ";").alias("node_ids"))


@query("SELECT 'HAS_CUSTOMER' AS rel, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'IN_SEGMENT', count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey")
def relation_counts(t: Tables) -> DataFrame:
    """Distinct relationships of each name over the facts (A1)."""
    return V.relation_counts(_evidence(t))


_FACT_TEXT = "'nation=' || n_name || ' > customer=' || c_custkey || ' > segment=' || c_mktsegment"


@query(_FACTS + f" SELECT count(*) AS n_facts, sum(length({_FACT_TEXT}))::BIGINT AS chars, sum(strlen({_FACT_TEXT}))::BIGINT AS bytes, max(row_index) + 1 = count(*) AS in_order FROM f")
def context_size(t: Tables) -> DataFrame:
    """Size of the facts as lines of text, and whether their numbers are positions."""
    return P.context_size(_facts(t))


def _events(t: Tables) -> DataFrame:
    """The events as a file stream; the pattern lets a single file stand for its folder."""
    return jobs.stream_of(t.spark, f"{t.folder}/events.parque[t]", t.events)


@query("SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def stream_merge(t: Tables) -> DataFrame:
    """Continuous merge, existing keys win."""
    at = jobs.work_folder(t.spark)
    specs = {"users": ("event_id", F.col("user_id").cast("string"))}
    query = jobs.merge_stream(_events(t), f"{at}/store", f"{at}/checkpoint", lambda batch: {"users": batch.select("event_id", "user_id")}, specs, {})
    query.awaitTermination()
    return S.current(t.spark, f"{at}/store")["users"]


@query("""WITH c AS (SELECT c_custkey::VARCHAR AS identity, 'c' || c_custkey AS canonical_id FROM customer)
SELECT * FROM c UNION ALL SELECT user_id::VARCHAR, min(event_id::VARCHAR) FROM events WHERE user_id::VARCHAR NOT IN (SELECT identity FROM c) GROUP BY user_id""")
def stream_canonical(t: Tables) -> DataFrame:
    """Users of the event stream merged statefully into a published store of customers."""
    at = jobs.work_folder(t.spark)
    published = t.customer.select(F.col("c_custkey").cast("string").alias("identity"), F.concat(F.lit("c"), "c_custkey").alias("raw_id")).withColumn("canonical_id", F.col("raw_id"))
    pairs = stateful.canonical_stream(_events(t), published, "event_id", F.col("user_id"), ["event_type"])
    stateful.append_to_log(pairs, f"{at}/log", f"{at}/checkpoint").awaitTermination()
    added = t.spark.read.schema(pairs.schema).parquet(f"{at}/log").filter("added")
    return published.select("identity", "canonical_id").unionByName(added.select("identity", "canonical_id"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(t: Tables) -> DataFrame:
    """Repeats of a signature within the watermark are dropped."""
    at = jobs.work_folder(t.spark)
    rows = jobs.dedup_stream(_events(t).select("user_id", "event_type", "ts"), "ts", ["user_id", "event_type"], "3650 days")
    return jobs.run_to_parquet(rows, f"{at}/out", f"{at}/checkpoint").select("user_id", "event_type")


@query("SELECT event_id, c_name FROM events JOIN customer ON user_id = c_custkey WHERE value > 20")
def stream_enrich(t: Tables) -> DataFrame:
    """Stream-static join and qualification."""
    at = jobs.work_folder(t.spark)
    static = t.customer.select(F.col("c_custkey").alias("user_id"), "c_name")
    return jobs.run_to_parquet(jobs.enrich_stream(_events(t), static, "user_id", F.col("value") > 20).select("event_id", "c_name"), f"{at}/out", f"{at}/checkpoint")


@query("SELECT event_id FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)")
def stream_missing(t: Tables) -> DataFrame:
    """Requests whose key no node has (T4)."""
    at = jobs.work_folder(t.spark)
    nodes = t.supplier.select(F.col("s_suppkey").alias("user_id"))
    return jobs.run_to_parquet(jobs.missing_stream(_events(t), nodes, "user_id").select("event_id"), f"{at}/out", f"{at}/checkpoint")


@query("""WITH a AS (SELECT event_id, user_id, event_type, ts::TIMESTAMP AS ts FROM events), w AS (SELECT least(max(ts) FILTER (event_type = 'click'), max(ts) FILTER (event_type = 'purchase')) - INTERVAL 1 HOUR AS mark FROM a)
SELECT r.event_id FROM a r, w WHERE r.event_type = 'click' AND r.ts + INTERVAL 6 HOUR < w.mark
AND NOT EXISTS (SELECT 1 FROM a c WHERE c.event_type = 'purchase' AND c.user_id = r.user_id AND c.ts >= r.ts AND c.ts <= r.ts + INTERVAL 6 HOUR)""")
def stream_unserved(t: Tables) -> DataFrame:
    """Clicks that no purchase of their user follows within six hours, once the streams have moved past them (T4)."""
    at = jobs.work_folder(t.spark)
    asked = _events(t).filter("event_type = 'click'").select("event_id", "user_id", "ts")
    rows = jobs.unserved_stream(asked, _events(t).filter("event_type = 'purchase'").select("user_id", "ts"), "user_id", "ts", "6 hours", "1 hour")
    return jobs.run_to_parquet(rows, f"{at}/out", f"{at}/checkpoint").select("event_id")
