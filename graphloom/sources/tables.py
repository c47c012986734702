"""Reading and writing: string tables, payloads, pages, name lists, versioned stores, upserts, digests."""

from __future__ import annotations

import datetime
import json
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_strings(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV with header, all columns strings, blanks kept; an empty table when the path is missing."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    found = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return align(found, columns)


def read_sheet(spark: SparkSession, path: str, lower: bool = True) -> DataFrame:
    """A tabular sheet exported as CSV, header names trimmed and lower-cased."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*[c.strip().lower() if lower else c.strip() for c in df.columns]).na.fill("")


def find_column(df: DataFrame, candidates: list[str]) -> str | None:
    """The first column that equals a candidate, ignoring case (S3)."""
    by_name = {c.strip().lower(): c for c in reversed(df.columns)}
    return next((by_name[c.lower()] for c in candidates if c.lower() in by_name), None)


def read_payloads(spark: SparkSession, path: str, schema: str, items: str) -> DataFrame:
    """Rows of ``data.<items>`` of stored JSON responses {data, ok} that are ok."""
    body = spark.read.schema(f"data struct<{items}: array<{schema}>>, ok boolean").option("multiLine", True).json(path)
    return body.filter("ok").select(F.explode(f"data.{items}").alias("item")).select("item.*")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Stored pages: a Parquet table with url and html, or a folder of files."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    files = spark.read.text(path, wholetext=True).withColumn("url", F.input_file_name())
    return files.select("url", F.col("value").alias("html"))


def read_name_list(spark: SparkSession, path: str) -> DataFrame:
    """Names from lines without numbering, blanks and # comments, or from a name column; first of each kept, in order."""
    if path.endswith(".csv"):
        df = read_sheet(spark, path)
        column = find_column(df, ["plant_name", "plant", "name"])
        rows = df.select(F.trim(F.col(f"`{column}`")).alias("name"))
    else:
        rows = spark.read.text(path).select(F.trim(F.regexp_replace(F.trim("value"), "^[0-9]+[.)]\\s*", "")).alias("name")).filter("not startswith(name, '#')")
    ordered = rows.filter("name <> ''").withColumn("ord", F.monotonically_increasing_id())
    return first_per(ordered, ["name"], [F.col("ord")])


def write_tables(tables: dict[str, DataFrame], path: str, kind: str = "parquet") -> None:
    """Each table under its name."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).format(kind).save(f"{path}/{name}")


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """The table itself, or an error that names the missing columns (F1)."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def align(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly these columns: missing and null ones blank, others dropped (F2)."""
    return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns])


def keep_known(df: DataFrame, allowed: list[str]) -> DataFrame:
    """The allowed columns that the table has."""
    return df.select(*[c for c in allowed if c in df.columns])


def first_per(df: DataFrame, keys: list[str], order: list[Column], last: bool = False) -> DataFrame:
    """The first (or last) row of each key under an explicit order."""
    w = Window.partitionBy(*keys).orderBy(*[o.desc() if last else o for o in order])
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def publish(spark: SparkSession, store: str, tables: dict[str, DataFrame], violations: DataFrame | None = None, base: str | None = None) -> str:
    """Write a new version of all tables, then a pointer to it; the newest pointer counts, nothing is written if there are violations.

    ``base`` is the version that the tables were made from (by default the current one as publishing starts, none for a new store). A
    version has one successor: where another writer has published on the same base meanwhile, this one fails, its version stays
    without a pointer and no merge is lost; read the store again and repeat. Rows are counted as they are written, for
    ``history``. Earlier versions stay as snapshots. The pointer is set by a rename that fails where the name is taken, as
    file systems with atomic renames have it.
    """
    if violations is not None and (bad := violations.head(5)):
        raise ValueError(f"not published: {bad}")
    base = base or current_version(spark, store)
    version = datetime.datetime.now(datetime.UTC).strftime("%Y%m%dT%H%M%S%fZ") + uuid.uuid4().hex[:4]
    version = version if base is None or version > base else f"{base}~"  # a clock that is behind
    rows = {}
    for name, df in tables.items():
        seen = Observation()
        df.observe(seen, F.count("*").alias("n")).write.mode("overwrite").parquet(f"{store}/{version}/{name}")
        rows[name] = seen.get["n"]
    told = json.dumps({"version": version, "base": base, "tables": sorted(tables), "rows": rows})
    _set_once(spark, f"{store}/_current", f"after-{base or 'nothing'}.json", told)
    return version


def _set_once(spark: SparkSession, folder: str, name: str, text: str) -> None:
    """A file of this text under a name that nothing has yet; an error where something has."""
    fs, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    goal, draft = fs.Path(f"{folder}/{name}"), fs.Path(f"{folder}/_draft-{uuid.uuid4().hex}")
    out = draft.getFileSystem(conf).create(draft)
    out.write(bytearray(text.encode()))
    out.close()
    files = fs.FileContext.getFileContext(draft.getFileSystem(conf).getUri(), conf)
    try:
        files.rename(draft, goal, spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Py4JJavaError as error:
        files.delete(draft, False)
        if not files.util().exists(goal):
            raise
        raise ValueError(f"not published: another version follows already ({name})") from error


def _pointers(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema("version string, base string, tables array<string>, rows map<string, bigint>").json(f"{store}/_current")


def current_version(spark: SparkSession, store: str) -> str | None:
    """The newest version of a store; None where nothing has been published."""
    return _pointers(spark, store).agg(F.max("version")).first()[0] if _exists(spark, f"{store}/_current") else None


def current(spark: SparkSession, store: str, version: str | None = None) -> dict[str, DataFrame]:
    """The tables of a version, by default of the newest; none where nothing has been published."""
    version = version or current_version(spark, store)
    if version is None:
        return {}
    told = _pointers(spark, store).filter(F.col("version") == version).first()
    if told is None:
        raise ValueError(f"no version {version}")
    return {t: spark.read.parquet(f"{store}/{version}/{t}") for t in told["tables"]}


def history(spark: SparkSession, store: str) -> DataFrame:
    """(version, base, table_name, n_before, n_after, n_added) of each table of each version, from the counts of the writes.

    A table that the base lacks starts from 0.
    """
    counts = _pointers(spark, store).select("version", "base", F.explode("rows").alias("table_name", "n_after"))
    before = counts.select(F.col("version").alias("base"), "table_name", F.col("n_after").alias("n_before"))
    both = counts.join(before, ["base", "table_name"], "left").withColumn("n_before", F.coalesce("n_before", F.lit(0)))
    return both.select("version", "base", "table_name", "n_before", "n_after", (F.col("n_after") - F.col("n_before")).alias("n_added"))


def upsert_nodes(target: DataFrame, source: DataFrame, key: str, order: Column | None = None) -> DataFrame:
    """Create or update by key: fields that the source has overwrite, others stay, nothing is deleted.

    Where the source repeats a key its last row under ``order`` (by default all its columns) counts; a blank or null key in it is an error.
    """
    blank = F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")) == ""
    filled = source.withColumn(key, F.when(blank, F.raise_error(F.lit(f"blank key {key}"))).otherwise(F.col(key)))
    last = first_per(filled, [key], [F.struct(*source.columns) if order is None else order], last=True)
    t, s = target.alias("t"), last.alias("s")
    hit = F.col(f"s.{key}").isNotNull()
    pick = {c: F.when(hit, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")) if c in source.columns else F.col(f"t.{c}") for c in target.columns}
    pick[key] = F.coalesce(f"t.{key}", f"s.{key}")
    return t.join(s, F.col(f"t.{key}") == F.col(f"s.{key}"), "full_outer").select(*[c.alias(name) for name, c in pick.items()])


def upsert_edges(target: DataFrame, source: DataFrame, src_nodes: DataFrame, dst_nodes: DataFrame, order: Column) -> DataFrame:
    """Edges (src_id, dst_id, ...) with both endpoints, one per pair; the source's last row wins."""
    known = source.join(src_nodes.select(F.col("id").alias("src_id")), "src_id", "left_semi").join(dst_nodes.select(F.col("id").alias("dst_id")), "dst_id", "left_semi")
    last = first_per(known, ["src_id", "dst_id"], [order], last=True)
    kept = target.join(last, ["src_id", "dst_id"], "left_anti")
    return kept.unionByName(last.select(*target.columns))


def digest(df: DataFrame, keys: list[str], digits: int = 2) -> DataFrame:
    """(bucket, n_rows, digest): an order-free digest of each bucket of a table's rows, dealt by ``digits`` hex digits of their keys' MD5.

    Every field is hashed with its length, a null as a mark of its own, so values cannot change places unseen. The sums of the
    row hashes' four parts make a bucket's digest: it is the same whatever the order, and counts repeated rows.
    """
    row = lambda names: F.md5(F.concat(*[F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in names]))
    hashed = df.select(F.substring(row(keys), 1, digits).alias("bucket"), row(df.columns).alias("h"))
    part = lambda i: F.sum(F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")).cast("string")
    sums = hashed.groupBy("bucket").agg(F.count("*").alias("n_rows"), *[part(i).alias(f"s{i}") for i in range(4)])
    return sums.select("bucket", "n_rows", F.md5(F.concat_ws(",", F.col("n_rows").cast("string"), "s0", "s1", "s2", "s3")).alias("digest"))


def digest_root(digests: DataFrame) -> DataFrame:
    """One row (n_rows, digest) over the digests of a table's buckets."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("bucket", "digest"))), lambda x: F.concat(x["bucket"], x["digest"]))
    return digests.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.md5(F.array_join(parts, "")).alias("digest"))


def changed(now: DataFrame, before: DataFrame) -> DataFrame:
    """The buckets whose digests differ between two states of a table, or stand in one of them only."""
    a, b = now.select("bucket", F.col("digest").alias("_now")), before.select("bucket", F.col("digest").alias("_before"))
    return a.join(b, "bucket", "full_outer").filter(~F.col("_now").eqNullSafe(F.col("_before"))).select("bucket")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only for a local master where it is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="spark-graphloom-")
    return shared.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read again: it is computed once."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by their keys over as many tasks as a shuffle has, however small they are on disk.

    A grouping by these keys or more then needs no further shuffle: it holds one such part at a time, not all rows of a large file's scan, and
    rows that compress well are not brought together in few tasks. Rows that work hard on each row get all cores this way.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """The rows with their 0-based position under an order.

    Rows are dealt into ranges of the order and numbered there; a range goes on after the sizes of those before it, so no task sees all rows.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumns({f"_o{i}": o for i, o in enumerate(order)})
    keys = [F.col(f"_o{i}") for i in range(len(order))]
    ranges = stored(keyed.repartitionByRange(n, *keys).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("_range").agg(F.count("*").alias("_size"))
    before = sizes.select("_range", F.coalesce(F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*keys)) - 1 + F.col("_before")
    return ranges.join(F.broadcast(before), "_range").withColumn(name, place.cast("long")).drop("_range", "_before", *[f"_o{i}" for i in range(len(order))])
