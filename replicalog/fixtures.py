"""Catalogs, listings, event logs and the like, derived from the driver's tables.

Each derivation is one SQL text for both engines, ``{sha}`` being the hash function; Spark then adds the map of
versions and the array of blocks. Replica 1 is the local one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A two-replica catalog: each remainder of doc_id by 20 is a case of its own.
CATALOG = """
d AS (SELECT doc_id, source, 'folder' || CAST(doc_id % 4 AS VARCHAR(9)) AS folder, lang || '/' || source || '/doc' || CAST(doc_id AS VARCHAR(20)) || '.txt' AS name,
             CAST(n_chars AS BIGINT) AS size, 1700000000 + doc_id * 60 AS t0, {sha_text} AS h, {sha_edit} AS h2, doc_id % 20 AS k FROM documents),
c AS (SELECT folder, '1' AS replica, name, CASE WHEN k = 16 THEN 0 ELSE size END AS size,
             CASE WHEN k = 16 THEN 0 WHEN k IN (11, 12, 14) THEN t0 + 10 WHEN k = 13 THEN t0 + 90 ELSE t0 END AS modified_s,
             CASE WHEN k = 16 THEN '' WHEN k IN (11, 12, 13) THEN h2 ELSE h END AS hash, k = 16 AS deleted,
             CASE WHEN k IN (11, 12, 13, 14, 16) THEN 2 ELSE 1 END AS v1, 0 AS v2, doc_id AS seq FROM d WHERE k <> 17
      UNION ALL
      SELECT folder, '2', name, CASE WHEN k IN (15, 19) THEN 0 ELSE size END,
             CASE WHEN k IN (15, 19) THEN 0 WHEN k IN (10, 16) THEN t0 + 20 WHEN k IN (12, 13, 14) THEN t0 + 50 ELSE t0 END,
             CASE WHEN k IN (15, 19) THEN '' WHEN k = 10 THEN h2 ELSE h END, k IN (15, 19),
             CASE WHEN k = 17 THEN 0 WHEN k = 16 THEN 2 ELSE 1 END, CASE WHEN k IN (10, 12, 13, 14, 15, 16, 17, 19) THEN 1 ELSE 0 END, doc_id FROM d WHERE k <> 18
      UNION ALL
      SELECT folder, '2', 'moved/' || source || '/doc' || CAST(doc_id AS VARCHAR(20)) || '.txt', size, t0, h, false, 0, 1, doc_id + 1000000000 FROM d WHERE k = 19)"""

EVENTS = """
e AS (SELECT event_id AS id, ts, CASE WHEN event_type = 'signup' THEN 'peers' ELSE 'folder' || CAST(user_id % 4 AS VARCHAR(9)) END AS folder, 'p' || CAST(user_id AS VARCHAR(20)) AS path,
             CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'applied' WHEN 'view' THEN 'skipped' WHEN 'purchase' THEN 'conflict' ELSE 'peer' END AS category,
             CASE WHEN value >= 100 THEN 2 WHEN value >= 50 THEN 1 ELSE 0 END AS severity,
             CASE WHEN event_type = 'signup' THEN 'peer offline: ' || event_type ELSE event_type END AS reason,
             CASE event_id % 7 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 0 END AS resolution, CAST(user_id % 3 AS VARCHAR(9)) AS peer_id, {seconds} AS ts_s FROM events)"""

ATTEMPTS = """
a AS (SELECT event_id AS id, 'peer' || CAST(user_id % 5 AS VARCHAR(9)) AS peer, {seconds} AS ts, event_type NOT IN ('error', 'purchase') AS ok,
             CASE WHEN event_type IN ('error', 'purchase') THEN event_type END AS error FROM events)"""


def catalog_sql(sha: str) -> str:
    return CATALOG.replace("{sha_text}", sha.format("text")).replace("{sha_edit}", sha.format("text || '#edit'"))


def for_duckdb(text: str) -> str:
    return text.replace("{seconds}", "CAST(floor(epoch(ts)) AS BIGINT)")


def _select(spark: SparkSession, sf_dir: str, table: str, ctes: str, name: str) -> DataFrame:
    """Runs the derivation on one table, given as a frame."""
    text = ctes.replace("{seconds}", "unix_timestamp(ts)")
    body = text.replace(f"FROM {table}", f"FROM {{{table}}}")
    return spark.sql(f"WITH {body} SELECT * FROM {name}", **{table: spark.read.parquet(f"{sf_dir}/{table}.parquet")})


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _select(spark, sf_dir, "documents", catalog_sql("sha2({}, 256)"), "c")
    version = F.map_filter(F.create_map(F.lit("1"), F.col("v1").cast("long"), F.lit("2"), F.col("v2").cast("long")), lambda _, n: n > 0)
    return d.select(
        "folder", "replica", "name", F.col("size").cast("long").alias("size"), F.col("modified_s").cast("long").alias("modified_s"), F.lit(0).alias("modified_ns"), F.lit(420).alias("mode"),
        F.lit(0).alias("type"), "deleted", F.lit(False).alias("invalid"), version.alias("version"), F.col("seq").cast("long").alias("sequence"), F.lit(131072).alias("block_size"),
        F.when(F.col("hash") == "", F.array().cast("array<string>")).otherwise(F.array("hash")).alias("blocks"),
    )


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies on disk: the peer's live rows."""
    return catalog(spark, sf_dir).where("replica = '2' AND NOT deleted").select("folder", "name", "type", "size", "modified_s", "modified_ns", "mode")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _select(spark, sf_dir, "events", EVENTS, "e")
    return d.withColumns({"ack_by": F.lit(""), "ack_ts": F.lit(None).cast("long"), "linked": F.lit("")})


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark, sf_dir, "events", ATTEMPTS, "a")


def folders(spark: SparkSession) -> DataFrame:
    """The four folders' settings."""
    rows = [(f"folder{i}", f"Folder {i}", f"/mnt/user/f{i}", "conflict-copy" if i % 2 == 0 else "newest", i == 2, ["2"] if i == 1 else [], 25, 0) for i in range(4)]
    return spark.createDataFrame(rows, "id string, name string, path string, conflict string, versioned boolean, peers array<string>, max_delete_pct int, max_delete_files int")


def peers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("2", "nas")], "peer string, name string")


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select(F.concat(F.lit("folder"), F.col("doc_id") % 4).alias("folder"), F.concat_ws("/", "lang", "source", F.concat(F.lit("doc"), "doc_id", F.lit(".txt"))).alias("name"), F.col("text").alias("content"))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of the pages, as a listing of files."""
    d = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return d.select(F.lit("folder0").alias("folder"), "page_id", F.regexp_replace("url", r"^https?://[^/]+/|[?#].*$", "").alias("name"), F.lit(0).alias("type"))


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archived versions: every document is a version of its source, under one of three strategies."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select(
        F.concat(F.lit("folder"), F.col("doc_id") % 4).alias("folder"), F.element_at(F.array(F.lit("trashcan"), F.lit("simple"), F.lit("staggered")), (F.col("doc_id") % 3 + 1).cast("int")).alias("strategy"),
        F.col("source").alias("path"), F.col("n_chars").cast("long").alias("size"), (1700000000 + F.col("doc_id") * 60).alias("modified_s"), F.col("doc_id").alias("stamp"),
    )
