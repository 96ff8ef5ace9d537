"""Exact dedup by a keyed stream (operator 7; DataFrame and SQL functions only).

1. *Log*: every row's number (its id, if ids are unique) and its normalised text's
   digest are written to the shared folder.
2. *State*: the log is read as a stream.  A streaming aggregation keyed by
   digest runs over the RocksDB state store (on disk, checkpointed to the shared
   folder, no watermark and so no expiry).  Per digest the state keeps the
   smallest (doc_id, locator) and a count; a restarted batch repeats nothing.
   Copies are combined before the shuffle, so a hot text costs a row per task.
3. *Bytes*: rows whose digest has two or more members are hits.  Each hit's full
   normalised text is compared with the text of the row the state points to.
   Rows that differ (a digest collision) are grouped among themselves by their
   full text, so even a weak digest gives the exact groups.

Defined results: a null text is empty; nulls in ``doc_id`` sort last; of rows
that repeat both id and text one stays (the first by locator); an empty table
gives no rows; further columns, whatever their names, are carried in a struct.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, ensure_checkpoint_dir, materialize
from .common import documents, sieved, without
from .registry import register

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Session settings while the state is written and read.  RocksDB would reserve
#: several MB of disk for each of many small stores, and tens of MB of memory for each
#: that is open; all stores of an executor share one bound.
STATE_SETTINGS = {"spark.sql.streaming.stateStore.providerClass": STATE_STORE,
                  "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
                  "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
                  "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "32"}
#: Text files of the log in one micro-batch; more files make more batches.
FILES_PER_BATCH = 20_000


def normalised(text: str | Column) -> Column:
    """Null is empty; each run of ASCII white space becomes one space."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256_digest(text: Column) -> Column:
    return F.sha2(text, 256)


def _keep_state(spark: SparkSession, log: str, schema, files_per_batch: int) -> DataFrame:
    """Stream the log through keyed state; ``(digest, first, n)`` per digest."""
    at = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpusgraph-tables/dedup-{uuid.uuid4().hex}"
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(log)
              .groupBy("digest")
              .agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")).alias("first"),
                   F.count(F.lit(1)).alias("n")))
    before = {k: spark.conf.get(k, None) for k in STATE_SETTINGS}
    try:
        for k, v in STATE_SETTINGS.items():
            spark.conf.set(k, v)
        query = (stream.writeStream.format("noop").outputMode("update")
                 .option("checkpointLocation", at).trigger(availableNow=True).start())
        query.awaitTermination()
        # The state itself, as the last commit left it: key (digest), value (first, n) by position.
        state = spark.read.format("statestore").load(at)
        first, n = state.schema["value"].dataType.names
        return materialize(state.select(
            F.col("key.digest").alias("digest"), F.col("value").getField(first).alias("first"),
            F.col("value").getField(n).alias("n")), "state")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def _numbered(docs: DataFrame, id_col: str) -> DataFrame:
    """``rid, doc_id, row`` of every input row.  Ids that are unique and not null are the
    ``rid`` themselves; otherwise the rows are numbered once, in a table in the shared
    folder, so that every later scan sees the same numbers."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    rows = rows.select(F.col("row").getField(id_col).cast("bigint").alias("doc_id"), "row")
    n, ids, distinct = rows.agg(F.count(F.lit(1)), F.count("doc_id"), F.count_distinct("doc_id")).first()
    if n == ids == distinct:
        return rows.select(F.col("doc_id").alias("rid"), "doc_id", "row")
    return materialize(rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "row"), "numbered")


def decisions(rows: DataFrame, text_col: str = "text", digest: Callable[[Column], Column] = sha256_digest,
              files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """``rid, doc_id, digest, keep_id, group_size, kept`` of ``rows`` (as :func:`_numbered`
    gives them), a written table; the tables on the way to it go."""
    spark = rows.sparkSession
    text = normalised(F.col("row").getField(text_col))
    log = materialize(rows.select("rid", "doc_id", digest(text).alias("digest")), "log")
    state = _keep_state(spark, log.inputFiles()[0].rsplit("/", 1)[0], log.schema, files_per_batch)
    held = state.select("digest", F.col("first.rid").alias("first_rid"),
                        F.col("first.doc_id").alias("first_id"), "n")

    # Full bytes of every hit against the kept row's.  Only texts of hits move (and the few
    # others that share a bit of the sieve).  Hot digests are split by AQE's skew join.
    found = materialize(log.join(held.where("n > 1"), "digest"), "found")
    hits = materialize(found.join(sieved(rows, found).select("rid", text.alias("body")), "rid"), "hits")
    kept_body = hits.where("rid = first_rid").select("digest", F.col("body").alias("kept_body"))
    checked = materialize(
        hits.join(kept_body, "digest")
        .withColumn("same", F.col("body") == F.col("kept_body"))
        .select("rid", "doc_id", "digest", "first_rid", "first_id", "n", "same",
                F.when(~F.col("same"), F.col("body")).alias("body")), "checked")
    discard(found, hits)
    odd = checked.where("NOT same")
    groups = odd.groupBy("digest", "body").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")).alias("f"),
        F.count(F.lit(1)).alias("m"))
    odd = odd.select("rid", "digest", "body").join(groups, ["digest", "body"]).select(
        "rid", F.col("f.rid").alias("odd_rid"), F.col("f.doc_id").alias("odd_id"), F.col("m").alias("odd_n"))
    less = groups.groupBy("digest").agg(F.sum("m").alias("less"))

    singles = held.where("n = 1").select(
        F.col("first_rid").alias("rid"), F.col("first_id").alias("keep_id"),
        F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"))
    alike = (checked.where("same").join(less, "digest", "left")
             .select("rid", F.col("first_id").alias("keep_id"),
                     (F.col("n") - F.coalesce("less", F.lit(0))).alias("group_size"),
                     (F.col("rid") == F.col("first_rid")).alias("kept")))
    other = odd.select("rid", F.col("odd_id").alias("keep_id"), F.col("odd_n").alias("group_size"),
                       (F.col("rid") == F.col("odd_rid")).alias("kept"))
    out = materialize(log.join(singles.unionByName(alike).unionByName(other), "rid"), "decisions")
    discard(log, state, checked)
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                digest: Callable[[Column], Column] = sha256_digest,
                files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """One row per input row: ``rid, doc_id, digest, keep_id, group_size, kept``
    and ``row`` (the input row)."""
    rows = _numbered(docs, id_col)
    return decisions(rows, text_col, digest, files_per_batch).join(rows.select("rid", "row"), "rid")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the kept rows, columns as given."""
    rows = _numbered(docs, "doc_id")
    return without(rows, decisions(rows).where("NOT kept").select("rid")).select("row.*")


@register("op7_exact_dedup", r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, sha256(body) AS text_sha256
FROM d WINDOW g AS (PARTITION BY body)""")
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies of ``documents``: keep_id, group size and decision per row."""
    out = decisions(_numbered(documents(spark, sf_dir).select("doc_id", "text"), "doc_id"))
    return out.select("doc_id", "keep_id", F.col("group_size").cast("bigint").alias("group_size"),
                      "kept", F.col("digest").alias("text_sha256"))
