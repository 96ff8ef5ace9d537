"""Session helpers: a tuned local session for tests and benches, and the
checkpoint directory contract used by every iterative operator.

On a cluster the checkpoint directory comes from ``spark.checkpoint.dir``
(a shared file system folder named by the cluster).  Only when it is unset
*and* Spark runs in local mode do we create a scratch folder under ``/tmp``;
on a cluster without the setting we refuse to guess a machine-local path.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "corpusgraph") -> SparkSession:
    """A local session configured the way the tests and the bench expect."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, configuring it if needed.

    Order: an already set SparkContext checkpoint dir, then the session /
    cluster setting ``spark.checkpoint.dir``, then (local mode only) a fresh
    scratch folder.  Never a local folder on a cluster.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; iterative operators need a shared "
            "checkpoint folder on a cluster")
    scratch = tempfile.mkdtemp(prefix="corpusgraph-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(scratch)
    return sc.getCheckpointDir() or scratch


_tables: list[str] = []


def _delete(spark: SparkSession, table: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def table_scope(spark: SparkSession):
    """Owner of the tables that :func:`materialize` writes inside: they are deleted
    when the block ends, so the block must consume its results."""
    first = len(_tables)
    try:
        yield
    finally:
        for table in _tables[first:]:
            _delete(spark, table)
        del _tables[first:]


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialize` returned and that no frame in use reads any
    more.  Other frames are left alone."""
    for df in tables:
        path = getattr(df, "_written_to", None)
        if path in _tables:
            _delete(df.sparkSession, path)
            _tables.remove(path)


#: Spark then deletes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_go(spark: SparkSession):
    """The shuffle files of the writes inside go as each ends; else they stay until the driver
    happens to collect its garbage, and those of all steps may lie on the disks at once.  Each
    write is planned by itself, so no other query reads them."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)


def materialize(df: DataFrame, tag: str = "step", with_count: bool = False):
    """Write ``df`` as a parquet table under the reliable checkpoint directory
    and return a frame reading it back (and its row count if ``with_count``).

    One job (unlike ``checkpoint()`` on an un-persisted frame, which computes
    the plan twice), lineage cut to a file scan, and the files live on the
    shared checkpoint storage, so a lost executor never loses the result.
    The row count comes from an ``Observation`` on the write itself, so the
    emptiness test of an iteration costs no extra job.  Who no longer needs
    the table gives it to :func:`discard`.
    """
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/corpusgraph-tables/{tag}-{uuid.uuid4().hex}"
    _tables.append(path)
    schema = df.schema
    if with_count:
        obs = Observation(f"rows_{uuid.uuid4().hex[:8]}")
        df = df.observe(obs, F.count(F.lit(1)).alias("n"))
    with _shuffles_go(spark):
        df.write.mode("error").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._written_to = path
    return (out, int(obs.get["n"])) if with_count else out


def materialize_bucketed(parts: Sequence[DataFrame], cols: list[str], name: str) -> DataFrame:
    """Write the ``parts``, one after the other, in buckets of ``cols`` as the table ``name`` whose
    files lie under the checkpoint directory, and read it back: joins on ``cols`` then need no shuffle
    of it.  Only one part's shuffle files lie on the disks at once, and a bucket's rows are sorted, so
    that they take little room.  The name is the caller's to drop; the files go with :func:`discard`
    or their :func:`table_scope`."""
    spark = parts[0].sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpusgraph-tables/{name}"
    _tables.append(path)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for k, df in enumerate(parts):
        with _shuffles_go(spark):
            (df.repartition(n, *cols).write.mode("append" if k else "error").format("parquet").option("path", path)
             .option("compression", "zstd").bucketBy(n, *cols).sortBy(*df.columns).saveAsTable(name))
    out = spark.table(name)
    out._written_to = path
    return out
