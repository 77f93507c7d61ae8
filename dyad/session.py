"""Spark session helpers.

The library never creates global state of its own: every operator takes a
DataFrame and returns a DataFrame.  This module only builds a session for
tests/bench and makes sure a checkpoint directory exists when the caller's
cluster has not named one.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "dyad") -> SparkSession:
    """Session tuned for local runs; on a cluster the submitter's conf wins."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared ``spark.checkpoint.dir``.

    Only a local master (tests, bench) may run without one: it gets a scratch
    folder.  Anywhere else executors would each write to their own disk, so an
    unset folder is an error."""
    sc = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF, None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if not configured:
        if not _is_local(sc.master):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share (master {sc.master})")
        configured = tempfile.mkdtemp(prefix="dyad-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set(CHECKPOINT_CONF, configured)
    sc.setCheckpointDir(configured)
    return configured


def _is_local(master: str) -> bool:
    return master == "local" or master.startswith("local[")


#: open scopes of :func:`scratch` in this thread (or context), innermost last
_SCOPES: ContextVar[tuple[dict[str, SparkSession], ...]] = ContextVar("dyad_scopes", default=())
#: tables that no scope owns
_LOOSE: dict[str, SparkSession] = {}


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:  # the session has ended
        return
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def release_tables() -> None:
    """Delete every table that :func:`cut_lineage` wrote outside a scope, in any
    thread.  Call it when no frame that reads them is used any more."""
    while _LOOSE:
        path, spark = _LOOSE.popitem()
        _remove(spark, path)


class scratch:
    """Scope for intermediate tables: on exit, tables cut inside it are deleted
    except those handed to :meth:`keep`, which pass to the enclosing scope.
    Scopes belong to the thread that opened them; other threads' tables are not touched.

    ``with scratch() as s: ...; return s.keep(cut_lineage(df))``"""

    def __enter__(self) -> scratch:
        self._own: dict[str, SparkSession] = {}
        open_scopes = _SCOPES.get()
        self._outer = open_scopes[-1] if open_scopes else _LOOSE
        self._token = _SCOPES.set((*open_scopes, self._own))
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        path = getattr(df, "_table_path", None)
        if path not in self._own:
            raise ValueError("keep() takes a frame that cut_lineage() returned in this scope")
        self._outer[path] = self._own.pop(path)
        return df

    def __exit__(self, *exc) -> None:
        _SCOPES.reset(self._token)
        for path, spark in self._own.items():
            _remove(spark, path)


def new_table_path(spark: SparkSession) -> str:
    """A fresh folder under the shared checkpoint directory, owned by this thread's innermost scope."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    open_scopes = _SCOPES.get()
    (open_scopes[-1] if open_scopes else _LOOSE)[path] = spark
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a parquet table under the shared checkpoint
    directory and read it back: the lineage is cut, the data survives executor
    loss, and later jobs scan a columnar table (pruned to what they use).
    One job, unlike ``Dataset.checkpoint`` which computes the plan twice.
    The innermost :func:`scratch` scope owns the table."""
    spark = df.sparkSession
    path = new_table_path(spark)
    df.write.mode("error").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._table_path = path
    return table
