"""Written tables in the folder that the driver and all executors share.

A table written here ends its DataFrame's lineage, so a lost executor costs no more than
what was read since.  The folder is spark.checkpoint.dir; only a session on one machine may
go without it.  Every table of an application lies below one folder of its own, which is
deleted when the application ends; release() and scratch() delete sooner.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that may be broadcast; tables that count more meet by a shuffle.
BROADCAST_BYTES = 64 << 20

_scopes: list[str] = []
_roots: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a private one only where that is unset and there is one machine."""
    sc = spark.sparkContext
    set_to = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    now = sc._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return set_to or now.get()
    if not set_to:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        set_to = "file://" + tempfile.mkdtemp(prefix="veil-")
    sc.setCheckpointDir(set_to)
    return set_to


def _root(spark: SparkSession) -> str:
    root = f"{shared_dir(spark).rstrip('/')}/veil-{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots.add(root)
        atexit.register(_forget, spark, root)
    return root


def _forget(spark: SparkSession, root: str) -> None:
    # the session may be gone by now; then its folder stays
    with contextlib.suppress(Exception):
        remove(spark, root)


def shared_path(spark: SparkSession, kind: str, keep: bool = False) -> str:
    """A new path below the folder in use; with keep, below the one around it."""
    scopes = _scopes[:-1] if keep else _scopes
    return f"{scopes[-1] if scopes else _root(spark)}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame, *done: DataFrame, keep: bool = False) -> DataFrame:
    """Write df as Parquet, read it back, and delete the tables of done, which only df needed.

    With keep, the table outlives the scratch() around it.
    """
    spark = df.sparkSession
    path = shared_path(spark, "cut", keep)
    df.write.parquet(path)
    release(*done)
    out = spark.read.schema(df.schema).parquet(path)
    out._veil_path = path
    return out


def release(*done: DataFrame) -> None:
    """Delete tables that cut() wrote; nothing that reads them may run any more."""
    for df in done:
        if path := getattr(df, "_veil_path", None):
            remove(df.sparkSession, path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder for all tables written meanwhile, deleted in the end."""
    path = f"{_root(spark)}/scratch-{uuid.uuid4().hex}"
    _scopes.append(path)
    try:
        yield path
    finally:
        _scopes.pop()
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    jvm = spark.sparkContext._jvm
    hp = jvm.org.apache.hadoop.fs.Path(path)
    hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hp, True)


def small(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """df marked for broadcast if its counted rows of about row_bytes each are within BROADCAST_BYTES.

    Beyond that it stays as it is and joins by a shuffle, with the same rows.
    """
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n * row_bytes <= BROADCAST_BYTES else df
