"""Scratch tables in the folder that all machines of the cluster share.

Lineage is cut by writing a Parquet table below ``spark.checkpoint.dir`` and
reading it again, so a lost executor never takes an intermediate result along.
The setting is read from the session; a folder is set only where it is unset in
a local session (tests). On a cluster a missing setting is an error: executors
would write where nobody else can read.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_written: dict[str, list[str]] = {}
_hooked = False


def shared_dir(spark: SparkSession) -> str:
    """Folder for scratch tables; a temporary one only if a local session names none."""
    base = spark.conf.get(_KEY, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{_KEY} must name a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="kinlink-")
        spark.conf.set(_KEY, base)
    return base.rstrip("/") + "/kinlink"


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def scratch_path(spark: SparkSession, name: str, scope: str = "default") -> str:
    """A new path in the shared folder, which goes with its scope."""
    global _hooked
    path = f"{shared_dir(spark)}/{scope}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(scope, []).append(path)
    if not _hooked:
        atexit.register(_at_exit)
        _hooked = True
    return path


def materialize(df: DataFrame, name: str, scope: str = "default") -> DataFrame:
    """Write ``df`` as a scratch table and return a scan of it."""
    path = scratch_path(df.sparkSession, name, scope)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kinlink_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a scratch table that :func:`materialize` returned."""
    path = getattr(df, "_kinlink_path", None)
    if path:
        _delete(df.sparkSession, path)
        for paths in _written.values():
            if path in paths:
                paths.remove(path)


def release(spark: SparkSession, scope: str) -> None:
    """Delete every scratch table of a scope; nothing may read them any more."""
    for path in _written.pop(scope, []):
        _delete(spark, path)


def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    try:
        for scope in list(_written):
            release(spark, scope)
    except Exception:  # noqa: BLE001  the JVM may be gone already at interpreter exit
        return
