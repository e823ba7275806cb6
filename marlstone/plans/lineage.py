"""Lineage cuts that survive lost executors, and limits for Arrow batches.

A cut is a Parquet table in the folder that every executor shares
(``spark.checkpoint.dir``).  Only where that setting is absent and the master is
local, as in tests, is a folder of our own used; a cluster without it is refused,
as its machines would write to folders that others can't read.  Tables live as long as the application unless they
are released earlier.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """Folder for this application's cut tables, inside ``spark.checkpoint.dir``."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="marlstone-cuts-")
        _ROOTS[app] = f"{base.rstrip('/')}/marlstone-{app}"
        atexit.register(_forget, spark, _ROOTS[app])
    return _ROOTS[app]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _forget(spark: SparkSession, root: str) -> None:
    """Best effort at exit: by then the JVM may be gone."""
    try:
        _delete(spark, root)
    except Exception:  # noqa: BLE001 - nothing can be done about it at exit
        pass


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._marlstone_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete tables that ``cut`` returned and that no live plan reads any more."""
    for df in frames:
        path = getattr(df, "_marlstone_path", None)
        if path:
            _delete(df.sparkSession, path)


def bound_batches(spark: SparkSession, rows: int = 2000, megabytes: int = 16) -> None:
    """Keep Arrow batches of long texts small enough for a Python worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{megabytes}m")
