"""Written intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir; where that is unset a temporary one, in local mode only."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="chronopanel-")
        _ROOTS[app] = f"{base.rstrip('/')}/chronopanel-{app}"
        atexit.register(release, spark)
    return _ROOTS[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again.

    This cuts the lineage, survives the loss of any executor, and (unlike a cached or checkpointed plan)
    leaves the reader without an output partitioning, so that AQE can split skewed joins on it. The shuffle files of
    the write go as soon as it is done, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path, before = fresh_path(spark, label), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def _delete(spark: SparkSession, name: str) -> None:
    with contextlib.suppress(Exception):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more, plans not yet run included."""
    for df in tables:
        _delete(df.sparkSession, _PATHS.pop(df))


def release(spark: SparkSession) -> None:
    """Delete every staged table of this application (also done at exit)."""
    root = _ROOTS.pop(spark.sparkContext.applicationId, None) if spark.sparkContext._jsc else None
    if root:
        _delete(spark, root)
