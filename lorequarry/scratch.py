"""Shared scratch space: the way this library cuts lineage.

Every table written here lives under ``spark.checkpoint.dir``, which a cluster
sets to storage that all executors and the driver see.  Only where the setting
is absent, and only on a ``local`` master (tests, a laptop), does the library
choose a folder of its own; on any other master it raises.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


_own_dirs: dict[str, str] = {}
_written: dict[str, list[str]] = {}
_kept: dict[str, dict[tuple, object]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session; one of its own where none is configured."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_dirs:
            _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="lorequarry-")
        where = _own_dirs[app]
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def spool(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of what was written.

    Survives the loss of any executor, is computed once, and lets later plans
    prune columns.  Void columns are not supported.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def once(spark: SparkSession, key: tuple, make: Callable[[], object]) -> object:
    """What ``make`` gave for this key in this application; made anew after a release."""
    held = _kept.setdefault(spark.sparkContext.applicationId, {})
    if key not in held:
        held[key] = make()
    return held[key]


def release(spark: SparkSession) -> None:
    """Delete all that this application has written to the shared folder.  Results
    that have not been consumed yet cannot be read after it."""
    jvm = spark.sparkContext._jvm
    _kept.pop(spark.sparkContext.applicationId, None)
    for path in _written.pop(spark.sparkContext.applicationId, []):
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
