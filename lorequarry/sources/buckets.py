"""Keyed tables in buckets: a merge rewrites only the buckets that it touches.

A row lies in the bucket of its key's hash.  A manifest, a small table of where
each bucket's files are, is what makes a version; it is written last, under the next
number, so readers see the old version or the new one, and a merge that dies
leaves files that no manifest names.  Files of buckets without news are not touched.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorequarry.operators.ranking import first_per_key

BUCKETS = 64
_BUCKET = "_bucket"


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def _fs(spark: SparkSession, path: str) -> tuple[object, object]:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of whole manifests, in order."""
    fs, pattern = _fs(spark, f"{path}/manifest/v*/_SUCCESS")
    found = fs.globStatus(pattern) or []
    return sorted(int(str(f.getPath().getParent().getName())[1:]) for f in found)


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict[int, str]:
    """Where the files of each bucket are, in the last version or a stated one; at most
    a row a bucket.  A table that is not there has none."""
    known = versions(spark, path)
    if not known:
        return {}
    rows = spark.read.schema("bucket int, dir string").parquet(f"{path}/manifest/v{known[-1] if version is None else version:012d}")
    return {r["bucket"]: r["dir"] for r in rows.collect()}


def _read(spark: SparkSession, path: str, dirs: list[str]) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(*(f"{path}/{d}" for d in dirs))


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The rows of a version; None where there is none."""
    held = manifest(spark, path, version)
    return _read(spark, path, sorted(set(held.values()))) if held else None


def merge(new: DataFrame, path: str, key: str, seq: str | None = None, buckets: int = BUCKETS, version: int | None = None) -> int:
    """Put ``new`` in place of the rows of the same key; of several new rows of a key
    the last by ``seq``, a null one first.  Gives the version.

    A version that is there already is not made again, so a batch that runs
    twice (``version`` its number) changes nothing.  The number of buckets is that of the
    first merge for good.  A null key is a key.  Columns that a side lacks are null.
    """
    spark = new.sparkSession
    known = versions(spark, path)
    number = (known[-1] + 1 if known else 0) if version is None else version
    if number in known:
        return number
    held = manifest(spark, path)
    # Last of a key first, and then the bucket: a key of any number of news sends a row a task.
    order = [F.col(seq).desc_nulls_last()] if seq else [F.xxhash64(F.struct("*")).asc()]
    last = first_per_key(new, [key], order)
    folder = f"data/{number:012d}-{uuid.uuid4().hex}"
    incoming = last.withColumn(_BUCKET, bucket_of(key, buckets))
    if held:
        touched = [r[_BUCKET] for r in incoming.select(_BUCKET).distinct().collect()]
        dirs = sorted({held[b] for b in touched if b in held})
        if dirs:
            old = _read(spark, path, dirs).withColumn(_BUCKET, bucket_of(key, buckets)).where(F.col(_BUCKET).isin(touched))
            other = incoming.select(F.col(key).alias("_key"))
            incoming = old.join(other, old[key].eqNullSafe(other["_key"]), "left_anti").unionByName(incoming, allowMissingColumns=True)
    incoming.repartition(F.col(_BUCKET)).write.partitionBy(_BUCKET).parquet(f"{path}/{folder}")
    fs, pattern = _fs(spark, f"{path}/{folder}/{_BUCKET}=*")
    made = {int(f.getPath().getName().partition("=")[2]): f"{folder}/{f.getPath().getName()}" for f in fs.globStatus(pattern) or []}
    rows = spark.createDataFrame(sorted((held | made).items()), "bucket int, dir string")
    rows.coalesce(1).write.parquet(f"{path}/manifest/v{number:012d}")
    return number


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete files that none of the last ``keep`` versions names; gives how many folders."""
    known = versions(spark, path)
    live = {d for v in known[-keep:] for d in manifest(spark, path, v).values()}
    fs, pattern = _fs(spark, f"{path}/data/*/{_BUCKET}=*")
    gone = 0
    for f in fs.globStatus(pattern) or []:
        at = f.getPath()
        if f"data/{at.getParent().getName()}/{at.getName()}" not in live:
            fs.delete(at, True)
            gone += 1
    for v in known[:-keep]:
        fs.delete(_fs(spark, f"{path}/manifest/v{v:012d}")[1], True)
    return gone
