"""Stage files that keep coming: a file stream that upserts each batch.

The reader's checkpoint records the files it has taken, so each is taken once;
a batch that runs again writes the same rows, as the collection is keyed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lorequarry.sources import buckets
from lorequarry.sources.writers import upsert


def file_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New Parquet files under ``path`` as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def upsert_stream(stream: DataFrame, table_dir: str, checkpoint: str, key: str) -> StreamingQuery:
    """Keep the newest row of each key under ``table_dir``, a version for each batch.

    Readers take the last version whose writing has succeeded, so they never see
    half a batch.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        previous = current_version(spark, table_dir, before=batch_id)
        rows = batch.withColumn("_batch", F.lit(batch_id))
        base = spark.read.parquet(previous) if previous else rows.limit(0)
        upsert(base, rows, key, "_batch").write.mode("overwrite").parquet(f"{table_dir}/v{batch_id:012d}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_stream(stream: DataFrame, table_dir: str, checkpoint: str, key: str, seq: str | None = None, n_buckets: int = buckets.BUCKETS) -> StreamingQuery:
    """Merge each batch into a table in buckets: a batch costs the buckets that it
    touches, and one that runs again changes nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        buckets.merge(batch, table_dir, key, seq, n_buckets, batch_id)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_version(spark: SparkSession, table_dir: str, before: int | None = None) -> str | None:
    """The path of the last whole version (of those before a batch); None at first."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{table_dir}/v*/_SUCCESS")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) or []
    paths = sorted(str(f.getPath().getParent()) for f in found)
    whole = [p for p in paths if before is None or int(p.rpartition("/v")[2]) < before]
    return whole[-1] if whole else None
