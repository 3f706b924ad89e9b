"""Writers: overwrite, append, skip what is there, and upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorequarry.operators.ranking import first_per_key


def overwrite_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def missing(df: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not there yet."""
    return df.join(existing.select(key).distinct(), key, "left_anti")


def append_missing(df: DataFrame, path: str, key: str) -> None:
    """Append rows whose key the table at ``path`` lacks; done again, nothing happens."""
    spark = df.sparkSession
    try:
        existing = spark.read.parquet(path)
    except Exception as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        existing = df.limit(0)
    missing(df, existing, key).write.mode("append").parquet(path)


def upsert(existing: DataFrame, new: DataFrame, key: str, seq: str | None = None) -> DataFrame:
    """``existing`` with the rows of ``new`` in place of those of the same key; of
    several new rows of a key the last by ``seq``."""
    order = [F.col("_new").desc()] + ([F.col(seq).desc()] if seq else [])
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return first_per_key(both, [key], order).drop("_new")


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Write both tables, and fail if what was written holds a node twice."""
    spark = nodes.sparkSession
    for name, df in (("nodes", nodes), ("edges", edges)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    if spark.read.parquet(f"{path}/nodes").select("kind", "id").distinct().count() != spark.read.parquet(f"{path}/nodes").count():
        raise ValueError("a node stands twice in the saved graph")
