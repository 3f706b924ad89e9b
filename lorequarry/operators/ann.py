"""An inverted file of vectors: approximate search beside the exact one.

Centroids are trained on a bounded sample; every row is stored in the list of its
nearest one, and a question reads the lists of the few centroids nearest to it.
With all lists probed the search is exact.  How many to probe is measured, against
exact search, on a bounded set of questions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorequarry.config import TOP_K
from lorequarry.operators.ranking import top_per_group
from lorequarry.operators.vectors import QUESTION_BYTES, matrix, question_blocks, search_pass, top_k
from lorequarry.scratch import new_path

#: Rows that centroids are trained on, at most; rounds of training; questions that probes are measured on.
SAMPLE, ROUNDS, MEASURED = 16_384, 12, 256
#: Vectors without a direction are in no centroid's list.
NOWHERE = -1


@dataclass(frozen=True)
class VectorIndex:
    """Rows with their ``list``, stored by list, and the centroids."""

    rows: DataFrame
    centroids: np.ndarray
    id_col: str


def _units(v: np.ndarray) -> np.ndarray:
    size = np.sqrt((v * v).sum(axis=1))[:, None]
    return np.divide(v, size, out=np.zeros_like(v), where=size > 0)


def train(sample: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """``lists`` unit centroids of unit vectors, by rounds of assigning and averaging;
    a centroid that loses all its vectors moves to the one that is worst served."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), lists, replace=False)].copy()
    for _ in range(rounds):
        near = sample @ centroids.T
        own = near.argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        idle = np.flatnonzero(np.bincount(own, minlength=lists) == 0)
        sums[idle] = sample[np.argsort(near.max(axis=1), kind="stable")[: len(idle)]]
        centroids = _units(sums)
    return centroids


def _nearest_lists(rows: DataFrame, centroids: np.ndarray, probes: int, name: str) -> DataFrame:
    """``rows`` with the numbers of the ``probes`` nearest centroids, nearest first; of
    a vector without a direction ``NOWHERE``."""
    held = rows.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = held.value
        for batch in batches:
            v, _ = matrix(batch["embedding"], centres.shape[1])
            near = np.argsort(-(_units(v) @ centres.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
            near[~v.any(axis=1)] = NOWHERE
            yield batch.append_column(name, pa.array(near.tolist(), pa.list_(pa.int32())))

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))]))


def build_index(collection: DataFrame, lists: int | None = None, id_col: str = "chunk_id", sample: int = SAMPLE) -> VectorIndex:
    """Train on at most ``sample`` rows, taken by the hash of their id, and store every
    row; by default as many lists as the root of the rows.  A list of any size is
    spread over tasks by id.  A table without a usable vector has one empty list.
    """
    spark = collection.sparkSession
    d = (collection.select(F.size("embedding").alias("d")).where("d > 0").first() or [1])[0]
    taken = collection.orderBy(F.xxhash64(id_col), id_col).limit(sample).select("embedding").toArrow()
    units = _units(matrix(taken["embedding"], d)[0])
    units = units[units.any(axis=1)]
    wanted = lists or max(1, round(collection.count() ** 0.5))
    centroids = train(units, min(wanted, len(units))) if len(units) else np.zeros((1, d))
    placed = _nearest_lists(collection, centroids, 1, "list").withColumn("list", F.get("list", F.lit(0)))
    path = new_path(spark, "inverted-file")
    placed.repartitionByRange("list", F.xxhash64(id_col)).write.partitionBy("list").parquet(path)
    schema = T.StructType([f for f in placed.schema if f.name != "list"] + [placed.schema["list"]])
    return VectorIndex(spark.read.schema(schema).parquet(path), centroids, id_col)


def search(index: VectorIndex, questions: DataFrame, probes: int, k: int = TOP_K, exclude_self: bool = False, question_bytes: int = QUESTION_BYTES) -> DataFrame:
    """As ``top_k``, but among the rows of the ``probes`` lists nearest to each question.
    Lists that no question probes are not read."""
    asked = _nearest_lists(questions.select("query_id", "embedding"), index.centroids, probes, "lists")
    asked = asked.withColumn("lists", F.transform(F.sequence(F.lit(0), F.lit(min(probes, len(index.centroids)) - 1)), lambda i: F.coalesce(F.get("lists", i), F.lit(NOWHERE))))
    passes = []
    for block in question_blocks(asked, question_bytes):
        probed = [int(x) for x in np.unique(block.lists)]
        passes.append(search_pass(index.rows.where(F.col("list").isin(probed)), block, k, index.id_col, exclude_self))
    order = [F.col("distance").asc_nulls_last(), F.col(index.id_col).asc()]
    return top_per_group(reduce(DataFrame.unionByName, passes), ["query_id"], order, k)


def recall(found: DataFrame, exact: DataFrame, id_col: str = "chunk_id") -> float:
    """The share of the exact hits that were found; 1 where there are none."""
    hit = found.select("query_id", id_col, F.lit(1.0).alias("hit"))
    share = exact.join(hit, ["query_id", id_col], "left").agg(F.avg(F.coalesce("hit", F.lit(0.0)))).first()[0]
    return 1.0 if share is None else share


def probes_for(index: VectorIndex, questions: DataFrame, least: float = 0.9, k: int = TOP_K, exclude_self: bool = False, measured: int = MEASURED) -> int:
    """The fewest probes with which the search finds ``least`` of what exact search does,
    on at most ``measured`` questions.

    A hit is found if its list is probed; so one exact search says for each hit how far
    down the question's order of lists its own is.
    """
    some = questions.orderBy(F.xxhash64("query_id"), "query_id").limit(measured)
    exact = top_k(index.rows.withColumn("in_list", F.col("list")), some, k, None, index.id_col, exclude_self)
    order = _nearest_lists(some.select("query_id", "embedding"), index.centroids, len(index.centroids), "lists")
    at = exact.join(order.select("query_id", "lists"), "query_id").select(F.array_position("lists", F.col("in_list")).alias("at")).collect()
    places = sorted(r["at"] or len(index.centroids) for r in at)  # a row that is in no list is never found
    return int(places[max(0, int(np.ceil(least * len(places))) - 1)]) if places else 1
