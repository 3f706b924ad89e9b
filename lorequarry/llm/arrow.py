"""Small helpers for operators that run on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of whole texts handed to Python at once.  A batch is copied a few times,
#: so its size, and not the size of a partition, is what a worker holds.
BATCH_ROWS = 256


def map_batches(
    df: DataFrame, step: Callable[[dict[str, pa.Array]], dict[str, object]], schema: StructType
) -> DataFrame:
    """Apply ``step`` to each Arrow batch of ``df``, as columns by name.

    ``step`` gets pyarrow arrays and returns arrays (or lists) in ``schema``.
    Batches are cut to ``BATCH_ROWS`` rows so that very long texts do not add up.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                out = step(dict(zip(part.schema.names, part.columns, strict=True)))
                columns = [
                    c if isinstance(c, pa.Array) else pa.array(c, f.type)
                    for f, c in ((f, out[f.name]) for f in arrow)
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.mapInArrow(run, schema)


def texts(column: pa.Array) -> list[str]:
    """The strings of a column; null becomes the empty text."""
    return [x or "" for x in column.to_pylist()]


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, whatever else the table carries."""
    return df.select(*(F.col(f"`{n}`") for n in names))


def row_keys(docs: DataFrame) -> list[Column]:
    """``row_key, row_check``: two 64-bit hashes of all columns.  Only rows that are
    equal in all columns share both."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    return [F.xxhash64(whole).alias("row_key"), F.xxhash64(F.lit(1), whole).alias("row_check")]


def keep_rows(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], how: str = "left_semi") -> DataFrame:
    """The rows of ``docs`` that ``judge`` returns (or, with ``left_anti``, does not).

    ``judge`` gets the columns of ``docs``, with the row's own key for a ``doc_id``,
    and returns ``doc_id`` of some; so no row is kept or lost for the id that it
    shares.  Repeated rows stay or go together.
    """
    key = F.struct(*row_keys(docs))
    found = judge(docs.withColumn("doc_id", key)).select(F.col("doc_id.*")).toDF("found_key", "found_check").distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *row_keys(docs))
    return rows.join(found, (rows["row_key"] == found["found_key"]) & (rows["row_check"] == found["found_check"]), how).select("row.*")


#: Bits of a sieve: a fixed 4 MB, whatever the input.
SIEVE_BITS = 1 << 25


def sieve(keys: DataFrame, key: str) -> Broadcast:
    """A bit array that has a bit for each of some 64-bit keys, of a fixed size.

    It tells most other keys apart, so that their rows need not be shuffled to a
    join; the join stays exact.  With very many keys it only stops saving.
    """
    bit = F.pmod(F.col(key), F.lit(SIEVE_BITS))
    places = keys.select(F.floor(bit / 64).cast("int").alias("word"), (bit % 64).cast("int").alias("at"))
    found = places.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("bits")).toArrow()
    held = np.zeros(SIEVE_BITS // 64, "<i8")
    held[found["word"].to_numpy()] = found["bits"].to_numpy()
    return keys.sparkSession.sparkContext.broadcast(held)


def sifted(rows: DataFrame, key: str, held: Broadcast, hit: bool = True) -> DataFrame:
    """The rows whose key may be among those of a sieve; or those whose key is not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = held.value
        for batch in batches:
            bit = batch[key].to_numpy() % SIEVE_BITS
            found = (words[bit >> 6] >> (bit & 63) & 1) == 1
            if found.any() if hit else not found.all():
                yield batch.filter(pa.array(found == hit))

    return rows.mapInArrow(run, rows.schema)
