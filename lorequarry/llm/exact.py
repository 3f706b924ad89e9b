"""Exact duplicates, with frequent texts taken out of the shuffle.

Texts are told apart by the SHA-256 of their UTF-8 bytes, a null text counting as
empty.  Of equal texts the row with the largest id stays.

A text that fills a third of the table would put a third of the rows into one
task.  So each task keeps a Misra-Gries summary of the digests that it reads;
the summaries are added up, and every digest in more than ``3 / (counters + 1)``
of the rows is among the ``counters`` that can be left.  Their groups are then
counted exactly, with partial sums in each task, and the winners (so many rows at
most) are broadcast: a row of a frequent text learns its fate without moving.
Every other digest is shuffled, in groups that have that bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorequarry.llm.arrow import pick
from lorequarry.scratch import spool

#: Digests in a summary, and so the most rows that are ever broadcast.
COUNTERS = 1023


def summarise(counts: dict[bytes, int], counters: int) -> dict[bytes, int]:
    """A Misra-Gries summary of at most ``counters`` keys: of more, the count of the
    first that has no place is taken off all, and what is used up goes."""
    if len(counts) <= counters:
        return counts
    most = np.fromiter(counts.values(), np.int64, len(counts))
    off = int(np.partition(most, len(most) - counters - 1)[len(most) - counters - 1])
    return {k: n - off for k, n in counts.items() if n > off}


def _summaries(digests: DataFrame, counters: int) -> DataFrame:
    """``digest, seen``: the summary of each task; ``seen`` is at most the true count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        rows = 0
        for batch in batches:
            rows += batch.num_rows
            found = pc.value_counts(batch["digest"])
            for k, n in zip(found.field("values").to_pylist(), found.field("counts").to_pylist(), strict=True):
                held[k] = held.get(k, 0) + n
            held = summarise(held, counters)
        # What is this rare in a task's own rows cannot make a digest frequent.
        kept = [(k, n) for k, n in held.items() if n * (counters + 1) > rows]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in kept], pa.binary()), pa.array([n for _, n in kept], pa.int64())], names=["digest", "seen"])

    return digests.mapInArrow(run, "digest binary, seen bigint")


def frequent(marked: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """``digest`` of at most ``counters`` rows, with all that are in more than
    ``3 / (counters + 1)`` of the rows.

    A task's summary counts a digest short by less than its share of the rows, and
    leaves out less than that again, so the sum of a digest beyond three shares is
    beyond one; and as sums add up to the rows at most, so many digests can be.
    """
    share = marked.count() / (counters + 1)
    summed = _summaries(marked.select("digest"), counters).groupBy("digest").agg(F.sum("seen").alias("seen"))
    return spool(summed.where(F.col("seen") > share).select("digest"), "exact-frequent")


def _text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _winners(rows: DataFrame, counters: int) -> DataFrame:
    """``digest, group_size, winner`` of the frequent digests, counted over all rows."""
    held = rows.join(F.broadcast(frequent(rows, counters)), "digest")
    return spool(
        held.groupBy("digest").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row_no")).alias("winner")), "exact-winners"
    )


def _decided(rows: DataFrame, winners: DataFrame) -> DataFrame:
    """``rows`` (``doc_id, row_no, digest``) with their ``group_size`` and ``winner``."""
    heavy = rows.join(F.broadcast(winners), "digest")
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    group = Window.partitionBy("digest")
    light = rest.withColumns({"group_size": F.count("*").over(group), "winner": F.max(F.struct("doc_id", "row_no")).over(group)})
    return heavy.unionByName(light)


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Null text is empty; a null id is smaller than any other.  Of equal texts exactly
    one row is kept, the one with the largest id; of rows that share that id too,
    the last in the order in which they are stored.  An empty table gives an empty
    one; other columns are ignored.
    """
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text")
    marked = spool(rows.select("doc_id", F.monotonically_increasing_id().alias("row_no"), _text_digest(F.col("text")).alias("digest")), "exact-digests")
    return _decided(marked, _winners(marked, counters)).select(
        "doc_id", F.col("winner.doc_id").alias("keep_id"), "group_size",
        (F.col("row_no") == F.col("winner.row_no")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; see ``duplicates``.

    Losing copies of frequent texts go where they are read, before any shuffle.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = spool(
        docs.select(row.alias("row"), F.monotonically_increasing_id().alias("row_no"), _text_digest(F.col(f"`{text_col}`")).alias("digest")), "exact-rows"
    )
    marked = rows.select(F.col("row").getField(id_col).alias("doc_id"), "row_no", "digest")
    winners = _winners(marked, counters)
    chosen = winners.select("digest", F.col("winner.row_no").alias("stays"))
    left = rows.join(F.broadcast(chosen), "digest", "left").where("stays is null or stays = row_no").select("row", "row_no")
    gone = _decided(marked.join(F.broadcast(winners.select("digest")), "digest", "left_anti"), winners).where("row_no <> winner.row_no").select("row_no")
    return left.join(gone, "row_no", "left_anti").select("row.*")


DUPLICATES_SQL = """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
  sha256(coalesce(text, '')) AS text_sha256 FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""
