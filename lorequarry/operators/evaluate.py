"""Evaluation: recall at k, judges' scores, and the summary of stages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorequarry.config import RECALL_KS
from lorequarry.functions.text import bare_paper_id, format_metric


def explode_gold(gold: DataFrame) -> DataFrame:
    """``query_id, gold_id, gold_no``: chunks and papers together; repeats count."""
    ids = F.concat(F.coalesce("relevant_chunks", F.array().cast("array<string>")), F.coalesce("relevant_papers", F.array().cast("array<string>")))
    return gold.select("query_id", F.posexplode(F.filter(ids, lambda x: F.trim(x) != "")).alias("gold_no", "gold_id"))


def recall_at_k(gold: DataFrame, hits: DataFrame, ks: tuple[int, ...] = RECALL_KS) -> DataFrame:
    """``query_id, recall_at_<k>`` for each question of ``gold`` (``query_id,
    relevant_chunks, relevant_papers``); null where it has no gold.

    ``hits``: ``query_id, rank, chunk_id, doc_id``.  A gold id is met by an equal
    chunk or paper id, or by the same paper regardless of version and chunk.
    """
    keys = F.array_distinct(F.array_compact(F.array("chunk_id", "doc_id", bare_paper_id(F.col("chunk_id")), bare_paper_id(F.col("doc_id")))))
    found = hits.where(F.col("rank") <= max(ks)).select("query_id", "rank", F.explode(keys).alias("key")).groupBy("query_id", "key").agg(F.min("rank").alias("rank"))
    golds = explode_gold(gold)
    sides = F.array_distinct(F.array("gold_id", bare_paper_id(F.col("gold_id"))))
    met = golds.select("*", F.explode(sides).alias("key")).join(found, ["query_id", "key"], "left").groupBy("query_id", "gold_no").agg(F.min("rank").alias("rank"))
    shares = met.groupBy("query_id").agg(*(F.avg((F.coalesce("rank", F.lit(k + 1)) <= k).cast("double")).alias(f"recall_at_{k}") for k in ks))
    return gold.select("query_id").distinct().join(shares, "query_id", "left")


def stage_means(per_question: DataFrame, metrics: list[str]) -> DataFrame:
    """Means by stage, of what is not null; a stage without any is null."""
    return per_question.groupBy("stage").agg(*(F.avg(m).alias(m) for m in metrics))


def summary(means: DataFrame, metrics: list[str]) -> DataFrame:
    """The means as text: four places, or that there are none."""
    return means.select("stage", *(format_metric(F.col(m)).alias(m) for m in metrics))


def write_summary(formatted: DataFrame, csv_path: str, order: tuple[str, ...]) -> str:
    """Write the CSV and return Markdown, stages in their order: a row for each stage."""
    place = reduce(lambda e, ix: e.when(F.col("stage") == ix[1], ix[0]), enumerate(order[1:], 1), F.when(F.col("stage") == order[0], 0))
    rows = formatted.orderBy(place).coalesce(1)
    rows.write.mode("overwrite").option("header", True).csv(csv_path)
    head = f"| {' | '.join(rows.columns)} |\n|{'---|' * len(rows.columns)}\n"
    return head + "\n".join(f"| {' | '.join(map(str, r))} |" for r in rows.collect())
