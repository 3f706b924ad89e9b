"""Ranks, limits and rank fusion.

A ranking is a table ``query_id, doc_id, rank`` (1 is best).  Ranks are columns;
nothing depends on the order of rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorequarry.config import GRAPH_WEIGHT, RRF_K, VECTOR_WEIGHT


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group, with their rank.  The limit is pushed
    below the shuffle, so a group of any size sends ``n`` rows a task."""
    numbered = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.where(F.col(rank) <= n)


def ranked(df: DataFrame, keys: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """All rows of each group, with their rank."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


#: Rows of a stated set that meet all rows of a table in one pass.
ASKED_A_BLOCK = 1000


def in_blocks(asked: DataFrame, key: str, size: int = ASKED_A_BLOCK) -> list[DataFrame]:
    """A stated set in parts of about ``size`` rows, each small enough to broadcast."""
    n = max(1, -(-asked.count() // size))
    return [asked] if n == 1 else [asked.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]


def meet(rows: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """All rows with each row of a stated set."""
    return reduce(DataFrame.unionByName, (rows.crossJoin(F.broadcast(block)) for block in in_blocks(asked, key)))


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_per_group(df, keys, order, 1, "_first").drop("_first")


def year_asc(year: str = "year", *ids: str) -> list[Column]:
    """Papers by year, unknown years last, then id."""
    return [F.col(year).asc_nulls_last(), *(F.col(i).asc() for i in ids)]


def graph_order(score: str = "score", year: str = "year", doc: str = "arxiv_id") -> list[Column]:
    """Best score first, then the latest year, unknown years last, then id."""
    return [F.col(score).desc(), F.col(year).desc_nulls_last(), F.col(doc).asc()]


def first_positions(ranking: DataFrame) -> DataFrame:
    """The first rank of each document; blank ids take a rank but are not kept."""
    kept = ranking.where(F.trim(F.coalesce("doc_id", F.lit(""))) != "")
    return kept.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))


def tagged(graph: DataFrame, vector: DataFrame) -> DataFrame:
    """Both rankings under each other, with the list that a row is from."""
    sides = [first_positions(r).withColumn("list", F.lit(n)) for n, r in (("graph", graph), ("vector", vector))]
    return sides[0].unionByName(sides[1])


def _membership() -> list[Column]:
    return [F.max(F.col("list") == n).alias(f"in_{n}") for n in ("graph", "vector")]


def rrf(graph: DataFrame, vector: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion: ``query_id, doc_id, score, in_graph, in_vector``."""
    return tagged(graph, vector).groupBy("query_id", "doc_id").agg(
        F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"), *_membership()
    )


def min_max(value: Column, over) -> Column:
    """Scaled to 0..1 within a window; a constant list is all ones."""
    low, high = F.min(value).over(over), F.max(value).over(over)
    return F.when(high <= low, F.lit(1.0)).otherwise((value - low) / (high - low))


def weighted(graph: DataFrame, vector: DataFrame, w_graph: float = GRAPH_WEIGHT, w_vector: float = VECTOR_WEIGHT) -> DataFrame:
    """Weighted sum of scaled reciprocal ranks; a list without the document adds nothing."""
    scaled = tagged(graph, vector).withColumn(
        "scaled", min_max(1.0 / F.col("rank"), Window.partitionBy("query_id", "list"))
    )
    weight = F.when(F.col("list") == "graph", F.lit(w_graph)).otherwise(F.lit(w_vector))
    return scaled.groupBy("query_id", "doc_id").agg(F.sum(weight * F.col("scaled")).alias("score"), *_membership())


def fuse(method: str, graph: DataFrame, vector: DataFrame) -> DataFrame:
    return weighted(graph, vector) if method == "weighted" else rrf(graph, vector)


def with_fused_rank(fused: DataFrame, n: int | None = None) -> DataFrame:
    """Ranked by score, then id; scores are compared at twelve places, as sums of
    the same terms may differ in their last bit."""
    order = [F.round("score", 12).desc(), F.col("doc_id").asc()]
    ranked = fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked if n is None else ranked.where(F.col("rank") <= n)


def context_hits(fused: DataFrame, chunks: DataFrame, papers: DataFrame) -> DataFrame:
    """For each fused document its best chunk, else a card with the paper's title.

    ``fused``: ``query_id, doc_id, rank``; ``chunks``: ``query_id, doc_id, chunk_id,
    text, section, rank``; ``papers``: ``doc_id, title``.
    """
    best = first_per_key(chunks, ["query_id", "doc_id"], [F.col("rank"), F.col("chunk_id")]).select(
        "query_id", "doc_id", F.col("chunk_id").alias("best_id"), F.col("text").alias("best_text"), F.col("section").alias("best_section")
    )
    card = F.concat(F.lit("(graf) "), F.coalesce(F.nullif("title", F.lit("")), F.col("doc_id")))
    return (
        fused.join(best, ["query_id", "doc_id"], "left")
        .join(papers.select("doc_id", "title"), "doc_id", "left")
        .select(
            "query_id", "doc_id", "rank",
            F.coalesce("best_id", F.concat("doc_id", F.lit("_graph"))).alias("chunk_id"),
            F.when(F.col("best_id").isNotNull(), F.col("best_text")).otherwise(card).alias("text"),
            F.when(F.col("best_id").isNotNull(), F.col("best_section")).otherwise(F.lit("graph")).alias("section"),
        )
    )
