"""Embedding bookkeeping and exact vector search.

Search is brute force over a stated set of questions, in one pass over the vectors:
the questions are a broadcast matrix of a bounded size, each task multiplies its
rows, a batch and a block of questions at a time, and keeps the best of each
question.  Questions beyond that size take another pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from lorequarry.config import CANDIDATES, EMBED_BATCH, TOP_K, VECTOR_CHUNKS
from lorequarry.functions.text import content_key
from lorequarry.operators.ranking import top_per_group

#: Questions that are broadcast at once: so many bytes of doubles.
QUESTION_BYTES = 64 << 20
#: Questions and rows that are multiplied at once.
BLOCK_QUESTIONS, BLOCK_ROWS = 1024, 4096
#: By how much a product of matrices may differ from the distance that decides.
SLACK = 1e-9


def _dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """One minus the cosine, in doubles; null where a vector is zero or lacks."""
    return 1.0 - _dot(a, b) / F.nullif(F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)), F.lit(0.0))


@dataclass(frozen=True)
class Questions:
    """A part of a stated set: ids and vectors; ``lists`` are those that each probes."""

    ids: pa.Array
    vectors: np.ndarray
    lengths: np.ndarray
    lists: np.ndarray | None = None


def matrix(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of ``d`` entries as doubles, and which are of that kind; the others,
    null, of another length or with an entry that is null or not finite, are zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    usable = pc.fill_null(pc.equal(pc.list_value_length(column), d), False).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(column.filter(pa.array(usable))).cast(pa.float64())
    found = np.zeros((len(column), d))
    found[usable] = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, d)
    holes = ~np.isfinite(found).all(axis=1)
    found[holes] = 0.0
    return found, usable & ~holes


def _lengths(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v * v).sum(axis=1))


def distances(v: np.ndarray, v_length: np.ndarray, q: np.ndarray, q_length: np.ndarray) -> np.ndarray:
    """Cosine distance of rows to rows, infinite where a vector is zero.  Each is a
    sum of its own, so that equal vectors have equal distances wherever they stand."""
    size = v_length * q_length
    return np.where(size > 0, 1.0 - np.divide((v * q).sum(axis=1), size, out=np.zeros_like(size), where=size > 0), np.inf)


def question_blocks(questions: DataFrame, most: int = QUESTION_BYTES) -> Iterator[Questions]:
    """A stated set as matrices of bounded size.  The entries of the first vector say
    how many the others have."""
    columns = ["query_id", "embedding", *(["lists"] if "lists" in questions.columns else [])]
    first = questions.select(F.size("embedding").alias("d")).where("d > 0").first()
    d = first["d"] if first else 1
    n = max(1, -(-questions.count() * d * 8 // most))
    for part in range(n):
        rows = questions if n == 1 else questions.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == part)
        held = rows.select(*columns).toArrow()
        vectors, _ = matrix(held["embedding"], d)
        lists = np.array(held["lists"].to_pylist(), int).reshape(len(vectors), -1) if "lists" in columns else None
        yield Questions(held["query_id"].combine_chunks(), vectors, _lengths(vectors), lists)


def _in_order(*keys: np.ndarray) -> np.ndarray:
    """Places by the first key, then the next."""
    return np.lexsort(keys[::-1])


def _rank_of(ids: pa.ChunkedArray) -> np.ndarray:
    """Numbers in the order of ids, which are numbers or texts; null is the smallest."""
    return pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()


def _first_of_each(q: np.ndarray, n: int) -> np.ndarray:
    """Which of some rows, in order of ``q``, are among the first ``n`` of theirs."""
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
    return np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)])) < n


class _Best:
    """The best rows of each question so far, with their other columns."""

    def __init__(self, asked: Questions, k: int, id_col: str, exclude_self: bool):
        self.asked, self.k, self.id_col, self.exclude_self = asked, k, id_col, exclude_self
        self.worst = np.full(len(asked.ids), np.inf)
        self.rows: pa.Table | None = None
        self.q, self.far = np.zeros(0, int), np.zeros(0)

    def _candidates(self, v: np.ndarray, lengths: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and questions (of ``who``) that may be among the best: by products of
        matrices, within a slack that is decided later."""
        found = []
        unit = np.divide(v, lengths[:, None], out=np.zeros_like(v), where=lengths[:, None] > 0)
        for at in range(0, len(who), BLOCK_QUESTIONS):
            some = who[at : at + BLOCK_QUESTIONS]
            q_length = self.asked.lengths[some]
            q = np.divide(self.asked.vectors[some], q_length[:, None], out=np.zeros((len(some), v.shape[1])), where=q_length[:, None] > 0)
            far = 1.0 - q @ unit.T
            far[q_length == 0] = np.inf
            far[:, lengths == 0] = np.inf
            bound = self.worst[some]
            if far.shape[1] > self.k:
                bound = np.minimum(bound, np.partition(far, self.k, axis=1)[:, self.k])  # one more: a row may be the question's own
            row = np.nonzero(far <= (bound + SLACK)[:, None])
            found.append((row[1], some[row[0]]))
        return np.concatenate([r for r, _ in found]), np.concatenate([q for _, q in found])

    def add(self, batch: pa.RecordBatch, v: np.ndarray, who: np.ndarray) -> None:
        """Take in rows that the questions ``who`` are asked of."""
        if not len(who) or not batch.num_rows:
            return
        lengths = _lengths(v)
        # Of equal vectors only the first few ids can be among the best.
        order = _in_order(*_same(v), _rank_of(batch[self.id_col]))
        kept = np.sort(order[_first_of_each(_groups(v[order]), self.k + 1)])
        row, q = self._candidates(v[kept], lengths[kept], who)
        row = kept[row]
        if self.exclude_self:
            other = pc.fill_null(pc.not_equal(batch[self.id_col].take(pa.array(row)), self.asked.ids.take(pa.array(q)).cast(batch[self.id_col].type)), False).to_numpy(zero_copy_only=False)
            row, q = row[other], q[other]
        far = distances(v[row], lengths[row], self.asked.vectors[q], self.asked.lengths[q])
        fresh = pa.Table.from_batches([batch]).take(pa.array(row))
        rows = fresh if self.rows is None else pa.concat_tables([self.rows, fresh])
        q, far = np.concatenate([self.q, q]), np.concatenate([self.far, far])
        order = _in_order(q, far, _rank_of(rows[self.id_col]))
        order = order[_first_of_each(q[order], self.k)]
        self.rows, self.q, self.far = rows.take(pa.array(order)).combine_chunks(), q[order], far[order]
        last = np.flatnonzero(np.bincount(self.q, minlength=len(self.worst)) >= self.k)
        ends = np.cumsum(np.bincount(self.q, minlength=len(self.worst)))
        self.worst[last] = self.far[ends[last] - 1]

    def table(self, names: list[str]) -> list[pa.RecordBatch]:
        if self.rows is None:
            return []
        far = pa.array(self.far, mask=np.isinf(self.far))
        columns = [self.asked.ids.take(pa.array(self.q)), *(self.rows[c] for c in names), far]
        return pa.table(columns, names=["query_id", *names, "distance"]).to_batches()


def _same(v: np.ndarray) -> tuple[np.ndarray, ...]:
    """Two numbers that equal vectors share, and hardly any others."""
    bits = np.ascontiguousarray(v + 0.0).view(np.uint64)
    with np.errstate(over="ignore"):
        odd = np.arange(1, 2 * v.shape[1], 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
        mixed = (bits ^ (bits >> np.uint64(29))) * odd
        return mixed.sum(axis=1, dtype=np.uint64), (mixed ^ (mixed >> np.uint64(32))).sum(axis=1, dtype=np.uint64)


def _groups(v: np.ndarray) -> np.ndarray:
    """A number for each run of equal rows."""
    return np.cumsum(np.r_[False, (v[1:] != v[:-1]).any(axis=1)]) if len(v) else np.zeros(0, int)


def search_pass(rows: DataFrame, asked: Questions, k: int, id_col: str, exclude_self: bool) -> DataFrame:
    """The best rows of each task for each question; of its lists alone if it names some."""
    names = [c for c in rows.columns if c not in ("embedding", "list")]
    schema = T.StructType([T.StructField("query_id", from_arrow_type(asked.ids.type)), *(rows.schema[c] for c in names), T.StructField("distance", T.DoubleType())])
    held = rows.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        questions = held.value
        best = _Best(questions, k, id_col, exclude_self)
        everyone = np.arange(len(questions.ids))
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                v, _ = matrix(part["embedding"], questions.vectors.shape[1])
                if questions.lists is None:
                    best.add(part.select([*names]), v, everyone)
                    continue
                lists = part["list"].to_numpy(zero_copy_only=False)
                for one in np.unique(lists):
                    own = np.flatnonzero(lists == one)
                    best.add(part.select([*names]).take(pa.array(own)), v[own], np.flatnonzero((questions.lists == one).any(axis=1)))
        yield from best.table(names)

    return rows.mapInArrow(run, schema)


def top_k(
    collection: DataFrame,
    questions: DataFrame,
    k: int = TOP_K,
    where: Column | None = None,
    id_col: str = "chunk_id",
    exclude_self: bool = False,
    question_bytes: int = QUESTION_BYTES,
) -> DataFrame:
    """The ``k`` nearest rows of ``collection`` (``id_col, embedding, ...``) for each
    of ``questions`` (``query_id, embedding``): ``query_id``, the row, ``distance``
    and ``rank``.  ``where`` filters before the search; ties go to the smaller id.

    Exact: products of matrices choose who may be among the best, and a distance of
    its own decides.  A null or zero vector, or one of another length, is at no
    distance and comes last.  Questions that share an id share a ranking.
    """
    rows = collection if where is None else collection.where(where)
    passes = [search_pass(rows, asked, k, id_col, exclude_self) for asked in question_blocks(questions, question_bytes)]
    order = [F.col("distance").asc_nulls_last(), F.col(id_col).asc()]
    return top_per_group(reduce(DataFrame.unionByName, passes), ["query_id"], order, k)


def over_fetch(hits: DataFrame, keep: Column, k: int = TOP_K) -> DataFrame:
    """Filter hits after their limit, then the first ``k``: rows beyond the limit do
    not come back, however few pass."""
    return top_per_group(hits.where(keep).withColumnRenamed("rank", "fetched_rank"), ["query_id"], [F.col("fetched_rank")], k)


def search_with_filter(
    collection: DataFrame, questions: DataFrame, where: Column | None, keep: Column, k: int = TOP_K, candidates: int = CANDIDATES
) -> DataFrame:
    """Filter, take the ``candidates`` nearest, filter those, take ``k``."""
    return over_fetch(top_k(collection, questions, candidates, where), keep, k)


def rows_to_hits(rows: DataFrame) -> DataFrame:
    """Search results as hits: the chunk's stored id, else its row id; empty for null."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return rows.select(
        "query_id",
        F.coalesce(F.nullif("chunk_id", F.lit("")), F.col("id")).alias("chunk_id"),
        text("document"), text("arxiv_id"), text("section"), text("authors"), "year", "distance", "rank",
    )


def collapse_to_papers(hits: DataFrame, n: int = VECTOR_CHUNKS) -> DataFrame:
    """Papers in the order in which they first appear among the first ``n`` hits:
    ``query_id, doc_id, rank, first_chunk_rank``.  Blank papers are skipped."""
    seen = hits.where((F.col("rank") <= n) & (F.trim(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) != ""))
    firsts = seen.groupBy("query_id", "doc_id").agg(F.min("rank").alias("first_chunk_rank"))
    return top_per_group(firsts, ["query_id"], [F.col("first_chunk_rank")], n)


# --- the embedding cache ------------------------------------------------------


def usable_chunks(chunks: DataFrame, counted: Observation | None = None) -> DataFrame:
    """Chunks with a text and an id.  ``counted`` gets ``chunks`` and ``dropped`` from the
    pass that reads the result, as soon as that has ended."""
    filled = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    usable = filled("text") & filled("chunk_id")
    seen = chunks if counted is None else chunks.observe(counted, F.count(F.lit(1)).alias("chunks"), F.count_if(~usable).alias("dropped"))
    return seen.where(usable)


def probe_cache(chunks: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """``chunks`` with ``cache_key`` and the cached ``embedding``, null on a miss."""
    keyed = chunks.withColumn("cache_key", content_key(model, F.col("text")))
    return keyed.join(cache.select("cache_key", "embedding").dropDuplicates(["cache_key"]), "cache_key", "left")


def _by_index(answer: list) -> list:
    """A service's vectors in the order asked for; none where an index lacks or repeats."""
    if not answer or not isinstance(answer[0], tuple):
        return answer
    indexed = dict(answer)
    return [indexed[i] for i in range(len(answer))] if indexed.keys() == set(range(len(answer))) else []


def embed_missing(probed: DataFrame, embed: Callable[[list[str]], list[list[float]]], batch: int = EMBED_BATCH) -> DataFrame:
    """``cache_key, embedding`` for each distinct text that missed.

    ``embed`` runs on the executors, on at most ``batch`` texts at a time, and returns
    vectors in order, or pairs of index and vector in any order; a batch that returns
    another number of them, or not each index once, is dropped.
    """
    missing = probed.where("embedding is null").select("cache_key", "text").dropDuplicates(["cache_key"])
    arrow = pa.schema([("cache_key", pa.string()), ("embedding", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                vectors = _by_index(embed(part["text"].to_pylist()))
                if len(vectors) == part.num_rows:
                    yield pa.RecordBatch.from_arrays([part["cache_key"], pa.array(vectors, arrow.field(1).type)], schema=arrow)

    return missing.mapInArrow(run, "cache_key string, embedding array<float>")


def embed_questions(questions: DataFrame, cache: DataFrame, embed: Callable[[list[str]], list[list[float]]], model: str) -> tuple[DataFrame, DataFrame]:
    """``questions`` (``query_id, text``) with their ``embedding``, and what to add to
    the cache.  A blank question is left out, as nothing can be like it."""
    probed = probe_cache(questions.where(F.trim(F.coalesce("text", F.lit(""))) != ""), cache, model)
    fresh = embed_missing(probed, embed)
    known = probed.drop("embedding").join(cache.select("cache_key", "embedding").unionByName(fresh).dropDuplicates(["cache_key"]), "cache_key")
    return known, fresh


def require_rows(collection: DataFrame, name: str = "collection") -> DataFrame:
    """The collection, or an error where it has no row to search."""
    if collection.isEmpty():
        raise ValueError(f"the {name} is empty: build the index first")
    return collection


def collection_rows(chunks: DataFrame) -> DataFrame:
    """Chunks as rows of a collection: no null text, authors joined, year only if whole."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return chunks.select(
        "chunk_id", F.coalesce("text", F.lit("")).alias("document"), "embedding", text("arxiv_id"), text("method"), text("source_file"), text("section"),
        F.array_join(F.coalesce("authors", F.array().cast("array<string>")), "; ").alias("authors"),
        F.when(F.col("year").cast("string").rlike(r"^\d+$"), F.col("year").cast("string").try_cast("int")).alias("year"),
    )
