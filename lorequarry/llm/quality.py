"""Quality classifier: a factorisation machine.

Features are hashed words (log counts, scaled to unit length), statistics of the
text's structure, and the stored length.  Pairwise interactions have rank
``RANK`` and are scored in time linear in the features, by
``sum_{i<j} <v_i, v_j> x_i x_j = (|sum_i v_i x_i|^2 - sum_i |v_i x_i|^2) / 2``.

The model is fitted in numpy on at most ``SAMPLE`` labelled rows, the ones whose
hashed ids come first; every row is scored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorequarry.llm.arrow import keep_rows, map_batches, pick

BUCKETS = 1 << 12
RANK = 8
#: Most labelled rows that the model is fitted on.
SAMPLE = 4000
FOLDS, HELD_OUT_FOLD = 5, 0
THRESHOLD = 0.3
STEPS, RATE, DECAY = 200, 0.05, 1e-4

_SYMBOL = re.compile(r"[#*$%&|<>]+")
_UPPER = re.compile(r"[^\W\d_a-zß-öø-ÿ]+")
_DIGIT = re.compile(r"[0-9]+")
_PUNCT = re.compile(r"[.,;:!?'\"()\-]+")

STATISTICS = (
    "log_words", "word_length", "symbols", "upper", "digits", "punctuation", "distinct", "top_word", "adjacent", "log_lines",
    "repeated_lines", "log_chars",
)


def _share(pattern: re.Pattern, text: str) -> float:
    return sum(map(len, pattern.findall(text))) / len(text) if text else 0.0


def statistics(text: str, words: list[str], counts: Counter, n_chars: int | None) -> list[float]:
    """The structure of a text, each figure of order one; zeros for an empty text."""
    n = len(words)
    lines = text.split("\n")
    adjacent = sum(a == b for a, b in zip(words, words[1:], strict=False)) if n else 0
    return [
        math.log1p(n) / 8,
        (len(text) - n + 1) / n / 10 if n else 0.0,
        _share(_SYMBOL, text),
        _share(_UPPER, text),
        _share(_DIGIT, text),
        _share(_PUNCT, text),
        len(counts) / n if n else 0.0,
        max(counts.values()) / n if n else 0.0,
        adjacent / n if n else 0.0,
        math.log1p(len(lines)) / 5,
        1 - len(set(lines)) / len(lines),
        math.log1p(max(0, len(text) if n_chars is None else n_chars)) / 10,
    ]


class Featurizer:
    """Texts to sparse rows: ascending ids below ``BUCKETS``, then the statistics."""

    #: Words whose buckets are remembered at once; beyond that the memory starts anew.
    REMEMBERED = 200_000

    def __init__(self) -> None:
        self.bucket: dict[str, int] = {}

    def __call__(self, text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
        text = text or ""
        words = text.split()
        counts = Counter(words)
        known = self.bucket
        for w in set(counts).difference(known):
            known[w] = zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) % BUCKETS
        ids = np.fromiter(map(known.__getitem__, counts), np.int64, len(counts))
        sums = np.bincount(ids, np.fromiter(counts.values(), np.float64, len(counts)), BUCKETS) if len(ids) else np.zeros(BUCKETS)
        at = np.flatnonzero(sums)
        weights = np.log1p(sums[at])
        if len(at):
            weights /= np.sqrt((weights**2).sum())
        if len(known) > self.REMEMBERED:
            known.clear()
        extra = np.array(statistics(text, words, counts, n_chars))
        return (
            np.concatenate([at, np.arange(BUCKETS, BUCKETS + len(extra))]).astype(np.int32),
            np.concatenate([weights, extra]).astype(np.float32),
        )


@dataclass(frozen=True)
class FactorisationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def logit(self, ids: np.ndarray, values: np.ndarray) -> float:
        """Linear in the features: by sum of squares, not by pairs."""
        scaled = self.factors[ids] * values[:, None]
        pairs = (np.square(scaled.sum(axis=0)) - np.square(scaled).sum(axis=0)).sum() / 2
        return float(self.bias + self.linear[ids] @ values + pairs)

    def score(self, ids: np.ndarray, values: np.ndarray) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.logit(ids, values)))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> FactorisationMachine:
    """Fit by Adam on the logistic loss, all rows at each step.  No rows: scores of one half."""
    width = BUCKETS + len(STATISTICS)
    rng = np.random.default_rng(seed)
    if not len(rows):
        return FactorisationMachine(0.0, np.zeros(width, np.float32), np.zeros((width, RANK), np.float32))
    x = np.zeros((len(rows), width), np.float32)
    for k, (ids, values) in enumerate(rows):
        x[k, ids] = values
    x2 = np.square(x)
    y = labels.astype(np.float32)
    share = float(np.clip(y.mean(), 0.01, 0.99))
    params = [np.float32([math.log(share / (1 - share))]), np.zeros(width, np.float32), rng.normal(0, 0.05, (width, RANK)).astype(np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, STEPS + 1):
        bias, linear, factors = params
        inner = x @ factors
        pairs = (np.square(inner).sum(1) - x2 @ np.square(factors).sum(1)) / 2
        gap = (1 / (1 + np.exp(-np.clip(bias + x @ linear + pairs, -30, 30))) - y) / len(y)
        grads = [
            gap.sum(keepdims=True),
            x.T @ gap + DECAY * linear,
            x.T @ (inner * gap[:, None]) - factors * (x2.T @ gap)[:, None] + DECAY * factors,
        ]
        for p, g, m, v in zip(params, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return FactorisationMachine(float(params[0][0]), params[1], params[2])


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo the folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def _features(rows: DataFrame, keep: str) -> DataFrame:
    schema = T.StructType(
        [rows.schema[keep], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.FloatType()))]
    )
    held: list[Featurizer] = []

    def step(cols: dict[str, pa.Array]) -> dict[str, object]:
        featurize = held[0] if held else (held.append(Featurizer()) or held[0])
        made = [featurize(t, n) for t, n in zip(cols["text"].to_pylist(), cols["n_chars"].to_pylist(), strict=True)]
        return {keep: cols[keep], "ids": [m[0] for m in made], "values": [m[1] for m in made]}

    return map_batches(rows, step, schema)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> FactorisationMachine:
    """Fit on labelled rows outside the held-out fold: at most ``sample`` ids, and of
    documents that share an id at most as many rows again.

    A document with several labels counts as good if any says so; null labels are
    left out.
    """
    marks = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
        .where(fold_of(F.col("doc_id")) != HELD_OUT_FOLD)
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    # At most ``sample`` ids: small enough to broadcast whatever the input.  Ids may
    # repeat, so rows are bounded too, and taken in an order of their own.
    joined = pick(docs, "doc_id", "text", "n_chars").join(F.broadcast(marks), "doc_id").select("doc_id", "quality", "text", "n_chars")
    joined = joined.orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text", "n_chars").limit(2 * sample)
    found = _features(joined.select("quality", "text", "n_chars"), "quality").toArrow()
    rows = [
        (np.asarray(i, np.int32), np.asarray(v, np.float32))
        for i, v in zip(found["ids"].to_pylist(), found["values"].to_pylist(), strict=True)
    ]
    return fit(rows, np.array(found["quality"].to_pylist()))


def score_rows(docs: DataFrame, model: FactorisationMachine) -> DataFrame:
    """``doc_id, score`` for each row of ``docs``."""
    rows = pick(docs, "doc_id", "text", "n_chars")
    schema = T.StructType([rows.schema["doc_id"], T.StructField("score", T.DoubleType())])
    held: list[Featurizer] = []

    def step(cols: dict[str, pa.Array]) -> dict[str, object]:
        featurize = held[0] if held else (held.append(Featurizer()) or held[0])
        pairs = zip(cols["text"].to_pylist(), cols["n_chars"].to_pylist(), strict=True)
        return {"doc_id": cols["doc_id"], "score": [model.score(*featurize(t, n)) for t, n in pairs]}

    return map_batches(rows, step, schema)


def good_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text scores at least the threshold, told apart by
    all their columns and never by id; repeated rows stay or go together."""
    model = train(docs, labels)
    return keep_rows(docs, lambda keyed: score_rows(keyed, model).where(F.col("score") >= THRESHOLD))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``.

    Null text is empty and is scored like any other; a null stored length is taken
    from the text; repeated rows stay; an empty table gives an empty one; without
    labels every score is 0.5.  Other columns are ignored.
    """
    scored = score_rows(docs, train(docs, labels))
    return scored.select(
        "doc_id",
        (fold_of(F.col("doc_id")) == HELD_OUT_FOLD).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
