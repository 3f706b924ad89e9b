"""Benchmark decontamination: BM25 over test items, searched by block-max WAND.

The test items are the indexed side; each training passage is a query.  An item's
score for a passage is its BM25 score divided by the score it would get from
itself, so one threshold serves all items.  All items above it are retrieved, and
then verified: five-word shingles of the item, and the words of its question and
of its answer (its last sentence), must stand in the passage.

Items longer than ``UNIT`` words are indexed as units of that length.  Passages
are windows that overlap by ``UNIT`` words, so a unit that stands in a document
stands whole in some window.  The question and the answer of such an item are looked
for in the whole document, as no window need hold them.

Document frequencies, the number of units and their mean length are those of the
whole benchmark.  Units reach the workers with their impacts, in blocks of at most
``INDEX_UNITS``; how they are cut into blocks changes no score.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorequarry.llm.arrow import keep_rows, pick, texts
from lorequarry.scratch import spool

K1, B = 1.2, 0.75
#: Words of an indexed unit, and of a passage.
UNIT, PASSAGE = 64, 256
#: Least share of an item's own BM25 score.
THRESHOLD = 0.6
BLOCK = 4
SHINGLE, MIN_SHINGLES = 5, 0.8
MIN_QUESTION, MIN_ANSWER = 0.8, 0.5
#: Most units in one index; larger benchmarks are searched in several.
INDEX_UNITS = 16384

_SENTENCE_END = re.compile(r"[.!?][\"')\]]*\s+")


def words_of(text: str) -> list[str]:
    """Runs of anything but ASCII white space, in lower case."""
    return [w.decode("utf-8", "surrogatepass") for w in text.lower().encode("utf-8", "surrogatepass").split()]


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The last sentence is the answer; a single sentence is split at its last third."""
    ends = [m.end() for m in _SENTENCE_END.finditer(text.strip())]
    if ends:
        return words_of(text.strip()[: ends[-1]]), words_of(text.strip()[ends[-1] :])
    words = words_of(text)
    cut = len(words) - max(1, len(words) // 3) if words else 0
    return words[:cut], words[cut:]


def shingles(words: list[str], n: int = SHINGLE) -> set[tuple[str, ...]]:
    """Word n-grams; all the words as one where there are fewer."""
    if len(words) < n:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(n)), strict=False))


class Parts:
    """The words of an item's question and answer; one object for all its units."""

    def __init__(self, text: str) -> None:
        question, answer = question_and_answer(text)
        self.bags = Counter(question), Counter(answer)
        #: Whether no passage need hold them.
        self.long = len(question) + len(answer) > UNIT


@dataclass
class Item:
    """One unit of a test item: its words, its terms with their shares of the unit's
    own BM25 score, and the parts of the whole item."""

    item_id: object
    words: tuple[str, ...]
    terms: tuple[tuple[str, float], ...]
    parts: Parts

    @cached_property
    def grams(self) -> frozenset:
        return frozenset(shingles(list(self.words)))


def units(text: str | None) -> list[list[str]]:
    """The words of an item as units of at most ``UNIT``; none for an empty text."""
    words = words_of(text or "")
    # The tail takes words of the unit before.
    return [words[at : at + UNIT] if at + UNIT <= len(words) or not at else words[-UNIT:] for at in range(0, len(words), UNIT)]


class BlockMaxIndex:
    """Postings of normalised BM25 impacts, with the maximum of each block of units."""

    def __init__(self, items: list[Item]) -> None:
        self.items = items
        postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for at, item in enumerate(items):
            for w, x in item.terms:
                postings[w].append((at, x))
        self.postings = {w: ([p[0] for p in ps], [p[1] for p in ps]) for w, ps in postings.items()}
        self.vocabulary = self.postings.keys()
        self.n_blocks = -(-len(items) // BLOCK)
        self.block_max: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for w, (ids, impacts) in self.postings.items():
            most: dict[int, float] = {}
            for i, x in zip(ids, impacts, strict=True):
                most[i // BLOCK] = max(most.get(i // BLOCK, 0.0), x)
            self.block_max[w] = (np.fromiter(most, np.int64, len(most)), np.fromiter(most.values(), float, len(most)))

    def search(self, words: set[str], threshold: float = THRESHOLD) -> list[tuple[int, float]]:
        """All ``(unit, score)`` of at least ``threshold``.

        A block whose summed maxima stay below the threshold holds no pivot and is
        skipped whole; within the others WAND moves its cursors.
        """
        terms = list(words & self.vocabulary)
        if not terms:
            return []
        maxima = [self.block_max[w] for w in terms]
        bounds = np.bincount(
            np.concatenate([m[0] for m in maxima]), np.concatenate([m[1] for m in maxima]), self.n_blocks
        )
        found = []
        for block in np.flatnonzero(bounds >= threshold - 1e-9).tolist():
            found += self._wand(terms, block, threshold)
        return found

    def _wand(self, terms: list[str], block: int, threshold: float) -> list[tuple[int, float]]:
        """Document-at-a-time WAND over one block, with the block's maxima as bounds."""
        end, cursors = (block + 1) * BLOCK, []
        for w in terms:
            ids, impacts = self.postings[w]
            at = bisect_left(ids, block * BLOCK)
            stop = at
            most = 0.0
            while stop < len(ids) and ids[stop] < end:
                most = max(most, impacts[stop])
                stop += 1
            if stop > at:
                cursors.append([ids[at], at, stop, most, ids, impacts])
        found = []
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, None
            for c in cursors:
                bound += c[3]
                if bound >= threshold - 1e-9:
                    pivot = c[0]
                    break
            if pivot is None:
                break
            if cursors[0][0] == pivot:
                score = 0.0
                for c in cursors:
                    if c[0] == pivot:
                        score += c[5][c[1]]
                        c[1] += 1
                if score >= threshold - 1e-9:
                    found.append((pivot, score))
            else:
                for c in cursors:
                    if c[0] < pivot:
                        c[1] = bisect_left(c[4], pivot, c[1], c[2])
            for c in cursors:
                c[0] = c[4][c[1]] if c[1] < c[2] else end
            cursors = [c for c in cursors if c[1] < c[2]]
        return found


def _share(need: Counter, have: Counter) -> float:
    total = sum(need.values())
    return sum(min(n, have[w]) for w, n in need.items()) / total if total else 1.0


@dataclass(frozen=True)
class Match:
    item_id: object
    bm25: float
    shingle_overlap: float
    question_overlap: float
    answer_overlap: float


def matches(index: BlockMaxIndex, text: str) -> list[Match]:
    """Verified items of one document, the best passage of each."""
    words = words_of(text)
    best: dict[object, Match] = {}
    step = PASSAGE - UNIT
    whole_bag: Counter | None = None
    shares: dict[Parts, list[float]] = {}
    for at in range(0, max(1, len(words) - UNIT), step):
        passage = words[at : at + PASSAGE]
        hits = index.search(set(passage))
        if not hits:
            continue
        grams, bag = shingles(passage), Counter(passage)
        for unit, score in hits:
            item = index.items[unit]
            overlap = len(item.grams & grams) / len(item.grams)
            if len(item.words) < SHINGLE and overlap < 1:  # fewer words than a shingle: look for the run
                n = len(item.words)
                overlap = float(any(tuple(passage[i : i + n]) == item.words for i in range(len(passage) - n + 1)))
            if overlap < MIN_SHINGLES:
                continue
            if item.parts.long:  # the same for all units of the item that stand in the document
                if item.parts not in shares:
                    whole_bag = Counter(words) if whole_bag is None else whole_bag
                    shares[item.parts] = [_share(part, whole_bag) for part in item.parts.bags]
                question, answer = shares[item.parts]
            else:
                question, answer = (_share(part, bag) for part in item.parts.bags)
            if question >= MIN_QUESTION and answer >= MIN_ANSWER:
                found = Match(item.item_id, round(score, 12), overlap, question, answer)
                held = best.get(item.item_id)
                if held is None or (found.shingle_overlap, found.bm25) > (held.shingle_overlap, held.bm25):
                    best[item.item_id] = found
    return list(best.values())


def weighed_units(benchmark: DataFrame) -> DataFrame:
    """``item_id, item, unit, words, terms, text``: each unit of each item, its terms
    with their shares of the unit's own BM25 score, by the statistics of the whole
    benchmark.  ``text`` stands with an item's first unit only: words are shuffled under
    a unit's number, so that an item costs in proportion to its length.

    Null ids and null or empty texts give none; repeated items count once.
    """
    rows = pick(benchmark, "item_id", "text").where("text is not null and item_id is not null").distinct()
    cut = F.udf(units, "array<array<string>>")
    items = rows.select("item_id", "text", F.monotonically_increasing_id().alias("item"))
    made = spool(
        items.select("item_id", "item", "text", F.posexplode(cut("text")).alias("unit", "words"))
        .select("item_id", "item", "unit", "words", F.when(F.col("unit") == 0, F.col("text")).alias("text")),
        "leak-units",
    )
    n, mean = made.agg(F.count("*"), F.avg(F.size("words"))).first()
    keys = ["item", "unit"]
    counts = made.select(*keys, F.size("words").alias("n"), F.explode("words").alias("word")).groupBy(*keys, "n", "word").agg(F.count("*").alias("tf"))
    seen = counts.groupBy("word").agg(F.count("*").alias("df"))
    idf = F.log1p((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    length = K1 * (1 - B + B * F.col("n") / F.lit(mean or 1.0))
    impacts = counts.join(seen, "word").withColumn("x", idf * F.col("tf") * (K1 + 1) / (F.col("tf") + length))
    # At most ``UNIT`` terms meet in a unit.
    own = impacts.groupBy(*keys).agg(F.sum("x").alias("own"), F.sort_array(F.collect_list(F.struct("word", "x"))).alias("terms"))
    share = F.transform("terms", lambda t: F.struct(t["word"].alias("word"), (t["x"] / F.col("own")).alias("x")))
    return made.join(own.select(*keys, share.alias("terms")), keys).select("item_id", *keys, "words", "terms", "text")


def _indexes(benchmark: DataFrame) -> Iterator[list[Item]]:
    """The units in blocks of at most ``INDEX_UNITS``, streamed to the driver."""
    held: list[Item] = []
    parts = Parts("")
    for row in spool(weighed_units(benchmark), "leak-weighed").orderBy("item", "unit").toLocalIterator():
        if row["unit"] == 0:
            parts = Parts(row["text"])
        held.append(Item(row["item_id"], tuple(row["words"]), tuple((t[0], t[1]) for t in row["terms"]), parts))
        if len(held) >= INDEX_UNITS:
            yield held
            held = []
    if held:
        yield held


#: The index that this process has built last, by the key of its block.
_built: dict[str, BlockMaxIndex] = {}


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, bm25, shingle_overlap, question_overlap, answer_overlap``:
    a row for each row of ``docs`` and each test item that it holds.

    Every document is searched whole.  Null and empty texts, of either table, match
    nothing; a repeated document gives its rows again; repeated items count once;
    empty tables give an empty one; other columns are ignored.  Ids may be of any
    type.  A benchmark of more than ``INDEX_UNITS`` units is searched in blocks.
    """
    rows = pick(docs, "doc_id", "text")
    schema = T.StructType(
        [
            T.StructField("doc_id", rows.schema["doc_id"].dataType),
            T.StructField("item_id", benchmark.schema["item_id"].dataType),
            *(T.StructField(n, T.DoubleType()) for n in ("bm25", "shingle_overlap", "question_overlap", "answer_overlap")),
        ]
    )
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    spark = docs.sparkSession
    out = spark.createDataFrame([], schema)
    for items in _indexes(benchmark):
        shipped, key = spark.sparkContext.broadcast(items), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped, key=key) -> Iterator[pa.RecordBatch]:
            from lorequarry.llm.decontaminate import _built

            if key not in _built:
                _built.clear()
                _built[key] = BlockMaxIndex(shipped.value)
            index = _built[key]
            for batch in batches:
                found = []
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    for doc_id, text in zip(part["doc_id"].to_pylist(), texts(part["text"]), strict=True):
                        found += [{"doc_id": doc_id} | m.__dict__ for m in matches(index, text)]
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema=arrow)

        out = out.union(rows.mapInArrow(run, schema))
    return out


def remove_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text holds a test item.

    Rows are told apart by all their columns and never by id: of rows of null or
    repeated id, those whose texts are clean stay.  Repeated rows stay or go together.
    """
    return keep_rows(docs, lambda keyed: find_leaks(keyed, benchmark), "left_anti")
