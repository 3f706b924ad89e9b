"""Quality rules by distribution divergence, in DataFrame functions only.

A document's character classes and its common words are counted and set against
the same histograms over all documents of its language.  The Jensen-Shannon
distance (base 2, 0 to 1) to either reference rejects a document; each histogram
is judged only where the text is long enough for it.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorequarry.llm.arrow import keep_rows, pick
from lorequarry.scratch import spool

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Least code points, and least words, for each histogram to count.
MIN_CHARS_FOR_CLASSES = 200
MIN_WORDS_FOR_COMMON = 200
MAX_CLASS_DISTANCE = 0.17
MAX_COMMON_DISTANCE = 0.3

SPACE = r"[ \t-\r]"
SYMBOLS = "#*$%&|<>"

# The most common words of each language, most common first.
COMMON_WORDS = {
    "en": "the of and to in a is that for it as was with be by on".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par".split(),
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht".split(),
    "es": "de la que el en y a los se del las un por con no una".split(),
}

#: Most languages whose references are broadcast (under 1 KB each).
BROADCAST_LANGUAGES = 1000
#: Up to so many repeated hashes, a text's windows look themselves up one by one.
SHORT_LIST = 64


def word_list(text: Column) -> Column:
    """Runs of anything but ASCII white space."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def _bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once: a lambda over an array of one."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more.

    Most texts have no such window, which hashes show at once: distinct hashes are
    distinct windows.  Of the others, the windows whose hash repeats are sorted by
    content, so that the count is of equal windows and not of equal hashes.
    """
    last = F.size(words) - 3
    every = F.sequence(F.lit(0), F.greatest(last, F.lit(0)))

    def cover(at: Column) -> Column:
        windows = F.sort_array(
            F.transform(
                at,
                lambda i: F.struct(
                    F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i")
                ),
            )
        )

        def covered(s: Column) -> Column:
            equal = lambda x, j: F.coalesce(F.get(s, j)["w"] == x["w"], F.lit(False))
            found = F.filter(s, lambda x, j: equal(x, j - 1) | equal(x, j + 1))
            return F.size(F.array_distinct(F.flatten(F.transform(found, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

        return _bind(windows, covered)

    def counted(hashes: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            return F.array_distinct(F.filter(s, lambda x, j: F.coalesce(F.get(s, j + 1) == x, F.lit(False))))

        def of_repeated(twice: Column) -> Column:
            # A short list is searched; where much repeats, all windows are sorted.
            some = F.filter(every, lambda i: F.array_contains(twice, F.get(hashes, i)))
            return F.when(F.size(twice) <= SHORT_LIST, cover(some)).otherwise(cover(every))

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            _bind(_bind(F.sort_array(hashes), of_sorted), of_repeated)
        )

    hashes = F.transform(every, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(last < 1, F.lit(0)).otherwise(_bind(hashes, counted)).cast("long")


def _common_counts(words: Column, lang: Column) -> Column:
    """Counts of the language's common words, in their order; empty where it has no list.

    Each word becomes its place in the list (0: not in it).  Sorted together with one
    marker for each place, the words of a place stand between two markers.
    """
    out = F.array().cast("array<bigint>")
    for code, listed in sorted(COMMON_WORDS.items()):
        out = F.when(lang == code, _counts_in_order(words, listed)).otherwise(out)
    return out


def _counts_in_order(words: Column, listed: list[str]) -> Column:
    places = F.array(*(F.lit(w) for w in listed))
    markers = F.array(*(F.lit(i).cast("long") for i in range(1, len(listed) + 2)))
    found = F.sort_array(F.concat(F.transform(words, lambda w: F.array_position(places, F.lower(w))), markers))
    return _bind(
        found,
        lambda s: F.array(
            *(F.array_position(s, i + 1) - F.array_position(s, i) - 1 for i in range(1, len(listed) + 1))
        ),
    )


#: Character classes that are counted by taking them away, most frequent first.
CLASSES = {
    "plain": string.ascii_lowercase + string.digits,
    "space": " \t\n\x0b\x0c\r",
    "upper": string.ascii_uppercase,
    "punct": ".,;:!?'\"()-",
    "n_symbols": SYMBOLS,
}


def _class_counts(text: Column) -> Column:
    """A struct of the code points in each class, and of the rest.

    Each class is taken away from what the one before has left, so that all but the
    first pass read a small part of the text.
    """

    def take(rest: Column, names: list[str], lengths: list[Column]) -> Column:
        lengths = [*lengths, F.length(rest).cast("long")]
        if not names:
            counts = [(a - b).alias(n) for n, a, b in zip(CLASSES, lengths, lengths[1:], strict=False)]
            return F.struct(*counts, lengths[-1].alias("other"))
        return _bind(F.translate(rest, CLASSES[names[0]], ""), lambda r: take(r, names[1:], lengths))

    return _bind(text, lambda t: take(t, list(CLASSES), []))


def measure(docs: DataFrame) -> DataFrame:
    """The counts of each document: the contract's, ``classes`` and ``common``."""
    rows = pick(docs, "doc_id", "lang", "text").select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")
    )
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \t-\r]"))
    by_word = _bind(
        word_list(text),
        lambda ws: F.struct(
            F.size(ws).cast("long").alias("n_words"),
            _repeat_words(ws).alias("n_repeat_words"),
            _common_counts(ws, F.col("lang")).alias("listed"),
        ),
    )
    counted = rows.select(
        "doc_id",
        "lang",
        F.length(text).cast("long").alias("n_chars"),
        _bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        by_word.alias("by_word"),
        _class_counts(text).alias("by_class"),
    ).select("*", "by_word.*", "by_class.*")
    listed = F.aggregate("listed", F.lit(0).cast("long"), lambda a, x: a + x)
    return counted.select(
        "doc_id", "lang", "n_words", (F.col("n_chars") - F.col("space")).alias("word_chars"), "n_symbols", "n_dup_lines",
        "n_repeat_words", "n_chars",
        F.array(*CLASSES, "other").alias("classes"),
        F.when(F.size("listed") > 0, F.concat("listed", F.array(F.col("n_words") - listed))).otherwise(F.col("listed")).alias("common"),
    )


def references(measured: DataFrame) -> DataFrame:
    """For each language, the summed histograms over all its documents."""
    width = 1 + max(map(len, COMMON_WORDS.values()))
    sums = [F.sum(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(7)]
    sums += [F.sum(F.get("common", F.lit(i))).alias(f"w{i}") for i in range(width)]
    return measured.groupBy("lang").agg(*sums).select(
        "lang",
        F.array(*(F.coalesce(f"c{i}", F.lit(0)) for i in range(7))).alias("class_reference"),
        F.array_compact(F.array(*(F.col(f"w{i}") for i in range(width)))).alias("common_reference"),
    )


def js_distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of two histograms of the same bins; 0 where either is empty."""
    add = lambda a, x: a + x
    zero = F.lit(0.0)
    n = F.aggregate(counts, zero, add)
    total = F.aggregate(reference, zero, add)

    def bin_part(a: Column, b: Column) -> Column:
        p, q = a / n, b / total
        m = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / m)).otherwise(zero) + F.when(q > 0, q * F.log2(q / m)).otherwise(zero)

    parts = F.zip_with(counts, reference, bin_part)
    distance = F.sqrt(F.greatest(F.aggregate(parts, zero, lambda a, x: a + F.coalesce(x, zero)) / 2, zero))
    return F.when((n > 0) & (total > 0), distance).otherwise(zero)


def _distances(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with both distances; 0 where a text is too short or has no reference.

    The references have a row for each language.  Their number is counted: few of
    them are broadcast, as a language may hold most rows; otherwise the rows are
    shuffled, and a hot language is left to the skew handling of the join.
    """
    found = spool(found, "rule-references")
    side = F.broadcast(found) if found.count() <= BROADCAST_LANGUAGES else found
    joined = rows.drop("class_distance", "common_distance").join(side, "lang", "left")
    classes = F.when(F.col("n_chars") >= MIN_CHARS_FOR_CLASSES, js_distance(F.col("classes"), F.col("class_reference")))
    common = F.when(F.col("n_words") >= MIN_WORDS_FOR_COMMON, js_distance(F.col("common"), F.col("common_reference")))
    return joined.select(
        rows["*"], F.coalesce(classes, F.lit(0.0)).alias("class_distance"), F.coalesce(common, F.lit(0.0)).alias("common_distance")
    )


def judge(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (``doc_id, lang, text``): the counts,
    ``base_failed``, ``class_distance``, ``common_distance`` and ``kept``.

    Null text is empty, and fails the base rule; null language is a language of
    its own; a language without a word list is judged by character classes alone.
    Repeated rows stay; an empty table gives an empty one; other columns are ignored.
    """
    measured = spool(measure(docs), "rule-counts")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = measured.withColumn("base_failed", failed)
    # First all documents give the references, then those that are near them.
    first = _distances(rows, references(measured))
    near = (F.col("class_distance") <= MAX_CLASS_DISTANCE) & (F.col("common_distance") <= MAX_COMMON_DISTANCE)
    trimmed = references(first.where(near & ~F.col("base_failed")))
    scored = _distances(rows, trimmed)
    verdict = (F.col("class_distance") <= MAX_CLASS_DISTANCE) & (F.col("common_distance") <= MAX_COMMON_DISTANCE)
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance",
        "common_distance", (~F.col("base_failed") & verdict).alias("kept"),
    )


def kept_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, told apart by all their columns and
    never by id; repeated rows stay or go together."""
    return keep_rows(docs, lambda keyed: judge(keyed).where("kept"))
