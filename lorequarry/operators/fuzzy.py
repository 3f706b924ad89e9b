"""Fuzzy joins by inverted index: only pairs that can reach a score are scored.

The texts of one side are looked up by what a match must share with them, in
equi-joins; there is no cross join, and no cap on what is found.

* **Bigrams.**  Each token, with a space before and after, is cut into bigrams; the
  bag of a text does not hang on the order of its tokens.  Deleting a character
  destroys two bigrams at most, adding one destroys one.  So texts of lengths ``p``
  and ``q`` whose Indel similarity is ``t`` share ``(1.5 t - 1) (p + q) + 1`` bigrams,
  and neither is longer than ``(2 - t) / t`` times the other.  An asked text
  is looked up under its rarest bigrams, as many as cannot all be missed; the
  pairs found are counted, and subsequences are measured for what is left.
* **Tokens.**  A common part that makes up a share of one text's characters holds one
  of any tokens that make up more than the rest; the longest few are looked up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorequarry.functions.text import (
    PREFIX_LETTERS, bind, clean_text, folded, tier_tokens, tiered_name_score, title_score, tokens_of,
)
from lorequarry.scratch import spool

#: Scores are rounded to four places, so one just below the least may still reach it.
ROUNDING = 1e-4


def bigrams(tokens: Column) -> Column:
    """The bag of bigrams of an array of tokens, each with its number among equals."""
    grams = F.flatten(
        F.transform(tokens, lambda t: F.transform(F.sequence(F.lit(1), F.length(t) + 1), lambda i: F.substring(F.concat(F.lit(" "), t, F.lit(" ")), i, 2)))
    )
    # Bound, so that the bag is made once and not once for each gram.
    return bind(F.array_sort(grams), lambda bag: F.transform(bag, lambda g, i: F.concat(g, (i - F.array_position(bag, g)).cast("string"))))


def shared_at_least(p: Column, q: Column, t: float) -> Column:
    """Bigrams that texts of two lengths share if their similarity is ``t`` or more."""
    return F.ceil((1.5 * t - 1) * (p + q) + 1 - 1e-9)


def close_pairs(asked: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """``query, label``: all pairs whose ``tokens``, joined in some order, may have an
    Indel similarity of ``least`` (over 2/3); pairs that cannot are mostly left out.

    ``asked`` has ``query, tokens``, ``texts`` has ``label, tokens``, each once; those
    without tokens meet nothing.  Lengths are compared before any text is cut up.
    """
    t = least - ROUNDING
    if 1.5 * t <= 1:
        raise ValueError("a similarity of 2/3 or less is not bound to share a bigram")
    wide = (2 - t) / t
    long = lambda: F.length(F.array_join("tokens", " "))
    left = asked.where(F.size("tokens") > 0).select("query", F.col("tokens").alias("asked_tokens"), long().alias("p"))
    ends = left.agg(F.floor(F.min("p") / wide).alias("from_length"), F.ceil(F.max("p") * wide).alias("to_length"))
    sized = texts.select("label", "tokens", long().alias("q")).where(F.size("tokens") > 0)
    right = sized.join(F.broadcast(ends), F.col("q").between(F.col("from_length"), F.col("to_length"))).select("label", "tokens", "q")
    # Written, so that few of them are known to be few before all texts' are dealt out to meet them.
    probes = spool(left.select("query", "p", F.explode(bigrams(F.col("asked_tokens"))).alias("gram")), "asked-grams")
    # The part of the index that any question looks at, written once: it is counted, and then read.
    grams = right.select("label", "q", F.explode(bigrams(F.col("tokens"))).alias("gram"))
    index = spool(grams.join(probes.select("gram").distinct(), "gram", "left_semi"), "grams")
    counted = index.groupBy("gram").agg(F.count("*").alias("texts"))
    rarest = Window.partitionBy("query").orderBy(F.coalesce("texts", F.lit(0)), "gram")
    fewest = F.col("p") + 2 - shared_at_least(F.col("p"), F.ceil(F.col("p") / wide), t)
    chosen = probes.join(counted, "gram", "left").withColumn("nth", F.row_number().over(rarest)).where(F.col("nth") <= fewest)
    p, q = F.col("p"), F.col("q")
    met = chosen.join(index, "gram").where((q <= F.ceil(p * wide)) & (p <= F.ceil(q * wide)))
    pairs = spool(met.select("query", "label").distinct(), "pairs-by-gram")
    both = F.size(F.array_intersect(bigrams(F.col("asked_tokens")), bigrams(F.col("tokens"))))
    return pairs.join(left, "query").join(right, "label").where(both >= shared_at_least(p, q, t)).select("query", "label")


def like_names(asked: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """``query, label, score``: pairs whose ``tiered_name_score`` is ``least`` or more.

    ``asked`` has ``query``, ``texts`` has ``label``; repeats count once, and null and
    blank ones are like nothing.
    """
    n = spool(asked.select("query", folded(F.col("query")).alias("n")).where("n <> ''").distinct(), "asked-names")
    h = spool(texts.select("label").distinct().select("label", folded(F.col("label")).alias("h")).where("h <> ''"), "names")
    equal = n.join(h, F.col("n") == F.col("h")).select("query", "label")
    parts = h.select("label", F.explode(F.array_distinct(tier_tokens(F.col("h")))).alias("token"))
    token = n.join(parts, F.col("n") == F.col("token")).select("query", "label")
    # Beginnings only of the lengths that are asked for: one row, of as many numbers as names have lengths.
    lengths = F.broadcast(n.agg(F.collect_set(F.when(F.length("n") >= PREFIX_LETTERS, F.length("n"))).alias("lengths")))
    begun = parts.crossJoin(lengths).select(
        "label", F.explode(F.transform(F.filter("lengths", lambda k: k <= F.length("token")), lambda k: F.substring(F.col("token"), F.lit(1), k))).alias("begins")
    )
    prefix = n.join(begun, F.col("n") == F.col("begins")).select("query", "label")
    close = close_pairs(n.select("query", tokens_of(F.col("n")).alias("tokens")), h.select("label", tokens_of(F.col("h")).alias("tokens")), least)
    # Written, or the filter by score would run in each branch, before repeats are gone.
    pairs = spool(equal.unionByName(token).unionByName(prefix).unionByName(close).distinct(), "pairs-of-names")
    scored = pairs.select("query", "label", tiered_name_score(F.col("query"), F.col("label")).alias("score"))
    return scored.where(F.col("score") >= least)


def _telling(tokens: Column, share: float) -> Column:
    """The longest of a text's tokens that make up more than the share that may be missing.

    A token weighs its length and a space.  If a common part weighs ``share`` of the
    whole, it holds one of these.
    """
    weigh = lambda least: F.aggregate(tokens, F.lit(0), lambda s, x: s + F.when(F.length(x) >= least, F.length(x) + 1).otherwise(0))
    lengths = F.array_distinct(F.transform(tokens, F.length))
    cutoff = F.array_max(F.filter(lengths, lambda n: weigh(n) > (1 - share) * weigh(F.lit(0))))
    return F.filter(tokens, lambda x: F.length(x) >= cutoff)


def like_titles(asked: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """``query, label, score``: pairs whose ``title_score`` is ``least`` (over 2/3) or more.

    The score is the best of three: common tokens against either whole, found by
    token, and the wholes against each other, found by bigram.  ``asked`` has ``query``,
    ``texts`` has ``label``; repeats count once, null and blank ones are like nothing.
    """
    t = least - ROUNDING
    share = t / (2 - t)  # of the characters of a whole, so that 2 s / (s + whole) >= t
    words = lambda df, c: df.select(c).distinct().where(clean_text(F.col(c)) != "").select(c, F.array_distinct(tokens_of(F.col(c))).alias("tokens"))
    n, h = spool(words(asked, "query"), "asked-titles"), spool(words(texts, "label"), "titles")
    some = lambda df, c, ts: df.select(c, F.explode(ts).alias("token"))
    mine = some(n, "query", _telling(F.col("tokens"), share)).join(some(h, "label", F.col("tokens")), "token")
    theirs = some(n, "query", F.col("tokens")).join(some(h, "label", _telling(F.col("tokens"), share)), "token")
    pairs = spool(mine.select("query", "label").unionByName(theirs.select("query", "label")).unionByName(close_pairs(n, h, least)).distinct(), "pairs-of-titles")
    return pairs.select("query", "label", title_score(F.col("query"), F.col("label")).alias("score")).where(F.col("score") >= least)

