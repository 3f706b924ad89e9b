"""The indexed fuzzy joins against all pairs, and the bit-parallel subsequence."""

import random
import time

import pytest
from lorequarry.functions import text
from lorequarry.functions.lcs import lcs
from lorequarry.operators import fuzzy
from pyspark.sql import functions as F

LETTERS = "abcdeé😀"


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


def test_lcs_of_random_strings_up_to_500():
    rng = random.Random(3)
    for n in (1, 2, 7, 63, 64, 65, 128, 129, 500):
        for letters in ("ab", LETTERS):
            a, b = ("".join(rng.choices(letters, k=rng.randint(0, n))) for _ in range(2))
            assert lcs(a, b) == lcs(b, a) == slow_lcs(a, b)
    assert lcs("", "") == lcs("abc", "") == 0


def test_lcs_takes_time_in_proportion():
    a, b = "ab" * 32, "ba" * 50_000
    began = time.perf_counter()
    assert lcs(a, b) == 64
    assert time.perf_counter() - began < 1


def noisy(rng, name):
    chars = list(name)
    for _ in range(rng.randint(0, 4)):
        at = rng.randrange(len(chars) + 1)
        if chars and rng.random() < 0.5:
            del chars[min(at, len(chars) - 1)]
        else:
            chars.insert(at, rng.choice(LETTERS + " "))
    parts = "".join(chars).split(" ")
    rng.shuffle(parts)
    return " ".join(parts)


def names(rng, n):
    words = ["".join(rng.choices(LETTERS, k=rng.randint(1, 9))) for _ in range(25)]
    made = [" ".join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(n)]
    return made + [noisy(rng, m) for m in made] + [m.upper() for m in made[:5]] + [made[0][:3], made[1][:4], "a, b.", "aa aa aa", "aaa aaa", "ab" * 400, "", "  ", None]


def all_pairs(spark, asked, texts, score, least):
    left = spark.createDataFrame([(x,) for x in asked], "query string").distinct()
    right = spark.createDataFrame([(x,) for x in texts], "label string").distinct()
    scored = left.crossJoin(right).select("query", "label", score(F.col("query"), F.col("label")).alias("score"))
    return {(r.query, r.label, r.score) for r in scored.where(F.col("score") >= least).collect()}


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("least", [0.85, 0.7, 0.95])
def test_names_found_by_index_are_those_of_all_pairs(spark, seed, least):
    rng = random.Random(seed)
    made = names(rng, 30)
    asked, texts = rng.sample(made, 40), made + made[:7]
    frame = lambda rows, c: spark.createDataFrame([(x,) for x in rows], f"{c} string")
    found = fuzzy.like_names(frame(asked, "query"), frame(texts, "label"), least).collect()
    want = all_pairs(spark, asked, texts, text.tiered_name_score, least)
    assert {tuple(r) for r in found} == want and len(found) == len(want) and len(want) > 20


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("least", [0.75, 0.9])
def test_titles_found_by_index_are_those_of_all_pairs(spark, seed, least):
    rng = random.Random(seed + 10)
    made = names(rng, 30)
    asked, texts = rng.sample(made, 40), made + made[:7]
    frame = lambda rows, c: spark.createDataFrame([(x,) for x in rows], f"{c} string")
    found = fuzzy.like_titles(frame(asked, "query"), frame(texts, "label"), least).collect()
    want = all_pairs(spark, asked, texts, text.title_score, least)
    assert {tuple(r) for r in found} == want and len(found) == len(want) and len(want) > 20


def test_nothing_asked_and_nothing_to_find(spark):
    empty, one = (spark.createDataFrame(rows, "query string, label string") for rows in ([], [("ada byron", "ada byron")]))
    for find in (fuzzy.like_names, fuzzy.like_titles):
        assert find(empty.select("query"), one.select("label"), 0.85).count() == 0
        assert find(one.select("query"), empty.select("label"), 0.85).count() == 0
    with pytest.raises(ValueError, match="2/3"):
        fuzzy.close_pairs(one.select("query"), one.select("label"), 0.5)


def test_plans_have_no_cross_join_of_texts(spark):
    """The one row of lengths is the only thing that meets all texts."""
    frame = lambda c: spark.createDataFrame([("ada byron",)], f"{c} string")
    plan = fuzzy.like_titles(frame("query"), frame("label"), 0.75)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan
