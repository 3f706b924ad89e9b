"""Whitening against the eigenvectors of a covariance worked out in one place."""

import numpy as np
import pytest
from lorequarry.llm import whiten
from lorequarry.llm.queries import QUERIES
from pyspark.sql import functions as F

SCHEMA = "vec_id bigint, embedding array<float>"


def by_hand(vectors, k=32):
    x = np.floor(64 * np.asarray(vectors, np.float32).astype(float)) + 1_000_000
    c = x - x.mean(axis=0)
    values, units = np.linalg.eigh(c.T @ c / len(x))
    order = np.argsort(-values)[: min(k, len(values))]
    n, s = len(x), x.astype(np.int64).astype(object).sum(axis=0)
    deviation = [int(((n * r.astype(np.int64).astype(object) - s) ** 2).sum()) for r in x]
    return c @ units[:, order] / np.sqrt(values[order]), values[order] / values.sum(), deviation


def compared(rows, vectors, ids, k=32):
    whitened, explained, deviation = by_hand(vectors, k)
    some = whitened.shape[1]
    found = {(r.vec_id, r.component): r for r in rows}
    assert len(rows) == len(found) == len(vectors) * some
    made = np.array([[found[i, j + 1].whitened for j in range(some)] for i in ids])
    sign = np.sign((made * whitened).sum(axis=0))
    assert np.abs(made - whitened * sign).max() < 1e-6
    assert all(abs(found[ids[0], j + 1].explained - explained[j]) < 1e-9 for j in range(some))
    assert [found[i, 1].deviation for i in ids] == deviation
    assert {r.n for r in rows} == {len(vectors)} and len({r.identity_error for r in rows}) == 1
    assert rows[0].identity_error < 1e-9
    assert np.abs(np.cov(made.T, bias=True) - np.eye(some)).max() < 1e-9


@pytest.mark.parametrize("d,n", [(5, 40), (33, 300), (64, 200)])
def test_by_hand(spark, d, n):
    rng = np.random.default_rng(d)
    vectors = (rng.normal(0, 1, (n, d)) @ rng.normal(0, 1, (d, d)) + rng.normal(0, 5, d)).astype(np.float32)
    vectors[: n // 3] = vectors[0]
    made = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], SCHEMA).repartition(37)
    compared(whiten.whiten(made).collect(), vectors, range(n))


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    compared(QUERIES["op11_whitening"](spark, sf).collect(), [r.embedding for r in table], [r.vec_id for r in table])


def test_broken_rows_repeats_and_clashing_columns(spark):
    good = [(i, [float(i % 5), float(i * i % 7), float(i)]) for i in range(20)]
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [float("nan"), 0.0, 1.0]), (103, [float("-inf"), 0.0, 1.0]), (104, []), (105, [1.0, 2.0]), (106, [1e30, 0.0, 0.0])]
    made = spark.createDataFrame(good + bad, SCHEMA).withColumns({"x": F.lit(1), "n": F.lit("n"), "whitened": F.lit(None).cast("double")})
    compared(whiten.whiten(made).collect(), [v for _, v in good], range(20))
    twice = whiten.whiten(made.union(made)).collect()
    assert len(twice) == 2 * 20 * 3 and {r.n for r in twice} == {40}


def test_rows_that_do_not_differ(spark):
    made = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert whiten.whiten(made([])).count() == 0
    assert whiten.whiten(made([(1, [1.0, 2.0])])).count() == 0
    assert whiten.whiten(made([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    flat = [(i, [float(i), 3.0, 2.0 * i]) for i in range(30)]
    rows = whiten.whiten(made(flat)).collect()
    assert {r.component for r in rows} == {1} and abs(rows[0].explained - 1) < 1e-12 and rows[0].identity_error < 1e-9


def test_jacobi_keeps_the_digits_of_small_values():
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.normal(size=(12, 12)))
    scaled = q * 10.0 ** -np.arange(12)  # columns are orthogonal: their lengths are the values
    values, units = whiten.jacobi(scaled)
    assert np.allclose(values, 10.0 ** -np.arange(12), rtol=1e-12, atol=0)
    assert np.allclose(units.T @ units, np.eye(12), atol=1e-14)


def test_tournament_meets_everyone_once():
    for d in (1, 2, 3, 8, 9):
        pairs = [(p, q) for a, b in whiten.tournament(d) for p, q in zip(a, b, strict=True)]
        assert sorted(pairs) == [(p, q) for p in range(d) for q in range(p + 1, d)]
        assert all(len({*a, *b}) == len(a) + len(b) for a, b in whiten.tournament(d))


def test_deviations_are_exact_at_any_size():
    x = np.array([[1_000_064, 1_000_000], [999_936, 1_000_001]], np.int64)
    for n in (2, 10**9, 10**13):
        sums = [1_000_003 * n + 7, 1_000_000 * n + n - 1]
        made = whiten.Whitening(n, sums, np.zeros((2, 0)), np.zeros(0), 0.0).deviations(x)
        true = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
        assert made == [t if t < 1 << 63 else None for t in true]
