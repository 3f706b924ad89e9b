"""Search by products of matrices against a plain loop, and the inverted file."""

import numpy as np
import pytest
from lorequarry.operators import ann, vectors
from pyspark.sql import functions as F

SCHEMA = "chunk_id {}, embedding array<float>, label int"


def by_hand(rows, asked, k, exclude_self=False):
    out = {}
    for q_id, q in asked:
        hits = []
        for c_id, v, _ in rows:
            if exclude_self and c_id == q_id:
                continue
            whole = v is not None and q is not None and len(v) == len(q) and None not in v and None not in q
            a, b = (np.array(x, np.float32).astype(float) if whole else np.zeros(1) for x in (v, q))
            size = np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())
            hits.append((1 - (a * b).sum() / size if size > 0 else np.inf, c_id))
        out[q_id] = [c for _, c in sorted(hits)[:k]]
    return out


def taken(df):
    found = {}
    for r in df.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.chunk_id)
    return found


@pytest.mark.parametrize("kind", ["bigint", "string"])
@pytest.mark.parametrize("exclude_self", [True, False])
def test_same_rows_as_a_loop_with_ties_zeros_and_broken_vectors(spark, kind, exclude_self):
    rng = np.random.default_rng(1)
    name = (lambda i: i) if kind == "bigint" else (lambda i: f"é{i}")
    rows = [(name(i), [float(x) for x in rng.integers(-2, 3, 4)], i % 3) for i in range(300)]
    rows += [(name(1000 + i), [1.0, 2.0, 0.0, 1.0], 7) for i in range(150)]
    rows += [(name(2000), None, 1), (name(2001), [0.0] * 4, 1), (name(2002), [1.0, 2.0], 1), (name(2003), [1.0, None, 0.0, 1.0], 1)]
    asked = [(r[0], r[1]) for r in rows if r[1] and len(r[1]) == 4 and None not in r[1] and any(r[1])][::9] + [(name(2001), [0.0] * 4)]
    made = spark.createDataFrame(rows, SCHEMA.format(kind)).repartition(6)
    questions = spark.createDataFrame(asked, f"query_id {kind}, embedding array<float>")
    for size in (64 << 20, 10 * 4 * 8):
        got = vectors.top_k(made, questions, 7, exclude_self=exclude_self, question_bytes=size)
        assert taken(got) == by_hand(rows, asked, 7, exclude_self)
    assert got.columns == ["query_id", "chunk_id", "label", "distance", "rank"]
    assert got.where("distance is null").select("query_id").distinct().collect() == [(name(2001),)]


def test_few_rows_none_and_a_filter(spark):
    made = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [0.0, 1.0], 2)], SCHEMA.format("bigint"))
    asked = spark.createDataFrame([(9, [1.0, 0.1])], "query_id bigint, embedding array<float>")
    assert taken(vectors.top_k(made, asked, 5)) == {9: [1, 2]}
    assert taken(vectors.top_k(made, asked, 5, F.col("label") == 2)) == {9: [2]}
    assert vectors.top_k(made, asked.limit(0), 5).count() == vectors.top_k(made.limit(0), asked, 5).count() == 0


def test_distances_are_those_of_the_expression(spark):
    made = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding")
    asked = made.limit(20).withColumnRenamed("chunk_id", "query_id")
    found = vectors.top_k(made, asked, 9).join(made.withColumnRenamed("embedding", "v"), "chunk_id").join(asked.withColumnRenamed("embedding", "q"), "query_id")
    apart = found.select(F.max(F.abs(F.col("distance") - vectors.cosine_distance(F.col("v"), F.col("q"))))).first()[0]
    assert apart < 1e-12


def test_inverted_file(spark):
    made = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")
    odd = spark.createDataFrame([(-1, None, 1), (-2, [0.0] * 64, 1)], SCHEMA.format("bigint"))
    index = ann.build_index(made.union(odd), lists=12)
    assert index.rows.count() == made.count() + 2 and {r["list"] for r in index.rows.where("chunk_id < 0").collect()} == {ann.NOWHERE}
    asked = made.where("chunk_id % 7 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    exact = vectors.top_k(made, asked, 5, exclude_self=True)
    assert taken(ann.search(index, asked, 12, 5, True)) == taken(exact)
    probes = ann.probes_for(index, asked, 0.9, 5, True)
    assert 1 <= probes <= 12 and ann.recall(ann.search(index, asked, probes, 5, True), exact) >= 0.9
    assert probes == 1 or ann.recall(ann.search(index, asked, probes - 1, 5, True), exact) < 0.9
    plan = ann.search(index, asked.limit(1), 1, 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(list" in plan or "PartitionFilters: [(list" in plan or "list#" in plan.split("PartitionFilters")[1][:80]


def test_index_of_nothing(spark):
    made = spark.createDataFrame([], SCHEMA.format("bigint"))
    asked = spark.createDataFrame([(1, [1.0])], "query_id bigint, embedding array<float>")
    assert ann.search(ann.build_index(made), asked, 3).count() == 0
