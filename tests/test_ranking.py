import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lorequarry.operators import ranking, vectors
from pyspark.sql import functions as F

RANKING = "query_id string, doc_id string, rank int"


def frame(spark, docs):
    return spark.createDataFrame([("q", d, i) for i, d in enumerate(docs, 1)], RANKING)


def scores(df):
    return {r.doc_id: r.score for r in df.collect()}


def test_rrf_literals(spark):
    got = scores(ranking.rrf(frame(spark, ["a", "b", "c"]), frame(spark, ["b", "d"])))
    want = {"b": 1 / 62 + 1 / 61, "a": 1 / 61, "d": 1 / 62, "c": 1 / 63}
    assert got == pytest.approx(want)


def test_weighted_literals_and_ties(spark):
    made = ranking.weighted(frame(spark, ["a", "b", "c"]), frame(spark, ["b", "d"]))
    ranked = ranking.with_fused_rank(made).orderBy("rank").collect()
    assert [r.doc_id for r in ranked] == ["b", "a", "c", "d"]
    assert [r.score for r in ranked] == pytest.approx([0.625, 0.5, 0.0, 0.0])
    assert [(r.in_graph, r.in_vector) for r in ranked] == [(True, True), (True, False), (True, False), (False, True)]


def test_blank_ids_take_a_rank(spark):
    got = scores(ranking.rrf(frame(spark, ["", "a"]), frame(spark, [None, None, "b"])))
    assert got == pytest.approx({"a": 1 / 62, "b": 1 / 63})


def test_single_element_scales_to_one(spark):
    assert scores(ranking.weighted(frame(spark, ["x"]), frame(spark, []))) == {"x": 0.5}


@settings(max_examples=6, deadline=None)
@given(st.lists(st.sampled_from("abcdef"), max_size=6), st.lists(st.sampled_from("abcdef"), max_size=6))
def test_rrf_is_symmetric(spark, a, b):
    one, two = (scores(ranking.rrf(frame(spark, x), frame(spark, y))) for x, y in ((a, b), (b, a)))
    assert one == pytest.approx(two)


def test_collapse_to_papers(spark):
    hits = frame(spark, ["p2", "p1", "p2", "", "p3"])
    got = sorted((r.rank, r.doc_id, r.first_chunk_rank) for r in vectors.collapse_to_papers(hits).collect())
    assert got == [(1, "p2", 1), (2, "p1", 2), (3, "p3", 5)]


def test_context_or_card(spark):
    fused = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], RANKING)
    chunks = spark.createDataFrame([("q", "x", "c2", "second", "method", 4), ("q", "x", "c1", "best", "results", 2)], "query_id string, doc_id string, chunk_id string, text string, section string, rank int")
    papers = spark.createDataFrame([("x", "X"), ("y", "Title")], "doc_id string, title string")
    got = {r.doc_id: (r.chunk_id, r.text, r.section) for r in ranking.context_hits(fused, chunks, papers).collect()}
    assert got == {"x": ("c1", "best", "results"), "y": ("y_graph", "(graf) Title", "graph")}


def test_filter_after_the_limit(spark):
    rows = [(i, [1.0, i / 100.0], "Li" if i in (3, 7, 11, 41) else "Bo") for i in range(60)]
    coll = spark.createDataFrame(rows, "chunk_id bigint, embedding array<float>, authors string")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<float>")
    got = vectors.search_with_filter(coll, asked, None, F.col("authors") == "Li").collect()
    assert sorted(r.chunk_id for r in got) == [3, 7, 11]


def test_blocks_of_questions_find_the_same(spark):
    rows = spark.range(40).select(F.col("id").alias("chunk_id"), F.array(F.cos("id"), F.sin("id")).cast("array<float>").alias("embedding"))
    asked = rows.where("chunk_id < 9").withColumnRenamed("chunk_id", "query_id")
    whole = sorted(map(tuple, vectors.top_k(rows, asked, 3).select("query_id", "chunk_id", "rank").collect()))
    assert sorted(map(tuple, vectors.top_k(rows, asked, 3, question_bytes=4 * 2 * 8).select("query_id", "chunk_id", "rank").collect())) == whole


def test_zero_vectors_come_last(spark):
    coll = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, -1.0])], "chunk_id int, embedding array<float>")
    asked = spark.createDataFrame([(1, [0.0, 1.0])], "query_id int, embedding array<float>")
    assert [r.chunk_id for r in vectors.top_k(coll, asked, 2).orderBy("rank").collect()] == [2, 1]


def test_embedding_cache(spark):
    chunks = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "yy"), ("d", " ")], "chunk_id string, text string")
    cache = spark.createDataFrame([], "cache_key string, embedding array<float>")
    probed = vectors.probe_cache(vectors.usable_chunks(chunks), cache, "m")
    fresh = vectors.embed_missing(probed, lambda texts: [[float(len(t))] for t in texts])
    assert fresh.count() == 2 and {r.embedding[0] for r in fresh.collect()} == {1.0, 2.0}
    again = vectors.probe_cache(vectors.usable_chunks(chunks), fresh, "m")
    assert again.where("embedding is null").count() == 0 and again.count() == 3
    assert vectors.embed_missing(probed, lambda texts: []).count() == 0
