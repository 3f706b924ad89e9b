"""What a ranking by signals makes of names that many authors share."""

import re

from lorequarry.operators import graph
from lorequarry.plans import queries
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
ASKED = "query_id string, author_name string, topic string, method string, year_min int"


def test_authors_of_one_name_make_no_edges_for_a_ranking(spark, tmp_path, monkeypatch):
    """Forty suppliers of one name on each line: edges would be forty times the lines."""
    for name in ("nation", "part", "orders", "lineitem"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    makers = spark.read.parquet(f"{SF}/supplier.parquet").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(39))))
    makers.withColumn("s_suppkey", F.col("s_suppkey") + 1000 * F.col("copy")).drop("copy").write.parquet(f"{tmp_path}/supplier.parquet")
    lines, written, spool = spark.read.parquet(f"{SF}/lineitem.parquet").count(), {}, graph.spool
    monkeypatch.setattr(graph, "spool", lambda df, name: written.setdefault(f"{name} {len(written)}", spool(df, name)))
    got = {(r.query_id, r.doc_id, r.score, r.year) for r in queries.graph_signal_ranking(spark, str(tmp_path)).collect()}
    assert max(t.count() for n, t in written.items() if n.startswith("graph-edges")) <= 4 * lines
    nodes, edges = queries._graph(spark, str(tmp_path))
    assert got == {(r.query_id, r.doc_id, r.score, r.year) for r in graph.rank_by_signals(queries._asked_entities(spark), nodes, edges).collect()}
    assert {q for q, *_ in got} >= {"author", "method"}


def test_papers_by_counts_an_author_once_a_paper(spark):
    """Authors of two names, names of two authors, papers of two rows and of two versions."""
    entities = [("1", "one", ["Ada", "Ada B", "Bo"], ["X"], [], 1), ("2v1", "old", ["Bo"], [], [], 2), ("2v1", "new", ["Bo", "Cy"], [], [], 3), ("2v2", "next", ["Ada"], [], [], 4)]
    mapping = [("Ada", "A1", "", []), ("Ada B", "A1", "", []), ("Ada B", "A3", "", []), ("Bo", "A2", "", []), ("Cy", "A3", "", []), ("Cy", "A4", "", []), ("Cy", "A4", "Lab", [])]
    parts = graph.parts_of(
        spark.createDataFrame(entities, "arxiv_id string, title string, authors array<string>, methods_proposed array<string>, methods_criticized array<string>, seq int"),
        spark.createDataFrame(mapping, "query_name string, author_id string, institution string, aliases array<string>"), spark.createDataFrame([("2", 2001)], "arxiv_id string, year int"),
    )
    asked = [(q, i) for q, ids in {"all": ["A1", "A2", "A3", "A4"], "one": ["A1", "A1"], "two": ["A3", "A4"], "none": ["A9"]}.items() for i in ids]
    want = {}
    wrote = {(r.src_id, r.dst_id) for r in graph.edges_of(parts).where(F.col("relation") == graph.WROTE).collect()}
    for q, i in set(asked):
        for _, p in (w for w in wrote if w[0] == i):
            want[q, p] = want.get((q, p), 0) + 1
    found = graph.papers_by(parts, spark.createDataFrame(asked, "query_id string, id string"))
    assert {(r.query_id, r.paper_id): r.n for r in found.groupBy("query_id", "paper_id").agg(F.sum("times").alias("n")).collect()} == want
    assert {r.relation for r in graph.edges_of(parts, wrote=False).collect()} == {graph.PUBLISHED, graph.PROPOSES, graph.WORKS_AT}


def test_no_signals_gather_by_question_alone(spark):
    nodes, edges, parts = queries._ranked_graph(spark, SF)
    ranked = graph.rank_by_signals(queries._asked_entities(spark), nodes, edges, parts)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\(query_id#\d+, \d+\)", plan)
