from collections import Counter

import pytest
from lorequarry.operators import graph

ENTITIES = "arxiv_id string, title string, authors array<string>, methods_proposed array<string>, methods_criticized array<string>, seq int"
MAPPING = "query_name string, author_id string, institution string, aliases array<string>"
PAPERS = "arxiv_id string, year int"


@pytest.fixture(scope="module")
def shared(spark):
    """Papers of one row, of two rows and of two versions; two names of one author."""
    entities = [
        ("1", "one", ["Ada", "Ada  B", "Bo"], ["X", "x"], ["Y"], 1),
        ("2v1", "old", ["Bo", "Bo"], ["X"], None, 2),
        ("2v1", "new", ["Bo", "Cy"], ["X", "Z"], [], 5),
        ("2v2", "next", ["Ada"], None, ["Y"], 4),
        ("3", None, None, ["Z"], ["Z"], 3),
    ]
    mapping = [("Ada", "A1", "", ["a"]), ("Ada B", "A1", "Lab", ["A", "b"]), ("Bo", "A2", "Lab", []), ("Cy", "A3", None, None), ("Cy", "A4", "Lab ", []), ("No", "A5", "Hut", [])]
    return graph.parts_of(spark.createDataFrame(entities, ENTITIES), spark.createDataFrame(mapping, MAPPING), spark.createDataFrame([("2", 2001)], PAPERS))


def test_edges_once_whatever_repeats(shared):
    found = [(r.src_id, r.dst_id, r.relation, r.seq) for r in graph.edges_of(shared).collect()]
    assert max(Counter(f[:3] for f in found).values()) == 1
    wrote = {(a, p): s for a, p, r, s in found if r == graph.WROTE}
    assert wrote == {("A1", "1"): 1, ("A2", "1"): 1, ("A2", "2v1"): 2, ("A3", "2v1"): 5, ("A4", "2v1"): 5, ("A1", "2v2"): 4}
    assert {(p, m): s for p, m, r, s in found if r == graph.PROPOSES} == {("1", "X"): 1, ("2v1", "X"): 2, ("2v1", "Z"): 5, ("3", "Z"): 3}
    assert {(a, i): s for a, i, r, s in found if r == graph.WORKS_AT} == {("A1", "Lab"): 1, ("A2", "Lab"): 1, ("A4", "Lab"): 5}
    assert {(p, y): s for p, y, r, s in found if r == graph.PUBLISHED} == {("2v1", "2001"): 2, ("2v2", "2001"): 4}


def test_nodes_with_and_without_edges(shared):
    rows = lambda df: sorted(map(str, df.collect()))
    nodes = graph.nodes_of(shared)
    assert rows(nodes) == rows(graph.nodes_of(shared, graph.edges_of(shared)))
    got = {(r.kind, r.id): r for r in nodes.collect()}
    assert len(got) == nodes.count() == 4 + 4 + 3 + 1 + 1
    assert got["paper", "2v1"].title == "new" and got["paper", "2v2"].year == 2001
    assert (got["author", "A1"].name, got["author", "A1"].aliases, got["author", "A1"].institution) == ("Ada B", ["a", "b"], "Lab")


def test_edges_of_single_rows_are_not_grouped(spark):
    """Only where authors work is grouped: papers of one row give each edge once as they are."""
    entities = spark.createDataFrame([("1", "t", ["Ada"], ["X"], [], 1)], ENTITIES)
    parts = graph.parts_of(entities, spark.createDataFrame([("Ada", "A1", "Lab", [])], MAPPING), spark.createDataFrame([], PAPERS))
    assert parts.base.select("alone").first()[0] and parts.held.select("single").first()[0]
    seen = []
    graph_distinct, graph.distinct_edges = graph.distinct_edges, lambda df: seen.append({r.relation for r in df.collect()}) or graph_distinct(df)
    try:
        assert graph.edges_of(parts).count() == 3
    finally:
        graph.distinct_edges = graph_distinct
    assert seen == [{graph.WORKS_AT}]


def test_coauthors_of_some_and_of_all(spark):
    wrote = {"P1": ["A1", "A2", "A3"], "P2": ["A2", "A1"], "P3": ["A4"], "P4": ["A3", "A4"]}
    edges = spark.createDataFrame([("author", a, graph.WROTE, "paper", p, 1) for p, who in wrote.items() for a in who], "src_kind string, src_id string, relation string, dst_kind string, dst_id string, seq bigint")
    for asked in (["A1"], ["A2", "A3", "A2"], ["A1", "A2", "A3", "A4", "A9"]):
        want = {(a, c): sorted(p for p, who in wrote.items() if a in who and c in who) for a in asked for c in ("A1", "A2", "A3", "A4") if a != c}
        found = graph.coauthors(spark.createDataFrame([(a,) for a in asked], "author_id string"), edges).collect()
        assert {(r.author_id, r.coauthor_id): r.papers for r in found} == {k: v for k, v in want.items() if v} and len(found) == len({(r.author_id, r.coauthor_id) for r in found})
