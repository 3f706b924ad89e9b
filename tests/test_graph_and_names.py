import pytest
from lorequarry.operators import evaluate, filters, graph, resolve
from lorequarry.plans import pipelines
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def built(spark):
    entities = spark.createDataFrame(
        [
            ("2401.1v1", "On Graphs", ["Ada  Byron", "Bo Li"], ["GNN"], ["CNN"], 1),
            ("1901.2v1", "On Trees", ["Ada Byron", "Cy Na"], ["Tree", "tree"], ["GNN"], 2),
            ("math_1", "Odd", ["Nobody"], [], [], 3),
            (" ", "No id", ["Ada Byron"], ["GNN"], [], 4),
        ],
        "arxiv_id string, title string, authors array<string>, methods_proposed array<string>, methods_criticized array<string>, seq int",
    )
    mapping = spark.createDataFrame(
        [("Ada Byron", "A1", "Lab", ["A. Byron"]), ("Bo Li", "A2", "", []), ("Cy Na", "A3", "Lab", ["C. Na"]), ("Nobody", "X9", "Lab", [])],
        "query_name string, author_id string, institution string, aliases array<string>",
    )
    papers = spark.createDataFrame([("2401.1", 2023)], "arxiv_id string, year int")
    return graph.build(entities, mapping, papers)


def test_build(built):
    nodes, edges = built
    got = {(r.what, r.key): r.n for r in graph.summarize(nodes, edges).collect()}
    assert got == {
        ("node", "paper"): 3, ("node", "author"): 3, ("node", "method"): 3, ("node", "institution"): 1, ("node", "year"): 2,
        ("edge", "YAZDI"): 4, ("edge", "ÇALIŞIYOR"): 2, ("edge", "ÖNERİYOR"): 2, ("edge", "ELEŞTİRİYOR"): 2, ("edge", "YAYINLANDI"): 2,
    }
    years = {r.id: r.year for r in nodes.where("kind = 'paper'").collect()}
    assert years == {"2401.1v1": 2023, "1901.2v1": 2019, "math_1": None}


def test_hops(spark, built):
    nodes, edges = built
    ask = lambda *q: spark.createDataFrame([(x,) for x in q], "query string")
    assert [(r.query, r.id, r.score) for r in graph.find_authors(ask("A2"), nodes).collect()] == [("A2", "A2", 1.0)]
    assert {r.id for r in graph.find_authors(ask("byron"), nodes).collect()} == {"A1"}
    one = spark.createDataFrame([("A1",)], "author_id string")
    assert {(r.coauthor_id, tuple(r.papers)) for r in graph.coauthors(one, edges).collect()} == {("A2", ("2401.1v1",)), ("A3", ("1901.2v1",))}
    assert {r.path for r in graph.author_papers(one, nodes, edges).collect()} == {"author:A1 — YAZDI — paper:2401.1v1", "author:A1 — YAZDI — paper:1901.2v1"}
    assert [r.institution for r in graph.author_institutions(one, nodes, edges).collect()] == ["Lab"]
    assert [(r.paper_id, r.method_id) for r in graph.papers_criticising(ask("gnn"), nodes, edges).collect()] == [("1901.2v1", "GNN")]
    assert [r.path for r in graph.papers_criticising(ask("gnn"), nodes, edges).collect()] == ["paper:1901.2v1 — ELEŞTİRİYOR — method:GNN"]
    bundle = pipelines.author_bundle(ask("A1"), nodes, edges)
    assert [(r.name, r.path) for r in bundle["coauthors"].collect()] == [
        ("Bo Li", "author:A1 — YAZDI — paper:2401.1v1 — YAZDI — author:A2"), ("Cy Na", "author:A1 — YAZDI — paper:1901.2v1 — YAZDI — author:A3"),
    ]
    methods = pipelines.method_bundle(ask("gnn"), nodes, edges)
    assert [(r.id, r.score) for r in methods["methods"].collect()] == [("GNN", 1.0)]
    assert [r.paper_id for r in methods["papers"].collect()] == ["1901.2v1"]
    two = spark.createDataFrame([("A2",)], "author_id string")
    assert [(r.coauthor_id, r.paper_id) for r in graph.coauthor_papers(two, nodes, edges).collect()] == [("A1", "1901.2v1")]


def test_signals(spark, built):
    nodes, edges = built
    asked = spark.createDataFrame(
        [("both", "Ada Byron", None, "GNN", None), ("gated", "Ada Byron", None, None, 2020), ("topic", None, "on trees", None, None), ("year", None, None, None, 2019), ("none", "Zzz Qqq", None, None, None)],
        "query_id string, author_name string, topic string, method string, year_min int",
    )
    got = {(r.query_id, r.doc_id): r.score for r in graph.rank_by_signals(asked, nodes, edges).collect()}
    assert got == {
        ("both", "2401.1v1"): 140, ("both", "1901.2v1"): 150, ("gated", "2401.1v1"): 100, ("topic", "1901.2v1"): 10,
        ("year", "2401.1v1"): 5, ("year", "1901.2v1"): 5,
    }
    assert [(r.query_id, r.note) for r in graph.not_found_notes(asked, nodes).collect()] == [("none", "author not found: Zzz Qqq")]


def test_author_nodes_merge(spark):
    rows = [("A1", "A. B", ["x", "Y"], "", 1), ("A1", "Ada Byron", ["X", "z"], "Lab", 2), ("A1", "Ada Byrom", [], "Other", 3)]
    r = graph.author_nodes(spark.createDataFrame(rows, "id string, name string, aliases array<string>, institution string, seq int")).first()
    assert (r.name, r.aliases, r.institution) == ("Ada Byron", ["x", "Y", "z"], "Lab")


def test_last_paper_wins(spark):
    r = graph.paper_nodes(spark.createDataFrame([("p", "old", 1, 1), ("p", "new", 2, 2)], "id string, title string, year int, seq int")).first()
    assert (r.title, r.year, r.kind) == ("new", 2, "paper")


def test_confidence_and_ambiguity(spark):
    lit = lambda *x: [F.lit(v) for v in x]
    row = spark.range(1).select(
        F.round(resolve.confidence(*lit(0.6, True, False, False, True)), 6), F.round(resolve.confidence(*lit(0.98, False, False, False, True)), 6),
        *(resolve.is_ambiguous(*lit(*x)) for x in ((0.95, False, 0.93), (0.95, False, 0.90), (0.92, True, 0.92), (0.69, False, 0.0))),
        resolve.is_ambiguous(F.lit(0.9), F.lit(False), F.lit(None).cast("double")),
    ).first()
    assert tuple(row) == (0.97, 1.0, True, True, False, True, False)


def test_unique_names(spark):
    names = spark.createDataFrame([("Li  Wei", 1), ("li wei", 2), (" Bo ", 3), ("", 4), (None, 5)], "name string, seq int")
    assert sorted((r.seq, r.name) for r in resolve.unique_names(names).collect()) == [(1, "Li  Wei"), (3, "Bo")]


def test_resolve(spark):
    names = spark.createDataFrame([("Ada Byron", "p1", 1), ("Bo Li", "p1", 2), ("Cy Na", "p2", 3), ("Zed", "p2", 4)], "query_name string, arxiv_id string, seq int")
    cand = spark.createDataFrame(
        [
            ("Ada Byron", 0, "A1", "Ada Byron", "Lab", 3, 1.0, ["Work X"]), ("Ada Byron", 1, "A2", "Ada Byron", "Else", 2, 1.0, ["Other"]),
            ("Bo Li", 0, "A3", "Bo Li", "", 1, 1.0, ["work  x"]),
            ("Cy Na", 0, "A4", "Cy Na", "", 1, 1.0, []), ("Cy Na", 1, "A5", "Cy Na", "", 1, 1.0, []),
        ],
        "query_name string, pos int, author_id string, display_name string, institution string, works int, score double, top_5_works array<string>",
    )
    bylines = spark.createDataFrame([], "arxiv_id string, pos int, author_id string, display_name string, raw_author_name string, institution string")
    titles = spark.createDataFrame([("p1", "Nothing alike"), ("p2", "Nor this")], "arxiv_id string, title string")
    mapping, rest = resolve.resolve(names, cand, bylines, titles)
    assert {r.query_name: r.author_id for r in mapping.collect()} == {"Ada Byron": "A1", "Bo Li": "A3"}
    assert {r.query_name: r.reason for r in rest.collect()} == {"Cy Na": "homonym_no_paper_evidence", "Zed": "no_candidates"}
    assert {r.query_name for r in resolve.homonyms(cand).collect()} == {"Ada Byron", "Cy Na"}
    byline = spark.createDataFrame([("p2", 0, "A9", "Cy Na", "C. Na", "Lab")], bylines.schema)
    mapping, _ = resolve.resolve(names, cand, byline, titles)
    assert {r.query_name: (r.author_id, r.confidence) for r in mapping.collect()}["Cy Na"] == ("A9", 1.0)


def test_joint_works_are_sought_with_resolved_peers(spark):
    names = spark.createDataFrame([("Cy Na", "p", 1), ("Ada Byron", "p", 2)], "query_name string, arxiv_id string, seq int")
    cand = spark.createDataFrame(
        [("Cy Na", 0, "A4", "Cy Na", "", 1, 1.0, []), ("Cy Na", 1, "A5", "Cy Na", "", 1, 1.0, []), ("Ada Byron", 0, "A1", "Ada Byron", "", 1, 1.0, [])],
        "query_name string, pos int, author_id string, display_name string, institution string, works int, score double, top_5_works array<string>",
    )
    bylines = spark.createDataFrame([], "arxiv_id string, pos int, author_id string, display_name string, raw_author_name string, institution string")
    titles = spark.createDataFrame([("p", "Title")], "arxiv_id string, title string")
    found = lambda pairs: {r.query_name: r.author_id for r in resolve.resolve(names, cand, bylines, titles, spark.createDataFrame(pairs, "a string, b string"))[0].collect()}
    # Names are judged in the order in which they are first seen: the first has nobody resolved beside it.
    assert found([("A1", "A5")]) == {"Ada Byron": "A1"}
    names = spark.createDataFrame([("Cy Na", "p", 2), ("Ada Byron", "p", 1)], "query_name string, arxiv_id string, seq int")
    assert found([("A1", "A5")]) == {"Cy Na": "A5", "Ada Byron": "A1"}
    assert found([("A2", "A5")]) == {"Ada Byron": "A1"}


def test_first_candidates(spark):
    found = spark.createDataFrame(
        [("n", k, f"A{k}" if k != 1 else "", "N", "", k, 0.5) for k in range(7)], "query_name string, pos int, author_id string, display_name string, institution string, works int, score double"
    )
    works = spark.createDataFrame([("A2", f"w{k}", k) for k in range(7)] + [("A2", "", 99), ("A3", "x", None)], "author_id string, title string, cited_by int")
    got = [(r.author_id, r.pos, r.top_5_works) for r in resolve.first_candidates(found, works).orderBy("pos").collect()]
    assert got == [("A4", 0, []), ("A3", 1, ["x"]), ("A2", 2, ["w6", "w5", "w4", "w3", "w2"]), ("A0", 3, [])]


def test_paper_matching(spark):
    papers = spark.createDataFrame([("p1", "A Study of Things", "d1"), ("p2", "Deep Graph Learning", None)], "arxiv_id string, title string, doi string")
    works = spark.createDataFrame(
        [("W1", "d1", "Other", None, 0), ("W2", None, "Learning Deep Graph", "p2", 1), ("W3", None, "deep graph learning", "p2", 0)], "work_id string, doi string, title string, searched_for string, pos int"
    )
    assert {tuple(r) for r in resolve.match_paper(papers, works).collect()} == {("p1", "W1"), ("p2", "W2")}


def test_filters(spark):
    raws = ['{"year_min": 2020, "year_max": 2024.7, "authors": " Li ", "section": "Method"}', '{"year_min": true, "authors": ["a", " ", 3], "section": "refs"}', "broken", None]
    rows = spark.createDataFrame([(r,) for r in raws], "raw string").select(filters.normalize_filter(F.col("raw")).alias("f")).collect()
    assert [tuple(r.f) for r in rows] == [(2020, None, ["Li"], "method"), (1, None, ["a", "3"], None), (None, None, [], None), (None, None, [], None)]
    row = spark.range(1).select(
        filters.author_matches(F.lit("Oliver Stone"), ["li"]), filters.author_matches(F.lit(None).cast("string"), ["li"]), filters.author_matches(F.lit("x"), []),
        filters.year_ok(F.lit(None).cast("int"), F.lit(2024)), filters.year_ok(F.lit(None).cast("int"), F.lit(None).cast("int")),
    ).first()
    assert tuple(row) == (True, False, False, False, True)
    assert filters.build_where() is None


def test_catalog(spark):
    rows = spark.createDataFrame([("b", 2020, "Li", 1), ("b", 1999, "Li", 2), ("a", None, "Li", 3), ("", 2021, "Li", 4), ("c", 2001, "Bo", 5)], "arxiv_id string, year int, authors string, seq int")
    assert [tuple(r)[:2] for r in filters.catalog(rows, None, ["li"]).collect()] == [("b", 2020), ("a", None)]
    assert filters.catalog_line(filters.catalog(rows)).first()[0] == "c (year=2001), b (year=2020), a (year=?)"
    assert filters.catalog_line(rows.limit(0)).first()[0] == "(boş)"


def test_recall(spark):
    gold = spark.createDataFrame([("q1", [], ["p1", "p2"]), ("q2", [], []), ("q3", ["1910.1v1#3"], [])], "query_id string, relevant_chunks array<string>, relevant_papers array<string>")
    hits = [("q1", i, f"p1_{i}", "p1") for i in range(1, 6)] + [("q1", 6, "p2_0", "p2"), ("q3", 1, "1910.1v2_0007", "1910.1v2")]
    got = {r.query_id: (r.recall_at_5, r.recall_at_10) for r in evaluate.recall_at_k(gold, spark.createDataFrame(hits, "query_id string, rank int, chunk_id string, doc_id string")).collect()}
    assert got == {"q1": (0.5, 1.0), "q2": (None, None), "q3": (1.0, 1.0)}


def test_whole_question(spark, built):
    nodes, edges = built
    coll = spark.createDataFrame(
        [("c1", "text one", [1.0, 0.0], "2401.1v1", "method", "Ada Byron; Bo Li", 2023), ("c2", "text two", [0.0, 1.0], "zzz", "results", "Oliver", 2020)],
        "chunk_id string, document string, embedding array<float>, arxiv_id string, section string, authors string, year int",
    )
    asked = spark.createDataFrame([("q", [0.0, 1.0])], "query_id string, embedding array<float>")
    answers = spark.createDataFrame([("q", 'Sure: {"author_name": "Ada Byron", "year_min": 2020}')], "query_id string, response string")
    hits = pipelines.hybrid_hits(asked, pipelines.parse_entities(answers), nodes, edges, coll)
    assert [(r.doc_id, r.chunk_id) for r in hits.orderBy("rank").collect()] == [("2401.1v1", "c1"), ("zzz", "c2")]
    assert pipelines.context(hits).first().context.startswith("[1] paper 2401.1v1")
    filt = pipelines.parse_filters(spark.createDataFrame([("q", '{"authors": ["li"], "year_min": 2021}')], "query_id string, response string"))
    assert [r.chunk_id for r in pipelines.metadata_hits(coll, asked, filt).collect()] == ["c1"]
    paths = pipelines.author_paths(pipelines.parse_entities(answers), nodes, edges).first().paths
    assert len(paths) == 2
    gold = spark.createDataFrame([("q", [], ["zzz"])], "query_id string, relevant_chunks array<string>, relevant_papers array<string>")
    out = pipelines.evaluate_stages(gold, {"hybrid": hits.select("query_id", "rank", "chunk_id", "doc_id")}).first()
    assert (out.stage, out.recall_at_5, out.latency_ms) == ("hybrid", "1.0000", "n/a")
    with pytest.raises(ValueError, match="unknown stages"):
        pipelines.evaluate_stages(gold, {"other": hits})
