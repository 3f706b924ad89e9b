"""Functions that other tests do not reach, with literals."""

import hashlib
import random
import re

from lorequarry.functions import tei, text
from lorequarry.operators import evaluate, filters, graph, resolve, vectors
from lorequarry.plans import pipelines
from lorequarry.sources import readers
from pyspark.sql import functions as F


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def ordered(df, c):
    return [r[c] for r in df.orderBy("i").collect()]


def test_numbering_of_headings(spark):
    rng = random.Random(6)
    made = ["".join(rng.choices(["I", "v", "X", "A", "b", "1", "23", ".", " ", "\t", "Intro", "é"], k=rng.randint(0, 6))) for _ in range(400)]
    made += ["", "3.1.2. Model", "IV.", "IV. ", "A.1 Data", "12 Monkeys", "Mix models", " 1. Late", "1.. Odd"]
    got = ordered(column(spark, made).select("i", tei.normalize_heading(F.col("x")).alias("n"), tei.is_subsection(F.col("x")).alias("s")), "n")
    assert got == [re.sub(r"(?ai)^([ivxlcdm]+|[a-z]|\d+)(\.\d+)*\.?\s+", "", h).strip(" ").lower() for h in made]
    subs = ordered(column(spark, made).select("i", tei.is_subsection(F.col("x")).alias("s")), "s")
    assert subs == [bool(re.match(r"[A-Z]\.\s", h)) for h in made]


def slow_object(raw):
    m = re.search(r"```(json)?\s*(\{.*?\})\s*```", raw, re.DOTALL)
    if m:
        return m[2]
    return raw[raw.find("{") : raw.rfind("}") + 1] if 0 <= raw.find("{") < raw.rfind("}") else None


def test_objects_in_prose(spark):
    rng = random.Random(7)
    made = ["".join(rng.choices(["```", "```json", "\n", " ", "{", "}", '{"a": 1}', '{"b": {"c": 2}}', "word"], k=rng.randint(0, 9))) for _ in range(600)]
    got = ordered(column(spark, made).select("i", text.extract_json_text(F.col("x")).alias("x")), "x")
    import json

    def want(raw):
        found = slow_object(raw)
        try:
            return found if found and isinstance(json.loads(found), dict) else None
        except ValueError:
            return None

    assert got == [want(x) for x in made]


def test_keys_of_requests(spark):
    row = spark.range(1).select(text.request_key("works", F.lit("/w"), F.create_map(F.lit("b"), F.lit("x y"), F.lit("a"), F.lit("1")))).first()[0]
    assert row == "works:" + hashlib.sha256(b"/w?a=1&b=x+y").hexdigest()


def test_institutions_and_authorships(spark):
    place = "array<struct<display_name:string>>"
    rows = [([("",), ("Last",)], "Old", []), ([], "Old", []), ([], "", [([2001], ("One",)), ([2005], ("Two",)), ([2005], ("Three",)), (None, ("Four",)), ([2009], ("",))]), (None, None, [])]
    made = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, last {place}, legacy string, aff array<struct<years:array<int>,institution:struct<display_name:string>>>")
    assert ordered(made.select("i", resolve.institution_of(F.col("last"), F.col("legacy"), F.col("aff")).alias("x")), "x") == ["Last", "Old", "Three", None]
    works = spark.createDataFrame(
        [("p", [(("https://x.org/A1", "Ada"), "A. Da", [("",), ("Lab",)]), (("https://x.org/X9", "No"), "No", []), (("https://x.org/A2/", "Bo"), None, [])])],
        "arxiv_id string, authorships array<struct<author:struct<id:string,display_name:string>,raw_author_name:string,institutions:array<struct<display_name:string>>>>",
    )
    assert [tuple(r) for r in resolve.parse_authorships(works).orderBy("pos").collect()] == [("p", 0, "A1", "Ada", "A. Da", "Lab"), ("p", 2, "A2", "Bo", None, "")]


def test_rows_hits_and_answers(spark, capsys):
    chunks = spark.createDataFrame([("c1", None, [1.0], "p", None, None, None, ["A", "B"], "2001"), ("c2", "t", [1.0], None, "m", "f", "s", None, "200x")], "chunk_id string, text string, embedding array<float>, arxiv_id string, method string, source_file string, section string, authors array<string>, year string")
    assert [(r.document, r.arxiv_id, r.authors, r.year) for r in vectors.collection_rows(chunks).orderBy("chunk_id").collect()] == [("", "p", "A; B", 2001), ("t", "", "", None)]
    hits = spark.createDataFrame([("q", "", "r1", None, "p", None, "A", 2001, 0.5, 1)], "query_id string, chunk_id string, id string, document string, arxiv_id string, section string, authors string, year int, distance double, rank int")
    made = vectors.rows_to_hits(hits)
    assert [(r.chunk_id, r.document, r.section) for r in made.collect()] == [("r1", "", "")]
    pipelines.print_hits(made)
    pipelines.print_hits(made.limit(0))
    assert capsys.readouterr().out == " 1. r1 [-] 0.5000\n(yok)\n"
    both = spark.createDataFrame([([], [], "a"), ([1], [], "b")], "h array<int>, l array<int>, a string").select(filters.answer_or_abstain(F.col("h"), F.col("l"), F.col("a")).alias("x"))
    assert [r.x for r in both.collect()] == ["Bu bilgi verilen makalelerde yok.", "b"]


def test_prompts_of_judges(spark):
    hits = spark.createDataFrame([("q", f"p{i}", i, f"text {i}", None) for i in range(1, 8)], "query_id string, doc_id string, rank int, text string, section string")
    asked = spark.createDataFrame([("q", "Why?"), ("r", "How?")], "query_id string, text string")
    answers = spark.createDataFrame([("q", "Because."), ("r", "So.")], "query_id string, response string")
    got = {(r.query_id, r.metric): r.request for r in pipelines.judge_prompts(hits, asked, answers).collect()}
    assert len(got) == 4 and "text 5" in got["q", "faithfulness"] and "text 6" not in got["q", "faithfulness"]
    assert "text" not in got["q", "relevance"].split("\n\n", 1)[1] and "Because." in got["q", "relevance"] and got["r", "relevance"].endswith("Question: How?")


def test_summaries_are_written(spark, tmp_path):
    rows = spark.createDataFrame([("hybrid", "0.5000"), ("naive", "n/a")], "stage string, recall string")
    said = evaluate.write_summary(rows, str(tmp_path / "out"), ("naive", "hybrid"))
    assert said == "| stage | recall |\n|---|---|\n| naive | n/a |\n| hybrid | 0.5000 |"
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "out")).collect()] == [("naive", "n/a"), ("hybrid", "0.5000")]


def test_vectors_come_back_in_any_order(spark):
    probed = spark.createDataFrame([("a", "x", None), ("b", "yy", None), ("c", "zzz", None)], "cache_key string, text string, embedding array<float>").coalesce(1)
    turned = lambda texts: [(i, [float(len(t))]) for i, t in enumerate(texts)][::-1]
    assert {r.cache_key: r.embedding for r in vectors.embed_missing(probed, turned).collect()} == {"a": [1.0], "b": [2.0], "c": [3.0]}
    assert vectors.embed_missing(probed, lambda texts: [(0, [1.0]) for _ in texts], batch=3).where("cache_key = 'b'").count() == 0


def test_downloads_skip_what_is_there(spark):
    papers = spark.createDataFrame([("a", "u1"), ("b", "u2"), ("c", "bad"), ("d", None), ("e", "html"), ("b", "u3")], "arxiv_id string, url string")
    held = spark.createDataFrame([("a", b"%PDF-1"), ("b", b"")], "arxiv_id string, content binary")

    def fetch(url):
        if url == "bad":
            raise OSError
        return b"<html>" if url == "html" else b"%PDF-" + url.encode()

    got = {r.arxiv_id: (r.status, r.content and bytes(r.content)) for r in readers.download(papers, held, fetch).collect()}
    assert got == {"b": ("ok", b"%PDF-u2"), "c": ("failed", None), "d": ("no url", None), "e": ("no pdf", None)}


def test_payloads(spark):
    nodes = spark.createDataFrame([("author", "A1", "", None, None, None, None, 1), ("paper", "p", "", [], "", None, 2001, 1)], graph.NODE_COLUMNS)
    assert [tuple(r) for r in graph.author_payload(nodes).collect()] == [("A1", "A1", [], "")]
    assert [tuple(r) for r in graph.paper_payload(nodes).collect()] == [("p", "p", 2001)]
