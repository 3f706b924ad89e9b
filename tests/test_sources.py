import json

import pytest
from lorequarry.operators import costs
from lorequarry.sources import readers, services, writers
from lorequarry.streaming import ingest
from pyspark.sql import functions as F


def test_readers(spark, tmp_path):
    (tmp_path / "papers.json").write_text(json.dumps([{"title": "T", "authors": ["A"], "year": None, "arxiv_id": "1"}]))
    assert readers.json_array(spark, str(tmp_path / "papers.json"), readers.PAPERS).first().authors == ["A"]
    (tmp_path / "x_raw.txt").write_text("one\ntwo")
    r = readers.whole_files(spark, str(tmp_path), "*_raw.txt").first()
    assert (r.arxiv_id, r.text) == ("x", "one\ntwo")
    gold = {"_about": {"x": 1}, "q1": {"question": " Why? ", "relevant_papers": [" p ", ""]}, "q2": {"question": " "}, "_n": 3}
    (tmp_path / "gold.json").write_text(json.dumps(gold))
    rows = readers.ground_truth(spark, str(tmp_path / "gold.json")).collect()
    assert [tuple(r) for r in rows] == [("q1", "Why?", [], ["p"])]
    (tmp_path / "m.json").write_text(json.dumps({"a": [1, 2], "b": []}))
    assert {r.key: r.value for r in readers.json_map(spark, str(tmp_path / "m.json"), "array<int>").collect()} == {"a": [1, 2], "b": []}


def test_tolerant_lines(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"stage": "s", "cost": 1.5}\n\n[1]\n{"stage": \n"text"\n{"stage": "t", "extra": 1}\n')
    assert [r.stage for r in readers.read_jsonl(spark, str(path), readers.CALL_LOG).collect()] == ["s", "t"]
    assert readers.read_jsonl(spark, str(tmp_path / "none.jsonl"), readers.CALL_LOG).count() == 0


def test_pdfs_by_content(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "b.pdf").write_bytes(b"<html>")
    assert [r.arxiv_id for r in readers.pdf_files(spark, str(tmp_path)).collect()] == ["a"]


def test_unknown_collection(spark):
    with pytest.raises(ValueError, match="there are grobid, naive"):
        readers.collection(spark, "x", {"naive": "a", "grobid": "b"})


def test_search_results(spark):
    row = spark.createDataFrame([("http://x/abs/math/03v1", "T", ["A"], "2024-02-03", "S")], "entry_id string, title string, authors array<string>, published string, summary string")
    r = readers.search_results(row).first()
    assert (r.arxiv_id, r.year, r.abstract) == ("math_03v1", 2024, "S")


def test_upsert_and_append(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", 5, 1)], "k string, v int, seq int")
    assert {(r.k, r.v) for r in writers.upsert(old, new, "k", "seq").collect()} == {("a", 1), ("b", 4), ("c", 5)}
    path = str(tmp_path / "t")
    for _ in range(2):
        writers.append_missing(old, path, "k")
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(ValueError, match="stands twice"):
        writers.save_graph(old.select(F.lit("n").alias("kind"), F.lit("x").alias("id")), old, str(tmp_path / "g"))


def test_services_replay(spark, tmp_path):
    asked = spark.createDataFrame([("k1", "hello"), ("k1", "hello"), ("k2", "fail"), ("k3", "held")], "cache_key string, request string")
    cache = spark.createDataFrame([("k3", "kept")], "cache_key string, response string")

    def call(request):
        if request == "fail":
            raise OSError(request)
        return request.upper()

    services_wait, services.WAIT_SECONDS = services.WAIT_SECONDS, 0.0
    called = services.call_service(asked, cache, call)
    rows = sorted((r.cache_key, r.response, r.cache_hit) for r in called.where("response is not null").collect())
    services.WAIT_SECONDS = services_wait
    assert rows == [("k1", "HELLO", False), ("k1", "HELLO", False), ("k3", "kept", True)]
    assert [tuple(r) for r in services.cache_rows(called, cache).collect()] == [("k1", "HELLO")]


def test_costs(spark):
    calls = spark.createDataFrame([("s", "gpt-4o-mini", 1_000_000, 0, False), ("s", "gpt-4o-mini", 1_000_000, 0, True), (None, "other", 0, 1_000_000, False)], "stage string, model string, input_tokens bigint, output_tokens bigint, cache_hit boolean")
    got = {r.stage or ("total" if r.is_total else None): r for r in costs.aggregate(costs.log_rows(calls)).collect()}
    assert (got["s"].cost, got["s"].cost_no_cache, got["s"].hits, got["s"].misses, got["s"].hit_ratio) == (0.15, 0.3, 1, 1, 50.0)
    assert (got["unknown"].cost, got["total"].calls) == (0.6, 3)
    text = costs.report(costs.log_rows(calls), costs.log_rows(calls.limit(0)))
    assert "| s | 2 | 2000000 | $0.15 | $0.30 | $0.15 | 50.0 |" in text
    assert costs.aggregate(calls.withColumn("cost", F.lit("?")).withColumn("input_tokens", F.lit("bad"))).where("is_total = 1").first().cost == 0


def test_stream_upserts_each_file_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    for rows in ([("a", 1), ("b", 1)], [("b", 2), ("c", 2)], []):
        if rows:
            spark.createDataFrame(rows, "k string, v int").coalesce(1).write.mode("append").parquet(src)
        ingest.upsert_stream(ingest.file_stream(spark, src, "k string, v int"), out, ck, "k").awaitTermination()
    got = spark.read.parquet(ingest.current_version(spark, out))
    assert {(r.k, r.v) for r in got.collect()} == {("a", 1), ("b", 2), ("c", 2)}


def test_pdf_texts(spark):
    pdfs = spark.createDataFrame([("a", b"one|two"), ("b", b""), ("c", b"!")], "arxiv_id string, content binary")

    def pages_of(content):
        if content == b"!":
            raise ValueError("damaged")
        return [None if not page else page.decode() for page in content.split(b"|")]

    got = {r.arxiv_id: (r.status, r.n_pages, r.text) for r in readers.pdf_texts(pdfs, pages_of).collect()}
    assert got == {"a": ("ok", 2, "one\ntwo"), "b": ("empty", 1, ""), "c": ("failed", 0, None)}


def test_retries_wait_only_when_asked_to_slow_down(monkeypatch):
    waits = []
    monkeypatch.setattr(services.time, "sleep", waits.append)
    answers = iter([services.TooManyRequests(), ValueError(), "yes"])

    def call(request):
        answer = next(answers)
        if isinstance(answer, Exception):
            raise answer
        return answer

    assert services.with_retries(call, pause=1.0)("x") == "yes"
    assert waits == [3.0, 1.0]


def test_two_timeouts_in_a_row_stop_a_service():
    asked = []

    def call(request):
        asked.append(request)
        if request == "slow":
            raise TimeoutError
        return "" if request == "empty" else request

    tried = services.until_timeouts(call, lambda: True)
    assert [tried(r) for r in ("slow", "a", "slow", "empty", "slow", "slow", "b")] == [None, "a", None, None, None, None, None]
    assert "b" not in asked
    assert services.until_timeouts(call, lambda: False)("a") is None
