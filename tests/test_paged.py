"""A fake service behind the paged source: pages asked for, filters, retries."""

import json
import time

import pytest
from lorequarry.sources import paged
from lorequarry.sources.services import TooManyRequests
from pyspark.sql import functions as F


def fake(log, failing=()):
    """Forty rows; what is asked is written down; some pages fail at first."""

    def fetch(request, number, size):
        with open(log, "a") as f:
            f.write(json.dumps([request, number, size]) + "\n")
        tries = sum(json.loads(x)[1] == number for x in open(log))
        if number in failing and tries <= failing[number]:
            raise ValueError("busy")
        rows = [(i, 2000 + i) for i in range(40) if 2000 + i >= request.get("year_min", 0)]
        return rows[number * size : (number + 1) * size]

    return fetch


def asked(log):
    return [json.loads(x) for x in open(log)]


def test_only_pages_that_the_limit_needs(spark, tmp_path):
    log = str(tmp_path / "log")
    paged.register_paged(spark, "fake_pages", fake(log), "id int, year int")
    read = spark.read.format("fake_pages").option("pageSize", 10).option("pause", 0).option("query", "graphs")
    assert sorted(r.id for r in read.option("limit", 25).load().collect()) == list(range(25))
    assert sorted(n for _, n, _ in asked(log)) == [0, 1, 2] and {r["query"] for r, _, _ in asked(log)} == {"graphs"}
    assert read.option("limit", 90).load().count() == 40 and read.option("limit", 0).load().count() == 0


def test_filters_become_part_of_the_request(spark, tmp_path):
    log = str(tmp_path / "log")
    paged.register_paged(spark, "fake_filters", fake(log), "id int, year int", ("year",))
    try:
        found = spark.read.format("fake_filters").option("pageSize", 10).option("pause", 0).option("limit", 10).load().where((F.col("year") >= 2030) & (F.col("id") != 33))
        assert sorted(r.id for r in found.collect()) == [30, 31, 32, 34, 35, 36, 37, 38, 39]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert asked(log)[-1] == [{"query": "", "year_min": 2030}, 0, 10]


def test_a_pause_after_each_error(spark, tmp_path):
    log = str(tmp_path / "log")
    paged.register_paged(spark, "fake_errors", fake(log, {0: 2}), "id int, year int")
    read = spark.read.format("fake_errors").option("pageSize", 10).option("limit", 10).option("pause", 0.7)
    began = time.perf_counter()
    assert read.load().count() == 10
    assert time.perf_counter() - began > 2.1 and [n for _, n, _ in asked(log)] == [0, 0, 0]
    paged.register_paged(spark, "fake_failures", fake(str(tmp_path / "other"), {0: 9}), "id int, year int")
    with pytest.raises(Exception, match="busy"):
        spark.read.format("fake_failures").option("limit", 10).option("attempts", 2).option("pause", 0).load().count()


def test_a_service_that_asks_to_slow_down_is_waited_for(monkeypatch):
    waits, answers = [], iter([TooManyRequests(), ValueError(), [(1,)]])
    monkeypatch.setattr(paged.time, "sleep", waits.append)

    def fetch(request, number, size):
        answer = next(answers)
        if isinstance(answer, Exception):
            raise answer
        return answer

    reader = paged.PagedReader(fetch, {"limit": "5"}, ())
    assert list(reader.read(paged.Page(0, 5))) == [(1,)] and waits == [3.0, 1.0, 1.0]
