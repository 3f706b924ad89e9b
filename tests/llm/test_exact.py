"""Exact duplicates against plain loops, and against SQL."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import pytest
from lorequarry.llm import exact
from lorequarry.llm.queries import ORACLE_SQL, QUERIES
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def by_hand(rows):
    """One row is kept of each text; rows of one id and text may swap places."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    least = lambda x: (x is not None, x or 0)
    found = Counter()
    for text, ids in groups.items():
        top = max(ids, key=least)
        digest = hashlib.sha256(text.encode()).hexdigest()
        for n, i in enumerate(sorted(ids, key=least, reverse=True)):
            found[(i, top, len(ids), n == 0, digest)] += 1
    return found


def taken(df):
    return Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect())


@pytest.mark.parametrize("counters", [1, 3, 1023])
def test_by_hand_with_hot_texts_ties_and_nulls(spark, counters):
    rng = random.Random(counters)
    rows = [(i, "the same " * 50) for i in range(300)] + [(1000 + i, None if i % 2 else "") for i in range(200)]
    rows += [(2000 + i, f"text {rng.randrange(150)}") for i in range(400)] + [(None, "text 7"), (None, "alone"), (5, "the same " * 50), (2001, "x" * 200_000)]
    rows += [(7, "twice"), (7, "twice"), (8, " twice"), (None, "no id"), (None, "no id")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    assert taken(exact.duplicates(docs, counters=counters)) == by_hand(rows)


def test_odd_rows_and_empty_tables(spark, odd_docs, no_docs):
    assert taken(exact.duplicates(odd_docs)) == by_hand([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert exact.duplicates(no_docs).count() == 0 and exact.kept_rows(no_docs).columns == no_docs.columns
    clash = odd_docs.withColumns({"digest": F.lit(1), "row_no": F.lit(2), "group_size": F.lit("g"), "winner": F.lit(None).cast("string"), "row": F.lit(3)})
    kept = exact.kept_rows(clash, counters=1)
    assert kept.columns == clash.columns
    assert sorted((r.text or "") for r in kept.collect()) == sorted({(r.text or "") for r in odd_docs.collect()})
    assert {r.doc_id for r in kept.collect()} == {1, 3, None, 4, 5, 6}


def test_summaries_bound_and_miss_nothing_frequent(spark):
    rng = random.Random(4)
    rows = [(i, b"a" if i % 3 == 0 else b"b" if i % 7 == 0 else str(rng.random()).encode()) for i in range(3000)]
    marked = spark.createDataFrame(rows, "doc_id bigint, digest binary").repartition(5)
    for counters in (7, 31, 127):
        held = {bytes(r.digest) for r in exact.frequent(marked, counters).collect()}
        true = Counter(d for _, d in rows)
        assert len(held) <= counters
        assert {d for d, n in true.items() if n > 3 * len(rows) / (counters + 1)} <= held


def test_merging_summaries_keeps_the_bound():
    rng = random.Random(1)
    true, held, n = Counter(), {}, 0
    for _ in range(40):
        part = Counter(rng.choice("aaabbcdefghijklmnopqrstuvwxyz") for _ in range(50))
        true += part
        n += 50
        for k, c in part.items():
            held[k] = held.get(k, 0) + c
        held = exact.summarise(held, 6)
        assert len(held) <= 6
        assert all(true[k] - n / 7 <= held.get(k, 0) <= true[k] for k in true)


@pytest.mark.parametrize("name", ["op12_exact", "op13_golden"])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "clients"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    made, sql = QUERIES[name](spark, SF), con.execute(ORACLE_SQL[name])
    names = [c[0] for c in sql.description]
    assert sorted(made.columns) == sorted(names)
    assert sorted(map(tuple, made.select(*names).collect()), key=str) == sorted(sql.fetchall(), key=str)
