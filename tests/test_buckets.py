"""Keyed tables in buckets: what a merge touches, and what readers see."""

import os
import random
import time

import pytest
from lorequarry.functions import tei
from lorequarry.operators import costs, vectors
from lorequarry.sources import buckets
from lorequarry.streaming import ingest
from pyspark.sql import Observation
from pyspark.sql import functions as F

SCHEMA = "k string, v int, seq int"


def rows(df):
    return sorted((r.k or "", r.v) for r in df.collect())


def files(path):
    found = {}
    for at, _, names in os.walk(path):
        found |= {os.path.join(at, n): os.stat(os.path.join(at, n)).st_mtime_ns for n in names if n.startswith("part-")}
    return found


def test_merge_rewrites_only_touched_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    made = spark.createDataFrame([(f"k{i}", i, 0) for i in range(200)], SCHEMA)
    assert buckets.read(spark, path) is None
    assert buckets.merge(made, path, "k", buckets=16) == 0
    before = files(f"{path}/data")
    news = spark.createDataFrame([("k7", 70, 1), ("k7", 71, 3), ("k7", 72, 2), ("new", 5, None), (None, 6, 1)], SCHEMA)
    touched = {r[0] for r in news.select(buckets.bucket_of("k", 16)).distinct().collect()}
    assert buckets.merge(news, path, "k", "seq", buckets=16) == 1
    after = files(f"{path}/data")
    assert {f: after[f] for f in before} == before  # old files keep name and time
    made_anew = {f.rpartition("_bucket=")[2].split("/")[0] for f in set(after) - set(before)}
    assert made_anew == {str(b) for b in touched}
    want = sorted([(f"k{i}", i) for i in range(200) if i != 7] + [("k7", 71), ("new", 5), ("", 6)])
    assert rows(buckets.read(spark, path)) == want
    assert rows(buckets.read(spark, path, 0)) == sorted((f"k{i}", i) for i in range(200))
    assert buckets.vacuum(spark, path, keep=1) > 0
    assert rows(buckets.read(spark, path)) == want and len(files(f"{path}/data")) < len(after)


def test_merges_are_those_of_a_dict(spark, tmp_path):
    rng, path, held = random.Random(4), str(tmp_path / "t"), {}
    for n in range(4):
        news = [(f"k{rng.randrange(30)}", rng.randrange(100), i) for i in range(rng.randint(0, 25))]
        held |= {k: v for k, v, _ in news}
        buckets.merge(spark.createDataFrame(news, SCHEMA), path, "k", "seq", buckets=8)
        assert rows(buckets.read(spark, path)) == sorted(held.items()) if held else True
        assert buckets.versions(spark, path) == list(range(n + 1))


def test_a_batch_that_dies_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path / "t")
    buckets.merge(spark.createDataFrame([("a", 1, 0), ("b", 1, 0)], SCHEMA), path, "k", buckets=4)

    def die(batches):
        for batch in batches:
            yield batch
            raise ValueError("lost")

    dying = spark.createDataFrame([("a", 2, 0)], SCHEMA).mapInArrow(die, SCHEMA)
    with pytest.raises(Exception, match="lost"):
        buckets.merge(dying, path, "k", buckets=4)
    os.makedirs(f"{path}/manifest/v{9:012d}")  # a manifest that was never ended
    assert rows(buckets.read(spark, path)) == [("a", 1), ("b", 1)] and buckets.versions(spark, path) == [0]


def test_stream_merges_each_batch_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    for news in ([("a", 1, 0), ("b", 1, 0)], [("b", 2, 0), ("c", 2, 0)], []):
        if news:
            spark.createDataFrame(news, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        ingest.merge_stream(ingest.file_stream(spark, src, SCHEMA), out, ck, "k", n_buckets=4).awaitTermination()
    assert rows(buckets.read(spark, out)) == [("a", 1), ("b", 2), ("c", 2)]
    again = buckets.merge(spark.createDataFrame([("z", 9, 0)], SCHEMA), out, "k", version=1)
    assert again == 1 and rows(buckets.read(spark, out)) == [("a", 1), ("b", 2), ("c", 2)]


def test_counts_come_from_the_pass_that_does_the_work(spark):
    chunks = spark.createDataFrame([("a", "x"), ("b", " "), (None, "y"), ("d", None)], "chunk_id string, text string")
    seen, statuses = Observation(), Observation()
    assert vectors.usable_chunks(chunks, seen).count() == 1
    assert seen.get == {"chunks": 4, "dropped": 3}
    marked = chunks.withColumn("status", F.when(F.col("text") == "x", "ok").when(F.col("text") == "y", "odd"))
    assert costs.observed_statuses(marked, ("ok", "failed"), statuses).count() == 4
    assert statuses.get == {"ok": 1, "failed": 0, "other": 3}


def test_100_000_headings_in_seconds(spark):
    heads = F.transform(F.sequence(F.lit(1), F.lit(100_000)), lambda i: F.struct(F.when(i % 9 == 0, "Results").when(i % 7 == 0, "V. Ethics").when(i % 5 == 0, "").otherwise("Introduction").alias("head"), F.lit("t").alias("text")))
    began = time.perf_counter()
    found = spark.range(1).select(tei.assign_sections(heads).alias("a")).select(F.size("a"), F.size(tei.unmapped_heads(F.col("a")))).first()
    assert found[0] == 100_000 and time.perf_counter() - began < 30


def test_empty_headings_are_named(spark):
    divs = spark.createDataFrame([([("", "text"), (None, "more"), ("Odd", "t"), ("", " ")],)], "divs array<struct<head:string,text:string>>")
    assert divs.select(tei.unmapped_heads(tei.assign_sections(F.col("divs")))).first()[0] == ["(başlıksız)", "(başlıksız)", "Odd"]
    empty = spark.createDataFrame([([],), (None,)], "divs array<struct<head:string,text:string>>")
    assert [r.a for r in empty.select(tei.assign_sections(F.col("divs")).alias("a")).collect()] == [[], None]
