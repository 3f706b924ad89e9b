import random

from pyspark.sql import functions as F
from lorequarry.llm import urls


def test_five_bad_rows_give_a_rule_in_a_large_table(spark):
    rows = [(f"http://fine{i % 40}.org/a/{i}", i % 3 == 0) for i in range(6000)]
    rows += [("http://farm.aa/", True)] * 5 + [("http://four.bb/", True)] * 4
    mined = urls.mine_rules(spark.createDataFrame(rows, "url string, bad boolean"))
    found = {t: r for r in mined.collect() for t in r.antecedent}
    assert found["h:farm"].confidence == 1.0 and "h:four" not in found
    asked = spark.createDataFrame([("http://farm.aa/y",), ("http://four.bb/y",), ("http://fine1.org/a/1",)], "url string")
    assert [r.url for r in urls.match_rules(asked, mined).collect()] == ["http://farm.aa/y"]


def test_mined_rules_are_all_and_decide(spark):
    """Rules and verdicts against a search of all token sets of up to three tokens."""
    from itertools import combinations

    rng, rows = random.Random(5), []
    for k in range(240):
        host = rng.choice(["spam.biz", "shop.spam.biz", "news.info", "blog.info"])
        path = "/".join(rng.sample(["win", "buy", "read", "now"], rng.randint(0, 2)))
        bad = "spam" in host and "win" in path or rng.random() < 0.05
        rows.append((k, f"http://{host}/{path}", bad))
    rows += [(900, None, True), (901, None, False), (902, "http://spam.biz/win" + "/x" * 50_000, True)]
    pages = spark.createDataFrame([(i, u) for i, u, _ in rows], "page_id bigint, url string")
    labels = spark.createDataFrame([(i, 0 if b else 1, 0) for i, _, b in rows], "doc_id bigint, quality int, toxic int")
    bags = {r.page_id: frozenset(r.t or ()) for r in pages.select("page_id", urls.tokens(F.col("url")).alias("t")).collect()}
    bad = {i: b for i, _, b in rows}
    sure = {}
    for n in (1, 2, 3):
        for some in combinations(sorted(frozenset().union(*bags.values())), n):
            hit = [bad[i] for i, t in bags.items() if t.issuperset(some)]
            if sum(hit) >= 5 and sum(hit) / len(hit) >= 0.8:
                sure[some] = sum(hit) / len(hit)
    want = {i: "block" if any(t.issuperset(s) for s in sure) else "allow" for i, t in bags.items()}
    got = {r.page_id: r.verdict for r in urls.judge(pages, labels, rules=()).collect()}
    assert got == want and set(want.values()) == {"block", "allow"}


def test_null_urls_alone_are_allowed(spark):
    pages = spark.createDataFrame([(1, None), (1, None), (None, None)], "page_id bigint, url string")
    labels = spark.createDataFrame([(1, 0, 0), (None, 0, 0)], "doc_id bigint, quality int, toxic int")
    assert [(r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, labels).collect()] == [("", "", None, "allow")] * 3
