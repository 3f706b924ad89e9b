"""Names in pages, rules of wide URLs, and long test items."""

import time

import pytest
from lorequarry.llm import decontaminate, html, urls

LONG = "A sentence of the article that goes on for a while, as the sentences of articles do. "


def page(part, where="article"):
    body = "".join(f"<p>{LONG * 3}</p>" for _ in range(12))
    return f"<body><nav><a href=x>menu</a></nav><{where}>{body}{part}</{where}><footer>f</footer></body>"


@pytest.mark.parametrize("tag", ["div", "section"])
@pytest.mark.parametrize("name", ["search-methods", "social-policy", "comment-free", "share-capital", "ad-hoc", "widget", "alert", "x"])
def test_a_part_of_the_article_stays_whatever_it_is_called(name, tag):
    part = "".join(f"<p>{LONG * 4}</p>" for _ in range(4))
    assert html.extract_text(page(f'<{tag} class="{name}">{part}</{tag}>')) == html.extract_text(page(part))


@pytest.mark.parametrize("part", [f"<div class=comments>{'<p>' + LONG * 4 + '</p>'}</div>", "<div class=widget><a href=a>Go</a> <a href=b>on</a></div>", "<div class=ad>Buy this thing now.</div>"])
def test_parts_that_are_not_the_article_go(part):
    assert html.extract_text(page(part)) == html.extract_text(page(""))
    assert html.extract_text(page("").replace("<article>", part + "<article>")) == html.extract_text(page(""))


def test_named_parts_nest_deeply_in_time():
    began = time.perf_counter()
    html.extract_text("<div class=widget>" * 20_000 + LONG)
    assert time.perf_counter() - began < 20


def mined(spark, rows, **more):
    return urls.mine_rules(spark.createDataFrame(rows, "url string, bad boolean"), **more)


def matched(spark, asked, rules):
    return {r.url for r in urls.match_rules(spark.createDataFrame([(u,) for u in asked], "url string"), rules).collect()}


def test_equal_urls_of_many_parameters_are_one_item(spark):
    wide = "http://farm.aa/?" + "&".join(f"p{i}=1" for i in range(40))
    rules = mined(spark, [(wide, True)] * 6 + [("http://fine.org/a", False)] * 20)
    assert matched(spark, ["http://x.org/?p7=2", "http://farm.aa/", "http://fine.org/a"], rules) == {"http://x.org/?p7=2", "http://farm.aa/"}
    # Seen on good pages as well, the parameters are not sure, alone or together.
    unsure = mined(spark, [(wide, True)] * 6 + [(wide.replace("farm.aa", "fine.org"), False)] * 6)
    assert matched(spark, ["http://x.org/?p7=2", "http://farm.aa/"], unsure) == {"http://farm.aa/"}


def test_any_of_the_tokens_of_the_same_baskets_makes_a_rule(spark):
    """Two kinds of two tokens each, bad only together."""
    rows = [("http://a.cc/?k1=1&k2=1&m1=1&m2=1", True)] * 6 + [("http://a.cc/?k1=1&k2=1", False)] * 9 + [("http://a.cc/?m1=1&m2=1", False)] * 9
    rules = mined(spark, rows)
    asked = [f"http://b.dd/?{x}=1&{y}=2" for x in ("k1", "k2") for y in ("m1", "m2")]
    assert matched(spark, [*asked, "http://b.dd/?k1=1&k2=1"], rules) == set(asked)
    assert all(r.confidence == 1.0 for r in rules.collect())


def test_wide_baskets_are_bounded_and_confidences_exact(spark):
    """URLs that differ in one of 30 parameters each, good and bad: no set is sure but that with the mark."""
    rows = []
    for i in range(30):
        params = "&".join(f"p{j}=1" for j in range(30) if j != i)
        rows += [(f"http://a.cc/?{params}", False), (f"http://a.cc/?{params}&mark=1&part=1", True)]
    rows += [("http://a.cc/?mark=1", False)] * 30 + [("http://a.cc/?part=1", False)] * 30
    began = time.perf_counter()
    rules = mined(spark, rows, widest=8)
    found = {tuple(r.antecedent): r.confidence for r in rules.collect()}
    assert time.perf_counter() - began < 60
    bags = [({t.split("=")[0] for t in u.split("?")[1].split("&")}, b) for u, b in rows]
    for antecedent, confidence in found.items():
        hit = [b for bag, b in bags if all(t[:2] != "q:" or t[2:] in bag for t in antecedent)]
        assert confidence == sum(hit) / len(hit) >= 0.8
    assert matched(spark, ["http://x.org/?mark=1&part=2", "http://x.org/?mark=1"], rules) == {"http://x.org/?mark=1&part=2"}


def test_odd_labels(spark):
    rows = [(None, True)] * 9 + [("http://farm.aa/", None)] * 9 + [("", True)] * 9
    assert mined(spark, rows).count() == 0
    pages = spark.createDataFrame([(1, "http://farm.aa/")] * 5 + [(2, "http://fine.bb/")] * 5, "page_id bigint, url string")
    labels = spark.createDataFrame([(1, 0, None), (1, None, 1), (2, None, None), (None, 0, 1)], "doc_id bigint, quality int, toxic int")
    assert {(r.page_id, r.verdict) for r in urls.judge(pages, labels).collect()} == {(1, "block"), (2, "allow")}


def test_an_item_of_100_000_words(spark):
    words = [f"w{i * 7919 % 30011}" for i in range(100_000)]
    item = " ".join(words)
    benchmark = spark.createDataFrame([("long", item), ("short", "What is the capital of the land? It is the old town by the sea.")], "item_id string, text string")
    weighed = decontaminate.weighed_units(benchmark)
    # What the words are grouped and joined by is a pair of numbers.
    plan = weighed._jdf.queryExecution().executedPlan().toString()
    assert not any("text#" in line for line in plan.split("\n") if "Exchange hashpartitioning" in line and "item#" in line)
    docs = spark.createDataFrame([(1, "before " * 30 + item + " after"), (2, " ".join(words[:90_000:2])), (3, "none of it")], "doc_id bigint, text string")
    began = time.perf_counter()
    assert [(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, benchmark).collect()] == [(1, "long")]
    assert time.perf_counter() - began < 100
