from lorequarry.llm import urls


def test_rules_of_wide_urls_need_not_be_of_tokens_that_are_bad_most_often(spark):
    """Bad URLs of 13 parameters, less one each, and a pair that is rarer among bad ones
    than any of them; only together is the pair sure."""
    rows = []
    for i in range(13):
        params = "&".join(f"p{j:02}=1" for j in range(13) if j != i)
        rows += [(f"http://a.cc/?{params}&mark=1&part=1", True), (f"http://a.cc/?{params}", False)]
    for i in range(13):
        rows += [(f"http://a.cc/?p{i:02}=1&mark=1", False)] * 2 + [(f"http://a.cc/?p{i:02}=1&part=1", False)] * 2
    mined = urls.mine_rules(spark.createDataFrame(rows, "url string, bad boolean"))
    asked = spark.createDataFrame([("http://x.org/?mark=1&part=2",), ("http://x.org/?mark=1",), ("http://a.cc/?p01=1&p02=1",)], "url string")
    assert "http://x.org/?mark=1&part=2" in {r.url for r in urls.match_rules(asked, mined).collect()}
    assert "http://x.org/?mark=1" not in {r.url for r in urls.match_rules(asked, mined).collect()}
