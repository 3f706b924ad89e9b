from lorequarry.plans import pipelines


def test_an_answer_is_cut_once_and_dealt_out(spark):
    answers = spark.createDataFrame([("1", 'a ```json\n{"title": "T", "authors": ["x"]}\n```'), ("2", "none"), ("3", '{"title": 1} {'), ("4", None), ("5", 'so {"authors": "x"} it is')], "arxiv_id string, response string")
    papers = spark.createDataFrame([("5", "five"), ("1", "one")], "arxiv_id string, title string")
    found = pipelines.parse_records(answers, papers)
    assert {(r.arxiv_id, r.title, tuple(r.authors)) for r in found.collect()} == {("1", "T", ("x",)), ("3", "", ()), ("5", "five", ("x",))}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(response") == 1 and "RepartitionByExpression" in plan
