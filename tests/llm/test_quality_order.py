"""The classifier is the same however its rows are dealt out."""

import numpy as np
from lorequarry.llm import quality


def test_model_is_the_same_for_rows_in_another_order(spark):
    rows = [(1, f"word{i % 50} and other{i % 7} words " * (1 + i % 4), 10 + i) for i in range(200)] + [(2, "clean text of another kind", 5), (3, None, None)]
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 1), (6, 0)], "doc_id bigint, quality int")
    made = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint")
    turned = spark.createDataFrame(rows[::-1], "doc_id bigint, text string, n_chars bigint").repartition(5)
    for sample in (1, 2, 5):
        a, b = quality.train(made, labels, sample), quality.train(turned, labels, sample)
        assert a.bias == b.bias and np.array_equal(a.linear, b.linear) and np.array_equal(a.factors, b.factors)


def test_module_defines_each_name_once():
    import ast
    import inspect
    from collections import Counter

    tree = ast.parse(inspect.getsource(quality))
    names = Counter(node.name for node in tree.body if isinstance(node, ast.FunctionDef | ast.ClassDef))
    assert set(names.values()) == {1}
