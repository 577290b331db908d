"""Providers' outputs of every shape."""

import json

from corvane.operators import lifecycle

CASES = [
    # question, rewrite, intent -> asked, intent, constraints, source
    ("8 ports", None, None, ["8 ports"], "", [], "fallback"),
    ("original", '{"queries": ["variant-a", "variant-a", "variant-b", "variant-c"]}', None, ["original", "variant-a", "variant-b"], "", [], "llm"),
    (" 8 ports ", '["RJ45 switch", " 8 ports", 5, null]', None, ["8 ports", "RJ45 switch"], "", [], "llm"),
    ("q", "not-json", None, ["q"], "", [], "fallback"),
    ("q", '"text"', '{"intent": 3}', ["q"], "3", [], "llm"),
    ("q", '{"queries": "text"}', "[]", ["q"], "", [], "fallback"),
    ("compare", None, '{"intent": "comparison", "constraints": [{"field": "ports", "operator": ">=", "value": 8}], "needs_graph": false}', ["compare"], "comparison", [{"field": "ports", "operator": ">=", "value": 8}], "llm"),
    ("compare", '["other"]', '{"constraints": [{"a": 1}, 2]}', ["compare", "other"], "", [{"a": 1}], "mixed"),
    ("compare", None, "not-json", ["compare"], "", [], "fallback"),
    ("  ", '["other"]', '{"intent": "x"}', ["  "], "", [], "fallback"),
    (None, '["other"]', None, [""], "", [], "fallback"),
]


def test_outputs(spark):
    rows = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(CASES)], "i int, text string, rewrite string, said string")
    got = lifecycle.query_understanding(rows, "text", "rewrite", "said", most=3).orderBy("i").collect()
    for r, c in zip(got, CASES, strict=True):
        assert (r["retrieval_queries"], r["intent"], [json.loads(x) for x in r["constraints"]], r["source"]) == c[3:], c
    plain = lifecycle.query_understanding(rows).orderBy("i").collect()
    assert {r["source"] for r in plain} == {"fallback"}
