import json

from pyspark.sql import functions as F

from loomgraph.operators import responses as R


def test_scans():
    assert R.strict_array('x [1, [2]] y]') == "[1, [2]]"
    assert R.strict_array('["a ] b"]') == '["a ]'
    assert R.strict_array("[1") is None and R.strict_array(None) is None
    assert json.loads(R.salvaged_array('[{"a": 1}, {"b":')) == [{"a": 1}]
    assert json.loads(R.salvaged_array('[{"a": "x ] } \\" y"}, {"b": [1, {"c": 2}]}, {"d": ')) == [{"a": 'x ] } " y'}, {"b": [1, {"c": 2}]}]
    assert R.salvaged_array("x [1, 2] y") == "[1, 2]" and R.salvaged_array('[{"a": 1}, 3] ]') == '[{"a": 1}, 3]'
    assert R.salvaged_array("[1, 2") is None and R.salvaged_array("none") is None


def test_ladder_and_validation(spark):
    one = {"head": {"text": " A ", "type": "person"}, "relation": "/people/person/children", "tail": {"text": "B", "type": "ROBOT"}, "evidence": "e", "confidence": "x"}
    items = [one, 3, {**one, "relation": "/made/up"}, {**one, "confidence": 7}, {**one, "confidence": None, "tail": {"text": ""}}, {**one, "tail": {"text": "C", "type": "ORG"}, "confidence": 0.5}]
    rows = [(1, 0, "no json"), (1, 1, "```json\n" + json.dumps(items) + "\n```"), (2, 0, json.dumps([one])[:-1] + ", {"), (3, 0, None)]
    p = R.parsed(spark.createDataFrame(rows, "doc_id long, attempt int, response string"))
    assert {(r["doc_id"], r["attempt"]): r["how"] for r in p.collect()} == {(1, 0): None, (1, 1): "strict", (2, 0): "salvaged", (3, 0): None}
    v = R.validated(R.first_parsed(p))
    got = {(r["doc_id"], r["ord"]): (r["head"], r["tail_type"], r["confidence"]) for r in v.collect()}
    assert got == {(1, 0): ("A", "OTHER", 0.0), (1, 3): ("A", "OTHER", 1.0), (1, 5): ("A", "ORG", 0.5), (2, 0): ("A", "OTHER", 0.0)}
    assert {(r["doc_id"], r["tail"]): r["ord"] for r in R.best_of_response(v).collect()} == {(1, "B"): 3, (1, "C"): 5, (2, "B"): 0}


def test_labels(spark):
    df = spark.createDataFrame([("a b",), ("ab",), ("z",), (None,)], "x string")
    first = [tuple(r[0]) for r in df.select(R.coerced_label(F.col("x"), ["c", "a b"])).collect()]
    assert first == [("a b", True, None), ("a b", True, None), ("c", False, "fallback"), ("c", False, "fallback")]
    none = [tuple(r[0]) for r in df.select(R.coerced_label(F.col("x"), ["a b"], "no_relation")).collect()]
    assert none[2] == ("NO_RELATION", False, "label_not_allowed")
    null = [tuple(r[0]) for r in df.select(R.coerced_label(F.col("x"), ["a b"], "null")).collect()]
    assert null[1] == (None, False, "label_not_allowed")


def test_providers(spark):
    q = spark.createDataFrame([(1, "p"), (2, "q")], "doc_id long, prompt string")
    got = {r["doc_id"]: r["response"] for r in R.ask(q, "prompt", lambda: lambda ps: [p * 2 for p in ps]).collect()}
    assert got == {1: "pp", 2: "qq"}
    canned = R.CannedLLM(spark.createDataFrame([(1, 0, "x")], "doc_id long, attempt int, response string"))
    assert canned.ask(q).count() == 1
    assert "/sports/sports_team/location" in q.select(R.triple_prompt(F.col("prompt")).alias("t")).first()["t"]


def test_fences(spark):
    df = spark.createDataFrame([("```json\n[1]\n```",), ("```\n[1]```",), ("```python [1]\n```",)], "x string")
    assert [r[0] for r in df.select(R.unfenced(F.col("x"))).collect()] == ["[1]", "[1]", "python [1]"]


def test_giving_up_can_raise(spark):
    import pytest

    q = spark.createDataFrame([(1, "t")], "doc_id long, text string")
    never = lambda: lambda prompts: ["no"] * len(prompts)
    assert [tuple(r) for r in R.extracted(q, never, retries=1).select("attempt", "how").collect()] == [(1, None)]
    with pytest.raises(Exception, match="could not be parsed"):
        R.extracted(q, never, retries=0, strict=True).collect()


def test_answers_are_parsed_once(spark):
    df = spark.createDataFrame([(1, '[{"a": 1}]'), (2, '[{"a": 1}, {"b'), (3, "none"), (4, None), (5, "[]"), (6, '[{"a": "]"}, {"b": "\\\\"}, 2')], "doc_id long, response string")
    p = R.parsed(df)
    plan = R.validated(p)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") + plan.count("parse_json") <= 2
    assert [(r["how"], r["n"]) for r in p.selectExpr("doc_id", "how", "size(items) AS n").orderBy("doc_id").collect()] == [("strict", 1), ("salvaged", 1), (None, None), (None, None), ("strict", 0), ("salvaged", 2)]
