import math

import numpy as np
from pyspark.sql import functions as F

from loomgraph.operators import scoring


def test_softmax_topk_margin(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), ([2.0],)], "logits array<double>")
    a, b = scoring.predicted(df, k=2).collect()
    e = [math.exp(x) for x in (1, 3, 3)]
    assert np.allclose(a["probs"], [x / sum(e) for x in e])
    assert a["pred_id"] == 1 and [t["id"] for t in a["topk"]] == [1, 2] and a["margin"] == 0
    assert b["margin"] is None and b["conf"] == 1.0


def test_accepts(spark):
    rows = [(0.8, 0.79), (0.6, 0.4), (0.6, 0.5), (0.49, 0.0), (0.6, None)]
    got = spark.createDataFrame(rows, "c double, t double").select(scoring.accepts(F.col("c"), F.col("t")).alias("k")).collect()
    assert [r["k"] for r in got] == [True, True, False, False, True]


def test_every_reason(spark):
    child = "/people/person/children"
    person = ("PERSON", "PERSON")
    rows = [
        (1, "P0_fallback_window", "m", child, 0.99, 0.9, *person, "x", None),
        (2, "P1_SVO", "", child, 0.99, 0.9, *person, "x", None),
        (3, "P1_SVO", "m", "no_relation", 0.99, 0.9, *person, "x", None),
        (4, "P1_SVO", "m", child, 0.99, 0.9, "ORG", "ORG", "x", None),
        (5, "P1_SVO", "m", child, 0.5, 0.9, *person, "x", None),
        (6, "P1_SVO", "m", child, 0.99, 0.1, *person, "x", None),
        (7, "P1_SVO", "m", child, 0.99, None, *person, "nothing", None),
        (8, "P1_SVO", "m", child, 0.99, None, *person, "a person", 0.2),
        (9, "P1_SVO", "m", child, 0.99, None, *person, "a person", 0.9),
        (10, "P2_pred_prep+conj", "m", "/made/up", 0.95, 0.9, *person, "x", None),
    ]
    df = spark.createDataFrame(rows, "id int, pattern string, marked string, relation string, conf double, margin double, head_type string, tail_type string, sentence string, ent double")
    got = {r["id"]: r["reason"] for r in scoring.gated(df, explicit_only=True, verifier="ent").collect()}
    assert got == {1: "explicit_only", 2: "mark_failed", 3: "no_relation", 4: "schema", 5: "conf_threshold", 6: "margin", 7: "trigger", 8: "verifier", 9: "accept", 10: "accept"}


def test_fallback_threshold(spark):
    rows = [("P0_fallback_window", 0.9985), ("P0_fallback_window", 0.9991), ("P1_SVO", 0.99)]
    df = spark.createDataFrame([(p, "m", "/location/location/contains", c, None, "GPE", "GPE", "x") for p, c in rows], "pattern string, marked string, relation string, conf double, margin double, head_type string, tail_type string, sentence string")
    assert [r["decision"] for r in scoring.gated(df).orderBy("conf").collect()] == ["accept", "reject", "accept"]


def test_export_conserves(spark):
    rows = [("/business/person/company", c, 0.1, h, "ORG") for c in (0.3, 0.7, 0.9) for h in ("PERSON", "ORG", "")] + [("/made/up", 0.9, 0.1, "ORG", "ORG"), ("no_relation", 0.9, 0.1, "ORG", "ORG")]
    df = spark.createDataFrame(rows, "relation string, conf double, top2 double, head_type string, tail_type string")
    got = {r["reason"]: r["count"] for r in scoring.export_reason(df, drop_labels=["no_relation"], strict=True).groupBy("reason").count().collect()}
    assert sum(got.values()) == len(rows)
    assert got == {"dropped_label": 1, "dropped_no_rule": 1, "dropped_rule_conf": 6, "dropped_type": 1, "kept": 2}


def test_hypothesis_is_not_filled_twice(spark):
    df = spark.createDataFrame([("/people/person/children", "the {t} firm", "Bo"), ("/made/up", "A", "B")], "relation string, head string, tail string")
    assert {r["hypothesis"] for r in scoring.hypothesis(df).collect()} == {"Bo is a child of the {t} firm.", "A has relation /made/up with B."}


def test_scorers(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, None)], "id int, t string")
    model = lambda: scoring.CentroidScorer(3)
    got = {r["id"]: r["logits"] for r in scoring.score(df, "t", model).collect()}
    assert len(got[1]) == 3 and got[1] == got[2]
    again = {r["id"]: r["logits"] for r in scoring.score_distinct(df.where("t IS NOT NULL"), ["id"], F.col("t"), model).collect()}
    assert again[1] == got[1]


def test_thresholds_merge_keeps_zero(spark):
    a = spark.createDataFrame([("x", 0.9), ("y", 0.8)], "relation string, threshold double")
    b = spark.createDataFrame([("x", "0.0"), ("y", "high"), ("z", "0.5")], "relation string, threshold string")
    assert {r["relation"]: r["threshold"] for r in scoring.merged_thresholds(a, b).collect()} == {"x": 0.0, "y": 0.8, "z": 0.5}


def test_small_helpers(spark):
    d = scoring.directed(spark.createDataFrame([("a", "b", "reverse"), ("a", "b", None)], "head string, tail string, direction string")).collect()
    assert [(r["source"], r["target"]) for r in d] == [("b", "a"), ("a", "b")]
    assert scoring.entailment_ids({0: "ENTAILMENT", 1: "neutral", 2: "contradiction"}) == (0, 1, 2)
    assert scoring.entailment_ids({0: "LABEL_0", 1: "LABEL_1", 2: "LABEL_2"}) == (2, 1, 0)
    m = spark.createDataFrame([(1, "r", 0.5), (2, "s", 0.5)], "id int, relation string, conf double")
    n = spark.createDataFrame([(1, "r"), (3, "s")], "id int, relation string")
    assert [(r["id"], r["agree"]) for r in scoring.side_by_side(m, n, ["id"]).collect()] == [(1, True)]


def test_centroid_counts_per_text():
    import numpy as np

    texts = ["abc", "", None, "ab", "aBCabc ä", "abcd" * 50]
    scorer = scoring.CentroidScorer(3)
    x = np.zeros((len(texts), scorer.dim))
    for i, t in enumerate(texts):
        raw = (t or "").lower().encode()
        for k in range(len(raw) - 2):
            x[i, (raw[k] * 961 + raw[k + 1] * 31 + raw[k + 2]) % scorer.dim] += 1
    n = np.linalg.norm(x, axis=1, keepdims=True)
    assert np.array_equal(scorer(texts), x / np.where(n == 0, 1, n) @ scorer.w)
