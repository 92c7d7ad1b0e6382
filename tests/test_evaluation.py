import random

from pyspark.sql import functions as F

from loomgraph.operators import evaluation as E


def rows(n=400, seed=3):
    rng = random.Random(seed)
    names = ["a", "b", "c", "no_relation"]
    return [(i, g := rng.choice(names), g if rng.random() < 0.6 else rng.choice(names), round(rng.random(), 2), rng.choice([0.05, 0.3, None])) for i in range(n)]


def frame(spark, data):
    return spark.createDataFrame(data, "id int, gold string, pred string, conf double, margin double")


def test_zero_support_counts_in_macro(spark):
    labels = spark.createDataFrame([(0, "no_relation"), (1, "x"), (2, "y")], "id int, label string")
    df = spark.createDataFrame([(0, 0), (1, 1), (1, 0)], "gold int, pred int")
    t = E.per_label(E.confusion(df), labels)
    got = {r["id"]: r for r in t.collect()}
    assert got[2]["f1"] == 0 and got[2]["support"] == 0
    o = E.overall(t).first()
    assert abs(o["macro_f1"] - (2 / 3 + 2 / 3) / 3) < 1e-12 and abs(o["macro_f1_no_relation_excluded"] - (2 / 3) / 2) < 1e-12 and o["samples"] == 3


def test_grid_by_brute_force(spark):
    data = rows()
    got = {r["relation"]: r["threshold"] for r in E.fit_grid(frame(spark, data), least=50).collect()}
    for label in ("a", "b", "c"):
        best = None
        for t in E.grid():
            kept = [r for r in data if r[2] == label and r[3] >= t]
            tp = sum(r[1] == label for r in kept)
            gold = sum(r[1] == label for r in data)
            p, rc = (tp / len(kept) if kept else 0), tp / gold
            f = 2 * p * rc / (p + rc) if p + rc else 0
            key = (round(f, 9), p, -t)
            best = max(best or key, key)
        assert abs(got[label] + best[2]) < 1e-6
    assert E.fit_grid(frame(spark, data), least=10_000).isEmpty()


def test_observed_by_brute_force(spark):
    data = rows(300, 5)
    for metric, target in (("f1", 0.95), ("recall", 0.7), ("recall", 1.1)):
        got = {r["relation"]: (r["threshold"], r["f1"]) for r in E.fit_observed(frame(spark, data), 0.1, metric, target).collect()}
        for label in ("a", "b", "c"):
            best, at = -1.0, None
            for t in sorted({0.0, 1.0, *(r[3] for r in data if r[2] == label)}):
                kept = [r for r in data if r[2] == label and (r[4] is None or r[4] >= 0.1) and r[3] >= t]
                tp, gold = sum(r[1] == label for r in kept), sum(r[1] == label for r in data)
                p, rc = (tp / len(kept) if kept else 0), tp / gold
                f = 2 * p * rc / (p + rc) if p + rc else 0
                v = f if metric == "f1" else (rc if p >= target - 1e-12 else -1.0)
                if v > best + 1e-12:
                    best, at = v, t
            assert got[label][0] == (1.0 if at is None else at)
            assert (got[label][1] is None) == (at is None)


def test_gap_is_upper_median(spark):
    df = spark.createDataFrame([(float(x),) for x in (4, 1, 3, 2)], "g double")
    assert E.gap_stats(df, F.col("g")).first().asDict() == {"gap_min": 1.0, "gap_p50": 3.0, "gap_max": 4.0}
    assert E.gap_stats(df.where("g > 9"), F.col("g")).isEmpty()
    assert E.gap_stats(df.where("g = 2"), F.col("g")).first()["gap_p50"] == 2.0


def test_downsample(spark):
    df = spark.createDataFrame([(i, i < 10) for i in range(100)], "id int, pos boolean")
    got = E.downsample(df, ~F.col("pos"), "id", 2.0)
    assert got.where("pos").count() == 10 and got.where("NOT pos").count() == 20
    assert E.downsample(df.where("NOT pos"), ~F.col("pos"), "id").count() == 90
    assert E.downsample(df.where("id < 15"), ~F.col("pos"), "id").count() == 15


def test_class_weights_and_confusions(spark):
    labels = spark.createDataFrame([(0, "x"), (1, "y"), (2, "z")], "id int, label string")
    df = spark.createDataFrame([(0,)] * 99 + [(1,)], "gold int")
    assert {r["id"]: round(r["weight"], 6) for r in E.class_weights(df, labels).collect()} == {0: round(100 / 297, 6), 1: 20.0, 2: 0.0}
    c = spark.createDataFrame([(0, 1, 5), (1, 0, 5), (0, 0, 9)], "true_id int, pred_id int, count long")
    assert [r["true_id"] for r in E.top_confusions(c, 5).collect()] == [1, 0]
    assert [r["true_id"] for r in E.top_confusions(c, 5, "asc").collect()] == [0, 1]
