import json

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import corpus, evaluation
from loomgraph.sources import files
from loomgraph.streaming.graph_stream import edge_stream, write_edges


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_jsonl(spark, tmp_path):
    good = put(tmp_path / "a.jsonl", '{"x": 1}\n\n{"x": 2}\n')
    assert sorted(r["x"] for r in files.read_jsonl(spark, good, "x int").collect()) == [1, 2]
    assert files.read_jsonl(spark, good, "x int", limit=1).count() == 1
    bad = put(tmp_path / "b.jsonl", '{"x": 1}\n{"x": \n')
    with pytest.raises(Exception):
        files.read_jsonl(spark, bad, "x int").collect()
    with pytest.raises(ValueError, match="line 2 "):
        files.read_jsonl_checked(spark, bad, "x int")
    assert files.read_jsonl_checked(spark, good, "x int").count() == 2


def test_line_numbers_over_splits(spark, tmp_path):
    lines = [f'{{"x": {i}}}' if i % 97 else "{" for i in range(1, 3000)]
    p = put(tmp_path / "many.jsonl", "\n".join(lines) + "\n")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        assert sorted(r["line"] for r in files.bad_lines(spark, p).collect()) == list(range(97, 3000, 97))
        assert [r["x"] for r in files.read_jsonl(spark, put(tmp_path / "ok.jsonl", "\n".join(x for x in lines if x != "{")), "x int", limit=5).collect()] == [1, 2, 3, 4, 5]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_detected(spark, tmp_path):
    texts = ['{"a": 1}\n{"a": 2}\n', '[{"a": 1}, {"a": 2}]', '{"data": [{"a": 1}, {"a": 2}]}', '{"k": {"a": 1}, "l": {"a": 2}}']
    for i, t in enumerate(texts):
        df = files.read_detected(spark, put(tmp_path / f"{i}.json", t))
        assert sorted(r[0] for r in df.select(F.expr("variant_get(record, '$.a', 'int')")).collect()) == [1, 2], t


def test_maps(spark, tmp_path):
    p = put(tmp_path / "id2label.json", json.dumps({"0": "x", "1": "y"}))
    got = {r["label"]: r["id"] for r in files.read_label_map(spark, str(tmp_path / "none.json"), p).collect()}
    assert got == {"x": 0, "y": 1}
    with pytest.raises(FileNotFoundError):
        files.read_label_map(spark, str(tmp_path / "none.json"))
    t = put(tmp_path / "t.json", json.dumps({"thresholds": {"x": 0.0, "y": "no", "z": 1}}))
    assert {r["relation"]: r["threshold"] for r in files.read_thresholds(spark, t).collect()} == {"x": 0.0, "z": 1.0}


def test_corpus(spark, tmp_path):
    m = [{"em1Text": " Ann ", "em2Text": "Rome", "label": "/r"}, {"em1Text": "", "em2Text": "Rome", "label": "/r"}, {"em1Text": "Bo", "em2Text": "Rome", "label": "/r"}, {"em1Text": "Ann", "em2Text": "Rome", "label": "/other"}]
    p = put(tmp_path / "c.json", json.dumps({"sentText": "Ann saw Rome", "articleId": "1", "sentId": "2", "relationMentions": m}) + "\n")
    raw = files.read_jsonl(spark, p, files.CORPUS)
    labels = evaluation.label_map(corpus.gold_mentions(raw).where("relation = '/r'"))
    ex = corpus.examples(raw, labels, "train").collect()
    assert [r["text"] for r in ex] == ["[E1] Ann [/E1] saw [E2] Rome [/E2]"] and ex[0]["label_id"] == 0 and ex[0]["meta"]["sentId"] == "2"
    d = corpus.decoded(spark.createDataFrame([(0,), (7,)], "pred_id int"), labels)
    assert [r["label"] for r in d.orderBy("pred_id").collect()] == ["/r", "__UNK_ID_7__"]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("Zoë \"q\"", None, [1, 2])], "a string, b string, c array<int>")
    files.write_jsonl(df, str(tmp_path / "j"))
    assert json.loads(spark.read.text(str(tmp_path / "j")).first()[0]) == {"a": 'Zoë "q"', "b": None, "c": [1, 2]}
    files.write_csv(df, str(tmp_path / "c"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).first()
    assert back["a"] == 'Zoë "q"' and back["c"] == "[1,2]"
    assert files.write_summary(df.agg(F.count("*").alias("n")), str(tmp_path / "s"), thr=0.5) == {"thr": 0.5, "n": 1}
    e = spark.createDataFrame([("a", "b", "R", "/r", 2, 0.5, 0.25, "x")], "src_id string, dst_id string, rel_type string, rel_raw string, support_count long, conf_max double, conf_mean double, evidence string")
    files.write_graph(spark.createDataFrame([("a", "A", "ORG")], "id string, name string, type string"), e, str(tmp_path / "g"))
    assert spark.read.option("header", True).csv(str(tmp_path / "g/edges")).first()["conf_mean"] == "0.250000"
    assert files.listed(spark.createDataFrame([("a", "r", "b", None), ("a", "r", "c", 0.1)], "head string, relation string, tail string, conf double"), 0.5) == ["(a) -[r]-> (b)"]


def test_stream(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "A", "ORG", "/business/company/founders", "B", "PERSON", 0.9), ("2024-01-01 00:01:00", "B", "PERSON", "/business/company/founders", "A", "ORG", 0.5), ("2024-01-01 05:00:00", "A", "ORG", "/business/company/founders", "C", "PERSON", 0.5)]
    schema = "ts timestamp, head string, head_type string, relation string, tail string, tail_type string, conf double"
    spark.createDataFrame(rows, "ts string, head string, head_type string, relation string, tail string, tail_type string, conf double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = write_edges(edge_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r["src_id"], r["dst_id"], r["support_count"], r["conf_max"]) for r in got] == [("ORG:A", "PERSON:B", 2, 0.9)]
