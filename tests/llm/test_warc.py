import hashlib

import duckdb
import pytest

from loomgraph.llm import common, warc

BIG = "<p>" + "é" * 80 + "</p>"


def run(spark, rows, path, schema="page_id long, url string, html string"):
    warc.write(spark.createDataFrame(rows, schema), path)
    return warc.read(spark, path)


def test_round_trip(spark, tmp_path):
    evil = "WARC/1.1\r\nContent-Length: 3\r\n\r\n" * 5
    rows = [(3, "http://a", BIG), (1, "http://b", BIG), (2, "http://c\r\nX: y", BIG), (4, None, "tiny"), (5, "u", "tiny"), (6, "u", None), (7, "u", ""), (8, "u", evil), (9, "u", "x" * 300_000), (None, "u", BIG)]
    read = run(spark, rows, str(tmp_path / "w"))
    bodies = {r["page_id"]: bytes(r["payload"]).decode() for r in read.where("record_type = 'response'").collect()}
    assert bodies == {1: BIG, 4: "tiny", 5: "tiny", 6: "", 7: "", 8: evil, 9: "x" * 300_000}
    got = {r["page_id"]: r for r in warc.resolved_back(read).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        raw = (html or "").encode()
        revisit = html == BIG and i != 1
        assert (got[i]["payload_bytes"], got[i]["payload_digest"], got[i]["record_type"], got[i]["refers_to"]) == (len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", 1 if revisit else None)


def test_repeats_and_empty(spark, tmp_path):
    got = warc.resolved_back(run(spark, [(1, "a", BIG), (1, "a", BIG), (2, "a", BIG)], str(tmp_path / "w"))).collect()
    assert sorted((r["page_id"], r["record_type"]) for r in got) == [(1, "response"), (1, "response"), (2, "revisit")]
    no_ids = warc.resolved_back(run(spark, [(None, "a", BIG), (None, "b", BIG)], str(tmp_path / "n"))).collect()
    assert [r["record_type"] for r in no_ids] == ["response", "response"]
    assert run(spark, [], str(tmp_path / "e")).isEmpty()


def test_small_files_and_least(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 5000)
    rows = [(i, "u", BIG + str(i % 3)) for i in range(50)]
    read = run(spark, rows, str(tmp_path / "w"))
    assert read.select("file").distinct().count() > 3
    assert warc.resolved_back(read).where("record_type = 'response'").count() == 3
    assert warc.resolve(spark.createDataFrame(rows, "page_id long, url string, html string"), least=10_000).where("original IS NOT NULL").isEmpty()


def test_shuffled_join_says_the_same(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    got = warc.resolved_back(run(spark, [(i, "u", BIG + str(i % 4)) for i in range(40)], str(tmp_path / "w")))
    assert {r["refers_to"] for r in got.where("record_type = 'revisit'").collect()} == {0, 1, 2, 3} and got.count() == 40


def test_repeated_ids_as_the_sql(spark, tmp_path):
    """Page ids that come with several payloads, payloads that come several times under one id: query and SQL agree, and no record id repeats."""
    a, b, c = BIG + "a", BIG + "b" * 30, BIG + "c" * 7
    rows = [(5, a), (5, b), (7, b), (8, a), (7, b), (5, a), (5, a), (9, c), (9, c), (None, a), (None, c), (None, BIG), (None, BIG), (1, "x"), (1, "x"), (2, None), (2, None), (3, b), (3, c)]
    spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    found = warc.op8_warc_revisit(spark, str(tmp_path))
    want = duck.execute(f"SELECT {', '.join(found.columns)} FROM ({warc.OP8_SQL})").fetchall()
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
    warc.write(spark.read.parquet(f"{tmp_path}/pages.parquet"), f"{tmp_path}/w")
    ids = [r["record_id"] for r in warc.read(spark, f"{tmp_path}/w").collect()]
    refers = [r["refers_to_id"] for r in warc.read(spark, f"{tmp_path}/w").where("record_type = 'revisit'").collect()]
    assert len(ids) == len(rows) == len(set(ids)) and set(refers) <= set(ids) and refers


def test_damaged():
    with pytest.raises(ValueError):
        list(warc.parse(memoryview(b"HTTP/1.1 200 OK\r\n\r\n")))
    with pytest.raises(ValueError):
        list(warc.parse(memoryview(b"WARC/1.1\r\nno end")))
