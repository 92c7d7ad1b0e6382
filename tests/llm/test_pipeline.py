import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from loomgraph.llm import common  # noqa: E402
from tests.llm.test_decontamination import brute as leaks  # noqa: E402
from tests.llm.test_jaccard import brute as links  # noqa: E402


def folder(spark, path, docs, seed=1):
    rng = random.Random(seed)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(d[0], int("%%%" not in (d[1] or "")), 0) for d in docs if d[0] is not None and rng.random() < 0.8], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"bench{i}" for i in range(14)))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def corpus(seed=1):
    rng = random.Random(seed)
    vocab = [f"{a}{b}" for a in ("ka", "lo", "mi", "ru", "te", "su") for b in ("na", "ri", "po", "de", "gu", "ba", "she", "ton")]
    docs = []
    for i in range(160):
        t = " ".join(rng.choice(vocab) for _ in range(rng.choice([30, 80])))
        if i % 6 == 0:
            t = " ".join(w + "%%%" for w in t.split())
        if i % 20 == 1:
            t += " " + " ".join(f"Bench{k}" for k in range(2, 13))
        if i % 15 == 2 and docs:
            t = docs[-1][1] + " again"
        docs.append((i, t, "en", f"s{i % 3}" if i % 5 else None, len(t)))
    docs += [(None, docs[5][1], "en", "s1", 1), (None, " ".join(rng.choice(vocab) for _ in range(50)), "en", "s1", 1)]
    return docs + [(500, None, None, "s1", None), (501, "", "en", "s1", 0), (3, docs[3][1], "en", "s0", 1), (502, "x " * 30000, "en", "s2", 9)]


def test_stages(spark, tmp_path):
    docs = corpus()
    folder(spark, str(tmp_path), docs)
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    now = df
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        path = f"{tmp_path}/out{k}"
        out.write.parquet(path)
        before, after = now.collect(), spark.read.parquet(path).collect()
        if k < 4:
            assert out.columns == df.columns
        if name == "quality":
            kept = {r["doc_id"] for r in after}
            junk = {d[0] for d in docs if "%%%" in (d[1] or "")}
            clean = {d[0] for d in docs if "%%%" not in (d[1] or "") and len(d[1] or "") > 50 and d[0] != 502}
            assert len(kept & junk) <= 0.1 * len(junk) and len(kept & clean) >= 0.95 * len(clean)
        if name == "near_duplicates":
            rows = [(r["doc_id"], r["text"]) for r in before]
            found = links(rows, 5, 80, 100)
            want = {c if n else d for d, n, c in found if d is not None or c is not None} | {d for d, n, c in found if c is None}
            assert sorted((r["doc_id"] for r in after), key=str) == sorted(want, key=str)
        if name == "decontamination":
            bad = {x[0] for x in leaks([(r["doc_id"], r["text"]) for r in before], [(1, " ".join(f"bench{i}" for i in range(14)))]) if x[5]}
            assert bad and {r["doc_id"] for r in after} == {r["doc_id"] for r in before} - bad
        if name == "mixing":
            assert 0.8 * len(before) <= len(after) <= len(before)
        if name == "sharding":
            assert len(after) == len(before) and set(out.columns) == {*df.columns, "shard", "slot"}
            counts = {}
            for r in after:
                counts.setdefault(r["shard"], []).append(r["slot"])
            assert all(sorted(x) == list(range(len(x))) for x in counts.values())
        now = spark.read.parquet(path)


def test_empty(spark, tmp_path):
    folder(spark, str(tmp_path), corpus()[:12])
    now = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        assert now.isEmpty()


def test_run(spark, tmp_path):
    folder(spark, str(tmp_path), corpus(2))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 100


def test_mixing_keeps_all_rows_in_order(spark):
    docs = [(i, "t", "en", "hot", 1) for i in range(3000)] + [(9000 + i, "t", "en", "b", 1) for i in range(1000)] + [(9999, "t", "en", "rare", 1), (None, "t", "en", None, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.mix(spark, df, "").collect()
    assert sorted(map(str, got)) == sorted(map(str, df.collect()))
    seen = sum(r["source"] == "b" for r in got[:1000])
    weights = {"hot": 3000**0.9, "b": 1000**0.9, "rare": 1, None: 1}
    assert abs(seen - 1000 * weights["b"] / sum(weights.values())) <= 16


@pytest.mark.parametrize("most", [1 << 18, 0])
def test_near_duplicates_by_row(spark, monkeypatch, most):
    monkeypatch.setattr(common, "BROADCAST_BYTES", most)  # 0: all joins by shuffles
    rng = random.Random(4)
    t = [" ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(6)]
    docs = [
        (1, t[0]), (7, t[0] + " again"), (7, t[1]),  # a copy and a text of its own under one id
        (8, t[2]), (8, t[2] + " again"),  # near copies of one id
        (None, t[3]), (None, t[3] + " again"), (None, t[4]),  # near copies without an id
        (None, t[5]), (9, t[5] + " again"), (12, t[5] + " again"), (9, t[5] + " again"), (20, None), (None, ""),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = corpus_pipeline.keep_one_of_each(spark, df, "").collect()
    assert {tuple(r) for r in got} <= set(docs)
    which = sorted((str(r["doc_id"]), r["text"] and t.index(r["text"].removesuffix(" again"))) for r in got if r["text"])
    assert which == [("1", 0), ("7", 1), ("8", 2), ("9", 5), ("None", 3), ("None", 4)]
    assert len(got) == 8


CLASHES = ("score", "predicted", "held_out", "shard", "slot", "position", "block", "__key", "__s", "__b", "__k", "__id", "name", "row", "tie", "node", "label", "n", "g", "row_key", "contaminated", "n_words", "items", "column0", "repeated", "a.b")


def test_clashing_names(spark, tmp_path):
    """Every stage keeps columns of its operators' names, and the same rows as without them."""
    docs = corpus(3)[:80] + [(None, None, None, None, None)]
    folder(spark, str(tmp_path), docs)
    plain = spark.read.parquet(f"{tmp_path}/documents.parquet")
    wide = plain.selectExpr("*", *[f"concat('{c} ', coalesce(doc_id, -1)) AS `{c}`" for c in CLASHES])
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out, want = stage(spark, wide, str(tmp_path)), stage(spark, plain, str(tmp_path))
        out.write.parquet(f"{tmp_path}/wide{k}")
        kept = [c for c in wide.columns if k < 4 or c not in ("shard", "slot")]
        assert out.columns == kept + (["shard", "slot"] if k == 4 else [])
        rows = out.collect()
        assert sorted(str((r["doc_id"], r["text"])) for r in rows) == sorted(str((r["doc_id"], r["text"])) for r in want.collect()) and rows
        assert all(r[c] == f"{c} {-1 if r['doc_id'] is None else r['doc_id']}" for r in rows for c in kept if c in CLASHES)


def test_emptied_half_way(spark, tmp_path):
    """All documents rejected by the first stage: the others get an empty table."""
    folder(spark, str(tmp_path), [d for d in corpus() if "%%%" in (d[1] or "")])
    spark.createDataFrame([(0, 0, 0)] + [(i, 0, 0) for i in range(0, 160, 6)], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.isEmpty() and out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"]


@pytest.mark.parametrize("files", [True, False])
def test_slots_keep_the_mixed_order(spark, tmp_path, monkeypatch, files):
    """What the mixing stage does is seen in the shards: their slots follow its order, and another order gives other slots."""
    monkeypatch.setattr("loomgraph.llm.sharding.STRETCH", 100)
    docs = [(i, f"t{i}", "en", "hot", 1) for i in range(900)] + [(9000 + i, f"u{i}", "en", "b", 1) for i in range(600)] + [(None, "t", "en", None, 1)] * 20
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)

    def slots(mixed, name):
        mixed = mixed.selectExpr("*", "0L AS _metadata", "monotonically_increasing_id() AS place")
        if files:
            mixed.write.option("maxRecordsPerFile", 130).parquet(f"{tmp_path}/{name}")
            mixed = spark.read.parquet(f"{tmp_path}/{name}")
        rows = corpus_pipeline.deal(spark, mixed, "").collect()
        assert len(rows) == len(docs)
        for s in range(24):
            of = sorted((r["slot"], r["place"]) for r in rows if r["shard"] == s)
            assert [x for x, _ in of] == list(range(len(of))) and [p for _, p in of] == sorted(p for _, p in of)
        return {r["doc_id"]: (r["shard"], r["slot"]) for r in rows if r["doc_id"] is not None}

    a, b = slots(corpus_pipeline.mix(spark, df, ""), "mixed"), slots(df.orderBy("source", "doc_id").coalesce(1), "sorted")
    assert {k: s for k, (s, _) in a.items()} == {k: s for k, (s, _) in b.items()} and a != b
    # both sources run through a shard's slots as through the whole
    assert sum(a[i][1] for i in range(9000, 9600)) / 600 == pytest.approx(sum(a[i][1] for i in range(900)) / 900, rel=0.25)
