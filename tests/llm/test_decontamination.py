import hashlib
import random
import re

from loomgraph.llm import decontamination as D

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOW))


def brute(docs, items):
    wins = []
    for i, t in items:
        w = words(t)
        if w:
            n = min(10, len(w))
            wins += [(i, tuple(w[j : j + n])) for j in range(len(w) - n + 1)]
    out = []
    for d, t in docs:
        w, hit, who = words(t), set(), set()
        for i, g in wins:
            for j in range(len(w) - len(g) + 1):
                if tuple(w[j : j + len(g)]) == g:
                    hit.update(range(j, j + len(g)))
                    who.add(i)
        names = ",".join(sorted(str(x) for x in who if x is not None))
        out.append((d, len(w), len(hit), len(who), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def cases(seed=1, n=60):
    rng = random.Random(seed)
    vocab = ["a", "b", "Zoë", "d2", "e", "the", "É"] + [f"w{i}" for i in range(30)]
    text = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    items = [(i, text(rng.choice([1, 3, 9, 10, 11, 30]))) for i in range(25)] + [(100, None), (101, ""), (102, "!!!"), (None, text(12)), (3, text(14)), (103, "a " * 40)]
    docs = []
    for d in range(n):
        t = text(rng.choice([0, 5, 40, 200]))
        for _ in range(rng.choice([0, 1, 3])):
            src = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(src) + 1)
            cut = " ".join(src[a : a + rng.choice([5, 9, 10, 12, 40])])
            t = t[: len(t) // 2] + " " + cut.upper().replace("É", "É") + "," + t[len(t) // 2 :]
        docs.append((d, t))
    return docs + [(500, None), (501, ""), (502, "a " * 5000), (None, items[0][1]), (0, docs[0][1])], items


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def result(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in D.digest(df).collect()), key=str)


def test_against_brute_force(spark):
    for seed in (1, 2, 3):
        docs, items = cases(seed)
        assert result(D.decontaminate(*frames(spark, docs, items), keep=["doc_id"])) == brute(docs, items)


def test_joined_fingerprints_say_the_same(spark, monkeypatch):
    small = frames(spark, *cases(4))
    want = D.decontaminate(*small).drop("text").collect()
    monkeypatch.setattr(D, "BLOCK_BYTES", 30)
    for seed, most in ((4, 1 << 27), (5, 1 << 16)):
        monkeypatch.setattr(D, "SIEVE_MOST", most)
        docs, items = cases(seed, 40)
        assert result(D.decontaminate(*frames(spark, docs, items), keep=["doc_id"])) == brute(docs, items)
    assert sorted(map(str, D.decontaminate(*small).drop("text").collect())) == sorted(map(str, want))
    df, bench = small
    assert D.decontaminate(df.limit(0), bench).isEmpty()
    clashing = D.decontaminate(df.selectExpr("*", "'x' AS Items", "1 AS d", "2 AS t", "3 AS maybe"), bench)
    assert sorted(clashing.columns) == sorted(["doc_id", "text", "d", "t", "maybe", "n_words", "hit_spans", "n_items", "items", "contaminated"])
    assert clashing.where("d = 1 AND t = 2 AND maybe = 3").count() == df.count()
    monkeypatch.setattr(D, "fits", lambda df: False)
    docs, items = cases(6, 40)
    assert result(D.decontaminate(*frames(spark, docs, items), keep=["doc_id"])) == brute(docs, items)


def test_empty_and_clashing(spark):
    docs, items = cases(5, 5)
    df, bench = frames(spark, docs, items)
    assert D.decontaminate(df.limit(0), bench).isEmpty()
    none = D.decontaminate(df, bench.limit(0))
    assert none.where("contaminated OR n_items > 0").isEmpty() and none.count() == len(docs)
    extra = df.selectExpr("*", "1 AS items", "'x' AS Contaminated", "2 AS other")
    got = D.decontaminate(extra, bench)
    assert sorted(got.columns) == sorted(["doc_id", "text", "other", "n_words", "hit_spans", "n_items", "items", "contaminated"])


def test_long_text_in_pieces(spark, monkeypatch):
    from loomgraph.llm import common

    monkeypatch.setattr(common, "CHUNK_BYTES", 200)
    docs, items = cases(6, 15)
    index = D.Index([(str(i), t) for i, t in items if t and i is not None])
    import numpy as np

    for d, t in docs:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        w = common.Words(raw, np.array([0, len(raw)]), common.ALNUM)
        hit, _ = index.scan(w)
        assert (len(w.hash), int(hit.sum())) == next(x[1:3] for x in brute([(d, t)], [x for x in items if x[0] is not None]))
