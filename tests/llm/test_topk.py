import math
import time

import numpy as np
import pytest

from loomgraph.llm import topk as K


def brute(rows, every, k, scale=256):
    ok = [(i, [math.floor(x * scale) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, x in ok:
        if q % every == 0:
            best = sorted({(-sum(a * b for a, b in zip(x, y)), i) for i, y in ok if i != q})[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(set(out))


def vectors(n, d, seed=0, copies=0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(5, d))
    x = centers[rng.integers(0, 5, n)] + rng.normal(0, 0.3, (n, d))
    if copies:
        x[:copies] = x[0]
    return [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]


def run(spark, rows, every=10, k=5):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return sorted(tuple(r) for r in K.top_k(df, k, every).select("query_id", "rank", "vec_id", "score").collect())


def test_against_brute_force(spark, monkeypatch):
    rows = vectors(400, 8)
    assert run(spark, rows) == brute(rows, 10, 5)
    monkeypatch.setattr(K, "LEAST_PART", 20)
    monkeypatch.setattr(K, "PART", 20)
    monkeypatch.setattr(K, "GROUP", 4)
    monkeypatch.setattr(K, "BLOCK", 3)
    monkeypatch.setattr(K, "PIVOTS", 6)
    rows = vectors(300, 6, 1, copies=120)
    assert run(spark, rows, 7, 5) == brute(rows, 7, 5)


def test_ties_nulls_few(spark):
    rows = [(0, [1.0, 0.0]), (5, [0.5, 0.1]), (3, [0.5, 0.1]), (4, None), (10, [None, 1.0]), (20, [float("nan"), 1.0]), (30, [float("inf"), 1.0]), (None, [9.0, 9.0]), (40, [-1.0, 0.003]), (50, [])]
    assert run(spark, rows, 10, 5) == brute(rows, 10, 5)
    assert [r[2] for r in run(spark, rows, 10, 5) if r[0] == 0] == [3, 5, 40]
    assert run(spark, rows[:1]) == [] and run(spark, []) == []
    with pytest.raises(ValueError):
        run(spark, [(0, [1.0]), (1, [1.0, 2.0])])


def test_trees_prune_and_stay_exact():
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(20, 4))[rng.integers(0, 20, 3000)] * 300 + rng.normal(0, 10, (3000, 4))).astype(np.int64)
    q = x[:40]
    best = K.Best(40, 5)
    data = K.Cover(x)
    queries = K.Cover(q, leaf=4)
    visited = K.dual(queries, np.arange(40), data, np.arange(3000), best)
    for i in range(40):
        want = sorted((-(int(q[i] @ x[j])), j) for j in range(3000) if j != i)[:5]
        assert sorted((-s, -v) for s, v in best.heaps[i]) == want
    assert visited < len(data.center) * len(queries.center) / 2


def test_cover_radii():
    rng = np.random.default_rng(4)
    x = rng.integers(-500, 500, (700, 5))
    tree = K.Cover(x)

    def below(k):
        return list(tree.points[k]) if tree.points[k] is not None else [p for c in tree.child[k] for p in below(c)]

    assert sorted(below(0)) == list(range(700))
    for k in range(len(tree.center)):
        pts = below(k)
        assert tree.center[k] in pts
        assert np.sqrt(((x[pts] - x[tree.center[k]]) ** 2).sum(axis=1)).max() <= tree.radius[k] + 1e-6


def test_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(K, "LEAST_PART", 20)
    monkeypatch.setattr(K, "PART", 20)
    monkeypatch.setattr(K, "PIVOTS", 6)
    rows = vectors(150, 6, 5)
    best = brute(rows, 10, 5)
    rows += [rows[best[0][2]]] * 4 + [rows[0]] + [(rows[best[5][2]][0], rows[7][1])] * 2 + [(10, rows[33][1])]
    ints = [(i, [math.floor(x * 256) for x in v]) for i, v in rows]
    want = []
    for q in {i for i, _ in ints if i % 10 == 0}:
        found = sorted((-sum(a * b for a, b in zip(x, y)), i) for p, x in ints if p == q for i, y in ints if i != q)[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    assert run(spark, rows) == sorted(want)


def test_levels_and_negative_scores(spark, monkeypatch):
    for name, value in (("LEAST_PART", 8), ("PART", 8), ("PIVOTS", 3), ("GROUP", 4), ("BLOCK", 3), ("FIRST_ROWS", 6), ("WHOLE", 2)):
        monkeypatch.setattr(K, name, value)
    rows = vectors(260, 6, 7, copies=60)
    placed, nodes, depth = K.cells(K.integers(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "embedding", "vec_id", 256).withColumn("u", K.F.col("id")), 8)
    paths = {r["id"]: tuple(r["path"]) for r in placed.collect()}
    assert sorted(paths) == list(range(260)) and max(map(len, paths.values())) == depth > 1
    for n in nodes.collect():
        inside = [i for i, p in paths.items() if p[: len(n["path"])] == tuple(n["path"])]
        x = np.array([[math.floor(v * 256) for v in rows[i][1]] for i in inside])
        assert len(inside) == n["n"] and np.sqrt(((x - np.array(n["c"])) ** 2).sum(axis=1)).max() <= n["r"] + 1e-9
        assert n["leaf"] == (tuple(n["path"]) in set(paths.values()))
    assert run(spark, rows, 7, 5) == brute(rows, 7, 5)
    monkeypatch.setattr(K, "LEVELS", 2)
    assert run(spark, rows, 7, 5) == brute(rows, 7, 5)
    # all scores negative and large, with ties
    away = [(0, [-4000.0, -4000.0])] + [(i, [4000.0 + (i % 3), 4000.0]) for i in range(1, 60)]
    assert run(spark, away, 100, 5) == brute(away, 100, 5)


@pytest.mark.parametrize(("scale", "kind"), [(256, np.float32), (1 << 20, np.float64), (1 << 27, np.int64)])
def test_products_are_exact_in_every_type(scale, kind):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 48))
    x = np.floor(scale * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)
    x[700:1400] = x[0]  # ties
    q, ids = np.vstack([x[:3], -x[5:200:5]]), rng.permutation(3000)
    data, best = K.Cover(x), K.Best(len(q), 5)
    K.dual(K.Cover(q, K.GROUP), np.concatenate([ids[:3], np.arange(9000, 9000 + len(q) - 3)]), data, ids, best)
    assert K.exact(np.sqrt((q**2).sum(axis=1).max()) * data.most) is kind
    scores = q.astype(object) @ x.T.astype(object)
    for i in range(len(q)):
        want = sorted((-int(s), int(v)) for s, v in zip(scores[i], ids, strict=True) if i >= 3 or v != ids[i])[:5]
        assert sorted((-s, -v) for s, v in best.heaps[i]) == want


def test_time_without_pruning():
    """Where no bound helps (random directions), the search takes no more than a few times a plain product of integer matrices."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(20200, 64))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)
    q, data, best = K.Cover(x[:200]), K.Cover(x[200:]), K.Best(200, 5)
    start = time.process_time()
    scores = x[:200] @ x[200:].T
    plain = time.process_time() - start
    start = time.process_time()
    K.dual(q, np.arange(200), data, np.arange(200, 20200), best)
    took = time.process_time() - start
    assert [sorted(s for s, _ in h) for h in best.heaps] == np.sort(scores, axis=1)[:, -5:].tolist()
    assert took < 20 * plain
