import random
import re

import pytest

from loomgraph.llm import common
from loomgraph.llm import jaccard as J
from loomgraph.llm.components import components

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, gram, num, den):
    sets = []
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOW))
        sets.append({tuple(w[i : i + gram]) for i in range(len(w) - gram + 1)} if len(w) >= gram else ({tuple(w)} if w else set()))
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if o and den * o >= num * (len(sets[i]) + len(sets[j]) - o):
                top[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def family(seed, n=80):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["Zoë", "É", "the", "THE"]
    text = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passage = text(40)
    base = [text(rng.choice([3, 4, 8, 30, 120])) for _ in range(8)]
    out = []
    for i in range(n):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        t = "  ".join(w)
        out.append((i, t if rng.random() < 0.8 else passage + "\n" + text(rng.choice([2, 10, 60]))))
    return out


def result(spark, rows, gram, num, den):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = J.classes(df, gram=gram, num=num, den=den).collect()
    return sorted(((None if r["row_key"].startswith("\0") else int(r["row_key"]), r["n_shingles"], r["component_id"]) for r in got), key=str)


@pytest.mark.parametrize("seed,gram,num", [(1, 4, 85), (2, 5, 80)])
def test_against_brute_force(spark, seed, gram, num):
    rows = family(seed)
    assert result(spark, rows, gram, num, 100) == brute(rows, gram, num, 100)


@pytest.mark.parametrize("lead", [True, False])
def test_hot_lists_are_cut(spark, monkeypatch, lead):
    monkeypatch.setattr(J, "LIST_PART", 3)
    monkeypatch.setattr(J, "GROUP_SHINGLES", 400)
    monkeypatch.setattr(J, "GROUP_POSTINGS", 30)
    monkeypatch.setattr(J, "BIG", 3)
    monkeypatch.setattr(J, "LONG_LIST", 10**9)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    rows = family(3, 60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((int(r["row_key"]), r["n_shingles"], r["component_id"]) for r in J.classes(df, gram=4, num=85, den=100, lead=lead).collect()), key=str)
    assert got == brute(rows, 4, 85, 100)


def all_links(rows, gram, num, den):
    """Every link between different sets, by an index of all shingles."""
    sets = {}
    for d, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOW))
        if w:
            s = frozenset(tuple(w[i : i + gram]) for i in range(len(w) - gram + 1)) if len(w) >= gram else frozenset({tuple(w)})
            sets.setdefault(s, []).append(d)
    every, index, shared = list(sets), {}, {}
    for i, s in enumerate(every):
        for g in s:
            for j in index.setdefault(g, []):
                shared[j, i] = shared.get((j, i), 0) + 1
            index[g].append(i)
    good = [(i, j) for (i, j), o in shared.items() if den * o >= num * (len(every[i]) + len(every[j]) - o)]
    n = {d: len(x) - 1 for x in sets.values() for d in x}
    for i, j in good:
        for x, y in ((i, j), (j, i)):
            for d in sets[every[x]]:
                n[d] += len(sets[every[y]])
    return {frozenset((min(sets[every[i]]), min(sets[every[j]]))) for i, j in good}, n


@pytest.mark.parametrize("small", [True, False])
def test_search_alone_finds_all_links(spark, monkeypatch, small):
    """Recall of the T-occurrence search by itself: 1, and no link too many; with the leaders the components are the same."""
    if small:
        rows = family(7, 120)
        monkeypatch.setattr(J, "GROUP_POSTINGS", 60)
    else:
        rng = random.Random(9)
        vocab, rows = [f"w{i}" for i in range(3000)], []
        passage = " ".join(rng.choice(vocab) for _ in range(60))
        for f in range(260):
            base = [rng.choice(vocab) for _ in range(rng.choice([12, 60, 150, 400]))]
            for _ in range(rng.choice([1, 1, 2, 3, 40])):
                w = list(base)
                for _ in range(int(len(w) * rng.choice([0, 0.005, 0.01, 0.02]))):
                    w[rng.randrange(len(w))] = rng.choice(vocab)
                rows.append((len(rows), " ".join(w) + (" " + passage if f % 3 == 0 else "")))
        assert len(rows) > 1500
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found, members = J.links(df, gram=4, num=85, den=100)
    name = {r["node"]: int(r["row_key"]) for r in sorted(members.collect(), key=lambda r: -int(r["row_key"])) if r["node"] is not None}
    want, n = all_links(rows, 4, 85, 100)
    pairs = [(r["a"], r["b"]) for r in found.collect()]
    assert len(pairs) == len(set(pairs)) and {frozenset((name[a], name[b])) for a, b in pairs} == want and len(want) > (40 if small else 2000)
    assert {int(r["row_key"]): r["n_links"] for r in members.collect()} == {d: n.get(d, 0) for d, _ in rows}
    both = [sorted((int(r["row_key"]), r["component_id"]) for r in J.classes(df, gram=4, num=85, den=100, lead=x).collect()) for x in (True, False)]
    assert both[0] == both[1]


def test_edges(spark):
    rows = [(5, None), (6, ""), (7, " \n\t"), (8, "a b"), (3, "A  B"), (9, "a b c"), (None, "a b"), (None, "x y z w v"), (4, "q " * 3000), (2, "Q " * 2500), (8, "a b"), (11, "b a")]
    got = result(spark, rows, 4, 85, 100)
    assert got == brute(rows, 4, 85, 100)
    assert (8, 1, 3) in got and (5, 0, 5) in got and (4, 1, 2) in got
    assert J.classes(spark.createDataFrame([], "doc_id long, text string")).isEmpty()


def test_bound_and_probe():
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(300):
        base = rng.choice(400, 60, replace=False)
        a, b = (np.unique(np.concatenate([base[rng.random(60) > e], rng.choice(400, 5)])) for e in rng.random(2) * 0.2)
        o = len(np.intersect1d(a, b))
        linked = 100 * o >= 85 * (len(a) + len(b) - o)
        lists = []
        for x in (a, b):
            t = -(-85 * len(x) // 100)
            lists.append(x[: len(x) - t + min(J.MEET, t)])
        ptr = np.array([0, len(lists[0]), len(lists[0]) + len(lists[1])])
        ids = np.concatenate(lists)
        met = J.occurring([[0, 1] if v in lists[1] else [0] for v in lists[0]], J.MEET)
        good = J.survivors(np.array([0]), np.array([1]), ids, ptr, np.array([len(a), len(b)]), np.ones(400, bool), 85, 100)
        assert (good[0] and 1 in met) or not linked
        assert J.Lists([a.astype(np.uint64), b.astype(np.uint64)]).reach(0, 1, 85, 100) == J.Lists([b.astype(np.uint64), a.astype(np.uint64)]).reach(0, 1, 85, 100, 7) == linked


def test_occurring():
    assert J.occurring([[1, 2, 5], [2, 5], [5]], 2) == [2, 5] and J.occurring([[1, 2]], 1) == [1, 2] and J.occurring([[1]], 2) == []


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)] + [(None, 3), (7, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    top = {}
    for a, b in edges:
        if a is not None and a != b:
            top.setdefault(a, a), top.setdefault(b, b)
    change = True
    while change:
        change = False
        for a, b in edges:
            if a is not None and a != b and top[a] != top[b]:
                top[a] = top[b] = min(top[a], top[b])
                change = True
    assert got == top
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_sieve(spark, monkeypatch):
    df = spark.range(0, 3000).selectExpr("CASE WHEN id % 10 = 9 THEN NULL ELSE concat('k', id) END AS key", "id")
    want = spark.createDataFrame([(f"k{i}",) for i in range(0, 600, 7)] + [("absent",), (None,)], "key string")
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    for bits in (64, 1 << 10, 1 << 23):
        monkeypatch.setattr(common, "SIEVE_BITS", bits)
        rows = common.marked(df, "key", want).collect()
        assert len(rows) == 3000 and all(r["__maybe"] for r in rows if r["id"] < 600 and r["id"] % 7 == 0 and r["key"]) and not any(r["__maybe"] for r in rows if r["key"] is None)
        kept = common.sifted(df, "key", want).join(want, "key")
        assert {r["id"] for r in kept.collect()} == {i for i in range(0, 600, 7) if i % 10 != 9}
    assert sum(r["__maybe"] for r in rows) < 100
