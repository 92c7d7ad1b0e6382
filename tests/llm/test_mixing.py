from collections import Counter

from pyspark.sql import functions as F

from loomgraph.llm import mixing


def check(rows, shares_of=None, block=1):
    """The schedule's own law: every block in its window, slots used once, less than one block of deviation up to the horizon."""
    slots = [(r["slot"], r["source"]) for r in rows if r["slot"] is not None]
    for r in rows:
        if r["slot"] is not None:
            assert r["release"] <= r["slot"] < r["deadline"]
    firsts = {(r["slot"]): r["source"] for r in rows if r["slot"] is not None}
    assert len({(s, x) for s, x in slots}) == len(firsts)
    assert len({r["position"] for r in rows if r["position"] is not None}) == len(slots)
    return firsts


def test_pfair_deviation():
    for weights in ({"a": 1, "b": 1}, {"a": 0.7, "b": 0.2, "c": 0.1}, {"a": 0.37, "b": 0.33, "c": 0.3}, {f"s{i}": 1 + i % 5 for i in range(30)}):
        k = mixing.quantised(weights, 1000)
        assert sum(k.values()) == 1000
        at = mixing.edf(k)
        order = {t: s for s, ts in at.items() for t in ts}
        assert sorted(order) == list(range(1000))
        seen = Counter()
        for t in range(1000):
            seen[order[t]] += 1
            for s in k:
                assert abs(seen[s] - k[s] * (t + 1) / 1000) < 1


def test_mix(spark):
    rows = [(i, "hot") for i in range(300)] + [(1000 + i, "b") for i in range(60)] + [(2000 + i, None) for i in range(40)] + [(3000, "unweighted")]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, source string, block string, Slot int")
    got = mixing.mix_sources(df, {"hot": 0.5, "b": 0.3, None: 0.2, "absent": 4.0}, block_rows=2).collect()
    assert len(got) == len(rows) and "Slot" not in got[0].asDict()
    firsts = check(got)
    horizon = next(t for t in range(10**6) if t not in firsts)
    assert all(r["selected"] == (r["slot"] is not None and r["slot"] < horizon) for r in got)
    assert all(r["slot"] is None for r in got if r["source"] == "unweighted")
    seen, w = Counter(), {"hot": 0.5, "b": 0.3, None: 0.2}
    for t in range(horizon):
        seen[firsts[t]] += 1
        assert all(abs(seen[s] - w[s] * (t + 1)) < 1.001 for s in w)


def test_defaults_nulls_repeats_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, source string")
    assert mixing.mix_sources(empty).isEmpty()
    df = spark.createDataFrame([(None, None)] * 20 + [(1, "a")] * 30 + [(i, "b") for i in range(10)], "doc_id long, source string")
    got = mixing.mix_sources(df).collect()
    assert len(got) == 60 and all(r["slot"] is not None for r in got)
    check(got)
    assert any(r["selected"] for r in got)


def test_query_is_native(spark, tmp_path):
    spark.createDataFrame([(i, f"s{i % 3}", "t") for i in range(200)], "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = mixing.op3_pfair_mix(spark, str(tmp_path))
    assert df.count() == 200
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()


def test_unrounded_targets(spark):
    rows = {"hot": 6000, **{f"s{i}": 600 for i in range(19)}, "rare": 3}
    weights = {s: n**0.9 for s, n in rows.items()}
    df = spark.createDataFrame([(i, s) for s, n in rows.items() for i in range(n)], "doc_id long, source string")
    got = mixing.mix_sources(df, block_rows=1).collect()
    firsts = check(got)
    assert len(firsts) == len(got)
    horizon, total = sum(r["selected"] for r in got), sum(weights.values())
    assert horizon > 8000
    seen = Counter()
    for t in range(horizon):
        seen[firsts[t]] += 1
        assert all(abs(seen[s] - w / total * (t + 1)) < 1 for s, w in weights.items())


def test_exhausted_sources_leave():
    weights, blocks = {"a": 0.6, "b": 0.3, "c": 0.00007, "d": 1e-9}, {"a": 500, "b": 2000, "c": 1, "d": 40}
    seen, left = Counter(), dict(blocks)
    order = list(mixing.Schedule(weights, blocks))
    assert [x[2] for x in order] == list(range(2541))
    fluid = dict.fromkeys(weights, 0.0)
    for s, i, *_ in order:
        assert i == seen[s]
        seen[s] += 1
        need = 1.0
        while need > 1e-9 and (on := [x for x in weights if left[x] - fluid[x] > 1e-9]):
            rate = sum(weights[x] for x in on)
            step = min(need, min((left[x] - fluid[x]) * rate / weights[x] for x in on))
            for x in on:
                fluid[x] += step * weights[x] / rate
            need -= step
        assert all(abs(seen[x] - fluid[x]) < 1 + 1e-6 for x in weights)
    assert dict(seen) == blocks


def test_schedule_in_pieces(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"s{i % 7 % 3}") for i in range(900)], "doc_id long, source string")
    whole = sorted(map(str, mixing.mix_sources(df).collect()))
    monkeypatch.setattr(mixing, "RUN", 5)
    monkeypatch.setattr(mixing, "PIECE", 4)
    assert sorted(map(str, mixing.mix_sources(df).collect())) == whole


def simulated(rows, power):
    """(source, block, slot) of every block, slot by slot, from a fluid schedule that is run step by step in fractions."""
    from fractions import Fraction

    blocks = {s: -(-n // 8) for s, n in rows.items()}
    weight = {s: Fraction(n**power) for s, n in rows.items()}
    times, have, now = {s: [Fraction(0)] for s in rows}, {s: Fraction(0) for s in rows}, Fraction(0)
    while any(have[s] < blocks[s] for s in rows):  # to the next moment at which some source's fluid share is a whole number of blocks
        on = [s for s in rows if have[s] < blocks[s]]
        total = sum(weight[s] for s in on)
        step = min((int(have[s]) + 1 - have[s]) * total / weight[s] for s in on)
        now += step
        for s in on:
            have[s] += step * weight[s] / total
            if have[s].denominator == 1 and len(times[s]) <= have[s]:
                times[s].append(now)
    windows = {(s, i): (times[s][i].__floor__(), times[s][i + 1].__ceil__()) for s in rows for i in range(blocks[s])}
    done, out = {s: 0 for s in rows}, []
    for t in range(sum(blocks.values())):
        s = min((s for s in rows if done[s] < blocks[s] and windows[s, done[s]][0] <= t), key=lambda s: (windows[s, done[s]][1], s))
        out.append((s, done[s], t))
        done[s] += 1
    return out


def test_schedule_row_by_row(spark):
    rows = {"a": 211, "b": 97, "c": 40, "d": 3}
    docs = [(k * 1000 + i, s) for k, (s, n) in enumerate(rows.items()) for i in range(n)]
    got = mixing.mix_sources(spark.createDataFrame(docs, "doc_id long, source string")).collect()
    want = simulated({f"={s}": n for s, n in rows.items()}, mixing.TEMPER)
    place = sorted({(r["slot"], r["source"], r["block"]) for r in got})
    assert [(f"={s}", i) for _, s, i in place] == [(s, i) for s, i, _ in want]
    inside = [(t, s) for t, s, _ in place]
    horizon = next((t for t in range(len(inside)) if inside[t][0] != t), len(inside))
    assert all(t == w[2] + (t > horizon) for (t, _), w in zip(inside, want, strict=True))
    size = {}
    for r in got:
        size.setdefault((r["source"], r["block"]), set()).add(r["position"] - 8 * r["slot"])
    assert all(x == set(range(len(x))) for x in size.values()) and sum(map(len, size.values())) == len(docs)


def test_clashing_names_and_ties(spark):
    df = spark.createDataFrame([(None, "a", f"t{i}", i) for i in range(400)], "doc_id long, source string, __s string, __b int")
    got = mixing.mix_sources(df, ties=(F.col("__s"),)).collect()
    assert sorted(r["__s"] for r in got) == sorted(f"t{i}" for i in range(400)) and {r["__b"] for r in got} == set(range(400))
    assert sorted(r["position"] for r in got) == list(range(400))
