import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import language, lattice, quality, tokens
from loomgraph.llm.common import fold

WORDS = {"en": "the and of house water green was with this that have from", "de": "der und die haus wasser das ist mit auch nicht wurde eine", "fr": "le et la maison eau vert est avec dans pour une sur"}


def text(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang].split()) + rng.choice(["", "", "s", "e"]) for _ in range(n))


# ---- quality ----


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        good = rng.random() < 0.6
        t = text(rng, "en", rng.choice([5, 40, 150]))
        if not good:
            t += " ".join(w + "%%%" for w in text(rng, "en", 30).split())
        out.append((i, t, int(good)))
    return out


def test_quality(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9000, None), (9001, ""), (9002, "word " * 300_000), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 2] + [(None, 1), (77777, 0), (1, None)], "doc_id long, quality int")
    learn = fold(F.col("doc_id"), 4) != 2
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, labels, learn).collect()}
    assert len(got) == len(rows) + 4 and all(0 <= s <= 1 for s in got.values())
    held = [(got[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(s >= 0.5) == y for s, y in held]) > 0.95
    again = {r["doc_id"]: r["score"] for r in quality.score(docs.repartition(3), labels, learn).collect()}
    assert all(abs(got[k] - again[k]) < 1e-5 for k in got)
    clash = quality.score(docs.selectExpr("*", "1 AS Score", "2 AS extra").limit(3), labels, learn)
    assert sorted(clash.columns) == ["doc_id", "extra", "score", "text"] and clash.count() == 3
    assert quality.score(docs.limit(0), labels.limit(0), learn).isEmpty()


def test_quality_chunks_cover_all():
    for n in (0, 1, 255, 256, 257, 449, 5000):
        data = np.arange(n) % 250 + 1
        c, k = quality.cut(data.astype(np.uint8), np.array([0, n]))
        assert k[0] == len(c) >= 1
        seen = set()
        for i in range(len(c)):
            at = np.arange(i * quality.HOP, i * quality.HOP + quality.CHUNK)
            ok = at < n
            assert (c[i][ok] == data[at[ok]]).all() and (c[i][~ok] == 0).all()
            seen.update(at[ok].tolist())
        assert seen == set(range(n))


def test_quality_gradients():
    rng = np.random.default_rng(0)
    net = quality.Network(np.random.default_rng(1))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    raw = rng.integers(1, 255, 900).astype(np.uint8)
    chunks, n = quality.cut(raw, np.array([0, 300, 900]))
    y, w = np.array([1.0, 0.0]), np.array([0.4, 0.6])
    _, g = net.gradients(chunks, n, y, w)
    for name in ("v", "vb", "w", "wb", "cb"):
        flat, grad = net.p[name].reshape(-1), np.asarray(g[name]).reshape(-1)
        k = int(np.abs(grad).argmax())
        old, eps = flat[k], 1e-3
        flat[k] = old + eps
        up, _ = net.gradients(chunks, n, y, w)
        flat[k] = old - eps
        down, _ = net.gradients(chunks, n, y, w)
        flat[k] = old
        assert abs((up - down) / (2 * eps) - grad[k]) < 0.02 * max(1e-2, abs(grad[k])), name


# ---- language ----


def test_language(spark):
    rng = random.Random(2)
    rows = [(i, text(rng, lang, rng.choice([4, 30, 200])), lang) for i in range(300) for lang in [rng.choice(list(WORDS))]]
    rows += [(1001, None, "en"), (1002, "", "en"), (1003, "12 !! 3", "en"), (1004, text(rng, "fr", 40_000), None), (1005, text(rng, "de", 50).upper(), None), (None, text(rng, "de", 50), None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    got = {r["doc_id"]: r for r in language.identify(docs, fold(F.col("doc_id"), 5) != 0).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got.values())
    held = [got[i]["lang_pred"] == lang for i, _, lang in rows if i is not None and i < 1000 and zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean(held) > 0.95
    assert [got[i]["lang_pred"] for i in (1001, 1002, 1003, 1004, 1005, None)] == ["und", "und", "und", "fr", "de", "de"]
    assert {r["lang_pred"] for r in language.identify(docs, F.lit(False)).collect()} == {"und"}
    assert language.identify(docs.limit(0), F.lit(True)).isEmpty()


def test_a_rare_language_leaves_the_others_alone(spark):
    rng = random.Random(3)
    rows = [(text(rng, lang, 120), lang) for _ in range(250) for lang in WORDS]
    rare = [("water haus maison zzyx", "xx"), (" ".join(f"qu{rng.randrange(10**6)}zz" for _ in range(600)), "yy")]
    before = language.sample(spark.createDataFrame(rows, "t string, l string"), "t", "l")
    after = language.sample(spark.createDataFrame(rows + rare, "t string, l string"), "t", "l")
    assert all(len(v) > 40_000 for v in before.values()) and {k: after[k] for k in before} == before
    held = [text(rng, lang, n) for n in (6, 30, 200) for _ in range(10) for lang in WORDS]
    one, two = language.Compressors(before), language.Compressors(after)
    assert [one.judge(language.letters(t))[0] for t in held] == [two.judge(language.letters(t))[0] for t in held]
    assert two.judge(language.letters(" ".join(f"qu{rng.randrange(10**6)}zz" for _ in range(90))))[0] == "yy"


def test_narrow_margins_are_rejected():
    same = {"a": b"one two three four five", "b": b"one two three four five"}
    lang, score, certain = language.Compressors(same).judge(b"one two three")
    assert lang == "a" and not certain and abs(score - 0.5) < 1e-9


# ---- lattice ----

PIECES = [b" ", b"a", b"b", b"ab", b" a", b" ab", b"ba", b"bab", "é".encode()] + [bytes([k]) for k in range(128, 256)] + [b"c"]


def all_segmentations(word, p):
    if not word:
        return 1.0
    return sum(p[x] * all_segmentations(word[len(x) :], p) for x in p if word.startswith(x))


def test_lattice_sums_all_segmentations():
    rng = np.random.default_rng(0)
    w = rng.random(len(PIECES))
    p = dict(zip(PIECES, w / w.sum()))
    net = lattice.Lattice(PIECES, np.log(w / w.sum()))
    words = [x.encode() for x in ["a", "ab", "abab", "babba", "é", "aéb", "c" * 3, "ab" * 300]]
    raw = np.frombuffer(b"".join(words), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(x) for x in words])])
    got = net.scores(raw, off)
    for x, s in zip(words[:-1], got):
        assert abs(s - math.log10(all_segmentations(b" " + x, p))) < 1e-9
    assert np.isfinite(got[-1])
    e = net.expected(raw[: off[3]], off[:4], np.array([1.0, 2.0, 1.0]))
    assert abs(sum(c * len(x) for c, x in zip(e, PIECES)) - (2 + 2 * 3 + 5)) < 1e-9  # expected pieces cover every byte


def brute_base(rows, learn):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    toks = [re.findall("[^\x20\x09-\x0d]+", (t or "").translate(low)) + [None] for _, t in rows]
    c = Counter(x for t, ok in zip(toks, learn) if ok for x in t)
    n, v = sum(c.values()), len(c)
    return [(len(t), sum(c[x] > 0 for x in t), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t)) for t in toks]


@pytest.mark.parametrize("head", [lattice.HEAD, 5])
def test_lm_scores(spark, head):
    rng = random.Random(4)
    rows = [(i, text(rng, "en", rng.choice([1, 20])) + rng.choice(["", " Żółć", f" rare{i} rare{i}"])) for i in range(60)] + [(900, None), (901, ""), (902, "THE the " * 3000), (903, "x" * 5000), (5, "the")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    learn = [zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows]
    got = sorted(tuple(r) for r in lattice.score(df, fold(F.col("doc_id"), 7) != 2, head=head).select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect())
    want = sorted((i, *x) for (i, _), x in zip(rows, brute_base(rows, learn)))
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert all(abs(g[4] - w[4]) < 1e-6 * max(1, abs(w[4])) for g, w in zip(got, want))
    assert all(math.isfinite(g[5]) and g[5] < 0 for g in got)
    by = {g[0]: g[5] for g in got}
    assert by[902] < by[901] and by[900] == by[901]


def test_lm_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = lattice.score(df, F.lit(False)).orderBy("doc_id").collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got] == [(3, 0, 0), (1, 0, 0)]
    assert lattice.score(df.limit(0), F.lit(True)).isEmpty()


# ---- tokens ----


def test_scan_stitches_blocks(spark, tmp_path):
    rng = np.random.default_rng(1)
    want = {}
    for k in range(3):
        docs = [rng.integers(0, 90, rng.integers(0, 40)) for _ in range(30)]
        flat = np.concatenate([np.append(d, 99) for d in docs] + ([np.array([1, 2, 3])] if k == 0 else []))
        flat.astype("<u2").tofile(tmp_path / f"f{k}.bin")
        want[f"f{k}.bin"] = [len(d) for d in docs] + ([3] if k == 0 else [])
    (tmp_path / "empty.bin").write_bytes(b"")
    for block in (1, 7, 64, 1 << 18):
        got = tokens.scan(spark, str(tmp_path), eod=99, block=block).orderBy("file", "doc").collect()
        for name, sizes in want.items():
            rows = [r for r in got if r["file"].endswith(name)]
            assert [r["n_tokens"] for r in rows] == sizes and [r["doc"] for r in rows] == list(range(len(sizes)))
            start = 0
            for r in rows:
                assert r["start"] == start
                start += r["n_tokens"] + 1
            assert [r["closed"] for r in rows] == [True] * 30 + [False] * (name == "f0.bin")
        assert not any(r["file"].endswith("empty.bin") for r in got)
    (tmp_path / "odd.bin").write_bytes(b"abc")
    with pytest.raises(Exception):
        tokens.scan(spark, str(tmp_path), eod=99).collect()


def test_token_counts_of_documents(spark, tmp_path, monkeypatch):
    import base64

    import tiktoken

    monkeypatch.setattr(tokens, "FILE_BYTES", 600)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokens.RANKS, "rb"))}
    tool = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", "hello  world\n", "é <|endoftext|> x", "PÄ Ä P\x00 \U0001f600", "word " * 5000] + [f"number {i} " * (i % 5) for i in range(80)]
    spark.createDataFrame([(i * 3, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.op7_separator_scan(spark, str(tmp_path)).collect()}
    assert got == {i * 3: len(tool.encode_ordinary(t or "")) for i, t in enumerate(texts)}


# ---- brute force ----


def test_network_by_plain_loops():
    """score() against a forward pass written out byte by byte."""
    rng = np.random.default_rng(3)
    net = quality.Network(rng)
    texts = [b"", b"a", rng.integers(1, 250, 700).astype(np.uint8).tobytes(), b"word " * 90]
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    for t in texts:
        feats, n = [], max(1, -(-(len(t) - (quality.CHUNK - quality.HOP)) // quality.HOP))
        for c in range(n):
            chunk = [t[i] if i < len(t) else 0 for i in range(c * quality.HOP, c * quality.HOP + quality.CHUNK)]
            pooled = []
            for f in range(quality.FILTERS):
                best = -math.inf
                for at in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE):
                    best = max(best, sum(float(p["emb"][chunk[at + j]] @ p["conv"][j * quality.DIM : (j + 1) * quality.DIM, f]) for j in range(quality.WIDTH)))
                pooled.append(max(0.0, best + p["cb"][f]))
            row = [*pooled, sum(x != 0 for x in chunk) / quality.CHUNK]
            feats.append([max(0.0, sum(r * p["w"][i, h] for i, r in enumerate(row)) + p["wb"][h]) for h in range(quality.HIDDEN)])
        z = sum(max(x[h] for x in feats) * p["v"][h] + sum(x[h] for x in feats) / n * p["v"][quality.HIDDEN + h] for h in range(quality.HIDDEN)) + p["vb"][0]
        got = net.score(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0]
        assert abs(got - 1 / (1 + math.exp(-z))) < 1e-4


def test_languages_by_a_plain_loop(spark):
    """identify() against a loop over texts, pieces and dictionaries with a compressor made anew each time."""
    import zstandard

    rng = random.Random(8)
    rows = [(i, text(rng, lang, rng.choice([3, 30, 500])), lang) for i, lang in enumerate(rng.choices(list(WORDS), k=150))] + [(900, None, "en"), (901, "12 34", "de"), (902, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learn = fold(F.col("doc_id"), 5) != 0
    dicts = language.sample(docs.where(learn), "text", "lang")
    sizes = {len(x) for x in dicts.values()}
    assert len(dicts) == 3 and min(sizes) >= language.LEAST_BYTES

    def compressed(lang, most, t):
        d = zstandard.ZstdCompressionDict(dicts[lang][-most:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=language.LEVEL)
        return sum(len(zstandard.ZstdCompressor(level=language.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(t[a : a + language.PIECE])) for a in range(0, len(t), language.PIECE))

    def judged(t):
        t = language.letters(t)
        if len(t) < language.PIECE // 8:
            t = (t + b" ") * max(1, min(8, language.PIECE // 8 // (len(t) + 1)))
        out = {}
        for lang in sorted(dicts, key=lambda k: (-len(dicts[k]), k)):  # richest first; a poorer one meets the best so far at its own length
            size = compressed(lang, len(dicts[lang]), t)
            richer = {k: v for k, v in out.items() if len(dicts[k]) > len(dicts[lang])}
            best = min(sorted(richer), key=richer.get, default=None)
            out[lang] = size * (out[best] / compressed(best, len(dicts[lang]), t) if best else 1.0)
        return min(sorted(out), key=out.get)

    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, learn).collect()}
    for i, t, _ in rows:
        assert got[i] == (judged(t) if t and re.search("[^\\W\\d_]", t) else "und")


def test_lattice_scores_end_to_end(spark):
    """score() and its fitted pieces against sums over all segmentations, document by document."""
    docs = [(i, t) for i, t in enumerate(["the cat the", "a cat sat", "The CAT", "dog", "", None, "satthe cat cat"])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    learn = F.col("doc_id") != 3
    got = {r["doc_id"]: r for r in lattice.score(df, learn).collect()}
    pieces = lattice.load_pieces()
    words = [(t or "").translate({c: c + 32 for c in range(65, 91)}).split() for _, t in docs]
    counts = Counter(w for i, ws in enumerate(words) if i != 3 for w in ws)
    weight = 1.0 / (np.arange(len(pieces)) + 50.0)
    p, end, number = weight / weight.sum() * 0.9, 0.1, {x: k for k, x in enumerate(pieces)}

    def ways(w):
        """Every segmentation as piece numbers."""
        if not w:
            yield []
        for n in range(1, len(w) + 1):
            if w[:n] in number:
                for rest in ways(w[n:]):
                    yield [number[w[:n]], *rest]

    every = {w: list(ways(b" " + w.encode())) for w in set(sum(words, []))}
    for _ in range(lattice.ROUNDS):
        total = np.full(len(pieces), lattice.PRIOR)
        for w, c in counts.items():
            odds = [math.prod(p[k] for k in x) for x in every[w]]
            for x, o in zip(every[w], odds, strict=True):
                np.add.at(total, x, c * o / sum(odds))
        ends = len(docs) - 1
        everything = total.sum() + ends + lattice.PRIOR
        p, end = total / everything, (ends + lattice.PRIOR) / everything
    n, v = sum(counts.values()) + len(docs) - 1, len(counts) + 1
    for (i, _), ws in zip(docs, words, strict=True):
        want = math.log10(end) + sum(math.log10(sum(math.prod(p[k] for k in x) for x in every[w])) for w in ws)
        assert abs(got[i]["score"] - want) < 1e-6
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws) + math.log10((len(docs) - 1 + 1) / (n + v + 1))
        assert abs(got[i]["base_score"] - base) < 1e-9 and got[i]["n_tokens"] == len(ws) + 1 and got[i]["train_tokens"] == n


def test_long_words_go_the_other_way(monkeypatch):
    """Words read in stretches get the scores and expectations of those read together; a megabyte takes seconds."""
    import time

    pieces = lattice.load_pieces()
    log_p = np.log(np.random.default_rng(1).dirichlet(np.ones(len(pieces))))
    rng = random.Random(2)
    words = [bytes(rng.choice(b"theandofing\xc3\xa9xyz") for _ in range(n)) for n in (1, 3, 9, 40, 333, 2000)]
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    raw, counts = np.frombuffer(b"".join(words), np.uint8), np.arange(1.0, len(words) + 1)
    lat = lattice.Lattice(pieces, log_p)
    monkeypatch.setattr(lattice, "LONG", 10**9)
    a, b = lat.scores(raw, offsets), lat.expected(raw, offsets, counts)
    monkeypatch.setattr(lattice, "LONG", 5)
    monkeypatch.setattr(lattice, "STRETCH", 37)
    assert np.allclose(a, lat.scores(raw, offsets), rtol=1e-9) and np.allclose(b, lat.expected(raw, offsets, counts), rtol=1e-7, atol=1e-9)
    monkeypatch.setattr(lattice, "STRETCH", 1 << 16)
    big = np.frombuffer(b"theandofing" * 100_000, np.uint8)
    start = time.time()
    assert lat.scores(big, np.array([0, len(big)]))[0] < 0 and time.time() - start < 60
