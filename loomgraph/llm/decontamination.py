"""Benchmark decontamination by winnowing.

Benchmark and documents keep, for each window of WINDOW words, the smallest hash of its GRAM-word runs. A span of WINDOW words that both
share has the same smallest hash on both sides, so none is missed. Where a document's fingerprint is one of the benchmark's, the hit is
extended to whole windows: their hash, and then their words, must equal those of an item's window. Items shorter than a window are one
window of their own, looked up by every run of that many words. A window of the document is looked up once however many items share it, so
frequent passages cost no more than others.

Fingerprints of a benchmark of at most BLOCK_BYTES of text are joined by a broadcast of its index, past which documents stream without a shuffle. A
larger benchmark stays distributed: fingerprints of both sides are joined by a shuffle, documents leaving at home those that a bitmap of at most
SIEVE_MOST bits shows to be none of the benchmark's; then the windows of the texts that matched are joined by their words. Texts are told by a
digest there, so copies are compared once, and nothing is gathered that grows with the benchmark or the documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import ALNUM, Staged, Words, _C, chunks, fits, lean, marked, mix, sifted, table

WINDOW, GRAM, BLOCK_BYTES = 10, 5, 16 << 20
#: Bits of the bitmap of a larger benchmark's fingerprints: at most, and for each fingerprint.
SIEVE_MOST, SIEVE_EACH = 1 << 27, 32
ADDED = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("n_items", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("contaminated", T.BooleanType()),
])


def minima(grams: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each run of so many grams."""
    m = len(grams) - width + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = grams[:m].copy()
    for k in range(1, width):
        np.minimum(out, grams[k : k + m], out=out)
    return out


def member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """For each value its place in the sorted array, or -1."""
    if not len(among) or not len(values):
        return np.full(len(values), -1)
    k = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return np.where(among[k] == values, k, -1)


class Index:
    """Fingerprints and windows of one block of the benchmark. Items of equal id count as one; an item without an id counts but has no name."""

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram = window, gram
        self.names = list(dict.fromkeys(name for name, _ in items))
        number = {name: k for k, name in enumerate(self.names)}
        owner = np.array([number[name] for name, _ in items], np.int64)
        raw = [text.encode() for _, text in items]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        words = Words(np.frombuffer(b"".join(raw), np.uint8), offsets, ALNUM)
        count = np.diff(words.first)
        self.lengths: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]] = {}
        for n in sorted({min(int(c), window) for c in count if c}):
            of = np.flatnonzero(count >= window if n == window else count == n)
            at = np.concatenate([np.arange(words.first[i], words.first[i + 1] - n + 1) for i in of])
            who = np.repeat(owner[of], count[of] - n + 1)
            h = words.grams(n)[at]
            order = np.lexsort((who, h))
            h, who, at = h[order], who[order], at[order]
            keys, first = np.unique(h, return_index=True)
            said = [b" ".join(words.word(j) for j in range(at[f], at[f] + n)) for f in first]
            self.lengths[n] = (keys, np.append(first, len(h)), who, said)
            if n == window:
                self.fingerprints = np.unique(minima(words.grams(gram), window - gram + 1)[at])
                # at was reordered, but the minima are a set

    def scan(self, words: Words) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """Which words are hit, and (document, items) of each document with hits."""
        n_words = len(words.hash)
        delta = np.zeros(n_words + 1, np.int64)
        doc = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
        found: dict[int, set[int]] = {}
        for n, (keys, first, who, said) in self.lengths.items():
            m = n_words - n + 1
            if m <= 0:
                continue
            inside = doc[:m] == doc[n - 1 :]
            if n == self.window:
                low = minima(words.grams(self.gram), n - self.gram + 1)
                changes = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))  # each fingerprint once, however many windows keep it
                hit = np.repeat(member(low[changes], self.fingerprints) >= 0, np.diff(np.append(changes, m)))
                at = np.flatnonzero(hit & inside)
            else:
                at = np.flatnonzero(inside)
            if not len(at):
                continue
            if n == self.window:
                h = np.full(len(at), n, np.uint64)
                h = words.grams(n)[at] if len(at) * n > m else words_at(words, at, n)
            else:
                h = words.grams(n)[at]
            key = member(h, keys)
            for j, k in zip(at[key >= 0].tolist(), key[key >= 0].tolist(), strict=True):
                if b" ".join(words.word(x) for x in range(j, j + n)) == said[k]:
                    delta[j] += 1
                    delta[j + n] -= 1
                    found.setdefault(int(doc[j]), set()).update(who[first[k] : first[k + 1]].tolist())
        return np.cumsum(delta[:-1]) > 0, [(d, np.array(sorted(x))) for d, x in found.items()]


def words_at(words: Words, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words at the given places only."""
    out = np.full(len(at), n, np.uint64)
    for k in range(n):
        out = out * _C + words.hash[at + k]
    return mix(out)


def decontaminate(docs: DataFrame, bench: DataFrame, text: str = "text", item: str = "item_id", bench_text: str = "text", keep: list[str] | None = None, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs (the columns of keep, or all) with n_words, hit_spans (words [start, end)), n_items, items (sorted as strings) and contaminated.

    Null and empty texts have no words and no hits; so has everything against an empty benchmark. Repeated rows are judged alike. Columns of
    the new names are replaced. Items that repeat an id count as one; all items without an id count as one that has no name.
    """
    added = {f.name for f in ADDED}
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in added]
    items = bench.select(F.col(f"`{item}`").cast("string").alias("i"), F.col(f"`{bench_text}`").alias("t")).where("t IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("t") + F.coalesce(F.octet_length("i"), F.lit(0)) + 16)).first()[0] or 0
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(kept)], *([] if text in kept else [F.col(f"`{text}`").alias("t")]))
    t = f"c{kept.index(text)}" if text in kept else "t"  # a text that is kept goes to Python once
    judged = (by_broadcast if size <= BLOCK_BYTES else by_join)(rows, t, items, window, gram)
    return judged.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(kept)], *[f.name for f in ADDED])


def by_broadcast(rows: DataFrame, t: str, items: DataFrame, window: int, gram: int) -> DataFrame:
    """rows (their texts in column t, which goes if it is named so) with the added columns; for items (i, t) of at most BLOCK_BYTES."""
    shared = rows.sparkSession.sparkContext.broadcast(Index([(r["i"], r["t"]) for r in items.collect()], window, gram))
    others = [c for c in rows.columns if c != "t"]

    def judged(batches):
        index = shared.value
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(t)):
                words = Words(data, offsets, ALNUM)
                hit, found = index.scan(words)
                out = [(int(c), [], 0, [], False) for c in np.diff(words.first)]
                for d, who in found:
                    lo, hi = words.first[d], words.first[d + 1]
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[lo:hi].astype(np.int8), [0]])))
                    names = [index.names[i] for i in who]
                    out[d] = (out[d][0], edge.reshape(-1, 2).tolist(), len(names), sorted(x for x in names if x is not None), True)
                cols = list(zip(*out, strict=True))
                spans = pa.array([[{"start": s, "end": e} for s, e in x] for x in cols[1]], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                arrays = [batch.column(n).slice(a, b - a) for n in others]
                arrays += [pa.array(cols[0], pa.int64()), spans, pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.list_(pa.string())), pa.array(cols[4], pa.bool_())]
                yield pa.RecordBatch.from_arrays(arrays, names=others + [f.name for f in ADDED])

    return rows.mapInArrow(lean(judged), T.StructType([f for f in rows.schema.fields if f.name != "t"] + ADDED.fields))


def runs_of(words: Words, n: int, gram: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the runs of n words inside one document, their documents and keys: a whole window's fingerprint, or a shorter run's own hash."""
    doc = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    m = max(len(words.hash) - n + 1, 0)
    at = np.flatnonzero(doc[:m] == doc[n - 1 :]) if m else np.zeros(0, np.int64)
    keys = minima(words.grams(gram), window - gram + 1) if n == window else words.grams(n)
    return at, doc[at], keys[at]


def windows_of(items: DataFrame, window: int, gram: int) -> DataFrame:
    """n, key, said, i: the windows of items, with their words as said; an item of fewer words is one window of its own."""

    def cut(batches):
        for batch in batches:
            for a, _, data, offsets in chunks(batch.column("t")):
                words = Words(data, offsets, ALNUM)
                count = np.diff(words.first)
                names = batch.column("i")
                for n in sorted({min(int(c), window) for c in count if c}):
                    at, doc, keys = runs_of(words, n, gram, window)
                    ours = count[doc] >= window if n == window else count[doc] == n
                    for lo in range(0, int(ours.sum()), 1 << 16):
                        j, d, k = (x[ours][lo : lo + (1 << 16)] for x in (at, doc, keys))
                        said = [b" ".join(words.word(x) for x in range(s, s + n)) for s in j.tolist()]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), n, np.int32)), pa.array(k.view(np.int64)), pa.array(said, pa.binary()), names.take(pa.array(a + d))], names=["n", "key", "said", "i"])

    return items.select("i", "t").mapInArrow(cut, "n int, key long, said binary, i string").distinct()


def bitmap(keys: DataFrame, count: int) -> np.ndarray:
    """A power of two of bits, of them set those of the keys; SIEVE_MOST bits (16 MiB) at most, so bounded whatever the keys."""
    bits = 1 << 16
    while bits < min(count * SIEVE_EACH, SIEVE_MOST):
        bits *= 2
    words = keys.selectExpr(f"key & {bits - 1}L AS spot").selectExpr("cast(spot div 8 AS int) AS w", "shiftleft(1, cast(spot % 8 AS int)) AS b").groupBy("w").agg(F.bit_or("b").alias("b"))
    out = np.zeros(bits >> 3, np.uint8)
    found = words.toArrow()
    out[found["w"].to_numpy()] = found["b"].to_numpy().astype(np.uint8)
    return out


def by_join(rows: DataFrame, t: str, items: DataFrame, window: int, gram: int) -> DataFrame:
    """As by_broadcast(), for items of any size. Texts are told by a digest."""
    windows = Staged(windows_of(items, window, gram), "windows").df
    keys = Staged(windows.select("n", "key").distinct(), "fingerprints").df
    lengths = sorted(r["n"] for r in keys.select("n").distinct().collect())  # window of them at most
    sieve = rows.sparkSession.sparkContext.broadcast(bitmap(keys, keys.count()))
    others = [c for c in rows.columns if c != "t"]
    rows = rows.withColumn("d", F.unhex(F.md5(F.coalesce(t, F.lit("")).cast("binary"))))
    texts = rows.select("d", F.col(t).alias("t"))

    def printed(batches):
        """n_words of each row and its fingerprints that pass the sieve."""
        bits = sieve.value
        mask = np.uint64(len(bits) * 8 - 1)
        for batch in batches:
            digests = batch.column("d")
            for a, _, data, offsets in chunks(batch.column("t")):
                words = Words(data, offsets, ALNUM)
                for n in lengths:
                    _, doc, key = runs_of(words, n, gram, window)
                    at = key & mask
                    seen = (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
                    pairs = np.unique(np.stack([doc[seen].astype(np.uint64), key[seen]]), axis=1)
                    if pairs.shape[1]:
                        of = digests.take(pa.array(a + pairs[0].astype(np.int64)))
                        yield pa.RecordBatch.from_arrays([of, pa.array(np.full(len(of), n, np.int32)), pa.array(pairs[1].view(np.int64))], names=["d", "n", "key"])

    found = texts.mapInArrow(lean(printed), "d binary, n int, key long").distinct().join(keys, ["n", "key"], "left_semi")
    wanted = Staged(found.groupBy("d").agg(F.collect_list(F.struct("n", "key")).alias("wanted")), "matches").df
    texts = sifted(texts, "d", wanted.select("d")).join(wanted.select("d"), "d", "left_semi").groupBy("d").agg(F.any_value("t").alias("t"))

    def extended(batches):
        """The windows of a text whose fingerprints matched, with their words."""
        for batch in batches:
            for i in range(batch.num_rows):  # one text at a time
                row = {c: batch.column(c)[i].as_py() for c in ("d", "t", "wanted")}
                raw = np.frombuffer(row["t"].encode(), np.uint8)
                words = Words(raw, np.array([0, len(raw)]), ALNUM)
                for n in lengths:
                    at, _, key = runs_of(words, n, gram, window)
                    want = np.array([w["key"] for w in row["wanted"] if w["n"] == n], np.int64)
                    at = at[np.isin(key.view(np.int64), want)]
                    for lo in range(0, len(at), 1 << 16):
                        part = at[lo : lo + (1 << 16)].tolist()
                        said = [b" ".join(words.word(x) for x in range(j, j + n)) for j in part]
                        yield pa.RecordBatch.from_arrays([pa.array([row["d"]] * len(part), pa.binary()), pa.array(part, pa.int64()), pa.array([n] * len(part), pa.int32()), pa.array(said, pa.binary())], names=["d", "j", "n", "said"])

    runs = Staged(texts.join(wanted, "d").mapInArrow(lean(extended), "d binary, j long, n int, said binary"), "runs").df
    hits = runs.join(windows.select("n", "said").distinct(), ["n", "said"], "left_semi").groupBy("d").agg(F.collect_list(F.struct("j", (F.col("j") + F.col("n")).alias("to"))).alias("at"))
    who = runs.select("d", "n", "said").distinct().join(windows.select("n", "said", "i").distinct(), ["n", "said"]).groupBy("d").agg(F.array_sort(F.collect_set("i")).alias("items"), F.max(F.col("i").isNull().cast("long")).alias("nameless"))

    def merged(batches):
        """Spans of hit words from the windows of a text; of these, copies of a place count once."""
        for batch in batches:
            spans = []
            for at in batch.column("at"):
                pairs = sorted((x["j"], x["to"]) for x in at.as_py())
                out: list[dict] = []
                for s, e in pairs:
                    if out and s <= out[-1]["end"]:
                        out[-1]["end"] = max(out[-1]["end"], e)
                    else:
                        out.append({"start": s, "end": e})
                spans.append(out)
            yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["d", "hit_spans"])

    hits = hits.mapInArrow(merged, T.StructType([T.StructField("d", T.BinaryType()), ADDED["hit_spans"]]))
    judged = Staged(hits.join(who, "d").select("d", "hit_spans", (F.size("items") + F.col("nameless")).cast("long").alias("n_items"), "items"), "judged").df

    def counted(batches):
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(t)):
                n = np.diff(Words(data, offsets, ALNUM).first)
                names = [*others, "d"]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(a, b - a) for c in names], pa.array(n.astype(np.int64))], names=[*names, "n_words"])

    all_rows = rows.mapInArrow(lean(counted), T.StructType([f for f in rows.schema.fields if f.name != "t"] + [ADDED["n_words"]]))
    if fits(judged.select("d")):
        out = all_rows.join(F.broadcast(judged), "d", "left")
    else:  # only rows that may be hit are shuffled
        all_rows = marked(all_rows, "d", judged.select("d"), "maybe")
        out = all_rows.where("maybe").join(judged, "d", "left").unionByName(all_rows.where("NOT maybe"), allowMissingColumns=True)
    return out.select(
        *others, "n_words", F.coalesce("hit_spans", F.array().cast(ADDED["hit_spans"].dataType)).alias("hit_spans"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("n_items").isNotNull().alias("contaminated"),
    )


def digest(marked: DataFrame) -> DataFrame:
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda x, s: x + s["end"] - s["start"])
    return marked.select("doc_id", "n_words", n_hit.alias("n_hit"), "n_items", F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op4_winnow_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Hits of all documents against the whole benchmark; for null and empty texts, repeated rows and an empty benchmark see decontaminate()."""
    return digest(decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep=["doc_id"]))


_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP4_SQL = f"""
WITH b AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[j : j + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS j FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
d AS (SELECT doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
runs AS (
  SELECT doc_id, n, j, array_to_string(w[j : j + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS j FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT DISTINCT r.doc_id, r.n, r.j, win.item_id FROM runs r JOIN win ON r.n = win.n AND r.g = win.g),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + n)) AS k FROM (SELECT DISTINCT doc_id, n, j FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(words.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items.s, '')) AS items_sha256, coalesce(words.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
