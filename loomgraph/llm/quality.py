"""Quality classifier: a byte-level convolutional network in numpy.

A document's bytes are cut into overlapping chunks that cover all of it. Bytes have learned embeddings, learned filters run over each chunk and
are max-pooled; a hidden layer turns a chunk's pooled filters into features, whose maximum and mean over all chunks give one probability.

Training takes a bounded sample: at most SAMPLE labelled documents of each class, those of the smallest hashes among documents of at most
SAMPLE_BYTES. Scoring reads every whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import buffers, fold, lean, table

#: Bytes of a chunk and from one chunk to the next; width, stride and number of filters; size of embeddings and of the hidden layer.
CHUNK, HOP, WIDTH, STRIDE, FILTERS, DIM, HIDDEN = 256, 192, 8, 2, 32, 8, 16
#: Most labelled documents of a class and most bytes of one; least passes and steps, documents of a step, seed; least score to be predicted good.
SAMPLE, SAMPLE_BYTES, EPOCHS, STEPS, BATCH, SEED, CUT = 700, 32 << 10, 10, 700, 32, 7, 0.7


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of the documents (padded with zero bytes) and the number of chunks of each; an empty text has one of padding."""
    size = np.diff(offsets)
    n = np.maximum(1, -(-(size - (CHUNK - HOP)) // HOP)).astype(np.int64)
    doc = np.repeat(np.arange(len(n)), n)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * HOP
    at = (offsets[doc] + start)[:, None] + np.arange(CHUNK)
    inside = at < offsets[doc + 1][:, None]
    padded = np.append(data, np.uint8(0))
    return padded[np.where(inside, at, len(data))], n


def filled(chunks: np.ndarray) -> np.ndarray:
    return (chunks != 0).mean(axis=1, dtype=np.float32)


class Network:
    def __init__(self, rng: np.random.Generator | None = None):
        rng = rng or np.random.default_rng(SEED)
        f = np.float32
        self.p = {
            "emb": rng.normal(0, 0.5, (256, DIM)).astype(f), "conv": rng.normal(0, (2 / (WIDTH * DIM)) ** 0.5, (WIDTH * DIM, FILTERS)).astype(f), "cb": np.zeros(FILTERS, f),
            "w": rng.normal(0, (2 / FILTERS) ** 0.5, (FILTERS + 1, HIDDEN)).astype(f), "wb": np.zeros(HIDDEN, f), "v": rng.normal(0, 0.2, 2 * HIDDEN).astype(f), "vb": np.zeros(1, f),
        }

    def windows(self, chunks: np.ndarray) -> np.ndarray:
        e = self.p["emb"][chunks]
        view = np.lib.stride_tricks.sliding_window_view(e.reshape(len(chunks), -1), WIDTH * DIM, axis=1)
        return view[:, :: STRIDE * DIM]

    def pooled(self, chunks: np.ndarray, where: bool = False):
        out, at = np.empty((len(chunks), FILTERS), np.float32), np.empty((len(chunks), FILTERS), np.int64) if where else None
        for k in range(0, len(chunks), 64):
            win = self.windows(chunks[k : k + 64])
            a = (np.ascontiguousarray(win).reshape(-1, WIDTH * DIM) @ self.p["conv"]).reshape(win.shape[0], win.shape[1], FILTERS)
            if where:
                at[k : k + 64] = a.argmax(axis=1)
            out[k : k + 64] = a.max(axis=1)
        return out + self.p["cb"], at

    def top(self, pool: np.ndarray, fill: np.ndarray, n: np.ndarray):
        """fill: the part of each chunk that holds text."""
        first = np.cumsum(n) - n
        r = np.concatenate([np.maximum(pool, 0), fill[:, None]], axis=1)
        h = np.maximum(r @ self.p["w"] + self.p["wb"], 0)
        most, mean = np.maximum.reduceat(h, first), np.add.reduceat(h, first) / n[:, None]
        z = np.concatenate([most, mean], axis=1) @ self.p["v"] + self.p["vb"][0]
        return r, h, most, mean, z

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of each document; long documents are pooled in runs of chunks, so memory stays bounded."""
        out = []
        for i in range(len(offsets) - 1):
            if offsets[i + 1] - offsets[i] > 1 << 20:
                hs, fs = [], []
                for a in range(int(offsets[i]), int(offsets[i + 1]), HOP * 4096):
                    b = min(int(offsets[i + 1]), a + HOP * 4096 + CHUNK - HOP)
                    c, m = cut(data[a:b], np.array([0, b - a]))
                    hs.append(self.pooled(c)[0])
                    fs.append(filled(c))
                out.append(self.top(np.concatenate(hs), np.concatenate(fs), np.array([sum(map(len, hs))]))[4])
            else:
                c, m = cut(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))
                out.append(self.top(self.pooled(c)[0], filled(c), m)[4])
        z = np.concatenate(out) if out else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))

    def gradients(self, chunks: np.ndarray, n: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        pool, at = self.pooled(chunks, where=True)
        r, h, most, mean, z = self.top(pool, filled(chunks), n)
        p = 1 / (1 + np.exp(-z))
        first, doc = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
        loss = float(-(weight * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / weight.sum())
        dz = (weight * (p - y) / weight.sum()).astype(np.float32)
        g = {"v": np.concatenate([most, mean], axis=1).T @ dz, "vb": dz.sum(keepdims=True)}
        dmost, dmean = dz[:, None] * self.p["v"][:HIDDEN], dz[:, None] * self.p["v"][HIDDEN:]
        is_most = h == most[doc]
        ties = np.add.reduceat(is_most.astype(np.float32), first)
        dh = (is_most * (dmost / ties)[doc] + (dmean / n[:, None])[doc]) * (h > 0)
        g["w"], g["wb"] = r.T @ dh, dh.sum(axis=0)
        dpool = (dh @ self.p["w"][:-1].T) * (pool > 0)
        g["cb"] = dpool.sum(axis=0)
        rows = (at * STRIDE)[:, :, None] + np.arange(WIDTH)
        bytes_at = chunks[np.arange(len(chunks))[:, None, None], rows]  # chunks, filters, width
        win = self.p["emb"][bytes_at].reshape(len(chunks), FILTERS, -1)
        g["conv"] = np.einsum("cf,cfk->kf", dpool, win)
        dwin = (dpool[:, :, None] * self.p["conv"].T[None]).reshape(-1, DIM)
        flat = bytes_at.ravel()
        g["emb"] = np.stack([np.bincount(flat, dwin[:, k], 256) for k in range(DIM)], axis=1).astype(np.float32)
        return loss, g


def train(texts: list[bytes], y: np.ndarray, epochs: int = EPOCHS) -> Network:
    """Adam on cross-entropy with classes in balance. With no examples the network is untrained; with one class it learns that one."""
    rng = np.random.default_rng(SEED)
    net = Network(rng)
    if not texts:
        return net
    # a short good text has few patterns, as a repetitive one has: short cuts of good texts teach the difference
    short = [t[a : a + k] for t, c in zip(texts, y, strict=True) if c == 1 and len(t) > 16 for k in (int(rng.integers(16, 200)),) for a in (int(rng.integers(0, max(1, len(t) - k))),)]
    texts, y = [*texts, *short], np.concatenate([y, np.ones(len(short), y.dtype)])
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    chunks, n = cut(np.frombuffer(b"".join(texts), np.uint8), offsets)
    first = np.cumsum(n) - n
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())).astype(np.float32)
    m = {k: np.zeros_like(x) for k, x in net.p.items()}
    s = {k: np.zeros_like(x) for k, x in net.p.items()}
    each = -(-len(texts) // BATCH)
    epochs = max(epochs, -(-STEPS // each))
    t, steps = 0, epochs * each
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), BATCH):
            docs = order[a : a + BATCH]
            rows = np.concatenate([np.arange(first[d], first[d] + n[d]) for d in docs])
            _, g = net.gradients(chunks[rows], n[docs], y[docs].astype(np.float32), weight[docs])
            t += 1
            rate = 0.008 * min(1.0, t / 20) * (1 - t / (steps + 1))
            for k, x in g.items():
                m[k] = 0.9 * m[k] + 0.1 * x
                s[k] = 0.99 * s[k] + 0.01 * x * x
                net.p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
    return net


def examples(docs: DataFrame, labels: DataFrame, learn: Column, text: str, key: str, label: str, most: int = SAMPLE) -> tuple[list[bytes], np.ndarray]:
    """At most `most` labelled documents of each class. A key with several labels or texts gives each pair once."""
    marked = labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").alias("y")).where(F.col("k").isNotNull() & F.col("y").isin(0, 1)).distinct()
    marked = marked.withColumn("h", F.xxhash64("k"))
    own = docs.where(F.coalesce(learn, F.lit(False))).select(F.col(f"`{key}`").alias("k"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t")).where(F.octet_length("t") <= SAMPLE_BYTES)
    texts, y = [], []
    for c in (0, 1):
        keys = own.select("k").distinct().join(marked.where(F.col("y") == c), "k").orderBy("h", "k").limit(most).select("k", "h")  # bounded
        got = own.join(F.broadcast(keys), "k").orderBy("h", "k", "t").limit(2 * most).collect()
        texts += [r["t"].encode() for r in got]
        y += [c] * len(got)
    return texts, np.array(y)


def score(docs: DataFrame, labels: DataFrame, learn: Column, text: str = "text", key: str = "doc_id", label: str = "quality", keep: tuple[str, ...] | None = None) -> DataFrame:
    """docs (keep columns, or all) with score, the probability of label 1.

    learn: rows of docs that may be learnt from, by their key in labels. Null and empty texts are one chunk of padding and get its score. Repeated
    rows score alike; texts of any length are read whole. With no labels scores come from an untrained network. A column named score is replaced.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() != "score"]
    net = train(*examples(docs, labels, learn, text, key, label))
    shared = docs.sparkSession.sparkContext.broadcast(net.p)
    named = text if text in kept else "__text"
    base = docs.select(*[F.col(f"`{c}`") for c in kept], *([] if named == text else [F.col(f"`{text}`").alias(named)]))

    def scored(batches):
        own = Network()
        own.p = shared.value
        for batch in batches:
            out = own.score(*buffers(batch.column(named)))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(out, pa.float64())], names=[*kept, "score"])

    return base.mapInArrow(lean(scored), base.select(*kept, F.lit(0.0).alias("score")).schema)


def op1_byte_cnn_quality(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents, learnt from the labels of all folds but one; for null, empty and long texts, ties and empty tables see score()."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", fold(F.col("doc_id"), 4) == 2)
    out = score(docs, table(spark, sf_dir, "labels"), ~F.col("held_out"), keep=("doc_id", "held_out"))
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
