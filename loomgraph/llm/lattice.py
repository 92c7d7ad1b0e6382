"""Language-model scores by subword lattices.

The model draws pieces of an existing vocabulary independently until an end: a word, led by a space, has the summed probability of all its
segmentations, found by a forward recursion in log space, and a text has the product of its words' and the end's. Byte fallback covers what
no piece does, so every text has a probability. Pieces start from weights by their rank in the vocabulary and are then fitted to the
training words by expectation maximisation over all segmentations.

Words are counted over all documents, so the table of words grows with the corpus; lattices are computed once per distinct word. The HEAD most
frequent words go to the executors by a broadcast of bounded size; all other words are joined.
"""

from __future__ import annotations

import math
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from loomgraph.llm.common import SPACED, Staged, Words, buffers, chunks, fold, most_frequent, table

#: Words of the broadcast head, rounds of fitting, weight of the prior in each piece's count, bytes of text counted before counts are sent on.
HEAD, ROUNDS, PRIOR, FLUSH_BYTES = 1 << 19, 2, 0.1, 16 << 20
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of a word from which on it is read in blocks of STRETCH bytes, by itself; shorter ones go together with those of equal length.
LONG, STRETCH = 512, 1 << 16
_B = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22


def load_pieces(path: str = PIECES) -> list[bytes]:
    """Pieces that can be part of a lower-cased word led by a space, best first, and a byte for each that is no piece itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out: dict[bytes, None] = {}
    for k in range(model.get_piece_size()):
        piece = model.id_to_piece(k)
        if model.is_unknown(k) or model.is_control(k) or model.is_byte(k) or "▁" in piece[1:]:
            continue
        raw = piece.replace("▁", " ").encode()
        if raw and not any(65 <= x <= 90 for x in raw) and not any(x in b" \t\n\v\f\r" for x in raw[1:]):
            out.setdefault(raw)
    for k in range(256):
        if k not in b"\t\n\v\f\r" and not 65 <= k <= 90:
            out.setdefault(bytes([k]))
    return list(out)


class Lattice:
    def __init__(self, pieces: list[bytes], log_p: np.ndarray):
        """log_p: natural logarithms, one a piece."""
        self.longest = max(map(len, pieces))
        h = np.array([self._hash(x) for x in pieces], np.uint64)
        self.order = np.argsort(h)
        self.keys, self.log_p = h[self.order], log_p[self.order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one hash")
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[(self.keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    @staticmethod
    def _hash(x: bytes) -> int:
        h = 0
        for b in x:
            h = ((h + b + 1) * int(_B)) % (1 << 64)
        return h

    def matches(self, w: np.ndarray):
        """Of words of one length (a byte matrix): start, end, rows and piece numbers, by start."""
        m, n = w.shape
        out = []
        for s in range(n):
            h = np.zeros(m, np.uint64)
            for e in range(s + 1, min(n, s + self.longest) + 1):
                h = (h + w[:, e - 1] + np.uint64(1)) * _B
                rows = np.flatnonzero(self.seen[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
                if len(rows):
                    k = np.minimum(np.searchsorted(self.keys, h[rows]), len(self.keys) - 1)
                    ok = self.keys[k] == h[rows]
                    if ok.any():
                        out.append((s, e, rows[ok], k[ok]))
        return out

    def forward(self, m: int, n: int, found) -> np.ndarray:
        a = np.full((n + 1, m), -np.inf)
        a[0] = 0
        for s, e, rows, k in found:
            a[e, rows] = np.logaddexp(a[e, rows], a[s, rows] + self.log_p[k])
        return a

    def stretches(self, raw: np.ndarray, backward: bool = False):
        """Of one word (led by a space): starts, ends and piece numbers of its matches, by start (backward: the last start first), a stretch of starts at a time."""
        w = np.concatenate([[32], raw]).astype(np.uint64)
        for a in range(0, len(w), STRETCH) if not backward else reversed(range(0, len(w), STRETCH)):
            b = min(len(w), a + STRETCH)
            h, found = np.zeros(b - a, np.uint64), []
            for n in range(1, self.longest + 1):
                m = min(b, len(w) - n + 1) - a  # starts with so many bytes left
                if m <= 0:
                    break
                h = (h[:m] + w[a + n - 1 : a + n - 1 + m] + np.uint64(1)) * _B
                at = np.flatnonzero(self.seen[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
                k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
                ok = self.keys[k] == h[at]
                found.append((at[ok] + a, at[ok] + a + n, k[ok]))
            s, e, k = (np.concatenate([x[i] for x in found]) for i in range(3))
            order = np.argsort(s, kind="stable")
            yield s[order], e[order], k[order]

    def climb(self, raw: np.ndarray, backward: bool = False) -> array:
        """Natural logarithms of the probability of each prefix of a word (backward: each suffix), by one pass over its matches."""
        a = array("d", [-math.inf]) * (len(raw) + 2)
        a[-1 if backward else 0] = 0.0
        for s, e, k in self.stretches(raw, backward):
            p = self.log_p[k]
            rows = zip(e[::-1].tolist(), s[::-1].tolist(), p[::-1].tolist(), strict=True) if backward else zip(s.tolist(), e.tolist(), p.tolist(), strict=True)
            for i, j, x in rows:
                v, u = a[i] + x, a[j]
                if u == -math.inf:
                    a[j] = v
                elif v != -math.inf:
                    a[j] = max(u, v) + math.log1p(math.exp(-abs(u - v)))
        return a

    def long(self, raw: np.ndarray, offsets: np.ndarray):
        """Numbers and bytes of the long words."""
        for i in np.flatnonzero(np.diff(offsets) >= LONG).tolist():
            yield i, raw[offsets[i] : offsets[i + 1]]

    def groups(self, raw: np.ndarray, offsets: np.ndarray, most: int = 1 << 18):
        """Words (led by a space) that aren't long, as byte matrices of one length: numbers, matrix."""
        size = np.diff(offsets)
        order = np.argsort(size, kind="stable")
        order = order[: int(np.searchsorted(size[order], LONG))]
        at = 0
        while at < len(order):
            n = int(size[order[at]])
            to = int(np.searchsorted(size[order], n, "right"))
            to = min(to, at + max(1, most // (n + 1)))
            rows = order[at:to]
            w = np.full((len(rows), n + 1), 32, np.uint64)
            w[:, 1:] = raw[offsets[rows][:, None] + np.arange(n)]
            yield rows, w
            at = to

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """log10 of each word's probability."""
        out = np.zeros(len(offsets) - 1)
        for rows, w in self.groups(raw, offsets):
            out[rows] = self.forward(*w.shape, self.matches(w))[-1] / np.log(10)
        for i, word in self.long(raw, offsets):
            out[i] = self.climb(word)[-1] / np.log(10)
        return out

    def expected(self, raw: np.ndarray, offsets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """How often each piece is expected in words of these counts; in the order of pieces as given."""
        total = np.zeros(len(self.keys))
        for rows, w in self.groups(raw, offsets):
            found = self.matches(w)
            m, n = w.shape
            a = self.forward(m, n, found)
            b = np.full((n + 1, m), -np.inf)
            b[n] = 0
            for s, e, r, k in reversed(found):
                b[s, r] = np.logaddexp(b[s, r], b[e, r] + self.log_p[k])
            z = a[-1]
            for s, e, r, k in found:
                total += np.bincount(k, counts[rows[r]] * np.exp(a[s, r] + self.log_p[k] + b[e, r] - z[r]), len(total))
        for i, word in self.long(raw, offsets):
            up, down = np.frombuffer(self.climb(word)), np.frombuffer(self.climb(word, backward=True))
            for s, e, k in self.stretches(word):
                total += np.bincount(k, counts[i] * np.exp(up[s] + self.log_p[k] + down[e] - up[-1]), len(total))
        out = np.zeros(len(total))
        out[self.order] = total
        return out


def cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words' bytes, one after the other, and their offsets."""
    size = ends - starts
    offsets = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], size)
    return data[at], offsets


def as_binary(raw: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])


def word_table(docs: DataFrame) -> DataFrame:
    """h, word, train, uses of every distinct word of docs (text, learn): its hash, its uses in training rows and in all rows."""

    def counted(batches):
        held: list[tuple] = []

        def flush():
            h, t, u = (np.concatenate([x[k] for x in held]) for k in range(3))
            raw, size = np.concatenate([x[3] for x in held]), np.concatenate([x[4] for x in held])
            offsets = np.concatenate([[0], np.cumsum(size)])
            order = np.argsort(h, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
            at = order[first]
            words = cut(raw, offsets[at], offsets[at + 1])
            yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), as_binary(*words), pa.array(np.add.reduceat(t[order], first)), pa.array(np.add.reduceat(u[order], first))], names=["h", "word", "train", "uses"])

        size = 0
        for batch in batches:
            learn = batch.column("learn").to_numpy(zero_copy_only=False)
            for a, b, data, offsets in chunks(batch.column("text")):
                words = Words(data, offsets, SPACED)
                if not len(words.hash):
                    continue
                by_word = np.repeat(learn[a:b], np.diff(words.first))
                h, first, back, uses = np.unique(words.hash, return_index=True, return_inverse=True, return_counts=True)
                train = np.bincount(back, by_word, len(h)).astype(np.int64)
                raw, off = cut(words.data, words.starts[first], words.ends[first])
                held.append((h, train, uses, raw, np.diff(off)))
                size += len(data)
                if size > FLUSH_BYTES:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    each = docs.mapInArrow(counted, "h long, word binary, train long, uses long")
    return each.groupBy("h", "word").agg(F.sum("train").alias("train"), F.sum("uses").alias("uses"))


def fit(words: DataFrame, pieces: list[bytes], ends: int, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Natural logarithms of the pieces' and the end's probabilities."""
    spark = words.sparkSession
    weights = 1.0 / (np.arange(len(pieces)) + 50.0)
    log_p, log_end = np.log(weights / weights.sum() * 0.9), np.log(0.1)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((pieces, log_p))

        def expect(batches, shared=shared):
            lattice = Lattice(*shared.value)
            total = np.zeros(len(lattice.keys))
            for batch in batches:
                raw, offsets = _words(batch)
                total += lattice.expected(raw, offsets, batch.column("train").to_numpy().astype(np.float64))
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["piece", "n"])

        got = words.where("train > 0").select("word", "train").mapInArrow(expect, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()  # one row a piece
        counts = np.full(len(pieces), PRIOR)
        for r in got:
            counts[r["piece"]] += r["n"]
        total = counts.sum() + ends + PRIOR
        log_p, log_end = np.log(counts / total), float(np.log((ends + PRIOR) / total))
        shared.unpersist()
    return log_p, log_end


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    raw, offsets = buffers(batch.column("word"))
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def score(docs: DataFrame, learn, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str = PIECES, head: int = HEAD) -> DataFrame:
    """keep columns with n_tokens, n_known, train_tokens, base_score and score (both log10 of the text's probability).

    learn: column that is true for rows to learn from. Tokens are lower-cased (A-Z) runs without ASCII white space and one end. base_score is
    an add-one unigram model of words; score is the lattice model. Null and empty texts are one end. With no rows to learn from, base_score is that
    of an empty vocabulary and score that of the vocabulary's ranks. Repeated rows are scored alike. Texts of any length are scored whole.
    """
    spark = docs.sparkSession
    base = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"), F.coalesce(learn, F.lit(False)).alias("__learn"))
    pieces = load_pieces(path)
    counted = Staged(word_table(base.select(F.col("__text").alias("text"), F.col("__learn").alias("learn"))), "words")
    ends = base.where("__learn").count()
    sums = counted.df.agg(F.coalesce(F.sum("train"), F.lit(0)), F.count_if(F.col("train") > 0)).first()
    tokens, distinct = sums[0] + ends, sums[1] + (ends > 0)
    log_p, log_end = fit(counted.df, pieces, ends)
    shared = spark.sparkContext.broadcast((pieces, log_p))

    def scored(batches):
        lattice = Lattice(*shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("train"), batch.column("uses"), pa.array(lattice.scores(*_words(batch)))], names=["h", "train", "uses", "lp"])

    words = Staged(counted.df.mapInArrow(scored, "h long, train long, uses long, lp double"), "scored")
    counted.drop()
    top = most_frequent(words.df, "uses", head).select("h", "train", "lp").toArrow()  # bounded by head
    h = top["h"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    known = spark.sparkContext.broadcast((h[order], top["train"].to_numpy()[order], top["lp"].to_numpy()[order]))
    schema = pa.schema([("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("lp", pa.float64()), ("rare", pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int64())])))])

    def summed(batches):
        keys, train, lp = known.value
        log_c = np.log10(train + 1.0)
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column("__text")):
                w = Words(data, offsets, SPACED)
                n, m = b - a, len(w.hash)
                doc = np.repeat(np.arange(n), np.diff(w.first))
                k = np.minimum(np.searchsorted(keys, w.hash), max(len(keys) - 1, 0))
                hit = keys[k] == w.hash if len(keys) else np.zeros(m, bool)
                k, of = k[hit], doc[hit]
                sums = [np.bincount(of, train[k] > 0, n).astype(np.int64), np.bincount(of, log_c[k], n), np.bincount(of, lp[k], n)] if len(keys) else [np.zeros(n, np.int64), np.zeros(n), np.zeros(n)]
                rh, rd = w.hash[~hit], doc[~hit]
                o = np.lexsort((rh, rd))
                rh, rd = rh[o], rd[o]
                first = np.flatnonzero(np.concatenate([[True], (rh[1:] != rh[:-1]) | (rd[1:] != rd[:-1])])) if len(rh) else np.zeros(0, np.int64)
                times = np.diff(np.append(first, len(rh)))
                pairs = pa.StructArray.from_arrays([pa.array(rh[first].view(np.int64)), pa.array(times)], names=["h", "n"])
                at = np.searchsorted(rd[first], np.arange(n + 1)).astype(np.int32)
                cols = [pa.array(np.diff(w.first) + 1), pa.array(sums[0]), pa.array(sums[1].astype(np.float64)), pa.array(sums[2].astype(np.float64)), pa.ListArray.from_arrays(pa.array(at), pairs)]
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(a, b - a) for c in kept] + cols, names=kept + schema.names)

    kept = [f.name for f in base.schema.fields if f.name not in ("__text", "__learn")]
    out_schema = StructType([base.schema[c] for c in kept] + from_arrow_schema(schema).fields)
    found = base.select(*kept, "__text").mapInArrow(summed, out_schema)
    found = Staged(found.withColumn("__u", F.monotonically_increasing_id()), "sums").df
    rare = found.select("__u", F.explode("rare").alias("r")).select("__u", "r.h", "r.n")
    joined = rare.join(words.df.select("h", "train", F.col("lp").alias("w")), "h")
    more = joined.groupBy("__u").agg(F.sum(F.when(F.col("train") > 0, F.col("n")).otherwise(0)).alias("k"), F.sum(F.col("n") * F.log10(F.col("train") + 1.0)).alias("b"), F.sum(F.col("n") * F.col("w")).alias("l"))
    out = found.drop("rare").join(more, "__u", "left")
    floor = float(np.log10(tokens + distinct + 1))
    base_score = F.col("base") + F.coalesce("b", F.lit(0.0)) + float(np.log10(ends + 1)) - F.col("n_tokens") * floor
    return out.select(
        *kept, "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0)) + int(ends > 0)).cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        base_score.alias("base_score"), (F.col("lp") + F.coalesce("l", F.lit(0.0)) + log_end / float(np.log(10))).alias("score"),
    )


def op9_lattice_lm(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents, learnt from all folds but one; for null and empty texts, repeated rows and empty tables see score()."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 7) == 2
    found = score(docs.withColumn("held_out", held_out), ~F.col("held_out"), keep=("doc_id", "held_out"))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
