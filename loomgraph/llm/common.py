"""What the operators of this subpackage share: tables, staged results, folds and vectorised word hashing."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.plans.staging import Staged, new_path, staged

__all__ = ["Staged", "Words", "batches_of", "buffers", "chunks", "fits", "fold", "lean", "marked", "most_frequent", "new_path", "sifted", "small", "staged", "table", "with_outputs"]

#: Bytes of text that a Python worker expands into word arrays at a time.
CHUNK_BYTES = 1 << 19
#: Bytes of a table that is broadcast by a hint; beyond, Spark decides by its own threshold.
BROADCAST_BYTES = 1 << 16
#: Bits of a sieve.
SIEVE_BITS = 1 << 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lean(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """f over Arrow batches; when a task ends, its worker gives back the memory it no longer uses."""

    def run(batches):
        yield from f(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # not every C library has it
            return

    return run


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows at most for what is planned inside; for steps that write their result before they leave."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name, None)
    spark.conf.set(name, str(rows if was is None or int(was) <= 0 else min(rows, int(was))))
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, was)


def most_frequent(df: DataFrame, count: str, most: int) -> DataFrame:
    """Rows of the largest counts (whole numbers from 0), `most` at most: a histogram finds the cut, so no task orders or reads them all.

    Counts of one bin (one value up to 4095, then 64 bins a doubling) come in together or stay out together.
    """
    c = F.col(count)
    bin_ = F.when(c < 4096, c).otherwise(F.lit(4096 - 12 * 64) + F.floor(F.log2(c) * 64)).cast("int")
    left, cut_at = most, None
    for r in df.groupBy(bin_.alias("b")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("b")).collect():  # about 8000 rows at most
        if r["n"] > left:
            break
        left, cut_at = left - r["n"], r["b"]
    return df.where(F.lit(False)) if cut_at is None else df.where(bin_ >= cut_at)


def fits(df: DataFrame) -> bool:
    """Whether the values of a staged table take BROADCAST_BYTES at most."""
    text = [c for c, kind in df.dtypes if kind == "string"]
    wide = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in text), F.lit(16 * len(df.columns)).cast("long"))
    return (df.agg(F.sum(wide)).first()[0] or 0) <= BROADCAST_BYTES


def small(df: DataFrame) -> DataFrame:
    """A staged table, broadcast if it fits; beyond, Spark joins by a shuffle, or as its own threshold says."""
    return F.broadcast(df) if fits(df) else df


def marked(df: DataFrame, key: str, wanted: DataFrame, flag: str = "__maybe") -> DataFrame:
    """df with flag: false where its key is surely none of wanted's (a staged table with a column of that name and type), by a bitmap of SIEVE_BITS bits.

    The bitmap is an aggregate of SIEVE_BITS / 64 rows at most and broadcast; with very many keys it says less, never anything wrong. A null key is none.
    """
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(SIEVE_BITS))
    words = wanted.where(F.col(key).isNotNull()).select(spot(key).alias("h")).selectExpr("h div 64 AS __w", "shiftleft(1L, cast(h % 64 AS int)) AS b").groupBy("__w").agg(F.bit_or("b").alias("__bits"))
    df = df.withColumn("__spot", spot(key))
    j = df.withColumn("__w", F.expr("__spot div 64")).join(F.broadcast(staged(words, "sieve")), "__w", "left")
    hit = F.expr("(__bits & shiftleft(1L, cast(__spot % 64 AS int))) <> 0") & F.col(key).isNotNull()
    return j.withColumn(flag, F.coalesce(hit, F.lit(False))).drop("__w", "__spot", "__bits")


def sifted(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows of df that a join with wanted by the key may need: all where wanted is broadcast anyway, else those that marked() lets through, so that few
    others are shuffled."""
    return df if fits(wanted) else marked(df, key, wanted).where("__maybe").drop("__maybe")


def fold(key: Column, mod: int) -> Column:
    """crc32 of the key as text, modulo mod; a null key falls in the fold of the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % mod


def with_outputs(df: DataFrame, **columns: Column) -> DataFrame:
    """df with new columns; an input column of the same name (in any case) is replaced."""
    taken = {c.lower() for c in columns}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken], *[v.alias(k) for k, v in columns.items()])


# ---- vectorised words ----

_ODD = 0x9E3779B97F4A7C15
_INV = pow(_ODD, -1, 1 << 64)
_C = np.uint64(0xD1342543DE82EF95)
_powers: list[np.ndarray] = []

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words that are runs of anything but ASCII white space.
SPACED = np.ones(256, bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
#: Bytes of words that are runs of digits, lower-case letters and non-ASCII characters.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, 1 << 16)
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, x, np.uint64)]), dtype=np.uint64) for x in (_ODD, _INV)]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _C
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def spans(data: np.ndarray, bounds: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in lower-cased bytes; bounds: offsets of documents, which no word crosses."""
    w = is_word[data]
    s, e = w.copy(), w.copy()
    s[1:] &= ~w[:-1]
    e[:-1] &= ~w[1:]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    s[inner] = w[inner]
    e[inner - 1] = w[inner - 1]
    return np.flatnonzero(s), np.flatnonzero(e) + 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, by prefix sums of a polynomial modulo 2**64."""
    up, down = _pow(len(data))
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _C)


class Words:
    """The words of a run of documents: data (lower-cased bytes), starts, ends, hash, and for each document the words [first[i], first[i+1])."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
        self.data = LOWER[data]
        offsets = offsets.astype(np.int64)
        if len(data) <= 2 * CHUNK_BYTES:
            self.starts, self.ends = spans(self.data, offsets, is_word)
            self.hash = hashes(self.data, self.starts, self.ends)
        else:  # one very long document: in pieces that end at a separator
            found, at = [], 0
            gaps = np.flatnonzero(~is_word[self.data])
            while at < len(data):
                k = np.searchsorted(gaps, at + CHUNK_BYTES)
                to = int(gaps[k]) + 1 if k < len(gaps) else len(data)
                piece = self.data[at:to]
                s, e = spans(piece, offsets - at, is_word)
                found.append((s + at, e + at, hashes(piece, s, e)))
                at = to
            self.starts, self.ends, self.hash = (np.concatenate(x) for x in zip(*found, strict=True))
        self.first = np.searchsorted(self.starts, offsets)

    def grams(self, n: int) -> np.ndarray:
        """Hash of the n words from each word on, over all documents; those that cross a document's end are to be left out by the caller."""
        if len(self.hash) < n:
            return np.zeros(0, np.uint64)
        m = len(self.hash) - n + 1
        out = np.full(m, n, np.uint64)
        for k in range(n):
            out = out * _C + self.hash[k : k + m]
        return mix(out)

    def word(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.ends[k]].tobytes()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    big = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if "binary" in str(column.type) else "")
    _, off, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(off, np.int64 if big else np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if off is not None and n else np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs [a, b) of rows of at most so many bytes (or one row), with their bytes and offsets from 0."""
    data, offsets = buffers(column)
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        b = min(b, n)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b
