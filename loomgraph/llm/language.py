"""Language identification by compression.

Each language has a raw-content zstandard dictionary of training text. A text is cut into pieces, every piece is compressed with every
dictionary, and the language with the smallest total wins. When the runner-up comes within a margin, the choice is marked as rejected: it
stays in lang_pred for callers that need one, and certain is false.

Dictionaries take DICT_BYTES at most of each language's text: one short piece of each of BUCKETS hash buckets of documents, by an aggregate of
bounded size that every training row goes through. Each keeps its whole sample: languages of equal samples are compared with one another, and
the best of the larger ones meets a poorer language with a dictionary cut to that one's length (LEAST_BYTES at least), so a poor sample
weakens no other comparison. Texts are classified whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import fold, table

#: Sample documents and bytes of each language, characters taken of a sample document, bytes of a piece, compression level, narrowest margin.
BUCKETS, DICT_BYTES, SAMPLE_CHARS, PIECE, LEVEL, MARGIN = 192, 96 << 10, 700, 1024, 6, 0.01
#: Bytes to which a dictionary is cut at most for the comparison with a poorer one.
LEAST_BYTES = 4096
UND = "und"
_LETTERS = np.arange(256, dtype=np.uint8)
_LETTERS[:65] = _LETTERS[91:97] = _LETTERS[123:128] = 32


def letters(text: str) -> bytes:
    """Lower-cased words of letters, with one space for whatever lies between."""
    b = _LETTERS[np.frombuffer(text.lower().encode(), np.uint8)]
    keep = np.ones(len(b), bool)
    keep[1:] = (b[1:] != 32) | (b[:-1] != 32)
    return b[keep].tobytes()


def sample(docs: DataFrame, text: str, lang: str) -> dict[str, bytes]:
    """Training text of each language."""
    rows = docs.where(F.col(lang).isNotNull() & (F.length(text) > 0)).select(F.col(lang).alias("lang"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    start = F.pmod(F.shiftright("h", 20), F.greatest(F.length("t") - SAMPLE_CHARS, F.lit(1))).cast("int")
    rows = rows.select("lang", F.pmod("h", F.lit(BUCKETS)).alias("b"), "h", F.substring("t", start + 1, F.lit(SAMPLE_CHARS)).alias("t"))
    got = rows.groupBy("lang", "b").agg(F.min(F.struct("h", "t")).alias("x")).select("lang", "b", "x.t").collect()  # languages * BUCKETS rows
    out: dict[str, list[bytes]] = {}
    for r in sorted(got, key=lambda r: (r["lang"], r["b"])):
        out.setdefault(r["lang"], []).append(letters(r["t"]))
    return {k: b" ".join(x)[-DICT_BYTES:] for k, x in out.items()}


class Compressors:
    def __init__(self, texts: dict[str, bytes]):
        self.langs = sorted(texts)
        self.texts = [texts[k] for k in self.langs]
        self.tools: dict[tuple[int, int], zstandard.ZstdCompressor] = {}
        self.tiers: dict[int, list[int]] = {}  # languages by the bytes at which they are compared, the richest first
        for k in sorted(range(len(self.langs)), key=lambda k: -len(self.texts[k])):
            self.tiers.setdefault(max(len(self.texts[k]), LEAST_BYTES), []).append(k)

    def tool(self, k: int, most: int) -> zstandard.ZstdCompressor:
        text = self.texts[k][-most:]
        if (k, len(text)) not in self.tools:
            d = zstandard.ZstdCompressionDict(text, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.tools[k, len(text)] = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        return self.tools[k, len(text)]

    def size(self, k: int, most: int, text: bytes) -> int:
        """Bytes of the text with at most so many bytes of the dictionary."""
        tool = self.tool(k, most)
        return sum(len(tool.compress(text[at : at + PIECE])) for at in range(0, len(text), PIECE))

    def sizes(self, text: bytes) -> np.ndarray:
        """Sizes by language, of poorer languages in proportion to that of the best of the richer ones at the same length of dictionary."""
        out = np.full(len(self.langs), np.inf)
        for most, tier in self.tiers.items():
            best = int(out.argmin())
            unit = out[best] / self.size(best, most, text) if out[best] < np.inf else 1.0
            for k in tier:
                out[k] = self.size(k, most, text) * unit
        return out

    def judge(self, text: bytes) -> tuple[str, float, bool]:
        """Language, score and whether the margin is wide enough. Ties go to the language that sorts first."""
        if len(text) < PIECE // 8:  # short texts are repeated, so that sizes in whole bytes can differ
            text = (text + b" ") * max(1, min(8, PIECE // 8 // (len(text) + 1)))
        size = self.sizes(text)
        k = int(size.argmin())
        rest = np.delete(size, k)
        gap = float((rest.min() - size[k]) / size[k]) if len(rest) else 1.0
        odds = np.exp(-(size - size[k]) / size[k] * 20)
        return self.langs[k], float(odds[k] / odds.sum()), gap >= MARGIN


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns with lang_pred, score (0 to 1) and certain (false: rejected, the margin is narrow).

    learn: rows to learn from; of these, those with a language and text. lang_pred is `und` with score 0 where the text is null or has no letter,
    and everywhere if there is nothing to learn from. Repeated rows are judged alike; texts of any length whole.
    """
    base = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"), F.col(f"`{lang}`").alias("__lang"), F.coalesce(learn, F.lit(False)).alias("__learn"))
    texts = sample(base.where("__learn"), "__text", "__lang")
    shared = base.sparkSession.sparkContext.broadcast(texts)
    kept = list(keep)

    def judged(batches):
        tools = Compressors(shared.value)
        for batch in batches:
            known = batch.column("__letter").to_pylist()
            rows = [tools.judge(letters(text.as_py())) if ok and tools.langs else (UND, 0.0, False) for text, ok in zip(batch.column("__text"), known, strict=True)]
            cols = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.bool_())], names=[*kept, "lang_pred", "score", "certain"])

    schema = base.select(*kept, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("certain")).schema
    return base.select(*kept, "__text", has_letter(F.col("__text")).alias("__letter")).mapInArrow(judged, schema)


def op6_zstd_language(spark, sf_dir: str) -> DataFrame:
    """Languages of all documents, learnt from all folds but one; for null texts, texts without letters, ties and empty tables see identify()."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", fold(F.col("doc_id"), 5) == 0)
    return identify(docs, ~F.col("held_out"), keep=("doc_id", "held_out"))
