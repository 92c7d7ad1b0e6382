"""Token counts of flat token files by a separator scan.

A flat file holds token ids of a fixed width, each document's followed by an end-of-document id, and no index. Files are read in blocks; a
vectorised comparison finds the separators of a block, and a prefix scan over the blocks of a file (tokens and documents before, last separator
before) gives each document its place, also where it runs over several blocks. What follows the last separator of a file is an open document.

Files are written by Spark's text writer: a document's ids are one row's bytes and the separator's bytes the line separator, so the commit
protocol and every file system of Spark serve binary files too.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import new_path, table

#: Vocabulary and its pattern of pieces, end-of-document id, tokens of a block, bytes of a file (about).
RANKS, EOD, BLOCK, FILE_BYTES = "/opt/tokenizers/byte_bpe_50k.tiktoken", 50256, 1 << 18, 16 << 20
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def encode(docs: DataFrame, text: str = "text", ranks: str = RANKS) -> DataFrame:
    """ids: each text's token ids as little-endian 16-bit numbers; null is the empty text."""

    def encoded(batches):
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        tool = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        for batch in batches:
            out, size = [], 0
            for x in batch.column(0):
                out.append(np.array(tool.encode_ordinary(x.as_py() or ""), "<u2").tobytes())
                size += len(out[-1])
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["ids"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["ids"])

    return docs.select(f"`{text}`").mapInArrow(encoded, "ids binary")


def write(ids: DataFrame, path: str, per_file: int, eod: int = EOD) -> None:
    """Flat files below path, of per_file documents at most, in the order of ids' partitions."""
    end = np.array([eod], "<u2").tobytes().decode("latin-1")
    ids.select(F.col("ids").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", end).option("maxRecordsPerFile", per_file).text(path)


def scan(spark: SparkSession, path: str, eod: int = EOD, width: str = "<u2", block: int = BLOCK) -> DataFrame:
    """file, doc (from 0 in its file), start, n_tokens, closed: each document of the files below path.

    start is the place of its first token in the file, n_tokens leaves the separator out, and closed is false for tokens after the last separator.
    Empty files have no documents; two separators in a row hold an empty one. A file whose size is no multiple of the width raises ValueError.
    """
    step = np.dtype(width).itemsize

    def found(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                raw = content.as_buffer()
                if len(raw) % step:
                    raise ValueError(f"{name}: {len(raw)} bytes")
                tokens = np.frombuffer(raw, width)
                rows = []
                for k, at in enumerate(range(0, len(tokens), block)):
                    part = tokens[at : at + block]
                    rows.append((name, k, len(part), np.flatnonzero(part == eod)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.list_(pa.int64()))], names=["file", "block", "n", "ends"])

    blocks = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(found, "file string, block int, n long, ends array<long>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    last = F.when(F.size("ends") > 0, F.col("base") + F.element_at("ends", -1))
    blocks = blocks.withColumn("docs", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0))).withColumn("after", F.coalesce(F.max(last).over(before), F.lit(-1)) + 1)
    is_last = F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull()
    blocks = blocks.withColumn("is_last", is_last)
    ends = F.transform("ends", lambda e: e + F.col("base"))
    starts = F.concat(F.array("after"), F.transform("ends", lambda e: e + F.col("base") + 1))
    total = F.col("base") + F.col("n")
    spans = F.zip_with(F.slice(starts, 1, F.size("ends")), ends, lambda s, e: F.struct(s.alias("start"), (e - s).alias("n"), F.lit(True).alias("closed")))
    rest = F.element_at(starts, -1)
    spans = F.when(F.col("is_last") & (rest < total), F.concat(spans, F.array(F.struct(rest.alias("start"), (total - rest).alias("n"), F.lit(False).alias("closed"))))).otherwise(spans)
    each = blocks.select("file", "docs", F.posexplode(spans).alias("k", "d"))
    return each.select("file", (F.col("docs") + F.col("k")).cast("long").alias("doc"), F.col("d.start").alias("start"), F.col("d.n").alias("n_tokens"), F.col("d.closed").alias("closed"))


def op7_separator_scan(spark, sf_dir: str) -> DataFrame:
    """Token count of every document: documents are encoded into flat files, the files scanned, and documents named by their place.

    Null and empty texts have no tokens, long ones are encoded whole, repeated rows and ids each have their own place, and an empty table gives no
    rows. Columns besides doc_id and text are not read.
    """
    docs = table(spark, sf_dir, "documents")
    path = new_path(spark, "tokens")
    mean = docs.agg(F.avg(F.octet_length("text"))).first()[0] or 1
    per_file = max(1, int(FILE_BYTES / (mean / 1.5 + 2)))
    write(encode(docs), path, per_file)
    found = scan(spark, path)
    part = F.regexp_extract("file", r"part-(\d+)-[^/]*-c(\d+)", 1).cast("int")
    found = found.withColumn("part", part).withColumn("place", F.regexp_extract("file", r"part-(\d+)-[^/]*-c(\d+)", 2).cast("long") * per_file + F.col("doc"))
    # rows of a scan keep their partition and order, whichever columns are read
    order = docs.select("doc_id", F.monotonically_increasing_id().alias("m")).select("doc_id", F.shiftright("m", 33).cast("int").alias("part"), F.col("m").bitwiseAND((1 << 33) - 1).alias("place"))
    return order.join(found, ["part", "place"]).select("doc_id", F.col("part").alias("file"), F.col("place").alias("doc"), "start", "n_tokens")
