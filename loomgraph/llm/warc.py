"""WARC archives with revisit records.

Headers (row, id, digest) are shuffled by payload digest; the smallest page id of equal payloads keeps its response, the others become revisits
that refer to it. Payloads stay where they are while the table of revisits is small; beyond, they are joined with it by row, never by digest, so a hot
payload fills no task. Spark's text writer puts the records into files, with its commit protocol and on any file system; a record ends with the
two line ends that the format asks for. Reading parses by Content-Length and joins revisits to the originals again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import Staged, new_path, small, staged, table

#: Payloads of fewer bytes are always stored; bytes of an archive file, about.
LEAST_BYTES, FILE_BYTES = 100, 16 << 20
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "file string, record_id string, page_id long, url string, record_type string, refers_to_id string, payload_digest string, payload_bytes long, payload binary"


def resolve(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """pages with payload, digest, bytes, u (a number of the row) and original: page_id and u of the response for this payload, or null for a response.

    Null html is an empty payload. Payloads below `least` bytes are responses. Repeated rows that hold the smallest id are all responses, and
    revisits refer to one of them. Rows without a page_id are never originals; if all rows of a payload are without, all are responses. One page_id may
    come with several payloads. No rows give no rows; other columns are ignored. pages is read twice and must then have the same rows in the same order, as
    tables in files have.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    heads = pages.select("page_id", "url", payload.alias("payload"), F.monotonically_increasing_id().alias("u"))
    heads = heads.select("*", F.sha2(F.col("payload").cast("binary"), 256).alias("digest"), F.octet_length("payload").cast("long").alias("bytes"))
    keys = Staged(heads.where(F.col("bytes") >= least).select("page_id", "u", F.unhex("digest").alias("d")), "heads")
    one = F.min(F.when(F.col("page_id").isNotNull(), F.struct(F.col("page_id").alias("page"), "u"))).alias("original")
    first = Staged(keys.df.groupBy("d").agg(F.count(F.lit(1)).alias("n"), one).where("n > 1 AND original IS NOT NULL").select("d", "original"), "digests")
    others = keys.df.join(small(first.df), "d").where(~F.col("page_id").eqNullSafe(F.col("original.page"))).select("u", "original")
    return heads.join(small(staged(others, "revisits")), "u", "left")


def record_id(page_id: Column, digest: Column, u: Column) -> Column:
    h = F.md5(F.concat(F.lit("page "), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(" "), digest, F.lit(" "), u.cast("string")).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def records(resolved: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """The text of each record but for its end, with fresh headers."""
    own = F.col("original").isNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.when(own, F.concat(http, F.col("payload"))).otherwise(http)
    url = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\r\n]", "%0A")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(own, F.lit("response")).otherwise(F.lit("revisit")),
        F.lit("\r\nWARC-Record-ID: "), record_id(F.col("page_id"), F.col("digest"), F.col("u")), F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), url,
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"), F.lit("\r\nX-Page-ID: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.when(own, F.lit("")).otherwise(F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), record_id(F.col("original.page"), F.col("digest"), F.col("original.u")))),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END),
    )
    return resolved.select(F.concat(head, block).alias("value"))


def write(pages: DataFrame, path: str, least: int = LEAST_BYTES) -> None:
    """Archives below path, of about FILE_BYTES each."""
    mean = pages.agg(F.avg(F.coalesce(F.octet_length("html"), F.lit(0)))).first()[0] or 0
    records(resolve(pages, least)).write.option("lineSep", END).option("maxRecordsPerFile", max(1, int(FILE_BYTES / (mean + 600)))).text(path)


def parse(content: memoryview) -> Iterator[tuple[dict[str, str], memoryview]]:
    """Headers and block of each record of one archive."""
    at, size = 0, len(content)
    while at < size:
        to = at
        while (found := bytes(content[to : to + 4096]).find(b"\r\n\r\n")) < 0:
            to += 4093
            if to >= size:
                raise ValueError(f"no end of headers after byte {at}")
        to += found
        lines = bytes(content[at:to]).decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(head["content-length"])
        yield head, content[to + 4 : to + 4 + n]
        at = to + 4 + n + 4


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row a record, with its payload (null for revisits) and the headers' digest and length."""

    def rows(batches):
        names = [x.split()[0] for x in RECORD.split(", ")]
        schema = pa.schema([(n, {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}.get(n, pa.string())) for n in names])
        for batch in batches:
            for file, content in zip(batch.column("path"), batch.column("content"), strict=True):
                out, held = [], 0
                for head, block in parse(memoryview(content.as_buffer())):
                    at = bytes(block[:4096]).find(b"\r\n\r\n") + 4
                    kind = head["warc-type"]
                    page = head.get("x-page-id", "")
                    stated = next(int(x.split(b":")[1]) for x in bytes(block[:at]).split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    body = bytes(block[at:]) if kind == "response" else None
                    out.append((file.as_py(), head["warc-record-id"], int(page) if page else None, head.get("warc-target-uri"), kind, head.get("warc-refers-to"), head["warc-payload-digest"].partition(":")[2], stated, body))
                    held += len(body or b"")
                    if held > 4 << 20 or len(out) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(rows, RECORD)


def resolved_back(records_read: DataFrame) -> DataFrame:
    """Each record with the digest and length of its full payload: a response's own, computed from its bytes; a revisit's, from the response it refers to."""
    digests = records_read.select("record_id", "page_id", "record_type", "refers_to_id", F.sha2("payload", 256).alias("o_digest"), F.octet_length("payload").cast("long").alias("o_bytes"))
    records_read = staged(digests, "records")  # archives are parsed once
    own = records_read.where("record_type = 'response'").select("record_id", F.col("page_id").alias("o_page"), "o_digest", "o_bytes")
    responses = own.select(F.col("o_page").alias("page_id"), F.col("o_bytes").alias("payload_bytes"), F.col("o_digest").alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    referred = records_read.where("record_type = 'revisit'").select("page_id", "refers_to_id")
    revisits = referred.join(own, F.col("refers_to_id") == F.col("record_id"), "left").select("page_id", F.col("o_bytes").alias("payload_bytes"), F.col("o_digest").alias("payload_digest"), F.lit("revisit").alias("record_type"), F.col("o_page").alias("refers_to"))
    return responses.unionByName(revisits)


def op8_warc_revisit(spark, sf_dir: str) -> DataFrame:
    """Writes all of pages and reads the archives back; for null and repeated ids, empty pages and repeated rows see resolve()."""
    path = new_path(spark, "warc")
    write(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return resolved_back(read(spark, path))


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY d)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN p.n >= 100 AND f.first_id IS NOT NULL AND p.page_id IS DISTINCT FROM f.first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.n >= 100 AND f.first_id IS NOT NULL AND p.page_id IS DISTINCT FROM f.first_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d AND p.n >= 100
"""
