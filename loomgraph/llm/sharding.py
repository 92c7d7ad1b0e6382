"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Shards own virtual nodes on a ring of 60-bit positions; a row belongs to the arc that ends at the next virtual node. Every shard has a
capacity, and rows that find their shard full continue clockwise to the next distinct shard with room. All rows of an arc meet the shards
in the same order, so who goes where depends on the number of rows of each arc alone: the driver gets one count per cell of the ring (at
most 2**CELL_BITS + shards * vnodes of them, whatever the input), plans ranges of ranks, and the rows take their ranks by a window inside
their cell. Cells are equal parts of a hash, so no source and no group of copies makes one of them large. Where rows have an order of their own, slots
follow it inside each shard: a slot is the shard's rows in earlier stretches of that order, from counts, and a rank inside the stretch.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import Staged, table

SHARDS, VNODES, CELL_BITS = 24, 64, 14
BITS = 60
#: Least rows of a stretch of an order, and about the most stretches.
STRETCH, STRETCHES = 4096, 1024


def position(key: str) -> int:
    return int(hashlib.md5(key.encode()).hexdigest()[:15], 16)


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(position, shard) of all virtual nodes in clockwise order."""
    return sorted((position(f"shard {s} node {v}"), s) for s in range(shards) for v in range(vnodes))


def key_position(key: Column, *ties: Column) -> Column:
    """A place on the ring by the key and, where several rows share one or lack it, by what tells them apart."""
    text = F.concat_ws(" ", F.coalesce(key.cast("string"), F.lit("")), *[t.cast("string") for t in ties])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def plan(points: list[tuple[int, int]], counts: list[int], shards: int) -> list[list[tuple[int, int, int]]]:
    """For each arc the ranges (first rank, shard, slot of that rank). Capacities differ by one at most and sum to the rows, so counts do too.

    Round r: the rows of each arc that have no place yet ask the r-th distinct shard clockwise; a shard takes them arc by arc in ring order.
    """
    total, n = sum(counts), len(points)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used, done, out = [0] * shards, [0] * n, [[] for _ in range(n)]
    order = []
    for a in range(n):
        seen: dict[int, None] = {}
        for k in range(n):
            seen.setdefault(points[(a + k) % n][1])
            if len(seen) == shards:
                break
        order.append(list(seen))
    for r in range(shards):
        for a in range(n):
            if (left := counts[a] - done[a]) and r < len(order[a]):
                s = order[a][r]
                if take := min(left, room[s] - used[s]):
                    out[a].append((done[a], s, used[s]))
                    done[a] += take
                    used[s] += take
    return out


def shard(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, key: str = "doc_id", ties: tuple[Column, ...] = (), order: str | None = None) -> DataFrame:
    """docs with shard (0 to shards - 1) and slot (gapless from 0 in each shard); counts of shards differ by one at most.

    Null keys count as the empty text; rows that share a key are rows like others and are told apart, and spread over the ring, by ties. No rows
    give no rows. Columns named shard or slot are replaced; all others stay, whatever their names. order: a column of distinct numbers from 0 to the rows
    (about); shards are the same with and without it, but slots follow it.
    """
    spark = docs.sparkSession
    own = {c: f"column{i}" for i, c in enumerate(docs.columns)}  # names that none here has
    names = [f"tie{i}" for i in range(len(ties))]
    docs, key = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in own.items()], *[t.alias(n) for t, n in zip(ties, names, strict=True)]), own[key]
    order = [own[order]] if order else []
    points = ring(shards, vnodes)
    width = BITS - CELL_BITS
    starts = [p for p, _ in points]
    cells = []
    for c in range(1 << CELL_BITS):
        lo = bisect_left(starts, c << width)
        cells.append((c, lo, starts[lo : bisect_left(starts, (c + 1) << width)]))
    lookup = F.broadcast(spark.createDataFrame(cells, "__c int, __lo int, __points array<bigint>"))

    def placed(df: DataFrame) -> DataFrame:
        df = df.withColumn("__p", key_position(F.col(key), *map(F.col, names))).withColumn("__c", F.shiftright("__p", width).cast("int")).join(lookup, "__c")
        arc = F.col("__lo") + F.size(F.filter("__points", lambda x: x < F.col("__p")))
        return df.withColumn("__a", arc % len(points)).drop("__lo", "__points")

    counted = placed(docs.select(key, *names)).groupBy("__a", "__c").count().collect()  # bounded by the ring, not by the rows
    per_cell = sorted((r["__a"], r["__c"], r["count"]) for r in counted)
    counts = [0] * len(points)
    for a, _, n in per_cell:
        counts[a] += n
    ranges = plan(points, counts, shards)
    rows, before = [], [0] * len(points)
    for a, c, n in per_cell:
        lo, hi = before[a], before[a] + n
        of_arc = ranges[a]
        ends = [x[0] for x in of_arc[1:]] + [counts[a]]
        rows.append((a, c, [(max(f, lo) - lo, s, base + max(f, lo) - f) for (f, s, base), to in zip(of_arc, ends, strict=True) if f < hi and to > lo]))
        before[a] = hi
    pieces = F.broadcast(spark.createDataFrame(rows, "__a int, __c int, __r array<struct<first: bigint, shard: int, slot: bigint>>"))
    rank = F.row_number().over(Window.partitionBy("__a", "__c").orderBy("__p", key, *names, *order)).cast("long") - 1
    out = placed(docs).withColumn("__k", rank).join(pieces, ["__a", "__c"])
    out = out.withColumn("__x", F.element_at(F.filter("__r", lambda x: x["first"] <= F.col("__k")), -1))
    kept = [F.col(k).alias(c) for c, k in own.items() if c.lower() not in ("shard", "slot")]
    if not order:
        return out.select(*kept, F.col("__x.shard").alias("shard"), (F.col("__x.slot") + F.col("__k") - F.col("__x.first")).alias("slot"))
    stretch = F.floor(F.col(order[0]) / max(STRETCH, -(-sum(counts) // STRETCHES)))
    out = Staged(out.select(*own.values(), F.col("__x.shard").alias("__s"), stretch.alias("__g")), "shards").df
    earlier = F.sum("__n").over(Window.partitionBy("__s").orderBy("__g").rowsBetween(Window.unboundedPreceding, -1))
    first = out.groupBy("__s", "__g").agg(F.count(F.lit(1)).alias("__n")).select("__s", "__g", F.coalesce(earlier, F.lit(0)).alias("__first"))
    place = F.row_number().over(Window.partitionBy("__s", "__g").orderBy(order[0])).cast("long") - 1
    out = out.withColumn("__k", place).join(first, ["__s", "__g"])
    return out.select(*kept, F.col("__s").alias("shard"), (F.col("__first") + F.col("__k")).alias("slot"))


def op5_shard_ring(spark, sf_dir: str) -> DataFrame:
    """Shards of all documents under the law `rows`; null texts count as empty, null and repeated ids are told apart by their texts, empty tables give none."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"))
    return shard(rows, ties=(F.col("text_crc32"), F.col("size"))).select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
