"""Mixing sources to target weights by Pfair scheduling.

Each source's rows form blocks. In a fluid schedule all sources that still have blocks share the slots in proportion to their exact weights;
an exhausted source leaves it and the others share what it had. Block i of a source has as its release the slot in which its fluid share
begins, and as its deadline the slot by whose start that share is complete, and in every slot the released block with the earliest deadline
goes next. The fluid schedule fills each slot, so every block gets a slot in its window, and after any number of slots a source has had less
than one block more or less than its fluid share. Until the first source is exhausted that share is its weight times the slots.

The driver computes the schedule from the counts of rows alone (three numbers a block, handed over in pieces of bounded size); a row finds its
slot by its source and its block's number.

Ranks inside a source come from counts of hash buckets, never from one window over a whole source, so a source may hold any share of the
rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce
from itertools import islice
from math import lcm

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import staged, table

#: Rows of a block, exponent of the default targets, least buckets of a source and rows of a bucket (about), most sources.
BLOCK_ROWS, TEMPER, BUCKETS, BUCKET_ROWS, MOST_SOURCES = 8, 0.9, 1024, 65_536, 100_000
#: Blocks in a row of the schedule's table, rows of that table that the driver holds and broadcasts.
RUN, PIECE = 256, 4096


def quantised(weights: dict[str, float], slots: int) -> dict[str, int]:
    """Shares of the slots of one period by largest remainder; every positive weight gets one at least."""
    total = sum(weights.values())
    exact = {s: w / total * slots for s, w in weights.items() if w > 0}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    by_rest = sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))
    k = 0
    while sum(out.values()) < slots:
        out[by_rest[k % len(by_rest)]] += 1
        k += 1
    while sum(out.values()) > slots:
        out[max(out, key=lambda s: (out[s], s))] -= 1
    return out


class Schedule:
    """The slots of all blocks: earliest deadline first among released blocks, by exact weights; exhausted sources leave it.

    weights (above 0) and blocks (1 at least) of each source. horizon: the whole slots before the first source is exhausted.
    """

    def __init__(self, weights: dict[str, float], blocks: dict[str, int]):
        exact = {s: Fraction(w) for s, w in weights.items()}
        unit = lcm(*(f.denominator for f in exact.values()))
        self.weight = {s: int(f * unit) for s, f in exact.items()}
        self.blocks = {s: blocks[s] for s in self.weight}
        self.slots = sum(self.blocks.values())
        order = sorted(self.weight, key=lambda s: (Fraction(self.blocks[s], self.weight[s]), s))
        self.ends = [(self.blocks[s], self.weight[s]) for s in order]
        self.gone, self.active = [0], [sum(self.weight.values())]  # blocks of the first j sources to be exhausted, weight of the others
        for b, w in self.ends:
            self.gone.append(self.gone[-1] + b)
            self.active.append(self.active[-1] - w)
        self.horizon = self.ends[0][0] * self.active[0] // self.ends[0][1] if order else 0

    def share(self, s: str, i: int) -> tuple[int, int]:
        """Floor and ceiling of the time at which the fluid schedule has given source s its first i blocks."""
        w, lo, hi = self.weight[s], 0, len(self.ends)
        while lo < hi:
            mid = (lo + hi) // 2
            b, v = self.ends[mid]
            lo, hi = (mid + 1, hi) if b * w <= i * v else (lo, mid)
        x = i * self.active[lo]
        return self.gone[lo] + x // w, self.gone[lo] - (-x // w)

    def __iter__(self) -> Iterator[tuple[str, int, int, int, int]]:
        """(source, block, slot, release, deadline) in the order of slots; memory for one block a source."""
        ready = [(self.share(s, 1)[1], s, 0, 0) for s in self.weight]
        heapq.heapify(ready)
        later: list[tuple[int, int, str, int]] = []
        for t in range(self.slots):
            while later and later[0][0] <= t:
                release, deadline, s, i = heapq.heappop(later)
                heapq.heappush(ready, (deadline, s, i, release))
            deadline, s, i, release = heapq.heappop(ready)
            assert release <= t < deadline
            yield s, i, t, release, deadline
            if i + 1 < self.blocks[s]:
                heapq.heappush(later, (self.share(s, i + 1)[0], self.share(s, i + 2)[1], s, i + 1))

    def runs(self) -> Iterator[tuple[str, int, list[int], list[int], list[int]]]:
        """(source, run, slots, releases, deadlines) of each RUN blocks. Where sources outlast the horizon, its slot stays empty, and marks it."""
        open_runs: dict[str, tuple[list, list, list]] = {}
        for s, i, t, release, deadline in self:
            run = open_runs.setdefault(s, ([], [], []))
            for x, v in zip(run, (t + (t >= self.horizon), release + (release >= self.horizon), deadline + (deadline > self.horizon)), strict=True):
                x.append(v)
            if len(run[0]) == RUN or i + 1 == self.blocks[s]:
                yield (s, i // RUN, *open_runs.pop(s))


def edf(shares: dict[str, int]) -> dict[str, list[int]]:
    """The slots of each source's blocks in one period of as many slots as there are shares."""
    out: dict[str, list[int]] = {s: [] for s in shares}
    for s, _, t, _, _ in Schedule(shares, shares):
        out[s].append(t)
    return out


def tempered(rows: dict[str, int], power: float = TEMPER) -> dict[str, float]:
    """Targets that flatten the natural shares."""
    return {s: n**power for s, n in rows.items()}


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, source: str = "source", key: str = "doc_id", block_rows: int = BLOCK_ROWS, ties: tuple[Column, ...] = ()) -> DataFrame:
    """docs with block, release, deadline, slot, position and selected. ties: what tells rows of one key apart, so that they too are spread over buckets.

    weights: target of each source (None: of rows without a source); by default the rows of each source to the power TEMPER. Sources
    without rows are left out and the rest scaled up. position: place in the interleaved order, which holds all rows; exhausted sources leave
    it and the others share their slots by their weights. selected: its slot comes before the first source is exhausted, so up to there all
    targets hold within a block; later rows have selected = false, and the slot between them and the others stays empty. Sources of no
    weight have null slots and positions. Null keys and repeated keys are rows like others. Columns of the new names are replaced; all others
    stay.
    """
    spark = docs.sparkSession
    own = {c: f"column{i}" for i, c in enumerate(docs.columns)}  # names that none here has
    docs, names = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in own.items()], *[t.alias(f"tie{i}") for i, t in enumerate(ties)]), [f"tie{i}" for i in range(len(ties))]
    source, key = own[source], own[key]
    docs = docs.withColumn("__s", F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("-")))
    totals = docs.groupBy("__s").count().limit(MOST_SOURCES + 1).collect()
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources; group them before mixing")
    rows = {r["__s"]: r["count"] for r in totals}
    buckets = max(BUCKETS, max(rows.values(), default=0) // BUCKET_ROWS)
    base = docs.withColumn("__b", F.pmod(F.xxhash64(key, *names), F.lit(buckets)))
    counts = base.groupBy("__s", "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__s").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__s", "__b", before.alias("__before"))
    target = tempered(rows) if weights is None else {("-" if s is None else f"={s}"): w for s, w in weights.items()}
    target = {s: w for s, w in target.items() if rows.get(s) and w > 0}
    plan = Schedule(target, {s: -(-rows[s] // block_rows) for s in target})
    runs, pieces = plan.runs(), []
    while (piece := list(islice(runs, PIECE))) or not pieces:
        df = spark.createDataFrame(piece, "__s string, __run bigint, __slots array<bigint>, __releases array<bigint>, __deadlines array<bigint>", verifySchema=False)
        more = len(piece) == PIECE or pieces
        pieces.append(staged(df, "schedule") if more else F.broadcast(df))  # PIECE rows at most; beyond, a join
        if len(piece) < PIECE:
            break
    slots = reduce(DataFrame.unionByName, pieces)
    rank = F.row_number().over(Window.partitionBy("__s", "__b").orderBy(F.xxhash64(key), key, *names)) - 1
    out = base.withColumn("__k0", rank).join(offsets, ["__s", "__b"])
    place = F.col("__before") + F.col("__k0")
    out = out.withColumn("__i", F.floor(place / block_rows).cast("long")).withColumn("__r", place % block_rows)
    out = out.withColumn("__run", F.expr(f"__i div {RUN}")).join(slots, ["__s", "__run"], "left")
    at = (F.col("__i") % RUN).cast("int")
    slot = F.get("__slots", at)
    new = {
        "block": F.col("__i"), "release": F.get("__releases", at), "deadline": F.get("__deadlines", at), "slot": slot, "position": slot * block_rows + F.col("__r"),
        "selected": F.coalesce(slot < plan.horizon, F.lit(False)),
    }
    return out.select(*[F.col(k).alias(c) for c, k in own.items() if c.lower() not in new], *[v.alias(c) for c, v in new.items()])


def op3_pfair_mix(spark, sf_dir: str) -> DataFrame:
    """The schedule of all documents; for null and repeated keys, null sources and empty tables see mix_sources()."""
    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source"))
