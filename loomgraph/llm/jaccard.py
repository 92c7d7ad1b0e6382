"""N-gram Jaccard self-join by T-occurrence search with DivideSkip.

Two sets of sizes s <= t with Jaccard similarity of at least num/den share at least T = ceil(num * t / den) shingles. With all shingles in
one global order, each record's L = T - MEET last ones are its long lists and the rest its short ones; a record that reaches T must meet the
query in T - L = MEET short lists (all T, where T is smaller). Search: a query's short inverted lists are heap-merged and records that come up
that often are candidates. Probe: the inverted lists of the query's shingles, the long ones too, are searched for each candidate by binary search
until the overlap is reached or out of reach. The order is: shingles that were not seen often, by hash; then those seen often, by count. Seen
often are, first, shingles that come up repeatedly in a batch of documents and, second, those that then fill a short list; of both the
MOST_FREQUENT with the largest counts over all documents are kept. Any order gives the same links; this one keeps lists short.

links() is the whole join: every link between different sets. classes() needs their components only, which spares families of copies the pairs of
all with all:
1. Equal sets become one node (64-bit signature, checked against a second one).
2. Leaders: of short lists with more than BIG nodes, each node takes the HEADS_FROM with the smallest hashes and is probed against at most four
   leaders of each, the nodes with the largest lists. This is linear in the postings and joins most of a large family.
3. Short lists whose nodes are all of one component of (2) are dropped by an aggregate; the others are searched whole, and a query is
   compared with nodes of other components only.
4. Links of (2) and (3) give the components. Without (2) the result is the same.
Only candidates' texts are read again for their sets. Hot lists and hot leaders are cut into parts, and groups are bounded by shingles.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import SPACED, Staged, Words, batches_of, chunks, lean, mix, most_frequent, sifted, small, table
from loomgraph.llm.components import components

#: Words of a shingle and least similarity (num, den), unless a caller says otherwise.
GRAM, NUM, DEN = 5, 80, 100
#: Frequent shingles kept for the order; postings of a part of a list; shingles of a group to probe; postings of a group to search.
MOST_FREQUENT, LIST_PART, GROUP_SHINGLES, GROUP_POSTINGS = 200_000, 2048, 1 << 19, 8192
#: Short lists in which a candidate must meet the query.
MEET = 4
#: Nodes of a list beyond which it has leaders; lists of a node that look for leaders.
BIG, HEADS_FROM = 12, 8
#: Times that a shingle is seen in a batch of BATCH_BYTES before it counts as frequent there; postings of a list before its shingle counts as frequent.
SEEN_OFTEN, BATCH_BYTES, LONG_LIST = 4, 8 << 20, 4
#: Rows of an Arrow batch of texts.
TEXT_ROWS = 2000


def sets_of(words: Words, gram: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document; fewer words than a shingle are one shingle, no words none."""
    runs, out = words.grams(gram), []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= gram:
            g = np.sort(runs[a : b - gram + 1])
            out.append(g[np.concatenate([[True], g[1:] != g[:-1]])])
        elif b > a:
            h = np.array([b - a], np.uint64)
            for k in range(a, b):
                h = h * np.uint64(0xD1342543DE82EF95) + words.hash[k : k + 1]
            out.append(mix(h))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(g: np.ndarray, seed: int) -> tuple[int, int]:
    m = mix(g ^ np.uint64(0x9E3779B97F4A7C15 * (2 * seed + 1) % (1 << 64)))
    return int(m.sum(dtype=np.uint64).astype(np.int64)), int(mix(m).sum(dtype=np.uint64).astype(np.int64))


SIGNED = "row_key string, n long, node long, check long, often binary"


def sign(docs: DataFrame, gram: int, seed: int) -> DataFrame:
    """docs: row_key, text. A row for each document and, with a null n, one of frequent shingles for each batch."""

    def signed(batches):
        schema = pa.schema([("row_key", pa.string()), ("n", pa.int64()), ("node", pa.int64()), ("check", pa.int64()), ("often", pa.binary())])
        held, size = [], 0

        def often():
            if not held:
                return
            u, c = np.unique(np.concatenate(held), return_counts=True)
            u, c = u[c >= SEEN_OFTEN], c[c >= SEEN_OFTEN]
            if len(u):
                yield pa.RecordBatch.from_pylist([{"often": u.tobytes() + c.astype(np.int64).tobytes()}], schema=schema)

        for batch in batches:
            for a, b, data, offsets in chunks(batch.column("text")):
                sets = sets_of(Words(data, offsets, SPACED), gram)
                signs = [signature(g, seed) if len(g) else (None, None) for g in sets]
                cols = [batch.column("row_key").slice(a, b - a), pa.array([len(g) for g in sets], pa.int64()), pa.array([s[0] for s in signs], pa.int64()), pa.array([s[1] for s in signs], pa.int64()), pa.nulls(b - a, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, schema=schema)
                held += sets
                size += len(data)
                if size > BATCH_BYTES:
                    yield from often()
                    held, size = [], 0
        yield from often()

    return docs.mapInArrow(lean(signed), SIGNED)


def frequent(signed: DataFrame) -> np.ndarray:
    """Shingles seen often, the most frequent last; MOST_FREQUENT at most, sorted by hash, with their ranks."""

    def opened(batches):
        for batch in batches:
            for x in batch.column("often").to_pylist():
                k = len(x) // 16
                yield pa.RecordBatch.from_arrays([pa.array((np.frombuffer(x, np.uint64, k) >> np.uint64(1)).view(np.int64)), pa.array(np.frombuffer(x, np.int64, k, 8 * k))], names=["h", "c"])

    counted = signed.where("often IS NOT NULL").select("often").mapInArrow(opened, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    return ranked(counted)


def ranked(counted: DataFrame, before: np.ndarray | None = None) -> np.ndarray:
    """The MOST_FREQUENT shingles of the largest counts (h: 63 bits of the hash, c), sorted by h, with ranks by count; earlier ones stay behind new ones."""
    counts = Staged(counted, "counts")
    top = most_frequent(counts.df, "c", MOST_FREQUENT).toArrow()  # bounded; only the order of lists depends on it
    counts.drop()
    h, c = top["h"].to_numpy().view(np.uint64), top["c"].to_numpy()
    if before is not None and before.shape[1]:
        new = ~np.isin(h, before[0])
        h, c = np.concatenate([h[new], before[0]]), np.concatenate([c[new], int(c.max(initial=0)) + 1 + before[1].astype(np.int64)])
        keep = np.argsort(-c, kind="stable")[:MOST_FREQUENT]
        h, c = h[keep], c[keep]
    by_count = np.lexsort((h, c))
    rank = np.empty(len(h), np.uint64)
    rank[by_count] = np.arange(len(h), dtype=np.uint64)
    order = np.argsort(h)
    return np.array([h[order], rank[order]])


def keys(g: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The set as ascending keys of the global order: 63 bits of the hash for shingles that are not frequent, beyond those of the rank for others."""
    out = g >> np.uint64(1)
    if len(g) and often.shape[1]:
        k = np.minimum(np.searchsorted(often[0], out), often.shape[1] - 1)
        is_often = often[0][k] == out
        out[is_often] = often[1][k[is_often]] | np.uint64(1 << 63)
    return np.sort(out)


def short_lists(docs: DataFrame, gram: int, num: int, den: int, seed: int, often) -> DataFrame:
    """node, n, tokens (ascending keys of the short lists) of each document with words."""

    def listed(batches):
        order = often.value
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column("text")):
                sets = [g for g in sets_of(Words(data, offsets, SPACED), gram) if len(g)]
                least = [-(-num * len(g) // den) for g in sets]
                tokens = [keys(g, order)[: len(g) - t + min(MEET, t)] for g, t in zip(sets, least, strict=True)]
                at = np.concatenate([[0], np.cumsum([len(x) for x in tokens])]).astype(np.int32)
                flat = np.concatenate([*tokens, np.zeros(0, np.uint64)]).view(np.int64)
                cols = [pa.array([signature(g, seed)[0] for g in sets], pa.int64()), pa.array([len(g) for g in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))]
                yield pa.RecordBatch.from_arrays(cols, names=["node", "n", "tokens"])

    return docs.select("text").mapInArrow(lean(listed), "node long, n long, tokens array<long>")


def full_sets(wanted: DataFrame, gram: int, seed: int, often) -> DataFrame:
    """g, node and the whole set as ascending keys, of rows of text, g and node; a row of another text under the same key is left out."""

    def built(batches):
        order = often.value
        for batch in batches:
            node = batch.column("node").to_pylist()
            for a, b, data, offsets in chunks(batch.column("text")):
                sets = sets_of(Words(data, offsets, SPACED), gram)
                good = [i for i in range(b - a) if len(sets[i]) and signature(sets[i], seed)[0] == node[a + i]]
                part = batch.slice(a, b - a).take(pa.array(good, pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("g"), part.column("node"), pa.array([keys(sets[i], order).tobytes() for i in good], pa.binary())], names=["g", "node", "set"])

    return wanted.select("text", "g", "node").mapInArrow(lean(built), "g long, node long, set binary")


class Lists:
    """The inverted lists of a group's sets (ascending keys): one list after the other, each sorted by record."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        self.ptr = np.concatenate([[0], np.cumsum(self.size)])
        _, token = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True)
        self.token = token.astype(np.int64) * max(1, len(sets))  # of each record's shingles, in order
        self.posted = np.sort(self.token + np.repeat(np.arange(len(sets)), self.size))

    def reach(self, q: int, other: int, num: int, den: int, step: int = 256) -> bool:
        """Whether the overlap of records q and other gives num/den: the lists of the smaller one's shingles are probed for the other, rare ones first, until it is reached or out of reach."""
        if self.size[other] < self.size[q]:
            q, other = other, q
        n = int(self.size[q])
        need = -(-num * (n + int(self.size[other])) // (num + den))  # overlap o with den * o >= num * (both sizes - o)
        got, lists = 0, self.token[self.ptr[q] : self.ptr[q + 1]]
        for k in range(0, n, step):
            if got >= need or got + n - k < need:
                break
            find = lists[k : k + step] + other
            at = np.minimum(np.searchsorted(self.posted, find), len(self.posted) - 1)
            got += int((self.posted[at] == find).sum())
        return got >= need > 0


def probed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, gram: int, num: int, den: int, seed: int, often) -> DataFrame:
    """The pairs (a < b of nodes; label: what a group has in common; member: a or b) that are similar enough.

    Pairs of one label are judged together, so that a family's sets travel once; a label of more than GROUP_SHINGLES is cut by member. Sets are built
    next to the texts and travel once to each group, whole.
    """
    size = nodes.select("node", "n")
    weighed = pairs.join(size.withColumnRenamed("node", "a").withColumnRenamed("n", "x"), "a").join(size.withColumnRenamed("node", "b").withColumnRenamed("n", "y"), "b")
    held = Staged(weighed.select("a", "b", "label", "member", (F.col("x") + F.col("y")).alias("w")), "pairs")
    by_label = held.df.groupBy("label").agg(F.sum("w").alias("total")).where(F.col("total") > GROUP_SHINGLES)
    large = Staged(by_label.select("label", F.ceil(F.col("total") / GROUP_SHINGLES).alias("parts")), "large")
    total = held.df.agg(F.sum("w")).first()[0] or 0
    groups = max(1, -(-2 * total // GROUP_SHINGLES))
    part = F.pmod(F.xxhash64("member"), F.coalesce("parts", F.lit(1)))
    g = F.pmod(F.xxhash64("label", part), F.lit(groups))
    dealt = Staged(held.df.join(small(large.df), "label", "left").select("a", "b", g.alias("g")), "dealt")
    needs = dealt.df.select(F.col("b").alias("node"), "g").unionByName(dealt.df.select(F.col("a").alias("node"), "g")).distinct()
    needs = Staged(needs.join(nodes.select("node", "row_key"), "node"), "needs")
    rows = full_sets(sifted(docs, "row_key", needs.df).join(small(needs.df), "row_key"), gram, seed, often).select("g", "node", "set", F.lit(None).cast("long").alias("b"))
    rows = rows.unionByName(dealt.df.select("g", F.col("a").alias("node"), F.lit(None).cast("binary").alias("set"), "b"))

    def judged(group: pa.Table) -> pa.Table:
        given = group["set"].is_valid()
        sets, todo = group.filter(given), group.filter(pc.invert(given))
        number = {node: k for k, node in enumerate(sets["node"].to_pylist())}
        lists = Lists([np.frombuffer(x.as_buffer(), np.uint64) for x in sets["set"]])
        good = [(a, b) for a, b in zip(todo["node"].to_pylist(), todo["b"].to_pylist(), strict=True) if lists.reach(number[a], number[b], num, den)]
        return pa.table({"a": pa.array([x[0] for x in good], pa.int64()), "b": pa.array([x[1] for x in good], pa.int64())})

    found = Staged(rows.groupBy("g").applyInArrow(judged, "a long, b long"), "links")
    for x in (held, large, dealt, needs):
        x.drop()
    return found.df


def survivors(left: np.ndarray, right: np.ndarray, ids: np.ndarray, ptr: np.ndarray, size: np.ndarray, own: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which pairs of rows can reach the overlap, judged by their short lists, and are this group's to name.

    ids[ptr[i]:ptr[i+1]]: row i's short lists as ascending numbers of the order; own: whether a number's list is searched here. Both lists are complete up to
    the smaller of their last numbers. Up to there a pair shares c and the rows have a and b, so the overlap is at most c + min(|x| - a, |y| - b). A pair
    is named where its first shared list is, so it comes up once however many lists it shares.
    """
    good = np.zeros(len(left), bool)
    long = np.diff(ptr)
    most = ids.max(initial=0) + 1
    for at in range(0, len(left), 1 << 13):
        x, y = left[at : at + (1 << 13)], right[at : at + (1 << 13)]
        pair = np.concatenate([np.repeat(np.arange(len(x)), long[x]), np.repeat(np.arange(len(y)), long[y])])
        row = np.concatenate([np.repeat(x, long[x]), np.repeat(y, long[y])])
        first = np.concatenate([np.repeat(np.cumsum(long[x]) - long[x], long[x]), np.repeat(np.cumsum(long[y]) - long[y], long[y])])
        count_x = int(long[x].sum())
        run = np.concatenate([np.arange(count_x), np.arange(len(row) - count_x)]) - first
        value = ids[ptr[row] + run]
        limit = np.minimum(ids[ptr[x + 1] - 1], ids[ptr[y + 1] - 1])
        inside = value <= limit[pair]
        a = np.bincount(pair[:count_x], inside[:count_x], len(x))
        b = np.bincount(pair[count_x:], inside[count_x:], len(x))
        both = np.sort(pair * most + value)
        shared = both[1:][both[1:] == both[:-1]]
        of = shared // most
        c = np.bincount(of, minlength=len(x))
        least = np.full(len(x), most)
        starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, int)
        least[of[starts]] = shared[starts] % most
        need = -(-num * (size[x] + size[y]) // (num + den))
        named = np.append(own, False)[np.minimum(least, len(own))]
        good[at : at + (1 << 13)] = named & (c + np.minimum(size[x] - a, size[y] - b) >= need)
    return good


def occurring(streams: list[list[int]], least: int) -> list[int]:
    """The records that come up at least so often in ascending lists, by merging them on a heap."""
    if len(streams) < least:
        return []
    if len(streams) == 1:
        return streams[0]
    out, last, n = [], -1, 0
    for x in heapq.merge(*streams):
        if x == last:
            n += 1
        else:
            last, n = x, 1
        if n == least:
            out.append(x)
    return out


def search(postings: DataFrame, lists: DataFrame, num: int, den: int) -> DataFrame:
    """Candidate pairs (a < b) of nodes of different components that come up in T - L short lists, with label and member. postings: token, node, n, comp of all lists to search;
    lists: node, tokens.

    Lists go to groups by their smallest component, so those of one family mostly meet in one; a family of more than GROUP_POSTINGS is cut by list, and a list
    of more than LIST_PART is searched part against part. A node's short lists travel once to each group that it is in.
    """
    sized = Staged(postings.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("lead")), "sized")
    leads = Staged(sized.df.groupBy("lead").agg(F.sum("size").alias("total")).where(F.col("total") > GROUP_POSTINGS), "leads")
    groups = max(1, -(-(sized.df.agg(F.sum("size")).first()[0] or 0) // GROUP_POSTINGS))
    cut = F.ceil(F.col("size") / LIST_PART).cast("int")
    parts = F.ceil(F.coalesce("total", F.lit(1)) / GROUP_POSTINGS)
    whole = F.pmod(F.xxhash64("lead", F.pmod(F.xxhash64("token"), parts)), F.lit(groups))
    plan = Staged(sized.df.join(small(leads.df), "lead", "left").select("token", cut.alias("cut"), whole.alias("whole")), "plan")
    rows = postings.join(small(plan.df), "token").withColumn("own", F.pmod(F.xxhash64("node"), F.col("cut")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    g = F.when(F.col("cut") == 1, F.col("whole")).otherwise(-1 - F.abs(F.xxhash64("token", lo, hi) % (1 << 62)))
    split = F.when(lo != hi, F.col("own"))  # of lists searched part against part, the part that the node is of
    rows = Staged(rows.select(g.alias("g"), "node", "token", "n", "comp", split.alias("part")), "searched")
    needs = Staged(rows.df.groupBy("node", "g").agg(F.first("n").alias("n"), F.first("comp").alias("comp"), F.first("part").alias("part")), "needs")
    asked = Staged(needs.df.select("node").distinct(), "asked")
    pre = sifted(lists, "node", asked.df).join(small(asked.df), "node", "left_semi").groupBy("node").agg(F.first("tokens").alias("tokens"))
    have = needs.df.join(pre, "node").select("g", "node", "n", "comp", "part", "tokens", F.lit(None).cast("long").alias("token"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("n", "long"), ("comp", "long"), ("part", "int"), ("tokens", "array<long>"))]
    given = have.unionByName(rows.df.select("g", "token").distinct().select("g", F.lit(0).cast("long").alias("node"), *none, "token"))

    def merged(group: pa.Table) -> pa.Table:
        is_list = group["token"].is_valid()
        here = np.unique(group.filter(is_list)["token"].to_numpy().view(np.uint64))
        d = group.filter(pc.invert(is_list)).combine_chunks()
        order = np.lexsort((d["node"].to_numpy(), d["comp"].to_numpy()))
        d = d.take(pa.array(order))
        node, size, comp = (d[c].to_numpy() for c in ("node", "n", "comp"))
        part = d["part"].to_numpy(zero_copy_only=False)
        apart = len(part) > 0 and not np.isnan(part.astype(float)).any()
        tokens = d["tokens"].combine_chunks()
        ptr = np.concatenate([[0], np.cumsum(pc.list_value_length(tokens).to_numpy())])
        universe, ids = np.unique(tokens.flatten().to_numpy().view(np.uint64), return_inverse=True)
        searched = np.isin(universe, here)
        m = len(node)
        row = np.repeat(np.arange(m), np.diff(ptr))
        posted = np.sort(ids * m + row)  # list after list, each in the order of rows, and so of components
        beyond = np.searchsorted(comp, comp, "right")
        tail, end = np.searchsorted(posted, ids * m + beyond[row]), np.searchsorted(posted, (ids + 1) * m)  # of each row's lists the part past its own component
        record = posted % max(1, m)
        full = end > tail
        asking = np.unique(row[full & searched[ids]])
        left, right = [], []
        for q in asking.tolist():
            low, high = -(-num * size[q] // den), size[q] * den // num
            streams = []
            for k in (ptr[q] + np.flatnonzero(full[ptr[q] : ptr[q + 1]])).tolist():
                x = record[tail[k] : end[k]]
                keep = (size[x] >= low) & (size[x] <= high)
                if apart:
                    keep &= part[x] != part[q]
                if keep.any():
                    streams.append(x[keep].tolist())
            # of a smaller record T may be below MEET; then one list is asked for, and the bound and the probe judge
            found = occurring(streams, MEET if -(-num * low // den) >= MEET else 1)
            left += [q] * len(found)
            right += found
        left, right = np.array(left, np.int64), np.array(right, np.int64)
        good = survivors(left, right, ids, ptr, size, searched, num, den)
        x, y = node[left[good]], node[right[good]]
        return pa.table({"a": pa.array(np.minimum(x, y)), "b": pa.array(np.maximum(x, y))})

    found = Staged(given.groupBy("g").applyInArrow(merged, "a long, b long").distinct(), "candidates")
    low = Staged(found.df.groupBy("b").agg(F.min("a").alias("low")).select(F.col("b").alias("a"), "low"), "low")
    out = Staged(found.df.join(small(low.df), "a", "left").select("a", "b", F.coalesce("low", "a").alias("label"), F.col("b").alias("member")), "candidates")
    for x in (sized, leads, plan, rows, needs, asked, found, low):
        x.drop()
    return out.df


def leaders(postings: DataFrame) -> DataFrame:
    """Pairs (a < b) of a node and a leader of one of its large lists; label: the first leader of that list, member: the node. postings: token, node, and k, the nodes of the list."""
    of_node = postings.groupBy("node").agg(F.sum("k").alias("rank"), F.slice(F.array_sort(F.collect_list(F.struct(F.xxhash64("token").alias("h"), "token"))), 1, HEADS_FROM).alias("t"))
    rows = Staged(of_node.select("node", "rank", F.explode("t.token").alias("token")), "asked")
    best = [F.max(F.when(F.pmod(F.xxhash64("node"), F.lit(4)) == q, F.struct("rank", "node")))["node"] for q in range(4)]
    heads = Staged(rows.df.groupBy("token").agg(F.array_distinct(F.array_compact(F.array(*best))).alias("heads")), "heads")
    met = rows.df.join(small(heads.df), "token").select("node", F.array_min("heads").alias("label"), F.explode("heads").alias("head")).where("node <> head")
    met = met.groupBy("node", "head").agg(F.min("label").alias("label"))
    pairs = met.select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b"), F.struct("label", F.col("node").alias("member")).alias("x"))
    out = Staged(pairs.groupBy("a", "b").agg(F.min("x").alias("x")).select("a", "b", "x.label", "x.member"), "near")
    rows.drop()
    heads.drop()
    return out.df


def row_key(key: Column, text: Column) -> Column:
    """The key as text; where it is null, a zero character and a hash of the text."""
    return F.coalesce(key.cast("string"), F.concat(F.lit("\x00"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))


def has_key(name: Column) -> Column:
    return ~F.startswith(name, F.lit("\x00"))


class Join:
    """The nodes of docs (row_key, text; ident: the key of a row or null) and their short lists, staged."""

    def __init__(self, docs: DataFrame, ident: Column, gram: int, num: int, den: int):
        self.docs, self.gram, self.num, self.den = docs, gram, num, den
        share = docs.sparkSession.sparkContext.broadcast
        for seed in range(8):
            self.seed, self.signed = seed, Staged(sign(docs, gram, seed), "signed")
            own = self.signed.df.where("n > 0")
            smallest = F.min_by("row_key", F.coalesce(F.struct(ident.isNull().alias("no"), ident.alias("id"))))
            self.nodes = Staged(own.groupBy("node").agg(F.min("check").alias("lo"), F.max("check").alias("hi"), smallest.alias("row_key"), F.min(ident).alias("least"), F.count(F.lit(1)).alias("copies"), F.min("n").alias("n")), "nodes")
            if self.nodes.df.where("lo <> hi").isEmpty():
                break
            self.signed.drop()
            self.nodes.drop()
        else:
            raise RuntimeError("signatures of different sets kept colliding")
        seen = frequent(self.signed.df)
        drafts = Staged(short_lists(docs, gram, num, den, seed, share(seen)), "lists")
        long = drafts.df.select(F.explode("tokens").alias("h")).where("h >= 0").groupBy("h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= LONG_LIST)
        self.often = share(ranked(long, seen))
        drafts.drop()
        self.lists = Staged(short_lists(docs, gram, num, den, seed, self.often), "lists")
        posted = self.lists.df.select("node", "n", F.explode("tokens").alias("token"))
        met = Staged(posted.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("token"), "met")
        every = Staged(sifted(posted, "token", met.df).join(small(met.df), "token").select("token", "node", "n").distinct(), "posted")  # only lists of several nodes
        met.drop()
        size = Staged(every.df.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > BIG), "large")
        self.postings, self.large = every, size

    def probe(self, pairs: DataFrame) -> DataFrame:
        return probed(pairs, self.nodes.df, self.docs, self.gram, self.num, self.den, self.seed, self.often)

    def led(self) -> DataFrame:
        """Links of nodes with leaders of their large lists."""
        return self.probe(leaders(self.postings.df.join(small(self.large.df), "token")))

    def rest(self, comps: DataFrame | None = None) -> DataFrame:
        """All links, or all between nodes of different components (node, label)."""
        if comps is None:
            rows = self.postings.df.select("token", "node", "n", F.col("node").alias("comp"))
            return self.probe(search(rows, self.lists.df, self.num, self.den))
        rows = Staged(self.postings.df.join(small(comps), "node", "left").select("token", "node", "n", F.coalesce("label", "node").alias("comp")), "placed")
        open_lists = Staged(rows.df.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token"), "open")
        held = Staged(rows.df.join(small(open_lists.df), "token"), "held")
        rows.drop()
        open_lists.drop()
        return self.probe(search(held.df.select("token", "node", "n", "comp"), self.lists.df, self.num, self.den))

    def drop(self) -> None:
        for x in (self.lists, self.postings, self.large):
            x.drop()


def keyed(docs: DataFrame, text: str, key: str) -> tuple[DataFrame, Column]:
    kind = docs.schema[key].dataType
    rows = docs.select(row_key(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("row_key"), F.col(f"`{text}`").alias("text"))
    return rows, F.when(has_key(F.col("row_key")), F.col("row_key").cast(kind))


def links(docs: DataFrame, text: str = "text", key: str = "doc_id", gram: int = GRAM, num: int = NUM, den: int = DEN) -> tuple[DataFrame, DataFrame]:
    """The whole join: (a, b: the nodes of every two different sets that link) and (row_key, n_shingles, node, n_links of each row of docs).

    n_links counts other rows: those of linked nodes and the other copies of its own. The pairs are as many as there are links between different
    sets; copies are not expanded. Rows without words have a null node and no links. For the rest see classes().
    """
    rows, ident = keyed(docs, text, key)
    with batches_of(docs.sparkSession, TEXT_ROWS):
        join = Join(rows, ident, gram, num, den)
        found = join.rest()
        join.drop()
    size = join.nodes.df.select("node", "copies")
    both = found.select(F.col("a").alias("node"), F.col("b").alias("o")).unionByName(found.select(F.col("b").alias("node"), F.col("a").alias("o")))
    far = both.join(size.withColumnRenamed("node", "o"), "o").groupBy("node").agg(F.sum("copies").alias("far"))
    n = size.join(far, "node", "left").select("node", (F.coalesce("far", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    members = join.signed.df.where("n IS NOT NULL").select("row_key", F.col("n").alias("n_shingles"), "node").join(n, "node", "left")
    return found, members.select("row_key", "n_shingles", "node", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", gram: int = GRAM, num: int = NUM, den: int = DEN, lead: bool = True) -> DataFrame:
    """row_key, n_shingles, component_id, label for each row of docs: its set's size, the smallest key reachable by links, itself included, and
    the name of its component, null where the set is empty.

    row_key is the key as text (for null keys see row_key()). Words are lower-cased (A-Z) runs without ASCII white space. A text of fewer words than a shingle has one
    shingle, the whole; null texts and texts without words have none and link with nothing, so their component is their own key. Repeated
    rows are copies; null keys are never the smallest unless no other is reachable. Lengths, ties and hot groups change nothing; no rows give none.
    Columns besides text and key are ignored. lead: whether leaders join large families first; the result is the same without, at the cost of all
    pairs of a family.
    """
    rows, ident = keyed(docs, text, key)
    with batches_of(docs.sparkSession, TEXT_ROWS):
        join = Join(rows, ident, gram, num, den)
        found = join.led() if lead else None
        comps = Staged(components(found), "components") if lead else None
        more = join.rest(comps.df if lead else None)
        join.drop()
    if lead:
        comps.drop()
    label = Staged(components(found.unionByName(more) if lead else more), "components")
    named = Staged(join.nodes.df.select("node", "least").join(small(label.df), "node", "left").select("node", "least", F.coalesce("label", "node").alias("label")), "named")
    of_label = Staged(named.df.groupBy("label").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("size")), "least")
    many = of_label.df.where("size > 1").select("label", F.col("component_id").alias("first"))
    ends = Staged(named.df.join(small(many), "label", "left").select("node", F.coalesce("first", "least").alias("component_id"), "label"), "ends")
    for x in (label, named, of_label):
        x.drop()
    signed = join.signed.df.where("n IS NOT NULL").select("row_key", "n", "node")
    out = signed.where("n > 0").join(small(ends.df), "node").select("row_key", F.col("n").alias("n_shingles"), "component_id", "label")
    return out.unionByName(signed.where("n = 0").select("row_key", F.col("n").alias("n_shingles"), ident.alias("component_id"), F.lit(None).cast("long").alias("label")))


def op10_divideskip_jaccard(spark, sf_dir: str) -> DataFrame:
    """Components of all documents; for null ids and texts, short texts, repeated rows and empty tables see classes()."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = classes(docs, gram=4, num=85, den=100)
    return found.select(F.when(has_key(F.col("row_key")), F.col("row_key").cast("long")).alias("doc_id"), "n_shingles", "component_id")


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
OP10_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[j : j + least(len(w), 4) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS j FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM k JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * o >= 85 * (p.n + q.n - o)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.y FROM r JOIN l ON r.b = l.x),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.a = d.doc_id
"""
