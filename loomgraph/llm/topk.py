"""Exact top-k inner products by dual-tree search over cover trees.

Vectors are dealt to the nearest of at most PIVOTS pivots; cells of more than WHOLE parts are dealt again, by pivots for what is left of a
vector when its pivots so far are taken off, until cells are small or LEVELS is reached. So cells form a cover tree over all data, each with its center
(the sum of its pivots) and radius, and the pivots are few at any size. The rows of a cell, in parts by hash, form cover
trees of their own; queries form trees by groups. For a query node with center q and covering radius Rq, and a data node with center c and radius Rc,
no inner product exceeds q.c + |q| Rc + |c| Rq + Rq Rc, so a pair of nodes is left out when that is below the worst k-th score of the query
group. First every query group goes down to the cells that promise most, which gives it a k-th score; then groups and cells go down together, level by
level, as long as the bound of the pair reaches that score, and the rest never meet. What meets is scored by matrix products in the fastest type that is exact for
integers of that size. All values are integers and all bounds are rounded up, so the result is exact.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import Staged, small, table

#: Pivots of a level, levels, least and most rows of a part of data, rows of a query group, groups that meet a part in one task, rows of a leaf, cells that
#: a group goes to first, and the rows these have at least, parts' rows of a cell that isn't split by further pivots, data rows of one matrix product.
PIVOTS, LEVELS, LEAST_PART, PART, GROUP, BLOCK, LEAF, FIRST, FIRST_ROWS, WHOLE, CHUNK = 64, 8, 512, 1 << 18, 256, 2048, 128, 4, 256, 4, 2048
SCALE, DEPTH = 256, 64


def exact(norms: float) -> type:
    """The fastest type that holds inner products of integer vectors exactly, given the product of their norms: no partial sum is larger (Cauchy-Schwarz)."""
    return np.float32 if norms < (1 << 24) - 1 else np.float64 if norms < (1 << 53) * (1 - 1e-9) else np.int64


class Cover:
    """A cover tree: the points of a node lie within its radius of its center, which is one of them; radii shrink by half from level to level."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x, self.typed = x, {}
        self.center, self.radius, self.child, self.points = [], [], [], []
        self.square = np.concatenate([(x[i : i + 8192].astype(np.float64) ** 2).sum(axis=1) for i in range(0, max(len(x), 1), 8192)])
        self.norms = np.sqrt(self.square)
        self.most = float(self.norms.max()) if len(x) else 0.0
        self.by_products = exact(4 * self.most**2) is not np.int64  # else squares don't sum exactly
        if len(x):
            self._build(np.arange(len(x)), 0, None, leaf, 0)
        self.center = np.array(self.center, np.int64)
        self.radius = np.array(self.radius, np.float64)
        self.norm = self.norms[self.center] if len(x) else np.zeros(0)
        self.ends = np.array([p is not None for p in self.points], bool)
        self.size = np.array([0 if p is None else len(p) for p in self.points], np.int64)

    def of_type(self, kind: type) -> np.ndarray:
        if kind not in self.typed:
            self.typed[kind] = self.x.astype(kind)
        return self.typed[kind]

    def _distances(self, rows: np.ndarray):
        """The distances of rows to a row, as a function of that row."""
        if not self.by_products:
            x = self.x[rows]
            return lambda c: np.sqrt(((x - self.x[c]).astype(np.float64) ** 2).sum(axis=1))
        f, square = self.of_type(exact(self.most**2)), self.square[rows]
        mine = f[rows]
        return lambda c: np.sqrt(square + self.square[c] - 2 * (mine @ f[c]).astype(np.float64))

    def _build(self, rows: np.ndarray, root: int, dist: np.ndarray | None, leaf: int, depth: int) -> int:
        c = int(rows[root])
        if dist is None:
            dist = self._distances(rows)(c)
        k, r = len(self.center), float(dist.max())
        self.center.append(c)
        self.radius.append(r * (1 + 1e-9))
        self.child.append([])
        self.points.append(None)
        if len(rows) <= leaf or r == 0 or depth == DEPTH:
            self.points[k] = rows
            return k
        # children: centers further than half the radius from each other, each with the points it is nearest to
        near, owner = dist.copy(), np.zeros(len(rows), np.int64)
        centers, to = [root], self._distances(rows)
        most = min(64, -(-2 * len(rows) // leaf))
        while near.max() > r / 2 and len(centers) < most:
            j = int(near.argmax())
            d = to(rows[j])
            closer = d < near
            owner[closer] = len(centers)
            near[closer] = d[closer]
            centers.append(j)
        del to
        for i, j in enumerate(centers):
            mine = np.flatnonzero(owner == i)
            if len(mine) == len(rows):
                self.points[k] = rows
                return k
            self.child[k].append(self._build(rows[mine], int(np.flatnonzero(mine == j)[0]), near[mine], leaf, depth + 1))
        return k


class Best:
    """The k best (score, smaller id) of each query of a group."""

    def __init__(self, n: int, k: int):
        self.k, self.heaps = k, [[] for _ in range(n)]

    def worst(self, q: int) -> float:
        h = self.heaps[q]
        return h[0][0] if len(h) == self.k else -np.inf

    def offer(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        h = self.heaps[q]
        if len(ids) > self.k:  # no others than its k best can get in, ties included
            first = np.lexsort((ids, -scores))[: self.k]
            scores, ids = scores[first], ids[first]
        for s, i in zip(scores.tolist(), ids.tolist(), strict=True):
            if len(h) < self.k:
                heapq.heappush(h, (s, -i))
            elif (s, -i) > h[0]:
                heapq.heapreplace(h, (s, -i))


def dual(queries: Cover, q_ids: np.ndarray, data: Cover, d_ids: np.ndarray, best: Best) -> int:
    """Offers every candidate that can matter; returns the node pairs visited. A query is no candidate of its own.

    A query node meets the data nodes level by level, many at a time; the queries of a leaf then meet the data leaves left by a bound of their own,
    and what is left is scored by matrix products of a type that is exact.
    """
    if not len(queries.center) or not len(data.center):
        return 0
    kind, visited = exact(queries.most * data.most), 0
    xq, xd = queries.of_type(kind), data.of_type(kind)
    none = np.iinfo(np.int64).min if kind is np.int64 else -np.inf
    worst = lambda q: w if (w := best.worst(q)) > -np.inf else none
    lows = np.array([worst(q) for q in range(len(xq))], kind)
    under: dict[int, np.ndarray] = {}

    def members(a: int) -> np.ndarray:
        if a not in under:
            under[a] = queries.points[a] if queries.points[a] is not None else np.concatenate([members(c) for c in queries.child[a]])
        return under[a]

    def raised_bounds(rows: np.ndarray, norm: np.ndarray, rq: float, b: np.ndarray) -> np.ndarray:
        """For each of rows, as the center of a ball of radius rq, and each data node a number that no inner product exceeds."""
        dot = (xq[rows] @ xd[data.center[b]].T).astype(np.float64)
        more = norm[:, None] * data.radius[b] + (data.norm[b] * rq + rq * data.radius[b])
        return np.floor(dot + more + (np.abs(dot) + more) * 1e-12 + 1e-6)

    def bound(a: int, b: np.ndarray) -> np.ndarray:
        return raised_bounds(queries.center[a : a + 1], queries.norm[a : a + 1], queries.radius[a], b)[0]

    def reach(a: int, front: np.ndarray) -> np.ndarray:
        """The data leaves below the nodes of front that a may need."""
        nonlocal visited
        out, low = [], lows[members(a)].min()
        while len(front):
            visited += len(front)
            front = front[bound(a, front) >= low]
            end = data.ends[front]
            out.append(front[end])
            front = np.array([c for b in front[~end].tolist() for c in data.child[b]], np.int64)
        return np.concatenate(out) if out else front

    def score(rows: np.ndarray, cols: np.ndarray) -> None:
        for i in range(0, len(cols), CHUNK):
            part = cols[i : i + CHUNK]
            scores, ids = xq[rows] @ xd[part].T, d_ids[part]
            for j in np.flatnonzero(scores.max(axis=1) >= lows[rows]).tolist():
                q = int(rows[j])
                at = np.flatnonzero(scores[j] >= lows[q])
                at = at[ids[at] != q_ids[q]]
                if len(at):
                    best.offer(q, scores[j][at].astype(np.int64), ids[at])
                    lows[q] = worst(q)

    def seed(a: int, front: np.ndarray) -> int:
        """Scores the most promising data leaf; returns it."""
        nonlocal visited
        while True:
            visited += len(front)
            b = int(front[bound(a, front).argmax()])
            if data.ends[b]:
                score(members(a), data.points[b])
                return b
            front = np.array(data.child[b])

    stack = [(0, np.zeros(1, np.int64))]
    while stack:
        a, front = stack.pop()
        rows = members(a)
        if queries.child[a]:
            if lows[rows].min() > none:
                front = reach(a, front)
            stack += [(c, front) for c in queries.child[a] if len(front)]
            continue
        done = seed(a, front) if lows[rows].min() == none else -1
        leaves = reach(a, front)
        leaves = leaves[leaves != done]
        if not len(leaves):
            continue
        tried = rows[:: -(-len(rows) // 8)]
        if (raised_bounds(tried, queries.norms[tried], 0.0, leaves) >= lows[tried][:, None]).mean() > 0.5:  # further bounds cost more than they save
            score(rows, np.concatenate([data.points[b] for b in leaves.tolist()]))
            continue
        tops = raised_bounds(rows, queries.norms[rows], 0.0, leaves)
        order = np.argsort(-tops.max(axis=0), kind="stable")  # the most promising are scored first
        leaves, tops = leaves[order], tops[:, order]
        before = np.cumsum(data.size[leaves]) - data.size[leaves]
        edges = np.unique(np.concatenate([[0, len(leaves)], np.searchsorted(before, np.arange(CHUNK // 8, before[-1] + 1, CHUNK))]))
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            need = tops[:, lo:hi] >= lows[rows][:, None]
            some = need.any(axis=0)
            if some.any():
                score(rows[need.any(axis=1)], np.concatenate([data.points[b] for b in leaves[lo:hi][some].tolist()]))
    return visited


def integers(vectors: DataFrame, vector: str, key: str, scale: int) -> DataFrame:
    """id and x (floor(scale * component)) of vectors without null, NaN or infinite components; rows without an id or components take no part."""
    v = F.col(f"`{vector}`")
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")), F.lit(False)))
    return vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.transform(v, lambda e: F.floor(e.cast("double") * scale)).alias("x"), sound.alias("ok")).where("ok AND id IS NOT NULL").select("id", "x")


def unpack(column, kind: type = np.int64) -> np.ndarray:
    """A list column as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(kind)


def cells(data: DataFrame, limit: int) -> tuple[DataFrame, DataFrame, int]:
    """Rows (id, x, u) with the path of their cell, and all cells: path, parent, n, r (covering radius), c (center), cn (its norm), leaf; and the
    number of levels.

    A level takes at most PIVOTS pivots, from a bounded sample by hash of the rows still to be dealt; every row is placed. A cell stays whole where it
    has no more than limit rows, after LEVELS levels, and where a level splits no row off (copies).
    """
    spark, done, tables, pivots, before = data.sparkSession, [], [], [], None
    todo, fan = data.withColumn("path", F.array().cast("array<int>")), PIVOTS
    kind = data.schema["x"].dataType.simpleString()
    for level in range(1, LEVELS + 1):
        sample = todo.orderBy(F.xxhash64("id", F.lit(level))).limit(fan).select("x", "path").collect()
        pivots.append(np.array([np.array(r["x"]) - sum(p[c] for p, c in zip(pivots, r["path"], strict=True)) for r in sample], np.int64))
        shared = spark.sparkContext.broadcast(list(pivots))  # LEVELS * PIVOTS vectors at most

        def dealt(batches, shared=shared):
            *upper, p = shared.value
            half = (p.astype(np.float64) ** 2).sum(axis=1) / 2
            for batch in batches:
                if batch.num_rows:
                    rest = unpack(batch.column("x"))
                    path = unpack(batch.column("path")) if upper else np.zeros((len(rest), 0), np.int64)
                    for k, q in enumerate(upper):
                        rest = rest - q[path[:, k]]
                    near = np.concatenate([(rest[i : i + 8192].astype(np.float64) @ p.T.astype(np.float64) - half).argmax(axis=1) for i in range(0, len(rest), 8192)])
                    dist = np.sqrt(((rest - p[near]).astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9)
                    full = np.hstack([path, near[:, None]]).astype(np.int32)
                    new = pa.ListArray.from_arrays(pa.array(np.arange(0, full.size + 1, full.shape[1], dtype=np.int32)), pa.array(full.ravel()))
                    yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("x"), batch.column("u"), new, pa.array(dist)], names=["id", "x", "u", "path", "dist"])

        now = Staged(todo.mapInArrow(dealt, f"id long, x {kind}, u long, path array<int>, dist double"), "placed").df
        found = Staged(now.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("r")), "cells").df
        over = found.where(F.col("n") > limit)
        rows, most = over.agg(F.sum("n"), F.max("n")).first()
        last = rows is None or level == LEVELS or (rows, most) == before
        tables.append(found.withColumn("leaf", F.lit(True) if last else F.col("n") <= limit))
        if last:
            done.append(now.drop("dist"))
            break
        before, fan = (rows, most), min(PIVOTS, max(8, -(-4 * most // limit)))
        wide = small(Staged(over.select("path"), "wide").df)
        done.append(now.drop("dist").join(wide, "path", "left_anti").select("id", "x", "u", "path"))
        todo = now.drop("dist").join(wide, "path", "left_semi").select("id", "x", "u", "path")

    shared_all = spark.sparkContext.broadcast(pivots)

    def centered(batches):
        for batch in batches:
            c = [sum(p[k] for p, k in zip(shared_all.value, path, strict=False)) for path in batch.column("path").to_pylist()]
            norm = [float(np.sqrt((x.astype(np.float64) ** 2).sum())) for x in c]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x.tolist() for x in c], pa.list_(pa.int64())), pa.array(norm, pa.float64())], names=[*batch.schema.names, "c", "cn"])

    def union(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for df in frames[1:]:
            out = out.unionByName(df)
        return out

    nodes = union(tables).withColumn("parent", F.expr("slice(path, 1, size(path) - 1)"))
    nodes = nodes.mapInArrow(centered, "path array<int>, n long, r double, leaf boolean, parent array<int>, c array<long>, cn double")
    return union(done), Staged(nodes, "nodes").df, level


def grouped(queries: DataFrame) -> DataFrame:
    """g, id and x of query rows: a group is the largest cell with at most GROUP of them; a last cell with more is cut by a hash of the row."""
    queries = Staged(queries, "queries").df
    prefixes = queries.select("u", "path", F.explode(F.sequence(F.lit(1), F.size("path"))).alias("l")).withColumn("p", F.expr("slice(path, 1, l)"))
    counts = prefixes.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    chosen = prefixes.join(counts, "p").groupBy("u").agg(F.min(F.when(F.col("n") <= GROUP, F.col("l"))).alias("l"), F.min("n").alias("n"))
    whole = F.coalesce("l", F.size("path"))
    cut = F.when(F.col("l").isNull(), F.pmod(F.xxhash64("u"), F.ceil(F.col("n") * 1.25 / GROUP))).otherwise(0)
    g = F.concat(F.concat_ws(".", F.slice("path", F.lit(1), whole)), F.lit(":"), cut.cast("string"))
    return queries.join(chosen, "u").select(g.alias("g"), "id", "x")


def promising(pairs: DataFrame) -> DataFrame:
    """Of each group's pairs those of the largest bounds: FIRST, or as many as have FIRST_ROWS rows."""
    w = Window.partitionBy("g").orderBy(F.desc("bound"), "child")
    had = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return pairs.withColumn("place", F.row_number().over(w)).withColumn("had", had).where((F.col("place") <= FIRST) | (F.col("had") < FIRST_ROWS)).drop("place", "had")


def down(groups: DataFrame, nodes: DataFrame, depth: int, kept) -> DataFrame:
    """g and path of the leaf cells that query groups (g, qc, qr, qn) reach, when of each level's pairs with their bound only the kept ones go on."""
    dot = F.aggregate(F.zip_with("qc", "c", lambda a, b: a * b), F.lit(0).cast("long"), lambda a, b: a + b).cast("double")
    front, out = groups.withColumn("parent", F.array().cast("array<int>")), []
    for level in range(1, depth + 1):
        kids = nodes.where(F.size("path") == level).withColumnRenamed("path", "child")
        kids = F.broadcast(kids) if level == 1 else kids  # PIVOTS rows at most
        pairs = front.join(kids, "parent").withColumn("dot", dot)
        pairs = kept(pairs.withColumn("bound", raised(F.col("dot"), F.col("qn") * F.col("r") + F.col("cn") * F.col("qr") + F.col("qr") * F.col("r"))))
        pairs = Staged(pairs, "pairs").df if level < depth else pairs
        out.append(pairs.where("leaf").select("g", F.col("child").alias("path")))
        front = pairs.where("NOT leaf").select(*groups.columns, F.col("child").alias("parent"))
    leaves = out[0]
    for df in out[1:]:
        leaves = leaves.unionByName(df)
    return leaves


def raised(dot: Column, more: Column) -> Column:
    """A whole number that no inner product exceeds, rounding errors of the sum included."""
    return F.floor(dot + more + (F.abs(dot) + more) * 1e-12 + 1e-6)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, vector: str = "embedding", key: str = "vec_id", scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose key is divisible by `every`, its k largest integer inner products.

    Ties go to the smaller key; with fewer than k candidates all are returned. Rows that repeat a key, or a key and vector, are candidates like
    others and each take a rank of their own; rows that repeat a query's key share its ranks. A query is no candidate of its own, and rows
    that repeat its key are none either. Vectors without values, with null or non-finite components or without a key take no part. Vectors of different
    lengths raise ValueError. Columns besides vector and key are ignored.
    """
    spark = vectors.sparkSession
    data = Staged(integers(vectors, vector, key, scale).withColumn("u", F.monotonically_increasing_id()), "vectors").df
    shape = data.agg(F.min(F.size("x")), F.max(F.size("x")), F.max(F.array_max(F.transform("x", F.abs))), F.count(F.lit(1))).first()
    out = "query_id long, rank int, vec_id long, score long"
    if shape[0] is None:
        return spark.createDataFrame([], out)
    if shape[0] != shape[1]:
        raise ValueError(f"vectors of {shape[0]} and {shape[1]} components")
    if shape[2] > 1 << 28:
        raise ValueError("components beyond 2**28 would not sum exactly")
    data = data.withColumn("x", F.col("x").cast("array<short>" if shape[2] < 1 << 15 else "array<int>"))  # shuffles take a quarter or half
    limit = min(PART, max(LEAST_PART, shape[3] // PIVOTS))
    placed, nodes, depth = cells(data, limit * WHOLE)
    cut_cells = small(Staged(nodes.where("leaf").where(F.col("n") > limit).select("path", F.ceil(F.col("n") * 1.25 / limit).cast("int").alias("cuts")), "cuts").df)
    with_cuts = lambda df: df.join(cut_cells, "path", "left").na.fill(1, ["cuts"])
    name = lambda path: F.concat_ws(".", path)
    rows = with_cuts(placed).withColumn("cut", F.pmod(F.xxhash64("u"), F.col("cuts")))
    rows = rows.select(F.concat(name(F.col("path")), F.lit(":"), F.col("cut").cast("string")).alias("part"), "id", "x")
    queries = grouped(placed.where(F.col("id") % every == 0))

    def ball(group: pa.Table) -> pa.Table:
        x = unpack(group["x"])
        c = np.floor(x.mean(axis=0)).astype(np.int64)
        r = float(np.sqrt(((x - c).astype(np.float64) ** 2).sum(axis=1).max())) * (1 + 1e-9)
        return pa.table({"g": group["g"][:1], "qc": pa.array([c.tolist()], pa.list_(pa.int64())), "qr": [r], "qn": [float(np.sqrt((c.astype(np.float64) ** 2).sum()))]})

    q_balls = Staged(queries.groupBy("g").applyInArrow(ball, "g string, qc array<long>, qr double, qn double"), "balls").df
    q_rows = queries.select("g", F.col("id").alias("q"), F.col("x").alias("qx"))
    block = F.pmod(F.xxhash64("g"), F.lit(max(1, -(-q_balls.count() // BLOCK)))).alias("block")

    def parts_of(leaves: DataFrame, first_only: bool) -> DataFrame:
        """g and part, for g and path."""
        each = leaves.withColumn("cut", F.lit(0)) if first_only else with_cuts(leaves).select("g", "path", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"))
        return each.select("g", F.concat(name(F.col("path")), F.lit(":"), F.col("cut").cast("string")).alias("part"))

    def searched(pairs: DataFrame, found: DataFrame | None) -> DataFrame:
        """Each part meets its query groups in blocks of about BLOCK groups, mostly all in one; the tree of a part is built for each of them."""
        pairs = pairs.select("g", "part", block)
        held = rows.join(pairs.select("part", "block").distinct(), "part").select(F.col("part").alias("d_part"), F.col("block").alias("d_block"), F.col("id").alias("d_id"), F.col("x").alias("d_x"))
        blocked = pairs.join(q_rows, "g").select("g", "part", "block", "q", "qx")
        if found is not None:
            worst = found.groupBy("q").agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("n")).select("q", F.when(F.col("n") >= k, F.col("low")).alias("low"))
            blocked = blocked.join(worst, "q", "left").select("g", "part", "block", "q", "qx", "low")
        else:
            blocked = blocked.withColumn("low", F.lit(None).cast("long"))

        def one(left: pa.Table, right: pa.Table) -> pa.Table:
            q, s, v = [], [], []
            if left.num_rows and right.num_rows:
                tree, ids = Cover(unpack(right["d_x"], np.int32)), right["d_id"].to_numpy()
                of = left["g"].combine_chunks().dictionary_encode().indices.to_numpy()
                order = np.argsort(of, kind="stable")
                for at in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
                    mine = left.take(pa.array(at))
                    names = mine["q"].to_numpy()
                    best = Best(len(names), k)
                    for i, x in enumerate(mine["low"].to_pylist()):
                        if x is not None:  # placeholders after all ids: only as good or better is of use
                            best.heaps[i] = [(x, -(1 << 62))] * k
                    dual(Cover(unpack(mine["qx"], np.int32), GROUP), names, tree, ids, best)
                    for i, h in enumerate(best.heaps):
                        for score, other in h:
                            if other != -(1 << 62):
                                q.append(int(names[i]))
                                s.append(score)
                                v.append(-other)
            return pa.table({"q": pa.array(q, pa.int64()), "v": pa.array(v, pa.int64()), "score": pa.array(s, pa.int64())})

        got = blocked.groupBy("part", "block").cogroup(held.groupBy("d_part", "d_block")).applyInArrow(one, "q long, v long, score long")
        return got if found is None else got.unionByName(found)

    def best_of(df: DataFrame, name: str) -> DataFrame:
        """The k best of each query's rows; no query group meets a part twice, so each pair of rows is there once at most."""
        top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "v"))), 1, k)
        return Staged(df.groupBy("q").agg(top.alias("t")).select("q", F.posexplode("t").alias("r", "t")).select("q", F.col("t.v").alias("v"), (-F.col("t.s")).alias("score"), (F.col("r") + 1).cast("int").alias("rank")), name).df

    begun = Staged(parts_of(down(q_balls, nodes, depth, promising), True).distinct(), "begun").df
    first = best_of(searched(begun, None), "first")
    low = first.groupBy("q").agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("n"))
    of_group = q_rows.join(low, "q", "left").groupBy("g").agg(F.min(F.when(F.col("n") >= k, F.col("low")).otherwise(-(1 << 62))).alias("low"))
    reached = down(q_balls.join(of_group, "g"), nodes, depth, lambda pairs: pairs.where("bound >= low"))
    open_pairs = Staged(parts_of(reached, False).join(begun, ["g", "part"], "left_anti"), "meets").df
    last = best_of(searched(open_pairs, first.select("q", "v", "score")), "last")
    return last.select(F.col("q").alias("query_id"), "rank", F.col("v").alias("vec_id"), "score")


def op2_dual_tree_topk(spark, sf_dir: str) -> DataFrame:
    """The five best of every query row against all rows; for unsound vectors, repeated rows, ties and empty tables see top_k()."""
    return top_k(table(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(CAST(e AS DOUBLE) * 256) AS BIGINT) FOR e IN embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
p AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(CAST(q.x AS DOUBLE[]), CAST(d.x AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
