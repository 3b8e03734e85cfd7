"""Nearest neighbours by largest inner product: vantage-point trees, one per shard.

Vectors get one more component, sqrt(M^2 - |x|^2) with M the largest norm, and queries a zero there; then the smallest
distance is the largest inner product and the triangle inequality holds. A coarse tree, fitted on at most ``sample``
vectors, deals all vectors to shards (a leaf of too many rows, such as copies of one vector, is dealt on by hash).
Each shard's tree is built once and written. A query is searched in its own shards first; its k-th distance then rules
out shards and, inside them, subtrees: one is skipped if its lower bound exceeds what is left of that distance by ``factor``.
Lifted vectors lie on a sphere of radius M, so no distance from a query is below | M - |q| |; the factor applies to what the k-th
distance has over that, as only that tells near from far. Factor one, the default, is exact search. ``calibrate`` finds, on a bounded
sample of queries and vectors, the smallest factor that keeps a wanted recall, and tells the recall it had there.

Vectors that are null, zero, of another length than most, or that hold null or non-finite components take no part; nor do
null ids. A query's own id is no candidate; queries of one id give one list, the nearest to any of them. A candidate's score is
the sum of its own products, whatever shard it lies in, so copies tie, and ties go to the smaller id. Extra columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Share of the squared norms by which a squared distance may come out too small.
ROUNDING = 1e-12


def relaxed(far: np.ndarray, least: np.ndarray, factor: float) -> np.ndarray:
    """How far a search looks: the k-th distance so far, of which the part over the least possible one counts by the factor."""
    return far * (1 + 1e-12) if factor == 1 else np.where(np.isfinite(far), least + factor * np.maximum(far - least, 0), far)


class Tree:
    """hi: largest distance inside, lo: smallest outside, of a node's vantage point; leaves hold a range of rows."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = 256, seed: int = 1, depth: int | None = None):
        rng = np.random.default_rng(seed)
        self.vantage, self.hi, self.lo, self.kids, self.range = [], [], [], [], []
        order = np.argsort(ids, kind="stable") if len(ids) else np.zeros(0, np.int64)
        spots: list[np.ndarray] = []

        def grow(rows: np.ndarray, level: int) -> int:
            me = len(self.hi)
            self.vantage.append(np.zeros(points.shape[1]))
            self.hi.append(0.0), self.lo.append(0.0), self.kids.append((-1, -1)), self.range.append((0, 0))
            if len(rows) < 2 or (level == 0 if depth is not None else len(rows) <= leaf):
                at = sum(map(len, spots))
                spots.append(rows)
                self.range[me] = (at, at + len(rows))
                return me
            some = points[rows[rng.integers(0, len(rows), min(64, len(rows)))]]
            tries = points[rows[rng.integers(0, len(rows), 5)]]
            spread = [np.linalg.norm(some - t, axis=1).std() for t in tries]
            v = tries[int(np.argmax(spread))]
            d = np.linalg.norm(points[rows] - v, axis=1)
            by = np.argsort(d, kind="stable")
            half = len(rows) // 2
            self.vantage[me], self.hi[me], self.lo[me] = v, float(d[by[half - 1]]), float(d[by[half]])
            self.kids[me] = (grow(rows[by[:half]], level - 1), grow(rows[by[half:]], level - 1))
            return me

        grow(order, depth if depth is not None else 0)
        at = np.concatenate(spots) if spots else order
        self.points, self.ids = points[at], ids[at]
        self._close()

    def _close(self) -> None:
        self.vantage, self.hi, self.lo = np.array(self.vantage), np.array(self.hi), np.array(self.lo)
        self.kids, self.range = np.array(self.kids, np.int64).reshape(-1, 2), np.array(self.range, np.int64).reshape(-1, 2)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{k: getattr(self, k) for k in ("vantage", "hi", "lo", "kids", "range", "points", "ids")})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Tree:
        self = cls.__new__(cls)
        with np.load(io.BytesIO(raw)) as z:
            for k in z.files:
                setattr(self, k, z[k])
        return self

    def leaves(self) -> list[int]:
        return [i for i, k in enumerate(self.kids) if k[0] < 0]

    def route(self, x: np.ndarray) -> np.ndarray:
        """The leaf (by its node number) of each point."""
        at = np.zeros(len(x), np.int64)
        todo = np.flatnonzero(self.kids[at, 0] >= 0)
        while len(todo):
            n = at[todo]
            d = np.linalg.norm(x[todo] - self.vantage[n], axis=1)
            at[todo] = np.where(d <= (self.hi[n] + self.lo[n]) / 2, self.kids[n, 0], self.kids[n, 1])
            todo = todo[self.kids[at[todo], 0] >= 0]
        return at

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """For each point and leaf the least distance that points routed there can have."""
        low = {0: np.zeros(len(x))}
        for n, (a, b) in enumerate(self.kids.tolist()):
            if a >= 0:
                d, cut = np.linalg.norm(x - self.vantage[n], axis=1), (self.hi[n] + self.lo[n]) / 2
                low[a], low[b] = np.maximum(low[n], d - cut), np.maximum(low[n], cut - d)
        return np.stack([low[n] for n in self.leaves()], 1)

    def search(self, q: np.ndarray, own: np.ndarray, k: int, factor: float, far: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Inner products and ids of up to k nearest (-inf where fewer). far: distances already reached elsewhere."""
        best, who = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
        norms = (q * q).sum(1)
        least = np.abs(np.sqrt(norms) - np.linalg.norm(self.points[0])) if len(self.points) else np.zeros(len(q))
        size = float((self.points[0] ** 2).sum()) if len(self.points) else 0.0
        far = np.full(len(q), np.inf) if far is None else far.copy()

        def reach(at: np.ndarray) -> np.ndarray:
            return np.minimum(far[at], np.sqrt(np.maximum(0.0, norms[at] + size - 2 * best[at, -1]) + ROUNDING * (norms[at] + size)))

        def look(n: int, at: np.ndarray) -> None:
            s, e = self.range[n]
            points, every = self.points[s:e], self.ids[s:e]
            for part in range(0, len(at), 1000):
                look_at(points, every, at[part : part + 1000])

        def look_at(points: np.ndarray, every: np.ndarray, at: np.ndarray) -> None:
            # one matrix product finds who may be among the nearest; their own sums, equal for equal vectors, decide
            ip = q[at] @ points.T
            ip[every[None, :] == own[at][:, None]] = -np.inf
            near = ROUNDING * (norms[at] + size)
            some = ip.max(1) >= best[at, -1] - near
            at, ip, near = at[some], ip[some], near[some]
            if not len(at):
                return
            m = min(k + 8, ip.shape[1])
            pick = np.argpartition(-ip, m - 1, axis=1)[:, :m]
            rough = np.take_along_axis(ip, pick, 1)
            sums = np.where(np.isneginf(rough), -np.inf, (points[pick] * q[at][:, None, :]).sum(2))
            ids = every[pick]
            if m < ip.shape[1]:
                bar = np.maximum(np.partition(sums, m - k, axis=1)[:, m - k], best[at, -1])
                tied = np.flatnonzero((rough.min(1) >= bar - near) & (rough.min(1) > -np.inf))
                for t in tied.tolist():  # so many alike that others than the picked may count
                    own_sums = np.where(np.isneginf(ip[t]), -np.inf, (points * q[at[t]]).sum(1))
                    first = np.lexsort((every, -own_sums))[:m]
                    sums[t], ids[t] = own_sums[first], every[first]
            sums, ids = np.concatenate([best[at], sums], 1), np.concatenate([who[at], ids], 1)
            top = np.lexsort((ids, -sums), axis=1)[:, :k]
            best[at], who[at] = np.take_along_axis(sums, top, 1), np.take_along_axis(ids, top, 1)

        def visit(n: int, at: np.ndarray) -> None:
            a, b = self.kids[n]
            if a < 0:
                look(n, at[home[at] != n])
                return
            d = np.linalg.norm(q[at] - self.vantage[n], axis=1)
            for kid, low in ((a, d - self.hi[n]), (b, self.lo[n] - d)):
                some = at[low <= relaxed(reach(at), least[at], factor)]
                if len(some):
                    visit(kid, some)

        if len(self.points) and len(q):
            home = self.route(q)  # each query's own leaf first: its k-th distance prunes the rest
            for n in np.unique(home).tolist():
                look(n, np.flatnonzero(home == n))
            visit(0, np.arange(len(q)))
        return best, who


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def _lifted(x: np.ndarray, most: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(0.0, most * most - (x * x).sum(1)))[:, None]], 1)


def _flat(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.zeros((len(x), 1))], 1)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (doubles): the vectors that take part, still of any length."""
    v = F.col("embedding").cast("array<double>")
    good = "v IS NOT NULL AND vec_id IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)"
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(good)


_HIT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
_HIT_SQL = "query_id long, vec_id long, score double"


def calibrate(vectors: DataFrame, recall: float = 0.9, k: int = 20, sample: int = 8192, queries: int = 256) -> tuple[float, float]:
    """A factor and the recall it had: the smallest of 0.05, 0.1, ... 1 with at least the wanted recall, and half of what that leaves to
    one as a margin, on a tree over at most ``sample`` vectors of the commonest length and at most ``queries`` of them. A larger index
    has more subtrees to rule out and a nearer k-th distance, so a factor found on a sample errs on the safe side more often
    than not; measure the recall where it matters. Without vectors the factor is one."""
    rows = usable(vectors).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    if not rows:
        return 1.0, 1.0
    lengths = [len(r["v"]) for r in rows]
    dim = max(set(lengths), key=lambda n: (lengths.count(n), -n))
    x = np.array([r["v"] for r in rows if len(r["v"]) == dim], np.float64)
    ids = np.arange(len(x))
    tree, asked = Tree(_lifted(x, float(np.linalg.norm(x, axis=1).max())), ids), ids[:queries]
    q = _flat(x[asked])
    exact = tree.search(q, asked, k, 1.0)[1]
    none = np.iinfo(np.int64).max

    def found(factor: float) -> float:
        got = tree.search(q, asked, k, factor)[1]
        hits = sum(len(set(a.tolist()) & set(b.tolist()) - {none}) for a, b in zip(exact, got, strict=True))
        return hits / max(1, int((exact != none).sum()))

    wanted = recall + (1 - recall) / 2
    for step in range(1, 20):
        if (had := found(step / 20)) >= wanted:
            return step / 20, had
    return 1.0, 1.0


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, factor: float = 1.0, sample: int = 8192, shard_rows: int = 4096,
    query_rows: int = 20_000) -> DataFrame:
    """query_id, rank, vec_id, score for queries with vec_id divisible by ``every``."""
    spark = common.tune(vectors.sparkSession)
    all_ = usable(vectors)
    sizes = all_.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"),
        F.max(F.expr("aggregate(v, 0D, (a, x) -> a + x * x)")).alias("m")).orderBy(F.desc("n"), "dim").limit(1).collect()
    result = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], result)
    dim, rows, most = sizes[0]["dim"], sizes[0]["n"], float(np.sqrt(sizes[0]["m"]))
    same = all_.where(F.size("v") == dim)
    fit = same.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    points = _lifted(np.array([r["v"] for r in fit], np.float64).reshape(-1, dim), most)
    depth = max(0, min(int(np.ceil(np.log2(max(1, rows / shard_rows)))), int(np.log2(max(1, len(fit) / 8)))))
    coarse = Tree(points, np.arange(len(fit)), depth=depth)
    coarse.points, coarse.ids = coarse.points[:1], coarse.ids[:1]
    leaves = coarse.leaves()
    place = {n: i for i, n in enumerate(leaves)}
    sent = spark.sparkContext.broadcast(coarse)  # at most sample / 4 nodes

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _lifted(_matrix(b.column("v"), dim), most)
            leaf = np.array([place[n] for n in sent.value.route(x).tolist()], np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int32()), b.column("vec_id"), b.column("v")], names=["leaf", "vec_id", "v"])

    dealt = common.saved(same.mapInArrow(common.lean(deal), "leaf int, vec_id long, v array<double>"), "dealt")
    counts = {r["leaf"]: r["count"] for r in dealt.groupBy("leaf").count().collect()}  # a row for each coarse leaf
    subs = [max(1, -(-counts.get(i, 0) // (2 * shard_rows))) for i in range(len(leaves))]
    table = F.array(*map(F.lit, subs))
    index_schema = pa.schema([("leaf", pa.int32()), ("sub", pa.int32()), ("tree", pa.binary())])

    def build(group: pa.Table) -> pa.Table:
        x = _lifted(_matrix(group.column("v").combine_chunks(), dim), most)
        tree = Tree(x, group.column("vec_id").to_numpy())
        return pa.table({"leaf": group.column("leaf")[:1], "sub": group.column("sub")[:1], "tree": [tree.to_bytes()]}, schema=index_schema)

    sub = F.pmod(F.xxhash64("vec_id"), F.element_at(table, F.col("leaf") + 1)).cast("int")
    index = common.saved(dealt.withColumn("sub", sub).groupBy("leaf", "sub").applyInArrow(build, "leaf int, sub int, tree binary"), "trees")
    queries = same.where(F.col("vec_id") % every == 0)
    pairs = np.array([i for i, n in enumerate(subs) for _ in range(n)]), np.array([j for n in subs for j in range(n)])

    def send(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                q = _flat(_matrix(b.column("v"), dim))
                low = sent.value.bounds(q)
                home = np.array([place[n] for n in sent.value.route(q).tolist()], np.int64)
                if first:
                    go = np.zeros(low.shape, bool)
                    go[np.arange(len(q)), home] = True
                    far = np.full(len(q), np.inf)
                else:
                    far = b.column("far").to_numpy(zero_copy_only=False)
                    go = low <= relaxed(far, np.abs(np.linalg.norm(q, axis=1) - most), factor)[:, None]
                    go[np.arange(len(q)), home] = False
                row, shard = np.nonzero(go[:, pairs[0]])
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pairs[0][shard], pa.int32()), pa.array(pairs[1][shard], pa.int32()), b.column("vec_id").take(take),
                        b.column("v").take(take), pa.array(far[row], pa.float64())], names=["leaf", "sub", "vec_id", "v", "far"])

        return run

    def probe(asked: pa.Table, trees: pa.Table) -> pa.Table:
        if not asked.num_rows or not trees.num_rows:
            return _HIT.empty_table()
        own = asked.column("vec_id").to_numpy()
        q = _flat(_matrix(asked.column("v").combine_chunks(), dim))
        ip, who = Tree.from_bytes(trees.column("tree")[0].as_py()).search(q, own, k, factor, asked.column("far").to_numpy())
        ok = np.isfinite(ip)
        return pa.table({"query_id": np.repeat(own, k)[ok.ravel()], "vec_id": who[ok], "score": ip[ok]}, schema=_HIT)

    def searched(q: DataFrame, first: bool) -> DataFrame:
        asked = common.saved(q.mapInArrow(common.lean(send(first)), "leaf int, sub int, vec_id long, v array<double>, far double"), "asked")
        busiest = asked.groupBy("leaf", "sub").count().agg(F.max("count")).first()[0] or 0
        lanes = max(1, -(-busiest // query_rows))
        asked = asked.withColumn("lane", F.pmod(F.hash("vec_id"), F.lit(lanes)).cast("int"))
        trees = index.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
        by = ["leaf", "sub", "lane"]
        return common.saved(asked.groupBy(*by).cogroup(trees.groupBy(*by)).applyInArrow(probe, _HIT_SQL), "hits")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = lambda hits: hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    home = searched(queries, True)
    worst = top(home).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("s"))
    norm = F.expr("aggregate(v, 0D, (a, x) -> a + x * x)")
    reached = F.when(F.col("n") < k, F.lit(float("inf"))).otherwise(
        F.sqrt(F.greatest(F.lit(0.0), norm + most * most - 2 * F.col("s")) + ROUNDING * (norm + most * most)))
    known = queries.join(worst, queries.vec_id == worst.query_id, "left").select("vec_id", "v",
        F.coalesce(reached, F.lit(float("inf"))).alias("far"))
    away = searched(known, False)
    return top(home.unionByName(away).distinct()).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
