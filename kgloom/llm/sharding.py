"""Sharding by a k-d tree over document metadata, in DataFrame functions only.

Equal texts form one group and stay in one shard. A group is a point: the source, language and id of its first row (the
smallest doc_id), and its text's size; names count as the number that their first seven bytes spell. The tree
cuts each node along its widest dimension (as a part of that dimension's whole range) at the weighted median of bytes,
until a leaf is one shard. The median is found without sorting or gathering rows: bytes are counted in ``bins`` equal
parts of the range of all nodes of a level at once, then the part with the cut is divided again, until it holds less
than ``tolerance`` of a shard. Where one value holds more, as with a hot source, its groups are cut in the same way by
their first id, and those of one id by a hash.

Groups over ``heavy`` of a shard (fewer than shards / heavy) are too coarse for such counts: the driver cuts them at the
node's same dimension, and the cut of all others is moved so that both sides are equal. Where the others are too few for that,
heavy groups are exchanged until they are. A group larger than a whole shard is dealt by row in parts before, and the
cuts leave room for them. Shards so get nearly equal bytes (law ``bytes``).

Null text has size 1, as an empty one. Rows with one doc_id are kept apart but for equal texts, so repeated rows share a
shard; a text of any length is one row of it. Missing metadata columns are left out. An empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Columns of names that are dimensions too; and those that every row has.
NAMES, OWN = ("source", "lang"), ("bytes", "first_id")


def name_code(name: Column) -> Column:
    """The first seven UTF-8 bytes as a number, in their order; null is the least."""
    head = F.rpad(F.hex(F.substring(F.encode(name.cast("string"), "UTF-8"), 1, 7)), 14, "0")
    return F.coalesce(F.conv(head, 16, 10).cast("long"), F.lit(-1).cast("long"))


def _part() -> Column:
    return F.pmod(F.hash("doc_id"), F.col("parts"))


def _dealt_parts(groups: DataFrame, rows: DataFrame, shards: int, target: float, heavy: float) -> tuple[list[tuple], list[float]]:
    """(group, part, parts, shard) of the groups larger than a shard (fewer than ``shards``), cut by a hash of the row,
    and each shard's bytes of them."""
    found = groups.where(F.col("weight") > target).select("group", "weight").collect()
    load = [(0.0, s) for s in range(shards)]
    if not found:
        return [], [0.0] * shards
    parts = {r["group"]: min(int(r["weight"] / (heavy * target)) + 1, int(shards / heavy)) for r in found}
    table = F.broadcast(rows.sparkSession.createDataFrame(list(parts.items()), "group string, parts int"))
    sums = rows.join(table, "group").groupBy("group", _part().alias("part")).agg(F.sum("size").alias("w")).collect()
    out = []
    for w, g, p in sorted(((float(r["w"]), r["group"], r["part"]) for r in sums), key=lambda x: (-x[0], x[1], x[2])):
        have, s = heapq.heappop(load)
        out.append((g, p, parts[g], s))
        heapq.heappush(load, (have + w, s))
    return out, [w for w, _ in sorted(load, key=lambda x: x[1])]


def halve(weights: list[float], left: float, right: float, light: float, least: float) -> list[bool]:
    """Which of the heavy groups, given in the order of the cut's dimension, go left, where the sides have ``left`` and ``right``
    already and ``light`` can be shared freely: a prefix, and then the exchanges that balance needs."""
    total = sum(weights)
    best, at, run = None, 0, 0.0
    for k in range(len(weights) + 1):
        off = abs((left + run) - (right + total - run))
        if best is None or off < best:
            best, at = off, k
        run += weights[k] if k < len(weights) else 0.0
    side = [k < at for k in range(len(weights))]
    for _ in range(len(weights)):
        gap = left + sum(w for w, s in zip(weights, side, strict=True) if s) - right - sum(w for w,
            s in zip(weights, side, strict=True) if not s)
        if abs(gap) <= light + least:
            break
        full = [k for k, s in enumerate(side) if s == (gap > 0)]
        other = sorted((weights[k], k) for k, s in enumerate(side) if s != (gap > 0))
        ordered = [w for w, _ in other]
        want, moves = abs(gap) / 2, []
        for k in full:
            moves.append((abs(weights[k] - want), k, None))
            if other:  # the exchange partner that brings the difference nearest to what is wanted
                i = _nearest(ordered, weights[k] - want)
                moves.append((abs(weights[k] - other[i][0] - want), k, other[i][1]))
        if not moves or min(moves, key=lambda m: m[0])[0] >= want:
            break
        _, k, j = min(moves, key=lambda m: m[0])
        side[k] = not side[k]
        if j is not None:
            side[j] = not side[j]
    return side


def _nearest(ordered: list[float], x: float) -> int:
    lo, hi = 0, len(ordered)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (mid + 1, hi) if ordered[mid] < x else (lo, mid)
    return min((k for k in (lo - 1, lo) if 0 <= k < len(ordered)), key=lambda k: abs(ordered[k] - x))


@dataclass
class Cut:
    """A node's cut: groups come left by the values of ``by`` (ties of one by the next), up to ``want`` bytes of the light ones."""

    by: list[str]
    range: dict[str, tuple[int, int]]
    want: float
    ties: list[tuple[str, int]] = field(default_factory=list)
    before: float = 0.0
    lo: int = 0
    hi: int = 0
    step: int = 1

    def __post_init__(self):
        self.enter(self.by[0])

    def enter(self, column: str) -> None:
        self.lo, self.hi = self.range[column][0], self.range[column][1] + 1

    @property
    def column(self) -> str:
        return self.by[len(self.ties)]

    def narrow(self, crossing, limit: float) -> bool:
        """Goes on within the bin that holds the cut; True when the cut is found. crossing: bin, w, upto."""
        if crossing is None:  # fewer bytes than wanted: all go left
            self.lo = self.hi
            return True
        start = self.lo + crossing["bin"] * self.step
        self.before += crossing["upto"] - crossing["w"]
        self.lo, self.hi = start, min(self.hi, start + self.step)
        if crossing["w"] > limit and self.step > 1:
            return False
        if crossing["w"] > limit and len(self.ties) + 1 < len(self.by):
            self.ties.append((self.column, start))
            self.enter(self.column)
            return False
        if self.before + crossing["w"] / 2 < self.want:
            self.lo = self.hi
        return True


class Table:
    """All nodes' cuts as arrays by node, so that an expression is as long as a level's nodes and no deeper for more of them."""

    def __init__(self, plan: dict[int, Cut], nodes: int, columns: list[str]):
        values = F.array(*[F.col(c) for c in columns])

        def each(of) -> Column:
            return F.get(F.array(*[F.lit(of(plan[n]) if n in plan else None).cast("long") for n in range(nodes)]), F.col("node"))

        def tie(k: int) -> tuple[Column, Column]:
            name = lambda c: columns.index(c.ties[k][0]) if len(c.ties) > k else None
            value = lambda c: c.ties[k][1] if len(c.ties) > k else None
            return F.get(values, each(name).cast("int")), each(value)

        self.value = F.get(values, each(lambda c: columns.index(c.column)).cast("int"))
        self.lo, self.hi, self.step = each(lambda c: c.lo), each(lambda c: c.hi), each(lambda c: c.step)
        self.ties = [tie(k) for k in range(max((len(c.ties) for c in plan.values()), default=0))]
        left = [float(plan[n].want - plan[n].before) if n in plan else None for n in range(nodes)]
        self.wanted = F.get(F.array(*[F.lit(x).cast("double") for x in left]), F.col("node"))

    def bin(self) -> Column:
        """The part of its node's range that a group lies in; null outside, and at nodes without a cut here."""
        inside = (self.value >= self.lo) & (self.value < self.hi)
        for own, tied in self.ties:
            inside = inside & (tied.isNull() | (own == tied))
        return F.when(inside, F.floor((self.value - self.lo) / self.step))

    def left(self) -> Column:
        first = self.value < self.lo
        for own, tied in reversed(self.ties):
            first = F.when(tied.isNull(), first).otherwise((own < tied) | ((own == tied) & first))
        return first


def _find_cuts(light: DataFrame, plan: dict[int, Cut], limit: float, bins: int, nodes: int, columns: list[str]) -> None:
    """Narrows all nodes' cuts together, one histogram of at most ``bins`` parts a node and round."""
    open_ = dict(plan)
    while open_:
        for cut in open_.values():
            cut.step = max(1, -(-(cut.hi - cut.lo) // bins))
        table = Table(open_, nodes, columns)
        counted = light.withColumn("bin", table.bin()).where("bin IS NOT NULL").groupBy("node", "bin").agg(F.sum("weight").alias("w"))
        run = F.sum("w").over(Window.partitionBy("node").orderBy("bin"))
        crossing = counted.withColumn("upto", run).where(F.col("upto") >= table.wanted).groupBy("node").agg(
            F.min_by(F.struct("bin", "w", "upto"), "bin").alias("x")).collect()
        got = {r["node"]: r["x"] for r in crossing}
        open_ = {n: cut for n, cut in open_.items() if not cut.narrow(got.get(n), limit)}


def grow_tree(light: DataFrame, heavies: list[dict], dims: list[str], shards: int, extra: list[float], target: float, tolerance: float,
    bins: int) -> tuple[DataFrame, dict[str, int]]:
    """light (group, weight, dimensions, mix) with ``node``, its shard; and the heavy groups' shards."""
    columns = [*dims, "mix"]
    light, width, level = light.withColumn("node", F.lit(0)), shards, 0
    nodes = {h["group"]: 0 for h in heavies}
    span: dict[str, int] = {}
    while width > 1:
        ends = [f(d).alias(f"{k}_{d}") for d in columns for k, f in (("lo", F.min), ("hi", F.max))]
        stats = {r["node"]: r for r in light.groupBy("node").agg(F.sum("weight").alias("w"), *ends).collect()}
        plan: dict[int, Cut] = {}
        below: dict[str, int] = {}
        for n in sorted({*stats, *nodes.values()}):
            mine, s = [h for h in heavies if nodes[h["group"]] == n], stats.get(n)
            seen = {d: [h[d] for h in mine] + ([s[f"lo_{d}"], s[f"hi_{d}"]] if s else []) for d in columns}
            span = span or {d: max(1, max(v) - min(v)) for d, v in seen.items()}
            dim = max(dims, key=lambda d: ((max(seen[d]) - min(seen[d])) / span[d], -dims.index(d)))
            by = list(dict.fromkeys([dim, "first_id", "mix"]))
            left, right = (sum(extra[n * width + k * width // 2 :][: width // 2]) for k in (0, 1))
            weight = float(s["w"]) if s else 0.0
            mine.sort(key=lambda h: (*(h[c] for c in by), h["group"]))
            sides = halve([float(h["weight"]) for h in mine], left, right, weight, tolerance * target)
            for h, first in zip(mine, sides, strict=True):
                below[h["group"]] = 2 * n + (not first)
                left, right = left + first * h["weight"], right + (not first) * h["weight"]
            if s:
                want = min(weight, max(0.0, (weight + left + right) / 2 - left))
                plan[n] = Cut(by, {c: (s[f"lo_{c}"], s[f"hi_{c}"]) for c in columns}, want)
        level_nodes = shards // width
        _find_cuts(light, plan, tolerance * target, bins, level_nodes, columns)
        child = 2 * F.col("node") + F.when(Table(plan, level_nodes, columns).left(), 0).otherwise(1)
        width, level, nodes = width // 2, level + 1, below
        light = common.saved(light.withColumn("node", child), f"nodes{level}")
    return light, nodes


def assign_shards(docs: DataFrame, shards: int = 8, heavy: float = 0.005, tolerance: float = 0.0005, bins: int = 1024,
    slot_rows: int = 200_000, names: tuple[str, ...] = NAMES) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row. shards: a power of two."""
    if shards < 1 or shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    spark = docs.sparkSession
    names = tuple(c for c in names if c in docs.columns)
    dims = [*names, *OWN]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    group = F.concat_ws("-", F.hex(F.xxhash64(text)), F.hex(F.crc32(text.cast("binary"))), F.octet_length(text))
    codes = [name_code(F.col(c)).alias(c) for c in names]
    rows = common.saved(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"), group.alias("group"), *codes), "rows")
    first = F.min(F.struct("doc_id", *names))
    groups = rows.groupBy("group").agg(F.sum("size").alias("weight"), F.min("size").alias("bytes"), first.alias("f"))
    groups = common.saved(
        groups.select("group", "weight", "bytes", F.coalesce("f.doc_id", F.lit(0)).alias("first_id"),
            *[F.col(f"f.{c}").alias(c) for c in names], F.pmod(F.xxhash64("group"), F.lit(1 << 40)).alias("mix")), "groups")
    target = float(groups.agg(F.sum("weight")).first()[0] or 0) / shards
    placed, extra = _dealt_parts(groups, rows, shards, target, heavy)
    whole = groups.where(F.col("weight") <= target)
    heavies = [r.asDict() for r in whole.where(F.col("weight") > heavy * target).collect()]  # fewer than shards / heavy
    light, nodes = grow_tree(whole.where(F.col("weight") <= heavy * target), heavies, dims, shards, extra, target, tolerance, bins)
    homes = light.select("group", F.col("node").cast("int").alias("shard"))
    placed += [(g, 0, 1, s) for g, s in nodes.items()]
    rows = rows.drop(*names)
    if placed:
        known = spark.createDataFrame(placed, "group string, part int, parts int, home int")
        count = known.groupBy("group").agg(F.first("parts").alias("parts"))
        tagged = rows.join(F.broadcast(count), "group", "left").withColumn("part", F.coalesce(_part(), F.lit(0)))
        dealt = tagged.join(F.broadcast(known.drop("parts")), ["group", "part"], "left").select("doc_id", "size", "text_crc32", "group",
            "home")
        big = dealt.where("home IS NOT NULL").withColumnRenamed("home", "shard").drop("group")
        found = dealt.where("home IS NULL").drop("home").join(homes, "group").drop("group").unionByName(big)
    else:
        found = rows.join(homes, "group").drop("group")
    found = common.saved(found, "homes")
    # slots: rows are numbered within parts of bounded size, and parts by a running sum over their counts
    parts = max(1, -(-found.count() // (shards * slot_rows)))
    dealt = found.withColumn("part", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(parts)).cast("int"))
    counts = dealt.groupBy("shard", "part").count()
    before = counts.select("shard", "part",
        (F.sum("count").over(Window.partitionBy("shard").orderBy("part")) - F.col("count")).alias("before"))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "size", "text_crc32")) - 1)
    out = ranked.join(before, ["shard", "part"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("before") + F.col("rank")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
