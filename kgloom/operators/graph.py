"""Graph operators on edge tables: traversal, impact, cycles, hubs, coupling, relevance, governance.

Edges: from_id, to_id, type, confidence, is_active. Bounded traversals are joins on a frontier that is reduced,
de-duplicated and written at every step, so that plans don't grow with depth; parallel edges collapse to the best.
Sets of reached nodes are bits in rows. Nothing is gathered in one group, and nothing collected but loop conditions.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.session import FEW_ROWS, counted, cut, dealt, scratch, ship

from . import catalogs, pairs, substring
from .order import numbered

if TYPE_CHECKING:
    import pyarrow as pa

#: Words of 64 bits in a row of reached nodes.
REACH_WORDS = 8


def _depth(depth: int, least: int = 0) -> int:
    return max(least, min(depth, catalogs.MAX_DEPTH))


def _ways(edges: DataFrame, direction: str) -> DataFrame:
    """src, dst in the direction of travel; active edges only, parallel ones too."""
    live = edges.where("is_active")
    out = live.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))
    back = live.select(F.col("to_id").alias("src"), F.col("from_id").alias("dst"))
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction]


def _steps(edges: DataFrame, direction: str) -> DataFrame:
    """src, dst in the direction of travel; active edges only, each pair once."""
    return _ways(edges, direction).distinct()


def distances(edges: DataFrame, origins: DataFrame, depth: int, direction: str) -> DataFrame:
    """origin, node, depth: the least number of steps from each origin (origins: one column, origin).

    A frontier that has been counted to be small is sent to the edges, which stay where they are; from the first large one on, the
    steps are written once, each pair once, and move."""
    steps, wide = _ways(edges, direction), False
    seen = frontier = cut(origins.select("origin", F.col("origin").alias("node"), F.lit(0).alias("depth")))
    for d in range(1, _depth(depth) + 1):
        n = frontier.count()
        if not n:
            break
        if n > FEW_ROWS and not wide:
            steps, wide = cut(steps.distinct()), True
        near = (F.broadcast(frontier) if n <= FEW_ROWS else frontier).select("origin", F.col("node").alias("src"))
        reached = steps.join(near, "src").select("origin", F.col("dst").alias("node")).distinct()
        frontier = cut(reached.join(seen.select("origin", "node"), ["origin", "node"], "left_anti").withColumn("depth", F.lit(d)))
        seen = seen.unionByName(frontier)
    return seen


def _edges_at(edges: DataFrame, inner: DataFrame, direction: str) -> DataFrame:
    """from_id, to_id, type, confidence of the active edges that leave (out), enter (in) or touch (both) inner's nodes (node, each once); of
    both, equal edges once."""
    live, inner = edges.where("is_active").select("from_id", "to_id", "type", "confidence"), counted(cut(inner))
    if direction != "both":
        return live.join(inner.toDF("from_id" if direction == "out" else "to_id"), "from_id" if direction == "out" else "to_id", "left_semi")
    ends = live.join(inner.select(F.col("node").alias("from_id"), F.lit(True).alias("leaves")), "from_id", "left").join(inner.select(F.col(
        "node").alias("to_id"), F.lit(True).alias("enters")), "to_id", "left")
    return ends.where("leaves OR enters").select("from_id", "to_id", "type", "confidence").distinct()


def neighborhood(edges: DataFrame, origin: str, depth: int = 1, direction: str = "both") -> tuple[DataFrame, DataFrame]:
    """Nodes (node, depth; without the origin) and the edges at nodes nearer than depth."""
    start = edges.sparkSession.createDataFrame([(origin,)], "origin string")
    near = distances(edges, start, depth, direction).select("node", "depth")
    found = _edges_at(edges, near.where(F.col("depth") < _depth(depth)).select("node"), direction)
    return near.where("depth > 0"), found.select("from_id", "to_id", "type", "confidence")


def direct_neighbors(edges: DataFrame, node: str) -> DataFrame:
    """peer, side (dependency or dependent), type of the node's own edges; a loop counts as a dependency."""
    at = (F.col("from_id") == node) | (F.col("to_id") == node)
    out = F.col("from_id") == node
    return edges.where(at).select(F.when(out, F.col("to_id")).otherwise(F.col("from_id")).alias("peer"),
        F.when(out, "dependency").otherwise("dependent").alias("side"), "type")


def impact_weight(kind: Column) -> Column:
    return F.coalesce(*[F.when(kind == k, v) for k, v in catalogs.IMPACT_DECAY.items()], F.lit(catalogs.IMPACT_DECAY_OTHER))


def blast_radius(edges: DataFrame, origins: DataFrame, depth: int = 5) -> DataFrame:
    """origin, node, probability, depth: best product of decay and confidence along inbound paths, above the floor.

    One row a node: its best probability and the least depth that reaches it, most probable first. The origin itself is
    left out. Layers that have been counted to be small are sent to the edges, which stay where they are; from the first large one on,
    parallel edges are collapsed and written once."""
    weights, wide = edges.where("is_active").select(F.col("to_id").alias("src"), F.col("from_id").alias("dst"), (impact_weight(F.col(
        "type")) * F.col("confidence")).alias("w")), False
    layer = cut(origins.select("origin", F.col("origin").alias("node"), F.lit(1.0).alias("p")))
    found = None
    for d in range(1, (_depth(depth, 1) if depth >= 1 else catalogs.MAX_DEPTH) + 1):
        n = layer.count()
        if n > FEW_ROWS and not wide:
            weights, wide = cut(weights.groupBy("src", "dst").agg(F.max("w").alias("w"))), True
        near = (F.broadcast(layer) if n <= FEW_ROWS else layer).select("origin", F.col("node").alias("src"), "p")
        nxt = weights.join(near, "src").select("origin", F.col("dst").alias("node"), (F.col("p") * F.col("w")).alias("p"))
        layer = cut(
            nxt.where((F.col("p") > catalogs.IMPACT_FLOOR) & (F.col("node") != F.col("origin"))).groupBy("origin", "node").agg(
                F.max("p").alias("p")))
        here = layer.withColumn("depth", F.lit(d))
        found = here if found is None else found.unionByName(here)
        if layer.isEmpty():
            break
    best = F.min(F.struct((-F.round("p", 9)).alias("p"), "depth"))
    out = found.groupBy("origin", "node").agg(best.alias("b")).select("origin", "node", F.round(-F.col("b.p"), 6).alias("probability"),
        F.col("b.depth").alias("depth"))
    return out.orderBy(F.desc("probability"), "node")


def _places(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """node, own, r, n: names (node, own, r) with 0, 1, 2, ... for every node, so that nodes near each other have near numbers: they are in
    the order of the smallest node that two steps either way lead to. pairs: a, b, two nodes' r, which is in the order of names."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = cut(both.groupBy("a").agg(F.least(F.min("a"), F.min("b")).alias("label")))
    far = both.join(counted(label.toDF("b", "offer")), "b").groupBy(F.col("a").alias("r")).agg(F.min("offer").alias("label"))
    every = names.join(far, "r", "left").withColumn("label", F.coalesce("label", "r"))
    return cut(numbered(every, "n", "label", "r").drop("label"))


def _reached(steps: pa.Table, sets: pa.Table) -> pa.Table:
    """node, block, words, new words: what a part's nodes have reached of some blocks, known and new, from the part's steps (node, to, words)
    and, in sets (to, node, block, words), what the nodes that these lead to have newly reached, and what is known (to is null)."""
    import numpy as np
    import pyarrow as pa

    words = [c for c in sets.column_names if c.startswith("w")]
    each = 64 * len(words)

    def whole(t: pa.Table) -> np.ndarray:
        out = np.empty((t.num_rows, len(words)), np.int64)
        for i, w in enumerate(words):
            out[:, i] = t[w].to_numpy()
        return out.view(np.uint64)

    known, sets_to, sets_node, sets_block = np.asarray(sets["to"].is_null()), sets["to"].fill_null(-1).to_numpy(), sets["node"].to_numpy(), sets["block"].to_numpy()
    blocks, nodes = np.unique(sets_block), np.unique(np.r_[steps["node"].to_numpy(), sets_node[known]])
    old, new = (np.zeros((len(nodes), len(blocks), len(words)), np.uint64) for _ in range(2))
    got, block = whole(sets), np.searchsorted(blocks, sets_block)
    old[np.searchsorted(nodes, sets_node[known]), block[known]] = got[known]
    flat = new.reshape(len(nodes), len(blocks) * len(words))
    to, bits, row, end = steps["to"].to_numpy(), whole(steps), np.searchsorted(nodes, steps["node"].to_numpy()), sets_node % each
    for t in np.unique(sets_to[~known]):
        held = np.zeros((each, len(blocks), len(words)), np.uint64)
        here = np.flatnonzero(sets_to == t)
        held[end[here], block[here]] = got[here]
        held = held.reshape(each, -1)
        full, ways = held.any(axis=1), np.flatnonzero(to == t)
        for start in range(0, len(ways), 2048):  # at most 2 ** 20 steps at once
            some = ways[start:start + 2048]
            i, j = np.nonzero(np.unpackbits(bits[some].view(np.uint8), axis=1, bitorder="little"))
            i, j = i[full[j]], j[full[j]]
            for k in range(0, len(i), 4096):
                r, e = row[some[i[k:k + 4096]]], j[k:k + 4096]
                first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
                flat[r[first]] |= np.bitwise_or.reduceat(held[e], first, axis=0)
    new &= ~old
    at = np.nonzero((old | new).any(axis=2))
    old, new = (old | new)[at].view(np.int64), new[at].view(np.int64)
    return pa.table({"node": nodes[at[0]], "block": blocks[at[1]], **{w: old[:, i] for i, w in enumerate(words)}, **{f"n{w}": new[:, i] for i, w in
        enumerate(words)}})


def reach_counts(edges: DataFrame, nodes: DataFrame, depth: int, direction: str, part_rows: int = 600_000) -> DataFrame:
    """id, reached: how many nodes each node reaches within depth, without itself.

    What a node reaches is a set of bits in rows (node, block, words), of which only those with bits exist, and few do as near nodes
    have near numbers. Steps are bits too: rows (node, to, words), to a block of nodes. Each round, the steps of some nodes
    meet what the nodes they lead to have newly reached of some blocks, and are merged by bitwise or where they meet, which makes whole rows. Of how
    many nodes and blocks follows from how many there are, so that a task takes at most ``part_rows`` rows of either kind. No graph is copied."""
    spark = ship(edges.sparkSession)
    words, wide = [f"w{i}" for i in range(REACH_WORDS)], 64 * REACH_WORDS
    ways = _ways(edges, direction)
    ids = ways.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("own", F.lit(False)).unionByName(nodes.select(F.col("id").alias(
        "node"), F.lit(True).alias("own"))).groupBy("node").agg(F.bool_or("own").alias("own"))
    names = cut(numbered(ids, "r", "node"))
    ends = counted(names.select("node", "r"))
    pairs = cut(ways.join(ends.toDF("src", "a"), "src").join(ends.toDF("dst", "b"), "dst").select("a", "b").distinct())
    place = _places(pairs, names)
    n_nodes = place.count()
    part_nodes, part_blocks = max(1, part_rows // (n_nodes // wide + 1)), max(1, part_rows // max(1, n_nodes))

    def bits(n: str) -> list[Column]:
        one = F.expr(f"shiftleft(1L, int({n} % 64))")
        return [F.when(F.expr(f"{n} div 64 % {REACH_WORDS}") == i, one).otherwise(F.lit(0).cast("long")).alias(w) for i, w in enumerate(words)]

    known = fresh = cut(place.where("own").select(F.col("n").alias("node"), F.expr(f"n div {wide}").alias("block"), *bits("n")))
    ends = counted(place.select("r", "n"))
    by_number = pairs.join(ends.toDF("a", "s"), "a").join(ends.toDF("b", "t"), "b").select("s", "t")
    part, some = F.expr(f"node div {part_nodes}").alias("part"), F.expr(f"block div {part_blocks}").alias("some")
    steps = cut(by_number.select(F.col("s").alias("node"), F.expr(f"t div {wide}").alias("to"), *bits("t")).groupBy("node", "to").agg(*(F.bit_or(
        w).alias(w) for w in words)).select("*", part))
    parts = counted(cut(steps.select("to", "part").distinct()))
    shape = "node long, block long, " + ", ".join(f"{w} long" for w in [*words, *(f"n{w}" for w in words)])
    for _ in range(_depth(depth)):
        offered = fresh.select(F.expr(f"node div {wide}").alias("to"), "*").join(parts, "to").select("part", some, "to", "node", "block", *words)
        asked = counted(cut(offered.select("part", "some", "to").distinct()))
        own = known.select(part, some, F.lit(None).cast("long").alias("to"), "node", "block", *words)
        both = steps.join(asked, ["part", "to"]).groupBy("part", "some").cogroup(offered.unionByName(own).groupBy("part", "some")).applyInArrow(
            _reached, shape)
        both = cut(both)
        known = both.select("node", "block", *words)
        fresh = both.where(" OR ".join(f"n{w} <> 0" for w in words)).select("node", "block", *(F.col(f"n{w}").alias(w) for w in words))
        if fresh.isEmpty():
            break
    counts = known.groupBy(F.col("node").alias("n")).agg(F.sum(sum(F.bit_count(w).cast("long") for w in words)).alias("k"))
    return place.where("own").join(counts, "n").select(F.col("node").alias("id"), (F.col("k") - 1).alias("reached"))


def impact_percent(edges: DataFrame, nodes: DataFrame, depth: int = 3) -> DataFrame:
    """id, affected, percent: how many other nodes depend on each within depth."""
    counts = reach_counts(edges, nodes, depth, "in")
    total = nodes.agg(F.count("*").alias("n"))
    n = F.col("reached")
    return counts.join(F.broadcast(total)).select("id", n.alias("affected"),
        F.when(F.col("n") > 1, F.round(100.0 * n / (F.col("n") - 1), 4)).otherwise(0.0).alias("percent"))


def _trim(pairs: DataFrame) -> DataFrame:
    """Without pairs at nodes that have no way in or no way out: they lie on no cycle."""
    left, size = pairs, pairs.count()
    while size:
        ins, outs = counted(cut(left.select(F.col("t").alias("s")).distinct())), counted(cut(left.select(F.col("s").alias("t")).distinct()))
        left = cut(left.join(ins, "s", "left_semi").join(outs, "t", "left_semi").select("s", "t"))
        size, before = left.count(), size
        if size == before:
            break
    return left


def _colored_components(pairs: DataFrame) -> DataFrame | None:
    """Forward and backward colouring: every node takes the smallest node that reaches it as its colour; who reaches that node inside
    its colour makes a component with it, all colours at once. What is left is trimmed and coloured again."""
    done, left = None, _trim(pairs)
    while not left.isEmpty():
        color = cut(left.select(F.col("s").alias("node")).distinct().withColumn("color", F.col("node")))
        risen = color
        while True:  # only nodes whose colour has changed offer it again
            offer = left.join(counted(risen).withColumnRenamed("node", "s"), "s").groupBy(F.col("t").alias("node")).agg(F.min("color").alias("offer"))
            nxt = cut(color.join(offer, "node", "left").select("node", F.least("color", F.coalesce("offer", "color")).alias("color"), (F.coalesce(
                "offer", "color") < F.col("color")).alias("moved")))
            color, risen = nxt.select("node", "color"), nxt.where("moved").select("node", "color")
            if risen.isEmpty():
                break
        color = counted(color)
        inside = cut(left.join(color.toDF("s", "color"), "s").join(color.toDF("t", "ct"), "t").where("color = ct").select("s", "t", "color"))
        back = news = cut(color.where("node = color"))
        while not news.isEmpty():
            offer = inside.join(counted(news).select(F.col("node").alias("t"), "color"), ["t", "color"]).select(F.col("s").alias("node"), "color")
            news = cut(offer.join(counted(back), ["node", "color"], "left_anti").distinct())
            back = cut(back.unionByName(news))
        found = cut(back.select("node", F.col("color").alias("component")))
        done = found if done is None else done.unionByName(found)
        gone = counted(found.select("node"))
        rest = left.join(gone.toDF("s"), "s", "left_anti").join(gone.toDF("t"), "t", "left_anti")
        left = _trim(cut(rest.select("s", "t")))
    return done


def strongly_connected(edges: DataFrame) -> DataFrame:
    """node, component (smallest member): components of two nodes and more, and nodes with a loop. All edges given count. Joins
    only: pairs are dealt once, by their ends and in parts that counts make small, so that what nodes offer is reduced where it is made;
    what is known of nodes is sent to the pairs where it has been counted to be few."""
    spark = edges.sparkSession
    ends = edges.select(F.col("from_id").alias("s"), F.col("to_id").alias("t"), F.expr("pmod(xxhash64(from_id), 8)").alias("eighth"))
    pairs = cut(dealt(ends, edges.count(), "t", "eighth").distinct().select("s", "t"))
    loops = pairs.where("s = t").select(F.col("s").alias("node"), F.col("s").alias("component"))
    with scratch(spark):
        found = _colored_components(pairs.where("s <> t"))
        done = cut(found if found is not None else loops.limit(0), keep=True)
    big = done.groupBy("component").agg(F.count("*").alias("n")).where("n >= 2").select("component")
    out = done.join(big, "component", "left_semi").select("node", "component")
    return out.unionByName(loops.join(out.select("node"), "node", "left_anti"))


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, in_degree, out_degree, degree for every node."""
    ends = edges.select(
        F.explode(
            F.array(F.struct(F.col("from_id").alias("id"), F.lit(0).alias("i")),
                F.struct(F.col("to_id").alias("id"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    counts = ends.groupBy("id").agg(F.sum("i").alias("i"), F.count("*").alias("d"))
    i, d = F.coalesce("i", F.lit(0)), F.coalesce("d", F.lit(0))
    return nodes.select("id").join(counts, "id", "left").select("id", i.alias("in_degree"), (d - i).alias("out_degree"), d.alias("degree"))


def central(edges: DataFrame, nodes: DataFrame, most: int = 5) -> DataFrame:
    """The nodes of the highest degree."""
    return degrees(edges, nodes).orderBy(F.desc("degree"), "id").limit(most).select("id", "degree")


def supernodes(edges: DataFrame, nodes: DataFrame, sigmas: float = 4.0) -> DataFrame:
    """Nodes of a degree over mean + sigmas deviations and over 3, in graphs of 4 nodes and more."""
    deg = degrees(edges, nodes)
    stats = deg.agg(F.count("*").alias("n"), F.avg("degree").alias("mean"), F.stddev_pop("degree").alias("sd"))
    return deg.join(F.broadcast(stats)).where(
        (F.col("n") >= 4) & (F.col("degree") > 3) & (F.col("degree") > F.col("mean") + sigmas * F.col("sd"))).select("id", "degree")


def shared_table_coupling(accesses: DataFrame) -> DataFrame:
    """Tables that two or more services read or write: table_id, services (how many)."""
    return accesses.groupBy(F.col("to_id").alias("table_id")).agg(F.countDistinct("from_id").alias("services")).where("services >= 2")


def relevance_weight(kind: Column) -> Column:
    return F.coalesce(*[F.when(kind == k, v) for k, v in catalogs.RELEVANCE_WEIGHT.items()], F.lit(catalogs.RELEVANCE_OTHER))


def relevance(edges: DataFrame, origin: str, depth: int = 2, direction: str = "both", passes: int = 6, back_off: bool = True) -> tuple[
    DataFrame, DataFrame, int]:
    """The neighbourhood's relevant part: nodes (node, score), the edges between them or with the origin, and the depth used.

    A node's score is the best product of weight and confidence along the neighbourhood's edges, in either direction, from
    the origin's 1; those at the floor and over are kept, the best 200, ties by id, the origin not counted. Where more pass, the
    neighbourhood shrinks by a step and is scored again (``back_off``). Passes are synchronous and end when nothing rises."""
    spark, depth = edges.sparkSession, _depth(depth, 1)
    start = spark.createDataFrame([(origin,)], "origin string")
    far = cut(distances(edges, start, depth, direction).select("node", "depth"))
    while True:
        near = cut(_edges_at(edges, far.where(F.col("depth") < depth).select("node"), direction))
        w = relevance_weight(F.col("type")) * F.col("confidence")
        steps = cut(
            near.select(
                F.explode(
                    F.array(F.struct(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), w.alias("w")),
                        F.struct(F.col("to_id").alias("src"), F.col("from_id").alias("dst"), w.alias("w")))).alias("e")).groupBy("e.src",
                "e.dst").agg(F.max("e.w").alias("w")))
        score = risen = cut(spark.createDataFrame([(origin, 1.0)], "node string, score double"))
        for _ in range(passes):  # a path's product only falls, so what is under the floor never returns
            offer = counted(risen).join(steps, risen["node"] == steps["src"]).where(F.col("dst") != origin).groupBy(F.col("dst").alias("node")).agg(
                F.max(F.col("score") * F.col("w")).alias("offer"))
            offer = offer.where(F.col("offer") >= catalogs.RELEVANCE_FLOOR - 1e-12)
            both = cut(
                score.join(offer, "node", "full_outer").select("node", F.greatest("score", "offer").alias("score"),
                    (F.col("score").isNull() | (F.col("offer") > F.col("score"))).alias("rose")))
            score, risen = both.select("node", "score"), both.where("rose").select("node", "score")
            if risen.isEmpty():
                break
        scored = score.where(F.col("node") != origin)
        if not back_off or depth <= 1 or scored.count() <= catalogs.RELEVANCE_NODES:
            break
        depth -= 1
    kept = scored.select("node", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "node").limit(catalogs.RELEVANCE_NODES)
    ids = F.broadcast(cut(kept.select("node").unionByName(start.toDF("node"))))  # at most as many as are kept, and one
    inside = near.join(ids.toDF("from_id"), "from_id", "left_semi").join(ids.toDF("to_id"), "to_id", "left_semi")
    return kept, inside.select("from_id", "to_id", "type", "confidence"), depth


def _exact(hops: int) -> str:
    """Holds a product of so many confidences of six decimal places."""
    return f"decimal({6 * hops + 1},{6 * hops})"


def transitive_dependencies(edges: DataFrame, kinds: tuple[str, ...] = ("IMPORTS", "DEPENDS_ON"), depth: int = 5,
    floor: float = 0.5) -> DataFrame:
    """from_id, to_id, hops, confidence, chain: the most confident chain of 2..depth dependencies without repeated nodes, the
    shorter and then the first by its nodes of equal ones. Chains under ``floor`` are rejected as soon as they fall there.

    Confidences count to six places and multiply exactly; the product is rounded half up once, to six places. A layer holds,
    for each two nodes, the best walk of so many steps that does not return to its start, and the best one with another first
    step: two rows, however many chains there are. Before they meet, walks and steps are left out that even the other side's best
    at that node would not keep over ``floor``. No more is needed: a walk that repeats a node is beaten by the one without
    that loop, which is shorter and no less confident, unless only the direct dependency is left of it; that begins with the
    step to the end itself, and such walks are passed over for the one with another first step."""
    depth = _depth(depth)
    if depth > 5:
        raise ValueError("products of more than five confidences do not fit exactly")
    c = F.col("confidence").cast(_exact(1))
    best = cut(edges.where(F.col("is_active") & F.col("type").isin(*kinds)).groupBy("from_id", "to_id").agg(F.max(c).alias("c")).where(
        (F.col("c") >= F.lit(floor).cast("decimal(10,9)")) & (F.col("from_id") != F.col("to_id"))))
    layer = best.select("from_id", "to_id", F.col("to_id").alias("first"), "c", F.array("from_id", "to_id").alias("path"))
    step = best.select(F.col("from_id").alias("mid"), F.col("to_id").alias("end"), F.col("c").alias("c2"))
    most_out = counted(cut(best.groupBy(F.col("from_id").alias("to_id")).agg(F.max("c").alias("top"))))
    ranked = Window.partitionBy("from_id", "to_id").orderBy(F.desc("c"), "path")
    found = None
    for hops in range(2, depth + 1):
        product, least = (F.col("c") * F.col("c2")).cast(_exact(hops)), F.lit(floor).cast("decimal(10,9)")
        kept = cut(layer.join(most_out, "to_id").where((F.col("c") * F.col("top")).cast(_exact(hops)) >= least).drop("top"))
        most_in = counted(cut(kept.groupBy(F.col("to_id").alias("mid")).agg(F.max("c").alias("top"))))
        fit = step.join(most_in, "mid").where((F.col("top") * F.col("c2")).cast(_exact(hops)) >= least).drop("top")
        longer = kept.join(fit, F.col("to_id") == F.col("mid")).where(F.col("end") != F.col("from_id")).select("from_id", F.col("end").alias(
            "to_id"), "first", product.alias("c"), F.concat("path", F.array("end")).alias("path")).where(F.col("c") >= F.lit(floor).cast(
            "decimal(10,9)"))
        top = longer.groupBy("from_id", "to_id", "first").agg(F.min(F.struct((-F.col("c")).alias("c"), "path")).alias("b"))
        top = top.select("from_id", "to_id", "first", (-F.col("b.c")).alias("c"), "b.path")
        layer = cut(top.withColumn("n", F.row_number().over(ranked)).where("n <= 2").drop("n"))
        here = layer.where("first <> to_id").select("from_id", "to_id", F.lit(hops).alias("hops"), F.col("c").cast(_exact(5)).alias("c"), "path")
        found = here if found is None else found.unionByName(here)
        if layer.isEmpty():
            break
    out = found.groupBy("from_id", "to_id").agg(F.min(F.struct((-F.col("c")).alias("c"), "hops", "path")).alias("b"))
    return out.select("from_id", "to_id", F.col("b.hops").alias("hops"), F.round(-F.col("b.c"), 6).cast("double").alias("confidence"),
        F.array_join("b.path", ">").alias("chain"))


def health_audit(entities: DataFrame, edges: DataFrame, accesses: DataFrame) -> DataFrame:
    """All smells of the active edges: smell, severity, subject, size."""
    live = edges.where("is_active") if "is_active" in edges.columns else edges
    cycles = strongly_connected(live).groupBy("component").agg(F.count("*").alias("size")).select(F.lit("circular_dependency").alias("smell"),
        F.lit("CRITICAL").alias("severity"), F.col("component").alias("subject"), "size")
    hubs = supernodes(live, entities).select(F.lit("supernode").alias("smell"), F.lit("MEDIUM").alias("severity"),
        F.col("id").alias("subject"), F.col("degree").alias("size"))
    shared = shared_table_coupling(accesses).select(F.lit("shared_database_coupling").alias("smell"), F.lit("HIGH").alias("severity"),
        F.col("table_id").alias("subject"), F.col("services").alias("size"))
    return cycles.unionByName(hubs).unionByName(shared)


def entry_points(entities: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = ("CALLS",)) -> DataFrame:
    called = edges.where(F.col("type").isin(*kinds)).select(F.col("to_id").alias("id")).distinct()
    return entities.where("type = 'SERVICE'").join(called, "id", "left_anti").select("id")


def orphans(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities other than services that nothing points to."""
    return entities.where("type <> 'SERVICE'").join(edges.select(F.col("to_id").alias("id")).distinct(), "id", "left_anti").select("id")


def roots(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Where a tree starts: services that nothing points to; if none, all services; if none, all entities."""
    services = entities.where("type = 'SERVICE'").select("id")
    free = services.join(edges.select(F.col("to_id").alias("id")).distinct(), "id", "left_anti")
    rank = free.withColumn("r", F.lit(0)).unionByName(services.withColumn("r", F.lit(1))).unionByName(
        entities.select("id").withColumn("r", F.lit(2)))
    least = rank.agg(F.min("r").alias("r"))
    return rank.join(F.broadcast(least), "r", "left_semi").select("id")


def readers_writers(accesses: DataFrame) -> DataFrame:
    """table_id, readers, writers (sorted lists of distinct services), n_readers, n_writers."""
    one = lambda k: F.array_sort(F.collect_set(F.when(F.col("type") == k, F.col("from_id"))))
    out = accesses.groupBy(F.col("to_id").alias("table_id")).agg(one("READS_FROM").alias("readers"), one("WRITES_TO").alias("writers"))
    return out.withColumns({"n_readers": F.size("readers").cast("long"), "n_writers": F.size("writers").cast("long")})


def service_accesses(accesses: DataFrame) -> DataFrame:
    """service_id, reads, writes (sorted lists of distinct tables)."""
    one = lambda k: F.array_sort(F.collect_set(F.when(F.col("type") == k, F.col("to_id"))))
    return accesses.groupBy(F.col("from_id").alias("service_id")).agg(one("READS_FROM").alias("reads"), one("WRITES_TO").alias("writes"))


def visible(entities: DataFrame, edges: DataFrame, hidden: set[str]) -> tuple[DataFrame, DataFrame]:
    """Entities of types that aren't hidden, and the edges between them."""
    shown = entities.where(~F.col("type").isin(sorted(hidden))) if hidden else entities
    ids = shown.select("id")
    return shown, edges.join(ids.toDF("from_id"), "from_id", "left_semi").join(ids.toDF("to_id"), "to_id", "left_semi").select(
        *edges.columns)


def within(entities: DataFrame, edges: DataFrame, namespace: str) -> DataFrame:
    """Active edges of which both ends, active or not, lie in the namespace."""
    ids = entities.where(F.col("namespace") == namespace).select("id")
    return edges.where("is_active").join(ids.toDF("from_id"), "from_id", "left_semi").join(ids.toDF("to_id"), "to_id", "left_semi").select(
        *edges.columns)


def slow_callers(edges: DataFrame, latencies: DataFrame, over: float, share: float = 0.99) -> DataFrame:
    """Edges whose caller's latency (latencies: id, value) at that share lies over a limit: from_id, to_id, p99."""
    at = F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY value)").alias("p99")
    slow = latencies.groupBy(F.col("id").alias("from_id")).agg(at).where(F.col("p99") > over)
    return edges.join(slow, "from_id").select("from_id", "to_id", "p99")


def protected_by(entities: DataFrame, edges: DataFrame, guard: str) -> DataFrame:
    """Services with any edge to the guard, without the guard itself."""
    return entities.where((F.col("type") == "SERVICE") & (F.col("id") != guard)).join(
        edges.where(F.col("to_id") == guard).select(F.col("from_id").alias("id")), "id", "left_semi").select("id")


def ownerless(entities: DataFrame) -> DataFrame:
    """Services whose properties (JSON) name neither an owner nor a primary owner's team."""
    owner = F.coalesce(F.get_json_object("properties", "$.owner"), F.lit(""))
    team = F.coalesce(F.get_json_object("properties", "$.primary_owner.team_name"), F.lit(""))
    return entities.where((F.col("type") == "SERVICE") & (owner == "") & (team == "")).select("id")


# The rule that a smell breaks.
SMELL_RULES = {"circular_dependency": "no-circular-dependencies", "shared_database_coupling": "shared-database-table",
    "require-service-owners": "require-service-owners"}


def governance(smells: DataFrame, unowned: DataFrame, rules: DataFrame) -> DataFrame:
    """rule_id, rule, subject, severity, outcome of all smells (smell, severity, subject) and of unowned services (id).

    A rule (id, name, severity) sets its smell's severity; otherwise the smell's own stays, HIGH for unowned services. Exactly
    FAIL and WARN count, all else is SILENT; smells without a rule, such as supernodes, too."""
    missing = unowned.select(F.lit("require-service-owners").alias("smell"), F.lit("HIGH").alias("severity"), F.col("id").alias("subject"))
    found = smells.select("smell", "severity", "subject").unionByName(missing)
    rule = F.coalesce(*[F.when(F.col("smell") == k, v) for k, v in SMELL_RULES.items()], F.lit(""))
    last = rules.withColumn("__n", F.monotonically_increasing_id()).groupBy(F.col("name").alias("rule")).agg(
        F.max_by(F.struct(F.col("id"), F.col("severity")), "__n").alias("r"))
    out = found.withColumn("rule", rule).join(F.broadcast(last), "rule", "left")
    severity = F.coalesce("r.severity", "severity")
    outcome = F.when(severity == "FAIL", "FAIL").when(severity == "WARN", "WARN").otherwise("SILENT")
    return out.select(F.coalesce("r.id", F.lit("UNKNOWN")).alias("rule_id"), "rule", "subject", severity.alias("severity"),
        outcome.alias("outcome"))


def change_risk(affected: Column) -> Column:
    return F.when(affected > 5, "High").when(affected > 2, "Medium").otherwise("Low")


def affected_names(affected: DataFrame, entities: DataFrame, most: int = 80) -> DataFrame:
    """origin, names: the services and endpoints among affected (origin, node, probability), the likeliest first; cut to ``most``
    characters, None if there are none."""
    shown = entities.where(F.col("type").isin("SERVICE", "API_ENDPOINT")).select(F.col("id").alias("node"),
        F.format_string("`%s` (%s)", "canonical_name", "type").alias("label"))
    ranked = F.array_sort(F.collect_list(F.when(F.col("label").isNotNull(), F.struct((-F.col("probability")).alias("p"), "node", "label"))))
    names = F.array_join(F.transform(ranked, lambda x: x["label"]), ", ")
    out = affected.join(shown, "node", "left").groupBy("origin").agg(names.alias("n"))
    text = F.when(F.col("n") == "", "None").when(F.char_length("n") > most,
        F.concat(F.substring("n", 1, most - 3), F.lit("..."))).otherwise(F.col("n"))
    return out.select("origin", text.alias("names"))


def smells_of(smells: DataFrame, names: DataFrame) -> DataFrame:
    """Smells with a subject that holds one of the names (name), or that one of them holds, by an index of q-grams."""
    smells = cut(smells)  # read three times
    pairs = substring.touching(smells.select(F.col("subject").alias("text")), names.select(F.col("name").alias("text")))
    return smells.join(pairs.select(F.col("a").alias("subject")), "subject", "left_semi")


def suggestions(smells: DataFrame, unowned: DataFrame | None = None) -> DataFrame:
    """smell, subject, suggestion: an advice for each kind of smell, and for unowned services (id)."""
    advice = F.when(F.col("smell") == "circular_dependency", F.format_string("Break the cycle of %d nodes around %s", "size", "subject")).when(
        F.col("smell") == "shared_database_coupling", F.format_string("Let one service own table %s, which %d use", "subject", "size")
    ).when(F.col("smell") == "supernode", F.format_string("Divide hub %s of degree %d", "subject", "size"))
    out = smells.select("smell", "subject", advice.alias("suggestion"))
    if unowned is not None:
        out = out.unionByName(
            unowned.select(F.lit("require-service-owners").alias("smell"), F.col("id").alias("subject"),
                F.format_string("Assign an owner to %s", "id").alias("suggestion")))
    return out


def resolve_locations(places: DataFrame, entities: DataFrame, parts: bool = True) -> DataFrame:
    """The entity of each (path, line; null: any): equal paths or a suffix either way, at the line or around it; first by name.

    Paths and files meet by equality of their ends, ranges and lines by buckets (``substring``). Places that find nothing so are
    matched by part of a path either way (``parts``), through an index of q-grams. An entity without an end has its start line
    alone."""
    left = cut(places.select("path", "line").distinct())
    right = entities.select(F.col("id").alias("entity_id"), F.col("name").alias("entity_name"), F.col("file").alias("file"), "start_line",
        F.coalesce("end_line", "start_line").alias("end_line"))
    first = F.min_by("entity_id", F.struct("entity_name", "entity_id")).alias("entity_id")

    def hits(rows: DataFrame, pairs: DataFrame) -> DataFrame:
        return substring.at_lines(rows.join(pairs, "path"), right, ["file"]).groupBy("path", "line").agg(first)

    found = hits(left, substring.path_matches(left, right))
    if not parts:
        return found
    found = cut(found)
    rest = cut(left.join(found, (left["path"] == found["path"]) & left["line"].eqNullSafe(found["line"]), "left_anti"))
    pairs = substring.touching(rest.select(F.col("path").alias("text")), right.select(F.col("file").alias("text"))).toDF("path", "file")
    return found.unionByName(hits(rest, pairs))


def longest_prefix(files: DataFrame, projects: DataFrame) -> DataFrame:
    """The deepest project directory above each file, else '.': files are matched on each of their own directories."""
    parts = F.split("path", "/")
    dirs = files.select("path",
        F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("project"))
    found = dirs.join(projects.select("project"), "project").groupBy("path").agg(F.max_by("project", F.length("project")).alias("project"))
    return files.select("path").join(found, "path", "left").select("path", F.coalesce("project", F.lit(".")).alias("project"))


def change_coupling(commits: DataFrame, since: Column | None = None, most_files: int | None = None, salt_rows: int = 10_000) -> DataFrame:
    """left_id, right_id, together, coupling: shared commits over commits of either (commits: commit_id, id, at with ``since``).

    A commit of many files makes as many pairs as their number squared; ``most_files`` leaves larger commits out of the
    pairs, if wanted. One side of a commit is split by salts of about ``salt_rows`` rows, so no task has a huge commit alone; rows and
    pairs are dealt in parts that counts make small."""
    rows = commits if since is None else commits.where(F.col("at") >= since)
    rows = cut(rows.select("commit_id", "id").distinct())
    counts = rows.groupBy("id").agg(F.count("*").alias("n"))
    sizes = rows.groupBy("commit_id").agg(F.count("*").alias("size"))
    if most_files is not None:
        sizes = sizes.where(F.col("size") <= most_files)
    sizes = cut(sizes)
    total = sizes.agg(F.coalesce(F.sum(F.expr(f"size * ceil(size / {salt_rows})")), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.expr(
        "size * (size - 1) div 2")), F.lit(0)).alias("pairs")).first()
    sized = rows.join(sizes, "commit_id")
    salts = F.ceil(F.col("size") / salt_rows).cast("int")
    left = sized.select("commit_id", F.col("id").alias("left_id"), F.pmod(F.xxhash64("id"), salts).cast("int").alias("salt"))
    right = sized.select("commit_id", F.col("id").alias("right_id"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    left, right = (dealt(x, total["rows"], "commit_id", "salt") for x in (left, right))
    met = left.join(right, ["commit_id", "salt"]).where("left_id < right_id").select("left_id", "right_id")
    pairs = dealt(met, total["pairs"], "left_id", "right_id").groupBy("left_id", "right_id").agg(F.count("*").alias("together"))
    counts = counted(cut(counts))
    out = pairs.join(counts.toDF("left_id", "nl"), "left_id").join(counts.toDF("right_id", "nr"), "right_id")
    return out.select("left_id", "right_id", "together",
        F.round(F.col("together") / (F.col("nl") + F.col("nr") - F.col("together")), 6).alias("coupling"))


def coupled_above(commits: DataFrame, per_cent: int, salt_rows: int = 10_000) -> DataFrame:
    """left_id, right_id, together, coupling of the pairs of ``change_coupling`` with a coupling of at least so many per cent (1 to 100).

    Two ids that share so much share one of each one's rarest commits, as many as it may lose and one more, and are not too different
    in number. Such pairs are made and looked up from the one with fewer commits, if that takes fewer rows than to count all pairs of
    each commit, as it does where few commits are large; otherwise these are counted, each id dealt the lists of ids in its commits (``pairs``), and
    only those leave a task that share enough for the left one's number of commits. Both ways are exact, and their rows known from
    counts before they are made. Ids are numbers in their own order until the end."""
    rows = commits.select("commit_id", "id").where("id IS NOT NULL")
    names = cut(numbered(rows.select("id").distinct(), "k", "id").withColumn("k", F.col("k").cast("int")))
    known = counted(names)
    rows = cut(rows.join(known, "id").select("commit_id", "k").distinct())
    counts = cut(rows.groupBy("k").agg(F.count("*").alias("n")))
    few, rows = counted(counts), rows.where("commit_id IS NOT NULL")
    sizes = cut(rows.groupBy("commit_id").agg(F.count("*").alias("size")))
    # of an id with n commits, all but the must - 1 most frequent are rare
    must = F.expr(f"(n * {per_cent} + 99) div 100")
    sums = lambda df, **of: df.agg(*(F.coalesce(F.expr(x), F.lit(0)).alias(c) for c, x in of.items())).first()
    total = sums(sizes, pairs="sum(size * (size - 1) div 2)", rows="sum(size)", commits="count(*)")
    own = sums(counts.withColumn("rare", F.col("n") - must + 1), most="max(n)", rare="sum(rare)")

    def looked_up() -> DataFrame | None:
        """Pairs that meet at a rare commit, with what they share, or None if that takes more rows than to count all pairs, as is plain
        where even commits of equal size would leave half of the pairs."""
        if own["rare"] * (own["rare"] - total["commits"]) >= total["pairs"] * total["commits"]:
            return None
        ranked = rows.join(sizes, "commit_id").withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("size", "commit_id")))
        rare = cut(ranked.join(few, "k").where(F.col("r") <= F.col("n") - must + 1).drop("r"))
        squares = rare.groupBy("commit_id").count().agg(F.coalesce(F.sum(F.expr("count * (count - 1) div 2")), F.lit(0))).first()[0]
        if squares >= total["pairs"] // 2:
            return None
        salts = F.ceil(F.col("size") / salt_rows).cast("int")
        left = rare.select("commit_id", F.col("k").alias("a"), F.col("n").alias("na"), F.pmod(F.xxhash64("k"), salts).cast("int").alias("salt"))
        right = rare.select("commit_id", F.col("k").alias("b"), F.col("n").alias("nb"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
        near = cut(left.join(right, ["commit_id", "salt"]).where(f"a < b AND 100 * least(na, nb) >= {per_cent} * greatest(na, nb)").select("a", "b", "na",
            "nb").distinct())
        if (near.agg(F.sum(F.least("na", "nb")).alias("n")).first()["n"] or 0) >= total["pairs"]:
            return None
        fewer = F.col("na") <= F.col("nb")
        near = near.select("a", "b", F.when(fewer, F.col("a")).otherwise(F.col("b")).alias("few"), F.when(fewer, F.col("b")).otherwise(F.col("a")).alias("many"))
        return near.join(rows.toDF("commit_id", "few"), "few").join(rows.toDF("commit_id", "many"), ["many", "commit_id"]).groupBy("a", "b").agg(F.count(
            "*").alias("n"))

    def all_counted() -> DataFrame:
        n_slots = pairs.slots(own["most"], total["pairs"], total["rows"])
        packed = rows.join(sizes, "commit_id").select("commit_id", "size", "k", *pairs.pack("k", "size", n_slots)).groupBy("commit_id", "size", "slot", "pack").agg(
            F.collect_list("k").alias("others"))
        packed = cut(packed.select("*", F.ceil(F.col("size") / (1000.0 * n_slots)).alias("packs")))
        # each list of a commit meets a copy of each other
        left = packed.select("commit_id", F.col("slot").alias("own_slot"), F.col("pack").alias("own"), F.col("others").alias("lefts"))
        right = packed.select("commit_id", "slot", "others", "packs", F.explode(F.expr(f"sequence(0L, {n_slots - 1}L)")).alias("own_slot")).select(
            "*", F.explode(F.expr("sequence(0L, packs - 1)")).alias("own")).drop("packs")
        met = left.join(right, ["commit_id", "own_slot", "own"]).select("slot", F.explode("lefts").alias("a"), "others")
        later = met.select("a", "slot", F.filter("others", lambda x: x > F.col("a")).alias("others")).where(F.size("others") > 0)
        least = few.select(F.col("k").alias("a"), must.cast("int").alias("least"))
        return pairs.counted(later.join(least, "a"), total["pairs"])

    found = looked_up()
    both = (all_counted() if found is None else found).join(few.toDF("a", "nl"), "a").join(few.toDF("b", "nr"), "b").withColumnRenamed("n", "together")
    union = F.col("nl") + F.col("nr") - F.col("together")
    both = both.where(100 * F.col("together") >= per_cent * union)
    return both.join(known.toDF("left_id", "a"), "a").join(known.toDF("right_id", "b"), "b").select("left_id", "right_id", "together", F.round(F.col(
        "together") / union, 6).alias("coupling"))
