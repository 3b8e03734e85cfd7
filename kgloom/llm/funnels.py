"""Ordered funnels: attempts that walk through kinds of rows in order, by binary search in sorted arrays.

Each row of a funnel's first kind starts an attempt. The next step is the client's earliest row of its kind later than the
step before; it is reached unless it lies more than ``within`` after the first step, or a row of an excluded kind lies after
the step before and not after the next.

A client may hold most rows, so none is kept together: time is cut into blocks whose length follows from the number of rows
and their span (three numbers from one aggregation), and a block also gets the rows of the ``within`` after its end, which is
as far as its attempts can look. Pieces (client, block) are dealt into buckets of about ``piece_rows`` rows. In a bucket every
(piece, time) has a position; each kind's positions are a sorted int64 array, and ``numpy.searchsorted`` (side right) finds
the next step and the next excluded row of all attempts at once.

What leaves a bucket are counts of attempts by step and time since the step before. Percentiles are exact: counts by cells of
65,536 microseconds (no more than ``within`` has, per client) say which cell holds the wanted rank, and ``numpy.partition``
selects among that cell's times.

Rows with a null client, kind or time are left out, as are kinds that no funnel names; repeated rows count once. Rows of equal time
are not after each other. An empty table gives no rows. Other columns of the table are ignored. A client whose rows crowd in
one block's time makes that block large: blocks follow the mean density, and are never shorter than twice ``within``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Fixed values of the contract: each funnel's steps and its excluded kinds.
FUNNELS = {
    "A": (("view", "click", "view", "purchase"), ("error",)),
    "B": (("signup", "view", "click", "purchase"), ("error",)),
    "C": (("click", "click", "purchase", "view"), ("signup",)),
}
MINUTE = 60_000_000
CELL = 1 << 16
#: Times of a cell that are written out one by one for the selection; beyond it the counts are walked.
SPREAD = 1 << 20


def micros(df: DataFrame, name: str) -> Column:
    """A timestamp as microseconds since 1970; one without a zone is read as it stands, whatever the session's zone is."""
    if dict(df.dtypes)[name] != "timestamp_ntz":
        return F.unix_micros(F.col(name).cast("timestamp"))
    fraction = F.expr(f"extract(SECOND FROM `{name}`)") * 1_000_000
    return (F.unix_date(F.to_date(name)).cast("long") * 1440 + F.hour(name) * 60 + F.minute(name)) * MINUTE + fraction.cast("long")


def _walk(kinds: dict[int, np.ndarray], own: np.ndarray, piece: np.ndarray, time: np.ndarray, steps: list[int], excluded: list[int],
    within: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each step, the positions of the first steps of the attempts that reach it, and the times since the step before."""
    first = kinds[steps[0]]
    first = first[own[first]]
    at, out = first, [(first, np.zeros(len(first), np.int64))]
    for kind in steps[1:]:
        there = kinds[kind]
        to = np.searchsorted(there, at, side="right")
        good = to < len(there)
        first, at, to = first[good], at[good], there[to[good]]
        good = (piece[to] == piece[at]) & (time[to] - time[first] <= within)
        for bad in excluded:
            stops = np.append(kinds[bad], len(piece))
            good &= stops[np.searchsorted(stops, at, side="right")] > to
        out.append((first[good], time[to[good]] - time[at[good]]))
        first, at = first[good], to[good]
    return out


def kth(values: np.ndarray, counts: np.ndarray, k: int) -> int:
    """The k-th smallest (from 1) of values that occur so often."""
    if counts.sum() <= SPREAD:
        return int(np.partition(np.repeat(values, counts), k - 1)[k - 1])
    order = np.argsort(values)
    return int(values[order[np.searchsorted(np.cumsum(counts[order]), k)]])


def _attempts(events: DataFrame, funnels: dict, within: int, piece_rows: int) -> DataFrame:
    """funnel, client_id, step, gap (time since the step before; 0 for the first) and how many attempts reached the step so."""
    names = sorted({k for steps, excluded in funnels.values() for k in (*steps, *excluded)})
    code = {k: i for i, k in enumerate(names)}
    rows = events.where(F.col("kind").isin(names) & F.col("client_id").isNotNull() & F.col("arrived_at").isNotNull())
    rows = rows.select(F.col("client_id").cast("long").alias("client_id"), F.array_position(F.array(*map(F.lit, names)), F.col("kind")).cast(
        "int").alias("kind"), micros(events, "arrived_at").alias("t"))
    n, low, high = rows.agg(F.count("*"), F.min("t"), F.max("t")).first()
    pieces = max(1, -(-n // piece_rows))
    length = max(2 * within, -(-((high or 0) - (low or 0) + 1) // pieces))
    block = F.expr(f"t div {length} - if(pmod(t, {length}) <> t % {length}, 1, 0)")
    near = F.when(F.pmod("t", F.lit(length)) <= within, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    dealt = rows.distinct().withColumn("block", block).select("client_id", "kind", "t", "block", F.explode(near).alias("early"))
    dealt = dealt.withColumns({"block": F.col("block") - F.col("early"), "own": F.col("early") == 0})
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("client_id", "block"), F.lit(pieces)))
    plans = [(name, [code[k] for k in steps], [code[k] for k in excluded]) for name, (steps, excluded) in funnels.items()]

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        client, cut, t, kind = (group[c].to_numpy() for c in ("client_id", "block", "t", "kind"))
        order = np.lexsort((kind, t, cut, client))
        client, cut, t, kind, own = client[order], cut[order], t[order], kind[order] - 1, group["own"].to_numpy()[order]
        new_piece = np.ones(len(t), bool)
        new_piece[1:] = (client[1:] != client[:-1]) | (cut[1:] != cut[:-1])
        new = new_piece.copy()
        new[1:] |= t[1:] != t[:-1]
        at = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        piece, time, own, client = (np.cumsum(new_piece) - 1)[starts], t[starts], own[starts], client[starts]
        kinds = {k: at[kind == k] for k in range(len(names))}
        out = []
        for name, steps, excluded in plans:
            for step, (first, gap) in enumerate(_walk(kinds, own, piece, time, steps, excluded, within), 1):
                both, n = np.unique(np.stack([client[first], gap]), axis=1, return_counts=True)
                out.append(pd.DataFrame({"funnel": name, "client_id": both[0], "step": step, "gap": both[1], "n": n}))
        return pd.concat(out)

    return dealt.groupBy("bucket").applyInPandas(walk, "funnel string, client_id long, step int, gap long, n long")


def _percentiles(gaps: DataFrame, per_cent: int, buckets: int) -> DataFrame:
    """The ceil(per_cent * n / 100)-th smallest gap of each funnel, client and step."""
    key = ["funnel", "client_id", "step"]
    cell = F.expr(f"gap div {CELL}").alias("cell")
    whole = Window.partitionBy(*key)
    so_far = whole.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    cells = gaps.groupBy(*key, cell).agg(F.sum("n").alias("n")).withColumns({"upto": F.sum("n").over(so_far), "all": F.sum("n").over(whole)})
    wanted = cells.withColumn("want", F.expr(f"({per_cent} * all + 99) div 100")).where("upto - n < want AND want <= upto")
    wanted = wanted.select(*key, "cell", (F.col("want") - F.col("upto") + F.col("n")).alias("k"))
    left = gaps.select(*key, "gap", "n", cell).join(wanted, [*key, "cell"])
    left = left.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)))

    def select(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(key, ignore_index=True)
        first = np.flatnonzero((group[key] != group[key].shift()).any(axis=1).to_numpy())
        gap, n, k = (group[c].to_numpy() for c in ("gap", "n", "k"))
        ends = np.append(first[1:], len(group))
        found = [kth(gap[a:b], n[a:b], k[a]) for a, b in zip(first.tolist(), ends.tolist(), strict=True)]
        return group.loc[first, key].assign(value=np.array(found, np.int64))

    return left.groupBy("bucket").applyInPandas(select, "funnel string, client_id long, step int, value long")


def count_funnels(events: DataFrame, funnels: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = FUNNELS, within: int = 5 * MINUTE,
    per_cent: int = 25, piece_rows: int = 20_000) -> DataFrame:
    """events (client_id, kind, arrived_at) by funnel and client with attempts: n1, n2, ... attempts that reach each step, the
    ``deepest`` step, t2, ... percentiles of the times from the step before, same_depth (clients of that funnel and depth)."""
    spark = common.tune(events.sparkSession)
    depth = max(len(steps) for steps, _ in funnels.values())
    found = _attempts(events, funnels, within, piece_rows)
    gaps = common.saved(found.groupBy("funnel", "client_id", "step", "gap").agg(F.sum("n").alias("n")), "gaps")
    buckets = max(1, -(-gaps.count() // piece_rows), int(spark.conf.get("spark.sql.shuffle.partitions")))
    counts = gaps.groupBy("funnel", "client_id").agg(*(F.coalesce(F.sum(F.when(F.col("step") == i, F.col("n"))), F.lit(0)).alias(f"n{i}")
        for i in range(1, depth + 1)), F.max("step").alias("deepest"))
    times = _percentiles(gaps.where("step > 1"), per_cent, buckets).groupBy("funnel", "client_id").agg(
        *(F.max(F.when(F.col("step") == i, F.col("value"))).alias(f"t{i}") for i in range(2, depth + 1)))
    rows = common.saved(counts.join(times, ["funnel", "client_id"], "left"), "funnels")
    alike = rows.groupBy("funnel", "deepest").agg(F.count("*").alias("same_depth"))
    # one row a funnel and step
    return rows.join(F.broadcast(alike), ["funnel", "deepest"]).select("funnel", "client_id", *(f"n{i}" for i in range(1, depth + 1)),
        "deepest", *(f"t{i}" for i in range(2, depth + 1)), "same_depth")
