"""N-gram Jaccard self-join by vertical partitioning, and the groups that its links form. Exact.

1. All documents' shingles are cut by hash range into fragments, as many as their number asks for. A fragment counts, for each document, those of its
   shingles that stand in another document too; the counts are summed per document. A document with fewer than 75 % such
   shingles links with nothing and is out. Only 32 bits of each shingle travel (a chance meeting keeps a document in,
   no more), and a shingle of many documents once a batch.
2. Equal sets become one class with the smallest doc_id; classes are filtered in the same way among themselves.
3. Global order of shingles: document frequency, then hash. Linked classes share one of the first n - need + 1.
   The classes under one such key are compared with one of them (the leader), not with each other; what the links join
   is one component. Keys whose classes still lie in several components go on: after ``star_rounds`` rounds pairs from
   different components that pass the length and positional filters are compared, so no link that would
   join two components is lost, and a group of many near copies makes few pairs. Keys of many classes are dealt out in
   blocks then, each pair of blocks apart, and by salts before.
4. A pair is counted fragment by fragment of the global hash order, and the partial overlaps summed.

A class id is 128 bits. Shingles are 64-bit hashes: two different ones meet with a chance of about 10^-19 a pair.
Null or wordless text: empty set, linked with nothing. Null doc_id: as its own row, component null. Rows with one doc_id
and different texts are separate members, repeated rows members of one class; a text of any length is one member. An empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .shingles import shingle_sets

PARTS = 4  # fragments of a pair's count
FRAGMENT = 1 << 21  # shingles of a fragment, about
BLOCK = 512  # classes of a key that are compared at once
LOCAL_LINKS = 1 << 20  # links that one task joins, of 32 bytes each


def _sets(batch: pa.RecordBatch, k: int) -> list[np.ndarray]:
    return shingle_sets([t.encode("utf-8", "surrogatepass") for t in common.texts(batch)], k)


def _class(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else b""


_PIECE = pa.schema(
    [("fragment", pa.int32()), ("batch", pa.int64()), ("docs", pa.int32()), ("values", pa.binary()), ("per_doc", pa.binary()),
        ("shared", pa.binary()), ("meta", pa.binary())])
_PIECE_SQL = "fragment int, batch long, docs int, values binary, per_doc binary, shared binary, meta binary"


def _pieces(sets: list[np.ndarray], batch: int, fragments: int, meta: bytes) -> pa.RecordBatch:
    """A batch's shingles by fragment. Those of several of its documents are sent once; counts of them are in meta."""
    sizes = np.array([len(s) for s in sets], np.int64)
    doc, h = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    order = np.argsort(h, kind="stable")
    hs = h[order]
    new = np.ones(len(hs), bool)
    new[1:] = hs[1:] != hs[:-1]
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(hs)))
    several = np.zeros(len(h), bool)
    several[order] = np.repeat(times > 1, times)
    own = np.bincount(doc[several], minlength=len(sets)).astype("<u4")
    common_h = hs[first[times > 1]]
    doc, h = doc[~several], h[~several]
    part = ((h >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    part, doc, low = part[order], doc[order], (h[order] & np.uint64(0xFFFFFFFF)).astype("<u4")
    cut = np.searchsorted(part, np.arange(fragments + 1))
    cpart = ((common_h >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)
    ccut, clow = np.searchsorted(cpart, np.arange(fragments + 1)), (common_h & np.uint64(0xFFFFFFFF)).astype("<u4")
    rows = [f for f in range(fragments) if cut[f] < cut[f + 1] or ccut[f] < ccut[f + 1]]
    return common.record(
        _PIECE, fragment=[*rows, batch % fragments], batch=[batch] * (len(rows) + 1), docs=[len(sets)] * (len(rows) + 1),
        values=[*(low[cut[f] : cut[f + 1]].tobytes() for f in rows), None],
        per_doc=[*(np.bincount(doc[cut[f] : cut[f + 1]], minlength=len(sets)).astype("<u4").tobytes() for f in rows), None],
        shared=[*(clow[ccut[f] : ccut[f + 1]].tobytes() for f in rows), None], meta=[*[None] * len(rows), own.tobytes() + meta],
    )


_COUNT = pa.schema([("batch", pa.int64()), ("docs", pa.int32()), ("counts", pa.binary()), ("meta", pa.binary())])


def _count(group: pa.Table) -> pa.Table:
    """For each batch, how many of its documents' shingles here stand in other batches."""
    common.release()  # what the group before held
    rows = group.to_pylist()
    pieces = [r for r in rows if r["meta"] is None]
    values = [np.frombuffer(r["values"], "<u4") for r in pieces]
    every = np.sort(np.concatenate([*values, *(np.frombuffer(r["shared"], "<u4") for r in pieces)])) if pieces else np.zeros(0, np.uint32)
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    counts = []
    for r, v in zip(pieces, values, strict=True):
        at = np.searchsorted(twice, v)
        hit = at < len(twice)
        hit[hit] = twice[at[hit]] == v[hit]
        doc = np.repeat(np.arange(r["docs"]), np.frombuffer(r["per_doc"], "<u4"))
        counts.append(np.bincount(doc[hit], minlength=r["docs"]).astype("<u4").tobytes())
    meta = [r for r in rows if r["meta"] is not None]
    return pa.table(
        {"batch": [r["batch"] for r in [*pieces, *meta]], "docs": [r["docs"] for r in [*pieces, *meta]],
            "counts": [*counts, *[None] * len(meta)], "meta": [*[None] * len(pieces), *(r["meta"] for r in meta)]}, schema=_COUNT)


_TALLY_SQL = "doc_id long, cls binary, n long, repeated long"
_TALLY = pa.schema([("doc_id", pa.int64()), ("cls", pa.binary()), ("n", pa.int64()), ("repeated", pa.int64())])


def _sum(group: pa.Table) -> pa.Table:
    rows = group.to_pylist()
    docs = rows[0]["docs"]
    meta = next(r["meta"] for r in rows if r["meta"] is not None)
    total = np.frombuffer(meta, "<u4", docs).astype(np.int64)
    for r in rows:
        if r["counts"] is not None:
            total = total + np.frombuffer(r["counts"], "<u4")
    ids, n = np.frombuffer(meta, "<i8", docs, 4 * docs), np.frombuffer(meta, "<i8", docs, 12 * docs)
    null = np.frombuffer(meta, np.uint8, docs, 20 * docs).astype(bool)
    raw = meta[21 * docs :]
    cls = [raw[16 * i : 16 * i + 16] if n[i] else b"" for i in range(docs)]
    return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=null), "cls": cls, "n": n, "repeated": total}, schema=_TALLY)


def _meta(ids: list, sets: list[np.ndarray], classes: list[bytes]) -> bytes:
    return np.array([d or 0 for d in ids], "<i8").tobytes() + np.array([len(s) for s in sets], "<i8").tobytes() + bytes(
        d is None for d in ids) + b"".join(c.ljust(16, b"\0") for c in classes)


def _fragments(shingles: int) -> int:
    return max(8, -(-shingles // FRAGMENT))


def _spread(pieces: DataFrame, fragments: int) -> DataFrame:
    """Pieces dealt by fragment into as many parts as there are fragments (the session's number of partitions, if that is more)."""
    parts = max(fragments, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return pieces.repartition(parts, "fragment")


def _tallied(pieces: DataFrame, fragments: int) -> DataFrame:
    counted = _spread(pieces, fragments).groupBy("fragment").applyInArrow(_count, "batch long, docs int, counts binary, meta binary")
    return counted.groupBy("batch").applyInArrow(_sum, _TALLY_SQL)


def tally_documents(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, cls, n, repeated: each document's set and how many of its shingles other documents hold."""
    # a shingle starts at each word; a word and its blank have at least two bytes, in texts about six
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    fragments = _fragments(size // 6)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for seq, batch in enumerate(batches):
            if batch.num_rows:
                sets = _sets(batch, k)
                yield _pieces(sets, at + seq, fragments, _meta(batch.column("doc_id").to_pylist(), sets, [_class(s) for s in sets]))

    return _tallied(docs.mapInArrow(common.lean(cut), _PIECE_SQL), fragments)


_SET_SQL = "cls binary, n long, shingles binary"
_SET = pa.schema([("cls", pa.binary()), ("n", pa.int64()), ("shingles", pa.binary())])


def _likely(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without most of those whose doc_id isn't among ids: a bitmap of hashes, of at most 4 MB whatever their number."""
    bits = 1 << max(16, min(25, (16 * ids.count()).bit_length()))
    slots = ids.select(F.pmod(F.xxhash64("doc_id"), F.lit(bits)).alias("h")).groupBy(
        F.expr("cast(shiftright(h, 6) as int)").alias("slot")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(h & 63L as int))")).alias("bits")).collect()
    table = np.zeros(bits // 64, np.int64)
    table[[r["slot"] for r in slots]] = [r["bits"] for r in slots]
    sent = docs.sparkSession.sparkContext.broadcast(table.tobytes())

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.frombuffer(sent.value, np.uint64)
        for batch in batches:
            h = batch.column("h").to_numpy()
            yield batch.filter(pa.array(words[h >> 6] >> (h & 63).astype(np.uint64) & np.uint64(1) == 1)).select(["doc_id", "text"])

    hashed = docs.where("doc_id IS NOT NULL").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(bits)).alias("h"))
    return hashed.mapInArrow(common.lean(keep), "doc_id long, text string")


def class_sets(docs: DataFrame, reps: DataFrame, k: int) -> DataFrame:
    """The sets of the classes' first documents. Texts of other documents are left out before the shuffle."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(c, len(s), s.astype("<u8").tobytes()) for c,
                s in zip(batch.column("cls").to_pylist(), _sets(batch, k), strict=True) if _class(s) == c]
            cls, n, blob = zip(*rows, strict=True) if rows else ((), (), ())
            yield common.record(_SET, cls=cls, n=n, shingles=blob)

    ids = reps.select(F.col("first").alias("doc_id"), "cls")
    return _likely(docs, ids).join(ids, "doc_id").select("doc_id", "text", "cls").mapInArrow(common.lean(cut), _SET_SQL)


def _need(n):
    return F.ceil(F.lit(3) * n / F.lit(4))


_KEYS_SQL = "key long, cls binary, n long, alone long, place long"


def prefix_keys(sets: DataFrame) -> DataFrame:
    """key, cls, n, alone, place: of each class the first n - need + 1 shingles in the global order, without those (alone)
    that no other class holds, which come first.

    Fragments count the classes of each shingle; what they find comes back by batch, not by class."""
    fragments = _fragments(sets.agg(F.sum("n")).first()[0] or 0)
    piece = pa.schema(
        [("fragment", pa.int32()), ("batch", pa.int64()), ("classes", pa.binary()), ("sizes", pa.binary()), ("values", pa.binary()),
            ("per", pa.binary())])
    tally = pa.schema(
        [("batch", pa.int64()), ("classes", pa.binary()), ("sizes", pa.binary()), ("values", pa.binary()), ("per", pa.binary()),
            ("df", pa.binary())])
    keys = pa.schema([("key", pa.int64()), ("cls", pa.binary()), ("n", pa.int64()), ("alone", pa.int64()), ("place", pa.int64())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for seq, batch in enumerate(common.slices(batches, 500)):
            blobs = [np.frombuffer(b, "<u8") for b in batch.column("shingles").to_pylist()]
            if not blobs:
                continue
            owner, h = np.repeat(np.arange(len(blobs)), [len(b) for b in blobs]), np.concatenate(blobs)
            part = ((h >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            h, owner = h[order], owner[order]
            edge = np.searchsorted(part[order], np.arange(fragments + 1))
            used = [f for f in range(fragments) if edge[f] < edge[f + 1]]
            classes, sizes = b"".join(batch.column("cls").to_pylist()), np.array(batch.column("n").to_pylist(), "<i8").tobytes()
            yield common.record(
                piece, fragment=used, batch=[at + seq] * len(used), classes=[classes if k == 0 else None for k in range(len(used))], sizes=[sizes if k == 0 else None for k in range(len(used))],
                values=[h[edge[f] : edge[f + 1]].astype("<u8").tobytes() for f in used], per=[np.bincount(owner[edge[f] : edge[f + 1]], minlength=len(blobs)).astype("<u4").tobytes() for f in used],
            )

    def count(group: pa.Table) -> pa.Table:
        common.release()
        rows = group.to_pylist()
        values = [np.frombuffer(r["values"], "<u8") for r in rows]
        known, df = np.unique(np.concatenate(values), return_counts=True)
        known, df = known[df > 1], df[df > 1]
        out = []
        for r, v in zip(rows, values, strict=True):
            at = np.searchsorted(known, v)
            keep = at < len(known)
            keep[keep] = known[at[keep]] == v[keep]
            per = np.frombuffer(r["per"], "<u4")
            owner = np.repeat(np.arange(len(per)), per)[keep]
            out.append(
                (r["batch"], r["classes"], r["sizes"], v[keep].tobytes(), np.bincount(owner, minlength=len(per)).astype("<u4").tobytes(),
                    df[at[keep]].astype("<u4").tobytes()))
        batch, classes, sizes, v, per, d = zip(*out, strict=True)
        return pa.table({"batch": batch, "classes": classes, "sizes": sizes, "values": v, "per": per, "df": d}, schema=tally)

    def pick(group: pa.Table) -> pa.Table:
        common.release()
        rows = group.to_pylist()
        first = next(r for r in rows if r["classes"] is not None)
        sizes = np.frombuffer(first["sizes"], "<i8")
        h = np.concatenate([np.frombuffer(r["values"], "<u8") for r in rows])
        df = np.concatenate([np.frombuffer(r["df"], "<u4") for r in rows])
        owner = np.concatenate([np.repeat(np.arange(len(sizes)), np.frombuffer(r["per"], "<u4")) for r in rows])
        order = np.lexsort((h, df, owner))
        h, owner = h[order], owner[order]
        held = np.bincount(owner, minlength=len(sizes))
        alone = sizes - held
        place = np.arange(len(h)) - (np.cumsum(held) - held)[owner] + alone[owner]
        near = place < (sizes - (3 * sizes + 3) // 4 + 1)[owner]
        owner, place = owner[near], place[near]
        names = [first["classes"][16 * i : 16 * i + 16] for i in range(len(sizes))]
        return pa.table(
            {"key": h[near].view(np.int64), "cls": [names[i] for i in owner.tolist()], "n": sizes[owner], "alone": alone[owner],
                "place": place}, schema=keys)

    dealt = _spread(sets.mapInArrow(common.lean(deal), "fragment int, batch long, classes binary, sizes binary, values binary, per binary"),
        fragments)
    counted = dealt.groupBy("fragment").applyInArrow(count, "batch long, classes binary, sizes binary, values binary, per binary, df binary")
    return counted.groupBy("batch").applyInArrow(pick, _KEYS_SQL)


def count_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links among pairs (a, b): the overlaps of the PARTS fragments of the hash order, counted one by one and summed."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])
    edges = np.array([(p << 64) // PARTS for p in range(1, PARTS)], np.uint64)

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
                u, v = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                total = 0
                for one, two in zip(np.split(u, np.searchsorted(u, edges)), np.split(v, np.searchsorted(v, edges)), strict=True):
                    both = np.sort(np.concatenate([one, two]), kind="stable")
                    total += int((both[1:] == both[:-1]).sum())
                linked.append(100 * total >= 75 * (len(u) + len(v) - total))
            keep = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], schema=schema)

    left, right = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("cls").alias("b"),
        F.col("shingles").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(common.lean(overlap), "a binary, b binary")


_PART = pa.schema([("cls", pa.binary()), ("comp", pa.binary())])


def _joined(group: pa.Table) -> pa.Table:
    """cls, comp of one group's links: labels fall to the smallest of their links, and to their labels' own, until none does."""
    a, b = (group.column(c).to_pylist() for c in "ab")
    codes, names = pd.factorize(np.array([*a, *b], object), sort=True)
    a, b = np.split(codes, 2)
    label, before = np.arange(len(names)), None
    while before is None or (label != before).any():
        before = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
    return pa.table({"cls": names.tolist(), "comp": names[label].tolist()}, schema=_PART)


def components(links: DataFrame) -> DataFrame:
    """cls, comp (the smallest member) for all that links name: up to ``LOCAL_LINKS`` of them (counted) in one task, more by alternating
    large and small stars."""
    edges = common.saved(links.select("a", "b").where("a <> b").distinct(), "links")
    if edges.count() <= LOCAL_LINKS:
        return edges.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_joined, "cls binary, comp binary")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = common.saved(large, "large-star")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        small = common.saved(small, "small-star")
        edges = small
        mark, before = small.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first(), mark
        if mark == before:
            break
    roots = edges.select(F.col("b").alias("cls"), F.col("b").alias("comp")).distinct()
    return edges.select(F.col("a").alias("cls"), F.col("b").alias("comp")).unionByName(roots)


#: What a pair must pass: sizes that allow 75 %, and enough shingles that others hold too.
_FITS = "4 * least(nx, ny) >= 3 * greatest(nx, ny) AND least(nx - ax, ny - ay) >= ceil(3 * (nx + ny) / 7)"


def _with_leader(live: DataFrame, lead: DataFrame) -> DataFrame:
    """live with its key's leader. Classes of a key of more than ``BLOCK`` are dealt in parts of about that many, each with a copy of
    the leader; such keys are rows / BLOCK at most."""
    lead = common.saved(lead, "lead")
    hot = lead.where(F.col("size") > BLOCK).select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("salts"))
    if hot.isEmpty():
        return live.join(lead.drop("size"), "key")
    salts = F.coalesce("salts", F.lit(1))
    dealt = live.join(hot, "key", "left").withColumn("salt", F.pmod(F.xxhash64("cls"), salts).cast("int")).drop("salts")
    leads = lead.drop("size").join(hot, "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return dealt.join(leads, ["key", "salt"])


def _block_pairs(live: DataFrame) -> DataFrame:
    """Pairs (x, y) of one key's classes in different components that pass the filters. A key's classes lie in blocks of about
    ``BLOCK``, and each two blocks meet apart, so that no task has all pairs of a frequent key."""
    sizes = live.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = live.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
    one, two = (
        met.select("key", "lo", "hi", F.col("own").alias("o" + a), F.col("cls").alias(a), F.col("comp").alias("c" + a),
            F.col("n").alias("n" + a), F.col("place").alias("p" + a), F.col("alone").alias("a" + a)) for a in "xy")
    meet = "cx <> cy AND ((lo = hi AND x < y) OR (lo < hi AND ox = lo AND oy = hi))"
    return one.join(two, ["key", "lo", "hi"]).where(f"{meet} AND least(nx - px, ny - py) >= ceil(3 * (nx + ny) / 7) AND {_FITS}")


def class_components(sets: DataFrame, star_rounds: int = 3) -> DataFrame:
    """cls, comp for the classes that link with another.

    A key's leader is the class with the smallest share of shingles of its own, which links with most; in later rounds it
    comes from the key's largest component, so that only classes outside are compared."""
    keys = common.saved(prefix_keys(sets), "keys")
    links, comps = None, None
    for turn in range(star_rounds + 1):
        if comps is None:
            live = keys.withColumn("comp", F.col("cls"))
        else:
            tagged = keys.join(comps, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
            open_ = tagged.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
            live = common.saved(tagged.join(open_, "key"), "open")
            if live.isEmpty():
                break
        if turn < star_rounds:
            central = F.struct(F.floor(F.col("alone") * 32 / F.col("n")).alias("share"), F.xxhash64("cls", F.lit(turn)).alias("order"),
                "cls")
            best = F.min_by(F.struct("cls", "comp", "n", "alone"), central)
            if turn == 0:
                lead = live.groupBy("key").agg(best.alias("lead"), F.count("*").alias("size"))
            else:
                sizes = live.groupBy("key", "comp").agg(F.count("*").alias("size"), best.alias("lead"))
                lead = sizes.groupBy("key").agg(F.max_by("lead", F.struct("size", "comp")).alias("lead"), F.sum("size").alias("size"))
            pairs = _with_leader(live, lead).where("comp <> lead.comp").select(F.col("lead.cls").alias("x"), F.col("cls").alias("y"),
                F.col("lead.n").alias("nx"), F.col("n").alias("ny"), F.col("lead.alone").alias("ax"), F.col("alone").alias("ay"))
        else:
            pairs = _block_pairs(live)
        pairs = pairs.where(_FITS).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        found = common.saved(count_pairs(pairs, sets), "found")
        links = found if links is None else links.unionByName(found)
        with common.scratch(sets.sparkSession):
            comps = common.saved(components(links), "comps", keep=True)
    return comps


def near_duplicates(docs: DataFrame, k: int = 5, star_rounds: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id for every row: linked at Jaccard similarity 0.75 and more."""
    common.tune(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tally = common.saved(tally_documents(docs, k), "tally")
    alive = tally.where((F.col("n") > 0) & (F.col("repeated") >= _need(F.col("n"))) & F.col("doc_id").isNotNull())
    reps = common.saved(alive.groupBy("cls").agg(F.min("doc_id").alias("first"), F.first("n").alias("n")), "classes")
    sets = common.saved(class_sets(docs, reps, k), "sets")
    comps = class_components(sets, star_rounds)
    joined = reps.select("cls", "first").join(comps, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    least = joined.groupBy("comp").agg(F.min("first").alias("component_id"))
    groups = joined.join(least, "comp").select("cls", "component_id")
    out = tally.join(groups, "cls", "left")
    linked = F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), linked.alias("component_id"))
