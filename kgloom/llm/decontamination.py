"""Benchmark decontamination by winnowing, in DataFrame and SQL functions only.

A benchmark window is ``WINDOW`` consecutive words of an item (all words of a shorter item). Its fingerprint is the
smallest hash of its ``GRAM``-word grams, the last of equals; a document's fingerprints are the grams that are smallest
in one of its own windows, so each shared window shares its fingerprint at the same place. Fingerprints that a fixed
bitmap of the benchmark's rules out are dropped where they are made; the others, with the words around them, are
joined with the benchmark's windows on the hash and extended word by word to whole windows. Items shorter than a
window are looked for at all grams (of their own length, if under ``GRAM`` words), as winnowing gives no guarantee there.

Only words around possible hits leave the scan; no text is shuffled. The windows' table is broadcast up to
``broadcast_windows`` rows and joined by a shuffle beyond. A benchmark of more than ``bitmap_windows`` windows would fill the
bitmap; then documents' fingerprints are joined as they are, as narrow rows, and only texts with a match are cut into words
again, by their number in a written copy. Null text has no words; wordless items have no window;
items with null id mark words but aren't listed; rows with one doc_id, repeated rows too, are kept apart; a text of any length is one
row; an empty table gives no rows, an empty benchmark no hits; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW, GRAM = 10, 5


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(common.ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(common.WORD), F.lit(0))


def _hash(words: str, at: str, gram: int) -> str:
    return "xxhash64(" + ", ".join(f"{words}[{at} + {k}]" for k in range(gram)) + ")"


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """Distinct windows: win (words), n, gram, hash and at (fingerprint and its place), items (ids as sorted strings)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("words")).where("size(words) > 0")
    spread = items.select("item",
        F.explode(F.expr(f"transform(sequence(0, greatest(size(words) - {WINDOW}, 0)), i -> slice(words, i + 1, {WINDOW}))")).alias("win"))
    distinct = spread.groupBy("win").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("n", F.size("win")).withColumn(
        "gram", F.least("n", F.lit(GRAM)))
    by_gram = "CASE gram " + " ".join(
        f"WHEN {g} THEN transform(sequence(0, n - {g}), i -> {_hash('win', 'i', g)})" for g in range(1, GRAM + 1)) + " END"
    hashed = distinct.withColumn("hashes", F.expr(by_gram)).withColumn("hash", F.array_min("hashes"))
    return hashed.withColumn("at", F.expr("size(hashes) - array_position(reverse(hashes), hash)").cast("int")).drop("hashes")


def _bitmap(windows: DataFrame, gram: int, least: int = 12, most: int = 20) -> tuple[str, int] | None:
    """Bits of the fingerprints of one gram length as an SQL array of longs, and its number of longs (a power of two,
    at most 2^most bits whatever the benchmark's size: more fingerprints only make it less selective)."""
    own = windows.where(F.col("gram") == gram).select("hash").distinct()
    n = own.count()
    if not n:
        return None
    bits = 1 << min(most, max(least, (128 * n - 1).bit_length()))
    slots = own.groupBy(F.expr(f"cast(shiftright(hash & {bits - 1}L, 6) as int)").alias("slot")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(hash & 63L as int))")).alias("bits")).collect()
    longs = [0] * (bits // 64)
    for r in slots:
        longs[r["slot"]] = r["bits"]
    return "array(" + ",".join("-9223372036854775807L - 1L" if x == -(2**63) else f"{x}L" for x in longs) + ")", bits


def candidates(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Per row rid, doc_id, n_words and cands: fingerprints that the benchmark may hold, with the words around."""
    lengths = [r[0] for r in windows.select("n").where(F.col("n") < WINDOW).distinct().collect()]  # at most 9
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", words_of(F.col("text")).alias("w")).withColumn("m",
        F.size("w"))
    found = []
    for gram in range(1, GRAM + 1):
        if bitmap := _bitmap(windows, gram):
            table, bits = bitmap
            # each gram is hashed once; most texts end at the bitmap
            own = f"h{gram}"
            rows = rows.withColumn(own,
                F.expr(f"CASE WHEN m >= {gram} THEN transform(sequence(0, m - {gram}), i -> {_hash('w', 'i', gram)}) ELSE array() END"))
            bit = lambda h: f"getbit({table}[cast(shiftright({h} & {bits - 1}L, 6) as int)], cast({h} & 63L as int)) = 1"  # noqa: B023, E731
            maybe = f"CASE WHEN exists({own}, h -> {bit('h')}) THEN filter(sequence(0, m - {gram}), i -> {bit(f'{own}[i]')}) ELSE array() END"
            chosen = "false"
            if gram == GRAM:
                last = WINDOW - GRAM
                chosen = f"m >= {WINDOW} AND exists(sequence(greatest(i - {last}, 0), least(i, m - {WINDOW})), s -> forall(sequence(s, s + {last}), j -> j = i OR (j < i AND {own}[j] >= {own}[i]) OR (j > i AND {own}[j] > {own}[i])))"
            made = f"transform({maybe}, i -> named_struct('gram', {gram}, 'hash', {own}[i], 'place', i, 'chosen', {chosen}, 'start', greatest(i - {WINDOW - 1}, 0), 'near', slice(w, greatest(i - {WINDOW - 1}, 0) + 1, {2 * WINDOW})))"
            short = any(min(n, GRAM) == gram for n in lengths)
            found.append(made if short else f"filter({made}, c -> c.chosen)")
    cands = f"concat({', '.join(found)})" if found else "array()"
    return rows.select("rid", "doc_id", F.col("m").cast("long").alias("n_words"),
        F.expr(cands).alias("cands") if found else F.lit(None).cast("array<int>").alias("cands"))


def fingerprints(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """rid, gram, hash, place: all fingerprints of rows (rid, w: words), and all grams of short windows' lengths."""
    m, last = "size(w)", WINDOW - GRAM
    own = rows.withColumn("h",
        F.expr(f"CASE WHEN {m} >= {GRAM} THEN transform(sequence(0, {m} - {GRAM}), i -> {_hash('w', 'i', GRAM)}) ELSE array() END"))
    # in a window of hashes the smallest, the last of equals
    least = f"transform(sequence(0, {m} - {WINDOW}), s -> s + {last + 1} - array_position(reverse(slice(h, s + 1, {last + 1})), array_min(slice(h, s + 1, {last + 1}))))"
    chosen = f"CASE WHEN {m} >= {WINDOW} THEN array_distinct({least}) ELSE array() END"
    found = [f"transform({chosen}, p -> named_struct('gram', {GRAM}, 'hash', h[cast(p as int)], 'place', cast(p as int), 'long', true))"]
    for gram in sorted({min(n, GRAM) for n in lengths}):
        every = f"CASE WHEN {m} >= {gram} THEN sequence(0, {m} - {gram}) ELSE array() END"
        found.append(f"transform({every}, i -> named_struct('gram', {gram}, 'hash', {_hash('w', 'i', gram)}, 'place', i, 'long', false))")
    return own.select("rid", F.explode(F.expr(f"concat({', '.join(found)})")).alias("c")).select("rid", "c.*")


def _found_by_bitmap(docs: DataFrame, windows: DataFrame, side: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (rid, doc_id, n_words), and the places of windows in them: rid, s (start), n, items."""
    base = common.saved(candidates(docs, windows), "fingerprints")
    if base.schema["cands"].dataType.simpleString() == "array<int>":
        return base, base.select("rid", F.lit(0).alias("s"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("items")).limit(0)
    spread = base.where("size(cands) > 0").select("rid", F.explode("cands").alias("c")).select("rid", "c.*")
    same = f"(n < {WINDOW} OR chosen) AND slice(near, place - at - start + 1, n) = win"
    joined = spread.join(side, ["gram", "hash"]).where(f"place - at >= 0 AND CASE WHEN place - at >= 0 THEN {same} ELSE false END")
    return base, joined.select("rid", (F.col("place") - F.col("at")).alias("s"), "n", "items")


def _found_by_join(docs: DataFrame, windows: DataFrame, side: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same for many windows."""
    lengths = [r[0] for r in windows.select("n").where(F.col("n") < WINDOW).distinct().collect()]  # at most 9
    rows = common.saved(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text"), "numbered")
    worded = rows.select("rid", words_of(F.col("text")).alias("w"))
    met = fingerprints(worded, lengths).join(side, ["gram", "hash"]).where(f"place >= at AND long = (n >= {WINDOW})")
    maybe = common.saved(met.select("rid", (F.col("place") - F.col("at")).alias("s"), "n", "win", "items").distinct(), "met")
    held = worded.join(maybe.select("rid").distinct(), "rid", "left_semi")
    base = rows.select("rid", "doc_id", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    return base, maybe.join(held, "rid").where("slice(w, s + 1, n) = win").select("rid", "s", "n", "items")


def contamination(docs: DataFrame, benchmark: DataFrame, broadcast_windows: int = 50_000, bitmap_windows: int = 1 << 16) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and items (the ids)."""
    windows = common.saved(benchmark_windows(benchmark), "windows")
    many = windows.count()
    side = F.broadcast(windows) if many <= broadcast_windows else windows
    base, found = (_found_by_bitmap if many <= bitmap_windows else _found_by_join)(docs, windows, side)
    runs = found.select("rid", F.struct("s", (F.col("s") + F.col("n")).alias("e")).alias("run"), "items")
    covered = "aggregate(array_sort(runs), named_struct('e', 0, 't', 0L), (a, x) -> named_struct('e', greatest(a.e, x.e), 't', a.t + greatest(0, x.e - greatest(a.e, x.s))), a -> a.t)"
    hits = runs.groupBy("rid").agg(F.collect_set("run").alias("runs"), F.collect_set("items").alias("lists")).select("rid",
        F.expr(covered).alias("n_hit"), F.expr("array_sort(array_distinct(flatten(lists)))").alias("items"))
    out = base.select("rid", "doc_id", "n_words").join(hits, "rid", "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), items.alias("items"))
