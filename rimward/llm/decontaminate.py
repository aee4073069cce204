"""Benchmark decontamination by winnowing, in DataFrame operations alone.

Words are hashed to 64 bits. Of every ``WINNOW`` neighbouring ``GRAM``-grams of a text the minimum hash is kept
(with all its ties). ``WINNOW + GRAM - 1`` is the window length, so any window that a document and an item
share has a kept gram in common. Kept grams of documents and items are joined, and each hit is extended to
the windows around it, which must equal an item's window in whole. Items shorter than a window are a window
of their own length. They are found in one pass over the words: a bitmap of fixed size tells which neighbouring word pairs (or words, for
items of one word) can begin such an item, and only from those on windows are made and joined.

Edge cases. A null or empty text has no words, and an item without words no window. Null or repeated ids of
documents are kept, each row with its own result. Null item ids count as no item. Items with the same text
all count. Empty tables give no hits. Other columns are ignored. Equal 64-bit hashes are taken as equal words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rimward.llm.common import ascii_lower, text_or_empty

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 5
#: Bits of the bitmap of the first words of short items. With more items it tells less, and nothing is lost.
BITS = 1 << 18
#: Hashes of the benchmark up to this many rows are broadcast; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 500_000


def text_hash() -> Column:
    text = text_or_empty("text")
    return F.xxhash64(text, F.char_length(text))


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), SEPARATOR), "")


def _gram(words: Column, at: Column, length: int) -> Column:
    return F.xxhash64(*[F.get(words, at + j) for j in range(length)])


def _positions(count: Column) -> Column:
    """0 to ``count`` - 1."""
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


def hashed_words(df: DataFrame, *keep: str) -> DataFrame:
    """``keep``, text_hash and ``words``, the array of 64-bit word hashes."""
    text = text_or_empty("text")
    cut = df.select(*keep, text_hash().alias("text_hash"), word_array(text).alias("w"))
    return cut.select(*keep, "text_hash", F.transform("w", lambda w: F.xxhash64(w)).alias("words"))


def kept_grams(hashed: DataFrame, window: int, *keep: str) -> DataFrame:
    """A row for each kept gram: ``keep``, pos, gram and ``around``, the words from ``first`` on that any window over the gram has."""
    winnow = window - GRAM + 1
    reach = window - GRAM
    # explode_outer: for explode, Catalyst infers a filter on the array's size and inlines all of this into it
    grams = hashed.withColumn(
        "grams", F.transform(_positions(F.when(F.size("words") >= window, F.size("words") - (GRAM - 1)).otherwise(0)), lambda i: _gram(F.col("words"), i, GRAM))
    )
    least = grams.withColumn(
        "least", F.transform(_positions(F.size("grams") - (winnow - 1)), lambda i: F.least(*[F.get(F.col("grams"), i + j) for j in range(winnow)]))
    )
    # a gram is kept if it's the minimum of some window over it, that is, equal to the largest of their minima
    kept = least.withColumn(
        "kept",
        F.filter(
            _positions(F.size("grams")),
            lambda i: F.get(F.col("grams"), i) == F.greatest(*[F.get(F.col("least"), F.when(i - j >= 0, i - j)) for j in range(winnow)]),
        ),
    )
    rows = kept.withColumn(
        "row",
        F.transform(
            "kept",
            lambda i: F.struct(
                i.alias("pos"),
                F.get(F.col("grams"), i).alias("gram"),
                F.greatest(i - reach, F.lit(0)).alias("first"),
                F.slice(F.col("words"), F.greatest(i - reach, F.lit(0)) + 1, F.lit(GRAM + 2 * reach)).alias("around"),
            ),
        ),
    )
    return rows.select(*keep, F.explode_outer("row").alias("row")).select(*keep, "row.*").where(F.col("gram").isNotNull())


def _bit(key: Column) -> Column:
    return F.pmod(key, F.lit(BITS))


def _bitmap(keys: DataFrame) -> Column:
    """A constant array of longs with the bit of every ``key`` set; BITS / 64 rows at most come to the driver."""
    at = _bit(F.col("key"))
    longs = keys.groupBy(F.floor(at / 64).cast("int").alias("i")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(pmod(key, {BITS}L), 64) as int))")).alias("bits")).collect()
    held = {r["i"]: r["bits"] for r in longs}
    return F.split(F.lit(",".join(str(held.get(i, 0)) for i in range(BITS // 64))), ",").cast("array<bigint>")


def _has_bit(bitmap: Column, key: Column) -> Column:
    return F.getbit(F.get(bitmap, F.floor(_bit(key) / 64).cast("int")), F.pmod(_bit(key), F.lit(64)).cast("int")) == 1


def _short_starts(hashed: DataFrame, items: DataFrame, sizes: list[int], *keep: str) -> DataFrame:
    """(``keep``, start, size, window) of the windows of ``sizes`` words in documents that begin like an item of fewer words than a window."""
    n, most = F.size("words"), max(sizes)
    short = items.where(n.between(1, most))
    if 1 in sizes:
        words = _bitmap(short.where(n == 1).select(F.col("words")[0].alias("key")))
    if most > 1:
        pairs = _bitmap(short.where(n > 1).select(_gram(F.col("words"), F.lit(0), 2).alias("key")))

    def begins(i: Column) -> Column:
        found = F.lit(False)
        if 1 in sizes:
            found = found | _has_bit(words, F.get(F.col("words"), i))
        if most > 1:
            found = found | ((i + 1 < n) & _has_bit(pairs, _gram(F.col("words"), i, 2)))
        return found

    row = F.transform(F.filter(_positions(n), begins), lambda i: F.struct(i.alias("start"), F.slice("words", i + 1, F.lit(most)).alias("next")))
    rows = hashed.select(*keep, F.explode_outer(row).alias("row")).select(*keep, "row.*").where(F.col("start").isNotNull())
    windows = F.array(*[F.when(F.size("next") >= s, F.struct(F.lit(s).alias("size"), _gram(F.col("next"), F.lit(0), s).alias("window"))) for s in sizes])
    return rows.select(*keep, "start", F.explode(windows).alias("w")).where(F.col("w").isNotNull()).select(*keep, "start", "w.size", "w.window")


def _item_windows(items: DataFrame, window: int) -> DataFrame:
    """(item_id, size, window): every window of each item; ``size`` is the number of its words."""
    n = F.size("words")
    long = items.where(n >= window).select(
        "item_id", F.lit(window).alias("size"), F.explode(F.array_distinct(F.transform(_positions(n - (window - 1)), lambda i: _gram(F.col("words"), i, window)))).alias("window")
    )
    for length in range(1, window):
        short = items.where(n == length).select("item_id", F.lit(length).alias("size"), _gram(F.col("words"), F.lit(0), length).alias("window"))
        long = long.unionByName(short)
    return long


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def window_hits(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """(doc_id, text_hash, start, size, item_id): where a window of an item occurs in a document."""
    items = hashed_words(benchmark.where(F.col("item_id").isNotNull()), "item_id")
    windows = _item_windows(items, window)
    sizes = [r["size"] for r in windows.groupBy("size").count().orderBy("size").collect()]  # at most `window` rows
    total = windows.count()
    hashed = hashed_words(docs, "doc_id")
    starts = None
    if window in sizes:
        fingerprints = kept_grams(items, window, "item_id").select("gram").distinct()
        hits = kept_grams(hashed, window, "doc_id", "text_hash").join(_small(fingerprints, total), "gram", "left_semi")
        last = F.col("first") + F.size("around") - window
        spread = hits.select("doc_id", "text_hash", "first", "around", F.explode(F.sequence(F.col("first"), F.least(F.col("pos"), last))).alias("start"))
        starts = spread.select("doc_id", "text_hash", "start", F.lit(window).alias("size"), _gram(F.col("around"), F.col("start") - F.col("first"), window).alias("window"))
    if short := [s for s in sizes if s < window]:
        begun = _short_starts(hashed, items, short, "doc_id", "text_hash")
        starts = begun if starts is None else starts.unionByName(begun)
    if starts is None:
        return hashed.where(F.lit(False)).select("doc_id", "text_hash", F.lit(0).alias("start"), F.lit(0).alias("size"), F.lit(None).cast(benchmark.schema["item_id"].dataType).alias("item_id"))
    return starts.join(_small(windows, total), ["size", "window"]).select("doc_id", "text_hash", "start", "size", "item_id")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, items array<string>, hit_spans) per row of ``docs``; spans are of words, end exclusive."""
    hits = window_hits(docs, benchmark, window)
    found = hits.groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end")))).alias("spans"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
    )
    # spans in order of start: each adds what lies past the furthest end so far
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["end"]))).cast("long").alias("n"), F.greatest(a["end"], s["end"]).alias("end")),
        lambda a: a["n"],
    )
    found = found.withColumn("n_hit", covered)
    text = text_or_empty("text")
    rows = docs.select("doc_id", text_hash().alias("text_hash"), F.size(word_array(text)).cast("long").alias("n_words"))
    joined = rows.alias("r").join(found.alias("f"), F.col("r.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("r.text_hash") == F.col("f.text_hash")), "left")
    return joined.select(
        "r.doc_id", "r.text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("spans").alias("hit_spans"),
    )
