"""The trie of all prefixes of conversations, with counts rolled up from the leaves to every ancestor.

A turn's digest is SHA-256 of its role and text. A prefix's key is the sum, in two lanes of 62 bits, of hashes of
its turns' digests and positions; a node is a distinct key at a depth, and the key of its parent is its own less its last turn's hash.
So prefixes are running sums. They are taken within ranges of the globally sorted turns and then over ranges, so
that a conversation with a third of all turns is no task's burden.

Subtree sums use pointer jumping. After round r each node holds the sums over the descendants less than 2^r levels
below it, and points to its ancestor 2^r levels up; a round adds the sums of the nodes that point to it and follows
the pointers' pointers. So a trie of depth d takes log2(d) rounds, each of pre-aggregated grouping and joins.

Conversations are rebuilt before: with ``group``, conversation c opens with the first h turns of conversation
c - c % group, h = crc32(c) % ``heads``, in place of its own first h. Without it they stay as they are.

Edge cases. Turns are in order of turn (null first), then role, then text; roles and texts that are null become empty. Rows without
conv_id are left out. Repeated rows are turns of their own. A conversation without turns of its own or lent ones ends at the root.
Very long texts are hashed once and then dropped. An empty table gives no rows, not even a root. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rimward.llm.common import materialize, text_or_empty

#: Members of a node are joined to strings by ranges of 2 ** this many ids before they are hashed.
ID_BITS = 12
_KEY = ["k1", "k2"]
_MODULUS = 1 << 62


def _lanes(position: str) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(lane), F.col(position).cast("long"), "digest"), F.lit(_MODULUS)).alias(f"l{lane}") for lane in (1, 2)]


def _wrapped(total: Column) -> Column:
    return F.pmod(total, F.lit(_MODULUS).cast("decimal(38,0)")).cast("long")


def _sum(lane: str) -> Column:
    return F.sum(F.col(lane).cast("decimal(20,0)"))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, part, digest, n_chars): turns in global order of place; a part is a range of them."""
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), "turn", text_or_empty("role").alias("role"), text_or_empty().alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    dealt = rows.withColumn("at", F.monotonically_increasing_id()).repartitionByRange(*order, "at").sortWithinPartitions(*order)
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    placed = dealt.select("conv_id", F.monotonically_increasing_id().alias("place"), digest.alias("digest"), F.char_length("text").cast("long").alias("n_chars"))
    return materialize(placed.withColumn("part", F.expr("shiftright(place, 33)")), "turns")


def _spans(turns: DataFrame, group: int | None, heads: int) -> tuple[DataFrame, DataFrame]:
    """Per conversation and part its first place and the turns before; and per conversation (conv_id, base, h, lent, length)."""
    spans = materialize(turns.groupBy("conv_id", "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")), "spans")
    convs = spans.groupBy("conv_id").agg(F.sum("n").alias("n"))
    if group is None:
        convs = convs.select("conv_id", "n", F.col("conv_id").alias("base"), F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("lent"))
    else:
        h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
        convs = convs.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), h.alias("h"))
        bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("there"))
        convs = convs.join(bases, "base", "left").select("conv_id", "n", "base", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("lent"))
    convs = materialize(convs.select("conv_id", "base", "h", "lent", (F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "conversations")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = spans.select("conv_id", "part", "first", before.alias("before")).join(convs, "conv_id")
    return materialize(placed, "placed-spans"), convs


def prefixes(conversations: DataFrame, group: int | None = None, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, k1, k2, p1, p2, n_chars, ends): each prefix of each rebuilt conversation but the empty one, its key and its parent's;
    and (conv_id, base, h, lent, length) per conversation."""
    turns = ordered_turns(conversations)
    spans, convs = _spans(turns, group, heads)
    ranked = turns.join(spans, ["conv_id", "part"]).withColumn("rank", F.col("place") - F.col("first") + 1 + F.col("before"))
    own = ranked.where("rank > h").withColumn("depth", F.col("lent") + F.col("rank") - F.col("h"))
    own = materialize(own.select("conv_id", "part", "place", "depth", "length", "n_chars", *_lanes("depth")), "own-turns")
    lent = ranked.where((F.col("conv_id") == F.col("base")) & (F.col("rank") < heads)).select("base", F.col("rank").alias("depth"), "n_chars", *_lanes("rank"))
    along = Window.partitionBy("base").orderBy("depth")
    lent = materialize(lent.select("base", "depth", "n_chars", "l1", "l2", *[_sum(f"l{i}").over(along).alias(f"s{i}") for i in (1, 2)]), "lent-turns")
    # what comes before a conversation's turns in a part: the lent turns and those of earlier parts
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = own.groupBy("conv_id", "part").agg(*[_sum(f"l{i}").alias(f"t{i}") for i in (1, 2)])
    heads_of = convs.join(lent.select("base", F.col("depth").alias("lent"), "s1", "s2"), ["base", "lent"]).select("conv_id", "s1", "s2")
    zero = F.lit(0).cast("decimal(38,0)")
    starts = sums.join(heads_of, "conv_id", "left").select(
        "conv_id", "part", *[(F.coalesce(f"s{i}", zero) + F.coalesce(F.sum(f"t{i}").over(earlier), zero)).alias(f"b{i}") for i in (1, 2)]
    )
    inside = Window.partitionBy("conv_id", "part").orderBy("place")
    run = own.join(starts, ["conv_id", "part"]).withColumns({f"s{i}": F.col(f"b{i}") + _sum(f"l{i}").over(inside) for i in (1, 2)})
    shared = convs.where("lent > 0").select("conv_id", "base", "lent", "length").join(lent, "base").where("depth <= lent")
    out = ["conv_id", "depth", "n_chars", (F.col("depth") == F.col("length")).alias("ends"), *[_wrapped(F.col(f"s{i}")).alias(f"k{i}") for i in (1, 2)], *[_wrapped(F.col(f"s{i}") - F.col(f"l{i}")).alias(f"p{i}") for i in (1, 2)]]
    return run.select(*out).unionByName(shared.select(*out)), convs


def _end_hashes(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of (k1, k2, conv_id): ids are joined in ranges first, and a node's ranges pass through one hash in order."""
    texts = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    ranges = ends.groupBy(*_KEY, F.expr(f"shiftright(conv_id, {ID_BITS})").alias("range")).agg(texts.alias("ids"))
    in_order = ranges.repartition(*_KEY).sortWithinPartitions(*_KEY, "range").select(*_KEY, "ids")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, []
        for batch in batches:
            for k1, k2, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (k1, k2) == key:
                    state.update(b"," + ids.encode())
                    continue
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = (k1, k2), hashlib.sha256(ids.encode())
            if done:
                yield _records(done)
                done = []
        if key is not None:
            yield _records([(*key, state.hexdigest())])

    return in_order.mapInArrow(digest, "k1 long, k2 long, ends_sha256 string")


def _records(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    first, second, text = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(text, pa.string())], names=["k1", "k2", "ends_sha256"])


def subtree_sums(nodes: DataFrame, sums: list[str]) -> DataFrame:
    """(k1, k2, sums) of nodes (k1, k2, p1, p2, depth, sums): each column summed over the node's subtree, by pointer jumping. Depths begin at 0."""
    state = materialize(nodes.select(*_KEY, "depth", F.col("p1").alias("a1"), F.col("p2").alias("a2"), *sums), "pointers")
    deepest, step = state.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0], 1
    while step <= deepest:
        below = state.where(F.col("depth") >= step).groupBy(F.col("a1").alias("k1"), F.col("a2").alias("k2")).agg(*[F.sum(c).alias(f"{c}_below") for c in sums])
        deep, rest = state.where(F.col("depth") >= 2 * step), state.where(F.col("depth") < 2 * step)
        onward = state.where(F.col("depth") >= step).select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2"))
        moved = deep.join(onward, ["a1", "a2"]).select(*_KEY, "depth", F.col("b1").alias("a1"), F.col("b2").alias("a2"), *sums)
        both = moved.unionByName(rest).join(below, _KEY, "left")
        state = materialize(both.select(*_KEY, "depth", "a1", "a2", *[(F.col(c) + F.coalesce(f"{c}_below", F.lit(0))).alias(c) for c in sums]), "pointers", replaces=state)
        step *= 2
    return state.select(*_KEY, *sums)


def conversation_trie(conversations: DataFrame, group: int | None = None, heads: int = 6) -> DataFrame:
    """(k1, k2, p1, p2, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) per node.

    conv_id is the smallest member; ``saved_tokens`` counts code points that a cache of the node's last turn saves its other members, over the subtree;
    ``ends_sha256`` is the hash of the members that end at the node.
    """
    rows, convs = prefixes(conversations, group, heads)
    rows = materialize(rows, "prefixes")
    found = rows.groupBy(*_KEY, "depth").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("n_chars").alias("n_chars"), F.min(F.struct("p1", "p2")).alias("p")
    )
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2"), zero.alias("depth"), "conv_id", "n_convs", zero.alias("n_chars"))
    nodes = materialize(found.select(*_KEY, "p.p1", "p.p2", "depth", "conv_id", "n_convs", "n_chars").unionByName(root), "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = materialize(nodes.join(children, _KEY, "left").withColumn("n_children", F.coalesce("n_children", zero)), "nodes", replaces=nodes)
    valued = nodes.select(*_KEY, "p1", "p2", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("n_chars")).alias("saved_tokens"))
    ends = rows.where("ends").select(*_KEY, "conv_id").unionByName(convs.where("length = 0").select(zero.alias("k1"), zero.alias("k2"), "conv_id"))
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    named = nodes.where("depth > 0").join(parents, ["p1", "p2"]).unionByName(nodes.where("depth = 0").withColumn("parent_conv_id", none))
    out = named.join(subtree_sums(valued, ["n_leaves", "saved_tokens"]), _KEY).join(_end_hashes(ends), _KEY, "left")
    return out.select(
        *_KEY, "p1", "p2", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")
    )
