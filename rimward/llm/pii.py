"""Information-theoretic sanitisation of personal data, in DataFrame operations alone.

Base detection finds e-mail addresses, IPv4 addresses, payment cards and telephone numbers. Each distinct
value found is a *protected entity*. All terms (words) of a text co-occur with all its entities, however far apart they
stand; over the whole corpus of distinct texts, with n texts, a term t and an entity e have

    disclosure  P(e | t) = n(e, t) / n(t)        and        information  log2(n * n(e, t) / (n(e) * n(t))).

A term whose disclosure reaches ``min_disclosure`` would reveal the entity, if it tells anything about it: its information
is positive and at least ``min_bits``. By default that is all, so terms of entities in a single text count, whatever the
number of texts; ``min_support`` may ask for more texts. An entity in all texts has no such terms. A revealing term is generalised to ``[TERM]`` in the documents that hold the entity; base values are
replaced by their kind. Terms never displace base spans.

Edge cases. A null or empty text has no spans. Null or repeated ids are kept, each row with its own result. Repeated
texts count once as evidence. An empty table gives no rows. Other columns are ignored. Texts are
searched whole; the patterns below take linear time and no deep recursion on any text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rimward.llm.common import materialize, text_or_empty

# The patterns find the same leftmost matches as the plain ones in comments: a run of the leading class can only match from where it begins or
# where the match before ended, and each greedy run may be possessive, as what follows it isn't of its class.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",  # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",  # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "card": r"[0-9](?:[\x20-]?[0-9])++",  # [0-9]([\x20-]?[0-9])+
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
NOT_TERM = r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+"
MIN_TERM = 3
#: Terms, or rows of documents with terms, up to this many are broadcast; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 200_000
_BLOCK = 64


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _located(rows: DataFrame, kind: str, pattern: Column, where: Column) -> DataFrame:
    """``rows`` with ``kind``: array<struct<start, end, value>> of the matches of ``pattern`` in ``t``.

    A match begins after all gaps and matches before it. Their lengths are summed in blocks, so a text with m
    matches takes about m * (64 + m / 4096) steps.
    """
    none = F.array().cast("array<string>")
    rows = rows.withColumn("m", F.when(where, F.regexp_extract_all("t", pattern, F.lit(0))).otherwise(none))
    rows = rows.withColumn("g", F.when(F.size("m") > 0, F.split("t", pattern)).otherwise(none))
    # steps[i]: the gap before match i and the match itself; the match ends after steps 0 to i
    rows = rows.withColumn("steps", F.transform("m", lambda m, i: F.char_length(F.get(F.col("g"), i)) + F.char_length(m)))
    blocks = F.when(F.size("m") > 0, F.sequence(F.lit(0), F.floor((F.size("m") - 1) / _BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("sums", F.transform(blocks, lambda b: _sum(F.slice("steps", b * _BLOCK + 1, F.lit(_BLOCK)))))
    rows = rows.withColumn("heads", F.transform("sums", lambda _, b: F.when(b > 0, _sum(F.slice("sums", F.lit(1), b))).otherwise(F.lit(0))))

    def span(m: Column, i: Column) -> Column:
        end = F.get(F.col("heads"), F.floor(i / _BLOCK).cast("int")) + _sum(F.slice("steps", F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK + 1))
        return F.struct((end - F.char_length(m)).cast("long").alias("start"), end.cast("long").alias("end"), m.alias("value"))

    return rows.withColumn(kind, F.transform("m", span)).drop("m", "g", "steps", "sums", "heads")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def _luhn(digits: Column) -> Column:
    """From the right, every second digit doubled, its digits added; the sum is a multiple of ten."""
    def add(total: Column, x: Column, i: Column) -> Column:
        twice = x * (1 + i % 2)
        return total + F.when(twice > 9, twice - 9).otherwise(twice)

    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.struct(c.cast("int").alias("x"), i.alias("i")))
    return F.aggregate(each, F.lit(0), lambda a, s: add(a, s["x"], s["i"])) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    count = F.char_length(_digits(value))
    if kind == "ip":
        byte = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return F.forall(F.split(value, r"\."), lambda p: p.rlike(f"^{byte}$"))
    if kind == "card":
        return count.between(13, 19) & F.when(count.between(13, 19), _luhn(_digits(value))).otherwise(F.lit(False))
    if kind == "phone":
        return count.between(9, 15)
    return F.lit(True)


def _marked(order: int, kind: str) -> Column:
    """The valid spans of one kind, with its place in the order of kinds."""
    valid = F.filter(kind, lambda s: _valid(kind, s["value"]))
    return F.transform(valid, lambda s: F.struct(F.lit(order).alias("order"), F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def _hashed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, t) per row; rows with one hash have one text."""
    text = text_or_empty("text")
    return docs.select("doc_id", F.xxhash64(text, F.char_length(text)).alias("text_hash"), text.alias("t"))


def base_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, t, spans) of the rows that may hold personal data; spans: array<struct<order, kind, start, end, value>>, by kind and start.

    ``t`` is null where nothing was found. Such rows are left to be filtered after the result is written: Catalyst
    would inline all of this into a filter here.
    """
    rows = _hashed(docs).where(F.col("t").contains("@") | F.col("t").rlike(r"[0-9][0-9\x20.()-]"))
    hint = {"email": F.col("t").contains("@"), "phone": F.col("t").contains("+")}
    for kind, pattern in KINDS.items():
        rows = _located(rows, kind, F.lit(pattern), hint.get(kind, F.lit(True)))
    parts = [_marked(i, kind) for i, kind in enumerate(KINDS)]
    rows = rows.select("doc_id", "text_hash", "t", F.concat(*parts).alias("spans"))
    return rows.select("doc_id", "text_hash", F.when(F.size("spans") > 0, F.col("t")).alias("t"), "spans")


def _entity(span: Column) -> Column:
    """The protected entity of a base span: its kind and value, digits alone for cards and telephones."""
    value = F.when(span["kind"].isin("card", "phone"), _digits(span["value"])).otherwise(F.lower(span["value"]))
    return F.concat_ws(":", span["kind"], value)


def _terms(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(text, NOT_TERM)), lambda w: (F.char_length(w) >= MIN_TERM) & w.rlike("[^0-9]"))


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _held(once: DataFrame) -> DataFrame:
    """(text_hash, entity, n_entity) of the distinct texts ``once``; entities that are in the same texts all go by the least of them.

    Two sums by xor over independent hashes of the texts, and their number, tell sets of texts apart.
    """
    each = materialize(once.select("text_hash", F.explode(F.array_distinct(F.transform("spans", _entity))).alias("entity")), "pii-entities")
    sets = each.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n_entity"), F.bit_xor(F.xxhash64("text_hash")).alias("a"), F.bit_xor(F.xxhash64("text_hash", F.lit(1))).alias("b")
    )
    names = sets.groupBy("n_entity", "a", "b").agg(F.min("entity").alias("entity")).select("entity", "n_entity")
    return each.join(names, "entity").select("text_hash", "entity", "n_entity")


def revealing_terms(docs: DataFrame, once: DataFrame, min_support: int = 1, min_disclosure: float = 0.6, min_bits: float = 0.0) -> DataFrame:
    """(text_hash, term) of the terms that reveal an entity of their text; ``once`` are the distinct texts of ``base_spans(docs)`` with spans."""
    held = materialize(_held(once), "pii-held")
    words = materialize(once.select("text_hash", F.explode(_terms(F.col("t"))).alias("term")), "pii-words")
    most = held.agg(F.max("n_entity")).first()[0] or 0
    texts = _hashed(docs)
    every = texts.dropDuplicates(["text_hash"]).select(F.explode(F.array_distinct(F.split("t", NOT_TERM))).alias("term"))
    # all words are counted before the join, so common ones shrink to a row per task; a semi join would be pushed below the count
    counted = every.groupBy("term").agg(F.count(F.lit(1)).alias("n_term")).join(_few(words.select("term").distinct()), "term")
    # n_both is at most n_entity, so no term is lost here, nor in the pairs below
    n_term = materialize(counted.where(F.lit(most) / F.col("n_term") >= min_disclosure), "pii-terms")
    total = texts.select("text_hash").distinct().count()
    pairs = words.join(_few(n_term), "term").join(held, "text_hash").where(F.col("n_entity") / F.col("n_term") >= min_disclosure)
    pairs = materialize(pairs.select("text_hash", "entity", "term", "n_entity", "n_term"), "pii-pairs")
    scored = pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both"), F.max("n_entity").alias("n_entity"), F.max("n_term").alias("n_term"))
    ratio = F.lit(float(total)) * F.col("n_both") / (F.col("n_entity") * F.col("n_term"))
    enough = (F.col("n_both") >= min_support) & (F.col("n_both") / F.col("n_term") >= min_disclosure) & (ratio > 1) & (F.log2(ratio) >= min_bits)
    revealing = materialize(scored.where(enough).select("entity", "term"), "pii-revealing")
    return pairs.join(_few(revealing), ["entity", "term"]).select("text_hash", "term").distinct()


def _with_terms(found: DataFrame, once: DataFrame, revealing: DataFrame) -> DataFrame:
    """``found`` with the spans of the revealing terms of its texts added."""
    rows = once.join(revealing.select("text_hash").distinct(), "text_hash", "left_semi")
    parts = F.arrays_zip(F.split("t", TERM).alias("gap"), F.regexp_extract_all("t", F.lit(TERM), F.lit(0)).alias("term"))
    each = rows.select("text_hash", F.posexplode(parts).alias("i", "p")).select("text_hash", "i", F.col("p.gap").alias("gap"), F.col("p.term").alias("term")).where("term IS NOT NULL")
    # a running sum over one text's own words; there are too many for _located
    end = F.sum(F.char_length("gap") + F.char_length("term")).over(Window.partitionBy("text_hash").orderBy("i"))
    each = each.select("text_hash", "term", end.cast("long").alias("end"))
    each = each.select("text_hash", "term", F.struct((F.col("end") - F.char_length("term")).alias("start"), "end", F.col("term").alias("value")).alias("s"))
    terms = each.join(revealing, ["text_hash", "term"]).groupBy("text_hash").agg(F.sort_array(F.collect_list("s")).alias("term"))  # bounded by the text's own words
    rows = found.join(terms, "text_hash", "left")
    clear = F.filter("term", lambda s: ~F.exists("spans", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    added = F.transform(clear, lambda s: F.struct(F.lit(len(KINDS)).alias("order"), F.lit("term").alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    return rows.select("doc_id", "text_hash", "t", "spans", F.coalesce(added, F.filter("spans", lambda s: F.lit(False))).alias("term_spans"))


def sanitise(docs: DataFrame, min_support: int = 1, min_disclosure: float = 0.6, min_bits: float = 0.0) -> DataFrame:
    """(doc_id, text, base_spans, term_spans) per row of ``docs``: the sanitised text and what was found in it.

    Spans that overlap (a card inside a telephone number, say) are replaced together, by the first one's kind.
    """
    found = materialize(base_spans(docs), "pii-base").where(F.col("t").isNotNull())
    once = materialize(found.dropDuplicates(["text_hash"]).select("text_hash", "t", "spans"), "pii-once")
    revealing = materialize(revealing_terms(docs, once, min_support, min_disclosure, min_bits), "pii-text-terms")
    marked = materialize(_with_terms(found, once, revealing), "pii-marked")
    spans = F.array_sort(F.transform(F.concat("spans", "term_spans"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    marked = marked.withColumn("o", spans).withColumn("ends", F.transform("o", lambda s: s["end"]))
    tops = F.transform(F.sequence(F.lit(0), F.floor(F.size("o") / _BLOCK).cast("int")), lambda b: F.array_max(F.slice("ends", b * _BLOCK + 1, F.lit(_BLOCK))))
    marked = marked.withColumn("tops", tops)
    pieces = F.transform(
        "o",
        lambda s, i: F.when(
            s["start"] >= _reach(i), F.concat(F.substring(F.col("t"), (_reach(i) + 1).cast("int"), (s["start"] - _reach(i)).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        ).otherwise(F.lit("")),
    )
    clean = marked.withColumn("clean", F.concat(F.array_join(pieces, ""), F.substring(F.col("t"), (_reach(F.size("o")) + 1).cast("int"), F.char_length("t"))))
    clean = clean.select("doc_id", "text_hash", "clean", "spans", "term_spans").dropDuplicates(["doc_id", "text_hash"])
    rows = _hashed(docs)
    joined = rows.alias("r").join(clean.alias("c"), F.col("r.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("r.text_hash") == F.col("c.text_hash")), "left")
    none = F.array().cast(clean.schema["spans"].dataType)
    return joined.select(
        "r.doc_id", F.coalesce("clean", "t").alias("text"), F.coalesce("spans", none).alias("base_spans"), F.coalesce("term_spans", none).alias("term_spans")
    )


def _reach(i: Column) -> Column:
    """The furthest end of the spans of ``o`` before the i-th: ``tops`` has that of each whole block of ``ends``."""
    block = F.floor(i / _BLOCK).cast("int")
    whole, rest = F.array_max(F.slice("tops", F.lit(1), block)), F.array_max(F.slice("ends", block * _BLOCK + 1, i % _BLOCK))
    return F.coalesce(F.greatest(whole, rest), F.lit(0).cast("long"))


def span_list(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def n_of(kind: str, spans: Column) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
