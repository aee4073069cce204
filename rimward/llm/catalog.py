"""The thin queries over the corpus operators, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rimward.llm import bpe, conversation_trie, decontaminate, html_extract, line_dedup, ngram_join, pii, quality_rules, set_sketch, token_alignment, token_counts, toxic_spans, vp_search
from rimward.llm.oracles import ORACLES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(folds: int):
    """The remainder of crc32 of the id as text."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality_rules.train(docs, labels.where(_fold(5) != 0), "quality")
    out = quality_rules.score(docs, model, threshold=0.3)
    return out.select("doc_id", (F.coalesce(_fold(5), F.lit(1)) == 0).alias("held_out"), "score", "predicted")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.sanitise(_table(spark, sf_dir, "documents"), min_support=1, min_disclosure=0.6, min_bits=0.0)
    return out.select(
        "doc_id",
        *[pii.n_of(kind, F.col("base_spans")).alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(pii.span_list(F.col("base_spans")), 256).alias("base_sha256"),
        pii.span_list(F.concat("base_spans", "term_spans")).alias("spans"),
    )


def op3_vp_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    out = vp_search.nearest(rows, rows.where(F.col("vec_id") % 100 == 0), "vec_id", "embedding", k=10, factor=1.0)
    return out.withColumnRenamed("id", "vec_id")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    out = bpe.round_trip(_table(spark, sf_dir, "documents"), ranks, pattern)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op9_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxic_spans.train(docs, labels.where(_fold(4) != 2), "toxic")
    out = toxic_spans.tag(docs, model, threshold=0.3)
    return out.select("doc_id", (F.coalesce(_fold(4), F.lit(0)) == 2).alias("held_out"), "score", "predicted")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = conversation_trie.conversation_trie(_table(spark, sf_dir, "conversations"), group=100, heads=6)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_set_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_sketch.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, model = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")
    out = token_alignment.token_alignment(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, model, keep_groups=False)
    # a link for each shared cut, as every token has a byte
    return out.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")


OPERATORS = (
    op1_quality_rules, op2_pii, op3_vp_search, op4_ngram_join, op5_line_dedup, op6_html_extract, op7_byte_bpe, op8_token_counts, op9_toxic_spans, op10_decontaminate,
    op11_conversation_trie, op12_set_sketch, op13_token_alignment,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
