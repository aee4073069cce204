"""A training-corpus pipeline: quality, line dedup, near-duplicate removal, decontamination, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. Between stages the rows are written to the shared folder and read again. Nulls, empty texts,
repeated rows and empty tables are handled as each operator's docstring says; columns beyond those of
``documents`` are left out.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rimward.llm import bpe, decontaminate, line_dedup, ngram_join, quality_rules
from rimward.llm.common import materialize
from rimward.session import ship_package

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble predicts to be of quality 1; it learns from the labelled rows of ``docs``."""
    ship_package(spark)
    model = quality_rules.train(docs, _table(spark, sf_dir, "labels"), "quality")
    return quality_rules.keep(docs, model, 0.3, *COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that at least ten of them have; a document of such lines alone is left with an empty text."""
    ship_package(spark)
    rows = docs.select(*COLUMNS)
    index = line_dedup.LineIndex.build(rows, min_docs=10, min_chars=1)
    # the other columns travel inside the id
    packed = rows.select(F.struct("doc_id", "lang", "source").alias("doc_id"), "text")
    pruned = index.prune(packed)
    return pruned.select("doc_id.*", "text").withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id, nulls last, and of those the least text hash.
    Documents without words are kept; rows with equal id and text are one.
    """
    ship_package(spark)
    groups = ngram_join.jaccard_components(docs)
    own = F.when(F.col("n_shingles") == 0, F.struct("doc_id", "text_hash"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash")))
    kept = groups.groupBy("component", own.alias("own")).agg(first.alias("first")).select("first.kept_id", "first.kept_hash").distinct()
    same = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.xxhash64("text") == F.col("kept_hash"))
    rows = docs.select(*COLUMNS).join(kept, same, "left_semi")
    return rows.dropDuplicates(["doc_id", "text"])


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of ten words with a benchmark item."""
    ship_package(spark)
    found = decontaminate.window_hits(docs, _table(spark, sf_dir, "benchmark"), window=10).select("doc_id", "text_hash").distinct()
    keyed = docs.select(*COLUMNS).withColumn("text_hash", decontaminate.text_hash())
    hit = keyed.alias("d").join(
        found.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.text_hash") == F.col("f.text_hash")), "left_anti"
    )
    return hit.select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents, and the digest of the text that they decode to."""
    ship_package(spark)
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    out = bpe.round_trip(docs, ranks, pattern)
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("bytes", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality),
    ("line_dedup", dedup_lines),
    ("near_duplicates", dedup_documents),
    ("decontamination", decontaminate_documents),
    ("byte_bpe", encode),
]

#: SQL can't fit the rule ensemble; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
