"""The stages of the pipeline, each against what it should leave of its own input."""

import collections
import gc
import os
import re

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from rimward.llm import bpe, catalog, quality_rules
from tests.llm.test_operators import components, plain_statistics

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.mark.parametrize("name", [f.__name__ for f in catalog.OPERATORS])
def test_query_has_rows(spark, name):
    table = {"op3_vp_search": "embeddings", "op6_html_extract": "pages"}.get(name, "documents")
    got = catalog.queries()[name](spark, DATA)
    assert got.count() == (10 * spark.read.parquet(f"{DATA}/embeddings.parquet").where("vec_id % 100 = 0").count() if table == "embeddings" else spark.read.parquet(f"{DATA}/{table}.parquet").count())


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    got = catalog.queries()[name](spark, DATA)
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS FROM read_parquet('{DATA}/{file}')")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(want)


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where(F.col("doc_id") < 120)
    docs = docs.unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(None, None, None, None, None)], docs.schema)).withColumn("extra", F.lit(1))
    for name, stage in cp.STAGES[:-1]:
        after = stage(spark, docs, DATA)
        assert after.columns == list(cp.COLUMNS), name
        assert after.count() <= docs.count() and after.count() > docs.count() / 3
        docs = spark.createDataFrame(after.collect(), after.schema)
    last = cp.encode(spark, docs, DATA)
    want = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("s"))
    assert sorted(map(str, last.select("doc_id", "decoded_sha256").collect())) == sorted(str(r).replace("s=", "decoded_sha256=", 1) for r in want.collect())


def rows_of(frame):
    return collections.Counter(tuple(r) for r in frame.select(*cp.COLUMNS).collect())


def test_each_stage_leaves_what_plain_python_leaves(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select(*cp.COLUMNS)
    docs = docs.unionByName(docs.where("doc_id % 50 = 0")).unionByName(spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "s", 0)], docs.schema))
    rows = [tuple(r) for r in docs.collect()]

    def frame(left):
        return spark.createDataFrame(left, docs.schema)

    model = quality_rules.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"), "quality")

    def passes(text):
        s = plain_statistics(text)
        total = model.bias + sum(r.weight for r in model.rules if all((s[n.removeprefix("s_")] > b) == greater for n, greater, b in r.terms))
        return total >= -0.8472978603872037  # the score of 0.3

    rows = [r for r in rows if passes(r[1])]
    assert rows_of(cp.quality(spark, docs, DATA)) == collections.Counter(rows)

    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    counts = collections.Counter(k for r in rows for k in {key(x) for x in (r[1] or "").split("\n")})
    kept = ["\n".join(x for x in (r[1] or "").split("\n") if not key(x) or counts[key(x)] < 10) for r in rows]
    before, rows = rows, [(r[0], t, r[2], r[3], len(t)) for r, t in zip(rows, kept, strict=True)]
    assert rows_of(cp.dedup_lines(spark, frame(before), DATA)) == collections.Counter(rows)

    got = cp.dedup_documents(spark, frame(rows), DATA)
    left = rows_of(got)
    group = collections.defaultdict(set)
    for r, (n, component) in zip(rows, components([r[1] for r in rows]), strict=True):
        group[component if n else ("none", r[0], r[1])].add(r)
    assert sum(left.values()) == len(group)
    for members in group.values():  # one of each: one with the smallest id
        assert sum(left[m] for m in members) == 1
        ids = {m[0] for m in members} - {None}
        assert not ids or any(left[m] for m in members if m[0] == min(ids))
    rows = sorted(left, key=str)

    find = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        w = find(r["text"])
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1 if n else 0)}
    sizes = {len(w) for w in windows}
    clean = [r for r in rows if not any(tuple(w[i : i + n]) in windows for w in [find(r[1])] for n in sizes for i in range(len(w) - n + 1))]
    assert rows_of(cp.decontaminate_documents(spark, frame(rows), DATA)) == collections.Counter(clean) and 0 < len(clean) < len(rows)


def test_near_duplicates_leave_one_of_each_group(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(3, "a b c d e f", "en", "s", 1), (2, "a b c d e f", "en", "s", 1), (5, "g h i j k", "en", "s", 1), (5, "g h i j k", "en", "s", 1), (7, "", "en", "s", 0), (8, None, None, None, None)]
    got = cp.dedup_documents(spark, spark.createDataFrame(rows, schema), DATA)
    assert sorted(r["doc_id"] for r in got.collect()) == [2, 5, 7, 8]


def test_near_duplicates_with_null_or_repeated_ids_leave_one_of_each_group(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    base = [" ".join(f"{c}{i}" for i in range(60)) for c in "pqrs"]
    rows = [(None, base[0]), (None, base[0] + " more"), (3, base[1]), (5, base[1] + " more"), (5, base[2]), (None, base[3]), (9, base[3] + " more"), (None, "alone"), (None, None), (11, "")]
    got = cp.dedup_documents(spark, spark.createDataFrame([(*r, "en", "s", 1) for r in rows], schema), DATA).collect()
    found = sorted(((r["doc_id"], r["text"]) for r in got), key=str)
    assert len([t for _, t in found if t and t.startswith("p0 ")]) == 1
    rest = [x for x in found if not (x[1] and x[1].startswith("p0 "))]
    assert rest == sorted([(3, base[1]), (5, base[2]), (9, base[3] + " more"), (None, "alone"), (None, None), (11, "")], key=str)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in cp.STAGES:
        assert stage(spark, empty, DATA).count() == 0


def alive(kind):
    """How many objects of ``kind`` each of a worker's tasks finds in that worker."""

    def count(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(isinstance(x, kind) for x in gc.get_objects())], pa.int64())], names=["n"])

    return count


@pytest.mark.parametrize("stage", [cp.dedup_lines, cp.dedup_documents])
def test_a_stage_frees_what_its_workers_remember_of_another(spark, stage):
    """The workers of one stage are those of the next, so a vocabulary and its pieces lay beside all that near-duplicates needed."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").repartition(8)
    tasks = spark.range(0, 16, 1, 16)
    assert cp.encode(spark, docs, DATA).count() == docs.count()
    assert tasks.mapInArrow(alive(bpe.Codec), "n long").agg(F.sum("n")).first()[0] > 0
    stage(spark, docs, DATA).write.format("noop").mode("overwrite").save()
    assert tasks.mapInArrow(alive(bpe.Codec), "n long").agg(F.sum("n")).first()[0] == 0
