"""Near duplicates against all pairs; registers against what they stand for."""

import random

import numpy as np
import pytest

from rimward.llm import ngram_join, set_sketch
from tests.llm.test_operators import frame, words


def plain(texts):
    sets = []
    for t in texts:
        w = "".join(c.lower() if c < "\x80" else c for c in t or "").replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ")
        w = [x for x in w if x]
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set())
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return [(len(s), c, c == i) for i, (s, c) in enumerate(zip(sets, label, strict=True))]


@pytest.mark.parametrize(("sparse", "rows"), [(16, 500_000), (0, 0)])
def test_components_equal_all_pairs(spark, monkeypatch, sparse, rows):
    monkeypatch.setattr(ngram_join, "SPARSE", sparse)
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 400)
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", rows)
    rng = random.Random(2)
    texts = [words(rng, rng.randint(1, 90)) for _ in range(40)] + [None, "", " \n\t", "a b", "A  B", "a b c d", "é ß 日本 \x1c x y z", words(rng, 5000)]
    texts += [texts[0].upper(), texts[1], texts[1]]
    base = words(rng, 100).split()
    for i in range(60):  # some are linked only by way of others
        copy = list(base)
        for _ in range(1 + i % 5):
            copy[rng.randrange(100)] = f"edit{rng.randrange(99)}"
        texts.append(" ".join(copy))
    long = texts[47].split()
    long[100] = "changed"
    texts.append(" ".join(long))
    got = set_sketch.near_duplicates(frame(spark, texts)).orderBy("doc_id").collect()
    assert [(r["n_shingles"], r["component_id"], r["kept"]) for r in got] == plain(texts)


def test_null_ids_and_empty_table(spark):
    rows = set_sketch.near_duplicates(frame(spark, ["a b c d e", "a b c d e", None, "q r s t u"], [None, 3, None, None])).collect()
    assert sorted((r["doc_id"] is None, r["component_id"] is None, r["n_shingles"], r["kept"]) for r in rows) == [(False, False, 2, True), (True, False, 2, False), (True, True, 0, True), (True, True, 2, True)]
    assert set_sketch.near_duplicates(frame(spark, [])).count() == 0


def test_registers_merge_agree_and_estimate():
    rng = np.random.default_rng(3)
    draw = lambda n: rng.integers(0, 2**64, n, dtype=np.uint64)
    a, b = draw(5000), draw(3000)
    assert (set_sketch.registers(np.concatenate([a, b])) == np.maximum(set_sketch.registers(a), set_sketch.registers(b))).all()
    assert not set_sketch.registers(draw(0)).any()
    errors, shared = [], 0
    for _ in range(60):
        both, x, y = draw(800), draw(60), draw(140)  # similarity 0.8
        x, y = np.concatenate([both, x]), np.concatenate([both, y])
        p, q = set_sketch.registers(x), set_sketch.registers(y)
        errors.append(set_sketch.estimates(p[None, :], q[None, :], np.array([len(x)]), np.array([len(y)]))[0] - 0.8)
        shared += bool(set(set_sketch.band_signatures(p)) & set(set_sketch.band_signatures(q)))
    assert shared == 60
    assert abs(np.mean(errors)) < 0.02 and np.abs(errors).max() < set_sketch.MARGIN
    p, q = set_sketch.registers(draw(500)), set_sketch.registers(draw(700))
    assert set_sketch.estimates(p[None, :], q[None, :], np.array([500]), np.array([700]))[0] < 0.05
    assert not set(set_sketch.band_signatures(p)) & set(set_sketch.band_signatures(q))


def test_pairs_far_below_the_threshold_are_not_verified(spark):
    rng = np.random.default_rng(4)
    both = rng.integers(0, 2**64, 500, dtype=np.uint64)
    sets = {1: both, 2: np.concatenate([both[:300], rng.integers(0, 2**64, 200, dtype=np.uint64)]), 3: both[:450]}
    sketches = spark.createDataFrame([(i, bytearray(set_sketch.registers(s).tobytes()), len(s)) for i, s in sets.items()], "set_id long, sketch binary, n_shingles long")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "a long, b long")
    assert [(r["a"], r["b"]) for r in set_sketch.likely(pairs, sketches).collect()] == [(1, 3)]
