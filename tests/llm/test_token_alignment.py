"""Alignments against ends of tokens compared one by one, as the libraries encode whole texts."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from rimward.llm import token_alignment as ta
from tests.llm.test_operators import frame, words

FILES = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model")
SHOWN = "doc_id", "n_a", "n_b", "n_groups", "n_best", "count_sum", "groups_sha256"


def plain(texts):
    one = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=FILES[2])
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level tokens show as themselves
    byte_of = {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in printed)}
    rows, counts = [], collections.Counter()
    for t in texts:
        a = one.encode(" " + t, add_special_tokens=False).ids if t else []
        b = two.encode(t) if t else []
        x = [bytes(byte_of[c] for c in one.id_to_token(i)) for i in a]
        y = [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not t or b"".join(x) != (" " + t).encode() or b"".join(y) != (" " + t).encode():
            rows.append((0, 0, [], ""))
            continue
        ends_a, ends_b = (list(np.cumsum([len(z) for z in w])) for w in (x, y))
        groups, links, p, q = [], [], 0, 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            i, j = ends_a.index(cut) + 1, ends_b.index(cut) + 1
            groups.append(",".join(map(str, a[p:i])) + "|" + ",".join(map(str, b[q:j])))
            links.append((a[i - 1], b[j - 1]))
            p, q = i, j
        counts.update(links)
        rows.append((len(a), len(b), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    highest = collections.Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    return [(i, n_a, n_b, len(k), sum(counts[x] == highest[x[1]] for x in k), sum(counts[x] for x in k), g) for i, (n_a, n_b, k, g) in enumerate(rows)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(6)
    out = [words(rng, rng.randint(1, 80)) for _ in range(40)]
    out += [None, "", " ", "  ", " lead", "trail ", "two  spaces", "tab\tand\nline\n\n", "a ▁ b", "▁", "x▁ y z", "<|endoftext|> and <s> </s> <unk>", "<0x41>", "日本語のテキスト。 と 空白", "naïve café é ﬁ Å", "🙂🙃 👩‍👩‍👧", "don't we'll I've", "\x00 \x1c x \x1c", "a b c d", "ⅷ ½ ² ①"]
    return [*out, out[3], out[3], words(rng, 6000), "q" * 9000, "日本" * 2500, " ".join("é" * rng.randint(1, 9) for _ in range(500))]


@pytest.mark.parametrize(("block", "memo"), [(500_000, 400_000), (50, 20)])
def test_alignment_equals_ends_compared_one_by_one(spark, texts, monkeypatch, block, memo):
    monkeypatch.setattr(ta, "BLOCK_LINKS", block)
    monkeypatch.setattr(ta, "MEMO", memo)
    monkeypatch.setattr(ta, "BATCH_CHARS", block)
    got = ta.token_alignment(frame(spark, texts), *FILES).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in SHOWN) for r in got] == plain(texts)
    assert all(hashlib.sha256(r["groups"].encode()).hexdigest() == r["groups_sha256"] for r in got if r["n_a"])


def test_null_ids_and_empty_tables(spark):
    got = ta.token_alignment(frame(spark, ["one two", None, "one two"], [None, None, 7]), *FILES, keep_groups=False).collect()
    assert sorted((r["doc_id"] is None, r["n_groups"] > 0) for r in got) == [(False, True), (True, False), (True, True)]
    assert ta.token_alignment(frame(spark, []), *FILES).count() == 0
    assert ta.token_alignment(frame(spark, [None, ""]), *FILES).agg({"count_sum": "sum"}).first()[0] == 0


def test_ranks_of_shared_cuts():
    rng = np.random.default_rng(0)
    for size in (1, 63, 64, 65, 1000):
        a, b = (np.union1d(np.flatnonzero(rng.random(size) < 0.4) + 1, [size]) for _ in range(2))
        cuts = np.intersect1d(a, b)
        rank_a, rank_b = ta.shared_ranks(ta.end_bits(a, size), ta.end_bits(b, size))
        assert (a[rank_a - 1] == cuts).all() and (b[rank_b - 1] == cuts).all()


def test_vocabularies_with_inner_spaces_are_aligned_whole(texts):
    aligner = ta._aligner(open(FILES[0], "rb").read(), FILES[1], open(FILES[2], "rb").read())
    some = [t for t in texts[:60] if t]
    want = [(*x[:3], x[3].tolist()) for x in aligner.align_all(some)]
    whole = ta.Aligner(open(FILES[0], "rb").read(), FILES[1], open(FILES[2], "rb").read())
    whole.by_units = False
    assert [(*x[:3], x[3].tolist()) for x in whole.align_all(some)] == want
