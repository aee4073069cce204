"""Each corpus operator against a brute-force version, on small tables with nulls, empty, long and repeated texts."""

import base64
import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rimward.llm import bpe, catalog, decontaminate, html_extract, line_dedup, ngram_join, pii, quality_rules, token_counts, toxic_spans, vp_search

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
JSON = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, text_hash string, t string, component string"  # the last three clash with inner names


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in zip(ids, texts, strict=True)], SCHEMA)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [words(rng, rng.randint(1, 120)) for _ in range(60)]
    near = []
    for t in base[:12]:
        parts = t.split()
        if len(parts) > 60:
            parts[rng.randrange(len(parts))] = "changed"
        near.append(" ".join(parts))
    odd = [None, "", " \n\t ", "a b", "A  B", base[0].upper(), base[1], base[1], "é ß 日本 \x1c   x", words(rng, 4000), "x" * 3000, "\n\n", "one\n Two \nthree"]
    return base + near + odd


def test_line_dedup_is_exact_by_broadcast_and_by_dealt_filters(spark, texts, monkeypatch):
    lines = ["same line", " Same LINE\t", "rare"]
    docs = [f"{lines[i % 2]}\nown {i}\n\n{t or ''}" for i, t in enumerate(texts)] + [None, "", "rare"]
    counts = collections.Counter(k for d in docs for k in {line_dedup.line_key(x.encode()) for x in (d or "").split("\n")})
    want = []
    for i, d in enumerate(docs):
        split = (d or "").split("\n")
        kept = [x for x in split if not (k := line_dedup.line_key(x.encode())) or counts[k] < 10]
        want.append((i, len(split), len(split) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    got = lambda: sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in line_dedup.dedup_lines(frame(spark, docs)).collect())
    assert got() == want
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", 0)
    assert got() == want


def test_line_hashes_are_dealt_to_the_shards_of_large_filters(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(line_dedup, "KEYS_PER_SHARD", 500)
    often = "\n".join(f"often {i}" for i in range(2_000))
    docs = [f"{often}\n" + "\n".join(f"rare {d} {i}" for i in range(8_000)) for d in range(12)]
    df = frame(spark, docs)
    index = line_dedup.LineIndex.build(df, min_docs=10)
    wrong = index._exceptions()
    keys = {tuple(r) for r in wrong.collect()}
    assert index.shards == 4 and keys  # filters do answer yes for a few of 96,000 other keys
    assert wrong.join(index.counts.where("n_docs < 10"), ["h1", "h2"], "left_semi").count() == len(keys)
    out = index.prune(df)
    assert not any("line-counts" in path for path in out.inputFiles())  # filters answer, not the exact table
    want = {(8_000, hashlib.sha256(("\n".join(d.split("\n")[2_000:])).encode()).hexdigest()) for d in docs}
    assert {(r["n_lines"] - r["n_dropped"], r["kept_sha256"]) for r in out.collect()} == want


def test_line_index_takes_back_what_was_inserted(spark):
    first, second = frame(spark, [f"shared\nown {i}" for i in range(6)]), frame(spark, [f"shared\nother {i}" for i in range(6)])
    index = line_dedup.LineIndex.build(first, min_docs=10)
    table = lambda ix: sorted(tuple(r) for r in ix.counts.collect())
    grown = index.insert(second)
    assert grown.prune(first).agg(F.sum("n_dropped")).first()[0] == 6
    back = grown.delete(second)
    assert table(back) == table(index) and back.prune(first).agg(F.sum("n_dropped")).first()[0] == 0


def test_line_index_deals_its_keys_anew_when_they_outgrow_their_shards(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "KEYS_PER_SHARD", 4)
    first = frame(spark, ["a\nb"] * 10)
    more = frame(spark, ["\n".join(f"line {i}" for i in range(30))] * 10)
    index = line_dedup.LineIndex.build(first, min_docs=10)
    grown = index.insert(more)
    assert (index.shards, grown.shards) == (1, 8) and grown.filters.agg(F.sum("n_keys")).first()[0] == 32
    assert grown.prune(first.unionByName(more)).agg(F.sum("n_dropped")).first()[0] == 320
    back = grown.delete(more)
    assert back.prune(first).agg(F.sum("n_dropped")).first()[0] == 20 and back.counts.count() == 2


def test_cuckoo_filter_holds_all_and_forgets_removed():
    rng = np.random.default_rng(0)
    h1, h2 = rng.integers(-(2**63), 2**63, (2, 5000))
    made = line_dedup._built(h1, h2)
    assert made.holds(h1, h2).all()
    made.remove(h1[:2500], h2[:2500])
    assert made.holds(h1[2500:], h2[2500:]).all() and made.holds(h1[:2500], h2[:2500]).mean() < 0.01


def test_bpe_equals_the_library_and_round_trips(spark, texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    more = [*texts, "<|endoftext|> it's 'll", "  two  spaces \n\n x ", "　wide　 space", "a\x1cb \x85 c"]
    rows = bpe.decode(bpe.encode(frame(spark, more), RANKS, PATTERN), RANKS, PATTERN).orderBy("doc_id").collect()
    assert [list(r["ids"]) for r in rows] == [library.encode_ordinary(t or "") for t in more]
    assert [bytes(r["bytes"]) for r in rows] == [(t or "").encode() for t in more]


def test_bpe_of_long_pieces_equals_the_library(spark):
    rng = random.Random(11)
    many = ["a" * 100_000, "abcdefghij" * 10_000, "x" * 100_007, *["".join(rng.choice(letters) for _ in range(3_000)) for letters in ("acgt", "thean", "ing", "abcdefghijklmnopqrstuvwxyz", "=-", "\u0928\u092e\u0938", " \n", "19")]]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = bpe.round_trip(frame(spark, [*many, None, ""]), RANKS, PATTERN).orderBy("doc_id").collect()
    assert [list(r["ids"]) for r in rows] == [library.encode_ordinary(t) for t in many] + [[], []]
    assert [bytes(r["bytes"]) for r in rows] == [t.encode() for t in many] + [b"", b""]
    assert bpe.round_trip(frame(spark, []), RANKS, PATTERN).count() == 0


def test_null_ids_repeated_rows_and_empty_tables(spark):
    docs, ids = ["x y\nz", "x y\nz", None, "", "long " * 20_000], [None, None, None, 4, 4]
    df, empty = frame(spark, docs, ids), frame(spark, [])
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    lines = sorted((str(r["doc_id"]), r["n_lines"], r["kept_sha256"]) for r in line_dedup.dedup_lines(df).collect())
    assert lines == sorted((str(i), (d or "").count("\n") + 1, sha(d)) for i, d in zip(ids, docs, strict=True))
    tokens = sorted((str(r["doc_id"]), r["n_bytes"]) for r in token_counts.count_tokens(df, JSON).collect())
    assert tokens == sorted((str(i), len(d or "")) for i, d in zip(ids, docs, strict=True))
    ids_back = sorted((str(r["doc_id"]), bytes(r["bytes"]).decode()) for r in bpe.round_trip(df, RANKS, PATTERN).collect())
    assert ids_back == sorted((str(i), d or "") for i, d in zip(ids, docs, strict=True))
    assert line_dedup.dedup_lines(empty).count() == token_counts.count_tokens(empty, JSON).count() == 0


def test_bpe_rejects_unknown_ids(spark):
    with pytest.raises(Exception, match="vocabulary"):
        bpe.decode(spark.createDataFrame([(1, [60000])], "doc_id long, ids array<int>"), RANKS, PATTERN).collect()


def test_token_counts_equal_the_library(spark, texts):
    more = [*texts, "<|endoftext|> in <|endoftext|>text", "a  b \n c", "x" * 70000, "word " * 20000, "no\n\nspaces\n" * 9000]
    library = Tokenizer.from_file(JSON)
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in more]
    rows = token_counts.count_tokens(frame(spark, more), JSON).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in rows] == want and [r["n_bytes"] for r in rows] == [len((t or "").encode()) for t in more]
    assert [r["over_limit"] for r in rows] == [n > 512 for n in want]


def test_small_chunks_resynchronise(texts):
    counter = token_counts.Counter(open(JSON, encoding="utf-8").read())
    library = Tokenizer.from_file(JSON)
    for t in filter(None, texts):
        assert counter.count_huge(t, 60, 8) == len(library.encode(t, add_special_tokens=False).ids)


def components(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    label = list(range(len(sets)))
    for _ in sets:
        before = list(label)
        for i, a in enumerate(sets):
            for j in range(i):
                b = sets[j]
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
        if label == before:
            break
    return [(len(s), x) for s, x in zip(sets, label, strict=True)]


@pytest.mark.parametrize("sparse", [16, 0])
def test_jaccard_components_equal_brute_force(spark, texts, monkeypatch, sparse):
    monkeypatch.setattr(ngram_join, "SPARSE", sparse)
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 400)
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0 if sparse else 500_000)
    rng = random.Random(9)
    group = []
    base = words(rng, 100).split()
    for i in range(40):  # some are linked only by way of others
        copy = list(base)
        for _ in range(1 + i % 4):
            copy[rng.randrange(100)] = f"edit{rng.randrange(99)}"
        group.append(" ".join(copy))
    many = [*texts, *group]
    rows = ngram_join.jaccard_components(frame(spark, many)).orderBy("doc_id").collect()
    assert [(r["n_shingles"], r["component_id"]) for r in rows] == components(many)


def test_pairs_grow_with_the_sets_of_a_cluster_of_near_copies(spark, monkeypatch):
    rng = random.Random(10)
    base = words(rng, 70).split()
    many = []
    for i in range(2400):  # most are linked to few others, directly or by way of others
        copy = list(base)
        for at in rng.sample(range(70), 1 + i % 6):
            copy[at] = f"edit{rng.randrange(9)}"
        many.append(" ".join(copy))
    made, meant = [], ngram_join._linked
    monkeypatch.setattr(ngram_join, "_linked", lambda pairs, sets: made.append(pairs.count()) or meant(pairs, sets))
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 500)
    rows = ngram_join.jaccard_components(frame(spark, many)).orderBy("doc_id").collect()
    assert len(made) == ngram_join.HUB_ROUNDS + 1 and max(made[:-1]) <= 2400 and made[-1] <= ngram_join.SPARSE * 2400
    column: dict = {}
    matrix = np.zeros((2400, 60_000), dtype=np.float32)
    for i, t in enumerate(many):
        w = t.split()
        for j in range(len(w) - 4):
            matrix[i, column.setdefault(tuple(w[j : j + 5]), len(column))] = 1
    both, size = matrix @ matrix.T, matrix.sum(1)
    near = 180 * both >= 80 * (size[:, None] + size[None, :])
    label, before = np.arange(2400), None
    while before is None or (label != before).any():
        before, label = label, np.where(near, label[None, :], 2400).min(1)
    assert 10 < len(set(label)) < 2300
    assert [r["component_id"] for r in rows] == label.tolist()


def test_groups_of_many_sets_and_a_few_others_make_few_pairs(spark):
    rows = [(s, i, 0 if i < 90 else i) for s in (1, 2) for i in range(93)] + [(3, 200 + i, 200 + i) for i in range(50)] + [(4, 1, 0), (4, 300, 300)]
    pairs, dense = ngram_join.sparse_pairs(spark.createDataFrame(rows, "signature long, set_id long, component long"), 7)
    want = {(i, j) for i in range(90) for j in (90, 91, 92)} | {(1, 300)}
    got = {(r["a"], r["b"]) for r in pairs.collect()}
    assert got == want
    # the others of group 1 have candidates beyond the limit, and are compared with each other in blocks
    assert {r["set_id"] for r in dense.collect()} == {90, 91, 92} | set(range(200, 250))


def test_jaccard_components_with_null_ids_and_empty_table(spark):
    rows = ngram_join.jaccard_components(frame(spark, ["a b c d e f", "a b c d e f", None], [None, 3, None])).collect()
    assert sorted((r["doc_id"] is None, r["component_id"]) for r in rows if r["n_shingles"]) == [(False, 3), (True, 3)]
    assert ngram_join.jaccard_components(frame(spark, [])).count() == 0


def test_decontamination_equals_brute_force(spark, texts):
    rng = random.Random(3)
    items = [words(rng, n) for n in (1, 4, 9, 10, 11, 40)] + [None, "", "...", "r r r r r r r r r r r r"]
    docs = [*texts, *[f"{words(rng, 20)}, {t.upper()}! {words(rng, 7)}" for t in items if t], "r " * 50, " ".join(items[5].split()[3:13]), " ".join(items[5].split()[3:12])]
    find = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+").findall
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    windows = collections.defaultdict(set)
    for i, t in enumerate(items):
        w = find(low(t))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(str(i))
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], "item_id long, text string, words string")
    rows = decontaminate.contamination(frame(spark, docs), bench).orderBy("doc_id").collect()
    for r, d in zip(rows, docs, strict=True):
        w, hit, found = find(low(d)), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if items_here := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= items_here
        assert (r["n_words"], r["n_hit"], r["items"]) == (len(w), len(hit), sorted(found))
    assert decontaminate.contamination(frame(spark, docs), bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


@pytest.mark.parametrize("rows", [500_000, 0])
def test_decontamination_by_broadcast_and_by_shuffle(spark, monkeypatch, rows):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(decontaminate, "BITS", 64)  # a bitmap that is nearly full finds the same
    items = ["one", "two words", "a b c", "r s t u v w x y z a b c d", "two words", "k l m n o p q r s t"]
    docs = ["ONE, two words; a b", "k l m n o p q r s t u v w x y z a b c d", "b a b c", "", None, "one one", "words two"]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(None, "words two")], "item_id long, text string")
    got = {(r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in decontaminate.contamination(frame(spark, docs, [1, 2, 3, 4, 5, None, 7]), bench).collect()}
    assert got == {(1, 5, 3, ("0", "1", "4")), (2, 20, 20, ("2", "3", "5")), (3, 4, 3, ("2",)), (4, 0, 0, ()), (5, 0, 0, ()), (None, 2, 2, ("0",)), (7, 2, 0, ())}
    assert decontaminate.contamination(frame(spark, []), bench).count() == 0


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def test_base_spans_equal_the_plain_patterns(spark, texts):
    rng = random.Random(2)
    pieces = ["a.b@c.de", "x@y", "_q%@w-1.zz.", "10.0.0.255", "300.1.1.1", "1.2.3.4.5.6", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+49.30", "é日", "@", "+", "12", "007.08.09.0010"]
    docs = [*texts, *["".join(rng.choice([*pieces, " ", ",", "."]) for _ in range(rng.randint(1, 60))) for _ in range(120)], "1" * 5000, "a" * 5000 + "@" + "b." * 2000, "9 " * 3000]
    rows = pii.sanitise(frame(spark, docs)).select("doc_id", pii.span_list(F.col("base_spans")).alias("s")).orderBy("doc_id").collect()
    for r, d in zip(rows, docs, strict=True):
        want = [f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items() for m in re.finditer(p, d or "") if valid(k, m[0])]
        assert r["s"] == ",".join(want)


def test_revealing_terms_are_generalised_where_their_entity_is(spark):
    rng = random.Random(1)
    docs = [f"{words(rng, 8)} Zorblax wrote from zor@blax.example about {words(rng, 6)}" for _ in range(5)] + [f"{words(rng, 30)} about nothing" for _ in range(200)]
    rows = pii.sanitise(frame(spark, docs), min_support=3, min_disclosure=0.6, min_bits=4.0).orderBy("doc_id").collect()
    assert all("[TERM]" in r["text"] and "Zorblax" not in r["text"] and "[EMAIL]" in r["text"] for r in rows[:5])
    assert all(r["text"] == d and not r["term_spans"] for r, d in zip(rows[5:], docs[5:], strict=True))


@pytest.mark.parametrize("others", [1, 40, 400])
def test_query_generalises_terms_of_entities_in_one_text_or_in_many(spark, tmp_path, others):
    once = [f"the Quibbler wrote from qui@b.example to you {i}" for i in range(1)]
    half = [f"the Zorblax wrote from zor@blax.example to you {i}" for i in range(others)]
    docs = [*once, *half, *[f"the letter to you {i}" for i in range(others)]]
    frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    for r in catalog.op2_pii(spark, str(tmp_path)).collect():
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        terms = {docs[r["doc_id"]][int(a) : int(b)] for k, a, b in spans if k == "term"}
        assert terms & {"Quibbler", "Zorblax"} == set(re.findall("Quibbler|Zorblax", docs[r["doc_id"]]))
        assert not terms & {"the", "you"}


def test_copies_of_a_text_count_once_as_evidence(spark):
    docs = [f"Zorblax wrote from zor@blax.example on day {i}" for i in range(5)] + [f"someone wrote from here on day {i}" for i in range(10)]
    rows = pii.sanitise(frame(spark, docs + [docs[0]] * 1000)).where("contains(text, 'EMAIL')").collect()
    assert len(rows) == 1005 and all("Zorblax" not in r["text"] and r["text"].startswith("[TERM] wrote from [EMAIL]") for r in rows)


def term_spans(docs, min_disclosure=0.6):
    """The term spans of each text, by counting over the distinct texts."""
    term = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
    once, base, entities, terms = sorted({d or "" for d in docs}), {}, {}, {}
    for d in once:
        base[d] = [(k, m.start(), m.end(), m[0]) for k, p in PLAIN.items() for m in re.finditer(p, d) if valid(k, m[0])]
        entities[d] = {(k, re.sub("[^0-9]", "", v) if k in ("card", "phone") else v.lower()) for k, _, _, v in base[d]}
        terms[d] = {w for w in term.findall(d) if len(w) >= 3 and re.search("[^0-9]", w)}
    n_term, n_entity = collections.Counter(w for d in once for w in terms[d]), collections.Counter(e for d in once for e in entities[d])
    n_both = collections.Counter((e, w) for d in once for e in entities[d] for w in terms[d])
    out = []
    for d in (d or "" for d in docs):
        reveal = {w for e in entities[d] for w in terms[d] if n_both[e, w] / n_term[w] >= min_disclosure and len(once) * n_both[e, w] / (n_entity[e] * n_term[w]) > 1}
        out.append([(m.start(), m.end()) for m in term.finditer(d) if m[0] in reveal and not any(a < m.end() and m.start() < b for _, a, b, _ in base[d])])
    return out


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_term_spans_equal_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(pii, "BROADCAST_ROWS", broadcast)
    rng = random.Random(15)
    people = [(f"Name{i}", f"Town{i % 4}", rng.choice([f"n{i % 9}@mail.example", f"10.0.0.{i}", f"+49 30 {1000000 + i}", "4111 1111 1111 1111"])) for i in range(14)]
    docs = [None, "", None, "no words 123 12345678901234567"]
    for _ in range(90):
        who = rng.sample(people, rng.choice([0, 1, 1, 2]))
        docs.append(" ".join(rng.sample([w for p in who for w in p] + words(rng, 4).split() + ["é日本", "9x9", "12"], 3 * len(who) + 5)))
    docs += rng.choices(docs, k=30)
    ids = [None if i % 17 == 0 else i // 2 for i in range(len(docs))]  # null and repeated ids
    found = collections.Counter()
    for r in pii.sanitise(frame(spark, docs, ids)).collect():
        found[r["doc_id"], r["text"], tuple((s["start"], s["end"]) for s in r["term_spans"])] += 1
    want = collections.Counter()
    for i, d, spans in zip(ids, docs, term_spans(docs), strict=True):
        marks = sorted([(a, b, "TERM") for a, b in spans] + [(m.start(), m.end(), k.upper()) for k, p in PLAIN.items() for m in re.finditer(p, d or "") if valid(k, m[0])])
        text, reach = "", 0
        for a, b, k in marks:
            if a >= reach:
                text += (d or "")[reach:a] + f"[{k}]"
            reach = max(reach, b)
        want[i, text + (d or "")[reach:], tuple(spans)] += 1
    assert found == want and sum(len(k[2]) for k in want) > 50
    assert pii.sanitise(frame(spark, [])).count() == 0


def test_terms_far_from_their_entity_are_found(spark):
    gap = " and so on" * 30
    docs = [f"Zorblax wrote.{gap} Reply to zor@blax.example{gap}, says{gap if i % 2 else ''} Vantrell" for i in range(4)] + [f"a reply, says someone{gap} who wrote {i}" for i in range(8)]
    docs += [" ".join(f"a{i}@b.example word{i}x" for i in range(400)), "word7x"]
    rows = pii.sanitise(frame(spark, docs)).orderBy("doc_id").collect()
    for r, d in zip(rows[:4], docs[:4], strict=True):
        assert r["text"] == d.replace("Zorblax", "[TERM]").replace("Vantrell", "[TERM]").replace("Reply", "[TERM]").replace("zor@blax.example", "[EMAIL]")
    assert rows[12]["text"] == " ".join("[EMAIL] " + ("word7x" if i == 7 else "[TERM]") for i in range(400)) and not rows[13]["term_spans"]


def test_html_keeps_the_article(spark):
    page = (
        "<html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body><header>Site</header><nav><ul><li><a href=/>Home</a></ul></nav>"
        "<div class='cookie-notice'>We use cookies</div><div id=main><div class=post-17><h1>Head &amp; line</h1><p>First  <b>bold</b>\n text.<p>Second &eacute; part, rather long, with prose in it."
        "<aside>Related</aside><form><input value=x>Sign up</form></div><div class=comments><p>I disagree with all of this, at length, again and again.</p></div></div><footer>&copy; 2020</footer>"
    )
    pages = spark.createDataFrame([(1, "https://a.example/1", page, "x"), (2, "https://a.example/2", page.replace("post-17", "post-8"), "x"), (3, None, None, "x"), (4, "bad", "", "x"), (5, "u", "plain text", "x")], "page_id long, url string, html string, host string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    assert got[1] == got[2] == "Head & line\nFirst bold text.\nSecond é part, rather long, with prose in it."
    assert got[3] == got[4] == "" and got[5] == "plain text"


SENTENCE = "Prose that is long enough to be told from a label, as it has a verb and a full stop."
PAGES = {
    "headline and lead beside the text": ("<body><div class=top>Site</div><div class=post><h1>Head</h1><p>lead</p><div class=text><p>{0}<p>{0}</div><p>closing</p></div><div class=low>(c) 2020</div>", "Head\nlead\n{0}\n{0}\nclosing"),
    "names with one odd word": ('<article><p class="related-work">{0}<p id="notice-period">kept<p class="share-price">kept too</article>', "{0}\nkept\nkept too"),
    "names of other parts": ('<div id=c><p>{0}<div class="cookie-banner">no</div><div id="related-posts"><p>{0}</div><p class=advert>no<p>a <span class=promo>no</span> b</div>', "{0}\na b"),
    "comments longer than the article": ("<body><div class=entry><p>{0}</div><div class=comments><article class=comment><p>{0}<p>{0}<p>{0}</article></div>", "{0}"),
    "only a name against it": ("<body><div class=widget><p>{0}</div><footer>(c)</footer>", "{0}"),
    "sections": ("<main><div class=a><p>{0}</div><div class=b><p>{0}</div></main><div class=sidebar><p>{0}</div>", "{0}\n{0}"),
    "lists and tables": ("<article><ul><li>one<li>two</ul><table><tr><td>x<td>y</table><pre>p  q</pre></article>", "one\ntwo\nx\ny\np q"),
    "unclosed": ("<p>{0}<p><b>{0}<i>x", "{0}\n{0}x"),
    "inline styles": ('<article style="overflow:hidden"><p style="visibility: hidden-ish; role=menu">{0}<p style=\'class="advert"\'>kept</article>', "{0}\nkept"),
    "links and data": ('<article><p>See <a href="/the-hidden-lake">the lake</a> now. {0}<p data-role="banner">one<p data-id="share">two<p data-hidden>three<p x-class=promo>four</article>', "See the lake now. {0}\none\ntwo\nthree\nfour"),
    "stray quotes": ("<article><p title=it's>{0}<p title=\"never closed>two<p alt='a b'>three<p class=a'b id='c'>four</article>", "{0}\ntwo\nthree\nfour"),
    "hidden all the same": ('<article><p>{0}<p hidden>no<p HIDDEN="">no<p class="x" hidden=hidden>no<p aria-hidden = "true">no<p title="a>b" role=banner>no<p/hidden>no</article>', "{0}"),
    "references": ("<article><p>&lt;b&gt; &amp;amp; &#233;&nbsp;x</article>", "<b> &amp; é x"),
}


def test_html_keeps_whole_articles_of_many_forms(spark):
    rows = [(i, f"https://h{i}.example/{j}", form.format(SENTENCE), "x") for i, (form, _) in enumerate(PAGES.values()) for j in range(2)]
    rows += [(99, "https://deep.example", "<div>" * 20_000 + "x" + "<b>" * 20_000 + "<p>y" * 20_000 + "</i>" * 20_000, "x"), (None, "https://h0.example/0", rows[0][2], None), rows[0]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = collections.defaultdict(set)
    for r in html_extract.extract(pages).collect():
        got[r["page_id"]].add(r["text"])
        assert r["n_chars"] == len(r["text"])
    for i, (name, (_, want)) in enumerate(PAGES.items()):
        assert got[i] == {want.format(SENTENCE)}, name
    assert got[99] == {"\n".join(["x"] + ["y"] * 20_000)} and got[None] == got[0]
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_html_reads_articles_with_any_attributes(spark):
    rng = random.Random(8)
    names = ["style", "title", "href", "data-role", "data-id", "data-hidden", "alt", "onclick", "lang", "x-class", "aria-label"]
    values = ["overflow:hidden", "/the-hidden-lake", "it's", "banner", "share", "a > b", 'say "no"', "role=menu", "", "class='advert'", "hidden"]

    def attribute():
        name, value = rng.choice(names), rng.choice(values)
        quotes = [q for q in "\"'" if q not in value]
        bare = value and not re.search(r"[\s>\"'=]", value)
        return name if not value else f" {name}={value}" if bare and rng.random() < 0.5 else f" {name} = {quotes[0]}{value}{quotes[0]}"

    rows, want = [], {}
    for i in range(40):
        lines = [f"{SENTENCE} {j}" for j in range(rng.randint(1, 6))]
        tag = lambda t: f"<{t} {' '.join(attribute() for _ in range(rng.randint(0, 4)))}>"
        body = "".join(f"{tag('p')}{line[:20]}{tag('b')}{line[20:30]}</b>{line[30:]}</p>" for line in lines)
        rows.append((i, f"https://h{i % 3}.example/{i}", f"<body><nav>menu</nav>{tag('article')}{body}</article><footer>(c)</footer>"))
        want[i] = "\n".join(lines)
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == want
    assert len(html_extract.parse("<p " + "a" * 200_000).blocks) == 0  # a tag that never ends takes no more time than its length


def test_html_reads_pages_at_the_path_of_their_host(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "BROADCAST_ROWS", 0)
    page = "<body><div class=c><h1>H</h1><p>{0}</div><div class=other>{1}</div>"
    rows = [(i, "https://h.example/x", page.format(SENTENCE, "" if i else f"<p>{SENTENCE}")) for i in range(20)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in got} == {f"H\n{SENTENCE}"}  # also the page that would take its own body


@pytest.mark.parametrize("rows", [30, 3000])
def test_nearest_is_exact_at_factor_one(spark, rows):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(rows, 6)).round(1)
    bad = [None, [0.0] * 6, [float("nan")] * 6, [float("inf")] + [1.0] * 5, [None] + [1.0] * 5, [1.0] * 5]
    df = spark.createDataFrame([(i, [float(c) for c in x], "x") for i, x in enumerate(v)] + [(rows + i, b, "x") for i, b in enumerate(bad)], "vec_id long, embedding array<double>, score string").repartition(3)
    usable = np.flatnonzero(np.abs(v).sum(1) > 0)
    got = collections.defaultdict(list)
    for r in vp_search.nearest(df, df.where("vec_id % 10 = 0"), "vec_id", "embedding").orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["id"], r["score"]))
    for q in (i for i in usable if i % 10 == 0):
        gaps = vp_search.exact_distances(np.broadcast_to(v[q], v.shape), v)
        order = [i for i in usable[np.lexsort((usable, gaps[usable]))] if i != q][:10]
        assert [i for i, _ in got[q]] == order and np.allclose([s for _, s in got[q]], gaps[order])
    assert vp_search.nearest(df.limit(0), df.limit(0), "vec_id", "embedding").count() == 0


def test_quality_rules_separate_junk(spark):
    rng = random.Random(8)
    docs = [words(rng, 60) + "." if i % 3 else " ".join(w + "###" for w in words(rng, 60).split()) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 200)] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = quality_rules.train(frame(spark, docs), labels)
    assert 0 < len(model.rules) < 60
    rows = quality_rules.score(frame(spark, [*docs, None, ""]), model).orderBy("doc_id").collect()
    assert all(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in rows if 200 <= r["doc_id"] < 300) and all(0 <= r["score"] <= 1 for r in rows)
    kept = quality_rules.keep(frame(spark, docs), model, 0.3, "doc_id", "text").collect()
    assert sorted(r["doc_id"] for r in kept) == [r["doc_id"] for r in rows if r["predicted"] and r["doc_id"] < 300]
    assert quality_rules.score(frame(spark, ["a"]), quality_rules.train(frame(spark, docs), labels.limit(0))).first()["score"] == 0.5


def plain_statistics(text):
    t = text or ""
    w, lines = [x for x in re.split("[\x20\x09-\x0d]+", t) if x], t.split("\n")
    count = lambda p: len(re.findall(p, t))
    n = max(len(w), 1)
    out = {"log_chars": np.log1p(len(t)), "log_words": np.log1p(len(w)), "word_length": len(t) / n, "words_per_line": len(w) / len(lines), "distinct_words": len(set(w)) / n, "distinct_lines": len(set(lines)) / len(lines)}
    patterns = {"upper": "[A-Z]{2,}", "marks": r"[#$%&*|]", "bangs": "!", "digits": "[0-9]+", "stops": "[.?]", "commas": "[,;:]", "links": "https?:|www[.]|@", "odd": r"[<>{}\[\]=_~^\\/]"}
    return out | {f"{k}_per_word": count(p) / n for k, p in patterns.items()}


def test_quality_scores_equal_the_rules_taken_one_by_one(spark, texts):
    rng = random.Random(16)
    docs = [words(rng, 30).upper() + "!" if i % 2 else words(rng, 40) + "." for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int")
    model = quality_rules.train(frame(spark, docs), labels)
    many = [*docs, *texts, "A B! " * 200_000, docs[0], docs[0], None]
    want = []
    for t in many:
        s = plain_statistics(t)
        fires = [r.weight for r in model.rules if all((s[n.removeprefix("s_")] > b) == greater for n, greater, b in r.terms)]
        want.append(1 / (1 + np.exp(-(model.bias + sum(fires)))))
    rows = quality_rules.score(frame(spark, many), model).orderBy("doc_id").collect()
    assert np.allclose([r["score"] for r in rows], want) and [r["predicted"] for r in rows] == [int(x >= 0.3) for x in want]
    assert quality_rules.score(frame(spark, []), model).count() == 0


def test_toxic_spans_are_found(spark):
    rng = random.Random(6)
    docs = [words(rng, 50) if i % 4 else f"{words(rng, 20)} you {rng.choice(['vile', 'nasty'])} Scum, {words(rng, 20)}" for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id long, toxic int")
    model = toxic_spans.train(frame(spark, docs), labels)
    rows = toxic_spans.tag(frame(spark, [*docs, None, ""]), model).orderBy("doc_id").collect()
    assert all(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in rows if 300 <= r["doc_id"] < 400)
    assert any("Scum" in docs[300][s["start"] : s["end"]] for s in rows[300]["spans"]) and not rows[301]["spans"]


def test_toxic_words_with_combining_marks_are_one_word(spark):
    rng = random.Random(12)
    vile = "\u0939\u093f\u0928\u094d\u0926\u0940"  # six code points, three of them marks
    docs = [words(rng, 40) if i % 4 else f"{words(rng, 20)} {vile} {words(rng, 20)}" for i in range(200)]
    long = words(rng, 30_000) + f" {vile}"
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(200, 1)], "doc_id long, toxic int")
    model = toxic_spans.train(frame(spark, [*docs, long]), labels)  # windows of a long text take part too
    assert vile in model.lexicon
    rows = toxic_spans.tag(frame(spark, [*docs, long, docs[0]], [*range(201), 0]), model).orderBy("doc_id").collect()
    assert rows[0] == rows[1]
    for r, d in zip(rows[1:], [*docs, long], strict=True):
        assert [d[s["start"] : s["end"]] for s in r["spans"]] == [vile] * (vile in d)
    assert toxic_spans.tag(frame(spark, []), model).count() == 0
    assert toxic_spans.train(frame(spark, []), labels).lexicon == {}


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    lengths = np.array([3, 0, 5, 1])
    lay = toxic_spans.Ragged(lengths)
    odds, move, start = np.empty(9), np.exp(rng.normal(size=(2, 2))), 0.7
    own = np.exp(rng.normal(size=9))
    odds[lay.place] = own
    ahead, back, _ = toxic_spans.forward_backward(odds, lay, move, start)
    both = (ahead * back)[lay.place]
    at = 0
    for n in lengths:
        total, marginal = 0.0, np.zeros(n)
        for code in range(2**n):
            y = [(code >> i) & 1 for i in range(n)]
            w = np.prod([own[at + i] if y[i] else 1 for i in range(n)]) * (start if n and y[0] else 1) * np.prod([move[a, b] for a, b in zip(y, y[1:], strict=False)])
            total += w
            marginal += w * np.array(y)
        assert np.allclose(both[at : at + n] / (1 + both[at : at + n]), marginal / total if n else [])
        at += n


def neighbours(df, **kw):
    got = collections.defaultdict(list)
    for r in vp_search.nearest(df, df.where("vec_id % 100 = 0"), "vec_id", "embedding", **kw).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["id"], r["score"]))
    return got


@pytest.mark.parametrize("batch", [1, 3, 7, 40])
@pytest.mark.parametrize("norm", [1.0, 10.0])
def test_search_finds_equal_vectors_in_other_leaves(batch, norm):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(4000, 64)).astype(np.float32)
    v = (norm * v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32).astype(np.float64)
    at = rng.permutation(4000)[:3000].reshape(3, 1000)
    v[at] = v[at[:, :1]]  # 3 vectors, each 1,000 times, so in several leaves
    pick = np.arange(batch) % 3
    ids, asked = np.arange(4000), v[at[pick, 0]]
    run = vp_search.Search(ids, v, np.full(batch, -1), asked, np.full(batch, np.inf), 10, 1.0)
    run.run(vp_search.build_tree(v), np.arange(batch))
    for found, best, group in zip(run.found, run.best, at[pick], strict=True):
        assert list(found) == sorted(group)[:10] and not best.any()


def test_nearest_finds_equal_vectors_in_all_shards(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(3000, 64))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32).astype(np.float64)
    for g in range(0, 3000, 100):
        v[g : g + 48] = v[g]  # a query and 47 copies, 12 or so in each shard
    df = spark.createDataFrame([(i, [float(c) for c in x]) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(4)
    got = neighbours(df)
    for q in range(0, 3000, 100):
        gaps = vp_search.exact_distances(np.broadcast_to(v[q], v.shape), v)
        assert [i for i, _ in got[q]] == [i for i in np.lexsort((np.arange(3000), gaps)) if i != q][:10]


def test_nearest_takes_repeated_rows_as_rows(spark):
    rng = np.random.default_rng(8)
    v = [(i, [float(c) for c in x]) for i, x in enumerate(rng.normal(size=(301, 4)))]
    near = (7, [c + 1e-3 for c in v[0][1]])  # the nearest to row 0, and repeated
    rows = [*v[:7], *[near] * 12, *v[8:], v[200], v[200], (300, [0.5, 0.5, 0.5, 0.5])]
    got = neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3))
    for q in (0, 100, 200, 300):
        want = sorted((float(vp_search.exact_distances(np.array([a]), np.array([b]))[0]), j) for i, a in rows if i == q for j, b in rows if j != q)[:10]
        assert got[q] == [(j, s) for s, j in want]
    assert {i for i, _ in got[0]} == {7}


@pytest.mark.parametrize(("factor", "least"), [(1.0, 1.0), (0.6, 0.9)])
def test_nearest_over_cells_and_shards(spark, monkeypatch, factor, least):
    for name, value in {"LEAST_ROWS": 50, "SHARD_ROWS": 100, "CELLS": 7, "QUERY_BLOCK": 9, "LEAF": 8}.items():
        monkeypatch.setattr(vp_search, name, value)
    rng = np.random.default_rng(9)
    v = np.concatenate([rng.normal(size=(1400, 8)) + 3 * rng.normal(size=(7, 8))[np.arange(1400) % 7], np.ones((600, 8))])  # and one vector 600 times
    df = spark.createDataFrame([(i, [float(c) for c in x]) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(4)
    got, hits, asked = neighbours(df, factor=factor), 0, range(0, 2000, 100)
    for q in asked:
        gaps = vp_search.exact_distances(np.broadcast_to(v[q], v.shape), v)
        want = [i for i in np.lexsort((np.arange(2000), gaps)) if i != q][:10]
        hits += len(set(want) & {i for i, _ in got[q]})
        assert factor < 1 or [i for i, _ in got[q]] == want
    assert hits >= least * 10 * len(asked)


def test_nearest_takes_the_most_frequent_length_of_all_rows(spark, monkeypatch):
    rows = [(i, [1.0, float(i)] if i % 5 < 3 else [1.0, 2.0, float(i)]) for i in range(100)]
    monkeypatch.setattr(vp_search, "SEED_ROWS", 1)
    for turn in range(5):  # whatever row the sample holds
        df = spark.createDataFrame([(1 + (i + turn) * 10**turn, x) for i, x in rows], "vec_id long, embedding array<double>")
        got = vp_search.nearest(df, df, "vec_id", "embedding", k=3)
        assert got.select("query_id").distinct().count() == 60
