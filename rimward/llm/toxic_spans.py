"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Spark counts words over labelled documents (equal texts once) and keeps as lexicon the words that are
significantly more frequent in toxic ones. Tokens of the lexicon in toxic documents are the labelled toxic tokens.
The field has two states; its emissions are linear in the lexicon weights of a token and its neighbours. It's
fitted by gradient ascent with exact forward-backward expectations. A document's score is a logistic
function of the marginals' sum, maximum and density; spans are runs of tokens that are more likely toxic than not.

Words are runs of letters, marks, digits and underscores, lower-cased, in the lexicon and in the field alike.

Bounds of the fit: ``MAX_TRAIN`` labelled rows (smallest hash of the id), ``LEXICON`` words, and, for the field's weights,
``FIELD_WINDOWS`` of the windows of ``FIELD_TOKENS`` words that the rows' whole texts are cut into (smallest hash). All documents are scored, whole.

Edge cases. Null and empty texts have no tokens and get a score. Null labels take no part. Without labels of
both kinds the score is the share of ones (0.5 without labels). Null ids and repeated rows are kept. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rimward.llm.common import materialize, slices

MAX_TRAIN, LEXICON, FIELD_WINDOWS, FIELD_TOKENS = 20_000, 5_000, 2_000, 1_000
MIN_DOCS, MIN_Z = 5, 4.0
LETTERS = r"\p{L}\p{M}\p{N}_"
WORD = regex.compile(f"[{LETTERS}]+")
ROUNDS, RATE = 150, 0.1


class Ragged:
    """Token positions of several sequences, laid out step by step: the longest sequences first, so that a step is a slice."""

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        ranked = lengths[self.order]
        self.steps = int(ranked[0]) if len(ranked) else 0
        self.active = np.searchsorted(-ranked, -np.arange(self.steps), side="left")  # sequences longer than the step
        self.offsets = np.concatenate([[0], np.cumsum(self.active)])
        rank = np.empty(len(lengths), dtype=np.int64)
        rank[self.order] = np.arange(len(lengths))
        self.doc = np.repeat(np.arange(len(lengths)), lengths)
        pos = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.place = self.offsets[pos] + rank[self.doc] if len(pos) else pos
        self.first = pos == 0


def forward_backward(odds: np.ndarray, lay: Ragged, move: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ratios (toxic to clean) of forward and backward sums per token, and log Z per sequence.

    ``odds`` are exponentiated emissions in layout order, ``move`` the 2 x 2 exponentiated transitions.
    """
    (c, d), (e, f) = move
    ahead, back = np.empty_like(odds), np.ones_like(odds)
    log_z = np.zeros(int(lay.active[0]) if lay.steps else 0)
    for t in range(lay.steps):
        at, n = lay.offsets[t], lay.active[t]
        if t == 0:
            ahead[:n] = odds[:n] * start
        else:
            before = ahead[lay.offsets[t - 1] : lay.offsets[t - 1] + n]
            base = c + before * e
            ahead[at : at + n] = odds[at : at + n] * (d + before * f) / base
            log_z[:n] += np.log(base)
        done = lay.active[t + 1] if t + 1 < lay.steps else 0
        log_z[done:n] += np.log1p(ahead[at + done : at + n])
    for t in range(lay.steps - 2, -1, -1):
        at, n = lay.offsets[t + 1], lay.active[t + 1]
        after = odds[at : at + n] * back[at : at + n]
        back[lay.offsets[t] : lay.offsets[t] + n] = (e + f * after) / (c + d * after)
    return ahead, back, log_z


@dataclass(frozen=True)
class Field:
    """Emission weights (bias, own, previous, next lexicon weight), transitions from clean to toxic and toxic to toxic, start."""

    weights: tuple[float, ...]
    move: tuple[float, float]
    start: float

    @property
    def moves(self) -> np.ndarray:
        return np.exp(np.array([[0.0, self.move[0]], [0.0, self.move[1]]]))

    def marginals(self, lexical: np.ndarray, lay: Ragged) -> np.ndarray:
        """P(toxic) of each token, in the order of documents."""
        odds = np.empty(len(lexical))
        odds[lay.place] = np.exp(np.clip(features(lexical, lay) @ np.array(self.weights), -30, 30))
        ahead, back, _ = forward_backward(odds, lay, self.moves, math.exp(self.start))
        both = (ahead * back)[lay.place]
        return both / (1.0 + both)


def features(lexical: np.ndarray, lay: Ragged) -> np.ndarray:
    before, after = np.zeros_like(lexical), np.zeros_like(lexical)
    before[1:], after[:-1] = lexical[:-1], lexical[1:]
    before[lay.first] = 0
    after[:-1][lay.first[1:]] = 0
    return np.stack([np.ones_like(lexical), lexical, before, after], axis=1)


def fit_field(lexical: np.ndarray, toxic: np.ndarray, lay: Ragged) -> Field:
    """Ascend the mean log likelihood per document of the tokens' labels, with a small ridge."""
    if not len(lexical):
        return Field((-5.0, 1.0, 0.0, 0.0), (0.0, 0.0), 0.0)
    x, y = features(lexical, lay), toxic.astype(float)
    prior = np.concatenate([[0.0], y[:-1]]) * ~lay.first
    n_docs = max(1, int(lay.first.sum()))
    inner = ~lay.first
    seen = np.concatenate([x.T @ y, [((1 - prior) * y)[inner].sum(), (prior * y)[inner].sum(), y[lay.first].sum()]])
    theta = np.concatenate([[-5.0, 1.0, 0.0, 0.0], [0.0, 0.0, 0.0]])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    last = np.empty(len(lexical), dtype=np.int64)  # where the token before lies in the layout
    last[1:], last[0] = lay.place[:-1], 0
    for i in range(1, ROUNDS + 1):
        odds = np.empty(len(x))
        odds[lay.place] = np.exp(np.clip(x @ theta[:4], -30, 30))
        move = np.exp(np.array([[0.0, theta[4]], [0.0, theta[5]]]))
        ahead, back, _ = forward_backward(odds, lay, move, math.exp(theta[6]))
        both = (ahead * back)[lay.place]
        p = both / (1 + both)
        r, ob = ahead[last], (odds * back)[lay.place]
        total = 1.0 + move[0, 1] * ob + r * (1.0 + move[1, 1] * ob)
        enter, stay = move[0, 1] * ob / total, r * move[1, 1] * ob / total
        expected = np.concatenate([x.T @ p, [enter[inner].sum(), stay[inner].sum(), p[lay.first].sum()]])
        gradient = (seen - expected) / n_docs - 1e-3 * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        theta += RATE * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    return Field(tuple(theta[:4].tolist()), (float(theta[4]), float(theta[5])), float(theta[6]))


@dataclass(frozen=True)
class ToxicModel:
    lexicon: dict[str, float]
    field: Field
    weights: tuple[float, ...]  # of the document score: bias, log of 1 + sum, maximum, density

    def lexical(self, texts: list[str]) -> tuple[np.ndarray, Ragged]:
        get = self.lexicon.get
        each = [[get(w, 0.0) for w in map(str.lower, WORD.findall(t))] for t in texts]
        lengths = np.array([len(e) for e in each], dtype=np.int64)
        return np.concatenate([np.array(e, dtype=float) for e in each]) if each else np.zeros(0), Ragged(lengths)

    def documents(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, Ragged]:
        """Statistics of each document (1, log of 1 + sum, maximum, density) and the tokens' marginals."""
        values, lay = self.lexical(texts)
        p = self.field.marginals(values, lay)
        total, most = np.bincount(lay.doc, weights=p, minlength=len(texts)), np.zeros(len(texts))
        np.maximum.at(most, lay.doc, p)
        count = np.bincount(lay.doc, minlength=len(texts))
        return np.stack([np.ones(len(texts)), np.log1p(total), most, total / np.maximum(count, 1)], axis=1), p, lay


def _lexicon(rows: DataFrame) -> tuple[dict[str, float], int, int]:
    once = rows.dropDuplicates(["text"])
    sides = {r["toxic"]: r["n"] for r in once.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sides.get(1, 0), sides.get(0, 0)
    words = once.select("toxic", F.explode(F.array_distinct(F.split(F.lower("text"), f"[^{LETTERS}]+"))).alias("word")).where("word <> ''")
    counts = words.groupBy("word").agg(F.sum("toxic").alias("k1"), F.sum(1 - F.col("toxic")).alias("k0")).where(F.col("k1") >= MIN_DOCS)
    odds = F.log((F.col("k1") + 0.5) / (n1 + 1.0)) - F.log((F.col("k0") + 0.5) / (n0 + 1.0))
    z = odds / F.sqrt(1.0 / (F.col("k1") + 0.5) + 1.0 / (F.col("k0") + 0.5))
    top = counts.select("word", odds.alias("odds"), z.alias("z")).where(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "word").limit(LEXICON)
    return {r["word"]: r["odds"] for r in top.collect()}, n1, n0


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = 1e-2 * np.diag([0.0] + [1.0] * (len(w) - 1))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)), x.T @ (y - p) - ridge @ w)
    return w


def _field(rows: DataFrame, lexicon: dict[str, float]) -> Field:
    """Fitted on a bounded number of windows of the rows (doc_id, text, toxic): their words' weights, and the words of the lexicon in toxic texts as labels."""
    sent = rows.sparkSession.sparkContext.broadcast(lexicon)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ToxicModel(sent.value, Field((-5.0, 1.0, 0.0, 0.0), (0.0, 0.0), 0.0), (0.0, 0.0, 0.0, 0.0))
        for batch in slices(batches):
            keys, starts, toxic, weights = [], [], [], []
            for key, text, kind in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                values, _ = model.lexical([text])
                for at in range(0, len(values), FIELD_TOKENS):
                    keys.append(key)
                    starts.append(at)
                    toxic.append(kind)
                    weights.append(values[at : at + FIELD_TOKENS].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(toxic, pa.int32()), pa.array(weights, pa.binary())], names=["key", "start", "toxic", "weights"])

    windows = rows.select(F.xxhash64("doc_id").alias("key"), "text", "toxic").mapInArrow(cut, "key long, start long, toxic int, weights binary")
    few = windows.orderBy(F.xxhash64("key", "start"), "key", "start", "toxic", "weights").limit(FIELD_WINDOWS).select("toxic", "weights").toPandas()
    each = [np.frombuffer(w, np.float32).astype(float) for w in few["weights"]]
    lay = Ragged(np.array([len(w) for w in each], dtype=np.int64))
    values = np.concatenate(each) if each else np.zeros(0)
    return fit_field(values, (values > 0) & (few["toxic"].to_numpy()[lay.doc] == 1), lay)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", max_rows: int = MAX_TRAIN) -> ToxicModel:
    """Fit on labelled documents (doc_id, text) and labels (doc_id, ``label_col``), ``max_rows`` at most."""
    known = labels.select("doc_id", F.col(label_col).cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(max_rows)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    rows = materialize(rows, "toxic-rows")  # read by each of the steps below
    lexicon, n1, n0 = _lexicon(rows)
    if not n1 or not n0:
        share = min(max(n1 / (n1 + n0) if n1 + n0 else 0.5, 1e-6), 1 - 1e-6)
        return ToxicModel({}, Field((-5.0, 1.0, 0.0, 0.0), (0.0, 0.0), 0.0), (math.log(share / (1 - share)), 0.0, 0.0, 0.0))
    field = _field(rows, lexicon)
    model = ToxicModel(lexicon, field, (0.0, 0.0, 0.0, 0.0))
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, _, _ = sent.value.documents(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x[:, j]) for j in (1, 2, 3))], names=["toxic", "total", "most", "density"])

    got = rows.select("toxic", "text").mapInArrow(measure, "toxic int, total double, most double, density double").toPandas()
    x = np.hstack([np.ones((len(got), 1)), got[["total", "most", "density"]].to_numpy()])
    return ToxicModel(lexicon, field, tuple(_logistic(x, got["toxic"].to_numpy(dtype=float)).tolist()))


def tag(docs: DataFrame, model: ToxicModel, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted, spans array<struct<start, end, p>>) per row of ``docs``; spans in code points, end exclusive."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                x, p, lay = model.documents(texts)
                score = 1 / (1 + np.exp(-np.clip(x @ np.array(model.weights), -30, 30)))
                spans: list[list[dict]] = [[] for _ in texts]
                for doc in np.unique(lay.doc[p >= 0.5]):
                    low, high = np.searchsorted(lay.doc, [doc, doc + 1])
                    spans[doc] = _spans(texts[doc], p[low:high])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(spans, span)], names=["doc_id", "score", "predicted", "spans"])

    schema = f"doc_id {kind}, score double, predicted int, spans array<struct<start: long, end: long, p: double>>"
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)


def _spans(text: str, p: np.ndarray) -> list[dict]:
    """Runs of neighbouring tokens with p >= 1/2, with the largest p of each."""
    out: list[dict] = []
    for i, m in enumerate(WORD.finditer(text)):
        if p[i] >= 0.5:
            if i and p[i - 1] >= 0.5:
                out[-1]["end"], out[-1]["p"] = m.end(), max(out[-1]["p"], float(p[i]))
            else:
                out.append({"start": m.start(), "end": m.end(), "p": float(p[i])})
    return out
