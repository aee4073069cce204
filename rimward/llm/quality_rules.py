"""Quality classifier: a sparse ensemble of rules over text statistics, scored as Spark column expressions.

Shallow boosted trees are grown over statistics of labelled texts; each path from a root to a node is a
conjunctive rule. Lasso logistic regression weighs the rules, most of them with zero, and what is left becomes one
Column expression: a sum of CASE expressions inside a logistic function. So all documents are scored by
Spark's own expressions.

The fit takes at most ``MAX_TRAIN`` labelled rows, those with the smallest hash of their id; what it
learns from is bounded, what it scores is not.

Edge cases. Null and empty texts have the statistics of an empty text and get a score. Labels that are null
take no part. Without labels of both kinds every score is the share of ones (0.5 without labels). Null ids
and repeated rows are kept. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rimward.llm.common import text_or_empty

MAX_TRAIN = 20_000
TREES, DEPTH, BINS, MIN_ROWS, SHRINK = 40, 3, 32, 20, 0.3
LASSO, STEPS = 0.002, 400


def statistics(df: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and a column per statistic of ``text``."""
    text = text_or_empty("text")
    rows = df.select(*keep, text.alias("t"))
    words = F.filter(F.split("t", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.split("t", "\n")
    count = lambda pattern: F.regexp_count("t", F.lit(pattern)).cast("double")
    rows = rows.withColumns({"words": words, "lines": lines, "chars": F.char_length("t").cast("double")})
    rows = rows.withColumns(
        {
            "n_words": F.size("words").cast("double"), "n_lines": F.size("lines").cast("double"),
            "distinct_words": F.size(F.array_distinct("words")).cast("double"), "distinct_lines": F.size(F.array_distinct("lines")).cast("double"),
            "upper": count("[A-Z]{2,}"), "marks": count(r"[#$%&*|]"), "bangs": count("!"), "digits": count("[0-9]+"),
            "stops": count("[.?]"), "commas": count("[,;:]"), "links": count("https?:|www[.]|@"), "odd": count(r"[<>{}\[\]=_~^\\/]"),
        }
    )
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1.0))
    named = {
        "log_chars": F.log1p("chars"), "log_words": F.log1p("n_words"), "word_length": per("chars", "n_words"), "words_per_line": per("n_words", "n_lines"),
        "distinct_words": per("distinct_words", "n_words"), "distinct_lines": per("distinct_lines", "n_lines"),
        **{f"{c}_per_word": per(c, "n_words") for c in ("upper", "marks", "bangs", "digits", "stops", "commas", "links", "odd")},
    }
    return rows.select(*keep, *[v.alias(f"s_{k}") for k, v in named.items()])


@dataclass(frozen=True)
class Rule:
    """All of (statistic, is_greater, threshold), with a weight."""

    terms: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def column(self) -> Column:
        out = F.lit(True)
        for name, greater, threshold in self.terms:
            out = out & ((F.col(name) > threshold) if greater else (F.col(name) <= threshold))
        return F.when(out, F.lit(self.weight)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class RuleModel:
    bias: float
    rules: tuple[Rule, ...]

    def score(self) -> Column:
        total = F.lit(self.bias)
        for rule in self.rules:
            total = total + rule.column()
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _grow(x: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray, rows: np.ndarray, depth: int, path: tuple, paths: list) -> list[tuple[np.ndarray, float]]:
    """Leaves (rows, value) of one regression tree on binned statistics; every node's path is added to ``paths``."""
    if path:
        paths.append(path)
    best = (1e-9, None, None)
    if depth:
        g, h = gradient[rows], hessian[rows]
        whole = g.sum() ** 2 / (h.sum() + 1.0)
        for j, cut in enumerate(cuts):
            if len(cut):
                n = np.bincount(x[rows, j], minlength=len(cut) + 1).cumsum()[:-1]
                gl, hl = (np.bincount(x[rows, j], weights=w, minlength=len(cut) + 1).cumsum()[:-1] for w in (g, h))
                gain = gl**2 / (hl + 1.0) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1.0) - whole
                gain[(n < MIN_ROWS) | (len(rows) - n < MIN_ROWS)] = 0
                if gain.max() > best[0]:
                    best = (gain.max(), j, int(gain.argmax()))
    if best[1] is None:
        return [(rows, -gradient[rows].sum() / (hessian[rows].sum() + 1.0))]
    _, j, b = best
    left = x[rows, j] <= b
    down = lambda side, greater: _grow(x, cuts, gradient, hessian, rows[side], depth - 1, (*path, (j, greater, b)), paths)
    return down(left, False) + down(~left, True)


def _simplified(path: tuple) -> tuple:
    """The path with one bound per statistic and side: the tightest."""
    tight: dict[tuple[int, bool], int] = {}
    for j, greater, b in path:
        tight[j, greater] = (max if greater else min)(tight.get((j, greater), b), b)
    return tuple(sorted((j, g, b) for (j, g), b in tight.items()))


def fit_rules(values: np.ndarray, label: np.ndarray, names: list[str]) -> RuleModel:
    """Grow trees, take their paths as rules, weigh the rules by lasso logistic regression (accelerated proximal gradient)."""
    share = float(label.mean()) if len(label) else 0.5
    if len(np.unique(label)) < 2:
        share = min(max(share, 1e-6), 1 - 1e-6)
        return RuleModel(math.log(share / (1 - share)), ())
    cuts = [np.unique(np.quantile(values[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(values.shape[1])]
    x = np.stack([np.searchsorted(cut, values[:, j], side="left") for j, cut in enumerate(cuts)], axis=1)
    margin = np.full(len(label), math.log(share / (1 - share)))
    paths: list[tuple] = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        for rows, value in _grow(x, cuts, p - label, p * (1 - p), np.arange(len(label)), DEPTH, (), paths):
            margin[rows] += SHRINK * value
    unique = sorted(set(map(_simplified, paths)))
    fires = np.stack([np.logical_and.reduce([(x[:, j] > b) if g else (x[:, j] <= b) for j, g, b in path]) for path in unique], axis=1).astype(float)
    weights, bias = _lasso_logistic(fires, label)
    rules = tuple(Rule(tuple((names[j], g, float(cuts[j][b])) for j, g, b in path), float(w)) for path, w in zip(unique, weights, strict=True) if w)
    return RuleModel(bias, rules)


def _lasso_logistic(fires: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, float]:
    n = len(label)
    a = np.hstack([fires, np.ones((n, 1))])
    step = 4.0 / (np.linalg.norm(a, 2) ** 2 / n)
    w = np.zeros(a.shape[1])
    w[-1] = math.log(label.mean() / (1 - label.mean()))
    ahead, t = w.copy(), 1.0
    for _ in range(STEPS):
        moved = ahead - step * (a.T @ (1 / (1 + np.exp(-(a @ ahead))) - label)) / n
        moved[:-1] = np.sign(moved[:-1]) * np.maximum(np.abs(moved[:-1]) - step * LASSO, 0)
        t, last = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        ahead, w = moved + (last - 1) / t * (moved - w), moved
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = MAX_TRAIN) -> RuleModel:
    """Fit on labelled documents (doc_id, text) and labels (doc_id, ``label_col``), ``max_rows`` at most."""
    known = labels.select("doc_id", F.col(label_col).cast("double").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    picked = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_rows))
    rows = statistics(docs.select("doc_id", "text").join(picked, "doc_id"), "doc_id", "label").orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(2 * max_rows).toPandas()
    names = [c for c in rows.columns if c.startswith("s_")]
    return fit_rules(rows[names].to_numpy(dtype=float), rows["label"].to_numpy(dtype=float), names)


def score(docs: DataFrame, model: RuleModel, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) per row of ``docs``."""
    out = statistics(docs, "doc_id").select("doc_id", model.score().alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep(docs: DataFrame, model: RuleModel, threshold: float, *columns: str) -> DataFrame:
    """``columns`` of the rows whose score reaches ``threshold``."""
    passed = F.when(model.score() >= threshold, F.array(F.lit(True)))
    # explode_outer keeps Catalyst from pushing the whole score, with each statistic repeated in every rule, below the statistics
    return statistics(docs, *columns).select(*columns, F.explode_outer(passed).alias("passed")).where("passed").select(*columns)
