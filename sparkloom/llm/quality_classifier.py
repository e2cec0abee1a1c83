"""Operator 7: sparse rule ensemble over text statistics, compiled into Spark columns."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._common import WORD, words
from sparkloom.llm.quality_rules import COMMON_WORDS, let, repeat_words

FEATURES = (
    "log_words", "mean_word", "upper", "digit", "other", "mark", "symbol", "bang", "space", "dup_lines",
    "repeats", "distinct", "common", "line_words", "bars",
)


def statistics(
    docs: DataFrame, *, text_col: str = "text", keep: tuple[str, ...] = (), prefix: str = "f_"
) -> DataFrame:
    """``keep`` columns and the feature columns, named with ``prefix``: shares and means over the whole text.

    Null is an empty text; an empty text has 0 in every feature, so it is scored like any other.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = docs.select(*[F.col(c).alias(f"k_{c}") for c in keep], text.alias("t")).withColumn("w", words(F.col("t")))
    t, w = F.col("t"), F.col("w")
    chars = F.greatest(F.length(t), F.lit(1)).cast("double")
    n = F.greatest(F.size(w), F.lit(1)).cast("double")
    per = lambda p: F.regexp_count(t, F.lit(p)) / chars
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    line = let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
    src = src.withColumn("line", line)
    n_lines = F.greatest(F.col("line.n"), F.lit(1)).cast("double")
    known = sorted({x for v in COMMON_WORDS.values() for x in v})
    low = F.transform(w, lambda x: F.lower(x))
    made = {
        "log_words": F.log1p(F.size(w).cast("double")),
        "mean_word": F.length(F.array_join(w, "")) / n,
        "upper": per("[A-Z]"),
        "digit": per("[0-9]"),
        "other": per(r"[^\x00-\x7F]"),
        "mark": per(r"[.,;:?'\"()-]"),
        "symbol": per("[#*$%&|<>]"),
        "bang": per("!"),
        "space": (F.length(t) - F.length(F.array_join(w, ""))) / chars,
        "dup_lines": (F.col("line.n") - F.col("line.d")) / n_lines,
        "repeats": repeat_words(w) / n,
        "distinct": F.size(F.array_distinct(w)) / n,
        "common": F.size(F.filter(low, lambda x: x.isin(known))) / n,
        "line_words": F.log1p(F.size(w) / n_lines),
        "bars": F.size(F.filter(w, lambda x: x == "|")) / n,
    }
    return src.select(*[F.col(f"k_{c}").alias(c) for c in keep], *[made[f].cast("double").alias(prefix + f) for f in FEATURES])


@dataclass(frozen=True)
class RuleModel:
    """score = sigmoid(bias + sum of the weights of the rules that hold). A rule is a conjunction
    of (feature, over?, threshold): value > threshold, or value <= threshold."""

    bias: float
    rules: tuple[tuple[float, tuple[tuple[int, bool, float], ...]], ...]
    names: tuple[str, ...] = FEATURES

    def column(self, prefix: str = "f_") -> Column:
        def holds(conditions) -> Column:
            tests = [F.col(prefix + self.names[f]) > F.lit(v) if over else F.col(prefix + self.names[f]) <= F.lit(v) for f, over, v in conditions]
            return reduce(lambda a, b: a & b, tests)

        total = F.lit(self.bias)
        for weight, conditions in self.rules:
            total = total + F.when(holds(conditions), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for weight, conditions in self.rules:
            z += weight * _holds(x, conditions)
        return 1 / (1 + np.exp(-z))


def _holds(x: np.ndarray, conditions) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, over, v in conditions:
        out &= (x[:, f] > v) if over else (x[:, f] <= v)
    return out


def _tree(x: np.ndarray, bins: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int, least: int):
    """Second-order regression tree by histograms; yields the paths of all nodes and leaf values."""
    g, h = grad[rows].sum(), hess[rows].sum()
    leaf = -g / (h + 1.0)
    best = (1e-6, None, None)
    if depth and len(rows) >= 2 * least:
        for f, cut in enumerate(cuts):
            if not len(cut):
                continue
            b = bins[rows, f]
            m = len(cut) + 1
            gs = np.cumsum(np.bincount(b, grad[rows], m))[:-1]
            hs = np.cumsum(np.bincount(b, hess[rows], m))[:-1]
            ns = np.cumsum(np.bincount(b, minlength=m))[:-1]
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
            gain[(ns < least) | (len(rows) - ns < least)] = 0
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], f, k)
    if best[1] is None:
        return [((), rows, leaf, True)]
    _, f, k = best
    out = [((), rows, leaf, False)]
    for over in (False, True):
        part = rows[(bins[rows, f] > k) == over]
        for path, r, v, end in _tree(x, bins, cuts, grad, hess, part, depth - 1, least):
            out.append((((f, over, float(cuts[f][k])), *path), r, v, end))
    return out


def _simple(path) -> tuple:
    """One bound for each side of each feature."""
    held: dict[tuple[int, bool], float] = {}
    for f, over, v in path:
        old = held.get((f, over))
        held[f, over] = v if old is None else (max(old, v) if over else min(old, v))
    return tuple((f, over, v) for (f, over), v in sorted(held.items()))


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float, bias: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights and bias of least mean logistic loss plus ``penalty`` times the sum of absolute weights."""
    scale = 4.0 / max(1e-9, (np.linalg.norm(a, 2) ** 2 + len(y)) / len(y))
    w, b, w0, b0, k = np.zeros(a.shape[1]), bias, np.zeros(a.shape[1]), bias, 1.0
    for _ in range(steps):
        k1 = (1 + np.sqrt(1 + 4 * k * k)) / 2
        ww, bb = w + (k - 1) / k1 * (w - w0), b + (k - 1) / k1 * (b - b0)
        r = 1 / (1 + np.exp(-(a @ ww + bb))) - y
        w0, b0, k = w, b, k1
        step = ww - scale * (a.T @ r) / len(y)
        w = np.sign(step) * np.maximum(np.abs(step) - scale * penalty, 0)
        b = bb - scale * r.mean()
    return w, b


def fit_rules(
    x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 3, rate: float = 0.2, penalties=(0.0005, 0.001, 0.002, 0.004, 0.008),
    steps: int = 400, seed: int = 0,
) -> RuleModel:
    """Boosted trees give rules; a lasso logistic fit over them (accelerated proximal gradient)
    keeps few. The penalty with the best held-in validation loss (every fifth row) wins. With one
    class, or no rows, the model is a constant."""
    rate_1 = (y.sum() + 1) / (len(y) + 2)
    constant = RuleModel(float(np.log(rate_1 / (1 - rate_1))), ())
    if len(y) < 10 or y.min() == y.max():
        return constant
    cuts = []
    for f in range(x.shape[1]):
        q = np.unique(np.quantile(x[:, f], np.linspace(0, 1, 65)[1:-1]))
        cuts.append(q[q < x[:, f].max()])
    bins = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    rng, z, found = np.random.default_rng(seed), np.full(len(y), constant.bias), {}
    least = max(3, len(y) // 500)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        rows = np.flatnonzero(rng.random(len(y)) < 0.5) if len(y) > 200 else np.arange(len(y))
        for path, r, v, end in _tree(x, bins, cuts, p - y, p * (1 - p) + 1e-9, rows, depth, least):
            if path:
                found[_simple(path)] = None
            if end:
                z += rate * v * _holds(x, path) if path else rate * v
    rules = list(found)
    if not rules:
        return constant
    a = np.stack([_holds(x, r) for r in rules], axis=1).astype(np.float64)
    fold = np.arange(len(y)) % 5 == 4
    best = (np.inf, None, None)

    for penalty in penalties:
        w, b = lasso_logistic(a[~fold], y[~fold], penalty, constant.bias, steps)
        z = np.clip(a[fold] @ w + b, -30, 30)
        loss = float(np.mean(np.log1p(np.exp(-z)) * y[fold] + np.log1p(np.exp(z)) * (1 - y[fold])))
        if loss < best[0]:
            best = (loss, penalty, None)
    w, b = lasso_logistic(a, y, best[1], constant.bias, steps)
    return RuleModel(float(b), tuple((float(v), r) for v, r in zip(w, rules) if abs(v) > 1e-6))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    sample: int = 8000,
) -> RuleModel:
    """Fits on at most ``sample`` labelled rows, the first in a hash order of their ids, never on
    held-out ids. Only these rows' statistics reach the driver. Rows without id, or with a label
    other than 0 and 1, take no part; of repeated labels of an id one is used, the largest."""
    y = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    y = y.filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    order = F.xxhash64("doc_id", F.lit(7))
    y = y.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(order, "doc_id").limit(sample)
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # At most ``sample`` rows of two numbers: bounded by the parameter.
    rows = statistics(picked.join(F.broadcast(y), "doc_id"), keep=("doc_id", "y"))
    names = [f"f_{f}" for f in FEATURES]
    # Of rows of one id the one of least statistics, so that ids bound what reaches the driver.
    one = rows.groupBy("doc_id", "y").agg(F.min(F.struct(*names)).alias("s")).select("doc_id", "y", "s.*")
    got = one.toPandas().sort_values("doc_id")
    return fit_rules(got[[f"f_{f}" for f in FEATURES]].to_numpy(np.float64), got["y"].to_numpy(np.float64))


def score(
    docs: DataFrame, model: RuleModel, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7
) -> DataFrame:
    """doc_id, held_out, score, predicted for every row: column expressions alone, no shuffle."""
    pick = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    seen = statistics(pick, keep=("doc_id",)).select("doc_id", model.column().alias("score"))
    return seen.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: RuleModel, *, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is at least ``threshold``; no shuffle."""
    seen = statistics(docs, text_col=text_col, keep=tuple(docs.columns), prefix="score of ")
    # A filter on the score itself would be pushed below the statistics, and each rule would
    # compute its own; generated rows stop it, so that every statistic is computed once a row.
    scored = seen.select(*docs.columns, F.explode(F.array(model.column("score of "))).alias("score of text"))
    return scored.filter(F.col("score of text") >= threshold).select(*docs.columns)
