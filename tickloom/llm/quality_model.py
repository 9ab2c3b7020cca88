"""Quality classifier: a sparse ensemble of rules over text statistics.

Small trees are boosted on a bounded sample of labelled rows; each path from a
root becomes a conjunctive rule; lasso logistic regression keeps few of them;
the kept rules are compiled into one Spark column expression over the
statistics, so that scoring is a single pass over the texts.

``sample_rows`` bounds the labelled rows used for fitting (the first ones by a
hash of their id); every document is scored. Nulls are scored as empty texts.
Labels that are null, or of null ids, are not used. With labels of one class or
none the score is their smoothed share (0.5 without labels). Repeated rows are
scored each; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.quality_rules import measured
from tickloom.llm.tables import narrowed

SAMPLE_ROWS = 16_000
#: Statistics: name and SQL expression over the measurements.
STATISTICS: dict[str, str] = {
    "log_words": "ln(1D + n_words)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(n_words, 1)",
    "marks": "n_marks / greatest(n_words, 1)",
    "marked": "n_marked_words / greatest(n_words, 1)",
    "upper": "n_upper / greatest(word_chars, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "distinct": "n_distinct_words / greatest(n_words, 1)",
    "same_next": "n_same_next / greatest(n_words, 1)",
    "long_words": "n_long_words / greatest(n_words, 1)",
    "short_words": "n_short_words / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
}

Condition = tuple[int, bool, float]  # statistic, whether it must be above the threshold, threshold


def held_out(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def labelled(labels: DataFrame, target: str, rows: int, id_col: str = "doc_id") -> DataFrame:
    """doc_id and y of at most ``rows`` rows that may be learnt from: the first by a hash of the id."""
    known = narrowed(labels, doc_id=id_col, y=F.col(target).cast("int")).dropna().where(~held_out("doc_id"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(rows)


def grown(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], depth: int) -> list[tuple[tuple[Condition, ...], np.ndarray, float]]:
    """The nodes of one regression tree but its root: (conditions, rows, value). Splits gain most by Newton's score."""
    out, todo = [], [((), np.arange(len(g)))]
    while todo:
        path, rows = todo.pop()
        if path:
            out.append((path, rows, float(g[rows].sum() / (h[rows].sum() + 1))))
        if len(path) == depth or len(rows) < 40:
            continue
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-3, None)
        for j, at in enumerate(cuts):
            if not len(at):
                continue
            bin_ = np.searchsorted(at, x[rows, j], "left")
            gl, hl, nl = (np.cumsum(np.bincount(bin_, w, len(at) + 1))[:-1] for w in (g[rows], h[rows], None))
            gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
            gain[(nl < 15) | (len(rows) - nl < 15)] = -1
            if gain[k := int(gain.argmax())] > best[0]:
                best = (float(gain[k]), (j, float(at[k])))
        if best[1]:
            j, at = best[1]
            above = x[rows, j] > at
            todo += [((*path, (j, False, at)), rows[~above]), ((*path, (j, True, at)), rows[above])]
    return out


def leaves_of(nodes: list) -> list:
    paths = {p for p, _, _ in nodes}
    return [n for n in nodes if not any(len(p) == len(n[0]) + 1 and p[: len(n[0])] == n[0] for p in paths)]


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty on the weights of standardised columns, by accelerated proximal steps."""
    mean, sd = z.mean(0), z.std(0) + 1e-9
    s = (z - mean) / sd
    w, b = np.zeros(s.shape[1]), float(np.log(y.mean() / (1 - y.mean())))
    v, c, t = w.copy(), b, 1.0
    step = 4.0 / (np.linalg.norm(s, 2) ** 2 / len(y) + 1)
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(s @ v + c))) - y
        w2 = v - step * (s.T @ r) / len(y)
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - step * penalty, 0)
        b2 = c - step * r.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w / sd, b - float((w / sd) @ mean)


@dataclass
class RuleEnsemble:
    names: tuple[str, ...]
    rules: list[tuple[tuple[Condition, ...], float]]
    intercept: float

    def column(self) -> Column:
        """The score as an expression over the statistics' columns."""
        total = F.lit(self.intercept)
        for conditions, weight in self.rules:
            holds = F.lit(True)
            for j, above, at in conditions:
                holds = holds & (F.col(self.names[j]) > at if above else F.col(self.names[j]) <= at)
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, names: tuple[str, ...], trees: int = 40, depth: int = 3, penalty: float = 1e-3, rate: float = 0.2, seed: int = 7) -> RuleEnsemble:
    if len(y) < 40 or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return RuleEnsemble(names, [], float(np.log(share / (1 - share))))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.01, 0.99, 49))) for j in range(x.shape[1])]
    rng, f, rules = np.random.default_rng(seed), np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        some = np.sort(rng.choice(len(y), max(40, len(y) // 2), replace=False))
        nodes = grown(x[some], (y - p)[some], (p * (1 - p))[some], cuts, depth)
        if not nodes:
            break
        rules |= {tuple(sorted(path)): None for path, _, _ in nodes}
        for path, _, value in leaves_of(nodes):
            f[holding(x, path)] += rate * value
    paths = list(rules)
    z = np.stack([holding(x, p) for p in paths], 1).astype(float)
    w, b = lasso(z, y.astype(float), penalty)
    return RuleEnsemble(names, [(p, float(v)) for p, v in zip(paths, w, strict=True) if v], b)


def holding(x: np.ndarray, conditions: tuple[Condition, ...]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, above, at in conditions:
        out &= x[:, j] > at if above else x[:, j] <= at
    return out


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return measured(docs, id_col, text_col).select("doc_id", *[F.expr(e).cast("double").alias(k) for k, e in STATISTICS.items()])


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", sample_rows: int = SAMPLE_ROWS) -> RuleEnsemble:
    sample = labelled(labels, target, sample_rows)
    texts = narrowed(docs, doc_id="doc_id", text="text").join(F.broadcast(sample.select("doc_id").distinct()), "doc_id", "left_semi")
    rows = statistics(texts).join(sample, "doc_id").orderBy("doc_id", *STATISTICS).toPandas()
    names = tuple(STATISTICS)
    return fit(rows[list(names)].to_numpy(float), rows["y"].to_numpy(int), names)


def scores(docs: DataFrame, model: RuleEnsemble, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    return statistics(docs).select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), model.column().alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
