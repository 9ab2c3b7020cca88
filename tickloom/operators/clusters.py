"""Clusters of features by their correlations, and orthogonal features."""

from __future__ import annotations

import numpy as np
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 100) -> np.ndarray:
    """Labels of k clusters, from centres drawn far apart."""
    centres = x[[rng.integers(len(x))]]
    while len(centres) < k:
        d = ((x[:, None] - centres) ** 2).sum(2).min(1)
        centres = np.vstack([centres, x[rng.choice(len(x), p=d / d.sum()) if d.sum() else rng.integers(len(x))]])
    labels = np.full(len(x), -1)
    for _ in range(rounds):
        new = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
        if (new == labels).all():
            break
        labels = new
        centres = np.stack([x[labels == c].mean(0) if (labels == c).any() else centres[c] for c in range(k)])
    return labels


def silhouettes(x: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """How much nearer each point is to its own cluster than to the next; 0 for clusters of one."""
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    kinds = np.unique(labels)
    mean = np.stack([d[:, labels == c].sum(1) for c in kinds], 1)
    size = np.array([(labels == c).sum() for c in kinds])
    own = np.searchsorted(kinds, labels)
    at = np.arange(len(x))
    a = mean[at, own] / np.maximum(size[own] - 1, 1)
    others = mean / size
    others[at, own] = np.inf
    b = others.min(1)
    return np.where(size[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)


def quality(s: np.ndarray) -> float:
    return float(s.mean() / s.std()) if len(s) and s.std() > 0 else 0.0


def best_clusters(corr: np.ndarray, most: int = 10, n_init: int = 10, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(labels 0, 1, ..., silhouettes) of the clustering with the best ratio of mean to deviation of silhouettes."""
    x = np.sqrt(np.maximum((1 - np.nan_to_num(corr)) / 2, 0))
    best = None
    for start in range(n_init):
        rng = np.random.default_rng([seed, start])
        for k in range(2, min(most, len(x) - 1) + 1):
            labels = kmeans(x, k, rng)
            if len(np.unique(labels)) < 2:
                continue
            s = silhouettes(x, labels)
            if best is None or quality(s) > quality(best[1]):
                best = labels, s
    if best is None:
        return np.zeros(len(x), int), np.zeros(len(x))
    return np.unique(best[0], return_inverse=True)[1], best[1]


def top_clusters(corr: np.ndarray, most: int | None = None, n_init: int = 10, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """As best_clusters, with clusters of below-average quality clustered anew as long as that raises the average."""
    n = len(corr)
    if n < 3:
        return np.zeros(n, int), np.zeros(n)
    most = min(most or n - 1, n - 1)
    labels, s = best_clusters(corr, most, n_init, seed)
    each = {c: quality(s[labels == c]) for c in np.unique(labels)}
    mean = float(np.mean(list(each.values())))
    weak = [c for c, q in each.items() if q < mean]
    if len(weak) <= 1:
        return labels, s
    again = np.flatnonzero(np.isin(labels, weak))
    inner, _ = top_clusters(corr[np.ix_(again, again)], min(most, len(again) - 1), n_init, seed + 1)
    new = labels.copy()
    new[again] = labels.max() + 1 + inner
    new = np.unique(new, return_inverse=True)[1]
    x = np.sqrt(np.maximum((1 - np.nan_to_num(corr)) / 2, 0))
    s2 = silhouettes(x, new)
    better = float(np.mean([quality(s2[new == c]) for c in np.unique(new)]))
    return (new, s2) if better > mean else (labels, s)


def correlation(features: DataFrame, column: str = "features") -> np.ndarray:
    """Correlation matrix of a vector column, by one distributed pass."""
    return Correlation.corr(features, column).first()[0].toArray()


def cluster_kmeans_base(features: DataFrame, names: list[str], most: int = 10, n_init: int = 10, seed: int = 0, column: str = "features") -> DataFrame:
    """feature, cluster, silhouette."""
    return clustered(features, names, best_clusters(correlation(features, column), most, n_init, seed))


def cluster_kmeans_top(features: DataFrame, names: list[str], most: int | None = None, n_init: int = 10, seed: int = 0, column: str = "features") -> DataFrame:
    return clustered(features, names, top_clusters(correlation(features, column), most, n_init, seed))


def clustered(features: DataFrame, names: list[str], found: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    rows = [(n, int(c), float(s)) for n, c, s in zip(names, *found, strict=True)]
    return features.sparkSession.createDataFrame(rows, "feature string, cluster int, silhouette double")


# Orthogonal features.


def pca_weights(cov: np.ndarray, risk: np.ndarray | None = None, target: float = 1.0) -> np.ndarray:
    """Portfolio that takes the given shares of risk from the components (default: all from the smallest)."""
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    if risk is None:
        risk = np.zeros(len(values))
        risk[-1] = 1.0
    return vectors @ (target * np.sqrt(np.asarray(risk) / values))


def get_e_vec(gram: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """The components, largest first, that are needed for a share of the variance."""
    values, vectors = np.linalg.eigh(gram)
    values, vectors = values[::-1], vectors[:, ::-1]
    n = int(np.searchsorted(np.cumsum(values) / values.sum(), share)) + 1
    return values[:n], vectors[:, :n]


def get_ortho_feats(rows: DataFrame, columns: list[str], share: float = 0.95, carry: tuple[str, ...] = ()) -> DataFrame:
    """``carry`` and pc_1, pc_2, ...: standardised features on their main components. Moments in one pass, the projection as expressions."""
    moments = [F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)] + [F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(columns)]
    pairs = [F.covar_samp(a, b).alias(f"c{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j]
    got = rows.agg(*moments, *pairs).first().asDict()
    n = len(columns)
    sd = [got[f"s{i}"] or 1.0 for i in range(n)]
    gram = np.array([[got[f"c{min(i, j)}_{max(i, j)}"] / sd[i] / sd[j] for j in range(n)] for i in range(n)])
    _, vectors = get_e_vec(gram, share)
    z = [(F.col(c) - got[f"m{i}"]) / sd[i] for i, c in enumerate(columns)]
    parts = [sum((z[i] * float(vectors[i, k]) for i in range(n)), F.lit(0.0)).alias(f"pc_{k + 1}") for k in range(vectors.shape[1])]
    return rows.select(*carry, *parts)


def weighted_kendall_tau(importance: np.ndarray, pc_rank: np.ndarray) -> float:
    """Kendall's tau of importance against inverse rank, with hyperbolic weights by both orders, averaged."""
    x, y = np.asarray(importance, float), 1 / np.asarray(pc_rank, float)

    def one(a: np.ndarray, b: np.ndarray) -> float:
        rank = np.empty(len(a))
        rank[np.lexsort((b, a))[::-1]] = np.arange(len(a))
        w = 1 / (rank[:, None] + 1) + 1 / (rank[None, :] + 1)
        np.fill_diagonal(w, 0)
        sa, sb = np.sign(a[:, None] - a), np.sign(b[:, None] - b)
        return float((w * sa * sb).sum() / np.sqrt((w * sa * sa).sum() * (w * sb * sb).sum()))

    return (one(x, y) + one(y, x)) / 2
