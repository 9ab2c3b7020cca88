"""Allocation: covariances, denoising, hierarchical risk parity, nested clusters, simulation.

Covariances come from one distributed pass over the returns; matrices of up to
about a thousand assets are then worked on where they are needed.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.statistics import bounded_minimum
from tickloom.operators.clusters import best_clusters

MOST = 2000


def covariance(returns: DataFrame, value: str = "ret", asset: str = "asset", ts: str = "ts") -> DataFrame:
    """i, j, cov, n over the times at which both assets have a return; j of i or later."""
    r = returns.select(F.col(ts).alias("t"), F.col(asset).alias("a"), F.col(value).alias("x"))
    pairs = r.select("t", F.col("a").alias("i"), F.col("x").alias("x")).join(r.select("t", F.col("a").alias("j"), F.col("x").alias("y")), "t").where("i <= j")
    return pairs.groupBy("i", "j").agg(F.covar_samp("x", "y").alias("cov"), F.count(F.lit(1)).alias("n"))


def matrix(cov: DataFrame) -> tuple[list, np.ndarray]:
    """(assets in order, full matrix) of a long covariance table of at most MOST assets."""
    n = cov.select("i").distinct().count()
    if n > MOST:
        raise ValueError(f"{n} assets; dense algebra takes up to {MOST}")
    long = cov.select("i", "j", "cov").toPandas()
    names = sorted(set(long["i"]))
    at = {k: p for p, k in enumerate(names)}
    out = np.zeros((n, n))
    a, b = long["i"].map(at).to_numpy(), long["j"].map(at).to_numpy()
    out[a, b] = out[b, a] = long["cov"].to_numpy()
    return names, out


def cov2corr_long(cov: DataFrame) -> DataFrame:
    """i, j, corr, held within -1 and 1."""
    sd = cov.where("i = j").select(F.col("i").alias("a"), F.sqrt("cov").alias("sd"))
    rows = cov.join(F.broadcast(sd.withColumnsRenamed({"a": "i", "sd": "si"})), "i").join(F.broadcast(sd.withColumnsRenamed({"a": "j", "sd": "sj"})), "j")
    return rows.select("i", "j", F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("cov") / (F.col("si") * F.col("sj"))))).alias("corr"))


def corr2cov_long(corr: DataFrame, sd: DataFrame) -> DataFrame:
    """i, j, cov from correlations and deviations (a, sd)."""
    rows = corr.join(F.broadcast(sd.withColumnsRenamed({"a": "i", "sd": "si"})), "i").join(F.broadcast(sd.withColumnsRenamed({"a": "j", "sd": "sj"})), "j")
    return rows.select("i", "j", (F.col("corr") * F.col("si") * F.col("sj")).alias("cov"))


def cov2corr(cov: np.ndarray) -> np.ndarray:
    sd = np.sqrt(np.diag(cov))
    out = np.clip(cov / np.outer(sd, sd), -1, 1)
    np.fill_diagonal(out, 1)
    return out


def corr2cov(corr: np.ndarray, sd: np.ndarray) -> np.ndarray:
    return corr * np.outer(sd, sd)


def get_pca(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors), the largest first."""
    values, vectors = np.linalg.eigh(m)
    return values[::-1], vectors[:, ::-1]


def marchenko_pastur(var: float, q: float, points: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, density) over the distribution's range."""
    low, high = var * (1 - (1 / q) ** 0.5) ** 2, var * (1 + (1 / q) ** 0.5) ** 2
    x = np.linspace(low, high, points)
    return x, q / (2 * np.pi * var * np.maximum(x, 1e-300)) * np.sqrt(np.maximum((high - x) * (x - low), 0))


def kernel_density(values: np.ndarray, width: float, x: np.ndarray) -> np.ndarray:
    z = (x[:, None] - values[None, :]) / width
    return np.exp(-0.5 * z * z).sum(1) / (len(values) * width * np.sqrt(2 * np.pi))


def find_max_eval(values: np.ndarray, q: float, width: float) -> tuple[float, float]:
    """(largest eigenvalue of noise, its variance): the variance whose density is nearest to that of the eigenvalues."""

    def error(var: float) -> float:
        x, pdf = marchenko_pastur(var, q)
        return float(((kernel_density(values, width, x) - pdf) ** 2).sum())

    var = bounded_minimum(error, 1e-5, 1 - 1e-5)
    return var * (1 + (1 / q) ** 0.5) ** 2, var


def denoised_corr(values: np.ndarray, vectors: np.ndarray, n_facts: int) -> np.ndarray:
    """The correlation with the eigenvalues of noise made equal."""
    v = values.copy()
    if n_facts < len(v):
        v[n_facts:] = v[n_facts:].mean()
    return cov2corr((vectors * v) @ vectors.T)


def denoised_corr_shrinkage(values: np.ndarray, vectors: np.ndarray, n_facts: int, alpha: float = 0.0) -> np.ndarray:
    """The correlation whose part of noise is shrunk towards its diagonal."""
    part = lambda s: (vectors[:, s] * values[s]) @ vectors[:, s].T
    noise = part(slice(n_facts, None))
    return part(slice(0, n_facts)) + alpha * noise + (1 - alpha) * np.diag(np.diag(noise))


def denoise_cov(cov: np.ndarray, q: float, width: float) -> np.ndarray:
    values, vectors = get_pca(cov2corr(cov))
    top, _ = find_max_eval(values, q, width)
    n_facts = int((values > top).sum())
    return corr2cov(denoised_corr(values, vectors, n_facts), np.sqrt(np.diag(cov)))


def detone_corr(corr: np.ndarray, n_facts: int = 1) -> np.ndarray:
    """The correlation without its first components."""
    values, vectors = get_pca(corr)
    return cov2corr(corr - (vectors[:, :n_facts] * values[:n_facts]) @ vectors[:, :n_facts].T)


# Hierarchical risk parity.


def correl_dist(corr: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((1 - corr) / 2, 0))


def tree_clustering(corr: np.ndarray, method: str = "single") -> np.ndarray:
    """Steps (a, b, distance, size) that join clusters: rows of the distance matrix are points, and points' distances Euclidean.

    Methods: single, complete, average. Clusters from step s on are numbered n + s.
    """
    x = correl_dist(corr)
    square = (x * x).sum(1)
    d = np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * x @ x.T, 0))
    np.fill_diagonal(d, np.inf)
    n = len(d)
    name, size, out = np.arange(n), np.ones(n), []
    for step in range(n - 1):
        a, b = sorted(divmod(int(d.argmin()), n))
        out.append((*sorted((name[a], name[b])), d[a, b], size[a] + size[b]))
        if method == "single":
            new = np.minimum(d[a], d[b])
        elif method == "complete":
            new = np.maximum(d[a], d[b])
        elif method == "average":
            new = (d[a] * size[a] + d[b] * size[b]) / (size[a] + size[b])
        else:
            raise ValueError(f"unknown method {method}")
        d[a], d[:, a] = new, new
        d[a, a] = np.inf
        d[b], d[:, b] = np.inf, np.inf
        name[a], size[a] = n + step, size[a] + size[b]
    return np.array(out)


def get_quasi_diag(link: np.ndarray) -> list[int]:
    """Leaves of the tree from left to right."""
    n, out = len(link) + 1, []
    todo = [n + len(link) - 1]
    while todo:
        k = int(todo.pop())
        if k < n:
            out.append(k)
        else:
            todo += [link[k - n, 1], link[k - n, 0]]
    return out


def get_ivp(cov: np.ndarray) -> np.ndarray:
    w = 1 / np.diag(cov)
    return w / w.sum()


def get_ivp_long(cov: DataFrame) -> DataFrame:
    """asset, weight: inverse variances, scaled to sum 1."""
    rows = cov.where("i = j").select(F.col("i").alias("asset"), (1 / F.col("cov")).alias("w"))
    total = rows.agg(F.sum("w").alias("t"))
    return rows.crossJoin(F.broadcast(total)).select("asset", (F.col("w") / F.col("t")).alias("weight"))


def get_cluster_var(cov: np.ndarray, items: list[int]) -> float:
    part = cov[np.ix_(items, items)]
    w = get_ivp(part)
    return float(w @ part @ w)


def get_rec_bipart(cov: np.ndarray, order: list[int]) -> np.ndarray:
    """Weights by halving the order again and again, each half in proportion to the other's variance."""
    w, todo = np.ones(len(cov)), [order]
    while todo:
        items = todo.pop()
        if len(items) < 2:
            continue
        left, right = items[: len(items) // 2], items[len(items) // 2 :]
        a, b = get_cluster_var(cov, left), get_cluster_var(cov, right)
        w[left] *= b / (a + b)
        w[right] *= a / (a + b)
        todo += [left, right]
    return w


def hrp_weights(cov: np.ndarray, corr: np.ndarray | None = None) -> np.ndarray:
    return get_rec_bipart(cov, get_quasi_diag(tree_clustering(cov2corr(cov) if corr is None else corr)))


def hrp_alloc(returns: DataFrame) -> DataFrame:
    """asset, weight from returns (ts, asset, ret)."""
    cov = covariance(returns)
    names, m = matrix(cov)
    return returns.sparkSession.createDataFrame([(n, float(w)) for n, w in zip(names, hrp_weights(m), strict=True)], f"asset {returns.schema['asset'].dataType.simpleString()}, weight double")


# Nested clusters.


def opt_port(cov: np.ndarray, mu: np.ndarray | None = None) -> np.ndarray:
    """Weights of least variance, or of the best ratio for expected returns; they sum to 1."""
    one = np.ones(len(cov)) if mu is None else np.asarray(mu, float).ravel()
    w = np.linalg.pinv(cov) @ one
    return w / w.sum()


min_var_port = opt_port


def opt_port_nco(cov: np.ndarray, mu: np.ndarray | None = None, max_clusters: int | None = None, seed: int = 0) -> np.ndarray:
    """Weights within clusters times weights of the clusters."""
    labels, _ = best_clusters(cov2corr(cov), max_clusters or max(2, len(cov) // 2), 10, seed)
    inside = np.zeros((len(cov), labels.max() + 1))
    for k in range(labels.max() + 1):
        at = np.flatnonzero(labels == k)
        inside[at, k] = opt_port(cov[np.ix_(at, at)], None if mu is None else np.asarray(mu)[at])
    between = opt_port(inside.T @ cov @ inside, None if mu is None else inside.T @ np.asarray(mu))
    return inside @ between


# Simulation.


def generate_data(n_obs: int, size0: int, size1: int, sigma1: float, seed: int = 12345) -> tuple[np.ndarray, list[int]]:
    """(returns, which of the first columns each of the later ones is a noisy copy of)."""
    rng, pick = np.random.RandomState(seed), random.Random(seed)
    x = rng.normal(0, 1, size=(n_obs, size0))
    of = [pick.randint(0, size0 - 1) for _ in range(size1)]
    return np.hstack([x, x[:, of] + rng.normal(0, sigma1, size=(n_obs, size1))]), of


def hrp_mc(spark: SparkSession, num_iters: int = 1000, n_obs: int = 520, size0: int = 5, size1: int = 5, sigma1: float = 0.25, s_length: int = 260, rebal: int = 22, seed: int = 12345) -> DataFrame:
    """iteration, ivp, hrp: what rebalanced portfolios return out of sample, one simulated market per row."""

    def run(batches):
        for pdf in batches:
            rows = []
            for it in pdf["iteration"]:
                rng = np.random.default_rng([seed, it])
                x = rng.normal(0, 0.01, size=(n_obs, size0))
                x = np.hstack([x, x[:, rng.integers(0, size0, size1)] + rng.normal(0, 0.01 * sigma1, size=(n_obs, size1))])
                grown = {"ivp": 1.0, "hrp": 1.0}
                for at in range(s_length, n_obs, rebal):
                    cov, out = np.cov(x[at - s_length : at], rowvar=False), x[at : at + rebal]
                    for name, w in (("ivp", get_ivp(cov)), ("hrp", hrp_weights(cov))):
                        grown[name] *= float(np.prod(1 + out @ w))
                rows.append((it, grown["ivp"] - 1, grown["hrp"] - 1))
            yield pd.DataFrame(rows, columns=["iteration", "ivp", "hrp"])

    return spark.range(num_iters).withColumnRenamed("id", "iteration").repartition(min(num_iters, 64)).mapInPandas(run, "iteration long, ivp double, hrp double")
