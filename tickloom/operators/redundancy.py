"""How many independent trials there were, and what that says of the best one."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tickloom.operators.clusters import top_clusters
from tickloom.operators.evaluation import deflated_sharpe_ratio
from tickloom.operators.portfolio import cov2corr, covariance, matrix, opt_port


def effective(names: list[str], mean: np.ndarray, cov: np.ndarray, n: int, seed: int) -> list[tuple[int, list[str], float]]:
    """(cluster, members, Sharpe ratio of their portfolio of least variance) from moments of the trials alone."""
    labels, _ = top_clusters(cov2corr(cov), seed=seed)
    out = []
    for c in range(labels.max() + 1):
        at = np.flatnonzero(labels == c)
        w = opt_port(cov[np.ix_(at, at)])
        sd = np.sqrt(w @ cov[np.ix_(at, at)] @ w * (n - 1) / n)
        out.append((c, [names[i] for i in at], float(w @ mean[at] / sd) if sd > 0 else 0.0))
    return out


def clusters_of(trials: DataFrame, seed: int) -> list[tuple[int, list[str], float]]:
    cov = covariance(trials, asset="trial")
    names, m = matrix(cov)
    mean = {r["trial"]: r["m"] for r in trials.groupBy("trial").agg({"ret": "avg"}).withColumnRenamed("avg(ret)", "m").collect()}  # one number per trial
    return effective(names, np.array([mean[k] for k in names]), m, int(cov.agg({"n": "min"}).first()[0]), seed)


def get_effective_trials(trials: DataFrame, seed: int = 0) -> DataFrame:
    """cluster, members, sharpe: clusters of trials (ts, trial, ret); their number is that of independent trials."""
    return trials.sparkSession.createDataFrame(clusters_of(trials, seed), "cluster int, members array<string>, sharpe double")


def deflated_sharpe_ratio_clustered(sr: float, trials: DataFrame, n: int = 252, skew: float = 0.0, kurtosis: float = 3.0, seed: int = 0) -> float:
    return deflated_sharpe_ratio(sr, [s for _, _, s in clusters_of(trials, seed)], n, skew, kurtosis)
