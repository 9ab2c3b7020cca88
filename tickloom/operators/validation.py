"""Cross-validation without leakage: purged and embargoed folds, combinatorial splits, backtest paths, scores.

Observations are keys-less tables with ``ts`` and ``t1`` (end of the label);
splits come back as rows (split, ts, role), to be joined with the features.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.operators.ordered import over, position, whole


def get_train_times(train: DataFrame, tests: DataFrame) -> DataFrame:
    """``train`` (ts, t1) without labels that share time with any of the closed intervals ``tests`` (start, end).

    The intervals are merged first, so each label meets at most the first merged one that ends at or after it starts.
    """
    w = Window.orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    merged = tests.withColumn("new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1))).withColumn("g", F.sum("new").over(w))
    merged = merged.groupBy("g").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("start", "end")
    return train.join(F.broadcast(merged), (F.col("ts") <= F.col("end")) & (F.col("t1") >= F.col("start")), "left_anti")


def get_embargo_times(times: DataFrame, pct: float) -> DataFrame:
    """ts, embargo_ts: the time a share of all rows later, at most the last."""
    step = int(times.count() * pct)
    w = over((), ["ts"])
    last = F.max("ts").over(whole(()))
    return times.select("ts", F.coalesce(F.lead("ts", step).over(w), last).alias("embargo_ts") if step else F.col("ts").alias("embargo_ts"))


def numbered(observations: DataFrame, groups: int) -> DataFrame:
    """Adds i, n and fold: consecutive, the first ones a row longer if need be."""
    rows = observations.withColumn("i", position((), ["ts"])).withColumn("n", F.count(F.lit(1)).over(whole(())))
    return rows.withColumn("fold", F.ntile(groups).over(over((), ["ts"])) - 1)


class PurgedKFold:
    """Consecutive test folds; training is what ends before the fold starts or starts after its labels end and the embargo."""

    def __init__(self, n_splits: int = 3, pct_embargo: float = 0.0) -> None:
        self.n_splits, self.pct_embargo = n_splits, pct_embargo

    def split(self, observations: DataFrame) -> DataFrame:
        """split, ts, role (train or test)."""
        if "t1" not in observations.columns:
            raise ValueError("t1 is needed")
        rows = numbered(observations.select("ts", "t1"), self.n_splits)
        folds = rows.groupBy(F.col("fold").alias("split")).agg(F.min("ts").alias("first"), F.max("t1").alias("until"))
        after = rows.select("ts", "i", "n").crossJoin(F.broadcast(folds)).where(F.col("ts") >= F.col("until")).groupBy("split").agg(F.min(F.col("i") + F.floor(F.col("n") * self.pct_embargo)).alias("resume"))
        folds = folds.join(after, "split", "left")
        each = rows.crossJoin(F.broadcast(folds))  # n_splits rows per observation, as many as the result may have
        role = F.when(F.col("fold") == F.col("split"), "test").when((F.col("t1") <= F.col("first")) | (F.col("i") >= F.col("resume")), "train")
        return each.select("split", "ts", role.alias("role")).where("role IS NOT NULL")


class CombinatorialPurgedKFold:
    """All choices of ``k`` of ``n`` consecutive groups as test sets."""

    def __init__(self, n_splits: int = 6, k_test_groups: int = 2, pct_embargo: float = 0.0) -> None:
        if k_test_groups >= n_splits:
            raise ValueError("k_test_groups must be below n_splits")
        self.n, self.k, self.pct_embargo = n_splits, k_test_groups, pct_embargo

    def splits(self) -> list[tuple[int, ...]]:
        return list(itertools.combinations(range(self.n), self.k))

    def split_groups(self, observations: DataFrame) -> DataFrame:
        """split, fold of all test groups: a table of constants."""
        return observations.sparkSession.createDataFrame([(s, g) for s, groups in enumerate(self.splits()) for g in groups], "split int, fold int")

    def get_test_group_map(self, observations: DataFrame) -> DataFrame:
        """split, fold, ts of the test observations."""
        return numbered(observations.select("ts", "t1"), self.n).join(F.broadcast(self.split_groups(observations)), "fold").select("split", "fold", "ts")

    def split(self, observations: DataFrame) -> DataFrame:
        """split, ts, role. Training is purged of labels that share time with a test group, and of the rows between a group's end and its embargo time."""
        rows = numbered(observations.select("ts", "t1"), self.n)
        step = int(observations.count() * self.pct_embargo)
        spans = rows.groupBy("fold").agg(F.min("ts").alias("start"), F.max("t1").alias("until"), F.max("i").alias("last"))
        tests = F.broadcast(self.split_groups(observations).join(spans, "fold"))
        every = rows.crossJoin(F.broadcast(self.split_groups(observations).select("split").distinct()))
        test = every.join(F.broadcast(self.split_groups(observations)), ["split", "fold"], "left_semi").select("split", "ts", F.lit("test").alias("role"))
        rest = every.join(F.broadcast(self.split_groups(observations)), ["split", "fold"], "left_anti")
        shared = (rest["ts"] <= tests["until"]) & (rest["t1"] >= tests["start"])
        banned = (rest["i"] > tests["last"]) & (rest["i"] < tests["last"] + step)
        train = rest.join(tests, (rest["split"] == tests["split"]) & (shared | banned), "left_anti").select("split", "ts", F.lit("train").alias("role"))
        return test.unionByName(train)


def backtest_partitions(n: int, k: int) -> list[list[int]]:
    """For each path, the splits whose test groups partition all groups: the first ones in depth-first order; none unless k divides n."""
    splits = list(itertools.combinations(range(n), k))
    want, out = k * math.comb(n, k) // n, []
    if n % k:
        return out

    def extend(left: frozenset[int], start: int, chosen: list[int]) -> None:
        if len(out) == want:
            return
        if not left:
            out.append(chosen)
            return
        for s in range(start, len(splits)):
            if left.issuperset(splits[s]):
                extend(left.difference(splits[s]), s + 1, [*chosen, s])

    extend(frozenset(range(n)), 0, [])
    return out


def assemble_backtest_paths(predictions: DataFrame, n_groups: int, k_test_groups: int) -> DataFrame:
    """path, ts, prediction from predictions (split, ts, prediction) of the test sets."""
    rows = [(p, s) for p, splits in enumerate(backtest_partitions(n_groups, k_test_groups)) for s in splits]
    paths = predictions.sparkSession.createDataFrame(rows, "path int, split int")
    return predictions.join(F.broadcast(paths), "split").select("path", "ts", "prediction")


def assemble_paths_per_group(predictions: DataFrame, cv: CombinatorialPurgedKFold, observations: DataFrame) -> DataFrame:
    """path, ts, prediction where the j-th split that tests a group serves path j: every prediction is used once."""
    order = {}
    rows = []
    for s, groups in enumerate(cv.splits()):
        for g in groups:
            rows.append((s, g, order.setdefault(g, 0)))
            order[g] += 1
    uses = predictions.sparkSession.createDataFrame(rows, "split int, fold int, path int")
    return predictions.join(cv.get_test_group_map(observations), ["split", "ts"]).join(F.broadcast(uses), ["split", "fold"]).select("path", "ts", "prediction")


def neg_log_loss(prob_of_label: Column, weight: Column | None = None) -> Column:
    """Aggregate: mean log of the probability given to the true label."""
    w = weight if weight is not None else F.lit(1.0)
    return F.sum(w * F.log(F.greatest(F.least(prob_of_label, F.lit(1 - 1e-15)), F.lit(1e-15)))) / F.sum(w)


def accuracy(label: Column, prediction: Column, weight: Column | None = None) -> Column:
    w = weight if weight is not None else F.lit(1.0)
    return F.sum(F.when(label == prediction, w).otherwise(F.lit(0.0))) / F.sum(w)


def probability_weighted_accuracy(rows: DataFrame, label: str = "label", prediction: str = "prediction", prob: str = "prob", classes: int = 2) -> DataFrame:
    """One row, pwa: how sure predictions were beyond chance, the share of it that was right; 0 if there was none."""
    edge = F.col(prob) - 1 / classes
    total = F.sum(edge)
    return rows.agg(F.when(total != 0, F.sum(F.when(F.col(label) == F.col(prediction), edge).otherwise(F.lit(0.0))) / total).otherwise(F.lit(0.0)).alias("pwa"))


def purged_folds(ts: np.ndarray, t1: np.ndarray, k: int, pct: float = 0.0) -> list[tuple[np.ndarray, np.ndarray]]:
    """(train, test) places of the folds of PurgedKFold, for kernels that hold the observations; ts ascending."""
    out, n = [], len(ts)
    for test in np.array_split(np.arange(n), k):
        until = np.searchsorted(ts, t1[test].max(), "left")
        resume = until + int(n * pct) if until < n else n
        out.append((np.flatnonzero((t1 <= ts[test[0]]) | (np.arange(n) >= resume)), test))
    return [(np.setdiff1d(a, b), b) for a, b in out]
