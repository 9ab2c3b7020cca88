"""Learning with purged folds: forests, importance of features, scores, tuning.

Fits on folds are independent, so tasks of (fold, feature or parameters) are
rows of a grid, each task with the observations it needs; forests that must hold
all data are Spark ML's. Every random choice has a seed.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.validation import PurgedKFold, accuracy, neg_log_loss


def balanced(rows: DataFrame, label: str = "label") -> DataFrame:
    """Adds weight: the row's own, times rows over classes and the class's rows."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("__c"))
    total, classes = rows.count(), counts.count()
    own = F.col("weight") if "weight" in rows.columns else F.lit(1.0)
    return rows.join(F.broadcast(counts), label).withColumn("weight", own * total / (classes * F.col("__c"))).drop("__c")


def build_random_forest(avg_uniqueness: float | None = None, n_estimators: int = 1000, method: int = 0, seed: int = 0) -> RandomForestClassifier:
    """Forests for overlapping labels: 0 balanced bags of all rows, 1 bags of the share of unique rows with all features, 2 the same with one feature a split."""
    if method not in (0, 1, 2):
        raise ValueError("method must be 0, 1 or 2")
    if method and avg_uniqueness is None:
        raise ValueError("methods 1 and 2 need the average uniqueness")
    features = {0: "sqrt", 1: "all", 2: "1"}[method]
    return RandomForestClassifier(numTrees=n_estimators, impurity="entropy", subsamplingRate=float(avg_uniqueness or 1.0), featureSubsetStrategy=features, weightCol="weight", maxDepth=5, seed=seed)


def bagging_classifier(rows: DataFrame, estimator, n_estimators: int, max_samples: float = 1.0, seed: int = 0) -> list:
    """Models of ``estimator`` on samples with replacement; average their probabilities with ``bagged``."""
    return [estimator.fit(rows.sample(withReplacement=True, fraction=max_samples, seed=seed + i)) for i in range(n_estimators)]


def bagged(models: list, rows: DataFrame) -> DataFrame:
    """Adds prob, an array: the mean of the models' class probabilities."""
    out = rows
    for i, m in enumerate(models):
        out = m.transform(out).withColumn(f"__p{i}", vector_to_array("probability")).drop("rawPrediction", "probability", "prediction")
    n = len(models)
    total = F.col("__p0")
    for i in range(1, n):
        total = F.zip_with(total, F.col(f"__p{i}"), lambda a, b: a + b)
    return out.withColumn("prob", F.transform(total, lambda x: x / n)).drop(*[f"__p{i}" for i in range(n)])


def assembled(rows: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    out = VectorAssembler(inputCols=features, outputCol="features").transform(rows).withColumn("label", F.col(label).cast("double"))
    return out if "weight" in out.columns else out.withColumn("weight", F.lit(1.0))


def scored(model, test: DataFrame, scoring: str) -> float:
    got = model.transform(test).withColumn("__p", vector_to_array("probability"))
    value = neg_log_loss(F.element_at("__p", F.col("label").cast("int") + 1), F.col("weight")) if scoring == "neg_log_loss" else accuracy(F.col("label"), F.col("prediction"), F.col("weight"))
    return float(got.agg(value.alias("s")).first()["s"])


def folds_of(rows: DataFrame, cv: PurgedKFold):
    """(train, test) of each fold, as joins of the rows with the split table."""
    splits = cv.split(rows).cache()
    for s in range(cv.n_splits):
        part = splits.where(F.col("split") == s)
        yield tuple(rows.join(part.where(F.col("role") == role).select("ts"), "ts", "left_semi") for role in ("train", "test"))


def cv_score(estimator, rows: DataFrame, features: list[str], scoring: str = "neg_log_loss", cv: PurgedKFold | None = None) -> list[float]:
    """Scores of the folds; ``rows``: ts, t1, label, features and perhaps weight."""
    data = assembled(rows, features).cache()
    return [scored(estimator.fit(train), test, scoring) for train, test in folds_of(data, cv or PurgedKFold(3))]


# Importance of features.


def feat_imp_mdi(spark: SparkSession, model, names: list[str]) -> DataFrame:
    """feature, mean, std: importance in the forest's trees (0 counts as missing), scaled so that the means sum to 1."""
    each = np.array([t.featureImportances.toArray() for t in model.trees])
    each[each == 0] = np.nan
    return summarised(spark, names, each)


def summarised(spark: SparkSession, names: list[str], each: np.ndarray, scale: bool = True) -> DataFrame:
    mean = np.where(np.isnan(each).all(0), 0.0, np.nanmean(np.where(np.isnan(each).all(0), 0.0, each), axis=0))
    sd = np.nan_to_num(np.nanstd(np.where(np.isnan(each).all(0), 0.0, each), axis=0, ddof=1 if len(each) > 1 else 0)) / np.sqrt(len(each))
    total = mean.sum() if scale and mean.sum() else 1.0
    return spark.createDataFrame([(f, float(m / total), float(s / total)) for f, m, s in zip(names, mean, sd, strict=True)], "feature string, mean double, std double")


def feat_imp_mdi_clustered(spark: SparkSession, model, names: list[str], clusters: dict[str, list[str]]) -> DataFrame:
    """As feat_imp_mdi for sums over clusters of features."""
    each = np.array([t.featureImportances.toArray() for t in model.trees])
    sums = np.stack([each[:, [names.index(f) for f in c]].sum(1) for c in clusters.values()], 1)
    return summarised(spark, list(clusters), sums)


def permuted(rows: DataFrame, features: list[str], seed: int) -> DataFrame:
    """The rows with the values of some features dealt anew, each by an order of its own."""
    from pyspark.sql.window import Window

    out = rows.withColumn("__i", F.row_number().over(Window.orderBy("ts")))
    for k, f in enumerate(features):
        dealt = rows.select(F.col(f).alias(f"__{f}"), F.row_number().over(Window.orderBy(F.xxhash64(F.lit(seed + k), "ts"))).alias("__i"))
        out = out.join(dealt, "__i").drop(f).withColumnRenamed(f"__{f}", f)
    return out.drop("__i")


def loss_of(before: float, after: float, scoring: str) -> float:
    """What a score loses, as a share of what it could lose."""
    room = -after if scoring == "neg_log_loss" else 1 - after
    return (before - after) / room if room else 0.0


def feat_imp_mda(estimator, rows: DataFrame, features: list[str], cv: PurgedKFold | None = None, scoring: str = "neg_log_loss", clusters: dict[str, list[str]] | None = None, seed: int = 0) -> DataFrame:
    """feature (or cluster), mean, std of what out-of-sample scores lose when its values are dealt anew."""
    groups = clusters or {f: [f] for f in features}
    cv, losses = cv or PurgedKFold(10), []
    for fold, (train, test) in enumerate(folds_of(rows.cache(), cv)):
        model, test = estimator.fit(assembled(train, features)), test.cache()
        before = scored(model, assembled(test, features), scoring)
        losses.append([loss_of(before, scored(model, assembled(permuted(test, c, seed + 1000 * fold), features), scoring), scoring) for c in groups.values()])
    return summarised(rows.sparkSession, list(groups), np.array(losses), scale=False)


def feat_imp_mda_clustered(estimator, rows: DataFrame, features: list[str], clusters: dict[str, list[str]], n_splits: int = 10, seed: int = 0) -> DataFrame:
    return feat_imp_mda(estimator, rows, features, PurgedKFold(n_splits), "neg_log_loss", clusters, seed)


def feat_imp_sfi(estimator, rows: DataFrame, features: list[str], cv: PurgedKFold | None = None, scoring: str = "neg_log_loss") -> DataFrame:
    """feature, mean, std of the fold scores with one feature alone."""
    each = np.array([cv_score(estimator, rows, [f], scoring, cv) for f in features]).T
    return summarised(rows.sparkSession, features, each, scale=False)


def get_test_data(spark: SparkSession, n_features: int = 40, n_informative: int = 10, n_redundant: int = 10, n_samples: int = 10_000, seed: int = 0) -> DataFrame:
    """ts, t1, label, weight and features I_* (informative), R_* (combinations of these), N_* (noise)."""
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n_samples)
    info = (2.0 * y[:, None] - 1) * rng.choice([-1.0, 1.0], size=n_informative) + rng.standard_normal((n_samples, n_informative))
    redundant = info @ rng.uniform(-1, 1, (n_informative, n_redundant))
    noise = rng.standard_normal((n_samples, n_features - n_informative - n_redundant))
    names = [f"I_{i}" for i in range(n_informative)] + [f"R_{i}" for i in range(n_redundant)] + [f"N_{i}" for i in range(noise.shape[1])]
    pdf = pd.DataFrame(np.hstack([info, redundant, noise]), columns=names)
    pdf.insert(0, "ts", pd.bdate_range("2000-01-03", periods=n_samples))
    pdf.insert(1, "t1", pdf["ts"])
    pdf.insert(2, "label", y.astype(float))
    pdf.insert(3, "weight", 1.0)
    return spark.createDataFrame(pdf)


def feat_importance(rows: DataFrame, features: list[str], n_estimators: int = 1000, cv: int = 10, scoring: str = "neg_log_loss", method: str = "MDI", pct_embargo: float = 0.0, seed: int = 0) -> tuple[DataFrame, float]:
    """(importance, mean fold score) of a forest of trees with one random feature a split, by MDI, MDA or SFI."""
    forest = RandomForestClassifier(numTrees=n_estimators, impurity="entropy", featureSubsetStrategy="1", weightCol="weight", maxDepth=5, seed=seed)
    data, folds = balanced(rows), PurgedKFold(cv, pct_embargo)
    if method == "MDI":
        imp = feat_imp_mdi(rows.sparkSession, forest.fit(assembled(data, features)), features)
    elif method == "MDA":
        imp = feat_imp_mda(forest, data, features, folds, scoring, seed=seed)
    elif method == "SFI":
        imp = feat_imp_sfi(forest, data, features, folds, scoring)
    else:
        raise ValueError(f"unknown method {method}")
    return imp, float(np.mean(cv_score(forest, data, features, scoring, folds)))


def plot_feat_importance(importance: DataFrame) -> DataFrame:
    """The rows of a bar chart, least important first."""
    return importance.orderBy("mean")


# Tuning.


def make_pipeline(*stages) -> Pipeline:
    """Stages whose last one is fitted with the rows' weights."""
    stages[-1].setParams(weightCol="weight")
    return Pipeline(stages=list(stages))


def draws(grid: dict[str, list | tuple[float, float]], n: int, seed: int) -> list[dict]:
    """n random settings: from lists, or log-uniform between the two ends of a pair of floats."""
    rng = np.random.default_rng(seed)
    return [{k: float(v[0] * (v[1] / v[0]) ** rng.uniform()) if isinstance(v, tuple) else v[rng.integers(len(v))] for k, v in grid.items()} for _ in range(n)]


def clf_hyper_fit(rows: DataFrame, features: list[str], make, grid: dict, cv: int = 3, bagging: int = 0, random_draws: int = 0, pct_embargo: float = 0.0, seed: int = 0):
    """(model or bagged models, best settings, scores): the settings with the best mean score over purged folds, fitted on all rows.

    ``make(**settings)`` gives an estimator. Labels 0 and 1 are scored by F1, others by log loss.
    """
    settings = draws(grid, random_draws, seed) if random_draws else [dict(zip(grid, v, strict=True)) for v in itertools.product(*grid.values())]
    data = assembled(rows, features).cache()
    binary = {r["label"] for r in data.select("label").distinct().limit(3).collect()} == {0.0, 1.0}
    total = np.zeros(len(settings))
    for train, test in folds_of(data, PurgedKFold(cv, pct_embargo)):
        train, test = train.cache(), test.cache()
        total += [f1(make(**s).fit(train), test) if binary else scored(make(**s).fit(train), test, "neg_log_loss") for s in settings]
    best = settings[int(total.argmax())]
    model = bagging_classifier(data, make(**best), bagging, seed=seed) if bagging else make(**best).fit(data)
    return model, best, (total / cv).tolist()


def f1(model, test: DataFrame) -> float:
    w, p, y = F.col("weight"), F.col("prediction"), F.col("label")
    r = model.transform(test).agg(*[F.coalesce(F.sum(F.when((p == a) & (y == b), w)), F.lit(0.0)).alias(n) for n, a, b in (("tp", 1, 1), ("fp", 1, 0), ("fn", 0, 1))]).first()
    return 2 * r["tp"] / (2 * r["tp"] + r["fp"] + r["fn"]) if r["tp"] else 0.0


ESTIMATORS = {"tree": DecisionTreeClassifier, "logistic": LogisticRegression, "forest": RandomForestClassifier}
