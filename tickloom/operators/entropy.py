"""Entropy and information: word frequencies, compression and matching estimators, encodings, distances between variables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.operators.ordered import Names, whole


def pmf1(messages: DataFrame, w: int, keys: Names = (), message: str = "message") -> DataFrame:
    """keys, word, p: shares of the words of length w, the last word left out."""
    n = F.length(message) - w
    words = messages.where(n > 0).select(*keys, n.alias("n"), F.explode(F.sequence(F.lit(1), n)).alias("at"), F.col(message).alias("__m"))
    words = words.select(*keys, "n", F.substring("__m", F.col("at"), F.lit(w)).alias("word"))
    return words.groupBy(*keys, "n", "word").agg(F.count(F.lit(1)).alias("c")).select(*keys, "word", (F.col("c") / F.col("n")).alias("p"))


def plug_in(messages: DataFrame, w: int, keys: Names = (), message: str = "message") -> DataFrame:
    """keys, entropy: of the word shares, per letter, in bits."""
    return pmf1(messages, w, keys, message).groupBy(*keys).agg((-F.sum(F.col("p") * F.log2("p")) / w).alias("entropy"))


def lempel_ziv(message: str) -> list[str]:
    """The phrases of a parse, each the shortest string from its place that is no phrase yet; one that the end cuts is left out."""
    seen: dict[str, None] = {}
    at, n = 0, len(message)
    while at < n:
        for end in range(at + 1, n + 1):
            if message[at:end] not in seen:
                seen[message[at:end]] = None
                break
        at = end
    return list(seen)


def lempel_ziv_udf():
    """The parse as a function of a column, in Arrow batches."""

    @F.pandas_udf("array<string>")
    def run(messages: pd.Series) -> pd.Series:
        return messages.map(lambda m: lempel_ziv(m or ""))

    return run


def lempel_ziv_lib(message: str | Column) -> Column:
    return lempel_ziv_udf()(message)


def match_length(message: str, i: int, n: int) -> tuple[int, str]:
    """(1 + length, match): the longest string of up to n letters from i that also starts in [i - n, i); it may run over i."""
    best = ""
    for size in range(1, n + 1):
        if i + size > len(message):
            break
        at = message.find(message[i : i + size], max(i - n, 0), i + size - 1)
        if at < 0:
            break
        best = message[i : i + size]
    return len(best) + 1, best


def kontoyiannis(message: str, window: int | None = None) -> tuple[int, float, list[str], float, float]:
    """(points, sum, matches, entropy rate, redundancy)."""
    n = len(message)
    if window is None:
        points = range(1, n // 2 + 1)
    else:
        window = min(window, n // 2)
        points = range(window, n - window + 1)
    total, matches, count = 0.0, [], 0
    for i in points:
        length, match = match_length(message, i, window or i)
        total += math.log2((window or i) + 1) / length
        matches.append(match)
        count += 1
    h = total / count if count else 0.0
    return count, total, matches, h, 1 - h / math.log2(n) if n > 1 else 0.0


def konto(message: str | Column, window: int | None = None) -> Column:
    """Struct num, sum, matches, h, r of a column of messages, in Arrow batches."""

    @F.pandas_udf("num long, sum double, matches array<string>, h double, r double")
    def run(messages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([kontoyiannis(m or "", window) for m in messages], columns=["num", "sum", "matches", "h", "r"])

    return run(message)


def joined_in_order(rows: DataFrame, letter: Column, keys: Names, order: Names) -> DataFrame:
    """keys, message: the letters of a series in order. A message is one value, so a series must fit one row."""
    pairs = F.sort_array(F.collect_list(F.struct(*order, letter.cast("string").alias("__l"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(pairs, lambda x: x["__l"]), "").alias("message"))


def encode_binary(returns: DataFrame, value: str = "ret", keys: Names = (), order: Names = ("ts",)) -> DataFrame:
    """keys, message: 1 for gains, 0 for losses, nothing for zeros."""
    return joined_in_order(returns.where(F.col(value) != 0), F.when(F.col(value) > 0, 1).otherwise(0), keys, order)


def quantile_letters(returns: DataFrame, letters: int, value: str, keys: Names) -> DataFrame:
    """Adds __letter: the number of inner quantile edges (linear between values, equal ones once) below the value."""
    at = [i / letters for i in range(letters + 1)]
    edges = F.array_distinct(F.percentile(value, F.array(*[F.lit(a) for a in at])))
    edged = returns.groupBy(*keys).agg(edges.alias("__edges"))
    rows = returns.join(F.broadcast(edged), list(keys)) if keys else returns.crossJoin(F.broadcast(edged))
    inner = F.slice("__edges", 2, F.greatest(F.size("__edges") - 2, F.lit(0)))
    return rows.withColumn("__letter", F.size(F.filter(inner, lambda e: e < F.col(value)))).drop("__edges")


def encode_quantile(returns: DataFrame, letters: int = 10, value: str = "ret", keys: Names = (), order: Names = ("ts",)) -> DataFrame:
    """keys, message: the quantile bin of each value, as decimal numbers one after the other."""
    return joined_in_order(quantile_letters(returns.where(F.col(value).isNotNull()), letters, value, keys), F.col("__letter"), keys, order)


def encode_sigma(returns: DataFrame, step: float, value: str = "ret", keys: Names = (), order: Names = ("ts",)) -> DataFrame:
    """keys, message: how many whole steps each value is above the lowest."""
    rows = returns.where(F.col(value).isNotNull()).withColumn("__low", F.min(value).over(whole(keys)))
    return joined_in_order(rows, F.floor((F.col(value) - F.col("__low")) / step), keys, order)


def market_efficiency_metric(returns: DataFrame, encoding: str = "quantile", bins: int = 10, value: str = "ret", keys: Names = (), order: Names = ("ts",)) -> DataFrame:
    """keys, entropy_rate, redundancy of the encoded series."""
    messages = encode_binary(returns, value, keys, order) if encoding == "binary" else encode_quantile(returns, bins, value, keys, order)
    rows = messages.withColumn("__k", konto("message"))
    return rows.select(*keys, F.col("__k.h").alias("entropy_rate"), F.col("__k.r").alias("redundancy"))


def portfolio_concentration(w: np.ndarray, cov: np.ndarray) -> float:
    """1 less the effective share of principal components that carry the portfolio's risk."""
    values, vectors = np.linalg.eigh(cov)
    theta = (vectors.T @ w) ** 2 * values
    theta = theta / theta.sum()
    theta = theta[theta > 0]
    return float(1 - np.exp(-(theta * np.log(theta)).sum()) / len(w))


def adverse_selection_feature(flow: DataFrame, bins: int = 10, window: int = 100, buy: str = "buy_volume", total: str = "volume", keys: Names = (), order: Names = ("ts",)) -> DataFrame:
    """keys, h: entropy rate of the quantile-coded share of buys."""
    messages = encode_quantile(flow.withColumn("__share", F.try_divide(buy, total)), bins, "__share", keys, order)
    return messages.withColumn("__k", konto("message", window)).select(*keys, F.col("__k.h").alias("h"))


def kl_divergence(pairs: DataFrame, keys: Names = (), p: str = "p", q: str = "q") -> DataFrame:
    """keys, kl: of two distributions given row by row and scaled to sum 1; infinite where q is 0 and p is not."""
    w = whole(keys)
    rows = pairs.withColumn("__p", F.col(p) / F.sum(p).over(w)).withColumn("__q", F.col(q) / F.sum(q).over(w))
    term = F.when(F.col("__p") > 0, F.when(F.col("__q") > 0, F.col("__p") * F.log(F.col("__p") / F.col("__q"))).otherwise(F.lit(float("inf")))).otherwise(F.lit(0.0))
    return rows.groupBy(*keys).agg(F.sum(term).alias("kl"))


def cross_entropy(pairs: DataFrame, keys: Names = (), p: str = "p", q: str = "q") -> DataFrame:
    """keys, cross_entropy: entropy of p plus its divergence from q, in nats."""
    w = whole(keys)
    rows = pairs.withColumn("__p", F.col(p) / F.sum(p).over(w)).withColumn("__q", F.col(q) / F.sum(q).over(w))
    term = F.when(F.col("__p") > 0, F.when(F.col("__q") > 0, -F.col("__p") * F.log("__q")).otherwise(F.lit(float("inf")))).otherwise(F.lit(0.0))
    return rows.groupBy(*keys).agg(F.sum(term).alias("cross_entropy"))


def num_bins(n: int | Column, corr: float | Column | None = None) -> int | Column:
    """The best number of bins for n values, or for n pairs of a correlation; of numbers or of columns."""
    if not isinstance(n, Column):
        if corr is None:
            z = (8 + 324 * n + 12 * (36 * n + 729 * n**2) ** 0.5) ** (1 / 3)
            return round(z / 6 + 2 / (3 * z) + 1 / 3)
        return round(2**-0.5 * (1 + (1 + 24 * n / (1 - corr**2)) ** 0.5) ** 0.5)
    if corr is None:
        z = F.pow(8 + 324 * n + 12 * F.sqrt(36 * n + 729 * n * n), F.lit(1 / 3))
        return F.bround(z / 6 + 2 / (3 * z) + 1 / 3).cast("int")
    return F.bround(2**-0.5 * F.sqrt(1 + F.sqrt(1 + 24 * n / (1 - corr * corr)))).cast("int")


def binned(rows: DataFrame, columns: Names, bins: int | Column | None, keys: Names) -> DataFrame:
    """Adds <column>_bin: which of the equal-width bins between the least and the greatest value a value is in."""
    w = whole(keys)
    b = (num_bins(F.count(F.lit(1)).over(w)) if bins is None else F.lit(bins) if isinstance(bins, int) else bins)
    rows = rows.withColumn("__b", b)
    for c in columns:
        low, high = F.min(c).over(w), F.max(c).over(w)
        rows = rows.withColumn(f"{c}_bin", F.when(high == low, 0).otherwise(F.least(F.floor((F.col(c) - low) * F.col("__b") / (high - low)), F.col("__b") - 1)).cast("int"))
    return rows


def discretize_optimal(rows: DataFrame, value: str, bins: int | None = None, keys: Names = ()) -> DataFrame:
    """Adds <value>_bin."""
    return binned(rows, [value], bins, keys).drop("__b")


def information(pairs: DataFrame, x: str, y: str, keys: Names) -> DataFrame:
    """keys, hx, hy, i: entropies of the binned variables and their mutual information, in nats."""
    w = whole(keys)
    rows = pairs.withColumn("__r", F.corr(x, y).over(w)).withColumn("__n", F.count(F.lit(1)).over(w))
    rows = binned(rows, [x, y], num_bins(F.col("__n"), F.col("__r")), keys)
    cells = rows.groupBy(*keys, F.col(f"{x}_bin").alias("a"), F.col(f"{y}_bin").alias("b")).agg((F.count(F.lit(1))).alias("c"))
    cells = cells.withColumn("n", F.sum("c").over(w)).withColumn("ca", F.sum("c").over(Window.partitionBy(*keys, "a"))).withColumn("cb", F.sum("c").over(Window.partitionBy(*keys, "b")))
    p, pa, pb = (F.col(c) / F.col("n") for c in ("c", "ca", "cb"))
    return cells.groupBy(*keys).agg((-F.sum(p * F.log(pa))).alias("hx"), (-F.sum(p * F.log(pb))).alias("hy"), F.sum(p * F.log(p / (pa * pb))).alias("i"))


def variation_of_information(pairs: DataFrame, x: str, y: str, normalize: bool = False, keys: Names = ()) -> DataFrame:
    rows = information(pairs, x, y, keys)
    vi = F.col("hx") + F.col("hy") - 2 * F.col("i")
    joint = F.col("hx") + F.col("hy") - F.col("i")
    return rows.select(*keys, (F.when(joint > 0, vi / joint).otherwise(vi) if normalize else vi).alias("vi"))


def mutual_information_optimal(pairs: DataFrame, x: str, y: str, keys: Names = ()) -> DataFrame:
    return information(pairs, x, y, keys).select(*keys, F.col("i").alias("mi"))
