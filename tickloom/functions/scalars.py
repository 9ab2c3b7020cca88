"""Closed forms as column functions. Arguments may be columns, names of columns, or numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Value = Column | str | float | int


def col(x: Value) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def bet_size(w: Value, x: Value) -> Column:
    return col(x) / F.sqrt(col(w) + col(x) * col(x))


def get_target_pos(w: Value, f: Value, m_p: Value, max_pos: Value) -> Column:
    return (bet_size(w, col(f) - col(m_p)) * col(max_pos)).cast("int")


def inv_price(f: Value, w: Value, m: Value) -> Column:
    return col(f) - col(m) * F.sqrt(col(w) / (1 - col(m) * col(m)))


def limit_price(t_pos: Value, pos: Value, f: Value, w: Value, max_pos: Value) -> Column:
    """Mean of the prices at which each further unit would be held; sizes count without their sign."""
    t, p = col(t_pos).cast("int"), col(pos).cast("int")
    first, last = F.abs(p + F.when(t >= p, 1).otherwise(-1)), F.abs(t)
    units = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(units, F.lit(0.0), lambda s, j: s + inv_price(f, w, j / col(max_pos)))
    return F.when(t == p, col(f)).otherwise(F.try_divide(total, (t - p).cast("double")))


def get_w(x: Value, m: Value) -> Column:
    return col(x) * col(x) * (1 / (col(m) * col(m)) - 1)


def discrete_signal(signal: Value, step: float) -> Column:
    """Rounded to steps (halves to even) and held within -1 and 1."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.bround(col(signal) / step) * step))


def strategy_precision(alpha: Value, beta: Value, theta: Value) -> Column:
    hit = (1 - col(beta)) * col(theta)
    return hit / (hit + col(alpha))


def strategy_recall(beta: Value) -> Column:
    return 1 - col(beta)


def multi_test_precision_recall(alpha: Value, beta: Value, theta: Value, k: Value) -> Column:
    """Struct precision, recall of k tests."""
    a, b = 1 - F.pow(1 - col(alpha), col(k)), F.pow(col(beta), col(k))
    return F.struct(strategy_precision(a, b, theta).alias("precision"), (1 - b).alias("recall"))


def sharpe_ratio_symmetric(p: Value, n: Value) -> Column:
    return F.sqrt(col(n)) * (2 * col(p) - 1) / F.sqrt(4 * col(p) * (1 - col(p)))


def sharpe_ratio_asymmetric(p: Value, n: Value, sl: Value, pt: Value) -> Column:
    d = col(pt) - col(sl)
    return F.sqrt(col(n)) * (d * col(p) + col(sl)) / (d * F.sqrt(col(p) * (1 - col(p))))


def bin_hr(sl: Value, pt: Value, freq: Value, target_sr: Value) -> Column:
    """The precision that a target Sharpe ratio needs: the positive root of its quadratic."""
    s, d, n, t = col(sl), col(pt) - col(sl), col(freq), col(target_sr)
    a = (n + t * t) * d * d
    b = (2 * n * s - t * t * d) * d
    c = n * s * s
    return (-b + F.sqrt(b * b - 4 * a * c)) / (2 * a)


def implied_precision_symmetric(n: Value, target_sr: Value) -> Column:
    return bin_hr(-1.0, 1.0, n, target_sr)


def bin_freq(sl: Value, pt: Value, p: Value, target_sr: Value) -> Column:
    d = col(pt) - col(sl)
    return F.pow(col(target_sr) * d, 2) * col(p) * (1 - col(p)) / F.pow(d * col(p) + col(sl), 2)


def ou_half_life(phi: Value) -> Column:
    """Null outside (0, 1), where there is no half-life."""
    return F.when((col(phi) > 0) & (col(phi) < 1), -math.log(2) / F.log(col(phi)))


def log_uniform_cdf(x: Value, a: float, b: float) -> Column:
    return F.log(col(x) / a) / math.log(b / a)


def log_uniform_pdf(x: Value, a: float, b: float) -> Column:
    return 1 / (col(x) * math.log(b / a))


def log_uniform(a: float, b: float, seed: int) -> Column:
    """Random values whose logarithm is uniform between those of a and b."""
    return a * F.pow(F.lit(b / a), F.rand(seed))


def bagging_accuracy(n: int, p: float, k: int = 2) -> float:
    """Chance that more than one in k of n independent classifiers of accuracy p are right."""
    return 1 - sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(int(n / k) + 1))


def get_num_splits(n_groups: int, k: int) -> int:
    return math.comb(n_groups, k)


def get_num_backtest_paths(n_groups: int, k: int) -> int:
    return k * math.comb(n_groups, k) // n_groups


def lin_parts(atoms: int, parts: int) -> list[int]:
    """Bounds of equal parts."""
    n = min(parts, atoms)
    return [math.ceil(atoms * i / n) for i in range(n + 1)] if n else [0]


def nested_parts(atoms: int, parts: int, upper: bool = False) -> list[int]:
    """Bounds that give each part as much of a triangle's work; the heavy end first if ``upper``."""
    n, out = min(parts, atoms), [0.0]
    for _ in range(n):
        out.append((-1 + math.sqrt(1 + 4 * (out[-1] ** 2 + out[-1] + atoms * (atoms + 1) / n))) / 2)
    bounds = [round(x) for x in out]
    return [0, *accumulated([b - a for a, b in zip(bounds[:-1], bounds[1:], strict=True)][::-1])] if upper else bounds


def accumulated(widths: list[int]) -> list[int]:
    total, out = 0, []
    for w in widths:
        total += w
        out.append(total)
    return out


def mp_pdf(x: Value, var: float, q: float) -> Column:
    """Marchenko-Pastur density; 0 outside its bounds."""
    low, high = var * (1 - math.sqrt(1 / q)) ** 2, var * (1 + math.sqrt(1 / q)) ** 2
    inside = F.greatest((high - col(x)) * (col(x) - low), F.lit(0.0))
    return F.when((col(x) >= low) & (col(x) <= high), q / (2 * math.pi * var * col(x)) * F.sqrt(inside)).otherwise(F.lit(0.0))


def correl_dist(rho: Value) -> Column:
    return F.sqrt((1 - col(rho)) / 2)
