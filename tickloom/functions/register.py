"""Names for spark.sql users."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tickloom.functions.statistics import NORMAL, phi, t_cdf
from tickloom.operators.entropy import kontoyiannis, lempel_ziv_udf


def register(spark: SparkSession) -> list[str]:
    """Registers norm_cdf, norm_ppf, t_cdf, konto_h and lempel_ziv for the session."""

    @F.pandas_udf("double")
    def norm_cdf(x: pd.Series) -> pd.Series:
        return pd.Series(phi(x.to_numpy(float)), index=x.index).where(x.notna())

    @F.pandas_udf("double")
    def norm_ppf(p: pd.Series) -> pd.Series:
        return p.map(lambda v: NORMAL.inv_cdf(v) if v == v and 0 < v < 1 else float("nan"))

    @F.pandas_udf("double")
    def student_cdf(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([t_cdf(a, b) for a, b in zip(t, df, strict=True)])

    @F.pandas_udf("double")
    def konto_h(m: pd.Series) -> pd.Series:
        return m.map(lambda x: kontoyiannis(x or "")[3])

    found = {"norm_cdf": norm_cdf, "norm_ppf": norm_ppf, "t_cdf": student_cdf, "konto_h": konto_h, "lempel_ziv": lempel_ziv_udf()}
    for name, f in found.items():
        spark.udf.register(name, f)
    return list(found)
