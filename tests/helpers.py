from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pandas as pd

DAY0 = date(2024, 1, 1)


def day(i: int) -> date:
    return DAY0 + timedelta(days=i)


def panel(spark, paths: dict[str, list], column: str = "close"):
    """Rows from asset -> list of values on consecutive days; None is a missing value, 'skip' a missing row."""
    rows = [(day(i), a, v) for a, vs in paths.items() for i, v in enumerate(vs) if v != "skip"]
    return spark.createDataFrame(rows, f"date date, asset string, {column} double")


def factor_table(spark, rows):
    return spark.createDataFrame(rows, "date date, asset string, factor string, value double")


def random_prices(spark, assets: int, days: int, seed: int = 7):
    rng = np.random.default_rng(seed)
    walk = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, (days, assets)), axis=0))
    rows = [(day(i), f"a{j:02d}", float(walk[i, j])) for i in range(days) for j in range(assets)]
    return spark.createDataFrame(rows, "date date, asset string, close double")


def frame(df, *order) -> pd.DataFrame:
    out = df.toPandas()
    return out.sort_values(list(order)).reset_index(drop=True) if order else out


def values(df, *order, col: str = "value") -> list:
    return [None if pd.isna(v) else v for v in frame(df, *order)[col]]
