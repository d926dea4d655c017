"""Seeded random draws inside tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def beta_draws_udf(rounds: int):
    """``rounds`` Beta(a, b) draws for each row, from a generator seeded by the row's own key."""

    @F.pandas_udf("array<double>")
    def draws(a: pd.Series, b: pd.Series, key: pd.Series) -> pd.Series:
        out = []
        for x, y, k in zip(a, b, key):
            rng = np.random.Generator(np.random.PCG64(int(k) & ((1 << 63) - 1)))
            out.append(rng.beta(float(x), float(y), rounds))
        return pd.Series(out)

    return draws
