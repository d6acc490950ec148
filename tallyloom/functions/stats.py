"""Two-proportion z-test as column arithmetic."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def two_tailed_p(z: pd.Series) -> pd.Series:
    """Two-tailed normal p-value; stable far in the tail. Meant for result rows."""
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)), na_action="ignore")


def pooled_z(n_a: Column, x_a: Column, n_b: Column, x_b: Column) -> Column:
    """z statistic of ``x_b/n_b - x_a/n_a`` with pooled variance; 0 without variance.

    NULL when an arm is empty.
    """
    n_a, x_a, n_b, x_b = (c.cast("double") for c in (n_a, x_a, n_b, x_b))
    pooled = F.try_divide(x_a + x_b, n_a + n_b)
    error = F.sqrt(pooled * (F.lit(1.0) - pooled) * (F.try_divide(F.lit(1.0), n_a) + F.try_divide(F.lit(1.0), n_b)))
    lift = F.try_divide(x_b, n_b) - F.try_divide(x_a, n_a)
    return F.when(error > 0, lift / error).when(lift.isNotNull(), F.lit(0.0))
