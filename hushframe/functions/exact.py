"""Rounding as Python does it, on the exact binary value: the built-in functions round the shortest decimal form."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def round4(x: Column | str) -> Column:
    """x to 4 places, halves to even, in Arrow batches."""
    return F.pandas_udf(_round4, "double")(x)


def _round4(x: pd.Series) -> pd.Series:
    return x.map(lambda v: round(v, 4), na_action="ignore").astype("float64")
