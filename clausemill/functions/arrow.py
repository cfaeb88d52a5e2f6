"""Text functions that Spark lacks, as vectorised Python functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def compatible(texts: pd.Series) -> pd.Series:
    """NFKC form; null stays null."""
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.StringType())
def letters_only(texts: pd.Series) -> pd.Series:
    """NFKD form without anything beyond ASCII; null stays null."""
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())
