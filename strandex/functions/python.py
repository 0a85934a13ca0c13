"""Scalar rules that have no built-in function, as Arrow-batched Python functions."""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, StringType


@F.pandas_udf(DecimalType(20, 0))
def _blake_number(texts: pd.Series) -> pd.Series:
    from decimal import Decimal

    return texts.map(lambda t: Decimal(int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big")), na_action="ignore")


def tie_breaker(key: Column, mode: Column, item: Column, seed: Column) -> Column:
    """An unsigned 64-bit number that orders ties at random, but always alike for the same key, mode, seed and item."""
    return _blake_number(F.concat_ws(":", key, mode, seed.cast("string"), item.cast("string")))


@F.pandas_udf(StringType())
def identity_text(texts: pd.Series) -> pd.Series:
    """Compatibility-decomposed and case-folded, without anything but word characters; for matching names."""
    return texts.map(lambda t: re.sub(r"\W+", "", unicodedata.normalize("NFKD", t).casefold()), na_action="ignore")


@F.pandas_udf(DoubleType())
def stored_duration(seconds: pd.Series) -> pd.Series:
    """Rounded to two places from the exact binary value, so 2.675 becomes 2.67."""
    return seconds.map(lambda x: round(float(x), 2), na_action="ignore")
