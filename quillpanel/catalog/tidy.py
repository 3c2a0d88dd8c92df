"""Reporting form of a result: stable types, rounded numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import rounded, rounded_price


def tidy(df: DataFrame, digits: int = 6, prices: tuple[str, ...] = (), exact: tuple[str, ...] = ()) -> DataFrame:
    """Doubles rounded, integers as BIGINT; ``prices`` get four digits, ``exact`` stay as they are."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in exact:
            out.append(c)
        elif f.name in prices:
            out.append(rounded_price(c).alias(f.name))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(rounded(c, digits).alias(f.name))
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            out.append(c.cast("bigint").alias(f.name))
        else:
            out.append(c)
    return df.select(*out)
