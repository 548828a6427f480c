"""One meaning of "missing": SQL NULL. Float NaN is folded into it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRACTIONAL = (T.FloatType, T.DoubleType)
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, *FRACTIONAL)


def quoted(name: str) -> str:
    """A column name safe to use where Spark parses it (dots, spaces, backticks)."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def clean(df: DataFrame, name: str) -> Column:
    """The column with NaN read as NULL."""
    c = col(name)
    if isinstance(df.schema[name].dataType, FRACTIONAL):
        return F.nanvl(c, F.lit(None).cast(df.schema[name].dataType))
    return c


def present(df: DataFrame, name: str) -> Column:
    """Predicate "value is not missing". The null test alone reaches the Parquet reader."""
    c = col(name)
    if isinstance(df.schema[name].dataType, FRACTIONAL):
        return c.isNotNull() & ~F.isnan(c)
    return c.isNotNull()


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[clean(df, f.name).alias(f.name) for f in df.schema.fields])
