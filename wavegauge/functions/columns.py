"""Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def require_columns(df: DataFrame, required, what: str) -> None:
    """Raise before any job runs when a table lacks columns."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing columns: {missing}")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating column, so that aggregates skip it."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def ratio(num: Column, den: Column) -> Column:
    """num / den, NULL when the denominator is 0."""
    return F.when(den != 0, num / den)


def db_mean(c: str) -> Column:
    """Mean of decibel values taken on the linear power scale."""
    return 10 * F.log10(F.avg(F.pow(F.lit(10.0), F.col(c) / 10)))


def draw(key: Column, n: Column) -> Column:
    """Uniform integer in [0, n) from the MD5 of a text key: repeatable on any engine."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % n


def id_list(c: str) -> Column:
    """Parse an id scope: NULL, empty or 'all' means everything (NULL), else an integer array."""
    text = F.lower(F.trim(F.col(c)))
    parts = F.filter(F.transform(F.split(F.col(c), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(text.isNull() | (text == "") | (text == "all"), F.lit(None)).otherwise(
        F.transform(parts, lambda x: x.cast("int"))
    )


def tag_list(c: str) -> Column:
    """Parse a comma list of tags into an array; NULL gives an empty array."""
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return parts
