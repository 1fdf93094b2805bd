"""Small column helpers used across operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOAT_DIGITS = 6


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bucket(year, years: int = 10) -> Column:
    """Decade-style bucket ``floor(year / years) * years`` (null stays null)."""
    return (F.floor(col(year) / years) * years).cast("int")


def r6(c, digits: int = FLOAT_DIGITS) -> Column:
    """Round a float result to ``digits`` places as ``floor(x * 10^d + 0.501) / 10^d``.

    Plain IEEE arithmetic, identical in every engine. The boundary sits just
    below the decimal half-way point: results that are exact decimal ties
    (common with averages of decimal data) would otherwise round either way
    depending on the last bit left by the summation order. Magnitudes >= 1e12
    are returned unrounded."""
    x = col(c).cast("double")
    scale = float(10 ** digits)
    return F.when(F.abs(x) < 1e12, F.floor(x * scale + 0.501) / scale).otherwise(x)


def rounded(df: DataFrame) -> DataFrame:
    """Every double column by ``r6``: how queries state results. Operators return raw values."""
    return df.select(*[r6(f"`{n}`").alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])


def try_double(c) -> Column:
    """Lenient numeric parse: junk -> null, NaN -> null, surrounding blanks ok."""
    v = F.trim(col(c).cast("string")).try_cast("double")
    return F.nanvl(v, F.lit(None).cast("double"))


def try_long(c) -> Column:
    """Integer parse through double, cut towards zero ('12.5' is 12, '-12.5' is -12)."""
    return try_double(c).try_cast("bigint")


def pearson(a, b) -> Column:
    """Population Pearson r that yields null (not an error) on zero variance."""
    return F.try_divide(F.covar_pop(col(a), col(b)),
                        F.stddev_pop(col(a)) * F.stddev_pop(col(b)))
