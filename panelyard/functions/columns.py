"""Null-safe column expressions.

Missing values are NULL everywhere in this package: NaN is turned into NULL at the
entrance (``clean``) and every division goes through ``try_divide`` because ANSI mode
raises on a zero divisor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c: Column | str) -> Column:
    """Double with NaN replaced by NULL."""
    return F.nanvl(as_col(c).cast("double"), F.lit(None).cast("double"))


def number(c: Column | str) -> Column:
    """Numeric cast that yields NULL for text which is not a number."""
    return F.nanvl(as_col(c).try_cast("double"), F.lit(None).cast("double"))


def ratio(num: Column, den: Column) -> Column:
    return F.try_divide(num.cast("double"), den.cast("double"))


def ieee_ratio(num: Column, den: Column) -> Column:
    """Quotient of doubles with +-inf, or NaN for 0 / 0, where the divisor is 0; NULL only where a side is NULL."""
    beyond = F.when(num > 0, float("inf")).when(num < 0, float("-inf")).when(num == 0, float("nan"))
    return F.when(den == 0, beyond).otherwise(F.try_divide(num, den))


def gated(value: Column, count: Column, minimum: int) -> Column:
    """``value`` where at least ``minimum`` observations back it."""
    return F.when(count >= minimum, value)


def flag(c: Column | str) -> Column:
    """Boolean with a missing value read as false."""
    return F.coalesce(as_col(c).cast("boolean"), F.lit(False))


def pair_corr(x: Column, y: Column, min_pairs: int = 2) -> Column:
    """Pearson correlation of complete pairs; NULL when a side is constant.

    ``corr`` itself raises on a constant column under ANSI, so the ratio is formed by hand
    and guarded by min < max (float noise can leave a tiny non-zero deviation).
    """
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    usable = (F.count(a) >= min_pairs) & (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    return F.when(usable, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def rounded(df: DataFrame, digits: int = 8, **overrides: int) -> DataFrame:
    """Round every double column of a final result for presentation."""
    return df.select(
        *[
            F.round(F.col(f.name), overrides.get(f.name, digits)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )
