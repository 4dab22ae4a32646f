"""Column formulas shared by the operators. Counts are cast to DOUBLE before dividing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dbl(x) -> Column:
    return col(x).cast("double")


def ratio(num, den, empty=0.0) -> Column:
    """num / den as DOUBLE, and a fixed value where den is 0."""
    return F.when(dbl(den) != 0, dbl(num) / dbl(den)).otherwise(F.lit(empty).cast("double"))


def f1(tp="tp", fp="fp", fn="fn") -> Column:
    """Per-class F1 with zero where the class is neither true nor predicted."""
    return ratio(2.0 * dbl(tp), 2.0 * dbl(tp) + dbl(fp) + dbl(fn))


def r9(x) -> Column:
    """Nine decimals without a negative zero, so that results compare across engines."""
    return F.round(dbl(x), 9) + F.lit(0.0)


def rounded(df, *keep):
    """Round every DOUBLE column of a result."""
    return df.select(*[r9(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def hash32(*parts) -> Column:
    """Deterministic 32-bit draw from the parts joined by '|'; the same integer in every engine with md5."""
    return hash_of(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(p) for p in parts]))


def hash_of(text: Column) -> Column:
    """The same draw from a whole text; concat() makes one faster than concat_ws() does."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
