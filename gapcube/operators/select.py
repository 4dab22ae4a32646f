"""Exact "first k of every group" that survives a group holding a third of all rows.

A window over the whole group would put that group into one task. Here each level is a grouped count (map-side
combined) that narrows the cut to one bucket, and only the rows of the last bucket are ranked.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gapcube.session import written


#: Rows of a group's bucket that may be ranked in one window before it is narrowed further.
RANKED = 4096


def take_lowest(df: DataFrame, by: Sequence[str], levels: Sequence[Column], order: Sequence[Column],
                quota: Callable[[Column], Column]) -> DataFrame:
    """Rows of each group that come first in `order`, `quota(group size)` of them.

    `levels` are BIGINT bucket numbers that follow the same order, coarse to fine. The cut is narrowed until no group's
    bucket has more than RANKED rows; the last level bounds how many are ranked together.
    """
    by = list(by)
    names = [f"_l{i}" for i in range(len(levels))]
    work = df.select("*", *[lv.cast("bigint").alias(n) for lv, n in zip(levels, names)])
    cuts, fixed = None, []
    for name in names:
        rows = work if cuts is None else work.join(cuts, by).filter(
            F.expr(" AND ".join(f"{n} = _c{n}" for n in fixed)))
        carried = [f"_c{n}" for n in fixed] + (["_left"] if fixed else [])
        hist = rows.groupBy(*by, *carried, name).agg(F.count(F.lit(1)).alias("_n"))
        group = Window.partitionBy(*by)
        upto = group.orderBy(name).rowsBetween(Window.unboundedPreceding, 0)
        hist = hist.select("*", F.sum("_n").over(group).alias("_size"), F.sum("_n").over(upto).alias("_upto"))
        left = F.least(F.col("_left") if fixed else quota(F.col("_size")).cast("bigint"), F.col("_size"))
        cuts = hist.withColumn("_q", left).filter("_upto - _n < _q AND _q <= _upto").select(
            *by, *[f"_c{n}" for n in fixed], F.col(name).alias(f"_c{name}"), (F.expr("_q - _upto + _n")).alias("_left"), F.col("_n").alias("_rows"))
        fixed.append(name)
        cuts = written(cuts, "cuts")  # one row per group; a stored table has a known size
        if (cuts.agg(F.max("_rows")).first()[0] or 0) <= RANKED:
            break
    near = work.join(cuts, by)
    below, equal = F.lit(False), F.lit(True)
    for n in fixed:
        below = below | (equal & (F.col(n) < F.col(f"_c{n}")))
        equal = equal & (F.col(n) == F.col(f"_c{n}"))
    rank = F.row_number().over(Window.partitionBy(*by, *fixed).orderBy(*order))
    edge = near.filter(equal).withColumn("_rank", rank).filter("_rank <= _left").select(*df.columns)
    return near.filter(below).select(*df.columns).unionByName(edge)


def take_lowest_hash(df: DataFrame, by: Sequence[str], draw: str, tie: str, quota: Callable[[Column], Column]) -> DataFrame:
    """`take_lowest` for a 32-bit hash column: 65,536 even buckets, then the rows of one bucket by (draw, tie)."""
    return take_lowest(df, by, [F.shiftright(F.col(draw), 16)], [F.col(draw), F.col(tie)], quota)
