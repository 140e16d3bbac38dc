"""Each row with the row that follows it in a global order, without a global sort in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranges per shuffle partition: smaller ranges keep a window's buffer small.
RANGES_PER_PARTITION = 4


def in_ranges(df: DataFrame, key: str, ranges: int) -> tuple[Column, list]:
    """A column with the range of an integer key (null: 0), and the first key of each non-empty range.

    Cuts are approximate quantiles of the key over all rows, so ranges hold
    about the same number of rows. Both passes read the key alone, and the
    driver gets one number per range.
    """
    name = F.col(f"`{key}`")
    fractions = [i / ranges for i in range(1, ranges)] or [0.5]
    cuts = df.agg(F.percentile_approx(name, fractions, 20 * ranges).alias("cuts")).first().cuts or []
    cuts = F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast("array<bigint>")
    at = F.size(F.filter(cuts, lambda c: c <= name))
    firsts = df.groupBy(at.alias("range")).agg(F.min(name).alias("first"), F.bool_or(name.isNull()).alias("blank"))
    return at, [(r.range, None if r.blank else r.first) for r in firsts.orderBy("range").collect()]


def with_next(df: DataFrame, key: str, text: str, derive: Callable[[DataFrame], DataFrame], carry: str) -> DataFrame:
    """Rows in ascending ``key`` order (nulls first, ties by text), each with what its successor holds.

    First every row gets ``next_text``; ``derive`` then adds columns, among
    them ``carry``; last ``next_<carry>`` is the successor's ``carry``. The
    successor of the last row is the first. A range of keys is one window
    group; it also gets a copy of the first row of the next range (``halo``),
    dropped at the end, so texts are moved once.
    """
    ranges = RANGES_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at, firsts = in_ranges(df, key, ranges)
    name, before = F.col(f"`{key}`"), [-1] * ranges
    for (previous, _), (own, _) in zip([firsts[-1], *firsts[:-1]] if firsts else [], firsts, strict=True):
        before[own] = previous
    home = F.get(F.array(*[F.lit(x) for x in before]), at)
    present = [f for _, f in firsts if f is not None]
    chosen = name.isin(present) | name.isNull() if len(present) < len(firsts) else name.isin(present)
    rows = df.withColumn("range", at).withColumn("halo", F.lit(0)).unionByName(
        df.where(chosen).withColumn("range", home).withColumn("halo", F.lit(1))
    )
    order = W.partitionBy("range").orderBy("halo", F.col(f"`{key}`").asc_nulls_first(), F.col(f"`{text}`").asc_nulls_first())
    first_pass = derive(rows.withColumn("next_text", F.lead(text).over(order)))
    return first_pass.withColumn(f"next_{carry}", F.lead(carry).over(order)).where("halo = 0").drop("range", "halo")
