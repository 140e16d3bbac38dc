"""Row digests and hash order: reproducible whatever the partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabscout.schema import as_text, column

# Hex digits of the hash prefix whose histogram locates a sample's cut-off.
_PREFIX_DIGITS = 4


def row_md5(df: DataFrame, names: Sequence[str]) -> Column:
    """MD5 of the '|'-joined text of the named columns, missing written 'nan'."""
    parts = [F.coalesce(as_text(df.schema[n]), F.lit("nan")) for n in names]
    return F.md5(F.concat_ws("|", *parts).cast("binary"))


def row_hash64(names: Sequence[str]) -> Column:
    """An 8-byte digest that narrows candidates; equality is always re-checked."""
    return F.xxhash64(*[column(n) for n in names])


def seeded_md5(key: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key).cast("binary"))


def hash_fold(key: Column, seed: int, folds: int) -> Column:
    """Fold number from the key's digest: no shuffle, same in every run."""
    digits = F.substring(seeded_md5(key, seed), 1, 8)
    return F.pmod(F.conv(digits, 16, 10).cast("bigint"), F.lit(folds)).cast("int")


def first_by_hash(
    df: DataFrame, key: Column, quotas: DataFrame, seed: int, stratum: Column
) -> DataFrame:
    """The ``quota`` rows of each stratum whose seeded key digest is smallest.

    ``quotas`` is ``stratum, quota``. A histogram of digest prefixes, at most
    16**4 counters a stratum, finds the prefix at which each quota is reached:
    rows below it are taken as they are, and ranks are only needed among equal
    prefixes, so no window holds more than one prefix of one stratum. Rows
    travel as one struct, so columns of any name come back untouched.
    """
    digest = seeded_md5(key, seed)
    hashed = df.select(F.struct("*").alias("row"), stratum.alias("stratum"), digest.alias("digest")).withColumn(
        "prefix", F.substring("digest", 1, _PREFIX_DIGITS)
    )
    same = F.col("h.stratum").eqNullSafe(F.col("q.stratum"))
    histogram = hashed.groupBy("stratum", "prefix").agg(F.count(F.lit(1)).alias("n"))
    running = F.sum("n").over(
        W.partitionBy("stratum").orderBy("prefix").rowsBetween(W.unboundedPreceding, 0)
    )
    cuts = (
        histogram.alias("h")
        .join(quotas.alias("q"), same)
        .select("h.stratum", "prefix", "n", "quota")
        .withColumn("reached", running)
        .where(F.col("reached") - F.col("n") < F.col("quota"))
        .groupBy("stratum")
        .agg(
            F.max("prefix").alias("cut"),
            F.max_by(F.col("quota") - F.col("reached") + F.col("n"), "prefix").alias("wanted"),
        )
    )
    rank = F.row_number().over(W.partitionBy("stratum", "prefix").orderBy("digest"))
    return (
        hashed.alias("h")
        # One row per stratum with a quota; shuffled by stratum, a whole stratum would meet in one task.
        .join(F.broadcast(cuts).alias("q"), same & (F.col("h.prefix") <= F.col("q.cut")))
        .select("h.row", "h.stratum", "h.prefix", "h.digest", "q.cut", "q.wanted")
        .withColumn("rank", rank)
        .where((F.col("prefix") < F.col("cut")) | (F.col("rank") <= F.col("wanted")))
        .select("row.*")
    )
