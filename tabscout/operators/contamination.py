"""Duplicate rows and overlap between a train and a test split."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscout.functions.hashing import row_hash64, row_md5
from tabscout.functions.lineage import stored
from tabscout.functions.metric import Limits, near_rows
from tabscout.schema import FINDINGS, as_number, column, empty, finding, union_all

TOOL = "contamination_detector"


def _share(count: Column, total: Column) -> Column:
    return F.try_divide(count * 100.0, total)


def _one_row(parts: Sequence[DataFrame]) -> DataFrame:
    """Add up single-row frames that share their columns."""
    total = union_all(parts)
    return total.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in total.columns])


#: log2 of the bits of the filter that rows pass before they are grouped by their columns.
FILTER_BITS = 25
_WORD = 63


def _place(digest: Column) -> dict[str, Column]:
    """Which bit of the filter a digest is: its leading bits, as a word and a bit of the word."""
    at = F.shiftrightunsigned(digest, 64 - FILTER_BITS)
    return {"_word": F.floor(at / _WORD).cast("int"), "_bit": (at % _WORD).cast("int")}


def _behind(rows: DataFrame, digests: DataFrame) -> DataFrame:
    """Rows whose digest ``_h`` is among ``digests``, and few others, without a shuffle.

    The digests become a bit filter of fixed size: at most 2 ** FILTER_BITS / 63 words
    of two numbers (8 MB), whatever the tables, so it may be broadcast. Rows that
    pass it by chance are told apart by the grouping that follows.
    """
    words = digests.withColumns(_place(F.col("_h"))).groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_held"))
    passed = rows.withColumns(_place(F.col("_h"))).join(F.broadcast(words), "_word")
    return passed.where(F.expr("(_held & shiftleft(1L, _bit)) <> 0")).drop("_word", "_bit", "_held")


def measure_duplicates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``total, count, percentage``: rows beyond the first of each distinct row.

    The shuffle of the whole table carries 8-byte digests only, pre-aggregated
    per task. Rows behind a repeated digest are grouped by digest and real columns
    in the task that reads them, so a row repeated any number of times leaves a task once; the
    grouping makes the count exact.
    """
    names = list(columns or df.columns)
    hashed = df.select(*[column(n) for n in names]).withColumn("_h", row_hash64(names))
    digests = stored(hashed.groupBy("_h").agg(F.count(F.lit(1)).alias("n")))
    suspects = digests.where("n > 1").select("_h")
    copies = _behind(hashed, suspects).groupBy("_h", *[column(n) for n in names]).agg(F.count(F.lit(1)).alias("n"))
    total = digests.select(F.col("n").alias("total"), F.lit(0).cast("bigint").alias("count"))
    beyond = copies.where("n > 1").select(F.lit(0).cast("bigint").alias("total"), (F.col("n") - 1).alias("count"))
    return _one_row([total, beyond]).withColumn("percentage", _share(F.col("count"), F.col("total")))


def flag_duplicates(measure: DataFrame, split: str, dataset: str = "table") -> DataFrame:
    where = {"train": "training", "test": "test"}[split]
    return measure.where("count > 0").select(
        *finding(
            TOOL,
            f"exact_duplicates_{split}",
            "warning",
            F.format_string(f"Found %d exact duplicate rows in {where} set (%.2f%%)", "count", "percentage"),
            F.col("percentage"),
            F.struct("count", "percentage"),
            dataset=dataset,
        )
    )


def aligned(train: DataFrame, test: DataFrame, columns: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both splits with the train columns, in one type per column."""
    names = list(columns or train.columns)
    left, right = [], []
    for n in names:
        a, b = train.schema[n].dataType, test.schema[n].dataType
        if a == b:
            kind = None
        elif isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
            kind = "double"
        else:
            kind = "string"
        left.append(column(n) if kind is None else column(n).cast(kind).alias(n))
        right.append(column(n) if kind is None else column(n).cast(kind).alias(n))
    return train.select(*left), test.select(*right), names


def measure_exact_overlap(train: DataFrame, test: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``total, count, percentage``: test rows that also occur in train.

    Distinct digests of both sides meet first; only rows behind a common digest
    are compared on their real columns (NULL equals NULL). Both sides are grouped by
    digest and columns in the task that reads them, before anything moves, so
    a row repeated any number of times leaves a task once.
    """
    train, test, names = aligned(train, test, columns)
    train = train.withColumn("_h", row_hash64(names))
    test = test.withColumn("_h", row_hash64(names))
    in_train = train.groupBy("_h").agg(F.lit(1).alias("one")).select("_h")
    digests = stored(test.groupBy("_h").agg(F.count(F.lit(1)).alias("n")))
    suspects = stored(digests.join(in_train, "_h", "left_semi").select("_h"))
    wanted = [column(n) for n in names]
    test_rows = _behind(test, suspects).groupBy("_h", *wanted).agg(F.count(F.lit(1)).alias("n"))
    train_rows = _behind(train, suspects).select("_h", *wanted).distinct()
    equal = reduce(
        lambda a, b: a & b,
        [F.col(f"a.`{n.replace('`', '``')}`").eqNullSafe(F.col(f"b.`{n.replace('`', '``')}`")) for n in names],
    )
    matched = test_rows.alias("a").join(
        train_rows.alias("b"), (F.col("a._h") == F.col("b._h")) & equal, "left_semi"
    )
    zero = F.lit(0).cast("bigint")
    return _one_row(
        [
            digests.select(F.col("n").alias("total"), zero.alias("count")),
            matched.select(zero.alias("total"), F.col("n").alias("count")),
        ]
    ).withColumn("percentage", _share(F.col("count"), F.col("total")))


def measure_hash_overlap(train: DataFrame, test: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``total, count, percentage``: test rows whose text digest is in train."""
    names = list(columns or train.columns)
    seen = train.select(row_md5(train, names).alias("digest")).distinct()
    tested = test.groupBy(row_md5(test, names).alias("digest")).agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("bigint")
    return _one_row(
        [
            tested.select(F.col("n").alias("total"), zero.alias("count")),
            tested.join(seen, "digest", "left_semi").select(zero.alias("total"), F.col("n").alias("count")),
        ]
    ).withColumn("percentage", _share(F.col("count"), F.col("total")))


def measure_key_overlap(train: DataFrame, test: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``total, count, percentage``: distinct test keys that train also has."""
    names = [column(k) for k in keys]
    tested = test.select(*names).distinct()
    common = train.select(*names).intersect(test.select(*names))
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    return _one_row(
        [
            tested.select(one.alias("total"), zero.alias("count")),
            common.select(zero.alias("total"), one.alias("count")),
        ]
    ).withColumn("percentage", _share(F.col("count"), F.col("total")))


def flag_exact_overlap(measure: DataFrame, dataset: str = "table") -> DataFrame:
    return measure.where("count > 0").select(
        *finding(
            TOOL,
            "train_test_contamination",
            "critical",
            F.format_string(
                "Found %d exact matches between train and test sets (%.2f%% of test set)", "count", "percentage"
            ),
            F.col("percentage"),
            F.struct("count", "percentage"),
            dataset=dataset,
        )
    )


def flag_hash_overlap(measure: DataFrame, min_percentage: float = 0.1, dataset: str = "table") -> DataFrame:
    return measure.where((F.col("count") > 0) & (F.col("percentage") > min_percentage)).select(
        *finding(
            TOOL,
            "hash_contamination",
            "critical",
            F.format_string("Hash-based detection found %d potential duplicates between train and test", "count"),
            F.col("percentage"),
            F.struct("count", "percentage"),
            dataset=dataset,
        )
    )


def flag_key_overlap(measure: DataFrame, dataset: str = "table") -> DataFrame:
    return measure.where("count > 0").select(
        *finding(
            TOOL,
            "duplicate_indices",
            "warning",
            F.format_string(
                "Found %d overlapping index values between train and test sets (%.2f%%)", "count", "percentage"
            ),
            F.col("percentage"),
            F.struct("count", "percentage"),
            dataset=dataset,
        )
    )


# --- near duplicates -------------------------------------------------------


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def _numbers(df: DataFrame, names: Sequence[str], moments: dict[str, tuple[float, float]] | None) -> Column:
    """ARRAY<DOUBLE> of the named columns: own mean imputed, optionally scaled."""
    own = df.agg(*[F.avg(as_number(df.schema[n])).alias(f"c{i}") for i, n in enumerate(names)]).first()
    cells = []
    for i, n in enumerate(names):
        cell = as_number(df.schema[n])
        if own[i] is not None:
            cell = F.coalesce(cell, F.lit(own[i]))
        if moments is not None:
            mean, sd = moments[n]
            cell = (cell - F.lit(mean)) / F.lit(sd)
        cells.append(cell)
    return F.array(*cells)


def _moments(df: DataFrame, names: Sequence[str]) -> dict[str, tuple[float, float]]:
    aggs = [e for n in names for e in (F.avg(as_number(df.schema[n])), F.stddev_pop(as_number(df.schema[n])))]
    row = df.agg(*[a.alias(f"m{i}") for i, a in enumerate(aggs)]).first()
    return {n: (row[2 * i] or 0.0, row[2 * i + 1] or 1.0) for i, n in enumerate(names)}


def _unit(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(vector, lambda x: x / norm)).otherwise(vector)


def _dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def unit_vectors(
    train: DataFrame,
    test: DataFrame,
    columns: Sequence[str] | None = None,
    vector: str | None = None,
    standardize: bool = False,
) -> tuple[DataFrame, DataFrame] | None:
    """Both splits as one column ``u`` of unit vectors; None below two numbers."""
    if vector is not None:
        return tuple(
            df.select(_unit(column(vector).cast("array<double>")).alias("u")) for df in (train, test)
        )
    names = list(columns or numeric_columns(train))
    if len(names) < 2:
        return None
    moments = _moments(train, names) if standardize else None
    return tuple(df.select(_unit(_numbers(df, names, moments)).alias("u")) for df in (train, test))


def measure_near_duplicates_head(
    train: DataFrame,
    test: DataFrame,
    key: Sequence[str],
    rows: int = 1000,
    threshold: float = 0.95,
    columns: Sequence[str] | None = None,
    vector: str | None = None,
    standardize: bool = False,
) -> DataFrame:
    """Spot check of ``rows`` rows of each split, those whose key digest is smallest.

    ``total, count, percentage, threshold, avg_similarity``. Both sides are
    bounded by the parameter, so the train side travels as one array value.
    Rows that neighbour each other in some order would be too alike, hence the
    digest; it needs ``key``.
    """
    if not key:
        raise ValueError("a spot check draws rows by key: name the key columns")
    train, test = (
        side.orderBy(row_md5(side, list(key)), *[column(k) for k in key]).limit(rows) for side in (train, test)
    )
    sides = unit_vectors(train, test, columns, vector, standardize)
    if sides is None:
        return empty(
            train.sparkSession,
            "total bigint, count bigint, percentage double, threshold double, avg_similarity double",
        )
    a, b = sides
    best = F.array_max(F.transform("train_units", lambda v: _dot(F.col("u"), v)))
    compared = (
        b.repartition(b.sparkSession.sparkContext.defaultParallelism)
        .withColumn("train_units", a.agg(F.collect_list("u")).scalar())
        .select(best.alias("similarity"))
        .where("similarity IS NOT NULL")
    )
    return compared.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("similarity") >= threshold).alias("count"),
        F.avg("similarity").alias("avg_similarity"),
    ).select(
        "total",
        "count",
        _share(F.col("count"), F.col("total")).alias("percentage"),
        F.lit(threshold).alias("threshold"),
        "avg_similarity",
    )


def measure_near_duplicates(
    train: DataFrame,
    test: DataFrame,
    threshold: float = 0.95,
    columns: Sequence[str] | None = None,
    vector: str | None = None,
    standardize: bool = False,
    limits: Limits = Limits(),
) -> DataFrame:
    """``total, count, percentage, threshold, pairs`` over whole splits, exactly.

    Test rows are near-duplicates if their cosine to some train row is at least
    ``threshold``. Copies are removed from both sides first; the distinct
    directions meet in cells around centres, see ``near_rows``. ``pairs`` is how
    many of them were compared. A vector that is zero, null or not finite
    throughout counts as a row and is similar to none.
    """
    schema = "total bigint, count bigint, percentage double, threshold double, pairs bigint"
    sides = unit_vectors(train, test, columns, vector, standardize)
    if sides is None:
        return empty(train.sparkSession, schema)
    whole = sides[1]
    directed = F.exists("u", lambda x: x != 0) & F.forall("u", lambda x: x.isNotNull() & (F.abs(x) <= 1.5))
    a, b = (s.where(directed) for s in sides)
    rows = stored(b.groupBy("u").agg(F.count(F.lit(1)).alias("n")).withColumn("id", F.monotonically_increasing_id()))
    near = stored(near_rows(a.distinct(), rows.select("id", "u"), threshold, limits))
    zero = F.lit(0).cast("bigint")
    matched = rows.join(near.select("id").where("id IS NOT NULL").distinct(), "id", "left_semi")
    return _one_row(
        [
            whole.agg(F.count(F.lit(1)).alias("total")).select("total", zero.alias("count"), zero.alias("pairs")),
            matched.select(zero.alias("total"), F.col("n").alias("count"), zero.alias("pairs")),
            near.select(zero.alias("total"), zero.alias("count"), "pairs"),
        ]
    ).select(
        "total",
        "count",
        _share(F.col("count"), F.col("total")).alias("percentage"),
        F.lit(threshold).alias("threshold"),
        "pairs",
    )


def flag_near_duplicates(measure: DataFrame, mild_below: float = 5.0, dataset: str = "table") -> DataFrame:
    extra = ["avg_similarity"] if "avg_similarity" in measure.columns else []
    return measure.where("count > 0").select(
        *finding(
            TOOL,
            "near_duplicates",
            F.when(F.col("percentage") < mild_below, "warning").otherwise("critical"),
            F.format_string(
                "Found %d near-duplicate samples (similarity >= %s) in test set",
                "count",
                F.col("threshold").cast("string"),
            ),
            F.col("percentage"),
            F.struct("count", "percentage", "threshold", *extra),
            dataset=dataset,
        )
    )


def check_contamination(
    train: DataFrame,
    test: DataFrame | None = None,
    key: Sequence[str] = (),
    near_rows: int | None = None,
    standardize: bool = False,
    dataset: str = "table",
) -> DataFrame:
    """All contamination findings; without a test split only train duplicates.

    Near duplicates are sought in the whole splits; ``near_rows`` asks for a spot
    check of so many rows of each instead, drawn by a digest of ``key``. Key
    overlap is reported only for columns named in ``key``.
    """
    parts = [flag_duplicates(measure_duplicates(train), "train", dataset)]
    if test is not None:
        parts.append(flag_duplicates(measure_duplicates(test), "test", dataset))
        parts.append(flag_exact_overlap(measure_exact_overlap(train, test), dataset))
        parts.append(flag_hash_overlap(measure_hash_overlap(train, test), dataset=dataset))
        if near_rows is None:
            near = measure_near_duplicates(train, test, standardize=standardize)
        else:
            near = measure_near_duplicates_head(train, test, key, near_rows, standardize=standardize)
        parts.append(flag_near_duplicates(near, dataset=dataset))
        if key:
            parts.append(flag_key_overlap(measure_key_overlap(train, test, key), dataset))
    return union_all(parts) if parts else empty(train.sparkSession, FINDINGS)


def split_sizes(train: DataFrame, test: DataFrame | None = None) -> DataFrame:
    """``train_size, test_size``: one row."""
    zero = F.lit(0).cast("bigint")
    one = F.lit(1).cast("bigint")
    parts = [train.select(one.alias("train_size"), zero.alias("test_size"))]
    if test is not None:
        parts.append(test.select(zero.alias("train_size"), one.alias("test_size")))
    return _one_row(parts)
