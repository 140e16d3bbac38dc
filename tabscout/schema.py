"""Column classification, missing-value rules and the findings schema."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FINDINGS = T.StructType(
    [
        T.StructField("dataset", T.StringType()),
        T.StructField("tool", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("feature", T.StringType()),
        T.StructField("feature2", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("metric", T.DoubleType()),
        T.StructField("evidence", T.StringType()),
    ]
)

# A condition on a measurement row and the finding it gives.
Rule = tuple[Column, list[Column]]

# The five check families, in the order an audit runs them.
TOOLS = (
    "leakage_detector",
    "contamination_detector",
    "bias_detector",
    "spurious_detector",
    "feature_utility",
)

# This many columns are aggregated side by side in one pass; a wider table is measured
# in several, each of which prunes the scan to its own columns.
COLUMNS_PER_AGGREGATE = 4


def column(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_fractional(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.FloatType, T.DoubleType))


def missing(field: T.StructField) -> Column:
    """True where the cell is NULL or NaN."""
    cell = column(field.name)
    return cell.isNull() | F.isnan(cell) if is_fractional(field.dataType) else cell.isNull()


def as_number(field: T.StructField) -> Column:
    """The cell as DOUBLE with NaN turned into NULL and -0.0 into 0.0."""
    cell = column(field.name)
    if isinstance(field.dataType, T.BooleanType):
        cell = cell.cast("int")
    cell = cell.cast("double")
    if is_fractional(field.dataType):
        cell = F.nanvl(cell, F.lit(None).cast("double")) + F.lit(0.0)
    return cell


def as_text(field: T.StructField) -> Column:
    """The cell as STRING with NaN turned into NULL, for value counting."""
    if is_fractional(field.dataType):
        return as_number(field).cast("string")
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(column(field.name))
    return column(field.name).cast("string")


def empty(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(lambda left, right: left.unionByName(right), frames)


def blocks(items: Sequence, size: int) -> list[Sequence]:
    return [items[i : i + size] for i in range(0, len(items), size)]


def measure_cells(
    df: DataFrame,
    cells: dict[str, Column],
    aggregates: Callable[[Column], dict[str, Column]],
    schema: str,
    keep: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per cell name holding its ``aggregates`` over the cells (and ``keep``); none for an empty table.

    Columns stay side by side, so no row is multiplied and no cell is looked up in
    a hash table; a task hands on one row. Every block of columns is a scan
    of those columns only, and few enough that the JVM compiles its loop.
    """
    if not cells:
        return empty(df.sparkSession, f"feature string, {schema}")
    parts = []
    for block in blocks(list(cells), COLUMNS_PER_AGGREGATE):
        own = [f"__cell_{i}" for i in range(len(block))]
        wide = df.select(*[c.alias(k) for k, c in (keep or {}).items()], *[cells[n].alias(c) for n, c in zip(block, own)])
        measured = [F.struct(*[e.alias(k) for k, e in aggregates(F.col(c)).items()]).alias(c) for c in own]
        held = wide.agg(F.count(F.lit(1)).alias("__rows"), *measured).where("__rows > 0")
        named = [F.struct(F.lit(n).alias("feature"), F.col(f"{c}.*")) for n, c in zip(block, own)]
        parts.append(held.select(F.inline(F.array(*named))))
    return union_all(parts)


def melt(
    df: DataFrame,
    cells: dict[str, Column],
    keep: dict[str, Column] | None = None,
) -> DataFrame:
    """Long form ``keep..., feature, value``: one row per named cell.

    Cells and kept columns are computed once per input row, below the unpivot,
    and not once per output row.
    """
    keep = keep or {}
    kept = [f"__kept_{i}" for i in range(len(keep))]
    wide = df.select(
        *[c.alias(k) for c, k in zip(keep.values(), kept)],
        *[cell.alias(name) for name, cell in cells.items()],
    )
    long = wide.unpivot(kept, [column(name) for name in cells], "feature", "value")
    return long.select(*[F.col(k).alias(n) for k, n in zip(kept, keep)], "feature", "value")


def finding(
    tool: str,
    kind: Column | str,
    severity: Column | str,
    message: Column,
    metric: Column,
    evidence: Column,
    feature: Column | None = None,
    feature2: Column | None = None,
    dataset: str = "table",
) -> list[Column]:
    """Columns of one finding row, in ``FINDINGS`` order; ``evidence`` is a struct."""

    def text(value: Column | str) -> Column:
        return F.lit(value) if isinstance(value, str) else value

    none = F.lit(None).cast("string")
    return [
        F.lit(dataset).alias("dataset"),
        F.lit(tool).alias("tool"),
        text(kind).alias("type"),
        text(severity).alias("severity"),
        (none if feature is None else feature).alias("feature"),
        (none if feature2 is None else feature2).alias("feature2"),
        message.alias("message"),
        metric.cast("double").alias("metric"),
        F.to_json(evidence).alias("evidence"),
    ]


def emit(measure: DataFrame, *rules: Rule) -> DataFrame:
    """Findings of every rule that holds on a row of a measurement table.

    All rules are applied in one pass, so the measurement is computed once.
    """
    fired = [F.when(condition, F.struct(*columns)) for condition, columns in rules]
    return measure.select(F.inline(F.array_compact(F.array(*fired))))
