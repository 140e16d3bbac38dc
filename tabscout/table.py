"""A labelled table: the DataFrame, its target, and facts measured once."""

from __future__ import annotations

from dataclasses import dataclass, field as dataclass_field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscout.schema import as_number, as_text, column, is_fractional, measure_cells, missing


@dataclass(frozen=True)
class ColumnFacts:
    """Facts of one numeric column; as many records as the table has columns."""

    rows: int
    filled: int
    mean: float | None
    low: float | None
    high: float | None

    @property
    def constant(self) -> bool:
        return self.filled > 0 and self.low == self.high


@dataclass
class LabelledTable:
    """A DataFrame with a target column.

    ``key`` names the columns that identify a row; sampling, folds and ``head``
    semantics need it, because a distributed table has no row order of its own.
    Facts that other checks need (row count, column means) are measured at most
    once; each is one aggregate whose result is bounded by the schema.
    """

    df: DataFrame
    target: str
    key: tuple[str, ...] = ()
    name: str = "table"
    seed: int = 42
    shared: dict = dataclass_field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        self.key = tuple(self.key)
        absent = [c for c in (self.target, *self.key) if c not in self.df.columns]
        if absent:
            raise ValueError(f"columns not found in the table: {', '.join(absent)}")

    @property
    def spark(self):
        return self.df.sparkSession

    @cached_property
    def target_field(self) -> T.StructField:
        return self.df.schema[self.target]

    @cached_property
    def features(self) -> list[T.StructField]:
        return [f for f in self.df.schema if f.name != self.target]

    @cached_property
    def numeric(self) -> list[T.StructField]:
        return [f for f in self.features if isinstance(f.dataType, T.NumericType)]

    @cached_property
    def numeric_or_bool(self) -> list[T.StructField]:
        kinds = (T.NumericType, T.BooleanType)
        return [f for f in self.features if isinstance(f.dataType, kinds)]

    @cached_property
    def text(self) -> list[T.StructField]:
        return [f for f in self.features if isinstance(f.dataType, T.StringType)]

    @property
    def target_is_numeric(self) -> bool:
        return isinstance(self.target_field.dataType, (T.NumericType, T.BooleanType))

    @property
    def label(self) -> Column:
        """The target as a class label: STRING, NULL where it is missing."""
        return as_text(self.target_field)

    @property
    def target_number(self) -> Column:
        return as_number(self.target_field)

    @property
    def row_key(self) -> Column:
        """Text that identifies a row; the whole row where no key was named."""
        names = self.key or tuple(self.df.columns)
        fields = [self.df.schema[n] for n in names]
        return F.concat_ws("|", *[F.coalesce(as_text(f), F.lit("nan")) for f in fields])

    @cached_property
    def target_is_class(self) -> bool:
        """False for a target with fractional values, which no classifier accepts."""
        if not is_fractional(self.target_field.dataType):
            return True
        y = self.target_number
        found = self.df.agg(F.max((y != F.floor(y)).cast("int")).alias("f")).first()
        return not found["f"]

    @cached_property
    def numeric_facts(self) -> dict[str, ColumnFacts]:
        rows = measure_cells(
            self.df,
            {f.name: as_number(f) for f in self.numeric},
            lambda value: {
                "rows": F.count(F.lit(1)),
                "filled": F.count(value),
                "mean": F.avg(value),
                "low": F.min(value),
                "high": F.max(value),
            },
            "rows bigint, filled bigint, mean double, low double, high double",
        ).collect()
        found = {
            r["feature"]: ColumnFacts(r["rows"], r["filled"], r["mean"], r["low"], r["high"])
            for r in rows
        }
        # An empty table has no groups at all.
        nothing = ColumnFacts(0, 0, None, None, None)
        return {f.name: found.get(f.name, nothing) for f in self.numeric}

    @property
    def ends(self) -> dict[str, tuple[float, ...]]:
        """Numbers between which all cells of a numeric column lie, imputed ones included."""
        return {n: (x.low, x.high, x.mean) for n, x in self.numeric_facts.items() if x.filled}

    @cached_property
    def rows(self) -> int:
        facts = self.__dict__.get("numeric_facts")
        if facts:
            return next(iter(facts.values())).rows
        return self.df.count()

    @cached_property
    def classes(self) -> DataFrame:
        """One row per class, missing label excluded: ``class, n``."""
        return (
            self.df.groupBy(self.label.alias("class"))
            .agg(F.count(F.lit(1)).alias("n"))
            .where("class IS NOT NULL")
        )

    @cached_property
    def class_summary(self) -> dict:
        """Class count, extremes and row totals: one row whatever the class count."""
        per_class = self.df.groupBy(self.label.alias("class")).agg(F.count(F.lit(1)).alias("n"))
        known = F.col("class").isNotNull()
        row = per_class.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
            F.count("class").alias("classes"),
            F.min(F.when(known, F.col("n"))).alias("low"),
            F.max(F.when(known, F.col("n"))).alias("high"),
            F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("unlabelled"),
        ).first()
        return row.asDict()

    def imputed(self, f: T.StructField) -> Column:
        """A numeric cell with missing values replaced by the column mean."""
        facts = self.numeric_facts[f.name]
        cell = as_number(f)
        if facts.mean is None or facts.filled == facts.rows:
            return cell
        return F.coalesce(cell, F.lit(facts.mean))

    def labelled_rows(self) -> DataFrame:
        return self.df.where(~missing(self.target_field))

    def select_key(self) -> list[Column]:
        return [column(k) for k in self.key]

    def release(self) -> None:
        """Drops the counters that checks of this table share."""
        for kept in self.shared.values():
            if isinstance(kept, DataFrame):
                kept.unpersist()
        self.shared.clear()
