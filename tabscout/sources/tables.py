"""Reading labelled tables: one file, or a train and a test file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tabscout.table import LabelledTable


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, fmt: str | None = None
) -> DataFrame:
    """CSV (header, types inferred unless a schema is given), Parquet, ORC or JSON.

    Type inference reads a CSV twice; give a schema, or convert to Parquet once,
    for anything large.
    """
    fmt = fmt or path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        return reader.csv(path, header=True, inferSchema=schema is None, enforceSchema=False, escape='"')
    if fmt in ("parquet", "orc", "json"):
        return reader.format(fmt).load(path)
    raise ValueError(f"unsupported format: {fmt}")


def load_labelled(
    spark: SparkSession,
    path: str,
    target: str,
    key: Sequence[str] = (),
    name: str | None = None,
    schema: T.StructType | str | None = None,
) -> LabelledTable:
    """One labelled table; the target must exist."""
    return LabelledTable(read_table(spark, path, schema), target, tuple(key), name or path)


def load_split(
    spark: SparkSession,
    train_path: str,
    test_path: str,
    target: str,
    key: Sequence[str] = (),
    name: str | None = None,
    schema: T.StructType | str | None = None,
) -> tuple[LabelledTable, DataFrame, DataFrame]:
    """The union to audit, plus the train and test tables; the target must be in both."""
    train = read_table(spark, train_path, schema)
    test = read_table(spark, test_path, schema)
    for side, df in (("train", train), ("test", test)):
        if target not in df.columns:
            raise ValueError(f"target column '{target}' not found in the {side} table")
    both = train.unionByName(test, allowMissingColumns=True)
    return LabelledTable(both, target, tuple(key), name or train_path), train, test
