"""Labelled tables, findings and audit histories derived from the shared tables.

They give every operator a real input whose size follows the source tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabscout.operators.profile import complexity_score
from tabscout.schema import TOOLS
from tabscout.table import LabelledTable

# Each event type stands for one check in the derived findings and histories.
EVENT_TOOLS = {
    "view": "leakage_detector",
    "click": "contamination_detector",
    "signup": "bias_detector",
    "purchase": "spurious_detector",
    "error": "feature_utility",
}
# Per event type: finding types by value, highest limit first.
EVENT_FINDINGS = {
    "view": ((100, "identical_to_target"), (40, "perfect_correlation"), (None, "suspicious_name")),
    "click": ((100, "train_test_contamination"), (40, "near_duplicates"), (None, "exact_duplicates_train")),
    "signup": (
        (100, "severe_imbalance"),
        (60, "small_class_size"),
        (20, "missing_value_bias"),
        (None, "extreme_skewness"),
    ),
    "purchase": (
        (80, "single_feature_dominance"),
        (30, "simple_threshold_rule"),
        (None, "concentrated_importance"),
    ),
    "error": ((80, "constant_feature"), (30, "redundant_features"), (None, "low_information_feature")),
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LINE_FEATURES = """
    CAST(l_returnflag = 'R' AS INT) AS target,
    l_returnflag AS target3,
    CAST(l_returnflag = 'R' AS INT) AS leak,
    3 * CAST(l_returnflag = 'R' AS INT) + 2 AS leak_lin,
    1 AS const_col,
    CAST(l_orderkey % 50 = 0 AS INT) AS near_const,
    CASE WHEN l_returnflag = 'R' AND l_linenumber <= 3 THEN NULL ELSE l_tax END AS miss,
    power(l_quantity / 50, 60) AS skewed,
    l_quantity, l_extendedprice, l_discount, l_tax, l_linenumber
"""


def line_audit(spark: SparkSession, sf_dir: str, three_classes: bool = False) -> LabelledTable:
    """``lineitem`` with planted leaks, constants, gaps and skew; no row key."""
    df = read(spark, sf_dir, "lineitem").selectExpr(*_split(LINE_FEATURES))
    other, target = ("target", "target3") if three_classes else ("target3", "target")
    return LabelledTable(df.drop(other), target, name="lineitem")


def _split(select_list: str) -> list[str]:
    """Top-level items of a SELECT list."""
    items, depth, current = [], 0, ""
    for ch in select_list:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            items.append(current.strip())
            current = ""
        else:
            current += ch
    return [*items, current.strip()]


ORDER_FEATURES = """
    o_orderkey,
    CAST(o_totalprice > 250000 AS INT) AS target,
    o_totalprice AS shortcut,
    o_custkey AS custkey,
    CAST(substring(o_orderpriority, 1, 1) AS INT) AS prio,
    CAST(month(o_orderdate) AS INT) AS mon
"""


def order_audit(spark: SparkSession, sf_dir: str) -> LabelledTable:
    """``orders`` with a shortcut feature; ``o_orderkey`` identifies a row."""
    df = read(spark, sf_dir, "orders").selectExpr(*_split(ORDER_FEATURES))
    return LabelledTable(df, "target", ("o_orderkey",), "orders")


def region_audit(spark: SparkSession, sf_dir: str) -> LabelledTable:
    """Customers with their nation and region: text features, text target."""
    df = (
        read(spark, sf_dir, "customer")
        .join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("n_name", "c_mktsegment", "c_name", "r_name")
    )
    return LabelledTable(df, "r_name", name="customer")


def document_audit(spark: SparkSession, sf_dir: str) -> LabelledTable:
    """Documents with their partial labels: 60 % of the labels are missing."""
    df = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return LabelledTable(
        df.select("doc_id", "lang", "source", "n_chars", "quality", "toxic"), "lang", ("doc_id",), "documents"
    )


def document_split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = read(spark, sf_dir, "documents")
    wanted = ("text", "lang")
    return (
        docs.where("doc_id % 10 < 7").select(*wanted),
        docs.where("doc_id % 10 >= 7").select(*wanted),
    )


def embedding_split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Four fifths of the vectors against the rest plus slightly moved copies."""
    vectors = read(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("v")
    )
    train = vectors.where("vec_id % 5 <> 0")
    moved = train.where("vec_id % 5 = 1").select(
        "vec_id",
        F.transform("v", lambda x, i: F.when(i == 0, x + 0.01).otherwise(x)).alias("v"),
    )
    test = vectors.where("vec_id % 5 = 0").unionByName(moved)
    return train, test


def part_split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    parts = read(spark, sf_dir, "part")
    wanted = ("p_size", "p_retailprice", "p_partkey")
    return (
        parts.where("p_partkey % 10 < 7").select(*wanted),
        parts.where("p_partkey % 10 >= 7").select(*wanted),
    )


def event_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One finding per event; a dataset is one user on one day."""
    kind = F.lit(None).cast("string")
    value = F.col("value")
    for event, levels in EVENT_FINDINGS.items():
        branch = None
        for limit, name in levels:
            if limit is None:
                branch = branch.otherwise(name)
            elif branch is None:
                branch = F.when(value > limit, name)
            else:
                branch = branch.when(value > limit, name)
        kind = F.when(F.col("event_type") == event, branch).otherwise(kind)
    tools = F.create_map(*[F.lit(x) for pair in EVENT_TOOLS.items() for x in pair])
    return (
        read(spark, sf_dir, "events")
        .select(
            event_dataset().alias("dataset"),
            F.element_at(tools, F.col("event_type")).alias("tool"),
            kind.alias("type"),
            F.when(value > 100, "critical").when(value > 20, "warning").otherwise("info").alias("severity"),
            F.concat(F.lit("f"), (F.col("event_id") % 7).cast("string")).alias("feature"),
            F.lit(None).cast("string").alias("feature2"),
            F.col("event_type").alias("message"),
            value.alias("metric"),
            F.lit("{}").alias("evidence"),
        )
        .withColumn(
            "metric",
            F.when(F.col("type") == "train_test_contamination", (F.col("metric") - 100) / 10)
            .when(F.col("type") == "small_class_size", F.floor(F.col("metric") - 60).cast("double"))
            .when(F.col("type") == "perfect_correlation", F.col("metric") / 45)
            .otherwise(F.col("metric")),
        )
    )


def event_dataset():
    return F.concat_ws("/", F.col("user_id").cast("string"), F.to_date("ts").cast("string"))


def event_executed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five checks ran on every dataset."""
    tools = F.array(
        *[F.struct(F.lit(t).alias("tool"), F.lit(i).alias("position")) for i, t in enumerate(TOOLS)]
    )
    datasets = read(spark, sf_dir, "events").select(event_dataset().alias("dataset")).distinct()
    return datasets.select("dataset", F.inline(tools))


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``dataset, tools, time_used, time_budget`` of every dataset."""
    return (
        read(spark, sf_dir, "events")
        .groupBy(event_dataset().alias("dataset"))
        .agg(
            F.count_distinct("event_type").alias("tools"),
            (F.sum(F.round(F.col("value") * 100).cast("bigint")) / 100.0).alias("time_used"),
        )
        .withColumn("time_budget", F.lit(180.0))
    )


def event_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit steps: owner = user, audit = day, tool = event type.

    An owner has at most one audit a day, so every per-owner sequence is bounded
    by the calendar however many events a user has.
    """
    tools = F.create_map(*[F.lit(x) for pair in EVENT_TOOLS.items() for x in pair])
    grouped = (
        read(spark, sf_dir, "events")
        .groupBy(
            F.col("user_id").alias("owner"),
            F.to_date("ts").cast("string").alias("audit"),
            F.element_at(tools, F.col("event_type")).alias("tool"),
        )
        .agg(
            F.min("ts").alias("started"),
            (F.sum(F.round(F.col("value") * 100).cast("bigint")) / 10000.0).alias("seconds"),
            F.count_if(F.col("value") > 20).alias("findings"),
            F.count_if(F.col("value") > 100).alias("criticals"),
        )
    )
    order = W.partitionBy("owner", "audit").orderBy("started", "tool")
    return grouped.withColumn("position", F.row_number().over(order) - 1).drop("started")


def event_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One profile per owner and day, its numbers taken from the day's events.

    A day whose largest amount is 0 has the floating-point quotient as its
    balance, NaN or minus infinity, and fails no query.
    """
    cents = F.round(F.col("value") * 100).cast("bigint")
    least, most = F.min(cents).cast("double"), F.max(cents)
    over_zero = F.when(least == 0, float("nan")).otherwise(float("-inf"))
    return (
        read(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("owner"), F.to_date("ts").cast("string").alias("audit"))
        .agg(
            (F.sum(cents) + 1).alias("num_rows"),
            (F.count(F.lit(1)) * 7 + 5).alias("num_features"),
            (F.count_distinct("event_type") + 2).alias("num_classes"),
            F.when(most == 0, over_zero).otherwise(F.try_divide(least, most)).alias("class_balance_ratio"),
            (F.count_if(F.col("event_type") == "error") / (4.0 * F.count(F.lit(1)))).alias("missing_ratio"),
            F.lit(0.5).alias("numeric_ratio"),
            F.lit(0.5).alias("categorical_ratio"),
            F.bool_or(F.col("event_type") == "click").alias("has_temporal_features"),
            F.bool_or(F.col("event_type") == "view").alias("has_id_features"),
        )
        .withColumn("complexity_score", complexity_score())
    )


def latest_and_past(profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The newest profile of each owner, and all older ones."""
    last = profiles.groupBy("owner").agg(F.max("audit").alias("last"))
    marked = profiles.join(last, "owner")
    return (
        marked.where("audit = last").drop("last"),
        marked.where("audit < last").drop("last"),
    )
