"""Quantile bins of numeric features, counted against the class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscout.functions.hashing import hash_fold
from tabscout.functions.lineage import settle
from tabscout.functions.quantiles import quantile_values
from tabscout.schema import blocks, empty, melt, union_all
from tabscout.table import LabelledTable

QUARTILES = (0.25, 0.5, 0.75)


def usable_features(t: LabelledTable) -> list[T.StructField]:
    """Numeric features with at least one value."""
    return [f for f in t.numeric if t.numeric_facts[f.name].mean is not None]


def feature_quantiles(t: LabelledTable, bins: int = 10) -> dict[str, dict[float, float]]:
    """Quartiles and bin edges of imputed features over labelled rows.

    Measured once per table: features x probabilities numbers on the driver.
    """
    slot = ("quantiles", bins)
    if slot not in t.shared:
        probs = sorted({i / bins for i in range(1, bins)} | set(QUARTILES))
        summary = t.class_summary
        labelled = summary["rows"] - summary["unlabelled"]
        fields = usable_features(t)
        values = quantile_values(
            t.labelled_rows(),
            {f.name: t.imputed(f) for f in fields},
            {f.name: labelled for f in fields},
            probs,
            ends=t.ends,
        )
        t.shared[slot] = {name: dict(zip(probs, found)) for name, found in values.items()}
    return t.shared[slot]


def bin_number(cell: Column, edges: list[float]) -> Column:
    """How many of the ascending edges lie below the value; a few plain comparisons, so it compiles."""

    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(cell > F.lit(edges[middle]), among(middle + 1, high)).otherwise(among(low, middle))

    return F.when(cell.isNotNull(), among(0, len(edges))) if edges else F.lit(0)


def bin_counts(t: LabelledTable, bins: int = 10, folds: int = 1) -> DataFrame:
    """``feature, bin, class, n, n0, n1, ...``: rows per cell, in all and per fold.

    One shuffle of counters for all features. Rows are read once; what leaves a
    task is one row per feature, bin and class.
    """
    slot = ("bin_counts", bins, folds)
    if folds == 1:
        ready = [k for k in t.shared if k[:2] == slot[:2]]
        slot = ready[0] if ready else slot
    if slot not in t.shared:
        found = feature_quantiles(t, bins)
        probs = [i / bins for i in range(1, bins)]
        fields = [f for f in usable_features(t) if f.name in found]
        edges = {f.name: sorted({found[f.name][p] for p in probs}) for f in fields}
        keep = {"class": t.label}
        per_fold = []
        if folds > 1:
            keep["fold"] = hash_fold(t.row_key, t.seed, folds)
            per_fold = [F.count_if(F.col("fold") == k).alias(f"n{k}") for k in range(folds)]
        if not fields:
            extra = "".join(f", n{k} bigint" for k in range(len(per_fold)))
            return empty(t.spark, f"feature string, bin int, class string, n bigint{extra}")
        rows = t.labelled_rows()
        parts = []
        for block in blocks(list(enumerate(fields)), 40):
            # Cells are computed once; a number stands for the feature and its bin, which groups faster than a name.
            wide = rows.select(*[c.alias(k) for k, c in keep.items()], *[t.imputed(f).alias(f"__cell_{i}") for i, f in block])
            codes = {f.name: i * bins + bin_number(F.col(f"__cell_{i}"), edges[f.name]) for i, f in block}
            parts.append(melt(wide, codes, {k: F.col(k) for k in keep}))
        named = F.array(*[F.lit(f.name) for f in fields])
        code = F.col("value")
        # Two checks read these few counters several times over: computed once, and
        # without the long plan behind them.
        t.shared[slot] = settle(
            union_all(parts)
            .groupBy("value", "class")
            .agg(F.count(F.lit(1)).alias("n"), *per_fold)
            .withColumns({"feature": F.get(named, F.floor(code / bins).cast("int")), "bin": F.pmod(code, F.lit(bins))})
            .select("feature", "bin", "class", "n", *[f"n{k}" for k in range(len(per_fold))])
        )
    return t.shared[slot]
