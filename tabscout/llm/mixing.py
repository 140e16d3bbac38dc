"""Mixing sources to target weights: raked token weights and sampling by calibrated probabilities."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from math import inf

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscout.functions.lineage import stored
from tabscout.llm.words import words

_log = logging.getLogger(__name__)

#: Least rounds of fitting; one round adjusts every dimension once.
ROUNDS = 5
#: Least share of the tokens that sampling keeps in expectation.
KEPT = 0.4
#: Fitting goes on until no share misses its target by more than this, for so many rounds at most.
TOLERANCE, LIMIT = 1e-3, 50
#: Exponents of the production targets: 1 keeps a dimension as it is, 0 makes its values equal.
TEMPER = {"source": 0.7, "lang": 0.7, "topic": 1.0}
_DIGITS = 13


def form_topic(text: Column) -> Column:
    """The production topic of a document: what kind of page its text looks like."""
    text = F.coalesce(text, F.lit(""))
    return (
        F.when(text.contains("icense"), "notice")
        .when(text.contains("@"), "contact")
        .when(F.length(text) < 1000, "short")
        .when(F.length(text) < 4000, "article")
        .otherwise("long")
    )


def hash_unit(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")).cast("binary")), 1, _DIGITS)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**_DIGITS))


def tempered_shares(cells: DataFrame, dimension: str, tokens: str, temper: float) -> DataFrame:
    """``<dimension>, share``: the share of tokens to the power ``temper``, summing to 1."""
    totals = cells.groupBy(dimension).agg(F.sum(tokens).cast("double").alias("share")).where("share > 0")
    powers = totals.withColumn("share", F.pow("share", F.lit(temper)))
    return powers.withColumn("share", F.col("share") / F.lit(_number(powers.agg(F.sum("share")))))


def _number(one: DataFrame) -> float:
    """The single value of an aggregate over everything; 1 where there is nothing."""
    value = one.first()[0]
    return 1.0 if value is None else float(value)


def rake(
    cells: DataFrame, targets: Mapping[str, DataFrame], tokens: str = "tokens", rounds: int = ROUNDS
) -> DataFrame:
    """``cells`` with ``weight``, so that weighted tokens meet every target share.

    Iterative proportional fitting: dimension by dimension, a cell's weight is
    multiplied by target over current share of its value. ``targets`` maps each
    dimension to ``<dimension>, share``; a value without a target keeps its
    weight and so does one without tokens. Nulls are a value of their own. After
    ``rounds`` rounds, more follow until no share misses its target by more than
    ``TOLERANCE``, up to ``LIMIT`` or until a round no longer helps; a miss that is
    left is logged as a warning, as targets that contradict each other cannot all be met. The
    cells are combinations of values, not documents; each step is a written
    table, so that the plan and the estimate of its size stay small, and a lost executor costs one step.
    """
    fitted = _with_shares(cells.withColumn("weight", F.lit(1.0)), targets)
    total = _number(cells.agg(F.sum(tokens)))
    fitted = _fit(fitted, targets, tokens, total, F.col("weight"), rounds)
    return fitted.drop(*[f"_share_{d}" for d in targets])


def _with_shares(cells: DataFrame, targets: Mapping[str, DataFrame]) -> DataFrame:
    """The cells with ``_share_<dimension>``, the target of their value."""
    for dimension, shares in targets.items():
        wanted = shares.select(F.col(dimension).alias("_value"), F.col("share").alias(f"_share_{dimension}"))
        cells = cells.join(wanted, F.col(dimension).eqNullSafe(F.col("_value")), "left").drop("_value")
    return stored(cells)


def _round(fitted: DataFrame, dimensions: Iterable[str], tokens: str, total: float, used: Column) -> DataFrame:
    """``weight`` adjusted once to every dimension; ``used`` is the part of it that counts."""
    for dimension in dimensions:
        now = fitted.groupBy(F.col(dimension).alias("_value")).agg(F.sum(F.col(tokens) * used).alias("_now"))
        ratio = F.col(f"_share_{dimension}") * F.lit(total) / F.nullif(F.col("_now"), F.lit(0.0))
        fitted = stored(
            fitted.join(now, F.col(dimension).eqNullSafe(F.col("_value")), "left")
            .withColumn("weight", F.col("weight") * F.coalesce(ratio, F.lit(1.0)))
            .drop("_value", "_now")
        )
    return fitted


def _fit(fitted: DataFrame, dimensions: Iterable[str], tokens: str, total: float, used: Column, rounds: int) -> DataFrame:
    """At least ``rounds`` rounds, and more while shares miss their targets and a round lessens that by a hundredth."""
    done, last = 0, inf
    while True:
        if done >= rounds:
            miss = _largest_miss(fitted, dimensions, tokens, total, used)
            if miss <= TOLERANCE or done >= LIMIT or miss > 0.99 * last:
                break
            last = miss
        fitted, done = _round(fitted, dimensions, tokens, total, used), done + 1
    if miss > TOLERANCE:
        _log.warning("raking: a share still misses its target by %.3g after %d rounds", miss, done)
    return fitted


def _largest_miss(fitted: DataFrame, dimensions: Iterable[str], tokens: str, total: float, used: Column) -> float:
    """How far the share of any value with tokens is from its target."""
    misses = [
        fitted.where(F.col(tokens) > 0)
        .groupBy(d, f"_share_{d}")
        .agg(F.sum(F.col(tokens) * used).alias("_now"))
        .select(F.abs(F.col("_now") / F.lit(total) - F.col(f"_share_{d}")).alias("miss"))
        for d in dimensions
    ]
    return reduce(DataFrame.union, misses).agg(F.coalesce(F.max("miss"), F.lit(0.0))).first()[0]


def reachable_shares(cells: DataFrame, dimension: str, shares: DataFrame, tokens: str, budget: float) -> DataFrame:
    """``<dimension>, share`` of a budget of tokens: no value gets more than it has, the others share the rest as before."""
    held = cells.groupBy(F.col(dimension).alias("_value")).agg(F.sum(tokens).cast("double").alias("_held")).where("_held > 0")
    rows = stored(held.join(shares, F.col(dimension).eqNullSafe(F.col("_value"))).select(dimension, "share", "_held"))
    wanted = _number(rows.agg(F.sum("share"))) * budget
    factor = budget
    while True:  # the factor rises until no further value is used up
        whole = F.col("_held") <= F.col("share") * F.lit(factor)
        spent, left = rows.agg(F.sum(F.when(whole, F.col("_held"))), F.sum(F.when(~whole, F.col("share")))).first()
        new = (wanted - (spent or 0.0)) / left if left else factor
        if new <= factor * (1 + 1e-12):
            break
        factor = new
    return rows.select(dimension, (F.least("_held", F.col("share") * F.lit(factor)) / F.lit(budget)).alias("share"))


def probabilities(cells: DataFrame, targets: Mapping[str, DataFrame], tokens: str = "tokens", kept: float = KEPT) -> DataFrame:
    """Raked ``cells`` with ``probability``, at most 1, that keeps at least the share ``kept`` of the tokens.

    The probability is the weight over the largest weight where that keeps
    enough. Otherwise a few rare cells would set the scale for all others: the
    budget is then the share ``kept`` of the tokens, cells that cannot reach
    their target are kept whole, and the rest are raked again to what is left.
    """
    weights = cells.where(F.col(tokens) > 0)
    largest = _number(weights.agg(F.max("weight")))
    scale = min(largest, 1 / kept)
    chance = F.least(F.col("weight") / F.lit(scale), F.lit(1.0))
    if largest <= scale:
        return cells.withColumn("probability", chance)
    total = _number(cells.agg(F.sum(tokens)))
    budget = total / scale
    reachable = {d: reachable_shares(cells, d, shares, tokens, budget) for d, shares in targets.items()}
    fitted = _with_shares(cells.withColumn("_raked", F.col("weight")).withColumn("weight", F.col("weight") / F.lit(scale)), reachable)
    used = F.least(F.col("weight"), F.lit(1.0))
    _log.warning("a weight of %.3g: its cells are kept whole, the rest are raked to %.3g of the tokens", largest, 1 / scale)
    fitted = _fit(fitted, targets, tokens, budget, used, 1)
    return fitted.withColumn("probability", used).withColumn("weight", F.col("_raked")).drop("_raked", *[f"_share_{d}" for d in targets])


def mix(
    docs: DataFrame,
    topic: Column | None = None,
    dimensions: Sequence[str] = ("source", "lang", "topic"),
    targets: Mapping[str, DataFrame] | None = None,
    temper: Mapping[str, float] = TEMPER,
    rounds: int = ROUNDS,
    seed: int = 0,
    key: str = "doc_id",
    kept: float = KEPT,
) -> DataFrame:
    """Each document's raked weight, sampling probability and whether it is kept.

    Returns ``<key>, source, lang, topic, n_tokens, weight, probability, kept``.
    Tokens are words. Weights are fitted on the token totals of all combinations
    of the dimensions over all documents; the probability is proportional to the
    weight, so kept tokens meet the targets in expectation and none is kept
    twice. At least the share ``kept`` of the tokens stays in expectation, see
    ``probabilities``. The draw is a hash of key and seed: the same in every run, for
    copies of a row alike. ``targets`` gives shares per dimension, else they are
    the corpus shares to the power that ``temper`` names (1 if none). Null texts have no tokens; null
    values of a dimension form a group of their own. No documents, no rows.
    """
    topic = form_topic(F.col("text")) if topic is None else topic
    rows = stored(
        docs.select(
            F.col(f"`{key}`").alias(key),
            "source",
            "lang",
            topic.alias("topic"),
            F.size(words(F.col("text"))).cast("bigint").alias("n_tokens"),
        )
    )
    cells = stored(rows.groupBy(*dimensions).agg(F.sum("n_tokens").alias("tokens")))
    if targets is None:
        targets = {d: tempered_shares(cells, d, "tokens", temper.get(d, 1.0)) for d in dimensions}
    fitted = rake(cells, targets, rounds=rounds)
    fitted = probabilities(fitted, targets, kept=kept).select(*[F.col(d).alias(f"_{d}") for d in dimensions], "weight", "probability")
    same = F.lit(True)
    for d in dimensions:
        same = same & F.col(d).eqNullSafe(F.col(f"_{d}"))
    return rows.join(fitted, same, "left").select(
        key,
        "source",
        "lang",
        "topic",
        "n_tokens",
        "weight",
        "probability",
        (hash_unit(F.col(key), seed) < F.col("probability")).alias("kept"),
    )
