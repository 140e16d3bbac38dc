"""Exact quantiles of many columns at once that never hold a column's values in one place.

Spark's exact ``percentile`` keeps every distinct value of a column in one
aggregation buffer. Here the line of each column is cut into closed intervals of
keys. Tasks count the equal parts of the intervals of all columns in arrays of fixed
size, Spark adds the counters up, and the parts that hold a wanted rank are cut on, from
the least to the greatest key that they hold. Counts alone decide where a rank is, so results are exact. Intervals of
few rows are counted value by value at the end.

A value's key is an integer of the bits of its double that ascends with the value, NaN last.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabscout.schema import blocks, empty, union_all

SCHEMA = "feature string, prob double, value double"

# Log2 of the parts that an interval is cut into in the first round and in each later one.
_FIRST, _NEXT = 14, 10
# Rows of an interval that are counted value by value.
_BRACKET_ROWS = 100_000
_COLUMNS_PER_SCAN = 40
# Intervals by which rows are told before they reach Python.
_MOST_TOLD = 32
# The greatest key there is; no value has it, as all NaN share a lower one.
_TOP = 2**64 - 1
_COUNTERS = "place int, slot int, part int, n bigint, low bigint, high bigint"
_VALUES = "place int, slot int, key bigint, n bigint"
# Keys are unsigned; moved by this they are signed numbers in the same order, which Spark holds.
_MIDDLE = np.uint64(2**63)


@dataclass
class _Search:
    """Some ranks of a column, all within its ``rows`` values with keys from ``low`` to ``high``.

    ``below`` values are less than these.
    """

    feature: str
    ranks: list[int]
    below: int
    rows: int
    low: int
    high: int


def order_statistics(
    df: DataFrame,
    cells: dict[str, Column],
    ranks: dict[str, Sequence[int]],
    sizes: dict[str, int],
    bracket_rows: int = _BRACKET_ROWS,
    ends: dict[str, Sequence[float]] | None = None,
) -> dict[tuple[str, int], float]:
    """The value at every wanted rank (from 0) of every column, nulls left out.

    ``sizes`` are the numbers of non-null values. ``ends`` may name numbers between
    which all values of a column lie: the least and the greatest, in any order. The driver holds a few numbers
    per wanted rank and the counters of their intervals. There are at most as many jobs
    as a double has digits, and a column of few rows or few values needs two of them,
    however many rows and columns there are.
    """
    found: dict[tuple[str, int], float] = {}
    open_ = []
    for feature, wanted in ranks.items():
        if not wanted or not sizes[feature]:
            continue
        keys = [_key(x) for x in (ends or {}).get(feature, ())] or [0, _TOP]
        if min(keys) == max(keys):
            found.update({(feature, rank): _value(keys[0]) for rank in wanted})
        else:
            open_.append(_Search(feature, sorted(set(wanted)), 0, sizes[feature], min(keys), max(keys)))
    width, small = _FIRST, []
    while open_:
        small += [s for s in open_ if s.rows <= bracket_rows]
        open_ = _cut(df, cells, [s for s in open_ if s.rows > bracket_rows], width, found)
        width = _NEXT
    _list(df, cells, small, found)
    return found


def _by_feature(searches: list[_Search]) -> dict[str, list[_Search]]:
    """The searches of each column by ascending interval."""
    own: dict[str, list[_Search]] = {}
    for search in sorted(searches, key=lambda s: s.low):
        own.setdefault(search.feature, []).append(search)
    return own


def _scan(df: DataFrame, cells: dict[str, Column], own: dict[str, list[_Search]], task: Callable, schema: str) -> DataFrame:
    """What ``task`` makes of the columns' cells; it is given each column's place and the ends of its intervals."""
    parts = []
    for block in blocks(list(enumerate(own)), _COLUMNS_PER_SCAN):
        wanted = [(place, [(s.low, s.high) for s in own[n]]) for place, n in block]
        wide = df.select(*[cells[n].alias(f"c{place}") for place, n in block])
        inside = [F.col(f"c{place}").between(_value(low), _value(high)) for place, ends in wanted for low, high in ends if high < _TOP]
        # Rows without a value in an interval stay out of Python, unless there are so many intervals that telling costs more.
        if len(inside) == sum(len(ends) for _, ends in wanted) <= _MOST_TOLD:
            wide = wide.where(reduce(lambda a, b: a | b, inside))
        parts.append(wide.mapInArrow(task(wanted), schema))
    return union_all(parts)


def _at_ranks(counted: DataFrame, order: str, own: dict[str, list[_Search]]) -> DataFrame:
    """The rows of ``place, slot, n`` and ``order`` that hold a wanted rank, one per rank, with the rows ``upto`` them."""
    upto = F.sum("n").over(W.partitionBy("place", "slot").orderBy(order))
    rows = [(i, j, r - s.below, r) for i, searches in enumerate(own.values()) for j, s in enumerate(searches) for r in s.ranks]
    asked = counted.sparkSession.createDataFrame(rows, "place int, slot int, at bigint, rank bigint")
    return counted.withColumn("upto", upto).join(F.broadcast(asked), ["place", "slot"]).where("at < upto AND at >= upto - n")  # one row per wanted rank


def _cut(
    df: DataFrame, cells: dict[str, Column], searches: list[_Search], width: int, found: dict[tuple[str, int], float]
) -> list[_Search]:
    """What is left to search once the 2 ** ``width`` parts of each interval are counted, from one job for all columns."""
    if not searches:
        return []
    own = _by_feature(searches)
    names = list(own)
    counters = _scan(df, cells, own, lambda wanted: _counting(wanted, width), _COUNTERS)
    counted = counters.groupBy("place", "slot", "part").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    left: dict[tuple[int, int, int], _Search] = {}
    # An interval has as many counters as parts; the driver sees those that hold a rank.
    for r in _at_ranks(counted, "part", own).collect():
        search = own[names[r.place]][r.slot]
        low, high = r.low + int(_MIDDLE), r.high + int(_MIDDLE)
        if low == high:
            found[search.feature, r["rank"]] = _value(low)
            continue
        part = _Search(search.feature, [], search.below + r.upto - r.n, r.n, low, high)
        inner = left.setdefault((r.place, r.slot, r.part), part)
        inner.ranks.append(r["rank"])
    return list(left.values())


def _helpers() -> tuple[Callable, Callable]:
    """Two functions that travel to the tasks whole, as workers need not know this package."""
    middle = _MIDDLE

    def keys_of(column: pa.Array, lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ascending keys of a column's values in the ascending intervals from ``lows`` to ``highs``, and the number of each one's interval."""
        # Adding 0 makes one zero of the two.
        values = column.drop_null().to_numpy(zero_copy_only=False) + 0.0
        values[np.isnan(values)] = np.nan
        keys = values.view(np.uint64) ^ ((values.view(np.int64) >> 63).view(np.uint64) | middle)
        keys.sort()
        starts, stops = np.searchsorted(keys, lows), np.searchsorted(keys, highs, "right")
        slot = np.repeat(np.arange(len(lows)), stops - starts)
        return np.concatenate([keys[a:b] for a, b in zip(starts, stops)]), slot

    def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where runs of equal values start and end."""
        starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        return starts, np.append(starts[1:], len(values))

    return keys_of, runs


def _counting(wanted: list[tuple[int, list[tuple[int, int]]]], width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows, least and greatest key of each part of the wanted intervals of each column, over a task's rows."""
    names = ["place", "slot", "part", "n", "low", "high"]
    (keys_of, runs), middle, top = _helpers(), _MIDDLE, _TOP

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, held = [], []
        for _, ends in wanted:
            shifts = [max(0, (high - low).bit_length() - width) for low, high in ends]
            asked.append((*np.array(ends, np.uint64).T, np.array(shifts, np.uint64)))
            size = len(ends) << width
            held.append((np.zeros(size, np.int64), np.full(size, top, np.uint64), np.zeros(size, np.uint64)))
        for batch in batches:
            for (lows, highs, shifts), (n, low, high), column in zip(asked, held, batch.columns, strict=True):
                keys, slot = keys_of(column, lows, highs)
                if len(keys):
                    at = ((keys - lows[slot]) >> shifts[slot]).astype(np.int64) + (slot << width)
                    starts, stops = runs(at)
                    at = at[starts]
                    n[at] += stops - starts
                    low[at] = np.minimum(low[at], keys[starts])
                    high[at] = np.maximum(high[at], keys[stops - 1])
        for (place, _), (n, low, high) in zip(wanted, held, strict=True):
            at = np.flatnonzero(n)
            numbers = [np.full(len(at), place, np.int32), (at >> width).astype(np.int32), (at & (2**width - 1)).astype(np.int32), n[at]]
            numbers += [(key[at] ^ middle).view(np.int64) for key in (low, high)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in numbers], names)

    return count


def _listing(wanted: list[tuple[int, list[tuple[int, int]]]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Keys of the wanted intervals of each column, each once per batch with its rows."""
    names = ["place", "slot", "key", "n"]
    (keys_of, runs), middle = _helpers(), _MIDDLE

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = [(place, *np.array(ends, np.uint64).T) for place, ends in wanted]
        for batch in batches:
            for (place, *ends), column in zip(asked, batch.columns, strict=True):
                keys, slot = keys_of(column, *ends)
                if len(keys):
                    starts, stops = runs(keys)
                    numbers = [np.full(len(starts), place, np.int32), slot[starts].astype(np.int32), (keys[starts] ^ middle).view(np.int64), stops - starts]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in numbers], names)

    return gather


def _key(value: float) -> int:
    raw = int(np.array([math.nan if math.isnan(value) else value + 0.0]).view(np.uint64)[0])
    return raw ^ (2**64 - 1 if raw >> 63 else 2**63)


def _value(key: int) -> float:
    """The double with this key."""
    raw = key ^ (2**63 if key >> 63 else 2**64 - 1)
    return float(np.array([raw], np.uint64).view(np.float64)[0])


def _list(df: DataFrame, cells: dict[str, Column], searches: list[_Search], found: dict[tuple[str, int], float]) -> None:
    """Finds ranks among values counted singly."""
    if not searches:
        return
    own = _by_feature(searches)
    names = list(own)
    # An interval has few rows, so they may meet in one task.
    keys = _scan(df, cells, own, _listing, _VALUES).repartition("place", "slot")
    counted = keys.groupBy("place", "slot", "key").agg(F.sum("n").alias("n"))
    hits = _at_ranks(counted, "key", own).select("place", "rank", "key").collect()
    found.update({(names[r.place], r["rank"]): _value(r.key + int(_MIDDLE)) for r in hits})


def quantile_values(
    df: DataFrame,
    cells: dict[str, Column],
    sizes: dict[str, int],
    probs: Sequence[float],
    bracket_rows: int = _BRACKET_ROWS,
    ends: dict[str, Sequence[float]] | None = None,
) -> dict[str, list[float]]:
    """The quantiles of every column with linear interpolation between neighbours; empty columns have none.

    ``cells`` maps a feature to its DOUBLE expression and ``sizes`` to its number of non-null values; ``ends`` as for ``order_statistics``.
    """
    places = {n: [p * (sizes[n] - 1) for p in probs] for n in cells if sizes[n] > 0}
    ranks = {n: [x for at in own for x in (math.floor(at), math.ceil(at))] for n, own in places.items()}
    found = order_statistics(df, cells, ranks, sizes, bracket_rows, ends)

    def value(name: str, at: float) -> float:
        low, high = found[name, math.floor(at)], found[name, math.ceil(at)]
        return low if low == high else low + (high - low) * (at - math.floor(at))

    return {name: [value(name, at) for at in own] for name, own in places.items()}


def quantiles(
    df: DataFrame,
    cells: dict[str, Column],
    sizes: dict[str, int],
    probs: Sequence[float],
    bracket_rows: int = _BRACKET_ROWS,
    ends: dict[str, Sequence[float]] | None = None,
) -> DataFrame:
    """The same as a table ``feature, prob, value``."""
    found = quantile_values(df, cells, sizes, probs, bracket_rows, ends)
    rows = [(name, float(p), v) for name, own in found.items() for p, v in zip(probs, own, strict=True)]
    return df.sparkSession.createDataFrame(rows, SCHEMA) if rows else empty(df.sparkSession, SCHEMA)
