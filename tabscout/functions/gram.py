"""Correlations of all pairs of columns: sums in square tiles, added up in a tree, only strong pairs become rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscout.schema import empty, union_all

#: Columns of a tile's side, columns of one pass, and groups that the tasks' tiles are first added up in.
TILE, PASS, GROUPS = 128, 1024, 32
#: Rows of one matrix product.
ROWS = 4096

_TILES = "left int, right int, part int, sums array<double>"
_PAIRS = "i int, j int, n bigint, correlation double"


def _partial(starts: Sequence[tuple[int, int]], width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums over a task's rows for each pair of column blocks: n, x, y, xx, yy, xy over rows that have both."""
    groups, rows = GROUPS, ROWS
    ends = {a: b for a, b in starts}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for start in range(0, len(batch), rows):
                part = batch.column(0).slice(start, rows)
                raw = part.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                there = ~np.isnan(raw)
                x, there = np.where(there, raw, 0.0), there.astype(float)
                for i, a in enumerate(ends):
                    for b in list(ends)[i:]:
                        xa, ha, xb, hb = x[:, a : ends[a]], there[:, a : ends[a]], x[:, b : ends[b]], there[:, b : ends[b]]
                        sums = np.stack([ha.T @ hb, xa.T @ hb, ha.T @ xb, (xa * xa).T @ hb, ha.T @ (xb * xb), xa.T @ xb])
                        held[a, b] = held[a, b] + sums if (a, b) in held else sums
        number = TaskContext.get().partitionId() % groups
        for (a, b), sums in held.items():
            values = [pa.array([a], pa.int32()), pa.array([b], pa.int32()), pa.array([number], pa.int32())]
            yield pa.RecordBatch.from_arrays([*values, pa.array([sums.ravel()], pa.list_(pa.float64()))], ["left", "right", "part", "sums"])

    return add


def _added() -> Callable[[Iterator[pa.RecordBatch]], pa.Table]:
    def add(group: pa.Table) -> pa.Table:
        total = None
        for sums in group.column("sums").combine_chunks():
            values = sums.values.to_numpy()
            total = values.copy() if total is None else total + values
        return group.slice(0, 1).set_column(3, "sums", pa.array([total], pa.list_(pa.float64())))

    return add


def _strong(starts: Sequence[tuple[int, int]], least: float) -> Callable[[pa.Table], pa.Table]:
    """The pairs of a tile with a correlation of at least ``least`` in size; all of them, undefined ones too, at 0."""
    ends = dict(starts)

    def pairs(group: pa.Table) -> pa.Table:
        row = group.to_pylist()[0]
        a, b = row["left"], row["right"]
        n, sx, sy, sxx, syy, sxy = np.array(row["sums"]).reshape(6, ends[a] - a, ends[b] - b)
        with np.errstate(all="ignore"):
            vx, vy, cov = (sxx - sx * sx / n) / n, (syy - sy * sy / n) / n, (sxy - sx * sy / n) / n
            # Where only cancellation noise is left of a variance there is no correlation.
            r = np.where((vx > 1e-14 * sxx / n) & (vy > 1e-14 * syy / n) & (n > 1), cov / np.sqrt(vx * vy), np.nan)
        r = np.clip(r, -1, 1)
        i, j = np.meshgrid(np.arange(a, ends[a]), np.arange(b, ends[b]), indexing="ij")
        wanted = (i < j) & ((np.abs(r) >= least) if least > 0 else np.ones(r.shape, bool))
        found = [pa.array(i[wanted].astype(np.int32)), pa.array(j[wanted].astype(np.int32)), pa.array(n[wanted].astype(np.int64))]
        return pa.table([*found, pa.array(r[wanted], from_pandas=True)], ["i", "j", "n", "correlation"])

    return pairs


def strong_pairs(df: DataFrame, cells: Sequence[Column], least: float = 0.0) -> DataFrame:
    """``i, j, n, correlation`` of the columns' pairs (numbers i < j) over the rows that have both values.

    Pairs weaker than ``least`` never become rows; 0 gives all, those without a
    correlation as well. Cells should be centred roughly, so that sums keep their
    digits. Columns are taken in blocks of ``TILE``; a task holds one tile of sums
    per pair of blocks, whatever its rows, and hands on one packed row per tile. Tiles are
    added up within groups of tasks and then over the groups. Tables of more than ``PASS``
    columns take one pass per pair of column groups, each of which reads its own columns alone.
    """
    if len(cells) < 2:
        return empty(df.sparkSession, _PAIRS)
    groups = [range(s, min(s + PASS, len(cells))) for s in range(0, len(cells), PASS)]
    done = []
    for g, first in enumerate(groups):
        for second in groups[g:]:
            numbers = list(first) if first == second else [*first, *second]
            found = _pass(df, [cells[c] for c in numbers], least)
            place = F.array(*[F.lit(c) for c in numbers])
            named = found.select(F.get(place, F.col("i")).alias("i"), F.get(place, F.col("j")).alias("j"), "n", "correlation")
            if first != second:  # pairs within a group come from that group's own pass
                named = named.where((F.col("i") < second.start) & (F.col("j") >= second.start))
            done.append(named)
    return union_all(done)


def _pass(df: DataFrame, cells: Sequence[Column], least: float) -> DataFrame:
    width = len(cells)
    starts = [(s, min(s + TILE, width)) for s in range(0, width, TILE)]
    tiles = df.select(F.array(*cells).alias("x")).mapInArrow(_partial(starts, width), _TILES)
    grouped = tiles.groupBy("left", "right", "part").applyInArrow(_added(), _TILES)
    whole = grouped.groupBy("left", "right").applyInArrow(_added(), _TILES)
    return whole.groupBy("left", "right").applyInArrow(_strong(starts, least), _PAIRS)
