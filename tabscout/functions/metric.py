"""Which vectors of one table have a vector of another within an angle: cells around centres, triangle inequality."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscout.functions.lineage import stored


@dataclass(frozen=True)
class Limits:
    """Rows of a cell that is compared as it is, centres that a larger one is cut by, and rows of a task's block.

    A cut is undone where a sought row has to enter more than ``fan_out`` of the
    new cells on average: then the triangle inequality excludes too little.
    """

    cell: int = 16_384
    centres: int = 256
    block: int = 8_192
    rounds: int = 12
    fan_out: float = 0.5


# Angles of nearly equal vectors come out of arccos to about the root of the rounding error.
_SLACK = 1e-6
_MATCHED = "id bigint, pairs bigint"
# Rows drawn from a cell for each centre that is chosen among them.
_DRAWN = 4


def _deal(key: Column, rows: Column, block: int) -> Column:
    """A block number by hash, so that blocks hold about ``block`` of ``rows``."""
    return F.pmod(F.xxhash64(key), F.ceil(rows / F.lit(float(block)))).cast("int")


def _blocks(rows: Column, block: int) -> Column:
    """All block numbers of ``rows``."""
    return F.sequence(F.lit(0), (F.ceil(rows / F.lit(float(block))) - 1).cast("int"))


def near_rows(known: DataFrame, sought: DataFrame, threshold: float, limits: Limits = Limits()) -> DataFrame:
    """``id, pairs``: an id for every row of ``sought`` with a cosine of ``threshold`` or more to some known vector.

    ``known`` has distinct unit vectors ``u``, ``sought`` has ``id, u``; vectors of
    different length are never near. The sum of ``pairs`` is how many vectors were
    compared; rows with a null id only carry such a count, and an id may come twice.

    The angle between unit vectors is a metric. A cell (at first all vectors of
    one length) with more known rows than ``limits.cell`` is cut around centres, rows
    far from each other among a few drawn by hash: every known row joins its nearest centre. A
    sought row within the angle of a centre is settled, as a centre is a known
    row. Any other enters the cells that the triangle inequality leaves: with
    ``a`` the angle sought, those at most ``2 a`` farther than its nearest
    centre and within ``a`` of the cell's least to greatest distance. Cells that are
    small, do not shrink or exclude too little are compared in tiles: blocks of known rows
    times blocks of sought rows, as many of each as the counted sizes ask for.
    So a dense cell costs many small tasks, and a clump of copies none: known
    rows are distinct, and rows near it are settled by its centre.

    No table is broadcast and no count of cells reaches the driver; each round
    writes its tables in the shared folder.
    """
    width = F.size("u").cast("string")
    known = stored(known.select(width.alias("cell"), "u"))
    sought = stored(sought.select("id", width.alias("cell"), "u"))
    spark, settled, closed = known.sparkSession, [], []
    sizes = known.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    open_ = stored(sizes.where(F.col("n") > limits.cell).withColumn("centre_seed", F.lit(0)))
    for turn in range(limits.rounds):
        if open_.isEmpty():
            break
        small = known.join(open_, "cell", "left_anti"), sought.join(open_, "cell", "left_anti")
        cut, routed, stats = _cut(known.join(open_, "cell"), sought.join(open_, "cell"), threshold, limits, turn)
        done = stored(routed.where("slots IS NULL").groupBy("id").agg(F.sum("pairs").alias("pairs")))
        settled.append(done)
        # A row that a centre has settled need not be sought elsewhere.
        left = routed.where(F.size("slots") > 0).join(done, "id", "left_anti")
        useful = (
            left.groupBy("parent")
            .agg(F.sum(F.size("slots")).alias("entered"), F.count(F.lit(1)).alias("rows"))
            .join(stats.groupBy("parent").agg(F.count(F.lit(1)).alias("cells")), "parent")
            .where(F.col("entered") <= limits.fan_out * F.col("rows") * F.col("cells"))
            .select("parent")
        )
        useful = stored(useful)
        whole = open_.join(useful.withColumnRenamed("parent", "cell"), "cell", "left_anti").select("cell")
        closed.append((small[0], _without(small[1], settled)))
        closed.append((known.join(whole, "cell", "left_semi"), _without(sought.join(whole, "cell", "left_semi"), settled)))
        known = stored(cut.join(useful, "parent", "left_semi").select("cell", "u"))
        entering = left.join(useful, "parent", "left_semi").select("id", "parent", "u", F.explode("slots").alias("slot"))
        sought = stored(entering.select("id", F.concat_ws(".", "parent", "slot").alias("cell"), "u"))
        still = stats.join(useful, "parent", "left_semi").where(
            (F.col("n") > limits.cell) & (F.col("n") < 0.9 * F.col("whole"))
        )
        open_ = stored(still.select("cell", "n", F.lit(turn + 1).alias("centre_seed")))
    closed.append((known, _without(sought, settled)))
    compared = [_compare(a, b, threshold, limits.block) for a, b in closed]
    result = spark.createDataFrame([], _MATCHED)
    for part in [*settled, *compared]:
        result = result.union(part.select("id", "pairs"))
    return result


def _without(sought: DataFrame, settled: list[DataFrame]) -> DataFrame:
    for done in settled:
        sought = sought.join(done.where("id IS NOT NULL"), "id", "left_anti")
    return sought


def _cut(known: DataFrame, sought: DataFrame, threshold: float, limits: Limits, turn: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Known rows in their new cells, sought rows with those that they have to enter, and what is known of the new cells.

    Cells to enter are ``slots``, numbers below the parent, so a row and its vector leave a
    task once however many there are. A row without ``slots`` is settled.
    """
    slot = F.pmod(F.xxhash64(F.lit(turn), "u"), F.lit(_DRAWN * limits.centres)).cast("int")
    drawn = known.groupBy("cell", slot.alias("slot")).agg(
        F.min_by("u", F.xxhash64(F.lit(-turn - 1), "u")).alias("u"), F.first("n").alias("n")
    )
    slots = drawn.groupBy("cell").applyInArrow(_choosing(limits.centres), "cell string, slot int, u array<double>, n bigint")
    centres = stored(slots.groupBy("cell").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("slot", "u"))).alias("centres")))
    dealt = known.withColumn("block", _deal(F.col("u"), F.col("n"), limits.block))
    spread = centres.withColumn("block", F.explode(_blocks(F.col("n"), limits.block)))
    cut = stored(
        dealt.groupBy("cell", "block")
        .cogroup(spread.groupBy("cell", "block"))
        .applyInArrow(_joining(), "parent string, cell string, u array<double>, angle double, whole bigint")
    )
    stats = stored(
        cut.groupBy("parent", "cell").agg(
            F.count(F.lit(1)).alias("n"), F.min("angle").alias("least"), F.max("angle").alias("most"), F.first("whole").alias("whole")
        )
    )
    rings = stats.groupBy("parent").agg(F.collect_list(F.struct("cell", "least", "most")).alias("rings"))
    asked = sought.groupBy("cell").agg(F.count(F.lit(1)).alias("m"))
    posed = sought.join(asked, "cell").select("id", "cell", "u", _deal(F.col("id"), F.col("m"), limits.block).alias("block"))
    around = (
        centres.join(rings.withColumnRenamed("parent", "cell"), "cell")
        .join(asked, "cell")
        .select("cell", "centres", "rings", F.explode(_blocks(F.col("m"), limits.block)).alias("block"))
    )
    routed = (
        posed.groupBy("cell", "block")
        .cogroup(around.groupBy("cell", "block"))
        .applyInArrow(_routing(threshold), "id bigint, parent string, u array<double>, slots array<int>, pairs bigint")
    )
    return cut, stored(routed), stats


def _compare(known: DataFrame, sought: DataFrame, threshold: float, block: int) -> DataFrame:
    """Ids of sought rows with a near known row in their cell, tile by tile."""
    sizes = known.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).join(sought.groupBy("cell").agg(F.count(F.lit(1)).alias("m")), "cell")
    sizes = stored(sizes)
    rows = known.join(sizes, "cell").select(
        "cell", "u", _deal(F.col("u"), F.col("n"), block).alias("i"), F.explode(_blocks(F.col("m"), block)).alias("j")
    )
    asked = sought.join(sizes, "cell").select(
        "cell", "id", "u", _deal(F.col("id"), F.col("m"), block).alias("j"), F.explode(_blocks(F.col("n"), block)).alias("i")
    )
    tile = ("cell", "i", "j")
    return asked.groupBy(*tile).cogroup(rows.groupBy(*tile)).applyInArrow(_comparing(threshold), _MATCHED)


# What tasks run. Each is a closure without names of this package, so that workers need none of it.


def _choosing(most: int) -> Callable[[pa.Table], pa.Table]:
    """Of the rows drawn from a cell, up to ``most``, each the one farthest from those before."""

    def choose(drawn: pa.Table) -> pa.Table:
        drawn = drawn.sort_by("slot")
        column = drawn.column("u").combine_chunks()
        vectors = column.flatten().to_numpy().reshape(len(column), -1)
        chosen, nearest = [0], vectors @ vectors[0]
        while len(chosen) < min(most, len(vectors)):
            chosen.append(int(nearest.argmin()))
            nearest = np.maximum(nearest, vectors @ vectors[chosen[-1]])
        return drawn.take(pa.array(sorted(set(chosen)))).select(["cell", "slot", "u", "n"])

    return choose


def _joining() -> Callable[[pa.Table, pa.Table], pa.Table]:
    names = ["parent", "cell", "u", "angle", "whole"]

    def join(rows: pa.Table, centres: pa.Table) -> pa.Table:
        kinds = (pa.string(), pa.string(), pa.list_(pa.float64()), pa.float64(), pa.int64())
        if not rows.num_rows or not centres.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names)
        own = centres.slice(0, 1).to_pylist()[0]
        slots = [c["slot"] for c in own["centres"]]
        around = np.array([c["u"] for c in own["centres"]])
        column = rows.column("u").combine_chunks()
        vectors = column.flatten().to_numpy().reshape(len(column), -1)
        cosines = vectors @ around.T
        nearest = cosines.argmax(1)
        angles = np.arccos(np.clip(cosines[np.arange(len(nearest)), nearest], -1, 1))
        cells = np.array([f"{own['cell']}.{s}" for s in slots], object)[nearest]
        arrays = [pa.array([own["cell"]] * len(nearest)), pa.array(cells, pa.string()), column, pa.array(angles), pa.array([own["n"]] * len(nearest), pa.int64())]
        return pa.table(arrays, names)

    return join


def _routing(threshold: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    reach, slack = math.acos(max(-1.0, min(1.0, threshold))), _SLACK
    names = ["id", "parent", "u", "slots", "pairs"]

    def route(rows: pa.Table, around: pa.Table) -> pa.Table:
        kinds = (pa.int64(), pa.string(), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.int64())
        if not rows.num_rows or not around.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names)
        own = around.slice(0, 1).to_pylist()[0]
        rings = {r["cell"]: r for r in own["rings"]}
        held = [(f"{own['cell']}.{c['slot']}", c["slot"], c["u"]) for c in own["centres"]]
        held = [h for h in held if h[0] in rings]
        centres = np.array([u for _, _, u in held])
        column = rows.column("u").combine_chunks()
        vectors = column.flatten().to_numpy().reshape(len(column), -1)
        cosines = vectors @ centres.T
        settled = (cosines >= threshold).any(1)
        angles = np.arccos(np.clip(cosines, -1, 1))
        least, most = (np.array([rings[cell][n] for cell, _, _ in held]) for n in ("least", "most"))
        enter = (angles <= angles.min(1, keepdims=True) + 2 * reach + slack) & (angles <= most + reach + slack) & (angles >= least - reach - slack)
        enter[settled] = False
        slots = np.array([slot for _, slot, _ in held], np.int32)[np.nonzero(enter)[1]]
        ends = np.concatenate([[0], np.cumsum(enter.sum(1))]).astype(np.int32)
        # A null start makes a null list.
        entered = pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.append(settled, False)), pa.array(slots))
        # One more row, without id, only says how many centres were looked at.
        none = pa.nulls(1, pa.int64())
        keys = pa.concat_arrays([rows.column("id").combine_chunks(), none])
        vectors = pa.concat_arrays([column, pa.nulls(1, column.type)]).cast(kinds[2])
        counts = np.append(np.zeros(len(column), np.int64), cosines.size)
        lists = pa.concat_arrays([entered, pa.nulls(1, kinds[3])])
        return pa.table([keys, pa.array([own["cell"]] * len(counts)), vectors, lists, pa.array(counts)], names)

    return route


def _comparing(threshold: float, rows_at_once: int = 1024) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def compare(asked: pa.Table, rows: pa.Table) -> pa.Table:
        if not asked.num_rows or not rows.num_rows:
            return pa.table([pa.array([], pa.int64())] * 2, ["id", "pairs"])
        sides = []
        for side in (asked, rows):
            column = side.column("u").combine_chunks()
            sides.append(column.flatten().to_numpy().reshape(len(column), -1))
        left, right = sides
        near = np.zeros(len(left), bool)
        for start in range(0, len(left), rows_at_once):
            part = left[start : start + rows_at_once]
            near[start : start + rows_at_once] = ((part @ right.T) >= threshold).any(1)
        ids = asked.column("id").combine_chunks().take(pa.array(np.flatnonzero(near)))
        counts = pa.array([0] * len(ids) + [len(left) * len(right)], pa.int64())
        return pa.table([pa.concat_arrays([ids, pa.nulls(1, pa.int64())]), counts], ["id", "pairs"])

    return compare
