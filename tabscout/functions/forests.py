"""Random forests grown on every row of a table, by counting.

Rows come as the bins of their features. For each level of all trees a task counts
its rows by node, feature, bin and class in arrays of fixed size; the counters of a tree are
added up and its cuts chosen in one place. What a row weighs in a tree is drawn from its digest, and
counters are whole numbers, so a forest is the same at every partitioning. Trees follow the
rules of MLlib's: Poisson bootstrap, Gini gain, a square root of the features tried at a node,
leaves that agree merged, votes by class shares.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscout.functions.lineage import stored
from tabscout.functions.quantiles import order_statistics
from tabscout.schema import blocks, measure_cells, union_all

BINS = 32
ROWS = "codes binary, label int, fold int, draw bigint"
# Counters that a task holds at once; nodes that need more are grown in further jobs.
_COUNTERS = 4_000_000
# Cells of a batch, and votes, that a task spreads out at once.
_CELLS = 2_000_000
# A gain below this is rounding.
_GAIN = 1e-12
_COLUMNS_PER_SCAN = 40


# --- bins ---


def cut_points(
    df: DataFrame, cells: dict[str, Column], size: int, ends: dict[str, Sequence[float]] | None = None, bins: int = BINS
) -> dict[str, list[float]]:
    """The ascending values, at most ``bins - 1`` a column, that cut its ``size`` values into bins.

    A column of at most ``bins`` values has a bin for each. In others a value that holds the place of several
    bins gets one of its own, and the rest is cut into equal numbers of rows. All from counts of every row.
    """
    few = _few_values(df, cells, bins)
    cuts = {name: set(few.get(name, [])[:-1]) for name in cells}
    apart: dict[str, list[float]] = {name: [] for name in cells if name not in few}
    spare, sizes = dict.fromkeys(apart, bins - 1), dict.fromkeys(apart, size)
    while apart:
        rest = {n: F.when(~cells[n].isin(alone), cells[n]) if alone else cells[n] for n, alone in apart.items()}
        ranks = {n: [i * sizes[n] // (spare[n] + 1) for i in range(1, spare[n] + 1)] for n in apart}
        found = order_statistics(df, rest, ranks, sizes, ends=ends)
        left = {}
        for name, alone in apart.items():
            values = [found[name, rank] for rank in ranks[name]]
            common = sorted({a for a, b in zip(values, values[1:]) if a == b})
            if not common:
                cuts[name].update(values)
                continue
            cuts[name].update(x for v in common for x in (math.nextafter(v, -math.inf), v))
            spare[name] -= 2 * len(common)
            if spare[name] > 0:
                left[name] = alone + common
        if left:
            rest = {n: F.when(~cells[n].isin(alone), cells[n]) for n, alone in left.items()}
            counted = measure_cells(df, rest, lambda value: {"n": F.count(value)}, "n bigint").collect()
            sizes = {r["feature"]: r["n"] for r in counted}
        apart = {name: alone for name, alone in left.items() if sizes[name]}
    return {name: sorted(found) for name, found in cuts.items()}


def _few_values(df: DataFrame, cells: dict[str, Column], most: int) -> dict[str, list[float]]:
    """The ascending values of the columns that have at most ``most``."""
    parts = []
    for block in blocks(list(enumerate(cells.items())), _COLUMNS_PER_SCAN):
        wide = df.select(*[cell.alias(f"c{i}") for i, (_, cell) in block])
        parts.append(wide.mapInArrow(_listing([i for i, _ in block], most), "place int, value double"))
    found = (
        union_all(parts)
        .groupBy("place")
        .agg(F.bool_or(F.col("value").isNull()).alias("many"), F.sort_array(F.collect_set("value")).alias("values"))
        .where(~F.col("many") & (F.size("values") <= most))
        .collect()
    )
    names = list(cells)
    return {names[r["place"]]: r["values"] for r in found}


def binned(
    df: DataFrame, cells: dict[str, Column], cuts: dict[str, list[float]], label: Column, fold: Column, draw: Column
) -> DataFrame:
    """``codes, label, fold, draw, n``: one row per different row, and how many there are of it."""
    edges = [np.array(cuts[name], np.float64) for name in cells]
    wide = df.select(
        *[cell.alias(f"c{i}") for i, cell in enumerate(cells.values())],
        label.cast("int").alias("label"),
        fold.cast("int").alias("fold"),
        draw.cast("bigint").alias("draw"),
    )
    rows = wide.mapInArrow(_coding(edges), ROWS)
    return stored(rows.groupBy("codes", "label", "fold", "draw").agg(F.count(F.lit(1)).alias("n")))


# --- forests ---


@dataclass(frozen=True)
class Plan:
    """A forest to grow on some features, with the rows of one fold held back (-1: none)."""

    columns: tuple[int, ...]
    held: int
    trees: int
    depth: int

    @property
    def tried(self) -> int:
        """Features tried at a node."""
        return len(self.columns) if self.trees == 1 else math.ceil(math.sqrt(len(self.columns)))


class Tree:
    """One tree; node i has the children 2i + 1 and 2i + 2, a leaf has the feature -1."""

    def __init__(self, plan: Plan, number: int, seed: int, classes: int):
        self.plan, self.number, self.seed = plan, number, seed
        self.feature = np.full(2 ** (plan.depth + 1) - 1, -1, np.int64)
        self.cut = np.zeros(len(self.feature), np.int64)
        self.gain, self.rows = np.zeros(len(self.feature)), np.zeros(len(self.feature), np.int64)
        self.guess = np.zeros(len(self.feature), np.int64)
        # Class counts are only needed where rows are told.
        self.counts = np.zeros((len(self.feature) if plan.held >= 0 else 0, classes), np.int64)
        self.open = np.zeros(len(self.feature), bool)
        self.open[0] = True

    def growing(self, level: int) -> bool:
        return level < self.plan.depth and bool(self.open[2**level - 1 : 2 ** (level + 1) - 1].any())

    def _fill(self, node: int, counts: np.ndarray) -> None:
        self.rows[node], self.guess[node], self.open[node] = counts.sum(), counts.argmax(), True
        if len(self.counts):
            self.counts[node] = counts

    def tried(self, level: int) -> np.ndarray:
        """The features tried at each node of a level."""
        drawn = np.random.default_rng([self.seed, self.number, level]).random((2**level, len(self.plan.columns)))
        return np.array(self.plan.columns, np.int64)[np.argsort(drawn, axis=1)[:, : self.plan.tried]]

    def grow(self, first: int, feature: np.ndarray, cut: np.ndarray, gain: np.ndarray, counts: np.ndarray, left: np.ndarray) -> None:
        """Cuts of the nodes from ``first`` on, the rows of each class in them and those that go left."""
        if first == 0:
            self._fill(0, counts[0])
        for i, node in enumerate(range(first, first + len(feature))):
            if self.open[node] and gain[i] > _GAIN:
                self.feature[node], self.cut[node], self.gain[node] = feature[i], cut[i], gain[i]
                self._fill(2 * node + 1, left[i])
                self._fill(2 * node + 2, counts[i] - left[i])

    def merge(self) -> None:
        """A node whose two leaves predict the same class is a leaf."""
        for node in reversed(range(len(self.feature) // 2)):
            below = slice(2 * node + 1, 2 * node + 3)
            if self.feature[node] >= 0 and (self.feature[below] < 0).all() and len(set(self.guess[below])) == 1:
                self.feature[node] = -1

    def importances(self, features: int) -> np.ndarray:
        inner = self.feature >= 0
        weight = self.gain[inner] * self.rows[inner]
        found = np.bincount(self.feature[inner], weight, features)
        return found / found.sum() if found.sum() else found

    def steps(self) -> tuple[np.ndarray, np.ndarray]:
        """Feature and cut of every node; from a leaf all rows go left."""
        leaf = self.feature < 0
        return np.where(leaf, 0, self.feature), np.where(leaf, 255, self.cut)


def grow(rows: DataFrame, plans: Sequence[Plan], classes: int, seed: int) -> list[list[Tree]]:
    """The trees of every plan, level by level, all of them in the same jobs."""
    forests = [[Tree(plan, i, seed, classes) for i in range(plan.trees)] for plan in plans]
    trees = [tree for forest in forests for tree in forest]
    for level in range(max((plan.depth for plan in plans), default=0)):
        block, held = [], 0
        for tree in (tree for tree in trees if tree.growing(level)):
            size = tree.plan.tried * BINS * classes
            step = max(1, _COUNTERS // size)
            for low in range(0, 2**level, step):
                high = min(low + step, 2**level)
                if block and held + (high - low) * size > _COUNTERS:
                    _grow_nodes(rows, block, level, classes, seed)
                    block, held = [], 0
                block.append((tree, low, high))
                held += (high - low) * size
        if block:
            _grow_nodes(rows, block, level, classes, seed)
    for tree in trees:
        tree.merge()
    return forests


def _grow_nodes(rows: DataFrame, parts: list[tuple[Tree, int, int]], level: int, classes: int, seed: int) -> None:
    """Cuts some trees' nodes from a lowest to below a highest of a level, in one job."""
    tried = [tree.tried(level) for tree, _, _ in parts]
    wanted = [(tree.plan.held, tree.number, *tree.steps(), low, high, picked) for (tree, low, high), picked in zip(parts, tried)]
    counters = rows.mapInArrow(_counting(wanted, level, classes, seed), "part int, counts binary")
    shapes = [(high - low, picked.shape[1]) for (_, low, high), picked in zip(parts, tried)]
    chosen = counters.groupBy("part").applyInArrow(
        _choosing(shapes, classes), "part int, slot binary, cut binary, gain binary, counts binary, below binary"
    )
    # At most a sixteenth of the counters of a task.
    for r in chosen.collect():
        tree, low, high = parts[r["part"]]
        slot, cut = (np.frombuffer(r[name], np.int64) for name in ("slot", "cut"))
        counts, left = (np.frombuffer(r[name], np.int64).reshape(-1, classes) for name in ("counts", "below"))
        feature = tried[r["part"]][np.arange(low, high), slot]
        tree.grow(2**level - 1 + low, feature, cut, np.frombuffer(r["gain"], np.float64), counts, left)


def fold_scores(rows: DataFrame, plans: Sequence[Plan], classes: int, seed: int) -> list[float | None]:
    """How many of the rows held back each plan's forest tells right, as a share; None without rows to learn from or to tell."""
    found: list[float | None] = []
    # The driver and the tasks hold the class counts of a block's leaves.
    per_plan = max((plan.trees * 2 ** (plan.depth + 1) * classes for plan in plans), default=1)
    for block in blocks(list(plans), max(1, _COUNTERS // (8 * per_plan))):
        forests = grow(rows, block, classes, seed)
        learned = [any(tree.rows[0] for tree in forest) for forest in forests]
        wanted = [
            (plan.held, plan.depth, [(*tree.steps(), _shares(tree.counts)) for tree in forest])
            for plan, forest in zip(block, forests)
        ]
        told = rows.mapInArrow(_telling(wanted, classes), "plan int, told bigint, held bigint")
        summed = {r["plan"]: r for r in told.groupBy("plan").agg(F.sum("told").alias("told"), F.sum("held").alias("held")).collect()}
        for i in range(len(block)):
            held = summed[i]["held"] if i in summed else 0
            found.append(summed[i]["told"] / held if held and learned[i] else None)
    return found


def _shares(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)


def importances(rows: DataFrame, plan: Plan, features: int, classes: int, seed: int) -> list[float]:
    """Gini importances of one forest, every tree counting the same; sum 1."""
    found = np.zeros(features)
    for tree in grow(rows, [plan], classes, seed)[0]:
        found += tree.importances(features)
    return (found / found.sum() if found.sum() else found).tolist()


# What tasks run. Each is a closure without names of this package, so that workers need none of it.


def _listing(places: list[int], most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The different values of each column in a task's rows, or one null where there are more than ``most``."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray | None] = [np.zeros(0) for _ in places]
        for batch in batches:
            for i, column in enumerate(batch.columns):
                if held[i] is not None:
                    values = column.drop_null().to_numpy(zero_copy_only=False) + 0.0
                    both = np.unique(np.concatenate([held[i], values]))
                    held[i] = both if len(both) <= most else None
        for place, values in zip(places, held, strict=True):
            listed = [None] if values is None else values.tolist()
            if listed:
                yield pa.RecordBatch.from_arrays([pa.array([place] * len(listed), pa.int32()), pa.array(listed, pa.float64())], ["place", "value"])

    return gather


def _coding(edges: list[np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each row's cells as the numbers of cuts below them, one byte a cell."""
    width = len(edges)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.empty((batch.num_rows, width), np.uint8)
            for i, cuts in enumerate(edges):
                codes[:, i] = np.searchsorted(cuts, batch.column(i).to_numpy(zero_copy_only=False))
            offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * width
            packed = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(codes)])
            yield pa.RecordBatch.from_arrays([packed, *batch.columns[width:]], ["codes", "label", "fold", "draw"])

    return code


def _reading(classes: int) -> Callable:
    cells = _CELLS

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        """Codes with a row for each row, then label, fold, draw and number of rows; so many rows at once that they stay small."""
        for whole in batches:
            if whole.num_rows:
                step = max(1, cells // max(len(whole.column("codes")[0].as_py()), classes))
                for batch in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                    numbers = [batch.column(name).to_numpy(zero_copy_only=False) for name in ("label", "fold", "draw", "n")]
                    codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                    yield (codes.astype(np.int64), *numbers)

    return read


def _drawing(seed: int) -> Callable:
    """How often each row is in the bootstrap sample of each of some trees: Poisson numbers from its digest."""
    tables: dict[int, np.ndarray] = {}

    def table(rows: int) -> np.ndarray:
        """The Poisson number for each of 2 ** 16 equal shares; above 64 rows, of its deviate (Cornish-Fisher)."""
        if rows not in tables:
            share = (np.arange(65536) + 0.5) / 65536
            if rows <= 64:
                k = np.arange(int(rows + 12 * rows**0.5 + 12))
                logs = np.concatenate([[0.0], np.cumsum(np.log(k[1:]))])
                tables[rows] = np.searchsorted(np.cumsum(np.exp(k * np.log(rows) - rows - logs)), share).astype(np.float64)
            else:
                from statistics import NormalDist

                tables[rows] = np.array([NormalDist().inv_cdf(x) for x in share])
        return tables[rows]

    def mixed(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def draws(digest: np.ndarray, rows: np.ndarray, trees: int) -> np.ndarray:
        found = np.empty((trees, len(digest)))
        start = digest.view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) % 2**64)
        repeated = np.flatnonzero(rows > 1)
        many = rows[repeated]
        for tree in range(trees):
            if tree % 4 == 0:
                start = start + np.uint64(0x9E3779B97F4A7C15)
                bits = mixed(start)
            part = ((bits >> np.uint64(16 * (tree % 4))) & np.uint64(65535)).astype(np.int64)
            found[tree] = table(1)[part]
            if len(repeated):
                part = part[repeated]
                z = table(65)[part]
                own = np.maximum(np.floor(many + np.sqrt(many) * z + (z * z - 1) / 6 + 0.5), 0)
                for value in np.unique(many[many <= 64]).tolist():
                    own[many == value] = table(value)[part[many == value]]
                found[tree, repeated] = own
        return found

    return draws


def _counting(wanted: list[tuple], level: int, classes: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Weighted rows of each tree by node, feature tried, bin and class, over a task's rows."""
    read, draws, bins = _reading(1), _drawing(seed), BINS
    trees = max(number for _, number, *_ in wanted) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros((high - low) * picked.shape[1] * bins * classes) for *_, low, high, picked in wanted]
        for codes, label, fold, digest, rows in read(batches):
            weights = draws(digest, rows, trees)
            for out in {back for back, *_ in wanted}:
                inside = np.flatnonzero(fold != out)
                flat = codes[inside].ravel()
                joined = (codes[inside] * classes + label[inside, None]).ravel()
                starts = np.arange(len(inside)) * codes.shape[1]
                # Rows that a bootstrap sample holds, by the number of the tree.
                drawn: dict[int, tuple[np.ndarray, np.ndarray]] = {}
                for (back, number, feature, cut, low, high, picked), sums in zip(wanted, held, strict=True):
                    if back != out:
                        continue
                    if number not in drawn:
                        weight = weights[number, inside]
                        there = np.flatnonzero(weight)
                        drawn[number] = starts[there], weight[there]
                    start, weight = drawn[number]
                    node = np.zeros(len(start), np.int64)
                    for _ in range(level):
                        right = flat.take(start + feature.take(node)) > cut.take(node)
                        node *= 2
                        node += 1
                        node += right
                    node -= 2**level - 1
                    if high - low < 2**level:
                        there = np.flatnonzero((node >= low) & (node < high))
                        node, start, weight = node[there], start[there], weight[there]
                    for slot in range(picked.shape[1]):
                        at = joined.take(start + picked[:, slot].take(node))
                        at += ((node - low) * picked.shape[1] + slot) * (bins * classes)
                        if len(sums) < 8 * len(at):
                            sums += np.bincount(at, weight, len(sums))
                        else:
                            np.add.at(sums, at, weight)
        for part, sums in enumerate(held):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([sums.astype(np.int64).tobytes()], pa.binary())], ["part", "counts"])

    return count


def _choosing(shapes: list[tuple[int, int]], classes: int) -> Callable[[pa.Table], pa.Table]:
    """The best cut of each of a tree's nodes, from the counters of all tasks; ``shapes`` are nodes and features tried."""
    bins = BINS

    def choose(counters: pa.Table) -> pa.Table:
        part = counters.column("part")[0].as_py()
        size, tried = shapes[part]
        total = np.zeros(size * tried * bins * classes, np.int64)
        for payload in counters.column("counts"):
            total += np.frombuffer(payload.as_buffer(), np.int64)
        total = total.reshape(size, tried, bins, classes)
        left = total.cumsum(axis=2)[:, :, :-1]
        every = total[:, 0].sum(axis=1)
        right = every[:, None, None] - left
        lows, highs, all_ = left.sum(axis=-1), right.sum(axis=-1), every.sum(axis=-1)
        with np.errstate(divide="ignore", invalid="ignore"):
            # The gain of Gini impurity, in sums of squared class counts.
            kept = (left.astype(float) ** 2).sum(axis=-1) / lows + (right.astype(float) ** 2).sum(axis=-1) / highs
            before = (every.astype(float) ** 2).sum(axis=-1) / all_
            gain = (kept - before[:, None, None]) / all_[:, None, None]
        gain = np.where((lows > 0) & (highs > 0), gain, 0.0).reshape(size, -1)
        best = gain.argmax(axis=1)
        nodes = np.arange(size)
        slot, cut = best // (bins - 1), best % (bins - 1)
        found = [slot.astype(np.int64), cut.astype(np.int64), gain[nodes, best], every, left[nodes, slot, cut]]
        names = ["part", "slot", "cut", "gain", "counts", "below"]
        return pa.table([pa.array([part], pa.int32()), *[pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in found]], names)

    return choose


def _telling(wanted: list[tuple], classes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows held back from each forest, and those among them whose class it tells."""
    read = _reading(classes)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right, held = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.int64)
        for codes, label, fold, _, rows in read(batches):
            for out in {back for back, *_ in wanted}:
                inside = np.flatnonzero(fold == out)
                if not len(inside):
                    continue
                flat, own, n = codes[inside].ravel(), label[inside], rows[inside]
                start = np.arange(len(inside)) * codes.shape[1]
                for i, (back, depth, forest) in enumerate(wanted):
                    if back != out:
                        continue
                    votes = np.zeros((len(inside), classes))
                    for feature, cut, shares in forest:
                        node = np.zeros(len(inside), np.int64)
                        for _ in range(depth):
                            below = flat.take(start + feature.take(node)) > cut.take(node)
                            node = np.where(cut.take(node) == 255, node, 2 * node + 1 + below)
                        votes += shares[node]
                    right[i] += n[votes.argmax(axis=1) == own].sum()
                    held[i] += n.sum()
        numbers = [np.arange(len(wanted), dtype=np.int32), right, held]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in numbers], ["plan", "told", "held"])

    return tell
