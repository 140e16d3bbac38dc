"""Ranked lexical search: exact inner products over sparse term vectors, pruned by ball trees."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import floor, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabscout.functions.lineage import stored
from tabscout.llm.ship import ship

#: Documents and entries of one tree: what a task holds at a time.
SHARD, ENTRIES = 8192, 4_000_000
#: Documents of a leaf, and rounds of the power method that finds where to cut a ball in two.
LEAF, POWER = 64, 4
#: Text bytes of the items that are searched in one pass over the documents, on average.
ITEM_BYTES = 2 << 20
#: Scores are whole numbers: a document's part of a term is SCALE * tf div (1000 * tf + 8 * m), with m around 100.
SCALE, STEEP, BASE, SLOPE = 1_000_000_000, 8, 100, 90
_EPSILON = 2.0**-52

# Bytes of terms, A to Z lowered; all other bytes become spaces. Bytes from 128 on are parts of letters beyond ASCII.
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text in order: runs of ASCII letters and digits and of all characters beyond ASCII."""
    return (text or b"").translate(_TERM).split()


@dataclass(frozen=True)
class Sparse:
    """Rows of non-negative numbers, only those that are not 0: row i has entries ``starts[i]`` to ``starts[i + 1]``."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray

    def __len__(self) -> int:
        return len(self.starts) - 1

    def rows(self, first: int, last: int) -> Sparse:
        a, b = self.starts[first], self.starts[last]
        return Sparse(self.starts[first : last + 1] - a, self.columns[a:b], self.values[a:b])

    def taken(self, order: np.ndarray) -> Sparse:
        lengths = np.diff(self.starts)[order]
        starts = np.concatenate([[0], np.cumsum(lengths)])
        at = np.repeat(self.starts[order] - starts[:-1], lengths) + np.arange(starts[-1])
        return Sparse(starts, self.columns[at], self.values[at])

    def products(self, dense: np.ndarray) -> np.ndarray:
        """The inner product of every row with a dense vector, in the numbers that both have."""
        return self.sums(self.values * dense[self.columns])

    def sums(self, entries: np.ndarray) -> np.ndarray:
        if not len(entries):
            return np.zeros(len(self), entries.dtype)
        padded = np.append(entries, entries.dtype.type(0))
        totals = np.add.reduceat(padded, self.starts[:-1])
        totals[np.diff(self.starts) == 0] = 0
        return totals


class BallTree:
    """Balls around rows of a sparse matrix, halved until ``leaf`` rows are left.

    A ball is the mean of its rows and a radius that no row exceeds. Rows are
    halved at the median along a direction in which they spread widely, so the
    tree is even however many rows are equal. ``order`` are row
    numbers in leaf order; node i covers ``first[i]`` to ``last[i]`` and has the
    children ``left[i]`` and ``right[i]`` (-1: a leaf).
    """

    def __init__(self, rows: Sparse, width: int, leaf: int = LEAF):
        self.leaf, self.width = leaf, width
        self.order = np.arange(len(rows))
        self.first, self.last, self.left, self.right, self.radius = [], [], [], [], []
        self._centres: list[tuple[np.ndarray, np.ndarray]] = []
        self._build(rows, 0, np.arange(len(rows)))
        lengths = [len(columns) for columns, _ in self._centres]
        self.centres = Sparse(
            np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64),
            np.concatenate([c for c, _ in self._centres]),
            np.concatenate([v for _, v in self._centres]),
        )
        self.radius = np.array(self.radius)

    def _distances(self, rows: Sparse, squares: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Squared distances to a point, never too small: the rounding error of sums and differences is added."""
        own = float(dense @ dense)
        slack = 8 * _EPSILON * (self.width + 8) * (squares + own)
        return np.maximum(squares - 2 * rows.products(dense) + own, 0) + slack

    def _build(self, rows: Sparse, first: int, numbers: np.ndarray) -> int:
        node, n = len(self.first), len(rows)
        dense = np.bincount(rows.columns, rows.values, self.width) / n
        squares = rows.sums(rows.values * rows.values)
        away = self._distances(rows, squares, dense)
        columns = np.flatnonzero(dense)
        self._centres.append((columns, dense[columns]))
        self.first.append(first)
        self.last.append(first + n)
        self.radius.append(float(np.sqrt(away.max())) * (1 + 4 * _EPSILON))
        self.left.append(-1)
        self.right.append(-1)
        if n <= self.leaf:
            self.order[first : first + n] = numbers
            return node
        halves = np.argsort(self._along(rows, dense, int(away.argmax())), kind="stable")
        for side, part in (("left", halves[: n // 2]), ("right", halves[n // 2 :])):
            getattr(self, side)[node] = self._build(rows.taken(part), first, numbers[part])
            first += len(part)
        return node

    def _along(self, rows: Sparse, centre: np.ndarray, far: int) -> np.ndarray:
        """Positions of the rows along a direction in which they spread widely.

        Some rounds of the power method on the centred rows, from the row farthest from the
        centre. Rows that are alike get positions that are alike, so they stay together.
        """
        a, b = rows.starts[far], rows.starts[far + 1]
        direction = -centre
        direction[rows.columns[a:b]] += rows.values[a:b]
        lengths = np.diff(rows.starts)
        for _ in range(POWER):
            at = rows.products(direction) - centre @ direction
            direction = np.bincount(rows.columns, rows.values * np.repeat(at, lengths), self.width) - centre * at.sum()
            size = np.abs(direction).max()
            if not 0 < size < np.inf:
                break
            direction /= size
        return rows.products(direction)

    def bounds(self, query: np.ndarray) -> np.ndarray:
        """For every node a number that no row's inner product with the query exceeds, rounding included.

        By Cauchy and Schwarz q.x = q.c + q.(x - c) <= q.c + |q| * radius, where only those entries of q
        count that the ball's rows have, which are those of its centre. All numbers are
        non-negative, so a sum of n of them is off by n roundings at most.
        """
        own = query[self.centres.columns]
        reach = np.sqrt(self.centres.sums(own * own))
        return (self.centres.sums(self.centres.values * own) + reach * self.radius) * (1 + 4 * _EPSILON * (self.width + 8)) + 1


@dataclass(frozen=True)
class Items:
    """A block of items: each one's distinct terms as numbers, and what the corpus says of the terms."""

    numbers: list[int | None]
    terms: list[np.ndarray]
    weights: np.ndarray


class Best:
    """Per item the ``k`` best documents so far as (score, id with nulls last); the order never depends on arrival."""

    def __init__(self, n: int, k: int):
        self.k, self.found = k, [[] for _ in range(n)]

    def threshold(self, i: int) -> int:
        """Documents with less than this score cannot be among the best."""
        return self.found[i][0][0] if len(self.found[i]) == self.k else 1

    def add(self, i: int, scores: np.ndarray, ids: np.ndarray, blank: np.ndarray) -> None:
        heap = self.found[i]
        for at in np.flatnonzero(scores >= self.threshold(i)):
            entry = (int(scores[at]), not blank[at], -int(ids[at]))
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)


def search_shard(ids: np.ndarray, blank: np.ndarray, parts: Sparse, items: Items, best: Best, leaf: int = LEAF) -> int:
    """Finds the best documents of one shard for every item; returns how many documents were scored.

    ``parts`` has every document's whole-number part of each term. The tree is
    built over coordinates times the root of the term's weight, which leaves inner products as
    they are and lets rare terms shape the balls. Nodes are opened by falling
    bound until the next bound is below the item's k-th best score; leaves are
    scored in whole numbers.
    """
    roots = np.sqrt(items.weights.astype(np.float64))
    tree = BallTree(Sparse(parts.starts, parts.columns, parts.values * roots[parts.columns]), len(roots), leaf)
    ordered, ids, blank = parts.taken(tree.order), ids[tree.order], blank[tree.order]
    real, whole, scored = np.zeros(len(roots)), np.zeros(len(roots), np.int64), 0
    for i, own in enumerate(items.terms):
        real[own], whole[own] = roots[own], items.weights[own]
        bounds = tree.bounds(real)
        queue = [(-bounds[0], 0)]
        while queue and -queue[0][0] >= best.threshold(i):
            node = heapq.heappop(queue)[1]
            if tree.left[node] < 0:
                first, last = tree.first[node], tree.last[node]
                best.add(i, ordered.rows(first, last).products(whole), ids[first:last], blank[first:last])
                scored += last - first
            else:
                for child in (tree.left[node], tree.right[node]):
                    heapq.heappush(queue, (-bounds[child], child))
        real[own], whole[own] = 0.0, 0
    return scored


def count_terms(docs: DataFrame, numbers: dict[bytes, int], key: str, text: str) -> DataFrame:
    """``id, n, terms, counts`` of every document with a term: its terms with repeats, and those with a number, ascending."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n, found, counts = [], [], [], []
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = terms(raw)
                if own:
                    column, times = np.unique([numbers[t] for t in own if t in numbers], return_counts=True)
                    ids.append(i)
                    n.append(len(own))
                    found.append(column.astype(np.int32))
                    counts.append(times)
            arrays = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "n", "terms", "counts"])

    ids = F.col(f"`{key}`").cast("bigint").alias("id")
    return docs.select(ids, F.col(f"`{text}`").cast("binary").alias("raw")).mapInArrow(count, "id bigint, n bigint, terms array<int>, counts array<bigint>")


def term_weights(n_documents: int, frequencies: np.ndarray) -> np.ndarray:
    """floor(1000 * ln((2 N + 2) / (2 df + 1))) of every term."""
    return np.array([floor(1000 * log((2 * n_documents + 2) / (2 * int(df) + 1))) for df in frequencies], np.int64)


def document_parts(n: np.ndarray, counts: Sparse, n_documents: int, n_terms: int) -> np.ndarray:
    """The whole-number part of every entry: SCALE * tf div (1000 * tf + 8 * m), m by the document's length."""
    m = BASE - SLOPE + (SLOPE * n * n_documents) // n_terms
    tf = counts.values
    return (SCALE * tf) // (1000 * tf + STEEP * np.repeat(m, np.diff(counts.starts)))


def _lists(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together up to ``SHARD`` documents or ``ENTRIES`` entries."""
    held, rows, entries = [], 0, 0
    for batch in batches:
        for start in range(0, len(batch), 1024):
            piece = batch.slice(start, 1024)
            held.append(piece)
            rows, entries = rows + len(piece), entries + len(piece.column("terms").flatten())
            if rows >= SHARD or entries >= ENTRIES:
                yield pa.Table.from_batches(held)
                held, rows, entries = [], 0, 0
    if rows:
        yield pa.Table.from_batches(held)


def _blocks(items: DataFrame, key: str, text: str, most: int) -> Iterator[list]:
    """Items in blocks of about ``most`` bytes of text by a hash, each with its terms; one block is held at a time."""
    raw = F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b""))
    rows = items.select(F.col(f"`{key}`").cast("bigint").alias("item"), raw.alias("raw"))
    total = rows.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    blocks = 1 + total // most
    number = F.pmod(F.xxhash64("item", "raw"), F.lit(blocks))
    for block in range(blocks):
        part = rows if blocks == 1 else rows.where(number == block)
        found = [(r.item, sorted(set(terms(r.raw)))) for r in part.orderBy("item", "raw").collect()]
        if any(own for _, own in found):
            yield [f for f in found if f[1]]


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents with the highest scores above 0 for every item.

    A term weighs floor(1000 ln((2N + 2) / (2 df + 1))); a score sums weight times
    (10**9 tf) div (1000 tf + 8 m) over the item's distinct terms, m being 10 +
    (90 n N) div L, all in whole numbers. N counts documents with a term, L all their
    terms. Statistics cover all documents, and every document is in a tree.

    Items are taken in blocks, so that what every task gets is bounded whatever
    their number; a block costs one pass over the documents. Documents are
    counted where they are read and written once, restricted to the block's
    terms. A task then makes trees of up to ``SHARD`` of its documents one after
    the other, carries the best of earlier trees as thresholds for later ones
    and hands on ``k`` rows an item; nothing is gathered by document, term or
    copy. Ties go to the smaller id, documents with a null id stand last among
    equals. Rows with equal ids are documents of their own, items as well. Items
    without terms, and any item where no document has a term, give no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    results = [_search_block(docs, block, k, key, text) for block in _blocks(items, item_key, item_text, item_bytes)]
    schema = f"`{item_key}` bigint, rank int, `{key}` bigint, score bigint"
    if not results:
        return spark.createDataFrame([], schema)
    found = results[0]
    for more in results[1:]:
        found = found.union(more)
    return found.toDF(item_key, "rank", key, "score")


def _search_block(docs: DataFrame, block: list, k: int, key: str, text: str) -> DataFrame:
    numbers = {t: i for i, t in enumerate(sorted({t for _, own in block for t in own}))}
    counted = stored(count_terms(docs, numbers, key, text))
    # Two numbers, and one per term of the block, reach the driver.
    size = counted.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("terms")).first()
    frequencies = np.zeros(len(numbers), np.int64)
    for term, df in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        frequencies[term] = df
    weights = term_weights(size.n, frequencies)
    asked = Items([item for item, _ in block], [np.array([numbers[t] for t in own]) for _, own in block], weights)
    n_documents, n_terms = size.n, size.terms

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(asked.terms), k)
        for shard in _shards(b for b in batches if len(b)):
            lengths = pc.list_value_length(shard.column("terms")).to_numpy()
            counts = Sparse(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), _lists(shard.column("terms")), _lists(shard.column("counts")))
            parts = document_parts(shard.column("n").to_numpy(), counts, n_documents, n_terms)
            ids = shard.column("id")
            blank = ids.is_null().to_numpy()
            search_shard(ids.fill_null(0).to_numpy(), blank, Sparse(counts.starts, counts.columns, parts), asked, best)
        rows = [
            (i, asked.numbers[i], -negative if known else None, score) for i, heap in enumerate(best.found) for score, known, negative in heap
        ]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["item", "item_id", "id", "score"])

    held = counted.where(F.size("terms") > 0).mapInArrow(find, "item int, item_id bigint, id bigint, score bigint")
    rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    return held.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "id", "score")
