"""Nearest neighbours by inner product with one vantage-point tree per shard."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabscout.llm.ship import ship

#: Vectors of a shard and queries of a block: what one task holds at a time.
SHARD, BLOCK = 8192, 8192
#: Vectors of a leaf.
LEAF = 128
#: Pruning with factor 1 is exact; a larger one skips more.
FACTOR = 1.0
# Rounding of products of vectors, by width and lengths; distances are roots of differences of products.
_ROUNDING = 2.0**-50


@dataclass
class Tree:
    """A vantage-point tree over vectors lifted to one length.

    Every vector x gets one more coordinate, sqrt(M^2 - |x|^2) with M the
    largest norm of all shards, and every query a zero. The distance of a
    lifted query to a lifted vector is then sqrt(|q|^2 + M^2 - 2 q.x): nearest
    in that metric is largest in inner product. ``vectors`` and ``ids`` stand
    in leaf order. A node is a row of ``nodes``: first and last position, its
    vantage point's position, its children, and for each child the least and
    greatest distance to the vantage point.
    """

    ids: np.ndarray
    vectors: np.ndarray
    nodes: np.ndarray

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray, norm: float, leaf: int = LEAF) -> Tree:
        with np.errstate(over="ignore", invalid="ignore"):
            return cls._build(ids, vectors, norm, leaf)

    @classmethod
    def _build(cls, ids: np.ndarray, vectors: np.ndarray, norm: float, leaf: int) -> Tree:
        norm = np.float64(norm)
        lifted = np.column_stack([vectors, np.sqrt(np.maximum(norm**2 - (vectors**2).sum(1), 0))])
        order, nodes = np.arange(len(ids)), []

        def split(start: int, end: int) -> int:
            number = len(nodes)
            nodes.append(None)
            row = [start, end, -1, -1, -1, 0, 0, 0, 0]
            if end - start > leaf:
                own = order[start:end]
                distances = np.sqrt(((lifted[own] - lifted[own[0]]) ** 2).sum(1))
                by = np.argsort(distances, kind="stable")
                order[start:end], distances = own[by], distances[by]
                half = (end - start) // 2
                vantage = start  # the vantage point has distance 0 to itself, so it comes first
                bounds = [distances[0], distances[half - 1], distances[half], distances[-1]]
                row = [start, end, vantage, 0, 0, *bounds]
                # Children reorder their positions; the vantage point is kept by its original number.
                row[2] = order[start]
                row[3], row[4] = split(start, start + half), split(start + half, end)
            nodes[number] = row
            return number

        split(0, len(ids))
        table = np.array(nodes, np.float64)
        position = np.empty(len(ids), np.int64)
        position[order] = np.arange(len(ids))
        inner = table[:, 2] >= 0
        table[inner, 2] = position[table[inner, 2].astype(np.int64)]
        return cls(ids[order], np.ascontiguousarray(vectors[order]), table)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, norm: float, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """For each query the ids and scores of the ``k`` best (score, then smaller id); -inf where there are fewer."""
        if factor < 1:
            raise ValueError("the pruning factor is at least 1")
        with np.errstate(over="ignore", invalid="ignore"):
            return self._search(query_ids, queries, np.float64(norm), k, factor)

    def _search(self, query_ids: np.ndarray, queries: np.ndarray, norm: np.float64, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        own = (queries**2).sum(1)
        lengths = own + norm**2
        rounding = _ROUNDING * (queries.shape[1] + 4)
        slack, product_slack = np.sqrt(rounding) * (norm + np.sqrt(own)), rounding * norm * np.sqrt(own)
        scores = np.full((len(queries), k), -np.inf)
        best = np.full((len(queries), k), np.iinfo(np.int64).max)
        reach = np.full(len(queries), np.inf)

        def scan(start: int, end: int, active: np.ndarray) -> None:
            near = queries[active] @ self.vectors[start:end].T
            row, col = np.nonzero(~(near < (scores[active, -1] - product_slack[active])[:, None]))
            other = self.ids[start + col] != query_ids[active[row]]
            row, col = row[other], start + col[other]
            if not len(row):
                return
            exact = inner_products(queries, active[row], self.vectors, col)
            # The candidates of a query side by side, in a rectangle as wide as the longest list.
            found, counts = np.unique(row, return_counts=True)
            width = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            at = np.repeat(np.arange(len(found)), counts)
            who = active[found]
            more = np.full((len(found), counts.max()), -np.inf)
            names = np.full(more.shape, np.iinfo(np.int64).max)
            more[at, width], names[at, width] = exact, self.ids[col]
            more, names = np.hstack([scores[who], more]), np.hstack([best[who], names])
            top = np.lexsort((names, -more), axis=-1)[:, :k]
            scores[who], best[who] = np.take_along_axis(more, top, 1), np.take_along_axis(names, top, 1)
            reach[who] = np.sqrt(np.maximum(lengths[who] - 2 * scores[who, -1], 0))

        def visit(node: int, active: np.ndarray) -> None:
            if not len(active):
                return
            start, end, vantage, left, right = self.nodes[node, :5].astype(np.int64)
            if vantage < 0:
                return scan(start, end, active)
            least_in, most_in, least_out, most_out = self.nodes[node, 5:]
            distance = np.sqrt(np.maximum(lengths[active] - 2 * (queries[active] @ self.vectors[vantage]), 0))
            inside = np.maximum(distance - most_in, least_in - distance)
            outside = np.maximum(distance - most_out, least_out - distance)
            first = distance <= (most_in + least_out) / 2

            def open_(bound: np.ndarray, side: np.ndarray) -> np.ndarray:
                return active[side & ~(factor * (bound - slack[active]) > reach[active] + slack[active])]  # opened if not a number

            visit(left, open_(inside, first))
            visit(right, open_(outside, ~first))
            visit(right, open_(outside, first))
            visit(left, open_(inside, ~first))

        visit(0, np.arange(len(queries)))
        return best, scores


def inner_products(a: np.ndarray, rows_a: np.ndarray, b: np.ndarray, rows_b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed from the first coordinate on: the same bits for equal vectors."""
    total = np.zeros(len(rows_a))
    for j in range(a.shape[1]):
        total += a[rows_a, j] * b[rows_b, j]
    return total


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """``id, vector, width`` of the rows that take part: a key and a non-zero, finite vector without nulls."""
    vector = F.col(f"`{column}`").cast("array<double>")
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        vectors.where(F.col(f"`{key}`").isNotNull() & fine & F.exists(vector, lambda x: x != 0))
        .select(F.col(f"`{key}`").cast("bigint").alias("id"), vector.alias("vector"))
        .withColumn("width", F.size("vector"))
    )


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    column = table.column("vector").combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    return table.column("id").to_numpy(), values.reshape(len(column), -1)


def _spread(rows: int, most: int) -> Column:
    """A group number from the id, so that groups hold about ``most`` rows whatever the ids or vectors are."""
    return F.pmod(F.xxhash64("id"), F.lit(max(1, ceil(rows / most)))).cast("int")


def nearest(
    candidates: DataFrame,
    queries: DataFrame,
    k: int,
    key: str = "vec_id",
    column: str = "embedding",
    factor: float = FACTOR,
    shard: int = SHARD,
    block: int = BLOCK,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products of every query with other rows.

    Rows are dealt to shards by a hash of their key, so shards are even however
    many vectors are equal; each shard becomes one tree, and every tree meets
    every block of queries in its own task. A task prunes a subtree when
    ``factor`` times the distance bound of the triangle inequality exceeds the
    distance of the k-th best so far; 1 is exact. The best of a shard are
    merged by query, at most ``k`` per shard. Scores are summed in double
    precision from the first coordinate; ties go to the smaller key. Rows whose
    key equals the query's are its own. Vectors are compared with vectors of the
    same width; see ``usable`` for the rows left out. Fewer than ``k`` candidates
    give fewer ranks; an empty table gives no rows. Equal query rows are one
    query; rows that share a key but not the vector are ranked each for itself.
    Repeated candidate rows take a rank each.
    """
    spark = candidates.sparkSession
    ship(spark)
    rows = usable(candidates, key, column)
    asked = usable(queries, key, column).distinct().withColumn("digest", F.xxhash64("vector"))
    # Two counts and a norm reach the driver.
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)).alias("most")).first()
    n_queries = asked.count()
    norm = float(np.sqrt(size.most or 0.0)) * (1 + 1e-12)
    shards, blocks = max(1, ceil(size.n / shard)), max(1, ceil(n_queries / block))

    def build(group: pa.Table) -> pa.Table:
        ids, vectors = _matrix(group)
        tree = Tree.build(ids, vectors, norm)
        blobs = [x.tobytes() for x in (tree.ids, tree.vectors, tree.nodes)]
        return pa.table(
            {
                "shard": pa.array([group.column("shard")[0].as_py()], pa.int32()),
                "width": pa.array([vectors.shape[1]], pa.int32()),
                **{n: pa.array([b], pa.binary()) for n, b in zip(("ids", "vectors", "nodes"), blobs, strict=True)},
            }
        )

    trees = (
        rows.withColumn("shard", _spread(size.n, shard))
        .groupBy("shard", "width")
        .applyInArrow(build, "shard int, width int, ids binary, vectors binary, nodes binary")
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    )
    posed = asked.withColumn("block", _spread(n_queries, block)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def search(trees: pa.Table, posed: pa.Table) -> pa.Table:
        names = ["query_id", "digest", "vec_id", "score"]
        if not trees.num_rows or not posed.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64())], names)
        row = trees.to_pylist()[0]
        ids = np.frombuffer(row["ids"], np.int64)
        tree = Tree(ids, np.frombuffer(row["vectors"]).reshape(len(ids), -1), np.frombuffer(row["nodes"]).reshape(-1, 9))
        query_ids, vectors = _matrix(posed)
        best, scores = tree.search(query_ids, vectors, norm, k, factor)
        found = np.isfinite(scores)
        asker = [np.repeat(x, found.sum(1)) for x in (query_ids, posed.column("digest").to_numpy())]
        return pa.table([*asker, best[found], scores[found]], names)

    found = (
        trees.groupBy("shard", "width", "block")
        .cogroup(posed.groupBy("shard", "width", "block"))
        .applyInArrow(search, "query_id bigint, digest bigint, vec_id bigint, score double")
    )
    rank = F.row_number().over(W.partitionBy("query_id", "digest").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
