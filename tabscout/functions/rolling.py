"""Which of many short texts stand inside long ones: rolling hashes per length, a filter of fixed size, equality at last."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscout.functions.lineage import stored

#: log2 of the bits of the filter that windows pass before they become rows; the driver and every task hold it (4 MB).
FILTER_BITS = 25
#: Characters of a text that are hashed at a time, and rows that leave a task at a time.
CHUNK, ROWS = 1 << 20, 1 << 14


def _hashing(chunk: int) -> Callable[[str, np.ndarray], Iterator[tuple[int, int, np.ndarray]]]:
    """A function from a text and ascending lengths to (length, first position, hashes of windows from there on).

    Hashes are polynomials modulo 2^64, from differences of prefix sums: the sum
    of c_j B^j over a window, divided by B to the power of its start. They depend on the
    window's characters and length alone. A chunk overlaps the next one by the longest length.
    """
    base, inverse = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
    powers: list[np.ndarray] = []

    def grown(n: int) -> list[np.ndarray]:
        if not powers or len(powers[0]) < n:
            powers[:] = [np.full(n, b, np.uint64) for b in (base, inverse)]
            for p in powers:
                p[0] = 1
                np.cumprod(p, out=p)
        return powers

    def hashes(text: str, lengths: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        symbols = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        lengths = lengths[lengths <= len(symbols)]
        if not len(lengths):
            return
        longest = int(lengths[-1])
        for start in range(0, len(symbols), chunk):
            part = symbols[start : start + chunk + longest - 1]
            up, down = grown(len(part) + 1)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * up[: len(part)])])
            for k in lengths.tolist():
                count = min(chunk, len(part) - k + 1)
                if count > 0:
                    h = (sums[k : k + count] - sums[:count]) * down[:count] + np.uint64(k)
                    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                    yield k, start, h ^ (h >> np.uint64(31))

    return hashes


def contained_pieces(values: DataFrame, targets: DataFrame, bits: int = FILTER_BITS, chunk: int = CHUNK) -> DataFrame:
    """``feature, piece``: every target ``piece`` that some ``value`` of a feature contains, once.

    A text contains a piece exactly when one of its windows of the piece's
    length equals it. For every length that targets have, the hashes of all windows of a text
    are computed in one pass each. Windows whose hash is not in a bit filter of
    the targets' hashes stop there; the others become rows and
    are compared with the targets as texts. So the filter decides only how much
    is compared, never the result. Long texts are taken in chunks, rows leave a task in
    bounded batches, and equal rows are merged before any shuffle: a piece that is everywhere
    moves once per task. Null and empty pieces are contained in nothing.
    """
    wanted = stored(targets.where("piece IS NOT NULL AND piece <> ''").select("piece").distinct())
    # One number per length of a target, and the filter, reach the driver.
    lengths = np.array([r.k for r in wanted.select(F.length("piece").alias("k")).distinct().orderBy("k").collect()], np.int64)
    schema = "feature string, piece string"
    if not len(lengths):
        return values.sparkSession.createDataFrame([], schema)
    shift, hashes = 64 - bits, _hashing(chunk)  # a closure, so that workers need nothing of this package

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [h[0] for piece in batch.column(0).to_pylist() for _, _, h in hashes(piece, np.array([len(piece)]))]
            at = np.unique(np.array(own, np.uint64) >> np.uint64(shift)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at)], ["at"])

    # Positions of set bits, 63 to a number: at most 2 ** bits / 63 rows whatever the number of targets.
    words = wanted.mapInArrow(place, "at bigint").groupBy(F.floor(F.col("at") / 63).cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at % 63 as int))")).alias("held")
    )
    table = np.zeros((1 << bits) // 63 + 1, np.int64)
    for row in words.toArrow().to_batches():
        table[row.column("word").to_numpy()] = row.column("held").to_numpy()

    def packed(rows: set[tuple[str, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], ["feature", "piece"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: set[tuple[str, str]] = set()
        for batch in batches:
            for feature, value in zip(batch.column("feature").to_pylist(), batch.column("value").to_pylist(), strict=True):
                if value is None:
                    continue
                for k, start, h in hashes(value, lengths):
                    at = (h >> np.uint64(shift)).astype(np.int64)
                    hits = start + np.flatnonzero((table[at // 63] >> (at % 63)) & 1)
                    for i in range(0, len(hits), ROWS):
                        rows |= {(feature, value[x : x + k]) for x in hits[i : i + ROWS].tolist()}
                        if len(rows) >= ROWS:
                            yield packed(rows)
                            rows = set()
        yield packed(rows)

    candidates = values.select("feature", "value").mapInArrow(find, schema)
    return candidates.groupBy("feature", "piece").agg(F.lit(1).alias("one")).select("feature", "piece").join(wanted, "piece", "left_semi").select("feature", "piece")
