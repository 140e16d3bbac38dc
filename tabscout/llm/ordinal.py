"""Quality classifier: ordinal cumulative-link regression on hashed text features."""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscout.llm.ship import ship

#: Labelled documents that the model is fitted on, in expectation, however many there are.
SAMPLE = 10_000
#: A feature counts if so many documents of the sample have it.
LEAST_DOCUMENTS = 4
STEPS, RATE, PENALTY = 100, 0.5, 1e-3
_STEPS = (0.02, 0.05, 0.1, 0.2, 0.4)
_EDGE = string.punctuation + "“”„’‘«»…–—¿¡"


def features(text: str) -> np.ndarray:
    """Sorted 32-bit hashes of what a whole text contains, each once.

    These are its words without case and edge punctuation, the ends of words
    that are not letters or digits, and the steps that four shares have
    reached: of words equal to the word before, of words without letters or
    digits, and, among different words, of odd ends and of capitals.
    """
    sequence = text.split()
    tokens = set(sequence)
    stripped = {t: t.strip(_EDGE) for t in tokens}
    found = {t.lower() for t in stripped.values()}
    odd = [t[-3:] for t in tokens if not t[-2:].isalnum()]
    found.update("\x00" + end for end in odd)
    bare = {t for t, word in stripped.items() if not word}
    shares = (
        sum(map(eq, sequence, sequence[1:])) / max(1, len(sequence)),
        sum(map(bare.__contains__, sequence)) / max(1, len(sequence)) if bare else 0.0,
        len(odd) / max(1, len(tokens)),
        sum(map(str.isupper, tokens)) / max(1, len(tokens)),
    )
    found.update(f"\x01{kind} {step}" for kind, share in enumerate(shares) for step in _STEPS if share >= step)
    found.discard("")
    return np.array(sorted({xxhash.xxh32_intdigest(f) for f in found}), np.uint32)


@dataclass(frozen=True)
class Grades:
    """P(grade <= j) = 1 / (1 + exp(-(thresholds[j] - sum of weights of a text's features)))."""

    hashes: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    @classmethod
    def fit(cls, texts: list[np.ndarray], grades: np.ndarray, levels: int) -> Grades:
        """Proximal gradient descent with a rate per weight, twice: an L1 penalty chooses the
        features, and those are then fitted without it.

        Rows and features come in a fixed order, so equal samples give equal
        models. Without rows the thresholds are infinite and every text gets
        the highest grade.
        """
        if not texts:
            return cls(np.zeros(0, np.uint32), np.zeros(0), np.full(levels - 1, -np.inf))
        flat = np.concatenate(texts) if texts else np.zeros(0, np.uint32)
        hashes, counts = np.unique(flat, return_counts=True)
        hashes = hashes[counts >= LEAST_DOCUMENTS]
        row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        at = np.searchsorted(hashes, flat)
        known = at < len(hashes)
        known[known] = hashes[at[known]] == flat[known]
        row, at, n = row[known], at[known], len(texts)
        share = np.clip(np.cumsum(np.bincount(grades, minlength=levels))[:-1] / n, 1e-3, 1 - 1e-3)
        weights, thresholds = _descend(row, at, grades, np.zeros(len(hashes)), np.log(share / (1 - share)), PENALTY)
        chosen = weights != 0
        number = np.cumsum(chosen) - 1
        row, at = row[chosen[at]], number[at[chosen[at]]]
        hashes, weights = hashes[chosen], weights[chosen]
        weights, thresholds = _descend(row, at, grades, weights, thresholds, 0.0)
        return cls(hashes, weights, thresholds)

    def score(self, text: str) -> float:
        own = features(text)
        at = np.searchsorted(self.hashes, own)
        inside = at < len(self.hashes)
        at, own = at[inside], own[inside]
        return float(self.weights[at[self.hashes[at] == own]].sum())

    def above(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > j) of each score, one column per threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - scores[:, None], -700, 700)))


def _descend(
    row: np.ndarray, at: np.ndarray, grades: np.ndarray, weights: np.ndarray, thresholds: np.ndarray, penalty: float
) -> tuple[np.ndarray, np.ndarray]:
    """Fits weights and thresholds to the pairs of row and feature that the sample has."""
    sums, sums_t = np.full(len(weights), 1e-8), np.full(len(thresholds), 1e-8)
    for _ in range(STEPS):
        _, gradient, gradient_t = loss(row, at, grades, weights, thresholds)
        sums += gradient**2
        sums_t += gradient_t**2
        rate = RATE / np.sqrt(sums)
        moved = weights - rate * gradient
        weights = np.sign(moved) * np.maximum(np.abs(moved) - rate * penalty, 0)
        thresholds = np.maximum.accumulate(thresholds - RATE / np.sqrt(sums_t) * gradient_t)
    return weights, thresholds


def loss(
    row: np.ndarray, at: np.ndarray, grades: np.ndarray, weights: np.ndarray, thresholds: np.ndarray
) -> tuple[float, np.ndarray, np.ndarray]:
    """The mean of -log P(grade) over the sample, and its gradients by weights and by thresholds."""
    n, cuts = len(grades), len(thresholds)
    every = np.arange(n)
    score = np.bincount(row, weights[at], n)
    below = 1 / (1 + np.exp(np.clip(score[:, None] - thresholds, -30, 30)))  # P(grade <= j)
    padded = np.column_stack([np.zeros(n), below, np.ones(n)])
    slope = np.column_stack([np.zeros(n), below * (1 - below), np.zeros(n)])
    likely = np.maximum(padded[every, grades + 1] - padded[every, grades], 1e-12)
    upper, lower = slope[every, grades + 1] / likely, slope[every, grades] / likely
    gradient = np.bincount(at, (upper - lower)[row], len(weights)) / n
    gradient_t = np.array([((grades == j + 1) * lower - (grades == j) * upper).mean() for j in range(cuts)])
    return float(-np.log(likely).mean()), gradient, gradient_t


def hash_unit(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)).cast("double") / F.lit(float(1 << 40))


def quality_grade(quality: Column, toxic: Column) -> Column:
    """Graded ratings from two labels: 0 toxic, 1 poor, 2 good; null where a label is missing."""
    return F.when(toxic == 1, 0).when((quality == 0) & (toxic == 0), 1).when((quality == 1) & (toxic == 0), 2)


def fit_grades(docs: DataFrame, labels: DataFrame, levels: int = 3, sample: int = SAMPLE, seed: int = 0, key: str = "doc_id") -> Grades:
    """A model from ``docs`` (``<key>, text``) and ``labels`` (``<key>, grade`` from 0 to levels - 1).

    Rows without a grade or text take no part. Where there are more than
    ``sample`` labelled documents, each is drawn with the same probability by a
    hash of its key, so the fit holds about ``sample`` rows of hashes in one
    task and only the model (its non-zero weights) reaches the driver.
    """
    ship(docs.sparkSession)
    rated = labels.where(F.col("grade").between(0, levels - 1) & F.col(f"`{key}`").isNotNull())
    share = min(1.0, sample / max(1, rated.count()))
    drawn = rated.where(hash_unit(F.col(f"`{key}`"), seed) < share).select(F.col(f"`{key}`").alias("_key"), F.col("grade").cast("int"))
    joined = docs.where(F.col("text").isNotNull()).select(F.col(f"`{key}`").alias("_key"), "text").join(drawn, "_key")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                found = pa.array([features(t).tobytes() for t in part.column("text").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("_key"), part.column("grade"), found, pa.array([0] * len(found), pa.int32())], names)

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_key", "ascending"), ("found", "ascending"), ("grade", "ascending")])
        texts = [np.frombuffer(x, np.uint32) for x in table.column("found").to_pylist()]
        model = Grades.fit(texts, table.column("grade").to_numpy().astype(np.int64), levels)
        blobs = [model.hashes.tobytes(), model.weights.tobytes(), model.thresholds.tobytes()]
        return pa.table([pa.array([b], pa.binary()) for b in blobs], ["hashes", "weights", "thresholds"])

    names = ["_key", "grade", "found", "one"]
    schema = T.StructType([joined.schema["_key"], joined.schema["grade"]]).add("found", T.BinaryType()).add("one", T.IntegerType())
    fitted = joined.select("_key", "grade", "text").mapInArrow(hashed, schema)
    row = fitted.groupBy("one").applyInArrow(fit, "hashes binary, weights binary, thresholds binary").first()
    if row is None:
        return Grades.fit([], np.zeros(0, np.int64), levels)
    return Grades(np.frombuffer(row.hashes, np.uint32), np.frombuffer(row.weights), np.frombuffer(row.thresholds))


def grade(docs: DataFrame, model: Grades) -> DataFrame:
    """``docs`` with ``expected_grade`` and ``tail_probability`` (that of the highest grade) of each whole text.

    Null and blank texts have no features and score 0. Columns of those names
    are replaced; all others, and repeated rows, stay.
    """
    ship(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name not in ("expected_grade", "tail_probability")]
    schema = T.StructType([*kept, T.StructField("expected_grade", T.DoubleType()), T.StructField("tail_probability", T.DoubleType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                above = model.above(np.array([model.score(t or "") for t in part.column("text").to_pylist()]))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(f.name) for f in kept], pa.array(above.sum(1)), pa.array(above[:, -1])], names=schema.names
                )

    return docs.select(*[f"`{f.name}`" for f in kept]).mapInArrow(scored, schema)
