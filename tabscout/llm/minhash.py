"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscout.functions.lineage import stored
from tabscout.llm.components import components
from tabscout.llm.hashing import mixed, shingle_set
from tabscout.llm.ship import ship

#: Minima per document, and how many of them make one band. At similarity 0.8 all bands
#: differ with probability (1 - 0.8 ** 6) ** 42, three in a million; at 0.85 two in a billion.
ROWS, BANDS = 6, 42
MINIMA = 256
#: Standard errors that an estimate may lie below the threshold and still be confirmed.
MARGIN = 6.0
#: Members of a bucket's largest component that each member outside it is first compared with.
CENTRES = 8
#: Documents of a block and hashes of all their sets: what one side of a tile holds.
BLOCK, BLOCK_HASHES = 256, 1 << 20


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    numbers = mixed(np.arange(1, 2 * MINIMA + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return numbers[:MINIMA, None] | np.uint64(1), numbers[MINIMA:, None]


_TIMES, _PLUS = _multipliers()


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of every one of ``MINIMA`` hash functions over a set, as 32-bit numbers."""
    least = np.full(MINIMA, np.iinfo(np.uint64).max)
    for begin in range(0, len(hashes), 2048):
        np.minimum(least, (hashes[None, begin : begin + 2048] * _TIMES + _PLUS).min(1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def packed(least: np.ndarray) -> list[int]:
    """The two low bits of every minimum: first all lowest bits, then all second ones, 64 to a number."""
    planes = np.concatenate([least & 1, least >> 1 & 1]).astype(np.uint8)
    return np.packbits(planes, bitorder="little").view(np.int64).tolist()


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two packed signatures.

    Two unequal minima still agree in two bits with probability 1/4; the share
    of agreeing minima is corrected for that.
    """
    words = MINIMA // 64
    differ = F.lit(0)
    for i in range(words):
        low = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        high = F.get(a, F.lit(words + i)).bitwiseXOR(F.get(b, F.lit(words + i)))
        differ = differ + F.bit_count(low.bitwiseOR(high))
    return (1 - differ / MINIMA - 0.25) / 0.75


def least_estimate(similarity: float) -> float:
    """The estimate below which a pair of that similarity is out of the question."""
    agree = 0.75 * similarity + 0.25
    return similarity - MARGIN * (agree * (1 - agree) / MINIMA) ** 0.5 / 0.75


def signatures(docs: DataFrame, shingle: int, key: str = "doc_id") -> DataFrame:
    """``id, n, same, bits, bands`` of every document: size and digest of its set, signature and band keys.

    Rows without an id or words have size 0 and no signature.
    """
    ship(docs.sparkSession)
    names = ["id", "n", "same", "bits", "bands"]

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                batch = whole.slice(begin, 256)
                out: list[tuple] = []
                for text in batch.column(1).to_pylist():
                    hashes = shingle_set(text, shingle)
                    if not len(hashes):
                        out.append((0, None, None, None))
                        continue
                    least = minima(hashes)
                    keys = salt
                    for column in least[: ROWS * BANDS].reshape(BANDS, ROWS).astype(np.uint64).T:
                        keys = mixed(keys ^ column)
                    out.append((len(hashes), xxhash.xxh3_128_hexdigest(hashes.tobytes()), packed(least), keys.view(np.int64).tolist()))
                kinds = [pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                columns = [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    schema = "id bigint, n bigint, same string, bits array<bigint>, bands array<bigint>"
    return docs.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col("text").alias("text")).mapInArrow(signed, schema)


def full_sets(docs: DataFrame, wanted: DataFrame, shingle: int, key: str) -> DataFrame:
    """``id, hashes`` (sorted, binary) of the documents whose id is ``wanted``.

    Texts are shuffled by id once, at every size in the same way: the wanted
    ids grow with the corpus and are never sent to all tasks.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                batch = whole.slice(begin, 256)
                found = [shingle_set(t, shingle).tobytes() for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["id", "hashes"])

    texts = docs.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col("text").alias("text"))
    return texts.join(wanted.hint("merge"), "id", "left_semi").mapInArrow(sets, "id bigint, hashes binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs ``a, b`` those whose full sets have 100 * intersection >= percent * union."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                one, two = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(100 * common >= percent * (len(one) + len(two) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("x")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(compared, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, key: str = "doc_id") -> DataFrame:
    """Every row's ``<key>, n_shingles, component_id, kept``.

    Documents are linked if their sets of ``shingle``-word runs share at least
    ``percent`` of their union; ``component_id`` is the smallest id that a
    document reaches over links and ``kept`` tells whether it is its own.

    1. Equal sets are one class, represented by the smallest id.
    2. Representatives that share a band are candidates. Of each band's bucket
       every member is first compared with the member of smallest id: packed
       signatures sort out what cannot be similar, full sets decide.
    3. Two members in one component need no comparison. Where a bucket still
       holds several components, members outside its largest one (strays) are
       compared with ``CENTRES`` members of that one, spread by hash, which
       settles all but a few of them.
    4. Strays that are left meet the members of that component, and each other,
       in tiles of two bounded blocks (``tiled_links``). A tile gives at most
       one row per document, so a bucket of n copies makes some n comparisons
       and rows, no pairs become rows, and no pair of a bucket goes unchecked
       unless a path of links already joins it.

    Rows without an id take no part and are kept, with a null component. Null,
    empty and blank texts have an empty set and are linked with nothing. Rows
    that repeat an id are judged by their own texts, so equal rows fare alike.
    """
    signed = stored(signatures(docs, shingle, key))
    classes = stored(
        signed.where("id IS NOT NULL AND same IS NOT NULL")
        .groupBy("same")
        .agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("n", "bits", "bands")])
    )
    members = classes.select("id", F.explode("bands").alias("band"))
    buckets = stored(
        members.groupBy("band").agg(F.min("id").alias("centre"), F.count(F.lit(1)).alias("members")).where("members > 1")
    )
    gathered = members.join(buckets, "band")
    first = stored(gathered.where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct())
    sets = stored(full_sets(docs, first.select(F.col("a").alias("id")).union(first.select("b")).distinct(), shingle, key))
    links = stored(confirmed(_plausible(first, classes, percent), sets, percent))
    labels = components(links)

    crowded = stored(gathered.where("members > 2").select("band", "id"))
    open_ = _unsettled(crowded, labels)
    salts = [F.min_by("id", F.xxhash64("id", F.lit(s))) for s in range(CENTRES)]
    centres = open_.where("label = main").groupBy("band").agg(F.array_distinct(F.array(*salts)).alias("ids"))
    strays = open_.where("label <> main")
    second = stored(_new_pairs(strays.join(centres, "band").select("id", F.explode("ids").alias("other")), first))
    more = stored(confirmed(_plausible(second, classes, percent), sets, percent))
    if more.limit(1).count():
        links = links.union(more)
        labels = components(links, labels)

    more = tiled_links(_unsettled(crowded, labels), labels, classes, sets, percent)
    if more.limit(1).count():
        labels = components(links.union(more), labels)

    found = classes.join(labels, "id", "left").select("same", F.coalesce("label", "id").alias("component"))
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return signed.select("id", "n", "same").join(found, "same", "left").select(
        F.col("id").alias(key),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        (F.col("id").isNull() | (F.col("id") == component)).alias("kept"),
    )


def tiled_links(open_: DataFrame, labels: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` that join every linked pair of an open bucket, directly or over other links.

    The strays of all buckets with one largest component, and that component,
    are a family. Its documents are cut by set size, one class for each step
    that the similarity allows, and by a hash of the id into blocks that hold a
    bounded number of documents and hashes. A block of strays meets the blocks
    of its own and the neighbouring classes, each pair of blocks in a tile:
    first by signatures, which tell the documents that may have a partner in the
    tile, then by the full sets of these. No pair is left out.
    """
    spark = open_.sparkSession
    strays = open_.where("label <> main").select(F.col("main").alias("family"), "id").distinct()
    everyone = classes.select("id", "n").join(labels, "id", "left").select("id", "n", F.coalesce("label", "id").alias("family"))
    members = everyone.join(strays.select("family").distinct(), "family", "left_semi").select("family", "id", "n", F.lit(False).alias("stray"))
    strays = strays.join(classes.select("id", "n"), "id").select("family", "id", "n", F.lit(True).alias("stray"))
    # A little more than the ratio of sizes that a link allows, so that rounding cannot part linked documents by two classes.
    step = float(np.log(100 / percent * 1.01))
    kin = stored(members.union(strays).withColumn("class", F.floor(F.log("n") / step).cast("int")))
    at = ["family", "stray", "class"]
    blocks = F.greatest(
        F.ceil(F.count(F.lit(1)) / BLOCK), F.least(F.count(F.lit(1)), F.ceil(F.sum("n") / BLOCK_HASHES))
    )
    counted = kin.groupBy(*at).agg(blocks.cast("int").alias("blocks"))
    kin = stored(kin.join(counted, at).select(*at, "id", F.pmod(F.xxhash64("id", "family"), F.col("blocks")).cast("int").alias("block")))
    cells = stored(counted.select(*at, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")))
    ones = cells.where("stray").select(
        "family", F.col("class").alias("class_a"), F.col("block").alias("block_a"), F.explode(F.array(*[F.col("class") + i for i in (-1, 0, 1)])).alias("class")
    )
    once = "NOT stray OR class > class_a OR (class = class_a AND block >= block_a)"
    tiles = stored(ones.join(cells, ["family", "class"]).where(once).withColumn("tile", F.monotonically_increasing_id()))
    own = tiles.select("tile", "family", F.lit(True).alias("stray"), F.col("class_a").alias("class"), F.col("block_a").alias("block"))
    met = tiles.select("tile", "family", "stray", "class", "block")
    where = [*at, "block"]
    placed = own.withColumn("one", F.lit(True)).union(met.withColumn("one", F.lit(False))).join(kin, where).select("tile", "one", "id")
    signed = placed.join(classes.select("id", "n", "bits"), "id")
    least, fields = least_estimate(percent / 100), "tile bigint, one boolean, id bigint"

    def sides(tile: pa.Table) -> tuple[pa.Table, pa.Table]:
        return tile.filter(tile.column("one")), tile.filter(pc.invert(tile.column("one")))

    def plausible(tile: pa.Table) -> pa.Table:
        one, other = sides(tile)
        likely = _likely(_signature(one), _signature(other), least) & (one.column("id").to_numpy()[:, None] != other.column("id").to_numpy())
        kept = [side.filter(pa.array(likely.any(axis))).select(["tile", "one", "id"]) for side, axis in ((one, 1), (other, 0))]
        return pa.concat_tables(kept).combine_chunks()

    def joined(tile: pa.Table) -> pa.Table:
        one, other = sides(tile)
        ids = [side.column("id").to_numpy() for side in (one, other)]
        found = [[np.frombuffer(x.as_buffer(), np.uint64) for x in side.column("hashes")] for side in (one, other)]
        return pa.table(spanning_links(*ids, linked(*found, percent)), ["a", "b"])

    ship(spark)
    alive = stored(signed.groupBy("tile").applyInArrow(plausible, fields))
    return stored(alive.join(sets, "id").select("tile", "one", "id", "hashes").groupBy("tile").applyInArrow(joined, "a bigint, b bigint").distinct())


def _signature(rows: pa.Table) -> np.ndarray:
    values = rows.column("bits").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return values.astype(np.int64).view(np.uint64).reshape(rows.num_rows, -1)


def _likely(ones: np.ndarray, others: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of signatures have an ``estimate`` of ``least`` or more, as a matrix."""
    words = MINIMA // 64
    differ = np.zeros((len(ones), len(others)), np.int64)
    for i in range(words):
        low = ones[:, i, None] ^ others[None, :, i]
        high = ones[:, words + i, None] ^ others[None, :, words + i]
        differ += np.bitwise_count(low | high)
    return (1 - differ / MINIMA - 0.25) / 0.75 >= least


def linked(ones: list[np.ndarray], others: list[np.ndarray], percent: int, width: int = 4096) -> np.ndarray:
    """Which pairs of sets have 100 * intersection >= percent * union, as a matrix.

    A set has at most |s & U| in common and at least |s | I| in union with any
    set of a group whose union is U and whose intersection is I. Sets that this
    envelope of the other side excludes are compared with nothing; intersections
    of the rest are products of their indicator matrices, ``width`` hashes at a time.
    """
    rows = [np.arange(len(ones)), np.arange(len(others))]
    sides = [ones, others]
    for this, that in ((0, 1), (1, 0)):
        rows[this] = rows[this][_inside([sides[this][r] for r in rows[this]], [sides[that][r] for r in rows[that]], percent)]
    found = np.zeros((len(ones), len(others)), bool)
    if not len(rows[0]) or not len(rows[1]):
        return found
    sizes = [np.array([len(side[r]) for r in kept]) for side, kept in zip(sides, rows, strict=True)]
    flat = [np.concatenate([side[r] for r in kept]) for side, kept in zip(sides, rows, strict=True)]
    shared = np.intersect1d(*flat)
    common = np.zeros((len(rows[0]), len(rows[1])), np.int64)
    columns, owners = [], []
    for values, size in zip(flat, sizes, strict=True):
        owner = np.repeat(np.arange(len(size)), size)
        column, known = _positions(shared, values)
        column, owner = column[known], owner[known]
        order = np.argsort(column, kind="stable")
        columns.append(column[order])
        owners.append(owner[order])
    for begin in range(0, len(shared), width):
        parts = []
        for column, owner, size in zip(columns, owners, sizes, strict=True):
            first, last = np.searchsorted(column, [begin, begin + width])
            part = np.zeros((len(size), min(width, len(shared) - begin)), np.float32)
            part[owner[first:last], column[first:last] - begin] = 1
            parts.append(part)
        common += (parts[0] @ parts[1].T).astype(np.int64)
    union = sizes[0][:, None] + sizes[1][None, :] - common
    found[np.ix_(*rows)] = 100 * common >= percent * union
    return found


def _positions(known: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(known, values), max(0, len(known) - 1))
    return at, known[at] == values if len(known) else np.zeros(len(values), bool)


def _inside(sets: list[np.ndarray], group: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets the envelope of a group of sets does not exclude."""
    if not sets or not group:
        return np.zeros(len(sets), bool)
    union, times = np.unique(np.concatenate(group), return_counts=True)
    every = times == len(group)
    at, known = _positions(union, np.concatenate(sets))
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    most = np.bincount(owner[known], minlength=len(sets))
    core = np.bincount(owner[known & every[at]], minlength=len(sets))
    return 100 * most >= percent * (sizes + every.sum() - core)


def spanning_links(ones: np.ndarray, others: np.ndarray, found: np.ndarray) -> list[np.ndarray]:
    """``a, b``: every linked row of a tile with the smallest id that it reaches there, so at most one link a row."""
    label_a, label_b = ones.copy(), others.copy()
    far = np.iinfo(np.int64).max
    while found.any():
        before = label_a.copy(), label_b.copy()
        np.minimum(label_a, np.where(found, label_b[None, :], far).min(1), out=label_a)
        np.minimum(label_b, np.where(found, label_a[:, None], far).min(0), out=label_b)
        if np.array_equal(before[0], label_a) and np.array_equal(before[1], label_b):
            break
    ids, labels = np.concatenate([ones, others]), np.concatenate([label_a, label_b])
    return [labels[ids != labels], ids[ids != labels]]


def _unsettled(crowded: DataFrame, labels: DataFrame) -> DataFrame:
    """``band, id, label, main`` of the buckets that hold several components; ``main`` is the largest."""
    labelled = crowded.join(labels, "id", "left").select("band", "id", F.coalesce("label", "id").alias("label"))
    mixed_up = (
        labelled.groupBy("band", "label")
        .agg(F.count(F.lit(1)).alias("size"))
        .groupBy("band")
        .agg(F.max_by("label", F.struct("size", -F.col("label"))).alias("main"), F.count(F.lit(1)).alias("labels"))
        .where("labels > 1")
    )
    return stored(labelled.join(mixed_up.select("band", "main"), "band"))


def _new_pairs(pairs: DataFrame, tested: DataFrame) -> DataFrame:
    """``a, b`` with a < b, each once and none that was compared before."""
    ordered = pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
    return ordered.where("a <> b").distinct().join(tested, ["a", "b"], "left_anti")


def _plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes allow the similarity and whose signatures do not rule it out."""
    one = classes.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"))
    two = classes.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))
    fits = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    likely = estimate(F.col("bits_a"), F.col("bits_b")) >= least_estimate(percent / 100)
    return stored(pairs.join(one, "a").join(two, "b").where(fits & likely).select("a", "b").distinct())
