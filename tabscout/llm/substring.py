"""Removal of passages that an earlier document has too, located by Aho-Corasick automata."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscout.llm.hashing import run_hashes, word_hashes
from tabscout.llm.neighbours import in_ranges
from tabscout.llm.ship import ship
from tabscout.llm.words import words

#: Words of a window: shorter repeats stay.
WINDOW = 13
#: Text bytes of a block of documents, windows of a bucket of hashes, characters of one automaton.
BLOCK_BYTES, BUCKET_WINDOWS, AUTOMATON_CHARS = 8 << 20, 2 << 20, 4 << 20
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


# Packing of sorted hashes ------------------------------------------------------------------


def pack(hashes: np.ndarray) -> bytes:
    """Sorted numbers as compressed differences, byte by byte."""
    steps = np.diff(hashes, prepend=np.uint64(0))
    return zstandard.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


# Documents of a block ----------------------------------------------------------------------


class Block:
    """The documents of one range of ids, in ascending order."""

    def __init__(self, table: pa.Table, key: str, text: str):
        self.table = table.sort_by([(key, "ascending")])
        self.ids = self.table.column(key).to_numpy()
        self.raw = [(t or "").encode() for t in self.table.column(text).to_pylist()]
        self.words = [t.split() for t in self.raw]

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every window the hash, the document's number and the position of its first word there."""
        hashes, rows, starts = [], [], []
        for row, own in enumerate(self.words):
            found = run_hashes(word_hashes()(own), n)
            hashes.append(found)
            rows.append(np.full(len(found), row))
            starts.append(np.arange(len(found)))
        if not hashes:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(hashes), np.concatenate(rows), np.concatenate(starts)


def _groups(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last position of every run of equal numbers."""
    edges = np.flatnonzero(ordered[1:] != ordered[:-1]) + 1
    return np.concatenate([[0], edges]), np.concatenate([edges, [len(ordered)]]) - 1


# 1. Windows that recur ---------------------------------------------------------------------


def block_windows(block: Block, number: int, n: int, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """``bucket, block, hashes``: the different windows of a block, by ranges of the hash."""
    hashes = np.unique(block.windows(n)[0])
    width = -(-(1 << 64) // buckets)
    bucket = hashes // np.uint64(width)
    if len(hashes):
        for first, last in zip(*_groups(bucket), strict=True):
            yield int(bucket[first]), number, pack(hashes[first : last + 1])


def recurring(blocks: np.ndarray, blobs: list[bytes]) -> Iterator[tuple[int, bytes, bytes]]:
    """``block, targets, hashes`` for a bucket: windows that later blocks have too, with those blocks."""
    parts = [unpack(b) for b in blobs]
    hashes = np.concatenate(parts)
    owner = np.repeat(blocks, [len(p) for p in parts]).astype(np.int32)
    order = np.lexsort((owner, hashes))
    hashes, owner = hashes[order], owner[order]
    first = np.concatenate([[True], hashes[1:] != hashes[:-1]])
    source = owner[np.maximum.accumulate(np.where(first, np.arange(len(hashes)), 0))]
    hashes, source, target = hashes[~first], source[~first], owner[~first]
    order = np.argsort(source, kind="stable")
    hashes, source, target = hashes[order], source[order], target[order]
    if len(hashes):
        for begin, end in zip(*_groups(source), strict=True):
            yield int(source[begin]), target[begin : end + 1].tobytes(), hashes[begin : end + 1].tobytes()


# 2. The passages they make up --------------------------------------------------------------


def passages(block: Block, number: int, n: int, wanted: Iterable[tuple[bytes, bytes]]) -> Iterator[tuple[int, int | None, str]]:
    """``target, doc, passage``: where windows first occur, joined to the longest stretches.

    A passage for another block has no ``doc``, as all documents there come
    later; one for the block itself names the document it stands in.
    """
    hashes, rows, starts = block.windows(n)
    if not len(hashes):
        return
    order = np.argsort(hashes, kind="stable")
    first, last = _groups(hashes[order])
    known, at = hashes[order][first], order[first]
    again = block.ids[rows[order[last]]] > block.ids[rows[at]]
    chosen = [(np.full(int(again.sum()), number, np.int32), at[again])]
    for targets, found in wanted:
        chosen.append((np.frombuffer(targets, np.int32), at[np.searchsorted(known, np.frombuffer(found, np.uint64))]))
    targets, at = np.concatenate([t for t, _ in chosen]), np.concatenate([p for _, p in chosen])
    if not len(at):
        return
    order = np.lexsort((at, targets))
    targets, at = targets[order], at[order]
    joined = (targets[1:] == targets[:-1]) & (at[1:] == at[:-1] + 1) & (rows[at[1:]] == rows[at[:-1]])
    begins = np.flatnonzero(np.concatenate([[True], ~joined]))
    ends = [*begins[1:], len(at)]
    for begin, end in zip(begins, ends, strict=True):
        row, start = rows[at[begin]], starts[at[begin]]
        own = block.words[row][start : starts[at[end - 1]] + n]
        target = int(targets[begin])
        yield target, int(block.ids[row]) if target == number else None, b" ".join(own).decode()


# 3. Where they occur -----------------------------------------------------------------------


class Passages:
    """Automata that find every piece of many passages, and from a piece the whole occurrence.

    A passage is cut into pieces of (n + 1) // 2 words from its start, so each of
    its windows of n words holds a whole piece. Passages are dealt to automata
    of bounded size; every automaton is compiled, used and dropped in turn.
    """

    def __init__(self, rows: Iterable[tuple[int | None, str]], n: int):
        self.n, self.piece = n, (n + 1) // 2
        earliest: dict[str, int | None] = {}
        for doc, passage in rows:
            old = earliest.get(passage, doc)
            earliest[passage] = None if old is None or doc is None else min(old, doc)
        self.docs = list(earliest.values())
        self.texts = [p.encode().split() for p in earliest]

    def automata(self) -> Iterator:
        import ahocorasick

        keys: dict[str, list[tuple[int, int]]] = defaultdict(list)
        size = 0
        for number, own in enumerate(self.texts):
            for start in range(0, len(own) - self.piece + 1, self.piece):
                key = " " + b" ".join(own[start : start + self.piece]).decode("latin-1") + " "
                keys[key].append((number, start))
                size += len(key)
            if size >= AUTOMATON_CHARS or number == len(self.texts) - 1 and keys:
                automaton = ahocorasick.Automaton()
                for key, places in keys.items():
                    automaton.add_word(key, places)
                automaton.make_automaton()
                yield automaton
                keys, size = defaultdict(list), 0

    def mark(self, docs: list[tuple[int, list[bytes]]]) -> list[bytearray]:
        """For each document (id, words) a byte per word: 1 if an earlier document's window covers it."""
        marks = [bytearray(len(own)) for _, own in docs]
        for automaton in self.automata():
            for (doc, own), mark in zip(docs, marks, strict=True):
                if len(own) < self.n:
                    continue
                text = f" {b' '.join(own).decode('latin-1')} "
                ends: list[int] = []
                seen: dict[tuple[int, int], int] = {}
                for end, places in automaton.iter(text):
                    if not ends:
                        ends = np.cumsum([len(w) + 1 for w in own]).tolist()
                    start = bisect_left(ends, end) - self.piece + 1
                    for number, offset in places:
                        source = self.docs[number]
                        if source is not None and source >= doc or seen.get((number, start - offset), -1) > start:
                            continue
                        left, right = self._extend(own, self.texts[number], start, offset)
                        seen[number, start - offset] = right
                        if right - left >= self.n:
                            mark[left:right] = b"\x01" * (right - left)
        return marks

    def _extend(self, own: list[bytes], passage: list[bytes], start: int, offset: int) -> tuple[int, int]:
        """The longest stretch of equal words around a piece."""
        left, at = start, offset
        while left > 0 and at > 0 and own[left - 1] == passage[at - 1]:
            left, at = left - 1, at - 1
        right, at = start + self.piece, offset + self.piece
        while right < len(own) and at < len(passage) and own[right] == passage[at]:
            right, at = right + 1, at + 1
        return left, right


def without(raw: bytes, mark: bytearray) -> str:
    """The text without the marked words; each takes the white space behind it along."""
    starts = [m.start() for m in _WORD.finditer(raw)] + [len(raw)]
    kept, begin, inside = [raw[: starts[0]]], 0, False
    for i, gone in enumerate(mark):
        if gone and not inside:
            kept.append(raw[starts[begin] : starts[i]])
        if inside and not gone:
            begin = i
        inside = bool(gone)
    if not inside:
        kept.append(raw[starts[begin] :])
    return b"".join(kept).decode()


def remove_repeats(
    docs: DataFrame, n: int = WINDOW, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``docs`` without words that a window of ``n`` words of an earlier document covers.

    All columns stay; ``text`` is cut (unchanged where nothing goes), and
    ``n_words`` and ``n_removed`` are added (replaced if there). A word goes if
    one of its windows also starts in a document with a smaller ``key``, judged
    on the texts as they come in. Words are what ASCII white space separates.

    Documents are dealt to blocks: ranges of the key of about ``block_bytes``.

    1. Each block hands the hashes of its different windows to buckets, a few
       bytes each. A bucket tells the first block of a window which later
       blocks have it, so a passage that a third of all documents share costs
       one hash per block.
    2. That block cuts the passages that such windows make up from the document
       where they first occur, once per block that needs them.
    3. Each block compiles the passages it got into automata and streams its
       documents through them; an occurrence is extended word by word and so
       confirmed on the text. Hashes only choose what is compiled: two different
       windows of one 64-bit hash could hide a repeat, but never cut anything.

    The blocks' documents are shuffled once and used by all three steps. Null
    texts stay null and have no words. Rows with a null key are neither earlier
    nor later than others: they stay as they are. Rows that repeat a key do not
    count as earlier than each other.
    """
    spark = docs.sparkSession
    ship(spark)
    added = {"n_words": T.LongType(), "n_removed": T.LongType()}
    plain = docs.drop(*added)
    schema = T.StructType([*plain.schema.fields, *[T.StructField(c, t) for c, t in added.items()]])
    size = plain.agg(F.sum(F.octet_length(text))).first()[0] or 0
    ranges = max(1, ceil(size / block_bytes))
    buckets = max(16, ceil(size / 5 / BUCKET_WINDOWS))  # hardly a word has under 4 letters and a space
    at, _ = in_ranges(plain, key, ranges)
    names = plain.columns
    free = _free("block", names)
    dealt = plain.where(F.col(f"`{key}`").isNotNull()).withColumn(free, at)

    def rows(values: Iterator[tuple], fields: list[str], kinds: list[pa.DataType]) -> pa.Table:
        columns = list(zip(*values, strict=True)) or [[] for _ in fields]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], fields)

    def number(table: pa.Table) -> int:
        return table.column(free)[0].as_py()

    def step1(table: pa.Table) -> pa.Table:
        found = block_windows(Block(table, key, text), number(table), n, buckets)
        return rows(found, ["bucket", "block", "hashes"], [pa.int32(), pa.int32(), pa.binary()])

    def step2(table: pa.Table) -> pa.Table:
        found = recurring(table.column("block").to_numpy(), table.column("hashes").to_pylist())
        return rows(found, ["source", "targets", "hashes"], [pa.int32(), pa.binary(), pa.binary()])

    def step3(table: pa.Table, wanted: pa.Table) -> pa.Table:
        fields, kinds = ["target", "doc", "passage"], [pa.int32(), pa.int64(), pa.string()]
        if not table.num_rows:
            return rows(iter(()), fields, kinds)
        pairs = zip(wanted.column("targets").to_pylist(), wanted.column("hashes").to_pylist(), strict=True)
        return rows(passages(Block(table, key, text), number(table), n, pairs), fields, kinds)

    def step4(table: pa.Table, given: pa.Table) -> pa.Table:
        block = Block(table, key, text)
        found = Passages(zip(given.column("doc").to_pylist(), given.column("passage").to_pylist(), strict=True), n)
        marks = found.mark(list(zip(block.ids.tolist(), block.words, strict=True)))
        texts = [t if not any(m) else without(r, m) for t, r, m in zip(block.table.column(text).to_pylist(), block.raw, marks, strict=True)]
        columns = {c: block.table.column(c) for c in names}
        columns[text] = pa.array(texts, pa.string())
        columns |= {"n_words": pa.array(map(len, marks), pa.int64()), "n_removed": pa.array(map(sum, marks), pa.int64())}
        return pa.table(columns)

    seen = dealt.groupBy(free).applyInArrow(step1, "bucket int, block int, hashes binary")
    shared = seen.groupBy("bucket").applyInArrow(step2, "source int, targets binary, hashes binary")
    found = dealt.groupBy(free).cogroup(shared.groupBy("source")).applyInArrow(step3, "target int, doc bigint, passage string")
    cut = dealt.groupBy(free).cogroup(found.groupBy("target")).applyInArrow(step4, schema)
    apart = plain.where(F.col(f"`{key}`").isNull())
    return cut.unionByName(
        apart.withColumn("n_words", F.size(words(F.col(f"`{text}`"))).cast("bigint")).withColumn("n_removed", F.lit(0).cast("bigint"))
    )


def _free(name: str, taken: list[str]) -> str:
    while name in taken:
        name = f"_{name}"
    return name
