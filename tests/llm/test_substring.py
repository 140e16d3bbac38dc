"""Repeated passages against brute force, in one block and in many."""

import numpy as np
import pyarrow as pa
import pytest
from planted import make, prose
from pyspark.sql import functions as F

from tabscout.llm import substring
from tabscout.llm.substring import Block, Passages, block_windows, pack, passages, recurring, remove_repeats, unpack, without


def brute(rows, n):
    """``doc_id, words, removed marks`` for rows of id and text."""
    split = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in sorted((r for r in split if r[0] is not None), key=lambda r: r[0]):
        for k in range(len(w) - n + 1):
            first.setdefault(tuple(w[k : k + n]), i)
    out = []
    for i, w in split:
        mark = [0] * len(w)
        for k in range(len(w) - n + 1):
            if i is not None and first[tuple(w[k : k + n])] < i:
                mark[k : k + n] = [1] * n
        out.append((i, w, mark))
    return out


def check(docs, n, **options):
    found = remove_repeats(docs, n, **options)
    assert found.columns == [c for c in docs.columns if c not in ("n_words", "n_removed")] + ["n_words", "n_removed"]
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    expected = sorted(
        (str(i), len(w), sum(m), b" ".join(x for x, gone in zip(w, m, strict=True) if not gone).decode()) for i, w, m in brute(rows, n)
    )
    got = found.select("doc_id", "n_words", "n_removed", "text").collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, b" ".join((r.text or "").encode().split()).decode()) for r in got) == expected
    assert sum(r.text is None for r in got) == sum(t is None for _, t in rows)


def test_windows_whose_hashes_differ_in_low_bits_only(monkeypatch):
    """Another window with the upper 48 bits of a repeated one does not take its place."""

    def close(words, n):
        text = [tuple(words[k : k + n].tolist()) for k in range(len(words) - n + 1)]
        return np.array([(7 << 16) + seen.setdefault(t, len(seen)) for t in text], np.uint64)

    seen = {}
    monkeypatch.setattr(substring, "run_hashes", close)
    texts = {0: ["a b c", "d e f"], 1: ["d e f"]}
    blocks = {i: Block(pa.table({"id": [10 * i + k for k in range(len(t))], "text": t}), "id", "text") for i, t in texts.items()}
    rows = [r for i, b in blocks.items() for r in block_windows(b, i, 3, 16)]
    assert len({bucket for bucket, _, _ in rows}) == 1
    (source, targets, hashes), = recurring(np.array([number for _, number, _ in rows]), [blob for _, _, blob in rows])
    assert source == 0 and list(passages(blocks[0], 0, 3, [(targets, hashes)])) == [(1, None, "d e f")]


@pytest.mark.parametrize("block_bytes", [1 << 20, 1500])
def test_edges(edge_docs, block_bytes):
    check(edge_docs, 13, block_bytes=block_bytes)


def test_groups_of_copies_over_blocks(spark):
    shared = [prose(i, 30) for i in range(4)]
    texts = [prose(100 + i, 10) + " " + shared[i % 4] + " " + prose(200 + i, i % 9) + " " + shared[(i * 7) % 4] for i in range(60)]
    docs = make(spark, texts + [texts[0]] * 40)
    check(docs, 13, block_bytes=2000)
    check(docs, 4, block_bytes=2000)


def test_empty_table(no_docs):
    assert remove_repeats(no_docs).count() == 0


def test_windows_of_several_documents_meet_in_one(spark):
    a, b = prose(1, 20), prose(2, 20)
    joined = " ".join([*a.split()[-10:], *b.split()[:10]])
    docs = make(spark, [a, b, joined, a + " " + b, joined])
    check(docs, 13)
    check(docs, 8)


def test_cut_keeps_the_rest_as_it_is():
    assert without(b" a  b\nc\td ", bytearray([0, 1, 1, 0])) == " a  d "
    assert without(b"a b", bytearray([0, 1])) == "a "
    assert without(b" a b", bytearray([1, 1])) == " "


def test_packing_of_hashes():
    import numpy as np

    numbers = np.unique(np.random.default_rng(1).integers(0, 1 << 48, 5000, dtype=np.uint64))
    assert (unpack(pack(numbers)) == numbers).all()


def test_automata_of_bounded_size(monkeypatch):
    monkeypatch.setattr("tabscout.llm.substring.AUTOMATON_CHARS", 50)
    passages = [prose(i, 20) for i in range(10)]
    found = Passages([(None, p) for p in passages], 13)
    assert len(list(found.automata())) > 3
    assert [sum(m) for m in found.mark([(1, p.encode().split()) for p in passages])] == [20] * 10


def test_query_columns(spark):
    from tabscout.llm.queries import op1_substring

    found = op1_substring(spark, "/root/testdata/sf0.001")
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    import hashlib

    expected = {
        (i, len(w), sum(m), hashlib.sha256(b" ".join(x for x, gone in zip(w, m, strict=True) if not gone)).hexdigest())
        for i, w, m in brute(rows, 13)
    }
    assert {tuple(r) for r in found.select("doc_id", "n_words", "n_removed", F.col("kept_sha256")).collect()} == expected
