"""Packing: exact ids, exact cover, no padding."""

from collections import defaultdict

import numpy as np
import pytest
from planted import make, prose

from tabscout.llm.defaults import tokenizer_file
from tabscout.llm.packing import binary_lengths, pack
from tabscout.llm.tokens import WordEncoder

ODD = [
    "",
    " ",
    "a",
    " a",
    "a ",
    "a  b",
    "a \n b",
    "\n\n x\t y  ",
    "don't they've  I'll",
    "end.\nNext 12345 678",
    "ß Ünïcödé 漢字 漢 字 😀😀 x",
    " a  b  c",
    "x\x1c y \x85 z",
    "<|endoftext|> a <|endoftext|>",
    "a" * 3000,
    "%%% ### !!  ;; | |",
]


@pytest.mark.parametrize("words", [3, 100_000])
def test_ids_equal_those_of_whole_texts(words):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_file())
    plain.encode_special_tokens = True
    texts = [*ODD, *[prose(i, 50) for i in range(20)], *[a + b for a in ODD for b in ODD]]
    encoder = WordEncoder(tokenizer_file(), words)
    for begin in range(0, len(texts), 7):
        part = texts[begin : begin + 7]
        for text, ids in zip(part, encoder.encode(part), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_binary_lengths():
    for tokens in range(1, 5000, 37):
        lengths = binary_lengths(tokens, 2048)
        assert sum(lengths) == tokens and all(n & (n - 1) == 0 and n <= 2048 for n in lengths)
        assert len(lengths) <= tokens // 2048 + 11


def test_pieces_cover_documents(spark, edge_docs):
    rows = pack(edge_docs, tokenizer_file()).collect()
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    assert [r.length for r in sorted(rows, key=lambda r: r.sequence_id)] == sorted(r.length for r in rows)
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_file())
    expected, got = defaultdict(list), defaultdict(list)
    for r in edge_docs.collect():
        ids = plain.encode(r.text or "", add_special_tokens=False).ids + [1]
        expected[r.doc_id] += [(i, x, len(ids)) for i, x in enumerate(ids)]
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length and r.offset == 0
        got[r.doc_id] += [(r.start + i, x, r.doc_tokens) for i, x in enumerate(ids)]
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in expected.items()}


def test_edges(spark, no_docs):
    assert pack(no_docs, tokenizer_file()).count() == 0
    assert [(r.length, r.ids) for r in pack(make(spark, [None]), tokenizer_file()).collect()] == [(1, b"\x01\0\0\0")]
    with pytest.raises(ValueError):
        pack(no_docs, tokenizer_file(), longest=1000)
