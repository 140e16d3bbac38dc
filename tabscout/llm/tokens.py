"""Token ids from a byte-level BPE file of the ``tokenizers`` library, word by word."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np

# White space before a space: the space then belongs to a run that the tokenizer reads as a whole.
_RUN = re.compile(r"\s ")
# A space after anything else always starts a new pre-token.
_CUT = re.compile(r"(?<=\S) ")
_ID = np.dtype("<u4")
# Characters that one call encodes.
_BLOCK = 50_000


class WordEncoder:
    """Ids of whole texts, with each distinct word encoded once while it is remembered.

    The pre-tokenizer of byte-level BPE starts a new pre-token at every space
    that follows something other than white space, and no merge crosses
    pre-tokens. So a text may be cut there, and the ids of the parts put side
    by side are the ids of the text. Special tokens in a text are ordinary text.

    ``words`` bounds the memory: with so many remembered, all are forgotten.
    """

    def __init__(self, path: str, words: int = 800_000):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        self._words = words
        self._known: dict[str, bytes] = {}
        vocabulary = self._tokenizer.get_vocab()
        # A byte-level vocabulary writes each byte as one character.
        self._bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, number in vocabulary.items():
            self._bytes[number] = len(token)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, _ID)

    def _learn(self, words: Sequence[str]) -> None:
        """Encodes many words as one text and cuts the ids where the words end."""
        ids = self._ids("".join(words))
        ends = np.cumsum([len(w.encode()) for w in words])
        cuts = np.searchsorted(np.cumsum(self._bytes[ids]), ends) + 1
        raw, start = ids.tobytes(), 0
        for word, cut in zip(words, (cuts * _ID.itemsize).tolist(), strict=True):
            self._known[word[1:]] = raw[start:cut]
            start = cut

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """For each text its ids, as little-endian unsigned 32-bit numbers."""
        split = [_CUT.split(t) if _RUN.search(t) else t.split(" ") for t in texts]
        known = self._known
        if len(known) > self._words:
            known.clear()
        missing: set[str] = set()
        for parts in split:
            missing.update(parts[1:])
        block, length = [], 0
        for word in missing.difference(known):
            if not word or word[-1].isspace():  # could run into its neighbour in a joined text
                known[word] = self._ids(f" {word}").tobytes()
                continue
            block.append(f" {word}")
            length += len(word) + 1
            if length >= _BLOCK:
                self._learn(block)
                block, length = [], 0
        if block:
            self._learn(block)
        return [
            b"".join([self._ids(parts[0]).tobytes() if parts[0] else b"", *map(known.__getitem__, parts[1:])])
            for parts in split
        ]


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One encoder per Python worker, so that its words outlive a task."""
    return WordEncoder(path)
