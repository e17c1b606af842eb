"""Token ids of whole columns: each distinct chunk of text is encoded once, and documents are gathered in numpy.

A chunk begins at a space after a character that isn't white space (or at any space, where white space makes no tokens).
The pre-tokenizers of byte-level BPE files never join such sides, so chunks can be encoded on their own.
"""

from __future__ import annotations

from functools import lru_cache
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .bpe import SpeculativeBPE, Store, WordEncoder

#: Distinct chunks and words a worker remembers; beyond that it forgets them all and goes on.
REMEMBERED, WORDS_REMEMBERED = 400_000, 300_000


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ColumnEncoder:
    """words: encodes distinct chunks. Where spaces belong to tokens, a text with white space before a space is one chunk."""

    def __init__(self, words: WordEncoder, remembered: int = REMEMBERED):
        self.words, self.spaced, self.remembered = words, words.splitter.spaced, remembered
        self.store = Store()

    def _numbers(self, chunks: list[str]) -> np.ndarray:
        """A number in the store for each chunk."""
        known = self.store.number
        new = [c for c in dict.fromkeys(chunks) if c not in known]
        if new:
            self.store.add(new, *self.words.encode_chunks(new))
        return self.store.numbers(chunks)

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """ids (uint32) of all texts, one after the other, and n + 1 offsets. A null is an empty text. end: id after each."""
        if len(self.store.number) > self.remembered:
            self.store = Store()
        texts = pc.fill_null(texts.cast(pa.string()), "")
        n = len(texts)
        parts = pc.split_pattern(texts, " ")
        offsets = parts.offsets.to_numpy().astype(np.int64)
        flat = parts.values.slice(offsets[0], offsets[-1] - offsets[0])
        offsets = offsets - offsets[0]
        coded = flat.dictionary_encode()
        codes, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        firsts = offsets[:-1]
        slow = np.zeros(n, bool)
        if self.spaced:
            numbers = self._numbers([f" {w}" for w in distinct])[codes]
            heads = flat.take(pa.array(firsts)).to_pylist()
            numbers[firsts] = self._numbers(heads)
            empty, spacy = np.array([not w for w in distinct]), np.array([bool(w) and w[-1].isspace() for w in distinct])
            odd = spacy[codes] | empty[codes]
            odd[firsts] = spacy[codes[firsts]]
            odd[offsets[1:] - 1] = False
            slow = np.add.reduceat(odd, firsts) > 0 if len(odd) else slow
        else:
            numbers = self._numbers(distinct)[codes]
        if slow.any():
            whole = texts.filter(pa.array(slow)).to_pylist()
            keep = np.repeat(~slow, np.diff(offsets))
            at = np.flatnonzero(slow)
            numbers = np.insert(numbers[keep], np.searchsorted(np.flatnonzero(keep), offsets[at]), self._numbers(whole))
            counts = np.where(slow, 1, np.diff(offsets))
            offsets = np.concatenate([[0], np.cumsum(counts)])
        lens, ids = self.store.gather(numbers)
        bounds = np.concatenate([[0], np.cumsum(lens)])[offsets]
        if end is not None:
            ids = np.insert(ids, bounds[1:], end)
            bounds = bounds + np.arange(n + 1)
        return ids.astype(np.uint32, copy=False), bounds


@lru_cache(maxsize=2)
def speculative_bpe(path: str) -> SpeculativeBPE:
    return SpeculativeBPE(path)


@lru_cache(maxsize=2)
def speculative_encoder(bpe: SpeculativeBPE) -> ColumnEncoder:
    """Kept for the life of the Python worker with what it remembers."""
    return ColumnEncoder(WordEncoder(bpe.splitter, bpe.encode_words))
