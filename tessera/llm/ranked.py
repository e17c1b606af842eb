"""The tokenizers library's ids from byte strings and ranks alone, which the tiktoken library merges without a memory of words.

A tokenizers file merges listed pairs, tiktoken any two neighbours whose bytes together are a token. Both give the same if
no unlisted pair can ever stand side by side when its turn comes; that is checked once for each file, for every way to cut
every token in two. A file that fails the check, and every text that the splitting here isn't made for (characters beyond
Latin, strings of special tokens), goes to the tokenizers library itself.
"""

from __future__ import annotations

import os
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .bpe import BYTE_LEVEL_PATTERN, END, LATIN_END, SpeculativeBPE

#: Ends each word where tokens tell ends of words; texts that hold it go to the tokenizers library.
MARK = "\0"
#: The split pattern of word-end files that mark_words() follows (a fixed value of that format).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Below, lower case stays there, and is one character but for that of the dotted capital I.
LOWER_END = "\u0180"
SPACES = r"\t-\r \x{85}\x{a0}"


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """0 for white space, 1 letters, 2 numbers, 3 others, by code point below LATIN_END."""
    import regex

    kinds = [regex.compile(p) for p in (r"\s", r"\p{L}", r"\p{N}")]
    return np.array([next((k for k, p in enumerate(kinds) if p.match(chr(c))), 3) for c in range(ord(LATIN_END))], np.uint8)


def mark_words(texts: Sequence[str]) -> list[str]:
    """Each text with MARK after each word that WORD_PATTERN finds, for texts below LATIN_END without MARK."""
    joined = "\n".join(texts)
    code, kind = ("ascii", np.uint8) if joined.isascii() else ("utf-16-le", np.dtype("<u2"))
    chars = np.frombuffer((joined + "\n").encode(code), kind)
    cls = _classes()[chars]
    # a word ends before a character of another kind, and after each number
    last = np.append(cls[1:] != cls[:-1], True)
    last |= cls == 2
    last &= cls != 0
    quote = np.flatnonzero((chars == ord("'")) & last)  # quotes that a letter or a number may follow
    quote = quote[(quote == 0) | (cls[quote - 1] != 3)]
    if len(quote):
        padded = np.append(chars, [0, 0])
        one, two = padded[quote + 1], padded[quote + 2]
        short = quote[np.isin(one, [ord(c) for c in "stmd"])]
        pair = one.astype(np.int64) << 16 | two
        long = quote[np.isin(pair, [ord(c) << 16 | ord(d) for c, d in ("re", "ve", "ll")])]
        last[short] = last[long] = last[long + 1] = False
        last[short + 1] = last[long + 2] = True
    marks = np.flatnonzero(last)
    out = np.zeros(len(chars) + len(marks), kind)
    out[np.arange(len(chars)) + (np.cumsum(last) - last)] = chars
    flat = out.tobytes().decode(code)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes + 1) - 1
    ends = ends + np.searchsorted(marks, ends)
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [flat[a:z] for a, z in zip(starts.tolist(), ends.tolist())]


class RankedEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        bpe = SpeculativeBPE(path)
        self.library, self.lower = bpe.splitter.library, bpe.splitter.lower
        self.specials, self.suffix = list(bpe.splitter.specials), bpe.suffix
        pattern = bpe.splitter.pattern.pattern if bpe.splitter.pattern is not None else None
        self.core = self.ids = None
        if pattern == (WORD_PATTERN if self.suffix else BYTE_LEVEL_PATTERN) and bool(bpe.sound.all()) and not self.conflicts(bpe):
            self.core, self.ids = self._core(bpe, pattern)

    @staticmethod
    def conflicts(bpe: SpeculativeBPE) -> int:
        """Ways to cut a token in two neighbours that its merges don't list, but that earlier merges leave side by side."""
        cuts = [(x, y, i) for text, i in bpe.ids.items() for k in range(1, len(text)) if (x := bpe.ids.get(text[:k])) is not None and (y := bpe.ids.get(text[k:])) is not None]
        if not cuts:
            return 0
        x, y, made = bpe.order[np.array(cuts)].T
        listed = (bpe.left[made] == x) & (bpe.right[made] == y)
        return int((bpe.compatible(x, y, made) & ~listed).sum())

    def _core(self, bpe: SpeculativeBPE, pattern: str) -> tuple:
        import tiktoken

        table, end = bpe.bytes, MARK.encode()
        spare = len(bpe.order)
        ranks: dict[bytes, int] = {}
        ids = np.zeros(spare + 256, np.uint32)
        for text, i in bpe.ids.items():
            raw = bytes(table[c] for c in text.rstrip(END)) + (end if text.endswith(END) else b"")
            if self.suffix and end in raw[: len(raw) - text.endswith(END)]:
                continue  # the byte of MARK itself, which no text here holds
            ranks[raw] = int(bpe.order[i])
            ids[ranks[raw]] = i
        for b in range(256):
            ranks.setdefault(bytes([b]), spare + b)
        split = rf"[^\x00{SPACES}]+\x00" if self.suffix else pattern
        return tiktoken.Encoding("ranked", pat_str=split, mergeable_ranks=ranks, special_tokens={})._core_bpe, ids

    def _easy(self, text: str) -> bool:
        if not text.isascii() and (max(text) >= (LOWER_END if self.lower else LATIN_END) or "İ" in text):
            return False
        return not (self.suffix and MARK in text) and not any(s in text for s in self.specials)

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """ids (uint32) of all texts, one after the other, and n + 1 offsets. A null is an empty text. end: id after each."""
        texts = pc.fill_null(texts.cast(pa.string()), "").to_pylist()
        parts = [np.zeros(0, np.uint32)] * len(texts)
        easy = [i for i, t in enumerate(texts) if t and self._easy(t)] if self.core else []
        fine = set(easy)
        hard = [i for i, t in enumerate(texts) if t and i not in fine]
        ready = [texts[i] for i in easy]
        if self.suffix and ready:
            ready = mark_words([t.lower() for t in ready] if self.lower else ready)
        none: set[str] = set()
        for i, t in zip(easy, ready):
            try:
                parts[i] = self.ids[np.frombuffer(self.core.encode_to_tiktoken_buffer(t, none), np.uint32)]
            except ValueError:  # runs of white space that its regular expressions cannot take
                hard.append(i)
        for i, e in zip(hard, self.library.encode_batch_fast([texts[i] for i in hard], add_special_tokens=False)):
            parts[i] = np.array(e.ids, np.uint32)
        if end is not None:
            stop = np.array([end], np.uint32)
            parts = [p for own in parts for p in (own, stop)]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        bounds = np.concatenate([[0], np.cumsum(sizes)])[:: 1 if end is None else 2]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32), bounds


@lru_cache(maxsize=2)
def ranked_encoder(path: str) -> RankedEncoder:
    """One for each Python worker and file."""
    return RankedEncoder(path)
