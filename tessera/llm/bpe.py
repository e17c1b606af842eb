"""Byte-pair encoding of a tokenizers file by speculation: greedy longest match, then a check of all adjacent pairs.

A sequence of tokens is what merging by rank gives exactly if no two neighbours would have been merged otherwise. So the
longest-match guess of a word stands if each adjacent pair is compatible; pairs of all words are checked at once in
numpy by undoing merges from the later one back. Only words with an incompatible pair are merged step by step.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np

END = ""  # stands for the end-of-word suffix within this module


def byte_chars() -> list[str]:
    """The printable character of each byte in byte-level vocabularies: itself where it is visible Latin-1, else from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


#: The pattern that byte-level pre-tokenizers use unless the file gives another (a fixed value of that format).
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts with characters from here on are normalized and split by the library itself, with its tables of Unicode.
LATIN_END = "\u0250"
#: Stands between texts that are split together.
SEP = "\ue001"
NOT_A_WORD = r"[^\s\p{L}\p{N}]"


_SPACE_END = re.compile(r"\s(?:$|" + SEP + ")")


class Splitter:
    """Words of a text in byte characters, as a tokenizers file's normalizer and pre-tokenizer make them."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.spec = spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.normalizer, self.pre_tokenizer = self.library.normalizer, self.library.pre_tokenizer
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # the leftmost, and of those that begin together the longest
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))))
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take in their surroundings aren't known here")
        norm, pre = spec.get("normalizer"), spec.get("pre_tokenizer") or {}
        steps = [] if norm is None else norm["normalizers"] if norm["type"] == "Sequence" else [norm]
        kinds = [n["type"] for n in steps]
        parts = pre["pretokenizers"] if pre.get("type") == "Sequence" else [pre]
        self.lower = "Lowercase" in kinds
        self.pattern = None
        plain = set(kinds) <= {"NFC", "Lowercase", "Replace"} and all(n["pattern"] == {"Regex": r"\s+"} and n["content"] == " " for n in steps if n["type"] == "Replace")
        if plain and len(parts) == 1 and parts[0].get("type") == "ByteLevel" and parts[0]["use_regex"] and not parts[0]["add_prefix_space"] and "Replace" not in kinds:
            self.pattern = regex.compile(BYTE_LEVEL_PATTERN)
        elif plain and len(parts) == 2 and parts[0].get("type") == "Split" and parts[0]["invert"] and parts[0]["behavior"] == "Removed" and "Regex" in parts[0]["pattern"] and parts[1].get("type") == "ByteLevel" and not parts[1]["use_regex"] and not parts[1]["add_prefix_space"]:
            self.pattern = regex.compile(parts[0]["pattern"]["Regex"])
        self.together = None
        if self.pattern is not None and NOT_A_WORD in self.pattern.pattern:
            self.together = regex.compile(SEP + "|" + self.pattern.pattern.replace(NOT_A_WORD, NOT_A_WORD[:-1] + SEP + "]"))
        #: whether spaces belong to tokens
        self.spaced = self.library.encode("a b", add_special_tokens=False).ids != self.library.encode("a  b", add_special_tokens=False).ids
        self.chars = byte_chars()

    def words(self, text: str) -> list[str | int]:
        """Words in byte characters; an int is the id of a special token that the text holds."""
        out: list[str | int] = []
        for part in self._around_specials(text):
            if isinstance(part, int):
                out.append(part)
            elif self.pattern is not None and max(part) < LATIN_END:
                out += map(self.in_bytes, self.pattern.findall(part.lower() if self.lower else part))
            else:
                part = self.normalizer.normalize_str(part) if self.normalizer else part
                out += [w for w, _ in self.pre_tokenizer.pre_tokenize_str(part)]
        return out

    def in_bytes(self, word: str) -> str:
        return word if word.isalnum() and word.isascii() else "".join([self.chars[b] for b in word.encode()])

    def split(self, texts: Sequence[str]) -> tuple[list[str | int], np.ndarray]:
        """Words of all texts, one text after the other, and how many each has. Words of plain texts aren't in byte
        characters yet: in_bytes() is to be applied to strings without SEP before them; others are marked by a SEP before.
        """
        easy = self.together is not None
        joined = SEP.join(texts)
        rest = [] if easy and joined.count(SEP) == len(texts) - 1 and max(joined.replace(SEP, ""), default="") < LATIN_END and not any(s in joined for s in self.specials) and not _SPACE_END.search(joined) else [
            i for i, t in enumerate(texts) if not easy or (t and (max(t) >= LATIN_END or t[-1].isspace() or any(s in t for s in self.specials)))
        ]
        if rest:
            texts = list(texts)
            hard = {i: self.words(texts[i]) for i in rest}
            for i in rest:
                texts[i] = ""
            joined = SEP.join(texts)
        flat = self.together.findall((joined.lower() if self.lower else joined) + SEP) if easy else [SEP] * len(texts)
        ends = np.flatnonzero(np.fromiter((w == SEP for w in flat), bool, len(flat)))
        counts = np.diff(ends, prepend=-1) - 1
        if rest:
            out: list[str | int] = []
            at = 0
            for i, (end, n) in enumerate(zip(ends.tolist(), counts.tolist())):
                if i in hard:
                    out += [w if isinstance(w, int) else SEP + w for w in hard[i]]
                    counts[i] = len(hard[i])
                else:
                    out += flat[end - n : end]
            return out, counts
        return [w for w in flat if w != SEP], counts

    def _around_specials(self, text: str) -> list[str | int]:
        out: list[str | int] = []
        at = 0
        for found in self.special.finditer(text) if self.specials else ():
            if found.start() > at:
                out.append(text[at : found.start()])
            out.append(self.specials[found[0]])
            at = found.end()
        return [*out, text[at:]] if at < len(text) else out


class Store:
    """Ids of numbered keys, one after the other."""

    def __init__(self):
        self.number: dict[str | int, int] = {}
        self.lens, self.starts, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def add(self, keys: Sequence[str | int], lens: np.ndarray, ids: np.ndarray) -> None:
        self.number.update(zip(keys, range(len(self.lens), len(self.lens) + len(keys))))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lens) - lens])
        self.lens, self.flat = np.concatenate([self.lens, lens]), np.concatenate([self.flat, ids])

    def numbers(self, keys: Sequence[str | int]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, keys), np.int64, len(keys))

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids, one after the other."""
        lens = self.lens[numbers]
        ends = np.cumsum(lens)
        return lens, self.flat[np.repeat(self.starts[numbers] - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)]


class WordEncoder:
    """encode_chunks() of texts, with a memory of distinct words; encode_words: ids of each of a list of words."""

    def __init__(self, splitter: Splitter, encode_words: Callable[[list[str]], list[Sequence[int]]], remembered: int = 300_000):
        self.splitter, self.encode_words, self.remembered = splitter, encode_words, remembered
        self.store = Store()

    def encode_chunks(self, chunks: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each chunk has, and all ids, one after the other."""
        if len(self.store.number) > self.remembered:
            self.store = Store()
        known = self.store.number
        words, counts = self.splitter.split(chunks)
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            texts = [w for w in new if isinstance(w, str)]
            encoded = dict(zip(texts, self.encode_words([w[1:] if w[0] == SEP else self.splitter.in_bytes(w) for w in texts])))
            each = [encoded[w] if isinstance(w, str) else (w,) for w in new]
            lens = np.fromiter(map(len, each), np.int64, len(each))
            self.store.add(new, lens, np.fromiter(chain.from_iterable(each), np.uint32, int(lens.sum())))
        lens, ids = self.store.gather(self.store.numbers(words))
        sums = np.concatenate([[0], np.cumsum(lens)])
        bounds = sums[np.concatenate([[0], np.cumsum(counts)])]
        return np.diff(bounds), ids


class SpeculativeBPE:
    """For files with a byte-level BPE model, with or without an end-of-word suffix."""

    def __init__(self, path: str):
        self.splitter = Splitter(path)
        spec = self.splitter.spec
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
            raise ValueError("not a plain byte-level BPE model")
        self.decoder = (spec.get("decoder") or {}).get("type")
        if self.decoder not in (None, "ByteLevel"):
            raise ValueError(f"decoder {self.decoder} isn't known here")
        suffix = model.get("end_of_word_suffix") or ""
        self.suffix = bool(suffix)
        inner = lambda t: t[: -len(suffix)] + END if suffix and t.endswith(suffix) and t != suffix else t
        self.ids = {inner(t): i for t, i in model["vocab"].items()}
        self.longest = max(map(len, self.ids), default=1)
        size = max(model["vocab"].values(), default=-1) + 1
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        left, right = np.arange(size), np.arange(size)
        order = np.full(size, -1)
        for rank, (a, b) in enumerate(merges):
            a, b = inner(a), inner(b)
            ia, ib, made = self.ids[a], self.ids[b], self.ids[a + b]
            self.ranks.setdefault((ia, ib), (rank, made))
            if order[made] < 0:
                order[made], left[made], right[made] = rank, ia, ib
        # the order of tokens: those that no merge makes first, then by rank
        base = np.flatnonzero(order < 0)
        full = np.empty(size, np.int64)
        full[base] = np.arange(len(base))
        full[order >= 0] = order[order >= 0] + len(base)
        self.order = full
        top = int(full.max(initial=0)) + 1
        self.left, self.right = np.arange(top), np.arange(top)
        self.left[full], self.right[full] = full[left], full[right]
        pairs = sorted((int(full[a]) << 32 | int(full[b]), r + len(base)) for (a, b), (r, _) in self.ranks.items())
        self.pair_keys = np.array([k for k, _ in pairs], np.int64)
        self.pair_ranks = np.array([r for _, r in pairs], np.int64)
        self.texts = [""] * max(size, max(self.splitter.specials.values(), default=-1) + 1)
        for t, i in [*model["vocab"].items(), *self.splitter.specials.items()]:
            self.texts[i] = t
        self.chars = byte_chars()
        self.bytes = {c: b for b, c in enumerate(self.chars)}
        self.exact_words = 0  # words whose guess failed
        self.sound = self._sound()

    def _sound(self) -> np.ndarray:
        """By order: whether a token's own text encodes to that token; others are never guessed."""
        t = np.arange(len(self.left))
        made = self.left != t
        good = np.ones(len(t), bool)
        good[made] = self.compatible(self.left[made], self.right[made], t[made])
        for i in np.flatnonzero(made):  # parts come before what they make
            good[i] &= good[self.left[i]] and good[self.right[i]]
        for text in [x for x, i in self.ids.items() if not good[self.order[i]]]:
            del self.ids[text]
        return good

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """For tokens by order, whether a then b stays as it is when merged by rank (by merges before limit)."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), np.iinfo(np.int64).max) if limit is None else limit.astype(np.int64)
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.copy(), b.copy()
        while len(live) and len(self.pair_keys):
            x, y, lim = a[live], b[live], limit[live]
            key = x << 32 | y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            bad = (self.pair_keys[at] == key) & (self.pair_ranks[at] < lim)
            good[live[bad]] = False
            live, x, y = live[~bad], x[~bad], y[~bad]
            x_first = x > y
            nx, ny = self.right[x], self.left[y]
            x_can, y_can = nx != x, ny != y
            take_x = np.where(x_first, x_can, x_can & ~y_can)
            take_y = ~take_x & y_can
            limit[live] = np.where(take_x, x, y + 1)
            a[live] = np.where(take_x, nx, x)
            b[live] = np.where(take_y, ny, y)
            live = live[take_x | take_y]
        return good

    def guess(self, word: str) -> list[int]:
        out, at, n, ids = [], 0, len(word), self.ids
        bare = n - 1 if self.suffix else -1  # the suffix belongs to the last character
        while at < n:
            for end in range(min(n, at + self.longest), at, -1):
                i = ids.get(word[at:end])
                if i is not None and end != bare:
                    out.append(i)
                    at = end
                    break
            else:
                raise KeyError(word[at])
        return out

    def exact(self, word: str) -> list[int]:
        """Merging by rank, the lowest first and the leftmost of equals."""
        parts = list(word)
        if self.suffix and len(parts) > 1 and parts[-1] == END:
            parts[-2:] = [parts[-2] + END]
        ids, ranks = [self.ids[p] for p in parts], self.ranks
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*ranks[p], k, *p) for k, p in enumerate(zip(ids, ids[1:])) if p in ranks]
        heap = [(rank, k, made, a, b) for rank, made, k, a, b in heap]
        heapify(heap)
        while heap:
            _, k, made, a, b = heappop(heap)
            j = after[k]
            if ids[k] != a or j >= n or ids[j] != b:  # merged otherwise since
                continue
            ids[k], ids[j] = made, -1
            after[k] = end = after[j]
            if end < n:
                before[end] = k
                if (p := (made, ids[end])) in ranks:
                    heappush(heap, (ranks[p][0], k, ranks[p][1], *p))
            if (i := before[k]) >= 0 and (p := (ids[i], made)) in ranks:
                heappush(heap, (ranks[p][0], i, ranks[p][1], *p))
        return [i for i in ids if i >= 0]

    def encode_words(self, words: Sequence[str]) -> list[list[int]]:
        """Ids of distinct words in byte characters."""
        if self.suffix:
            words = [w + END for w in words]
        guesses = [self.guess(w) for w in words]
        sizes = np.fromiter(map(len, guesses), np.int64, len(guesses))
        flat = self.order[np.fromiter((i for g in guesses for i in g), np.int64, int(sizes.sum()))]
        if len(flat) > 1:
            owner = np.repeat(np.arange(len(guesses)), sizes)
            within = owner[1:] == owner[:-1]
            pairs, back = np.unique(flat[:-1][within] << 32 | flat[1:][within], return_inverse=True)
            fails = ~self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[back]
            for w in np.unique(owner[1:][within][fails]).tolist():
                guesses[w] = self.exact(words[w])
                self.exact_words += 1
        return guesses

    def decode(self, ids: Sequence[int]) -> str:
        """As the library's decode(ids, skip_special_tokens=False): tokens joined by spaces, or their bytes."""
        if self.decoder is None:
            return " ".join(map(self.texts.__getitem__, ids))
        text, table = "".join(map(self.texts.__getitem__, ids)), self.bytes
        return bytes(table[c] for c in text).decode("utf-8", "replace") if all(c in table for c in text) else b"".join(bytes([table[c]]) if c in table else c.encode() for c in text).decode("utf-8", "replace")
