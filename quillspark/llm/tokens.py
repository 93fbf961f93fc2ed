"""Encoding of many texts by public tokenizers, with a cache of words.

The ``tokenizers`` library encodes every distinct word once; texts are then put
together from the cached ids. A word here is what the tokenizer's own pre-tokenizer
cuts out, so the ids equal those of the whole text. Words are cut and looked up with
numpy, by a 64-bit hash that takes in their length; a hit is not compared again, so two
of W words in the cache share ids by mistake with odds of about W * W / 2**65, one in
16 million for the 1.5 million words at most that it holds. Texts with characters or contractions for
which this cut is not known to be the same go to the library whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
from itertools import pairwise

import numpy as np

#: Characters below this code point, one apart, neither compose under NFC nor change length in lower case.
_PLAIN_BELOW = 0x250
_NOT_PLAIN = re.compile("[^\x00-įı-ɏ]")
_CONTRACTION = re.compile("'(?:[sdmt]|re|ve|ll)")
_BETWEEN = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
_CACHED_WORDS = 1_500_000
_PART_CHARS = 1_000_000
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
_P = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64

_ENCODERS: dict[tuple[str, int], "Encoder"] = {}


def _kinds() -> np.ndarray:
    spaces = {*range(9, 14), 32, 0x85, 0xA0}
    of = {"L": _LETTER, "N": _NUMBER}
    return np.array([_SPACE if c in spaces else of.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(_PLAIN_BELOW)], dtype=np.uint8)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_P, pow(_P, -1, 1 << 64)):
        x = np.full(n, base, dtype=np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def _sorted(keys: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    return keys[order], word[order]


class _Growing:
    """An array that is added to at its end."""

    def __init__(self, kind):
        self.room, self.n = np.zeros(1024, dtype=kind), 0

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.room):
            self.room = np.concatenate([self.room[: self.n], np.zeros(self.n + 2 * len(more), self.room.dtype)])
        self.room[self.n : self.n + len(more)] = more
        self.n += len(more)

    @property
    def held(self) -> np.ndarray:
        return self.room[: self.n]


class Encoder:
    """``path``: a tokenizer file, byte-level or with lower-case words. ``end_id`` closes each text."""

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.end_id = end_id
        self.lower = self.library.normalizer is not None
        self.kinds = _kinds()
        self.alone = re.compile(r"[^\W\d_]+" if self.lower else r" [^\W\d_]+")
        self.up, self.down = _powers(1 << 16)
        self._clear()

    def _clear(self) -> None:
        # hashes of known words in order, and their numbers; recent words are kept apart until they are many
        self.keys, self.word = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.recent = self.keys, self.word
        self.ids, self.bounds = _Growing(np.uint32), _Growing(np.int64)
        self.bounds.add(np.zeros(1, np.int64))

    def _library(self, words: list[str]) -> list[list[int]]:
        """Ids of single words; plain ones go to the library as one text, which is faster."""
        out: list = [None] * len(words)
        plain = [k for k, w in enumerate(words) if self.alone.fullmatch(w)]
        glue = " " if self.lower else ""
        for a in range(0, len(plain), 2000):
            part = plain[a : a + 2000]
            found = self.library.encode(glue.join([words[k] for k in part]), add_special_tokens=False)
            of = np.array(found.word_ids, dtype=np.int64)
            ids, cuts = found.ids, np.searchsorted(of, np.arange(len(part) + 1)).tolist()
            if len(of) and of[-1] == len(part) - 1 and all(x < y for x, y in pairwise(cuts)):
                for k, x, y in zip(part, cuts[:-1], cuts[1:], strict=True):
                    out[k] = ids[x:y]
        rest = [k for k, x in enumerate(out) if x is None]
        for k, x in zip(rest, self.library.encode_batch([words[k] for k in rest], add_special_tokens=False), strict=True):
            out[k] = x.ids
        return out

    def _cut(self, chars: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each word. ``first`` marks the first character of each text."""
        kind = self.kinds[chars]
        new = np.empty(len(chars), dtype=bool)
        new[0] = True
        np.not_equal(kind[1:], kind[:-1], out=new[1:])
        new |= first
        space = kind == _SPACE
        if self.lower:
            new |= kind == _NUMBER
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(chars))
            word = ~space[starts]
            return starts[word], ends[word]
        # the last white space before a word stands apart, or, if it is a blank, joins the word
        last = np.zeros(len(chars), dtype=bool)
        last[:-1] = space[:-1] & ~space[1:] & ~first[1:]
        new |= last
        glued = np.flatnonzero(last & (chars == 32)) + 1
        new[glued] = False
        starts = np.flatnonzero(new)
        return starts, np.append(starts[1:], len(chars))

    def _hashes(self, chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(chars) >= len(self.up):
            self.up, self.down = _powers(2 * len(chars))
        sums = np.zeros(len(chars) + 1, dtype=np.uint64)
        np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * self.up[: len(chars)], out=sums[1:])
        x = (sums[ends] - sums[starts]) * self.down[starts]
        x ^= (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        return x * np.uint64(0xD6E8FEB86659FD93)

    def _words(self, text: str, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The number of each word, in the cache; unknown words enter it."""
        if len(self.keys) > _CACHED_WORDS:
            self._clear()
        some, where, back = np.unique(keys, return_index=True, return_inverse=True)
        number = np.full(len(some), -1, dtype=np.int64)
        for have, word in ((self.keys, self.word), self.recent):
            if len(have):
                at = np.minimum(np.searchsorted(have, some), len(have) - 1)
                number = np.where(have[at] == some, word[at], number)
        new = number < 0
        if new.any():
            fresh = where[new]
            ids = self._library([text[a:b] for a, b in zip(starts[fresh].tolist(), ends[fresh].tolist(), strict=True)])
            known = len(self.bounds.held) - 1
            number[new] = np.arange(len(ids)) + known
            self.bounds.add(self.bounds.held[-1] + np.cumsum([len(x) for x in ids], dtype=np.int64))
            self.ids.add(np.array([y for x in ids for y in x], dtype=np.uint32))
            self.recent = _sorted(np.concatenate([self.recent[0], some[new]]), np.concatenate([self.recent[1], number[new]]))
            if len(self.recent[0]) > 50_000 + len(self.keys) // 4:
                self.keys, self.word = _sorted(np.concatenate([self.keys, self.recent[0]]), np.concatenate([self.word, self.recent[1]]))
                self.recent = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return number[back]

    def _some(self, texts: list[str], closed: list[bool]) -> tuple[list[np.ndarray], list[int]]:
        """Ids of each text, with the end id where it is closed, and their counts."""
        plain, whole = [], {}
        for k, text in enumerate(texts):
            low = text.lower() if self.lower else text
            if _NOT_PLAIN.search(text) or "'" in text and _CONTRACTION.search(low):
                whole[k] = np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
            else:
                plain.append(low)
        joined, sizes = "".join(plain), np.array([len(x) for x in plain], dtype=np.int64)
        text_ends = np.cumsum(sizes)
        ids, marks = np.zeros(0, np.uint32), np.zeros(len(plain) + 1, np.int64)
        if joined:
            chars = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
            first = np.zeros(len(chars), dtype=bool)
            first[(text_ends - sizes)[sizes > 0]] = True
            starts, ends = self._cut(chars, first)
            which = self._words(joined, starts, ends, self._hashes(chars, starts, ends))
            bounds = self.bounds.held
            size, at = bounds[which + 1] - bounds[which], bounds[which]
            total = np.cumsum(size)
            ids = self.ids.held[np.arange(total[-1] if len(total) else 0) + np.repeat(at - (total - size), size)]
            marks = np.concatenate([[0], total])[np.searchsorted(starts, np.concatenate([[0], text_ends]))]
        pieces, counts, end, n = [], [], np.array([self.end_id], dtype=np.uint32), 0
        for k in range(len(texts)):
            if k in whole:
                own = whole[k]
            else:
                own = ids[marks[n] : marks[n + 1]]
                n += 1
            pieces += [own, end] if closed[k] else [own]
            counts.append(len(own) + closed[k])
        return pieces, counts

    def encode(self, texts: list[str | None]):
        """Yield (ids, lengths) of runs of texts, in order; a missing text is empty."""
        done: tuple[list, list, list] = ([], [], [])  # ids, counts and whether a text ends there
        part, closed, size = [], [], 0

        def flush() -> None:
            pieces, counts = self._some(part, closed)
            done[0].extend(pieces)
            done[1].extend(counts)
            done[2].extend(closed)
            part.clear()
            closed.clear()

        def taken() -> tuple[np.ndarray, np.ndarray]:
            ends = np.flatnonzero(done[2])
            sums = np.concatenate([[0], np.cumsum(done[1])])[np.concatenate([[0], ends + 1])]
            out = np.concatenate(done[0]), np.diff(sums)
            for x in done:
                x.clear()
            return out

        for text in texts:
            segments = _segments(text or "")
            for k, segment in enumerate(segments):
                part.append(segment)
                closed.append(k + 1 == len(segments))
                size += len(segment)
                if size >= _PART_CHARS:
                    flush()
                    size = 0
            if not part:
                yield taken()
        if part:
            flush()
        if done[0]:
            yield taken()


def _segments(text: str, most: int | None = None) -> list[str]:
    """A long text, cut before blanks at which any of the tokenizers begins a new word."""
    out, most = [], most or _PART_CHARS
    while len(text) > most and (m := _BETWEEN.search(text, most)):
        out.append(text[: m.start()])
        text = text[m.start() :]
    return [*out, text]


def encoder(path: str, end_id: int) -> Encoder:
    """The encoder of this Python worker; its cache outlives a task."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]
