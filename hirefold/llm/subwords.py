"""Hashed word, word-pair and character n-gram features of whole texts, as
numpy arrays over code points. Shared by the classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Code points hashed at a time.
BLOCK = 1 << 17
R = np.uint32(0x9E3779B1)


def blocks_of(texts: list[str]) -> Iterator[tuple[list[int], str, np.ndarray]]:
    """Blocks of about BLOCK code points: the texts' numbers, the joined
    string, and where each begins. Longer texts are cut after spaces, so every
    text is read whole and no word is split (a word beyond a block is)."""
    owners, parts, size = [], [], 0
    for i, t in enumerate(texts):
        at = 0
        while at < len(t):
            to = min(len(t), at + BLOCK)
            if to < len(t):
                cut = t.rfind(" ", at + 1, to)
                to = cut + 1 if cut > 0 else to
            if size and size + to - at > BLOCK:
                yield _joined(owners, parts)
                owners, parts, size = [], [], 0
            owners.append(i)
            parts.append(t[at:to])
            size += to - at
            at = to
    if parts:
        yield _joined(owners, parts)


def _joined(owners: list[int], parts: list[str]) -> tuple[list[int], str, np.ndarray]:
    begins = np.cumsum([0] + [len(p) + 2 for p in parts])
    return owners, "".join(f" {p} " for p in parts), begins


def _found(text: str, begins: np.ndarray, bits: int, grams: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, feature number) arrays of a block: each word; each pair of
    neighbouring words of a text, where a repeated word is one feature
    whichever word it is; each character n-gram of a word with its
    boundaries."""
    down = np.uint32(32 - bits)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = (c == 32) | ((c >= 9) & (c <= 13))
    v = np.where(space, np.uint32(32), c) * R
    v ^= v >> np.uint32(15)
    begin = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    if not len(begin):
        return
    end = np.flatnonzero(~space[:-1] & space[1:]) + 1
    lens = end - begin
    powers = np.full(int(lens.max()), R, np.uint32)
    powers[0] = 1
    powers = np.multiply.accumulate(powers, dtype=np.uint32)
    letters = ~space
    place = np.flatnonzero(letters)
    first = np.cumsum(lens) - lens
    word = np.add.reduceat(v[place] * powers[place - np.repeat(begin, lens)], first, dtype=np.uint32)
    word ^= word >> np.uint32(16)
    yield begin, (word * np.uint32(0x85EBCA6B)) >> down
    same_text = np.searchsorted(begins, begin[1:], "right") == np.searchsorted(begins, begin[:-1], "right")
    pair = np.where(word[1:] == word[:-1], np.uint32(0x5BD1E995), (word[:-1] * R + word[1:]) * np.uint32(0xC2B2AE35))
    yield begin[1:][same_text], (pair >> down)[same_text]
    h, inner = v, None
    for n in range(2, max(grams) + 1):
        m = len(c) - n + 1
        if m <= 0:
            return
        # Grams may begin and end with a boundary, but not run over one.
        h = h[:m] * R + v[n - 1:n - 1 + m]
        inner = letters[1:m + 1] if n == 3 else inner[:m] & letters[n - 2:n - 2 + m] if n > 3 else None
        if n in grams:
            keep = np.flatnonzero(inner if inner is not None else letters[:m] | letters[1:m + 1])
            g = h[keep]
            g ^= g >> np.uint32(13)
            yield keep, (g * np.uint32(0xC2B2AE3D)) >> down


def counted(text: str, bits: int, grams: tuple[int, ...] = (3, 4)) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers (below 2**bits) of a text and their counts."""
    every = [f for _, block, begins in blocks_of([text]) for _, f in _found(block, begins, bits, grams)]
    if not every:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    return np.unique(np.concatenate(every), return_counts=True)


def scores(texts: list[str], weights: np.ndarray, bits: int, grams: tuple[int, ...] = (3, 4)) -> np.ndarray:
    """Mean feature weight of each text (0 for a text without features)."""
    total, n = np.zeros(len(texts)), np.zeros(len(texts))
    for owners, block, begins in blocks_of(texts):
        for place, f in _found(block, begins, bits, grams):
            cuts = np.searchsorted(place, begins)
            sums = np.concatenate([[0.0], np.cumsum(weights[f], dtype=np.float64)])
            np.add.at(total, owners, sums[cuts[1:]] - sums[cuts[:-1]])
            np.add.at(n, owners, np.diff(cuts))
    return total / np.maximum(n, 1)


_CODES = 0x3000
_LETTER = np.array([chr(i).isalnum() for i in range(_CODES)])
_UPPER = np.array([chr(i).isupper() for i in range(_CODES)])
_LOW = np.array([ord(chr(i).lower()) if len(chr(i).lower()) == 1 else i for i in range(_CODES)], np.uint32)


class Words:
    """Lower-cased words (runs of letters and digits) of a block of texts:
    ``hashes`` has the words in row 0 and, for each stem length, the stems of
    longer words (0: none); ``cuts`` has each text's first word."""

    def __init__(self, owners: list[int], text: str, begins: np.ndarray, stems: tuple[int, ...] = ()):
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.minimum(c, _CODES - 1)
        letter = _LETTER[code] | (c >= _CODES)
        self.owners, self.begins = owners, begins
        self.upper = np.add.reduceat(_UPPER[code], begins[:-1], dtype=np.int64)
        begin = np.flatnonzero(~letter[:-1] & letter[1:]) + 1
        lens = np.flatnonzero(letter[:-1] & ~letter[1:]) + 1 - begin
        place = np.flatnonzero(letter)
        first = np.cumsum(lens) - lens
        powers = np.full(int(lens.max()) if len(lens) else 1, R, np.uint32)
        powers[0] = 1
        powers = np.multiply.accumulate(powers, dtype=np.uint32)
        low = np.where(c[place] < _CODES, _LOW[code[place]], c[place])
        v = low * R
        v = (v ^ (v >> np.uint32(15))) * powers[place - np.repeat(begin, lens)]
        upto = np.concatenate([np.zeros(1, np.uint32), np.cumsum(v, dtype=np.uint32)])
        head = upto[first]
        rows = [_mix32(upto[first + lens] - head, 1)]
        rows += [np.where(lens > k, _mix32(upto[first + np.minimum(lens, k)] - head, k), np.uint32(0)) for k in stems]
        self.hashes = np.stack(rows)
        self.cuts = np.searchsorted(begin, begins)


def _mix32(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B) + np.uint32(salt)
    return h ^ (h >> np.uint32(13))
