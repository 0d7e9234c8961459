"""Vectorised words and hashes over Arrow strings: a batch of texts is one
byte buffer, and words, word hashes and word n-gram hashes are numpy arrays
over it. A word is ``[^\\x20\\x09-\\x0D]+`` in UTF-8 bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
STEP = np.uint64(0x9E3779B97F4A7C15)


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a large_string array and the offsets of its texts."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def spans(raw: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the index of the first word of
    each text (one more entry than texts). Words never cross texts."""
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    word = ~space[raw]
    head = np.zeros(n + 1, bool)
    head[offsets[:-1]] = True
    head[n] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | head[1:n]
    end = word.copy()
    end[:-1] &= ~word[1:] | head[1:n]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Spans above this many bytes are hashed one by one, over all their bytes at once.
LONG = 1 << 12


def _long_hash(span: np.ndarray) -> np.uint64:
    """A 64-bit hash of one long span: its eight-byte pieces, each mixed with
    its place, summed and mixed."""
    whole = np.zeros(-(-len(span) // 8) * 8, np.uint8)
    whole[:len(span)] = span
    pieces = whole.view("<u8").astype(np.uint64)
    places = np.arange(1, len(pieces) + 1, dtype=np.uint64) * STEP
    size = np.array([len(span)], np.uint64) * STEP
    return mix(size ^ mix(pieces ^ mix(places)).sum(dtype=np.uint64))[0]


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, eight bytes at a time over all spans
    of ordinary length; a span's hash depends on its bytes alone."""
    lens = ends - starts
    h = lens.astype(np.uint64) * STEP
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate([raw, np.zeros(8, np.uint8)]), 8)
    active, at = np.flatnonzero(lens <= LONG), 0
    for i in np.flatnonzero(lens > LONG).tolist():
        h[i] = _long_hash(raw[starts[i]:ends[i]])
    while len(active):
        x = np.ascontiguousarray(eight[starts[active] + at]).view("<u8").ravel()
        left = lens[active] - at
        # Bytes beyond the span fall off.
        x = x << (np.clip(8 - left, 0, 7).astype(np.uint64) * np.uint64(8))
        h[active] = mix(h[active] ^ x)
        active, at = active[left > 8], at + 8
    return h


def gram_hashes(hashes: np.ndarray, k: int, step: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hash of each k consecutive entries (len - k + 1 of them), built by
    doubling so that it takes about log2(k) passes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, part, width = None, 0, hashes, 1
    r = step
    m = k
    while m:
        if m & 1:
            piece = part[done:done + n]
            out = piece.copy() if out is None else out + piece * np.uint64(pow(step, done, 1 << 64))
            done += width
        m >>= 1
        if m:
            part = part[:-width] + part[width:] * np.uint64(r)
            r, width = r * r % (1 << 64), width * 2
    return mix(out)


def gram_starts(first: np.ndarray, k: int, total: int) -> np.ndarray:
    """Whether a gram of k words that starts at each word stays in its text
    (``first``: index of each text's first word; ``total`` words)."""
    ok = np.zeros(total, bool)
    if total:
        ends = np.repeat(first[1:], np.diff(first))
        ok[:] = np.arange(total) + k <= ends
    return ok
