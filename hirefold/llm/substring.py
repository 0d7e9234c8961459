"""Repeated-substring removal over words with suffix automata.

A window is ``size`` consecutive words of one text. A word goes if a window
that covers it also starts in a document with a smaller id; windows are
judged on the input. The result is exact for every window.

Broadcasting an automaton of every reference shard to every document would
cost shards times documents, so documents meet only the shards that can hold
a match:

1. Every window has a minimizer, the smallest hash of its ``PART``-word
   grams; equal windows have equal minimizers. Each batch of documents sends
   its distinct minimizers (4 bytes each) to buckets; a bucket replies which
   of them more than one document has.
2. Runs of windows that share such a minimizer form segments. Each distinct
   segment of a batch goes, with its smallest and largest document id, to the
   reference shard of its minimizer (windows of a minimizer that more than
   ``HOT`` batches hold go one by one, by their own hash).
3. A shard builds suffix automata of its distinct segments, one a minimizer,
   in order of document id. Before a segment is added it is streamed through
   the automaton: matching statistics of ``size`` words or more name the
   first document that has the window. (A segment that is alone with its
   minimizer has nothing to match.) Each batch gets the windows that a
   smaller document has.
4. Each batch marks its documents' windows (128 bits of hash) and removes the
   words they cover.

Segments of copies meet as one entry per batch, so no group of copies is ever
gathered whole.

Null text has no words. A null id counts as larger than any other, and two
null ids as one document; so do rows that repeat an id.

An empty table gives an empty table. A very long text is held whole by the
task of its batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirefold.llm.common import keyed_text, large, pieces
from hirefold.llm.words import buffer, gram_hashes, gram_starts, mix, span_hashes, spans

SIZE = 13
PART = 5
#: Bytes of text in a batch, and bytes of text behind a bucket or shard.
BATCH = 2 << 20
SHARD = 12 << 20
HOT = 64
_LAST = (1 << 63) - 1
CHECK = 0xA0761D6478BD642F


class Batch:
    """The words, windows and minimizers of one batch of documents."""

    def __init__(self, table: pa.Table, size: int):
        ids = table.column("doc_id").combine_chunks()
        self.ids = ids
        self.order = ids.fill_null(_LAST).to_numpy(zero_copy_only=False)
        self.raw, offsets = buffer(large(table.column("text")))
        self.starts, self.ends, self.first = spans(self.raw, offsets)
        self.hashes = span_hashes(self.raw, self.starts, self.ends)
        self.size = size
        n = len(self.starts)
        self.at = np.flatnonzero(gram_starts(self.first, size, n))  # words at which a window starts
        self.doc = np.repeat(self.order, np.diff(self.first))  # id by word

    def minimizers(self) -> np.ndarray:
        part = min(PART, self.size)
        low, width, want = gram_hashes(self.hashes, part), 1, self.size - part + 1
        while 2 * width <= want:
            low, width = np.minimum(low[:-width], low[width:]), 2 * width
        if width < want and len(low):
            rest = want - width
            low = np.minimum(low[:len(low) - rest], low[rest:])
        return low[self.at] if len(self.at) else np.zeros(0, np.uint64)

    def windows(self) -> np.ndarray:
        h = gram_hashes(self.hashes, self.size)
        return h[self.at] if len(self.at) else np.zeros(0, np.uint64)

    def check(self, at: np.ndarray) -> np.ndarray:
        """A second hash of the windows that start at the given words."""
        out = np.zeros(len(at), np.uint64)
        for j in range(self.size):
            out = out * np.uint64(CHECK) + self.hashes[at + j]
        return mix(out)


def _place(h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 32-bit key of a minimizer."""
    return ((h >> np.uint64(32)) % np.uint64(n)).astype(np.int64), h.astype(np.uint32)


def _split(order_by: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(value, indices) for each value of an integer array."""
    order = np.argsort(order_by, kind="stable")
    cuts = np.flatnonzero(np.diff(order_by[order])) + 1
    return [(int(order_by[g[0]]), g) for g in np.split(order, cuts) if len(g)]


def _send(size: int, n: int):
    def run(key, table):
        b = Batch(table, size)
        h = b.minimizers()
        new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (np.diff(b.at) != 1)]) if len(h) else []
        h, doc = h[new], b.doc[b.at[new]] if len(h) else h
        order = np.argsort(h, kind="stable")
        h, doc = h[order], doc[order]
        runs = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
        many = (np.minimum.reduceat(doc, runs) != np.maximum.reduceat(doc, runs)) if len(h) else np.zeros(0, bool)
        bucket, short = _place(h[runs], n)
        out = [(k, short[i].tobytes(), short[i[many[i]]].tobytes()) for k, i in _split(bucket)]
        return pa.table({"bucket": pa.array([x[0] for x in out], pa.int64()),
                         "batch": pa.array([key[0].as_py()] * len(out), pa.int64()),
                         "keys": pa.array([x[1] for x in out], pa.binary()),
                         "many": pa.array([x[2] for x in out], pa.binary())})
    return run


def _joined(column: pa.ChunkedArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """All blobs of a column as one array, and the row of each entry."""
    blobs = column.to_pylist()
    size = np.dtype(kind).itemsize
    return (np.frombuffer(b"".join(blobs), kind),
            np.repeat(np.arange(len(blobs)), [len(x) // size for x in blobs]))


def _reply(table):
    keys, row = _joined(table.column("keys"), np.uint32)
    many, _ = _joined(table.column("many"), np.uint32)
    values, where, counts = np.unique(keys, return_inverse=True, return_counts=True)
    live = (counts > 1) | np.isin(values, many)
    hot = (counts > HOT)[where]
    live = live[where]
    batches = table.column("batch").to_numpy()
    bucket = table.column("bucket")[0].as_py() if table.num_rows else 0
    out = []
    for r, i in _split(row):
        mine = i[live[i]]
        if len(mine):
            out.append((int(batches[r]), keys[mine].tobytes(), keys[mine[hot[mine]]].tobytes()))
    return pa.table({"batch": pa.array([x[0] for x in out], pa.int64()),
                     "bucket": pa.array([bucket] * len(out), pa.int64()),
                     "live": pa.array([x[1] for x in out], pa.binary()),
                     "hot": pa.array([x[2] for x in out], pa.binary())})


def _composite(replies: pa.Table, name: str) -> np.ndarray:
    keys, row = _joined(replies.column(name), np.uint32)
    bucket = replies.column("bucket").to_numpy().astype(np.uint64)
    return np.unique((bucket[row] << np.uint64(32)) | keys.astype(np.uint64))


def _segments(size: int, n: int):
    def run(key, table, replies):
        out: dict[int, dict[bytes, list[int]]] = {}
        if table.num_rows and replies.num_rows:
            b = Batch(table, size)
            h = b.minimizers()
            if len(h):
                new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (np.diff(b.at) != 1)])
                last = np.r_[new[1:], len(h)] - 1
                bucket, short = _place(h[new], n)
                code = (bucket.astype(np.uint64) << np.uint64(32)) | short.astype(np.uint64)
                hot = np.isin(code, _composite(replies, "hot"))
                live = np.isin(code, _composite(replies, "live")) & ~hot
                # Each hot run becomes one segment a window, dealt by its own hash.
                single = np.flatnonzero(np.repeat(hot, last - new + 1))
                own = (mix(b.windows()[single]) >> np.uint64(32)) % np.uint64(n) if len(single) else np.zeros(0)
                begin = np.r_[b.at[new[live]], b.at[single]]
                end = np.r_[b.at[last[live]], b.at[single]] + size - 1
                shard = np.r_[bucket[live], own.astype(np.int64)]
                # The words of the batch joined by single spaces.
                lens = b.ends - b.starts
                stop = np.cumsum(lens)
                place = np.arange(int(stop[-1]))
                joined = np.full(len(place) + len(lens), 0x20, np.uint8)
                joined[place + np.repeat(np.arange(len(lens)), lens)] = b.raw[
                    place + np.repeat(b.starts - (stop - lens), lens)]
                data = joined.tobytes()
                stop += np.arange(len(lens))
                head, tail = (stop[begin] - lens[begin]).tolist(), stop[end].tolist()
                for s, a, z, d in zip(shard.tolist(), head, tail, b.doc[begin].tolist(), strict=True):
                    seen = out.setdefault(s, {}).setdefault(data[a:z], [d, d])
                    if d < seen[0]:
                        seen[0] = d
                    elif d > seen[1]:
                        seen[1] = d
        rows = [(s, list(x)) for s, x in out.items()]
        pack = lambda v, kind: np.array(v, kind).tobytes()
        return pa.table({
            "shard": pa.array([s for s, _ in rows], pa.int64()),
            "batch": pa.array([key[0].as_py()] * len(rows), pa.int64()),
            "low": pa.array([pack([out[s][k][0] for k in x], np.int64) for s, x in rows], pa.binary()),
            "high": pa.array([pack([out[s][k][1] for k in x], np.int64) for s, x in rows], pa.binary()),
            "bytes": pa.array([pack([len(k) for k in x], np.int32) for _, x in rows], pa.binary()),
            "data": pa.array([b"".join(x) for _, x in rows], pa.binary())})
    return run


class SuffixAutomaton:
    """Suffix automaton of several word sequences (``add``); each state knows
    the document of the sequence that first brought it."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.doc = [-1], [0], [None]

    def _state(self, length, nexts, link, doc) -> int:
        self.next.append(nexts)
        self.link.append(link)
        self.length.append(length)
        self.doc.append(doc)
        return len(self.link) - 1

    def _clone(self, p: int, c, q: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q], self.doc[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def add(self, words, doc) -> None:
        last = 0
        for c in words:
            q = self.next[last].get(c)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
                continue
            new, p = self._state(self.length[last] + 1, {}, 0, doc), last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
            last = new

    def first_docs(self, words, size: int) -> list:
        """For each window of ``size`` words the document that first brought
        it, or None (from matching statistics)."""
        nexts, link, length = self.next, self.link, self.length
        out, state, matched = [], 0, 0
        for i, c in enumerate(words):
            while state and c not in nexts[state]:
                state = link[state]
                matched = length[state]
            if c in nexts[state]:
                state = nexts[state][c]
                matched += 1
                while length[link[state]] >= size:  # the state of the last ``size`` words
                    state = link[state]
                    matched = length[state]
            if i >= size - 1:
                out.append(self.doc[state] if matched >= size else None)
        return out


def _match(size: int):
    def run(table):
        # Distinct segments of the shard, and who uses them.
        names: dict[bytes, int] = {}
        uses, batches = [], []
        lows, _ = _joined(table.column("low"), np.int64)
        highs, _ = _joined(table.column("high"), np.int64)
        for batch, sizes, data in zip(*(table.column(c).to_pylist() for c in ("batch", "bytes", "data")), strict=True):
            at = 0
            for n in np.frombuffer(sizes, np.int32).tolist():
                uses.append(names.setdefault(data[at:at + n], len(names)))
                at += n
            batches.append((batch, len(sizes) // 4))
        empty = pa.table({"batch": pa.array([], pa.int64()), **{c: pa.array([], pa.binary()) for c in ("window", "check", "first")}})
        if not uses:
            return empty
        texts, uses = list(names), np.array(uses)
        own = np.full(len(texts), _LAST, np.int64)
        np.minimum.at(own, uses, lows)
        # The words of all segments, one after another.
        sizes = np.array([len(t) for t in texts])
        raw = np.frombuffer(b"".join(texts), np.uint8)
        starts, ends, first = spans(raw, np.r_[0, np.cumsum(sizes)])
        h = span_hashes(raw, starts, ends)
        total = len(starts)
        seen = np.repeat(own, np.diff(first))  # by word: first document of the window that starts there
        part = min(PART, size)
        low = np.full(total, np.iinfo(np.uint64).max, np.uint64)
        inside = np.flatnonzero(gram_starts(first, part, total))
        low[inside] = gram_hashes(h, part)[inside]
        low = np.minimum.reduceat(low, first[:-1])
        # Segments share windows only within a minimizer, and only if one of
        # them is longer than a window (equal segments are one).
        order = np.lexsort((own, low))
        cuts = np.flatnonzero(np.r_[True, low[order][1:] != low[order][:-1], True])
        longest = np.maximum.reduceat(np.diff(first)[order], cuts[:-1])
        for a, z in zip(cuts[:-1][(np.diff(cuts) > 1) & (longest > size)].tolist(),
                        cuts[1:][(np.diff(cuts) > 1) & (longest > size)].tolist(), strict=True):
            machine = SuffixAutomaton()
            for s in order[a:z].tolist():
                words = texts[s].split(b" ")
                known = machine.first_docs(words, size)
                if None in known:
                    machine.add(words, int(own[s]))
                at = int(first[s])
                for i, d in enumerate(known):
                    if d is not None:
                        seen[at + i] = d
        ok = gram_starts(first, size, total)
        window = np.zeros(total, np.uint64)
        check = np.zeros(total, np.uint64)
        at = np.flatnonzero(ok)
        if len(at):
            window[at] = gram_hashes(h, size)[at]
            for j in range(size):
                check[at] = check[at] * np.uint64(CHECK) + h[at + j]
            check = mix(check)
        # Each batch gets the windows that a document before its last has.
        out, at = [], 0
        count = np.diff(first) - size + 1
        for batch, n in batches:
            mine, high = uses[at:at + n], highs[at:at + n]
            at += n
            c = count[mine]
            place = np.repeat(first[mine] - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))
            place = place[seen[place] < np.repeat(high, c)]
            if len(place):
                out.append((batch, window[place].tobytes(), check[place].tobytes(), seen[place].tobytes()))
        if not out:
            return empty
        return pa.table({"batch": pa.array([x[0] for x in out], pa.int64()),
                         **{c: pa.array([x[i + 1] for x in out], pa.binary())
                            for i, c in enumerate(("window", "check", "first"))}})
    return run


def _remove(size: int):
    def run(key, table, found):
        b = Batch(table, size)
        n = len(b.starts)
        gone = np.zeros(n, bool)
        if found.num_rows and len(b.at):
            window, _ = _joined(found.column("window"), np.uint64)
            check, _ = _joined(found.column("check"), np.uint64)
            first, _ = _joined(found.column("first"), np.int64)
            order = np.lexsort((check, window))
            window, check, first = window[order], check[order], first[order]
            # One entry a window: its smallest document (two hashes name it).
            new = np.flatnonzero(np.r_[True, (window[1:] != window[:-1]) | (check[1:] != check[:-1])])
            window, check, first = window[new], check[new], np.minimum.reduceat(first, new)
            mine = b.windows()
            place = np.minimum(np.searchsorted(window, mine), len(window) - 1)
            hit = np.flatnonzero(window[place] == mine)
            if len(hit):
                place, starts = place[hit], b.at[hit]
                mine_check = b.check(starts)
                for _ in range(len(window)):  # past another window with the same first hash
                    ahead = (check[place] != mine_check) & (place + 1 < len(window))
                    ahead[ahead] = window[place[ahead] + 1] == window[place[ahead]]
                    if not ahead.any():
                        break
                    place[ahead] += 1
                repeated = starts[(check[place] == mine_check) & (first[place] < b.doc[starts])]
                cover = np.zeros(n + 1, np.int64)
                np.add.at(cover, repeated, 1)
                np.add.at(cover, repeated + size, -1)
                gone = np.cumsum(cover[:-1]) > 0
        kept = np.flatnonzero(~gone)
        cuts = np.searchsorted(kept, b.first)
        raw = b.raw.tobytes()
        pairs = list(zip(b.starts[kept].tolist(), b.ends[kept].tolist(), strict=True))
        texts = [b" ".join([raw[s:e] for s, e in pairs[x:y]]).decode()
                 for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        n_words = np.diff(b.first)
        return pa.table({"doc_id": b.ids, "n_words": pa.array(n_words, pa.int64()),
                         "n_removed": pa.array(n_words - np.diff(cuts), pa.int64()),
                         "text": pa.array(texts, pa.string())})
    return run


def dedup_substrings(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, text (the words
    that stay, joined by one space)."""
    rows = keyed_text(docs, id_col, text_col)
    total = pieces(rows, F.octet_length("text"), BATCH)
    n = max(1, total * BATCH // SHARD)
    # By id and text: texts of a repeated or null id spread too.
    rows = rows.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(total)))
    by_batch = rows.groupBy("batch")
    sent = by_batch.applyInArrow(_send(size, n), "bucket long, batch long, keys binary, many binary")
    replies = sent.groupBy("bucket").applyInArrow(_reply, "batch long, bucket long, live binary, hot binary")
    sections = by_batch.cogroup(replies.groupBy("batch")).applyInArrow(
        _segments(size, n), "shard long, batch long, low binary, high binary, bytes binary, data binary")
    found = sections.groupBy("shard").applyInArrow(_match(size), "batch long, window binary, check binary, first binary")
    return by_batch.cogroup(found.groupBy("batch")).applyInArrow(
        _remove(size), "doc_id long, n_words long, n_removed long, text string")
