"""Line dedup by winnowing over line hashes.

A text's non-blank lines (ASCII white space stripped) form a sequence of
128-bit hashes. Grams of ``gram`` lines are hashed and of every ``window``
consecutive grams the smallest (rightmost of equals) is selected, so any run
of gram + window - 1 lines that repeats has a selected gram in common: the
guarantee of winnowing. A text of fewer grams than a window selects its
smallest gram; a text of fewer lines than a gram has none.

Positions join on the gram's hash. The first position (smallest doc_id, then
smallest line) is the source; every later position is extended line by line
both ways against it, up to ``reach`` lines each way - neighbouring grams of
a longer run carry on from there - and the lines of the resulting run are
deleted. The windows of gram + window - 1 lines around a position that the
extension did not cover (their first copy lies at another position of the
gram) join once more, by all their lines. So every line of every later run of
gram + window - 1 lines or more goes. Only line hashes travel; every group is
folded to its smallest position before the shuffle.

With ``lone_lines`` (the registered query) shorter repeats go too: the lines
that no run covers are compared singly, and one that an earlier place holds
is a run of its own. A line of a run has an earlier place, so a line's first
place is never covered: the lines left are all that this pass needs, and the
runs found by few fingerprints keep the rest out of its shuffle.

Null text is empty; a null id counts as the last document. Rows that repeat
an id with the same text are one document; with different texts they are
ordered by text hash. Blank lines are never deleted.

An empty table gives an empty table. A very long text is split whole, in the
Arrow batch that holds it; its lines stream past the hashed runs. Its hashes
(16 bytes a line) and its runs are each one value.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirefold.llm.common import cut, keyed_text, large
from hirefold.llm.words import gram_hashes

GRAM, WINDOW, REACH = 2, 3, 4
_LAST = (1 << 63) - 1


def line_digests(text: bytes) -> tuple[list[bytes], list[int], bytes]:
    """The lines, the indices of those that aren't blank, and their 16-byte hashes."""
    lines = text.split(b"\n")
    bare = [x.strip() for x in lines]
    kept = [i for i, x in enumerate(bare) if x]
    return lines, kept, b"".join(hashlib.blake2b(bare[i], digest_size=16).digest() for i in kept)


def _pairs(digests: bytes) -> np.ndarray:
    return np.frombuffer(digests, "<u8").reshape(-1, 2)


def line_hashes(text: bytes) -> tuple[list[bytes], list[int], np.ndarray]:
    """As ``line_digests``, with the first 64 bits of each hash (what grams are made of)."""
    lines, kept, digests = line_digests(text)
    return lines, kept, _pairs(digests)[:, 0].astype(np.uint64)


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Selected positions: the minimum of every window, rightmost of equals."""
    n = len(grams)
    if not n:
        return np.zeros(0, np.int64)
    w = min(window, n)
    view = np.lib.stride_tricks.sliding_window_view(grams[::-1], w)
    picks = n - 1 - (np.arange(n - w + 1) + view.argmin(axis=1))  # leftmost of the reverse
    return np.unique(picks)


def _text_key(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


def _sketch(batches):
    for b in batches:
        keys, digests = [], []
        for t in large(b.column("text")):
            data = t.as_buffer().to_pybytes()
            keys.append(_text_key(data))
            digests.append(line_digests(data)[2])
        docs = [_LAST if d is None else d for d in b.column("doc_id").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(docs, pa.int64()), pa.array(keys, pa.int64()), pa.array(digests, pa.binary())],
            ["doc", "text_key", "digests"])


def _sketches(b: pa.RecordBatch):
    return zip(b.column("doc").to_pylist(), b.column("text_key").to_pylist(),
               (_pairs(d) for d in b.column("digests").to_pylist()), strict=True)


def _positions(gram: int, window: int, reach: int):
    size = gram + 2 * reach

    def run(batches):
        for b in batches:
            docs, keys, at, grams, contexts = [], [], [], [], []
            for doc, key, h in _sketches(b):
                g = gram_hashes(h[:, 0].astype(np.uint64), gram)
                picked = winnow(g, window)
                if not len(picked):
                    continue
                # Around each gram: hashes of the lines, 0 beyond the ends.
                beyond = np.zeros((reach, 2), "<u8")
                pad = np.concatenate([beyond, h, beyond])
                around = pad[picked[:, None] + np.arange(size)]
                docs += [doc] * len(picked)
                keys += [key] * len(picked)
                at += picked.tolist()
                grams.append(g[picked].view(np.int64))
                contexts += [row.tobytes() for row in around]
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(keys, pa.int64()), pa.array(at, pa.int32()),
                 pa.array(np.concatenate(grams) if grams else [], pa.int64()), pa.array(contexts, pa.binary())],
                ["doc", "text_key", "line", "gram", "context"])
    return run


def _extend(gram: int, window: int, reach: int):
    """Runs (window null) of the positions extended against their sources, and
    the windows around them that the runs don't cover."""
    size = gram + window - 1

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            mine, source = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u8").reshape(b.num_rows, -1, 2)
                            for c in ("context", "source_context"))
            inside = (mine != 0).any(axis=2)
            same = (mine == source).all(axis=2) & inside
            back = np.cumprod(same[:, :reach][:, ::-1], axis=1).sum(axis=1)
            ahead = np.cumprod(same[:, reach + gram:], axis=1).sum(axis=1)
            fine = same[:, reach:reach + gram].all(axis=1)  # the grams themselves, not just their hashes
            line = b.column("line").to_numpy()
            rows, begins, ends, windows = [np.flatnonzero(fine)], [(line - back)[fine]], [(line + gram + ahead)[fine]], []
            for shift in range(window):
                span = slice(reach - shift, reach - shift + size)
                open_ = ~fine | (back < shift) | (gram + ahead < size - shift)
                at = np.flatnonzero(open_ & inside[:, span].all(axis=1))
                rows.append(at)
                begins.append(line[at] - shift)
                ends.append(line[at] - shift + size)
                windows += [x.tobytes() for x in mine[at, span]]
            at = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc").take(at), b.column("text_key").take(at), pa.array(np.concatenate(begins), pa.int32()),
                 pa.array(np.concatenate(ends), pa.int32()),
                 pa.array([None] * len(rows[0]) + windows, pa.binary())], ["doc", "text_key", "from", "to", "window"])
    return run


def _later_runs(sketches: DataFrame, gram: int, window: int, reach: int) -> DataFrame:
    reach = max(reach, window - 1)
    places = cut(sketches.mapInArrow(_positions(gram, window, reach),
                                     "doc long, text_key long, line int, gram long, context binary"))
    first = F.min(F.struct("doc", "text_key", "line", F.col("context").alias("source_context"))).alias("s")
    last = F.max(F.struct("doc", "text_key", "line")).alias("l")
    source = (places.groupBy("gram").agg(first, last)
              .where("struct(s.doc, s.text_key, s.line) <> l").select("gram", "s"))
    later = places.join(cut(source), "gram").where("struct(doc, text_key, line) > struct(s.doc, s.text_key, s.line)")
    runs = cut(later.select("doc", "text_key", "line", "context", "s.source_context")
               .mapInArrow(_extend(gram, window, reach), "doc long, text_key long, from int, to int, window binary"))
    rest = runs.where("window is not null")
    place = F.struct("doc", "text_key", "from")
    again = cut(rest.groupBy("window").agg(F.min(place).alias("s"), F.max(place).alias("l"))
                .where("s <> l").select("window", "s"))
    more = rest.join(again, "window").where("struct(doc, text_key, from) > s")
    names = ["doc", "text_key", "from", "to"]
    return runs.where("window is null").select(*names).union(more.select(*names))


def _per_doc(runs: DataFrame) -> DataFrame:
    # A document's runs are at most as many as its lines.
    return cut(runs.distinct().groupBy("doc", "text_key").agg(F.collect_list(F.struct("from", "to")).alias("runs")))


def _covered(runs, n: int) -> np.ndarray:
    """Which of ``n`` lines lie in a run."""
    steps = np.zeros(n + 1, np.int64)
    for r in runs or ():
        steps[r["from"]] += 1
        steps[r["to"]] -= 1
    return np.cumsum(steps[:n]) > 0


def _left(batches):
    for b in batches:
        docs, keys, at, digests = [], [], [], []
        for (doc, key, h), runs in zip(_sketches(b), b.column("runs").to_pylist(), strict=True):
            free = np.flatnonzero(~_covered(runs, len(h)))
            docs += [doc] * len(free)
            keys += [key] * len(free)
            at.append(free)
            digests += [x.tobytes() for x in h[free]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(docs, pa.int64()), pa.array(keys, pa.int64()),
             pa.array(np.concatenate(at) if at else [], pa.int32()), pa.array(digests, pa.binary())],
            ["doc", "text_key", "line", "digest"])


def _later_lines(sketches: DataFrame, per_doc: DataFrame) -> DataFrame:
    """Runs of one line: the uncovered lines that an earlier place holds."""
    left = cut(sketches.join(per_doc, ["doc", "text_key"], "left")
               .mapInArrow(_left, "doc long, text_key long, line int, digest binary"))
    place = F.struct("doc", "text_key", "line")
    first = cut(left.groupBy("digest").agg(F.min(place).alias("s"), F.max(place).alias("l"))
                .where("s <> l").select("digest", "s"))
    later = left.join(first, "digest").where("struct(doc, text_key, line) > s")
    return later.select("doc", "text_key", F.col("line").alias("from"), (F.col("line") + 1).alias("to"))


def _line_sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return cut(keyed_text(docs, id_col, text_col).mapInArrow(_sketch, "doc long, text_key long, digests binary"))


def repeated_runs(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, reach: int = REACH,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Later repeated runs: doc, text_key, from, to (line numbers among the
    non-blank lines, end exclusive; runs of one document may overlap)."""
    return _later_runs(_line_sketches(docs, id_col, text_col), gram, window, reach)


def _delete(batches):
    for b in batches:
        texts, n_lines, n_gone = [], [], []
        for t, runs in zip(large(b.column("text")), b.column("runs").to_pylist(), strict=True):
            lines = t.as_buffer().to_pybytes().split(b"\n")
            kept = [i for i, x in enumerate(lines) if x.strip()]
            gone = {kept[i] for i in np.flatnonzero(_covered(runs, len(kept))).tolist()} if runs else ()
            n_lines.append(len(lines))
            n_gone.append(len(gone))
            texts.append(b"\n".join(x for i, x in enumerate(lines) if i not in gone).decode())
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(n_gone, pa.int64()),
             pa.array(texts, pa.string())], ["doc_id", "n_lines", "n_removed", "text"])


def _keys(batches):
    for b in batches:
        keys = [_text_key(t.as_buffer().to_pybytes()) for t in large(b.column("text"))]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array(keys, pa.int64())],
                                         ["doc_id", "text", "text_key"])


def dedup_lines(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, reach: int = REACH,
                lone_lines: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_lines, n_removed, text (without the
    lines of later repeated runs; with ``lone_lines``, without any line that
    an earlier place holds)."""
    sketches = _line_sketches(docs, id_col, text_col)
    runs = _later_runs(sketches, gram, window, reach)
    if lone_lines:
        runs = cut(runs)
        runs = runs.union(_later_lines(sketches, _per_doc(runs)))
    rows = keyed_text(docs, id_col, text_col).mapInArrow(_keys, "doc_id long, text string, text_key long")
    # The runs are hashed, so that the texts stream past them without a sort.
    joined = (rows.withColumn("doc", F.coalesce("doc_id", F.lit(_LAST)))
              .join(_per_doc(runs).hint("shuffle_hash"), ["doc", "text_key"], "left").select("doc_id", "text", "runs"))
    return joined.mapInArrow(_delete, "doc_id long, n_lines long, n_removed long, text string")
