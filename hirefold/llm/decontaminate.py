"""Benchmark decontamination by latent semantic retrieval.

Passages of all documents are TF-IDF vectors over the benchmark's words (no
other word can match an item); the benchmark's own passages join them with a
weight, so that the basis holds what tells items apart and not only what
common words share. A randomised SVD of this matrix - two distributed passes:
document frequencies, then the range sample A'A * Omega, both summed by Spark
- gives a latent basis, scaled by the inverse root of the singular values.
Windows of every document, at
lengths that fit the items, are searched by cosine in that basis; every
candidate is then checked on words: longest common subsequence with the item
(``FULL`` of its words, or ``PART`` of them if the answer - the item's last
sentence - is there too). Paraphrases that keep order and answer are found.

Documents are read once: their benchmark words and positions are written as
compact blobs, and all later passes read those. Candidates never leave their
task. The benchmark is taken in blocks of at most ``BLOCK_BYTES`` of text;
each block's vocabulary and basis is what a broadcast holds.

Null and empty texts match nothing; items without words match nothing. Rows
are judged one by one; repeated rows stay rows.

An empty table, or an empty benchmark, flags nothing. A very long text is read
whole; windows cover all of it.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirefold.llm.common import Shared, cut, free, keyed_text, large
from hirefold.llm.words import span_hashes, spans

BLOCK_BYTES = 2 << 20
RANK, EXTRA = 64, 8
#: Weight of the benchmark's own passages in the matrix: times their share.
ITEM_WEIGHT = 2.0
PASSAGE = 32
WINDOWS = (16, 32, 64)
COSINE = 0.55
FULL, PART, ANSWER = 0.8, 0.5, 0.8
#: Words whose vectors a task holds at a time, and benchmark words in a range sample block.
CHUNK = 1 << 14


#: Bytes that don't belong to words: ASCII other than letters and digits.
APART = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def lowered(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, and the first word of each (one more entry
    than texts). Words are lower-case runs of letters and digits."""
    parts = [t.lower().replace("\u2019", "'").replace("\u201c", '"').replace("\u201d", '"').encode("utf-8", "surrogatepass")
             for t in texts]
    raw = np.frombuffer(b"".join(parts), np.uint8)
    starts, ends, first = spans(raw, np.cumsum([0] + [len(p) for p in parts]), APART)
    return (span_hashes(raw, starts, ends) >> np.uint64(32)).astype(np.uint32), first


def words_of(text: str) -> np.ndarray:
    return lowered([text])[0]


class Benchmark:
    """Items as sequences of vocabulary numbers, with their answers."""

    def __init__(self, items: list[tuple[int, str]]):
        rows = [(i, words_of(t), words_of(_answer(t))) for i, t in items]
        rows = [r for r in rows if len(r[1])]
        self.ids = [r[0] for r in rows]
        self.vocabulary = np.unique(np.concatenate([r[1] for r in rows])) if rows else np.zeros(0, np.uint32)
        self.items = [np.searchsorted(self.vocabulary, r[1]) for r in rows]
        self.answers = [np.searchsorted(self.vocabulary, r[2]) for r in rows]
        self.counts = [dict(zip(*(x.tolist() for x in np.unique(w, return_counts=True)), strict=True)) for w in self.items]
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[self.vocabulary >> np.uint32(16)] = True
        self.kind = np.uint16 if len(self.vocabulary) < 1 << 16 else np.uint32

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the vocabulary's words, and their numbers."""
        place = np.flatnonzero(self.maybe[hashes >> np.uint32(16)])
        h = hashes[place]
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        true = self.vocabulary[at] == h
        return place[true], at[true]


def _answer(text: str) -> str:
    """The last sentence."""
    parts = [p for p in re.split(r"[.!?\n]+", text) if p.strip()]
    return parts[-1] if parts else ""


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence (bit-parallel)."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        m = row & masks.get(x, 0)
        row = ((row + m) | (row - m)) & full
    return len(a) - row.bit_count()


def _index(shared):
    def run(batches):
        bench = shared.value
        for b in batches:
            texts = large(b.column("text")).to_pylist()
            hashes, first = lowered(texts)
            place, number = bench.find(hashes)
            cuts = np.searchsorted(place, first)
            pairs = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
            place = (place - np.repeat(first[:-1], np.diff(cuts))).astype(np.uint32)
            number = number.astype(bench.kind)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_key"), pa.array(np.diff(first), pa.int64()),
                 pa.array([place[x:y].tobytes() for x, y in pairs], pa.binary()),
                 pa.array([number[x:y].tobytes() for x, y in pairs], pa.binary())],
                ["doc_id", "text_key", "n_words", "places", "numbers"])
    return run


def _documents(batch, kind):
    """(row, n_words, places, numbers) of a batch of blobs."""
    for i, (n, p, v) in enumerate(zip(batch.column("n_words").to_pylist(), batch.column("places").to_pylist(),
                                      batch.column("numbers").to_pylist(), strict=True)):
        yield i, n, np.frombuffer(p, np.uint32).astype(np.int64), np.frombuffer(v, kind).astype(np.int64)


def _passages(batches, kind):
    """Blocks of (passage of each word, numbers, passages) over fixed passages
    of PASSAGE words; a passage stays in one block."""
    passage, number, base, size = [], [], 0, 0
    for b in batches:
        for _, n, place, v in _documents(b, kind):
            passage.append(place // PASSAGE + base)
            number.append(v)
            base += -(-n // PASSAGE)
            size += len(v)
            if size >= CHUNK:
                yield np.concatenate(passage), np.concatenate(number), base
                passage, number, base, size = [], [], 0, 0
    if base:
        yield np.concatenate(passage), np.concatenate(number), base


def _frequencies(shared):
    def run(batches):
        bench = shared.value
        df, n, size = np.zeros(len(bench.vocabulary), np.int64), 0, len(bench.vocabulary)
        for passage, number, count in _passages(batches, bench.kind):
            df += np.bincount(np.unique(passage * size + number) % size, minlength=size)
            n += count
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, size)), pa.array(np.r_[n, df])], ["word", "n"])
    return run


def _range_sample(shared, idf: np.ndarray, omega: np.ndarray):
    def run(batches):
        bench = shared.value
        z = np.zeros(omega.shape)
        used = False
        scaled = (omega * idf[:, None]).astype(np.float32)
        for passage, number, count in _passages(batches, bench.kind):
            if not len(number):
                continue
            used = True
            norm = np.sqrt(np.bincount(passage, idf[number] ** 2, count)) + 1e-9
            new = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
            y = np.add.reduceat(scaled[number], new, axis=0) / (norm[passage[new]] ** 2)[:, None].astype(np.float32)
            rank = np.cumsum(np.r_[0, passage[1:] != passage[:-1]])
            order = np.argsort(number, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(number[order]) != 0])
            z[number[order[first]]] += np.add.reduceat(y[rank[order]], first, axis=0, dtype=np.float64)
        if used:
            z *= idf[:, None]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(z))), *(pa.array(z[:, j]) for j in range(z.shape[1]))],
                ["word", *(f"z{j}" for j in range(z.shape[1]))])
    return run


def _stretches(batch, kind):
    """Documents laid end to end, far enough apart that no window sees two:
    (rows, begins, places, numbers, total words) per stretch."""
    rows, begins, places, numbers, total = [], [], [], [], 0
    for i, n, place, number in _documents(batch, kind):
        if len(number):
            rows.append(i)
            begins.append(total)
            places.append(place + total)
            numbers.append(number)
            total += n + max(WINDOWS)
        if total >= CHUNK:
            yield rows, np.array(begins), places, numbers, total
            rows, begins, places, numbers, total = [], [], [], [], 0
    if rows:
        yield rows, np.array(begins), places, numbers, total


def _candidates(place: np.ndarray, number: np.ndarray, total: int, space: np.ndarray, groups: list):
    """(first word, item, end word) of windows close to an item."""
    for lo_word in range(0, total, CHUNK):  # windows begin in this stretch
        a, z = np.searchsorted(place, [lo_word, lo_word + CHUNK + max(WINDOWS)])
        if a == z:
            continue
        at = place[a:z]
        upto = np.zeros((z - a + 1, space.shape[1]), np.float32)
        np.cumsum(space[number[a:z]], axis=0, out=upto[1:])
        for length, items, vectors, sizes in groups:
            begins = np.arange(lo_word, min(lo_word + CHUNK, total), length // 2)
            lo, hi = np.searchsorted(at, begins), np.searchsorted(at, begins + length)
            some = np.flatnonzero(hi - lo >= sizes.min())
            if not len(some):
                continue
            v = upto[hi[some]] - upto[lo[some]]
            near = v @ vectors >= COSINE * (np.sqrt(np.einsum("ij,ij->i", v, v)) + 1e-9)[:, None]
            near &= (hi - lo)[some][:, None] >= sizes[None, :]
            w, j = np.nonzero(near)
            yield from zip(begins[some[w]].tolist(), items[j].tolist(), (begins[some[w]] + length).tolist(), strict=True)


def leaked(bench: Benchmark, item: int, number: np.ndarray, place: np.ndarray, begin: int, end: int) -> float:
    """Share of the item's words found in order near the window, if it counts
    as leaked; else 0."""
    words, answer = bench.items[item], bench.answers[item]
    n, best = len(words), 0.0
    span = n + n // 2 + 2
    # Enough of the item's words anywhere near?
    lo, hi = np.searchsorted(place, [begin - n, end + n])
    left, have = dict(bench.counts[item]), 0
    for x in number[lo:hi].tolist():
        if left.get(x, 0):
            left[x] -= 1
            have += 1
    if have < PART * n:
        return 0.0
    for start in range(begin - n, max(end - n // 2, begin - n + 1), max(1, n // 4)):
        lo, hi = np.searchsorted(place, [start, start + span])
        if hi - lo < PART * n:
            continue
        part = number[lo:hi]
        share = common_subsequence(words, part) / n
        if share >= FULL or share >= PART and common_subsequence(answer, part) >= ANSWER * len(answer):
            best = max(best, share)
            if best == 1:
                break
    return best


def _search(shared, space: np.ndarray):
    def run(batches):
        bench = shared.value
        vectors = np.stack([space[w].sum(axis=0) for w in bench.items])
        vectors /= np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-9
        sizes = np.array([len(w) for w in bench.items])
        fit = np.searchsorted(WINDOWS, sizes, "right") - 1
        groups = []
        for g, length in enumerate(WINDOWS):
            mine = np.flatnonzero(np.maximum(fit, 0) == g)
            if len(mine):  # as many words as half an item needs, or the window's part of it
                least = np.maximum(1, np.floor(0.7 * PART * np.minimum(sizes[mine], length))).astype(int)
                groups.append((length, mine, vectors[mine].T.astype(np.float32), least))
        small = space.astype(np.float32)
        for b in batches:
            found: list[dict[int, float]] = [{} for _ in range(b.num_rows)]
            for rows, begins, places, numbers, total in _stretches(b, bench.kind):
                near: dict[tuple[int, int], list[list[int]]] = {}
                for begin, item, end in sorted(_candidates(np.concatenate(places), np.concatenate(numbers), total,
                                                           small, groups)):
                    r = int(np.searchsorted(begins, begin, "right")) - 1
                    spans_ = near.setdefault((r, item), [])
                    if spans_ and begin <= spans_[-1][1]:  # overlapping windows are one
                        spans_[-1][1] = end
                    else:
                        spans_.append([begin, end])
                for (r, item), spans_ in near.items():
                    shift = int(begins[r])
                    share = max(leaked(bench, item, numbers[r], places[r] - shift, x - shift, y - shift) for x, y in spans_)
                    if share:
                        found[rows[r]][item] = share
            hits = [[{"item_id": bench.ids[k], "share": s} for k, s in sorted(f.items())] for f in found]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_key"),
                 pa.array(hits, pa.list_(pa.struct([("item_id", pa.int64()), ("share", pa.float64())])))],
                ["doc_id", "text_key", "hits"])
    return run


HITS = "doc_id long, text_key long, hits array<struct<item_id:long,share:double>>"


def _one_block(rows: DataFrame, items: list[tuple[int, str]], seed: int = 5) -> DataFrame:
    """(doc_id, text_key, hits) of every row against one block of items."""
    spark = rows.sparkSession
    bench = Benchmark(items)
    if not bench.ids:
        return rows.select("doc_id", "text_key", F.array().cast("array<struct<item_id:long,share:double>>").alias("hits"))
    shared = Shared(spark, bench)
    blobs = cut(rows.mapInArrow(_index(shared), "doc_id long, text_key long, n_words long, places binary, numbers binary"))
    counted = (blobs.mapInArrow(_frequencies(shared), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
               .toArrow())  # one row a word of the block
    n = dict(zip(counted.column("word").to_pylist(), counted.column("n").to_pylist(), strict=True))
    size = len(bench.vocabulary)
    df = np.array([n.get(i, 0) for i in range(size)], float)
    idf = np.log((n.get(-1, 0) + 2) / (df + 1))
    width = min(RANK + EXTRA, size)
    omega = np.random.default_rng(seed).standard_normal((size, width))
    names = [f"z{j}" for j in range(width)]
    sample = (blobs.mapInArrow(_range_sample(shared, idf, omega), "word long, " + ", ".join(f"{c} double" for c in names))
              .groupBy("word").agg(*[F.sum(c).alias(c) for c in names]).toArrow())
    z = np.zeros((size, width))
    if sample.num_rows:
        z[sample.column("word").to_numpy()] = np.stack([sample.column(c).to_numpy() for c in names], axis=1)
    rows_ = np.zeros((len(bench.items), size))
    for j, w in enumerate(bench.items):
        np.add.at(rows_[j], w, idf[w])
    rows_ /= np.linalg.norm(rows_, axis=1, keepdims=True) + 1e-9
    z += rows_.T @ (rows_ @ omega) * (ITEM_WEIGHT ** 2 * max(1, n.get(-1, 0)) / len(rows_))
    basis, power, _ = np.linalg.svd(z, full_matrices=False)
    # Few items, or a small table, span fewer directions than RANK; the rest
    # tell no items apart, and the scale below would lift them over the others.
    rank = max(1, min(len(bench.items), int((power[:RANK] > 1e-6 * power[0]).sum())))
    # The range sample's singular values are squares of the matrix's.
    scale = np.maximum(power[:rank], 1e-300) ** -0.25
    return blobs.mapInArrow(_search(shared, basis[:, :rank] * scale * idf[:, None]), HITS)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, contaminated, item_ids (array, sorted),
    share (largest share of an item's words found; 0 if none)."""
    # Rows that share an id, or have none, are told apart by their text.
    rows = keyed_text(docs, id_col, text_col).withColumn("text_key", F.xxhash64("doc_id", "text"))
    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("item_id"),
                             F.coalesce(F.col(f"`{item_text_col}`").cast("string"), F.lit("")).alias("text"))
    out, block, size = None, [], 0

    def flush(out):
        part = _one_block(rows, sorted(block, key=lambda x: (x[0] is None, x[0] or 0, x[1])))
        if out is None:
            return part
        return out.unionByName(part)

    blocks = 0
    for r in items.distinct().toLocalIterator():
        if block and size + len(r["text"].encode()) > BLOCK_BYTES:
            out, block, size, blocks = flush(out), [], 0, blocks + 1
        block.append((r["item_id"], r["text"]))
        size += len(r["text"].encode())
    out = flush(out)
    if blocks:
        # Blocks meet per id and text; copies of a row have equal hits, kept once.
        out = (out.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_set("hits")).alias("hits"), F.count("*").alias("n"))
               .select("doc_id", "hits", F.explode(F.sequence(F.lit(1), (F.col("n") / (blocks + 1)).cast("int")))))
    ids = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item_id"])))
    return out.select("doc_id", (F.size("hits") > 0).alias("contaminated"), ids.alias("item_ids"),
                      F.coalesce(F.array_max(F.transform("hits", lambda h: h["share"])), F.lit(0.0)).alias("share"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns. Rows
    are told apart by a hash of id and text, so rows that share an id are
    judged one by one."""
    key = free(docs, "row_key")
    keyed = docs.withColumn(key, F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")))
    gone = cut(find_leaks(keyed, benchmark, key, text_col).where("contaminated").select(F.col("doc_id").alias(key)).distinct())
    return keyed.join(gone, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
