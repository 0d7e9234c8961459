"""Exact duplicates by composable polynomial fingerprints.

A text is lower-cased (A-Z only) and read as UTF-8 bytes. Each chunk of
``CHUNK`` bytes hashes on its own (a dot product with powers of a base, for
two primes near 2**31); chunk hashes combine by length-shifted arithmetic,
H(ab) = H(a) * base**len(b) + H(b).
A text of more than ``SEGMENT`` bytes is cut into segments that are hashed in
any number of tasks; each hash is shifted by the bytes that follow it in the
text, H * base**after, so that the segments of a text add up in any order.
Equal (fingerprint, length) texts are then compared chunk by chunk: chunks of
a group stream through min/max aggregates that combine map-side, so a group
of any size costs one chunk per task and position. Groups that are not
uniform (a fingerprint collision) are split by their whole texts.

Null text counts as empty; null ids are allowed (a null id stays only in a
group without other ids). Of equal texts the row with the largest id stays;
of repeated rows of that id exactly one.

An empty table gives an empty table. Of a very long text only the digest
(SHA-256 has no parallel form) and the cutting are one task's.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirefold.llm.common import cut, free, keyed_text, large

PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1664525)
CHUNK = 1 << 14
#: Longer texts are hashed and compared in segments of this many bytes.
SEGMENT = 16 * CHUNK
#: Segments handed on at once.
_AT_ONCE = 16


class Hasher:
    """Polynomial hashes of byte strings modulo two primes (below 2**31)."""

    def __init__(self, primes: tuple[int, int] = PRIMES, bases: tuple[int, int] = BASES):
        self.primes, self.bases = primes, bases
        self.powers = []
        for r, p in zip(bases, primes, strict=True):
            w, x = np.empty(CHUNK, np.uint64), 1
            for i in range(CHUNK - 1, -1, -1):
                w[i], x = x, x * r % p
            self.powers.append(w)

    def chunk(self, data: bytes) -> tuple[int, int, int]:
        """(length, hash by the first prime, hash by the second) of one chunk."""
        raw = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
        n = len(raw)
        return (n, *(int(np.dot(raw, w[CHUNK - n:])) % p for w, p in zip(self.powers, self.primes, strict=True)))

    def combine(self, a: tuple[int, int, int], b: tuple[int, int, int]) -> tuple[int, int, int]:
        """Hash of the concatenation; associative, so chunks combine in any grouping."""
        return (a[0] + b[0], *((x * pow(r, b[0], p) + y) % p
                               for x, y, r, p in zip(a[1:], b[1:], self.bases, self.primes, strict=True)))

    def whole(self, data: bytes) -> tuple[int, int, int]:
        """(length, hashes): chunk hashes combined."""
        out = (0, 0, 0)
        for at in range(0, len(data), CHUNK):
            out = self.combine(out, self.chunk(data[at:at + CHUNK]))
        return out

    def text(self, data: bytes) -> tuple[int, int]:
        """(fingerprint, length)."""
        n, one, two = self.whole(data)
        return (one << 31) | two, n

    def shifted(self, data: bytes, after: int) -> tuple[int, int, int]:
        """(length, hashes shifted by the bytes after it): what a segment adds
        to its text's hashes, modulo the primes."""
        n, *hashes = self.whole(data)
        return (n, *(x * pow(r, after, p) % p for x, r, p in zip(hashes, self.bases, self.primes, strict=True)))


def _prints(hasher: Hasher):
    def run(batches):
        for b in batches:
            rows = []
            for t in large(b.column("text")):
                data = t.as_buffer().to_pybytes().lower()  # bytes.lower(): A-Z only
                rows.append((*hasher.text(data), hashlib.sha256(data).hexdigest()))
            fp, n, sha = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(fp, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string())],
                ["doc_id", "fp", "n_bytes", "text_sha256"])
    return run


def _segments(batches):
    """The segments of long texts, a few at a time, with the bytes after each."""
    def some(doc, sha, data, first):
        last = min(first + _AT_ONCE * SEGMENT, len(data))
        cuts = [(at, data[at:at + SEGMENT]) for at in range(first, last, SEGMENT)]
        return pa.RecordBatch.from_arrays(
            [pa.array([doc] * len(cuts), pa.int64()), pa.array([sha] * len(cuts), pa.string()),
             pa.array([at // SEGMENT for at, _ in cuts], pa.int32()),
             pa.array([len(data) - at - len(x) for at, x in cuts], pa.int64()),
             pa.array([x for _, x in cuts], pa.binary())], ["doc_id", "text_sha256", "part", "after", "segment"])

    for b in batches:
        for doc, t in zip(b.column("doc_id").to_pylist(), large(b.column("text")), strict=True):
            data = t.as_buffer().to_pybytes().lower()
            sha = hashlib.sha256(data).hexdigest()
            for first in range(0, len(data), _AT_ONCE * SEGMENT):
                yield some(doc, sha, data, first)


def _shifted(hasher: Hasher):
    def run(batches):
        for b in batches:
            found = [hasher.shifted(x, after) for x, after in
                     zip(b.column("segment").to_pylist(), b.column("after").to_pylist(), strict=True)]
            n, one, two = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_sha256"), b.column("part"),
                 *[pa.array(x, pa.int64()) for x in (n, one, two)]], ["doc_id", "text_sha256", "part", "n", "one", "two"])
    return run


def _chunks(hasher: Hasher):
    def run(batches):
        for b in batches:
            ids, fps, sizes, parts, chunks = [], [], [], [], []
            for i, t in zip(b.column("doc_id").to_pylist(), large(b.column("text")), strict=True):
                data = t.as_buffer().to_pybytes().lower()
                fp, n = hasher.text(data)
                for k, at in enumerate(range(0, n, CHUNK)):
                    ids.append(i)
                    fps.append(fp)
                    sizes.append(n)
                    parts.append(k)
                    chunks.append(data[at:at + CHUNK])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(fps, pa.int64()), pa.array(sizes, pa.int64()),
                 pa.array(parts, pa.int32()), pa.array(chunks, pa.binary())],
                ["doc_id", "fp", "n_bytes", "part", "chunk"])
    return run


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     hasher: Hasher | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, copy_no (1..n
    among repeated rows of one id and text), n_bytes, text_sha256."""
    hasher = hasher or Hasher()
    rows = keyed_text(docs, id_col, text_col)
    plain, long = rows.where(F.octet_length("text") <= SEGMENT), rows.where(F.octet_length("text") > SEGMENT)
    prints = plain.mapInArrow(_prints(hasher), "doc_id long, fp long, n_bytes long, text_sha256 string")
    segments = long.mapInArrow(_segments, "doc_id long, text_sha256 string, part int, after long, segment binary")
    # Repeated rows of one id and text meet here, combined map-side.
    ids = cut(prints.groupBy("doc_id", "fp", "n_bytes", "text_sha256").agg(F.count("*").alias("copies"))
              .unionByName(_long_prints(segments, hasher)))
    key = ["fp", "n_bytes"]
    shared = cut(_groups(ids, key).where("group_size > 1").select(*key))
    odd = cut(_not_uniform(plain, segments, ids, shared, hasher))
    # Texts of a fingerprint collision differ in a chunk: such groups are
    # told apart by the digest of the whole text.
    # (Cut, so that the groups below aggregate map-side first.)
    ids = cut(ids.join(odd.withColumn("odd", F.lit(True)), key, "left").select(
        "doc_id", *key, "text_sha256", "copies",
        F.when(F.col("odd"), F.col("text_sha256")).otherwise("").alias("variant")))
    groups = cut(_groups(ids, [*key, "variant"]).where("group_size > 1"))
    out = ids.join(groups, [*key, "variant"], "left").select(
        "doc_id", F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("group_size", "copies").alias("group_size"),
        F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy_no"), "n_bytes", "text_sha256")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy_no") == 1)
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "copy_no", "n_bytes", "text_sha256")


def _groups(ids: DataFrame, key: list[str]) -> DataFrame:
    return ids.groupBy(*key).agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))


def _long_prints(segments: DataFrame, hasher: Hasher) -> DataFrame:
    """Fingerprints of the long texts: segments hashed apart, then added up."""
    n = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    apart = segments.repartition(n, "doc_id", "text_sha256", "part").mapInArrow(
        _shifted(hasher), "doc_id long, text_sha256 string, part int, n long, one long, two long")
    # A repeated row repeats its segments: one of each counts.
    once = apart.groupBy("doc_id", "text_sha256", "part").agg(
        *[F.max(c).alias(c) for c in ("n", "one", "two")], F.count("*").alias("copies"))
    whole = once.groupBy("doc_id", "text_sha256").agg(
        F.sum("n").alias("n_bytes"), *[(F.sum(c) % p).alias(c) for c, p in zip(("one", "two"), hasher.primes, strict=True)],
        F.max("copies").alias("copies"))
    fp = F.shiftleft("one", 31).bitwiseOR(F.col("two"))
    return whole.select("doc_id", fp.alias("fp"), "n_bytes", "text_sha256", "copies")


def _not_uniform(plain: DataFrame, segments: DataFrame, ids: DataFrame, shared: DataFrame, hasher: Hasher) -> DataFrame:
    """Fingerprint groups of which some chunk (of long texts: some segment)
    differs between members.

    They stream through min/max: first per share of a group, then per group,
    so that no task gathers a hot group. There are as many shares as
    partitions, and rows of one id are dealt out by where they were read."""
    n = int(plain.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["fp", "n_bytes"]
    chunks = plain.mapInArrow(_chunks(hasher), "doc_id long, fp long, n_bytes long, part int, chunk binary")
    chunks = chunks.withColumn("at", F.spark_partition_id()).join(shared, key, "left_semi")
    members = ids.where(F.col("n_bytes") > SEGMENT).join(shared, key, "left_semi").select(
        F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), *key)
    parts = segments.withColumn("at", F.spark_partition_id()).join(
        members, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_sha256") == F.col("_sha"))).select(
        "doc_id", *key, "part", F.col("segment").alias("chunk"), "at")
    same = (chunks.select("doc_id", *key, "part", "chunk", "at").unionByName(parts)
            .withColumn("share", F.pmod(F.xxhash64("doc_id", "at"), F.lit(n))).drop("at")
            .repartition(n, *key, "part", "share").groupBy(*key, "part", "share")
            .agg(F.min("chunk").alias("low"), F.max("chunk").alias("high")))
    return (same.groupBy(*key, "part").agg(F.min("low").alias("low"), F.max("high").alias("high"))
            .where("low <> high").select(*key).distinct())


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their
    names. Of rows that repeat an id and a text one stays (any, where their
    other columns differ)."""
    found = exact_duplicates(docs, id_col, text_col)
    sha, keep, digest, many = (free(docs, x) for x in ("own_sha", "keep", "digest", "many"))
    staying = cut(found.where("kept").select(F.col("doc_id").alias(keep), F.col("text_sha256").alias(digest),
                                             (F.col("group_size") > 1).alias(many)))
    # The digest tells the rows of one id with different texts apart.
    low = F.translate(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), UPPER, UPPER.lower())
    rows = docs.withColumn(sha, F.sha2(low, 256)).join(
        staying, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(keep)) & (F.col(sha) == F.col(digest)))
    repeated = rows.where(F.col(many)).dropDuplicates([id_col, sha])
    return rows.where(~F.col(many)).unionByName(repeated).select(*[F.col(f"`{c}`") for c in docs.columns])


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
