"""SimHash near-duplicates: fingerprints, exact links, components.

Fingerprint: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, shingles of
``words`` words (a shorter text: one shingle of all its words), XXH64 (seed
42) of each shingle with repeats; a bit is set if it is set in over half of
the hashes. A text without words has fingerprint 0 and links like any other.

Links: distinct fingerprints at most ``radius`` bits apart, found exactly.
Two such fingerprints agree on at least one of radius + 1 bands, so each goes
to its band buckets; a bucket's members are sorted by population count, cut
into tiles, and tile pairs are compared by exclusive-or and bit counts unless
their population counts differ by more than the radius. Buckets over
``HOT`` members are dealt out as tile pairs (tiles by population count and
hash), so no task holds one whole. A bucket sends only a spanning forest of
its links, never all pairs.

Null text is a text without words; a null id has a fingerprint and a
component but never names one while another member has an id. Repeated rows
stay rows.

An empty table gives an empty table. A very long text's shingles are hashed whole,
in the Arrow batch that holds it.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirefold.llm.common import components, cut, free, keyed_text, large

BITS = 64
TILE = 1024
#: Members of a band bucket beyond which its tile pairs go to tasks of their own.
HOT = 8192
#: Distinct band values of a bucket group (one Python call), about.
GROUP = 100_000


def fingerprint(text: bytes, words: int = 3) -> int:
    parts = text.lower().split()  # bytes: A-Z only, ASCII white space
    if not parts:
        return 0
    joined = b" ".join(parts)
    k = min(words, len(parts))
    starts = list(accumulate((len(p) + 1 for p in parts[:len(parts) - k]), initial=0))
    ends = [s - 1 for s in accumulate((len(p) + 1 for p in parts[k:]), initial=sum(map(len, parts[:k])) + k)]
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(BITS, np.int64), len(starts)
    for at in range(0, n, 1 << 16):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[at:at + (1 << 16)], ends[at:at + (1 << 16)],
                                                              strict=True)], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(i) for i in np.flatnonzero(2 * ones > n))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _prints(words: int):
    def run(batches):
        for b in batches:
            fps = [_signed(fingerprint(t.as_buffer().to_pybytes(), words)) for t in large(b.column("text"))]
            names = [c for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(fps, pa.int64())], [*names, "fp"])
    return run


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit integer."""
    return keyed_text(docs, id_col, text_col).mapInArrow(_prints(words), "doc_id long, fp long")


def tile_links(fps: np.ndarray, radius: int, tile: int = TILE) -> np.ndarray:
    """For each of the fingerprints (uint64) the index of the smallest-index
    member of its component within this set, over exact links."""
    pop = np.bitwise_count(fps)
    order = np.argsort(pop, kind="stable")
    fps, pop = fps[order], pop[order].astype(np.int64)
    label = np.arange(len(fps))
    left, right = [], []
    for a in range(0, len(fps), tile):
        x = fps[a:a + tile]
        for b in range(a, len(fps), tile):
            if pop[b] - pop[min(a + tile, len(fps)) - 1] > radius:
                break
            near = np.bitwise_count(x[:, None] ^ fps[None, b:b + tile]) <= radius
            i, j = np.nonzero(near)
            i, j = i + a, j + b
            keep = i < j
            # Links inside one tile pair shrink to a forest before they wait.
            roots = _forest(np.arange(len(fps)), i[keep], j[keep]) if keep.sum() > 4 * tile else None
            if roots is None:
                left.append(i[keep])
                right.append(j[keep])
            else:
                moved = np.flatnonzero(roots != np.arange(len(fps)))
                left.append(roots[moved])
                right.append(moved)
    if left:
        label = _forest(label, np.concatenate(left), np.concatenate(right))
    out = np.empty(len(fps), np.int64)
    # Back to the caller's order, each component named by its first member.
    first = np.full(len(fps), len(fps), np.int64)
    np.minimum.at(first, label, order)
    out[order] = first[label]
    return out


def _forest(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index of each index's component under the links (i, j)."""
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _bucket_links(radius: int):
    def run(table):
        band = table.column("band").to_numpy()
        value = table.column("value").to_numpy()
        fp = table.column("fp").to_numpy()
        order = np.lexsort((value, band))
        band, value, fp = band[order], value[order], fp[order]
        new = np.flatnonzero(np.r_[True, (band[1:] != band[:-1]) | (value[1:] != value[:-1])])
        ends = np.r_[new[1:], len(fp)]
        a, b = [], []
        for s, e in zip(new[ends - new > 1], ends[ends - new > 1], strict=True):
            members = np.unique(fp[s:e])
            root = tile_links(members.view(np.uint64), radius)
            moved = np.flatnonzero(root != np.arange(len(members)))
            a.append(members[root[moved]])
            b.append(members[moved])
        none = np.zeros(0, np.int64)
        return pa.table({"a": pa.array(np.concatenate(a) if a else none, pa.int64()),
                         "b": pa.array(np.concatenate(b) if b else none, pa.int64())})
    return run


def links(distinct: DataFrame, radius: int = 2, hot: int = HOT) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct
    fingerprints (column fp) at most ``radius`` bits apart."""
    bands = radius + 1
    edges = [round(i * BITS / bands) for i in range(bands + 1)]
    cuts = [F.struct(F.lit(i).alias("band"),
                     F.shiftrightunsigned(F.shiftleft("fp", BITS - hi), BITS - hi + lo).alias("value"))
            for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))]
    rows = distinct.select("fp", F.explode(F.array(*cuts)).alias("c")).select("c.band", "c.value", "fp")
    counts = rows.groupBy("band", "value").count()
    big = cut(counts.where(F.col("count") > hot))
    n = max(1, distinct.count() * bands // GROUP)
    # A bucket that is not hot shares a Python call with others.
    cold = (rows.join(big.select("band", "value"), ["band", "value"], "left_anti")
            .withColumn("grp", F.pmod(F.hash("band", "value"), F.lit(n)).cast("string")))
    # Tiles of a hot bucket: by population count, then by hash into enough parts.
    share = F.ceil(F.col("count") / hot).cast("int")
    pop = F.bit_count("fp")
    part = F.pmod(F.hash("fp"), "share")
    others = F.explode(F.sequence(pop - radius, pop + radius))
    tiles = (rows.join(big, ["band", "value"]).withColumn("share", share)
             .select("band", "value", "fp", "share", pop.alias("pop"), part.alias("part"), others.alias("pop2"))
             .withColumn("part2", F.explode(F.sequence(F.lit(0), F.col("share") - 1))))
    pair = F.array_join(F.array_sort(F.array(F.concat_ws(":", "pop", "part"), F.concat_ws(":", "pop2", "part2"))), "|")
    tiles = tiles.select("band", "value", "fp", F.concat_ws("/", "band", "value", pair).alias("grp"))
    return (cold.select("band", "value", "fp", "grp").union(tiles).groupBy("grp")
            .applyInArrow(_bucket_links(radius), "a long, b long"))


def _lowest(prints: DataFrame, low: Column, radius: int, hot: int) -> DataFrame:
    """(fp, low): for each fingerprint the smallest ``low`` of its component
    (an aggregate over rows of ``prints``)."""
    distinct = cut(prints.groupBy("fp").agg(low.alias("low")))
    roots = components(links(distinct.select("fp"), radius, hot))
    named = cut(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "low"))
    names = cut(named.groupBy("root").agg(F.min("low").alias("low")))
    return cut(named.select("fp", "root").join(names, "root").select("fp", "low"))


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, id_col: str = "doc_id",
                    text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits),
    component_id (smallest doc_id reachable over links)."""
    prints = cut(fingerprints(docs, words, id_col, text_col))
    by_fp = _lowest(prints, F.min("doc_id"), radius, hot)
    return prints.join(by_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("low").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, id_col: str = "doc_id",
                         text_col: str = "text", hot: int = HOT) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each
    component the document with the smallest id (null last; of one id's
    texts the one with the smallest hash). Rows that repeat an id and a text
    are one document and stay or go together."""
    key = free(docs, "text_key")
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))))
    rows = keyed.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(key).alias("text_key"),
                        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    prints = cut(rows.mapInArrow(_prints(words), "doc_id long, text_key long, fp long"))
    member = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    by_fp = _lowest(prints, F.min(member), radius, hot)
    lost, lost_key = free(keyed, "lost"), free(keyed, "lost_key")
    gone = cut(prints.join(by_fp, "fp").where(~member.eqNullSafe(F.col("low")))
               .select(F.col("doc_id").alias(lost), F.col("text_key").alias(lost_key)).distinct())
    return keyed.join(gone, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(lost)) & (F.col(key) == F.col(lost_key)),
                      "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
