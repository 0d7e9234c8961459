"""Delta tables of mergeable facts: every batch lands its own facts, readers
merge what they find, and deltas are merged in tiers.

A table is a folder of deltas ``delta=<source>-<from>-<to>``: the merged facts
of the batches ``from`` to ``to`` of one source (a stream's checkpoint).
``FANIN`` neighbouring deltas of one span become one of the next span, so a
fact is rewritten once per tier, however many batches there are. Merging is
idempotent, so nothing here needs a transaction: a batch that is replayed
lands the same delta again, and a merged delta next to the deltas it was made
of says the same as either. A merged delta supersedes them; they stay until
the next merge, for readers that hold them, and are deleted then.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hirefold.sources.stores import _fs

FANIN = 8
_NAME = re.compile(r"delta=([0-9a-f]+)-(\d+)-(\d+)")


def source_name(checkpoint: str) -> str:
    """The source that a stream's batches count under."""
    return hashlib.md5(checkpoint.encode()).hexdigest()[:12]


def _deltas(spark: SparkSession, base: str) -> list[tuple[str, int, int]]:
    """Complete deltas: (source, from, to). One entry a folder, metadata only."""
    fs, path, make = _fs(spark, base)
    if not fs.exists(path):
        return []
    found = []
    for st in fs.listStatus(path):
        named = _NAME.fullmatch(st.getPath().getName())
        if named and fs.exists(make(st.getPath(), "_SUCCESS")):
            found.append((named[1], int(named[2]), int(named[3])))
    return sorted(found)


def _split(found: list[tuple[str, int, int]]) -> tuple[list, list]:
    """Deltas that count and those that a wider one supersedes."""
    covered = [d for d in found if any(o != d and o[0] == d[0] and o[1] <= d[1] and d[2] <= o[2] for o in found)]
    return [d for d in found if d not in covered], covered


def _path(base: str, delta: tuple[str, int, int]) -> str:
    return os.path.join(base, "delta={}-{}-{}".format(*delta))


def land(facts: DataFrame, base: str, source: str, batch: int) -> None:
    """Land one batch's facts (again, if it is replayed)."""
    if any(s == source and a <= batch <= b and a < b for s, a, b in _deltas(facts.sparkSession, base)):
        return  # replayed after its delta was merged
    facts.write.mode("overwrite").parquet(_path(base, (source, batch, batch)))


def compact(spark: SparkSession, base: str, merge: Callable[[DataFrame], DataFrame], fanin: int = FANIN) -> None:
    """Merge every ``fanin`` neighbouring deltas of one span, tier by tier."""
    counted, covered = _split(_deltas(spark, base))
    tier = 1
    while True:
        spans: dict[tuple[str, int], list] = {}
        for d in counted:
            if d[2] - d[1] + 1 == tier:
                spans.setdefault((d[0], d[1] // (tier * fanin)), []).append(d)
        full = [ds for ds in spans.values() if len(ds) == fanin]
        if full and covered:  # superseded by an earlier merge: no reader's list is that old
            fs, _, make = _fs(spark, base)
            for d in covered:
                fs.delete(make(_path(base, d)), True)
            covered = []
        for ds in full:
            whole = (ds[0][0], min(d[1] for d in ds), max(d[2] for d in ds))
            merge(spark.read.parquet(*[_path(base, d) for d in ds])).write.mode("overwrite").parquet(_path(base, whole))
            counted = [d for d in counted if d not in ds] + [whole]
        tier *= fanin
        if all(d[2] - d[1] + 1 < tier for d in counted):
            return


def read(spark: SparkSession, base: str, merge: Callable[[DataFrame], DataFrame], schema: str) -> DataFrame:
    """The merged facts of all deltas (an empty table where there are none)."""
    counted, _ = _split(_deltas(spark, base))
    if not counted:
        return spark.createDataFrame([], schema)
    return merge(spark.read.schema(schema).parquet(*[_path(base, d) for d in counted]))
