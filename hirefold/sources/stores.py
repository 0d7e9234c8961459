"""Stores: tolerant JSONL reads, last-write-wins, versioned writes, run log.

A store is a directory of versions (``<base>/version=<n>``), each written
whole and marked complete by Spark's ``_SUCCESS`` file; readers take the
newest complete version, so a job lost half-way leaves the previous state
readable and a rerun is idempotent. A version is never overwritten while it
is being read. Stores that change together do so by a ``Commit``: a manifest
names the versions that count, and old versions are deleted.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirefold import rules as R
from hirefold.session import checkpoint_dir

REGISTRY_SCHEMA = T.StructType([
    T.StructField("company_name", T.StringType()), T.StructField("domain", T.StringType()),
    T.StructField("vendor", T.StringType()), T.StructField("slug", T.StringType()),
    T.StructField("board_url", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("last_verified", T.DateType()), T.StructField("last_posting_count", T.LongType()),
    T.StructField("discovered_via", T.StringType()), T.StructField("notes", T.StringType()),
])
REGISTRY_DEFAULTS = {"company_name": "", "domain": "", "vendor": "unknown", "slug": "",
                     "board_url": "", "status": "unverified", "last_posting_count": 0,
                     "discovered_via": "", "notes": ""}
REGISTRY_ENUMS = {"vendor": R.VENDORS + ("unknown",), "status": ("live", "dead", "unverified")}
CORRUPT = "_corrupt_record"
MANIFESTS = "_manifests"


def parse_jsonl(lines: DataFrame, schema: T.StructType, defaults: dict | None = None,
                enums: dict | None = None) -> DataFrame:
    """Lines (``line_no``, ``line``) to records: blank lines, malformed JSON,
    wrongly typed fields and values outside an enum are skipped; missing
    fields take their defaults. Good lines are kept with their line_no."""
    full = T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType())])
    parsed = lines.where(F.trim(F.coalesce(F.col("line"), F.lit(""))) != "").select(
        "line_no", F.trim("line").alias("line"),
        F.from_json(F.trim("line"), full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r"))
    ok = F.col("r").isNotNull() & F.col(f"r.{CORRUPT}").isNull() & F.col("line").startswith("{")
    for name, allowed in (enums or {}).items():
        value = F.coalesce(F.col(f"r.{name}"), F.lit((defaults or {}).get(name)))
        ok = ok & value.isin(*allowed)
    cols = [F.coalesce(F.col(f"r.{f.name}"), F.lit((defaults or {}).get(f.name)).cast(f.dataType)).alias(f.name)
            if (defaults or {}).get(f.name) is not None else F.col(f"r.{f.name}").alias(f.name)
            for f in schema.fields]
    return parsed.where(ok).select("line_no", *cols)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of a text log: lines are numbered 0, 1, ... through
    its files in path order, so a later file's lines come later whatever the
    sizes and however the files are split over tasks.

    Prefix sums in two passes: a line's place in its split, the lines of the
    splits before it in its file (one row per split), and those of the files
    before (one row per file). The lines are read once and checkpointed, so
    both passes see the same splits."""
    checkpoint_dir(spark)
    lines = (spark.read.option("recursiveFileLookup", "true").text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at")).checkpoint(eager=True))
    splits = lines.groupBy("file", "start").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    files = splits.groupBy("file").agg(F.sum("n").alias("of_file"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("of_file").over(before), F.lit(0)).alias("base"))
    at = splits.join(files, "file").select("file", "start", (F.col("base") + F.col("earlier") - F.col("first")).alias("shift"))
    return lines.join(at, ["file", "start"]).select((F.col("at") + F.col("shift")).alias("line_no"), "line")


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: T.StructType,
                        defaults: dict | None = None, enums: dict | None = None) -> DataFrame:
    """A JSONL log of one or more files read tolerantly, with ``line_no`` (0,
    1, ... over the files in path order; skipped lines count)."""
    return parse_jsonl(numbered_lines(spark, path), schema, defaults, enums)


def last_write_wins(records: DataFrame, keys, order: str = "line_no") -> DataFrame:
    """One row per key, the latest line wins."""
    cols = [c for c in records.columns if c not in keys]
    g = records.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col(order)).alias("_r"))
    return g.select(*keys, "_r.*")


def _fs(spark: SparkSession, path: str):
    """(file system, path, constructor of paths) of Hadoop for ``path``."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    at = make(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at, make


def versions(spark: SparkSession, base: str) -> dict[int, bool]:
    """The version folders under ``base``: number to whether it is complete
    (Spark's ``_SUCCESS`` marker)."""
    fs, path, make = _fs(spark, base)
    if not fs.exists(path):
        return {}
    named = ((st.getPath().getName(), st.getPath()) for st in fs.listStatus(path))
    return {int(name[8:]): fs.exists(make(at, "_SUCCESS")) for name, at in named
            if name.startswith("version=") and name[8:].isdigit()}


def latest_version(spark: SparkSession, base: str) -> int | None:
    """The version of a store that counts: the one that its root's newest
    manifest names; of a store that no manifest names, the newest complete one."""
    root, name = os.path.split(base.rstrip("/"))
    last = last_manifest(spark, root)
    if last and name in last["stores"]:
        return last["stores"][name]
    return max((v for v, whole in versions(spark, base).items() if whole), default=None)


def last_manifest(spark: SparkSession, root: str) -> dict | None:
    """The newest manifest under ``root``: number, stores (name to version)."""
    found = _manifests(spark, root)
    if not found:
        return None
    fs, path, _ = _fs(spark, os.path.join(root, MANIFESTS, f"{max(found)}.json"))
    stream = fs.open(path)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return json.loads(text)


def _manifests(spark: SparkSession, root: str) -> list[int]:
    fs, path, _ = _fs(spark, os.path.join(root, MANIFESTS))
    if not root or not fs.exists(path):
        return []
    names = [st.getPath().getName() for st in fs.listStatus(path)]
    return [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]


class Commit:
    """One change of several stores under a root, seen as a whole or not at all.

    Each store's next version and the run record are written first; then a
    manifest that names them all takes effect by one rename. Readers follow
    the newest manifest, so a job killed anywhere before that rename leaves
    the old state of every store, and what it left behind is cleared by the
    next commit. The versions that the last ``keep`` manifests name stay, for
    readers that hold one; older ones are deleted. One writer at a time."""

    def __init__(self, spark: SparkSession, root: str, keep: int = 2):
        self.spark, self.root, self.keep = spark, root, max(1, keep)
        self.last = last_manifest(spark, root)
        self.number = self.last["number"] + 1 if self.last else 0
        self.stores = dict(self.last["stores"]) if self.last else {}
        for name, version in self.stores.items():
            for left in versions(spark, os.path.join(root, name)):
                if left > version:
                    self._delete(name, f"version={left}")

    def write(self, name: str, df: DataFrame, sort_keys=("id",)) -> None:
        """The next version of a store, whole."""
        self.stores[name] = write_store(df, os.path.join(self.root, name), sort_keys)

    def log(self, name: str, df: DataFrame) -> None:
        """Lines of a log; they count once the commit does (``commit_no``)."""
        out = df.withColumn("commit_no", F.lit(self.number).cast("long"))
        out.write.mode("overwrite").json(os.path.join(self.root, name, f"commit={self.number}"))

    def finish(self) -> None:
        folder = os.path.join(self.root, MANIFESTS)
        fs, final, make = _fs(self.spark, os.path.join(folder, f"{self.number}.json"))
        draft = make(os.path.join(folder, f"{self.number}.draft"))
        stream = fs.create(draft, True)
        stream.write(bytearray(json.dumps({"number": self.number, "stores": self.stores}).encode()))
        stream.close()
        if not fs.rename(draft, final):
            raise RuntimeError(f"commit {self.number} of {self.root} was taken by another writer")
        for old in _manifests(self.spark, self.root):
            if old <= self.number - self.keep:
                self._delete(MANIFESTS, f"{old}.json")
        for name, version in self.stores.items():
            older = sorted(v for v in versions(self.spark, os.path.join(self.root, name)) if v < version)
            for left in older[:len(older) - (self.keep - 1)]:
                self._delete(name, f"version={left}")

    def _delete(self, *parts: str) -> None:
        fs, path, _ = _fs(self.spark, os.path.join(self.root, *parts))
        fs.delete(path, True)


def committed_lines(spark: SparkSession, root: str, name: str, schema: T.StructType) -> DataFrame:
    """A log's records up to the last commit (those of no commit too)."""
    last = last_manifest(spark, root)
    recs = read_jsonl_tolerant(spark, os.path.join(root, name), T.StructType([*schema.fields, T.StructField("commit_no", T.LongType())]))
    if last is not None:
        recs = recs.where(F.col("commit_no").isNull() | (F.col("commit_no") <= last["number"]))
    else:
        recs = recs.where(F.col("commit_no").isNull())
    return recs.drop("commit_no")


def read_store(spark: SparkSession, base: str, schema: str | T.StructType | None = None,
               defaults: dict | None = None) -> DataFrame | None:
    """The newest version; an empty table of ``schema`` where there is none.
    Columns of ``schema`` that an older version lacks are added, with their
    value in ``defaults`` or NULL."""
    v = latest_version(spark, base)
    if v is None:
        return spark.createDataFrame([], schema) if schema is not None else None
    df = spark.read.parquet(os.path.join(base, f"version={v}"))
    if schema is None:
        return df
    wanted = spark.createDataFrame([], schema).schema
    return df.withColumns({f.name: F.lit((defaults or {}).get(f.name)).cast(f.dataType)
                           for f in wanted if f.name not in df.columns})


def write_store(df: DataFrame, base: str, sort_keys=("id",)) -> int:
    """Write the next version of a store, whole; returns its number. The
    rows are range-partitioned by key so each file holds a sorted key range
    (the reference writes its stores sorted by key)."""
    spark = df.sparkSession
    nxt = max(versions(spark, base), default=-1) + 1
    (df.repartitionByRange(*sort_keys).sortWithinPartitions(*sort_keys)
     .write.mode("errorifexists").parquet(os.path.join(base, f"version={nxt}")))
    return nxt


def run_record(routed: DataFrame, scans: DataFrame, registry: DataFrame, run_date: Column,
               duration_seconds: float = 0.0) -> DataFrame:
    """One run-log row: date, orgs_live, orgs_scanned, postings_read,
    eliminated (title, location, comp, liveness), survivors, flagged,
    suppressed, zombies, dead_orgs, duration (1 decimal, half-even)."""
    r = routed.agg(
        F.count(F.lit(1)).alias("postings_read"),
        F.count_if(F.col("route") == "title").alias("title"),
        F.count_if(F.col("route") == "location").alias("location"),
        F.count_if(F.col("route") == "comp").alias("comp"),
        F.count_if(F.col("route") == "zombie").alias("zombies"),
        F.count_if(F.col("route").isin("kept", "flagged", "still_open")).alias("survivors"),
        F.count_if(F.col("route") == "flagged").alias("flagged"),
        F.count_if(F.col("route") == "suppressed").alias("suppressed"),
    )
    scanned = scans.agg(F.count_if(F.col("outcome") == "answered")).scalar()
    dead = scans.agg(F.count_if(F.col("outcome") != "answered")).scalar()
    live = registry.agg(F.count_if((F.col("status") == "live") & (F.col("vendor") != "unknown"))).scalar()
    return r.select(
        F.date_format(run_date, "yyyy-MM-dd").alias("date"), live.alias("orgs_live"),
        scanned.alias("orgs_scanned"), "postings_read",
        F.struct("title", "location", "comp", F.col("zombies").alias("liveness")).alias("eliminated"),
        "survivors", "flagged", "suppressed", "zombies", dead.alias("dead_orgs"),
        F.bround(F.lit(float(duration_seconds)), 1).alias("duration_seconds"))


def org_scan_list(pins: DataFrame, registry: DataFrame, harvested=R.VENDORS) -> DataFrame:
    """The night's org list: pins first (config order, dead ones already
    excluded), then live registry orgs whose vendor has a reader and that
    are not pinned (key order). ``source`` says which; ``reader`` is false
    for live orgs on a vendor with no reader (counted, not scanned)."""
    p = pins.select(F.lit(0).alias("group"), F.col("ordinal").cast("bigint").alias("ordinal"), "vendor", "slug",
                    F.when(F.coalesce(F.col("company"), F.lit("")) != "", F.col("company"))
                    .otherwise(F.col("slug")).alias("company"), F.lit("pin").alias("source"),
                    F.lit(True).alias("reader"))
    live = registry.where((F.col("status") == "live") & (F.col("vendor") != "unknown"))
    live = live.join(pins.select("vendor", "slug"), ["vendor", "slug"], "left_anti")
    r = live.select(F.lit(1).alias("group"), F.lit(None).cast("bigint").alias("ordinal"), "vendor", "slug",
                    F.when(F.coalesce(F.col("company_name"), F.lit("")) != "", F.col("company_name"))
                    .otherwise(F.col("slug")).alias("company"), F.lit("registry").alias("source"),
                    F.col("vendor").isin(*harvested).alias("reader"))
    return p.unionByName(r)
