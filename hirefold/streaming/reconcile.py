"""Nightly snapshots as a stream, kept as mergeable facts (``operators.nights``)
and published as the seen store and the public store.

Closure needs the org's scan marker, not a watermark: silence proves
nothing, so a role closes only when its org answered in that run. A snapshot
row with a null id is such a marker (the org answered, with or without
postings).

A run (``run_ts``) may span many files and many micro-batches, and a date may
hold several runs. Each micro-batch lands the facts of the roles, orgs and
runs that it holds, and no other: no earlier or later run is folded again, a
late file costs what an early one does, and a replayed batch lands the same
facts. Facts are merged in tiers (``sources.deltas``). When the stream has
taken all files, both stores are read off the merged facts and published by
one commit, which deletes the versions before the last.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirefold.operators import nights, state
from hirefold.session import checkpoint_dir
from hirefold.sources import deltas, stores

SNAPSHOT_SCHEMA = ("run_ts timestamp, id string, org_key string, vendor string, title string, "
                   "company_name string, url string")
SEEN_SCHEMA = ("id string, org_key string, title string, company_name string, url string, "
               "first_seen timestamp, last_seen timestamp, closed_at timestamp, public boolean, "
               "comp_band string, location string")


def write_nightly_snapshots(sightings: DataFrame, folder: str) -> None:
    """Lay the sightings out as nightly fetches leave them: files under
    ``night=<yyyymmdd>``, as many a night as the writing tasks."""
    out = sightings.withColumn("night", F.date_format("run_ts", "yyyyMMdd"))
    out.write.mode("overwrite").partitionBy("night").parquet(folder)


PUBLIC_SCHEMA = ("id string, vendor string, org_key string, company string, title string, "
                 "comp_band string, location string, remote boolean, url string, posted_at timestamp, "
                 "first_seen timestamp, last_seen timestamp, last_verified timestamp, closed_at timestamp, "
                 "collapsed_into string")


_ROW = "struct<vendor: string, org_key: string, company_name: string, title: string, url: string>"
_AT = "run: bigint, line: bigint"
ROLE_FACTS = (f"id string, nights array<bigint>, first struct<{_AT}, row: {_ROW}>, last struct<{_AT}, row: {_ROW}>, "
              f"title struct<{_AT}, value: string>, url struct<{_AT}, value: string>")
#: Fact tables: how they merge and their schemas.
FACTS = {"roles": (nights.merge_roles, ROLE_FACTS),
         "orgs": (nights.merge_orgs, "org_key string, nights array<bigint>"),
         "runs": (nights.merge_runs, "run bigint")}


def facts(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The merged facts that the batches have landed under ``base``."""
    merge, schema = FACTS[name]
    return deltas.read(spark, os.path.join(base, name), merge, schema)


def _land(base: str, source: str, fanin: int):
    def land(batch: DataFrame, batch_id: int) -> None:
        made = {"roles": nights.role_facts(batch), "orgs": nights.org_facts(batch), "runs": nights.run_facts(batch)}
        for name, rows in made.items():
            folder = os.path.join(base, name)
            deltas.land(rows, folder, source, batch_id)
            deltas.compact(batch.sparkSession, folder, FACTS[name][0], fanin)
    return land


def seen_rows(spark: SparkSession, base: str) -> DataFrame:
    """The seen store after every landed night. Marks of publication aren't
    facts of the nights; they start unset."""
    s = nights.seen_store(facts(spark, base, "roles"), facts(spark, base, "orgs"))
    return s.select("id", "org_key", "title", "company_name", "url", "first_seen", "last_seen", "closed_at",
                    F.lit(False).alias("public"), F.lit("").alias("comp_band"), F.lit("").alias("location"))


def public_rows(spark: SparkSession, base: str, published: DataFrame) -> DataFrame:
    """The public store after every landed night, mirrors collapsed: employer
    data only. Mirrors are those of the open rows; a closed row keeps the
    keeper it has in ``published``, the store published before (a row that
    closed before it was ever published has none)."""
    p = nights.public_store(*(facts(spark, base, name) for name in ("roles", "orgs", "runs")))
    kept = published.select(F.col("id").alias("_id"), "collapsed_into")
    rows = p.join(kept, F.col("id") == F.col("_id"), "left").select(
        "id", "vendor", "org_key", F.col("company_name").alias("company"), "title",
        F.lit("").alias("comp_band"), F.lit("").alias("location"), F.lit(False).alias("remote"),
        "url", F.lit(None).cast("timestamp").alias("posted_at"),
        "first_seen", "last_seen", "last_verified", "closed_at", "collapsed_into")
    checkpoint_dir(spark)  # the mirrors' join reads the rows twice
    return state.mirror_collapse(rows.checkpoint()).select(*state.PUBLIC_COLUMNS)


def stream_reconcile(spark: SparkSession, snapshot_folder: str, store_base: str,
                     checkpoint: str, public_base: str | None = None,
                     max_files_per_trigger: int | None = None, fanin: int = deltas.FANIN) -> DataFrame:
    """Run the stream over every available file, publish the stores, return
    the seen store (the public store is under ``public_base`` when given, in
    the same folder as ``store_base``). The result doesn't depend on how files
    meet micro-batches or on the order of the nights."""
    root, name = os.path.split(store_base.rstrip("/"))
    if public_base is not None and os.path.dirname(public_base.rstrip("/")) != root:
        raise ValueError("both stores are published by one commit: put them in one folder")
    reader = spark.readStream.schema(SNAPSHOT_SCHEMA).option("recursiveFileLookup", "true")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    df = reader.parquet(snapshot_folder)
    base = f"{store_base.rstrip('/')}-facts"
    q = (df.writeStream.foreachBatch(_land(base, deltas.source_name(checkpoint), fanin))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    commit = stores.Commit(spark, root)
    commit.write(name, seen_rows(spark, base))
    if public_base is not None:
        published = stores.read_store(spark, public_base, PUBLIC_SCHEMA)
        commit.write(os.path.basename(public_base.rstrip("/")), public_rows(spark, base, published))
    commit.finish()
    return stores.read_store(spark, store_base, SEEN_SCHEMA)
