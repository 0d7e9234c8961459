"""The three end-to-end jobs, composed from the operators.

* ``nightly_run``: raw payloads of one night to the next seen and public
  store versions, the routed postings, warnings, closed lines and the run
  record (E1).
* ``add_domains`` / ``verify_registry``: registry upkeep from crawled pages
  and vendor probes (E2).
* ``weekly_report``, ``board_report``, ``pages_report``: report tables from
  the stores and the run log (E3).

Stores live under one root folder as versioned parquet (``seen``,
``public``, ``registry``); the run log is a JSON folder per commit. Every job
reads the newest version that counts and writes the next one at its end, so a
job lost before that changes nothing. The nightly run's two stores and its run
record take effect together, by one ``stores.Commit``.
"""

from __future__ import annotations

import os
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hirefold.operators import funnel, history, registry as REG, reports, state
from hirefold.rules import DEFAULT_RULES, Rules
from hirefold.session import checkpoint_dir
from hirefold.sources import stores, vendors

SEEN_SCHEMA = ("id string, org_key string, title string, company_name string, url string, "
               "first_seen timestamp, last_seen timestamp, closed_at timestamp, public boolean, "
               "comp_band string, location string")
SEEN_DEFAULTS = {"public": False}
REGISTRY_SCHEMA = ("company_name string, domain string, vendor string, slug string, board_url string, "
                   "status string, last_verified date, last_posting_count bigint, discovered_via string, "
                   "notes string")
RUN_LOG_SCHEMA = ("date string, orgs_live bigint, orgs_scanned bigint, postings_read bigint, "
                  "eliminated struct<title:bigint,location:bigint,comp:bigint,liveness:bigint>, "
                  "survivors bigint, flagged bigint, suppressed bigint, zombies bigint, dead_orgs bigint, "
                  "duration_seconds double")


def _path(root: str, name: str) -> str:
    return os.path.join(root, name)


def nightly_run(spark: SparkSession, raw: DataFrame, history_rules: DataFrame, url_probes: DataFrame,
                registry: DataFrame, root: str, now: Column, rules: Rules = DEFAULT_RULES,
                include_open: bool = False, do_verify: bool = True) -> dict[str, DataFrame]:
    """One night. Returns ``routed`` (every posting with its stage / route),
    ``warnings``, ``closed`` (lines, empty on the first run) and ``run``
    (the run record, also appended to the run log)."""
    checkpoint_dir(spark)
    began = time.monotonic()
    # Read by every vendor's listing, the scanned orgs, the warnings and the record.
    outcomes = vendors.board_outcomes(raw).checkpoint(eager=True)
    scans = outcomes.drop("last")
    # Five consumers read the normalised postings (two stores, the funnel,
    # liveness, the run record): cut the lineage once, in the shared folder.
    postings = vendors.all_postings(raw, rules, outcomes).checkpoint(eager=True)
    scanned = scans.where(F.col("outcome") == "answered").select(
        F.concat_ws(":", "vendor", "slug").alias("org_key"))

    first_run = stores.latest_version(spark, _path(root, "seen")) is None
    seen_prev = stores.read_store(spark, _path(root, "seen"), SEEN_SCHEMA, SEEN_DEFAULTS)
    sightings = postings.select("id", F.concat_ws(":", "source", "org_slug").alias("org_key"),
                                "title", "company_name", "url", "line_no")
    # Read by the "is new" join, the closed lines and the store write.
    seen_next = state.seen_reconcile(seen_prev, sightings, scanned, now).checkpoint(eager=True)

    # The public store is fed before any private filter: title family only.
    public_prev = stores.read_store(spark, _path(root, "public"), _public_schema())
    folded = state.public_reconcile(public_prev, state.public_rows_from_postings(postings, rules), scanned, now,
                                    collapse=False).checkpoint(eager=True)
    public_next = state.mirror_collapse(folded)

    verdicts = history.apply_history(funnel.evaluate(postings, rules), history_rules)
    alive = F.col("stage").isNull() & F.col("suppressed_by").isNull()
    if do_verify:
        verdicts = funnel.liveness(verdicts, url_probes, only=alive)
    else:
        verdicts = verdicts.withColumn("live", F.when(alive, F.lit(True))).withColumn("live_method", F.lit(None))
    is_new = seen_next.select("id", "is_new")
    routed = funnel.route(verdicts.join(is_new, "id", "left")
                          .withColumn("is_new", F.coalesce("is_new", F.lit(True))), include_open)
    routed = routed.checkpoint(eager=True)

    kept = routed.where(F.col("route") == "kept").select(
        "id", "flags", _band(F.col("comp")).alias("band"),
        reports.location_label(F.col("location_raw"), F.col("is_remote")).alias("location_label"))
    seen_final = state.mark_public(seen_next, kept)
    closed = seen_final.where(F.col("closed_now") & F.lit(not first_run)).select(
        F.concat(F.col("company_name"), F.lit(": "), F.col("title"), F.lit(" ("), F.col("url"), F.lit(")"))
        .alias("line"))
    closed = closed.checkpoint(eager=True)
    commit = stores.Commit(spark, root)
    commit.write("public", public_next.select(*state.PUBLIC_COLUMNS))
    commit.write("seen", seen_final.drop("is_new", "closed_now"))
    run = stores.run_record(routed, scans, registry, F.to_date(now),
                            time.monotonic() - began).withColumn(
        "written_at", F.current_timestamp()).cache()
    commit.log("runs", run)
    commit.finish()
    warnings = scans.where(F.col("outcome") != "answered").select("vendor", "slug", "reason")
    return {"routed": routed, "warnings": warnings, "closed": closed, "run": run}


def _band(comp: Column) -> Column:
    from hirefold.functions.comp import band_text
    return band_text(comp)


def _public_schema() -> str:
    return ("id string, vendor string, org_key string, company string, title string, comp_band string, "
            "location string, remote boolean, url string, posted_at timestamp, first_seen timestamp, "
            "last_seen timestamp, last_verified timestamp, closed_at timestamp, collapsed_into string")


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """The run log, bad lines skipped. A later record of the same date wins:
    records carry the time they were written, which orders them across the
    log's part files (``line_no``)."""
    schema = spark.createDataFrame([], RUN_LOG_SCHEMA + ", written_at timestamp").schema
    runs = stores.committed_lines(spark, root, "runs", schema)
    return (runs.withColumn("line_no", F.unix_micros("written_at"))
            .withColumn("date", F.to_date("date"))
            .withColumn("liveness", F.col("eliminated.liveness")))


# --- registry upkeep ----------------------------------------------------------

def add_domains(spark: SparkSession, lines: DataFrame, crawl: DataFrame, root: str,
                discovered_via: str) -> DataFrame:
    """Scan the unclaimed domains of a list (from their crawled pages) and
    fold what is found, plus no-match markers, into the next registry
    version. Returns the counts (scanned, skipped, orgs_found, no_match)."""
    reg = stores.read_store(spark, _path(root, "registry"), REGISTRY_SCHEMA)
    added = REG.registry_add(reg, lines, crawl, discovered_via)
    stores.write_store(added.registry, _path(root, "registry"), sort_keys=("vendor", "slug"))
    return added.counts


def verify_registry(spark: SparkSession, probes: DataFrame, root: str, vendor: str | None = None,
                    limit: int | None = None) -> DataFrame:
    """Apply vendor probes to the stalest rows (all when ``limit`` is None)
    and write the next registry version. Returns the probe counts."""
    reg = stores.read_store(spark, _path(root, "registry"), REGISTRY_SCHEMA)
    chosen = REG.stalest_first(reg, limit, vendor) if limit is not None else (
        reg.where((F.col("vendor") != "unknown") & ((F.col("vendor") == vendor) if vendor else F.lit(True))))
    keys = chosen.select("vendor", "slug")
    p = probes.join(keys, ["vendor", "slug"], "left_semi")
    counts = REG.registry_probe_counts(reg, p).cache()
    counts.count()
    nxt = REG.registry_apply_probes(reg, p).checkpoint(eager=True)
    stores.write_store(nxt, _path(root, "registry"), sort_keys=("vendor", "slug"))
    return counts


# --- reports --------------------------------------------------------------------

def weekly_report(spark: SparkSession, root: str, week_end: Column) -> dict[str, DataFrame]:
    seen = stores.read_store(spark, _path(root, "seen"), SEEN_SCHEMA, SEEN_DEFAULTS)
    runs = read_runs(spark, root)
    return {"stats": reports.weekly_report_stats(runs, week_end),
            "new_roles": reports.weekly_new_roles(seen, week_end),
            "closed_roles": reports.weekly_closed_roles(seen, week_end)}


def board_report(spark: SparkSession, root: str, now: Column) -> dict[str, DataFrame]:
    public = stores.read_store(spark, _path(root, "public"), _public_schema())
    runs = read_runs(spark, root)
    return {"open": reports.board_open(public, now), "closed": reports.board_closed(public, now),
            "stats": reports.board_stats(public, runs, now)}


def pages_report(spark: SparkSession, root: str, run_day: Column) -> dict[str, DataFrame]:
    public = stores.read_store(spark, _path(root, "public"), _public_schema())
    reg = stores.read_store(spark, _path(root, "registry"), REGISTRY_SCHEMA)
    pages = reports.company_pages(REG.live_orgs(reg), public, run_day).cache()
    roles = reports.company_page_roles(pages, public)
    return {"pages": pages, "roles": roles, "totals": reports.pages_totals(pages),
            "jsonld": reports.jsonld_rows(roles), "sitemap": reports.sitemap_rows(pages, run_day)}


__all__ = ["nightly_run", "add_domains", "verify_registry", "weekly_report", "board_report",
           "pages_report", "read_runs"]
