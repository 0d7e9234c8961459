"""Query catalogue: one function (spark, sf_dir) -> DataFrame per operator.

Each reads the driver tables through ``sources.fixtures`` and runs one
library operator over the whole table. Results are projected to plain
columns (strings, integers, booleans; dates as ISO text) so they compare
one to one with the DuckDB oracles.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirefold.functions.comp import band_text, comp_top, parse_salary_prose
from hirefold.functions.text import normalize_title
from hirefold.operators import funnel
from hirefold.sources import fixtures as FX


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of an intermediate that a query reads more than once
    (self-joins, a count beside a top-k): a reliable checkpoint in the
    session's shared ``spark.checkpoint.dir``."""
    from hirefold.session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def q_funnel_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = funnel.evaluate(FX.postings(spark, sf_dir))
    return v.select("id", "decision", F.col("stage").alias("drop_stage"),
                    F.array_join("reasons", " | ").alias("reasons"),
                    F.array_join("flags", ",").alias("flags"))


def q_title_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = FX.postings(spark, sf_dir)
    return p.select("id", normalize_title(F.col("title")).alias("title_key"),
                    funnel.title_family(F.col("title")).alias("family"))


def q_location_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirefold.functions.text import location_segments
    p = FX.postings(spark, sf_dir)
    return p.select("id", funnel.location_status(F.col("location_raw"), F.col("is_remote"))
                    .alias("location_status"),
                    F.size(location_segments(F.col("location_raw"))).cast("bigint").alias("n_segments"))


def q_parse_salary_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = FX.postings(spark, sf_dir)
    s = parse_salary_prose(F.col("description_text"))
    return p.select("id", s["min"].alias("pay_min"), s["max"].alias("pay_max"),
                    s["currency"].alias("currency"),
                    F.array_join(s["flags"], ",").alias("pay_flags"))


def q_comp_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = FX.postings(spark, sf_dir)
    return p.select("id", funnel.comp_outcome(F.col("comp")).alias("comp_outcome"), band_text(F.col("comp")).alias("band"))


def q_shape_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = FX.postings(spark, sf_dir)
    hits = funnel.shape_hits(F.col("title"), F.col("description_text"))
    return p.select("id", F.array_join(F.transform(
        hits, lambda h: F.concat(h["pack"], F.lit("="), h["quote"])), " | ").alias("shape_hits"))


QUERIES = {
    "funnel_verdict": q_funnel_verdict,
    "title_family": q_title_family,
    "location_status": q_location_status,
    "parse_salary_prose": q_parse_salary_prose,
    "comp_floor": q_comp_floor,
    "shape_hits": q_shape_hits,
}


# --- sighting state ---------------------------------------------------------

def _ts(c: str):
    return F.date_format(F.col(c), "yyyy-MM-dd HH:mm:ss").alias(c)


def _last_night(spark: SparkSession, sf_dir: str):
    return FX.run_nights(spark, sf_dir).agg(F.max("run_ts")).scalar()


def q_sighting_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirefold.operators import state
    h = state.sighting_history(FX.sightings(spark, sf_dir), FX.board_fetches(spark, sf_dir))
    return h.select("id", "org_key", "company_name", "title", "url", _ts("first_seen"),
                    _ts("last_seen"), _ts("closed_at"), "n_closures", "n_reopened")


def q_closure_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirefold.operators import state
    e = state.closure_events(FX.sightings(spark, sf_dir), FX.board_fetches(spark, sf_dir))
    return e.select("id", _ts("night"), "event")


def _public_history(spark: SparkSession, sf_dir: str, before=None) -> DataFrame:
    from hirefold.operators import state
    s = FX.sightings(spark, sf_dir)
    n = FX.run_nights(spark, sf_dir)
    if before is not None:
        s, n = s.where(F.col("run_ts") < before), n.where(F.col("run_ts") < before)
    a = s.select("org_key", "run_ts").distinct()
    return state.public_history(s, a, n)


def q_public_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _public_history(spark, sf_dir)
    return p.select("id", _ts("first_seen"), _ts("last_seen"), _ts("closed_at"))


def _as_public(df: DataFrame) -> DataFrame:
    """Public-store columns for sighting rows (no band, no posted date)."""
    return df.select(
        "id", "vendor", "org_key", F.col("company_name").alias("company"), "title",
        F.lit("").alias("comp_band"), F.lit("").alias("location"), F.lit(False).alias("remote"),
        "url", F.lit(None).cast("timestamp").alias("posted_at"),
        *[c for c in ("first_seen", "last_seen", "last_verified", "closed_at") if c in df.columns],
        *([F.lit(None).cast("string").alias("collapsed_into")] if "first_seen" in df.columns else []))


def q_mirror_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirefold.operators import state
    p = materialize(_as_public(_public_history(spark, sf_dir)))
    return state.mirror_collapse(p).select("id", "collapsed_into")


def _facts(spark: SparkSession, sf_dir: str):
    """Merged facts of the sightings in pieces that overlap: the nights of
    each piece come in no order, every eighth sighting in two of them."""
    from functools import reduce

    from hirefold.operators import nights
    s = FX.sightings(spark, sf_dir).withColumn("_h", F.pmod(F.xxhash64("id", "run_ts"), F.lit(8)))
    pieces = [s.where(c) for c in ("_h < 3", "_h >= 3 AND _h < 6", "_h >= 5")]
    roles = [nights.role_facts(p) for p in pieces]
    orgs = [nights.org_facts(p) for p in pieces]
    return (nights.merge_roles(reduce(DataFrame.unionByName, roles)),
            nights.merge_orgs(reduce(DataFrame.unionByName, orgs)))


def q_facts_closure_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closures and resurrections read off merged facts."""
    from hirefold.operators import nights
    return nights.closure_events(*_facts(spark, sf_dir)).select("id", _ts("night"), "event")


def q_facts_seen_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seen store read off merged facts."""
    from hirefold.operators import nights
    h = nights.seen_store(*_facts(spark, sf_dir))
    return h.select("id", "org_key", "company_name", "title", "url", _ts("first_seen"), _ts("last_seen"),
                    _ts("closed_at"))


def q_facts_public_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The public store (before mirrors) read off merged facts."""
    from hirefold.operators import nights
    h = nights.public_store(*_facts(spark, sf_dir), nights.run_facts(FX.run_nights(spark, sf_dir)))
    return h.select("id", _ts("first_seen"), _ts("last_seen"), _ts("closed_at"))


def q_seen_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirefold.operators import state
    now = _last_night(spark, sf_dir)
    s = FX.sightings(spark, sf_dir)
    before = s.where(F.col("run_ts") < now)
    store = state.sighting_history(before, before.select("org_key", "run_ts").distinct()) \
        .withColumn("public", F.lit(False)).withColumn("comp_band", F.lit("")) \
        .withColumn("location", F.lit(""))
    tonight = s.where(F.col("run_ts") == now)
    nxt = state.seen_reconcile(store, tonight, tonight.select("org_key"), now)
    return nxt.select("id", _ts("first_seen"), _ts("last_seen"), _ts("closed_at"),
                      "is_new", "closed_now")


def q_public_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirefold.operators import state
    now = _last_night(spark, sf_dir)
    store = _as_public(_public_history(spark, sf_dir, before=now))
    s = FX.sightings(spark, sf_dir)
    tonight = _as_public(s.where(F.col("run_ts") == now))
    folded = materialize(state.public_reconcile(store, tonight, tonight.select("org_key"), now,
                                                collapse=False))
    nxt = state.mirror_collapse(folded)
    return nxt.select("id", _ts("first_seen"), _ts("last_seen"), _ts("closed_at"), "collapsed_into")


def q_new_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tonight = every posting; the store = postings first published before
    1997 (earlier runs). ``is_new`` for all rows (include_open)."""
    from hirefold.operators import state
    p = FX.postings(spark, sf_dir)
    store = p.where(F.col("published_at") < F.lit("1997-01-01").cast("timestamp")).select("id")
    return state.new_postings(store, p.select("id", "org_slug"), include_open=True) \
        .select("id", "is_new")


def q_normalize_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirefold.functions.text import normalize_company
    p = FX.postings(spark, sf_dir).select("company_name").distinct()
    return p.select("company_name", normalize_company(F.col("company_name")).alias("company_key"))


QUERIES.update({
    "sighting_history": q_sighting_history,
    "closure_events": q_closure_events,
    "public_history": q_public_history,
    "facts_closure_events": q_facts_closure_events,
    "facts_seen_store": q_facts_seen_store,
    "facts_public_store": q_facts_public_store,
    "mirror_collapse": q_mirror_collapse,
    "seen_reconcile": q_seen_reconcile,
    "public_reconcile": q_public_reconcile,
    "new_postings": q_new_postings,
    "normalize_company": q_normalize_company,
})


# --- history, liveness, routing ---------------------------------------------

def _verdicts_with_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirefold.operators import history
    v = funnel.evaluate(FX.postings(spark, sf_dir))
    return history.apply_history(v, FX.history(spark))


def routed_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings through verdict, history, liveness and the new/open split.
    Only unsuppressed survivors are probed (the join reads just those)."""
    from hirefold.operators import state
    v = _verdicts_with_history(spark, sf_dir)
    alive = F.col("stage").isNull() & F.col("suppressed_by").isNull()
    both = funnel.liveness(v, FX.url_probes(spark, sf_dir), only=alive)
    p = FX.postings(spark, sf_dir)
    store = p.where(F.col("published_at") < F.lit("1997-01-01").cast("timestamp")).select("id")
    return funnel.route(state.new_postings(store, both, include_open=True))


def q_history_suppress(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirefold.operators import history
    j = history.attach_history(FX.postings(spark, sf_dir), FX.history(spark))
    return j.select("id", F.col("suppressed_by.status").alias("suppressed_status"),
                    F.col("suppressed_by.ordinal").alias("suppressed_ordinal"))


def q_history_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _verdicts_with_history(spark, sf_dir)
    note = F.filter("reasons", lambda r: r.startswith("history at this company"))
    return v.select("id", F.array_contains("flags", "history-at-company").alias("noted"),
                    F.try_element_at(note, F.lit(1)).alias("note"))


def q_liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = funnel.liveness(FX.postings(spark, sf_dir).select("id", "url"), FX.url_probes(spark, sf_dir))
    return l.select("id", "live", "live_method")


def q_board_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirefold.operators import state
    s = FX.sightings(spark, sf_dir)
    roles = state.sighting_history(s, FX.board_fetches(spark, sf_dir)).select("id")
    board = s.where(F.col("run_ts") == _last_night(spark, sf_dir))
    return funnel.board_presence(roles, board).select("id", "on_board")


def q_route_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = routed_postings(spark, sf_dir)
    return r.select("id", "route", F.array_join("flags", ",").alias("flags"))


def q_funnel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnel.funnel_counts(routed_postings(spark, sf_dir))


QUERIES.update({
    "history_suppress": q_history_suppress,
    "history_note": q_history_note,
    "liveness": q_liveness,
    "board_presence": q_board_presence,
    "route_postings": q_route_postings,
    "funnel_counts": q_funnel_counts,
})


# --- registry and discovery -------------------------------------------------

def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirefold.operators import registry as REG
    return REG.last_write_wins(FX.registry_log(spark, sf_dir)).drop("line_no")


def _refs_text(refs):
    return F.array_join(F.transform(refs, lambda r: F.concat_ws(
        " ", r["vendor"], r["slug"], r["board_url"])), " | ")


def q_board_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirefold.operators import registry as REG
    p = FX.crawl_pages(spark, sf_dir)
    hay = F.concat(F.col("final_url"), F.lit("\n"), F.col("html"))
    return p.select("page_id", _refs_text(REG.board_refs(hay)).alias("refs"))


def q_discover_orgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirefold.operators import registry as REG
    d = REG.discover_orgs(FX.crawl_pages(spark, sf_dir), "pages")
    return d.select("domain", "vendor", "slug", "board_url", "company_name", "ref_pos")


def q_no_match_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirefold.operators import registry as REG
    pages = FX.crawl_pages(spark, sf_dir)
    m = REG.no_match_markers(pages, REG.discover_orgs(pages), "pages")
    return m.select("domain", "vendor", "slug", "company_name", "notes")


def q_domains_to_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirefold.operators import registry as REG
    return REG.domains_to_scan(FX.domain_lines(spark, sf_dir), _registry(spark, sf_dir))


def _reg_out(df: DataFrame) -> DataFrame:
    return df.select("vendor", "slug", "company_name", "domain", "board_url", "status",
                     F.date_format("last_verified", "yyyy-MM-dd").alias("last_verified"),
                     F.col("last_posting_count").cast("bigint").alias("last_posting_count"),
                     "discovered_via", "notes")


def q_last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reg_out(_registry(spark, sf_dir))


def q_registry_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rediscovery of every logged line (ordinal = line number) plus the
    boards found on crawled pages, folded into the registry."""
    from hirefold.operators import registry as REG
    reg = _registry(spark, sf_dir)
    log = FX.registry_log(spark, sf_dir)
    again = log.select(
        F.concat(F.lit("Seen "), F.col("slug")).alias("company_name"),
        F.concat(F.col("slug"), F.lit(".example.net")).alias("domain"),
        "vendor", "slug",
        F.concat(F.lit("https://boards.example.net/"), F.col("slug")).alias("board_url"),
        F.lit("unverified").alias("status"), F.lit(None).cast("date").alias("last_verified"),
        F.lit(0).cast("bigint").alias("last_posting_count"),
        F.when(F.col("line_no") % 2 == 0, F.lit("rescan")).otherwise(F.lit("")).alias("discovered_via"),
        F.lit("").alias("notes"),
        F.struct(F.lit(0).alias("src"), F.lit("").alias("domain"),
                 F.col("line_no").alias("pos")).alias("ordinal"))
    found = REG.discover_orgs(FX.crawl_pages(spark, sf_dir), "pages")
    found = found.withColumn("ordinal", F.struct(F.lit(1).alias("src"), F.col("domain"),
                                                 F.col("ref_pos").cast("bigint").alias("pos"))).drop("ref_pos")
    return _reg_out(REG.registry_upsert(reg, again.unionByName(found)))


def _registry_added(spark: SparkSession, sf_dir: str):
    from hirefold.operators import registry as REG
    return REG.registry_add(_registry(spark, sf_dir), FX.domain_lines(spark, sf_dir),
                            FX.crawl_pages(spark, sf_dir), "list")


def q_registry_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan the todo domains of the list: counts scanned, skipped,
    orgs_found, no_match (one row)."""
    return _registry_added(spark, sf_dir).counts


def q_registry_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry that the scan of the list leaves."""
    return _reg_out(_registry_added(spark, sf_dir).registry)


def q_registry_apply_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirefold.operators import registry as REG
    return _reg_out(REG.registry_apply_probes(_registry(spark, sf_dir), FX.board_probes(spark, sf_dir)))


def q_registry_probe_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirefold.operators import registry as REG
    return REG.registry_probe_counts(_registry(spark, sf_dir), FX.board_probes(spark, sf_dir))


def q_registry_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirefold.operators import registry as REG
    return REG.registry_stats(_registry(spark, sf_dir))


def q_stalest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirefold.operators import registry as REG
    return _reg_out(REG.stalest_first(_registry(spark, sf_dir), 25))


def q_live_orgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirefold.operators import registry as REG
    return _reg_out(REG.live_orgs(_registry(spark, sf_dir)))


def q_slug_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirefold.operators import registry as REG
    slugs = _registry(spark, sf_dir).select("slug").distinct()
    return REG.slug_lookup(FX.board_probes(spark, sf_dir), slugs)


QUERIES.update({
    "board_refs": q_board_refs,
    "discover_orgs": q_discover_orgs,
    "no_match_markers": q_no_match_markers,
    "domains_to_scan": q_domains_to_scan,
    "last_write_wins": q_last_write_wins,
    "registry_upsert": q_registry_upsert,
    "registry_add": q_registry_add,
    "registry_added": q_registry_added,
    "registry_apply_probes": q_registry_apply_probes,
    "registry_probe_counts": q_registry_probe_counts,
    "registry_stats": q_registry_stats,
    "stalest_first": q_stalest_first,
    "live_orgs": q_live_orgs,
    "slug_lookup": q_slug_lookup,
})


# --- reports ----------------------------------------------------------------

PUBLIC_OUT = ("id", "vendor", "org_key", "company", "title", "comp_band", "location", "remote",
              "url", "posted_at", "first_seen", "last_seen", "last_verified", "closed_at",
              "collapsed_into")


def _week_end(spark: SparkSession, sf_dir: str):
    return F.to_date(_last_night(spark, sf_dir))


def seen_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seen store over all nights; roles of type 'purchase' were clean
    survivors and so carry the public fields."""
    from hirefold.operators import state
    s = FX.sightings(spark, sf_dir)
    h = state.sighting_history(s, FX.board_fetches(spark, sf_dir)).withColumn(
        "public", F.lit(False)).withColumn("comp_band", F.lit("")).withColumn("location", F.lit(""))
    kept = s.where(F.col("title") == "purchase").select("id").distinct().select(
        "id", F.array().cast("array<string>").alias("flags"), F.lit("not published").alias("band"),
        F.lit("not stated").alias("location_label"))
    return materialize(state.mark_public(h, kept))


def board_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirefold.operators import state
    public = materialize(_as_public(_public_history(spark, sf_dir)))
    return materialize(state.mirror_collapse(public).select(*PUBLIC_OUT))


def postings_public_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public store after one run over every posting (store empty before):
    fed by title-family postings, before any private filter."""
    from hirefold.operators import state
    p = FX.postings(spark, sf_dir)
    now = p.agg(F.max("published_at") + F.expr("INTERVAL 1 DAY")).scalar()
    tonight = state.public_rows_from_postings(p)
    folded = materialize(state.public_reconcile(state.empty_public_store(spark), tonight,
                                                tonight.select("org_key"), now, collapse=False))
    return state.mirror_collapse(folded).select(*PUBLIC_OUT)


def q_latest_run_per_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirefold.operators import reports
    r = reports.latest_run_per_date(FX.runs(spark, sf_dir), _week_end(spark, sf_dir))
    return r.select(F.date_format("date", "yyyy-MM-dd").alias("date"), "postings_read", "orgs_scanned",
                    "zombies", "liveness", "survivors", "line_no")


def q_weekly_report_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirefold.operators import reports
    return reports.weekly_report_stats(FX.runs(spark, sf_dir), _week_end(spark, sf_dir))


def q_weekly_new_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirefold.operators import reports
    # The week of the first night: the one in which most roles appear.
    first = FX.run_nights(spark, sf_dir).agg(F.date_add(F.to_date(F.min("run_ts")), 6)).scalar()
    return reports.weekly_new_roles(seen_store(spark, sf_dir), first)


def q_weekly_closed_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirefold.operators import reports
    return reports.weekly_closed_roles(seen_store(spark, sf_dir), _week_end(spark, sf_dir))


def q_mark_public(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seen_store(spark, sf_dir).select("id", "public", "comp_band", "location")


def q_board_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirefold.operators import reports
    return reports.board_open(board_store(spark, sf_dir), _last_night(spark, sf_dir))


def q_board_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirefold.operators import reports
    return reports.board_closed(board_store(spark, sf_dir), _last_night(spark, sf_dir))


def q_board_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirefold.operators import reports
    return reports.board_stats(board_store(spark, sf_dir), FX.runs(spark, sf_dir),
                               _last_night(spark, sf_dir))


def q_mirror_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirefold.operators import reports
    return reports.mirror_counts(postings_public_store(spark, sf_dir))


def q_public_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = postings_public_store(spark, sf_dir)
    return p.select("id", "vendor", "org_key", "company", "title", "comp_band", "location", "remote",
                    "url", F.date_format("posted_at", "yyyy-MM-dd").alias("posted_at"),
                    _ts("first_seen"), "collapsed_into")


def _pages(spark: SparkSession, sf_dir: str, public: DataFrame | None = None) -> DataFrame:
    from hirefold.operators import registry as REG
    from hirefold.operators import reports
    orgs = REG.live_orgs(_registry(spark, sf_dir))
    run_day = F.to_date(_last_night(spark, sf_dir))
    return reports.company_pages(orgs, postings_public_store(spark, sf_dir) if public is None else public, run_day)


def q_company_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).drop("org_key")


def q_company_page_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirefold.operators import reports
    public = postings_public_store(spark, sf_dir)
    r = reports.company_page_roles(_pages(spark, sf_dir, public), public)
    return r.select("dirname", "sort_title", "id", "title", "comp_band", "location_label", "posted", "url")


def q_pages_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirefold.operators import reports
    return reports.pages_totals(_pages(spark, sf_dir))


def q_jsonld_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirefold.operators import reports
    public = postings_public_store(spark, sf_dir)
    roles = reports.company_page_roles(_pages(spark, sf_dir, public), public)
    return reports.jsonld_rows(roles)


def q_sitemap_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirefold.operators import reports
    return reports.sitemap_rows(_pages(spark, sf_dir), F.to_date(_last_night(spark, sf_dir)))


def q_dirname_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirefold.operators import reports
    orgs = q_registry_upsert(spark, sf_dir).select("vendor", "slug")
    return reports.dirname_collisions(orgs).select("vendor", "slug", "dirname")


def q_digest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirefold.operators import reports
    return reports.digest_rows(routed_postings(spark, sf_dir))


def q_suppressed_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirefold.operators import reports
    return reports.suppressed_top(routed_postings(spark, sf_dir))


QUERIES.update({
    "latest_run_per_date": q_latest_run_per_date,
    "weekly_report_stats": q_weekly_report_stats,
    "weekly_new_roles": q_weekly_new_roles,
    "weekly_closed_roles": q_weekly_closed_roles,
    "mark_public": q_mark_public,
    "board_open": q_board_open,
    "board_closed": q_board_closed,
    "board_stats": q_board_stats,
    "mirror_counts": q_mirror_counts,
    "public_projection": q_public_projection,
    "company_pages": q_company_pages,
    "company_page_roles": q_company_page_roles,
    "pages_totals": q_pages_totals,
    "jsonld_rows": q_jsonld_rows,
    "sitemap_rows": q_sitemap_rows,
    "dirname_collisions": q_dirname_collisions,
    "digest_rows": q_digest_rows,
    "suppressed_top": q_suppressed_top,
})


# --- vendor payloads ----------------------------------------------------------

def _norm_out(df: DataFrame) -> DataFrame:
    return df.select("id", "company_name", "title", "location_raw", "is_remote",
                     F.col("comp.min").alias("comp_min"), F.col("comp.max").alias("comp_max"),
                     F.col("comp.currency").alias("comp_currency"), F.col("comp.source").alias("comp_source"),
                     "url", _ts("published_at"), "description_text",
                     F.array_join("flags", ",").alias("flags"))


def _norm_query(vendor: str):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        from hirefold.sources import vendors
        return _norm_out(vendors.NORMALISERS[vendor](FX.raw_payloads(spark, sf_dir)))
    q.__name__ = f"q_norm_{vendor}"
    return q


def _landed_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fetched documents, written once by vendor and kind for the
    queries that read several vendors."""
    import uuid
    from hirefold.session import checkpoint_dir
    from hirefold.sources import vendors
    return vendors.land_raw(FX.raw_payloads(spark, sf_dir),
                            os.path.join(checkpoint_dir(spark), f"raw-{uuid.uuid4().hex}"))


def q_all_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirefold.sources import vendors
    return _norm_out(vendors.all_postings(_landed_raw(spark, sf_dir)))


def q_scan_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirefold.sources import vendors
    return vendors.scan_accounting(FX.raw_payloads(spark, sf_dir))


def q_probe_from_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirefold.sources import vendors
    p = vendors.probe_from_board(FX.raw_payloads(spark, sf_dir))
    return p.withColumn("sample", F.array_join("sample", " | "))


def q_detail_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gated detail join of the three vendors that need one."""
    from hirefold.sources import vendors
    raw = _landed_raw(spark, sf_dir)
    out = None
    for v in ("greenhouse", "smartrecruiters", "workday"):
        part = vendors.NORMALISERS[v](raw).select(
            "id", "url", _ts("published_at"), "description_text", F.array_join("flags", ",").alias("flags"))
        out = part if out is None else out.unionByName(part)
    return out


def q_detail_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate under the default rules (with a location exception: the
    title family alone) and under rules without one (the location too)."""
    from dataclasses import replace

    from hirefold.rules import DEFAULT_RULES
    p = FX.postings(spark, sf_dir)
    of = [F.col(c) for c in ("title", "location_raw", "is_remote")]
    return p.select("id", funnel.wants_detail(*of).alias("wants_detail"),
                    funnel.wants_detail(*of, replace(DEFAULT_RULES, exception_usd=None)).alias("wants_detail_strict"))


QUERIES.update({f"norm_{v}": _norm_query(v) for v in
                ("ashby", "greenhouse", "lever", "workable", "smartrecruiters", "workday")})
QUERIES.update({
    "all_postings": q_all_postings,
    "scan_accounting": q_scan_accounting,
    "probe_from_board": q_probe_from_board,
    "detail_enrich": q_detail_enrich,
    "detail_gate": q_detail_gate,
})


# --- column functions ---------------------------------------------------------

def q_html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirefold.functions.comp import html_to_text
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    return p.select("page_id", html_to_text(F.col("html")).alias("text"))


def q_normalize_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = FX.postings(spark, sf_dir).select("title").distinct()
    return p.select("title", normalize_title(F.col("title")).alias("title_key"))


def q_location_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirefold.functions.text import location_segments
    p = FX.postings(spark, sf_dir).select("location_raw").distinct()
    return p.select("location_raw", F.array_join(location_segments(F.col("location_raw")), "|").alias("segments"))


def q_annualize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured pay components (Ashby-style interval) annualised."""
    from hirefold.functions.comp import annualize
    f = FX._order_facts(spark, sf_dir)
    lo = annualize((F.floor(F.col("top") / 2) / F.col("div")).cast("double"), F.col("interval"))
    hi = annualize((F.col("top") / F.col("div")).cast("double"), F.col("interval"))
    return f.select(F.col("k").alias("id"), F.col("interval"), lo["value"].alias("min_annual"),
                    hi["value"].alias("max_annual"), (lo["scaled"] | hi["scaled"]).alias("scaled"))


def q_workday_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirefold.sources.vendors import workday_slug
    slugs = FX.raw_payloads(spark, sf_dir).select("slug").distinct()
    w = workday_slug(F.col("slug"))
    return slugs.select("slug", w["tenant"].alias("tenant"), w["n"].alias("n"), w["site"].alias("site"))


def _vendor_rows(spark: SparkSession, sf_dir: str, vendors_, cols) -> DataFrame:
    from hirefold.sources import vendors as V
    raw = _landed_raw(spark, sf_dir)
    out = None
    for v in vendors_:
        part = V.NORMALISERS[v](raw).select("id", *cols)
        out = part if out is None else out.unionByName(part)
    return out


def q_flatten_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vendor_rows(spark, sf_dir, ("ashby", "lever", "workable", "smartrecruiters"), ["location_raw"])


def q_parse_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _vendor_rows(spark, sf_dir, ("ashby", "lever", "workable", "workday"), ["published_at"])
    return r.select("id", _ts("published_at"))


def q_remote_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vendor_rows(spark, sf_dir, ("ashby", "lever", "workable", "smartrecruiters", "workday"), ["is_remote"])


def _comp_out(df: DataFrame) -> DataFrame:
    return df.select("id", F.col("comp.min").alias("comp_min"), F.col("comp.max").alias("comp_max"),
                     F.col("comp.currency").alias("comp_currency"), F.col("comp.source").alias("comp_source"),
                     F.array_join("flags", ",").alias("flags"))


def q_comp_ashby(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirefold.sources import vendors as V
    return _comp_out(V.norm_ashby(FX.raw_payloads(spark, sf_dir)))


def q_comp_lever(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirefold.sources import vendors as V
    return _comp_out(V.norm_lever(FX.raw_payloads(spark, sf_dir)))


QUERIES.update({
    "html_to_text": q_html_to_text,
    "normalize_title": q_normalize_title,
    "location_segments": q_location_segments,
    "annualize": q_annualize,
    "workday_slug": q_workday_slug,
    "flatten_locations": q_flatten_locations,
    "parse_timestamps": q_parse_timestamps,
    "remote_signal": q_remote_signal,
    "comp_ashby": q_comp_ashby,
    "comp_lever": q_comp_lever,
})


# --- stores, run log, org list, streaming -------------------------------------

def q_tolerant_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirefold.sources import stores
    recs = stores.parse_jsonl(FX.registry_lines(spark, sf_dir), stores.REGISTRY_SCHEMA,
                              stores.REGISTRY_DEFAULTS, stores.REGISTRY_ENUMS)
    return _reg_out(stores.last_write_wins(recs, ["vendor", "slug"]).drop("line_no"))


def q_log_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry log read back from files of unequal size: the later line
    of a key wins, and says where in the log it stood."""
    import uuid

    from hirefold.session import checkpoint_dir
    from hirefold.sources import stores
    path = os.path.join(checkpoint_dir(spark), f"registry-log-{uuid.uuid4().hex}")
    FX.registry_log_files(spark, sf_dir, path)
    recs = stores.read_jsonl_tolerant(spark, path, stores.REGISTRY_SCHEMA, stores.REGISTRY_DEFAULTS, stores.REGISTRY_ENUMS)
    last = stores.last_write_wins(recs.withColumn("at", F.col("line_no")), ["vendor", "slug"])
    return last.select("at", *_reg_out(last).columns).withColumn("last_verified", F.date_format("last_verified", "yyyy-MM-dd"))


def q_history_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirefold.operators import history
    return history.history_load(FX.history_docs(spark, sf_dir))


def q_run_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirefold.sources import stores, vendors
    rec = stores.run_record(routed_postings(spark, sf_dir),
                            vendors.scan_accounting(FX.raw_payloads(spark, sf_dir)),
                            _registry(spark, sf_dir), F.to_date(_last_night(spark, sf_dir)), 61.25)
    return rec.select("date", "orgs_live", "orgs_scanned", "postings_read",
                      *[F.col(f"eliminated.{k}").alias(f"eliminated_{k}") for k in ("title", "location", "comp", "liveness")],
                      "survivors", "flagged", "suppressed", "zombies", "dead_orgs",
                      F.col("duration_seconds").cast("string").alias("duration_seconds"))


def q_org_scan_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirefold.sources import stores
    return stores.org_scan_list(FX.pins(spark, sf_dir), _registry(spark, sf_dir))


#: Files a micro-batch of the stream keys: several batches, most nights split between two.
STREAM_FILES = 200


def _stream_run(spark: SparkSession, sf_dir: str) -> str:
    """Run the nightly stream over the nights of ``sightings``, several files
    a night, into both stores. Scratch space is a fresh folder under the
    session's checkpoint dir. Returns the folder holding the stores."""
    import uuid
    from hirefold.session import checkpoint_dir
    from hirefold.streaming import reconcile
    base = os.path.join(checkpoint_dir(spark), f"stream-reconcile-{uuid.uuid4().hex}")
    snaps = os.path.join(base, "snapshots")
    reconcile.write_nightly_snapshots(FX.sightings(spark, sf_dir), snaps)
    reconcile.stream_reconcile(spark, snaps, os.path.join(base, "seen"), os.path.join(base, "ckpt"),
                               public_base=os.path.join(base, "public"), max_files_per_trigger=STREAM_FILES)
    return base


def q_stream_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final seen store of the streamed nightly fold (equal to the one-pass
    ``sighting_history``)."""
    from hirefold.sources import stores
    from hirefold.streaming import reconcile
    store = stores.read_store(spark, os.path.join(_stream_run(spark, sf_dir), "seen"), reconcile.SEEN_SCHEMA)
    return store.select("id", "org_key", "company_name", "title", "url", _ts("first_seen"),
                        _ts("last_seen"), _ts("closed_at"))


def q_stream_public_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final public store of the streamed nightly fold (equal to the one-pass
    ``public_history``: retention deletes and restarts included)."""
    from hirefold.sources import stores
    from hirefold.streaming import reconcile
    store = stores.read_store(spark, os.path.join(_stream_run(spark, sf_dir), "public"),
                              reconcile.PUBLIC_SCHEMA)
    return store.select("id", _ts("first_seen"), _ts("last_seen"), _ts("closed_at"))


QUERIES.update({
    "tolerant_jsonl": q_tolerant_jsonl,
    "log_reader": q_log_reader,
    "history_load": q_history_load,
    "run_record": q_run_record,
    "org_scan_list": q_org_scan_list,
    "stream_reconcile": q_stream_reconcile,
    "stream_public_reconcile": q_stream_public_reconcile,
})


def q_location_exception(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title-family postings that fail location: kept (flagged) when the
    band top clears the configured exception, else dropped."""
    # A filter on the verdict's columns would be pushed below the verdict
    # projection with those expressions inlined (computed twice): filter a
    # materialised verdict instead.
    v = materialize(funnel.evaluate(FX.postings(spark, sf_dir))).where(
        F.col("family").isNotNull() & (F.col("location") == "fail"))
    return v.select("id", comp_top(F.col("comp")).alias("band_top"),
                    F.array_contains("flags", "location-exception-comp").alias("rescued"),
                    F.coalesce(F.col("stage"), F.lit("")).alias("drop_stage"))


QUERIES["location_exception"] = q_location_exception


def q_closed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest's closed lines for the last night: "company: title (url)"
    for every role that closed tonight (its org answered, it was absent)."""
    from hirefold.operators import state
    now = _last_night(spark, sf_dir)
    s = FX.sightings(spark, sf_dir)
    before = s.where(F.col("run_ts") < now)
    store = state.sighting_history(before, before.select("org_key", "run_ts").distinct()) \
        .withColumn("public", F.lit(False)).withColumn("comp_band", F.lit("")).withColumn("location", F.lit(""))
    tonight = s.where(F.col("run_ts") == now)
    nxt = state.seen_reconcile(store, tonight, tonight.select("org_key"), now)
    return nxt.where("closed_now").select("id", F.concat(
        F.col("company_name"), F.lit(": "), F.col("title"), F.lit(" ("), F.col("url"), F.lit(")")).alias("line"))


QUERIES["closed_lines"] = q_closed_lines


def q_store_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the registry as two whole store versions (the second after a
    probe pass) in a fresh folder under the shared checkpoint dir, then read
    the newest complete version back."""
    import uuid
    from hirefold.operators import registry as REG
    from hirefold.session import checkpoint_dir
    from hirefold.sources import stores
    base = os.path.join(checkpoint_dir(spark), f"registry-store-{uuid.uuid4().hex}")
    reg = _registry(spark, sf_dir)
    stores.write_store(reg, base, sort_keys=("vendor", "slug"))
    stores.write_store(REG.registry_apply_probes(stores.read_store(spark, base), FX.board_probes(spark, sf_dir)),
                       base, sort_keys=("vendor", "slug"))
    return _reg_out(stores.read_store(spark, base))


QUERIES["store_write"] = q_store_write
