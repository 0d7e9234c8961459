"""Report tables: weekly report, public board, company pages, digest.

The reference renders these through templates; here each report is a
result DataFrame (the rendering is out of scope). Inputs are the stores and
the run log; aggregates are single-pass ``agg`` / ``groupBy`` with partial
aggregation, lists are per-key joins. Public reports read only public
columns (the store projection has no flag, verdict or history field).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirefold import rules as R
from hirefold.functions.text import location_label, page_dirname
from hirefold.operators.ranking import row_numbers


def _days_open(closed: Column, first: Column) -> Column:
    """Whole 24-hour days between two stamps, at least 1."""
    secs = F.unix_timestamp(closed) - F.unix_timestamp(first)
    return F.greatest(F.floor(secs / 86400), F.lit(1)).cast("bigint")


def _day_text(ts: Column, missing: str = "not stated") -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd"), F.lit(missing))


# --- run log ------------------------------------------------------------------

def latest_run_per_date(runs: DataFrame, week_end: Column) -> DataFrame:
    """The trailing 7 days (inclusive) of the run log, one record per date:
    the last line of that date wins. ``runs`` has ``date`` and ``line_no``;
    unparseable lines are expected to have been dropped on read."""
    start = F.date_sub(week_end, R.WEEK_DAYS - 1)
    w = runs.where((F.col("date") >= start) & (F.col("date") <= week_end))
    cols = [c for c in runs.columns if c not in ("date", "line_no")]
    g = w.groupBy("date").agg(F.max_by(F.struct(*cols, "line_no"), "line_no").alias("_r"))
    return g.select("date", "_r.*")


def week_label(day: Column) -> Column:
    """ISO week label: 2026-W07."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"),
                    F.lpad(F.extract(F.lit("WEEK"), day).cast("string"), 2, "0"))


def weekly_report_stats(runs: DataFrame, week_end: Column) -> DataFrame:
    """One row: week label, start, end, postings read (sum), orgs scanned
    (max), ghosts (zombies, else the liveness eliminations, else 0, summed)
    and verified live (the last run's survivors)."""
    r = latest_run_per_date(runs, week_end)
    ghosts = F.coalesce(F.col("zombies"), F.col("liveness"), F.lit(0))
    return r.agg(
        F.coalesce(F.sum("postings_read"), F.lit(0)).cast("bigint").alias("postings_read"),
        F.coalesce(F.max("orgs_scanned"), F.lit(0)).cast("bigint").alias("orgs_scanned"),
        F.coalesce(F.sum(ghosts), F.lit(0)).cast("bigint").alias("ghosts"),
        F.coalesce(F.max_by("survivors", "date"), F.lit(0)).cast("bigint").alias("verified_live"),
    ).select(week_label(week_end).alias("week_label"),
             F.date_format(F.date_sub(week_end, R.WEEK_DAYS - 1), "yyyy-MM-dd").alias("start"),
             F.date_format(week_end, "yyyy-MM-dd").alias("end"), "*")


def weekly_new_roles(seen: DataFrame, week_end: Column) -> DataFrame:
    """Every role first seen within the week; ``listed`` marks the ones the
    report names: public and still open."""
    start = F.date_sub(week_end, R.WEEK_DAYS - 1)
    d = F.to_date("first_seen")
    listed = F.coalesce(F.col("public"), F.lit(False)) & F.col("closed_at").isNull()
    return seen.where((d >= start) & (d <= week_end)).select(
        "id", F.col("company_name").alias("company"), "title", "comp_band", "location", "url", listed.alias("listed"))


def weekly_closed_roles(seen: DataFrame, week_end: Column) -> DataFrame:
    """Every role closed within the week, ``public`` marking the ones the
    report lists by name, with days alive (whole days, at least 1)."""
    start = F.date_sub(week_end, R.WEEK_DAYS - 1)
    d = F.to_date("closed_at")
    return seen.where(F.col("closed_at").isNotNull() & (d >= start) & (d <= week_end)).select(
        "id", F.col("company_name").alias("company"), "title", "public",
        _days_open(F.col("closed_at"), F.col("first_seen")).alias("days_alive"))


# --- public board -------------------------------------------------------------

def mirror_counts(public: DataFrame) -> DataFrame:
    """Collapsed rows per keeper, closed ones included."""
    return public.where(F.col("collapsed_into").isNotNull()).groupBy(
        F.col("collapsed_into").alias("id")).agg(F.count(F.lit(1)).alias("mirrors"))


def _vendor_label(v: Column) -> Column:
    expr = None
    for key, label in R.VENDOR_LABELS.items():
        expr = F.when(v == key, F.lit(label)) if expr is None else expr.when(v == key, F.lit(label))
    return expr.otherwise(F.initcap(v))


def _board_row(public: DataFrame) -> DataFrame:
    m = mirror_counts(public)
    j = public.join(m, "id", "left")
    return j.select(
        "id", "company", "title", F.coalesce(F.col("comp_band"), F.lit("")).alias("comp_band"),
        location_label(F.col("location"), F.col("remote")).alias("location"),
        _vendor_label(F.col("vendor")).alias("vendor"),
        _day_text(F.col("posted_at")).alias("posted"), "url",
        F.date_format("last_verified", "yyyy-MM-dd").alias("verified"),
        F.coalesce(F.col("mirrors"), F.lit(0)).cast("bigint").alias("mirrors"),
        "first_seen", "closed_at", "collapsed_into")


def board_open(public: DataFrame, now: Column) -> DataFrame:
    """Open, uncollapsed rows: section ``new`` (first seen within the week)
    or ``still_open``; sort key lower company, lower title."""
    week_start = F.date_sub(F.to_date(now), R.WEEK_DAYS - 1)
    rows = _board_row(public).where(F.col("closed_at").isNull() & F.col("collapsed_into").isNull())
    section = F.when(F.to_date("first_seen") >= week_start, F.lit("new")).otherwise(F.lit("still_open"))
    return rows.select("id", section.alias("section"), "company", "title", "comp_band", "location",
                       "vendor", "posted", "url", "verified", "mirrors")


def board_closed(public: DataFrame, now: Column) -> DataFrame:
    """Closed, uncollapsed rows closed within the week, with days open."""
    week_start = F.date_sub(F.to_date(now), R.WEEK_DAYS - 1)
    rows = _board_row(public).where(F.col("closed_at").isNotNull() & F.col("collapsed_into").isNull()
                                    & (F.to_date("closed_at") >= week_start))
    return rows.select("id", "company", "title", "location", "vendor", "url",
                       F.date_format("closed_at", "yyyy-MM-dd").alias("closed"),
                       _days_open(F.col("closed_at"), F.col("first_seen")).alias("days_open"), "mirrors")


def board_stats(public: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """One row: last run stamp (max last_verified, else the last run's date,
    else "never"), boards read (max over the runs), postings read (the last
    run's, never a sum), verified live and closed this week."""
    week = latest_run_per_date(runs, F.to_date(now))
    boards = week.agg(F.max("orgs_scanned")).scalar()
    postings = week.agg(F.max_by("postings_read", "date")).scalar()
    last_date = week.agg(F.max("date")).scalar()
    opened = board_open(public, now).agg(F.count(F.lit(1))).scalar()
    closed = board_closed(public, now).agg(F.count(F.lit(1))).scalar()
    stamp = public.agg(F.max("last_verified")).scalar()
    last_run = F.coalesce(F.date_format(stamp, "yyyy-MM-dd HH:mm 'UTC'"),
                          F.date_format(last_date, "yyyy-MM-dd"), F.lit("never"))
    return public.sparkSession.range(1).select(
        last_run.alias("last_run"),
        F.coalesce(boards, F.lit(0)).cast("bigint").alias("boards_read"),
        F.coalesce(postings, F.lit(0)).cast("bigint").alias("postings_read"),
        opened.cast("bigint").alias("verified_live"), closed.cast("bigint").alias("closed_this_week"))


# --- company pages --------------------------------------------------------------

def dirname_collisions(orgs: DataFrame) -> DataFrame:
    """``dirname`` per org: the sanitised vendor-slug; when taken by an org
    earlier in key order, "-2" is appended until free.

    Names can only meet within one stem (the name without "-2" tails), where
    they differ in their number of tails: each org takes the first free
    number from its own on. All that wait for a number try it, and the
    earliest wins, so numbers are dealt out from below: between two numbers
    that some org starts with, the waiting orgs are served in key order. That
    is one numbering of rows per distinct start in the table (a handful:
    tails are part of a slug), and no step needs a stem in one task."""
    base = orgs.withColumn("_base", page_dirname(F.col("vendor"), F.col("slug")))
    waiting = (base.withColumn("_stem", F.regexp_replace("_base", "(-2)+$", ""))
               .withColumn("_start", ((F.length("_base") - F.length("_stem")) / 2).cast("int")).drop("_base"))
    starts = sorted(r["_start"] for r in waiting.select("_start").distinct().collect()) or [0]
    late, named = waiting, None
    waiting = waiting.limit(0)
    for start, until in zip(starts, [*starts[1:], None], strict=True):
        ready = waiting.unionByName(late.where(F.col("_start") == start))
        ranked = row_numbers(ready, ["_stem"], ["vendor", "slug"], "_rank")
        served = ranked if until is None else ranked.where(F.col("_rank") <= until - start)
        served = served.select(*orgs.columns, F.concat("_stem", F.repeat(
            F.lit("-2"), (F.col("_rank") + (start - 1)).cast("int"))).alias("dirname"))
        named = served if named is None else named.unionByName(served)
        waiting = ranked.where(F.col("_rank") > (until or 0) - start).drop("_rank")
    return named


def company_pages(orgs: DataFrame, public: DataFrame, run_day: Column) -> DataFrame:
    """One page header per live org: open public rows on its board (mirrors
    included), the headline stamp (the store's latest verification if not
    older than the registry's, else the registry date, else the run day)
    and the company name (registry, else the first listed role's, else the
    slug). Per-org facts come from one partial aggregate, so an org holding
    a third of all rows is combined map-side; the role list itself is
    ``company_page_roles`` (flat rows), never one array per org."""
    open_ = F.col("closed_at").isNull()
    per_org = public.groupBy("org_key").agg(
        F.max("last_verified").alias("stamp"),
        F.count_if(open_).alias("n_open"),
        F.min_by("company", F.when(open_, F.struct(F.lower("title"), F.col("id")))).alias("first_company"))
    o = dirname_collisions(orgs).withColumn("org_key", F.concat_ws(":", "vendor", "slug"))
    j = o.join(per_org, "org_key", "left")
    store_wins = F.col("stamp").isNotNull() & (
        F.col("last_verified").isNull() | (F.to_date("stamp") >= F.col("last_verified")))
    as_of = (F.when(store_wins, F.date_format("stamp", "yyyy-MM-dd"))
             .when(F.col("last_verified").isNotNull(), F.date_format("last_verified", "yyyy-MM-dd"))
             .otherwise(F.date_format(run_day, "yyyy-MM-dd")))
    checked = (F.when(store_wins, F.date_format("stamp", "yyyy-MM-dd HH:mm 'UTC'"))
               .when(F.col("last_verified").isNotNull(), F.date_format("last_verified", "yyyy-MM-dd"))
               .otherwise(F.date_format(run_day, "yyyy-MM-dd")))
    n = F.coalesce(F.col("n_open"), F.lit(0)).cast("bigint")
    company = F.when(F.coalesce(F.col("company_name"), F.lit("")) != "", F.col("company_name")) \
        .otherwise(F.coalesce(F.when(n > 0, F.col("first_company")), F.col("slug")))
    headline = F.when(n > 0, F.concat(
        F.lit("Yes: "), n.cast("string"), F.lit(" open GTM/RevOps "),
        F.when(n == 1, F.lit("role")).otherwise(F.lit("roles")), F.lit(" as of "), as_of, F.lit(".")))\
        .otherwise(F.concat(F.lit("No live GTM or RevOps roles verified as of "),
                            F.date_format(run_day, "yyyy-MM-dd"), F.lit(".")))
    return j.select("vendor", "slug", "org_key", "dirname", company.alias("company"),
                    (n > 0).alias("hiring"), n.alias("n_roles"), as_of.alias("as_of"),
                    checked.alias("last_checked"), headline.alias("headline"))


def company_page_roles(pages: DataFrame, public: DataFrame) -> DataFrame:
    """The roles listed on each company page, one row each, with the page's
    sort keys (lower title, id): a join on org key, no per-org collection."""
    open_rows = public.where(F.col("closed_at").isNull())
    j = open_rows.join(pages.select("org_key", "dirname"), "org_key")
    return j.select("dirname", F.lower("title").alias("sort_title"), "id", "title", "company",
                    "comp_band", location_label(F.col("location"), F.col("remote")).alias("location_label"),
                    _day_text(F.col("posted_at")).alias("posted"), "url", "posted_at",
                    F.col("location").alias("raw_location"), "remote")


def pages_totals(pages: DataFrame) -> DataFrame:
    """One row: hiring, quiet, total roles."""
    return pages.agg(F.count_if("hiring").cast("bigint").alias("hiring_count"),
                     F.count_if(~F.col("hiring")).cast("bigint").alias("quiet_count"),
                     F.coalesce(F.sum("n_roles"), F.lit(0)).cast("bigint").alias("total_roles"))



def jsonld_rows(page_roles: DataFrame) -> DataFrame:
    """One schema.org JobPosting object per listed role (the page's array is
    these objects in (sort_title, id) order): optional keys omitted, no
    pay, "</" escaped so page text cannot close the script tag."""
    r = page_roles
    posting = F.struct(
        F.lit("https://schema.org/").alias("@context"), F.lit("JobPosting").alias("@type"),
        F.col("title").alias("title"),
        F.struct(F.lit("Organization").alias("@type"), F.col("company").alias("name")).alias("hiringOrganization"),
        F.col("url").alias("url"), F.lit(True).alias("directApply"),
        F.date_format("posted_at", "yyyy-MM-dd").alias("datePosted"),
        F.when(F.coalesce(F.col("raw_location"), F.lit("")) != "", F.struct(
            F.lit("Place").alias("@type"),
            F.struct(F.lit("PostalAddress").alias("@type"),
                     F.col("raw_location").alias("addressLocality")).alias("address"))).alias("jobLocation"),
        F.when(F.coalesce(F.col("remote"), F.lit(False)), F.lit("TELECOMMUTE")).alias("jobLocationType"))
    text = F.replace(F.to_json(posting), F.lit("</"), F.lit("<\\/"))
    return r.select("dirname", "sort_title", "id", text.alias("jsonld"))


def sitemap_rows(pages: DataFrame, run_day: Column, base_url: str = R.SITE_BASE_URL) -> DataFrame:
    """(loc, lastmod): the three top pages on the run day, then one per
    company page with its as_of date."""
    day = F.date_format(run_day, "yyyy-MM-dd")
    top = pages.sparkSession.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(f"{base_url}/{p}").alias("loc"), day.alias("lastmod"))
        for p in ("", "companies/", "methodology/")])).alias("r")).select("r.*")
    per = pages.select(F.concat(F.lit(f"{base_url}/companies/"), F.col("dirname"), F.lit("/")).alias("loc"),
                       F.col("as_of").alias("lastmod"))
    return top.unionByName(per)


# --- digest ---------------------------------------------------------------------

def digest_rows(routed: DataFrame) -> DataFrame:
    """Kept and flagged rows with band, location, dates, reasons, flags."""
    from hirefold.functions.comp import band_text
    r = routed.where(F.col("route").isin("kept", "flagged"))
    return r.select(
        "id", F.col("route").alias("section"), F.col("company_name").alias("company"), "title",
        band_text(F.col("comp")).alias("band"),
        location_label(F.col("location_raw"), F.col("is_remote")).alias("location"),
        _day_text(F.col("published_at"), "unknown").alias("posted"), "url",
        F.array_join("reasons", " | ").alias("reasons"), F.array_join("flags", ",").alias("flags"))


def suppressed_top(routed: DataFrame, n: int = R.DIGEST_TOP_SUPPRESSED) -> DataFrame:
    """The first ``n`` suppressed lines (company, title, id order) and, on
    every row, how many more there are. A top-k, not a full sort."""
    s = routed.where(F.col("route") == "suppressed").select(
        F.col("company_name").alias("company"), "title", "id",
        F.col("suppressed_by.status").alias("status"), F.col("suppressed_by.date").alias("date"),
        F.col("suppressed_by.reason").alias("reason"))
    # Read twice (a count and a top-k): cut the lineage of the suppressed
    # lines (a small subset) so the verdict upstream runs once.
    from hirefold.session import checkpoint_dir
    checkpoint_dir(s.sparkSession)
    s = s.checkpoint(eager=True)
    total = s.agg(F.count(F.lit(1))).scalar()
    top = s.orderBy("company", "title", "id").limit(n)
    return top.withColumn("more", F.greatest(total - n, F.lit(0)).cast("bigint"))
