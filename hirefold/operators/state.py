"""Sighting state: first seen, last seen, closed, resurrected, mirrors.

Two forms of the same rules:

* the nightly fold (``seen_reconcile``, ``public_reconcile``): one snapshot
  against the stored state, a full outer join on posting id;
* the one-pass backfill over a whole history of nights
  (``sighting_history``, ``public_history``, ``closure_events``), written as
  gaps-and-islands: per role the next sighting (``lead`` over the role), per
  org the next night it answered (``lead`` over the org's answered nights).
  A role closed on night ``nx`` iff its org answered on ``nx`` and the role
  was not seen again by then. Both windows partition by a key whose size is
  bounded by the number of nights, so a hot org or company never lands whole
  in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirefold import rules as R
from hirefold.functions.text import normalize_company, normalize_title

def _retention() -> Column:
    return F.expr(f"INTERVAL {R.CLOSED_RETENTION_DAYS} DAYS")

SEEN_COLUMNS = ("id", "org_key", "title", "company_name", "url", "first_seen", "last_seen",
                "closed_at", "public", "comp_band", "location")


def _one_per_id(tonight: DataFrame) -> DataFrame:
    """An id twice in one snapshot counts once: the later line wins."""
    if "line_no" in tonight.columns:
        cols = [c for c in tonight.columns if c not in ("id", "line_no")]
        agg = tonight.groupBy("id").agg(F.max_by(F.struct(*cols), F.col("line_no")).alias("_r"))
        return agg.select("id", "_r.*")
    return tonight.dropDuplicates(["id"])


def _scanned_flag(df: DataFrame, scanned: DataFrame, key: str = "org_key") -> DataFrame:
    """Mark rows whose org answered tonight. The answered set is one row per
    org (it grows with the number of orgs, not postings); AQE broadcasts it
    when its runtime size is small and shuffle-joins it otherwise."""
    s = scanned.select(F.col("org_key").alias("_scan_key")).distinct().withColumn("_scanned", F.lit(True))
    return df.join(s, df[key] == s["_scan_key"], "left").drop("_scan_key") \
        .withColumn("_scanned", F.coalesce(F.col("_scanned"), F.lit(False)))


def seen_reconcile(store: DataFrame, tonight: DataFrame, scanned: DataFrame,
                   now: Column) -> DataFrame:
    """Fold one snapshot into the seen store; adds ``is_new``, ``closed_now``.

    New id: first = last = now. Seen again: last = now, closed_at cleared,
    title and url replaced when non-empty. Absent, open, org answered: closed
    now. Org silent: unchanged. No row is ever deleted.
    """
    cur = _one_per_id(tonight.select("id", "org_key", "title", "company_name", "url",
                                     *(["line_no"] if "line_no" in tonight.columns else [])))
    s = store.select([F.col(c).alias(f"s_{c}") for c in SEEN_COLUMNS])
    c = cur.select([F.col(x).alias(f"c_{x}") for x in cur.columns])
    j = s.join(c, s["s_id"] == c["c_id"], "full_outer")
    j = j.withColumn("_org", F.coalesce("s_org_key", "c_org_key"))
    j = _scanned_flag(j, scanned, "_org")
    current = F.col("c_id").isNotNull()
    is_new = F.col("s_id").isNull()
    closes = ~current & F.col("s_closed_at").isNull() & F.col("_scanned")

    def keep_or(new: str, old: str) -> Column:
        return F.when(F.coalesce(F.col(new), F.lit("")) != "", F.col(new)).otherwise(F.col(old))

    out = j.select(
        F.coalesce("s_id", "c_id").alias("id"),
        F.when(is_new, F.col("c_org_key")).otherwise(F.col("s_org_key")).alias("org_key"),
        F.when(is_new, F.col("c_title")).when(current, keep_or("c_title", "s_title"))
        .otherwise(F.col("s_title")).alias("title"),
        F.when(is_new, F.col("c_company_name")).otherwise(F.col("s_company_name")).alias("company_name"),
        F.when(is_new, F.col("c_url")).when(current, keep_or("c_url", "s_url"))
        .otherwise(F.col("s_url")).alias("url"),
        F.when(is_new, now).otherwise(F.col("s_first_seen")).alias("first_seen"),
        F.when(current, now).otherwise(F.col("s_last_seen")).alias("last_seen"),
        F.when(current, F.lit(None).cast("timestamp")).when(closes, now)
        .otherwise(F.col("s_closed_at")).alias("closed_at"),
        F.coalesce(F.col("s_public"), F.lit(False)).alias("public"),
        F.coalesce(F.col("s_comp_band"), F.lit("")).alias("comp_band"),
        F.coalesce(F.col("s_location"), F.lit("")).alias("location"),
        is_new.alias("is_new"),
        closes.alias("closed_now"),
    )
    return out


PUBLIC_COLUMNS = ("id", "vendor", "org_key", "company", "title", "comp_band", "location",
                  "remote", "url", "posted_at", "first_seen", "last_seen", "last_verified",
                  "closed_at", "collapsed_into")


def public_reconcile(store: DataFrame, tonight: DataFrame, scanned: DataFrame,
                     now: Column, collapse: bool = True) -> DataFrame:
    """Fold tonight's title-family rows into the public store, then collapse
    cross-vendor mirrors. ``tonight`` carries the public columns already
    (vendor, org_key, company, title, comp_band, location, remote, url,
    posted_at). A seen row is refreshed whole except first_seen; a closed
    row older than the retention window that is not current is deleted."""
    fields = ("vendor", "org_key", "company", "title", "comp_band", "location", "remote",
              "url", "posted_at")
    cur = _one_per_id(tonight.select("id", *fields,
                                     *(["line_no"] if "line_no" in tonight.columns else [])))
    s = store.select([F.col(c).alias(f"s_{c}") for c in PUBLIC_COLUMNS])
    c = cur.select([F.col(x).alias(f"c_{x}") for x in cur.columns])
    j = s.join(c, s["s_id"] == c["c_id"], "full_outer")
    j = j.withColumn("_org", F.coalesce("s_org_key", "c_org_key"))
    j = _scanned_flag(j, scanned, "_org")
    current = F.col("c_id").isNotNull()
    closes = ~current & F.col("s_closed_at").isNull() & F.col("_scanned")
    expired = ~current & F.col("s_closed_at").isNotNull() & (now > F.col("s_closed_at") + _retention())
    cols = [F.coalesce("s_id", "c_id").alias("id")]
    for f in fields:
        cols.append(F.when(current, F.col(f"c_{f}")).otherwise(F.col(f"s_{f}")).alias(f))
    cols += [
        F.when(F.col("s_id").isNull(), now).otherwise(F.col("s_first_seen")).alias("first_seen"),
        F.when(current, now).otherwise(F.col("s_last_seen")).alias("last_seen"),
        F.when(current, now).otherwise(F.col("s_last_verified")).alias("last_verified"),
        F.when(current, F.lit(None).cast("timestamp")).when(closes, now)
        .otherwise(F.col("s_closed_at")).alias("closed_at"),
        F.col("s_collapsed_into").alias("collapsed_into"),
    ]
    folded = j.where(~expired).select(*cols)
    # mirror_collapse reads its input twice (group facts joined back); a
    # caller whose input is not materialised passes collapse=False and
    # collapses a checkpointed result instead.
    return mirror_collapse(folded) if collapse else folded


def mirror_collapse(public: DataFrame) -> DataFrame:
    """Among open rows, group by (company key, title key); when the group
    spans at least two vendors, rows of vendors other than the keeper's
    (earliest posted_at else first_seen, then id) point at the keeper.
    Closed rows keep their stored value.

    The group facts come from a ``groupBy`` (partial aggregation, so a hot
    company/title pair is combined map-side) joined back on the key, not
    from a window that would put the whole hot group in one task. The
    input is read twice, so it should be a stored or checkpointed table.
    """
    keyed = public.withColumn("_ck", normalize_company(F.col("company"))) \
        .withColumn("_tk", normalize_title(F.col("title")))
    open_ = F.col("closed_at").isNull()
    posted = F.coalesce(F.col("posted_at"), F.col("first_seen"))
    groups = keyed.where(open_).groupBy("_ck", "_tk").agg(
        F.size(F.collect_set("vendor")).alias("_nv"),
        F.min_by(F.struct(F.col("id").alias("kid"), F.col("vendor").alias("kvendor")),
                 F.struct(posted, F.col("id"))).alias("_keeper"),
    ).where(F.col("_nv") >= 2)
    j = keyed.join(groups, ["_ck", "_tk"], "left")
    collapsed = (F.when(~open_, F.col("collapsed_into"))
                 .when(F.col("_nv").isNotNull() & (F.col("vendor") != F.col("_keeper.kvendor")),
                       F.col("_keeper.kid")))
    return j.withColumn("collapsed_into", collapsed).drop("_ck", "_tk", "_nv", "_keeper")


def mark_public(store: DataFrame, kept: DataFrame) -> DataFrame:
    """Flag-free kept rows become public with band text and location label.
    Sticky: a public row is never reset. ``kept`` has id, flags, band,
    location_label."""
    k = kept.where(F.size(F.coalesce("flags", F.array().cast("array<string>"))) == 0) \
        .select("id", F.col("band").alias("_band"), F.col("location_label").alias("_loc"))
    j = store.join(k, "id", "left")
    hit = F.col("_band").isNotNull()
    return (j.withColumn("public", F.col("public") | hit)
            .withColumn("comp_band", F.when(hit, F.col("_band")).otherwise(F.col("comp_band")))
            .withColumn("location", F.when(hit, F.col("_loc")).otherwise(F.col("location")))
            .drop("_band", "_loc"))


def new_postings(store: DataFrame | None, tonight: DataFrame, include_open: bool = False) -> DataFrame:
    """Tonight's postings not in the store (all of them without a store, or
    with ``include_open``), with ``is_new``."""
    if store is None:
        return tonight.withColumn("is_new", F.lit(True))
    known = store.select("id").withColumn("_known", F.lit(True))
    j = tonight.join(known, "id", "left").withColumn("is_new", F.col("_known").isNull()).drop("_known")
    return j if include_open else j.where("is_new")


# --- one pass over a history of nights --------------------------------------

def _linked(sightings: DataFrame, answered: DataFrame) -> DataFrame:
    """Each sighting with ``ns`` (role's next sighting), ``nx`` (org's next
    answered night) and ``closed_on`` (nx when the role was absent then)."""
    org_nights = answered.select("org_key", "run_ts").distinct().withColumn(
        "nx", F.lead("run_ts").over(Window.partitionBy("org_key").orderBy("run_ts")))
    s = sightings.join(org_nights, ["org_key", "run_ts"], "left")
    s = s.withColumn("ns", F.lead("run_ts").over(Window.partitionBy("id").orderBy("run_ts")))
    closed = F.col("nx").isNotNull() & (F.col("ns").isNull() | (F.col("nx") < F.col("ns")))
    return s.withColumn("closed_on", F.when(closed, F.col("nx")))


def sighting_history(sightings: DataFrame, answered: DataFrame) -> DataFrame:
    """Seen-store end state over all nights: one row per role id."""
    s = _linked(sightings, answered)
    last_title = F.when(F.coalesce(F.col("title"), F.lit("")) != "", F.col("run_ts"))
    last_url = F.when(F.coalesce(F.col("url"), F.lit("")) != "", F.col("run_ts"))
    return s.groupBy("id").agg(
        F.min_by("org_key", "run_ts").alias("org_key"),
        F.min_by("company_name", "run_ts").alias("company_name"),
        F.coalesce(F.max_by("title", last_title), F.min_by("title", "run_ts")).alias("title"),
        F.coalesce(F.max_by("url", last_url), F.min_by("url", "run_ts")).alias("url"),
        F.min("run_ts").alias("first_seen"),
        F.max("run_ts").alias("last_seen"),
        F.max_by("closed_on", "run_ts").alias("closed_at"),
        F.count("closed_on").alias("n_closures"),
        F.count(F.when(F.col("closed_on").isNotNull() & F.col("ns").isNotNull(), 1)).alias("n_reopened"),
    )


def closure_events(sightings: DataFrame, answered: DataFrame) -> DataFrame:
    """Every closure (on the org's next answered night) and every
    resurrection (the next sighting after a closure): id, night, event."""
    s = _linked(sightings, answered).where(F.col("closed_on").isNotNull())
    closed = s.select("id", F.col("closed_on").alias("night"), F.lit("closed").alias("event"))
    reopened = s.where(F.col("ns").isNotNull()).select(
        "id", F.col("ns").alias("night"), F.lit("reopened").alias("event"))
    return closed.unionByName(reopened)


def _deletion_nights(nights: DataFrame) -> DataFrame:
    """(closed_on, drop_on): the first run night more than the retention
    window after each run night. The calendar has one row per night, so its
    sorted array is a bounded scalar; it is materialised as a column before
    the higher-order filter reads it."""
    cal = nights.select("run_ts").distinct()
    arr = cal.agg(F.array_sort(F.collect_list("run_ts"))).scalar()
    return cal.withColumn("_cal", arr).select(
        F.col("run_ts").alias("closed_on"),
        F.try_element_at(F.filter("_cal", lambda r: r > F.col("run_ts") + _retention()), F.lit(1))
        .alias("drop_on"))


def public_history(sightings: DataFrame, answered: DataFrame, nights: DataFrame) -> DataFrame:
    """Public-store end state over all nights: a closed row is deleted on the
    first run night past retention unless the role came back first, and a
    later sighting starts a new row (new first_seen)."""
    s = _linked(sightings, answered)
    d = F.broadcast(_deletion_nights(nights))
    s = s.join(d, "closed_on", "left")
    deleted = F.col("drop_on").isNotNull() & (F.col("ns").isNull() | (F.col("drop_on") < F.col("ns")))
    w = Window.partitionBy("id").orderBy("run_ts")
    s = s.withColumn("_deleted", deleted).withColumn(
        "_island", F.coalesce(F.sum(F.col("_deleted").cast("int")).over(
            w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("_last_island", F.max("_island").over(Window.partitionBy("id")))
    last = s.where(F.col("_island") == F.col("_last_island"))
    fields = [c for c in ("vendor", "org_key", "company_name", "title", "url") if c in s.columns]
    agg = last.groupBy("id").agg(
        F.max_by(F.struct(*fields), "run_ts").alias("_r"),
        F.min("run_ts").alias("first_seen"),
        F.max("run_ts").alias("last_seen"),
        F.max_by("closed_on", "run_ts").alias("closed_at"),
        F.max_by("_deleted", "run_ts").alias("_gone"),
    )
    return agg.where(~F.col("_gone")).select(
        "id", "_r.*", "first_seen", "last_seen", F.col("last_seen").alias("last_verified"),
        "closed_at")


def public_rows_from_postings(postings: DataFrame, rules=None) -> DataFrame:
    """Title-family postings in the public store's shape (before any private
    filter): employer data only; the band only when one is known."""
    from hirefold.functions.comp import band_text, comp_known
    from hirefold.operators.funnel import title_family
    family = title_family(F.col("title")) if rules is None else title_family(F.col("title"), rules)
    fam = postings.where(family.isNotNull())
    return fam.select(
        "id", F.col("source").alias("vendor"), F.concat_ws(":", "source", "org_slug").alias("org_key"),
        F.col("company_name").alias("company"), "title",
        F.when(comp_known(F.col("comp")), band_text(F.col("comp"))).otherwise(F.lit("")).alias("comp_band"),
        F.coalesce(F.col("location_raw"), F.lit("")).alias("location"),
        F.coalesce(F.col("is_remote"), F.lit(False)).alias("remote"),
        F.coalesce(F.col("url"), F.lit("")).alias("url"), F.col("published_at").alias("posted_at"),
        *(["line_no"] if "line_no" in postings.columns else []))


def empty_public_store(spark) -> DataFrame:
    schema = ("id string, vendor string, org_key string, company string, title string, "
              "comp_band string, location string, remote boolean, url string, posted_at timestamp, "
              "first_seen timestamp, last_seen timestamp, last_verified timestamp, "
              "closed_at timestamp, collapsed_into string")
    return spark.createDataFrame([], schema)
