"""The company board registry: discovery from crawled pages, upkeep from
vendor probes, and its statistics.

Registry rows are keyed by (vendor, slug); they are never deleted. Every
operator is a join or an aggregate on that key, or a projection over pages;
none collects to the driver.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirefold import rules as R
from hirefold.functions.text import domain_of, let, name_guess, py_strip
from hirefold.session import checkpoint_dir

REGISTRY_COLUMNS = ("company_name", "domain", "vendor", "slug", "board_url", "status",
                    "last_verified", "last_posting_count", "discovered_via", "notes")
REF_TYPE = "struct<vendor:string,slug:string,board_url:string>"


def _clean_slug(raw: Column, vendor: str) -> Column:
    """URL-decode (valid %XX escapes decoded, a malformed "%" kept as is),
    strip whitespace, then trailing dots and hyphens; lower case for
    case-insensitive vendors. The slug class has no "+", so url_decode's
    plus-as-space never applies."""
    escaped = F.regexp_replace(raw, "%(?![0-9A-Fa-f]{2})", "%25")
    s = F.coalesce(F.try_url_decode(escaped), raw)
    s = F.regexp_replace(py_strip(s), r"[.-]+$", "")
    return F.lower(s) if vendor in R.LOWERCASE_SLUG_VENDORS else s


def board_refs(text: Column) -> Column:
    """array<struct<vendor, slug, board_url>>: every board the text
    mentions, pattern by pattern in the fixed order (not text order), junk
    path words dropped, each (vendor, slug) kept at its first mention.

    The text is bound once (``let``): it feeds a dozen pattern scans that
    run under higher-order functions, where it would otherwise be rebuilt
    for each."""
    return let(lambda x: _board_refs(x["t"]), t=text)


def _board_refs(text: Column) -> Column:
    parts = []
    for (vendor, pattern), host in zip(R.BOARD_PATTERNS, R.BOARD_HOSTS):
        junk = F.array(*[F.lit(j) for j in R.JUNK_SLUGS.get(vendor, ())])
        prefix = R.BOARD_URLS[vendor].replace("{slug}", "")
        found = F.when(F.contains(text, F.lit(host)), F.regexp_extract_all(text, F.lit(pattern), 1)).otherwise(
            F.array().cast("array<string>"))
        slugs = F.transform(found, _slug_fn(vendor))
        kept = F.filter(slugs, lambda s: (s != "") & ~F.array_contains(junk, F.lower(s)))
        parts.append(F.transform(kept, _ref_fn(vendor, prefix)))
    # The text is scanned once for whole matches, which are then split. A
    # match starts where a run of tenant characters starts (greedy, so the
    # leftmost start is that anyway); saying so keeps a page with one long
    # run linear instead of quadratic.
    wd = R.WORKDAY_PATTERN
    whole = F.when(F.contains(text, F.lit(R.WORKDAY_HOST)),
                   F.regexp_extract_all(text, F.lit("(?<![a-z0-9-])" + wd.replace("+)", "++)", 1)), 0)).otherwise(
        F.array().cast("array<string>"))
    triples = F.transform(whole, lambda m: F.struct(F.regexp_extract(m, wd, 1).alias("t"),
                                                    F.regexp_extract(m, wd, 2).alias("n"),
                                                    F.regexp_extract(m, wd, 4).alias("site")))
    wd_refs = F.transform(
        F.filter(triples, lambda t: F.coalesce(F.lower(t["site"]), F.lit("")) != "wday"),
        lambda t: F.struct(
            F.lit("workday").alias("vendor"),
            F.concat(t["t"], F.lit(".wd"), t["n"], F.lit("/"), t["site"]).alias("slug"),
            F.concat(F.lit("https://"), t["t"], F.lit(".wd"), t["n"],
                     F.lit(".myworkdayjobs.com/"), t["site"]).alias("board_url")))
    parts.append(wd_refs)
    return F.array_distinct(F.flatten(F.array(*parts))).cast(f"array<{REF_TYPE}>")


def _slug_fn(vendor: str):
    def fn(raw: Column) -> Column:
        return _clean_slug(raw, vendor)
    return fn


def _ref_fn(vendor: str, prefix: str):
    def fn(slug: Column) -> Column:
        return F.struct(F.lit(vendor).alias("vendor"), slug.alias("slug"),
                        F.concat(F.lit(prefix), slug).alias("board_url"))
    return fn


def discover_orgs(pages: DataFrame, discovered_via: str = "") -> DataFrame:
    """Candidate registry rows from crawled pages.

    Per domain, pages are tried in candidate order (rank, then page id);
    pages answering 400 or more are skipped; the first page with any board
    reference supplies all rows. The final URL after redirects counts as
    evidence. One ``min_by`` per domain (partial aggregation, no window).
    """
    hay = F.concat(F.coalesce(F.col("final_url"), F.col("url"), F.lit("")), F.lit("\n"),
                   F.coalesce(F.col("html"), F.lit("")))
    refs = pages.where(F.col("http_status") < 400).select(
        "domain", "candidate_rank", "page_id", board_refs(hay).alias("refs"))
    # "Has a reference" is part of the ordering (min_by skips NULL orderings)
    # rather than a filter: a filter here would be pushed below the
    # projection with the whole board_refs expression inlined into it,
    # scanning every page twice.
    first = refs.groupBy("domain").agg(
        F.min_by("refs", F.when(F.size("refs") > 0, F.struct("candidate_rank", "page_id"))).alias("refs"))
    first = first.where(F.size("refs") > 0)
    rows = first.select("domain", F.posexplode("refs").alias("ref_pos", "ref"))
    return rows.select(
        name_guess(F.col("domain")).alias("company_name"), "domain",
        F.col("ref.vendor").alias("vendor"), F.col("ref.slug").alias("slug"),
        F.col("ref.board_url").alias("board_url"), F.lit("unverified").alias("status"),
        F.lit(None).cast("date").alias("last_verified"), F.lit(0).cast("bigint").alias("last_posting_count"),
        F.lit(discovered_via).alias("discovered_via"), F.lit("").alias("notes"), "ref_pos")


def no_match_markers(pages: DataFrame, found: DataFrame, discovered_via: str = "") -> DataFrame:
    """A vendor-``unknown`` row (slug = domain) for every scanned domain with
    no reference, whatever its pages answered, so it is not rescanned."""
    scanned = pages.select("domain").distinct()
    none = scanned.join(found.select("domain").distinct(), "domain", "left_anti")
    return none.select(
        name_guess(F.col("domain")).alias("company_name"), "domain",
        F.lit("unknown").alias("vendor"), F.col("domain").alias("slug"), F.lit("").alias("board_url"),
        F.lit("unverified").alias("status"), F.lit(None).cast("date").alias("last_verified"),
        F.lit(0).cast("bigint").alias("last_posting_count"),
        F.lit(discovered_via).alias("discovered_via"), F.lit(R.NO_MATCH_NOTE).alias("notes"))


def domains_to_scan(lines: DataFrame, registry: DataFrame) -> DataFrame:
    """Per input line (line_no, raw): its domain and action: ``todo`` (first
    mention of an unclaimed domain), ``known`` (claimed by a registry row),
    ``repeat`` (a later mention) or ``ignored`` (blank or a comment)."""
    every = lines.withColumn("domain", domain_of(F.col("raw")))
    # Blank and commented lines share a few "domains": they join nothing.
    ignored = F.coalesce((F.col("domain") == "") | F.col("domain").startswith("#"), F.lit(True))
    d = every.where(~ignored)
    claimed = registry.where(F.coalesce(F.col("domain"), F.lit("")) != "") \
        .select(F.col("domain").alias("_cd")).distinct().withColumn("_claimed", F.lit(True))
    d = d.join(claimed, d["domain"] == claimed["_cd"], "left").drop("_cd")
    firsts = d.groupBy("domain").agg(F.min("line_no").alias("_first"))
    d = d.join(firsts, "domain", "left")
    action = (F.when(F.coalesce(F.col("_claimed"), F.lit(False)), F.lit("known"))
              .when(F.col("line_no") == F.col("_first"), F.lit("todo"))
              .otherwise(F.lit("repeat")))
    return d.select("line_no", "domain", action.alias("action")).unionByName(
        every.where(ignored).select("line_no", "domain", F.lit("ignored").alias("action")))


def registry_upsert(registry: DataFrame, candidates: DataFrame) -> DataFrame:
    """New key: inserted (the first candidate). Existing key: only empty
    company_name, domain, board_url, discovered_via are filled, from the
    first candidate (by ``ordinal``) that has one; status, notes and dates
    are kept."""
    fill = ("company_name", "domain", "board_url", "discovered_via")
    rest = [c for c in REGISTRY_COLUMNS if c not in fill + ("vendor", "slug")]
    c = candidates.groupBy("vendor", "slug").agg(
        *[F.min_by(f, F.when(F.coalesce(F.col(f), F.lit("")) != "", F.col("ordinal"))).alias(f"c_{f}")
          for f in fill],
        F.min_by(F.struct(*rest), F.col("ordinal")).alias("c_first"))
    r = registry.select([F.col(x).alias(f"r_{x}") for x in REGISTRY_COLUMNS]).withColumn("_exists", F.lit(True))
    j = r.join(c, (r["r_vendor"] == c["vendor"]) & (r["r_slug"] == c["slug"]), "full_outer")
    exists = F.coalesce(F.col("_exists"), F.lit(False))
    cols = [F.coalesce("r_vendor", "vendor").alias("vendor"), F.coalesce("r_slug", "slug").alias("slug")]
    for f in fill:
        old = F.coalesce(F.col(f"r_{f}"), F.lit(""))
        cols.append(F.when(exists & (old != ""), old)
                    .otherwise(F.coalesce(F.col(f"c_{f}"), old)).alias(f))
    for f in rest:
        cols.append(F.when(exists, F.col(f"r_{f}")).otherwise(F.col(f"c_first.{f}")).alias(f))
    return j.select(*cols).select(*REGISTRY_COLUMNS)


class Added(NamedTuple):
    """What ``registry_add`` makes: the next registry, and one row of counts."""

    registry: DataFrame
    counts: DataFrame


def registry_add(registry: DataFrame, lines: DataFrame, crawl: DataFrame, discovered_via: str = "") -> Added:
    """Scan the unclaimed domains of a list from their crawled pages and fold
    what is found, then a no-match marker for every other scanned domain,
    into the registry. Counts: scanned (todo domains that were crawled),
    skipped (known or repeated lines), orgs_found, no_match. Found rows are
    checkpointed (read three times), as is the registry."""
    checkpoint_dir(registry.sparkSession)
    plan = domains_to_scan(lines, registry).checkpoint()
    todo = plan.where(F.col("action") == "todo").select("domain")
    pages = crawl.join(todo, "domain", "left_semi")
    found = discover_orgs(pages, discovered_via).checkpoint()
    markers = no_match_markers(pages, found, discovered_via)

    def place(group: int, at: Column) -> Column:
        return F.struct(F.lit(group).alias("group"), F.col("domain"), at.cast("bigint").alias("at"))
    candidates = found.withColumn("ordinal", place(0, F.col("ref_pos"))).drop("ref_pos").unionByName(
        markers.withColumn("ordinal", place(1, F.lit(0))))
    merged = registry_upsert(registry, candidates).checkpoint()
    scanned = todo.join(pages.select("domain").distinct(), "domain", "left_semi")
    parts = {"scanned": scanned, "skipped": plan.where(F.col("action").isin("known", "repeat")),
             "orgs_found": found, "no_match": markers}
    tagged = reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("k")) for k, df in parts.items()])
    return Added(merged, tagged.agg(*[F.count_if(F.col("k") == k).alias(k) for k in parts]))


def probe_outcomes(registry: DataFrame, probes: DataFrame) -> DataFrame:
    """Registry rows (vendor known) joined to their latest probe (by
    ``line_no``); adds ``probe`` (struct or NULL)."""
    p = probes.groupBy("vendor", "slug").agg(F.max_by(
        F.struct("status", "count", "company_name", "detail", "probed_on"), "line_no").alias("probe"))
    return registry.join(p, ["vendor", "slug"], "left")


def registry_apply_probes(registry: DataFrame, probes: DataFrame) -> DataFrame:
    """ok: live, dated, count, the vendor's own name when it gives one, and
    a "back from the dead" note if it was dead. 404: dead, dated, count 0,
    a "went dead" note unless already dead. error or no probe: untouched."""
    j = probe_outcomes(registry, probes)
    st = F.col("probe.status")
    known = F.col("vendor") != "unknown"
    ok = known & (st == "ok")
    gone = known & (st == "404")
    day = F.date_format(F.col("probe.probed_on"), "yyyy-MM-dd")
    revived = F.concat(F.lit("back from the dead on "), day, F.lit(" with "),
                       F.col("probe.count").cast("string"), F.lit(" postings"))
    died = F.concat(F.lit("went dead on "), day, F.lit(": "), F.col("probe.detail"))

    def add_note(line: Column) -> Column:
        return F.when(F.coalesce(F.col("notes"), F.lit("")) != "",
                      F.concat(F.col("notes"), F.lit("; "), line)).otherwise(line)

    out = j.select(
        F.when(ok & (F.coalesce(F.col("probe.company_name"), F.lit("")) != ""),
               F.col("probe.company_name")).otherwise(F.col("company_name")).alias("company_name"),
        "domain", "vendor", "slug", "board_url",
        F.when(ok, F.lit("live")).when(gone, F.lit("dead")).otherwise(F.col("status")).alias("status"),
        F.when(ok | gone, F.col("probe.probed_on")).otherwise(F.col("last_verified")).alias("last_verified"),
        F.when(ok, F.col("probe.count").cast("bigint")).when(gone, F.lit(0).cast("bigint"))
        .otherwise(F.col("last_posting_count")).alias("last_posting_count"),
        "discovered_via",
        F.when(ok & (F.col("status") == "dead"), add_note(revived))
        .when(gone & (F.col("status") != "dead"), add_note(died))
        .otherwise(F.col("notes")).alias("notes"),
    )
    return out


def registry_probe_counts(registry: DataFrame, probes: DataFrame) -> DataFrame:
    """checked, live, dead, error, went_dead (was live), revived (was dead)
    over the probed rows, before the probes are applied. One row."""
    j = probe_outcomes(registry, probes).where(
        (F.col("vendor") != "unknown") & F.col("probe").isNotNull())
    st = F.col("probe.status")
    return j.agg(
        F.count(F.lit(1)).alias("checked"),
        F.count_if(st == "ok").alias("live"),
        F.count_if(st == "404").alias("dead"),
        F.count_if(~st.isin("ok", "404")).alias("error"),
        F.count_if((st == "404") & (F.col("status") == "live")).alias("went_dead"),
        F.count_if((st == "ok") & (F.col("status") == "dead")).alias("revived"),
    )


def stalest_first(registry: DataFrame, n: int, vendor: str | None = None) -> DataFrame:
    """The next ``n`` rows to re-verify: never verified first, then the
    oldest date, then key; unknown vendors excluded (top-k, no full sort)."""
    r = registry.where(F.col("vendor") != "unknown")
    if vendor:
        r = r.where(F.col("vendor") == vendor)
    return r.orderBy(F.col("last_verified").asc_nulls_first(), "vendor", "slug").limit(n)


def live_orgs(registry: DataFrame, vendor: str | None = None) -> DataFrame:
    r = registry.where((F.col("status") == "live") & (F.col("vendor") != "unknown"))
    if vendor:
        r = r.where(F.col("vendor") == vendor)
    return r


def registry_stats(registry: DataFrame) -> DataFrame:
    """(metric, vendor, n): total; live, dead, unverified (unknown vendor
    excluded); no_ats_found; postings on live rows; live per vendor."""
    unknown = F.col("vendor") == "unknown"
    live = ~unknown & (F.col("status") == "live")
    totals = registry.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(live).alias("live"),
        F.count_if(~unknown & (F.col("status") == "dead")).alias("dead"),
        F.count_if(~unknown & ~F.col("status").isin("live", "dead")).alias("unverified"),
        F.count_if(unknown).alias("no_ats_found"),
        F.coalesce(F.sum(F.when(live, F.col("last_posting_count"))), F.lit(0)).cast("bigint")
        .alias("postings_last_seen"),
    )
    names = ("total", "live", "dead", "unverified", "no_ats_found", "postings_last_seen")
    long = totals.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(n).cast("bigint").alias("n")) for n in names])).alias("m"))
    long = long.select("m.metric", F.lit("").alias("vendor"), "m.n")
    by_vendor = registry.where(live).groupBy("vendor").agg(F.count(F.lit(1)).alias("n")) \
        .select(F.lit("live_by_vendor").alias("metric"), "vendor", "n")
    return long.unionByName(by_vendor)


def last_write_wins(log: DataFrame, keys=("vendor", "slug"), order: str = "line_no") -> DataFrame:
    """One row per key: the latest line wins (explicit line number)."""
    cols = [c for c in log.columns if c not in keys]
    g = log.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col(order)).alias("_r"))
    return g.select(*keys, "_r.*")


def slug_lookup(probes: DataFrame, slugs: DataFrame) -> DataFrame:
    """For each slug, every vendor's probe result (Workday only for slugs
    with a slash); vendors with no result show status NULL."""
    vendors = F.array(*[F.lit(v) for v in R.VENDORS])
    cand = slugs.select("slug", F.explode(vendors).alias("vendor")).where(
        (F.col("vendor") != "workday") | (F.instr("slug", "/") > 0))
    latest = probes.groupBy("vendor", "slug").agg(
        F.max_by(F.struct("status", "count", "detail"), "line_no").alias("p"))
    j = cand.join(latest, ["vendor", "slug"], "left")
    return j.select("slug", "vendor", F.col("p.status").alias("status"), F.col("p.count").alias("count"),
                    F.when(F.col("p.status") == "404", F.lit("no board at this slug"))
                    .otherwise(F.col("p.detail")).alias("detail"))
