"""Raw vendor payloads to the one ``postings`` row shape.

Input: the ``raw_payloads`` table, one fetched document per row
(vendor, slug, company, kind 'list' | 'detail', external_id, offset,
http_status, body JSON text). Every normaliser is ``from_json`` with an
explicit schema + ``explode`` + column expressions: documents are parsed in
parallel by file split, nothing is collected, and the detail enrichment is
one left join on (vendor, slug, external id) restricted to gated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirefold import rules as R
from hirefold.functions.comp import (
    annualize, comp_struct, html_to_text, html_to_text_many, parse_salary_prose,
)
from hirefold.functions.text import py_strip, role_id
from hirefold.operators.funnel import wants_detail
from hirefold.rules import DEFAULT_RULES, Rules

POSTING_COLUMNS = ("id", "source", "org_slug", "company_name", "title", "location_raw",
                   "is_remote", "comp", "url", "published_at", "updated_at", "description_text",
                   "flags", "line_no")

def no_comp() -> Column:
    return comp_struct(F.lit(None), F.lit(None), F.lit(None).cast("string"), F.lit("none"))


def no_flags() -> Column:
    return F.array().cast("array<string>")

ASHBY_SCHEMA = """struct<jobs:array<struct<id:string,title:string,location:string,
  secondaryLocations:array<struct<location:string>>,publishedAt:string,updatedAt:string,
  isListed:boolean,isRemote:boolean,workplaceType:string,jobUrl:string,applyUrl:string,
  descriptionPlain:string,compensation:struct<compensationTierSummary:string,
  scrapeableCompensationSalarySummary:string,compensationTiers:array<struct<components:array<
  struct<compensationType:string,interval:string,currencyCode:string,minValue:double,
  maxValue:double>>>>>>>>"""
GREENHOUSE_SCHEMA = """struct<jobs:array<struct<id:bigint,title:string,company_name:string,
  location:struct<name:string>,absolute_url:string,first_published:string,updated_at:string>>>"""
GREENHOUSE_DETAIL_SCHEMA = "struct<id:bigint,content:string>"
LEVER_SCHEMA = """array<struct<id:string,text:string,workplaceType:string,createdAt:bigint,
  hostedUrl:string,applyUrl:string,categories:struct<location:string,allLocations:array<string>>,
  descriptionPlain:string,additionalPlain:string,lists:array<struct<content:string>>,
  salaryRange:struct<min:double,max:double,currency:string,interval:string>>>"""
WORKABLE_SCHEMA = """struct<name:string,jobs:array<struct<shortcode:string,title:string,
  telecommuting:boolean,url:string,application_url:string,published_on:string,city:string,
  state:string,country:string,locations:array<struct<city:string,region:string,country:string>>,
  description:string>>>"""
SMARTRECRUITERS_SCHEMA = """struct<totalFound:bigint,content:array<struct<id:string,name:string,
  company:struct<name:string,identifier:string>,releasedDate:string,location:struct<city:string,
  region:string,country:string,remote:boolean,fullLocation:string>>>>"""
SMARTRECRUITERS_DETAIL_SCHEMA = """struct<id:string,postingUrl:string,jobAd:struct<sections:struct<
  companyDescription:struct<text:string>,jobDescription:struct<text:string>,
  qualifications:struct<text:string>,additionalInformation:struct<text:string>>>>"""
WORKDAY_SCHEMA = """struct<total:bigint,jobPostings:array<struct<title:string,externalPath:string,
  locationsText:string,remoteType:string>>>"""
WORKDAY_DETAIL_SCHEMA = """struct<jobPostingInfo:struct<jobDescription:string,startDate:string,
  externalUrl:string>>"""


def _nonempty(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) != "", c)


def _or(*cols: Column) -> Column:
    """Python ``a or b or ...`` over strings: first non-empty, else ''."""
    return F.coalesce(*[_nonempty(c) for c in cols], F.lit(""))


def display_name(company: Column, slug: Column) -> Column:
    return _or(company, slug)


def parse_iso(c: Column) -> Column:
    """ISO stamp (Z or offset) or a bare date; anything else is NULL."""
    return F.try_to_timestamp(_nonempty(c))


def epoch_ms(c: Column) -> Column:
    """Epoch milliseconds; 0 or NULL is NULL."""
    return F.when(F.coalesce(c, F.lit(0)) != 0, F.timestamp_millis(c))


def join_locations(parts: Column) -> Column:
    """Strip, drop empties and repeats (order kept), join with " | "."""
    cleaned = F.filter(F.transform(parts, lambda p: py_strip(F.coalesce(p, F.lit("")))), lambda p: p != "")
    return F.array_join(F.array_distinct(cleaned), " | ")


def comma_segment(*parts: Column) -> Column:
    """", ".join of the stripped non-empty parts."""
    return F.array_join(F.filter(F.array(*[py_strip(F.coalesce(p, F.lit(""))) for p in parts]),
                                 lambda p: p != ""), ", ")


def _with_parsed(df: DataFrame, text: Column) -> DataFrame:
    """Add ``_parsed`` (the prose band) as its own column: it is read by
    several fields, and an expression under higher-order functions gets no
    common-subexpression elimination, so it must be computed once."""
    return df.withColumn("_parsed", parse_salary_prose(text))


def _parsed_comp():
    """(comp, flags) from ``_parsed``, source "parsed" when a band is found."""
    p = F.col("_parsed")
    found = p.isNotNull()
    comp = F.when(found, comp_struct(p["min"], p["max"], p["currency"], F.lit("parsed"))).otherwise(no_comp())
    return comp, F.when(found, p["flags"]).otherwise(no_flags())


#: Paginated vendors: where a list page keeps its total and its postings.
PAGED = {"smartrecruiters": ("totalFound", "content"), "workday": ("total", "jobPostings")}


def walked_pages(raw: DataFrame) -> DataFrame:
    """One narrow row per list document: vendor, slug, offset, ``read`` (the
    board's walk asks for it), ``rows`` (postings on it), ``failed`` (offset,
    status, error; NULL where it answered).

    A paginated board is walked in offset order: the first page is always
    asked for, a later one as long as the rows received so far are fewer than
    the total that the page before reported (the latest, so a board that
    grows or shrinks on the way is followed) and no page came back empty.
    An ordered fold, as running sums over a board's pages; each body is
    parsed once and none is shuffled."""
    status = F.coalesce(F.col("http_status"), F.lit(200))
    parsed = raw.where(F.col("kind") == "list").select(
        "vendor", "slug", F.coalesce(F.col("offset"), F.lit(0)).alias("offset"), status.alias("status"), "error",
        F.when(status < 400, F.try_parse_json("body")).alias("doc"))
    total, rows = F.lit(None).cast("bigint"), F.lit(None).cast("int")
    for vendor, (of, at) in PAGED.items():
        here = F.col("vendor") == vendor
        total = F.when(here, F.coalesce(F.try_variant_get("doc", f"$.{of}", "bigint"), F.lit(0))).otherwise(total)
        rows = F.when(here, F.coalesce(F.size(F.try_variant_get("doc", f"$.{at}", "array<variant>")), F.lit(0))).otherwise(rows)
    unreadable = (F.col("status") < 400) & F.col("doc").isNull()
    error = F.when(unreadable, F.lit(R.BAD_JSON)).otherwise(
        F.coalesce(F.col("error"), F.concat(F.lit("HTTP "), F.col("status").cast("string"))))
    pages = parsed.select("vendor", "slug", "offset", total.alias("total"), F.greatest(rows, F.lit(0)).alias("rows"), F.when(
        unreadable | (F.col("status") >= 400),
        F.struct(F.col("offset"), F.col("status"), error.alias("error"))).alias("failed"))
    walk = Window.partitionBy("vendor", "slug").orderBy("offset", F.col("failed").asc_nulls_first(), "total", "rows")
    received = F.sum("rows").over(walk.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = F.col("vendor").isin(*PAGED) & (F.col("failed").isNotNull() | (F.col("rows") == 0) | (received >= F.col("total")))
    pages = pages.withColumn("_ends", ends)
    before = F.max("_ends").over(walk.rowsBetween(Window.unboundedPreceding, -1))
    return pages.select("vendor", "slug", "offset", (~F.coalesce(before, F.lit(False))).alias("read"), "rows", "failed")


def board_outcomes(raw: DataFrame) -> DataFrame:
    """Per (vendor, slug): ``outcome`` (answered / 404 / unavailable), its
    ``reason`` (NULL when answered) and the ``last`` offset that its walk
    reads.

    A board answers as a whole: the first failing page among those that are
    read (status 400 or more, or a body that is not JSON) decides for all of
    it, 404 as not found and anything else as unavailable. So does a Workday
    slug that cannot address a board (not found). The aggregate reuses the
    walk's partitioning."""
    read = F.col("read")
    g = walked_pages(raw).groupBy("vendor", "slug").agg(
        F.max(F.when(read, F.col("offset"))).alias("last"), F.min(F.when(read, F.col("failed"))).alias("_f"))
    failed = F.col("_f").isNotNull()
    bad_wd = (F.col("vendor") == "workday") & workday_slug(F.col("slug")).isNull()
    outcome = (F.when(bad_wd | (failed & (F.col("_f.status") == 404)), F.lit("404"))
               .when(failed, F.lit("unavailable")).otherwise(F.lit("answered")))
    reason = (F.when(outcome == "404", F.lit(R.WARNING_404))
              .when(outcome == "unavailable", F.concat(F.lit("unavailable: "), F.col("_f.error"))))
    return g.select("vendor", "slug", outcome.alias("outcome"), reason.alias("reason"), "last")


def _answered(raw: DataFrame, vendor: str, outcomes: DataFrame | None = None) -> DataFrame:
    """The list documents of one vendor's answered boards, of a paginated
    vendor those that the walk reads (they are the first in offset order)."""
    if outcomes is None:
        outcomes = board_outcomes(raw.where(F.col("vendor") == vendor))
    good = outcomes.where((F.col("vendor") == vendor) & (F.col("outcome") == "answered")).select(
        "slug", F.col("last").alias("_last"))
    docs = raw.where((F.col("vendor") == vendor) & (F.col("kind") == "list")).join(good, "slug")
    return docs.where(F.coalesce(F.col("offset"), F.lit(0)) <= F.col("_last")) if vendor in PAGED else docs


def _postings(docs: DataFrame, postings: str, *more) -> DataFrame:
    """One row (``j``) per posting of the documents, with its place in the
    reading order of its board (``line_no``: page offset, then position), so
    that of an id listed twice the later one counts."""
    jobs = docs.select("slug", "company", *more, F.coalesce("offset", F.lit(0)).cast("bigint").alias("_offset"),
                       F.posexplode(F.coalesce(postings, F.array())).alias("_pos", "j"))
    return jobs.withColumn("line_no", F.shiftleft("_offset", 32) + F.col("_pos")).drop("_offset", "_pos")


def _details(raw: DataFrame, vendor: str) -> DataFrame:
    return raw.where((F.col("vendor") == vendor) & (F.col("kind") == "detail")
                     & (F.coalesce(F.col("http_status"), F.lit(200)) < 400))


def _finish(df: DataFrame) -> DataFrame:
    return df.select(*POSTING_COLUMNS)


# --- Ashby --------------------------------------------------------------------

def _ashby_salary(comp: Column) -> Column:
    """First Salary component, in tier then component order, with a min or max."""
    comps = F.flatten(F.transform(F.coalesce(comp["compensationTiers"], F.array()),
                                  lambda t: F.coalesce(t["components"], F.array())))
    return F.try_element_at(F.filter(comps, lambda c: (c["compensationType"] == "Salary") & (
        c["minValue"].isNotNull() | c["maxValue"].isNotNull())), F.lit(1))


def ashby_comp():
    """(comp, flags) from ``_salary`` (the structured component, annualised)
    else ``_parsed`` (the prose summary) else none."""
    salary = F.col("_salary")
    lo = annualize(salary["minValue"], salary["interval"])
    hi = annualize(salary["maxValue"], salary["interval"])
    structured = comp_struct(lo["value"], hi["value"], _or(salary["currencyCode"], F.lit("USD")),
                             F.lit("structured"))
    s_flags = F.when(lo["scaled"] | hi["scaled"], F.array(F.lit(R.FLAG_HOURLY))).otherwise(no_flags())
    p_comp, p_flags = _parsed_comp()
    has = salary.isNotNull()
    return F.when(has, structured).otherwise(p_comp), F.when(has, s_flags).otherwise(p_flags)


def norm_ashby(raw: DataFrame, rules: Rules = DEFAULT_RULES,
               outcomes: DataFrame | None = None) -> DataFrame:
    docs = _answered(raw, "ashby", outcomes).select("slug", "company", "offset", F.from_json("body", ASHBY_SCHEMA).alias("d"))
    jobs = _postings(docs, "d.jobs")
    jobs = jobs.where(F.coalesce(F.col("j.isListed"), F.lit(False)))
    c = F.col("j.compensation")
    jobs = jobs.withColumn("_salary", _ashby_salary(c))
    summary = _nonempty(_or(c["scrapeableCompensationSalarySummary"], c["compensationTierSummary"]))
    jobs = _with_parsed(jobs, F.when(F.col("_salary").isNull(), summary))
    comp, flags = ashby_comp()
    remote = F.when(F.col("j.isRemote").isNull() & (F.lower(F.coalesce("j.workplaceType", F.lit(""))) == "remote"),
                    F.lit(True)).otherwise(F.col("j.isRemote"))
    locs = F.concat(F.array(F.col("j.location")),
                    F.transform(F.coalesce("j.secondaryLocations", F.array()), lambda s: s["location"]))
    return _finish(jobs.select(
        "line_no", role_id(F.lit("ashby"), F.col("slug"), F.coalesce("j.id", F.lit(""))).alias("id"),
        F.lit("ashby").alias("source"), F.col("slug").alias("org_slug"),
        display_name(F.col("company"), F.col("slug")).alias("company_name"),
        py_strip(F.coalesce("j.title", F.lit(""))).alias("title"),
        join_locations(locs).alias("location_raw"), remote.alias("is_remote"), comp.alias("comp"),
        _or(F.col("j.jobUrl"), F.col("j.applyUrl")).alias("url"),
        parse_iso(F.col("j.publishedAt")).alias("published_at"),
        parse_iso(F.col("j.updatedAt")).alias("updated_at"),
        F.col("j.descriptionPlain").alias("description_text"), flags.alias("flags")))


# --- Lever --------------------------------------------------------------------

def lever_interval(raw: Column) -> Column:
    low = F.lower(F.coalesce(raw, F.lit("")))
    out = None
    for token, canonical in R.LEVER_INTERVAL_WORDS:
        cond = F.instr(low, token) > 0
        out = F.when(cond, F.lit(canonical)) if out is None else out.when(cond, F.lit(canonical))
    return out


def norm_lever(raw: DataFrame, rules: Rules = DEFAULT_RULES,
               outcomes: DataFrame | None = None) -> DataFrame:
    docs = _answered(raw, "lever", outcomes).select("slug", "company", "offset", F.from_json("body", LEVER_SCHEMA).alias("d"))
    jobs = _postings(docs, "d")
    sal = F.col("j.salaryRange")
    interval = lever_interval(sal["interval"])
    lo, hi = annualize(sal["min"], interval), annualize(sal["max"], interval)
    has = lo["value"].isNotNull() | hi["value"].isNotNull()
    structured = comp_struct(lo["value"], hi["value"], _or(sal["currency"], F.lit("USD")), F.lit("structured"))
    s_flags = F.when(lo["scaled"] | hi["scaled"], F.array(F.lit(R.FLAG_HOURLY))).otherwise(no_flags())
    list_texts = html_to_text_many(F.transform(F.coalesce("j.lists", F.array()), lambda i: i["content"]))
    prose = F.array_join(F.filter(F.concat(F.array(F.col("j.descriptionPlain"), F.col("j.additionalPlain")),
                                           list_texts), lambda t: F.coalesce(t, F.lit("")) != ""), "\n")
    # Prose is read only when no structured band exists; computed once.
    jobs = jobs.withColumn("_prose", F.when(~has, prose))
    jobs = _with_parsed(jobs, F.col("_prose"))
    p_comp, p_flags = _parsed_comp()
    locs = F.concat(F.array(F.col("j.categories.location")), F.coalesce("j.categories.allLocations", F.array()))
    return _finish(jobs.select(
        "line_no", role_id(F.lit("lever"), F.col("slug"), F.coalesce("j.id", F.lit(""))).alias("id"),
        F.lit("lever").alias("source"), F.col("slug").alias("org_slug"),
        display_name(F.col("company"), F.col("slug")).alias("company_name"),
        py_strip(F.coalesce("j.text", F.lit(""))).alias("title"),
        join_locations(locs).alias("location_raw"),
        F.when(F.lower(F.coalesce("j.workplaceType", F.lit(""))) == "remote", F.lit(True)).alias("is_remote"),
        F.when(has, structured).otherwise(p_comp).alias("comp"),
        _or(F.col("j.hostedUrl"), F.col("j.applyUrl")).alias("url"),
        epoch_ms(F.col("j.createdAt")).alias("published_at"),
        F.lit(None).cast("timestamp").alias("updated_at"),
        F.col("j.descriptionPlain").alias("description_text"),
        F.when(has, s_flags).otherwise(p_flags).alias("flags")))


# --- Workable -----------------------------------------------------------------

def norm_workable(raw: DataFrame, rules: Rules = DEFAULT_RULES,
                  outcomes: DataFrame | None = None) -> DataFrame:
    docs = _answered(raw, "workable", outcomes).select("slug", "company", "offset", F.from_json("body", WORKABLE_SCHEMA).alias("d"))
    # The account's name leaves the document before its postings do: read off
    # ``d`` afterwards, it would keep the whole document in every posting's
    # row, and the Python step queues whole rows.
    docs = docs.select("slug", "company", "offset", F.col("d.name").alias("acct"), F.col("d.jobs").alias("jobs"))
    jobs = _postings(docs, "jobs", "acct")
    jobs = jobs.withColumn("_desc", html_to_text(F.col("j.description")))
    jobs = _with_parsed(jobs, F.col("_desc"))
    comp, flags = _parsed_comp()
    listed = F.transform(F.coalesce("j.locations", F.array()),
                         lambda l: comma_segment(l["city"], l["region"], l["country"]))
    listed = F.array_distinct(F.filter(listed, lambda s: s != ""))
    flat = comma_segment(F.col("j.city"), F.col("j.state"), F.col("j.country"))
    loc = F.when(F.size(listed) > 0, F.array_join(listed, " | ")).otherwise(flat)
    return _finish(jobs.select(
        "line_no", role_id(F.lit("workable"), F.col("slug"), F.coalesce("j.shortcode", F.lit(""))).alias("id"),
        F.lit("workable").alias("source"), F.col("slug").alias("org_slug"),
        _or(F.col("acct"), F.col("company"), F.col("slug")).alias("company_name"),
        py_strip(F.coalesce("j.title", F.lit(""))).alias("title"),
        loc.alias("location_raw"), F.col("j.telecommuting").alias("is_remote"), comp.alias("comp"),
        _or(F.col("j.url"), F.col("j.application_url")).alias("url"),
        parse_iso(F.col("j.published_on")).alias("published_at"),
        F.lit(None).cast("timestamp").alias("updated_at"),
        F.col("_desc").alias("description_text"), flags.alias("flags")))


# --- detail enrichment (Greenhouse, SmartRecruiters, Workday) -----------------

def _enrich(listed: DataFrame, details: DataFrame, gate: Column, schema: str, extra) -> DataFrame:
    """Join gated rows to their detail document (vendor, slug, external id).
    A gated row without a usable detail keeps its list data and is flagged
    ``detail-fetch-failed``; ungated rows are untouched. Details are cut to
    the gated keys (a few percent of the postings) before any body is
    shuffled, the last fetch of a repeated one (by offset) is kept, and only
    then is its body parsed, once. ``extra(d)`` maps the parsed document to
    (description, url override, published override or None)."""
    listed = listed.withColumn("_gate", gate)
    wanted = listed.where(F.col("_gate")).select(F.col("org_slug").alias("slug"), F.col("_xid").alias("external_id"))
    d = details.join(wanted, ["slug", "external_id"], "left_semi")
    d = d.groupBy("slug", "external_id").agg(F.max_by("body", F.struct("offset", "body")).alias("body"))
    d = d.select(F.col("slug").alias("_dslug"), F.col("external_id").alias("_dxid"),
                 F.from_json("body", schema).alias("_dbody"))
    j = listed.join(
        d, (F.col("_gate")) & (F.col("org_slug") == F.col("_dslug")) & (F.col("_xid") == F.col("_dxid")), "left")
    got = F.col("_dslug").isNotNull()
    desc, url_over, pub_over = extra(F.col("_dbody"))
    j = _with_parsed(j.withColumn("_desc", F.when(got, desc)), F.col("_desc"))
    comp, flags = _parsed_comp()
    failed = F.col("_gate") & ~got
    out = (j.withColumn("description_text", F.when(got, F.col("_desc")).otherwise(F.col("description_text")))
           .withColumn("url", F.col("url") if url_over is None else F.when(
               got & (F.coalesce(url_over, F.lit("")) != ""), url_over).otherwise(F.col("url")))
           .withColumn("comp", F.when(got, comp).otherwise(F.col("comp")))
           .withColumn("flags", F.when(got, flags).when(failed, F.array(F.lit(R.FLAG_DETAIL_FAILED)))
                       .otherwise(F.col("flags"))))
    if pub_over is not None:
        out = out.withColumn("published_at", F.when(got, pub_over).otherwise(F.col("published_at")))
    return _finish(out)


def norm_greenhouse(raw: DataFrame, rules: Rules = DEFAULT_RULES,
                    outcomes: DataFrame | None = None) -> DataFrame:
    docs = _answered(raw, "greenhouse", outcomes).select("slug", "company", "offset", F.from_json("body", GREENHOUSE_SCHEMA).alias("d"))
    jobs = _postings(docs, "d.jobs")
    listed = jobs.select(
        "line_no", role_id(F.lit("greenhouse"), F.col("slug"), F.col("j.id")).alias("id"),
        F.coalesce(F.col("j.id").cast("string"), F.lit("")).alias("_xid"),
        F.lit("greenhouse").alias("source"), F.col("slug").alias("org_slug"),
        _or(F.col("j.company_name"), F.col("company"), F.col("slug")).alias("company_name"),
        py_strip(F.coalesce("j.title", F.lit(""))).alias("title"),
        py_strip(F.coalesce("j.location.name", F.lit(""))).alias("location_raw"),
        F.lit(None).cast("boolean").alias("is_remote"), no_comp().alias("comp"),
        _or(F.col("j.absolute_url")).alias("url"),
        parse_iso(F.col("j.first_published")).alias("published_at"),
        parse_iso(F.col("j.updated_at")).alias("updated_at"),
        F.lit(None).cast("string").alias("description_text"), no_flags().alias("flags"))
    gate = wants_detail(F.col("title"), F.col("location_raw"), F.col("is_remote"), rules)

    def extra(d: Column):
        return html_to_text(d["content"]), None, None
    return _enrich(listed, _details(raw, "greenhouse"), gate, GREENHOUSE_DETAIL_SCHEMA, extra)


def norm_smartrecruiters(raw: DataFrame, rules: Rules = DEFAULT_RULES,
                         outcomes: DataFrame | None = None) -> DataFrame:
    pages = _answered(raw, "smartrecruiters", outcomes).select(
        "slug", "company", "offset", F.from_json("body", SMARTRECRUITERS_SCHEMA).alias("d"))
    jobs = _postings(pages, "d.content")
    full = py_strip(F.coalesce("j.location.fullLocation", F.lit("")))
    parts = F.array_join(F.filter(F.array(*[py_strip(F.col(f"j.location.{k}")) for k in ("city", "region", "country")]),
                                  lambda p: F.coalesce(p, F.lit("")) != ""), ", ")
    ident = _or(F.col("j.company.identifier"), F.col("slug"))
    listed = jobs.select(
        "line_no", role_id(F.lit("smartrecruiters"), F.col("slug"), F.coalesce("j.id", F.lit(""))).alias("id"),
        F.coalesce("j.id", F.lit("")).alias("_xid"),
        F.lit("smartrecruiters").alias("source"), F.col("slug").alias("org_slug"),
        _or(F.col("j.company.name"), F.col("company"), F.col("slug")).alias("company_name"),
        py_strip(F.coalesce("j.name", F.lit(""))).alias("title"),
        F.when(full != "", full).otherwise(parts).alias("location_raw"),
        F.when(F.coalesce("j.location.remote", F.lit(False)), F.lit(True)).alias("is_remote"),
        no_comp().alias("comp"),
        F.concat(F.lit(R.SMARTRECRUITERS_POSTING_PREFIX), ident, F.lit("/"),
                 F.coalesce("j.id", F.lit(""))).alias("url"),
        parse_iso(F.col("j.releasedDate")).alias("published_at"),
        F.lit(None).cast("timestamp").alias("updated_at"),
        F.lit(None).cast("string").alias("description_text"), no_flags().alias("flags"))
    gate = wants_detail(F.col("title"), F.col("location_raw"), F.col("is_remote"), rules)

    def extra(d: Column):
        sections = F.array(*[d["jobAd"]["sections"][s]["text"] for s in R.SMARTRECRUITERS_SECTIONS])
        text = F.array_join(html_to_text_many(sections), "\n")
        return F.when(text != "", text), d["postingUrl"], None
    return _enrich(listed, _details(raw, "smartrecruiters"), gate, SMARTRECRUITERS_DETAIL_SCHEMA, extra)


def workday_slug(slug: Column) -> Column:
    """``tenant.wdN/site`` to struct<tenant, n, site>; NULL when malformed."""
    ok = (F.instr(slug, "/") > 0) & (F.instr(slug, ".wd") > 0)
    host = F.substring_index(slug, "/", 1)
    site = F.substring(slug, F.instr(slug, "/") + 1, F.lit(1 << 30))
    host_wd = F.instr(host, ".wd")
    tenant = F.substring(host, F.lit(1), host_wd - 1)
    n = F.substring(host, host_wd + 3, F.lit(1 << 30))
    return F.when(ok & (host_wd > 0), F.struct(tenant.alias("tenant"), n.alias("n"), site.alias("site")))


def norm_workday(raw: DataFrame, rules: Rules = DEFAULT_RULES,
                 outcomes: DataFrame | None = None) -> DataFrame:
    pages = _answered(raw, "workday", outcomes).select(
        "slug", "company", "offset", F.from_json("body", WORKDAY_SCHEMA).alias("d"))
    pages = pages.withColumn("_wd", workday_slug(F.col("slug"))).where(F.col("_wd").isNotNull())
    jobs = _postings(pages, "d.jobPostings", "_wd")
    path = F.coalesce("j.externalPath", F.lit(""))
    host = F.concat(F.lit("https://"), F.col("_wd.tenant"), F.lit(".wd"), F.col("_wd.n"),
                    F.lit(".myworkdayjobs.com"))
    rt = F.lower(py_strip(F.coalesce("j.remoteType", F.lit(""))))
    listed = jobs.select(
        "line_no", role_id(F.lit("workday"), F.col("slug"), path).alias("id"), path.alias("_xid"),
        F.lit("workday").alias("source"), F.col("slug").alias("org_slug"),
        display_name(F.col("company"), F.col("slug")).alias("company_name"),
        py_strip(F.coalesce("j.title", F.lit(""))).alias("title"),
        py_strip(F.coalesce("j.locationsText", F.lit(""))).alias("location_raw"),
        F.when(rt == "remote", F.lit(True)).when(rt == "onsite", F.lit(False)).alias("is_remote"),
        no_comp().alias("comp"),
        F.concat(host, F.lit("/"), F.col("_wd.site"), path).alias("url"),
        F.lit(None).cast("timestamp").alias("published_at"),
        F.lit(None).cast("timestamp").alias("updated_at"),
        F.lit(None).cast("string").alias("description_text"), no_flags().alias("flags"))
    # A posting with an empty path is never enriched, and so never flagged.
    gate = (F.col("_xid") != "") & wants_detail(F.col("title"), F.col("location_raw"), F.col("is_remote"), rules)

    def extra(d: Column):
        info = d["jobPostingInfo"]
        return html_to_text(info["jobDescription"]), info["externalUrl"], parse_iso(info["startDate"])
    return _enrich(listed, _details(raw, "workday"), gate, WORKDAY_DETAIL_SCHEMA, extra)


NORMALISERS = {
    "ashby": norm_ashby, "greenhouse": norm_greenhouse, "lever": norm_lever,
    "workable": norm_workable, "smartrecruiters": norm_smartrecruiters, "workday": norm_workday,
}


def all_postings(raw: DataFrame, rules: Rules = DEFAULT_RULES, outcomes: DataFrame | None = None) -> DataFrame:
    """Every vendor's rows from the boards that answered, one table. ``raw``
    is read per vendor and kind, so land it partitioned by those
    (``land_raw``); ``outcomes`` may be passed in where it is at hand."""
    out = None
    for fn in NORMALISERS.values():
        part = fn(raw, rules, outcomes)
        out = part if out is None else out.unionByName(part)
    return out


def land_raw(raw: DataFrame, path: str) -> DataFrame:
    """Write the fetched documents partitioned by (vendor, kind) and read
    them back: every later filter on those prunes to its own files."""
    raw.write.mode("overwrite").partitionBy("vendor", "kind").parquet(path)
    return raw.sparkSession.read.schema(raw.schema).parquet(path)


def scan_accounting(raw: DataFrame) -> DataFrame:
    """Per board: ``answered``, or a warning row with its reason (404: not
    found; other failure: unavailable with the error)."""
    return board_outcomes(raw).drop("last")


def probe_from_board(raw: DataFrame) -> DataFrame:
    """A vendor probe read off a board's first list page: status ok / 404 /
    error (a body that is not JSON too), posting count and the vendor's own
    company name.

    Ashby counts missing isListed as listed; SmartRecruiters reads a total
    of 0 as 404; Workday reads its total and a 422 as 404."""
    first = raw.where(F.col("kind") == "list").groupBy("vendor", "slug").agg(
        F.min_by(F.struct("http_status", "body", "error"), "offset").alias("p"))
    status = F.coalesce(F.col("p.http_status"), F.lit(200))
    body = F.col("p.body")
    unreadable = F.try_parse_json(body).isNull()
    v = F.col("vendor")
    # Each body is parsed once, with its own vendor's schema, into a column
    # (the fields below read it several times, some under higher-order
    # functions where nothing is shared).
    # Ashby jobs are kept as raw JSON text: a job without an isListed key
    # counts as listed, one with an explicit null does not, and only the
    # raw keys can tell the two apart.
    for name, vendor, schema in (("_ashby", "ashby", "struct<jobs:array<string>>"),
                                 ("_gh", "greenhouse", GREENHOUSE_SCHEMA),
                                 ("_lever", "lever", LEVER_SCHEMA), ("_wk", "workable", WORKABLE_SCHEMA),
                                 ("_sr", "smartrecruiters", SMARTRECRUITERS_SCHEMA),
                                 ("_wd", "workday", WORKDAY_SCHEMA)):
        first = first.withColumn(name, F.when(v == vendor, F.from_json(body, schema)))
    ashby = F.col("_ashby")["jobs"]
    gh = F.col("_gh")["jobs"]
    lever = F.col("_lever")
    wk = F.col("_wk")
    sr = F.col("_sr")
    wd = F.col("_wd")
    def ashby_listed(j: Column) -> Column:
        present = F.array_contains(F.json_object_keys(j), "isListed")
        return ~present | F.coalesce(F.get_json_object(j, "$.isListed") == "true", F.lit(False))
    count = (F.when(v == "ashby", F.size(F.filter(F.coalesce(ashby, F.array()), ashby_listed)))
             .when(v == "greenhouse", F.size(F.coalesce(gh, F.array())))
             .when(v == "lever", F.size(F.coalesce(lever, F.array())))
             .when(v == "workable", F.size(F.coalesce(wk["jobs"], F.array())))
             .when(v == "smartrecruiters", F.coalesce(sr["totalFound"], F.lit(0)))
             .when(v == "workday", F.coalesce(wd["total"], F.lit(0))).cast("bigint"))
    name = (F.when(v == "greenhouse", F.coalesce(F.try_element_at(F.filter(
        F.coalesce(gh, F.array()), lambda j: F.coalesce(j["company_name"], F.lit("")) != ""), F.lit(1))["company_name"],
        F.lit("")))
        .when(v == "workable", F.coalesce(wk["name"], F.lit(""))).otherwise(F.lit("")))
    not_found = ((status == 404) | ((v == "workday") & (status == 422))
                 | ((v == "workday") & workday_slug(F.col("slug")).isNull())
                 | ((status < 400) & ~unreadable & (v == "smartrecruiters") & (count == 0)))
    st = F.when(not_found, F.lit("404")).when((status >= 400) | unreadable, F.lit("error")).otherwise(F.lit("ok"))
    titles = (F.when(v == "ashby", F.transform(F.filter(F.coalesce(ashby, F.array()), ashby_listed),
                                                lambda j: F.get_json_object(j, "$.title")))
              .when(v == "greenhouse", F.transform(F.coalesce(gh, F.array()), lambda j: j["title"]))
              .when(v == "lever", F.transform(F.coalesce(lever, F.array()), lambda j: j["text"]))
              .when(v == "workable", F.transform(F.coalesce(wk["jobs"], F.array()), lambda j: j["title"]))
              .when(v == "smartrecruiters", F.transform(F.coalesce(sr["content"], F.array()), lambda j: j["name"]))
              .otherwise(F.transform(F.coalesce(wd["jobPostings"], F.array()), lambda j: j["title"])))
    sample = F.slice(F.transform(titles, lambda t: F.coalesce(t, F.lit(""))), 1, 3)
    return first.select("vendor", "slug", st.alias("status"),
                        F.when(st == "ok", count).otherwise(F.lit(0).cast("bigint")).alias("count"),
                        F.when(st == "ok", name).otherwise(F.lit("")).alias("company_name"),
                        F.when(st == "ok", sample).otherwise(F.array().cast("array<string>")).alias("sample"))
