"""Input tables derived from the driver tables (Spark side).

The driver tables carry no postings, so each operator's input is derived
here by fixed integer arithmetic and list lookups (see FIXTURES.md). The
oracle SQL derives the same tables independently in DuckDB.
All derivations are narrow (no shuffle) except where a grouping is the
point (one sighting per role and night; one registry row per key).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hirefold import rules as R
from hirefold.functions.comp import comp_struct, parse_salary_prose
from hirefold.functions.text import domain_of, org_key, role_id

# FIXED VALUES of the derivation (FIXTURES.md section 3).
COMPANY_BASES = ("Harborline", "Quillon", "Fernweh", "Wealth", "Brightwell", "Oakmere",
                 "Pinecrest", "Northwind", "Contoso", "Marlowe")
TITLES = ("GTM Engineer", "Senior Go-To-Market Engineer", "RevOps Engineer",
          "Growth Engineer", "Software Engineer", "Revenue Systems Lead",
          "Account Executive", "AI GTM Strategist", "Data Analyst", "Staff Accountant")
LOCATIONS = ("New York City", "Remote - United States", "Remote (EMEA)", "Remote",
             "Austin, TX", "London | Remote, UK", "San Francisco | NYC", "Remote, Lisbon",
             "Remote, OH", "Berlin", "")
BONUS_SENTENCE = "A $7,500 signing bonus is offered."
SHAPE_SENTENCES = ("", "You will build full-stack tools.", "You will own our CI / CD setup.",
                   "You will carry a quota.", "Expect a strong OTE.",
                   "We want 1-3 years in GTM.", "We are hiring for our client.",
                   "Share status updates weekly.", "Plan the year ahead.")
PAYLOAD_INTERVALS = ("1 YEAR", "1 MONTH", "1 HOUR", None, "per-decade")
REGISTRY_STATUSES = ("live", "dead", "unverified")
PROBE_OUTCOMES = ("ok", "404", "error", "ok")
HISTORY_ROWS = (
    # ordinal, company, status, role, date, reason: every status, with and
    # without a role, over dressed and bare company names
    (0, "Marlowe HQ", "applied", "Growth Engineer", "2025-03-04", "sent through the site"),
    (1, "Northwind", "rejected", "RevOps Engineer", "2025-02-11", "position filled"),
    (2, "Oakmere", "blacklist", None, None, "pays late"),
    (3, "Contoso Labs", "dq", "Growth Engineer", "2025-04-19", "asks for relocation"),
    (4, "TryUmbrella", "interviewing", "Revenue Systems", "2025-05-23", "panel next week"),
    (5, "Brightwell.com", "rejected", None, "2025-01-30", None),
    (6, "The Quillon", "applied", "GTM Engineer", None, None),
    (7, "Wealth, Inc.", "interviewing", "AI GTM", "2025-06-02", "take-home sent"),
    (8, "Fernweh", "applied", "go-to-market engineer", "2025-06-08", "met at a fair"),
    (9, "Harborline HQ", "rejected", "Senior Go-To-Market Engineer", "2025-02-27", None),
    (10, "Northwind Labs", "blacklist", "", "2025-05-05", "not again"),
    (11, " \t ", "applied", None, None, "a blank company matches nothing"),
)


def _pick(values, index: Column) -> Column:
    arr = F.array(*[F.lit(v) for v in values])
    return F.element_at(arr, (index + 1).cast("int"))


def _read(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def _thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def description_of(orderkey: Column, status: Column, top: Column) -> Column:
    half = F.floor(top / 2)
    form = orderkey % 4
    salary = (F.when(form == 0, F.concat(F.lit("The salary range is $"), _thousands(half),
                                          F.lit(" to $"), _thousands(top), F.lit(".")))
              .when(form == 1, F.concat(F.lit("Base pay is $"), F.floor(top / 1000).cast("string"),
                                        F.lit("k per year.")))
              .when(form == 2, F.concat(F.lit("Pay is $"), F.floor(top / 2080).cast("string"),
                                        F.lit(" per hour.")))
              .otherwise(F.concat(F.lit("OTE is $"), _thousands(half), F.lit(" - $"),
                                  _thousands(top), F.lit(" USD."))))
    shape = _pick(SHAPE_SENTENCES, orderkey % 9)
    return F.concat_ws(" ", F.lit(BONUS_SENTENCE),
                       F.when(status == "F", salary),
                       F.when(shape != "", shape))


def company_of(custkey: Column) -> Column:
    base = _pick(COMPANY_BASES, custkey % 10)
    dress = custkey % 7
    return (F.when(dress == 0, base)
            .when(dress == 1, F.concat(F.lit("Try"), F.lower(base)))
            .when(dress == 2, F.concat(base, F.lit(" Labs")))
            .when(dress == 3, F.concat(base, F.lit(".com")))
            .when(dress == 4, F.concat(F.lit("The "), base))
            .when(dress == 5, F.concat(base, F.lit("HQ")))
            .otherwise(F.concat(base, F.lit(", Inc."))))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``postings`` table from ``orders``: one posting per order."""
    o = _read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus",
              "o_totalprice", "o_orderdate")
    source = _pick(R.VENDORS, o.o_custkey % 6)
    slug = F.concat(F.lit("org"), (o.o_custkey % 50).cast("string"))
    top = F.floor(o.o_totalprice).cast("bigint")
    desc = description_of(o.o_orderkey, o.o_orderstatus, top)
    df = o.select(
        role_id(source, slug, o.o_orderkey).alias("id"),
        source.alias("source"),
        slug.alias("org_slug"),
        company_of(o.o_custkey).alias("company_name"),
        _pick(TITLES, o.o_orderkey % 10).alias("title"),
        _pick(LOCATIONS, o.o_orderkey % 11).alias("location_raw"),
        F.when(o.o_orderkey % 4 == 0, F.lit(True)).when(o.o_orderkey % 4 == 1, F.lit(False))
        .alias("is_remote"),
        o.o_orderstatus.alias("_status"),
        top.alias("_top"),
        F.concat(F.lit("https://jobs.example.com/"), source, F.lit("/"), slug, F.lit("/"),
                 o.o_orderkey.cast("string")).alias("url"),
        o.o_orderdate.cast("timestamp").alias("published_at"),
        F.lit(None).cast("timestamp").alias("updated_at"),
        desc.alias("description_text"),
    )
    parsed = parse_salary_prose(F.col("description_text"))
    df = df.withColumn("_parsed", F.when(F.col("_status") == "F", parsed))
    comp = (F.when(F.col("_status") == "O",
                   comp_struct(F.floor(F.col("_top") / 2), F.col("_top"), F.lit("USD"),
                               F.lit("structured")))
            .when(F.col("_parsed").isNotNull(),
                  comp_struct(F.col("_parsed.min"), F.col("_parsed.max"),
                              F.col("_parsed.currency"), F.lit("parsed")))
            .otherwise(comp_struct(F.lit(None), F.lit(None), F.lit(None).cast("string"),
                                   F.lit("none"))))
    flags = F.coalesce(F.col("_parsed.flags"), F.array().cast("array<string>"))
    return df.select("id", "source", "org_slug", "company_name", "title", "location_raw",
                     "is_remote", comp.alias("comp"), "url", "published_at", "updated_at",
                     "description_text", flags.alias("flags"))


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (role, night) from ``events``; role = (user, event type).

    Repeats go before the strings are made: user, type and night tell the same
    rows apart as (id, run_ts), and rows without text to carry along are
    hashed, where whole rows would be sorted."""
    e = _read(spark, sf_dir, "events", "ts", "user_id", "event_type")
    e = e.select(F.to_date(e.ts).cast("timestamp").alias("run_ts"), "user_id", "event_type").distinct()
    vendor = _pick(R.VENDORS, e.user_id % 6)
    slug = F.concat(F.lit("user"), e.user_id.cast("string"))
    key = org_key(vendor, slug)
    return e.select(
        "run_ts",
        F.concat_ws(":", key, e.event_type).alias("id"),
        key.alias("org_key"),
        vendor.alias("vendor"),
        e.event_type.alias("title"),
        F.concat(F.lit("Org"), (e.user_id % 75).cast("string")).alias("company_name"),
        F.concat(F.lit("https://jobs.example.com/"), vendor, F.lit("/"), slug, F.lit("/"),
                 e.event_type).alias("url"),
    )


def board_fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which org boards answered on which night: one row per (org, night)."""
    s = sightings(spark, sf_dir)
    return s.select("run_ts", "org_key").dropDuplicates()


def run_nights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calendar of nights the pipeline ran: one row per night."""
    e = _read(spark, sf_dir, "events", "ts")
    return e.select(F.to_date("ts").cast("timestamp").alias("run_ts")).dropDuplicates()


def crawl_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawled careers pages from ``pages``, each with one planted board link."""
    p = _read(spark, sf_dir, "pages", "page_id", "url", "html")
    k = p.page_id % 12
    s = (p.page_id % 40).cast("string")
    link = (F.when(k == 0, F.concat(F.lit('<a href="https://boards.greenhouse.io/Acme'), s, F.lit('">jobs</a>')))
            .when(k == 1, F.concat(F.lit('<a href="https://job-boards.greenhouse.io/acme'), s, F.lit('/jobs/42">x</a>')))
            .when(k == 2, F.concat(F.lit('<script src="https://boards.greenhouse.io/embed/job_board/js?for=acme'), s, F.lit('"></script>')))
            .when(k == 3, F.lit('<a href="https://boards.greenhouse.io/embed">embed</a>'))
            .when(k == 4, F.concat(F.lit('<a href="https://jobs.lever.co/ACME'), s, F.lit('">lever</a>')))
            .when(k == 5, F.concat(F.lit('<a href="https://jobs.ashbyhq.com/Acme%20Co'), s, F.lit('">ashby</a>')))
            .when(k == 6, F.concat(F.lit('<a href="https://apply.workable.com/api/v3/accounts/acme'), s, F.lit('">w</a>')))
            .when(k == 7, F.concat(F.lit('<a href="https://jobs.smartrecruiters.com/Acme'), s, F.lit('">sr</a>')))
            .when(k == 8, F.concat(F.lit('<a href="https://acme'), s, F.lit('.wd5.myworkdayjobs.com/en-US/External">wd</a>')))
            .when(k == 9, F.concat(F.lit('<a href="https://acme'), s, F.lit('.wd1.myworkdayjobs.com/Careers">wd</a>'))))
    domain = domain_of(p.url)
    path = _pick(R.CANDIDATE_PATHS, p.page_id % 3)
    page_url = F.concat(F.lit("https://"), domain, path)
    return p.select(
        p.page_id,
        domain.alias("domain"),
        (p.page_id % 3).cast("int").alias("candidate_rank"),
        page_url.alias("url"),
        # Pages with no planted link redirect to a board half of the time.
        F.when((k == 10) & (p.page_id % 2 == 0), F.concat(F.lit("https://jobs.lever.co/redir"), s))
        .otherwise(page_url).alias("final_url"),
        F.when(p.page_id % 13 == 0, F.lit(404)).otherwise(F.lit(200)).alias("http_status"),
        F.concat(p.html, F.coalesce(link, F.lit(""))).alias("html"),
    )


def registry_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry lines from ``customer``; keys repeat so later lines must win."""
    c = _read(spark, sf_dir, "customer", "c_custkey", "c_name")
    vendor = _pick(R.VENDORS, c.c_custkey % 6)
    slug = F.concat(F.lit("org"), (c.c_custkey % 50).cast("string"))
    board = F.when(vendor == "workday", F.lit("")).otherwise(
        F.concat(F.lit("https://boards.example.com/"), vendor, F.lit("/"), slug))
    return c.select(
        c.c_custkey.alias("line_no"),
        F.when(c.c_custkey % 9 == 0, F.lit("")).otherwise(c.c_name).alias("company_name"),
        F.when(c.c_custkey % 11 == 0, F.lit("")).otherwise(
            F.concat(F.lit("customer"), c.c_custkey.cast("string"), F.lit(".example.com"))).alias("domain"),
        vendor.alias("vendor"),
        slug.alias("slug"),
        board.alias("board_url"),
        _pick(REGISTRY_STATUSES, c.c_custkey % 3).alias("status"),
        F.when(c.c_custkey % 5 == 0, F.lit(None).cast("date")).otherwise(
            F.date_add(F.lit("2024-01-01").cast("date"), (c.c_custkey % 30).cast("int"))).alias("last_verified"),
        (c.c_custkey % 40).alias("last_posting_count"),
        F.when(c.c_custkey % 4 == 0, F.lit("")).otherwise(F.lit("seed")).alias("discovered_via"),
        F.when(c.c_custkey % 6 == 1, F.lit("seeded by hand")).otherwise(F.lit("")).alias("notes"),
    )


def board_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One probe outcome per customer line (vendor, slug as in the registry)."""
    c = _read(spark, sf_dir, "customer", "c_custkey", "c_name")
    vendor = _pick(R.VENDORS, c.c_custkey % 6)
    slug = F.concat(F.lit("org"), (c.c_custkey % 50).cast("string"))
    outcome = _pick(PROBE_OUTCOMES, c.c_custkey % 4)
    return c.select(
        c.c_custkey.alias("line_no"),
        vendor.alias("vendor"), slug.alias("slug"),
        F.lit("2024-02-01").cast("date").alias("probed_on"),
        outcome.alias("status"),
        F.when(outcome == "ok", (c.c_custkey % 17)).otherwise(F.lit(0)).alias("count"),
        F.when(c.c_custkey % 4 == 0, F.concat(F.lit("Vendor "), c.c_name)).otherwise(F.lit("")).alias("company_name"),
        F.when(outcome == "404", F.lit("no board at this slug"))
        .when(outcome == "error", F.lit("timeout"))
        .otherwise(F.concat((c.c_custkey % 17).cast("string"), F.lit(" listed jobs"))).alias("detail"),
    )


def history(spark: SparkSession) -> DataFrame:
    """The application history: a config list, file order kept as ``ordinal``."""
    schema = "ordinal int, company string, status string, role string, date string, reason string"
    return spark.createDataFrame(list(HISTORY_ROWS), schema)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run records from ``events`` by day; every third day was run twice."""
    e = _read(spark, sf_dir, "events", "ts", "user_id", "event_type")
    day = e.groupBy(F.to_date("ts").alias("date")).agg(
        F.count("*").alias("postings_read"),
        F.countDistinct("user_id").alias("orgs_scanned"),
        F.sum(F.when(e.event_type == "error", 1).otherwise(0)).alias("zombies"),
        F.sum(F.when(e.event_type == "purchase", 1).otherwise(0)).alias("survivors"),
    )
    idx = F.datediff("date", F.lit("2024-01-01").cast("date"))
    first = day.where(idx % 3 == 0).select(
        "date", (F.col("postings_read") / 2).cast("bigint").alias("postings_read"),
        "orgs_scanned", F.lit(None).cast("bigint").alias("zombies"),
        F.col("zombies").alias("liveness"), F.lit(0).cast("bigint").alias("survivors"),
        (idx * 2).cast("bigint").alias("line_no"))
    final = day.select("date", "postings_read", "orgs_scanned", "zombies",
                       F.col("zombies").alias("liveness"), "survivors",
                       (idx * 2 + 1).cast("bigint").alias("line_no"))
    return first.unionByName(final)


def url_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of probing each posting URL (HEAD, then GET when HEAD fails)."""
    o = _read(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    k = o.o_orderkey
    source = _pick(R.VENDORS, o.o_custkey % 6)
    slug = F.concat(F.lit("org"), (o.o_custkey % 50).cast("string"))
    err = k % 29 == 0
    head = F.when(err, F.lit(None)).when(k % 17 == 0, F.lit(405)).when(k % 23 == 0, F.lit(404)) \
        .otherwise(F.lit(200))
    get = F.when(err, F.lit(None)).when(k % 17 == 0, F.when(k % 2 == 0, F.lit(200)).otherwise(F.lit(410))) \
        .when(k % 23 == 0, F.lit(404))
    return o.select(role_id(source, slug, k).alias("id"), head.cast("int").alias("head_status"),
                    get.cast("int").alias("get_status"),
                    F.when(err, F.lit("timeout")).alias("error"))


def domain_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A domain list file: page URLs (some commented out, some blank) then
    a few domains the registry already claims."""
    p = _read(spark, sf_dir, "pages", "page_id", "url")
    raw = (F.when(p.page_id % 37 == 0, F.lit(""))
           .when(p.page_id % 10 == 0, F.concat(F.lit("# "), p.url)).otherwise(p.url))
    a = p.select(p.page_id.alias("line_no"), raw.alias("raw"))
    c = _read(spark, sf_dir, "customer", "c_custkey").where(
        (F.col("c_custkey") % 7 == 0) & (F.col("c_custkey") % 11 != 0))
    b = c.select((F.lit(1_000_000_000) + c.c_custkey).alias("line_no"),
                 F.concat(F.lit("https://www.customer"), c.c_custkey.cast("string"),
                          F.lit(".example.com/about")).alias("raw"))
    return a.unionByName(b)


# --- raw vendor payloads ------------------------------------------------------
# FIXED VALUES of the payload derivation.
LEVER_INTERVALS = ("per-year-salary", "per-month-salary", "per-hour-wage", None, "per-decade")
INTERVAL_DIVISOR = (1, 12, 2080, 1, 1)
BOARD_ORDERS = 30000      # order keys per board: more orders make more boards, not longer documents
PAGE_STEP = 8             # postings a page of a paginated board
# board % 30 of paginated boards whose pages differ in what they report:
STALE_BOARDS = (4, 5)     # a total one page too low on every page, so the last page is never asked for
GROWN_BOARDS = (16, 17)   # a total that is one page ahead until the end, so every page is read
SHRUNK_BOARDS = (22, 23)  # the full total first, then one page: the walk ends after the second
EMPTY_BOARDS = (28, 29)   # the second page is empty: the walk ends there


def _json_string(c: Column) -> Column:
    """A JSON string literal for ``c`` (quoted and escaped)."""
    return F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")


def _order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
              "o_orderdate", "o_orderpriority")
    k, c = o.o_orderkey, o.o_custkey
    vendor = _pick(R.VENDORS, c % 6)
    n = c % 50
    part = F.floor(k / BOARD_ORDERS).cast("string")
    org = F.concat(F.lit("org"), n.cast("string"), F.when(part == "0", F.lit("")).otherwise(F.concat(F.lit("-"), part)))
    slug = F.when(vendor == "workday", F.concat(org, F.lit(".wd5/External"))).otherwise(org)
    top = F.floor(o.o_totalprice).cast("bigint")
    p = (F.substring(o.o_orderpriority, 1, 1).cast("int") - 1)
    board = c % 150
    return o.select(
        k.alias("k"), c.alias("c"), board.alias("board"), vendor.alias("vendor"), slug.alias("slug"),
        F.when(board % 8 == 0, F.lit("")).otherwise(company_of(board)).alias("company"),
        company_of(board).alias("real_company"),
        _pick(TITLES, k % 10).alias("title"), _pick(LOCATIONS, k % 11).alias("loc"),
        F.when(k % 4 == 0, F.lit(True)).when(k % 4 == 1, F.lit(False)).alias("remote"),
        description_of(k, o.o_orderstatus, top).alias("desc"), o.o_orderstatus.alias("status"),
        top.alias("top"), _pick(PAYLOAD_INTERVALS, p).alias("interval"),
        _pick(LEVER_INTERVALS, p).alias("lever_interval"),
        F.element_at(F.array(*[F.lit(d) for d in INTERVAL_DIVISOR]), p + 1).alias("div"),
        F.concat(F.lit("https://jobs.example.com/"), vendor, F.lit("/"), k.cast("string")).alias("url"),
        F.date_format(o.o_orderdate, "yyyy-MM-dd").alias("day"),
    )


def raw_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched vendor documents built from ``orders``: per board one list
    document, or pages of ``PAGE_STEP`` for the paginated vendors, plus one
    detail document per posting for the vendors that need one (some missing).
    A board covers ``BOARD_ORDERS`` order keys at most, so no document grows
    with the data. Planted: boards that fail on the first page (7: 404, 11:
    503, 6: a body that is not JSON) or on a later one (10: 503, 40: 404),
    pages beyond the reported total (``STALE_BOARDS``), failing ones at 34;
    totals that grow or shrink on the way, and an empty page in the middle."""
    f = _order_facts(spark, sf_dir)
    k = F.col("k")
    iso = F.concat(F.col("day"), F.lit("T00:00:00.000Z"))
    lo = (F.floor(F.col("top") / 2) / F.col("div")).cast("double")
    hi = (F.col("top") / F.col("div")).cast("double")
    html = F.concat(F.lit("<p>"), F.col("desc"), F.lit("</p>"))
    salary_component = F.struct(
        F.lit("Salary").alias("compensationType"), F.col("interval").alias("interval"),
        F.when(k % 11 == 0, F.lit("")).otherwise(F.lit("USD")).alias("currencyCode"),
        lo.alias("minValue"), hi.alias("maxValue"))
    equity = F.struct(F.lit("EquityPercentage").alias("compensationType"), F.lit(None).cast("string").alias("interval"),
                      F.lit(None).cast("string").alias("currencyCode"), F.lit(0.1).alias("minValue"),
                      F.lit(0.5).alias("maxValue"))
    ashby_job = F.struct(
        k.cast("string").alias("id"), F.col("title"), F.col("loc").alias("location"),
        F.when(k % 5 == 0, F.array(F.struct(F.lit("NYC").alias("location")),
                                   F.struct(F.col("loc").alias("location")))).alias("secondaryLocations"),
        iso.alias("publishedAt"),
        F.when(k % 23 == 0, F.lit(False)).when(k % 29 == 0, F.lit(None).cast("boolean"))
        .otherwise(F.lit(True)).alias("isListed"),
        F.col("remote").alias("isRemote"),
        F.when(k % 3 == 0, F.lit("Remote")).otherwise(F.lit("OnSite")).alias("workplaceType"),
        F.when(k % 7 == 0, F.lit("")).otherwise(F.col("url")).alias("jobUrl"),
        F.concat(F.col("url"), F.lit("/apply")).alias("applyUrl"),
        F.col("desc").alias("descriptionPlain"),
        F.struct(
            F.when(F.col("status") == "P", F.lit("$145K - $210K")).alias("compensationTierSummary"),
            F.when(F.col("status") == "F", F.col("desc")).alias("scrapeableCompensationSalarySummary"),
            F.when(F.col("status") == "O", F.array(F.struct(F.array(equity, salary_component).alias("components"))))
            .alias("compensationTiers")).alias("compensation"))
    gh_job = F.struct(
        k.alias("id"), F.col("title"),
        F.when(k % 4 == 0, F.lit("")).otherwise(F.col("real_company")).alias("company_name"),
        F.struct(F.col("loc").alias("name")).alias("location"), F.col("url").alias("absolute_url"),
        iso.alias("first_published"))
    lever_job = F.struct(
        k.cast("string").alias("id"), F.col("title").alias("text"),
        F.when(k % 3 == 0, F.lit("remote")).otherwise(F.lit("on-site")).alias("workplaceType"),
        F.when(k % 19 == 0, F.lit(0)).otherwise(F.unix_timestamp(F.to_timestamp("day")) * 1000).alias("createdAt"),
        F.col("url").alias("hostedUrl"), F.concat(F.col("url"), F.lit("/apply")).alias("applyUrl"),
        F.struct(F.col("loc").alias("location"),
                 F.when(k % 5 == 0, F.array(F.col("loc"), F.lit("NYC"))).alias("allLocations")).alias("categories"),
        F.col("desc").alias("descriptionPlain"),
        F.array(F.struct(F.lit("<li>Own the revenue stack</li>").alias("content"))).alias("lists"),
        F.when(F.col("status") == "O", F.struct(lo.alias("min"), hi.alias("max"), F.lit("USD").alias("currency"),
                                                F.col("lever_interval").alias("interval"))).alias("salaryRange"))
    wk_job = F.struct(
        F.concat(F.lit("W"), k.cast("string")).alias("shortcode"), F.col("title"),
        F.col("remote").alias("telecommuting"), F.col("url"),
        F.concat(F.col("url"), F.lit("/apply")).alias("application_url"), F.col("day").alias("published_on"),
        F.col("loc").alias("city"),
        F.when(k % 5 == 0, F.array(
            F.struct(F.lit("New York").alias("city"), F.lit("NY").alias("region"), F.lit("US").alias("country")),
            F.struct(F.lit("Austin").alias("city"), F.lit("TX").alias("region"), F.lit("US").alias("country"))))
        .alias("locations"),
        html.alias("description"))
    sr_job = F.struct(
        k.cast("string").alias("id"), F.col("title").alias("name"),
        F.struct(F.col("company").alias("name"),
                 F.when(k % 6 == 0, F.lit("")).otherwise(F.concat(F.lit("Org"), (F.col("c") % 50).cast("string")))
                 .alias("identifier")).alias("company"),
        iso.alias("releasedDate"),
        F.struct(F.coalesce(F.col("remote"), F.lit(False)).alias("remote"),
                 F.col("loc").alias("fullLocation")).alias("location"))
    wd_job = F.struct(
        F.col("title"),
        F.when(k % 31 == 0, F.lit("")).otherwise(F.concat(F.lit("/job/R"), k.cast("string"))).alias("externalPath"),
        F.col("loc").alias("locationsText"),
        F.when(F.col("remote"), F.lit("Remote")).when(~F.col("remote"), F.lit("Onsite"))
        .otherwise(F.lit("Hybrid")).alias("remoteType"))
    job = (F.when(F.col("vendor") == "ashby", F.to_json(ashby_job))
           .when(F.col("vendor") == "greenhouse", F.to_json(gh_job))
           .when(F.col("vendor") == "lever", F.to_json(lever_job))
           .when(F.col("vendor") == "workable", F.to_json(wk_job))
           .when(F.col("vendor") == "smartrecruiters", F.to_json(sr_job))
           .otherwise(F.to_json(wd_job)))
    docs = f.select("vendor", "slug", "company", "real_company", "board", "k", job.alias("job"))
    docs = docs.groupBy("vendor", "slug", "company", "real_company", "board").agg(
        F.array_sort(F.collect_list(F.struct("k", "job"))).alias("_all"))
    size = F.size("_all")
    paged = F.col("vendor").isin("smartrecruiters", "workday")
    stale = (F.col("board") % 30).isin(*STALE_BOARDS)
    grown, shrunk, hollow = ((F.col("board") % 30).isin(*x) for x in (GROWN_BOARDS, SHRUNK_BOARDS, EMPTY_BOARDS))
    docs = docs.withColumn("page", F.explode(F.sequence(F.lit(0), F.when(
        paged, F.floor((size - 1) / PAGE_STEP).cast("int")).otherwise(F.lit(0)))))
    docs = docs.withColumn("offset", F.col("page") * PAGE_STEP)
    docs = docs.withColumn("total", F.when(stale, F.greatest(size - PAGE_STEP, F.lit(1)))
                           .when(grown, F.least(size, (F.col("page") + 1) * PAGE_STEP + 1))
                           .when(shrunk & (F.col("page") > 0), F.lit(PAGE_STEP)).otherwise(size))
    docs = docs.withColumn("_jobs", F.when(paged & hollow & (F.col("page") == 1), F.slice("_all", 1, 0))
                           .when(paged, F.slice("_all", F.col("offset") + 1, F.lit(PAGE_STEP)))
                           .otherwise(F.col("_all")))
    board, later = F.col("board"), F.col("page") > 0
    docs = docs.withColumn("http_status", F.when((board == 7) | ((board == 40) & later), F.lit(404)).when(
        (board == 11) | ((board == 10) & later) | ((board == 34) & later & (F.col("offset") >= F.col("total"))),
        F.lit(503)).otherwise(F.lit(200)))
    docs = docs.withColumn("jobs", F.array_join(F.transform("_jobs", lambda x: x["job"]), ","))
    jobs = F.concat(F.lit("["), F.col("jobs"), F.lit("]"))
    v = F.col("vendor")
    acct_name = F.when(F.col("company") == "", F.lit("")).otherwise(F.col("real_company"))
    body = (F.when(v == "lever", jobs)
            .when(v == "workable", F.concat(F.lit('{"name":'), _json_string(acct_name),
                                            F.lit(',"jobs":'), jobs, F.lit("}")))
            .when(v == "smartrecruiters", F.concat(F.lit('{"totalFound":'), F.col("total").cast("string"),
                                                   F.lit(',"content":'), jobs, F.lit("}")))
            .when(v == "workday", F.concat(F.lit('{"total":'), F.col("total").cast("string"),
                                           F.lit(',"jobPostings":'), jobs, F.lit("}")))
            .otherwise(F.concat(F.lit('{"jobs":'), jobs, F.lit("}"))))
    lists = docs.select(
        "vendor", "slug", "company", F.lit("list").alias("kind"), F.lit(None).cast("string").alias("external_id"),
        "offset", "http_status",
        F.when(F.col("http_status") == 503, F.lit("timeout")).alias("error"),
        F.when(board == 6, F.lit("<html>Down for maintenance</html>"))
        .when(F.col("http_status") < 400, body).alias("body"))
    gh_detail = F.to_json(F.struct(k.alias("id"), F.concat(F.lit("&lt;p&gt;"), F.col("desc"),
                                                           F.lit("&lt;/p&gt;")).alias("content")))
    sr_detail = F.to_json(F.struct(
        k.cast("string").alias("id"),
        F.when(k % 3 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.col("url"), F.lit("?sr=1"))).alias("postingUrl"),
        F.struct(F.struct(
            F.struct(F.lit("<p>We hire for GTM.</p>").alias("text")).alias("companyDescription"),
            F.struct(html.alias("text")).alias("jobDescription"),
            F.struct(F.lit("").alias("text")).alias("qualifications")).alias("sections")).alias("jobAd")))
    wd_detail = F.to_json(F.struct(F.struct(
        html.alias("jobDescription"),
        F.when(k % 7 == 0, F.lit("soon")).otherwise(F.col("day")).alias("startDate"),
        F.concat(F.col("url"), F.lit("?wd=1")).alias("externalUrl")).alias("jobPostingInfo")))
    detail = (F.when(v == "greenhouse", gh_detail).when(v == "smartrecruiters", sr_detail)
              .when(v == "workday", wd_detail))
    xid = F.when(v == "workday", F.concat(F.lit("/job/R"), k.cast("string"))).otherwise(k.cast("string"))
    details = f.where(v.isin("greenhouse", "smartrecruiters", "workday") & (k % 13 != 0)).select(
        "vendor", "slug", "company", F.lit("detail").alias("kind"), xid.alias("external_id"),
        F.lit(0).alias("offset"), F.lit(200).alias("http_status"), F.lit(None).cast("string").alias("error"),
        detail.alias("body"))
    return lists.unionByName(details)


def pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pinned orgs from ``nation`` (config order = nation key); nations of
    region 4 are on the dead list and excluded."""
    n = _read(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey")
    return n.where(F.col("n_regionkey") != 4).select(
        F.col("n_nationkey").alias("ordinal"),
        _pick(("ashby", "greenhouse"), n.n_nationkey % 2).alias("vendor"),
        F.concat(F.lit("org"), ((n.n_nationkey * 3) % 50).cast("string")).alias("slug"),
        F.when(n.n_nationkey % 5 == 0, F.lit("")).otherwise(F.initcap(n.n_name)).alias("company"))


def registry_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry log as JSONL text, with blank, truncated, wrongly typed,
    out-of-enum and partial lines mixed in."""
    r = registry_log(spark, sf_dir)
    c = F.col("line_no")
    fields = [x for x in r.columns if x != "line_no"]
    line = F.to_json(F.struct(*fields))
    line = (F.when(c % 17 == 0, F.lit(""))
            .when(c % 7 == 0, F.substring(line, 1, 40))
            .when(c % 13 == 0, F.regexp_replace(line, '"status":"[a-z]+"', '"status":"zombie"'))
            .when(c % 19 == 0, F.regexp_replace(line, '"last_posting_count":[0-9]+', '"last_posting_count":"many"'))
            .when(c % 23 == 0, F.regexp_replace(line, ',"(notes|domain)":"[^"]*"', ""))
            .otherwise(line))
    return r.select("line_no", line.alias("line"))


def registry_log_files(spark: SparkSession, sf_dir: str, path: str) -> None:
    """The registry log as text files under ``path``, in path order: each
    folder holds twice the lines of the one before, in up to three files."""
    lines = registry_lines(spark, sf_dir).withColumn("part", F.lpad(F.floor(F.log2("line_no")).cast("string"), 2, "0"))
    (lines.repartitionByRange(3, "line_no").sortWithinPartitions("line_no")
     .select("part", "line").write.partitionBy("part").text(path))


HISTORY_DOC_CUSTOMERS = 200   # customers a history document


def history_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History documents (doc_no, doc) from ``customer``, one for each
    ``HISTORY_DOC_CUSTOMERS`` keys: structured entries, and the legacy lists,
    some of which a document lacks."""
    c = _read(spark, sf_dir, "customer", "c_custkey", "c_name")
    k = c.c_custkey
    entry = F.to_json(F.struct(
        c.c_name.alias("company"), _pick(R.HISTORY_STATUSES, k % 5).alias("status"),
        F.when(k % 3 == 0, _pick(TITLES, k % 10)).alias("role"),
        F.when(k % 7 == 0, F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (k % 90).cast("int")), "yyyy-MM-dd")).alias("date"),
        F.when(k % 11 == 0, F.lit("no fit")).alias("reason")))
    kind = (k % 6).cast("int")

    def listed(n: int, value: Column) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(kind == n, F.struct(k.alias("k"), value.alias("v"))))), lambda x: x["v"])
    g = c.groupBy(F.floor(k / HISTORY_DOC_CUSTOMERS).alias("doc_no")).agg(
        F.transform(F.array_sort(F.collect_list(F.when(kind < 2, F.struct(k.alias("k"), entry.alias("v"))))), lambda x: x["v"]).alias("history"),
        *[listed(i, c.c_name).alias(name) for i, (name, _) in enumerate(R.LEGACY_HISTORY_KEYS, 2)])
    lists = [F.concat(F.lit(f'"{name}":'), F.to_json(name)) for name, _ in R.LEGACY_HISTORY_KEYS]
    # Every third document has no structured entries, every fourth no last list.
    history = F.when(F.col("doc_no") % 3 != 2, F.concat(F.lit('"history":['), F.array_join("history", ","), F.lit("]")))
    lists[-1] = F.when(F.col("doc_no") % 4 != 1, lists[-1])
    return g.select("doc_no", F.concat(F.lit("{"), F.concat_ws(",", history, *lists), F.lit("}")).alias("doc"))
