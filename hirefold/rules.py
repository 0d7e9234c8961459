"""Rule values: the filter configuration, pay tables and fixed texts.

A ``Rules`` object is plain data. Operators turn it into literal Spark
expressions once, on the driver, so every pattern is a constant the executors
compile once per task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# FIXED VALUES. These must equal the behaviour being matched, so they are
# stated plainly and in their natural order.
# ---------------------------------------------------------------------------

VENDORS = ("ashby", "greenhouse", "lever", "workable", "smartrecruiters", "workday")

# Pay interval multipliers (to a yearly figure) and hours in a working year.
HOURS_PER_YEAR = 2080
INTERVAL_MULTIPLIER = {
    "1 YEAR": 1,
    "1 MONTH": 12,
    "1 WEEK": 52,
    "1 DAY": 260,
    "1 HOUR": HOURS_PER_YEAR,
}

# A prose sentence must contain one of these (substring, lower case) before
# its dollar amounts count as pay.
SALARY_KEYWORDS = (
    "salary", "base pay", "base compensation", "compensation", "pay range",
    "pay band", "ote", "on-target", "on target", "annual", "per hour", "hourly",
    "per year",
)
OTE_KEYWORDS = ("ote", "on-target", "on target")
HOURLY_KEYWORDS = ("per hour", "/hour", "/hr", "hourly", "an hour")
MONEY_PATTERN = r"\$\s*(\d[\d,]*(?:\.\d+)?)\s*([kK])?"
CURRENCY_CODES = ("USD", "CAD", "EUR", "GBP")

# Lever interval words, tried in this order by substring.
LEVER_INTERVAL_WORDS = (
    ("hour", "1 HOUR"), ("day", "1 DAY"), ("week", "1 WEEK"),
    ("month", "1 MONTH"), ("year", "1 YEAR"),
)

# Company-name costume: branding suffix tokens and domain prefix tokens, and
# the shortest stem a glued prefix/suffix may leave behind.
COMPANY_SUFFIX_TOKENS = ("inc", "labs", "hq", "com", "ai", "app", "io", "co")
COMPANY_PREFIX_TOKENS = ("try", "get", "join", "use", "hey", "the")
MIN_STEM = 4

HISTORY_STATUSES = ("applied", "interviewing", "rejected", "dq", "blacklist")
COMPANY_WIDE_STATUSES = ("dq", "blacklist")
LEGACY_HISTORY_KEYS = (
    ("applied", "applied"), ("interviewing", "interviewing"),
    ("rejected", "rejected"), ("blacklist_companies", "blacklist"),
)

# Public store retention of closed rows, and the report week.
CLOSED_RETENTION_DAYS = 7
WEEK_DAYS = 7

VENDOR_LABELS = {
    "ashby": "Ashby", "greenhouse": "Greenhouse", "lever": "Lever",
    "workable": "Workable", "smartrecruiters": "SmartRecruiters", "workday": "Workday",
}

# Flag names, in the order the funnel can add them.
FLAG_TITLE_FAMILY = "title-family-flag"
FLAG_LOCATION_EXCEPTION = "location-exception-comp"
FLAG_REMOTE_UNVERIFIED = "remote-geo-unverified"
FLAG_COMP_UNKNOWN = "comp-unknown"
FLAG_BAND_TOP_ONLY = "band-top-only"
FLAG_HOURLY = "comp-hourly-annualized"
FLAG_OTE = "comp-ote"
FLAG_SINGLE_VALUE = "comp-single-value"
FLAG_DETAIL_FAILED = "detail-fetch-failed"
FLAG_HISTORY = "history-at-company"

# Verdict reason texts ({n} is a number with thousands separators).
REASON_TITLE_FLAG = "adjacent title family, surfaced not trusted"
REASON_LOCATION_EXCEPTION = "outside target geography, band top clears {n}"
REASON_REMOTE_UNVERIFIED = "remote with no US signal in the location"
REASON_COMP_UNKNOWN = "no band published, worth a look anyway"
REASON_BAND_CLEARS = "band clears {n}"
REASON_BAND_TOP_ONLY = "only the top of the band clears {n}"

# Board discovery: vendor board URL shapes, slug class, junk path words and
# the vendors whose slugs are case-insensitive.
BOARD_URLS = {
    "ashby": "https://jobs.ashbyhq.com/{slug}",
    "greenhouse": "https://boards.greenhouse.io/{slug}",
    "lever": "https://jobs.lever.co/{slug}",
    "workable": "https://apply.workable.com/{slug}",
    "smartrecruiters": "https://jobs.smartrecruiters.com/{slug}",
}
SLUG_CLASS = r"([A-Za-z0-9][A-Za-z0-9_.%-]*)"
BOARD_PATTERNS = (
    ("greenhouse", r"greenhouse\.io/embed/job_board(?:/js)?\?[^\"'\s<>]*?for=" + SLUG_CLASS),
    ("greenhouse", r"(?:job-boards|boards)\.(?:eu\.)?greenhouse\.io/" + SLUG_CLASS),
    ("greenhouse", r"boards-api\.greenhouse\.io/v1/boards/" + SLUG_CLASS),
    ("lever", r"jobs\.(?:eu\.)?lever\.co/" + SLUG_CLASS),
    ("ashby", r"jobs\.ashbyhq\.com/" + SLUG_CLASS),
    ("ashby", r"api\.ashbyhq\.com/posting-api/job-board/" + SLUG_CLASS),
    ("workable", r"apply\.workable\.com/(?:api/v\d+/accounts/)?" + SLUG_CLASS),
    ("smartrecruiters", r"jobs\.smartrecruiters\.com/(?:sr-jobs/)?" + SLUG_CLASS),
    ("smartrecruiters", r"api\.smartrecruiters\.com/v1/companies/" + SLUG_CLASS),
)
# Text that each pattern above, in order, cannot match without.
BOARD_HOSTS = (
    "greenhouse.io/embed/job_board", "greenhouse.io/", "boards-api.greenhouse.io/v1/boards/", "lever.co/",
    "jobs.ashbyhq.com/", "api.ashbyhq.com/posting-api/", "apply.workable.com/", "jobs.smartrecruiters.com/",
    "api.smartrecruiters.com/v1/companies/",
)
WORKDAY_HOST = ".myworkdayjobs.com/"
WORKDAY_PATTERN = (
    r"([a-z0-9-]+)\.wd(\d{1,2})\.myworkdayjobs\.com/(?:([a-z]{2,3}(?:-[A-Za-z]{2,4})?)/)?"
    + SLUG_CLASS
)
JUNK_SLUGS = {
    "greenhouse": ("embed", "js", "v1", "boards", "generic", "error", "img", "static"),
    "lever": ("login", "postings", "img"),
    "ashby": ("api", "posting-api", "embed", "non-user-facing"),
    "workable": ("api", "j", "jobs", "en", "backend", "assets"),
    "smartrecruiters": ("api", "sr-jobs", "job", "jobs", "img", "static"),
}
LOWERCASE_SLUG_VENDORS = ("greenhouse", "lever", "workable")
CANDIDATE_PATHS = ("/careers", "/jobs", "/")
NO_MATCH_NOTE = "no known ATS pattern on the careers page"
BAD_JSON = "Bad JSON"
WARNING_404 = "404, board not found. Slug is wrong or the org left this ATS."

# SmartRecruiters jobAd sections, in reading order.
SMARTRECRUITERS_SECTIONS = (
    "companyDescription", "jobDescription", "qualifications", "additionalInformation",
)
SMARTRECRUITERS_POSTING_PREFIX = "https://jobs.smartrecruiters.com/"

# Public site addresses used in sitemap rows.
SITE_BASE_URL = "https://example.org/board"
DIGEST_TOP_SUPPRESSED = 15


# ---------------------------------------------------------------------------
# The example filter configuration (title families, location rules, comp
# floor, shape packs). Fixed values, in their published order.
# ---------------------------------------------------------------------------

EXAMPLE_INCLUDE = (
    "gtm engineer", "gtm engineering", "go-to-market engineer", "gtm systems",
    "revops engineer", "revenue operations engineer", "revops architect",
    "revenue operations architect", "ai gtm", "gtm ai", "revenue systems",
)
EXAMPLE_FLAG = ("growth engineer",)
EXAMPLE_NYC_TOKENS = ("new york", "nyc", "brooklyn", "manhattan")
EXAMPLE_EXCLUDE_REGIONS = ("emea", "europe", "apac", "uk", "canada", "latam", "india")
EXAMPLE_US_SIGNALS = (
    "united states", "usa", "u.s.", "us", "america",
    "san francisco", "austin", "chicago", "seattle", "boston", "denver", "atlanta",
    "los angeles", "miami", "salt lake city", "washington dc",
)
EXAMPLE_US_STATES = (
    "al", "ak", "az", "ar", "ca", "co", "ct", "de", "fl", "ga", "hi", "id", "il", "in",
    "ia", "ks", "ky", "la", "ma", "md", "me", "mi", "mn", "mo", "ms", "mt", "nc", "nd",
    "ne", "nh", "nj", "nm", "nv", "ny", "oh", "ok", "or", "pa", "ri", "sc", "sd", "tn",
    "tx", "ut", "va", "vt", "wa", "wi", "wv", "wy", "dc",
)
EXAMPLE_EXCEPTION_USD = 175000
EXAMPLE_FLOOR_USD = 125000
EXAMPLE_SHAPES = (
    ("shape-swe", (
        "software engineer", "full stack", "frontend", "front end", "backend", "back end",
        "typescript", "apex", "lightning web components", "lwc", "ci/cd", "production code",
        "code review", "code reviews", "langgraph", "react", "next.js", "nextjs",
        "a/b test", "a/b tests", "a/b testing", "computer science degree",
        "degree in computer science", "bs in computer science",
    )),
    ("shape-sales", (
        "quota", "quotas", "closing experience", "pipeline generation", "cold call",
        "cold calls", "cold calling", "ae", "bdr", "sdr", "account executive",
        "business development representative", "sales development representative",
        "uncapped commission", "commission-based", "ote", "on-target earnings",
    )),
    ("shape-junior", (
        "1-3 years", "1 to 3 years", "0-2 years", "1-2 years", "2-3 years", "early career",
        "entry level", "associate", "junior", "new grad", "recent graduate",
    )),
    ("shape-agency", (
        "staffing", "our client", "recruiting firm", "recruitment agency",
        "recruiting agency", "search firm", "executive search", "talent agency",
        "confidential company", "company confidential", "confidential client",
    )),
)


@dataclass(frozen=True)
class Rules:
    """The filter configuration one run applies."""

    include: tuple[str, ...] = EXAMPLE_INCLUDE
    flag: tuple[str, ...] = EXAMPLE_FLAG
    nyc_tokens: tuple[str, ...] = EXAMPLE_NYC_TOKENS
    allow_remote_us: bool = True
    exclude_regions: tuple[str, ...] = EXAMPLE_EXCLUDE_REGIONS
    us_signals: tuple[str, ...] = EXAMPLE_US_SIGNALS
    us_states: tuple[str, ...] = EXAMPLE_US_STATES
    exception_usd: int | None = EXAMPLE_EXCEPTION_USD
    floor_usd: int = EXAMPLE_FLOOR_USD
    shapes: tuple[tuple[str, tuple[str, ...]], ...] = field(default=EXAMPLE_SHAPES)


DEFAULT_RULES = Rules()
