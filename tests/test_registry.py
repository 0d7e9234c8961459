"""Board references, upsert, probes and statistics."""

import datetime as dt

from pyspark.sql import functions as F

from tests.conftest import one


def refs(spark, text):
    from hirefold.operators.registry import board_refs
    r = one(spark, board_refs(F.col("t")), t=text)
    return [(x["vendor"], x["slug"], x["board_url"]) for x in r]


def test_board_refs_order_and_cleaning(spark):
    text = ('<a href="https://jobs.lever.co/ACME/123">x</a> '
            '<script src="https://boards.greenhouse.io/embed/job_board/js?for=Acme"></script> '
            '<a href="https://boards.greenhouse.io/embed">x</a> '
            '<a href="https://jobs.ashbyhq.com/Acme%20Co.">x</a> '
            '<a href="https://acme.wd5.myworkdayjobs.com/en-US/External">x</a> '
            '<a href="https://acme.wd1.myworkdayjobs.com/wday/cxs">x</a> '
            '<a href="https://boards.greenhouse.io/acme">dup</a>')
    assert refs(spark, text) == [
        ("greenhouse", "acme", "https://boards.greenhouse.io/acme"),
        ("lever", "acme", "https://jobs.lever.co/acme"),
        ("ashby", "Acme Co", "https://jobs.ashbyhq.com/Acme Co"),
        ("workday", "acme.wd5/External", "https://acme.wd5.myworkdayjobs.com/External"),
    ]
    assert refs(spark, "no boards here") == []


def test_upsert_fills_blanks_only(spark):
    from hirefold.operators.registry import REGISTRY_COLUMNS, registry_upsert
    schema = ("company_name string, domain string, vendor string, slug string, board_url string, status string, "
              "last_verified date, last_posting_count bigint, discovered_via string, notes string")
    reg = spark.createDataFrame([("", "acme.com", "lever", "acme", "", "live", dt.date(2026, 1, 1), 5, "", "n")], schema)
    cand = spark.createDataFrame([
        ("Acme", "other.com", "lever", "acme", "https://jobs.lever.co/acme", "unverified", None, 0, "scan", "", 1),
        ("Acme 2", "", "lever", "acme", "", "unverified", None, 0, "", "", 0),
        ("New", "new.com", "ashby", "new", "https://jobs.ashbyhq.com/new", "unverified", None, 0, "scan", "", 2),
    ], schema + ", ordinal int")
    out = {r["slug"]: r for r in registry_upsert(reg, cand).collect()}
    a = out["acme"]
    assert (a["company_name"], a["domain"], a["board_url"], a["discovered_via"]) == (
        "Acme 2", "acme.com", "https://jobs.lever.co/acme", "scan")
    assert (a["status"], a["notes"], a["last_posting_count"]) == ("live", "n", 5)
    assert out["new"]["status"] == "unverified" and list(REGISTRY_COLUMNS) == list(out["new"].asDict())


def test_apply_probes_notes(spark):
    from hirefold.operators.registry import registry_apply_probes, registry_probe_counts
    schema = ("company_name string, domain string, vendor string, slug string, board_url string, status string, "
              "last_verified date, last_posting_count bigint, discovered_via string, notes string")
    reg = spark.createDataFrame([
        ("A", "", "lever", "a", "", "dead", None, 0, "", "went dead on 2026-01-01: gone"),
        ("B", "", "lever", "b", "", "live", None, 4, "", ""),
        ("C", "", "lever", "c", "", "dead", None, 0, "", "x"),
        ("D", "", "lever", "d", "", "live", None, 4, "", ""),
    ], schema)
    probes = spark.createDataFrame([
        (1, "lever", "a", dt.date(2026, 2, 1), "ok", 7, "A Inc", "7 jobs"),
        (2, "lever", "b", dt.date(2026, 2, 1), "404", 0, "", "no board at this slug"),
        (3, "lever", "c", dt.date(2026, 2, 1), "404", 0, "", "no board"),
        (4, "lever", "d", dt.date(2026, 2, 1), "error", 0, "", "timeout"),
    ], "line_no int, vendor string, slug string, probed_on date, status string, count int, company_name string, detail string")
    out = {r["slug"]: r for r in registry_apply_probes(reg, probes).collect()}
    assert out["a"]["notes"] == "went dead on 2026-01-01: gone; back from the dead on 2026-02-01 with 7 postings"
    assert (out["a"]["status"], out["a"]["company_name"], out["a"]["last_posting_count"]) == ("live", "A Inc", 7)
    assert out["b"]["notes"] == "went dead on 2026-02-01: no board at this slug"
    assert out["c"]["notes"] == "x" and out["c"]["status"] == "dead"
    assert out["d"]["status"] == "live" and out["d"]["last_verified"] is None
    c = registry_probe_counts(reg, probes).first().asDict()
    assert c == {"checked": 4, "live": 1, "dead": 2, "error": 1, "went_dead": 1, "revived": 1}


def test_board_refs_in_running_text(spark):
    """Boards of one vendor in prose, markup, JSON and query strings of one page."""
    from hirefold import rules as R
    settings = ["see {} today", "({})", "{}.", "'{}',", "{}?ref=mail&x=1", "[{}]", '{{"board":"{}"}}', "{}/"]
    for vendor in ("ashby", "lever", "workable", "smartrecruiters"):
        urls = [R.BOARD_URLS[vendor].format(slug=f"harbor{i}") for i in range(len(settings))]
        page = "\n".join(s.format(u) for s, u in zip(settings, urls)) + "\n" + urls[3]
        assert [(v, slug) for v, slug, _ in refs(spark, page)] == [(vendor, f"harbor{i}") for i in range(len(settings))], vendor


def test_board_refs_of_all_vendors_come_pattern_by_pattern(spark):
    from hirefold import rules as R
    one = {v: R.BOARD_URLS[v].format(slug="quarry") for v in ("ashby", "lever", "workable", "smartrecruiters")}
    forward, backward = (refs(spark, " | ".join(urls)) for urls in (one.values(), list(one.values())[::-1]))
    assert forward == backward and {v for v, _, _ in forward} == set(one)
    assert refs(spark, "no board here") == []
