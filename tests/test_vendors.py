"""Vendor payloads to postings, on small hand-written documents."""

import json

RAW = ("vendor string, slug string, company string, kind string, external_id string, offset int, "
       "http_status int, error string, body string")


def raw(spark, rows):
    return spark.createDataFrame(rows, RAW)


def by_id(df):
    return {r["id"]: r for r in df.collect()}


def test_ashby_listing_comp_and_remote(spark):
    from hirefold.sources.vendors import norm_ashby
    jobs = [
        {"id": "1", "title": " GTM Engineer ", "location": "New York", "isListed": True,
         "secondaryLocations": [{"location": "Remote"}, {"location": "New York"}, {"location": " "}],
         "workplaceType": "Remote", "jobUrl": "", "applyUrl": "https://a/1/apply",
         "publishedAt": "2026-07-01T12:00:00.000Z",
         "compensation": {"compensationTiers": [
             {"components": [{"compensationType": "EquityPercentage", "minValue": 0.1, "maxValue": 0.2}]},
             {"components": [{"compensationType": "Salary", "interval": "1 HOUR", "currencyCode": None,
                              "minValue": 60, "maxValue": 80}]}]}},
        {"id": "2", "title": "Hidden", "isListed": False},
        {"id": "3", "title": "No flag", "location": "Remote"},
        {"id": "4", "title": "Prose", "isListed": True, "isRemote": False, "workplaceType": "Remote",
         "compensation": {"scrapeableCompensationSalarySummary": "",
                          "compensationTierSummary": "Salary: $150K - $180K"}},
    ]
    df = norm_ashby(raw(spark, [("ashby", "acme", "Acme", "list", None, 0, 200, None, json.dumps({"jobs": jobs}))]))
    out = by_id(df)
    assert set(out) == {"ashby:acme:1", "ashby:acme:4"}
    a = out["ashby:acme:1"]
    assert (a["title"], a["location_raw"], a["is_remote"], a["url"]) == (
        "GTM Engineer", "New York | Remote", True, "https://a/1/apply")
    assert (a["comp"]["min"], a["comp"]["max"], a["comp"]["currency"], a["comp"]["source"]) == (
        124800, 166400, "USD", "structured")
    assert list(a["flags"]) == ["comp-hourly-annualized"]
    assert a["published_at"].isoformat() == "2026-07-01T12:00:00"
    p = out["ashby:acme:4"]
    assert p["is_remote"] is False and (p["comp"]["min"], p["comp"]["source"]) == (150000, "parsed")


def test_lever_intervals_and_prose(spark):
    from hirefold.sources.vendors import norm_lever
    jobs = [
        {"id": "a", "text": "RevOps Engineer", "workplaceType": "remote", "createdAt": 1767225600000,
         "categories": {"location": "Austin", "allLocations": ["Austin", "NYC"]},
         "salaryRange": {"min": 10000, "max": 12000, "currency": None, "interval": "per-month-salary"}},
        {"id": "b", "text": "GTM Engineer", "workplaceType": "onsite", "createdAt": 0,
         "descriptionPlain": "We build things.", "additionalPlain": None,
         "lists": [{"content": "<li>Salary &amp; equity: $140,000 - $170,000</li>"}]},
    ]
    df = norm_lever(raw(spark, [("lever", "acme", "", "list", None, 0, 200, None, json.dumps(jobs))]))
    out = by_id(df)
    a, b = out["lever:acme:a"], out["lever:acme:b"]
    assert (a["company_name"], a["location_raw"], a["is_remote"]) == ("acme", "Austin | NYC", True)
    assert (a["comp"]["min"], a["comp"]["max"], a["comp"]["currency"]) == (120000, 144000, "USD")
    assert list(a["flags"]) == ["comp-hourly-annualized"]
    assert b["is_remote"] is None and b["published_at"] is None
    assert (b["comp"]["min"], b["comp"]["max"], b["comp"]["source"]) == (140000, 170000, "parsed")
    assert b["description_text"] == "We build things."


def test_workable_locations(spark):
    from hirefold.sources.vendors import norm_workable
    doc = {"name": "", "jobs": [
        {"shortcode": "X1", "title": "GTM Engineer", "telecommuting": None, "city": "Austin", "state": " TX ",
         "country": "US", "locations": [], "description": "<p>Base pay $150,000 to $170,000.</p>",
         "published_on": "2026-06-30"},
        {"shortcode": "X2", "title": "GTM Engineer", "city": "Austin",
         "locations": [{"city": "Berlin", "region": None, "country": "DE"}, {"city": "Berlin", "country": "DE"}]},
    ]}
    out = by_id(norm_workable(raw(spark, [("workable", "acme", "Acme Co", "list", None, 0, 200, None,
                                           json.dumps(doc))])))
    assert out["workable:acme:X1"]["location_raw"] == "Austin, TX, US"
    assert out["workable:acme:X1"]["company_name"] == "Acme Co"
    assert out["workable:acme:X1"]["comp"]["max"] == 170000
    assert out["workable:acme:X2"]["location_raw"] == "Berlin, DE"


def python_step_types(df):
    """The column types of the rows that pass each Python step of a plan."""
    def steps(plan):
        kids = plan.children()
        own = [plan] if plan.nodeName() == "ArrowEvalPython" else []
        return own + [x for i in range(kids.size()) for x in steps(kids.apply(i))]
    return [[x.output().apply(i).dataType().catalogString() for i in range(x.output().size())]
            for x in steps(df._jdf.queryExecution().optimizedPlan())]


def workable_board(spark):
    jobs = [{"shortcode": f"X{i}", "title": "GTM Engineer", "description": f"<p>A &amp; B {i}</p>"} for i in range(3)]
    return raw(spark, [("workable", "acme", "Acme Co", "list", None, 0, 200, None,
                        json.dumps({"name": "Acme Account", "jobs": jobs}))])


def test_workable_posting_does_not_carry_its_document(spark):
    from hirefold.sources.vendors import norm_workable
    df = norm_workable(workable_board(spark))
    types = python_step_types(df)
    assert types and not [t for step in types for t in step if "array<struct<shortcode" in t]
    assert {(r["id"], r["company_name"], r["description_text"]) for r in df.collect()} == {
        (f"workable:acme:X{i}", "Acme Account", f"A & B {i}") for i in range(3)}


def test_all_postings_do_not_carry_their_documents(spark):
    from hirefold.sources.vendors import all_postings
    df = all_postings(workable_board(spark))
    types = python_step_types(df)
    assert types and not [t for step in types for t in step if "array<struct<shortcode" in t]
    assert sorted(r["company_name"] for r in df.collect()) == ["Acme Account"] * 3


def test_smartrecruiters_pages_and_detail(spark):
    from hirefold.sources.vendors import norm_smartrecruiters
    def page(offset, ids):
        return ("smartrecruiters", "acme", "Acme", "list", None, offset, 200, None, json.dumps({
            "totalFound": 2, "content": [{"id": i, "name": "GTM Engineer", "company": {"identifier": ""},
                                          "location": {"city": "Austin", "region": "TX", "remote": True}}
                                         for i in ids]}))
    detail = ("smartrecruiters", "acme", "Acme", "detail", "p1", 0, 200, None, json.dumps({
        "postingUrl": "https://sr/p1", "jobAd": {"sections": {
            "companyDescription": {"text": "<p>We are a staffing firm.</p>"},
            "jobDescription": {"text": "<p>Salary $150,000 to $160,000.</p>"},
            "qualifications": {"text": ""}}}}))
    df = norm_smartrecruiters(raw(spark, [page(0, ["p1"]), page(1, ["p2"]), page(100, ["stale"]), detail]))
    out = by_id(df)
    assert set(out) == {"smartrecruiters:acme:p1", "smartrecruiters:acme:p2"}
    p1, p2 = out["smartrecruiters:acme:p1"], out["smartrecruiters:acme:p2"]
    assert p1["url"] == "https://sr/p1" and p1["description_text"] == "We are a staffing firm.\nSalary $150,000 to $160,000."
    assert p1["location_raw"] == "Austin, TX" and p1["is_remote"] is True
    assert p2["url"] == "https://jobs.smartrecruiters.com/acme/p2" and list(p2["flags"]) == ["detail-fetch-failed"]


def test_workday_enrichment_rules(spark):
    from hirefold.sources.vendors import norm_workday, scan_accounting
    page = ("workday", "acme.wd5/Ext", "", "list", None, 0, 200, None, json.dumps({"total": 3, "jobPostings": [
        {"title": "GTM Engineer", "externalPath": "/job/1", "locationsText": "NYC", "remoteType": "Onsite"},
        {"title": "GTM Engineer", "externalPath": "", "locationsText": "NYC", "remoteType": "Hybrid"},
        {"title": "Accountant", "externalPath": "/job/3", "locationsText": "NYC", "remoteType": " remote "}]}))
    det = ("workday", "acme.wd5/Ext", "", "detail", "/job/1", 0, 200, None, json.dumps({"jobPostingInfo": {
        "jobDescription": "<p>Hi</p>", "startDate": "not a date", "externalUrl": "https://wd/1"}}))
    bad = ("workday", "not-a-workday-slug", "", "list", None, 0, 200, None, json.dumps({"total": 1, "jobPostings": []}))
    r = raw(spark, [page, det, bad])
    out = by_id(norm_workday(r))
    assert set(out) == {"workday:acme.wd5/Ext:/job/1", "workday:acme.wd5/Ext:", "workday:acme.wd5/Ext:/job/3"}
    one = out["workday:acme.wd5/Ext:/job/1"]
    assert (one["url"], one["published_at"], one["is_remote"], one["description_text"]) == (
        "https://wd/1", None, False, "Hi")
    empty = out["workday:acme.wd5/Ext:"]
    assert list(empty["flags"]) == [] and empty["is_remote"] is None            # never enriched or flagged
    assert out["workday:acme.wd5/Ext:/job/3"]["is_remote"] is True
    assert out["workday:acme.wd5/Ext:/job/3"]["url"] == "https://acme.wd5.myworkdayjobs.com/Ext/job/3"
    scans = {r["slug"]: r["outcome"] for r in scan_accounting(r).collect()}
    assert scans == {"acme.wd5/Ext": "answered", "not-a-workday-slug": "404"}


def test_ashby_probe_counts_missing_is_listed_only(spark):
    from hirefold.sources.vendors import probe_from_board
    jobs = [{"id": "1", "title": "A", "isListed": True}, {"id": "2", "title": "B"},
            {"id": "3", "title": "C", "isListed": None}, {"id": "4", "title": "D", "isListed": False}]
    r = probe_from_board(raw(spark, [("ashby", "acme", "", "list", None, 0, 200, None,
                                      json.dumps({"jobs": jobs}))])).first()
    assert (r["status"], r["count"], list(r["sample"])) == ("ok", 2, ["A", "B"])


def test_later_listing_of_an_id_counts(spark):
    from hirefold.operators import state
    from hirefold.sources.vendors import norm_lever, norm_smartrecruiters
    page = lambda at, jobs: ("smartrecruiters", "acme", "", "list", None, at, 200, None, json.dumps({
        "totalFound": 4, "content": [{"id": i, "name": n} for i, n in jobs]}))
    pages = [page(2, [("y", "late"), ("x", "latest")]), page(0, [("x", "first"), ("x", "second")])]
    lever = ("lever", "acme", "", "list", None, 0, 200, None, json.dumps(
        [{"id": "z", "text": t} for t in ("one", "two", "three")]))
    r = raw(spark, [*pages, lever])
    every = norm_smartrecruiters(r).unionByName(norm_lever(r))
    tonight = every.repartition(5).selectExpr("id", "source || ':' || org_slug org_key", "title", "company_name", "url", "line_no")
    seen = "id string, org_key string, title string, company_name string, url string, first_seen timestamp, " \
           "last_seen timestamp, closed_at timestamp, public boolean, comp_band string, location string"
    from pyspark.sql import functions as F
    out = state.seen_reconcile(spark.createDataFrame([], seen), tonight, tonight.select("org_key"),
                               F.lit("2026-01-01").cast("timestamp"))
    assert {x["id"].rsplit(":", 1)[1]: x["title"] for x in out.collect()} == {"x": "latest", "y": "late", "z": "three"}
    # The rows of the public store carry the order too.
    assert "line_no" in state.public_rows_from_postings(every).columns
