"""The verdict, history suppression and routing on hand-made postings."""

POSTING_SCHEMA = ("id string, source string, org_slug string, company_name string, title string, "
                  "location_raw string, is_remote boolean, "
                  "comp struct<min:bigint,max:bigint,currency:string,source:string>, url string, "
                  "published_at timestamp, updated_at timestamp, description_text string, flags array<string>")


def postings(spark, rows):
    full = []
    for r in rows:
        full.append((r["id"], "ashby", "acme", r.get("company", "Acme"), r["title"], r.get("loc", "New York"),
                     r.get("remote"), r.get("comp", (None, None, None, "none")), r.get("url", "https://x/1"),
                     None, None, r.get("desc"), r.get("flags", [])))
    return spark.createDataFrame(full, POSTING_SCHEMA)


def verdicts(spark, rows):
    from hirefold.operators.funnel import evaluate
    out = evaluate(postings(spark, rows)).select("id", "decision", "stage", "reasons", "flags").collect()
    return {r["id"]: r for r in out}


def test_title_location_comp_order(spark):
    v = verdicts(spark, [
        {"id": "a", "title": "Data Analyst"},
        {"id": "b", "title": "GTM Engineer", "loc": "Berlin"},
        {"id": "c", "title": "GTM Engineer", "comp": (90000, 110000, "USD", "structured")},
        {"id": "d", "title": "GTM Engineer", "comp": (130000, 160000, "USD", "structured")},
        {"id": "e", "title": "GTM Engineer", "comp": (100000, 160000, "USD", "structured")},
        {"id": "f", "title": "GTM Engineer"},
        {"id": "g", "title": "Growth Engineer", "loc": "Berlin", "comp": (150000, 200000, "USD", "parsed")},
    ])
    assert (v["a"]["decision"], list(v["a"]["reasons"])) == ("drop", ["title"])
    assert (v["b"]["decision"], list(v["b"]["reasons"])) == ("drop", ["location"])
    assert (v["c"]["decision"], v["c"]["stage"]) == ("drop", "comp")
    assert (v["d"]["decision"], list(v["d"]["reasons"])) == ("pass", ["band clears 125,000"])
    assert list(v["e"]["flags"]) == ["band-top-only"]
    assert list(v["f"]["flags"]) == ["comp-unknown"] and v["f"]["decision"] == "flag"
    assert list(v["g"]["flags"]) == ["title-family-flag", "location-exception-comp"]
    assert list(v["g"]["reasons"])[1] == "outside target geography, band top clears 175,000"


def test_location_drop_keeps_title_flag(spark):
    v = verdicts(spark, [{"id": "x", "title": "Growth Engineer", "loc": "Remote (EMEA)"}])
    assert v["x"]["decision"] == "drop" and list(v["x"]["flags"]) == ["title-family-flag"]


def test_shapes_quote_and_order(spark):
    desc = "We ship React and TypeScript. Quota carrying. Full-stack, 1-3 years. Our client is confidential."
    v = verdicts(spark, [{"id": "s", "title": "GTM Engineer", "desc": desc,
                          "comp": (130000, 160000, "USD", "structured"), "flags": ["comp-ote"]}])
    r = v["s"]
    assert list(r["flags"]) == ["comp-ote", "shape-swe", "shape-sales", "shape-junior", "shape-agency"]
    # phrase order, not text order: "full stack" precedes "typescript" and "react" in the pack
    assert 'shape-swe: JD says "Full-stack"' in list(r["reasons"])
    assert r["decision"] == "flag"


def test_history_suppression(spark):
    from hirefold.operators.history import apply_history
    from hirefold.operators.funnel import evaluate
    hist = spark.createDataFrame([
        (0, "Acme Labs", "applied", "GTM Engineer", "2026-07-01", "applied"),
        (1, "acme", "blacklist", None, None, "never"),
        (2, "Oakmere", "interviewing", "RevOps Engineer", "2026-07-10", None),
        (3, "Brightwell", "rejected", "", None, None),
    ], "ordinal int, company string, status string, role string, date string, reason string")
    comp = (130000, 160000, "USD", "structured")
    p = postings(spark, [
        {"id": "a", "title": "Senior GTM Engineer", "company": "TryAcme", "comp": comp},
        {"id": "i1", "title": "RevOps Engineer II", "company": "Oakmere, Inc.", "comp": comp},
        {"id": "i2", "title": "GTM Engineer", "company": "Oakmere", "comp": comp},
        {"id": "g", "title": "GTM Engineer", "company": "Brightwell", "comp": comp},
    ])
    out = {r["id"]: r for r in apply_history(evaluate(p), hist).collect()}
    assert out["a"]["suppressed_by"]["status"] == "blacklist"      # company-wide outranks file order
    assert out["i1"]["suppressed_by"]["status"] == "interviewing"  # title family match
    assert out["i2"]["suppressed_by"] is None
    assert "history-at-company" in out["i2"]["flags"]
    assert list(out["i2"]["reasons"])[-1] == "history at this company: interviewing 2026-07-10"
    assert out["g"]["suppressed_by"] is None                       # empty role never matches
    assert list(out["g"]["reasons"])[-1] == "history at this company: rejected"


def test_liveness(spark):
    from hirefold.operators.funnel import liveness
    c = spark.createDataFrame([("a", "u"), ("b", "u"), ("c", "u"), ("d", ""), ("e", "u"), ("f", "u")],
                              "id string, url string")
    probes = spark.createDataFrame([
        ("a", 200, None, None), ("b", 405, 200, None), ("c", 404, 410, None), ("d", 500, 500, None),
        ("e", None, None, "timeout")], "id string, head_status int, get_status int, error string")
    got = {r["id"]: (r["live"], r["live_method"]) for r in liveness(c, probes).collect()}
    assert got == {"a": (True, "url-probe"), "b": (True, "url-probe"), "c": (False, "url-probe"),
                   "d": (True, "board-presence"), "e": (True, "url-probe-inconclusive"),
                   "f": (True, "url-probe-inconclusive")}
