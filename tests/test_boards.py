"""Board outcomes, long crawl pages, repeated fetches and probes."""

import json
import time

from pyspark.sql import functions as F

from tests.test_vendors import raw


def sr(offset, ids, total, status=200, body=None):
    page = json.dumps({"totalFound": total, "content": [{"id": i, "name": "GTM Engineer"} for i in ids]})
    return ("smartrecruiters", "acme", "Acme", "list", None, offset, status, "timeout" if status >= 500 else None,
            None if status >= 400 else (body or page))


def outcome(spark, rows):
    from hirefold.sources import vendors
    df = raw(spark, rows)
    got = vendors.scan_accounting(df).collect()
    assert len(got) == 1
    return got[0]["outcome"], got[0]["reason"], vendors.all_postings(df).count()


def test_a_board_answers_as_a_whole(spark):
    ok = [sr(0, "ab", 3), sr(2, "c", 3)]
    assert outcome(spark, ok) == ("answered", None, 3)
    assert outcome(spark, [ok[0], sr(2, "c", 3, 503)]) == ("unavailable", "unavailable: timeout", 0)
    assert outcome(spark, [ok[0], sr(2, "c", 3, 404)])[0::2] == ("404", 0)
    assert outcome(spark, [ok[0], sr(2, "c", 3, body="<html>")]) == ("unavailable", "unavailable: Bad JSON", 0)
    # Pages past the total are never asked for; the first page always is.
    assert outcome(spark, ok + [sr(4, "d", 3, 503)]) == ("answered", None, 3)
    assert outcome(spark, ok + [sr(4, "d", 3)]) == ("answered", None, 3)
    assert outcome(spark, [sr(0, "ab", 0)]) == ("answered", None, 2)
    assert outcome(spark, [("ashby", "acme", "", "list", None, 0, 200, None, "<html>down</html>")])[0] == "unavailable"
    assert outcome(spark, [("ashby", "acme", "", "list", None, 0, 200, None, None)])[0] == "unavailable"


def test_the_latest_total_steers_the_walk(spark):
    from hirefold.sources import vendors
    grown = [sr(0, "ab", 3), sr(2, "cd", 5), sr(4, "e", 5)]
    lost = "unavailable: timeout"
    cases = [
        (grown, ("answered", None, 5)),
        ([grown[2], grown[0], grown[1]], ("answered", None, 5)),
        # A page past the first total but below a later one is read, and so may fail.
        ([*grown[:2], sr(4, "e", 5, 503)], ("unavailable", lost, 0)),
        # The board shrank: what was received is enough.
        ([sr(0, "ab", 6), sr(2, "cd", 4), sr(4, "ef", 6, 503)], ("answered", None, 4)),
        # An empty page ends the listing, whatever the total says.
        ([sr(0, "ab", 50), sr(2, "", 50), sr(4, "ef", 50)], ("answered", None, 2)),
        ([sr(0, "", 9), sr(2, "cd", 9, 503)], ("answered", None, 0)),
    ]
    rows = [(r[0], f"b{i}", *r[2:]) for i, (pages, _) in enumerate(cases) for r in pages]

    def page(slug, offset, paths, total):
        body = json.dumps({"total": total, "jobPostings": [{"title": "GTM Engineer", "externalPath": f"/job/{p}"} for p in paths]})
        return ("workday", f"{slug}.wd5/External", "Acme", "list", None, offset, 200, None, body)
    rows += [page("c0", 0, "ab", 2), page("c0", 2, "cd", 9), page("c1", 0, "ab", 3), page("c1", 2, "cd", 5), page("c1", 4, "e", 0)]
    df = raw(spark, rows)
    outcomes = {r["slug"]: (r["outcome"], r["reason"]) for r in vendors.scan_accounting(df).collect()}
    read = vendors.norm_smartrecruiters(df).unionByName(vendors.norm_workday(df)).groupBy("org_slug").count()
    counts = dict(map(tuple, read.collect()))
    for i, (_, want) in enumerate(cases):
        assert (*outcomes[f"b{i}"], counts.get(f"b{i}", 0)) == want, i
    assert [counts[f"c{i}.wd5/External"] for i in range(2)] == [2, 5]


def test_a_walk_equals_a_loop_over_pages(spark):
    import random

    from hirefold.sources.vendors import walked_pages
    rnd, rows, want = random.Random(7), [], {}
    for b in range(60):
        pages, at = [], 0
        for _ in range(rnd.randrange(1, 7)):
            n = rnd.choice([0, 1, 2, 2, 2])
            pages.append((at, n, rnd.choice([1, 4, 6, 9, 20]), rnd.choice([200, 200, 200, 200, 503])))
            at += max(n, 1)
        received, read = 0, []
        for at, n, total, status in pages:
            read.append(at)
            received += n
            if status >= 400 or not n or received >= total:
                break
        want[f"b{b}"] = read
        for at, n, total, status in pages:
            rows.append((*sr(at, "x" * n, total, status)[:1], f"b{b}", *sr(at, "x" * n, total, status)[2:]))
    rnd.shuffle(rows)
    got = {}
    for r in walked_pages(raw(spark, rows)).where("read").orderBy("offset").collect():
        got.setdefault(r["slug"], []).append(r["offset"])
    assert got == want


def test_an_unreadable_probe_is_an_error(spark):
    from hirefold.sources.vendors import probe_from_board
    row = probe_from_board(raw(spark, [sr(0, "", 0, body="<html>")])).first()
    assert (row["status"], row["count"]) == ("error", 0)


def test_the_last_fetch_of_a_detail_counts(spark):
    from hirefold.sources.vendors import norm_greenhouse
    jobs = json.dumps({"jobs": [{"id": 1, "title": "GTM Engineer", "location": {"name": "Remote"}}]})
    rows = [("greenhouse", "acme", "Acme", "list", None, 0, 200, None, jobs)]
    for offset, text in ((1, "new"), (0, "old")):
        rows.append(("greenhouse", "acme", "Acme", "detail", "1", offset, 200, None,
                     json.dumps({"id": 1, "content": text})))
    assert [r["description_text"] for r in norm_greenhouse(raw(spark, rows)).collect()] == ["new"]


def test_a_posting_probed_twice_stays_one_row(spark):
    from hirefold.operators.funnel import liveness
    posts = spark.createDataFrame([("a", "https://x/a")], "id string, url string")
    probes = spark.createDataFrame([("a", 404, 404, None, 2), ("a", 200, None, None, 1)],
                                   "id string, head_status int, get_status int, error string, line_no int")
    assert [r["live"] for r in liveness(posts, probes).collect()] == [False]


def test_ignored_lines_join_nothing(spark):
    from hirefold.operators.registry import domains_to_scan
    lines = spark.createDataFrame([(1, ""), (2, "# https://a.com"), (3, "https://a.com/x"), (4, None),
                                   (5, "https://a.com")], "line_no long, raw string")
    reg = spark.createDataFrame([("b.com",)], "domain string")
    got = {r["line_no"]: r["action"] for r in domains_to_scan(lines, reg).collect()}
    assert got == {1: "ignored", 2: "ignored", 3: "todo", 4: "ignored", 5: "repeat"}


def test_one_long_run_does_not_stall_a_page(spark):
    from hirefold.operators.registry import board_refs
    run = "x" * 100_000
    link = "https://acme.wd5.myworkdayjobs.com/en-US/External"
    df = spark.createDataFrame([(run,), (f"{run} {link} {run}",), (f"{run}.wd5.myworkdayjobs.com/Site",)], "t string")
    refs = df.select(F.transform(board_refs(F.col("t")), lambda r: r["slug"]).alias("s"))
    refs.collect()
    began = time.time()
    got = [list(r["s"]) for r in refs.collect()]
    assert time.time() - began < 3
    assert got == [[], ["acme.wd5/External"], [run + ".wd5/Site"]]
