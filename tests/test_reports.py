"""Report details: whole-day counts, ISO week labels, dirnames, runs."""

import datetime as dt

from pyspark.sql import functions as F

D = dt.datetime


def test_days_alive_counts_whole_days(spark):
    from hirefold.operators.reports import weekly_closed_roles
    seen = spark.createDataFrame([
        ("a", "X", "T", D(2026, 1, 1, 23), D(2026, 1, 2, 1), True),     # 2 hours -> 1
        ("b", "X", "T", D(2026, 1, 1, 12), D(2026, 1, 3, 0), True),     # 1.5 days -> 1 (not 2 midnights)
        ("c", "X", "T", D(2025, 12, 20), D(2026, 1, 2), False),         # counted, not listed publicly
    ], "id string, company_name string, title string, first_seen timestamp, closed_at timestamp, public boolean")
    got = {r["id"]: (r["days_alive"], r["public"])
           for r in weekly_closed_roles(seen, F.to_date(F.lit("2026-01-04"))).collect()}
    assert got == {"a": (1, True), "b": (1, True), "c": (13, False)}


def test_week_label_iso(spark):
    from hirefold.operators.reports import week_label
    df = spark.createDataFrame([(dt.date(2027, 1, 1),), (dt.date(2026, 2, 12),), (dt.date(2024, 12, 30),)], "d date")
    assert [r[0] for r in df.select(week_label(F.col("d"))).collect()] == ["2026-W53", "2026-W07", "2025-W01"]


def test_dirname_collisions(spark):
    from hirefold.operators.reports import dirname_collisions
    orgs = spark.createDataFrame([("ashby", "acme.co"), ("ashby", "acme-co"), ("ashby", "Acme Co"),
                                  ("lever", "x")], "vendor string, slug string")
    got = {r["slug"]: r["dirname"] for r in dirname_collisions(orgs).collect()}
    # key order: "Acme Co" < "acme-co" < "acme.co"
    assert got == {"Acme Co": "ashby-acme-co", "acme-co": "ashby-acme-co-2", "acme.co": "ashby-acme-co-2-2",
                   "x": "lever-x"}


def test_latest_run_per_date_and_stats(spark):
    from hirefold.operators.reports import latest_run_per_date, weekly_report_stats
    runs = spark.createDataFrame([
        (dt.date(2026, 1, 1), 100, 5, None, 2, 10, 1),
        (dt.date(2026, 1, 1), 120, 6, 3, 3, 11, 2),      # rerun on the same night wins
        (dt.date(2026, 1, 2), 80, 4, None, 7, 12, 3),     # older record: ghosts fall back to liveness
        (dt.date(2025, 12, 20), 999, 99, 9, 9, 99, 4),    # outside the week
    ], "date date, postings_read bigint, orgs_scanned bigint, zombies bigint, liveness bigint, "
       "survivors bigint, line_no bigint")
    end = F.to_date(F.lit("2026-01-02"))
    assert latest_run_per_date(runs, end).count() == 2
    s = weekly_report_stats(runs, end).first()
    assert (s["postings_read"], s["orgs_scanned"], s["ghosts"], s["verified_live"]) == (200, 6, 10, 12)
