"""The end-to-end jobs over two nights of sf0.001 payloads."""

import datetime as dt
import os
import uuid

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_two_nights_and_reports(spark):
    from hirefold.plans import jobs as P
    from hirefold.operators.registry import last_write_wins
    from hirefold.session import checkpoint_dir
    from hirefold.sources import fixtures as FX, vendors
    root = os.path.join(checkpoint_dir(spark), f"pipe-{uuid.uuid4().hex}")
    raw = FX.raw_payloads(spark, SF).cache()
    reg = last_write_wins(FX.registry_log(spark, SF)).drop("line_no")
    hist, probes = FX.history(spark), FX.url_probes(spark, SF)

    n1 = P.nightly_run(spark, raw, hist, probes, reg, root, F.lit(dt.datetime(2026, 1, 1)))
    assert n1["closed"].count() == 0                      # first run closes nothing it reports
    routed1 = n1["routed"]
    assert routed1.count() == vendors.all_postings(raw).count()
    assert routed1.where("route = 'still_open'").count() == 0   # everything is new on night one

    # Night two: every lever board answers empty, every greenhouse board fails
    # and every workday board loses its later pages to an error.
    lists = F.col("kind") == "list"
    later = lists & (F.col("vendor") == "workday") & (F.col("offset") > 0)
    down = (lists & (F.col("vendor") == "greenhouse")) | later
    raw2 = (raw.withColumn("body", F.when(lists & (F.col("vendor") == "lever"), F.lit("[]"))
                           .when(~down, F.col("body")))
            .withColumn("http_status", F.when(down, F.lit(503)).otherwise(F.col("http_status"))))
    n2 = P.nightly_run(spark, raw2, hist, probes, reg, root, F.lit(dt.datetime(2026, 1, 2)))
    ids1 = vendors.all_postings(raw).select("id", F.concat_ws(":", "source", "org_slug").alias("org_key"))
    ids2 = vendors.all_postings(raw2).select("id")
    answered2 = vendors.scan_accounting(raw2).where("outcome = 'answered'").select(
        F.concat_ws(":", "vendor", "slug").alias("org_key"))
    expect = ids1.join(ids2, "id", "left_anti").join(answered2, "org_key", "left_semi").count()
    assert expect == ids1.where("org_key LIKE 'lever:%'").count() > 0 and n2["closed"].count() == expect
    lost = ids1.where("org_key LIKE 'greenhouse:%' OR org_key LIKE 'workday:%'").join(ids2, "id", "left_anti").count()
    assert lost > 0                                       # gone from view, and not closed
    assert n2["routed"].where("route = 'kept' OR route = 'flagged'").count() == 0   # nothing new

    runs = P.read_runs(spark, root)
    assert runs.count() == 2
    week = P.weekly_report(spark, root, F.to_date(F.lit("2026-01-02")))
    assert week["stats"].first()["postings_read"] == runs.agg(F.sum("postings_read")).first()[0]
    board = P.board_report(spark, root, F.lit(dt.datetime(2026, 1, 2)))
    assert board["stats"].first()["closed_this_week"] == board["closed"].count() > 0

    # Registry upkeep: seed, add domains from crawled pages, verify with probes.
    from hirefold.sources import stores
    stores.write_store(reg, os.path.join(root, "registry"), sort_keys=("vendor", "slug"))
    counts = P.add_domains(spark, FX.domain_lines(spark, SF), FX.crawl_pages(spark, SF), root, "list").first()
    assert counts["scanned"] > 0 and counts["orgs_found"] > 0
    v = P.verify_registry(spark, FX.board_probes(spark, SF), root, limit=10).first()
    assert v["checked"] <= 10
    pages = P.pages_report(spark, root, F.to_date(F.lit("2026-01-02")))
    assert pages["totals"].first()["hiring_count"] + pages["totals"].first()["quiet_count"] == pages["pages"].count()
