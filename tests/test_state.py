"""Seen store and public store folds, mirrors, the one-pass history."""

import datetime as dt

from pyspark.sql import functions as F

SEEN = ("id string, org_key string, title string, company_name string, url string, first_seen timestamp, "
        "last_seen timestamp, closed_at timestamp, public boolean, comp_band string, location string")
D = dt.datetime


def test_seen_reconcile_rules(spark):
    from hirefold.operators.state import seen_reconcile
    store = spark.createDataFrame([
        ("a", "ashby:x", "T", "X", "u", D(2026, 1, 1), D(2026, 1, 1), None, False, "", ""),
        ("b", "ashby:x", "T", "X", "u", D(2026, 1, 1), D(2026, 1, 1), None, False, "", ""),
        ("c", "ashby:y", "T", "Y", "u", D(2026, 1, 1), D(2026, 1, 1), None, False, "", ""),
        ("d", "ashby:x", "T", "X", "u", D(2026, 1, 1), D(2026, 1, 1), D(2026, 1, 2), False, "", ""),
    ], SEEN)
    tonight = spark.createDataFrame([
        ("a", "ashby:x", "New T", "X2", ""), ("d", "ashby:x", "", "X", "u2"), ("n", "ashby:x", "N", "X", "u"),
        ("n", "ashby:x", "N2", "X", "u"),
    ], "id string, org_key string, title string, company_name string, url string") \
        .withColumn("line_no", F.monotonically_increasing_id())
    now = F.lit(D(2026, 1, 3))
    out = {r["id"]: r for r in seen_reconcile(store, tonight, tonight.select("org_key"), now).collect()}
    assert out["a"]["title"] == "New T" and out["a"]["url"] == "u" and out["a"]["company_name"] == "X"
    assert out["b"]["closed_now"] and out["b"]["closed_at"] == D(2026, 1, 3)
    assert out["c"]["closed_at"] is None and not out["c"]["closed_now"]        # org silent
    assert out["d"]["closed_at"] is None and out["d"]["title"] == "T"          # resurrection
    assert out["n"]["is_new"] and out["n"]["title"] == "N2"                    # one row per id, later wins
    assert len(out) == 5


def test_public_retention(spark):
    from hirefold.operators.state import empty_public_store, public_reconcile
    base = empty_public_store(spark)
    rows = [("old", D(2026, 1, 1)), ("week", D(2026, 1, 2))]
    store = base.unionByName(spark.createDataFrame([
        (i, "ashby", "ashby:x", "X", "T " + i, "", "", False, "u", None, D(2025, 12, 1), D(2025, 12, 31),
         D(2025, 12, 31), c, None) for i, c in rows], base.schema))
    tonight = spark.createDataFrame([], "id string, vendor string, org_key string, company string, title string, "
                                        "comp_band string, location string, remote boolean, url string, posted_at timestamp")
    out = public_reconcile(store, tonight, spark.createDataFrame([("ashby:x",)], "org_key string"),
                           F.lit(D(2026, 1, 9))).collect()
    assert [r["id"] for r in out] == ["week"]   # 8 days closed is gone, 7 days stays


def test_mirror_collapse(spark):
    from hirefold.operators.state import empty_public_store, mirror_collapse
    base = empty_public_store(spark)
    def row(i, vendor, company, title, posted, closed=None):
        return (i, vendor, vendor + ":o", company, title, "", "", False, "u", posted, D(2026, 1, 5),
                D(2026, 1, 5), D(2026, 1, 5), closed, "old")
    df = spark.createDataFrame([
        row("g1", "greenhouse", "Acme Inc", "GTM Engineer", D(2026, 1, 2)),
        row("a1", "ashby", "acme", "gtm engineer", D(2026, 1, 1)),
        row("a2", "ashby", "Acme", "GTM Engineer", D(2026, 1, 3)),
        row("l1", "lever", "Acme", "GTM Engineer", None),
        row("z", "lever", "Acme", "GTM Engineer", None, closed=D(2026, 1, 4)),
        row("s1", "ashby", "Solo", "GTM Engineer", None),
    ], base.schema)
    out = {r["id"]: r["collapsed_into"] for r in mirror_collapse(df).collect()}
    assert out == {"a1": None, "a2": None, "g1": "a1", "l1": "a1", "z": "old", "s1": None}


def test_sightings_repeats_go_without_a_sort(spark, tmp_path):
    from hirefold.sources import fixtures as FX
    rows = [(D(2026, 1, 1, 8), 7, "view"), (D(2026, 1, 1, 9), 7, "view"), (D(2026, 1, 2, 8), 7, "view"),
            (D(2026, 1, 1, 8), 7, None), (D(2026, 1, 1, 9), 7, None), (D(2026, 1, 1, 8), None, "view"),
            (None, 7, "view"), (None, 7, "view"), (D(2026, 1, 1, 8), 7, "")]
    spark.createDataFrame(rows, "ts timestamp, user_id bigint, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    s = FX.sightings(spark, str(tmp_path))
    assert "SortAggregate" not in s._jdf.queryExecution().executedPlan().toString()
    first = D(2026, 1, 1)
    assert sorted(((r["id"], r["run_ts"]) for r in s.collect()), key=str) == sorted([
        ("greenhouse:user7:view", first), ("greenhouse:user7:view", D(2026, 1, 2)), ("greenhouse:user7", first),
        (":view", first), ("greenhouse:user7:view", None), ("greenhouse:user7:", first)], key=str)
