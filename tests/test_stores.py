"""Tolerant reads, versioned stores, the history document."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F


def test_parse_jsonl_skips_bad_lines(spark):
    from hirefold.sources import stores
    lines = spark.createDataFrame([
        (0, json.dumps({"vendor": "lever", "slug": "a", "status": "live"})),
        (1, ""), (2, "{not json"), (3, json.dumps({"vendor": "nope", "slug": "b"})),
        (4, json.dumps({"vendor": "lever", "slug": "c", "last_posting_count": "many"})),
        (5, json.dumps({"vendor": "lever", "slug": "a", "status": "dead", "extra": 1})),
        (6, "[1, 2]"),
    ], "line_no long, line string")
    recs = stores.parse_jsonl(lines, stores.REGISTRY_SCHEMA, stores.REGISTRY_DEFAULTS, stores.REGISTRY_ENUMS)
    assert sorted(r["line_no"] for r in recs.collect()) == [0, 5]
    lww = stores.last_write_wins(recs, ["vendor", "slug"]).collect()
    assert len(lww) == 1 and lww[0]["status"] == "dead" and lww[0]["notes"] == ""


def test_versioned_store_roundtrip(spark):
    from hirefold.sources import stores
    base = os.path.join(tempfile.mkdtemp(), "seen")
    assert stores.latest_version(spark, base) is None
    df = spark.createDataFrame([("b", 1), ("a", 2)], "id string, n int")
    assert stores.write_store(df, base) == 0
    assert stores.write_store(df.withColumn("n", F.col("n") + 1), base) == 1
    got = sorted((r["id"], r["n"]) for r in stores.read_store(spark, base).collect())
    assert got == [("a", 3), ("b", 2)]


def test_a_store_of_an_older_version_loads_with_defaults(spark):
    from hirefold.operators import state
    from hirefold.plans.jobs import SEEN_DEFAULTS, SEEN_SCHEMA
    from hirefold.sources import stores
    base = os.path.join(tempfile.mkdtemp(), "seen")
    old = spark.sql("SELECT 'lever:a:1' AS id, 'lever:a' AS org_key, 'GTM Engineer' AS title, 'A' AS company_name, "
                    "'u' AS url, timestamp'2026-01-01' AS first_seen, timestamp'2026-01-01' AS last_seen")
    stores.write_store(old, base)
    seen = stores.read_store(spark, base, SEEN_SCHEMA, SEEN_DEFAULTS)
    row = seen.first()
    assert (row["public"], row["closed_at"], row["comp_band"]) == (False, None, None)
    now = F.lit("2026-01-02").cast("timestamp")
    nothing = seen.select("id", "org_key", "title", "company_name", "url").limit(0)
    out = state.seen_reconcile(seen, nothing, seen.select("org_key"), now).first()
    assert out["closed_now"] and out["closed_at"] is not None


def test_history_load(spark):
    from hirefold.operators.history import history_load
    doc = {"history": [{"company": "Acme", "status": "applied", "role": "GTM Engineer", "date": "2026-07-01"},
                       {"company": "Brightwell", "status": "dq"}],
           "applied": ["Oakmere"], "blacklist_companies": ["Pinecrest", "Hooli"]}
    docs = spark.createDataFrame([(json.dumps(doc),)], "doc string")
    rows = [(r["ordinal"], r["company"], r["status"], r["role"]) for r in history_load(docs).orderBy("ordinal").collect()]
    assert rows == [(0, "Acme", "applied", "GTM Engineer"), (1, "Brightwell", "dq", None),
                    (2, "Oakmere", "applied", None), (3, "Pinecrest", "blacklist", None),
                    (4, "Hooli", "blacklist", None)]
    bad = spark.createDataFrame([(json.dumps({"history": [{"company": "A", "status": "dq", "oops": 1}]}),)], "doc string")
    with pytest.raises(Exception):
        history_load(bad).collect()


def test_history_of_several_documents(spark):
    from hirefold.operators.history import history_load
    docs = [(2, {"history": [{"company": "C", "status": "dq"}], "rejected": ["D"]}), (7, {"blacklist_companies": ["E"]}),
            (1, {"applied": ["A", "B"]}), (4, {})]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in docs], "doc_no int, doc string").repartition(3)
    got = [tuple(r)[:3] for r in history_load(df).orderBy("ordinal").collect()]
    assert got == [(0, "A", "applied"), (1, "B", "applied"), (2, "C", "dq"), (3, "D", "rejected"), (4, "E", "blacklist")]
    assert history_load(df.limit(0)).collect() == []
    with pytest.raises(Exception):
        history_load(spark.createDataFrame([(json.dumps({"history": [{"company": "A"}]}),)], "doc string")).collect()


def test_a_log_of_several_files_keeps_its_line_order(spark):
    from hirefold.sources import stores
    base, at = tempfile.mkdtemp(), 0
    want = []
    for name, n in (("a", 3), ("b", 400), ("c", 1), ("d", 0), ("e", 90)):
        with open(os.path.join(base, f"log-{name}.jsonl"), "w") as f:
            for i in range(n):
                line = "" if i % 11 == 5 else json.dumps({"vendor": "lever", "slug": f"s{i % 40}", "notes": f"{name}{i}"})
                f.write(line + "\n")
                want.append((at, line))
                at += 1
    was = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        lines = stores.numbered_lines(spark, base)
        assert sorted(map(tuple, lines.collect())) == want
        recs = stores.read_jsonl_tolerant(spark, base, stores.REGISTRY_SCHEMA, stores.REGISTRY_DEFAULTS, stores.REGISTRY_ENUMS)
        got = {r["slug"]: r["notes"] for r in stores.last_write_wins(recs, ["vendor", "slug"]).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was[0])
        spark.conf.set("spark.sql.files.openCostInBytes", was[1])
    last = {}
    for _, line in want:
        if line:
            last[json.loads(line)["slug"]] = json.loads(line)["notes"]
    assert got == last


def test_stores_change_together_or_not_at_all(spark):
    from hirefold.sources import stores
    from pyspark.sql import types as T
    root = tempfile.mkdtemp()
    record = T.StructType([T.StructField("night", T.LongType())])

    def night(n, killed=None):
        commit = stores.Commit(spark, root)
        df = spark.createDataFrame([(f"a{n}", n)], "id string, n int")
        commit.write("public", df)
        if killed == "between":
            return
        commit.write("seen", df)
        commit.log("runs", df.selectExpr("cast(n AS bigint) AS night"))
        if killed != "before the manifest":
            commit.finish()

    def state():
        both = [stores.read_store(spark, os.path.join(root, x)).first()["n"] for x in ("public", "seen")]
        return both, sorted(r["night"] for r in stores.committed_lines(spark, root, "runs", record).collect())

    night(1)
    assert state() == ([1, 1], [1])
    for killed in ("between", "before the manifest"):
        night(2, killed)
        assert state() == ([1, 1], [1])
    night(3)
    assert state() == ([3, 3], [1, 3])
    for n in (4, 5, 6):
        night(n)
    assert state() == ([6, 6], [1, 3, 4, 5, 6])
    # Old versions and manifests go; what a reader may still hold stays.
    for name in ("public", "seen"):
        assert len(stores.versions(spark, os.path.join(root, name))) == 2
    assert len(stores._manifests(spark, root)) == 2
    with pytest.raises(RuntimeError):
        late, soon = stores.Commit(spark, root), stores.Commit(spark, root)
        soon.finish()
        late.finish()
