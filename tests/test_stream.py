"""The streamed fold equals the one-pass history however files meet batches."""

import os
import uuid
from datetime import datetime

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
COLS = ["id", "first_seen", "last_seen", "closed_at"]


def _base(spark):
    from hirefold.session import checkpoint_dir
    return os.path.join(checkpoint_dir(spark), f"stream-test-{uuid.uuid4().hex}")


def _rows(df):
    return sorted(tuple(r) for r in df.select(*COLS).collect())


def test_backfill_batch_of_many_nights(spark):
    from hirefold.operators import state
    from hirefold.sources import fixtures as FX
    from hirefold.streaming import reconcile
    base = _base(spark)
    s = FX.sightings(spark, SF)
    (s.withColumn("night", F.date_format("run_ts", "yyyyMMdd")).repartition(3)
     .write.partitionBy("night").parquet(os.path.join(base, "snaps")))
    got = reconcile.stream_reconcile(spark, os.path.join(base, "snaps"), os.path.join(base, "seen"),
                                     os.path.join(base, "ckpt"))
    want = state.sighting_history(s, FX.board_fetches(spark, SF))
    assert _rows(got) == _rows(want) and got.count() > 0


@pytest.mark.parametrize("per_trigger", [1, None])
def test_split_nights_two_runs_a_date_and_empty_answers(spark, per_trigger):
    from hirefold.streaming import reconcile
    base = _base(spark)
    t1, t2, t3 = (datetime(2026, 1, 1, 1), datetime(2026, 1, 1, 20), datetime(2026, 1, 2, 1))
    row = lambda ts, i, org: (ts, i, org, "ashby", "t", "c", "u")
    files = [[row(t1, "a", "o1"), row(t1, "b", "o1")], [row(t1, "c", "o1"), row(t1, "d", "o2")],
             [row(t2, "a", "o1")], [row(t2, "e", "o1")], [row(t3, None, "o1")]]
    for part in files:
        (spark.createDataFrame(part, reconcile.SNAPSHOT_SCHEMA).coalesce(1)
         .write.mode("append").parquet(os.path.join(base, "snaps")))
    got = {r["id"]: r["closed_at"] for r in reconcile.stream_reconcile(
        spark, os.path.join(base, "snaps"), os.path.join(base, "seen"), os.path.join(base, "ckpt"),
        max_files_per_trigger=per_trigger).collect()}
    # b and c close at the second run; the marker of the third closes the rest of o1; o2 never answered again.
    assert got == {"a": t3, "b": t2, "c": t2, "d": None, "e": t3}


def _nights(spark, start, n):
    from datetime import timedelta

    from hirefold.streaming import reconcile
    row = lambda ts, i, org: (ts, i, org, "ashby", f"t{ts.day}" if i == "a" else "", "c", "u")
    days = [start + timedelta(days=d) for d in range(n)]
    parts = []
    for k, ts in enumerate(days):
        rows = [row(ts, "a", "o1")] if k % 3 else [row(ts, None, "o1")]
        rows += [row(ts, "b", "o2")] if k % 4 == 1 else []
        parts.append(rows)
    return parts, lambda rows: spark.createDataFrame(rows, reconcile.SNAPSHOT_SCHEMA)


def test_late_nights_touch_only_their_keys_and_facts_merge_in_tiers(spark):
    from hirefold.operators import state
    from hirefold.sources import stores
    from hirefold.streaming import reconcile
    base = _base(spark)
    snaps, seen, public = (os.path.join(base, x) for x in ("snaps", "seen", "public"))
    parts, frame = _nights(spark, datetime(2026, 1, 1), 9)
    late = parts.pop(4)

    def run():
        return reconcile.stream_reconcile(spark, snaps, seen, os.path.join(base, "ckpt"), public_base=public,
                                          max_files_per_trigger=1, fanin=2)
    for p in reversed(parts):  # the latest night first
        frame(p).coalesce(1).write.mode("append").parquet(snaps)
    run()
    before = set(os.listdir(os.path.join(base, "seen-facts", "roles")))
    frame(late).coalesce(1).write.mode("append").parquet(snaps)
    got = run()
    every = frame([r for p in [*parts, late] for r in p])
    answered, sight = every.select("org_key", "run_ts").distinct(), every.where("id is not null")
    want = state.sighting_history(sight, answered)
    assert _rows(got) == _rows(want)
    assert {r["id"]: r["title"] for r in got.collect()} == {r["id"]: r["title"] for r in want.collect()}
    shown = stores.read_store(spark, public)
    assert _rows(shown) == _rows(state.public_history(sight, answered, every.select("run_ts").distinct()))
    # Eight nights are one delta; the late one lands beside it, and no night was folded again.
    names = set(os.listdir(os.path.join(base, "seen-facts", "roles")))
    new = {n for n in names - before if n.startswith("delta=")}
    assert len(new) == 1 and new.pop().endswith("-8-8")
    # Old versions expire: the last two commits' remain.
    for _ in range(2):
        run()
    assert len(stores.versions(spark, seen)) == 2 == len(stores.versions(spark, public))


def test_replayed_and_overlapping_deltas_say_the_same(spark):
    from hirefold.operators import nights
    from hirefold.sources import deltas
    base = os.path.join(_base(spark), "roles")
    parts, frame = _nights(spark, datetime(2026, 2, 1), 6)
    from hirefold.streaming import reconcile
    read = lambda: sorted(map(str, deltas.read(spark, base, nights.merge_roles, reconcile.ROLE_FACTS)
                              .selectExpr("id", "array_sort(nights) nights", "first", "last", "title", "url").collect()))
    for k, p in enumerate(parts):
        deltas.land(nights.role_facts(frame(p)), base, "ab", k)
    plain = read()
    deltas.compact(spark, base, nights.merge_roles, fanin=3)
    assert read() == plain
    deltas.land(nights.role_facts(frame(parts[2])), base, "ab", 2)   # replayed after its merge
    deltas.land(nights.role_facts(frame(parts[2])), base, "cd", 0)   # the same file through another stream
    assert read() == plain
    assert deltas.read(spark, base + "-none", nights.merge_roles, reconcile.ROLE_FACTS).count() == 0


def test_public_rows_expire_and_return(spark):
    from datetime import timedelta

    from hirefold import rules as R
    from hirefold.operators import nights, state
    from hirefold.streaming import reconcile
    t0 = datetime(2026, 1, 1)
    day = lambda d: t0 + timedelta(days=d)
    keep = R.CLOSED_RETENTION_DAYS
    row = lambda d, i, org="o1": (day(d), i, org, "ashby", "t", "c", "u")
    # a closes on day 1 and comes back on the run that would delete it; b a run later; c never; d's org is silent.
    rows = [row(0, "a"), row(0, "b"), row(0, "c"), row(0, "d", "o2"), row(1, None),
            row(2 + keep, "a"), row(3 + keep, "b"), row(1 + keep, None, "o3")]
    s = spark.createDataFrame(rows, reconcile.SNAPSHOT_SCHEMA)
    answered, runs, sight = s.select("org_key", "run_ts"), s.select("run_ts"), s.where("id is not null")
    facts = (nights.merge_roles(nights.role_facts(sight)), nights.merge_orgs(nights.org_facts(answered)))
    got = nights.public_store(*facts, nights.run_facts(runs))
    assert _rows(got) == _rows(state.public_history(sight, answered.distinct(), runs.distinct()))
    assert {r["id"]: r["first_seen"] for r in got.collect()} == {"a": day(0), "b": day(3 + keep), "d": day(0)}
    events = sorted(map(tuple, nights.closure_events(*facts).collect()))
    assert events == sorted(map(tuple, state.closure_events(sight, answered.distinct()).select("id", "night", "event").collect()))


def test_no_sightings_give_no_roles(spark):
    from hirefold.operators import nights
    from hirefold.streaming import reconcile
    s = spark.createDataFrame([(None, None, None, None, None, None, None)], reconcile.SNAPSHOT_SCHEMA)
    roles, orgs = nights.role_facts(s), nights.org_facts(s.select("org_key", "run_ts"))
    assert nights.seen_store(roles, orgs).count() == 0 == nights.closure_events(roles, orgs).count()
    assert nights.public_store(roles, orgs, nights.run_facts(s.select("run_ts"))).count() == 0
