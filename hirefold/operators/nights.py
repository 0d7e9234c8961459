"""Sighting history as facts that merge: the nights of each role, the
answered nights of each org, the calendar of runs.

A fact row is a join of what its nights say: sets of nights, the earliest and
the latest sighting, the latest title and url that aren't empty. Merging two
fact rows of one key is associative, commutative and idempotent, so nights may
come in any order, late, in pieces, or twice; a new night makes facts only of
the keys it holds, and no earlier night is folded again. ``seen_store`` and
``public_store`` read the end state of the nightly fold off the merged facts;
``closure_events`` the closures and resurrections on the way.

Every array is bounded by the number of nights. Roles merge by id, orgs by
org key, both combined before the shuffle: a hot org is many roles and one
row a night. Repeated ids of one night: the later line wins (``line_no``,
where the table has one), else the larger row. A role belongs to the org of
its first sighting. No sightings give no roles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirefold import rules as R

_ROW = ("vendor", "org_key", "company_name", "title", "url")
_RETENTION = R.CLOSED_RETENTION_DAYS * 86_400_000_000  # microseconds
_SEEN, _ANSWERED, _RUN = 0, 1, 2                       # order of events at one time


def _filled(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) != ""


def role_facts(sightings: DataFrame) -> DataFrame:
    """Facts of the roles in ``sightings`` (run_ts, id, org_key, vendor,
    title, company_name, url; line_no optional); null ids make none."""
    line = F.col("line_no").cast("long") if "line_no" in sightings.columns else F.lit(0).cast("long")
    s = sightings.where(F.col("id").isNotNull()).select(
        "id", F.unix_micros("run_ts").alias("run"), line.alias("line"), *_ROW)
    late = F.struct("run", "line", F.struct(*_ROW).alias("row"))
    early = F.struct("run", (-F.col("line")).alias("line"), F.struct(*_ROW).alias("row"))
    return s.groupBy("id").agg(
        F.collect_set("run").alias("nights"),
        F.min(early).alias("first"),
        F.max(late).alias("last"),
        F.max(F.when(_filled("title"), F.struct("run", "line", F.col("title").alias("value")))).alias("title"),
        F.max(F.when(_filled("url"), F.struct("run", "line", F.col("url").alias("value")))).alias("url"))


def org_facts(answered: DataFrame) -> DataFrame:
    """Answered nights of each org in ``answered`` (org_key, run_ts)."""
    return answered.groupBy("org_key").agg(F.collect_set(F.unix_micros("run_ts")).alias("nights"))


def run_facts(runs: DataFrame) -> DataFrame:
    """The calendar of ``runs`` (run_ts): one row a run."""
    return runs.select(F.unix_micros("run_ts").alias("run")).distinct()


def _nights() -> Column:
    return F.array_distinct(F.flatten(F.collect_list("nights"))).alias("nights")


def merge_roles(facts: DataFrame) -> DataFrame:
    """One row a role of any number of facts."""
    return facts.groupBy("id").agg(_nights(), F.min("first").alias("first"), F.max("last").alias("last"),
                                   F.max("title").alias("title"), F.max("url").alias("url"))


def merge_orgs(facts: DataFrame) -> DataFrame:
    return facts.groupBy("org_key").agg(_nights())


def merge_runs(facts: DataFrame) -> DataFrame:
    return facts.select("run").distinct()


def _with_org(roles: DataFrame, orgs: DataFrame) -> DataFrame:
    o = orgs.select(F.col("org_key").alias("_org"), F.col("nights").alias("_answered"))
    return (roles.join(o, F.col("first.row.org_key") == F.col("_org"), "left").drop("_org")
            .withColumn("_answered", F.coalesce("_answered", F.array().cast("array<bigint>"))))


def _events(*kinds: tuple[Column, int]) -> Column:
    def tagged(times: Column, kind: int) -> Column:
        return F.transform(times, lambda t: F.struct(t.alias("at"), F.lit(kind).alias("kind")))
    return F.array_sort(F.concat(*[tagged(times, kind) for times, kind in kinds]))


def _time(micros: Column) -> Column:
    return F.timestamp_micros(micros)


def seen_store(roles: DataFrame, orgs: DataFrame) -> DataFrame:
    """The seen store after all nights, from merged facts: id, org_key,
    company_name, title, url, first_seen, last_seen, closed_at."""
    r = _with_org(roles, orgs)
    last = F.col("last.run")
    return r.select(
        "id", F.col("first.row.org_key").alias("org_key"), F.col("first.row.company_name").alias("company_name"),
        F.coalesce(F.col("title.value"), F.col("first.row.title")).alias("title"),
        F.coalesce(F.col("url.value"), F.col("first.row.url")).alias("url"),
        _time(F.col("first.run")).alias("first_seen"), _time(last).alias("last_seen"),
        _time(F.array_min(F.filter("_answered", lambda t: t > F.col("last.run")))).alias("closed_at"))


def closure_events(roles: DataFrame, orgs: DataFrame) -> DataFrame:
    """Every closure and resurrection: id, night, event. A role closes on its
    org's first answered night after a sighting that isn't a sighting too."""
    # Each step is a column of its own: lambdas look back into it, and must not compute it again.
    r = _with_org(roles, orgs).withColumn("_all", _events((F.col("nights"), _SEEN), (F.col("_answered"), _ANSWERED)))
    r = r.withColumn("_apart", F.filter("_all", lambda e, i: (e["at"] >= F.col("first.run")) & (
        (e["kind"] == _SEEN) | (F.coalesce(F.get("_all", i - 1)["at"], F.lit(-1)) != e["at"]))))
    turns = F.filter("_apart", lambda e, i: (i > 0) & (F.get("_apart", i - 1)["kind"] != e["kind"]))
    told = r.select("id", F.explode(turns).alias("e"))
    return told.select("id", _time(F.col("e.at")).alias("night"),
                       F.when(F.col("e.kind") == _SEEN, "reopened").otherwise("closed").alias("event"))


def public_store(roles: DataFrame, orgs: DataFrame, runs: DataFrame) -> DataFrame:
    """The public store after all nights, from merged facts, before mirrors:
    a closed row goes on the first run past retention unless the role is back
    on that run, and a later sighting starts anew."""
    # One row a run: the calendar is bounded by the number of nights.
    calendar = runs.agg(F.collect_list("run")).scalar()
    r = _with_org(roles, orgs).withColumn("_runs", calendar)
    events = _events((F.col("nights"), _SEEN), (F.col("_answered"), _ANSWERED), (F.col("_runs"), _RUN))
    none = F.lit(None).cast("long")
    start = F.struct(none.alias("first"), none.alias("closed"), none.alias("last"))

    def step(acc: Column, e: Column) -> Column:
        seen, answered = e["kind"] == _SEEN, e["kind"] == _ANSWERED
        # The night's sighting comes first: last is the newest one up to here.
        fresh = e["at"] == acc["last"]
        closes = answered & acc["first"].isNotNull() & acc["closed"].isNull() & ~fresh
        gone = (e["kind"] == _RUN) & acc["closed"].isNotNull() & (e["at"] > acc["closed"] + F.lit(_RETENTION))
        return F.struct(
            F.when(gone, none).when(seen, F.coalesce(acc["first"], e["at"])).otherwise(acc["first"]).alias("first"),
            F.when(seen | gone, none).when(closes, e["at"]).otherwise(acc["closed"]).alias("closed"),
            F.when(seen, e["at"]).otherwise(acc["last"]).alias("last"))

    r = r.withColumn("_end", F.aggregate(events, start, step)).where(F.col("_end.first").isNotNull())
    last = _time(F.col("last.run"))
    return r.select(
        "id", *[F.col(f"last.row.{c}").alias(c) for c in _ROW],
        _time(F.col("_end.first")).alias("first_seen"), last.alias("last_seen"), last.alias("last_verified"),
        _time(F.col("_end.closed")).alias("closed_at"))
