"""Page names go out in key order, whatever the chain."""


def test_chains(spark):
    from hirefold.operators.reports import dirname_collisions
    orgs = spark.createDataFrame([("ashby", s) for s in ("Acme", "acme", "acme-2", "acme-2-2", "ACME")],
                                 "vendor string, slug string")
    got = {r["slug"]: r["dirname"] for r in dirname_collisions(orgs).collect()}
    assert got == {"ACME": "ashby-acme", "Acme": "ashby-acme-2", "acme": "ashby-acme-2-2",
                   "acme-2": "ashby-acme-2-2-2", "acme-2-2": "ashby-acme-2-2-2-2"}


def by_loop(keys):
    import re
    taken, names = set(), {}
    for vendor, slug in sorted(keys):
        name = re.sub("^-+|-+$", "", re.sub("[^a-z0-9]+", "-", f"{vendor}-{slug}".lower()))
        while name in taken:
            name += "-2"
        taken.add(name)
        names[vendor, slug] = name
    return names


def test_chains_with_tails_of_any_length(spark):
    import random

    from hirefold.operators.reports import dirname_collisions
    rnd = random.Random(11)
    keys = {(v, rnd.choice("aAbB") + rnd.choice(["", ".", "_", "--"]) + "-2" * rnd.choice([0, 0, 0, 1, 2, 5, 9]) + "." * rnd.randrange(6))
            for v in ("ashby", "lever") for _ in range(150)}
    keys |= {("lever", c) for c in "ἀβγδ日本語"}
    orgs = spark.createDataFrame(sorted(keys, key=lambda k: k[1]), "vendor string, slug string").repartition(3)
    assert {(r["vendor"], r["slug"]): r["dirname"] for r in dirname_collisions(orgs).collect()} == by_loop(keys)


def test_twenty_thousand_orgs_of_one_stem(spark):
    """Slugs without a-z or 0-9 all have the bare vendor as their stem."""
    import time

    from pyspark.sql import functions as F

    from hirefold.operators.reports import dirname_collisions
    orgs = spark.range(20_000).select(F.lit("lever").alias("vendor"), F.translate(
        F.lpad(F.col("id").cast("string"), 6, "0"), "0123456789", "αβγδεζηθικ").alias("slug"))
    began = time.time()
    named = dirname_collisions(orgs)
    n = F.length("dirname")
    got = named.agg(F.count("*"), F.countDistinct(n), F.min(n), F.max(n), F.max_by(n, "slug")).first()
    assert tuple(got) == (20_000, 20_000, 5, 5 + 2 * 19_999, 5 + 2 * 19_999)
    assert time.time() - began < 60
    plan = named._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Python" not in plan


def test_row_numbers_span_partitions(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from hirefold.operators.ranking import row_numbers
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("g"),
                                  F.xxhash64("id").alias("o"))
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy(F.col("o").asc_nulls_first())).cast("long"))
    assert row_numbers(df, ["g"], ["o"], "n").exceptAll(want).count() == 0
    assert row_numbers(df.limit(0), ["g"], ["o"], "n").count() == 0
