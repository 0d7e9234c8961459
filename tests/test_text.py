"""Title and company keys, phrase matching, location status, title family."""

import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import one


@pytest.mark.parametrize("title,key", [
    ("Go-To-Market Engineer", "gtm engineer"),
    ("Senior  GTM Engineer (Remote)", "senior gtm engineer remote"),
    ("go to market: engineering", "gtm engineering"),
    ("Engineer, Go To Marketplace", "engineer go to marketplace"),
    (None, ""),
])
def test_normalize_title(spark, title, key):
    from hirefold.functions.text import normalize_title
    assert one(spark, normalize_title(F.col("t")), t=title) == key


@pytest.mark.parametrize("name,key", [
    ("Tryzephyr", "zephyr"), ("ZephyrHQ", "zephyr"), ("Zephyr HQ", "zephyr"),
    ("Nimbus.com", "nimbus"), ("Quill AI", "quill"), ("Ember Labs", "ember"),
    ("The Paper Mill", "paper mill"), ("Orbit, Inc.", "orbit"), ("Getwidget", "widget"),
    ("Sproutapp", "sprout"),
    # too short a stem to unglue: stays itself
    ("Thea", "thea"), ("Usher", "usher"), ("Tryst", "tryst"), ("Draco", "draco"), ("Kaio", "kaio"),
    ("Joinery", "joinery"),
    ("The Inc", "the"), ("inc inc", "inc"), ("", ""),
    ("Get Join Use Zephyr Labs Inc", "zephyr"),
])
def test_normalize_company(spark, name, key):
    from hirefold.functions.text import normalize_company
    assert one(spark, normalize_company(F.col("n")), n=name) == key


@pytest.mark.parametrize("phrase,text,hit", [
    ("ci/cd", "Own our CI / CD pipeline", True),
    ("ci/cd", "ACIs / CDs", False),
    ("ci/cd", "cizcd", False),
    ("a/b test", "Run A/B tests weekly", False),
    ("a/b tests", "Run A/B tests weekly", True),
    ("us", "status update", False),
    ("ae", "every year", False),
    ("full stack", "full-stack work", True),
])
def test_phrase_regex(spark, phrase, text, hit):
    from hirefold.functions.text import phrase_regex
    assert one(spark, F.col("t").rlike(phrase_regex(phrase)), t=text) is hit


@pytest.mark.parametrize("loc,remote,status", [
    ("New York City", None, "ok"),
    ("Brooklyn, NY | London", False, "ok"),
    ("Remote - United States", None, "ok"),
    ("Remote (EMEA)", None, "fail"),
    ("Remote, UK | Remote (Europe)", None, "fail"),
    ("London | Remote, UK", None, "fail"),
    ("Remote", None, "remote-unverified"),
    ("Remote, Lisbon", None, "remote-unverified"),
    ("Remote, OH", None, "ok"),
    ("Remote in Iceland", None, "remote-unverified"),
    ("Austin, TX", True, "ok"),
    ("Berlin", True, "remote-unverified"),
    ("Berlin", False, "fail"),
    ("Toronto, Canada", True, "fail"),
    ("", True, "remote-unverified"),
    ("", None, "fail"),
    ("Remote - Dukes County", None, "remote-unverified"),
])
def test_location_status(spark, loc, remote, status):
    from hirefold.operators.funnel import location_status
    df = spark.createDataFrame([(loc, remote)], "loc string, remote boolean")
    assert df.select(location_status(F.col("loc"), F.col("remote"))).first()[0] == status


@pytest.mark.parametrize("title,family", [
    ("GTM Engineer", "include"), ("Senior Go-To-Market Engineer", "include"),
    ("RevOps Architect", "include"), ("Growth Engineer", "flag"),
    ("Software Engineer", None), ("Head of AI GTM", "include"),
])
def test_title_family(spark, title, family):
    from hirefold.operators.funnel import title_family
    assert one(spark, title_family(F.col("t")), t=title) == family


def test_domain_and_name(spark):
    from hirefold.functions.text import domain_of, name_guess, page_dirname
    assert one(spark, domain_of(F.col("u")), u=" https://www.Zephyr-Labs.io/careers/ ") == "zephyr-labs.io"
    assert one(spark, name_guess(F.col("d")), d="zephyr-labs.io") == "Zephyr Labs"
    assert one(spark, name_guess(F.col("d")), d="acme-3d.com") == "Acme 3D"
    assert one(spark, page_dirname(F.lit("workday"), F.col("s")), s="Acme.wd5/External") == "workday-acme-wd5-external"


def test_alternation_regexes_are_valid():
    from hirefold.functions.text import any_phrase_regex, phrase_regex
    for p in ("ci/cd", "a/b test", "next.js"):
        re.compile(phrase_regex(p).replace("(?i)", ""))
        re.compile(any_phrase_regex([p, "x"]).replace("(?i)", ""))


@pytest.mark.parametrize("a,b,hit", [
    ("GTM Engineer", "Senior GTM Engineer", True), ("Go-To-Market Engineer, Tools", "gtm engineer", True),
    ("RevOps Engineer", "GTM Engineer", False), ("", "GTM Engineer", False), ("--", "GTM Engineer", False),
])
def test_title_matches(spark, a, b, hit):
    from hirefold.functions.text import title_matches
    assert one(spark, title_matches(F.col("a"), F.col("b")), a=a, b=b) is hit
