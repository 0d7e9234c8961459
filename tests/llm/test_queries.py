"""The registered corpus queries against their SQL (sf0.001)."""

import pytest

from hirefold.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from tools.compare import _norm
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = Q.QUERIES[name](spark, SF).toPandas(), con.execute(Q.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    assert _norm(got).equals(_norm(want))


def test_pipeline_is_registered():
    import corpus_pipeline
    assert Q.QUERIES["pipeline"] and len(corpus_pipeline.STAGES) == 5
