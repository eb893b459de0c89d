"""Every registered query equals its DuckDB SQL twin on the sf0.001 tables."""

import pytest

import __spark_entry__ as E
from upkeep.plans import registry
from tests.conftest import SF_SMALL
from tools.check_oracle import digest, stype

KEYS = sorted(registry.queries())


def test_every_query_has_an_oracle():
    assert set(registry.oracle_sql()) == set(registry.queries())


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, duck, key):
    df = E.queries()[key](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    rel = duck.sql(E.oracle_sql()[key])
    drows = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    dtypes = dict(zip(rel.columns, [str(t).replace(" ", "") for t in rel.types]))
    for c, t in df.dtypes:
        assert stype(t) == dtypes[c], (c, t, dtypes[c])
    assert len(srows) == len(drows)
    assert digest(srows, df.columns)[0] == digest(drows, rel.columns)[0]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["notif_type", "wo_cat", "cnt"]
    assert df.count() >= 0


@pytest.mark.parametrize("key", ["source_summary", "ingest_bom", "reports_list", "pack_weekly"])
def test_independent_of_session_zone(spark, duck, key):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        df = E.queries()[key](spark, SF_SMALL)
        srows = [tuple(r) for r in df.collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    rel = duck.sql(E.oracle_sql()[key])
    assert digest(srows, df.columns)[0] == digest(rel.fetchall(), rel.columns)[0]
