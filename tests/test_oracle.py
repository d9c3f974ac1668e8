"""Every registered query against its DuckDB oracle SQL on the smallest test
tables (the driver runs the same comparison at sf0.01)."""

import contextlib
import io

import pytest

import __spark_entry__ as E
from tools.oracle_check import compare, duck_connection

from .conftest import SF_SMALL

NAMES = list(E._SPARK)


@pytest.fixture(scope="module")
def con():
    return duck_connection(SF_SMALL)


def test_every_query_has_oracle():
    assert set(E._SQL) == set(E._SPARK) <= set(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    rows, status, _ = compare(spark, con, name, SF_SMALL)
    assert status == [], f"{name}: {status}"


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert 0 < len(rows) <= 10
    assert {"mal_grubu", "adet_deg", "neden", "aksiyon"} <= set(df.columns)


@pytest.mark.parametrize("name", ["mal_grubu_analysis_reasons", "stores_falling_all_groups",
                                  "stores_falling_all_products_named", "margin_reasons_product",
                                  "kpi_summary_filtered2"])
def test_shuffled_joins_match_oracle(spark, con, name):
    """With broadcasts off (as for large dimensions) every join is a shuffled
    sort-merge join; results stay the same."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, "-1")
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            E.queries()[name](spark, SF_SMALL).explain()
        assert "SortMergeJoin" in buf.getvalue() and "BroadcastHashJoin" not in buf.getvalue()
        rows, status, _ = compare(spark, con, name, SF_SMALL)
        assert status == [], f"{name}: {status}"
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
