"""A cross-section of the registered queries against DuckDB on the smallest data set."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
SAMPLE = ["price_snapshot", "ema", "resample_week_sum_keep", "asof_join", "nearest_asof", "pair_summary", "ccf_diff", "thresholds", "seasonal_index", "merged_header", "clean_cells",
          "validate_report", "kpss", "score_votes", "features", "empirical_interval", "stream_daily_totals"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def test_contract_is_complete(spark):
    q, s = contract.queries(), contract.oracle_sql()
    assert set(s) <= set(q) and len(q) > 140 and len(s) > 100
    assert contract.entry(spark).count() == 5


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = contract.queries()[name](spark, SF)
    cols = sorted(df.columns)
    res = con.execute(contract.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols

    def norm(v):
        return None if isinstance(v, float) and math.isnan(v) else v
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in res.fetchall()), key=repr)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
    assert len(got) == len(want) and got == want
