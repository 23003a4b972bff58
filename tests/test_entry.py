"""The driver contract, and a few queries beside their SQL twins at the smallest scale."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import TABLES, rows_of

SF = "/root/testdata/sf0.001"
SOME = ["a11_equal_recording_mean", "w2_window_counts", "a1_timestamp_audit", "k1_leave_one_recording_out", "a30_domain_shift", "j7_stream_overlap", "i2_even_thinning"]

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables are not here")


def test_registry():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 100


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 4


@pytest.mark.parametrize("name", SOME)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF).toPandas().astype(object)
    want = con.execute(entry.oracle_sql()[name]).fetchdf().astype(object)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
