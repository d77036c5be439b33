"""Every registered job against its SQL oracle (DuckDB) on the smallest driver tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_oracle import digest, duck  # noqa: E402
from larder.plans import registry  # noqa: E402

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_matches_oracle(spark, con, name):
    df = registry.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    assert name in SQL, "every job has an oracle"
    res = con.execute(SQL[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(rows, df.columns) == digest(orows, ocols)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["franchise_id", "item_name", "avg_feedback_rating", "total_feedbacks", "feedback_rank"]
    assert df.count() > 0
