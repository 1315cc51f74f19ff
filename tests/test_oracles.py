"""Every registered query against DuckDB on the same tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from tidecast.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for path in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def rows(frame):
    def plain(value):
        if value is None or (isinstance(value, float) and math.isnan(value)):
            return None
        return round(float(value), 6) + 0.0 if isinstance(value, float) else value

    frame = frame[sorted(frame.columns)].astype(object).where(frame.notna(), None)
    found = [tuple(map(plain, r)) for r in frame.itertuples(index=False)]
    return sorted(found, key=lambda r: [(v is None, f"{v:.3f}" if isinstance(v, float) else str(v)) for v in r])


def boosted(got):
    """Fitted on the past alone, the trees must do better on later hours than the value of a day before."""
    assert len(got) and got["y_pred"].notna().all()
    got = got.sort_values("ts")
    day_before = (got["y"] - got["y"].shift(24)).iloc[24:]
    assert ((got["y"] - got["y_pred"]).iloc[24:] ** 2).mean() < 0.8 * (day_before**2).mean()
    assert got["y_pred"].between(got["y"].min() - 1, got["y"].max() + 1).all()


def bootstrapped(got):
    """Bounds of a mean: in order, and narrow beside the errors, whose root mean square is some hundreds."""
    assert len(got) == 10 and (got["lower"] < got["upper"]).all()
    assert (got["upper"] - got["lower"] < 100).all()
    twins = got[got["model_id"].isin(["naive24", "dup_naive24"])].groupby("target")["lower"].agg(lambda x: x.max() - x.min())
    assert (twins < 30).all()


#: What the queries that SQL cannot express are held against.
ROWS = {"M07_boosted_forecast": boosted, "Q18_block_bootstrap": bootstrapped}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLES:
        ROWS[name](got)
        return
    want = duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got), "an empty result proves nothing" if len(want) else ""
    assert rows(got) == rows(want)


def test_every_query_has_an_oracle_or_says_why():
    from tidecast.plans.registry import ROWS_ONLY

    assert set(QUERIES) - set(ORACLES) == set(ROWS_ONLY) == set(ROWS)


def test_only_calls_of_round_are_moved_off_the_half():
    assert registry.off_half("SELECT round(avg(x), 6), f(a, 6), round(g(b, 6), 9), round(x, 3)") == f"SELECT round(avg(x) + {registry.OFF_HALF!r}, 6), f(a, 6), round(g(b, 6), 9), round(x + {registry.OFF_HALF!r}, 3)"
