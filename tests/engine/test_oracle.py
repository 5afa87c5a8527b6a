"""Every query that SQL expresses, against DuckDB on the same files."""

import math

import duckdb
import pytest

from gridloom.plans.catalogue import QUERIES
from gridloom.plans.oracle import ORACLE

from .conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def db():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return db


def test_every_query_that_sql_expresses_has_an_oracle():
    assert set(QUERIES) - set(ORACLE) == {"boxcox", "sym_orth"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, db, name):
    got = QUERIES[name](spark, SMALL)
    want = db.execute(ORACLE[name])
    cols = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(cols)
    text = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else str(v)
    rows = lambda dicts: sorted(tuple(text(d[c]) for c in sorted(cols)) for d in dicts)
    assert rows(r.asDict() for r in got.collect()) == rows(dict(zip(cols, r, strict=True)) for r in want.fetchall())


def test_all_factors_with_prices_of_zero(spark, db, tmp_path):
    path = str(tmp_path / "events.parquet")
    db.execute(f"COPY (SELECT * REPLACE (CASE WHEN event_id % 3001 = 7 THEN 0 ELSE value END AS value) FROM '{SMALL}/events.parquet') TO '{path}'")
    odd = duckdb.connect()
    for t in TABLES:
        odd.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if t == 'events' else f'{SMALL}/{t}.parquet'}'")
    cols = ["code", "date", "factor_name", "fac"]
    got = [tuple(str(r[c]) for c in cols) for r in QUERIES["all_factors"](spark, str(tmp_path)).collect()]
    want = odd.execute(f"SELECT {', '.join(cols)} FROM ({ORACLE['all_factors']})").fetchall()
    assert sum(r[3] == "inf" for r in got) > 0
    assert sorted(got) == sorted(tuple(map(str, r)) for r in want)


def test_all_factors_with_sums_of_sixteen_digits(spark, db, tmp_path):
    # A price near 0 now and then makes returns, and the sums of their squares, large.
    path = str(tmp_path / "events.parquet")
    db.execute(f"COPY (SELECT * REPLACE (CASE WHEN event_id % 97 = 5 THEN 0.002 ELSE value END AS value) FROM '{SMALL}/events.parquet') TO '{path}'")
    odd = duckdb.connect()
    odd.execute("SET threads = 1")  # the order of a day's bars, which the last digits depend on
    for t in TABLES:
        odd.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if t == 'events' else f'{SMALL}/{t}.parquet'}'")
    cols = ["code", "date", "factor_name", "fac"]
    got = [tuple(str(r[c]) for c in cols) for r in QUERIES["all_factors"](spark, str(tmp_path)).collect()]
    want = odd.execute(f"SELECT {', '.join(cols)} FROM ({ORACLE['all_factors']})").fetchall()
    assert sum(2**52 <= r[3] * 1e6 < 2**53 for r in want if r[3] is not None) > 5
    assert sorted(got) == sorted(tuple(map(str, r)) for r in want)


def test_expanded_days_are_summed_by_kind_and_day_alone(spark, tmp_path):
    path = str(tmp_path / "orders.parquet")
    duckdb.execute(f"COPY (SELECT * REPLACE (CASE WHEN o_orderkey % 7 > 0 THEN o_custkey END AS o_custkey) FROM '{SMALL}/orders.parquet') TO '{path}'")
    got = QUERIES["interval_expand"](spark, str(tmp_path))
    rows = sorted((r["kind"], r["date"], r["members"], r["codes"]) for r in got.collect())
    odd = duckdb.connect()
    odd.execute(f"CREATE VIEW orders AS SELECT * FROM '{path}'")
    assert rows == sorted(odd.execute(f"SELECT kind, date, members, codes FROM ({ORACLE['interval_expand']})").fetchall())
    assert any(members > codes for _, _, members, codes in rows)  # the null code is a member
    # Above the expansion nothing is grouped by code: that would hold, and spill, a row for each day of each code.
    plan = got._jdf.queryExecution().executedPlan().toString()
    above = [line for line in plan.split("Generate")[0].splitlines() if "Aggregate(keys=" in line]
    assert above and all("code#" not in line.split("functions=")[0] for line in above)
