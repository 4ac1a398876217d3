"""Every engine query with an SQL twin agrees with DuckDB."""

from __future__ import annotations

import math

import duckdb
import pytest

from sigplane.operators import reliability as R
from sigplane.plans import more_queries, queries  # noqa: F401  the first registers more

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("events", "customer", "orders"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _plain(rows):
    def value(x):
        return None if x is None or isinstance(x, float) and math.isnan(x) else round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else x

    return sorted((tuple(value(x) for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_agrees(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = df.select(*columns).collect()
    want = duck.sql(queries.oracle_sql()[name])
    assert sorted(want.columns) == columns
    quoted = ", ".join('"' + c + '"' for c in columns)
    assert _plain(got) == _plain(want.project(quoted).fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_runs(spark, name):
    assert queries.queries()[name](spark, SF).count() > 0


def test_campaign_has_the_whole_grid(spark):
    rows = queries.queries()["campaign"](spark, SF).select("policy", "family", "severity", "rate", "seed", "outcome").collect()
    assert len({tuple(r)[:5] for r in rows}) == len(rows) == 20 * 11 * 4 * 10
    assert {r["policy"] for r in rows} == {n for n, *_ in R.catalogue()}
    assert {(r["family"], r["severity"]) for r in rows} == {(f, i) for f, x in R.SEVERITIES.items() for i in range(len(x))}
    assert {r["rate"] for r in rows} >= {1e-9, 1e-7, 1e-5} and {r["outcome"] for r in rows} == {"EC", "MR", "DU", "SW"} - {"EC"}


def test_severities_change_the_plans():
    copies = [3] * 8
    size = lambda f, i: len(R.fault_plan(f, 1e-9, 1, 100_000, copies, severity=R.SEVERITIES[f][i]))
    assert (size("short_burst", 0), size("short_burst", 1), size("long_run", 0), size("long_run", 1), size("region_burst", 0)) == (2, 4, 8, 512, 10)
    assert size("column_offset", 1) > 5 * size("column_offset", 0) and 1800 < size("dense_region", 0) < 2300


def test_campaign_draws_a_plan_once_for_all_policies(spark):
    codes = R.fixed_codes(spark.createDataFrame([(i, (i * 37 % 1001) / 7.0) for i in range(3000)], "row_id long, v double"))
    plans = list(dict.fromkeys(x[1:] for x in R.grid([1e-3], [1, 2])))
    assert len(plans) == 11 * 2
    # As many events as one policy of three copies has, whatever the number of policies.
    assert R.plan_events(spark, plans, 3000).count() == sum(len(R.fault_plan(f, rate, seed, 3000, [3] * 8, severity=R.SEVERITIES[f][v])) for f, v, rate, seed in plans)
    cells = [c for c in R.grid([1e-3], [1, 2]) if c[0] in ("uniform_r1", "uniform_r2", "uniform_r3", "graded_b3") and c[1] in ("twin", "mixed", "short_burst")]
    got = {(x["policy"], x["family"], x["severity"], x["seed"]): x for x in R.campaign(spark, codes, 3000, cells).collect()}
    clean, copies = {x["row_id"]: x["code"] for x in codes.collect()}, {n: [1 + y for y in e] for n, _, _, e in R.catalogue()}
    assert len(got) == len(cells) == 4 * 4 * 2
    for policy, family, v, rate, seed in cells:
        masks: dict = {}
        for p, c, at, m in R.fault_plan(family, rate, seed, 3000, copies[policy], severity=R.SEVERITIES[family][v]):
            masks[p, at, c] = masks.get((p, at, c), 0) ^ m
        damage, struck = 0, set()
        for p, at in {(p, at) for (p, at, _), m in masks.items() if m}:
            byte = clean[at] >> 8 * (7 - p) & 255
            now = [byte ^ masks.get((p, at, c), 0) for c in range(copies[policy][p])]
            given = now[0] if len(now) < 3 else next((x for x in now if now.count(x) > 1), min(now))
            damage += (given - byte) * 256 ** (7 - p)
            struck.add(p)
        x = got[policy, family, v, seed]
        assert (int(x["clean_answer"]), int(x["damage"]), x["faulted_planes"]) == (sum(clean.values()), damage, sorted(struck))


def test_plans_have_all_their_bursts(spark):
    rows, copies = 30_000, [3] * 8
    size = lambda f, i, rate: len(R.fault_plan(f, rate, 1, rows, copies, severity=R.SEVERITIES[f][i]))
    # 300 bursts, runs or regions; no number of them is a limit.
    assert (size("short_burst", 1, 1e-2), size("long_run", 0, 1e-2), size("dense_region", 0, 1e-2)) == (300 * 4, 300 * 8, 300 * 2048)
    assert len(R.fault_plan("dense_region", 1e-9, 1, rows, copies, severity={"n_regions": 150, "region_size": 10, "density": 0.5})) == 150 * 5
    plans = [("short_burst", 1, 1e-2, 1), ("long_run", 0, 1e-2, 2), ("twin", 0, 1e-2, 3)]
    want = sorted((i, *e) for i, (f, v, rate, seed) in enumerate(plans) for e in R.fault_plan(f, rate, seed, rows, copies, severity=R.SEVERITIES[f][v]))
    got = R.plan_events(spark, plans, rows).select("plan", "plane", "replica", "row_id", "mask").collect()
    assert sorted(map(tuple, got)) == want and len({e[3] for e in want if e[0] == 1}) > 2000  # blocks differ
