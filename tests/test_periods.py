"""Statement periods: gaps, overlaps, balances carried on, transactions that belong to none or several."""

from __future__ import annotations

from datetime import date

from ledgerleaf.operators import reconcile

PERIOD = "account int, period int, first_day date, last_day date, beginning double, ending double"
MOVE = "account int, date date, seq int, deposit double, withdrawal double"


def day(n):
    return date.fromordinal(date(2024, 1, 1).toordinal() + n)


def test_periods(spark):
    periods = spark.createDataFrame([
        (1, 1, day(0), day(30), 100.0, None), (1, 2, day(31), day(60), None, 70.0), (1, 3, day(65), day(90), 70.0, 70.0), (1, 4, day(80), day(120), 50.0, None), (1, 5, day(85), day(100), None, None),
        (1, 6, day(50), day(40), 1.0, 1.0), (1, 7, None, day(3), 1.0, 1.0), (2, 1, day(0), day(400), None, 5.0), (2, 2, day(401), day(401), None, 6.0),
    ], PERIOD)
    moves = spark.createDataFrame([
        (1, day(0), 1, 10.0, None), (1, day(30), 2, None, 40.0), (1, day(31), 3, 1.0, 1.0), (1, day(62), 4, 9.0, None), (1, day(85), 5, 5.0, None), (2, day(399), 6, 4.0, None), (2, day(401), 7, 1.0, None), (2, None, 8, 1.0, None), (3, day(5), 9, 1.0, None),
    ], MOVE)
    held = sorted((r.seq, r.period) for r in reconcile.in_periods(moves, periods).collect() if r.period is not None)
    assert held == [(1, 1), (2, 1), (3, 2), (5, 3), (5, 4), (5, 5), (6, 1), (7, 2)]
    assert {r.seq for r in reconcile.in_periods(moves, periods).where("period is null").collect()} == {4, 8, 9}
    found = {(r.account, r.period): tuple(r)[2:] for r in reconcile.check_periods(moves, periods).collect()}
    #                     valid gap overlap n start deposits withdrawals computed ok carried
    assert found[1, 1] == (True, None, None, 2, 100.0, 10.0, 40.0, 70.0, None, None)
    assert found[1, 2] == (True, 0, 0, 1, 70.0, 1.0, 1.0, 70.0, True, None)
    assert found[1, 3] == (True, 4, 0, 1, 70.0, 5.0, 0.0, 75.0, False, True)
    assert found[1, 4] == (True, 0, 11, 1, 50.0, 5.0, 0.0, 55.0, None, False)
    assert found[1, 5] == (True, 0, 16, 1, 55.0, 5.0, 0.0, 60.0, None, None)
    assert found[1, 6] == found[1, 7] == (False, None, None, 0, None, 0.0, 0.0, None, None, None)
    assert found[2, 1] == (True, None, None, 1, None, 4.0, 0.0, None, None, None) and found[2, 2] == (True, 0, 0, 1, 5.0, 1.0, 0.0, 6.0, True, None)
    assert reconcile.check_periods(moves.limit(0), periods).count() == 9 and reconcile.check_periods(moves, periods.limit(0)).count() == 0


def test_no_cross_join(spark):
    plan = reconcile.in_periods(spark.createDataFrame([], MOVE), spark.createDataFrame([], PERIOD))._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan
    moves = spark.range(10).selectExpr("cast(id as int) account", "date'2024-01-01' date", "1.0D deposit")
    physical = reconcile.in_periods(moves, spark.createDataFrame([(1, 1, day(0), day(1), None, None)], PERIOD))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in physical and "Cartesian" not in physical
