"""Panels, folds and closed-form back-tests on small literals."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelforge.operators import allocation, backtest, books, folds, metrics
from panelforge.functions import kernels as K
from panelforge.sources import panels


def prices(spark, rows):
    return spark.createDataFrame([(dt.date(2020, 1, i + 1), a, float(p)) for i, day in enumerate(rows) for a, p in zip("AB", day, strict=True) if p is not None], "date date, asset string, price double")


def test_missing_dates_make_no_return(spark):
    got = {(r.date.day, r.asset): r.ret for r in panels.simple_returns(prices(spark, [(1, 2), (2, None), (3, 3), (6, 6)])).collect()}
    assert got[2, "A"] == 1 and got[3, "B"] is None and got[4, "B"] == 1
    assert panels.complete_returns(prices(spark, [(1, 2), (2, None), (3, 3), (6, 6)])).count() == 2


def test_validation(spark):
    assert panels.violations(prices(spark, [(1, 2)])).count() == 0
    bad = prices(spark, [(1, -2)]).union(prices(spark, [(1, -2)]))
    with pytest.raises(ValueError, match="repeated cell"):
        panels.require_valid(bad)


def test_spec():
    assert panels.parse_spec("a(20)") == ("a", 20) and panels.parse_spec("a:5") == ("a", 5) and panels.parse_spec("a") == ("a", None)


def two_days(spark):
    test = spark.createDataFrame([(0, 0, "A", 0.1), (0, 0, "B", 0.0), (0, 1, "A", 0.0), (0, 1, "B", 0.1)], "fold_id int, row_idx int, asset string, ret double")
    book = spark.createDataFrame([(0, "A", 0.5), (0, "B", 0.5)], "fold_id int, asset string, w double")
    return backtest.holdings(test, book)


def test_two_day_literal(spark):
    held = two_days(spark)
    constant = [r.gross for r in backtest.rebalanced(held)[0].orderBy("row_idx").collect()]
    drifted = [r.gross for r in backtest.drifting(held)[0].orderBy("row_idx").collect()]
    assert constant == pytest.approx([0.05, 0.05]) and drifted == pytest.approx([0.05, 0.05 / 1.05])


def test_total_loss_fails_the_fold(spark):
    test = spark.createDataFrame([(0, 0, "A", -1.0), (0, 1, "A", 0.5)], "fold_id int, row_idx int, asset string, ret double")
    book = spark.createDataFrame([(0, "A", 1.0)], "fold_id int, asset string, w double")
    assert backtest.drifting(backtest.holdings(test, book))[0].count() == 0
    assert backtest.rebalanced(backtest.holdings(test, book))[0].count() == 0


def test_drawdown_counts_initial_capital(spark):
    path = spark.createDataFrame([(0, 0, -0.1), (0, 1, 0.05)], "g int, row_idx int, ret double")
    assert metrics.drawdowns(path, ["g"]).first().max_dd_geo == pytest.approx(0.1)


def test_cvar_of_forty_rows_is_two(spark):
    path = spark.createDataFrame([(0, i, -0.01 * i) for i in range(40)], "g int, row_idx int, ret double")
    assert metrics.cvar(path, ["g"]).first().cvar95 == pytest.approx((0.39 + 0.38) / 2)


def test_folds_and_no_leak(spark):
    rows = [(i, dt.date(2020, 1, 1) + dt.timedelta(i), a, k, 0.01 * ((i * 7 + k * 3) % 11 - 5)) for i in range(100) for k, a in enumerate("ABCD")]
    returns = spark.createDataFrame(rows, "row_idx int, date date, asset string, asset_idx int, ret double")
    table = folds.fold_table(returns, 40, 40)
    assert [tuple(r) for r in table.collect()] == [(0, 0, 40, 40, 80)]
    assert folds.fold_table(returns, 40, 40, keep_tail=True).count() == 2
    train = folds.fold_rows(returns, table, "train")
    later = returns.withColumn("ret", F.when(F.col("row_idx") >= 40, 9.0).otherwise(F.col("ret")))
    w = lambda r: sorted((x.asset, x.w) for x in allocation.allocations(folds.fold_rows(r, table, "train"), {"c": K.Params()}).collect())
    assert w(returns) == w(later) == w(returns.repartition(7))
    assert books.contract(books.equal_weight(train)).first().violation == "equal weight"
    broken = allocation.allocations(train, {"c": K.Params()}, lambda x, p: 1 / 0).select("status").distinct().collect()
    assert [r.status for r in broken] == ["failed"]
