"""Performance of return paths (group columns, row_idx, ret), as aggregates and running windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

YEAR = 252
#: What is taken off the tail's size before it is rounded up, so 5 % of 40 rows are two rows.
TAIL_SLACK = 1e-9


def safe_sharpe(mean: Column, sd: Column, periods: float) -> Column:
    return F.when(sd > 1e-15, F.try_divide(mean, sd) * F.sqrt(F.lit(float(periods))))


def performance(path: DataFrame, by: list[str], value: str = "ret", periods: float = YEAR) -> DataFrame:
    """Annualised mean and volatility, cumulative return, CAGR (in logs, NULL after a total loss) and Sharpe ratio."""
    r = F.col(value)
    sums = path.groupBy(*by).agg(F.count(r).alias("n"), F.avg(r).alias("m"), F.coalesce(F.stddev_samp(r), F.lit(0.0)).alias("sd"), F.sum(F.when(r > -1, F.log1p(r))).alias("logs"), F.min(r).alias("low"))
    alive = F.col("low") > -1
    return sums.select(
        *by,
        "n",
        (F.col("m") * periods).alias("annual_mean"),
        (F.col("sd") * F.sqrt(F.lit(float(periods)))).alias("annual_vol"),
        F.when(alive, F.expm1("logs")).otherwise(-1.0).alias("cumulative"),
        F.when(alive, F.expm1(F.col("logs") * periods / F.col("n"))).alias("cagr"),
        safe_sharpe(F.col("m"), F.col("sd"), periods).alias("sharpe"),
    )


def drawdowns(path: DataFrame, by: list[str], value: str = "ret") -> DataFrame:
    """Largest geometric drawdown (initial capital counts) and largest arithmetic one (it doesn't)."""
    run = Window.partitionBy(*by).orderBy("row_idx").rowsBetween(Window.unboundedPreceding, 0)
    grown = path.withColumn("wealth", F.product(1 + F.col(value)).over(run)).withColumn("total", F.sum(value).over(run))
    high = F.greatest(F.max("wealth").over(run), F.lit(1.0))
    fallen = grown.withColumn("geo", 1 - F.col("wealth") / high).withColumn("arith", F.max("total").over(run) - F.col("total"))
    return fallen.groupBy(*by).agg(F.greatest(F.max("geo"), F.lit(0.0)).alias("max_dd_geo"), F.max("arith").alias("max_dd_arith"))


def cvar(path: DataFrame, by: list[str], value: str = "ret", tail: float = 0.05) -> DataFrame:
    """Mean loss in the worst share of rows, the last row counted in part."""
    up = Window.partitionBy(*by).orderBy(value, "row_idx")
    ranked = path.withColumn("k", F.row_number().over(up)).withColumn("size", F.count(F.lit(1)).over(Window.partitionBy(*by)) * tail)
    part = F.least(F.greatest(F.col("size") - F.col("k") + 1, F.lit(0.0)), F.lit(1.0))
    kept = F.when(F.col("k") <= F.ceil(F.col("size") - TAIL_SLACK), part).otherwise(0.0)
    return ranked.groupBy(*by).agg((-F.sum(kept * F.col(value)) / F.sum(kept)).alias("cvar95"))


def fold_metrics(path: DataFrame, by: list[str], value: str = "ret", periods: float = YEAR) -> DataFrame:
    """All of the above for each group."""
    return performance(path, by, value, periods).join(drawdowns(path, by, value), by).join(cvar(path, by, value), by)


def medians(folds: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Medians over folds of Sharpe ratio, CVaR and annual mean, with 5th and 95th percentiles of CVaR."""
    return folds.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("folds"), F.median("sharpe").alias("median_sharpe"), F.median("cvar95").alias("median_cvar95"), F.median("annual_mean").alias("median_annual"), F.percentile("cvar95", 0.05).alias("cvar95_p05"), F.percentile("cvar95", 0.95).alias("cvar95_p95"))


def extended(path: DataFrame, by: list[str], value: str = "ret") -> DataFrame:
    """The summary's other moments: variance, semi-variance, mean absolute deviation, value at risk, skew, kurtosis, Sortino, ulcer."""
    means = path.groupBy(*by).agg(F.avg(value).alias("m"))
    d = F.col(value) - F.col("m")
    rows = path.join(F.broadcast(means), by)
    run = Window.partitionBy(*by).orderBy("row_idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("wealth", F.product(1 + F.col(value)).over(run))
    rows = rows.withColumn("fallen", 1 - F.col("wealth") / F.greatest(F.max("wealth").over(run), F.lit(1.0)))
    n = F.count(value)
    semi = F.sum(F.pow(F.least(d, F.lit(0.0)), 2.0)) / (n - 1)
    m2, m3, m4 = (F.avg(F.pow(d, float(k))) for k in (2, 3, 4))
    return rows.groupBy(*by).agg(
        F.var_samp(value).alias("variance"),
        semi.alias("semi_variance"),
        F.avg(F.abs(d)).alias("mean_abs_dev"),
        (-F.percentile(value, 0.05)).alias("value_at_risk"),
        F.when(m2 > 0, F.try_divide(m3, F.pow(m2, F.lit(1.5)))).alias("skew"),
        F.when(m2 > 0, F.try_divide(m4, m2 * m2)).alias("kurtosis"),
        F.when(semi > 0, F.try_divide(F.avg(value), F.sqrt(semi)) * F.sqrt(F.lit(float(YEAR)))).alias("sortino"),
        F.sqrt(F.avg(F.pow("fallen", 2.0))).alias("ulcer"),
        (-F.min(value)).alias("worst"),
    )


#: Points of a grid over the scale of entropic value at risk, and how often it is refined about its best point.
POINTS, ROUNDS = 24, 4


def entropic_value_at_risk(path: DataFrame, by: list[str], value: str, out: str, tail: float = 0.05) -> DataFrame:
    """The least over z of z ln(mean(exp(loss / z)) / tail), losses being -value; z in units of the largest loss in size.

    The function is convex in z, so a grid of powers that closes in on its best point finds the minimum.
    """
    sized = path.groupBy(*by).agg(F.max(F.abs(F.col(value))).alias("size"))
    rows = path.join(sized, by).filter("size > 0").withColumn("loss", -F.col(value) / F.col("size"))
    grid = rows.select(*by).distinct().withColumn("centre", F.lit(0.0))
    width = 8.0
    best = grid
    for _ in range(ROUNDS):
        steps = F.transform(F.sequence(F.lit(-POINTS), F.lit(POINTS)), lambda i: i * (width / POINTS))
        tried = best.select(*by, F.explode(F.transform(steps, lambda d: F.col("centre") + d)).alias("power"))
        z = F.pow(F.lit(2.0), F.col("power"))
        # the largest loss is taken out of the sum, so nothing overflows
        scored = rows.join(tried, by).groupBy(*by, "power").agg(F.max("loss").alias("top"), F.collect_list("loss").alias("losses"))
        mean = F.aggregate("losses", F.lit(0.0), lambda a, x: a + F.exp((x - F.col("top")) / z)) / F.size("losses")
        risk = F.col("top") + z * (F.log(mean) - F.log(F.lit(tail)))
        best = scored.select(*by, "power", risk.alias("risk")).groupBy(*by).agg(F.min(F.struct("risk", "power")).alias("b")).select(*by, F.col("b.power").alias("centre"), F.col("b.risk").alias("risk"))
        width = 2 * width / POINTS
    return best.join(sized, by).select(*by, (F.col("risk") * F.col("size")).alias(out))


def tails(path: DataFrame, by: list[str], value: str = "ret", tail: float = 0.05, periods: float = YEAR) -> DataFrame:
    """Gini mean difference, entropic risk, first lower partial moment, and the arithmetic drawdowns' mean, value at risk, CVaR and Calmar ratio."""
    run = Window.partitionBy(*by).orderBy("row_idx").rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy(*by)
    rows = path.withColumn("total", F.sum(value).over(run)).withColumn("fallen", F.max("total").over(run) - F.col("total"))
    rows = rows.withColumn("m", F.avg(value).over(up)).withColumn("n", F.count(F.lit(1)).over(up)).withColumn("place", F.row_number().over(up.orderBy(value, "row_idx")))
    deep = rows.withColumn("depth", F.row_number().over(up.orderBy(F.desc("fallen"), "row_idx"))).withColumn("size", F.col("n") * tail)
    part = F.least(F.greatest(F.col("size") - F.col("depth") + 1, F.lit(0.0)), F.lit(1.0))
    kept = F.when(F.col("depth") <= F.ceil(F.col("size") - TAIL_SLACK), part).otherwise(0.0)
    spread = (2 * F.col("place") - F.col("n") - 1) * F.col(value)
    return deep.groupBy(*by).agg(
        (2 * F.sum(spread) / (F.first("n") * (F.first("n") - 1))).alias("gini"),
        (F.log(F.avg(F.exp(-F.col(value)))) - F.log(F.lit(tail))).alias("entropic"),
        F.avg(F.greatest(F.col("m") - F.col(value), F.lit(0.0))).alias("lower_moment"),
        F.avg("fallen").alias("mean_drawdown"),
        F.percentile("fallen", 1 - tail).alias("drawdown_at_risk"),
        F.try_divide(F.sum(kept * F.col("fallen")), F.sum(kept)).alias("cdar"),
        F.try_divide(F.first("m") * periods, F.max("fallen")).alias("calmar"),
    )


def yearly(path: DataFrame, dates: DataFrame, least: int, value: str = "ret") -> DataFrame:
    """performance() by calendar year, of years with enough rows; dates: (row_idx, date)."""
    rows = path.join(F.broadcast(dates), "row_idx").withColumn("year", F.year("date"))
    return performance(rows, ["year"], value).filter(F.col("n") >= least)


def win_rates(a: DataFrame, b: DataFrame) -> DataFrame:
    """How often metrics a beat metrics b of the same fold: higher Sharpe ratio and mean, smaller drawdown."""
    x, y = (m.select("fold_id", *(F.col(c).alias(f"{c}_{s}") for c in ("sharpe", "annual_mean", "max_dd_geo"))) for m, s in ((a, "a"), (b, "b")))
    wins = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return x.join(y, "fold_id").agg(wins(F.col("sharpe_a") > F.col("sharpe_b")).alias("sharpe_wins"), wins(F.col("annual_mean_a") > F.col("annual_mean_b")).alias("return_wins"), wins(F.col("max_dd_geo_a") < F.col("max_dd_geo_b")).alias("drawdown_wins"))
