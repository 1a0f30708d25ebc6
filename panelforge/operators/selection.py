"""Choosing among configurations by their own history: yearly percentile ranks, gates, survivors of a first phase."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..sources.stored import stored
from . import engine, metrics
from .scoring import average_rank

#: Share of degraded folds that a candidate may have, and rows that a year must have.
DEGRADED, YEAR_ROWS = 0.05, 126
#: Values that differ by less of the largest magnitude are equal: what the order of summing leaves, not the candidates.
NOISE = 1e-10


def percentile_means(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows (candidate, sharpe, ret, max_dd) with the mean of three average-rank percentiles within by; less drawdown is better.

    Values within NOISE of each other tie. Ranks are summed before they are divided, so equal sums are equal percentiles.
    """
    keys = [F.col(b) for b in by]
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    for c, v in (("_sharpe", F.col("sharpe")), ("_ret", F.col("ret")), ("_fall", -F.col("max_dd"))):
        scale = F.max(F.when(F.abs(v) < float("inf"), F.abs(v))).over(Window.partitionBy(*keys))
        rows = rows.withColumn(c, F.coalesce(F.rint(F.try_divide(v, scale * NOISE)), v))
    ranks = [average_rank(F.col(c), keys) for c in ("_sharpe", "_ret", "_fall")]
    return rows.withColumn("percentile", (ranks[0] + ranks[1] + ranks[2]) / 3 / n).drop("_sharpe", "_ret", "_fall")


def internal_ranking(whole: DataFrame, yearly: DataFrame) -> DataFrame:
    """Candidates from the best on, with place, eligible, and the median, lower quartile and full-period percentiles.

    whole: (candidate, failed, degradation, sharpe, ret, max_dd); yearly: (candidate, year, sharpe, ret, max_dd). Only
    candidates without failures, with a Sharpe ratio and few degraded folds are ranked; the others come last with -1.
    """
    gate = (F.col("failed") == 0) & F.col("sharpe").isNotNull() & (F.coalesce("degradation", F.lit(0.0)) <= DEGRADED)
    marked = whole.withColumn("eligible", F.coalesce(gate, F.lit(False)))
    good = marked.filter("eligible").withColumn("all", F.lit(1))
    full = percentile_means(good, ["all"]).select("candidate", F.col("percentile").alias("full_period"))
    years = percentile_means(yearly.filter("sharpe IS NOT NULL").join(good.select("candidate"), "candidate", "left_semi"), ["year"])
    spread = years.groupBy("candidate").agg(F.median("percentile").alias("middle"), F.percentile("percentile", 0.25).alias("lower"))
    told = marked.join(full, "candidate", "left").join(spread, "candidate", "left")
    out = told.select("candidate", "eligible", *(F.when(F.col("eligible"), F.coalesce(c, "full_period")).otherwise(-1.0).alias(n) for c, n in (("middle", "median_year"), ("lower", "lower_quartile_year"), ("full_period", "full_period"))), F.coalesce("degradation", F.lit(1.0)).alias("degradation"))
    order = Window.orderBy(F.desc("eligible"), F.desc("median_year"), F.desc("lower_quartile_year"), F.desc("full_period"), "degradation", "candidate")  # candidates are a handful
    return out.withColumn("place", F.row_number().over(order))


def survivors(ranking: DataFrame, many: int) -> DataFrame:
    """The best eligible candidates."""
    return ranking.filter((F.col("place") <= many) & F.col("eligible"))


def grid() -> dict[str, K.Params]:
    """The fourteen candidates of the first phase."""
    made = {f"qp_{p:g}_{m:g}": K.Params(penalty=p, recent_mix=m) for p in (0.25, 1.0, 4.0) for m in (0.0, 0.25, 0.5, 0.75)}
    return made | {"hrp": K.Params(method="hrp"), "ivp": K.Params(method="inverse_volatility", legacy=True)}


def phase(returns: DataFrame, configs: dict[str, K.Params], lookback: int, step: int, start: str | None, end: str | None, least: int = YEAR_ROWS) -> DataFrame:
    """The ranking of configurations over one phase; rows after its end are never seen."""
    run = engine.walk_forward(returns, configs, lookback, step, start=start, end=end)
    whole = run.summary.select(F.col("config").alias("candidate"), "failed", F.col("degradation_rate").alias("degradation"), "sharpe", F.col("cagr").alias("ret"), F.col("max_dd_geo").alias("max_dd"))
    dated = run.path.join(returns.select("row_idx", "date").distinct(), "row_idx").withColumn("year", F.year("date"))
    by = ["config", "year"]
    years = metrics.performance(dated, by, "net").join(metrics.drawdowns(dated, by, "net"), by).filter(F.col("n") >= least)
    return internal_ranking(whole, years.select(F.col("config").alias("candidate"), "year", "sharpe", F.col("cagr").alias("ret"), F.col("max_dd_geo").alias("max_dd")))


def tuned(returns: DataFrame, configs: dict[str, K.Params], lookback: int, step: int, until: str, end: str, many: int = 3, half_lives: tuple[float, ...] = (42.0, 126.0), least: int = YEAR_ROWS) -> DataFrame:
    """Two phases: all candidates up to `until`, then the best of them, with other half-lives, after it; rows (phase, candidate, .., place)."""
    first = phase(returns, configs, lookback, step, None, until, least)
    first = stored(first, "development")
    kept = [r.candidate for r in survivors(first, many).orderBy("place").collect()]  # many rows
    again = {c: configs[c] for c in kept}
    for c in kept:
        if configs[c].recent_mix > 0 and configs[c].method != "inverse_volatility":
            again |= {f"{c}_h{h:g}": K.Params(**{**vars(configs[c]), "half_life": h}) for h in half_lives}
    out = first.withColumn("phase", F.lit("development"))
    return out.unionByName(phase(returns, again, lookback, step, until, end, least).withColumn("phase", F.lit("validation"))) if again else out
