"""Registry of the engine's queries and their SQL."""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..operators import allocation, backtest, books, engine, factors, folds, metrics, projections, risk, scoring
from ..sources import panels
from ..sources.stored import stored
from .sqlref import digits, r, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

LOOK, STEP = 40, 40
LITTLE = {"int", "smallint", "tinyint"}


def tidy(df: DataFrame) -> DataFrame:
    """Doubles rounded to their column's digits (no negative zero), whole numbers as long: comparable across engines."""
    return df.select(*((F.round(c, digits(c)) + F.lit(0.0)).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in LITTLE else F.col(c) for c, t in df.dtypes))


def release() -> None:
    """Free the panel that is held; one of a session that has ended is only forgotten."""
    session = SparkSession.getActiveSession()
    for key, held in _last.items():
        if session is not None and key[0] == session.sparkContext.applicationId:
            for name in ("returns", "train", "test"):
                held[name].unpersist()
    _last.clear()


def query(name: str, text: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: tidy(f(spark, sf_dir))
        if text:
            SQL[name] = text
        return f

    return register


#: The panel that queries of this session read last, with its folds.
_last: dict[tuple, dict[str, DataFrame]] = {}


class Base:
    """The panel, folds, books and paths that most queries share."""

    def __init__(self, spark: SparkSession, sf_dir: str, panel: str = "brand", look: int = LOOK, step: int = STEP):
        # one row per period and asset however large the trades' table is; every fold, book and path reads it again
        key = (spark.sparkContext.applicationId, sf_dir, panel, look, step)
        if key not in _last:
            release()
            returns = panels.panel(spark, sf_dir, panel)
            table = folds.fold_table(returns, look, step)
            _last[key] = {"returns": returns, "folds": table, "train": folds.fold_rows(returns, table, "train"), "test": folds.fold_rows(returns, table, "test")}
        held = _last[key]
        self.returns, self.folds = held["returns"].persist(), held["folds"]
        self.train, self.test = held["train"].persist(), held["test"].persist()

    def ivp(self) -> DataFrame:
        return books.inverse_volatility(self.train)

    def held(self, book: DataFrame | None = None) -> DataFrame:
        return backtest.holdings(self.test, book if book is not None else self.ivp())

    def path(self, book: DataFrame | None = None) -> DataFrame:
        path, _ = backtest.rebalanced(self.held(book))
        return path

    def metrics(self, book: DataFrame | None = None) -> DataFrame:
        return metrics.fold_metrics(self.path(book).withColumnRenamed("gross", "ret"), ["fold_id"])

    def indexed(self, book: DataFrame) -> DataFrame:
        return book.join(F.broadcast(self.returns.select("asset", "asset_idx").distinct()), "asset")


# --- panels and folds --------------------------------------------------------------------------------------------


@query("panel_returns", sql(f"SELECT date, asset, {r('ln(price) AS log_price', 'ret')} FROM mv", "nation"))
def _(spark, d):
    return panels.simple_returns(panels.PanelSpec("nation").prices(spark, d)).select("date", "asset", F.ln("price").alias("log_price"), "ret")


for _panel in ("brand", "flag", "region", "priority"):

    @query("complete_rows" if _panel == "brand" else f"complete_rows_{_panel}", sql(f"SELECT row_idx, date, asset, asset_idx, {r('ret')} FROM rt", _panel))
    def _(spark, d, panel=_panel):
        return panels.panel(spark, d, panel)


@query("first_assets", sql(f"SELECT row_idx, asset, {r('ret')} FROM rt WHERE asset_idx < 8"))
def _(spark, d):
    return panels.first_assets(panels.panel(spark, d, "brand"), 8).select("row_idx", "asset", "ret")


@query("validation", sql("SELECT 'repeated cell' AS rule, count(*) AS n FROM (SELECT date, asset FROM px GROUP BY ALL HAVING count(*) > 1) HAVING count(*) > 0 UNION ALL SELECT 'impossible price', count(*) FROM px WHERE price < 0 HAVING count(*) > 0"))
def _(spark, d):
    return panels.violations(panels.PanelSpec("brand").prices(spark, d))


@query("fold_table", sql("SELECT fold_id, train_lo, train_hi, test_lo, test_hi FROM fd", look=60, step=20))
def _(spark, d):
    return Base(spark, d, look=60, step=20).folds


@query("fold_table_tail", sql("SELECT i AS fold_id, i * 40 AS train_lo, 40 + i * 40 AS train_hi, 40 + i * 40 AS test_lo, least(n, 80 + i * 40) AS test_hi FROM (SELECT n, unnest(range(0, greatest(0, (n - 41) // 40 + 1))) AS i FROM (SELECT count(DISTINCT row_idx) AS n FROM rt))"))
def _(spark, d):
    return folds.fold_table(panels.panel(spark, d, "brand"), LOOK, STEP, keep_tail=True)


SPARSE = {
    "md": "SELECT max(di) + 1 AS n FROM di",
    "wf": "SELECT i AS fold_id, i * 40 AS lo, i * 40 + 40 AS hi FROM (SELECT unnest(range(0, greatest(0, (n - 40) // 40))) AS i FROM md)",
    "cell": "SELECT wf.fold_id, di.di - lo AS k, ai.asset, mv.ret FROM wf JOIN di ON di.di >= lo AND di.di < hi CROSS JOIN ai LEFT JOIN mv ON mv.di = di.di AND mv.asset = ai.asset",
    "seen": "SELECT fold_id, asset, count(*) FILTER (ret IS NOT NULL AND ret >= -1) AS n_valid, coalesce(bool_or(k = 39 AND ret IS NOT NULL AND ret >= -1), false) AS last_valid FROM cell GROUP BY fold_id, asset",
    "tops": "SELECT fold_id, max(n_valid) AS most, count(*) FILTER (n_valid > 0 AND last_valid) AS alive FROM seen GROUP BY fold_id",
}


def sparse_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 40 dates over the nation panel, one cell for each date and asset, missing returns null."""
    prices = panels.PanelSpec("nation").prices(spark, d)
    dates = panels.date_index(prices)
    spans = dates.agg((F.max("di") + 1).alias("n")).select(F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 80) / 40).cast("int"))).alias("fold_id")).filter("fold_id >= 0")
    unrolled = spans.select("fold_id", F.posexplode(F.sequence(F.col("fold_id") * 40, F.col("fold_id") * 40 + 39)).alias("k", "di"))
    grid = unrolled.crossJoin(F.broadcast(panels.asset_index(prices)))  # folds x rows x assets: the windows' own size
    moved = panels.simple_returns(prices).select("di", "asset", "ret")
    return grid.join(moved, ["di", "asset"], "left").withColumn("rows", F.lit(40)).withColumn("row_idx", F.col("k"))


@query("eligibility", sql("SELECT seen.fold_id, asset, n_valid, last_valid, n_valid >= 32 AND last_valid AS eligible, CASE WHEN alive > 0 THEN n_valid > 0 AND last_valid ELSE n_valid = most END AS emergency FROM seen JOIN tops ON seen.fold_id = tops.fold_id", "nation", **SPARSE))
def _(spark, d):
    return risk.eligibility(sparse_windows(spark, d))


@query("common_rows", sql("SELECT cell.fold_id, k, count(*) FILTER (ret IS NOT NULL) AS n_valid, count(*) FILTER (ret IS NOT NULL) = count(*) AS complete FROM cell JOIN seen ON cell.fold_id = seen.fold_id AND cell.asset = seen.asset AND n_valid >= 32 AND last_valid GROUP BY cell.fold_id, k", "nation", **SPARSE))
def _(spark, d):
    cells = sparse_windows(spark, d)
    kept = risk.eligibility(cells).filter("eligible").select("fold_id", "asset")
    return cells.join(kept, ["fold_id", "asset"]).groupBy("fold_id", "k").agg(F.count("ret").alias("n_valid"), (F.count("ret") == F.count(F.lit(1))).alias("complete"))


@query("common_scale", sql(f"SELECT fold_id, asset, row_idx, {r('ret / max(abs(ret)) OVER (PARTITION BY fold_id) AS scaled')} FROM tr"))
def _(spark, d):
    top = F.max(F.abs("ret")).over(Window.partitionBy("fold_id"))
    return Base(spark, d).train.select("fold_id", "asset", "row_idx", F.try_divide(F.col("ret"), top).alias("scaled"))


# --- risk --------------------------------------------------------------------------------------------------------


@query("train_window_stats", sql(f"SELECT fold_id, asset, count(ret) AS n, {r('avg(ret) AS mean', 'stddev_samp(ret) AS sd', 'min(ret) AS low', 'max(ret) AS high', 'median(ret) AS mid', 'quantile_cont(ret, 0.05) AS p05', 'quantile_cont(ret, 0.95) AS p95')} FROM tr GROUP BY fold_id, asset"))
def _(spark, d):
    return risk.window_stats(Base(spark, d).train)


@query("cov_long", sql(f"SELECT a.fold_id, a.asset_idx AS i, b.asset_idx AS j, {r('covar_samp(a.ret, b.ret) AS cov')} FROM tr AS a JOIN tr AS b ON a.fold_id = b.fold_id AND a.row_idx = b.row_idx AND a.asset_idx <= b.asset_idx GROUP BY 1, 2, 3"))
def _(spark, d):
    return risk.covariance(Base(spark, d).train)


AGED = {
    "ag": "SELECT *, pow(2.0, -(train_hi - 1 - row_idx) / 10.0) / sum(pow(2.0, -(train_hi - 1 - row_idx) / 10.0)) OVER (PARTITION BY fold_id, asset) AS alpha FROM tr",
    "am": "SELECT fold_id, asset, sum(alpha * ret) AS m FROM ag GROUP BY fold_id, asset",
    "ac": "SELECT ag.*, ag.ret - m AS c FROM ag JOIN am ON ag.fold_id = am.fold_id AND ag.asset = am.asset",
}


@query("ewma_var", sql(f"SELECT fold_id, asset, {r('sum(alpha * c * c) / greatest(1 - sum(alpha * alpha), 1e-12) AS ewma_var')} FROM ac GROUP BY fold_id, asset", **AGED))
def _(spark, d):
    b = Base(spark, d)
    return risk.ewma_variance(b.train, b.folds, 10.0)


@query("semicov_long", sql(f"SELECT a.fold_id, a.asset_idx AS i, b.asset_idx AS j, {r('sum(a.alpha * least(a.c, 0) * least(b.c, 0)) AS semicov')} FROM ac AS a JOIN ac AS b ON a.fold_id = b.fold_id AND a.row_idx = b.row_idx AND a.asset_idx <= b.asset_idx GROUP BY 1, 2, 3", **AGED))
def _(spark, d):
    b = Base(spark, d)
    return risk.downside(b.train, b.folds, 10.0)


WOLF = {
    "xc": "SELECT fold_id, row_idx, asset_idx, ret - avg(ret) OVER (PARTITION BY fold_id, asset_idx) AS x FROM tr",
    "sz": "SELECT fold_id, count(DISTINCT row_idx) AS t, count(DISTINCT asset_idx) AS n FROM xc GROUP BY fold_id",
    "pp": "SELECT a.fold_id, a.asset_idx AS i, b.asset_idx AS j, sum(a.x * b.x) AS s1, sum(a.x * b.x * a.x * b.x) AS s2 FROM xc AS a JOIN xc AS b ON a.fold_id = b.fold_id AND a.row_idx = b.row_idx GROUP BY 1, 2, 3",
    "ws": "SELECT pp.fold_id, any_value(t) AS t, any_value(n) AS n, sum(s1 / t) FILTER (i = j) AS tr_, sum(s1 / t * s1 / t) AS sq, sum(s2) AS fo FROM pp JOIN sz ON pp.fold_id = sz.fold_id GROUP BY pp.fold_id",
    "wb": "SELECT fold_id, tr_ / n AS mu, (sq - 2 * (tr_ / n) * tr_ + n * (tr_ / n) * (tr_ / n)) / n AS delta, (fo / t - sq) / (n * t) AS beta FROM ws",
}


@query("ledoit_wolf", sql(f"SELECT fold_id, {r('mu', 'delta', 'least(beta, delta) AS beta', 'least(beta, delta) / delta AS shrinkage')} FROM wb", **WOLF))
def _(spark, d):
    return risk.ledoit_wolf(Base(spark, d).train)


@query("noise_edge", sql(f"SELECT fold_id, {r('pow(1 + 1 / sqrt(count(DISTINCT row_idx)::DOUBLE / count(DISTINCT asset_idx)), 2) AS edge')} FROM tr GROUP BY fold_id"))
def _(spark, d):
    return Base(spark, d).train.groupBy("fold_id").agg(risk.noise_edge(F.count_distinct("row_idx"), F.count_distinct("asset_idx")).alias("edge"))


# --- projections -------------------------------------------------------------------------------------------------

LEVEL = "SELECT fold_id, arg_max((total - {target}) / k, k) AS level FROM (SELECT fold_id, {v} AS u, row_number() OVER w AS k, sum({v}) OVER w AS total FROM {source} WINDOW w AS (PARTITION BY fold_id ORDER BY {v} DESC, asset ROWS UNBOUNDED PRECEDING)) WHERE u > (total - {target}) / k GROUP BY fold_id"


def _level(target: str, v: str = "v", source: str = "mu") -> str:
    return LEVEL.format(target=target, v=v, source=source)


def mean_vectors(b: Base, times: float = 1.0) -> DataFrame:
    return b.train.groupBy("fold_id", "asset").agg((F.avg("ret") * times).alias("v"))


@query("simplex_projection", sql(f"SELECT mu.fold_id, asset, {r('greatest(v - level, 0) AS w')} FROM mu JOIN lv ON mu.fold_id = lv.fold_id", lv=_level("1.0")))
def _(spark, d):
    return projections.simplex(mean_vectors(Base(spark, d))).select("fold_id", "asset", "w")


@query("water_fill_level", sql(f"SELECT fold_id, {r('level')} FROM lv", lv=_level("0.25")))
def _(spark, d):
    return projections.water_level(mean_vectors(Base(spark, d)), 0.25)


@query("box_simplex_projection", sql(f"SELECT bx.fold_id, asset, {r('greatest(s - level, 0) - 0.02 AS w')} FROM bx JOIN lv ON bx.fold_id = lv.fold_id", bx="SELECT fold_id, asset, v + 0.02 AS s FROM mu", lv=_level("(1 + 0.02 * (SELECT count(*) FROM ai))", "s", "bx")))
def _(spark, d):
    return projections.box_simplex(mean_vectors(Base(spark, d)), 0.02).select("fold_id", "asset", "w")


GROSS = {
    "m5": "SELECT fold_id, asset, v * 20 AS v, -v * 20 AS m FROM mu",
    "la": _level("1.3", "v", "m5"),
    "lb": _level("0.3", "m", "m5"),
    "sf": "SELECT fold_id, asset, v + (1 - sum(v) OVER (PARTITION BY fold_id)) / count(*) OVER (PARTITION BY fold_id) AS s FROM m5",
    "sn": "SELECT fold_id, sum(greatest(-s, 0)) AS need FROM sf GROUP BY fold_id",
}


@query("gross_budget_projection", sql(f"SELECT m5.fold_id, m5.asset, {r('CASE WHEN need <= 0.3 + 1e-9 THEN s ELSE greatest(v - la.level, 0) - greatest(m - lb.level, 0) END AS w')} FROM m5 JOIN la ON la.fold_id = m5.fold_id JOIN lb ON lb.fold_id = m5.fold_id JOIN sf ON sf.fold_id = m5.fold_id AND sf.asset = m5.asset JOIN sn ON sn.fold_id = m5.fold_id", **GROSS))
def _(spark, d):
    return projections.gross_budget(mean_vectors(Base(spark, d), 20.0), 0.3).select("fold_id", "asset", "w")


# --- books -------------------------------------------------------------------------------------------------------


@query("ewp_book", sql(f"SELECT fold_id, asset, {r('w')} FROM ew"))
def _(spark, d):
    return books.equal_weight(Base(spark, d).train)


@query("ivp_book", sql(f"SELECT fold_id, asset, {r('w')} FROM iv"))
def _(spark, d):
    return Base(spark, d).ivp()


@query("inverse_risk_book", sql(f"SELECT fold_id, asset, {r('(1 / sqrt(greatest(sd * sd, 1e-12))) / sum(1 / sqrt(greatest(sd * sd, 1e-12))) OVER (PARTITION BY fold_id) AS w')} FROM sd"))
def _(spark, d):
    return books.inverse_risk(Base(spark, d).train)


@query("last_resort_book", sql(f"SELECT DISTINCT fold_id, asset, {r('((SELECT count(*) FROM ai) - asset_idx) / ((SELECT count(*) FROM ai) * ((SELECT count(*) FROM ai) + 1) / 2.0) AS w')} FROM tr"))
def _(spark, d):
    return books.last_resort(Base(spark, d).train)


@query("risk_ranked_book", sql(f"SELECT fold_id, asset, {r('(1.0 / k) / sum(1.0 / k) OVER (PARTITION BY fold_id) AS w')} FROM (SELECT *, row_number() OVER (PARTITION BY fold_id ORDER BY sd, asset) AS k FROM sd)"))
def _(spark, d):
    return books.risk_ranked(Base(spark, d).train)


@query("l1_distance", sql(f"SELECT iv.fold_id, {r('sum(abs(iv.w - ew.w)) AS l1')}, sum(abs(iv.w - ew.w)) < 1e-9 AS hit FROM iv JOIN ew ON iv.fold_id = ew.fold_id AND iv.asset = ew.asset GROUP BY iv.fold_id"))
def _(spark, d):
    b = Base(spark, d)
    return books.l1_distance(b.ivp(), books.equal_weight(b.train))


@query("weight_correlation", sql(f"SELECT iv.fold_id, {r('corr(iv.w, lr.w) AS corr')} FROM iv JOIN lr ON iv.fold_id = lr.fold_id AND iv.asset = lr.asset GROUP BY iv.fold_id", lr="SELECT DISTINCT fold_id, asset, (SELECT count(*) FROM ai) - asset_idx AS w FROM tr"))
def _(spark, d):
    b = Base(spark, d)
    return books.weight_correlation(b.ivp(), books.last_resort(b.train))


@query("exposure", sql(f"SELECT fold_id, {r('sum(greatest(w, 0)) AS long', 'sum(greatest(-w, 0)) AS short', 'sum(w) AS net', 'sum(abs(w)) AS gross', 'max(w) AS max_weight', '1 / sum(w * w) AS effective_n')} FROM lw GROUP BY fold_id", **GROSS, lw="SELECT m5.fold_id, m5.asset, CASE WHEN need <= 0.3 + 1e-9 THEN s ELSE greatest(v - la.level, 0) - greatest(m - lb.level, 0) END AS w FROM m5 JOIN la ON la.fold_id = m5.fold_id JOIN lb ON lb.fold_id = m5.fold_id JOIN sf ON sf.fold_id = m5.fold_id AND sf.asset = m5.asset JOIN sn ON sn.fold_id = m5.fold_id"))
def _(spark, d):
    return books.exposure(projections.gross_budget(mean_vectors(Base(spark, d), 20.0), 0.3))


@query("weight_contract", sql("SELECT fold_id, 'equal weight' AS violation, true AS equal, 'ewp' AS book FROM (SELECT DISTINCT fold_id FROM ew) UNION ALL SELECT DISTINCT fold_id, NULL, false, 'ivp' FROM iv"))
def _(spark, d):
    b = Base(spark, d)
    return books.contract(books.equal_weight(b.train)).withColumn("book", F.lit("ewp")).unionByName(books.contract(b.ivp()).withColumn("book", F.lit("ivp")))


@query("relative_objective", sql(f"SELECT fold_id, {r('(wcw / bcb) + 4.0 * gap / size AS objective')} FROM fo JOIN gs USING (fold_id)", cl="SELECT a.fold_id, a.asset AS i, b.asset AS j, covar_samp(a.ret, b.ret) AS c FROM tr AS a JOIN tr AS b ON a.fold_id = b.fold_id AND a.row_idx = b.row_idx GROUP BY 1, 2, 3", wb="SELECT iv.fold_id, iv.asset, iv.w, ew.w AS b FROM iv JOIN ew ON iv.fold_id = ew.fold_id AND iv.asset = ew.asset", fo="SELECT cl.fold_id, sum(c * x.w * y.w) AS wcw, sum(c * x.b * y.b) AS bcb FROM cl JOIN wb AS x ON x.fold_id = cl.fold_id AND x.asset = cl.i JOIN wb AS y ON y.fold_id = cl.fold_id AND y.asset = cl.j GROUP BY cl.fold_id", gs="SELECT fold_id, sum((w - b) * (w - b)) AS gap, sum(b * b) AS size FROM wb GROUP BY fold_id"))
def _(spark, d):
    b = Base(spark, d)
    return books.relative_objective(risk.covariance(b.train), b.indexed(b.ivp()), b.indexed(books.equal_weight(b.train)), 4.0)


# --- paths and metrics -------------------------------------------------------------------------------------------


@query("hold_drift", sql(f"SELECT fold_id, row_idx, {r('wealth / lag(wealth, 1, 1.0) OVER (PARTITION BY fold_id ORDER BY row_idx) - 1 AS gross')} FROM wl"))
def _(spark, d):
    return backtest.drifting(Base(spark, d).held())[0].select("fold_id", "row_idx", "gross")


@query("drift_end_weights", sql(f"SELECT sh.fold_id, asset, {r('share / sum(share) OVER (PARTITION BY sh.fold_id) AS w_end')} FROM sh JOIN fd ON sh.fold_id = fd.fold_id AND row_idx = test_hi - 1"))
def _(spark, d):
    return backtest.drifting(Base(spark, d).held())[1]


@query("hold_rebalance", sql(f"SELECT fold_id, row_idx, {r('gross', 'turnover')} FROM tv"))
def _(spark, d):
    return Base(spark, d).path()


COST = {
    "en": "SELECT dr.fold_id + 1 AS fold_id, asset, moved FROM dr JOIN fd ON dr.fold_id = fd.fold_id AND row_idx = test_hi - 1",
    "tt": "SELECT iv.fold_id, sum(abs(w - coalesce(moved, 0))) AS trade FROM iv LEFT JOIN en ON en.fold_id = iv.fold_id AND en.asset = iv.asset GROUP BY iv.fold_id",
    "tc": "SELECT tv.fold_id, row_idx, gross, turnover + CASE WHEN row_idx = test_lo THEN trade ELSE 0 END AS turnover FROM tv JOIN tt ON tv.fold_id = tt.fold_id JOIN fd ON tv.fold_id = fd.fold_id",
}


@query("turnover_cost", sql(f"SELECT fold_id, row_idx, {r('gross', 'turnover', '(1 - turnover * 0.001) * (1 + gross) - 1 AS net')} FROM tc", **COST))
def _(spark, d):
    b = Base(spark, d)
    path, ends = backtest.rebalanced(b.held())
    return backtest.net_path(path, backtest.rebalance_turnover(b.ivp(), ends), 10.0)


METRICS = ("annual_mean", "annual_vol", "cumulative", "log_cagr", "sharpe", "max_dd_geo", "max_dd_arith", "cvar95")


@query("fold_metrics", sql(f"SELECT fold_id, n, {r(*(m if m != 'log_cagr' else 'ln(1 + cagr) AS log_cagr' for m in METRICS))} FROM fm"))
def _(spark, d):
    return Base(spark, d).metrics().withColumn("log_cagr", F.log1p("cagr")).select("fold_id", "n", *METRICS)


MEDIANS = "median(sharpe) AS median_sharpe", "median(cvar95) AS median_cvar95", "median(annual_mean) AS median_annual", "quantile_cont(cvar95, 0.05) AS cvar95_p05", "quantile_cont(cvar95, 0.95) AS cvar95_p95"


@query("median_metrics", sql(f"SELECT count(*) AS folds, {r(*MEDIANS)} FROM fm", "flag"))
def _(spark, d):
    return metrics.medians(Base(spark, d, "flag").metrics())


@query("max_drawdown_geo", sql(f"SELECT fold_id, {r('max_dd_geo')} FROM dd"))
def _(spark, d):
    return metrics.drawdowns(Base(spark, d).path(), ["fold_id"], "gross").select("fold_id", "max_dd_geo")


@query("max_drawdown_arith", sql(f"SELECT fold_id, {r('max_dd_arith')} FROM dd"))
def _(spark, d):
    return metrics.drawdowns(Base(spark, d).path(), ["fold_id"], "gross").select("fold_id", "max_dd_arith")


@query("cvar95", sql(f"SELECT fold_id, {r('cvar95')} FROM cv"))
def _(spark, d):
    return metrics.cvar(Base(spark, d).path(), ["fold_id"], "gross")


EXTENDED = """SELECT fold_id, {0} FROM (SELECT *, 1 - wealth / greatest(max(wealth) OVER (PARTITION BY fold_id ORDER BY row_idx), 1.0) AS fallen FROM (SELECT fold_id, row_idx, gross AS x, avg(gross) OVER (PARTITION BY fold_id) AS m, product(1 + gross) OVER (PARTITION BY fold_id ORDER BY row_idx) AS wealth FROM rb)) GROUP BY fold_id"""
_M2 = "avg(pow(x - m, 2))"
_SEMI = "(sum(pow(least(x - m, 0), 2)) / (count(*) - 1))"


@query("extended_summary", sql(EXTENDED.format(r("var_samp(x) AS variance", f"{_SEMI} AS semi_variance", "avg(abs(x - m)) AS mean_abs_dev", "-quantile_cont(x, 0.05) AS value_at_risk", f"avg(pow(x - m, 3)) / pow({_M2}, 1.5) AS skew", f"avg(pow(x - m, 4)) / ({_M2} * {_M2}) AS kurtosis", f"avg(x) / sqrt({_SEMI}) * sqrt(252) AS sortino", "sqrt(avg(fallen * fallen)) AS ulcer", "-min(x) AS worst"))))
def _(spark, d):
    return metrics.extended(Base(spark, d).path(), ["fold_id"], "gross")


@query("yearly_metrics", sql(f"SELECT year, n, {r('annual_mean', 'annual_vol', 'cumulative', 'ln(1 + cagr) AS log_cagr', 'sharpe')} FROM (SELECT year(date) AS year, count(*) AS n, avg(gross) * 252 AS annual_mean, stddev_samp(gross) * sqrt(252) AS annual_vol, exp(sum(ln(1 + gross))) - 1 AS cumulative, exp(sum(ln(1 + gross)) * 252 / count(*)) - 1 AS cagr, avg(gross) / stddev_samp(gross) * sqrt(252) AS sharpe FROM rb JOIN fl ON rb.row_idx = fl.row_idx GROUP BY 1 HAVING count(*) >= 20)"))
def _(spark, d):
    b = Base(spark, d)
    return metrics.yearly(b.path(), b.returns.select("row_idx", "date").distinct(), 20, "gross").withColumn("log_cagr", F.log1p("cagr")).drop("cagr")


EQUAL = {
    "eh": "SELECT te.fold_id, te.row_idx, avg(te.ret) AS gross FROM te GROUP BY te.fold_id, te.row_idx",
    "ep": "SELECT fold_id, avg(gross) * 252 AS annual_mean, avg(gross) / stddev_samp(gross) * sqrt(252) AS sharpe FROM eh GROUP BY fold_id",
    "ed": "SELECT fold_id, greatest(max(1 - wealth / greatest(high, 1.0)), 0.0) AS max_dd_geo FROM (SELECT *, max(wealth) OVER (PARTITION BY fold_id ORDER BY row_idx) AS high FROM (SELECT fold_id, row_idx, product(1 + gross) OVER (PARTITION BY fold_id ORDER BY row_idx) AS wealth FROM eh)) GROUP BY fold_id",
}


@query("equal_weight_path", sql(f"SELECT fold_id, row_idx, {r('gross')} FROM eh", **EQUAL))
def _(spark, d):
    b = Base(spark, d)
    return b.path(books.equal_weight(b.train)).select("fold_id", "row_idx", "gross")


@query("win_rates", sql(f"SELECT {r('avg(CASE WHEN fm.sharpe > ep.sharpe THEN 1.0 ELSE 0 END) AS sharpe_wins', 'avg(CASE WHEN fm.annual_mean > ep.annual_mean THEN 1.0 ELSE 0 END) AS return_wins', 'avg(CASE WHEN fm.max_dd_geo < ed.max_dd_geo THEN 1.0 ELSE 0 END) AS drawdown_wins')} FROM fm JOIN ep ON fm.fold_id = ep.fold_id JOIN ed ON fm.fold_id = ed.fold_id", **EQUAL))
def _(spark, d):
    b = Base(spark, d)
    return metrics.win_rates(b.metrics(), b.metrics(books.equal_weight(b.train)))


@query("bookkeeping", sql("SELECT count(*) AS folds, 0::BIGINT AS failed, 0.0::DOUBLE AS failure_rate FROM fd"))
def _(spark, d):
    b = Base(spark, d)
    return backtest.bookkeeping(b.folds, b.path())


# --- scoring -----------------------------------------------------------------------------------------------------

BOOKS = ("ewp", "ivp", "inverse_risk", "last_resort", "risk_ranked")


def field(spark: SparkSession, d: str) -> DataFrame:
    """Entries of a field: five books, each with its medians over folds and least distance to equal weight."""
    b = Base(spark, d)
    made = {"ewp": books.equal_weight(b.train), "ivp": b.ivp(), "inverse_risk": books.inverse_risk(b.train), "last_resort": books.last_resort(b.train), "risk_ranked": books.risk_ranked(b.train)}
    every = None
    for name, book in made.items():
        one = book.select(F.concat_ws("|", F.lit(name), F.col("fold_id")).alias("fold_id"), "asset", "w")
        every = one if every is None else every.unionByName(one)
    test = b.test.join(F.broadcast(spark.createDataFrame([(n,) for n in made], "label string"))).withColumn("fold_id", F.concat_ws("|", "label", "fold_id"))
    path, _ = backtest.rebalanced(backtest.holdings(test, every))
    path = path.select("fold_id", "row_idx", F.col("gross").alias("ret"))
    folds_ = metrics.performance(path, ["fold_id"]).join(metrics.cvar(path, ["fold_id"]), "fold_id").withColumn("label", F.substring_index("fold_id", "|", 1))
    entries = folds_.groupBy("label").agg(F.median("annual_mean").alias("median_annual"), F.median("sharpe").alias("median_sharpe"), F.median("cvar95").alias("median_cvar"), F.lit(0.0).alias("fail"))
    return stored(entries, "entries")  # one row per book


FIELD = {
    "bk": """SELECT 'ewp' AS label, fold_id, asset, w FROM ew UNION ALL SELECT 'ivp', fold_id, asset, w FROM iv
  UNION ALL SELECT 'inverse_risk', fold_id, asset, (1 / sqrt(greatest(sd * sd, 1e-12))) / sum(1 / sqrt(greatest(sd * sd, 1e-12))) OVER (PARTITION BY fold_id) FROM sd
  UNION ALL SELECT 'last_resort', fold_id, asset, k / sum(k) OVER (PARTITION BY fold_id) FROM (SELECT DISTINCT fold_id, asset, (SELECT count(*) FROM ai) - asset_idx AS k FROM tr)
  UNION ALL SELECT 'risk_ranked', fold_id, asset, (1.0 / k) / sum(1.0 / k) OVER (PARTITION BY fold_id) FROM (SELECT *, row_number() OVER (PARTITION BY fold_id ORDER BY sd, asset) AS k FROM sd)""",
    "bp": "SELECT label, te.fold_id, te.row_idx, sum(w * ret) AS gross FROM te JOIN bk ON te.fold_id = bk.fold_id AND te.asset = bk.asset GROUP BY ALL",
    "bc": "SELECT label, fold_id, -sum(gross) FILTER (k <= 2) / 2 AS cvar95, avg(gross) * 252 AS annual_mean, avg(gross) / stddev_samp(gross) * sqrt(252) AS sharpe FROM (SELECT *, row_number() OVER (PARTITION BY label, fold_id ORDER BY gross, row_idx) AS k FROM bp) GROUP BY label, fold_id",
    "fe": "SELECT label, median(annual_mean) AS median_annual, median(sharpe) AS median_sharpe, median(cvar95) AS median_cvar, 0.0 AS fail FROM bc GROUP BY label",
}


def _pct(metric: str, sign: str, source: str = "fe", by: str = "") -> str:
    """Percentile ranks of a metric with near-equal values tied."""
    part = f"PARTITION BY {by}" if by else ""
    and_by = f"{by}, " if by else ""
    return f"""SELECT {and_by}label, CASE WHEN n > 1 THEN (rk + (same - 1) / 2.0 - 1) / (n - 1) ELSE 0 END AS pct FROM (SELECT *, rank() OVER ({part} ORDER BY q) AS rk, count(*) OVER (PARTITION BY {and_by}q) AS same FROM (
  SELECT {and_by}label, round_even({sign}{metric} / (greatest(1.0, max(abs({metric})) OVER ({part})) * 1e-6), 0) AS q, count(*) OVER ({part}) AS n FROM {source}))"""


PCT = {"pa": _pct("median_annual", ""), "ps": _pct("median_sharpe", ""), "pc": _pct("median_cvar", "-")}


@query("field_entries", sql(f"SELECT label, {r('median_annual', 'median_sharpe', 'median_cvar', 'fail')} FROM fe", **FIELD))
def _(spark, d):
    return field(spark, d)


@query("rank_pct", sql(f"SELECT fe.label, {r('pa.pct AS annual_pct', 'pc.pct AS cvar_pct')} FROM fe JOIN pa ON pa.label = fe.label JOIN pc ON pc.label = fe.label", **FIELD, **PCT))
def _(spark, d):
    e = field(spark, d).withColumn("all", F.lit(1))
    e = scoring.rank_pct(e, "median_annual", ["all"], True, "annual_pct")
    return scoring.rank_pct(e, "median_cvar", ["all"], False, "cvar_pct").select("label", "annual_pct", "cvar_pct")


@query("rank_pct_midpoint", sql(f"SELECT label, {r('1 - (5 + 0.5 - (pct * 4 + 1)) / 5 AS pct')} FROM pa", **FIELD, **PCT))
def _(spark, d):
    return scoring.rank_pct(field(spark, d).withColumn("all", F.lit(1)), "median_annual", ["all"], True, "pct", midpoint=True).select("label", "pct")


@query("rank_ordinal", sql("SELECT label, row_number() OVER (ORDER BY median_cvar, label) AS place FROM fe", **FIELD))
def _(spark, d):
    return scoring.ordinal(field(spark, d).withColumn("all", F.lit(1)), "median_cvar", ["all"], False).select("label", "place")


@query("field_score", sql(f"SELECT fe.label, {r('0.1 * pa.pct + 0.1 * ps.pct + 0.1 * pc.pct + 0.7 * 0.5 AS score')} FROM fe JOIN pa ON pa.label = fe.label JOIN ps ON ps.label = fe.label JOIN pc ON pc.label = fe.label", **FIELD, **PCT))
def _(spark, d):
    return scoring.field_score(field(spark, d).withColumn("all", F.lit(1)), ["all"], scoring.CONTRACTS[8].weights).select("label", "score")


POOL = {
    "po": "SELECT c.label AS pool, r.* FROM fe AS r CROSS JOIN (SELECT label FROM fe WHERE label IN ('ewp', 'last_resort')) AS c WHERE r.label = c.label OR r.label NOT IN ('ewp', 'last_resort')",
    "qa": _pct("median_annual", "", "po", "pool"),
    "qs": _pct("median_sharpe", "", "po", "pool"),
    "qc": _pct("median_cvar", "-", "po", "pool"),
}


@query("pool_score", sql(f"SELECT qa.label, {r('0.1 * qa.pct + 0.1 * qs.pct + 0.1 * qc.pct + 0.7 * 0.5 AS score')} FROM qa JOIN qs ON qs.pool = qa.pool AND qs.label = qa.label JOIN qc ON qc.pool = qa.pool AND qc.label = qa.label WHERE qa.label = qa.pool", **FIELD, **POOL))
def _(spark, d):
    e = field(spark, d)
    tested = F.col("label").isin("ewp", "last_resort")
    return scoring.pool_scores(e.filter(tested), e.filter(~tested), scoring.CONTRACTS[8].weights)


LABELS = ("ewp", "inverse_risk", "ivp", "last_resort", "risk_ranked")


def _draws() -> list[tuple[int, str]]:
    """Forty drawn sub-fields of three entries; the same list feeds both engines."""
    rng = random.Random(11)
    return [(t, label) for t in range(40) for label in sorted(rng.sample(LABELS, 3))]


@query("field_resampling", sql(f"SELECT label, CAST(sum(CASE WHEN score >= top - 1e-12 THEN 1 ELSE 0 END) AS BIGINT) AS wins, count(*) AS trials, {r('median(score) AS middle', 'quantile_cont(score, 0.05) AS p05', 'quantile_cont(score, 0.95) AS p95')} FROM (SELECT *, max(score) OVER (PARTITION BY trial) AS top FROM sc) GROUP BY label", **FIELD, dw="SELECT * FROM (VALUES " + ", ".join(f"({t}, '{x}')" for t, x in _draws()) + ") AS v(trial, label)", de="SELECT trial, fe.* FROM fe JOIN dw ON dw.label = fe.label", ra=_pct("median_annual", "", "de", "trial"), rs=_pct("median_sharpe", "", "de", "trial"), rc=_pct("median_cvar", "-", "de", "trial"), sc="SELECT ra.trial, ra.label, 0.1 * ra.pct + 0.1 * rs.pct + 0.1 * rc.pct + 0.7 * 0.5 AS score FROM ra JOIN rs ON rs.trial = ra.trial AND rs.label = ra.label JOIN rc ON rc.trial = ra.trial AND rc.label = ra.label"))
def _(spark, d):
    return scoring.resampled(field(spark, d), F.broadcast(spark.createDataFrame(_draws(), "trial int, label string")), scoring.CONTRACTS[8].weights)


@query("compliance_floor", sql(f"SELECT {r('min(l1) AS least', 'median(l1) AS middle')}, 0::BIGINT AS undefined, count(*) FILTER (l1 < 0.1) AS near, {r('min(l1) - 0.1 AS margin')}, min(l1) >= 0.1 AS admissible, 'ivp' AS book FROM (SELECT iv.fold_id, sum(abs(iv.w - ew.w)) AS l1 FROM iv JOIN ew ON iv.fold_id = ew.fold_id AND iv.asset = ew.asset GROUP BY iv.fold_id)"))
def _(spark, d):
    b = Base(spark, d)
    return scoring.compliance(books.l1_distance(b.ivp(), books.equal_weight(b.train)).withColumn("book", F.lit("ivp")), ["book"])


@query("unanimity", sql(f"SELECT label, {r('min(delta) AS least', 'avg(delta) AS mean')} FROM (SELECT a.label, a.low - e.low AS delta FROM bl AS a JOIN bl AS e ON e.label = 'ewp' AND a.fold_id = e.fold_id WHERE a.label <> 'ewp' UNION ALL SELECT 'ewp over worst asset', e.low - w.low FROM bl AS e JOIN wl2 AS w ON w.fold_id = e.fold_id WHERE e.label = 'ewp') GROUP BY label HAVING min(delta) > 0", **FIELD, bl="SELECT label, fold_id, min(gross) AS low FROM bp GROUP BY label, fold_id", wl2="SELECT fold_id, min(ret) AS low FROM te GROUP BY fold_id"))
def _(spark, d):
    b = Base(spark, d)
    lows = {name: b.path(book).groupBy("fold_id").agg(F.min("gross").alias("low")) for name, book in (("ewp", books.equal_weight(b.train)), ("ivp", b.ivp()), ("inverse_risk", books.inverse_risk(b.train)), ("last_resort", books.last_resort(b.train)), ("risk_ranked", books.risk_ranked(b.train)))}
    lows["worst"] = b.test.groupBy("fold_id").agg(F.min("ret").alias("low"))
    out = None
    for name, (x, y) in {**{n: (n, "ewp") for n in BOOKS if n != "ewp"}, "ewp over worst asset": ("ewp", "worst")}.items():
        one = lows[x].join(lows[y].withColumnRenamed("low", "other"), "fold_id").select(F.lit(name).alias("label"), (F.col("low") - F.col("other")).alias("delta"))
        out = one if out is None else out.unionByName(one)
    return scoring.unanimous(out, ["label"])


@query("size_strata", sql(f"SELECT CASE WHEN sd <= q25 THEN 1 WHEN sd <= q50 THEN 2 WHEN sd <= q75 THEN 3 ELSE 4 END AS stratum, count(*) AS n, {r('avg(sd) AS mean_sd')} FROM sd JOIN (SELECT fold_id, quantile_cont(sd, 0.25) AS q25, quantile_cont(sd, 0.5) AS q50, quantile_cont(sd, 0.75) AS q75 FROM sd GROUP BY fold_id) USING (fold_id) GROUP BY 1"))
def _(spark, d):
    sd = Base(spark, d).train.groupBy("fold_id", "asset").agg(F.stddev_samp("ret").alias("sd"))
    cuts = sd.groupBy("fold_id").agg(F.percentile("sd", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    stratum = F.when(F.col("sd") <= F.col("q")[0], 1).when(F.col("sd") <= F.col("q")[1], 2).when(F.col("sd") <= F.col("q")[2], 3).otherwise(4)
    return sd.join(F.broadcast(cuts), "fold_id").groupBy(stratum.cast("long").alias("stratum")).agg(F.count(F.lit(1)).alias("n"), F.avg("sd").alias("mean_sd"))


# --- factors -----------------------------------------------------------------------------------------------------


def rows_of(spark: SparkSession, d: str) -> DataFrame:
    """The brand panel's rows as factors want them, artefacts kept: these prices move by more than GLITCH every week."""
    r_ = panels.panel(spark, d, "brand").select("asset", F.col("row_idx").alias("k"), "date", "ret")
    return r_.withColumn("path", F.product(1 + F.col("ret")).over(Window.partitionBy("asset").orderBy("k")))


ROWS = {"fr": "SELECT asset, row_idx AS k, date, ret, product(1 + ret) OVER (PARTITION BY asset ORDER BY row_idx) AS path, avg(ret) OVER (PARTITION BY date) AS mkt, lag(ret) OVER (PARTITION BY asset ORDER BY row_idx) AS before, sum(ret) OVER (PARTITION BY asset ORDER BY row_idx) AS total FROM rt"}


def _roll(f: str, x: str, w: int, least: int | None = None) -> str:
    over = f"OVER (PARTITION BY asset ORDER BY k ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {over} >= {least or factors.least_rows(w)} THEN {f}({x}) {over} END"


def _pair(f: str, x: str, y: str, w: int) -> str:
    over = f"OVER (PARTITION BY asset ORDER BY k ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    a, b_ = f"CASE WHEN {y} IS NOT NULL THEN {x} END", f"CASE WHEN {x} IS NOT NULL THEN {y} END"
    return f"CASE WHEN count({a}) {over} >= {factors.least_rows(w)} THEN {f}({a}, {b_}) {over} END"


def _back(n: int) -> str:
    return f"(path / lag(path, {n}) OVER (PARTITION BY asset ORDER BY k) - 1)"


def _fade(x: str, h: float, least: int) -> str:
    """By the definition: every earlier row's value and weight, for each row anew."""
    over = "OVER (PARTITION BY asset ORDER BY k)"
    weight = f"pow(0.5, (len(l) - 1 - i) / {h}.0)"
    mean = f"list_sum(list_transform(range(0, len(l)), lambda i: coalesce(l[i + 1], 0) * {weight})) / list_sum(list_transform(range(0, len(l)), lambda i: CASE WHEN l[i + 1] IS NULL THEN 0 ELSE {weight} END))"
    return f"CASE WHEN count({x}) {over} >= {least} THEN {mean.replace('len(l)', f'len(list({x}) {over})').replace('l[i + 1]', f'(list({x}) {over})[i + 1]')} END"


ROLLING = [
    *(f"{_roll('stddev_samp', 'ret', w)} AS rv{w}" for w in (10, 20, 60, 252)),
    f"{_roll('stddev_samp', 'least(ret, 0)', 60)} AS downside_vol60",
    f"{_roll('stddev_samp', 'greatest(ret, 0)', 60)} AS upside_vol60",
    f"{_roll('skewness', 'ret', 60)} AS skew60",
    f"{_roll('kurtosis', 'ret', 60)} AS kurt60",
    f"{_pair('corr', 'ret', 'before', 20)} AS autocorr20",
    f"{_back(231)} / 1e6 AS mom231",
    f"{_back(21)} / 1e3 AS mom21",
    f"-{_back(5)} AS rev5",
    f"-{_back(10)} / 1e3 AS rev10",
    f"{_roll('max', 'total', 60, 36)} - total AS winmaxdd60",
]


@query("rolling_factors", sql(f"SELECT asset, k, date, {r(*ROLLING[:9], *(x for x in ROLLING[9:] if 'mom' not in x and 'rev10' not in x))} FROM fr", **ROWS))
def _(spark, d):
    f = factors.return_factors(rows_of(spark, d))
    return f.select("asset", "k", "date", "rv10", "rv20", "rv60", "rv252", "downside_vol60", "upside_vol60", "skew60", "kurt60", "autocorr20", "rev5", "winmaxdd60")


@query("momentum_factors", sql("SELECT asset, k, date, " + r(*(f"ln(1 + {_back(n)}) AS mom{n}" for n in (21, 120, 231))) + " FROM fr", **ROWS))
def _(spark, d):
    f = factors.return_factors(rows_of(spark, d)).select("asset", "k", "date", F.log1p("mom21").alias("mom21"), F.log1p("mom231").alias("mom231"))
    m = rows_of(spark, d).withColumn("mom120", F.log1p(factors.moved(F.col("path"), 120))).select("asset", "k", "mom120")
    return f.join(m, ["asset", "k"])


@query("volofvol_factor", sql(f"SELECT asset, k, date, {r(_roll('stddev_samp', 'sd20', 60) + ' AS volofvol60')} FROM vv", **ROWS, vv=f"SELECT asset, k, date, {_roll('stddev_samp', 'ret', 20)} AS sd20 FROM fr"))
def _(spark, d):
    return factors.return_factors(rows_of(spark, d)).select("asset", "k", "date", "volofvol60")


BETA = {"bt": f"SELECT asset, k, date, ret, mkt, {_pair('covar_samp', 'ret', 'mkt', 252)} / {_roll('var_samp', 'mkt', 252).replace('CASE', '(CASE').replace(' END', ' END)')} AS beta FROM fr"}


@query("beta_factors", sql(f"SELECT asset, k, date, {r('beta AS beta252', _pair('corr', 'ret', 'mkt', 252) + ' AS corr_mkt252', _roll('stddev_samp', '(ret - beta * mkt)', 252) + ' AS residvol252', _pair('corr', 'abs(ret)', 'abs(mkt)', 60) + ' AS corr_vol_mkt')} FROM bt", **ROWS, **BETA))
def _(spark, d):
    return factors.return_factors(rows_of(spark, d)).select("asset", "k", "date", "beta252", "corr_mkt252", "residvol252", "corr_vol_mkt")


@query("ewm_factors", sql(f"SELECT asset, k, date, {r(_fade('abs(ret)', 10, 30) + ' AS dabs10', _fade('abs(ret)', 20, 60) + ' AS dabs20')} FROM fr", **ROWS))
def _(spark, d):
    return factors.return_factors(rows_of(spark, d)).select("asset", "k", "date", "dabs10", "dabs20")


def bars_of(spark: SparkSession, d: str) -> DataFrame:
    """Weekly bars by brand from the order lines: prices in time order, volume, amount."""
    line = panels.table(spark, d, "lineitem")
    part = panels.table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("asset"))
    one = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select("asset", F.date_trunc("week", "l_shipdate").cast("date").alias("date"), F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("at"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"), "l_quantity", "l_extendedprice")
    bars = one.groupBy("asset", "date").agg(F.min_by("p", "at").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "at").alias("close"), F.sum("l_quantity").alias("volume"), F.sum("l_extendedprice").alias("amount"))
    by = Window.partitionBy("asset").orderBy("date")
    return bars.withColumn("k", F.row_number().over(by) - 1).withColumn("ret", F.try_divide(F.col("close"), F.lag("close").over(by)) - 1).withColumn("vwap", F.col("amount") / F.col("volume"))


BARS = {
    "b0": "SELECT p_brand AS asset, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, (l_shipdate, l_orderkey, l_linenumber) AS tk, l_extendedprice / l_quantity AS p, l_quantity, l_extendedprice FROM lineitem JOIN part ON l_partkey = p_partkey",
    "b1": "SELECT asset, date, arg_min(p, tk) AS open, max(p) AS high, min(p) AS low, arg_max(p, tk) AS close, sum(l_quantity) AS volume, sum(l_extendedprice) AS amount FROM b0 GROUP BY asset, date",
    "b2": "SELECT *, amount / volume AS vwap, row_number() OVER w - 1 AS k, close / lag(close) OVER w - 1 AS ret, high - lag(high) OVER w AS dh, volume - lag(volume) OVER w AS dv, (high - low) / (high + low) AS rng FROM b1 WINDOW w AS (PARTITION BY asset ORDER BY date)",
}


@query("ohlcv_bars", sql(f"SELECT asset, date, k, {r('ln(open) AS open', 'ln(high) AS high', 'ln(low) AS low', 'ln(close) AS close', 'volume', 'amount', 'ln(vwap) AS vwap', 'ret')} FROM b2", **BARS))
def _(spark, d):
    return bars_of(spark, d).select("asset", "date", "k", *(F.ln(c).alias(c) for c in ("open", "high", "low", "close")), "volume", "amount", F.ln("vwap").alias("vwap"), "ret")


BAR_FACTORS = [
    "rng AS range_intensity",
    f"{_fade('rng', 5, 10)} AS range_decay",
    "(high - low) / low AS hl_ratio",
    f"{_pair('covar_samp', 'dh', 'volume', 10)} AS cov_dhigh_vol10",
    f"{_pair('covar_samp', 'dh', 'dv', 10)} AS cov_dhigh_dvol10",
    f"{_pair('covar_samp', '(high - low)', 'volume', 20)} AS cov_range_vol20",
    f"{_pair('covar_samp', 'ret', 'volume', 20)} AS cov_ret_vol20",
    f"{_pair('covar_samp', 'ret', 'amount', 20)} AS cov_ret_amt20",
    f"{_fade('abs(ret) * amount', 15, 20)} AS absret_amt20",
    f"{_roll('var_samp', '((high - open) / open)', 10)} AS intraday_var10",
    f"{_roll('avg', '((high - greatest(open, close)) / nullif(high - low, 0))', 10)} AS shadows",
    f"{_roll('avg', '((open - close) / close)', 10)} AS vwap_dist10",
    f"(volume - {_roll('avg', 'volume', 20)}) / {_roll('stddev_samp', 'volume', 20)} AS vol_z20",
    f"volume / {_roll('avg', 'volume', 60)} - 1 AS turn_z20",
    f"{_roll('avg', '(abs(ret) / amount)', 20)} AS amihud20",
]


@query("ohlcv_factors", sql(f"SELECT asset, k, date, {r(*BAR_FACTORS)} FROM b2", **BARS))
def _(spark, d):
    return factors.bar_factors(bars_of(spark, d))


IC = {
    "fw": f"SELECT *, lead(path, 5) OVER (PARTITION BY asset ORDER BY k) / path - 1 AS fwd, {_roll('stddev_samp', 'ret', 20)} AS f FROM fr",
    "rk": "SELECT date, asset, rank() OVER (PARTITION BY date ORDER BY f) + (count(*) OVER (PARTITION BY date, f) - 1) / 2.0 AS x, rank() OVER (PARTITION BY date ORDER BY fwd) + (count(*) OVER (PARTITION BY date, fwd) - 1) / 2.0 AS y FROM fw WHERE f IS NOT NULL AND fwd IS NOT NULL",
    "ic": "SELECT date, count(*) AS n, corr(x, y) AS ic FROM rk GROUP BY date HAVING count(*) >= 10",
    "tq": "SELECT k, date, asset, f FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY f DESC, asset) AS place, count(*) OVER (PARTITION BY date) AS n FROM fw WHERE f IS NOT NULL) WHERE place <= greatest(1, round_even(n * 0.2, 0))",
}


def signal(spark: SparkSession, d: str) -> DataFrame:
    rows = rows_of(spark, d)
    return factors.forward(rows.withColumn("f", factors.rolled(F.stddev_samp, F.col("ret"), 20)), 5)


@query("rank_ic", sql(f"SELECT date, n, {r('ic')} FROM ic", **ROWS, **IC))
def _(spark, d):
    return factors.rank_ic(signal(spark, d), "f", 10)


@query("ic_stats", sql(f"SELECT count(ic) AS n, {r('avg(ic) AS ic_mean', 'stddev_samp(ic) AS ic_sd', 'avg(ic) / stddev_samp(ic) AS icir', 'avg(ic) / stddev_samp(ic) * sqrt(count(ic)) AS t', 'avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0 END) AS positive')} FROM ic", **ROWS, **IC))
def _(spark, d):
    return factors.ic_stats(factors.rank_ic(signal(spark, d), "f", 10))


@query("quintile_book", sql(f"SELECT k, date, asset, {r('f')} FROM tq", **ROWS, **IC))
def _(spark, d):
    return factors.top_quantile(signal(spark, d), "f", 0.2).select("k", "date", "asset", "f")


@query("quintile_turnover", sql(f"SELECT k, {r('1 - count(kept)::DOUBLE / count(*) AS turnover')} FROM (SELECT a.k, b.asset AS kept FROM tq AS a LEFT JOIN tq AS b ON b.k + 1 = a.k AND b.asset = a.asset) WHERE k > (SELECT min(k) FROM tq) GROUP BY k", **ROWS, **IC))
def _(spark, d):
    return factors.selection_turnover(factors.top_quantile(signal(spark, d), "f", 0.2))


@query("composite_signal", sql(f"SELECT asset, k, date, {r('(CASE WHEN s1 > 1e-14 AND a IS NOT NULL THEN (a - m1) / s1 ELSE 0 END + CASE WHEN s2 > 1e-14 AND b IS NOT NULL THEN (b - m2) / s2 ELSE 0 END) / 2 AS signal')} FROM (SELECT *, avg(a) OVER p AS m1, CASE WHEN count(a) OVER p >= 3 THEN stddev_samp(a) OVER p END AS s1, avg(b) OVER p AS m2, CASE WHEN count(b) OVER p >= 3 THEN stddev_samp(b) OVER p END AS s2 FROM zz WINDOW p AS (PARTITION BY date))", **ROWS, zz=f"SELECT asset, k, date, {_pair('corr', 'ret', 'before', 20)} AS a, {_roll('stddev_samp', 'ret', 60)} AS b FROM fr"))
def _(spark, d):
    f = factors.return_factors(rows_of(spark, d))
    return f.select("asset", "k", "date", ((factors.z_score(F.col("autocorr20"), "date") + factors.z_score(F.col("rv60"), "date")) / 2).alias("signal"))


@query("glitch_filter", sql(f"SELECT asset, row_idx AS k, abs(ret) > 0.5 AS glitch, {r('CASE WHEN abs(ret) <= 0.5 THEN ret END AS ret', 'ln(product(1 + CASE WHEN abs(ret) <= 0.5 THEN ret ELSE 0 END) OVER (PARTITION BY asset ORDER BY row_idx)) AS log_path')} FROM rt"))
def _(spark, d):
    c = factors.cleaned(panels.panel(spark, d, "brand").withColumn("k", F.col("row_idx")))
    return c.select("asset", "k", "glitch", "ret", F.ln("path").alias("log_path"))


# --- joins, sets, counts -----------------------------------------------------------------------------------------


@query("membership_semijoin", sql(f"SELECT row_idx, asset, {r('ret')} FROM rt WHERE EXISTS (SELECT 1 FROM part WHERE p_brand = asset AND p_size > 45)"))
def _(spark, d):
    members = panels.table(spark, d, "part").filter("p_size > 45").select(F.col("p_brand").alias("asset")).distinct()
    return panels.panel(spark, d, "brand").join(members, "asset", "left_semi").select("row_idx", "asset", "ret")


@query("adjusted_close", sql(f"SELECT asset, date, {r('ln(close * (1 - 0.01 * (k % 7))) AS log_price')} FROM b2", **BARS))
def _(spark, d):
    return bars_of(spark, d).select("asset", "date", F.ln(F.col("close") * (1 - 0.01 * (F.col("k") % 7))).alias("log_price"))


@query("dedup_keep_last", sql("SELECT user_id, day, event_id, event_type FROM (SELECT user_id, CAST(ts AS DATE) AS day, event_id, event_type, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1"))
def _(spark, d):
    e = panels.table(spark, d, "events")
    return e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("last")).select("user_id", "day", "last.event_id", "last.event_type")


@query("distinct_counts", sql("SELECT count(DISTINCT date) AS dates, count(DISTINCT asset) AS assets, count(*) AS rows FROM mv"))
def _(spark, d):
    return panels.simple_returns(panels.PanelSpec("brand").prices(spark, d)).agg(F.count_distinct("date").alias("dates"), F.count_distinct("asset").alias("assets"), F.count(F.lit(1)).alias("rows"))


@query("value_counts_top", sql("SELECT asset, count(*) AS n FROM mv WHERE abs(ret) > 0.1 GROUP BY asset ORDER BY n DESC, asset LIMIT 10"))
def _(spark, d):
    m = panels.simple_returns(panels.PanelSpec("brand").prices(spark, d))
    return m.filter(F.abs("ret") > 0.1).groupBy("asset").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "asset").limit(10)


def _windows() -> list[tuple[int, int, int]]:
    """Twelve drawn windows of eight assets each; the same list feeds both engines."""
    rng = random.Random(5)
    return [(t, a, s) for t in range(12) for s in [rng.randint(0, 180)] for a in sorted(rng.sample(range(25), 8))]


@query("random_windows", sql(f"SELECT draw, count(*) AS n, {r('avg(ret) AS mean', 'stddev_samp(ret) AS sd')} FROM rt JOIN (VALUES {', '.join(map(str, _windows()))}) AS w(draw, a, s) ON asset_idx = a AND row_idx >= s AND row_idx < s + 100 GROUP BY draw"))
def _(spark, d):
    draws = spark.createDataFrame(_windows(), "draw int, asset_idx int, start int")
    return folds.random_windows(panels.panel(spark, d, "brand"), draws, 100).groupBy("draw").agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"))


@query("dataset_rollup", sql(f"SELECT asset, count(*) AS n, {r('avg(ret) AS mean')} FROM rt GROUP BY ROLLUP (asset)", "region"))
def _(spark, d):
    return panels.panel(spark, d, "region").rollup("asset").agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("mean"))


# --- kernels (rows only; each returns columns that tests hold against invariants) ----------------------------------

GRID = {f"qp_{p:g}": K.Params(penalty=p) for p in (0.25, 1.0, 4.0)} | {"hrp": K.Params(method="hrp"), "qp_downside": K.Params(penalty=1.0, downside_mix=0.5)}


@query("allocate_regularized")
def _(spark, d):
    return allocation.allocations(Base(spark, d).train, {"round8": K.Params(penalty=1.0)})


@query("allocate_hrp")
def _(spark, d):
    return allocation.allocations(Base(spark, d).train, {"hrp": K.Params(method="hrp")})


@query("allocate_short_budget")
def _(spark, d):
    return allocation.allocations(Base(spark, d).train, {"short": K.Params(penalty=0.25, gross_budget=1.6)})


@query("allocate_missing")
def _(spark, d):
    return allocation.allocations(sparse_windows(spark, d), {"round8": K.Params(penalty=1.0)})


@query("allocate_legacy")
def _(spark, d):
    return allocation.allocations(Base(spark, d).train, {"ivp": K.Params(method="inverse_volatility", legacy=True), "minvar": K.Params(method="minimum_variance", legacy=True, cap_names=2.0)})


#: Sample covariances as lists by fold, for iterations in SQL: cm[i][j], assets counted from 1.
LISTS = {
    "cv2": "SELECT a.fold_id, a.asset_idx AS i, b.asset_idx AS j, covar_samp(a.ret, b.ret) AS c FROM tr AS a JOIN tr AS b ON a.fold_id = b.fold_id AND a.row_idx = b.row_idx GROUP BY 1, 2, 3",
    "cr": "SELECT fold_id, i, list(c ORDER BY j) AS row FROM cv2 GROUP BY fold_id, i",
    "cm": "SELECT fold_id, list(row ORDER BY i) AS cm, len(list(i)) AS n, list(row[i + 1] ORDER BY i) AS dg FROM cr GROUP BY fold_id",
}
#: The nearest point of the simplex to list z: the largest level that leaves a positive part.
_SIMPLEX = """list_transform(z, lambda v: greatest(0.0, v - list_max(list_transform(range(1, len(z) + 1), lambda k: (list_sum(list_reverse_sort(z)[1:k]) - 1) / k))))"""


def _descent(value_step: str, source: str, rounds: int) -> str:
    """Accelerated projected gradients on the simplex from equal weights, written with lists."""
    return f"""SELECT fold_id, 0 AS k, list_transform(range(1, n + 1), lambda i: 1.0::DOUBLE / n) AS x, list_transform(range(1, n + 1), lambda i: 1.0::DOUBLE / n) AS y FROM {source}
  UNION ALL SELECT fold_id, k + 1, new, list_transform(range(1, len(new) + 1), lambda i: new[i] + (k / (k + 3.0)) * (new[i] - x[i])) FROM (
    SELECT fold_id, k, x, {_SIMPLEX} AS new FROM (SELECT gd.fold_id, k, x, {value_step} AS z FROM gd JOIN {source} ON gd.fold_id = {source}.fold_id WHERE k < {rounds}))"""


def _recursive(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


@query(
    "erc_book",
    _recursive(
        sql(
            f"SELECT fold_id, asset, asset_idx, {r('x[asset_idx + 1] / list_sum(x) AS w')}, true AS defined FROM (SELECT * FROM pt WHERE k = 1500) JOIN ai ON true",
            **LISTS,
            # each asset halfway to the root of its own equation, all at once: only equal contributions stay in place
            pt="SELECT fold_id, 0 AS k, list_transform(dg, lambda v: 1 / sqrt(n * v)) AS x FROM cm UNION ALL SELECT pt.fold_id, k + 1, list_transform(range(1, n + 1), lambda i: x[i] / 2 + (sqrt(pow(list_inner_product(cm[i], x) - dg[i] * x[i], 2) + 4 * dg[i] / n) - (list_inner_product(cm[i], x) - dg[i] * x[i])) / (4 * dg[i])) FROM pt JOIN cm ON pt.fold_id = cm.fold_id WHERE k < 1500",
        )
    ),
)
def _(spark, d):
    return allocation.kernel_books(Base(spark, d).train, "risk_parity")


@query(
    "scm_gmvp_book",
    _recursive(
        sql(
            f"SELECT fold_id, asset, asset_idx, {r('x[asset_idx + 1] AS w')}, true AS defined FROM (SELECT * FROM gd WHERE k = 4000) JOIN ai ON true",
            "flag",
            **LISTS,
            cs="SELECT cm.fold_id, cm, n, list_max(list_transform(cm, lambda row: list_sum(list_transform(row, lambda v: abs(v))))) AS top FROM cm",
            gd=_descent("list_transform(range(1, n + 1), lambda i: y[i] - list_inner_product(cm[i], y) / top)", "cs", 4000),
        )
    ),
)
def _(spark, d):
    return allocation.kernel_books(Base(spark, d, "flag").train, "minimum_variance")


@query(
    "anchored_qp",
    _recursive(
        sql(
            f"SELECT fold_id, asset, asset_idx, {r('x[asset_idx + 1] AS w', 'list_inner_product(list_transform(qm, lambda row: list_inner_product(row, x)), x) - 2 * list_inner_product(q, x) + 1.0 AS objective')}, true AS certified FROM (SELECT gd.*, qm, q FROM gd JOIN cs ON gd.fold_id = cs.fold_id WHERE k = 3000) JOIN ai ON true",
            **LISTS,
            ab="SELECT fold_id, cm, n, list_transform(dg, lambda v: (1 / sqrt(v)) / list_sum(list_transform(dg, lambda u: 1 / sqrt(u)))) AS b FROM cm",
            ac="SELECT *, list_inner_product(list_transform(cm, lambda row: list_inner_product(row, b)), b) AS risk, list_inner_product(b, b) AS size FROM ab",
            aq="SELECT fold_id, n, list_transform(range(1, n + 1), lambda i: list_transform(range(1, n + 1), lambda j: cm[i][j] / risk + CASE WHEN i = j THEN 1.0 / size ELSE 0 END)) AS qm, list_transform(b, lambda v: v / size) AS q FROM ac",
            cs="SELECT *, list_max(list_transform(qm, lambda row: list_sum(list_transform(row, lambda v: abs(v))))) AS top FROM aq",
            gd=_descent("list_transform(range(1, n + 1), lambda i: y[i] - (list_inner_product(qm[i], y) - q[i]) / top)", "cs", 3000),
        )
    ),
)
def _(spark, d):
    return allocation.anchored_books(Base(spark, d).train, 1.0)


#: Kruskal's merges by fold: lb holds each asset's cluster; l and r are the two clusters of a merge.
KRUSKAL = {
    "dt": "SELECT a.fold_id, a.i, a.j, sqrt(greatest(0, (1 - a.c / sqrt(x.c * y.c)) / 2)) AS d FROM cv2 AS a JOIN cv2 AS x ON x.fold_id = a.fold_id AND x.i = a.i AND x.j = a.i JOIN cv2 AS y ON y.fold_id = a.fold_id AND y.i = a.j AND y.j = a.j WHERE a.i < a.j",
    "kr": """SELECT fold_id, 0 AS k, range(0, n) AS lb, 0.0::DOUBLE AS height, 0::BIGINT AS l, 0::BIGINT AS r, range(0, n) AS was FROM cm
  UNION ALL SELECT fold_id, k + 1, list_transform(lb, lambda v: CASE WHEN v = e.r THEN e.l ELSE v END), e.d, e.l, e.r, lb FROM (
    SELECT kr.fold_id, k, lb, arg_min({'d': d, 'l': lb[i + 1], 'r': lb[j + 1]}, (d, i, j)) AS e FROM kr JOIN dt ON dt.fold_id = kr.fold_id WHERE lb[i + 1] <> lb[j + 1] GROUP BY kr.fold_id, k, lb)""",
}


@query("linkage_heights", _recursive(sql(f"SELECT fold_id, k - 1 AS step, {r('height')}, CAST(len(list_filter(was, lambda v: v = l OR v = r)) AS BIGINT) AS size FROM kr WHERE k > 0", **LISTS, **KRUSKAL)))
def _(spark, d):
    return allocation.linkage(Base(spark, d).train)


@query(
    "hrp_book",
    _recursive(
        sql(
            f"SELECT pw.fold_id, asset, ai.asset_idx, {r('w')}, true AS defined FROM pw JOIN ai ON ai.asset_idx = pw.a",
            **LISTS,
            **KRUSKAL,
            mb="SELECT fold_id, k, a, CASE WHEN was[a + 1] = l THEN 'l' ELSE 'r' END AS side FROM (SELECT *, unnest(range(0, len(was))) AS a FROM kr WHERE k > 0) WHERE was[a + 1] = l OR was[a + 1] = r",
            iv2="SELECT mb.*, (1 / c) / sum(1 / c) OVER (PARTITION BY mb.fold_id, k, side) AS v FROM mb JOIN cv2 ON cv2.fold_id = mb.fold_id AND cv2.i = a AND cv2.j = a",
            vr="SELECT p.fold_id, p.k, p.side, sum(p.v * q.v * c) AS var FROM iv2 AS p JOIN iv2 AS q ON p.fold_id = q.fold_id AND p.k = q.k AND p.side = q.side JOIN cv2 ON cv2.fold_id = p.fold_id AND cv2.i = p.a AND cv2.j = q.a GROUP BY 1, 2, 3",
            pw="SELECT mb.fold_id, a, product(o.var / (o.var + w.var)) AS w FROM mb JOIN vr AS w ON w.fold_id = mb.fold_id AND w.k = mb.k AND w.side = mb.side JOIN vr AS o ON o.fold_id = mb.fold_id AND o.k = mb.k AND o.side <> mb.side GROUP BY mb.fold_id, a",
        )
    ),
)
def _(spark, d):
    return allocation.kernel_books(Base(spark, d).train, "hierarchical")


@query(
    "two_speed_cov",
    sql(
        f"SELECT ts.fold_id, i, j, {r('c / mid AS c')} FROM ts JOIN (SELECT fold_id, median(c) AS mid FROM ts WHERE i = j GROUP BY fold_id) AS m ON m.fold_id = ts.fold_id WHERE i <= j",
        look=26,
        step=40,
        **WOLF,
        sl="SELECT pp.fold_id, i, j, (1 - least(beta, delta) / delta) * s1 / t + CASE WHEN i = j THEN least(beta, delta) / delta * mu ELSE 0 END AS c FROM pp JOIN sz ON sz.fold_id = pp.fold_id JOIN wb ON wb.fold_id = pp.fold_id",
        **AGED,
        rv="SELECT ac.fold_id, ac.asset_idx, sum(alpha * c * c) / greatest(1 - sum(alpha * alpha), 1e-12) AS v FROM ac GROUP BY 1, 2",
        ts="SELECT a.fold_id, a.i, a.j, 0.75 * a.c + 0.25 * a.c / sqrt(x.c * y.c) * sqrt(p.v * q.v) AS c FROM sl AS a JOIN sl AS x ON x.fold_id = a.fold_id AND x.i = a.i AND x.j = a.i JOIN sl AS y ON y.fold_id = a.fold_id AND y.i = a.j AND y.j = a.j JOIN rv AS p ON p.fold_id = a.fold_id AND p.asset_idx = a.i JOIN rv AS q ON q.fold_id = a.fold_id AND q.asset_idx = a.j",
    ),
)
def _(spark, d):
    # 26 rows of 25 assets are too few to tell noise by eigenvalues, so the blend is all that is left
    return allocation.two_speed_covariances(Base(spark, d, look=26).train, 10.0, 0.25)


@query("rmt_denoise")
def _(spark, d):
    return allocation.denoised_correlations(Base(spark, d).train)


def sweep(spark: SparkSession, d: str, configs: dict[str, K.Params]) -> DataFrame:
    """Median metrics, failures and least distances of every configuration over all folds: one job for the whole grid."""
    b = Base(spark, d)
    made = stored(allocation.allocations(b.train, configs), "allocations")  # states, holdings and distances read them
    by = engine.KEYS
    path, _ = backtest.rebalanced(backtest.holdings(b.test, made.select(*by, "asset", "w"), by), by)
    path = path.select(*by, "row_idx", F.col("gross").alias("ret"))
    folds_ = metrics.performance(path, list(by)).join(metrics.cvar(path, list(by)), list(by))
    state = made.groupBy("config").agg(F.count_distinct("fold_id").alias("folds"), F.avg((F.col("status") == "failed").cast("double")).alias("fail"), F.avg(F.col("degraded").cast("double")).alias("degraded"), F.min("l1_equal").alias("l1_equal"), F.min("l1_erc_sample").alias("l1_erc"))
    sums = folds_.groupBy("config").agg(F.median("annual_mean").alias("median_annual"), F.median("sharpe").alias("median_sharpe"), F.median("cvar95").alias("median_cvar"))
    return state.join(sums, "config", "left").withColumnRenamed("config", "label")


@query("sweep_grid")
def _(spark, d):
    entries = sweep(spark, d, GRID).withColumn("all", F.lit(1))
    return scoring.field_score(entries, ["all"], scoring.CONTRACTS[8].weights).drop("all")


@query("competitor_field")
def _(spark, d):
    b = Base(spark, d)
    out = None
    for name in ("risk_parity", "minimum_variance", "shrunk_minimum_variance", "denoised_minimum_variance", "hierarchical", "nested_clusters", "max_diversification", "random"):
        book = allocation.kernel_books(b.train, name)
        state = book.groupBy("fold_id").agg(F.bool_and("defined").alias("defined"))
        one = state.join(books.exposure(book.filter("defined")), "fold_id", "left").withColumn("label", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out
