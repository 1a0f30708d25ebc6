"""Queries that chain operators: the walk-forward engine, selection, legality, signals, certificates and tail metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kernels as K
from ..operators import allocation, books, engine, factors, folds, legality, metrics, risk, scoring, selection, signals
from ..sources import panels
from ..sources.stored import stored
from .catalog import AGED, COST, FIELD, LISTS, LOOK, ROWS, STEP, Base, _back, _descent, _pct, _recursive, _roll, _windows, query, rows_of
from .sqlref import r, sql

# --- the engine --------------------------------------------------------------------------------------------------


def engine_run(spark, d, **more):
    return engine.walk_forward(Base(spark, d).returns, {"ivp": K.Params()}, LOOK, STEP, cost_bps=10.0, keep_tail=False, allocator=engine.inverse_volatility, **more)


NET = {**COST, "np": "SELECT fold_id, row_idx, gross, turnover, (1 - turnover * 0.001) * (1 + gross) - 1 AS net FROM tc"}
WHOLE = "SELECT row_idx, {x} AS x, product(1 + {x}) OVER (ORDER BY row_idx) AS wealth, sum({x}) OVER (ORDER BY row_idx) AS total, row_number() OVER (ORDER BY {x}, row_idx) AS k, count(*) OVER () AS n FROM {source}"


@query("walk_forward_path", sql(f"SELECT 'ivp' AS config, fold_id, row_idx, {r('gross', 'turnover', 'net')} FROM np", **NET))
def _(spark, d):
    return engine_run(spark, d).path


@query(
    "walk_forward_summary",
    sql(
        f"SELECT 'ivp' AS config, (SELECT count(*) FROM fd) AS folds, (SELECT count(*) FROM fd) - (SELECT count(DISTINCT fold_id) FROM np WHERE isfinite(net)) AS failed, 0.0::DOUBLE AS degradation_rate, 'inverse_volatility=' || (SELECT count(*) FROM fd) AS statuses, {r('(SELECT sum(turnover) FROM np) AS turnover', 'avg(x) * 252 AS annual_mean', 'stddev_samp(x) * sqrt(252) AS annual_vol', 'avg(x) / stddev_samp(x) * sqrt(252) AS sharpe', 'max(1 - wealth / greatest(high, 1.0)) AS max_dd_geo', 'max(top - total) AS max_dd_arith', '-sum(CASE WHEN k <= ceil(n * 0.05 - 1e-9) THEN least(greatest(n * 0.05 - k + 1, 0), 1) * x END) / (n * 0.05) AS cvar95')} FROM (SELECT *, max(wealth) OVER (ORDER BY row_idx) AS high, max(total) OVER (ORDER BY row_idx) AS top FROM wh) GROUP BY n",
        **NET,
        wh=WHOLE.format(x="net", source="np"),
    ),
)
def _(spark, d):
    return engine_run(spark, d).summary.select("config", "folds", "failed", "degradation_rate", "statuses", "turnover", "annual_mean", "annual_vol", "sharpe", "max_dd_geo", "max_dd_arith", "cvar95")


@query(
    "walk_forward_drift",
    sql(
        f"SELECT 'ivp' AS config, fold_id, row_idx, {r('gross', 'turnover', '(1 - turnover * 0.001) * (1 + gross) - 1 AS net')} FROM dp",
        de="SELECT sh.fold_id + 1 AS fold_id, asset, share / sum(share) OVER (PARTITION BY sh.fold_id) AS moved FROM sh JOIN fd ON sh.fold_id = fd.fold_id AND row_idx = test_hi - 1",
        dt="SELECT iv.fold_id, sum(abs(w - coalesce(moved, 0))) AS trade FROM iv LEFT JOIN de ON de.fold_id = iv.fold_id AND de.asset = iv.asset GROUP BY iv.fold_id",
        dp="SELECT wl.fold_id, row_idx, wealth / lag(wealth, 1, 1.0) OVER (PARTITION BY wl.fold_id ORDER BY row_idx) - 1 AS gross, CASE WHEN row_idx = test_lo THEN trade ELSE 0.0 END AS turnover FROM wl JOIN dt ON dt.fold_id = wl.fold_id JOIN fd ON fd.fold_id = wl.fold_id",
    ),
)
def _(spark, d):
    return engine_run(spark, d, drift=True).path


@query("walk_forward_failures", sql("SELECT fold_id, fold_id % 3 <> 1 AS ok, CASE WHEN fold_id % 3 = 1 THEN 'equal weight' END AS error FROM fd"))
def _(spark, d):
    """Every third fold's allocator returns equal weights, which the contract forbids: those folds fail, the others stand."""
    b = Base(spark, d)
    marked = b.train.join(F.broadcast(b.folds.select("fold_id", (F.col("fold_id") % 3 == 1).alias("bad"))), "fold_id")
    made = marked.groupBy("fold_id", "asset").agg(F.stddev_samp("ret").alias("sd"), F.first("bad").alias("bad"))
    by = F.sum(1 / F.col("sd")).over(folds.by_fold()), F.count(F.lit(1)).over(folds.by_fold())
    book = made.select("fold_id", "asset", F.when(F.col("bad"), 1 / by[1]).otherwise(1 / F.col("sd") / by[0]).alias("w"))
    return books.contract(book).select("fold_id", F.col("violation").isNull().alias("ok"), F.col("violation").alias("error"))


@query("start_year_buckets", sql(f"SELECT year(date) AS year, count(*) AS folds, {r('avg(sharpe) AS mean_sharpe', 'max(max_dd_geo) AS deepest')} FROM fm JOIN fd ON fd.fold_id = fm.fold_id JOIN fl ON fl.row_idx = test_lo GROUP BY 1"))
def _(spark, d):
    b = Base(spark, d)
    start = b.folds.join(b.returns.select(F.col("row_idx").alias("test_lo"), F.year("date").alias("year")).distinct(), "test_lo").select("fold_id", "year")
    return b.metrics().join(start, "fold_id").groupBy("year").agg(F.count(F.lit(1)).alias("folds"), F.avg("sharpe").alias("mean_sharpe"), F.max("max_dd_geo").alias("deepest"))


# --- certificates and tilts --------------------------------------------------------------------------------------

CERTIFICATE = {
    "cl": "SELECT a.fold_id, a.asset AS i, b.asset AS j, covar_samp(a.ret, b.ret) AS c FROM tr AS a JOIN tr AS b ON a.fold_id = b.fold_id AND a.row_idx = b.row_idx GROUP BY 1, 2, 3",
    "wb": "SELECT iv.fold_id, iv.asset, iv.w, ew.w AS b FROM iv JOIN ew ON iv.fold_id = ew.fold_id AND iv.asset = ew.asset",
    "pr": "SELECT cl.fold_id, i AS asset, sum(c * w) AS cw, sum(c * b) AS cb FROM cl JOIN wb ON wb.fold_id = cl.fold_id AND wb.asset = cl.j GROUP BY 1, 2",
    "sg": "SELECT wb.*, cw, sum(b * cb) OVER f AS risk, sum(b * b) OVER f AS size FROM wb JOIN pr ON pr.fold_id = wb.fold_id AND pr.asset = wb.asset WINDOW f AS (PARTITION BY wb.fold_id)",
    "gr": "SELECT *, 2 * (cw / risk + 4.0 * (w - b) / size) AS g, w * cw / risk + 4.0 * (w - b) * (w - b) / size AS part FROM sg",
}


@query("gap_certificate", sql(f"SELECT fold_id, {r('sum(part) AS objective', 'min(g) + 0.3 * (min(g) - max(g)) AS low', 'greatest(sum(g * w) - (min(g) + 0.3 * (min(g) - max(g))), 0) / (1 + abs(sum(part))) AS gap')} FROM gr GROUP BY fold_id", **CERTIFICATE))
def _(spark, d):
    b = Base(spark, d)
    return books.certificate(risk.covariance(b.train), b.indexed(b.ivp()), b.indexed(books.equal_weight(b.train)), 4.0, 0.3)


@query("vertex_bound", sql(f"SELECT fold_id, {r('(1 + count(*) * 0.02) * min(v) - 0.02 * sum(v) AS low')} FROM mu GROUP BY fold_id"))
def _(spark, d):
    return books.boxed_low(Base(spark, d).train.groupBy("fold_id", "asset").agg(F.avg("ret").alias("v")), 0.02)


def _scored(x: str) -> str:
    return f"CASE WHEN count({x}) OVER f >= 3 AND stddev_samp({x}) OVER f > 1e-14 THEN coalesce(({x} - avg({x}) OVER f) / stddev_samp({x}) OVER f, 0) ELSE 0 END"


NUMBERED = "SELECT *, row_number() OVER a AS k, train_hi - row_idx - 1 AS back, train_hi - train_lo AS t FROM tr WINDOW a AS (PARTITION BY fold_id, asset ORDER BY row_idx)"
VOLATILITY = {
    "nr": NUMBERED,
    "vs": "SELECT fold_id, asset, asset_idx, stddev_samp(ret) FILTER (back < 20) AS a, stddev_samp(ret) FILTER (back < 60) AS b, stddev_samp(ret) FILTER (k <= t // 2) AS c, stddev_samp(ret) FILTER (k > t // 2) AS d, avg(abs(ret)) FILTER (back < 20) AS e FROM nr GROUP BY 1, 2, 3",
    "vz": f"SELECT fold_id, asset, asset_idx, ({' + '.join(_scored(x) for x in ('a', 'b', 'c', 'd', 'e', '(a / b)'))}) / 6 AS s FROM vs WINDOW f AS (PARTITION BY fold_id)",
}


@query("composite_volatility", sql(f"SELECT fold_id, asset, asset_idx, {r('s - avg(s) OVER (PARTITION BY fold_id) AS signal')} FROM vz", look=100, **VOLATILITY))
def _(spark, d):
    return signals.composite(Base(spark, d, look=100).train, "volatility")


@query(
    "composite_stable",
    sql(
        f"SELECT fold_id, asset, asset_idx, {r('s - avg(s) OVER (PARTITION BY fold_id) AS signal')} FROM sz2",
        look=240,
        nr=NUMBERED,
        sr="SELECT *, avg(ret) OVER (PARTITION BY fold_id, row_idx) AS mkt, CASE WHEN k >= 20 THEN stddev_samp(ret) OVER (PARTITION BY fold_id, asset ORDER BY row_idx ROWS 19 PRECEDING) END AS sd20, product(1 + ret) OVER (PARTITION BY fold_id, asset ORDER BY row_idx) AS path, (ret - avg(ret) FILTER (back < 60) OVER (PARTITION BY fold_id, asset)) / stddev_samp(ret) FILTER (back < 60) OVER (PARTITION BY fold_id, asset) AS z FROM nr",
        ss="SELECT fold_id, asset, asset_idx, corr(ret, mkt) AS a, corr(abs(ret), abs(mkt)) AS b, avg(pow(z, 4)) FILTER (back < 60) - 3 AS c, stddev_samp(sd20) AS d, max(path) FILTER (back = 20) / max(path) FILTER (back = 230) - 1 AS e FROM sr GROUP BY 1, 2, 3",
        sz2=f"SELECT fold_id, asset, asset_idx, ({' + '.join(_scored(x) for x in 'abcde')}) / 5 AS s FROM ss WINDOW f AS (PARTITION BY fold_id)",
    ),
)
def _(spark, d):
    return signals.composite(Base(spark, d, look=240).train, "stable")


@query(
    "tilted_qp",
    _recursive(
        sql(
            f"SELECT fold_id, asset, asset_idx, {r('x[asset_idx + 1] AS w')}, true AS certified FROM (SELECT * FROM gd WHERE k = 3000) JOIN ai ON true",
            look=100,
            **LISTS,
            **VOLATILITY,
            tl="SELECT fold_id, list(-0.05 * v ORDER BY asset_idx) AS tl FROM (SELECT fold_id, asset_idx, s - avg(s) OVER (PARTITION BY fold_id) AS v FROM vz) GROUP BY fold_id",
            ab="SELECT cm.fold_id, cm, n, tl, list_transform(dg, lambda v: (1 / sqrt(v)) / list_sum(list_transform(dg, lambda u: 1 / sqrt(u)))) AS b FROM cm JOIN tl ON tl.fold_id = cm.fold_id",
            ac2="SELECT *, list_inner_product(list_transform(cm, lambda row: list_inner_product(row, b)), b) AS risk, list_inner_product(b, b) AS size FROM ab",
            aq="SELECT fold_id, n, list_transform(range(1, n + 1), lambda i: list_transform(range(1, n + 1), lambda j: cm[i][j] / risk + CASE WHEN i = j THEN 1.0 / size ELSE 0 END)) AS qm, list_transform(range(1, n + 1), lambda i: b[i] / size - tl[i] / 2) AS q FROM ac2",
            cs="SELECT *, list_max(list_transform(qm, lambda row: list_sum(list_transform(row, lambda v: abs(v))))) AS top FROM aq",
            gd=_descent("list_transform(range(1, n + 1), lambda i: y[i] - (list_inner_product(qm[i], y) - q[i]) / top)", "cs", 3000),
        )
    ),
)
def _(spark, d):
    b = Base(spark, d, look=100)
    tilt = signals.composite(b.train, "volatility").withColumn("tilt", -0.05 * F.col("signal"))
    return allocation.anchored_books(b.train, 1.0, tilt).drop("objective")


# --- legality ----------------------------------------------------------------------------------------------------

BROKEN = """CASE fold_id % 7 WHEN 3 THEN CASE WHEN asset_idx = 1 THEN NULL ELSE w END WHEN 4 THEN CASE asset_idx WHEN 0 THEN w - 0.3 WHEN 1 THEN w + 0.3 ELSE w END WHEN 5 THEN w * 0.9 WHEN 6 THEN 1.0 / n ELSE w END"""
CODES = {
    "bw": f"SELECT fold_id, asset, n, {BROKEN} AS w FROM (SELECT iv.*, asset_idx, count(*) OVER (PARTITION BY fold_id) AS n FROM iv JOIN ai ON ai.asset = iv.asset) WHERE fold_id % 7 <> 1 AND NOT (fold_id % 7 = 2 AND asset_idx = 0)",
    "bs": "SELECT fold_id, any_value(n) AS n, count(*) AS size, count(w) AS known, min(w) AS low, sum(w) AS net, max(abs(w - 1.0 / n)) AS off FROM bw GROUP BY fold_id",
    "lc": "SELECT fd.fold_id AS draw, CASE WHEN size IS NULL THEN 'no_weights' WHEN size <> n THEN 'shape' WHEN known < size THEN 'nonfinite' WHEN low < -1e-6 THEN 'below_short_budget' WHEN abs(net - 1) > 1e-6 THEN 'not_fully_invested' WHEN off <= 1e-8 THEN 'equal_weight' ELSE 'ok' END AS code FROM fd LEFT JOIN bs ON bs.fold_id = fd.fold_id",
}


def broken_codes(spark, d):
    """The inverse-volatility books, six of seven folds broken in one way each, and what the check says."""
    b = Base(spark, d)
    book = b.indexed(b.ivp()).withColumn("n", F.count(F.lit(1)).over(folds.by_fold()))
    book = book.withColumn("w", F.expr(BROKEN)).filter("fold_id % 7 <> 1 AND NOT (fold_id % 7 = 2 AND asset_idx = 0)")
    sizes = b.train.groupBy("fold_id").agg(F.count_distinct("asset").alias("n"))
    return legality.codes(sizes.withColumnRenamed("fold_id", "draw"), book.select(F.col("fold_id").alias("draw"), "asset", "w"))


@query("legality_codes", sql("SELECT draw, code FROM lc", **CODES))
def _(spark, d):
    return broken_codes(spark, d)


@query("worst_slices", sql("SELECT draw % 6 AS slice, count(*) FILTER (code = 'no_weights') AS failed, count(*) FILTER (code NOT IN ('ok', 'no_weights', 'equal_weight')) AS illegal, count(*) FILTER (code = 'equal_weight') AS equal FROM lc GROUP BY 1 ORDER BY failed DESC, illegal DESC, equal DESC, slice LIMIT 5", **CODES))
def _(spark, d):
    sliced = broken_codes(spark, d).withColumn("slice", F.col("draw") % 6)
    return legality.worst(sliced.groupBy("slice").agg(F.count_if(F.col("code") == "no_weights").alias("failed"), F.count_if(~F.col("code").isin("ok", "no_weights", "equal_weight")).alias("illegal"), F.count_if(F.col("code") == "equal_weight").alias("equal")))


@query("random_window_legality", sql(f"SELECT count(DISTINCT draw) AS draws, 'ok' AS code FROM (VALUES {', '.join(map(str, _windows()))}) AS w(draw, a, s)"))
def _(spark, d):
    draws = spark.createDataFrame(_windows(), "draw int, asset_idx int, start int")
    rows = folds.random_windows(panels.panel(spark, d, "brand"), draws, 100).withColumnRenamed("draw", "fold_id")
    made = allocation.allocations(rows, {"round8": K.Params(penalty=1.0)})
    told = legality.codes(draws.groupBy("draw").agg(F.count(F.lit(1)).alias("n")), made.select(F.col("fold_id").alias("draw"), "asset", "w"))
    return told.groupBy("code").agg(F.count(F.lit(1)).alias("draws"))


# --- selection ---------------------------------------------------------------------------------------------------

CHAINED = {
    **FIELD,
    "bq": "SELECT label, row_idx, gross AS x, product(1 + gross) OVER w AS wealth FROM bp WINDOW w AS (PARTITION BY label ORDER BY row_idx)",
    "bh": "SELECT bq.*, max(wealth) OVER w AS high, year(date) AS year, product(1 + x) OVER v AS yw FROM bq JOIN fl ON fl.row_idx = bq.row_idx WINDOW w AS (PARTITION BY label ORDER BY bq.row_idx), v AS (PARTITION BY label, year(date) ORDER BY bq.row_idx)",
    "by2": "SELECT *, max(yw) OVER (PARTITION BY label, year ORDER BY row_idx) AS yh FROM bh",
    "cw": "SELECT label AS candidate, avg(x) / stddev_samp(x) AS sharpe, avg(x) AS ret, max(1 - wealth / greatest(high, 1.0)) AS max_dd FROM bh GROUP BY label",
    "cy": "SELECT label AS candidate, year, avg(x) / stddev_samp(x) AS sharpe, avg(x) AS ret, max(1 - yw / greatest(yh, 1.0)) AS max_dd FROM by2 GROUP BY label, year HAVING count(*) >= 20",
}


def _mean_rank(source: str, by: str) -> str:
    part = f"PARTITION BY {by}" if by else ""
    and_by = f"{by}, " if by else ""
    one = lambda v, k: f"(rank() OVER ({part} ORDER BY {v}) + (count(*) OVER (PARTITION BY {and_by}{k}) - 1) / 2.0)"
    return f"SELECT candidate, ({one('sharpe', 'sharpe')} + {one('ret', 'ret')} + {one('-max_dd', 'max_dd')}) / 3.0 / count(*) OVER ({part}) AS pct FROM {source}"


@query(
    "internal_ranking",
    sql(
        f"SELECT cf.candidate, true AS eligible, {r('cm2.middle AS median_year', 'cm2.lower AS lower_quartile_year', 'cf.pct AS full_period')}, 0.0::DOUBLE AS degradation, row_number() OVER (ORDER BY middle DESC, lower DESC, cf.pct DESC, cf.candidate) AS place FROM cf JOIN cm2 ON cm2.candidate = cf.candidate",
        **CHAINED,
        cf=_mean_rank("cw", ""),
        cp=_mean_rank("cy", "year"),
        cm2="SELECT candidate, median(pct) AS middle, quantile_cont(pct, 0.25) AS lower FROM cp GROUP BY candidate",
    ),
)
def _(spark, d):
    b = Base(spark, d)
    made = {"ewp": books.equal_weight(b.train), "ivp": b.ivp(), "inverse_risk": books.inverse_risk(b.train), "last_resort": books.last_resort(b.train), "risk_ranked": books.risk_ranked(b.train)}
    path = None
    for name, book in made.items():
        one = b.path(book).select(F.lit(name).alias("candidate"), "row_idx", F.col("gross").alias("ret"))
        path = one if path is None else path.unionByName(one)
    path = path.join(b.returns.select("row_idx", F.year("date").alias("year")).distinct(), "row_idx")
    path = stored(path, "book-paths")

    def measured(by):
        both = metrics.performance(path, by).join(metrics.drawdowns(path, by), by)
        return both.select(*by, "n", "sharpe", F.col("annual_mean").alias("ret"), F.col("max_dd_geo").alias("max_dd"))

    whole = measured(["candidate"]).withColumn("failed", F.lit(0)).withColumn("degradation", F.lit(0.0))
    return selection.internal_ranking(whole, measured(["candidate", "year"]).filter("n >= 20"))


@query("tune_two_phases")
def _(spark, d):
    returns = Base(spark, d).returns
    days = sorted(x.date for x in returns.select("date").distinct().collect())  # one row per period
    cut = days[len(days) * 6 // 10]
    return selection.tuned(returns, selection.grid(), LOOK, STEP, str(cut), str(days[-1]), least=20)


SCORES = {"sharpe": "", "max_dd": "-", "annual": "", "vol": "-", "cvar": "-", "median_annual": "", "median_sharpe": "", "median_cvar": "-", "fail": "-"}


def _contract_sql() -> str:
    parts = {f"p_{m}": _pct(m, sign, "ce") for m, sign in SCORES.items()}
    scores = " UNION ALL ".join(
        f"SELECT ce.label, {k} AS contract, {' + '.join(f'{w} * p_{m}.pct' for m, w in c.weights.items())} AS score FROM ce " + " ".join(f"JOIN p_{m} ON p_{m}.label = ce.label" for m in c.weights)
        for k, c in scoring.CONTRACTS.items()
    )
    more = {
        **FIELD,
        "cd": "SELECT *, max(wealth) OVER (PARTITION BY label ORDER BY row_idx) AS high FROM (SELECT label, row_idx, gross AS x, product(1 + gross) OVER (PARTITION BY label ORDER BY row_idx) AS wealth, row_number() OVER (PARTITION BY label ORDER BY gross, row_idx) AS k, count(*) OVER (PARTITION BY label) AS n FROM bp)",
        "ce": "SELECT cd.label, avg(x) / stddev_samp(x) * sqrt(252) AS sharpe, max(1 - wealth / greatest(high, 1.0)) AS max_dd, avg(x) * 252 AS annual, stddev_samp(x) * sqrt(252) AS vol, -sum(CASE WHEN k <= ceil(n * 0.05 - 1e-9) THEN least(greatest(n * 0.05 - k + 1, 0), 1) * x END) / (any_value(n) * 0.05) AS cvar, any_value(median_annual) AS median_annual, any_value(median_sharpe) AS median_sharpe, any_value(median_cvar) AS median_cvar, 0.0 AS fail FROM cd JOIN fe ON fe.label = cd.label GROUP BY cd.label",
        **parts,
        "sc2": scores,
    }
    return sql(f"SELECT label, contract, {r('score')} FROM sc2", **more)


@query("contract_scores", _contract_sql())
def _(spark, d):
    b = Base(spark, d)
    made = {"ewp": books.equal_weight(b.train), "ivp": b.ivp(), "inverse_risk": books.inverse_risk(b.train), "last_resort": books.last_resort(b.train), "risk_ranked": books.risk_ranked(b.train)}
    path = None
    for name, book in made.items():
        one = b.path(book).select(F.lit(name).alias("label"), "fold_id", "row_idx", F.col("gross").alias("ret"))
        path = one if path is None else path.unionByName(one)
    path = stored(path, "book-paths")  # a row for each book and period
    by = ["label"]
    whole = metrics.fold_metrics(path, by).select("label", "sharpe", F.col("max_dd_geo").alias("max_dd"), F.col("annual_mean").alias("annual"), F.col("annual_vol").alias("vol"), F.col("cvar95").alias("cvar"))
    each = metrics.performance(path, ["label", "fold_id"]).join(metrics.cvar(path, ["label", "fold_id"]), ["label", "fold_id"])
    middle = each.groupBy("label").agg(F.median("annual_mean").alias("median_annual"), F.median("sharpe").alias("median_sharpe"), F.median("cvar95").alias("median_cvar"))
    entries = whole.join(middle, "label").withColumn("fail", F.lit(0.0)).withColumn("all", F.lit(1))
    entries = stored(entries, "entries")
    out = None
    for k, c in scoring.CONTRACTS.items():
        one = scoring.field_score(entries, ["all"], c.weights, all_or_nothing=2 <= k <= 6).select("label", F.lit(k).alias("contract"), "score")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "signed_rank",
    sql(
        f"SELECT n, {r('plus', 'least(1.0, 2 * count(*) FILTER (reach <= least(plus, n * (n + 1) / 2.0 - plus)) / pow(2, n)) AS p')} FROM sw GROUP BY n, plus",
        **FIELD,
        df="SELECT a.annual_mean - e.annual_mean AS v FROM bc AS a JOIN bc AS e ON e.label = 'ewp' AND a.fold_id = e.fold_id WHERE a.label = 'ivp'",
        ds="SELECT count(*) AS n, coalesce(sum(rk) FILTER (v > 0), 0)::DOUBLE AS plus FROM (SELECT v, row_number() OVER (ORDER BY abs(v)) AS rk FROM df WHERE v <> 0)",
        sw="SELECT n, plus, bits, sum(((bits >> i) & 1) * (i + 1)) AS reach FROM (SELECT n, plus, unnest(range(0, CAST(pow(2, n) AS BIGINT))) AS bits FROM ds) JOIN (SELECT CAST(unnest(range(0, 15)) AS INTEGER) AS i) ON i < n GROUP BY n, plus, bits",
    ),
)
def _(spark, d):
    b = Base(spark, d)
    x, y = b.metrics().select("fold_id", F.col("annual_mean").alias("a")), b.metrics(books.equal_weight(b.train)).select("fold_id", F.col("annual_mean").alias("e"))
    return scoring.signed_rank_table(x.join(y, "fold_id").select((F.col("a") - F.col("e")).alias("delta")))


# --- tails, factors, keys ----------------------------------------------------------------------------------------

_GINI = "2 * sum((2 * k - n - 1) * x) / (any_value(n) * (any_value(n) - 1)) AS gini"
_CDAR = "sum(CASE WHEN dk <= ceil(n * 0.05 - 1e-9) THEN least(greatest(n * 0.05 - dk + 1, 0), 1) * fallen END) / (any_value(n) * 0.05) AS cdar"


@query(
    "tail_metrics",
    sql(
        f"SELECT fold_id, {r(_GINI, 'ln(avg(exp(-x)) / 0.05) AS entropic', 'avg(greatest(m - x, 0)) AS lower_moment', 'avg(fallen) AS mean_drawdown', 'quantile_cont(fallen, 0.95) AS drawdown_at_risk', _CDAR, 'avg(x) * 252 / max(fallen) AS calmar')} FROM t2 GROUP BY fold_id",
        t1="SELECT fold_id, row_idx, x, m, n, k, max(total) OVER (PARTITION BY fold_id ORDER BY row_idx) - total AS fallen FROM (SELECT fold_id, row_idx, gross AS x, avg(gross) OVER (PARTITION BY fold_id) AS m, count(*) OVER (PARTITION BY fold_id) AS n, row_number() OVER (PARTITION BY fold_id ORDER BY gross, row_idx) AS k, sum(gross) OVER (PARTITION BY fold_id ORDER BY row_idx) AS total FROM rb)",
        t2="SELECT *, row_number() OVER (PARTITION BY fold_id ORDER BY fallen DESC, row_idx) AS dk FROM t1",
    ),
)
def _(spark, d):
    return metrics.tails(Base(spark, d).path(), ["fold_id"], "gross")


_EVAR = "pow(2.0, {p}) * ln(list_sum(list_transform(l, lambda v: exp((v - list_max(l)) / pow(2.0, {p})))) / len(l) / 0.05) + list_max(l)"


@query(
    "entropic_value_at_risk",
    _recursive(
        sql(
            f"SELECT fold_id, {r(f'size * ({_EVAR.format(p='((lo + hi) / 2)')}) AS evar')} FROM es WHERE step = 90",
            el="SELECT fold_id, any_value(size) AS size, list(-gross / size) AS l FROM (SELECT fold_id, gross, max(abs(gross)) OVER (PARTITION BY fold_id) AS size FROM rb) GROUP BY fold_id",
            es=f"SELECT fold_id, size, l, -12.0::DOUBLE AS lo, 12.0::DOUBLE AS hi, 0 AS step FROM el UNION ALL SELECT fold_id, size, l, CASE WHEN {_EVAR.format(p='((2 * lo + hi) / 3)')} > {_EVAR.format(p='((lo + 2 * hi) / 3)')} THEN (2 * lo + hi) / 3 ELSE lo END, CASE WHEN {_EVAR.format(p='((2 * lo + hi) / 3)')} > {_EVAR.format(p='((lo + 2 * hi) / 3)')} THEN hi ELSE (lo + 2 * hi) / 3 END, step + 1 FROM es WHERE step < 90",
        )
    ),
)
def _(spark, d):
    return metrics.entropic_value_at_risk(Base(spark, d).path(), ["fold_id"], "gross", "evar")


def _slog(x: str) -> str:
    return f"sign({x}) * ln(1 + abs({x}))"


@query("reversal_factors", sql(f"SELECT asset, k, date, {r(_slog(f'(-{_back(10)})') + ' AS rev10', _slog(f'({_back(120)} / {_roll("stddev_samp", "ret", 120)})') + ' AS mom120_vol')} FROM fr", **ROWS))
def _(spark, d):
    """Both in logs of their size, as these panels move by orders of magnitude."""
    f = factors.return_factors(rows_of(spark, d))
    told = lambda c: (F.signum(c) * F.log1p(F.abs(c))).alias(c)
    return f.select("asset", "k", "date", told("rev10"), told("mom120_vol"))


@query("live_mask", sql("SELECT di.date, ai.asset, coalesce(price > 0, false) AS live FROM di CROSS JOIN ai LEFT JOIN px ON px.date = di.date AND px.asset = ai.asset", "nation"))
def _(spark, d):
    prices = panels.PanelSpec("nation").prices(spark, d)
    return panels.live_mask(prices)


@query("membership_by_date", sql(f"SELECT mv.date, mv.asset, {r('ret')} FROM mv WHERE EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE n_name = mv.asset AND CAST(date_trunc('week', l_shipdate) AS DATE) = mv.date AND o_orderpriority = '1-URGENT')", "nation"))
def _(spark, d):
    members = panels.members(spark, d, "1-URGENT")
    moved = panels.simple_returns(panels.PanelSpec("nation").prices(spark, d))
    return moved.join(members.filter(F.col("index_name") == "1-URGENT"), ["date", "asset"], "left_semi").select("date", "asset", "ret")


@query("regex_keys", sql("SELECT DISTINCT p_brand AS key, regexp_extract(p_brand, '^(\\w+)#(\\d+)$', 1) AS family, CAST(regexp_extract(p_brand, '^(\\w+)#(\\d+)$', 2) AS BIGINT) AS number FROM part WHERE regexp_matches(p_brand, '^\\w+#\\d+$')"))
def _(spark, d):
    part = panels.table(spark, d, "part").select(F.col("p_brand").alias("key")).distinct()
    return panels.keyed(part)


@query("penalty_frontier", None)
def _(spark, d):
    """Configurations of one penalty scan with their compliance: exposure, distance to equal weight and to the anchor's field."""
    b = Base(spark, d)
    made = allocation.allocations(b.train, {f"p{p:g}_g{g:g}": K.Params(penalty=p, gross_budget=g, downside_mix=m) for p, g, m in ((0.25, 1.0, 0.0), (1.0, 1.0, 0.5), (4.0, 1.6, 0.0))})
    return books.exposure(made.withColumn("fold_id", F.concat_ws("|", "config", "fold_id"))).withColumnRenamed("fold_id", "config_fold")


@query("ewma_long_panel", sql(f"SELECT asset, {r('sum(alpha * ret) AS mean')} FROM ag GROUP BY fold_id, asset HAVING fold_id = 0", **{"ag": AGED["ag"]}))
def _(spark, d):
    b = Base(spark, d)
    return risk.aged(b.train, b.folds, 10.0).filter("fold_id = 0").groupBy("asset").agg(F.sum(F.col("alpha") * F.col("ret")).alias("mean"))
