"""Cross-sectional factors of return and bar panels, rank information coefficients, quantile books.

Long layout: (asset, k, date, ret, ..), k numbering an asset's rows. Every factor is a composition of row windows by asset;
a window gives NULL until it holds max(10, round(0.6 w)) values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Returns beyond this size are artefacts.
GLITCH = 0.5


def least_rows(w: int) -> int:
    return max(10, round(w * 0.6))


def _last(w: int):
    return Window.partitionBy("asset").orderBy("k").rowsBetween(1 - w, 0)


def _so_far():
    return Window.partitionBy("asset").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)


def _by_time():
    return Window.partitionBy("asset").orderBy("k")


def rolled(kind, x: Column, w: int, least: int | None = None) -> Column:
    """An aggregate over the last w rows, NULL with too few values."""
    return F.when(F.count(x).over(_last(w)) >= (least or least_rows(w)), kind(x).over(_last(w)))


def rolled_pair(kind, x: Column, y: Column, w: int) -> Column:
    """A two-column aggregate over the last w rows where both have values."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.when(F.count(a).over(_last(w)) >= least_rows(w), kind(a, b).over(_last(w)))


def covariance(x: Column, y: Column, w: int) -> Column:
    return rolled_pair(F.covar_samp, x, y, w)


def correlation(x: Column, y: Column, w: int) -> Column:
    """NULL where either side is constant."""
    both = x.isNotNull() & y.isNotNull()
    sx, sy = F.stddev_samp(F.when(both, x)).over(_last(w)), F.stddev_samp(F.when(both, y)).over(_last(w))
    return F.when((sx > 1e-14) & (sy > 1e-14), F.try_divide(covariance(x, y, w), sx * sy))


def skew(x: Column, w: int) -> Column:
    """Sample skewness, corrected for bias."""
    n = F.count(x).over(_last(w))
    flat = F.coalesce(F.var_samp(x).over(_last(w)), F.lit(0.0)) < 1e-28
    return F.when((n >= least_rows(w)) & ~flat, F.skewness(x).over(_last(w)) * F.sqrt(n * (n - 1)) / (n - 2))


def kurt(x: Column, w: int) -> Column:
    """Sample excess kurtosis, corrected for bias."""
    n = F.count(x).over(_last(w))
    flat = F.coalesce(F.var_samp(x).over(_last(w)), F.lit(0.0)) < 1e-28
    return F.when((n >= least_rows(w)) & ~flat, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x).over(_last(w)) + 6))


#: Half-lives in a block of weights: 2**100 is far from overflow, and what lies a whole block back weighs 2**-100.
BLOCK = 100


def faded(x: Column, half_life: float, least: int) -> Column:
    """Mean with weights that halve every half_life rows back.

    Weights are powers of two from the start of a block of rows, so they stay bounded however long the panel is; a row sees
    its own block so far and the block before, scaled down.
    """
    rows = int(BLOCK * half_life)
    block = F.floor(F.col("k") / rows)
    weight = F.when(x.isNotNull(), F.pow(F.lit(2.0), (F.col("k") - block * rows) / half_life))
    own = Window.partitionBy("asset", block).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("asset").orderBy(block).rangeBetween(-1, -1)

    def total(v: Column) -> Column:
        return F.coalesce(F.sum(v).over(own), F.lit(0.0)) + F.coalesce(F.sum(v).over(before), F.lit(0.0)) * 2.0**-BLOCK

    return F.when(F.count(x).over(_so_far()) >= least, F.try_divide(total(x * weight), total(weight)))


def moved(price: Column, rows: int) -> Column:
    return F.try_divide(price, F.lag(price, rows).over(_by_time())) - 1


def cleaned(returns: DataFrame) -> DataFrame:
    """ret without artefacts, flat (zero-filled) returns and the price path they make, and the glitch mark."""
    bad = F.abs("ret") > GLITCH
    marked = returns.withColumn("glitch", F.coalesce(bad, F.lit(False))).withColumn("ret", F.when(~bad, F.col("ret")))
    flat = marked.withColumn("flat", F.coalesce("ret", F.lit(0.0)))
    return flat.withColumn("path", F.product(1 + F.col("flat")).over(_so_far()))


def return_factors(rows: DataFrame) -> DataFrame:
    """The 22 factors of returns alone. rows: asset, k, date, ret, path."""
    r, p = F.col("ret"), F.col("path")
    rows = rows.withColumn("mkt", F.avg("ret").over(Window.partitionBy("date")))
    m = F.col("mkt")
    rows = rows.withColumn("sd20", rolled(F.stddev_samp, r, 20)).withColumn("before", F.lag("ret").over(_by_time())).withColumn("total", F.sum("ret").over(_so_far()))
    var_m = rolled(F.var_samp, m, 252)
    rows = rows.withColumn("beta", F.when(var_m > 0, F.try_divide(covariance(r, m, 252), var_m)))
    return rows.select(
        "asset", "k", "date",
        *(rolled(F.stddev_samp, r, w).alias(f"rv{w}") for w in (10, 20, 60, 252)),
        faded(F.abs(r), 10, 30).alias("dabs10"),
        faded(F.abs(r), 20, 60).alias("dabs20"),
        rolled(F.stddev_samp, F.least(r, F.lit(0.0)), 60).alias("downside_vol60"),
        rolled(F.stddev_samp, F.greatest(r, F.lit(0.0)), 60).alias("upside_vol60"),
        skew(r, 60).alias("skew60"),
        kurt(r, 60).alias("kurt60"),
        rolled(F.stddev_samp, F.col("sd20"), 60).alias("volofvol60"),
        correlation(r, F.col("before"), 20).alias("autocorr20"),
        moved(p, 231).alias("mom231"),
        moved(p, 21).alias("mom21"),
        (-moved(p, 5)).alias("rev5"),
        (-moved(p, 10)).alias("rev10"),
        F.try_divide(moved(p, 120), rolled(F.stddev_samp, r, 120)).alias("mom120_vol"),
        F.col("beta").alias("beta252"),
        correlation(r, m, 252).alias("corr_mkt252"),
        rolled(F.stddev_samp, r - F.col("beta") * m, 252).alias("residvol252"),
        correlation(F.abs(r), F.abs(m), 60).alias("corr_vol_mkt"),
        (rolled(F.max, F.col("total"), 60, 36) - F.col("total")).alias("winmaxdd60"),
    )


def bar_factors(bars: DataFrame) -> DataFrame:
    """The 15 factors of bars: asset, k, date, ret, open, high, low, close, volume, amount. Prices are compared with the close."""
    r, o, h, low, c, v, a = (F.col(x) for x in ("ret", "open", "high", "low", "close", "volume", "amount"))
    size = F.abs(r)
    rows = bars.withColumn("range", F.try_divide(h - low, F.when(h + low != 0, h + low))).withColumn("dh", h - F.lag("high").over(_by_time())).withColumn("dv", v - F.lag("volume").over(_by_time()))
    spread = F.when(h != low, h - low)
    sd_v = rolled(F.stddev_samp, v, 20)
    return rows.select(
        "asset", "k", "date",
        F.col("range").alias("range_intensity"),
        faded(F.col("range"), 5, 10).alias("range_decay"),
        F.try_divide(h - low, F.when(low != 0, low)).alias("hl_ratio"),
        covariance(F.col("dh"), v, 10).alias("cov_dhigh_vol10"),
        covariance(F.col("dh"), F.col("dv"), 10).alias("cov_dhigh_dvol10"),
        covariance(h - low, v, 20).alias("cov_range_vol20"),
        covariance(r, v, 20).alias("cov_ret_vol20"),
        covariance(r, a, 20).alias("cov_ret_amt20"),
        faded(size * a, 15, 20).alias("absret_amt20"),
        rolled(F.var_samp, F.try_divide(h - o, F.when(o != 0, o)), 10).alias("intraday_var10"),
        rolled(F.avg, F.try_divide(h - F.greatest(o, c), spread), 10).alias("shadows"),
        rolled(F.avg, F.try_divide(o - c, F.when(c != 0, c)), 10).alias("vwap_dist10"),
        F.when(sd_v > 0, F.try_divide(v - rolled(F.avg, v, 20), sd_v)).alias("vol_z20"),
        (F.try_divide(v, rolled(F.avg, v, 60)) - 1).alias("turn_z20"),
        rolled(F.avg, F.try_divide(size, F.when(a != 0, a)), 20).alias("amihud20"),
    )


def forward(rows: DataFrame, hold: int) -> DataFrame:
    """rows with the return of the next `hold` rows."""
    return rows.withColumn("fwd", F.try_divide(F.lead("path", hold).over(_by_time()), F.col("path")) - 1)


def _ranks(rows: DataFrame, *values: str) -> DataFrame:
    for v in values:
        up = Window.partitionBy("date").orderBy(v)
        rows = rows.withColumn(f"r_{v}", F.rank().over(up) + (F.count(F.lit(1)).over(Window.partitionBy("date", v)) - 1) / 2)
    return rows


def rank_ic(rows: DataFrame, factor: str, least: int) -> DataFrame:
    """Rows (date, n, ic): Spearman correlation of the factor with what follows, on dates with enough names."""
    both = _ranks(rows.filter(F.col(factor).isNotNull() & F.col("fwd").isNotNull()), factor, "fwd")
    x, y = F.col(f"r_{factor}"), F.col("r_fwd")
    sums = both.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.covar_samp(x, y).alias("c"), F.stddev_samp(x).alias("sx"), F.stddev_samp(y).alias("sy"))
    return sums.filter(F.col("n") >= least).select("date", "n", F.when((F.col("sx") > 0) & (F.col("sy") > 0), F.try_divide(F.col("c"), F.col("sx") * F.col("sy"))).alias("ic"))


def ic_stats(ics: DataFrame) -> DataFrame:
    """Mean, deviation, ratio, t value and share of positive dates."""
    ratio = F.try_divide(F.avg("ic"), F.stddev_samp("ic"))
    return ics.agg(F.count("ic").alias("n"), F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_sd"), ratio.alias("icir"), (ratio * F.sqrt(F.count("ic"))).alias("t"), F.avg((F.col("ic") > 0).cast("double")).alias("positive"))


def top_quantile(rows: DataFrame, factor: str, share: float) -> DataFrame:
    """The largest share of names by date, one at least; ties by name."""
    held = rows.filter(F.col(factor).isNotNull())
    n = F.count(F.lit(1)).over(Window.partitionBy("date"))
    place = F.row_number().over(Window.partitionBy("date").orderBy(F.desc(factor), "asset"))
    chosen = held.withColumn("place", place).withColumn("size", F.greatest(F.lit(1.0), F.rint(n * share)))
    return chosen.filter("place <= size").drop("place", "size")


def selection_turnover(chosen: DataFrame) -> DataFrame:
    """Rows (k, turnover): share of a date's names that weren't chosen on the date before."""
    now = chosen.select("k", "asset")
    before = chosen.select((F.col("k") + 1).alias("k"), "asset", F.lit(1).alias("kept"))
    both = now.join(before, ["k", "asset"], "left").groupBy("k").agg((1 - F.count("kept") / F.count(F.lit(1))).alias("turnover"))
    return both.join(before.select("k").distinct(), "k", "left_semi")


def z_score(x: Column, by: str) -> Column:
    """0 with fewer than three values or none that differ."""
    w = Window.partitionBy(by)
    sd = F.stddev_samp(x).over(w)
    return F.when((F.count(x).over(w) >= 3) & (sd > 1e-14) & x.isNotNull(), F.try_divide(x - F.avg(x).over(w), sd)).otherwise(0.0)
