"""Reference books, distances between books, exposures and the contract that weights must keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def equal_weight(train: DataFrame) -> DataFrame:
    """Rows (fold_id, asset, w): 1/n."""
    rows = train.select("fold_id", "asset").distinct()
    return rows.withColumn("w", 1 / F.count(F.lit(1)).over(Window.partitionBy("fold_id")))


def inverse_volatility(train: DataFrame) -> DataFrame:
    """Weights in proportion to 1/sd; none for a fold of fewer than three rows or with a constant asset."""
    sd = train.groupBy("fold_id", "asset").agg(F.stddev_samp("ret").alias("sd"), F.count("ret").alias("n"))
    by = Window.partitionBy("fold_id")
    sound = sd.withColumn("bad", F.max(((F.col("n") < 3) | (F.coalesce("sd", F.lit(0.0)) <= 0)).cast("int")).over(by)).filter("bad = 0")
    return sound.select("fold_id", "asset", ((1 / F.col("sd")) / F.sum(1 / F.col("sd")).over(by)).alias("w"))


def inverse_risk(train: DataFrame, floor: float = 1e-12) -> DataFrame:
    """Weights in proportion to 1/sqrt(variance), the variance floored; a missing one gives no weight."""
    risk = train.groupBy("fold_id", "asset").agg(F.var_samp("ret").alias("v"))
    score = F.coalesce(1 / F.sqrt(F.greatest("v", F.lit(floor))), F.lit(0.0))
    return risk.select("fold_id", "asset", (score / F.sum(score).over(Window.partitionBy("fold_id"))).alias("w"))


def last_resort(train: DataFrame) -> DataFrame:
    """Weights n..1 by asset order, normalised: never equal, always defined."""
    rows = train.select("fold_id", "asset", "asset_idx").distinct()
    by = Window.partitionBy("fold_id")
    n = F.count(F.lit(1)).over(by)
    points = n - F.row_number().over(by.orderBy("asset_idx")) + 1
    return rows.select("fold_id", "asset", (points / (n * (n + 1) / 2)).alias("w"))


def risk_ranked(train: DataFrame) -> DataFrame:
    """Weights in proportion to 1/rank by observed risk, the least risky first."""
    risk = train.groupBy("fold_id", "asset").agg(F.var_samp("ret").alias("v"))
    rank = F.row_number().over(Window.partitionBy("fold_id").orderBy("v", "asset"))
    ranked = risk.withColumn("k", 1 / rank)
    return ranked.select("fold_id", "asset", (F.col("k") / F.sum("k").over(Window.partitionBy("fold_id"))).alias("w"))


def l1_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows (fold_id, l1, hit): the distance of two books fold by fold, and whether they are the same."""
    both = a.select("fold_id", "asset", F.col("w").alias("wa")).join(b.select("fold_id", "asset", F.col("w").alias("wb")), ["fold_id", "asset"], "full")
    gap = F.sum(F.abs(F.coalesce("wa", F.lit(0.0)) - F.coalesce("wb", F.lit(0.0))))
    return both.groupBy("fold_id").agg(gap.alias("l1")).withColumn("hit", F.col("l1") < 1e-9)


def weight_correlation(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows (fold_id, corr); NULL where either book is constant."""
    both = a.select("fold_id", "asset", F.col("w").alias("wa")).join(b.select("fold_id", "asset", F.col("w").alias("wb")), ["fold_id", "asset"])
    sums = both.groupBy("fold_id").agg(F.covar_samp("wa", "wb").alias("c"), F.stddev_samp("wa").alias("sa"), F.stddev_samp("wb").alias("sb"))
    return sums.select("fold_id", F.when((F.col("sa") > 1e-12) & (F.col("sb") > 1e-12), F.try_divide(F.col("c"), F.col("sa") * F.col("sb"))).alias("corr"))


def exposure(book: DataFrame) -> DataFrame:
    """Long, short, net, gross, largest weight and effective number of holdings per fold."""
    w = F.col("w")
    return book.groupBy("fold_id").agg(F.sum(F.greatest(w, F.lit(0.0))).alias("long"), F.sum(F.greatest(-w, F.lit(0.0))).alias("short"), F.sum(w).alias("net"), F.sum(F.abs(w)).alias("gross"), F.max(w).alias("max_weight"), (1 / F.sum(w * w)).alias("effective_n"))


def contract(book: DataFrame, short: float = 0.0, by: tuple[str, ...] = ("fold_id",)) -> DataFrame:
    """Rows (fold_id, violation, equal): the first rule a book breaks, NULL if none. A single asset may hold all."""
    w, n = F.col("w"), F.col("n")
    sized = book.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    equal = F.bool_and(F.abs(w - 1 / n) <= 1e-8 + 1e-5 * F.abs(1 / n)) & (F.first("n") > 1)
    sums = sized.groupBy(*by).agg(F.count_if(w.isNull() | F.isnan(w) | (F.abs(w) == float("inf"))).alias("holes"), F.sum(F.greatest(-w, F.lit(0.0))).alias("short"), F.sum(w).alias("net"), equal.alias("equal"))
    code = F.when(F.col("holes") > 0, "not finite").when(F.col("short") > short + 1e-10, "short budget").when(F.abs(F.col("net") - 1) > 1e-10, "sum").when(F.col("equal"), "equal weight")
    return sums.select(*by, code.alias("violation"), "equal")


def certificate(cov: DataFrame, book: DataFrame, anchor: DataFrame, penalty: float, short: float = 0.0) -> DataFrame:
    """Rows (fold_id, objective, low, gap): what the linear model at a book promises at most, relative to its objective."""
    both = book.select("fold_id", "asset_idx", F.col("w").alias("w")).join(anchor.select("fold_id", "asset_idx", F.col("w").alias("b")), ["fold_id", "asset_idx"])
    whole = cov.select("fold_id", "i", "j", "cov").union(cov.filter("i <> j").select("fold_id", "j", "i", "cov"))
    at = both.select("fold_id", F.col("asset_idx").alias("j"), "w", "b")
    drawn = whole.join(at, ["fold_id", "j"]).groupBy("fold_id", F.col("i").alias("asset_idx")).agg(F.sum(F.col("cov") * F.col("w")).alias("cw"), F.sum(F.col("cov") * F.col("b")).alias("cb"))
    rows = both.join(drawn, ["fold_id", "asset_idx"])
    sums = rows.groupBy("fold_id").agg(F.sum(F.col("b") * F.col("cb")).alias("risk"), F.sum(F.col("b") * F.col("b")).alias("size"))
    sloped = rows.join(F.broadcast(sums), "fold_id").withColumn("g", 2 * (F.col("cw") / F.col("risk") + penalty * (F.col("w") - F.col("b")) / F.col("size")))
    ends = sloped.groupBy("fold_id").agg(
        (F.sum(F.col("w") * F.col("cw")) / F.first("risk") + penalty * F.sum(F.pow(F.col("w") - F.col("b"), 2)) / F.first("size")).alias("objective"),
        (F.min("g") + short * (F.min("g") - F.max("g"))).alias("low"),
        F.sum(F.col("g") * F.col("w")).alias("at"),
    )
    return ends.select("fold_id", "objective", "low", (F.greatest(F.col("at") - F.col("low"), F.lit(0.0)) / (1 + F.abs("objective"))).alias("gap"))


def boxed_low(slopes: DataFrame, floor: float) -> DataFrame:
    """Rows (fold_id, low): the least of g'v over sum(v) = 1, v >= -floor: all at the floor but the least slope."""
    n, g = F.count(F.lit(1)), F.col("v")
    return slopes.groupBy("fold_id").agg(((1 + n * floor) * F.min(g) - floor * F.sum(g)).alias("low"))


def relative_objective(cov: DataFrame, book: DataFrame, anchor: DataFrame, penalty: float) -> DataFrame:
    """w'Cw / b'Cb + penalty |w-b|2 / |b|2 per fold; books need asset_idx."""
    both = book.select("fold_id", "asset_idx", F.col("w").alias("w")).join(anchor.select("fold_id", "asset_idx", F.col("w").alias("b")), ["fold_id", "asset_idx"])
    i = both.select("fold_id", F.col("asset_idx").alias("i"), F.col("w").alias("wi"), F.col("b").alias("bi"))
    j = both.select("fold_id", F.col("asset_idx").alias("j"), F.col("w").alias("wj"), F.col("b").alias("bj"))
    times = F.when(F.col("i") == F.col("j"), 1).otherwise(2) * F.col("cov")
    forms = cov.join(i, ["fold_id", "i"]).join(j, ["fold_id", "j"]).groupBy("fold_id").agg(F.sum(times * F.col("wi") * F.col("wj")).alias("wcw"), F.sum(times * F.col("bi") * F.col("bj")).alias("bcb"))
    gaps = both.groupBy("fold_id").agg(F.sum(F.pow(F.col("w") - F.col("b"), 2)).alias("gap"), F.sum(F.pow("b", 2.0)).alias("size"))
    return forms.join(gaps, "fold_id").select("fold_id", (F.try_divide("wcw", "bcb") + penalty * F.try_divide("gap", "size")).alias("objective"))
