"""Risk estimates in long form: eligibility, moments, covariance pairs, shrinkage, downside, weighting by age."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.panels import valid_return


def eligibility(window: DataFrame) -> DataFrame:
    """Per fold and asset of a window with missing values: valid rows, validity in the last row, and both screens.

    window: fold_id, k (row in the fold, from 0), rows (of the fold), asset, ret.
    """
    ok = valid_return(F.col("ret"))
    seen = window.groupBy("fold_id", "asset").agg(F.count_if(ok).alias("n_valid"), F.max_by(ok, "k").alias("last_valid"), F.first("rows").alias("rows"))
    need = F.least(F.col("rows"), F.greatest(F.lit(2), F.ceil(F.lit(0.8) * F.col("rows"))))
    top = seen.groupBy("fold_id").agg(F.max("n_valid").alias("most"), F.count_if((F.col("n_valid") > 0) & F.col("last_valid")).alias("alive"))
    out = seen.join(F.broadcast(top), "fold_id")
    emergency = F.when(F.col("alive") > 0, (F.col("n_valid") > 0) & F.col("last_valid")).otherwise(F.col("n_valid") == F.col("most"))
    return out.select("fold_id", "asset", "n_valid", "last_valid", ((F.col("n_valid") >= need) & F.col("last_valid")).alias("eligible"), emergency.alias("emergency"))


def window_stats(train: DataFrame) -> DataFrame:
    """Moments and quantiles per fold and asset."""
    r = F.col("ret")
    return train.groupBy("fold_id", "asset").agg(F.count(r).alias("n"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("sd"), F.min(r).alias("low"), F.max(r).alias("high"), F.median(r).alias("mid"), F.percentile(r, 0.05).alias("p05"), F.percentile(r, 0.95).alias("p95"))


def pairs(rows: DataFrame, *values: str) -> DataFrame:
    """Rows of a fold joined with themselves by asset pair i <= j; values get the suffixes _i and _j."""
    a = rows.select("fold_id", "row_idx", F.col("asset_idx").alias("i"), *(F.col(v).alias(f"{v}_i") for v in values))
    b = rows.select("fold_id", "row_idx", F.col("asset_idx").alias("j"), *(F.col(v).alias(f"{v}_j") for v in values))
    return a.join(b, ["fold_id", "row_idx"]).filter("i <= j")


def covariance(train: DataFrame) -> DataFrame:
    """Sample covariance (fold_id, i, j, cov)."""
    return pairs(train, "ret").groupBy("fold_id", "i", "j").agg(F.covar_samp("ret_i", "ret_j").alias("cov"))


def aged(train: DataFrame, folds: DataFrame, half_life: float) -> DataFrame:
    """train with normalised weights alpha that halve every half_life rows back from the fold's last."""
    span = folds.select("fold_id", (F.col("train_hi") - 1).alias("last"), "train_lo")
    total = span.withColumn("age", F.explode(F.sequence(F.lit(0), F.col("last") - F.col("train_lo")))).groupBy("fold_id", "last").agg(F.sum(F.pow(F.lit(2.0), -F.col("age") / half_life)).alias("total"))
    return train.join(F.broadcast(total), "fold_id").withColumn("alpha", F.pow(F.lit(2.0), -(F.col("last") - F.col("row_idx")) / half_life) / F.col("total"))


def ewma_variance(train: DataFrame, folds: DataFrame, half_life: float) -> DataFrame:
    """Age-weighted variance about the age-weighted mean, corrected for the weights' concentration."""
    rows = aged(train, folds, half_life)
    means = rows.groupBy("fold_id", "asset").agg(F.sum(F.col("alpha") * F.col("ret")).alias("m"))
    centred = rows.join(means, ["fold_id", "asset"])
    spread = F.sum(F.col("alpha") * F.pow(F.col("ret") - F.col("m"), 2))
    return centred.groupBy("fold_id", "asset").agg((spread / F.greatest(1 - F.sum(F.pow("alpha", 2.0)), F.lit(1e-12))).alias("ewma_var"))


def downside(train: DataFrame, folds: DataFrame, half_life: float) -> DataFrame:
    """Raw semi-covariance: the age-weighted products of shortfalls below the age-weighted mean."""
    rows = aged(train, folds, half_life)
    means = rows.groupBy("fold_id", "asset_idx").agg(F.sum(F.col("alpha") * F.col("ret")).alias("m"))
    short = rows.join(means, ["fold_id", "asset_idx"]).withColumn("s", F.least(F.col("ret") - F.col("m"), F.lit(0.0)))
    return pairs(short, "s", "alpha").groupBy("fold_id", "i", "j").agg(F.sum(F.col("alpha_i") * F.col("s_i") * F.col("s_j")).alias("semicov"))


def ledoit_wolf(train: DataFrame) -> DataFrame:
    """Shrinkage towards a multiple of the identity, per fold: (fold_id, mu, delta, beta, shrinkage)."""
    means = train.groupBy("fold_id", "asset_idx").agg(F.avg("ret").alias("m"))
    x = train.join(means, ["fold_id", "asset_idx"]).withColumn("x", F.col("ret") - F.col("m"))
    size = train.groupBy("fold_id").agg(F.count_distinct("row_idx").alias("t"), F.count_distinct("asset_idx").alias("n"))
    product = F.col("x_i") * F.col("x_j")
    both = pairs(x, "x").groupBy("fold_id", "i", "j").agg(F.sum(product).alias("s1"), F.sum(product * product).alias("s2")).join(F.broadcast(size), "fold_id")
    times = F.when(F.col("i") == F.col("j"), 1).otherwise(2)
    s = F.col("s1") / F.col("t")
    sums = both.groupBy("fold_id", "t", "n").agg(F.sum(F.when(F.col("i") == F.col("j"), s)).alias("trace"), F.sum(times * s * s).alias("square"), F.sum(times * F.col("s2")).alias("fourth"))
    mu = F.col("trace") / F.col("n")
    beta = (F.col("fourth") / F.col("t") - F.col("square")) / (F.col("n") * F.col("t"))
    delta = (F.col("square") - 2 * mu * F.col("trace") + F.col("n") * mu * mu) / F.col("n")
    out = sums.select("fold_id", mu.alias("mu"), delta.alias("delta"), F.least(beta, delta).alias("beta"))
    return out.withColumn("shrinkage", F.when(F.col("beta") == 0, 0.0).otherwise(F.try_divide("beta", "delta")))


def noise_edge(rows: F.Column, assets: F.Column) -> F.Column:
    """The upper edge of the spectrum of pure noise."""
    return F.pow(1 + 1 / F.sqrt(rows / assets), 2.0)
