"""Composite signals of training windows, as window aggregates: z-scores across a fold's assets, averaged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scored(x: Column) -> Column:
    """x in deviations across the assets of a fold; 0 with fewer than three values or none that differ."""
    by = Window.partitionBy("fold_id")
    sd = F.stddev_samp(x).over(by)
    return F.when((F.count(x).over(by) >= 3) & (sd > 1e-14), F.coalesce(F.try_divide(x - F.avg(x).over(by), sd), F.lit(0.0))).otherwise(0.0)


def composite(train: DataFrame, kind: str) -> DataFrame:
    """Rows (fold_id, asset, asset_idx, signal) of complete windows of 60 rows and three assets or more.

    "volatility": deviations of the last 20 and 60 rows, of both halves, mean size of the last 20, and the ratio of the first
    two. "stable": correlation with the mean of all assets, the same of sizes, kurtosis of the last 60, deviation of 20-row
    deviations, and momentum over 231 rows to 21 back where the window is that long. The signal's mean is taken off.
    """
    by = Window.partitionBy("fold_id", "asset").orderBy("row_idx")
    rows = train.select("fold_id", "asset", "asset_idx", "row_idx", "ret").withColumn("k", F.row_number().over(by)).withColumn("t", F.count(F.lit(1)).over(Window.partitionBy("fold_id", "asset")))
    rows = rows.withColumn("back", F.col("t") - F.col("k")).filter("t >= 60")

    def sd(when: Column) -> Column:
        return F.stddev_samp(F.when(when, F.col("ret")))

    if kind == "volatility":
        early = F.col("k") <= F.greatest(F.lit(1), F.floor(F.col("t") / 2))
        late = F.col("k") > F.floor(F.col("t") / 2)
        one = rows.groupBy("fold_id", "asset", "asset_idx").agg(sd(F.col("back") < 20).alias("a"), sd(F.col("back") < 60).alias("b"), sd(early).alias("c"), sd(late).alias("d"), F.avg(F.when(F.col("back") < 20, F.abs("ret"))).alias("e"))
        one = one.withColumn("f", F.when(F.col("b") > 0, F.try_divide("a", "b")))
        parts = ["a", "b", "c", "d", "e", "f"]
    elif kind == "stable":
        rows = rows.withColumn("mkt", F.avg("ret").over(Window.partitionBy("fold_id", "row_idx")))
        rows = rows.withColumn("sd20", F.when(F.col("k") >= 20, F.stddev_samp("ret").over(by.rowsBetween(-19, 0))))
        rows = rows.withColumn("path", F.product(1 + F.col("ret")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
        tail = Window.partitionBy("fold_id", "asset")
        last = F.when(F.col("back") < 60, F.col("ret"))
        rows = rows.withColumn("z", (last - F.avg(last).over(tail)) / F.nullif(F.stddev_samp(last).over(tail), F.lit(0.0)))

        def together(x: Column, y: Column) -> Column:
            return F.try_divide(F.covar_samp(x, y), F.nullif(F.stddev_samp(x) * F.stddev_samp(y), F.lit(0.0)))

        at = lambda back: F.max(F.when(F.col("back") == back, F.col("path")))
        moved = F.when(F.first("t") >= 232, F.try_divide(at(20), at(230)) - 1)
        one = rows.groupBy("fold_id", "asset", "asset_idx").agg(together(F.col("ret"), F.col("mkt")).alias("a"), together(F.abs("ret"), F.abs("mkt")).alias("b"), (F.avg(F.pow("z", 4)) - 3).alias("c"), F.stddev_samp("sd20").alias("d"), moved.alias("e"), F.first("t").alias("t"))
        parts = ["a", "b", "c", "d", "e"]
    else:
        raise ValueError(f"unknown signal {kind}")
    whole = one.withColumn("assets", F.count(F.lit(1)).over(Window.partitionBy("fold_id"))).filter("assets >= 3")
    total = sum((scored(F.col(p)) for p in parts), F.lit(0.0))
    many = F.when(F.col("t") >= 232, 5).otherwise(4) if kind == "stable" else F.lit(len(parts))
    mean = whole.withColumn("signal", total / many)
    return mean.select("fold_id", "asset", "asset_idx", (F.col("signal") - F.avg("signal").over(Window.partitionBy("fold_id"))).alias("signal"))
