"""Whether drawn books keep the rules of the game: codes, counts, and the worst slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE = 1e-6


def codes(drawn: DataFrame, weights: DataFrame, short: float = 0.0) -> DataFrame:
    """Rows (draw, code): the first rule that a draw's weights break, "ok" if none.

    drawn: (draw, n), the draws and how many assets each has; weights: (draw, asset, w). A draw without weights is
    "no_weights", one with another number of them "shape".
    """
    w = F.col("w")
    size = F.count(F.lit(1)).over(Window.partitionBy("draw"))
    bad = w.isNull() | F.isnan(w) | (F.abs(w) == float("inf"))
    equal = F.bool_and(F.abs(w - 1 / F.col("size")) <= 1e-8 + 1e-5 / F.col("size"))
    sums = weights.withColumn("size", size).groupBy("draw").agg(F.first("size").alias("size"), F.bool_or(bad).alias("holes"), F.min("w").alias("low"), F.sum("w").alias("net"), F.sum(F.abs(w)).alias("gross"), equal.alias("equal"))
    told = drawn.join(sums, "draw", "left")
    code = (
        F.when(F.col("size").isNull(), "no_weights")
        .when(F.col("size") != F.col("n"), "shape")
        .when(F.col("holes"), "nonfinite")
        .when(F.col("low") < -short - TOLERANCE, "below_short_budget")
        .when(F.abs(F.col("net") - 1) > TOLERANCE, "not_fully_invested")
        .when(F.col("gross") > 1 + 2 * short * F.col("n") + TOLERANCE, "gross_exposure_over_short_budget")
        .when(F.col("equal") & (F.col("n") > 1), "equal_weight")
        .otherwise("ok")
    )
    return told.select("draw", code.alias("code"))


def worst(counts: DataFrame, many: int = 5) -> DataFrame:
    """The slices (slice, failed, illegal, equal) with the most failures, then illegal, then equal books."""
    return counts.orderBy(F.desc("failed"), F.desc("illegal"), F.desc("equal"), "slice").limit(many)
