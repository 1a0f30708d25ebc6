"""Euclidean projections of long vectors (group, asset, v) as windows over the sorted values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def water_level(vectors: DataFrame, target: Column | float, by: str = "fold_id", value: str = "v") -> DataFrame:
    """Per group the level t with sum(max(v - t, 0)) = target."""
    target = target if isinstance(target, Column) else F.lit(float(target))
    down = Window.partitionBy(by).orderBy(F.desc(value), "asset")
    ranked = vectors.select(by, F.col(value).alias("u"), F.row_number().over(down).alias("k"), F.sum(value).over(down.rowsBetween(Window.unboundedPreceding, 0)).alias("total"), target.alias("target"))
    level = (F.col("total") - F.col("target")) / F.col("k")
    return ranked.filter(F.col("u") > level).groupBy(by).agg(F.max_by(level, "k").alias("level"))


def simplex(vectors: DataFrame, by: str = "fold_id") -> DataFrame:
    """Onto {w >= 0, sum 1}."""
    return vectors.join(water_level(vectors, 1.0, by), by).withColumn("w", F.greatest(F.col("v") - F.col("level"), F.lit(0.0))).drop("level")


def box_simplex(vectors: DataFrame, floor: float, by: str = "fold_id") -> DataFrame:
    """Onto {w >= -floor, sum 1}."""
    size = vectors.groupBy(by).agg((1 + F.count(F.lit(1)) * floor).alias("budget"))
    moved = vectors.join(F.broadcast(size), by).withColumn("s", F.col("v") + floor)
    level = water_level(moved, F.col("budget"), by, "s")
    return moved.join(level, by).withColumn("w", F.greatest(F.col("s") - F.col("level"), F.lit(0.0)) - floor).drop("s", "level", "budget")


def gross_budget(vectors: DataFrame, short: float, by: str = "fold_id") -> DataFrame:
    """Onto {sum 1, sum of negative parts <= short}: a shift if that suffices, else one fill from above and one from below."""
    size = vectors.groupBy(by).agg(((1 - F.sum("v")) / F.count(F.lit(1))).alias("shift"))
    moved = vectors.join(F.broadcast(size), by)
    need = moved.groupBy(by).agg(F.sum(F.greatest(-(F.col("v") + F.col("shift")), F.lit(0.0))).alias("short_needed"))
    long = water_level(vectors, 1.0 + short, by).withColumnRenamed("level", "a")
    under = water_level(vectors.withColumn("m", -F.col("v")), short, by, "m").withColumnRenamed("level", "b") if short > 0 else None
    out = moved.join(need, by).join(long, by)
    below = F.lit(0.0)
    if under is not None:
        out = out.join(under, by)
        below = F.greatest(-F.col("v") - F.col("b"), F.lit(0.0))
    filled = F.greatest(F.col("v") - F.col("a"), F.lit(0.0)) - below
    return out.withColumn("w", F.when(F.col("short_needed") <= short + 1e-9, F.col("v") + F.col("shift")).otherwise(filled)).drop("a", "b", "shift", "short_needed")
