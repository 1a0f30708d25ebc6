"""Walk-forward folds and the rows that belong to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_fold() -> WindowSpec:
    return Window.partitionBy("fold_id")


def fold_table(returns: DataFrame, lookback: int, step: int, keep_tail: bool = False, since: DataFrame | None = None) -> DataFrame:
    """Rows (fold_id, train_lo, train_hi, test_lo, test_hi), ends exclusive; a short last fold only if asked for.

    since: rows from the first of which on folds are tested, if they leave enough rows before them.
    """
    rows = returns.agg((F.max("row_idx") + 1).cast("int").alias("rows"))
    first = F.lit(lookback)
    if since is not None:
        rows = rows.crossJoin(since.agg(F.min("row_idx").cast("int").alias("since")))  # one row each
        first = F.greatest(first, F.col("since"))
    last = F.col("rows") - (1 if keep_tail else step)
    starts = F.when(last >= first, F.sequence(first, last, F.lit(step))).otherwise(F.array().cast("array<int>"))
    at = rows.select("rows", F.posexplode(starts).alias("fold_id", "test_lo"))
    return at.select("fold_id", (F.col("test_lo") - lookback).alias("train_lo"), F.col("test_lo").alias("train_hi"), "test_lo", F.least(F.col("test_lo") + step, "rows").alias("test_hi"))


def fold_rows(returns: DataFrame, folds: DataFrame, part: str) -> DataFrame:
    """returns with the fold that uses them for "train" or "test": folds are unrolled to rows, so the join is on equality."""
    unrolled = folds.select("fold_id", F.explode(F.sequence(F.col(f"{part}_lo"), F.col(f"{part}_hi") - 1)).alias("row_idx"))
    return returns.join(F.broadcast(unrolled), "row_idx")


def random_windows(returns: DataFrame, draws: DataFrame, length: int) -> DataFrame:
    """Draws (draw, asset_idx, start) joined to the rows of their windows."""
    wide = draws.withColumn("row_idx", F.explode(F.sequence(F.col("start"), F.col("start") + length - 1)))
    return returns.join(F.broadcast(wide), ["row_idx", "asset_idx"])
