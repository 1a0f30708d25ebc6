"""Holding returns, turnover, costs and paths, in closed form over windows: no loop over days.

With drifting weights an asset's share of a fold's wealth is its start weight times its cumulative growth, so wealth, gross
returns and end weights follow from one running product per fold and asset. With weights reset daily the drifted weights
of a day follow from that day's returns alone. A fold whose wealth reaches zero has failed and has no path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


FOLD = ("fold_id",)


def holdings(test: DataFrame, book: DataFrame, by: tuple[str, ...] = FOLD) -> DataFrame:
    """test rows (fold_id, row_idx, asset, ret) with the weight w of the book; by: the keys of a path, here and below."""
    return test.join(book.select(*by, "asset", "w"), ["fold_id", "asset"])


def drifting(held: DataFrame, by: tuple[str, ...] = FOLD) -> tuple[DataFrame, DataFrame]:
    """Path (fold_id, row_idx, gross, turnover) and end weights (fold_id, asset, w_end) without trades inside a fold."""
    run = Window.partitionBy(*by, "asset").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, 0)
    grown = held.withColumn("share", F.col("w") * F.product(1 + F.col("ret")).over(run))
    wealth = grown.groupBy(*by, "row_idx").agg(F.sum("share").alias("wealth"))
    before = F.lag("wealth", 1, 1.0).over(Window.partitionBy(*by).orderBy("row_idx"))
    path = wealth.withColumn("before", before).withColumn("alive", F.min("wealth").over(Window.partitionBy(*by)) > 0)
    path = path.filter("alive").select(*by, "row_idx", (F.try_divide("wealth", "before") - 1).alias("gross"), F.lit(0.0).alias("turnover"))
    last = grown.groupBy(*by).agg(F.max("row_idx").alias("row_idx"))
    at_end = grown.join(last, [*by, "row_idx"])
    ends = at_end.select(*by, "asset", F.try_divide(F.col("share"), F.sum("share").over(Window.partitionBy(*by))).alias("w_end"))
    return path, ends


def rebalanced(held: DataFrame, by: tuple[str, ...] = FOLD) -> tuple[DataFrame, DataFrame]:
    """The same with weights reset to the target before each row after the first; what that trades is the row's turnover."""
    day = Window.partitionBy(*by, "row_idx")
    moved = held.withColumn("gross", F.sum(F.col("w") * F.col("ret")).over(day)).withColumn("drifted", F.try_divide(F.col("w") * (1 + F.col("ret")), 1 + F.col("gross")))
    before = F.lag("drifted").over(Window.partitionBy(*by, "asset").orderBy("row_idx"))
    traded = moved.withColumn("trade", F.abs(F.col("w") - before)).groupBy(*by, "row_idx").agg(F.first("gross").alias("gross"), F.coalesce(F.sum("trade"), F.lit(0.0)).alias("turnover"))
    alive = F.min(1 + F.col("gross")).over(Window.partitionBy(*by)) > 0
    path = traded.withColumn("alive", alive).filter("alive").select(*by, "row_idx", "gross", "turnover")
    last = held.groupBy(*by).agg(F.max("row_idx").alias("row_idx"))
    ends = moved.join(last, [*by, "row_idx"]).select(*by, "asset", F.col("drifted").alias("w_end"))
    return path, ends


def rebalance_turnover(book: DataFrame, ends: DataFrame, by: tuple[str, ...] = FOLD) -> DataFrame:
    """Rows (fold_id, trade): what is traded into a fold, from the end weights of the fold before (from nothing if it failed)."""
    before = ends.withColumn("fold_id", F.col("fold_id") + 1).select(*by, "asset", "w_end")
    both = book.join(before, [*by, "asset"], "left")
    return both.groupBy(*by).agg(F.sum(F.abs(F.col("w") - F.coalesce("w_end", F.lit(0.0)))).alias("trade"))


def net_path(path: DataFrame, trades: DataFrame, cost_bps: float, by: tuple[str, ...] = FOLD) -> DataFrame:
    """Rows (fold_id, row_idx, gross, turnover, net): costs are taken off capital before the row's return."""
    first = F.row_number().over(Window.partitionBy(*by).orderBy("row_idx")) == 1
    whole = path.join(trades, list(by)).withColumn("turnover", F.col("turnover") + F.when(first, F.col("trade")).otherwise(0.0))
    cost = F.col("turnover") * (cost_bps / 10000.0)
    return whole.select(*by, "row_idx", "gross", "turnover", F.when(cost < 1, (1 - cost) * (1 + F.col("gross")) - 1).alias("net"))


def bookkeeping(folds: DataFrame, path: DataFrame, statuses: DataFrame | None = None) -> DataFrame:
    """One row: folds, failed ones, the failure rate, and how often each status occurred."""
    done = folds.join(path.select("fold_id").distinct().withColumn("ok", F.lit(1)), "fold_id", "left")
    out = done.agg(F.count(F.lit(1)).alias("folds"), F.count_if(F.col("ok").isNull()).alias("failed"), F.avg(F.col("ok").isNull().cast("double")).alias("failure_rate"))
    if statuses is None:
        return out
    counted = statuses.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return out.crossJoin(counted.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("statuses")))
