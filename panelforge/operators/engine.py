"""The walk-forward back-test as one operator: folds, allocation, holding, costs, bookkeeping."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..sources.stored import stored
from . import allocation, backtest, books, folds, metrics

KEYS = ("config", "fold_id")


@dataclass(frozen=True)
class Run:
    """What a back-test leaves: paths (config, fold_id, row_idx, gross, turnover, net), one row for each fold, one for each configuration."""

    path: DataFrame
    folds: DataFrame
    summary: DataFrame


def inverse_volatility(x: np.ndarray, params: K.Params) -> K.Outcome:
    """An allocator for Run: weights in proportion to 1/sd."""
    v = 1 / np.std(x, axis=0, ddof=1)
    return K.Outcome(v / v.sum(), "inverse_volatility", eligible=x.shape[1], complete_rows=len(x))


def walk_forward(returns: DataFrame, configs: dict[str, K.Params], lookback: int, step: int, *, start: str | None = None, end: str | None = None, drift: bool = False, cost_bps: float = 0.0, keep_tail: bool = True, allocator: Callable[[np.ndarray, K.Params], K.Outcome] = K.allocate) -> Run:
    """Fit each configuration on the rows before a fold, hold it through the fold, and charge what is traded.

    Rows after `end` are dropped before anything is fitted; `start` moves the first fold but keeps earlier rows for training.
    A fold fails if its allocation fails or breaks the contract, if its wealth reaches zero, or if costs take all capital; the
    fold after it trades from nothing. Allocations are computed once and kept, as path, costs and states all read them.
    """
    if lookback < 2 or step < 1 or cost_bps < 0:
        raise ValueError("impossible lookback, step or cost")
    if end is not None:
        returns = returns.filter(F.col("date") <= F.lit(end).cast("date"))
    table = folds.fold_table(returns, lookback, step, keep_tail, returns.filter(F.col("date") >= F.lit(start).cast("date")) if start is not None else None)
    train, test = folds.fold_rows(returns, table, "train"), folds.fold_rows(returns, table, "test")
    made = stored(allocation.allocations(train, configs, allocator), "allocations")
    shorts = max(p.short for p in configs.values())
    checked = books.contract(made, shorts, KEYS).withColumnRenamed("violation", "broken").drop("equal")
    sound = made.join(checked.filter("broken IS NULL"), list(KEYS), "left_semi")
    path, ends = (backtest.drifting if drift else backtest.rebalanced)(backtest.holdings(test, sound, KEYS), KEYS)
    net = backtest.net_path(path, backtest.rebalance_turnover(sound, ends, KEYS), cost_bps, KEYS)
    net = stored(net, "net-paths")
    held = net.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("rows"), F.sum("turnover").alias("turnover"), F.bool_and(F.col("net").isNotNull()).alias("paid"))
    states = made.groupBy(*KEYS).agg(F.first("status").alias("status"), F.first("degraded").alias("degraded"), F.first("seconds").alias("seconds"), F.first("events").alias("events"))
    told = states.join(checked, list(KEYS)).join(held, list(KEYS), "left")
    told = told.withColumn("ok", F.coalesce(F.col("paid"), F.lit(False))).withColumn("error", F.when(~F.col("ok"), F.coalesce(F.nullif("events", F.lit("")), F.col("broken"), F.lit("capital lost")))).drop("paid", "broken", "events")
    told = stored(told, "fold-states")
    net = net.join(told.filter("ok"), list(KEYS), "left_semi")
    counts = told.filter("ok").groupBy("config", "status").agg(F.count(F.lit(1)).alias("n")).groupBy("config").agg(F.concat_ws(", ", F.array_sort(F.collect_list(F.concat_ws("=", "status", "n")))).alias("statuses"))
    state = told.groupBy("config").agg(
        F.count(F.lit(1)).alias("folds"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.avg((~F.col("ok")).cast("double")).alias("failure_rate"),
        F.avg((F.col("ok") & F.col("degraded")).cast("double")).alias("degradation_rate"),
        F.median("seconds").alias("seconds_median"),
        F.percentile("seconds", 0.95).alias("seconds_p95"),
        F.sum("turnover").alias("turnover"),
    )
    whole = metrics.fold_metrics(net, ["config"], "net")
    numbers = [F.when(F.col("failed") == 0, F.col(c)).alias(c) for c in whole.columns if c != "config"]
    return Run(net, told, state.join(counts, "config", "left").join(whole, "config", "left").select(*state.columns, "statuses", *numbers))
