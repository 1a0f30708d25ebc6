"""Allocation of many folds and configurations at once: one grouped-map call per fold and slice of configurations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict
from time import perf_counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels as K

SCHEMA = "config string, fold_id int, asset string, asset_idx int, w double, status string, rule string, degraded boolean, gap double, iterations int, eligible int, complete_rows int, l1_equal double, l1_ivp double, l1_gmvp_model double, l1_erc_sample double, events string, seconds double"
#: Configurations solved in one task: a window's rows are copied once for so many.
SLICE = 16


def config_table(spark: SparkSession, configs: dict[str, K.Params]) -> DataFrame:
    """Configurations as rows; a grid of any size is small beside the folds."""
    return spark.createDataFrame([(name, *(str(v) for v in asdict(p).values())) for name, p in configs.items()], "config string, " + ", ".join(f"{k} string" for k in asdict(next(iter(configs.values())))))


def matrix(rows: pd.DataFrame) -> tuple[np.ndarray, pd.DataFrame]:
    """A group's rows as a matrix in time and asset order, whatever order they came in."""
    rows = rows.sort_values(["row_idx", "asset_idx"], kind="stable")
    wide = rows.pivot_table(index="row_idx", columns="asset_idx", values="ret", dropna=False, aggfunc="last")
    names = rows.drop_duplicates("asset_idx").set_index("asset_idx")["asset"]
    return wide.to_numpy(float), pd.DataFrame({"asset_idx": wide.columns, "asset": names.loc[wide.columns].to_numpy()})


def allocations(train: DataFrame, configs: dict[str, K.Params], allocator: Callable[[np.ndarray, K.Params], K.Outcome] = K.allocate) -> DataFrame:
    """Weights and diagnostics of every configuration in every fold of train (fold_id, row_idx, asset, asset_idx, ret).

    A group is one fold's window under SLICE configurations, so its size is lookback x assets. A kernel that raises becomes
    a row set with status "failed": nothing is lost and the rest of the job goes on.
    """
    named = list(configs.items())
    columns = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        fold, part = key
        x, assets = matrix(rows)
        made = []
        for config, params in named[part * SLICE : (part + 1) * SLICE]:
            began = perf_counter()
            try:
                o = allocator(x, params)
            except Exception as trouble:  # an injected allocator may raise anything; the fold is marked, not lost
                o = K.Outcome(np.full(len(assets), np.nan), "failed", events=[f"{type(trouble).__name__}: {trouble}"])
            out = assets.assign(config=config, fold_id=fold, w=o.w, status=o.status, rule=o.rule, degraded=o.degraded, gap=np.nan if o.gap is None else o.gap, iterations=pd.array([o.iterations] * len(assets), "Int32"), eligible=o.eligible, complete_rows=o.complete_rows)
            for k in ("equal", "ivp", "gmvp_model", "erc_sample"):
                out[f"l1_{k}"] = o.l1.get(k, np.nan)
            out["events"], out["seconds"] = "; ".join(o.events), perf_counter() - began
            made.append(out[columns])
        return pd.concat(made)

    wide = train.select("fold_id", "row_idx", "asset", "asset_idx", "ret", F.explode(F.sequence(F.lit(0), F.lit((len(named) - 1) // SLICE))).alias("part"))
    return wide.groupBy("fold_id", "part").applyInPandas(run, SCHEMA)


def kernel_books(train: DataFrame, book: str) -> DataFrame:
    """Sample books that need dense algebra: "risk_parity", "minimum_variance", "hierarchical", "max_diversification",
    "shrunk_minimum_variance", "denoised_minimum_variance", "nested_clusters", "random".

    Rows (fold_id, asset, asset_idx, w, defined): not defined, with null weights, where the sample covariance isn't of full rank.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x, assets = matrix(rows)
        w = np.full(x.shape[1], np.nan)
        ranked = len(x) > x.shape[1] and np.linalg.matrix_rank(np.cov(x, rowvar=False)) >= x.shape[1]
        try:
            if book == "random":
                w = np.random.default_rng(int(key[0])).dirichlet(np.ones(x.shape[1]))
            elif ranked:
                c = np.cov(x, rowvar=False)
                if book == "risk_parity":
                    w = K.risk_parity(c)
                elif book == "minimum_variance":
                    s = K.minimum_variance(c)
                    w = s.w if s.gap <= 1e-6 else w
                elif book == "hierarchical":
                    w = K.tree_weights(c)
                elif book == "shrunk_minimum_variance":
                    w = K.minimum_variance(K.shrunk(x)[0]).w
                elif book == "denoised_minimum_variance":
                    sd = np.sqrt(np.diag(c))
                    w = K.minimum_variance(K.denoised(c / np.outer(sd, sd), len(x)) * np.outer(sd, sd)).w
                elif book == "nested_clusters":
                    w = K.nested_clusters(c)
                elif book == "max_diversification":
                    sd = np.sqrt(np.diag(c))
                    s = K.minimum_variance(c / np.outer(sd, sd))
                    w = K.reconciled(s.w / sd / (s.w / sd).sum())
                else:
                    raise ValueError(f"unknown book {book}")
        except ArithmeticError:
            pass
        return assets.assign(fold_id=key[0], w=w, defined=bool(np.isfinite(w).all()))[["fold_id", "asset", "asset_idx", "w", "defined"]]

    return train.select("fold_id", "row_idx", "asset", "asset_idx", "ret").groupBy("fold_id").applyInPandas(run, "fold_id int, asset string, asset_idx int, w double, defined boolean")


def anchored_books(train: DataFrame, penalty: float, tilt: DataFrame | None = None) -> DataFrame:
    """Rows (fold_id, asset, asset_idx, w, objective, certified): least relative objective on the sample covariance, the inverse-volatility book as anchor.

    tilt: (fold_id, asset, tilt), a slope that is added to the objective; a book that can't be certified is the anchor, and
    the inverse-risk book where there is no anchor.
    """

    tilted = tilt is not None

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x, assets = matrix(rows)
        c = np.atleast_2d(np.cov(x, rowvar=False))
        sd = np.sqrt(np.maximum(np.diag(c), 1e-12))
        w, objective, certified = (1 / sd) / (1 / sd).sum(), None, False
        try:
            found = K.solve(c, w, penalty, tilt=None if not tilted else rows.drop_duplicates("asset_idx").sort_values("asset_idx")["tilt"].to_numpy(float))
            if found.converged:
                w, objective, certified = found.w, found.objective, True
        except (ValueError, ArithmeticError):
            pass
        return assets.assign(fold_id=key[0], w=w, objective=objective, certified=certified)[["fold_id", "asset", "asset_idx", "w", "objective", "certified"]]

    rows = train.select("fold_id", "row_idx", "asset", "asset_idx", "ret")
    if tilt is not None:
        rows = rows.join(tilt.select("fold_id", "asset", "tilt"), ["fold_id", "asset"])
    return rows.groupBy("fold_id").applyInPandas(run, "fold_id int, asset string, asset_idx int, w double, objective double, certified boolean")


def linkage(train: DataFrame) -> DataFrame:
    """Rows (fold_id, step, height, size): merges of the single-linkage tree on correlation distance."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x, _ = matrix(rows)
        merges = K.single_linkage(K.correlation_distance(np.cov(x, rowvar=False)))
        return pd.DataFrame({"fold_id": key[0], "step": range(len(merges)), "height": [m[2] for m in merges], "size": [m[3] for m in merges]})

    return train.select("fold_id", "row_idx", "asset", "asset_idx", "ret").groupBy("fold_id").applyInPandas(run, "fold_id int, step int, height double, size int")


def two_speed_covariances(train: DataFrame, half_life: float, recent_mix: float) -> DataFrame:
    """Rows (fold_id, i, j, c) of the blended covariance of each window, in units of its median variance."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x, assets = matrix(rows)
        c = K.two_speed(x, half_life, recent_mix)
        i, j = np.triu_indices(len(c))
        idx = assets["asset_idx"].to_numpy()
        return pd.DataFrame({"fold_id": key[0], "i": idx[i], "j": idx[j], "c": c[i, j]})

    return train.select("fold_id", "row_idx", "asset", "asset_idx", "ret").groupBy("fold_id").applyInPandas(run, "fold_id int, i int, j int, c double")


def denoised_correlations(train: DataFrame) -> DataFrame:
    """Rows (fold_id, i, j, corr, denoised) of each fold's sample correlation and what is left of it without noise."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x, assets = matrix(rows)
        c = np.atleast_2d(np.corrcoef(x, rowvar=False))
        d = K.denoised(c, len(x))
        i, j = np.triu_indices(len(c))
        idx = assets["asset_idx"].to_numpy()
        return pd.DataFrame({"fold_id": key[0], "i": idx[i], "j": idx[j], "corr": c[i, j], "denoised": d[i, j]})

    return train.select("fold_id", "row_idx", "asset", "asset_idx", "ret").groupBy("fold_id").applyInPandas(run, "fold_id int, i int, j int, corr double, denoised double")
