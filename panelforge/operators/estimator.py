"""An estimator in the customary form: fit(X) leaves weights_; missing and infinite values are allowed in X."""

from __future__ import annotations

import numpy as np

from ..functions import kernels as K


class PanelAllocator:
    """K.allocate() as an estimator. The constructor only keeps its arguments; they are checked by fit()."""

    def __init__(self, lookback: int = 40, half_life: float = 10.0, recent_mix: float = 0.25, penalty: float = 1.0, method: str = "regularized", gross_budget: float = 1.0, downside_mix: float = 0.0):
        self.lookback = lookback
        self.half_life = half_life
        self.recent_mix = recent_mix
        self.penalty = penalty
        self.method = method
        self.gross_budget = gross_budget
        self.downside_mix = downside_mix

    def get_params(self, deep: bool = True) -> dict:
        return dict(self.__dict__) if not hasattr(self, "weights_") else {k: v for k, v in self.__dict__.items() if not k.endswith("_")}

    def set_params(self, **params) -> PanelAllocator:
        for k, v in params.items():
            if k not in self.get_params():
                raise ValueError(f"unknown parameter {k}")
            setattr(self, k, v)
        return self

    def fit(self, X, y=None) -> PanelAllocator:  # noqa: N803
        """X: rows in time order, a column for each asset: an array, a pandas frame, or a wide Spark frame whose first column orders it."""
        names = None
        if hasattr(X, "toPandas"):  # a window of rows: collected, as one fit is dense algebra
            order, *assets = X.columns
            X = X.orderBy(order).select(*assets).toPandas()
        if hasattr(X, "to_numpy"):
            names, X = np.array(X.columns, object), X.to_numpy(float, na_value=np.nan) if hasattr(X, "dtypes") else X.to_numpy(float)
        x = np.asarray(X, float)
        found = K.allocate(x, K.Params(**self.get_params()))
        self.n_features_in_ = x.shape[1]
        if names is not None:
            self.feature_names_in_ = names
        self.weights_ = found.w
        self.status_ = found.status
        self.outcome_ = found
        return self

    def predict(self, X) -> np.ndarray:  # noqa: N803
        """The returns of the fitted weights, reset at every row."""
        x = X.to_numpy(float) if hasattr(X, "to_numpy") else np.asarray(X, float)
        return x @ self.weights_
