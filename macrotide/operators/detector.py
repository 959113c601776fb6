"""Regime detectors: fit, predict and inspect one model over feature tables."""

from __future__ import annotations

from abc import ABC, abstractmethod

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import io
from . import hmm, inference
from .hmm import Params


class RegimeDetector(ABC):
    """What every detector does. Tables are wide: a date and a column per feature."""

    def __init__(self, features: list[str], n_regimes: int = 4, **params):
        if n_regimes < 1:
            raise ValueError("n_regimes must be 1 or more")
        self.features, self.n_regimes, self.params = list(features), n_regimes, params

    @property
    @abstractmethod
    def is_fitted(self) -> bool: ...

    @abstractmethod
    def fit(self, wide: DataFrame) -> RegimeDetector: ...

    @abstractmethod
    def predict(self, wide: DataFrame) -> DataFrame:
        """(date, regime)."""

    @abstractmethod
    def save(self, path: str) -> None: ...

    def fit_predict(self, wide: DataFrame) -> DataFrame:
        return self.fit(wide).predict(wide)

    def get_params(self) -> dict:
        return {"is_fitted": self.is_fitted, "features": self.features, "n_regimes": self.n_regimes, **self.params}

    def __repr__(self) -> str:
        return f"{type(self).__name__}({', '.join(f'{k}={v!r}' for k, v in self.get_params().items())})"


class HmmDetector(RegimeDetector):
    """A Gaussian hidden-Markov model. It is fitted in one task, like a model of a grid; what it infers is scanned over many.

    Features are used as they are; ``regimes.standard_scale`` scales them. Rows with a missing feature are left out.
    """

    def __init__(self, features: list[str], n_regimes: int = 4, covariance_type: str = "full", p_stay: float = 0.95, n_iter: int = 1000, model: Params | None = None):
        if covariance_type not in ("full", "diag"):
            raise ValueError(f"covariance_type must be full or diag, not {covariance_type!r}")
        super().__init__(features, n_regimes, covariance_type=covariance_type, p_stay=p_stay, n_iter=n_iter)
        self.model = model

    @property
    def is_fitted(self) -> bool:
        return self.model is not None

    def fit(self, wide: DataFrame) -> HmmDetector:
        kind, stay, rounds = (self.params[k] for k in ("covariance_type", "p_stay", "n_iter"))
        self.model = hmm.fit_rows(wide, self.features, self.n_regimes, kind, stay, rounds)
        return self

    def _seen(self, wide: DataFrame) -> tuple[DataFrame, Params]:
        if self.model is None:
            raise ValueError("the model is not fitted")
        return inference.observed(wide, self.features, self.model), self.model

    def predict(self, wide: DataFrame) -> DataFrame:
        return inference.best_path(*self._seen(wide)).select("date", F.col("state").alias("regime"))

    def smooth_proba(self, wide: DataFrame) -> DataFrame:
        """(date, proba) given all rows."""
        return inference.smooth(*self._seen(wide)).select("date", F.col("smoothed").alias("proba"))

    def filter_proba(self, wide: DataFrame) -> DataFrame:
        """(date, proba) given the rows so far."""
        return inference.filtered(*self._seen(wide)).select("date", F.col("filtered").alias("proba"))

    def forecast(self, wide: DataFrame, steps: int) -> DataFrame:
        """(date, proba) ``steps`` rows after each one."""
        return inference.forecast(*self._seen(wide), steps).select("date", F.col("forecast").alias("proba"))

    def score(self, wide: DataFrame) -> float:
        """The log-likelihood of the rows; 0 if there are none."""
        row = inference.score(*self._seen(wide)).first()
        return row["log_likelihood"] if row else 0.0

    def transition_matrix(self) -> np.ndarray:
        return self._seen_model().arrays()[1]

    def means(self) -> np.ndarray:
        return self._seen_model().arrays()[2]

    def covariances(self) -> np.ndarray:
        return self._seen_model().arrays()[3]

    def _seen_model(self) -> Params:
        if self.model is None:
            raise ValueError("the model is not fitted")
        return self.model

    def save(self, path: str) -> None:
        io.save_model(self.model, path)

    @classmethod
    def load(cls, path: str, features: list[str]) -> HmmDetector:
        model = io.load_model(path)
        return cls(features, len(model.startprob), model=model)
