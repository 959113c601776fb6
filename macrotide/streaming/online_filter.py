"""The causal regime filter as a stateful stream: one forward step per arriving row."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.hmm import Params, _log, _lse, log_emissions

OUTPUT = "entity string, date timestamp, filtered array<double>"
STATE = "log_alpha array<double>, last timestamp"


def online_filter(rows: DataFrame, columns: list[str], params: Params) -> DataFrame:
    """(entity, date, filtered) for a stream of (entity, date, features); rows not after an entity's last one are dropped."""
    pi, a, means, covars = params.arrays()

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        alpha, last = (np.array(state.get[0]), state.get[1]) if state.exists else (None, None)
        pdf = pd.concat(list(frames)).dropna(subset=columns).sort_values("date").drop_duplicates("date")
        if last is not None:
            pdf = pdf[pdf["date"] > pd.Timestamp(last)]
        out = []
        for b in log_emissions(pdf[columns].to_numpy(float), means, covars) if len(pdf) else []:
            alpha = b + (_log(pi) if alpha is None else _lse(alpha[:, None] + _log(a), 0))
            alpha = alpha - _lse(alpha, 0)
            out.append(np.exp(alpha))
        if len(pdf):
            state.update((alpha.tolist(), pdf["date"].iloc[-1].to_pydatetime()))
            yield pd.DataFrame({"entity": key[0], "date": pdf["date"], "filtered": out})

    assert math.isclose(sum(pi), 1, abs_tol=1e-6)
    return rows.groupBy("entity").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
