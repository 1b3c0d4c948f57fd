"""Running diagnostics of a stream: per key the mean of the last values and the best so far, kept in state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What a key's state is: how many values it has had, the last ones in order, and the largest.
STATE = "n long, ring array<double>, best double"


def running(rows: DataFrame, key: str, order: list[str], value: str, size: int = 50) -> DataFrame:
    """key, the columns of ``order``, n (values of the key so far), mean (of its last ``size`` values) and best (its largest so far).

    rows: a stream. Each micro-batch is taken in the order of ``order`` and follows what came in earlier ones, so results
    are those of one pass as long as no row comes in a later batch than rows behind it. A key's state is ``size`` values
    whatever the stream's length, and a restart from the checkpoint goes on from it. Rows without a key or value are left out.
    """
    kept = rows.where(f"`{key}` IS NOT NULL AND `{value}` IS NOT NULL").select(key, *order, value)
    schema = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in (key, *order))

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, ring, best = state.get if state.exists else (0, [], -np.inf)
        new = pd.concat(list(batches)).sort_values(order)
        values = np.concatenate([np.asarray(ring, float), new[value].to_numpy(float)])
        end = np.arange(len(ring), len(values)) + 1
        sums = np.append(0.0, np.cumsum(values))
        first = np.maximum(end - size, 0)
        out = new[[key, *order]].copy()
        out["n"] = n + np.arange(1, len(new) + 1)
        out["mean"] = (sums[end] - sums[first]) / (end - first)
        out["best"] = np.maximum(best, np.maximum.accumulate(new[value].to_numpy(float)))
        state.update((int(n + len(new)), values[-size:].tolist(), float(out["best"].iloc[-1])))
        yield out

    return kept.groupBy(key).applyInPandasWithState(step, f"{schema}, n long, mean double, best double", STATE, "append", GroupStateTimeout.NoTimeout)
