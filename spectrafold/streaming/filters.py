"""Stateful filters, one state for each series: the same steps in batch and on Structured Streaming.

Rows of a series count in order. On a stream they do so within a micro-batch, and batches in turn: what comes late belongs to its
batch. A row whose `reset` is true begins anew. A null x passes as null and leaves the state; an empty table gives an empty one.
A factor above 1 is a half-life in rows.
"""

from collections.abc import Callable, Iterator
from math import ceil, exp, log, sqrt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Step = Callable[[list[float], float], tuple[list[float], float]]


def _decay(alpha: float) -> float:
    return exp(log(0.5) / alpha) if alpha > 1 else alpha


def bias(alpha: float) -> Step:
    """x less its exponential average: N = a N + 1 - a, s = a s + (1 - a) x, x - s / N."""
    a = _decay(alpha)

    def step(state: list[float], x: float) -> tuple[list[float], float]:
        n, s = state or [0.0, 0.0]
        n, s = a * n + 1 - a, a * s + (1 - a) * x
        return [n, s], x - s / n

    return step


def standard(alpha: float) -> Step:
    """x less its exponential mean, by its exponential spread, once the weight is above 0.75; before, x as it is."""
    a = _decay(alpha)

    def step(state: list[float], x: float) -> tuple[list[float], float]:
        n, s, q = state or [0.0, 0.0, 0.0]
        n, s, q = a * n + 1 - a, a * s + (1 - a) * x, a * q + (1 - a) * x * x
        spread = sqrt(abs((q - s * s / n) / n))
        return [n, s, q], (x - s / n) / (spread if spread >= 2.0**-52 else 1.0) if n > 0.75 else x

    return step


def relative(alpha: float) -> Step:
    """x by the root of its exponential mean square; 0 as long as that is 0."""
    a = _decay(alpha)

    def step(state: list[float], x: float) -> tuple[list[float], float]:
        n, q = state or [0.0, 0.0]
        n, q = a * n + 1 - a, a * q + (1 - a) * x * x
        return [n, q], x / sqrt(q / n) if q else 0.0

    return step


def robust_bias(alpha: float, reach: float = 1.0) -> Step:
    """x less a running median: the mean of x within the reach until half the weight is there, then steps of 1 - a towards x."""
    a = _decay(alpha)

    def step(state: list[float], x: float) -> tuple[list[float], float]:
        n, s, warm = state or [0.0, 0.0, 1.0]
        n = a * n + 1 - a
        if n < 0.5 and warm:
            s = a * s + (1 - a) * min(reach, max(x, -reach))
            return [n, s, 1.0], x - s / n
        if warm:
            # The sum so far, by its weight, is where the median starts.
            before = (n - 1 + a) / a
            s = s / before if before else 0.0
        s += (1 - a) * ((x > s) - (x < s))
        return [n, s, 0.0], x - s

    return step


def percentile(length: int, share: float = 0.5) -> Step:
    """x less the ceil(share * n)-th smallest of the last n values, n being length at most."""

    def step(state: list[float], x: float) -> tuple[list[float], float]:
        state = [*state, x][-length:]
        return state, x - sorted(state)[max(1, ceil(share * len(state))) - 1]

    return step


def _run(step: Step, state: list[float], xs: list, resets: list) -> tuple[list[float], list]:
    out = []
    for x, reset in zip(xs, resets):
        if reset:
            state = []
        if x is None or x != x:
            out.append(None)
        else:
            state, y = step(state, float(x))
            out.append(y)
    return state, out


def filtered(rows: DataFrame, key: str, order: str, step: Step, reset: str | None = None) -> DataFrame:
    """key, order, x of a table or a stream, filtered. One task holds one series, or what a micro-batch has of it."""
    plain = rows.select(key, order, F.col("x").cast("double").alias("x"), (F.col(reset) if reset else F.lit(False)).alias("_reset"))
    out = plain.drop("_reset").schema

    def one(rows: pd.DataFrame, state: list[float]) -> tuple[list[float], pd.DataFrame]:
        rows = rows.sort_values(order, kind="stable")
        state, x = _run(step, state, rows["x"].tolist(), rows["_reset"].tolist())
        return state, pd.DataFrame({key: rows[key], order: rows[order], "x": pd.array(x, "Float64")})

    if not rows.isStreaming:
        return plain.groupBy(key).applyInPandas(lambda pdf: one(pdf, [])[1], out)

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, found = one(pd.concat(list(frames)), list(state.get[0]) if state.exists else [])
        state.update((now,))
        yield found

    return plain.groupBy(key).applyInPandasWithState(run, out, "s array<double>", "append", GroupStateTimeout.NoTimeout)


def bias_filtered(stream: DataFrame, key: str, order: str, alpha: float) -> DataFrame:
    return filtered(stream, key, order, bias(alpha))
