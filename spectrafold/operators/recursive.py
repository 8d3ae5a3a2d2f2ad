"""Recursive filters of series of any length, by a prefix scan of affine maps.

A filter is a linear system: state' = M state + c x, y = d state + e x. So a stretch of n samples takes a state s to
M^n s + u, where u is what the stretch makes of no state at all, and such maps can be composed. Rows are dealt by ranges
of key and order: each task runs its part of a series from no state, a few numbers for each part are carried along the
parts, and each part then starts from the state that it really meets. Within a task samples run side by side, in rows of
CHUNK, and the rows' states are composed in the same way.

A null or NaN x passes as null and leaves the state. Rows at the same place in the order are taken by x. A row whose reset
is true begins anew. Null keys are one series. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrafold.operators.ordered import running_sums
from spectrafold.operators.statistics import met
from spectrafold.plans.lineage import written

CHUNK = 64


class System(NamedTuple):
    step: np.ndarray
    take: np.ndarray
    give: np.ndarray
    through: float


def equation(b: list[float], a: list[float] = (1.0,)) -> System:
    """a0 y(t) + a1 y(t-1) + .. = b0 x(t) + b1 x(t-1) + .."""
    n = max(len(a), len(b), 2)
    a, b = (np.pad(np.asarray(c, float), (0, n - len(c))) / a[0] for c in (a, b))
    step = np.eye(n - 1, k=1)
    step[:, :1] -= a[1:, None]
    return System(step, b[1:] - a[1:] * b[0], np.eye(1, n - 1)[0], float(b[0]))


def in_turn(first: System, second: System) -> System:
    """The second filter on what the first gives, as one system."""
    n, m = len(first.take), len(second.take)
    step = np.block([[first.step, np.zeros((n, m))], [np.outer(second.take, first.give), second.step]])
    return System(step, np.r_[first.take, second.take * first.through], np.r_[second.through * first.give, second.give], first.through * second.through)


def butterworth(order: int, cutoff: float | tuple[float, float], rate: float, kind: str = "low") -> System:
    """A Butterworth filter: low, high, bandpass or stop, by second-order sections in turn. cutoff in the units of the sample rate."""
    warped = 2 * np.tan(np.pi * np.atleast_1d(np.asarray(cutoff, float)) / rate)
    poles = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    # From the unit low-pass to the band: each pole of a band filter becomes two.
    if kind in ("low", "high"):
        poles = warped[0] * poles if kind == "low" else warped[0] / poles
        zeros = np.full(order, -1.0 if kind == "low" else 1.0, complex)
    else:
        centre, half = np.sqrt(warped[0] * warped[1]), (warped[1] - warped[0]) / 2
        scaled = half * poles if kind == "bandpass" else half / poles
        root = np.sqrt(scaled**2 - centre**2 + 0j)
        poles = np.r_[scaled + root, scaled - root]
        zeros = np.r_[np.ones(order), -np.ones(order)] if kind == "bandpass" else np.repeat([(2 + 1j * centre) / (2 - 1j * centre), (2 - 1j * centre) / (2 + 1j * centre)], order)
    poles = (2 + poles) / (2 - poles)
    # Where the gain is one: nothing, half the rate, or the band's centre.
    at = {"low": 1.0, "high": -1.0, "stop": 1.0}.get(kind, np.exp(2j * np.arctan(np.sqrt(np.prod(warped)) / 2)) if kind == "bandpass" else 1.0)
    sections = _sections(poles), _sections(zeros)
    out = None
    for a, b in zip(*sections):
        gain = abs(np.polyval(a, at) / np.polyval(b, at))
        one = equation(list(b * gain), list(a))
        out = one if out is None else in_turn(out, one)
    return out


def _sections(roots: np.ndarray) -> list[np.ndarray]:
    """Real polynomials of two roots each, conjugate ones together, as many as there are pairs; the last may have one."""
    upper = sorted((r for r in roots if r.imag > 1e-9), key=lambda r: -abs(r))
    real = sorted((r.real for r in roots if abs(r.imag) <= 1e-9))
    # Of the real ones the least goes with the largest, as zeros of a band filter do.
    pairs = [(real[k], real[-1 - k]) for k in range(len(real) // 2)]
    single = [np.array([1.0, -real[len(real) // 2]])] if len(real) % 2 else []
    return [np.array([1.0, -2 * r.real, abs(r) ** 2]) for r in upper] + [np.array([1.0, -(p + q), p * q]) for p, q in pairs] + single


def windowed_taps(order: int, cutoff: float | tuple[float, float], rate: float, kind: str = "low") -> list[float]:
    """order + 1 taps of a filter without recursion: the ideal response under a Hamming window, gain one in the middle of its first band."""
    edges = 2 * np.atleast_1d(np.asarray(cutoff, float)) / rate
    t = np.arange(order + 1) - order / 2
    ideal = lambda edge: edge * np.sinc(edge * t)
    low, band = ideal(edges[0]), ideal(edges[-1]) - ideal(edges[0])
    taps = {"low": low, "high": np.sinc(t) - low, "bandpass": band, "stop": np.sinc(t) - band}[kind] * np.hamming(order + 1)
    middle = {"low": 0.0, "stop": 0.0, "high": 1.0}.get(kind, edges.mean())
    return list(taps / abs(taps @ np.exp(-1j * np.pi * middle * t)))


def states(step: np.ndarray, added: np.ndarray, state: np.ndarray) -> np.ndarray:
    """state, then step state + added[0], and so on: one more than there are added."""
    n, p = added.shape
    if n <= CHUNK:
        found = np.empty((n + 1, p))
        found[0] = state
        for k in range(n):
            found[k + 1] = step @ found[k] + added[k]
        return found
    rows = -(-n // CHUNK)
    room = np.zeros((rows * CHUNK, p))
    room[:n] = added
    room = room.reshape(rows, CHUNK, p)
    inside = np.zeros((rows, CHUNK + 1, p))
    for k in range(CHUNK):
        inside[:, k + 1] = inside[:, k] @ step.T + room[:, k]
    powers = _powers(step, CHUNK + 1)
    starts = states(powers[CHUNK], inside[:, CHUNK], state)
    found = inside[:, :CHUNK] + np.einsum("kij,rj->rki", powers[:CHUNK], starts[:-1])
    found = found.reshape(-1, p)[:n]
    return np.vstack([found, step @ found[-1] + added[-1]])


def _powers(step: np.ndarray, n: int) -> np.ndarray:
    found = [np.eye(len(step))]
    for _ in range(n - 1):
        found.append(step @ found[-1])
    return np.array(found)


def run(system: System, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """y of x from a state, and the state after it; NaN passes."""
    good = ~np.isnan(x)
    met_states = states(system.step, x[good, None] * system.take, state)
    y = np.full(len(x), np.nan)
    y[good] = met_states[:-1] @ system.give + system.through * x[good]
    return y, met_states[-1]


def _runs(batch: pa.RecordBatch, n_keys: int) -> list[int]:
    """Where the keys of a batch change, with its end."""
    change = np.zeros(batch.num_rows, bool)
    for k in range(n_keys):
        code = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy()
        change[1:] |= code[1:] != code[:-1]
    return [0, *np.flatnonzero(change).tolist(), batch.num_rows]


def filtered(rows: DataFrame, keys: list[str], order: list[str], system: System, reset: Column | None = None, powers: list[int] | None = None) -> DataFrame:
    """keys, order, x of rows, filtered; with powers x as it is and e0, e1, ..: those powers of x, filtered in one pass."""
    own, all_powers = list(keys), powers or [1]
    # The powers' states lie one behind the other, as those of systems side by side.
    n_powers = len(all_powers)
    step, p = np.kron(np.eye(n_powers), system.step), n_powers * len(system.take)
    taken = lambda x: (_powers_of(x, all_powers)[:, :, None] * system.take).reshape(len(x), p)
    picked = rows.select(*keys, *order, F.nanvl(F.col("x").cast("double"), F.lit(None)).alias("x"), *([F.coalesce(reset, F.lit(False)).alias("_reset")] if reset is not None else []))
    if reset is not None:
        picked, own = running_sums(picked, keys, [*order, "x"], {"_segment": F.col("_reset").cast("int")}).drop("_reset"), [*keys, "_segment"]
    picked = picked.select(*own, *order, "x")
    by = [*own, *order, "x"]
    cells = F.array(F.struct(*order, "x"))
    schema = picked.select(*own, cells.alias("cells")).schema
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of a key within a batch, with the state at their start and end if the part begins with none, and how many samples lie before."""
        from pyspark import TaskContext

        part, last, state, before, block = TaskContext.get().partitionId(), None, np.zeros(p), 0, 0
        for batch in batches:
            at, heads, notes = _runs(batch, len(own)), [], []
            x = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            for lo, hi in zip(at, at[1:]):
                if lo == hi:
                    continue
                key = tuple(batch.column(k)[lo].as_py() for k in range(len(own)))
                if key != last:
                    last, state, before, block = key, np.zeros(p), 0, 0
                good = x[lo:hi][~np.isnan(x[lo:hi])]
                start, state = state, states(step, taken(good), state)[-1]
                heads.append(lo)
                notes.append((part, block, before, len(good), start.tolist(), state.tolist()))
                before, block = before + len(good), block + 1
            if not heads:
                continue
            packed = pa.StructArray.from_arrays([batch.column(k) for k in range(len(own), batch.num_columns)], [*order, "x"])
            lists = pa.ListArray.from_arrays(pa.array([*heads, batch.num_rows], pa.int32()), packed)
            made = [pa.array(c, t) for c, t in zip(zip(*notes), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(heads)) for k in range(len(own))), lists, *made], [*own, "cells", "_part", "_block", "_before", "_n", "_start", "_end"])

    sorted_rows = picked.repartitionByRange(*by).sortWithinPartitions(*by)
    blocks = written(sorted_rows.mapInArrow(pack, f"{kinds}, _part int, _block long, _before long, _n long, _start array<double>, _end array<double>"), "blocks")
    parts = blocks.groupBy(*own, "_part").agg(F.sum("_n").alias("n"), F.max_by("_end", "_block").alias("end")).groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("_part", "n", "end"))).alias("parts"))
    key_kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema[:-1])

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, number, found = [], [], []
            for row, of in enumerate(batch.column(len(own)).to_pylist()):
                state = np.zeros(p)
                for one in of:
                    at.append(row)
                    number.append(one["_part"])
                    found.append(state.tolist())
                    state = np.linalg.matrix_power(step, one["n"]) @ state + one["end"]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(at, pa.int64())) for k in range(len(own))), pa.array(number, pa.int32()), pa.array(found, pa.list_(pa.float64()))], [*own, "_part", "_met"])

    met_there = parts.mapInArrow(carry, f"{key_kinds}, _part int, _met array<double>" if own else "_part int, _met array<double>")
    joined = met(blocks, met_there, [*own, "_part"]).select(*keys, "cells", "_before", "_start", "_met")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(keys)
        for batch in batches:
            lists = batch.column(n)
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            columns = lists.flatten().flatten()
            x, y = columns[-1].to_numpy(zero_copy_only=False), np.full((n_powers, ends[-1]), np.nan)
            for row, (before, start, there) in enumerate(zip(*(batch.column(n + k).to_pylist() for k in (1, 2, 3)))):
                state = np.linalg.matrix_power(step, before) @ np.array(there) + start
                good = ends[row] + np.flatnonzero(~np.isnan(x[ends[row] : ends[row + 1]]))
                met_states = states(step, taken(x[good]), state)[:-1].reshape(len(good), n_powers, len(system.take))
                y[:, good] = (met_states @ system.give + system.through * _powers_of(x[good], all_powers)).T
            of = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(ends)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(of) for k in range(n)), *columns[: len(columns) if powers else -1], *(pa.array(e, from_pandas=True) for e in y)], [*keys, *order, *added])

    added = ["x", *(f"e{k}" for k in powers)] if powers else ["x"]
    return joined.mapInArrow(go, picked.select(*keys, *order, *(F.col("x").alias(c) for c in added)).schema)


def _powers_of(x: np.ndarray, powers: list[int]) -> np.ndarray:
    return np.stack([x**k for k in powers], 1)


def _means(rows: DataFrame, keys: list[str], order: list[str], alpha: float, powers: list[int], reset: Column | None) -> DataFrame:
    """keys, order, x and e0, e1, ..: exponential means of x's powers, 0 being the weight so far."""
    a = 0.5 ** (1 / alpha) if alpha > 1 else alpha
    return filtered(rows, keys, order, equation([1 - a], [1.0, -a]), reset, powers)


def less_exponential_mean(rows: DataFrame, keys: list[str], order: list[str], alpha: float, reset: Column | None = None) -> DataFrame:
    """x less its exponential average; a factor above 1 is a half-life in rows."""
    return _means(rows, keys, order, alpha, [0, 1], reset).withColumn("x", F.col("x") - F.col("e1") / F.col("e0")).drop("e0", "e1")


def by_exponential_power(rows: DataFrame, keys: list[str], order: list[str], alpha: float, reset: Column | None = None) -> DataFrame:
    """x by the root of its exponential mean square; 0 as long as that is 0."""
    size = F.sqrt(F.col("e2") / F.col("e0"))
    return _means(rows, keys, order, alpha, [0, 2], reset).withColumn("x", F.when(F.col("e2") == 0, 0.0).otherwise(F.col("x") / size)).drop("e0", "e2")
