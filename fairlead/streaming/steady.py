"""Steady-state segments of a stream of samples (W1): the rows of ``operators.segments.steady_segments`` as soon as they are final.

A vessel's samples wait until the watermark has passed them, so that order within the delay does not matter; then they go on
with the vessel's open run or close it.  An event-time timer closes a run that nothing has followed for the permitted gap.  What
is kept of a vessel is its open run's sums and the samples within the delay.  However the stream is cut into
micro-batches, the segments are those of all its samples at once; samples later than the delay are lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fairlead.functions.units import SEGMENT_MS_TO_KN
from fairlead.operators.segments import Limits

#: What is read of a sample; the second column orders samples of one time, exactly up to 2 ** 53.
SAMPLE = ["t_s", "tie", "stw_ms", "heading_deg", "active_engines", "fuel_kg_per_h", "hs_m", "period_peak_s", "wave_from_deg"]
_T, _TIE, _STW, _HEADING, _ENGINES, _FUEL, _HS, _PERIOD, _WAVE = range(len(SAMPLE))
SEGMENT = (
    "t_start_s double, t_end_s double, mean_stw_ms double, mean_heading_deg double, active_engines int, mean_fuel_kg_per_h double, "
    "mean_hs_m double, mean_period_peak_s double, mean_wave_from_deg double, n_samples long, duration_h double")
#: Sums of a run: first and last time, count, then of what is averaged; then the last sample.
_SUMS = 3 + 4 + 4


def _breaks(rows: np.ndarray, limits: Limits) -> np.ndarray:
    """Whether each sample but the first does not go on from the one before it."""
    a, b = rows[:-1], rows[1:]
    turn = np.abs((b[:, _HEADING] - a[:, _HEADING] + 180.0) % 360.0 - 180.0)
    fuel = np.maximum(1e-6, (a[:, _FUEL] + b[:, _FUEL]) / 2.0)
    return (
        (b[:, _T] - a[:, _T] > limits.max_gap_s) | (a[:, _ENGINES] != b[:, _ENGINES]) | (np.abs(b[:, _STW] - a[:, _STW]) * SEGMENT_MS_TO_KN > limits.speed_kn)
        | (turn > limits.heading_deg) | (np.abs(b[:, _FUEL] - a[:, _FUEL]) / fuel > limits.fuel_jump))


def _sums(rows: np.ndarray) -> np.ndarray:
    heading, wave = np.radians(rows[:, _HEADING]), np.radians(rows[:, _WAVE])
    each = [rows[:, _STW], rows[:, _FUEL], rows[:, _HS], rows[:, _PERIOD], np.sin(heading), np.cos(heading), np.sin(wave), np.cos(wave)]
    return np.array([rows[0, _T], rows[-1, _T], len(rows), *(x.sum() for x in each)])


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.concatenate([[a[0], b[1]], a[2:] + b[2:]])


def _segment(run: np.ndarray) -> tuple:
    """A row of SEGMENT from the sums of a run and its last sample."""
    n, last = run[2], run[_SUMS:]
    stw, fuel, hs, period, hsin, hcos, wsin, wcos = run[3:_SUMS] / n
    bearing = lambda s, c: float(np.degrees(np.arctan2(s, c)) % 360.0)
    return (run[0], run[1], stw, bearing(hsin, hcos), int(last[_ENGINES]), fuel, hs, period, bearing(wsin, wcos), int(n), (run[1] - run[0]) / 3600.0)


def _advance(run: np.ndarray, rows: np.ndarray, limits: Limits) -> tuple[list[tuple], np.ndarray]:
    """Segments that ``rows``, in order, close after the open ``run`` (empty for none), and the run that is open then."""
    parts = rows if not len(run) else np.vstack([run[_SUMS:], rows])
    cuts = np.flatnonzero(_breaks(parts, limits)) + 1
    done, pieces = [], np.split(parts, cuts)
    for k, piece in enumerate(pieces):
        if k == 0 and len(run):
            piece = piece[1:]  # the run's last sample is in its sums
            sums = _joined(run[:_SUMS], _sums(piece)) if len(piece) else run[:_SUMS]
            now = np.concatenate([sums, piece[-1] if len(piece) else run[_SUMS:]])
        else:
            now = np.concatenate([_sums(piece), piece[-1]])
        if k < len(pieces) - 1:
            done.append(now)
    return [_segment(r) for r in done if r[1] - r[0] >= limits.min_duration_s], now


def steady_stream(samples: DataFrame, by: str, tie: str, delay: str = "10 minutes", limits: Limits = Limits()) -> DataFrame:
    """A stream of ``samples(<by> string or number, t_s, <tie>, ...)`` -> by, and the columns of SEGMENT, in append mode."""
    kind = samples.schema[by].dataType.simpleString()
    rows = samples.select(by, F.timestamp_micros((F.col("t_s") * 1e6).cast("long")).alias("_at"), *[
        F.col(tie if c == "tie" else c).cast("double").alias(c) for c in SAMPLE]).withWatermark("_at", delay)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, run = (np.array(x or [], float) for x in (state.get if state.exists else ([], [])))
        parts = [pending.reshape(-1, len(SAMPLE)), *(pdf[SAMPLE].to_numpy(float) for pdf in batches)] if not state.hasTimedOut else [pending.reshape(-1, len(SAMPLE))]
        pending = np.vstack(parts)
        passed = state.getCurrentWatermarkMs() / 1000.0
        pending = pending[np.lexsort((pending[:, _TIE], pending[:, _T]))]
        cut = int(np.searchsorted(pending[:, _T], passed))  # later samples may yet come before the others
        found: list[tuple] = []
        if cut:
            found, run = _advance(run, pending[:cut], limits)
            pending = pending[cut:]
        if len(run) and run[1] + limits.max_gap_s < passed and (not len(pending) or pending[0, _T] - run[1] > limits.max_gap_s):
            found, run = found + ([_segment(run)] if run[1] - run[0] >= limits.min_duration_s else []), run[:0]
        if len(run) or len(pending):
            state.update((pending.ravel().tolist(), run.tolist()))
            wake = min([*([run[1] + limits.max_gap_s] if len(run) else []), *([pending[0, _T]] if len(pending) else [])])
            state.setTimeoutTimestamp(int(max(wake, passed) * 1000) + 1)
        elif state.exists:
            state.remove()
        if found:
            out = pd.DataFrame(found, columns=[c.split()[0] for c in SEGMENT.split(", ")])
            out.insert(0, by, key[0])
            yield out

    return rows.groupBy(by).applyInPandasWithState(
        step, f"{by} {kind}, {SEGMENT}", "pending array<double>, run array<double>", "append", GroupStateTimeout.EventTimeTimeout)
