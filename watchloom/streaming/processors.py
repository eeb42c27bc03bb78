"""Keyed state for Structured Streaming.

Each processor handles the rows of one key in one micro-batch, in event order,
and keeps only what the next batch needs. Size of a batch (and so of a group)
is bounded by the source's trigger options.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_LONG = T.LongType()
_DOUBLE = T.DoubleType()


def _collect(rows: Iterator[pd.DataFrame], order: Sequence[str]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(list(order), kind="stable").reset_index(drop=True)


class Suppress(StatefulProcessor):
    """Keep a row when at least ``cooldown_ms`` passed since the last kept row of the key."""

    def __init__(self, cooldown_ms: int, columns: Sequence[str], ts: str = "timestamp_ms", tiebreak: str = "event_id"):
        self.cooldown_ms, self.columns, self.ts, self.tiebreak = cooldown_ms, list(columns), ts, tiebreak

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", T.StructType([T.StructField("ms", _LONG)]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        pdf = _collect(rows, [self.ts, self.tiebreak])
        last = self.last.get()[0] if self.last.exists() else None
        kept = []
        for i, ms in enumerate(pdf[self.ts]):
            if last is None or ms - last >= self.cooldown_ms:
                kept.append(i)
                last = int(ms)
        self.last.update((last,))
        yield pdf.loc[kept, self.columns]

    def close(self) -> None:
        pass


class ThresholdAlerts(StatefulProcessor):
    """Alert when enough events of the key lie in the window; then clear and rest."""

    STATE = T.StructType([T.StructField("last", _LONG), T.StructField("recent", T.ArrayType(_LONG))])

    def __init__(self, limits: dict[str, tuple[int, int, int]], columns: Sequence[str], order: Sequence[str]):
        self.limits, self.columns, self.order = limits, list(columns), list(order)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("history", self.STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        pdf = _collect(rows, self.order)
        if pdf["category"].iloc[0] not in self.limits:
            return
        need, window, rest = self.limits[pdf["category"].iloc[0]]
        last, recent = None, []
        if self.state.exists():
            last, recent = self.state.get()
            recent = list(recent)
        fired, counts = [], []
        for i, ms in enumerate(pdf["timestamp_ms"].astype(int)):
            # A late event takes its place in time and counts only what lies before it.
            insort(recent, int(ms))
            seen = bisect_right(recent, ms) - bisect_left(recent, ms - window)
            recent = recent[bisect_left(recent, recent[-1] - window):]
            if seen >= need and (last is None or ms - last >= rest):
                fired.append(i)
                counts.append(seen)
                last, recent = int(ms), []
        self.state.update((last, recent))
        yield pdf.loc[fired, self.columns].assign(event_count=np.array(counts, dtype=np.int64))

    def close(self) -> None:
        pass


_COUNTERS = ["timestamp_ms", "cpu_user_ticks", "cpu_kernel_ticks", "cpu_idle_ticks", "net_bytes_in", "net_bytes_out"]
METRICS = ["net_in", "net_out", "in_out_ratio", "cpu", "ram", "auth_failures", "events", "interval"]


def baseline_output(keep: Sequence[T.StructField]) -> T.StructType:
    stats = [T.StructField(f"{m}_{s}", _DOUBLE) for m in METRICS for s in ("mean", "sd", "z")]
    return T.StructType([*keep, T.StructField("seq", _LONG), T.StructField("cpu_pct", _DOUBLE),
                         T.StructField("ram_pct", _DOUBLE), *stats])


class DeviceBaseline(StatefulProcessor):
    """Late drop, features and adaptive baselines of one device.

    A report that is not newer than the last accepted one is dropped. State is
    the last counters and (mean, variance) of eight series.
    """

    STATE = T.StructType([
        T.StructField("prev", T.ArrayType(_LONG)), T.StructField("seq", _LONG),
        T.StructField("mean", T.ArrayType(_DOUBLE)), T.StructField("var", T.ArrayType(_DOUBLE)),
    ])

    def __init__(self, keep: Sequence[str], alpha: float = 0.05, warmup: int = 20, tiebreak: str = "event_id"):
        self.keep, self.alpha, self.warmup, self.tiebreak = list(keep), alpha, warmup, tiebreak

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("baseline", self.STATE)

    def _series(self, r: dict, prev: list[int] | None) -> np.ndarray:
        """The eight values of a report; NaN where it carries none."""
        ram = 100.0 * (1.0 - r["ram_avail_bytes"] / r["ram_total_bytes"]) if r["ram_total_bytes"] > 0 else 0.0
        if prev is None:
            return np.array([np.nan] * 4 + [ram] + [np.nan] * 3)
        ts, user, kernel, idle, b_in, b_out = prev
        total = (r["cpu_user_ticks"] + r["cpu_kernel_ticks"] + r["cpu_idle_ticks"]) - (user + kernel + idle)
        cpu = 100.0 * (1.0 - (r["cpu_idle_ticks"] - idle) / total) if total > 0 else 0.0
        d_in, d_out = max(0, r["net_bytes_in"] - b_in), max(0, r["net_bytes_out"] - b_out)
        return np.array([d_in, d_out, d_in / d_out if d_out > 1 else 0.0, cpu, ram,
                         r["auth_failures"], r["event_count"], max(1, r["timestamp_ms"] - ts)], dtype=float)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        pdf = _collect(rows, ["timestamp_ms", self.tiebreak])
        prev, seq = None, 0
        mean, var = np.full(len(METRICS), np.nan), np.zeros(len(METRICS))
        if self.state.exists():
            p, seq, m, v = self.state.get()
            prev, mean, var = list(p), np.array([np.nan if x is None else x for x in m]), np.array(v, dtype=float)
        out = []
        for r in pdf.to_dict("records"):
            if prev is not None and r["timestamp_ms"] <= prev[0]:
                continue
            x = self._series(r, prev)
            seq += 1
            fresh = np.isnan(mean) & ~np.isnan(x)
            old = ~np.isnan(mean) & ~np.isnan(x)
            d = np.where(old, x - mean, 0.0)
            mean = np.where(fresh, x, np.where(old, mean + self.alpha * d, mean))
            var = np.where(old, (1 - self.alpha) * (var + self.alpha * d * d), var)
            sd = np.sqrt(np.maximum(var, 0.0))
            n = np.array([seq if m == "ram" else seq - 1 for m in METRICS])
            ok = (n >= self.warmup) & (sd >= 1e-9)
            z = np.where(ok, (x - mean) / np.where(sd > 0, sd, 1.0), 0.0)
            row = {c: r[c] for c in self.keep}
            row |= {"seq": seq, "cpu_pct": 0.0 if np.isnan(x[3]) else x[3], "ram_pct": x[4]}
            for i, m in enumerate(METRICS):
                row |= {f"{m}_mean": 0.0 if np.isnan(mean[i]) else mean[i], f"{m}_sd": sd[i], f"{m}_z": z[i]}
            out.append(row)
            prev = [int(r[c]) for c in _COUNTERS]
        if prev is not None:
            self.state.update((prev, seq, [None if np.isnan(v) else float(v) for v in mean], [float(v) for v in var]))
        if out:
            yield pd.DataFrame(out)

    def close(self) -> None:
        pass


class Correlate(StatefulProcessor):
    """Incidents of one rule and scope.

    State holds (time, stage counts) per millisecond for one window, and the
    time of the last incident.
    """

    STATE = T.StructType([T.StructField("last", _LONG), T.StructField("ms", T.ArrayType(_LONG)),
                          T.StructField("counts", T.ArrayType(_LONG))])

    def __init__(self, rules: dict[str, tuple[int, int, int]], stages: int, cooldown_ms: int):
        self.rules, self.stages, self.cooldown_ms = rules, stages, cooldown_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("window", self.STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        columns = [f"s{i}" for i in range(self.stages)]
        pdf = pd.concat(list(rows), ignore_index=True)
        rule, scope = pdf["rule_name"].iloc[0], pdf["scope"].iloc[0]
        window, need, used = self.rules[rule]
        per_ms = pdf.groupby("timestamp_ms")[columns].sum().sort_index()
        last, times, counts = None, np.empty(0, np.int64), np.empty((0, self.stages), np.int64)
        if self.state.exists():
            last, t, c = self.state.get()
            times, counts = np.array(t, np.int64), np.array(c, np.int64).reshape(-1, self.stages)
        start = len(times)
        times = np.concatenate([times, per_ms.index.to_numpy(np.int64)])
        counts = np.concatenate([counts, per_ms.to_numpy(np.int64)])
        order = np.argsort(times, kind="stable")
        first_new = {int(times[i]) for i in range(start, len(times))}
        times, counts = times[order], counts[order]
        sums = np.concatenate([np.zeros((1, self.stages), np.int64), counts.cumsum(axis=0)])
        fired, matches = [], []
        for i, ms in enumerate(times):
            if int(ms) not in first_new or (last is not None and ms - last < self.cooldown_ms):
                continue
            end = int(np.searchsorted(times, ms, side="right"))
            inside = sums[end] - sums[int(np.searchsorted(times, ms - window))]
            if (inside[:used] > 0).all() and inside.sum() >= need:
                fired.append(int(ms))
                matches.append(int(inside.sum()))
                last = int(ms)
        keep = times >= times[-1] - window
        self.state.update((last, [int(v) for v in times[keep]], [int(v) for v in counts[keep].ravel()]))
        yield pd.DataFrame({"rule_name": rule, "scope": scope, "first_seen_ms": np.array(fired, np.int64),
                            "event_count": np.array(matches, np.int64)})

    def close(self) -> None:
        pass
