"""Stateful stream operators, keyed by station or by (station, parameter).

Each keeps a bounded amount of state per key and sorts a micro-batch's rows of a key by time
before using them.  They only add context columns; the rules themselves are the column
expressions of the batch job.  Needs the RocksDB state store (see `use_rocksdb`).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fieldwatch.config import CHANNELS, FEATURES, SEQUENCE_ROWS, SERVICE, Profile
from fieldwatch.operators.features import cyclic_time
from fieldwatch.operators.health import (
    DRIFT_SLACK,
    SPANS,
    STEPS_KEPT,
    parameter_suspect_flags,
    series_rows,
    with_health_index,
)
from fieldwatch.operators.qc import qc_result
from fieldwatch.timeline import hours_between, micros_between

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR_NS = 3_600_000_000_000


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """One key's rows of this micro-batch, by time; bounded by the source's trigger limits."""
    return pd.concat(list(rows), ignore_index=True).sort_values("timestamp", kind="stable", ignore_index=True)


def _ns(ts: pd.Series) -> np.ndarray:
    return ts.to_numpy(dtype="datetime64[ns]").astype(np.int64)


def _number(x) -> float:
    return float("nan") if x is None else float(x)


class PreviousRow(StatefulProcessor):
    """Adds the station's previous row and the length of the run of equal readings.

    State: the last row and three run lengths.  Rows come out in order within a micro-batch;
    a late row is compared with whatever arrived before it, as it would be online.
    """

    def __init__(self, tolerance: float, gap_hours: float):
        self.tolerance, self.gap_hours = tolerance, gap_hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = [T.StructField("at", T.LongType())]
        fields += [T.StructField(c, T.DoubleType()) for c in CHANNELS]
        fields += [T.StructField(f"run_{c}", T.LongType()) for c in CHANNELS]
        self.last = handle.getValueState("last", T.StructType(fields))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _in_order(rows)
        known = self.last.get() if self.last.exists() else None
        at = _ns(pdf["timestamp"])
        before = np.concatenate([[known[0] if known else at[0]], at[:-1]])
        first = known is None
        hours = (at - before) / HOUR_NS
        out = {"station_id": pdf["station_id"], "timestamp": pdf["timestamp"]}
        out["p_timestamp"] = pd.Series(before.astype("datetime64[ns]"))
        if first:
            out["p_timestamp"].iloc[0] = pd.NaT
        state = [int(at[-1])]
        runs_out = []
        for i, c in enumerate(CHANNELS):
            v = pdf[c].to_numpy(dtype=float)
            start = _number(known[1 + i]) if known else float("nan")
            prev = np.concatenate([[start], v[:-1]])
            same = (np.abs(v - prev) <= self.tolerance) & (hours <= self.gap_hours)
            if first:
                same[0] = False
            runs = np.empty(len(v), dtype=np.int64)
            length = int(known[4 + i]) if known else 0
            for j, s in enumerate(same):
                length = length + 1 if s else 1
                runs[j] = length
            out[c], out[f"p_{c}"], out[f"run_{c}"] = v, prev, runs
            state.append(None if np.isnan(v[-1]) else float(v[-1]))
            runs_out.append(int(runs[-1]))
        self.last.update((*state, *runs_out))
        yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def _previous_schema() -> str:
    parts = ["station_id string", "timestamp timestamp_ntz", "p_timestamp timestamp_ntz"]
    for c in CHANNELS:
        parts += [f"{c} double", f"p_{c} double", f"run_{c} bigint"]
    return ", ".join(parts)


def stream_qc(rows: DataFrame, profile: Profile = SERVICE, flatline: bool = True) -> DataFrame:
    """The service checks on a stream of (station_id, timestamp, temperature, pressure,
    humidity).  Equal to the batch result, except that a flatline is known only from its
    `flatline_rows`-th row on; flatline=False leaves that check out."""
    context = (
        rows.select("station_id", "timestamp", *CHANNELS)
        .groupBy("station_id")
        .transformWithStateInPandas(
            PreviousRow(profile.flatline_tolerance, profile.rate_gap_hours),
            outputStructType=_previous_schema(),
            outputMode="Append",
            timeMode="None",
        )
    )
    cols = {"_h": hours_between(F.col("p_timestamp"), F.col("timestamp"))}
    for c in CHANNELS:
        run = F.col(f"run_{c}") >= profile.flatline_rows
        cols[f"_p_{c}"] = F.col(f"p_{c}")
        cols[f"{c}_flatline"] = run if flatline else F.lit(False)
    return qc_result(context.withColumns(cols), profile)


@dataclass
class Running:
    """What is kept of one (station, parameter): counters, the last value, the two drift sums,
    the last 720 error marks and the last 24 steps."""

    total: int = 0
    missing: int = 0
    suspect: int = 0
    flat: int = 0
    last: float = float("nan")
    up: float = 0.0
    down: float = 0.0
    errors: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint8))
    steps: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @staticmethod
    def load(row) -> Running:
        *numbers, last, up, down, errors, steps = row
        return Running(*numbers, _number(last), up, down, np.frombuffer(bytes(errors), np.uint8), np.frombuffer(bytes(steps)))

    def row(self) -> tuple:
        last = None if np.isnan(self.last) else float(self.last)
        counts = (int(self.total), int(self.missing), int(self.suspect), int(self.flat))
        return (*counts, last, float(self.up), float(self.down), self.errors.tobytes(), self.steps.tobytes())


RUNNING = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("total", "missing", "suspect", "flat")]
    + [T.StructField(n, T.DoubleType()) for n in ("last", "up", "down")]
    + [T.StructField(n, T.BinaryType()) for n in ("errors", "steps")]
)


def advance(known: Running, value, suspect, missing, flat) -> tuple[dict[str, np.ndarray], Running]:
    """Metrics after each of some rows in time order, and what to keep after the last.

    Work on whole arrays: error rates are differences of a running count, flatline runs end
    at the last row that moved, a drift sum is a running sum less its running minimum.
    """
    n = len(value)
    suspect, missing, flat = (np.asarray(x, dtype=bool) for x in (suspect, missing, flat))
    rows = np.arange(n)
    total = known.total + rows + 1
    errors = np.concatenate((known.errors, (suspect | missing).astype(np.uint8)))
    so_far = np.concatenate(([0], np.cumsum(errors, dtype=np.int64)))
    at = len(known.errors) + rows + 1
    out = {f"error_rate_{k}": (so_far[at] - so_far[np.maximum(at - span, 0)]) / np.minimum(span, total) for k, span in SPANS.items()}
    moved = np.maximum.accumulate(np.where(flat, -1, rows)) if n else rows
    run = np.where(moved < 0, known.flat + rows + 1, rows - moved)
    gone = known.missing + np.cumsum(missing)
    odd = known.suspect + np.cumsum(suspect & ~missing)
    # Steps between rows that have a value.
    seen = np.flatnonzero(~np.isnan(value))
    values = np.concatenate(([known.last], value[seen]))
    step = np.diff(values)
    stepped = seen[~np.isnan(step)]
    step = step[~np.isnan(step)]
    steps = np.concatenate((known.steps, step))
    many = len(known.steps) + np.searchsorted(stepped, rows, side="right")
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate((np.full(STEPS_KEPT, np.nan), steps)), STEPS_KEPT)
    spread = np.zeros(n)
    enough = many > 2
    spread[enough] = np.nanvar(windows[many[enough]], axis=1)
    quiet = ~suspect[stepped]
    counted = np.searchsorted(stepped[quiet], rows, side="right")
    drift = {}
    for name, start, sign in (("up", known.up, 1.0), ("down", known.down, -1.0)):
        sums = start + np.cumsum(sign * step[quiet] - DRIFT_SLACK)
        drift[name] = np.concatenate(([start], sums - np.minimum(0.0, np.minimum.accumulate(sums)) if len(sums) else sums))[counted]
    out |= {
        "noise_variance": spread,
        "cusum_drift": np.maximum(drift["up"], drift["down"]),
        "total_observations": total,
        "clean_observations": total - gone - odd,
        "suspect_observations": odd,
        "missing_observations": gone,
        "consecutive_flatlines": run,
    }
    if not n:
        return out, known
    kept = Running(total[-1], gone[-1], odd[-1], run[-1], values[-1] if len(seen) else known.last, drift["up"][-1], drift["down"][-1])
    kept.errors, kept.steps = errors[-max(SPANS.values()) :], steps[-STEPS_KEPT:]
    return out, kept


class HealthState(StatefulProcessor):
    """Running health metrics of one (station, parameter); the state is one `Running`."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("health", RUNNING)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _in_order(rows)
        known = Running.load(self.state.get()) if self.state.exists() else Running()
        out, kept = advance(known, pdf["value"].to_numpy(dtype=float), pdf["suspect"], pdf["missing"], pdf["flat"])
        self.state.update(kept.row())
        yield pdf[["station_id", "timestamp", "parameter"]].assign(**out)

    def close(self) -> None:
        pass


RATES = tuple(f"error_rate_{k}" for k in SPANS)
COUNTS = tuple(f"{k}_observations" for k in ("total", "clean", "suspect", "missing")) + ("consecutive_flatlines",)
METRICS = (*RATES, "noise_variance", "cusum_drift", *COUNTS)


def stream_health(qc: DataFrame) -> DataFrame:
    """Running parameter health on a stream of QC results; equal to the batch result."""
    rows = series_rows(parameter_suspect_flags(qc))
    doubles = [f"{k} double" for k in METRICS if k not in COUNTS]
    counts = [f"{k} bigint" for k in COUNTS]
    schema = ", ".join(["station_id string, timestamp timestamp_ntz, parameter string", *doubles, *counts])
    metrics = rows.groupBy("series").transformWithStateInPandas(
        HealthState(), outputStructType=schema, outputMode="Append", timeMode="None"
    )
    return with_health_index(metrics)


class LastRows(StatefulProcessor):
    """The last `rows` rows of a station as arrays, with every row once enough are known.

    State: at most `rows` - 1 rows.  Initial rows (history before the stream) fill the state
    without coming out.
    """

    def __init__(self, rows: int = SEQUENCE_ROWS):
        self.rows = rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("rows", T.StructType([T.StructField("data", T.BinaryType())]))

    def _load(self) -> np.ndarray:
        if not self.kept.exists():
            return np.empty((0, 1 + len(CHANNELS)))
        return np.frombuffer(bytes(self.kept.get()[0])).reshape(-1, 1 + len(CHANNELS))

    def _add(self, pdf: pd.DataFrame) -> np.ndarray:
        fresh = np.column_stack(
            [_ns(pdf["timestamp"]) / HOUR_NS, *[pdf[c].to_numpy(dtype=float) for c in CHANNELS]]
        )
        data = np.vstack([self._load(), fresh])
        self.kept.update((np.ascontiguousarray(data[-(self.rows - 1) :]).tobytes(),))
        return data

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self._add(initialState.sort_values("timestamp"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _in_order(rows)
        data = self._add(pdf)
        start = len(data) - len(pdf)
        ends = [i for i in range(start, len(data)) if i + 1 >= self.rows]
        parts = [data[i + 1 - self.rows : i + 1] for i in ends]
        out = pdf.iloc[[i - start for i in ends]][["station_id", "timestamp"]].reset_index(drop=True)
        names = ("hours", *CHANNELS)
        for k, name in enumerate(names):
            out[name] = pd.Series([p[:, k].tolist() for p in parts], dtype=object)
        yield out

    def close(self) -> None:
        pass


def stream_sequences(
    rows: DataFrame,
    history: DataFrame | None = None,
    size: int = SEQUENCE_ROWS,
    max_step_hours: float = 1.5,
) -> DataFrame:
    """Windows of the last `size` rows on a stream, without gaps or missing values.

    history: rows before the stream (station_id, timestamp, channels); only each station's
    last `size` - 1 are used.
    """
    cols = ["station_id", "timestamp", *CHANNELS]
    start = None
    if history is not None:
        newest = F.row_number().over(
            Window.partitionBy("station_id").orderBy(F.col("timestamp").desc())
        )
        tail = history.select(*cols).withColumn("_r", newest).where(F.col("_r") < size).drop("_r")
        start = tail.groupBy("station_id")
    arrays = ", ".join(f"{n} array<double>" for n in ("hours", *CHANNELS))
    out = rows.select(*cols).groupBy("station_id").transformWithStateInPandas(
        LastRows(size),
        outputStructType=f"station_id string, timestamp timestamp_ntz, {arrays}",
        outputMode="Append",
        timeMode="None",
        initialState=start,
    )
    hole = F.lit(False)
    for c in CHANNELS:
        hole = hole | F.exists(c, lambda x: x.isNull() | F.isnan(x))
    hours = F.col("hours")
    # Hours are doubles near 5e5: compare with a margin far below a second.
    gap = F.exists(
        F.sequence(F.lit(2), F.lit(size)),
        lambda i: F.element_at(hours, i) - F.element_at(hours, i - 1) > max_step_hours + 1e-6,
    )
    return out.where(~hole & ~gap).select(
        "station_id", "timestamp", F.arrays_zip(*[F.col(c) for c in CHANNELS]).alias("window")
    )



# -- the full check of arriving rows ------------------------------------------------------


class Context(StatefulProcessor):
    """Each row with what its decision needs of the rows around it.

    State: the station's last rows, as many as a window and the rows still open take.  A row
    is final when `ahead` later rows are known; until then every micro-batch gives it again
    with what is known by now.  Rows that come out of order are put in place among the
    open ones; a row from before the last final one is too late and is left out.
    """

    def __init__(self, tolerance: float, gap_hours: float, run: int, window: int = SEQUENCE_ROWS):
        self.tolerance, self.gap_hours, self.run, self.window = tolerance, gap_hours, run, window
        self.ahead = run - 1

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = [T.StructField("data", T.BinaryType()), T.StructField("open", T.LongType())]
        self.kept = handle.getValueState("rows", T.StructType(fields))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True)
        fresh = np.column_stack([_ns(pdf["timestamp"]), *[pdf[c].to_numpy(dtype=float).view(np.int64) for c in CHANNELS]])
        old, still_open = np.zeros((0, 1 + len(CHANNELS)), np.int64), 0
        if self.kept.exists():
            blob, still_open = self.kept.get()
            old = np.frombuffer(bytes(blob), np.int64).reshape(-1, 1 + len(CHANNELS))
        done = len(old) - still_open
        if done:
            fresh = fresh[fresh[:, 0] > old[done - 1, 0]]
        moving = np.vstack((old[done:], fresh))
        data = np.vstack((old[:done], moving[np.argsort(moving[:, 0], kind="stable")]))
        n = len(data)
        at, values = data[:, 0], data[:, 1:].copy().view(float)
        show = np.arange(done, n)
        final = show + self.ahead < n
        still_open = int((~final).sum())
        keep = max(0, n - (self.window - 1) - still_open)
        self.kept.update((np.ascontiguousarray(data[keep:]).tobytes(), still_open))
        yield self._rows(key[0], at, values, show, final)

    def _rows(self, station, at, values, show, final) -> pd.DataFrame:
        n = len(at)

        def times(offset):
            there = (show + offset >= 0) & (show + offset < n)
            out = np.full(len(show), "NaT", dtype="datetime64[ns]")
            out[there] = at[(show + offset)[there]].astype("datetime64[ns]")
            return out

        out = {"station_id": station, "timestamp": at[show].astype("datetime64[ns]"), "p_timestamp": times(-1), "n_timestamp": times(1), "pp_known": show >= 2}
        hours = np.diff(at) / HOUR_NS
        for i, c in enumerate(CHANNELS):
            v = np.concatenate(([np.nan, np.nan], values[:, i], [np.nan]))
            out[c], out[f"p_{c}"], out[f"pp_{c}"], out[f"n_{c}"] = v[show + 2], v[show + 1], v[show], v[show + 3]
            same = (np.abs(np.diff(values[:, i])) <= self.tolerance) & (hours <= self.gap_hours)
            run = np.concatenate(([0], np.cumsum(~same))) if n else np.zeros(0, np.int64)
            out[f"{c}_flatline"] = np.bincount(run)[run][show] >= self.run if n else np.zeros(0, bool)
        whole = show + 1 >= self.window
        for name, column in (("hours", at / HOUR_NS), *((c, values[:, i]) for i, c in enumerate(CHANNELS))):
            out[f"w_{name}"] = pd.Series([column[k + 1 - self.window : k + 1].tolist() if w else None for k, w in zip(show, whole)], dtype=object)
        return pd.DataFrame(out | {"final": final})

    def close(self) -> None:
        pass


def _context_schema() -> str:
    parts = ["station_id string", *[f"{p}timestamp timestamp_ntz" for p in ("", "p_", "n_")], "pp_known boolean"]
    for c in CHANNELS:
        parts += [f"{p}{c} double" for p in ("", "p_", "pp_", "n_")] + [f"{c}_flatline boolean"]
    parts += [f"w_{n} array<double>" for n in ("hours", *CHANNELS)]
    return ", ".join([*parts, "final boolean"])


def stream_context(rows: DataFrame, profile: Profile = SERVICE) -> DataFrame:
    """Arriving (station_id, timestamp, channels) rows with the rows around them."""
    out = rows.select("station_id", "timestamp", *CHANNELS).groupBy("station_id").transformWithStateInPandas(
        Context(profile.flatline_tolerance, profile.rate_gap_hours, profile.flatline_rows),
        outputStructType=_context_schema(),
        outputMode="Append",
        timeMode="None",
    )
    # Pandas writes a missing number as NaN.
    numbers = [f"{p}{c}" for c in CHANNELS for p in ("", "p_", "pp_", "n_")]
    return out.withColumns({c: F.nanvl(c, F.lit(None)) for c in numbers})


def _moments(values: list[Column]) -> tuple[Column, Column, Column]:
    """Count, mean and sample deviation of the values that are there, updated row by row as
    the aggregate functions do, so that stream and batch give the same bits."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("m"), F.lit(0.0).alias("q"))

    def step(a, x):
        n = a["n"] + 1.0
        delta = x - a["m"]
        part = delta / n
        moved = F.struct(n.alias("n"), (a["s"] + x).alias("s"), (a["m"] + part).alias("m"), (a["q"] + delta * (delta - part)).alias("q"))
        return F.when(x.isNull(), a).otherwise(moved)

    a = F.aggregate(F.array(*values), start, step)
    return a["n"], F.when(a["n"] > 0, a["s"] / a["n"]), F.when(a["n"] > 1, F.sqrt(a["q"] / (a["n"] - 1.0)))


def context_features(rows: DataFrame) -> DataFrame:
    """The sixteen features and `valid_features` of rows with their context."""
    hourly = micros_between(F.col("p_timestamp"), F.col("timestamp")) == 3_600_000_000
    cols = {}
    for c in CHANNELS:
        cols[f"{c}_change"] = F.coalesce(F.when(hourly, F.col(c) - F.col(f"p_{c}")), F.lit(0.0))
        n, mean, std = _moments([F.col(f"pp_{c}"), F.col(f"p_{c}"), F.col(c)])
        cols[f"{c}_mean3"] = F.when(n >= 1, mean)
        cols[f"{c}_std3"] = F.coalesce(std, F.lit(0.0))
    rows = cyclic_time(rows.withColumns(cols))
    valid = F.lit(True)
    for f in FEATURES:
        valid = valid & F.col(f).isNotNull()
    return rows.withColumn("valid_features", valid)


class StationHealth(StatefulProcessor):
    """Running metrics of a station's channels, added to its rows.

    State: one `Running` per channel, moved on by final rows only; open rows are counted on
    a copy.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.states = {c: handle.getValueState(c, RUNNING) for c in CHANNELS}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _in_order(rows)
        settled = int(pdf["final"].sum())
        out = {}
        for c, state in self.states.items():
            known = Running.load(state.get()) if state.exists() else Running()
            parts = []
            for part in (pdf.iloc[:settled], pdf.iloc[settled:]):
                missing = part[c].isna() | part["missing_flag"]
                got, known = advance(known, part[c].to_numpy(dtype=float), part[f"{c}_suspect"], missing, part[f"{c}_flat"])
                parts.append(got)
                if len(parts) == 1:
                    state.update(known.row())
            for name in METRICS:
                out[f"{c}_{name}"] = np.concatenate([p[name] for p in parts])
        yield pdf.assign(**out)

    def close(self) -> None:
        pass


def stream_station_health(rows: DataFrame) -> DataFrame:
    """Checked rows of a stream with the running metrics of their channels."""
    flagged = parameter_suspect_flags(rows)
    kinds = {k: T.LongType() if k in COUNTS else T.DoubleType() for k in METRICS}
    schema = T.StructType([*flagged.schema.fields])
    for c in CHANNELS:
        for k, kind in kinds.items():
            schema.add(f"{c}_{k}", kind)
    return flagged.groupBy("station_id").transformWithStateInPandas(
        StationHealth(), outputStructType=schema, outputMode="Append", timeMode="None"
    )


def channel_health(rows: DataFrame) -> DataFrame:
    """One row per (observation, channel) with health index and status, as `parameter_health` gives."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("parameter"), *[F.col(f"{c}_{k}").alias(k) for k in METRICS]) for c in CHANNELS])).alias("x")
    return with_health_index(rows.select("station_id", "timestamp", each).select("station_id", "timestamp", "x.*"))


def context_windows(rows: DataFrame, size: int = SEQUENCE_ROWS, max_step_hours: float = 1.5) -> DataFrame:
    """(station_id, timestamp, window) of the rows whose window has no gap and no missing value."""
    hole = F.lit(False)
    for c in CHANNELS:
        hole = hole | F.exists(f"w_{c}", lambda x: x.isNull() | F.isnan(x))
    hours = F.col("w_hours")
    gap = F.exists(F.sequence(F.lit(2), F.lit(size)), lambda i: F.element_at(hours, i) - F.element_at(hours, i - 1) > max_step_hours + 1e-6)
    return rows.where(hours.isNotNull()).where(~hole & ~gap).select(
        "station_id", "timestamp", F.arrays_zip(*[F.col(f"w_{c}").alias(c) for c in CHANNELS]).alias("window")
    )
