"""Folds over a device's rows in event-time order, whatever order they arrive in.

Rows wait in pages of event time.  A timer stands at the end of each page; when the watermark passes
it no row of the page can come any more, so the page is sorted, folded onto the carried state, emitted
and forgotten.  One page is in memory at a time, and state holds the pages above the watermark alone.
Rows that come behind the watermark are dropped by Spark, as in any stream.

The state store must be RocksDB (``build_session`` sets it).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PAGE_SECONDS = 60.0

#: (carried state or None, times in seconds, columns) -> (carried state, result columns)
Fold = Callable[[tuple[float, ...] | None, np.ndarray, list[np.ndarray]], tuple[tuple[float, ...], list[np.ndarray]]]


class PagedFold(StatefulProcessor):
    """State: a page's rows as packed numbers, and the fold's own state as doubles."""

    def __init__(self, names: Sequence[str], results: Sequence[str], kinds: Sequence[str], fold: Fold, page_micros: int):
        self.names, self.results, self.kinds, self.fold, self.page_micros = list(names), list(results), list(kinds), fold, page_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pages = handle.getMapState("pages", "page long", "rows binary")
        self.carried = handle.getValueState("carried", "state array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            packed = np.column_stack([frame["event_micros"].to_numpy("int64").view("float64"), *[frame[c].to_numpy("float64", na_value=np.nan) for c in self.names[2:]]])
            page = np.floor_divide(frame["event_micros"].to_numpy("int64"), self.page_micros)
            for number in np.unique(page).tolist():
                at = (number,)
                before = self.pages.getValue(at)[0] if self.pages.containsKey(at) else b""
                self.pages.updateValue(at, (bytes(before) + packed[page == number].tobytes(),))
                self.handle.registerTimer(-(-(number + 1) * self.page_micros // 1000))
        yield self._frame(key, np.zeros(0, "int64"), [np.zeros(0)] * len(self.kinds))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs() * 1000
        due = sorted(k[0] for k in self.pages.keys() if (k[0] + 1) * self.page_micros <= until)
        for number in due:
            table = np.frombuffer(bytes(self.pages.getValue((number,))[0])).reshape(-1, len(self.names) - 1)
            times, columns = np.ascontiguousarray(table[:, 0]).view("int64"), list(table[:, 1:].T)
            order = np.lexsort((*columns[::-1], times))
            times, columns = times[order], [c[order] for c in columns]
            state = tuple(self.carried.get()[0]) if self.carried.exists() else None
            state, results = self.fold(state, times / 1e6, columns)
            self.carried.update((list(map(float, state)),))
            self.pages.removeKey((number,))
            yield self._frame(key, times, results)

    def _frame(self, key, micros: np.ndarray, results: Sequence[np.ndarray]) -> pd.DataFrame:
        out = {self.names[0]: pd.Series([key[0]] * len(micros), dtype=object), "event_micros": micros}
        return pd.DataFrame(out | {n: np.asarray(r).astype(k) for n, r, k in zip(self.results, results, self.kinds, strict=True)})

    def close(self) -> None:
        pass


def fold_in_time_order(
    rows: DataFrame, device: str, ts: str, columns: Sequence[str], results: dict[str, str], fold: Fold,
    delay: str, page_seconds: float = PAGE_SECONDS,
) -> DataFrame:
    """(device, ts, results) of a fold over each device's rows in the order of ``ts``.

    ``columns`` are numbers (nulls arrive as NaN), ``results`` maps names to ``double`` or ``bigint``.
    Rows of one time are ordered by their columns.
    """
    kind = rows.schema[device].dataType.simpleString()
    head = f"{device} {kind}, event_micros bigint"
    schema = ", ".join([head, *[f"{n} {k}" for n, k in results.items()]])
    processor = PagedFold([device, "event_micros", *columns], list(results), ["int64" if k == "bigint" else "float64" for k in results.values()], fold, int(page_seconds * 1e6))
    slim = rows.where(F.col(ts).isNotNull()).withWatermark(ts, delay).select(device, ts, F.unix_micros(ts).alias("event_micros"), *[F.col(c).cast("double").alias(c) for c in columns])
    out = slim.groupBy(device).transformWithStateInPandas(processor, schema, "Append", "EventTime")
    return out.select(device, F.timestamp_micros("event_micros").alias(ts), *results)


def bounds_fold(alpha: float) -> Fold:
    """Bounds that follow a new extreme at once and recover slowly; a row without values keeps them."""
    def fold(state, times, columns):
        lower, upper = state if state is not None else (np.nan, np.nan)
        lows, highs = np.empty(len(times)), np.empty(len(times))
        for i, (x, y) in enumerate(zip(*map(np.ndarray.tolist, columns), strict=True)):
            if x == x:
                lower = x if lower != lower or x < lower else lower * (1 - alpha) + x * alpha
            if y == y:
                upper = y if upper != upper or y > upper else upper * (1 - alpha) + y * alpha
            lows[i], highs[i] = lower, upper
        return (lower, upper), [lows, highs]

    return fold


def gap_fold(interval: float) -> Fold:
    """Sampling slots missed before each row: ceil(late / interval)."""
    def fold(state, times, columns):
        before = np.concatenate([[state[0] if state is not None else np.nan], times[:-1]])
        late = times - before - interval
        return (times[-1],), [np.nan_to_num(np.ceil(np.maximum(late, 0) / interval))]

    return fold
