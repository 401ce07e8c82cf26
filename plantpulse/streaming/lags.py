"""Clock-validated lags on a stream: the last few readings of a unit are its state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from plantpulse.functions.tags import epoch_micros
from plantpulse.operators.windows import TOLERANCE, lag_column

# Rows that are handed on at once.
CHUNK = 10_000
# Microseconds since the epoch, whatever the session's time zone.
STAMP = "epoch_us"


class LagProcessor(StatefulProcessor):
    """Readings of one (unit, time bucket): list state of the newest ones, dropped by a timer.

    A micro-batch's rows come in pieces; of each only the columns are kept, as arrays.  They
    are then consumed in time order, ``CHUNK`` rows at a time, each piece carrying on from the
    readings before it.
    """

    def __init__(self, columns: list[str], lags: list[int], step_minutes: float, bucket_s: int):
        self.columns, self.lags, self.step, self.bucket_s = columns, lags, step_minutes, bucket_s
        self.names = [lag_column(columns[3], k) for k in lags]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", "stamp double, value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        unit, time, seq, target = self.columns
        pieces = [
            (piece[time].to_numpy(), piece[seq].to_numpy(), piece[target].to_numpy(dtype=np.float64),
             piece[STAMP].to_numpy(dtype=np.float64)) for piece in rows
        ]
        when, number, value, stamp = (np.concatenate(column) for column in zip(*pieces))
        # Rows of the bucket before are only there to be looked back at.
        home = np.floor(stamp / 1_000_000 / self.bucket_s)
        order = np.lexsort((number, stamp))
        if not self.kept.exists():
            ends = (int(key[1]) + 1) * self.bucket_s * 1000
            self.handle.registerTimer(max(ends, timerValues.getCurrentWatermarkInMs() + 1))
        before = [(row[0], row[1]) for row in self.kept.get()] if self.kept.exists() else []
        times, values = (np.array([b[i] for b in before], dtype=np.float64) for i in (0, 1))
        newest = times[-1] if len(times) else -np.inf
        for at in range(0, len(order), CHUNK):
            some = order[at:at + CHUNK]
            late = stamp[some] < newest
            out = {unit: [key[0]] * len(some), time: when[some], seq: number[some], target: value[some]}
            lagged, times, values = self._lagged(times, values, stamp[some][~late], value[some][~late])
            for name, found in zip(self.names, lagged):
                out[name] = np.full(len(some), np.nan)
                out[name][~late] = found
            own = home[some] == key[1]
            if own.any():
                yield pd.DataFrame(out)[own]
        self.kept.put([(float(t), float(v)) for t, v in zip(times, values)])

    def _lagged(self, times, values, stamps, readings):
        """Lags of the new readings, and the newest readings of all."""
        seen = len(times)
        times, values = np.concatenate([times, stamps]), np.concatenate([values, readings])
        found = []
        for k in self.lags:
            lagged = np.full(len(times), np.nan)
            minutes = (times[k:] - times[:-k]) / 60e6
            due = k * self.step
            ok = (minutes >= due * (1 - TOLERANCE)) & (minutes <= due * (1 + TOLERANCE))
            lagged[k:][ok] = values[:-k][ok]
            found.append(lagged[seen:])
        depth = max(self.lags)
        return found, times[-depth:], values[-depth:]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        return iter(())

    def close(self) -> None:
        pass


def streaming_lags(
    stream: DataFrame, unit: str, time: str, seq: str, target: str, lags: list[int],
    step_minutes: float, delay: str = "1 day", bucket_s: int = 7 * 86_400,
) -> DataFrame:
    """(unit, time, seq, target, lag values): NULL where the clock check fails.

    Groups are (unit, time bucket) with the rows before a bucket copied into it, so a
    busy unit spreads over tasks when history is replayed.  State holds the last
    max(lags) readings and is dropped once the watermark has passed the bucket.  Rows
    are taken in time order within a micro-batch; one older than the newest kept
    reading has no valid neighbourhood and gets NULL lags.  The state needs the RocksDB
    store, which ``jobs.start_append`` asks for.
    """
    back_s = max(lags) * step_minutes * 60 * (1 + TOLERANCE)
    columns = [unit, time, seq, target]
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    second = epoch_micros(F.col(time)) / 1_000_000
    first, last = F.floor(second / bucket_s), F.floor((second + back_s) / bucket_s)
    spread = (
        stream.withWatermark(time, delay)
        .select(*columns, epoch_micros(F.col(time)).alias(STAMP), F.explode(F.sequence(first, last)).alias("_bucket"))
    )
    processor = LagProcessor(columns, list(lags), step_minutes, bucket_s)
    schema = ", ".join([f"{c} {kinds[c]}" for c in columns] + [f"{n} double" for n in processor.names])
    return spread.groupBy(unit, "_bucket").transformWithStateInPandas(
        processor, schema, outputMode="append", timeMode="EventTime"
    )
