"""The same operators on arriving files: candidate upserts per micro-batch, health per source as state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from listing_radar import schemas
from listing_radar.operators.candidates import upsert_candidates
from listing_radar.plans.radar import RadarCatalog, match
from listing_radar.streaming.state import BUCKETS, fold_batch, read_state

#: Width of the slices of time in which the runs of a busy source wait, and runs of a slice that are returned together.
SLICE_SECONDS, PIECE_ROWS = 3600, 10_000
#: A run as it waits.
PACKED = np.dtype([("us", "<i8"), ("run", "<i8"), ("success", "?"), ("items", "<i4")])


def radar_stream(spark: SparkSession, items_path: str, state_path: str, checkpoint: str, catalog: RadarCatalog,
                 now: Column, max_files: int = 1000, buckets: int = BUCKETS):
    """Match arriving feed items and fold each micro-batch into the candidate state.

    The state stands in hash buckets (see ``state``): a batch rewrites the buckets of its own candidates and commits by its
    manifest, so a batch that is run again after a failure changes nothing.
    """
    items = spark.readStream.schema(schemas.FEED_ITEMS).option("maxFilesPerTrigger", max_files).parquet(items_path)

    def fold(previous: DataFrame, matched: DataFrame) -> DataFrame:
        return upsert_candidates(previous, matched, [F.col("seq")]).select(*schemas.struct(schemas.CANDIDATES).names)

    def apply(batch: DataFrame, number: int) -> None:
        fold_batch(batch.sparkSession, state_path, number, match(batch, catalog, now), "id", schemas.CANDIDATES, fold, buckets)

    writer = items.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.start()


def candidate_state(spark: SparkSession, state_path: str) -> DataFrame:
    """The candidates after the newest committed batch."""
    return read_state(spark, state_path, schemas.CANDIDATES)


class HealthProcessor(StatefulProcessor):
    """Counters of one source; runs of a micro-batch are taken in event order.

    Runs that come in more than one Arrow batch are filed by slices of their time and folded one slice after the other, so a task
    holds the runs of one source in one slice. A run that is not later than the last one folded is late: it changes nothing and is
    returned with the counters as they are and the status ``late``.
    """

    def __init__(self, slice_seconds: int = SLICE_SECONDS):
        self.slice_us = slice_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("health", "failures int, empties int, had_data boolean, last_us bigint, last_run bigint")
        self.waiting = handle.getMapState("waiting", "slice bigint, part int", "runs binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        counters = list(self.state.get()) if self.state.exists() else [0, 0, False, -(2**63), -(2**63)]
        first, parts = None, {}
        for number, frame in enumerate(rows):
            runs = _packed(frame)
            if number == 0:
                first = runs
                continue
            for some in ([first, runs] if number == 1 else [runs]):
                self._file(some, parts)
        if not parts:
            if first is not None and len(first):
                yield self._fold(key[0], first, counters)
        else:
            for time in sorted(parts):
                names = [(time, part) for part in range(parts[time])]
                runs = np.concatenate([np.frombuffer(self.waiting.getValue(name)[0], dtype=PACKED) for name in names])
                for name in names:
                    self.waiting.removeKey(name)
                yield from self._pieces(key[0], runs, counters)
        self.state.update(tuple(counters))

    def _file(self, runs: np.ndarray, parts: dict[int, int]) -> None:
        times = runs["us"] // self.slice_us
        for time in np.unique(times).tolist():
            self.waiting.updateValue((time, parts.get(time, 0)), (runs[times == time].tobytes(),))
            parts[time] = parts.get(time, 0) + 1

    def _pieces(self, source, runs: np.ndarray, counters: list) -> Iterator[pd.DataFrame]:
        runs = np.sort(runs, order=["us", "run"])
        for lo in range(0, len(runs), PIECE_ROWS):
            yield self._fold(source, runs[lo : lo + PIECE_ROWS], counters)

    def _fold(self, source, runs: np.ndarray, counters: list) -> pd.DataFrame:
        failures, empties, had_data, last_us, last_run = counters
        out = []
        for us, run, success, items in np.sort(runs, order=["us", "run"]).tolist():
            if (us, run) <= (last_us, last_run):
                out.append((source, run, failures, empties, "late"))
                continue
            if not success:
                failures += 1
                status = "failing" if failures >= 2 else "degraded"
            else:
                failures = 0
                empties = empties + 1 if items == 0 else 0
                status = "degraded" if items == 0 and empties >= 2 and had_data else "healthy"
                had_data = had_data or items > 0
            last_us, last_run = us, run
            out.append((source, run, failures, empties, status))
        counters[:] = failures, empties, had_data, last_us, last_run
        return pd.DataFrame(out, columns=HEALTH_COLUMNS)

    def close(self) -> None:
        pass


def _packed(frame: pd.DataFrame) -> np.ndarray:
    """Runs as (time in microseconds, number, success, items)."""
    out = np.zeros(len(frame), dtype=PACKED)
    times = pd.to_datetime(frame["checked_at"])
    out["us"] = times.to_numpy(dtype="datetime64[us]").astype(np.int64)
    out["run"], out["success"], out["items"] = frame["run_id"], frame["success"], frame["items_read"]
    return out


HEALTH_COLUMNS = ["source_id", "run_id", "consecutive_failures", "consecutive_empty_runs", "status"]
HEALTH_ROWS = (
    "source_id string, run_id bigint, consecutive_failures int, consecutive_empty_runs int, status string")


def health_stream(runs: DataFrame, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Counters after every run of a stream of source runs (``schemas.SOURCE_RUNS``)."""
    return runs.groupBy("source_id").transformWithStateInPandas(
        HealthProcessor(slice_seconds), HEALTH_ROWS, outputMode="Update", timeMode="None")

