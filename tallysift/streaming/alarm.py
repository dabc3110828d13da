"""The alarm state machine on Structured Streaming: one state a camera, frames in order within a batch.

The batch form is ``operators.windows.alarm_batch``; both apply the same step to the frames of a key in order of
(ts, frame_idx). Frames that come later than the watermark are dropped by the engine.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallysift.operators.windows import COOLDOWN, DANGER, WARNING

OUT = "camera string, frame_idx bigint, ts timestamp, hit boolean, count int, cooldown int, level string"


def step(count: int, cooldown: int, level: str, hit: bool) -> tuple[int, int, str]:
    """One detection frame; the same as ``windows.alarm_step``."""
    if hit:
        if cooldown:
            cooldown -= 1
        else:
            count += 1
        return count, cooldown, "danger" if count >= DANGER else level
    if count:
        cooldown = COOLDOWN
    count = max(0, count - 1)
    if not count:
        level = "safe"
    elif count >= WARNING:
        level = "warning"
    return count, cooldown, level


class Alarm(StatefulProcessor):
    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("alarm", "count int, cooldown int, level string", self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        count, cooldown, level = self.state.get() if self.state.exists() else (0, 0, "safe")
        frames = pd.concat(list(rows)).sort_values(["ts", "frame_idx"], kind="stable")
        out = []
        for idx, ts, hit in zip(frames["frame_idx"], frames["ts"], frames["hit"], strict=True):
            count, cooldown, level = step(count, cooldown, level, bool(hit))
            out.append((key[0], idx, ts, bool(hit), count, cooldown, level))
        self.state.update((count, cooldown, level))
        yield pd.DataFrame(out, columns=["camera", "frame_idx", "ts", "hit", "count", "cooldown", "level"])

    def close(self) -> None:
        pass


def confident(detections, least: float = 0.5, wanted: int = 0):
    """Whether a frame has a detection of the wanted class with at least this score."""
    return F.coalesce(F.exists(detections, lambda d: (d["class_id"] == wanted) & (d["score"] >= least)), F.lit(False))


def alarm_stream(frames: DataFrame, delay: str = "10 seconds", idle_ms: int | None = None) -> DataFrame:
    """A row a frame of the stream (camera, frame_idx, ts, hit), with the state after it.

    ``idle_ms`` drops the state of cameras without frames for so long, by processing time; a query with it
    runs batches without data too. Needs the RocksDB state store provider.
    """
    return (
        frames.withWatermark("ts", delay)
        .groupBy("camera")
        .transformWithStateInPandas(Alarm(idle_ms), outputStructType=OUT, outputMode="Append", timeMode="ProcessingTime" if idle_ms else "None")
    )


def hit_ratio(frames: DataFrame, denominator: str = "all") -> DataFrame:
    """(camera, hits, frames, ratio): frames with any detection over all frames, or over those inferred (detections not null)."""
    if denominator not in ("all", "inferred"):
        raise ValueError(denominator)
    base = F.count("*") if denominator == "all" else F.count("detections")
    hits = F.count_if(F.coalesce(F.size("detections"), F.lit(0)) > 0)
    return frames.groupBy("camera").agg(hits.alias("hits"), base.alias("frames"), F.try_divide(hits, base).alias("ratio"))
