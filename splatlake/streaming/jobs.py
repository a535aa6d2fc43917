"""Structured Streaming twins of the ordered operators.

Sinks write one folder per micro-batch, so a repeated batch overwrites itself; results are read
back as tables.  Folders live in the shared checkpoint location.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from splatlake import config as cfg
from splatlake.operators import detections as de
from splatlake.operators.tracks import OpenTracks
from splatlake.operators.video import Continuity
from splatlake.session import checkpoint_dir, cut


def timer(idle_ms: int | None) -> str:
    """Timers run in jobs with a continuous trigger; Spark starts batches without end while they are on, so a drained job has none."""
    return GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout


def job_folder(df: DataFrame, name: str) -> str:
    return os.path.join(checkpoint_dir(df.sparkSession), f"{name}-{uuid.uuid4().hex}")


def run_available(stream: DataFrame, folder: str, schema: str, write: Callable[[DataFrame], DataFrame] | None = None, mode: str = "append") -> DataFrame:
    """Drain what is available, one idempotent output folder per batch, and read the result."""
    def sink(batch: DataFrame, epoch: int) -> None:
        out = batch if write is None else write(batch)
        out.write.mode("overwrite").parquet(f"{folder}/out/epoch={epoch}")

    q = (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(sink).start())
    q.awaitTermination()
    return stream.sparkSession.read.schema(schema + ", epoch int").parquet(f"{folder}/out")


def select_frames(frames: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Continuity frames of arriving video frames; state per scan is five thumbnails at most.

    With ``idle_ms`` a scan that is silent for so long counts as finished and leaves no state; the timer is its
    own, so scans that start late lose nothing.  If it goes on after that, it starts anew.
    """
    def step(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        c = Continuity()
        if state.exists:
            last, looks = state.get
            c.last_id = last
            c.recent.extend(np.array(t) for t in looks)
        rows = pd.concat(list(batches)).sort_values("frame_id")
        saved = [c.add(int(r.frame_id), r.thumb) for r in rows.itertuples(index=False)]
        state.update((c.last_id, [t.tolist() for t in c.recent]))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield rows.loc[saved, ["scan_id", "frame_id"]]

    return frames.groupBy("scan_id").applyInPandasWithState(
        step, "scan_id string, frame_id int", "last bigint, looks array<array<double>>", "append", timer(idle_ms))


def associate(detections: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Track ids for arriving anchor detections; state per (scan, label) is its open tracks.

    Tracks close by the frames of their own scan and label, at the longest gap a track may bridge.  With
    ``idle_ms`` a (scan, label) that is silent for so long gives up its state, and a detection after that opens a track.
    """
    def step(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        t = OpenTracks()
        if state.exists:
            t.tracks = [[int(i), int(f), tuple(b)] for i, f, b in zip(*state.get)]
        rows = pd.concat(list(batches)).sort_values(["frame_index", "confidence", "detection_id"], ascending=[True, False, True])
        ids = [t.add(r.frame_index, (r.x1, r.y1, r.x2, r.y2), r.detection_id, r.width, r.height) for r in rows.itertuples(index=False)]
        state.update(([int(i) for i, _, _ in t.tracks], [int(f) for _, f, _ in t.tracks], [[float(x) for x in b] for _, _, b in t.tracks]))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield rows.assign(temp_track=ids)[["scan_id", "label", "detection_id", "temp_track"]]

    return detections.groupBy("scan_id", "label").applyInPandasWithState(
        step, "scan_id string, label string, detection_id bigint, temp_track bigint", "ids array<bigint>, frames array<bigint>, boxes array<array<double>>", "append", timer(idle_ms))


def detect(batch: DataFrame) -> DataFrame:
    """Gates and suppression of one micro-batch; a frame's detections arrive together.

    What a step keeps is materialised, as the next one reads it several times.
    """
    kept = cut(de.gate(batch).where("accepted"))
    kept = cut(de.nms(kept).where("suppressed_by IS NULL").drop("suppressed_by"))
    kept = cut(de.drop_generic(kept).where("suppressed_by IS NULL").drop("suppressed_by"))
    return de.drop_conflicts(kept).where("conflict_reason IS NULL").drop("conflict_reason", "conflict_with")


def counters(detections: DataFrame, frames: int = cfg.ANCHOR_STRIDE) -> DataFrame:
    """Detections per scan, block of ``frames`` frames and label.

    Counts of micro-batches add up, so a job writes those of each batch and keeps no state; a frame
    index is a clock of its own scan, and no watermark closes blocks of scans that start late.
    """
    first = (F.floor(F.col("frame_index") / frames) * frames).cast("int")
    return detections.groupBy("scan_id", first.alias("first_frame"), "label").agg(F.count("*").alias("n"))


def latest_per_key(rows: DataFrame, keys: list[str], columns: list[str], order: str) -> DataFrame:
    """Last write per key; the last of the last writes of all micro-batches is the last one, so a job needs no state."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("r"), F.max(order).alias(order)).select(*keys, order, "r.*")
