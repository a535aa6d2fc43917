"""State of the streaming twins: it is given back, and a finished key starts anew."""

import glob
import time

import pytest

from splatlake import fixtures as fx, queries
from splatlake.session import checkpoint_dir
from splatlake.streaming import jobs

DET = "scan_id string, label string, frame_index int, detection_id bigint, confidence double, x1 double, y1 double, x2 double, y2 double, width int, height int"


def box(scan, frame, ident):
    return (scan, "bed", frame, ident, 0.9, 10.0, 10.0, 60.0, 60.0, 640, 480)


def rows_of(folder, spark):
    return {(r.scan_id, r.detection_id): r.temp_track for r in spark.read.parquet(f"{folder}/out").collect()}


@pytest.mark.parametrize("scans", [3])
def test_state_falls_to_zero(spark, scans):
    d = spark.createDataFrame([box(f"s{i}", f, 100 * i + f) for i in range(scans) for f in (0, 8, 16)], DET)
    folder = jobs.job_folder(d, "expire")
    d.coalesce(1).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(d.schema).parquet(f"{folder}/in")
    q = jobs.associate(stream, idle_ms=1500).writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").option(
        "path", f"{folder}/out").trigger(processingTime="300 milliseconds").start()
    try:
        seen, end = [], time.time() + 90
        while time.time() < end and not (seen and max(seen) == scans and seen[-1] == 0):
            p = q.lastProgress
            if p is not None and p["stateOperators"]:
                seen.append(p["stateOperators"][0]["numRowsTotal"])
            time.sleep(0.2)
        assert max(seen) == scans and seen[-1] == 0
        # a late scan is tracked like any other, and a scan that goes on after its timer opens a track
        spark.createDataFrame([box("late", 0, 900), box("late", 8, 908), box("s0", 24, 24)], DET).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        got, end = {}, time.time() + 90
        while time.time() < end and len(got) < 3 * scans + 3:
            time.sleep(1)
            got = rows_of(folder, spark)
        assert got[("late", 900)] == got[("late", 908)] == 900 and got[("s0", 16)] == 0 and got[("s0", 24)] == 24
    finally:
        q.stop()


def test_counts_and_edits_keep_no_state(spark):
    d = spark.createDataFrame([("a", f, "bed") for f in range(0, 40, 4)] + [("b", 3, "bed"), ("b", 5, "desk")], "scan_id string, frame_index int, label string")
    folder = jobs.job_folder(d, "stateless")
    for scan in ("a", "b"):
        d.where(d.scan_id == scan).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out = jobs.run_available(stream, folder, "scan_id string, first_frame int, label string, n bigint", jobs.counters)
    got = {(r.scan_id, r.first_frame, r.label): r.n for r in out.collect()}
    assert got == {**{("a", b, "bed"): 2 for b in range(0, 40, 8)}, ("b", 0, "bed"): 1, ("b", 0, "desk"): 1}
    assert out.select("epoch").distinct().count() == 2


def test_stream_input_is_written_by_all_tasks(spark, sf):
    queries.load()
    before = set(glob.glob(f"{checkpoint_dir(spark)}/t3-*".removeprefix("file:")))
    out = queries.QUERIES["t3_detect_stream"](spark, sf)
    folder, = [f for f in set(glob.glob(f"{checkpoint_dir(spark)}/t3-*".removeprefix("file:"))) - before if "/t3-in-" in f]
    frames = [{(r.scan_id, r.frame_index) for r in spark.read.parquet(f).select("scan_id", "frame_index").distinct().collect()} for f in glob.glob(f"{folder}/*.parquet")]
    assert len(frames) == int(spark.conf.get("spark.sql.shuffle.partitions")) == 4
    assert sum(map(len, frames)) == len(set().union(*frames))  # a frame lies in one file, so in one micro-batch
    whole = jobs.detect(fx.view(spark, sf, "fx_detections")).select("scan_id", "detection_id", "label")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, whole.collect()))


def test_detect_evaluates_the_gates_once(spark, monkeypatch):
    d = spark.createDataFrame([("s", 8 * (i % 5), i, "bed", "canonical", 0.9, 10.0 * i, 10.0, 10.0 * i + 60, 60.0, 640, 480) for i in range(20)],
                              "scan_id string, frame_index int, detection_id bigint, label string, prompt_kind string, confidence double, x1 double, y1 double, x2 double, y2 double, width int, height int")
    seen = spark.sparkContext.accumulator(0)
    counted = d.rdd.map(lambda r: (seen.add(1), r)[1]).toDF(d.schema)
    assert jobs.detect(counted).count() == 20
    assert seen.value == 20
