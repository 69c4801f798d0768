"""Readers of native files, sinks, model slots."""

import json

import numpy as np

from stridelake.sources import readers as R
from stridelake.sources import slots, tables
from stridelake.sources import writers as W


def write(path, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines))


def test_energy_files(spark, tmp_path):
    write(
        tmp_path / "a" / "stream_energy_optical_flow_mag_mean.jsonl",
        '{"window": 1, "energy": 0.5}', "", "not json", '{"window": "2", "energy": "0.7", "source": "given", "mode": null}', '{"window": 3}', '{"window": 1, "energy": 0.6}',
    )
    write(tmp_path / "b" / "stream_energy_quantized_l2_mean.jsonl", "")
    rows = R.energy_files(spark, str(tmp_path)).orderBy("line_id").collect()
    assert [(r["win_idx"], r["energy"], r["source"], r["mode"]) for r in rows] == [(1, 0.5, "optical_flow", "mag_mean"), (2, 0.7, "given", "mag_mean"), (1, 0.6, "optical_flow", "mag_mean")]


def test_segment_documents(spark, tmp_path):
    doc = {"video": "a.mp4", "segments": [{"start_sec": 0, "end_sec": 2.5, "label": "x"}], "segmentation_params": {"orig_fps": 30}}
    write(tmp_path / "a_segments.json", json.dumps(doc))
    write(tmp_path / "a_segments_noisy.json", json.dumps(doc | {"fps": 25, "segments": []}))
    write(tmp_path / "b_pred_segments.json", json.dumps({"video": "b", "segments": 7}))
    rows = {r["doc_kind"]: r for r in R.segment_documents(spark, str(tmp_path)).collect()}
    assert rows["gt"]["fps"] == 30 and rows["gt"]["segments"][0]["end_sec"] == 2.5
    assert rows["gt_noisy"]["fps"] == 25 and rows["gt_noisy"]["segments"] == []
    assert "pred" not in rows or rows["pred"]["segments"] is None


def test_listing_and_priority(spark, tmp_path):
    for n in ("x/A.MP4", "x/b.txt", "y/c.mov"):
        write(tmp_path / n, "1")
    assert R.listing(spark, str(tmp_path), [".mp4", ".mov"]).count() == 2
    f = spark.createDataFrame([("r/a/stream_energy_x_y.jsonl",), ("r/a/energy_split1.jsonl",), ("r/b/stream_energy_z_y.jsonl",)], "path string")
    got = {r["folder"]: r["path"] for r in R.by_priority(f, ["stream_energy_q_", "energy_split1"]).collect()}
    assert got == {"r/a": "r/a/energy_split1.jsonl", "r/b": "r/b/stream_energy_z_y.jsonl"}


def test_paired(spark):
    f = spark.createDataFrame([("codes/d/a.codes.json",), ("codes/d/b.codes.json",)], "path string")
    v = spark.createDataFrame([("codes/d/a.mp4",), ("other/a.mp4",), ("other/b.mp4",)], "path string")
    got = {r["path"]: r["video"] for r in R.paired(f, v, "videos").collect()}
    assert got == {"codes/d/a.codes.json": "codes/d/a.mp4", "codes/d/b.codes.json": "other/b.mp4"}


def test_writers(spark, tmp_path):
    seg = spark.createDataFrame([("a", 2.0, 3.0), ("a", 0.0, 1.0)], "path string, start_sec double, end_sec double")
    doc = json.loads(W.segment_documents(seg).first()["json"])
    assert [(s["start_sec"], s["label"]) for s in doc["segments"]] == [(0.0, "segment_0"), (2.0, "segment_1")]
    out = str(tmp_path / "t")
    assert W.write_missing(seg, out, ["path", "start_sec"]) == 2
    assert W.write_missing(seg, out, ["path", "start_sec"]) == 0
    W.write_jsonl(seg, str(tmp_path / "j"), ["path"])
    W.write_report(seg, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2 and spark.read.option("header", True).csv(str(tmp_path / "r")).count() == 2


def test_slot(spark):
    rows = [("a", 0, [[1.0, -1.0]], False), ("a", 1, [[3.0, 4.0]], False), ("a", 2, [[3.0, 4.0]], True), ("a", 3, [], False)]
    df = spark.createDataFrame(rows, "path string, win long, features array<array<double>>, gated boolean")
    got = {r["win"]: r for r in slots.encode_windows(df, slots.FakeEncoder, gate="gated").collect()}
    assert got[1]["energy"] == 5.0 and got[2]["energy"] == 0.0 and got[2]["codes"] is None and got[3]["error"]


def test_track_source(spark, tmp_path):
    np.savez(tmp_path / "f.npz", **{"agent/tracks": np.arange(24.0).reshape(2, 2, 3, 2), "agent/vis": np.ones((2, 2, 3))})
    spark.dataSource.register(slots.TracksSource)
    df = spark.read.format("track_tensors").option("files", str(tmp_path / "f.npz")).load()
    assert df.count() == 12 and df.agg({"pt_col": "max"}).first()[0] == 23.0


def test_materialise(spark):
    df = tables.materialise(spark.range(5))
    assert df.count() == 5 and "stridelake-" in df.inputFiles()[0]


def test_demo_source(spark, tmp_path):
    np.savez(tmp_path / "d.npz", **{"demo_0/actions": np.ones((3, 2)), "demo_0/joint_states": np.zeros((3, 2)), "demo_0/gripper_states": np.full((3, 1), 9.0)})
    spark.dataSource.register(slots.DemosSource)
    df = spark.read.format("demo_steps").option("files", str(tmp_path / "d.npz")).load()
    assert df.count() == 3 and df.first()["proprio"] == [0.0, 0.0, 9.0]


def test_entry(spark, data):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["path", "i0", "i1", "start_sec", "end_sec"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
