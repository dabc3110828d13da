"""Sources, sinks and the stream."""

from __future__ import annotations

import datetime as dt
import json
import os

import pytest

from tallysift.sources import readers, sinks
from tallysift.streaming import alarm


def test_label_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("0 0.5 0.5 0.2 0.2\n1 0.1 0.1 0.1 0.1\nbroken\n")
    (tmp_path / "b.txt").write_text("")
    assert [(r["stem"], r["cls"], r["w"]) for r in readers.label_boxes(spark, str(tmp_path)).collect()] == [("a", 0, 0.2)]
    assert readers.label_boxes(spark, str(tmp_path), only_class=None).count() == 2


def test_label_maps_of_both_shapes(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a.jpg": 1, "b.jpg": {"label": 0}}')
    got = {r["image_name"]: r["label"] for r in readers.label_map(spark, str(tmp_path / "x.json")).collect()}
    assert got == {"a.jpg": 1, "b.jpg": 0}


def test_images(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name in ("a.JPG", "d/b.png", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "e.png").write_bytes(b"")
    assert {r["image_name"] for r in readers.list_images(spark, str(tmp_path)).collect()} == {"a.JPG", "b.png", "e.png"}
    assert {r["image_name"] for r in readers.list_images(spark, str(tmp_path), recursive=False).collect()} == {"a.JPG", "e.png"}
    assert {(r["image_name"], r["problem"]) for r in readers.preflight(spark, str(tmp_path)).collect()} >= {("e.png", "zero_byte"), ("a.JPG", "decode_failure")}
    (tmp_path / "d/a.JPG").write_bytes(b"y")
    with pytest.raises(ValueError, match="a.JPG"):
        readers.list_images(spark, str(tmp_path))


def test_coco_and_tables(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"images": [{"id": 1, "file_name": "a.jpg", "width": 10, "height": 5}], "annotations": [{"image_id": 1, "category_id": 7, "bbox": [1, 2, 3, 4]}], "categories": [{"id": 7, "name": "x"}, {"id": 3, "name": "y"}]}))
    images, notes, categories = readers.coco(spark, str(tmp_path / "c.json"))
    assert images.first()["width"] == 10 and notes.first()["h"] == 4.0
    assert {r["id"]: r["dense"] for r in categories.collect()} == {3: 0, 7: 1}
    (tmp_path / "s.csv").write_bytes("﻿image_name,image_path,label,score,prediction_best\na,p,1,0.5,\n".encode())
    row = readers.csv_table(spark, str(tmp_path / "s.csv"), readers.SCORES).first()
    assert (row["image_name"], row["score"], row["prediction_best"]) == ("a", 0.5, None)
    (tmp_path / "k.yaml").write_text("a: 1\n  b: 2\n# c: 3\nd: x:y\n")
    assert {tuple(r) for r in readers.key_values(spark, str(tmp_path / "k.yaml")).collect()} == {("a", "1"), ("d", "x:y")}
    (tmp_path / "m.txt").write_text("abc  name\nbroken\n")
    assert [tuple(r) for r in readers.sha_manifest(spark, str(tmp_path / "m.txt")).collect()] == [("abc", "name")]


def test_commit_whole_or_partial(spark, tmp_path):
    labels = spark.createDataFrame([("b.jpg", 0), ("a.jpg", 1)], "image_name string, label int")
    none = spark.createDataFrame([], "file string, stage string, exception_type string, message string, index int")
    path = str(tmp_path / "out.json")
    assert sinks.commit(labels, labels, none, path)
    assert list(json.loads(open(path).read())) == ["a.jpg", "b.jpg"]
    bad = spark.createDataFrame([sinks.failure("a.jpg", "inference", ValueError("x" * 300), 3)], none.schema)
    assert not sinks.commit(labels, labels, bad, str(tmp_path / "p.json"))
    assert not os.path.exists(tmp_path / "p.json") and os.path.exists(tmp_path / "p_PARTIAL.json")
    assert len(json.loads((tmp_path / "p_failures.json").read_text())[0]["message"]) == 200
    with pytest.raises(ValueError):
        sinks.failure("a", "other", ValueError())


def test_embedding_cache(spark, tmp_path):
    rows = spark.createDataFrame([("a", [0.5, 1.0])], "image_name string, features array<float>")
    sinks.write_embeddings(rows, str(tmp_path / "e"), "m", "train", 2, True)
    assert readers.embedding_cache(spark, str(tmp_path / "e"), "m", 1).count() == 1
    assert readers.embedding_cache(spark, str(tmp_path / "e"), "m", 2) is None
    assert readers.embedding_cache(spark, str(tmp_path / "none"), "m", 1) is None


def test_stream_equals_steps(spark, tmp_path):
    schema = "camera string, frame_idx long, ts timestamp, hit boolean"
    start = dt.datetime(2024, 1, 1)
    frames = [(c, i, start + dt.timedelta(seconds=i), (i * 7 + len(c)) % 5 < 3) for c in ("a", "bb") for i in range(40)]
    source = str(tmp_path / "in")
    spark.createDataFrame(frames, schema).coalesce(1).write.parquet(source)
    stream = alarm.alarm_stream(spark.readStream.schema(schema).parquet(source))
    q = stream.writeStream.format("memory").queryName("alarms").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(100)
    got = {(r["camera"], r["frame_idx"]): (r["count"], r["cooldown"], r["level"]) for r in spark.sql("select * from alarms").collect()}
    for camera in ("a", "bb"):
        state = (0, 0, "safe")
        for c, i, _, hit in frames:
            if c == camera:
                state = alarm.step(*state, hit)
                assert got[c, i] == state
