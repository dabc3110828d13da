"""Guards that fail, banded searches against nested loops, sinks and trained heads."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tallysift.operators import head, isolate, neardup, proposals, quality, sweep, validate, windows
from tallysift.session import discard, scratch, settle
from tallysift.sources import readers, sinks


def test_key_guards(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, a int")
    b = spark.createDataFrame([("x", 3), ("y", 4)], "k string, b int")
    assert validate.joined({"a": a, "b": b}, "k").count() == 2
    with pytest.raises(validate.KeySetsDiffer, match="b: 1 missing, 0 repeated"):
        validate.joined({"a": a, "b": b.limit(1)}, "k")
    with pytest.raises(validate.KeySetsDiffer, match="b: 0 missing, 2 repeated"):
        validate.joined({"a": a, "b": b.unionByName(b)}, "k")
    with pytest.raises(validate.KeySetsDiffer, match="1 names have no label"):
        validate.restricted(a.filter("k = 'x'"), b, "k")
    with pytest.raises(validate.KeySetsDiffer, match="2 keys occur more than once"):
        validate.union_of_splits({"train": a, "val": a}, "k")
    with pytest.raises(ValueError, match="2 distinct names instead of 3"):
        quality.require_distinct(a, "k", 3)


def test_frozen_values(spark):
    labels = spark.createDataFrame([("a.jpg", 1), ("b.jpg", 0)], "name string, label int")
    whole = validate.freeze(labels, labels, labels, "name", "label")
    row = whole.first()
    assert row["ok"] and row["universe"] == 2 and row["positives"] == 1
    validate.require_frozen(whole, whole)
    with pytest.raises(ValueError, match="positives: 1 is now 2"):
        validate.require_frozen(whole, whole.withColumn("positives", F.lit(2)))
    pair = labels.unionByName(spark.createDataFrame([("A.jpg", 1)], labels.schema))
    assert not validate.freeze(pair, pair, pair, "name", "label").first()["ok"]


def test_verdict_of_whole_predictions(spark):
    truth = spark.createDataFrame([("a", 1), ("b", 0)], "image_name string, truth int")
    good = truth.select("image_name", F.col("truth").alias("label"), F.lit(None).cast("string").alias("problem"))
    rows = validate.verdict(good, truth.select("image_name"), truth).collect()
    assert {(r["policy"], r["verdict"], r["f1"]) for r in rows} == {("strict", "PASS", 1.0), ("intersection", "PASS", 1.0)}
    assert all(r["ok"] for r in validate.submission_checks(good, truth, "image_name", "label").collect())


def test_json_numbers_prefer_the_root(spark):
    texts = [("f", '{"a": [{"precision": 0.1}], "PRECISION": 0.5, "b": {"recall": "x", "c": {"recall": 2}}}'), ("g", "no json"), ("h", None), ("i", "[1]")]
    frame = spark.createDataFrame(texts, "file string, content string")
    assert {(r["file"], r["key"], r["value"]) for r in validate.json_numbers(frame).collect()} == {("f", "precision", 0.5), ("f", "recall", 2.0)}


def test_isolated_rows(spark):
    frame = spark.createDataFrame([("a", 1), ("b", 0)], "name string, v int")
    done = isolate.run_isolated(frame, lambda r: 1.0 / r["v"], "name", "inference", index="v")
    good, bad = isolate.split_results(done)
    assert [tuple(r) for r in good.collect()] == [("a", 1.0, 1)]
    assert bad.first()["exception_type"] == "ZeroDivisionError" and bad.first()["stage"] == "inference"
    with pytest.raises(ValueError):
        isolate.run_isolated(frame, None, "name", "elsewhere")


def test_bands_equal_nested_loop(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        h = rng.getrandbits(64)
        for j in range(3):
            rows.append((3 * i + j, (h ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(12)))) - (1 << 63)))
    frame = spark.createDataFrame(rows, "id long, h long")
    for distance in (0, 3, 8, 12):
        pairs = lambda banded: {tuple(r) for r in neardup.hamming_pairs(frame, frame, distance, banded).collect()}  # noqa: E731, B023
        assert pairs(True) == pairs(False)
    left, right = frame.filter("id % 3 = 0"), frame.filter("id % 3 > 0")
    for distance in (8, 64):
        near = lambda banded: {tuple(r) for r in neardup.nearest(left, right, distance, banded).collect()}  # noqa: E731, B023
        assert near(True) == near(False)
    assert neardup.equal_bands(8, 100) == 1 < neardup.equal_bands(8, 10**8)


def test_gates_fail(spark):
    parts = spark.createDataFrame([(1, "holdout", 1), (2, "train", 0)], "id long, part string, label int")
    pairs = spark.createDataFrame([(1, 2, 0)], "a long, b long, d int")
    with pytest.raises(ValueError, match="cross_links: 1, floor 0; train_n: 1, floor 5"):
        neardup.require_gates(neardup.gates(parts, pairs, {"train": {"n": 5}, "holdout": {"pos": 1}}))
    neardup.require_gates(neardup.gates(parts, pairs.limit(0), {"train": {"n": 1}}))


def test_gaps_equal_pairs(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.randrange(60), rng.choice(("train", "val"))) for _ in range(200)] + [("c", 5, "val")]
    got = {r["base"]: tuple(r)[1:] for r in windows.sequence_gaps(spark.createDataFrame(rows, "base string, no long, side string"), "base", "no", "side").collect()}
    for base in "ab":
        gaps = [v - t for b, v, s in rows for c, t, u in rows if b == c == base and s == "val" and u == "train"]
        assert got[base] == (min(gaps), sum(g < 10 for g in gaps), sum(g < 50 for g in gaps))
    assert "c" not in got


def test_grid_sweep_at_thresholds(spark):
    rows = spark.createDataFrame([(i % 2, i / 1000) for i in range(1001)], "y int, s double")
    for r in sweep.grid_sweep(rows, "y", "s", 1001).collect():
        assert r["tp"] + r["fp"] == 1001 - r["step"]


def test_crops(spark):
    images = spark.createDataFrame([("a", 1, 200, 100), ("b", 0, 90, 120)], "k string, image_label int, width int, height int")
    side = "x1 double, y1 double, x2 double, y2 double"
    found = spark.createDataFrame([("a", 0.9, 0, 0.0, 0.0, 50.0, 50.0), ("a", 0.8, 1, 1.0, 1.0, 50.0, 50.0), ("b", 0.7, 0, 0.0, 0.0, 9.0, 9.0)], f"k string, confidence double, ordinal int, {side}")
    truth = spark.createDataFrame([("a", 0, (0.0, 0.0, 40.0, 50.0))], f"k string, number int, box struct<{side.replace(' double', ': double')}>")
    got = proposals.crop_manifest(images, found, truth, "k", n_tiles=3)
    kinds = {(r["k"], r["proposal_type"], r["label"]): r["n"] for r in got.groupBy("k", "proposal_type", "label").agg(F.count("*").alias("n")).collect()}
    assert kinds == {("a", "gt", 1): 1, ("a", "yolo", 1): 1, ("b", "yolo", 0): 1, ("b", "negative_tile", 0): 3}
    assert got.filter("proposal_type = 'negative_tile' and (x1 < 0 or y1 < 0 or x2 > 90 or y2 > 120)").count() == 0
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, proposals.crop_manifest(images.repartition(3), found, truth, "k", 3).collect()))


def test_label_folders_and_locks(spark, tmp_path):
    images = spark.createDataFrame([("a", "train"), ("b", "val")], "stem string, split string")
    labels = spark.createDataFrame([("a", "0 0.5 0.5 1 1")], "stem string, content string")
    folder = f"file://{tmp_path}/out"
    assert sinks.write_label_folders(images, labels, folder, ["fire"]) == {"train": 1, "val": 1}
    assert (tmp_path / "out/val/labels/b.txt").read_text() == "" and "nc: 1" in (tmp_path / "out/data.yaml").read_text()
    assert readers.label_boxes(spark, f"{folder}/train/labels").count() == 1
    sinks.write_once(labels, f"file://{tmp_path}/lock")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.write_once(labels, f"file://{tmp_path}/lock")
    with pytest.raises(ValueError, match="empty"):
        readers.require_rows(labels.limit(0), "scores")


def test_head(spark):
    rng = random.Random(3)
    rows = [([rng.gauss(2.0 if y else -2.0, 1.0), rng.gauss(0, 1)], y) for y in [1] * 150 + [0] * 30]
    frame = spark.createDataFrame(rows, "features array<double>, label int")
    scored = head.head_scores(head.train_head(frame), frame)
    right = scored.filter("(score >= 0.5) = (label = 1)").count()
    assert right >= 0.95 * len(rows) and scored.columns == ["features", "label", "score"]


def test_discarded_tables_are_gone(spark):
    t = settle(spark.range(3), "gone")
    assert t.count() == 3
    discard(t)
    with pytest.raises(Exception, match="(?i)not.*exist|not.*found"):
        spark.read.parquet(t._settled_at).count()
    assert scratch(spark, "x").startswith("file:")
