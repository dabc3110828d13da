"""Operators against straightforward Python on random inputs."""

from __future__ import annotations

import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallysift.functions import scalar
from tallysift.operators import blocks, components, neardup, proposals, quality, sweep, validate, windows
from tallysift.operators.components import connected_components
from tallysift.session import settle
from tallysift.streaming import alarm


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(500 + i, 501 + i) for i in range(60)] + [(900, 900), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {r["node"]: r["root"] for r in got} == {x: find(x) for x in list(parent)}
    assert len(got) == len(parent)
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_banded_join_equals_nested_loop(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(120)]
    close = [b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(1, 10))) & ((1 << 64) - 1) for b in base[:60]]
    rows = [(i, h - (1 << 64) if h >= 1 << 63 else h) for i, h in enumerate(base + close)]
    table = spark.createDataFrame(rows, "id long, h long")
    slow = sorted(map(tuple, neardup.hamming_pairs(table, table, 8, banded=False).collect()))
    fast = sorted(map(tuple, neardup.hamming_pairs(table, table, 8, banded=True).collect()))
    assert slow == fast and slow


def near_hashes(spark):
    """Rows (id, h, side): some near each other, one hash twice, one row without hash; 0 to 9 bits are flipped."""
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(90)]
    values = base + [h ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(10))) for h in base * 2]
    rows = [(i * 7 % 271, h - (1 << 64) if h >= 1 << 63 else h, "val" if i % 5 == 0 else "train") for i, h in enumerate(values)]
    return rows + [(500, None, "train")]


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(blocks, "LEAST", 32)
    monkeypatch.setattr(blocks, "TILE", (4, 16))
    monkeypatch.setattr(blocks, "BATCH", 8)


def brute_groups(rows, distance):
    root = {r[0]: r[0] for r in rows}
    near = [(a, b) for a, h, _ in rows for b, g, _ in rows if a < b and h is not None and g is not None and bin((h ^ g) & (1 << 64) - 1).count("1") <= distance]
    changed = True
    while changed:
        changed = False
        for a, b in near:
            least = min(root[a], root[b])
            changed |= root[a] != least or root[b] != least
            root[a] = root[b] = least
    return root, near


@pytest.mark.parametrize("few", [1, 50_000])
def test_groups_by_blocks_equal_brute_force(spark, small_blocks, monkeypatch, few):
    monkeypatch.setattr(blocks, "FEW_ROWS", few)
    rows = near_hashes(spark)
    table = spark.createDataFrame(rows, "id long, h long, side string")
    for distance in (4, 20):
        got = neardup.near_groups(table, distance).collect()
        assert sorted(map(tuple, got)) == sorted(brute_groups(rows, distance)[0].items())


def test_pairs_by_blocks_are_rows_of_no_join(spark, small_blocks):
    # a join of all pairs, or of all that agree in three bits by chance, is what failed by time at 1 GB
    table = spark.createDataFrame(near_hashes(spark), "id long, h long, side string")
    found = neardup.hamming_pairs(table, table, 20)
    assert "NestedLoop" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "Generate explode(array(" not in plan
    assert {tuple(r)[:2] for r in found.collect()} == set(brute_groups(near_hashes(spark), 20)[1])
    assert not neardup.spares(20, 100_000) and not neardup.spares(22, 100_000_000) and neardup.spares(4, 100_000)


def test_closest_groups_and_gates_by_blocks_equal_pairs(spark, small_blocks):
    rows = near_hashes(spark)[:-1]
    groups, _ = brute_groups(rows, 4)
    table = spark.createDataFrame([(i, h, groups[i], ("holdout", "train", "calibration", "quarantine")[i % 4], i % 2) for i, h, _ in rows], "id long, h long, root long, part string, label int")
    for distance in (18, 22):
        pairs = settle(neardup.hamming_pairs(table, table, distance), "pairs")
        for most in (1, 8):
            assert neardup.closest_near_groups(table, distance, most).collect() == neardup.closest_groups(table.select("id", "root"), pairs, most).collect()
        floors = {"holdout": {"n": 10, "pos": 500}}
        assert sorted(neardup.near_gates(table, distance, floors).collect()) == sorted(neardup.gates(table, pairs, floors).collect())


def iou(a, b):
    w, h = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
    area = lambda c: max(0, c[2] - c[0]) * max(0, c[3] - c[1])
    union = area(a) + area(b) - w * h
    return w * h / union if union > 0 else 0.0


def test_nms(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for k in range(25):
        boxes = []
        for i in range(20):
            x, y = rng.randrange(30), rng.randrange(30)
            boxes.append((round(rng.random(), 1), i, float(x), float(y), float(x + rng.randrange(0, 40)), float(y + rng.randrange(0, 40))))
        rows += [(k, c, i, *b) for c, i, *b in boxes]
        kept = []
        for c, i, *b in sorted(boxes, key=lambda z: -z[0]):
            if len(kept) < 8 and all(iou(b, o) < 0.8 for _, o in kept):
                kept.append((i, b))
        want[k] = [i for i, _ in kept]
    table = spark.createDataFrame(rows, "k int, confidence double, ordinal int, x1 double, y1 double, x2 double, y2 double")
    got = {r["k"]: [b["ordinal"] for b in r["kept"]] for r in proposals.greedy_nms(table, "k").collect()}
    assert got == want


def test_alarm_batch_equals_steps(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for k in range(12):
        state, level = (0, 0), "safe"
        for t in range(150):
            hit = rng.random() < (0.2 + 0.05 * k)
            rows.append((k, t, hit))
            c, cd, level = alarm.step(*state, level, hit)
            state = (c, cd)
        want[k] = (150, *state, level)
    got = windows.alarm_batch(spark.createDataFrame(rows, "k int, t int, hit boolean"), "k", ["t"], "hit").collect()
    assert {r["k"]: tuple(r)[1:] for r in got} == want


def test_sweep_equals_naive(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(2), round(rng.random(), 2)) for _ in range(400)]
    got = {r["threshold"]: (r["tp"], r["fp"], r["fn"], r["tn"]) for r in sweep.threshold_sweep(spark.createDataFrame(rows, "y int, s double"), "y", "s").collect()}
    for t in {s for _, s in rows}:
        c = defaultdict(int)
        for y, s in rows:
            c[y, s >= t] += 1
        assert got[t] == (c[1, True], c[0, True], c[1, False], c[0, False])


def test_greedy_until(spark):
    rng = random.Random(6)
    clusters = [(i, *(lambda p, n: (p + n, p, n))(rng.randrange(4), rng.randrange(1, 4))) for i in range(60)]
    floors = {"n": 50, "pos": 20, "neg": 20}
    want, held = set(), dict.fromkeys(floors, 0)
    for root, n, pos, neg in sorted(clusters, key=lambda c: (-c[1], c[0])):
        if all(held[k] >= v for k, v in floors.items()):
            break
        want.add(root)
        for k, v in (("n", n), ("pos", pos), ("neg", neg)):
            held[k] += v
    got = neardup.greedy_until(spark.createDataFrame(clusters, "root int, n int, pos int, neg int"), floors)
    assert {r["root"] for r in got.collect()} == want


def test_keys_and_validation(spark):
    names = ["a.jpg", "../evil.jpg", "x/y.jpg", " b.jpg", "", "photo.jpg", "PHOTO.jpg", "ghost.jpg", "IMG_0.JPG"]
    predicted = spark.createDataFrame([(n, 1, None) for n in names], "image_name string, label int, problem string")
    expected = spark.createDataFrame([("a.jpg",), ("photo.jpg",), ("img_0.jpg",), ("lost.jpg",)], "image_name string")
    found = {(r["stage"], r["code"], r["key"]) for r in validate.validate(predicted, expected).collect()}
    assert ("keys", "path_traversal_or_separator", "../evil.jpg") in found
    assert ("keys", "path_traversal_or_separator", "x/y.jpg") in found
    assert ("keys", "key_whitespace", " b.jpg") in found
    assert ("keys", "key_not_bare_filename", "") in found
    assert ("keys", "case_pair", "photo.jpg") in found
    assert ("coverage", "missing", "lost.jpg") in found
    assert ("coverage", "extra", "ghost.jpg") in found
    assert ("coverage", "case_mismatch", "IMG_0.JPG") in found


def test_strict_labels_encoding(spark):
    files = spark.createDataFrame([("bad", bytearray(b'{"a\xff": 1}')), ("bom", bytearray(b'\xef\xbb\xbf{"a": 1}')), ("ok", bytearray(b'{"a": 1}'))], "file string, content binary")
    got = {r["file"]: (r["image_name"], r["label"], r["problem"]) for r in validate.strict_labels(files).collect()}
    assert got == {"bad": (None, None, "encoding"), "bom": (None, None, "bom"), "ok": ("a", 1, None)}


def test_geometry(spark):
    b = F.struct(F.lit(10.0).alias("x1"), F.lit(20.0).alias("y1"), F.lit(15.0).alias("x2"), F.lit(30.0).alias("y2"))
    e = spark.range(1).select(scalar.expanded_box(b, F.lit(100), F.lit(25), 0.5, 8).alias("e")).first()["e"]
    # side 20, cut to 25 high: centre (12.5, 25) moved into the image; 2.5 rounds to 2
    assert tuple(e) == (2, 5, 22, 25)
    rest = spark.range(1).select(scalar.float_list(F.lit("0.1, ,0.2")).alias("f"), scalar.file_stem(F.lit("/a/b.c.png")).alias("s")).first()
    assert (rest["f"], rest["s"]) == ([0.1, 0.2], "b.c")
    pixels = [float(x) for y in range(8) for x in range(9, 0, -1)]
    assert spark.range(1).select(scalar.difference_hash(F.lit(pixels)).alias("h")).first()["h"] == -1


def test_early_stop(spark):
    rows = [(1, e, x) for e, x in enumerate([5.0, 4.0, 4.0 - 1e-7, 4.1, 4.2, 1.0])]
    r = windows.early_stop(spark.createDataFrame(rows, "k int, e int, l double"), "k", "e", "l", patience=3).first()
    assert (r["best_epoch"], r["best_loss"], r["stop_epoch"]) == (1, 4.0, 4)


def test_random_split_size(spark):
    keys = spark.range(3)
    assert quality.random_split(keys, "id").filter("side = 'val'").count() == 1


def test_small_components_are_one_task_a_round(spark, monkeypatch):
    """Graphs of few edges are not dealt out to all partitions in each round; larger ones are, with equal results."""
    settle, parts = components.settle, []

    def counted(df, name):
        out = settle(df, name)
        parts.append(sum(f.endswith(".parquet") for f in os.listdir(out._settled_at.removeprefix("file://").removeprefix("file:"))))
        return out

    monkeypatch.setattr(components, "settle", counted)
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "5"}
    before = {k: spark.conf.get(k) for k in conf}
    edges = spark.createDataFrame([(i, i + 1) for i in range(60) if i % 20 != 19] + [(90, 90), (None, 3)], "src long, dst long")
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        found = []
        for few in (components.FEW, 0):
            monkeypatch.setattr(components, "FEW", few)
            found.append(({(r["node"], r["root"]) for r in components.connected_components(edges).collect()}, parts[1:]))
            parts.clear()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found[0][0] == found[1][0] == {(i, i // 20 * 20) for i in range(60)} | {(90, 90)}
    assert set(found[0][1]) == {1} and max(found[1][1]) > 1
