import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from probewise.functions import boxes
from probewise.operators import detections as det

SCHEMA = "image_id long, face_index long, bbox array<double>, det_score double"


def loop_nms(rows, iou):
    """Greedy suppression, box by box."""
    kept = []
    for image, face, b, score in sorted(rows, key=lambda r: (r[0], -r[3], r[1])):
        clear = True
        for other_image, _, o, _ in kept:
            if other_image == image:
                w, h = min(b[2], o[2]) - max(b[0], o[0]), min(b[3], o[3]) - max(b[1], o[1])
                shared = max(w, 0) * max(h, 0)
                total = (b[2] - b[0]) * (b[3] - b[1]) + (o[2] - o[0]) * (o[3] - o[1]) - shared
                clear = clear and shared / (total + 1e-6) <= iou
        if clear:
            kept.append((image, face, b, score))
    return sorted((r[0], r[1]) for r in kept)


def random_boxes(n, images, seed, spread=60.0):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        x, y, w, h = rnd.uniform(0, spread), rnd.uniform(0, spread), rnd.uniform(5, 25), rnd.uniform(5, 25)
        box = [x, y, x + w, y + h]
        if rows and rnd.random() < 0.2:
            box = rows[-1][2]
        rows.append((rnd.choice([0] * images + list(range(images))), i, box, round(rnd.random(), 1)))
    rows.append((0, n, [3.0, 3.0, 3.0, 9.0], 0.5))
    rows.append((0, n + 1, [3.0, 3.0, 3.0, 9.0], 0.4))
    return rows


@pytest.mark.parametrize("iou", [0.0, 0.3, 0.4])
def test_nms_equals_the_loop(spark, iou):
    rows = random_boxes(300, 6, 2)
    found = det.nms(spark.createDataFrame(rows, SCHEMA).repartition(5), iou)
    assert sorted((r["image_id"], r["face_index"]) for r in found.collect()) == loop_nms(rows, iou)


@pytest.mark.parametrize("iou, doubtful, tiles, spread", [(0.4, 2000, 4, 60.0), (0.3, 5, 8, 60.0), (0.0, 2000, 3, 300.0), (0.4, 3, 2, 5.0)])
def test_crowded_images_in_tiles(spark, monkeypatch, iou, doubtful, tiles, spread):
    monkeypatch.setattr(det, "MOST_DOUBTFUL", doubtful)
    monkeypatch.setattr(det, "TILES", tiles)
    rows = random_boxes(160, 4, 5, spread)
    found = det.nms(spark.createDataFrame(rows, SCHEMA), iou, crowded=40)
    assert sorted((r["image_id"], r["face_index"]) for r in found.collect()) == loop_nms(rows, iou)


@pytest.mark.parametrize("rounds", [0, 1, 2])
def test_rounds_are_bounded(spark, monkeypatch, rounds):
    """What the rounds leave undecided is settled beside what they kept."""
    monkeypatch.setattr(det, "ROUNDS", rounds)
    monkeypatch.setattr(det, "MOST_DOUBTFUL", 4)
    monkeypatch.setattr(det, "BLOCK", 8)
    monkeypatch.setattr(det, "TILES", 4)
    rows = random_boxes(160, 4, 9)
    found = det.nms(spark.createDataFrame(rows, SCHEMA), 0.3, crowded=40)
    assert sorted((r["image_id"], r["face_index"]) for r in found.collect()) == loop_nms(rows, 0.3)


@pytest.mark.parametrize("batch", [1, 3, 50])
def test_images_over_several_batches(spark, batch):
    rows = random_boxes(250, 5, 4)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = det.nms(spark.createDataFrame(rows, SCHEMA), 0.3).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted((r["image_id"], r["face_index"]) for r in found) == loop_nms(rows, 0.3)


def test_pairs_in_slices(monkeypatch):
    rows = np.array([b for _, _, b, _ in random_boxes(200, 1, 7)])
    held = det.BoxList()
    for at in range(0, 100, 30):
        held.extend(rows[at : min(at + 30, 100)])
    whole = held.overlaps(rows[100:], 0.3)
    monkeypatch.setattr(det, "PAIRS", 150)
    assert held.n == 100 and (held.overlaps(rows[100:], 0.3) == whole).all()
    assert (whole == det.overlap_of(rows[100:], rows[:100], 0.3).any(axis=1)).all()


GATE = "bbox array<double>, det_score double, width int, height int, blur double"


@pytest.mark.parametrize(
    "row, reason",
    [
        (([0.0, 0.0, 50.0, 50.0], 0.4, None, None, None), "low_score"), ((None, 0.9, None, None, None), "missing_box"),
        (([0.0, 0.0, 10.0, 50.0], 0.9, None, None, None), "small_box"), (([0.0, 0.0, 50.0, 50.0], 0.9, None, None, None), None),
        (([200.0, 0.0, 250.0, 50.0], 0.9, 100, 100, 99.0), "empty_crop"), (([0.0, 0.0, 20.0, 20.0], 0.9, 200, 200, 99.0), "small_area"),
        (([0.0, 0.0, 50.0, 50.0], 0.9, 100, 100, 1.0), "blurry"), (([0.0, 0.0, 50.0, 50.0], 0.9, 100, 100, 50.0), None),
        (([-0.5, 0.5, 49.5, 50.5], 0.5, 100, 100, 50.0), None),
    ],
)
def test_quality_gate(spark, row, reason):
    df = spark.createDataFrame([row], GATE)
    assert det.quality_gate(df, 0.5, 20, 0.05, 10.0).first()["reject_reason"] == reason


def test_gate_without_limits_checks_the_score_only(spark):
    df = spark.createDataFrame([(None, 0.9, None, None, None)], GATE)
    assert det.quality_gate(df, 0.5).first()["reject_reason"] is None


def test_picks(spark):
    rows = [(1, 0, [0.0, 0.0, 2.0, 2.0], 0.9), (1, 1, [0.0, 0.0, 3.0, 3.0], 0.1), (1, 2, [1.0, 1.0, 4.0, 4.0], 0.5), (2, 0, None, 0.2)]
    df = spark.createDataFrame(rows, SCHEMA)

    def picked(policy):
        return {r["image_id"]: (r["face_index"], r["faces"]) for r in det.pick_detection(df, policy).collect()}

    assert picked("largest") == {1: (1, 3), 2: (0, 1)}
    assert picked("largest_scored") == {1: (2, 3), 2: (0, 1)}
    assert picked("best") == {1: (0, 3), 2: (0, 1)}
    images = spark.createDataFrame([(1,), (2,), (3,)], "image_id long")
    status = {r["image_id"]: r["status"] for r in det.single_face_status(images, df).collect()}
    assert status == {1: "multiple_faces", 2: "ok", 3: "no_face"}


def test_box_geometry(spark):
    df = spark.createDataFrame([([10.0, 10.0, 20.0, 30.0], 100, 35)], "b array<double>, w int, h int")

    def value(column):
        return df.select(column).first()[0]

    assert value(boxes.box_area("b")) == 200.0
    assert value(boxes.expand_box("b", 0.5, "w", "h")) == [5.0, 0.0, 25.0, 35.0]
    assert value(boxes.scale_box("b", 2.0, 0.5)) == [20.0, 5.0, 40.0, 15.0]
    assert value(boxes.scale_box(F.array(F.lit(1.0)), 2.0, 0.5)) is None
    assert value(boxes.center_box("w", "h")) == [32.0, 0.0, 67.0, 35.0]
    sx, sy = boxes.encoded_scale(F.lit(640), F.lit(481), 320)
    assert (value(sx), value(sy)) == (2.0, 481 / 240)
    assert value(boxes.encoded_scale(F.lit(100), F.lit(50), 320)[0]) == 1.0
