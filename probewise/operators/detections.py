"""Detected faces: quality gate, choice of a face, non-maximum suppression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probewise.functions.boxes import box_area, box_height, box_width, clipped_crop, has_box
from probewise.session import durable

# fixed values: small term that keeps an overlap ratio defined; tie-break weight
IOU_EPSILON = 1e-6
SCORE_WEIGHT = 1e-3

# boxes of an image that is cut into tiles, tiles per side, and undecided boxes
# of one tile that are looked at in a round
CROWDED = 20_000
TILES = 64
MOST_DOUBTFUL = 2_000
# rounds of a tile by tile suppression, and pairs of boxes that are compared at once
ROUNDS = 12
PAIRS = 1 << 18
# boxes of a tile that are judged together
BLOCK = 256
# boxes of an image that is compared together with other images
SMALL = 64
DROP, WAIT, KEEP = -1, 0, 1


def quality_gate(
    df: DataFrame,
    min_score: float,
    min_side: float = 0,
    min_area_ratio: float = 0.0,
    min_blur: float = 0.0,
) -> DataFrame:
    """Add ``reject_reason``: the first failed check, or null.

    Columns: ``bbox``, ``det_score``, ``width``, ``height``, ``blur``. The crop
    checks run only where the image size is known.
    """
    box, crop = F.col("bbox"), F.col("_crop")
    sized = F.col("width").isNotNull() & F.col("height").isNotNull()
    area = (crop[2] - crop[0]) * (crop[3] - crop[1])
    ratio = F.try_divide(area.cast("double"), (F.col("width") * F.col("height")).cast("double"))
    checks: list[tuple[Column, str]] = [(F.col("det_score") < min_score, "low_score")]
    if min_side > 0:
        checks.append((~has_box(box), "missing_box"))
        checks.append(((box_width(box) < min_side) | (box_height(box) < min_side), "small_box"))
    checks.append((sized & crop.isNull(), "empty_crop"))
    if min_area_ratio > 0:
        checks.append((sized & (ratio.isNull() | (ratio < min_area_ratio)), "small_area"))
    if min_blur > 0:
        checks.append((sized & (F.col("blur") < min_blur), "blurry"))
    reason = F.lit(None).cast("string")
    for failed, name in reversed(checks):
        reason = F.when(failed, name).otherwise(reason)
    # the crop is a column of its own, so it is computed once per row
    cropped = df.withColumn("_crop", clipped_crop(box, "width", "height"))
    return cropped.withColumn("reject_reason", reason).drop("_crop")


def pick_detection(df: DataFrame, policy: str = "largest") -> DataFrame:
    """One detection per image, with the number of faces found.

    ``largest`` takes the largest box, ``largest_scored`` lets the score break
    near ties, ``best`` takes the best score. Ties go to the first face.
    """
    ranking = {
        "largest": box_area("bbox"),
        "largest_scored": box_area("bbox") + F.col("det_score") * SCORE_WEIGHT,
        "best": F.col("det_score"),
    }[policy]
    best = F.min(F.struct((-ranking).alias("_r"), "face_index", F.struct("*").alias("row")))["row"]
    picked = df.groupBy("image_id").agg(best.alias("row"), F.count(F.lit(1)).alias("faces"))
    return picked.select("row.*", "faces")


def single_face_status(images: DataFrame, detections: DataFrame) -> DataFrame:
    """``ok``, ``no_face`` or ``multiple_faces`` for every image."""
    counts = detections.groupBy("image_id").agg(F.count(F.lit(1)).alias("faces"))
    faces = F.coalesce("faces", F.lit(0))
    status = F.when(faces == 0, "no_face").when(faces > 1, "multiple_faces").otherwise("ok")
    return images.select("image_id").distinct().join(counts, "image_id", "left").select(
        "image_id", faces.alias("faces"), status.alias("status")
    )


def merge_copies(df: DataFrame, iou: float) -> DataFrame:
    """Keep the best of the copies of one box: it overlaps the others fully,
    so they could never stay."""
    x1, y1, x2, y2 = (F.get("bbox", F.lit(i)) for i in range(4))
    area = (x2 - x1) * (y2 - y1)
    merges = area / (area + IOU_EPSILON) > iou
    copy_key = F.when(merges, F.lit(-1).cast("long")).otherwise(F.col("face_index").cast("long"))
    first = F.min(F.struct((-F.col("det_score")).alias("s"), F.col("face_index").alias("face_index")))
    return (
        df.groupBy("image_id", "bbox", copy_key.alias("_copy"))
        .agg(first.alias("b"))
        .select("image_id", F.col("b.face_index").alias("face_index"), "bbox", (-F.col("b.s")).alias("det_score"))
    )


def nms(df: DataFrame, iou: float = 0.4, crowded: int = CROWDED) -> DataFrame:
    """Greedy suppression of overlapping boxes per image.

    Rows ``(image_id, face_index, bbox, det_score)``; equal scores go to the
    smaller face index. An image is one sorted run of rows of which a task
    holds the kept boxes; images with more than ``crowded`` boxes are cut into
    tiles first.
    """
    boxes = durable(merge_copies(df, iou))
    sizes = boxes.groupBy("image_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > crowded)
    full = durable(sizes.select("image_id"))
    if full.isEmpty():
        return suppress_runs(boxes, iou)
    calm = suppress_runs(boxes.join(full, "image_id", "left_anti"), iou)
    return calm.unionByName(suppress_tiles(boxes.join(full, "image_id", "left_semi"), iou))


def suppress_runs(boxes: DataFrame, iou: float) -> DataFrame:
    """Each image as one sorted run; rows that are marked ``kept``, if there is such a column, stay and come first."""
    names = boxes.columns
    marked = boxes if "kept" in names else boxes.withColumn("kept", F.lit(False))

    def suppress(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        image, held = None, BoxList()
        for batch in batches:
            if not len(batch):
                continue
            rows, images, stays = corners(batch["bbox"]), batch["image_id"].to_numpy(), batch["kept"].to_numpy(dtype=bool).copy()
            ends = np.append(np.flatnonzero(images[1:] != images[:-1]) + 1, len(rows))
            starts = np.append(0, ends[:-1])
            # boxes of small images are compared with the best of their image, for all of these images at once
            fixed = np.add.reduceat(stays.astype(int), starts)
            small = (ends - starts <= SMALL) & (fixed == 0)
            small[[0, -1]] = False
            run = np.repeat(np.arange(len(starts)), ends - starts)
            left = np.flatnonzero(small[run])
            while len(left):
                best = np.append(True, run[left][1:] != run[left][:-1])
                chosen = left[best]
                stays[chosen] = True
                mine = chosen[np.cumsum(best) - 1]
                left = left[~best & ~row_overlap(rows[left], rows[mine], iou)]
            # the first image may have begun in an earlier batch, the last one may go on in the next
            for start, end in zip(starts[~small], ends[~small]):
                if images[start] != image:
                    image, held = images[start], BoxList()
                for at in range(start, end, BLOCK):
                    block = slice(at, min(at + BLOCK, end))
                    stays[block] = stay_of_block(rows[block], stays[block], held, iou)
            yield batch.loc[stays, names]

    order = ["image_id", F.col("kept").desc(), F.col("det_score").desc(), "face_index"]
    ordered = marked.repartition("image_id").sortWithinPartitions(*order)
    return ordered.mapInPandas(suppress, boxes.schema)


def suppress_tiles(boxes: DataFrame, iou: float) -> DataFrame:
    """The same result for crowded images, tile by tile in rounds.

    Overlapping boxes share a tile. A box is dropped if any of its tiles has a
    kept box over it, and kept if none of them has an undecided or kept better
    box over it. The best undecided box is always decided, and each round
    reads the undecided and the kept boxes only. What ``ROUNDS`` rounds leave
    undecided, chains of boxes over many tiles, is settled image by image.
    """
    corner = [F.get("bbox", F.lit(i)) for i in range(4)]
    ends = boxes.groupBy("image_id").agg(
        *[F.min(corner[i]).alias(f"_low{i}") for i in (0, 1)], *[F.max(corner[i + 2]).alias(f"_high{i}") for i in (0, 1)]
    )

    def tile(i: int, axis: int):
        low, high = F.col(f"_low{axis}"), F.col(f"_high{axis}")
        place = F.floor((corner[i] - low) / F.greatest(high - low, F.lit(IOU_EPSILON)) * TILES)
        return F.least(place, F.lit(TILES - 1))

    spans = {"tx1": tile(0, 0), "ty1": tile(1, 1), "tx2": tile(2, 0), "ty2": tile(3, 1)}
    placed = boxes.join(ends, "image_id").withColumns(spans).select(*boxes.columns, *spans)
    left = durable(placed.withColumn("kept", F.lit(False)))
    key, tiles = ["image_id", "face_index"], ["image_id", "tx", "ty"]
    schema = T.StructType([boxes.schema[name] for name in key] + [T.StructField("verdict", T.IntegerType())])

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, held, doubtful = None, BoxList(), BoxList()
        for batch in batches:
            if not len(batch):
                continue
            rows, fixed, alone = corners(batch["bbox"]), batch["kept"].to_numpy(dtype=bool), batch["alone"].to_numpy(dtype=bool)
            verdicts = np.zeros(len(batch), dtype=np.int32)
            places = batch[tiles].to_numpy()
            starts = np.append(np.flatnonzero(np.append(True, (places[1:] != places[:-1]).any(axis=1))), len(rows))
            for start, end in zip(starts[:-1], starts[1:]):
                current = tuple(places[start])
                if current != place:
                    place, held, doubtful = current, BoxList(), BoxList()
                for at in range(start, end, BLOCK):
                    block = slice(at, min(at + BLOCK, end))
                    verdicts[block] = judge_block(rows[block], fixed[block], alone[block], held, doubtful, iou)
            yield batch[key].assign(verdict=verdicts)

    for _ in range(ROUNDS):
        if left.where("NOT kept").isEmpty():
            return left.select(*boxes.columns)
        copies = (
            left.withColumn("alone", (F.col("tx1") == F.col("tx2")) & (F.col("ty1") == F.col("ty2")))
            .withColumn("tx", F.explode(F.sequence("tx1", "tx2")))
            .withColumn("ty", F.explode(F.sequence("ty1", "ty2")))
        )
        ordered = copies.repartition(*tiles).sortWithinPartitions(*tiles, F.col("det_score").desc(), "face_index")
        verdicts = ordered.select(*tiles, "face_index", "bbox", "kept", "alone").mapInPandas(judge, schema)
        decided = verdicts.groupBy(*key).agg(F.min("verdict").alias("verdict"))
        judged = left.drop("kept").join(decided, key).where(F.col("verdict") != DROP)
        left = durable(judged.withColumn("kept", F.col("verdict") == KEEP).drop("verdict"))
    return suppress_runs(left.select(*boxes.columns, "kept"), iou).select(*boxes.columns)


def stay_of_block(rows: np.ndarray, fixed: np.ndarray, held: BoxList, iou: float) -> np.ndarray:
    """Which of the next boxes of an image stay; these are added to its kept ones."""
    stays, among = fixed.copy(), overlap_of(rows, rows, iou)
    for i in np.flatnonzero(~fixed & ~held.overlaps(rows, iou)):
        stays[i] = not (among[i] & stays)[:i].any()
    held.extend(rows[stays])
    return stays


def judge_block(rows: np.ndarray, fixed: np.ndarray, alone: np.ndarray, held: BoxList, doubtful: BoxList, iou: float) -> np.ndarray:
    """The verdicts of the next boxes of a tile, which are added to its kept and its undecided ones."""
    covered, doubted = held.overlaps(rows, iou), doubtful.overlaps(rows, iou)
    among = overlap_of(rows, rows, iou)
    in_held, in_doubtful = np.zeros(len(rows), dtype=bool), np.zeros(len(rows), dtype=bool)
    verdicts, room = np.zeros(len(rows), dtype=np.int32), MOST_DOUBTFUL - doubtful.n
    for i in range(len(rows)):
        if fixed[i]:
            verdicts[i] = KEEP
        elif covered[i] or (among[i] & in_held).any():
            verdicts[i] = DROP
        elif room <= 0 or doubted[i] or (among[i] & in_doubtful).any():
            verdicts[i] = WAIT
        else:
            verdicts[i] = KEEP
        if verdicts[i] == KEEP and (fixed[i] or alone[i]):
            in_held[i] = True
        elif verdicts[i] != DROP and room > 0:
            in_doubtful[i] = True
            room -= 1
    held.extend(rows[in_held])
    doubtful.extend(rows[in_doubtful])
    return verdicts


def corners(boxes: pd.Series) -> np.ndarray:
    return np.stack(boxes.to_numpy()).astype(float)


def ratio_over(shared: np.ndarray, areas: np.ndarray, others: np.ndarray, iou: float) -> np.ndarray:
    return shared / (areas + others - shared + IOU_EPSILON) > iou


def area_of(rows: np.ndarray) -> np.ndarray:
    return (rows[:, 2] - rows[:, 0]) * (rows[:, 3] - rows[:, 1])


def row_overlap(rows: np.ndarray, others: np.ndarray, iou: float) -> np.ndarray:
    """Whether each box overlaps the one at its place in ``others``."""
    sides = np.maximum(np.minimum(rows[:, 2:], others[:, 2:]) - np.maximum(rows[:, :2], others[:, :2]), 0)
    return ratio_over(sides[:, 0] * sides[:, 1], area_of(rows), area_of(others), iou)


def overlap_of(rows: np.ndarray, others: np.ndarray, iou: float) -> np.ndarray:
    """Whether each box overlaps each of ``others``."""
    wide = np.minimum(rows[:, None, 2], others[None, :, 2]) - np.maximum(rows[:, None, 0], others[None, :, 0])
    high = np.minimum(rows[:, None, 3], others[None, :, 3]) - np.maximum(rows[:, None, 1], others[None, :, 1])
    return ratio_over(np.maximum(wide, 0) * np.maximum(high, 0), area_of(rows)[:, None], area_of(others)[None, :], iou)


class BoxList:
    """Growing list of boxes that answers which of other boxes overlap one of them."""

    def __init__(self) -> None:
        self.rows, self.n = np.empty((16, 4)), 0

    def extend(self, boxes: np.ndarray) -> None:
        if self.n + len(boxes) > len(self.rows):
            self.rows = np.concatenate([self.rows[: self.n], np.empty((self.n + len(boxes), 4))])
        self.rows[self.n : self.n + len(boxes)] = boxes
        self.n += len(boxes)

    def overlaps(self, boxes: np.ndarray, iou: float) -> np.ndarray:
        """For each box, ``PAIRS`` pairs at a time."""
        out = np.zeros(len(boxes), dtype=bool)
        step = max(1, PAIRS // max(len(boxes), 1))
        for at in range(0, self.n, step):
            open_ = np.flatnonzero(~out)
            out[open_] = overlap_of(boxes[open_], self.rows[at : min(at + step, self.n)], iou).any(axis=1)
        return out
