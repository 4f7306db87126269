"""Boxes as ``array<double>`` columns ``[x1, y1, x2, y2]``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from probewise.functions.vectors import as_column


def corners(box: Column | str) -> tuple[Column, Column, Column, Column]:
    box = as_column(box)
    return tuple(F.get(box, F.lit(i)) for i in range(4))


def has_box(box: Column | str) -> Column:
    """True for a box of four values or more; false for a short or missing one."""
    return F.coalesce(F.size(as_column(box)) >= 4, F.lit(False))


def box_width(box: Column | str) -> Column:
    x1, _, x2, _ = corners(box)
    return F.greatest(F.lit(0.0), x2 - x1)


def box_height(box: Column | str) -> Column:
    _, y1, _, y2 = corners(box)
    return F.greatest(F.lit(0.0), y2 - y1)


def box_area(box: Column | str) -> Column:
    """Area; 0 for a missing box."""
    return F.when(has_box(box), box_width(box) * box_height(box)).otherwise(0.0)


def expand_box(box: Column | str, margin: float, width: Column | str, height: Column | str) -> Column:
    """Grow by ``margin`` of each side and clip to the image; short boxes are kept.

    Without an image size the far corner, which it clips, is null.
    """
    box = as_column(box)
    if margin <= 0:
        return box
    x1, y1, x2, y2 = corners(box)
    dx, dy = box_width(box) * margin, box_height(box) * margin
    wide, high = as_column(width).cast("double"), as_column(height).cast("double")
    grown = F.array(
        F.greatest(F.lit(0.0), x1 - dx),
        F.greatest(F.lit(0.0), y1 - dy),
        F.when(wide.isNotNull(), F.least(wide, x2 + dx)),
        F.when(high.isNotNull(), F.least(high, y2 + dy)),
    )
    return F.when(has_box(box), grown).otherwise(box)


def scale_box(box: Column | str, sx: Column | float, sy: Column | float) -> Column:
    """Rescale; null unless the box has exactly four values."""
    x1, y1, x2, y2 = corners(box)
    sx, sy = (F.lit(s) if isinstance(s, (int, float)) else s for s in (sx, sy))
    return F.when(F.size(as_column(box)) == 4, F.array(x1 * sx, y1 * sy, x2 * sx, y2 * sy))


def center_box(width: Column | str, height: Column | str) -> Column:
    """Largest centred square of an image; its corners are null without a size."""
    width, height = as_column(width).cast("long"), as_column(height).cast("long")
    side = F.when(width.isNotNull() & height.isNotNull(), F.least(width, height))
    x1 = F.floor((width - side) / 2)
    y1 = F.floor((height - side) / 2)
    return F.array(*[c.cast("double") for c in (x1, y1, x1 + side, y1 + side)])


def clipped_crop(box: Column | str, width: Column | str, height: Column | str) -> Column:
    """Whole-pixel crop inside the image; null if it is empty."""
    x1, y1, x2, y2 = (F.bround(c, 0).cast("long") for c in corners(box))
    zero = F.lit(0).cast("long")
    left, top = F.greatest(zero, x1), F.greatest(zero, y1)
    right = F.least(as_column(width).cast("long"), x2)
    bottom = F.least(as_column(height).cast("long"), y2)
    return F.when(has_box(box) & (right > left) & (bottom > top), F.array(left, top, right, bottom))


def encoded_scale(width: Column | str, height: Column | str, max_width: int) -> tuple[Column, Column]:
    """Factors from the shrunk image sent for search back to the source frame."""
    # fixed value: 160 is the smallest width an image is shrunk to
    limit = max(160, max_width)
    width, height = as_column(width).cast("double"), as_column(height).cast("double")
    shrunk_height = F.greatest(F.lit(1.0), F.floor(height * (F.lit(float(limit)) / width)).cast("double"))
    small = width <= limit
    return F.when(small, 1.0).otherwise(width / limit), F.when(small, 1.0).otherwise(height / shrunk_height)
