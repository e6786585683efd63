"""Rectangles as Column expressions. A rectangle is a struct of left, top, width and height."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRID = 10000


def rectangle(left: Column, top: Column, width: Column, height: Column) -> Column:
    return F.struct(left.alias("left"), top.alias("top"), width.alias("width"), height.alias("height"))


def union_of(rect: str) -> Column:
    """The bounding box of a group's rectangles, as an aggregate."""
    left, top = F.min(f"{rect}.left"), F.min(f"{rect}.top")
    right, bottom = F.max(F.col(f"{rect}.left") + F.col(f"{rect}.width")), F.max(F.col(f"{rect}.top") + F.col(f"{rect}.height"))
    return rectangle(left, top, right - left, bottom - top)


def overlap(a: str, b: str) -> Column:
    """The area two rectangles share."""
    wide = F.least(F.col(f"{a}.left") + F.col(f"{a}.width"), F.col(f"{b}.left") + F.col(f"{b}.width")) - F.greatest(F.col(f"{a}.left"), F.col(f"{b}.left"))
    high = F.least(F.col(f"{a}.top") + F.col(f"{a}.height"), F.col(f"{b}.top") + F.col(f"{b}.height")) - F.greatest(F.col(f"{a}.top"), F.col(f"{b}.top"))
    return F.greatest(wide, F.lit(0)) * F.greatest(high, F.lit(0))


def covered(word: str, by: str) -> Column:
    """The share of a word's area that another rectangle covers."""
    area = F.col(f"{word}.width") * F.col(f"{word}.height")
    return F.when(area > 0, overlap(word, by) / area).otherwise(F.lit(0.0))


def scaled_to(rect: str, across: Column, down: Column) -> Column:
    """A rectangle on another scale, each number cut to a whole one."""
    return rectangle(*((F.col(f"{rect}.{side}") * by).cast("int") for side, by in (("left", across), ("top", down), ("width", across), ("height", down))))


def to_grid(value: Column, size: Column) -> Column:
    """Pixels to the page-relative grid, cut to whole numbers."""
    return F.floor(value.cast("long") * GRID / size).cast("int")


def from_grid(value: Column, size: Column) -> Column:
    """The grid to pixels, rounded."""
    return F.floor(value.cast("long") * size / GRID + 0.5).cast("int")


def padded(rect: str, by: int, width: Column, height: Column) -> Column:
    """A crop with a margin, clipped to the page."""
    left, top = F.greatest(F.col(f"{rect}.left") - by, F.lit(0)), F.greatest(F.col(f"{rect}.top") - by, F.lit(0))
    right, bottom = F.least(F.col(f"{rect}.left") + F.col(f"{rect}.width") + by, width), F.least(F.col(f"{rect}.top") + F.col(f"{rect}.height") + by, height)
    return rectangle(left, top, right - left, bottom - top)
