"""Lookups of pages, rows and words for a table of keys: one join for all keys, instead of a query for each.

``pages`` (rev, page_no, width, height, start_offset), ``rows`` (rev, page_no, row_no, rect, start_offset) and ``words`` (rev, page_no,
row_no, start_offset, end_offset, hyphenated_offset, rect). The columns of the keys stay in front; a key that finds nothing gives
no row, unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirespark.functions.geometry import overlap, rectangle, scaled_to, union_of
from quirespark.operators.layout import as_of, on_pixels


def pages_numbered(pages: DataFrame, keys: DataFrame) -> DataFrame:
    """The page of each ``(rev, page_no)``."""
    return keys.join(pages, ["rev", "page_no"])


def rows_numbered(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The row of each ``(rev, page_no, row_no)``."""
    return keys.join(rows, ["rev", "page_no", "row_no"])


def by_id(table: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """The page, row or word of each id."""
    return keys.join(table, key)


def rows_starting(rows: DataFrame, words: DataFrame, keys: DataFrame) -> DataFrame:
    """The row that holds the word that begins at each ``(rev, offset)``."""
    place = words.select("rev", F.col("start_offset").alias("offset"), "page_no", "row_no")
    return keys.join(place, ["rev", "offset"]).join(rows, ["rev", "page_no", "row_no"])


def pages_of_words(pages: DataFrame, words: DataFrame, keys: DataFrame) -> DataFrame:
    """The page that holds the word that begins at each ``(rev, offset)``."""
    place = words.select("rev", F.col("start_offset").alias("offset"), "page_no")
    return keys.join(place, ["rev", "offset"]).join(pages, ["rev", "page_no"])


def physical_pages(found: DataFrame, pages: DataFrame) -> DataFrame:
    """``found`` (rev, start_offset, text, ...) with ``page_no``: that of the last page that begins there, or -1.

    Between two numbers that leave some out come rows with the missing numbers, the offset of the later page and no text.
    """
    last = pages.groupBy("rev", "start_offset").agg(F.max("page_no").alias("page_no"))
    numbered = found.join(last, ["rev", "start_offset"], "left").withColumn("page_no", F.coalesce("page_no", F.lit(-1)))
    order = Window.partitionBy("rev").orderBy("start_offset").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.last(F.when(F.col("page_no") >= 0, F.col("page_no")), True).over(order), F.lit(-1))
    gaps = numbered.withColumn("__before", before).where("__before >= 0 and page_no - __before > 1")
    rest = [c for c in found.columns if c not in ("rev", "start_offset", "text")]
    missing = gaps.select("rev", "start_offset", F.explode(F.sequence(F.col("__before") + 1, F.col("page_no") - 1)).alias("page_no")).withColumn("text", F.lit(""))
    missing = missing.withColumns({c: F.lit(None).cast(found.schema[c].dataType) for c in rest})
    return numbered.select(*found.columns, "page_no").unionByName(missing.select(*found.columns, "page_no"))


def highlight_rects(words: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows ``(keys..., part, rect)``: the word at or after each ``(rev, offset)``, and the second half of one cut at a line's end."""
    place = words.select("rev", "start_offset", F.struct("page_no", "hyphenated_offset", "rect").alias("word"))
    first = as_of(keys, place, ["rev"], "offset", "start_offset", "word", forward=True).where("word is not null")
    halves = first.where("word.hyphenated_offset is not null").select(*keys.columns, F.col("word.hyphenated_offset").alias("__at"))
    second = as_of(halves, place, ["rev"], "__at", "start_offset", "word", forward=True).where("word is not null")
    both = first.withColumn("part", F.lit(0)).unionByName(second.drop("__at").withColumn("part", F.lit(1)))
    return both.select(*keys.columns, "part", F.col("word.page_no").alias("page_no"), F.col("word.rect").alias("rect"))


def image_snippets(spans: DataFrame, highlights: DataFrame, pages: DataFrame, images: DataFrame, margin: int = 5, extra: int = 2) -> DataFrame:
    """Rows ``(rev, span, page_no, crop, highlights)`` in pixels of the page's image.

    ``spans`` (rev, span, page_no, rect) has the rows of each snippet, ``highlights`` (rev, span, rect) its words, ``images`` (rev,
    page_no, image_width, image_height) the size of each image. The crop is the rows' box with a margin, within the image; the
    words' boxes are relative to the crop, with a little margin of their own, within it.
    """
    boxes = spans.groupBy("rev", "span", "page_no").agg(union_of("rect").alias("box")).join(pages.select("rev", "page_no", "width", "height"), ["rev", "page_no"]).join(images, ["rev", "page_no"])
    sized = boxes.withColumns({"sx": F.col("image_width") / F.col("width"), "sy": F.col("image_height") / F.col("height")})
    scaled = sized.withColumn("box", scaled_to("box", F.col("sx"), F.col("sy")))
    crops = scaled.withColumn("crop", _clipped(F.col("box.left") - margin, F.col("box.top") - margin, F.col("box.width") + 2 * margin, F.col("box.height") + 2 * margin, F.col("image_width"), F.col("image_height")))
    inside = highlights.join(crops.select("rev", "span", "crop", "sx", "sy"), ["rev", "span"]).withColumn("h", scaled_to("rect", F.col("sx"), F.col("sy")))
    shown = _clipped(F.col("h.left") - F.col("crop.left") - extra, F.col("h.top") - F.col("crop.top") - extra, F.col("h.width") + 2 * extra, F.col("h.height") + 2 * extra, F.col("crop.width"), F.col("crop.height"))
    marks = inside.withColumn("shown", shown).where("shown.width > 0 and shown.height > 0").groupBy("rev", "span").agg(F.sort_array(F.collect_list("shown")).alias("highlights"))
    return crops.select("rev", "span", "page_no", "crop").join(marks, ["rev", "span"], "left").withColumn("highlights", F.coalesce("highlights", F.array().cast(marks.schema["highlights"].dataType)))


def _clipped(left: F.Column, top: F.Column, width: F.Column, height: F.Column, wide: F.Column, high: F.Column) -> F.Column:
    """A rectangle's part within ``[0, wide) x [0, high)``."""
    a, b = F.greatest(left, F.lit(0)), F.greatest(top, F.lit(0))
    return rectangle(a.cast("int"), b.cast("int"), F.greatest(F.least(left + width, wide) - a, F.lit(0)).cast("int"), F.greatest(F.least(top + height, high) - b, F.lit(0)).cast("int"))


def image_responses(found: DataFrame, contents: DataFrame) -> DataFrame:
    """``found`` (of :func:`image_snippets`) with ``image``: the bytes of ``contents`` (rev, page_no, content) in base 64."""
    return found.join(contents.select("rev", "page_no", F.base64("content").alias("image")), ["rev", "page_no"], "left")


def suggested_rows(rows: DataFrame, suggestions: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows ``(doc_ref, page_no, row_no, rev, suggestion)``: the suggestions that share any area with a row."""
    met = rows.join(on_pixels(suggestions, pages), ["doc_ref", "page_no"]).where(overlap("rect", "by") > 0)
    return met.select("doc_ref", "page_no", "row_no", "rev", "suggestion")
