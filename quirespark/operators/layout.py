"""Pages, rows and words with their offsets, and lookups between them."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirespark.functions.geometry import covered, from_grid, overlap, rectangle, to_grid, union_of
from quirespark.functions.text import broken
from quirespark.languages import PLAIN, Language


def flattened(pieces: DataFrame) -> DataFrame:
    """Word rows with running offsets from ordered pieces.

    ``pieces``: rev, ref_length, page_no, block_no, line_no, ord, kind (word, space, hyphen), content, rect. A line ends with a
    newline, a block with one more; the text begins after the reference and its newline. One window over a document's pieces.
    """
    document = Window.partitionBy("rev").orderBy("page_no", "block_no", "line_no", "ord")
    following = F.struct(F.lead("page_no").over(document), F.lead("block_no").over(document), F.lead("line_no").over(document))
    last_of_line = F.coalesce(following != F.struct("page_no", "block_no", "line_no"), F.lit(True)) | F.lead("line_no").over(document).isNull()
    last_of_block = F.coalesce((F.lead("page_no").over(document) != F.col("page_no")) | (F.lead("block_no").over(document) != F.col("block_no")), F.lit(True))
    size = F.length("content") + last_of_line.cast("int") + last_of_block.cast("int")
    sized = pieces.withColumn("size", size).withColumn("start_offset", (F.col("ref_length") + 1 + F.coalesce(F.sum("size").over(document.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).cast("int"))
    return sized.withColumn("end_offset", F.col("start_offset") + F.length("content")).drop("size")


def lines(docs: DataFrame, ref: str = "doc_ref", text: str = "text") -> DataFrame:
    """Rows ``(doc_ref, row_no, line, start_offset, end_offset)`` of a text's lines; offsets are of code points from 0."""
    cut = docs.select(F.col(ref).alias("doc_ref"), F.posexplode(F.split(text, "\n", -1)).alias("row_no", "line"))
    before = Window.partitionBy("doc_ref").orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("int")
    return cut.withColumn("start_offset", start).withColumn("end_offset", F.col("start_offset") + F.length("line"))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, offset: str, value: str, forward: bool = False, strict: bool = False) -> DataFrame:
    """``left`` with the ``value`` of the last row of ``right`` at or before ``at`` (or the first at or after), by ``keys``.

    The two are laid on one line by a union, and a window carries the nearest value on: one exchange on the keys, no band join.
    ``strict`` leaves out rows of ``right`` at the very offset.
    """
    side = 1 if strict != forward else 0
    mine = left.select(*keys, F.col(at).alias("__at"), F.lit(1 - side if not forward else 1 - side).alias("__side"), F.struct(*left.columns).alias("__left"), F.lit(None).cast(right.schema[value].dataType).alias("__value"))
    other = right.select(*keys, F.col(offset).alias("__at"), F.lit(side).alias("__side"), F.lit(None).cast(mine.schema["__left"].dataType).alias("__left"), F.col(value).alias("__value"))
    order = Window.partitionBy(*keys).orderBy("__at", "__side")
    if forward:
        near = F.first("__value", True).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    else:
        near = F.last("__value", True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return mine.unionByName(other).withColumn("__near", near).where("__left is not null").select("__left.*", F.col("__near").alias(value))


def rows_between(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """The rows from the one that begins at ``from_offset`` to the last that begins before ``to_offset``, on one page.

    ``rows``: rev, page_no, row_no, start_offset. ``spans``: rev, span, from_offset, to_offset. The ends are found as of their
    offsets; the band between them is an equality on the page with a range inside it.
    """
    first = spans.join(rows.select("rev", F.col("start_offset").alias("from_offset"), "page_no", F.col("row_no").alias("first_row")), ["rev", "from_offset"])
    place = rows.select("rev", "start_offset", F.struct("page_no", "row_no").alias("last_place"))
    ended = as_of(first, place, ["rev"], "to_offset", "start_offset", "last_place", strict=True)
    on_page = ended.where(F.col("last_place.page_no") == F.col("page_no")).select("rev", "span", "page_no", "first_row", F.col("last_place.row_no").alias("last_row"))
    return rows.join(on_page, ["rev", "page_no"]).where(F.col("row_no").between(F.col("first_row"), F.col("last_row"))).select("span", *rows.columns)


def word_groups(words: DataFrame, keys: tuple[str, ...] = ("rev",)) -> DataFrame:
    """``words`` (rev, start_offset, end_offset) with ``group_no``: words that touch are one group."""
    order = Window.partitionBy(*keys).orderBy("start_offset")
    new = F.coalesce(F.col("start_offset") != F.lag("end_offset").over(order), F.lit(True)).cast("int")
    return words.withColumn("__new", new).withColumn("group_no", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__new")


def group_text(words: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows ``(rev, group_no, start_offset, end_offset, text)`` of the groups, cut from the documents' text.

    A document's groups meet its text as one array, so the text travels once, not with each of them.
    """
    spans = word_groups(words).groupBy("rev", "group_no").agg(F.min("start_offset").alias("start_offset"), F.max("end_offset").alias("end_offset"))
    own = spans.groupBy("rev").agg(F.collect_list(F.struct("group_no", "start_offset", "end_offset")).alias("__groups"))
    cut = F.transform("__groups", lambda x: F.struct(x["group_no"].alias("group_no"), x["start_offset"].alias("start_offset"), x["end_offset"].alias("end_offset"), F.substring(F.col("__text"), x["start_offset"] + 1, x["end_offset"] - x["start_offset"]).alias("text")))
    return own.join(docs.select("rev", F.col("text").alias("__text")), "rev").select("rev", F.inline(cut))


def words_in_row_of(words: DataFrame, spans: DataFrame) -> DataFrame:
    """All words of the row that holds the first word at or after each ``offset`` of ``spans`` (rev, offset)."""
    place = words.select("rev", "start_offset", F.struct("page_no", "row_no").alias("place"))
    found = as_of(spans, place, ["rev"], "offset", "start_offset", "place", forward=True).where("place is not null")
    return words.join(found.select("rev", "offset", F.col("place.page_no").alias("page_no"), F.col("place.row_no").alias("row_no")), ["rev", "page_no", "row_no"])


def suggestion_rows(words: DataFrame, docs: DataFrame, pages: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows of the table of suggestions: ``asked`` (rev, offset, suggestion, ...) with the words that each would replace.

    That is the group of touching words at or after the offset: ``previous_text``, ``start_offset``, ``page_no`` and ``grid``, the
    group's box on the page-relative grid. What finds no word gives no row. ``docs`` (rev, text), ``pages`` (rev, page_no, width, height).
    """
    spans = asked.select("rev", "offset").distinct()
    grouped = word_groups(words_in_row_of(words, spans), ("rev", "offset"))
    first = grouped.where(F.col("start_offset") >= F.col("offset")).groupBy("rev", "offset").agg(F.min_by("group_no", "start_offset").alias("group_no"))
    box = grouped.join(first, ["rev", "offset", "group_no"]).groupBy("rev", "offset", "page_no").agg(F.min("start_offset").alias("start_offset"), F.max("end_offset").alias("end_offset"), union_of("rect").alias("box"))
    on = box.join(pages.select("rev", "page_no", "width", "height"), ["rev", "page_no"]).join(docs.select("rev", F.col("text").alias("__text")), "rev")
    grid = rectangle(*(to_grid(F.col(f"box.{x}"), F.col(size)) for x, size in (("left", "width"), ("top", "height"), ("width", "width"), ("height", "height"))))
    made = on.select("rev", "offset", "page_no", "start_offset", grid.alias("grid"), F.substring(F.col("__text"), F.col("start_offset") + 1, F.col("end_offset") - F.col("start_offset")).alias("previous_text"))
    return asked.join(made, ["rev", "offset"])


def row_boxes(words: DataFrame) -> DataFrame:
    """The bounding box of each row's words."""
    return words.groupBy("rev", "page_no", "row_no").agg(union_of("rect").alias("rect"))


def non_empty_pages(pages: DataFrame) -> DataFrame:
    """Of the pages that begin at one offset, the last: the others have no text."""
    last = Window.partitionBy("rev", "start_offset").orderBy(F.desc("page_no"))
    return pages.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def all_pages(pages: DataFrame) -> DataFrame:
    """``pages`` (doc_ref, page_no, text) with empty pages for the missing numbers between the first and the last."""
    known = pages.groupBy("doc_ref").agg(F.min("page_no").alias("a"), F.max("page_no").alias("b"))
    return known.select("doc_ref", F.explode(F.sequence("a", "b")).alias("page_no")).join(pages, ["doc_ref", "page_no"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def logical_page(text: F.Column) -> F.Column:
    """The printed page number: the first, second or last paragraph that is digits only."""
    parts = F.transform(F.split(F.trim(text), "\n\n+"), lambda x: F.trim(x))
    pick = [F.try_element_at(parts, F.lit(i)) for i in (1, 2, -1)]
    return F.coalesce(*[F.when(x.rlike(r"^[0-9]+$"), x.try_cast("int")) for x in pick])


def on_pixels(suggestions: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows ``(doc_ref, page_no, rev, suggestion, by)``: the suggestions that count, their rectangles in pixels of the page."""
    scaled = suggestions.where(~F.col("ignore")).join(pages.select("doc_ref", "page_no", "width", "height"), ["doc_ref", "page_no"])
    return scaled.select("doc_ref", "page_no", "rev", "suggestion", rectangle(from_grid(F.col("grid.left"), F.col("width")), from_grid(F.col("grid.top"), F.col("height")), from_grid(F.col("grid.width"), F.col("width")), from_grid(F.col("grid.height"), F.col("height"))).alias("by"))


def suggested(words: DataFrame, suggestions: DataFrame, pages: DataFrame, least: float = 0.75) -> DataFrame:
    """``words`` (doc_ref, page_no, word_no, content, rect) with the newest suggestion that covers over ``least`` of them.

    ``suggestions`` (doc_ref, page_no, rev, ignore, suggestion, grid) are on the page-relative grid; ``pages`` has the sizes.
    A suggestion that covers words in a row replaces the first of them; the others get an empty content. ``by`` is the
    rectangle of the suggestion that a word has taken.
    """
    met = words.join(on_pixels(suggestions, pages), ["doc_ref", "page_no"]).where((overlap("rect", "by") > 0) & (covered("rect", "by") > least))
    newest = met.groupBy("doc_ref", "page_no", "word_no").agg(F.max(F.struct("rev", "suggestion", "by")).alias("s"))
    order = Window.partitionBy("doc_ref", "page_no").orderBy("word_no")
    joined = words.join(newest, ["doc_ref", "page_no", "word_no"], "left")
    again = F.col("s.rev").isNotNull() & F.coalesce(F.lag("s.rev").over(order) == F.col("s.rev"), F.lit(False))
    return joined.withColumn("content", F.when(again, "").otherwise(F.coalesce("s.suggestion", "content"))).withColumn("by", F.col("s.by")).drop("s")


def hyphen_split(content: Column, rect: str, right_to_left: bool = False) -> Column:
    """A word that ends in a hyphen as word and hyphen, its width dealt out by characters; others as they are.

    An array of structs (content, kind, rect). The hyphen stands at the word's far end in the direction of reading.
    """
    body = F.regexp_extract(content, "^(.+)([-־⸗])$", 1)
    left, top, width, height = (F.col(f"{rect}.{x}") for x in ("left", "top", "width", "height"))
    each = F.floor(width / (F.length(body) + 1)).cast("int")
    letters = (each * F.length(body)).cast("int")
    word = rectangle((left + each).cast("int") if right_to_left else left, top, letters, height)
    hyphen = rectangle(left if right_to_left else (left + letters).cast("int"), top, each, height)
    piece = lambda text, kind, box: F.struct(text.alias("content"), F.lit(kind).alias("kind"), box.alias("rect"))
    whole = F.array(piece(content, "word", rectangle(left, top, width, height)))
    return F.when(F.length(body) > 0, F.array(piece(body, "word", word), piece(F.substring(content, -1, 1), "hyphen", hyphen))).otherwise(whole)


def word_parts(content: Column, rect: Column, right_to_left: bool = False) -> Column:
    """A word cut at its punctuation (see ``functions.text.broken``) as an array of structs (content, rect).

    The width is dealt out by characters, from the right for a language that is read from there, and the last part takes what
    rounding leaves.
    """

    @F.pandas_udf("array<struct<content:string,rect:struct<left:int,top:int,width:int,height:int>>>")
    def cut(contents: pd.Series, rects: pd.DataFrame) -> pd.Series:
        out = []
        for text, left, top, width, height in zip(contents, rects["left"], rects["top"], rects["width"], rects["height"]):
            if text is None:
                out.append(None)
                continue
            parts, made, done = broken(text), [], 0
            for i, part in enumerate(parts):
                own = math.floor(len(part) / max(1, len(text)) * width + 0.5) if i < len(parts) - 1 else width - done
                at = left + width - done - own if right_to_left else left + done
                made.append({"content": part, "rect": {"left": int(at), "top": int(top), "width": int(own), "height": int(height)}})
                done += own
            out.append(made)
        return pd.Series(out)

    return cut(content, rect)


def suggested_pieces(words: DataFrame, suggestions: DataFrame, pages: DataFrame, language: Language = PLAIN, least: float = 0.75) -> DataFrame:
    """Rows ``(doc_ref, page_no, row_no, word_no, part, content, kind, rect)``: lines with their suggestions, as they are indexed.

    A suggestion takes its own rectangle and is cut at its punctuation; one that ends in a hyphen at the end of its row becomes
    word and hyphen. ``words`` needs ``row_no`` beside the columns that :func:`suggested` takes.
    """
    taken = suggested(words, suggestions, pages, least).where(F.col("by").isNull() | (F.col("content") != ""))
    last = taken.groupBy("doc_ref", "page_no", "row_no").agg(F.max("word_no").alias("__last"))
    # A suggestion over several words stands at the first of them, so the last that is left ends the row.
    placed = taken.join(last, ["doc_ref", "page_no", "row_no"]).withColumns({"end": F.col("word_no") == F.col("__last"), "box": F.coalesce("by", "rect")})
    rtl = language.right_to_left
    own = placed.where("by is null").select("doc_ref", "page_no", "row_no", "word_no", F.lit(0).alias("part"), "content", F.lit("word").alias("kind"), F.col("rect"))
    # The hyphen of a word that ends its row goes to a piece of its own; within a row it stays with the last part.
    split = hyphen_split(F.col("content"), "box", rtl)
    ended = placed.where("by is not null and end").withColumn("pieces", split).where("size(pieces) = 2")
    ended = ended.withColumn("parts", word_parts(F.col("pieces")[0]["content"], F.col("pieces")[0]["rect"], rtl))
    parts = ended.select("doc_ref", "page_no", "row_no", "word_no", F.posexplode("parts").alias("part", "p"), "pieces")
    words_ = parts.select("doc_ref", "page_no", "row_no", "word_no", "part", "p.content", F.lit("word").alias("kind"), F.col("p.rect").alias("rect"))
    hyphens = ended.select("doc_ref", "page_no", "row_no", "word_no", F.size("parts").alias("part"), F.col("pieces")[1]["content"].alias("content"), F.lit("hyphen").alias("kind"), F.col("pieces")[1]["rect"].alias("rect"))
    rest = placed.where("by is not null").join(ended.select("doc_ref", "page_no", "word_no"), ["doc_ref", "page_no", "word_no"], "left_anti")
    rest = rest.withColumn("parts", word_parts(F.col("content"), F.col("box"), rtl)).select("doc_ref", "page_no", "row_no", "word_no", F.posexplode("parts").alias("part", "p"))
    rest = rest.select("doc_ref", "page_no", "row_no", "word_no", "part", "p.content", F.lit("word").alias("kind"), F.col("p.rect").alias("rect"))
    return own.unionByName(words_).unionByName(hyphens).unionByName(rest)


def layout_tables(pieces: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables of pages, rows and words of flattened ``pieces`` (of :func:`flattened`), for one bulk append each.

    ``sizes`` (rev, page_no, width, height). A row is a line; rows are numbered through their page. A word before a hyphen that
    ends its line knows where its second half begins.
    """
    line = pieces.groupBy("rev", "page_no", "block_no", "line_no").agg(F.min("start_offset").alias("start_offset"), union_of("rect").alias("rect"))
    number = (F.row_number().over(Window.partitionBy("rev", "page_no").orderBy("block_no", "line_no")) - 1).alias("row_no")
    numbered = line.select("rev", "page_no", number, "rect", "start_offset", "block_no", "line_no")
    rows = numbered.drop("block_no", "line_no")
    pages = sizes.join(rows.groupBy("rev", "page_no").agg(F.min("start_offset").alias("start_offset")), ["rev", "page_no"], "left")
    text = Window.partitionBy("rev").orderBy("start_offset")
    kept = pieces.where("kind <> 'space'").select("*", F.lead("kind").over(text).alias("__kind"), F.lead("line_no").over(text).alias("__line"), F.lead("start_offset", 2).over(text).alias("__half"))
    cut = (F.col("__kind") == "hyphen") & (F.col("__line") == F.col("line_no"))
    words = kept.where("kind = 'word'").join(numbered.select("rev", "page_no", "row_no", "block_no", "line_no"), ["rev", "page_no", "block_no", "line_no"])
    return pages, rows, words.select("rev", "page_no", "row_no", "start_offset", "end_offset", F.when(cut, F.col("__half")).alias("hyphenated_offset"), "rect")
