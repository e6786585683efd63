"""Metadata records as XML, read and written by built-in expressions; and where a document's files are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The element of each field; the first of a name counts.
ELEMENTS = {"title": "title-alt-script", "title_en": "title", "author": "creator-alt-script", "author_en": "creator", "pub_year_raw": "date", "publisher": "publisher", "volume": "volume", "url": "identifier-access"}


def read(xml: Column) -> Column:
    """A struct of the record's fields; a missing element is null."""
    found = [F.get(F.xpath(xml, F.lit(f"//{e}/text()")), F.lit(0)).alias(c) for c, e in ELEMENTS.items()]
    return F.struct(*found, F.xpath(xml, F.lit("//collection/text()")).alias("collections"))


def _escaped(value: Column) -> Column:
    return F.replace(F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def write(record: str) -> Column:
    """The XML of a struct column."""
    order = ("volume", "title_en", "author_en", "publisher", "pub_year_raw", "title", "author", "url")
    parts = [F.when(F.col(f"{record}.{c}").isNotNull(), F.concat(F.lit(f"<{ELEMENTS[c]}>"), _escaped(F.col(f"{record}.{c}")), F.lit(f"</{ELEMENTS[c]}>"))) for c in order]
    collections = F.array_join(F.transform(F.col(f"{record}.collections"), lambda x: F.concat(F.lit("<collection>"), _escaped(x), F.lit("</collection>"))), "")
    return F.concat(F.lit("<metadata>"), F.concat_ws("", *parts, collections), F.lit("</metadata>"))


def content_directory(refs: DataFrame, directories: list[tuple[str, str]], ref: str = "doc_ref") -> DataFrame:
    """``refs`` with ``directory``: that of the greatest ``min_ref`` strictly before the reference, else the first.

    ``directories`` is configuration, so the lookup is an expression over it and joins nothing.
    """
    ordered = sorted(directories)
    chosen = F.lit(ordered[0][1])
    for least, directory in ordered:
        chosen = F.when(F.col(ref) > least, F.lit(directory)).otherwise(chosen)
    return refs.withColumn("directory", chosen)


def image_paths(pages: DataFrame, files: DataFrame) -> DataFrame:
    """``pages`` (doc_ref, page_no, stem) with ``path``: the png, else the jpg, else null; ``files`` lists ``path``."""
    png, jpg = (files.select(F.regexp_replace("path", rf"\.{e}$", "").alias("stem"), F.col("path").alias(e)).where(F.col(e).endswith(f".{e}")) for e in ("png", "jpg"))
    return pages.join(png, "stem", "left").join(jpg, "stem", "left").withColumn("path", F.coalesce("png", "jpg")).drop("png", "jpg")
