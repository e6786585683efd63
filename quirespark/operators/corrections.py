"""Corrections, their overlay on metadata, and which documents need a new index entry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirespark import catalog
from quirespark.errors import UnknownMetadataCorrectionId, UnknownMetadataField
from quirespark.functions.text import keyword

METADATA = {"Title": "title", "TitleEnglish": "title_en", "Author": "author", "AuthorEnglish": "author_en", "Publisher": "publisher", "PublicationYear": "pub_year_raw", "Volume": "volume", "URL": "url"}


def latest(corrections: DataFrame, links: DataFrame, ignored: bool = False) -> DataFrame:
    """Rows ``(doc_ref, field, rev, new_value)``: the newest correction of each field of a document, by one aggregation."""
    own = corrections if ignored else corrections.where(~F.col("ignore"))
    met = own.join(links, own["id"] == links["correction_id"])
    return met.groupBy("doc_ref", "field").agg(F.max(F.struct("rev", "new_value")).alias("c")).select("doc_ref", "field", "c.rev", "c.new_value")


def overlaid(docs: DataFrame, corrections: DataFrame, links: DataFrame) -> DataFrame:
    """``docs`` with its metadata corrected; undoing a correction brings back the one before."""
    columns = {f: col for f, col in METADATA.items() if col in docs.columns}
    wide = latest(corrections, links).groupBy(F.col("doc_ref").alias("__ref")).agg(*[F.max(F.when(F.col("field") == f, F.col("new_value"))).alias(f"__{col}") for f, col in columns.items()])
    joined = docs.join(wide, docs["doc_ref"] == wide["__ref"], "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns.values() else F.col(c) for c in docs.columns])


def correction_targets(docs: DataFrame, ref: str, field: str, everywhere: bool) -> DataFrame:
    """The documents a correction applies to: one, or all with the same old value when it is not blank."""
    if field not in METADATA:
        raise UnknownMetadataField(f"Unknown MetadataField: {field}")
    column = F.col(METADATA[field])
    one = docs.where(F.col("doc_ref") == ref).select(keyword(column).alias("old"))
    if not everywhere:
        return docs.where(F.col("doc_ref") == ref).select("doc_ref")
    same = docs.join(F.broadcast(one.where(F.coalesce(F.trim("old") != "", F.lit(False)))), keyword(column) == F.col("old"), "left_semi").select("doc_ref")
    return same.unionByName(docs.where(F.col("doc_ref") == ref).select("doc_ref")).distinct().orderBy("doc_ref")


def undone(corrections: DataFrame, number: int, rev: int) -> DataFrame:
    """``corrections`` with one ignored, at a new revision so that it counts as the newest change."""
    if corrections.where(F.col("id") == number).isEmpty():
        raise UnknownMetadataCorrectionId(f"Unknown metadata correction: {number}")
    here = F.col("id") == number
    return corrections.withColumns({"ignore": here | F.col("ignore"), "rev": F.when(here, rev).otherwise(F.col("rev"))})


def ignored_suggestions(suggestions: DataFrame, username: str, first_rev: int) -> DataFrame:
    """A user's suggestions ignored, each at a new revision from ``first_rev`` on, in their order."""
    hit = F.coalesce(F.col("username") == username, F.lit(False))
    order = Window.partitionBy("username").orderBy("rev")
    mine = suggestions.where(hit).withColumns({"ignore": F.lit(True), "rev": (F.lit(first_rev) + F.row_number().over(order) - 1).cast(suggestions.schema["rev"].dataType)})
    return suggestions.where(~hit).unionByName(mine)


def corrections_of(corrections: DataFrame, links: DataFrame, refs: DataFrame) -> DataFrame:
    """All corrections of each document of ``refs`` (doc_ref), the newest first."""
    met = refs.select("doc_ref").distinct().join(links, "doc_ref").join(corrections, F.col("correction_id") == corrections["id"])
    return met.select("doc_ref", *corrections.columns).orderBy("doc_ref", F.desc("rev"))


def documents_of(links: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents of each correction of ``ids`` (correction_id), by reference."""
    return links.join(ids.select("correction_id").distinct(), "correction_id").select("correction_id", "doc_ref").orderBy("correction_id", "doc_ref")


def sent(corrections: DataFrame, ids: DataFrame) -> DataFrame:
    """``corrections`` with those of ``ids`` (id) marked as sent."""
    here = ids.select(F.col("id").alias("__id")).distinct()
    return corrections.join(here, F.col("id") == F.col("__id"), "left").withColumn("sent", F.col("__id").isNotNull() | F.coalesce("sent", F.lit(False))).drop("__id")


def backfilled(indexed: DataFrame, corrections: DataFrame) -> DataFrame:
    """Rows ``(reference, field, metadata_correction_rev)`` from a table that knew one correction's revision a document."""
    known = indexed.where("metadata_correction_rev is not null").select("reference", "metadata_correction_rev")
    return known.join(corrections.select("field", F.col("rev").alias("metadata_correction_rev")), "metadata_correction_rev").select("reference", "field", "metadata_correction_rev")


def to_reindex(documents: DataFrame, suggestions: DataFrame, corrections: DataFrame, links: DataFrame, indexed: DataFrame, indexed_corrections: DataFrame) -> DataFrame:
    """The references whose index entry is behind: newer content, suggestion or correction, or marked.

    Each side is first reduced to its newest revision, so what would be correlated subqueries are equality joins.
    """
    d = documents.where("status = 'Complete'").groupBy("reference").agg(F.max("rev").alias("d_rev"))
    w = suggestions.groupBy(F.col("doc_ref").alias("reference")).agg(F.max("rev").alias("w_rev"))
    m = corrections.join(links, corrections["id"] == links["correction_id"]).groupBy(F.col("doc_ref").alias("reference"), "field").agg(F.max("rev").alias("m_rev"))
    behind = m.join(indexed_corrections, ["reference", "field"], "left").where("metadata_correction_rev IS NULL OR m_rev > metadata_correction_rev").select("reference", F.lit(True).alias("behind")).distinct()
    all_ = indexed.join(d, "reference", "left").join(w, "reference", "left").join(behind, "reference", "left")
    wanted = (F.col("d_rev") > F.col("doc_rev")) | (F.col("w_rev") > F.coalesce("word_suggestion_rev", F.lit(0))) | F.col("behind") | F.col("reindex").isin("Yes", "MetadataOnly")
    return all_.where(F.coalesce(wanted, F.lit(False))).select("reference").orderBy("reference")


def content_updated(documents: DataFrame, suggestions: DataFrame, indexed: DataFrame) -> DataFrame:
    """Rows ``(reference, updated)``: whether a document's words, not only its metadata, must be indexed again."""
    d = documents.where("status = 'Complete'").groupBy("reference").agg(F.max("rev").alias("d_rev"))
    w = suggestions.groupBy(F.col("doc_ref").alias("reference")).agg(F.max("rev").alias("w_rev"))
    all_ = indexed.join(d, "reference", "left").join(w, "reference", "left")
    return all_.select("reference", F.coalesce((F.col("d_rev") > F.col("doc_rev")) | (F.col("w_rev") > F.coalesce("word_suggestion_rev", F.lit(0))) | (F.col("reindex") == "Yes"), F.lit(False)).alias("updated"))


def aggregatable() -> list[str]:
    return [f.name for f in catalog.FIELDS.values() if f.aggregatable]
