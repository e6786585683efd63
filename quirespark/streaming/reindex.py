"""Re-indexing driven by a change log.

The log is a folder of Parquet files with a column ``doc_ref``; each trigger takes what has arrived, and one batch job builds the
entries of the changed documents. They become a segment of the index (``operators.indexing``), so a trigger costs what has
changed, not what the index holds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quirespark.functions.text import token_table
from quirespark.languages import PLAIN, Language
from quirespark.operators import corrections, store
from quirespark.operators.indexing import Segments


def rebuilt(postings: DataFrame, docs: DataFrame, changed: DataFrame, language: Language = PLAIN) -> DataFrame:
    """``postings`` with the entries of ``changed`` (doc_ref) made again from ``docs``; documents no longer there lose theirs."""
    kept = postings.join(changed.select("doc_ref").distinct(), "doc_ref", "left_anti").select(*postings.columns)
    return kept.unionByName(token_table(docs.join(changed.select("doc_ref").distinct(), "doc_ref", "left_semi"), language))


def reindex(index: Segments, docs: DataFrame, changed: DataFrame, made: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """Write the entries of ``changed`` (doc_ref) from ``docs``, with their metadata corrected where ``made`` and ``links`` are given.

    Gives rows ``(doc_ref, status)``: Indexed, or Gone for a document that is no longer there, whose entries go. A text that
    can't be analysed fails the batch as a whole, and the segment stays incomplete, so a next try starts from what was.
    """
    wanted = changed.select("doc_ref").distinct()
    own = docs.join(wanted, "doc_ref", "left_semi")
    if made is not None and links is not None:
        own = corrections.overlaid(own, made, links)
    index.upsert(own, wanted)
    return wanted.join(own.select("doc_ref", F.lit("Indexed").alias("status")).distinct(), "doc_ref", "left").select("doc_ref", F.coalesce("status", F.lit("Gone")).alias("status"))


def reindexed(state: dict[str, DataFrame], done: DataFrame, at) -> DataFrame:
    """The table ``indexed`` after a re-index of ``done`` (reference): newest revisions noted, no mark left.

    ``state`` has the tables that ``corrections.to_reindex`` takes. A reference that was not there before is added.
    """
    indexed = state["indexed"]
    docs = state["documents"].where("status = 'Complete'").groupBy("reference").agg(F.max("rev").alias("doc_rev"))
    words = state["suggestions"].groupBy(F.col("doc_ref").alias("reference")).agg(F.max("rev").alias("word_suggestion_rev"))
    new = done.select("reference").distinct().join(docs, "reference", "left").join(words, "reference", "left")
    new = new.withColumns({"reindex": F.lit("No"), "index_time": F.lit(at).cast("timestamp")})
    missing = [c for c in indexed.columns if c not in new.columns]
    new = new.join(indexed.select("reference", *missing), "reference", "left") if missing else new
    return store.upserted(indexed, new, ["reference"])


def metadata_only(index: Segments, docs: DataFrame, changed: DataFrame) -> None:
    """Documents whose words have not changed: their postings of the text are taken over as they are, their fields made anew."""
    spark = docs.sparkSession
    wanted = changed.select("doc_ref").distinct()
    now = index.open(spark)
    columns = [c for c in docs.columns if c != "text"]
    texts = now.docs.join(wanted, "doc_ref", "left_semi").select("doc_ref", "text")
    fields = docs.select(*columns).join(wanted, "doc_ref", "left_semi").join(texts, "doc_ref")
    index.upsert_fields(fields, now.postings.where("field = 'Text'").join(wanted, "doc_ref", "left_semi"))


def where_required(index: Segments, docs: DataFrame, state: dict[str, DataFrame], at) -> tuple[DataFrame, DataFrame]:
    """Index all that ``corrections.to_reindex`` names, and give the tables ``indexed`` and ``indexed_corrections`` as they are then.

    ``state`` has the tables that it takes. Documents with new words are analysed, the others keep their postings of the text and
    get their fields anew; two segments at most, whatever the number of documents.
    """
    spark = docs.sparkSession
    changed = corrections.to_reindex(**state).join(corrections.content_updated(state["documents"], state["suggestions"], state["indexed"]), "reference").select(F.col("reference").alias("doc_ref"), "updated")
    words, fields = changed.where("updated").select("doc_ref"), changed.where("not updated").select("doc_ref")
    if not words.isEmpty():
        reindex(index, docs, words, state["corrections"], state["links"])
    if index.numbers(spark) and not fields.isEmpty():
        metadata_only(index, corrections.overlaid(docs, state["corrections"], state["links"]), fields)
    done = changed.select(F.col("doc_ref").alias("reference"))
    met = state["corrections"].join(state["links"], state["corrections"]["id"] == state["links"]["correction_id"])
    noted = met.groupBy(F.col("doc_ref").alias("reference"), "field").agg(F.max("rev").alias("metadata_correction_rev")).join(done, "reference", "left_semi")
    return reindexed(state, done, at), store.upserted(state["indexed_corrections"], noted, ["reference", "field"])


def failed(state: dict[str, DataFrame], refs: DataFrame, reason: str) -> tuple[DataFrame, DataFrame]:
    """``documents`` and ``indexed`` after a re-index of ``refs`` (reference) has failed: the newest revisions say why, no mark is left."""
    here = refs.select("reference").distinct()
    revs = state["documents"].join(here, "reference", "left_semi").groupBy("reference").agg(F.max("rev").alias("rev"))
    return store.with_status(state["documents"], revs.select("rev"), "Failed", reason), store.marked(state["indexed"], here, "No")


def follow(spark: SparkSession, log: str, checkpoint: str, index: Segments, docs: Callable[[], DataFrame], interval: str | None = "10 seconds") -> StreamingQuery:
    """Re-index on every trigger; without an interval take what is there and end."""

    def batch(changes: DataFrame, number: int) -> None:
        changed = changes.select("doc_ref").distinct()
        if not changed.isEmpty():
            reindex(index, docs(), changed)

    stream = spark.readStream.schema("doc_ref string").parquet(log).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (stream.trigger(processingTime=interval) if interval else stream.trigger(availableNow=True)).start()
