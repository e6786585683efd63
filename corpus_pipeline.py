"""A training corpus from raw documents: rules, line dedup, near-duplicates, repeated spans, packing.

Each stage takes what the one before has kept, as Parquet read again, and returns the columns of ``documents``; the last
returns the packed pieces. A document whose text a deduplication stage empties leaves with it: nothing of it is new.

For every stage: a null text counts as empty; texts of any length are taken whole; rows of one id and text are one document,
and each of them gets the same result unless a stage says otherwise; null ids come first where ids are ordered, and their rows
are told apart by their texts; columns that are not read pass through, whatever their names; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.llm import linededup, packing, rules, simhash, spans
from quirespark.llm.common import dropped, written
from quirespark.llm.queries import WORD_BPE


def _like(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """``changed`` with the columns of ``docs``, its count of characters brought up to date (0 for a null text)."""
    return changed.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*docs.columns) if "n_chars" in docs.columns else changed.select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go. Null and empty texts have too few words, so they go; repeated rows stay or go together."""
    return rules.passing(docs, rules.cascade(docs))


def line_winnowing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go, and documents that had no others.

    The first place of a run, by id, text hash and line, stays. A text without lines stays; repeated rows keep the same lines.
    """
    columns = [c for c in docs.columns if c not in ("n_lines", "n_deleted_lines")]
    found = linededup.line_dedup(docs.select(*columns, *[F.col(c).alias(f"__own_{c}") for c in docs.columns if c not in columns]))
    left = found.where((F.col("n_lines") == 0) | (F.col("n_deleted_lines") < F.col("n_lines")))
    return _like(docs, _restored(left, docs))


def _restored(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` that the operator's counts have the names of, as they were."""
    return found.withColumns({c: F.col(f"__own_{c}") for c in docs.columns if f"__own_{c}" in found.columns})


def simhash_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar texts stays: five-word shingles, a similarity of 0.8 or more.

    The smallest id that is not null stays, of several texts with that id the one with the smallest hash; of repeated rows one.
    Texts without a word are similar to each other.
    """
    return simhash.one_of_similar(docs)


def sentence_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sentences of later repeated spans go, and documents that had no others.

    The first place of a span, by id, text hash and sentence, stays. A text without sentences stays; repeated rows keep the same.
    """
    name = "n_removed_sentences"
    own = docs.withColumnRenamed(name, f"__own_{name}") if name in docs.columns else docs
    found = spans.span_dedup(own)
    return _like(docs, _restored(found.where((F.col(name) == 0) | (F.trim("text") != "")), docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 4096. A null or empty text is its end token alone; repeated rows are packed each."""
    return packing.pack_documents(docs, WORD_BPE)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_winnowing", line_winnowing),
    ("simhash_near_duplicates", simhash_near_duplicates),
    ("sentence_spans", sentence_spans),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express neither the fingerprints nor the token ids; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what stands between them is written to the shared folder, and goes when it is used."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs, path = written(docs, name)
            if before:
                dropped(spark, before)
            before = path
    return docs
