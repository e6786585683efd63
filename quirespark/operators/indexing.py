"""A written index: postings dealt by term, lengths and counts, in segments that a change adds to.

A segment holds the documents of one change: their postings (in folders by field and by a checksum of the term, sorted by term,
so a word's postings are read from one folder), their lengths, their columns, and the references whose entries in earlier segments
are dead. A change costs what it holds, not the index. A segment is complete when its table of dead references is, which is
written last; a writer that dies leaves none, and readers keep the segments they have begun with. ``compacted`` makes one
segment of all, with the counts of terms.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark import catalog
from quirespark.functions.text import token_table
from quirespark.languages import PLAIN, Language
from quirespark.operators.search import plain_postings, with_keywords
from quirespark.plans.match import Index

BUCKETS = 64
#: Documents whose postings of one bucket a task writes, about.
SPLIT_DOCS = 200_000


@dataclass(frozen=True)
class Segments:
    """The index at ``path``. ``analyse`` says whether texts are cut by the language's patterns or by built-ins alone."""

    path: str
    language: Language = PLAIN
    analyse: bool = True
    buckets: int = BUCKETS

    def numbers(self, spark: SparkSession) -> list[int]:
        """The complete segments, the oldest first."""
        jvm = spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(root, "segment=*/dead/_SUCCESS"))
        return sorted(int(x.getPath().getParent().getParent().getName().split("=")[1]) for x in found or [])

    def _at(self, number: int, table: str) -> str:
        return f"{self.path}/segment={number:08d}/{table}"

    def _fields(self, docs: DataFrame) -> list[tuple[str, str, bool]]:
        return [(f.name, f.column, self.analyse and f.name != "Text") for f in catalog.FIELDS.values() if f.tokenized and f.column in docs.columns]

    def upsert(self, docs: DataFrame, gone: DataFrame | None = None) -> int:
        """Write the entries of ``docs`` in place of any they had, and take out those of ``gone`` (doc_ref); the segment's number."""
        fields = self._fields(docs)
        if self.analyse:
            rows = token_table(docs, self.language, tuple(fields))
        else:
            rows = plain_postings(docs, tuple((n, c) for n, c, _ in fields)).drop("dl")
        return self._write(docs, rows.withColumn("bucket", (F.crc32(F.col("term").cast("binary")) % self.buckets).cast("int")), gone)

    def upsert_fields(self, docs: DataFrame, texts: DataFrame) -> int:
        """Like :func:`upsert`, but the postings of the text are ``texts``, as another segment has them."""
        fields = [x for x in self._fields(docs) if x[0] != "Text"]
        rows = texts
        if fields:
            own = token_table(docs, self.language, tuple(fields)) if self.analyse else plain_postings(docs, tuple((n, c) for n, c, _ in fields)).drop("dl")
            rows = texts.unionByName(own.withColumn("bucket", (F.crc32(F.col("term").cast("binary")) % self.buckets).cast("int")))
        return self._write(docs, rows, None)

    def _write(self, docs: DataFrame, rows: DataFrame, gone: DataFrame | None) -> int:
        spark = docs.sparkSession
        number = max(self.numbers(spark), default=-1) + 1
        self._postings(rows, number, docs.count())
        written = spark.read.schema(rows.schema).parquet(self._at(number, "postings"))
        written.groupBy("field", "doc_ref").agg((F.max("position").cast("long") + 1).alias("dl")).write.mode("overwrite").parquet(self._at(number, "lengths"))
        with_keywords(docs).write.mode("overwrite").parquet(self._at(number, "docs"))
        dead = docs.select("doc_ref") if gone is None else docs.select("doc_ref").unionAll(gone.select("doc_ref"))
        dead.distinct().write.mode("overwrite").parquet(self._at(number, "dead"))
        return number

    def _postings(self, rows: DataFrame, number: int, n_docs: int) -> None:
        """Write postings by field and bucket. A bucket is dealt to as many tasks, and files, as the number of documents asks for.

        Dealing by a hash of the document also splits the postings of a word that every document has.
        """
        splits = max(1, -(-n_docs // SPLIT_DOCS))
        dealt = rows.repartition("field", "bucket", F.pmod(F.xxhash64("doc_ref"), F.lit(splits)))
        dealt.sortWithinPartitions("field", "bucket", "term", "doc_ref", "position").write.mode("overwrite").partitionBy("field", "bucket").parquet(self._at(number, "postings"))

    def _read(self, spark: SparkSession, numbers: list[int], table: str) -> DataFrame:
        frames = [spark.read.parquet(self._at(n, table)).withColumn("__segment", F.lit(n)) for n in numbers]
        return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

    def _live(self, rows: DataFrame, dead: DataFrame | None) -> DataFrame:
        """The rows that no later segment has replaced or taken out."""
        if dead is not None:
            rows = rows.join(dead, "doc_ref", "left").where("__last is null or __segment >= __last").drop("__last")
        return rows.drop("__segment")

    def open(self, spark: SparkSession) -> Index:
        """The index as it stands: one segment is read as it is; with more, what a later one has replaced is joined away."""
        numbers = self.numbers(spark)
        if not numbers:
            raise FileNotFoundError(f"no complete segment at {self.path}")
        dead = None
        if len(numbers) > 1:
            dead = self._read(spark, numbers[1:], "dead").groupBy("doc_ref").agg(F.max("__segment").alias("__last"))
        docs, postings, lengths = (self._live(self._read(spark, numbers, t), dead) for t in ("docs", "postings", "lengths"))
        fields = frozenset(n for n, _, fold in self._fields(docs) if fold)
        terms = corpus = None
        if len(numbers) == 1 and self._counted(spark, numbers[0]):
            terms, corpus = (spark.read.parquet(self._at(numbers[0], t)) for t in ("terms", "corpus"))
        return Index(docs, postings, self.language, fields, lengths, terms, corpus, self.buckets)

    def _counted(self, spark: SparkSession, number: int) -> bool:
        jvm = spark._jvm
        mark = jvm.org.apache.hadoop.fs.Path(self._at(number, "corpus/_SUCCESS"))
        return mark.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(mark)

    def count(self, spark: SparkSession) -> None:
        """Write the counts of an index of one segment."""
        number, = self.numbers(spark)
        found = self.open(spark)
        plain = Index(found.docs, found.postings, lengths=found.lengths)
        plain.term_stats().write.mode("overwrite").parquet(self._at(number, "terms"))
        plain.corpus_stats().write.mode("overwrite").parquet(self._at(number, "corpus"))

    def compacted(self, spark: SparkSession, path: str) -> Segments:
        """All live entries as one segment of a new index at ``path``, with its counts; nothing is analysed again."""
        found = self.open(spark)
        new = Segments(path, self.language, self.analyse, self.buckets)
        new._postings(found.postings, 0, found.docs.count())
        found.lengths.write.mode("overwrite").parquet(new._at(0, "lengths"))
        found.docs.write.mode("overwrite").parquet(new._at(0, "docs"))
        found.docs.select("doc_ref").where(F.lit(False)).write.mode("overwrite").parquet(new._at(0, "dead"))
        new.count(spark)
        return new
