"""Requests on an index: search, lists, facets, authors, single documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark import catalog
from quirespark.errors import DocumentNotFoundInIndex, IndexFieldNotAggregatable, NoFieldRequestedForAggregation, UnknownSort
from quirespark.functions.text import keyword, terms, token_table, year
from quirespark.languages import PLAIN, Language
from quirespark.plans import criteria as c
from quirespark.plans.match import MOST_CLAUSES, Index, check_clauses, scores
from quirespark.plans.parser import parse

SORTS = ("Score", "DateAscending", "DateDescending", "DocReference")
FACETS = ("author", "author_en")


def with_keywords(docs: DataFrame) -> DataFrame:
    """``docs`` with the normal forms of its keyword fields and the number of its year."""
    added = {f.compared: keyword(F.col(f.column)) for f in catalog.FIELDS.values() if f.keyword and f.column in docs.columns}
    if "pub_year_raw" in docs.columns and "pub_year" not in docs.columns:
        added["pub_year"] = year(F.col("pub_year_raw"))
    return docs.withColumns(added)


def plain_postings(docs: DataFrame, fields: tuple[tuple[str, str], ...] = (("Text", "text"),)) -> DataFrame:
    """Postings by built-in expressions alone: words of letters, marks and digits with their positions, no exchange.

    ``dl`` is the length of the document's field, which costs nothing here and is not computed where no one asks for it.
    """
    found = None
    for name, column in fields:
        cut = docs.select("doc_ref", F.lit(name).alias("field"), terms(F.col(column)).alias("words"))
        # The outer form: for the inner one Spark asks first whether there are any words, and cuts the text twice.
        own = cut.select("doc_ref", "field", F.size("words").alias("dl"), F.posexplode_outer("words").alias("position", "term"))
        found = own if found is None else found.unionByName(own)
    return found.where("position is not null")


def plain_lengths(docs: DataFrame, fields: tuple[tuple[str, str], ...] = (("Text", "text"),)) -> DataFrame:
    """Rows ``(field, doc_ref, dl)`` of the documents that have words: the texts' words are counted, not listed."""
    found = None
    for name, column in fields:
        own = docs.select(F.lit(name).alias("field"), "doc_ref", F.size(terms(F.col(column))).cast("long").alias("dl")).where("dl > 0")
        found = own if found is None else found.unionByName(own)
    return found


def plain_corpus(docs: DataFrame, fields: tuple[tuple[str, str], ...] = (("Text", "text"),)) -> DataFrame:
    """Rows ``(field, n_docs, avg_dl)`` over the documents that have words, each text cut once."""
    found = None
    for name, column in fields:
        own = docs.select(F.lit(name).alias("field"), F.size(terms(F.col(column))).alias("dl"))
        found = own if found is None else found.unionByName(own)
    some = F.when(F.col("dl") > 0, F.col("dl"))
    return found.groupBy("field").agg(F.count(some).alias("n_docs"), F.avg(some).alias("avg_dl"))


def plain_index(docs: DataFrame, fields: tuple[tuple[str, str], ...] = (("Text", "text"),)) -> Index:
    """An index by built-in expressions alone."""
    return Index(with_keywords(docs), plain_postings(docs, fields), lengths=plain_lengths(docs, fields), corpus=plain_corpus(docs, fields))


def index_of(docs: DataFrame, language: Language = PLAIN, analyse: bool = True) -> Index:
    """An index of document rows; with ``analyse`` by the language's patterns and with offsets, else by built-ins alone.

    With ``analyse`` all fields but Text are folded, the query's words for them too.
    """
    known = [(f.name, f.column, f.name != "Text") for f in catalog.FIELDS.values() if f.tokenized and f.column in docs.columns]
    if not analyse:
        return plain_index(docs, tuple((n, col) for n, col, _ in known))
    return Index(with_keywords(docs), token_table(docs, language, tuple(known)), language, frozenset(n for n, _, fold in known if fold))


def contains(criterion: c.Criterion) -> list[c.Contains]:
    """All query strings of a criterion."""
    return [criterion] if isinstance(criterion, c.Contains) else [x for part in criterion.parts for x in contains(part)]


@dataclass(frozen=True)
class Engine:
    """What a caller asks of an index. Everything returns a DataFrame, so a request is one plan.

    A prefix, wildcard, range or pattern is one condition on the postings, whatever number of words it stands for, so a query
    is not refused for it unless the caller sets ``most_clauses``. Inside a phrase it may stand for ``most_in_phrase`` words, as
    in the reference. Counting the words is a job of its own, of queries with such a bound only. Null counts none.
    """

    index: Index
    most_clauses: int | None = None
    most_in_phrase: int | None = MOST_CLAUSES

    def _scores(self, criterion: c.Criterion) -> DataFrame:
        for asked in contains(criterion):
            check_clauses(self.index, parse(asked.query, self.index.language, asked.strict), asked.fields, self.most_clauses, self.most_in_phrase)
        return scores(self.index, criterion)

    def search(self, criterion: c.Criterion, sort: str = "Score", first: int = 0, most: int = 10) -> DataFrame:
        """Rows ``(doc_ref, score)``: one page in the order asked for, ties by reference. Other orders than Score have no score."""
        found = self._scores(criterion)
        if sort == "Score":
            return found.orderBy(F.desc("score"), F.asc("doc_ref")).offset(first).limit(most)
        return self._sorted(found, sort).select("doc_ref", F.lit(None).cast("double").alias("score")).offset(first).limit(most)

    def _sorted(self, found: DataFrame, sort: str) -> DataFrame:
        if sort not in SORTS:
            raise UnknownSort(f"Unknown sort: {sort}")
        if sort == "DocReference":
            return found.orderBy("doc_ref")
        dated = found.join(self.index.docs.select("doc_ref", "pub_year"), "doc_ref")
        order = F.asc_nulls_first("pub_year") if sort == "DateAscending" else F.desc_nulls_last("pub_year")
        return dated.orderBy(order, F.asc("doc_ref"))

    def total(self, criterion: c.Criterion) -> DataFrame:
        return self._scores(criterion).agg(F.count("*").alias("total"))

    def refs(self, criterion: c.Criterion, sort: str = "DocReference") -> DataFrame:
        """All matching references, in order."""
        found = self._scores(criterion)
        return (found.orderBy(F.desc("score"), F.asc("doc_ref")) if sort == "Score" else self._sorted(found, sort)).select("doc_ref")

    def facet(self, criterion: c.Criterion, field: str, most: int | None = None, by_label: bool = False) -> DataFrame:
        """Rows ``(label, n)``: matching documents by raw value, the largest first, then the label; re-sorted by label after the limit."""
        f = catalog.field(field)
        if not f.aggregatable:
            raise IndexFieldNotAggregatable(f"{field} cannot be aggregated")
        own = self.index.docs.where(F.coalesce(F.trim(F.col(f.column)) != "", F.lit(False)))
        found = own.join(self._scores(criterion), "doc_ref", "left_semi").groupBy(F.col(f.column).alias("label")).agg(F.count("*").alias("n"))
        found = found.orderBy(F.desc("n"), F.asc("label"))
        found = found if most is None else found.limit(most)
        return found.orderBy("label") if by_label else found

    def top_authors(self, prefix: str, most: int, author: bool = True, author_english: bool = True) -> DataFrame:
        """The most frequent authors of each field whose names begin with ``prefix``, the top of both, by label."""
        fields = [n for n, on in (("Author", author), ("AuthorEnglish", author_english)) if on and catalog.field(n).column in self.index.docs.columns]
        if not fields:
            raise NoFieldRequestedForAggregation("No fields were selected for aggregation")
        found = None
        for i, name in enumerate(fields):
            own = self.facet(c.StartsWith(name, prefix), name, most).withColumn("i", F.lit(i))
            found = own if found is None else found.unionByName(own)
        return found.orderBy(F.desc("n"), "i", "label").limit(most).select("label", "n").orderBy("label")

    def document(self, ref: str) -> DataFrame:
        found = self.index.docs.where(F.col("doc_ref") == ref).limit(1)
        if found.isEmpty():
            raise DocumentNotFoundInIndex(f"Document {ref} not found in index")
        return found

    def size(self) -> DataFrame:
        return self.index.docs.agg(F.count("*").alias("size"))

    def list_terms(self, ref: str, start: int | None = None, end: int | None = None) -> DataFrame:
        """The terms of a document that begin in ``[start, end)``, by field, place and term."""
        own = self.index.postings.where(F.col("doc_ref") == ref)
        own = own if start is None else own.where(F.col("start") >= start)
        own = own if end is None else own.where(F.col("start") < end)
        return own.select("field", "term", "start", "end", "position").orderBy("field", "start", "end", "term")
