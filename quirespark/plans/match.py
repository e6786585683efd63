"""Criteria and parsed queries as plans over postings: who matches, how well, and where.

A query is one pass over the postings, whatever its clauses: the postings that any leaf asks for meet by document, each with
the leaves it serves, and the tree of clauses becomes an expression over what a document has of each leaf. A phrase is no
chain of self-joins: the positions of its words, each less its place in the phrase, are intersected within the document, or
vote by an aggregation where the matches themselves are wanted. So a phrase costs the postings of its own terms once.

With written statistics (``operators.indexing``) lengths and counts are read; without, lengths are one more pass.
"""

from __future__ import annotations

import functools
import itertools
import operator
from collections.abc import Callable
from dataclasses import dataclass, replace
from zlib import crc32

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirespark import catalog
from quirespark.errors import QueryTooComplex, WrongFieldType
from quirespark.functions.text import keyword_text
from quirespark.languages import PLAIN, Language, folded
from quirespark.plans import criteria as c
from quirespark.plans import parser as p

K1, B = 1.2, 0.75
MOST_CLAUSES = 16384


@dataclass(frozen=True)
class Index:
    """``docs`` (one row a document) and ``postings`` (doc_ref, field, term, position and, where known, start, end, page_no, row_no).

    ``folded`` are the fields whose terms are folded, on either side. ``lengths``, ``terms`` and ``corpus`` are the statistics
    where they are written; ``buckets`` is the number of partitions of written postings, dealt by the terms' checksum.
    """

    docs: DataFrame
    postings: DataFrame
    language: Language = PLAIN
    folded: frozenset[str] = frozenset()
    lengths: DataFrame | None = None
    terms: DataFrame | None = None
    corpus: DataFrame | None = None
    buckets: int = 0

    def doc_stats(self) -> DataFrame:
        """Length of each document's field: positions that advance, which are numbered from 0 without gaps."""
        if self.lengths is not None:
            return self.lengths
        return self.postings.groupBy("field", "doc_ref").agg((F.max("position").cast("long") + 1).alias("dl"))

    def term_stats(self) -> DataFrame:
        """Documents and occurrences of each term."""
        if self.terms is not None:
            return self.terms
        return self.postings.groupBy("field", "term", "doc_ref").agg(F.count("*").alias("tf")).groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))

    def corpus_stats(self) -> DataFrame:
        if self.corpus is not None:
            return self.corpus
        return self.doc_stats().groupBy("field").agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_dl"))


def wanted(leaf: p.Term | p.Multi) -> Column:
    """Whether a posting's term is one that the leaf asks for."""
    term = F.col("term")
    if isinstance(leaf, p.Term):
        return term.isin(*leaf.words)
    if leaf.kind == "prefix":
        return term.startswith(leaf.text)
    if leaf.kind == "range":
        low = F.lit(True) if not leaf.text else term >= leaf.text if leaf.ends[0] else term > leaf.text
        high = F.lit(True) if not leaf.upper else term <= leaf.upper if leaf.ends[1] else term < leaf.upper
        return low & high
    if leaf.kind == "fuzzy":
        size = len(leaf.text)
        return F.length(term).between(size - leaf.edits, size + leaf.edits) & (F.levenshtein(term, F.lit(leaf.text)) <= leaf.edits)
    return term.rlike(f"^(?:{leaf.text})$")


def of_fields(node: p.Phrase | p.Term | p.Multi, fields: tuple[str, ...]) -> tuple[str, ...]:
    return (node.field,) if node.field and node.field in catalog.FIELDS else fields


def _folded(leaf: p.Term | p.Multi) -> p.Term | p.Multi:
    if isinstance(leaf, p.Term):
        return replace(leaf, words=tuple(dict.fromkeys(map(folded, leaf.words))))
    return leaf if leaf.kind == "regexp" else replace(leaf, text=folded(leaf.text), upper=folded(leaf.upper))


def asked(index: Index, leaf: p.Term | p.Multi, fields: tuple[str, ...]) -> Column:
    """Whether a posting is one of ``fields`` with a term that the leaf asks for; folded fields are asked for the folded word."""
    parts = []
    for fold in (False, True):
        own = [f for f in fields if (f in index.folded) == fold]
        if own:
            term = _folded(leaf) if fold else leaf
            part = F.col("field").isin(*own) & wanted(term)
            if index.buckets and isinstance(term, p.Term):
                part = F.col("bucket").isin(*{crc32(w.encode()) % index.buckets for w in term.words}) & part
            parts.append(part)
    return functools.reduce(operator.or_, parts)


def starts(index: Index, phrase: p.Phrase, fields: tuple[str, ...]) -> DataFrame:
    """Rows ``(doc_ref, field, first, last)``: the positions of each match of a phrase."""
    named = of_fields(phrase, fields)
    asks = [asked(index, s, named) for _, s in phrase.slots]
    own = index.postings.where(functools.reduce(operator.or_, asks))
    n, size = len(phrase.slots), phrase.slots[-1][0]
    if not phrase.slop or phrase.gaps:
        slots = F.array(*[F.when(a, F.struct(F.lit(i).alias("slot"), F.lit(o).alias("offset"))) for i, ((o, _), a) in enumerate(zip(phrase.slots, asks))])
        each = own.select("doc_ref", "field", "position", F.explode(F.filter(slots, lambda x: x.isNotNull())).alias("s"))
        votes = each.groupBy("doc_ref", "field", (F.col("position") - F.col("s.offset")).alias("first")).agg(F.countDistinct("s.slot").alias("n"))
        return votes.where(F.col("n") == n).select("doc_ref", "field", "first", (F.col("first") + size).alias("last"))
    return near(own.select("doc_ref", "field", "position", functools.reduce(operator.add, [F.when(a, 1 << i).otherwise(0) for i, a in enumerate(asks)]).alias("mask")), phrase)


def _choices(phrase: p.Phrase) -> list[tuple[int, ...]]:
    """The sets of slots whose words must be counted together: those that can compete for one word."""
    words = [set(s.words) if isinstance(s, p.Term) else None for _, s in phrase.slots]
    same = [[a is None or b is None or bool(a & b) for b in words] for a in words]
    groups: list[set[int]] = []
    for i in range(len(words)):
        own = {i}.union(*(g for g in groups if any(same[i][j] for j in g)))
        groups = [g for g in groups if not g & own] + [own]
    out = []
    for group in groups:
        if all(words[i] == words[min(group)] is not None for i in group):
            out.append(tuple(sorted(group)))
            continue
        if len(group) > 10:
            raise QueryTooComplex("Query too complex: over 10 places of a phrase with slop that share words")
        out += [x for k in range(1, len(group) + 1) for x in itertools.combinations(sorted(group), k)]
    return out


def _fills(bits: int) -> Callable[[Column], Column]:
    return lambda x: x["mask"].bitwiseAND(F.lit(bits)) != 0


def _of(leaf: int, part: int | None = None) -> Callable[[Column], Column]:
    return lambda x: (x["leaf"] == leaf) if part is None else (x["leaf"] == leaf) & (x["part"] == part)


def _begins(offset: int) -> Callable[[Column], Column]:
    return lambda x: x["position"] - offset


def near(hits: DataFrame, phrase: p.Phrase) -> DataFrame:
    """Rows ``(doc_ref, field, first, last)`` of an unordered phrase; ``mask`` of a hit has a bit for each slot it can fill.

    From each position on, the shortest stretch that fills every slot with a position of its own. By Hall's theorem that is the
    stretch that has, for every set of slots, as many positions that fill one of them as the set has slots; sets of slots
    that share no word need not be looked at together. A match is no longer than its slots and the slop.
    """
    n = len(phrase.slots)
    each = hits.groupBy("doc_ref", "field", "position").agg(F.bit_or("mask").alias("mask"))
    ahead = Window.partitionBy("doc_ref", "field").orderBy("position").rangeBetween(0, n - 1 + phrase.slop)
    held = each.withColumn("held", F.collect_list(F.struct("position", "mask")).over(ahead))
    ends = []
    for choice in _choices(phrase):
        bits = sum(1 << i for i in choice)
        ends.append(F.get(F.filter("held", _fills(bits)), F.lit(len(choice) - 1))["position"])
    whole = functools.reduce(operator.and_, [e.isNotNull() for e in ends])
    last = F.greatest(*ends) if len(ends) > 1 else ends[0]
    return held.where(whole).select("doc_ref", "field", F.col("position").alias("first"), last.alias("last"))


def _idf(n_docs: Column, df: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def _hits(index: Index, asks: list[tuple[p.Node, tuple[str, ...]]]) -> DataFrame:
    """Rows ``(doc_ref, field, hits, dl)``: what a document's field has of each leaf, in one pass over the postings.

    A hit is (position, leaf, part, term): the part is the slot of a phrase; the term is kept where each word counts by itself.
    """
    conditions, tags = [], []
    for number, (leaf, named) in enumerate(asks):
        for part, one in enumerate([s for _, s in leaf.slots] if isinstance(leaf, p.Phrase) else [leaf]):
            condition = asked(index, one, named)
            conditions.append(condition)
            word = F.col("term") if isinstance(leaf, p.Term) else F.lit(None).cast("string")
            tags.append(F.when(condition, F.struct(F.lit(number).alias("leaf"), F.lit(part).alias("part"), word.alias("term"))))
    own = index.postings.where(functools.reduce(operator.or_, conditions))
    each = own.withColumn("tag", F.explode(F.filter(F.array(*tags), lambda x: x.isNotNull())))
    # The length stands in each hit: as a column of its own it would be pruned from one of the two uses of this exchange, and
    # the postings would be made twice.
    known = "dl" in own.columns
    hit = F.struct("position", "tag.leaf", "tag.part", "tag.term", *(["dl"] if known else []))
    found = each.groupBy("doc_ref", "field").agg(F.collect_list(hit).alias("hits"))
    return found.withColumn("dl", F.get("hits", F.lit(0))["dl"].cast("long")) if known else found.join(index.doc_stats(), ["doc_ref", "field"])


def _leaf_stats(index: Index, asks: list[tuple[p.Node, tuple[str, ...]]], hits: DataFrame) -> DataFrame:
    """One row a field: ``field``, ``avg_dl`` and ``idf``, a map by leaf. A word's idf is that of its commonest synonym; a phrase has the sum of its words'."""
    counted = [i for i, (leaf, _) in enumerate(asks) if not isinstance(leaf, p.Multi)]
    parts = F.array_distinct(F.transform(F.filter("hits", lambda x: x["leaf"].isin(*counted)), lambda x: F.struct(x["leaf"].alias("leaf"), x["part"].alias("part"), x["term"].alias("term"))))
    dfs = hits.select("field", F.explode(parts).alias("t")).groupBy("field", "t.leaf", "t.part", "t.term").agg(F.count("*").alias("df"))
    slots = dfs.groupBy("field", "leaf", "part").agg(F.max("df").alias("df")).join(F.broadcast(index.corpus_stats()), "field")
    leaf = slots.groupBy("field", "leaf", "avg_dl").agg(F.sum(_idf(F.col("n_docs"), F.col("df"))).alias("idf"))
    return leaf.groupBy("field").agg(F.first("avg_dl").alias("avg_dl"), F.map_from_entries(F.collect_list(F.struct("leaf", "idf"))).alias("idf"))


def leaf_scores(index: Index, leaves: list[p.Node], fields: tuple[str, ...]) -> DataFrame:
    """Rows ``(doc_ref, s0, s1, ...)``: the score of each leaf, null where a document does not match it; boosts are in.

    Words and phrases score by BM25, over all fields together; sets of words by 1 a field.
    """
    asks = [(leaf, of_fields(leaf, fields)) for leaf in leaves]
    hits = _hits(index, asks)
    sloppy = [i for i, leaf in enumerate(leaves) if isinstance(leaf, p.Phrase) and leaf.slop and not leaf.gaps]
    if any(not isinstance(leaf, p.Multi) for leaf in leaves):
        scored = hits.join(F.broadcast(_leaf_stats(index, asks, hits)), "field", "left")
    else:
        scored = hits.withColumns({"avg_dl": F.lit(None).cast("double"), "idf": F.lit(None).cast("map<int,double>")})
    for i in sloppy:
        own = hits.select("doc_ref", "field", F.explode(F.filter("hits", _of(i))).alias("h")).select("doc_ref", "field", F.col("h.position").alias("position"), F.expr("shiftleft(1, h.part)").alias("mask"))
        scored = scored.join(near(own, leaves[i]).groupBy("doc_ref", "field").agg(F.count("*").alias(f"n{i}")), ["doc_ref", "field"], "left")
    sums = []
    for i, (leaf, _) in enumerate(asks):
        if i in sloppy:
            tf = F.col(f"n{i}")
        elif isinstance(leaf, p.Phrase):
            at = [F.transform(F.filter("hits", _of(i, k)), _begins(o)) for k, (o, _) in enumerate(leaf.slots)]
            tf = F.size(functools.reduce(F.array_intersect, at))
        else:
            tf = F.size(F.filter("hits", _of(i)))
        if isinstance(leaf, p.Multi):
            score = F.lit(1.0)
        else:
            score = F.col("idf")[i] * tf / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))
        sums.append(F.when(F.coalesce(tf, F.lit(0)) > 0, score * float(leaf.boost)))
    if len({f for _, named in asks for f in named}) == 1:  # a row a document already
        return scored.select("doc_ref", *[x.alias(f"s{i}") for i, x in enumerate(sums)])
    return scored.groupBy("doc_ref").agg(*[F.sum(x).alias(f"s{i}") for i, x in enumerate(sums)])


def _constant(found: DataFrame) -> DataFrame:
    return found.select("doc_ref").distinct().withColumn("score", F.lit(1.0))


def _nothing(index: Index) -> DataFrame:
    return index.docs.where(F.lit(False)).select("doc_ref", F.lit(1.0).alias("score"))


def _summed(frames: list[DataFrame]) -> DataFrame:
    return frames[0] if len(frames) == 1 else functools.reduce(DataFrame.unionByName, frames).groupBy("doc_ref").agg(F.sum("score").alias("score"))


def _combined(node: p.Node, left: list[Column]) -> Column:
    """The score of a tree of clauses, null where it does not match; ``left`` has the leaves' scores in order and is used up."""
    if not isinstance(node, p.Bool):
        return left.pop(0)
    must, should, must_not = ([_combined(x, left) for x in part] for part in (node.must, node.should, node.must_not))
    if not must and not should:
        return F.lit(None).cast("double")
    matches = functools.reduce(operator.and_, [x.isNotNull() for x in must]) if must else functools.reduce(operator.or_, [x.isNotNull() for x in should])
    for x in must_not:
        matches = matches & x.isNull()
    return F.when(matches, functools.reduce(operator.add, [F.coalesce(x, F.lit(0.0)) for x in (*must, *should)]) * float(node.boost))


def node_scores(index: Index, node: p.Node | None, fields: tuple[str, ...]) -> DataFrame:
    """Rows ``(doc_ref, score)`` of a parsed query."""
    leaves = p.leaves(node)
    if not leaves:
        return _nothing(index)
    found = leaf_scores(index, leaves, fields)
    score = _combined(node, [F.col(f"s{i}") for i in range(len(leaves))])
    return found.select("doc_ref", score.alias("score")).where("score is not null")


def check_clauses(index: Index, node: p.Node | None, fields: tuple[str, ...], most: int | None = MOST_CLAUSES, in_phrase: int | None = None) -> None:
    """A prefix, wildcard, range or pattern may stand for at most ``most`` words, inside a phrase for at most ``in_phrase`` too.

    Null is no bound. What has a bound is counted in one pass over the terms.
    """
    within = min((x for x in (most, in_phrase) if x is not None), default=None)
    sets = []
    for leaf in p.leaves(node):
        inner, bound = ([s for _, s in leaf.slots], within) if isinstance(leaf, p.Phrase) else ([leaf], most)
        if bound is not None:
            sets += [(one, bound, asked(replace(index, buckets=0), one, of_fields(leaf, fields))) for one in inner if isinstance(one, p.Multi)]
    if not sets:
        return
    words = (index.terms if index.terms is not None else index.postings).where(functools.reduce(operator.or_, [c for _, _, c in sets])).select("field", "term").distinct()
    counts = words.agg(*[F.count_if(c).alias(str(i)) for i, (_, _, c) in enumerate(sets)]).first()
    for (one, bound, _), n in zip(sets, counts):
        if n > bound:
            raise QueryTooComplex(f"Query too complex: over {bound} words match {one.text}")


def predicate(criterion: c.Criterion) -> Column | None:
    """A criterion on document columns as a two-valued condition, or null where it needs postings.

    String fields are compared as they are; keyword fields by their normal form.
    """
    if isinstance(criterion, c.MatchAll):
        return F.lit(True)
    if isinstance(criterion, c.ValueIn):
        f = catalog.of_kind(criterion.field, "String", "UntokenizedText", "MultiString")
        if f.kind == "MultiString":
            return F.coalesce(F.arrays_overlap(f.compared, F.array(*map(F.lit, criterion.values))), F.lit(False)) if criterion.values else F.lit(False)
        values = [keyword_text(v) for v in criterion.values] if f.keyword else list(criterion.values)
        return F.coalesce(F.col(f.compared).isin(*values), F.lit(False))
    if isinstance(criterion, c.StartsWith):
        f = catalog.of_kind(criterion.field, "String", "UntokenizedText")
        return F.coalesce(F.col(f.compared).startswith(keyword_text(criterion.prefix) if f.keyword else criterion.prefix), F.lit(False))
    if isinstance(criterion, (c.GreaterThanOrEqualTo, c.LessThanOrEqualTo)):
        column = F.col(catalog.of_kind(criterion.field, "Integer").column)
        return F.coalesce(column >= criterion.value if isinstance(criterion, c.GreaterThanOrEqualTo) else column <= criterion.value, F.lit(False))
    if criterion.parts:
        parts = [predicate(x) for x in criterion.parts]
        if any(x is None for x in parts):
            return None
        return ~parts[0] if isinstance(criterion, c.Not) else functools.reduce(operator.and_ if isinstance(criterion, c.And) else operator.or_, parts)
    return None


def scores(index: Index, criterion: c.Criterion) -> DataFrame:
    """Rows ``(doc_ref, score)`` of the documents that match; conditions on columns become one filter on the documents' scan."""
    if isinstance(criterion, c.Contains):
        for name in criterion.fields:
            if not catalog.field(name).tokenized:
                raise WrongFieldType(f"{name} is not tokenized")
        return node_scores(index, p.parse(criterion.query, index.language, criterion.strict), criterion.fields)
    if isinstance(criterion, c.Not):
        plain = predicate(criterion)
        if plain is not None:
            return _constant(index.docs.where(plain))
        return _constant(index.docs.join(scores(index, criterion.parts[0]), "doc_ref", "left_anti"))
    if isinstance(criterion, c.And):
        found = None
        for part in criterion.parts:
            own = scores(index, part)
            found = own if found is None else found.join(own.withColumnRenamed("score", "more"), "doc_ref").select("doc_ref", (F.col("score") + F.col("more")).alias("score"))
        return found
    if isinstance(criterion, c.Or):
        return _summed([scores(index, part) for part in criterion.parts])
    return _constant(index.docs.where(predicate(criterion)))


def matched_tokens(index: Index, node: p.Node | None, field: str = "Text") -> DataFrame:
    """The postings of ``field`` that stand in a match of a positive leaf; of a phrase only those inside its matches.

    Leaves that are no phrases are one filter. The words of phrases are one more pass for each phrase.
    """
    found = p.positive_leaves(node)
    frames = []
    single = [x for x in found if not isinstance(x, p.Phrase)]
    if single:
        frames.append(index.postings.where((F.col("field") == field) & functools.reduce(operator.or_, [asked(index, x, (field,)) for x in single])))
    for leaf in (x for x in found if isinstance(x, p.Phrase)):
        asks = [asked(index, s, (field,)) for _, s in leaf.slots]
        own = index.postings.where(functools.reduce(operator.or_, asks)).withColumn("slots", F.array(*[F.when(a, i) for i, a in enumerate(asks)]))
        hit = starts(index, leaf, (field,)).select("doc_ref", "first", "last", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(o).alias("o")) for i, (o, _) in enumerate(leaf.slots)])).alias("s"))
        if leaf.slop and not leaf.gaps:
            within = F.col("position").between(F.col("first"), F.col("last"))
        else:
            within = (F.col("position") == F.col("first") + F.col("s.o")) & F.array_contains("slots", F.col("s.i"))
        frames.append(own.join(hit.withColumnRenamed("doc_ref", "d"), (F.col("doc_ref") == F.col("d")) & within, "left_semi").drop("slots"))
    if not frames:
        return index.postings.where(F.lit(False))
    return frames[0] if len(frames) == 1 else functools.reduce(DataFrame.unionByName, frames).distinct()


def candidates(docs: DataFrame, node: p.Node | None, text: str = "text") -> DataFrame:
    """The documents whose text may hold a positive leaf, by built-in expressions before any analysis.

    For a language that leaves words as they stand but for case: each word of a leaf is then part of the lower-cased text.
    Sets of words by a pattern are not looked for; a query with one keeps all documents.
    """
    low = F.lower(text)

    def may(leaf: p.Node) -> Column:
        if isinstance(leaf, p.Phrase):
            return functools.reduce(operator.and_, [may(s) for _, s in leaf.slots])
        if isinstance(leaf, p.Term):
            return functools.reduce(operator.or_, [low.contains(w) for w in leaf.words])
        return low.contains(leaf.text) if leaf.kind == "prefix" else F.lit(True)

    found = p.positive_leaves(node)
    return docs.where(functools.reduce(operator.or_, [may(x) for x in found])) if found else docs.where(F.lit(False))
