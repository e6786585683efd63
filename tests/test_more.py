"""Golden cases of the query language, the written index, lookups, suggestions and changes."""

import dataclasses
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from quirespark import queries
from quirespark.errors import QueryTooComplex, UnparsableQuery
from quirespark.functions import text as ft
from quirespark.languages import ENGLISH, PLAIN, YIDDISH
from quirespark.operators import layout, lookup, search, snippets
from quirespark.operators.indexing import Segments
from quirespark.plans import criteria as c
from quirespark.plans import parser as p
from quirespark.plans.match import Index, candidates, matched_tokens, scores, starts
from quirespark.sources import alto
from quirespark.streaming import reindex

TEXTS = [("a", "one b one c one"), ("b", "one two three"), ("c", "big apple city life"), ("d", "the cat sat on nyc"), ("e", "x one y two z"), ("f", "")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(ref, text, title, "Ann") for (ref, text), title in zip(TEXTS, ("Élan vital", "Plain", "elan", "NYC", "", None))]
    return spark.createDataFrame(rows, "doc_ref string, text string, title string, author string")


def refs(found):
    return sorted(r.doc_ref for r in found.collect())


def asked(docs, query, fields=("Text",), language=PLAIN, strict=False):
    return refs(scores(search.index_of(docs, language), c.Contains(fields, query, strict)))


def test_slop(docs):
    """Each place of a phrase with slop takes a word of its own."""
    assert asked(docs, '"one one one"~2') == ["a"]
    assert asked(docs, '"one one one"~1') == [] and asked(docs, '"one one one one"~9') == []
    assert asked(docs, '"two one"~1') == ["b", "e"] and asked(docs, '"two one"~0') == []
    assert asked(docs, '"two o*"~1') == ["b", "e"] and asked(docs, '"one o* b"~5') == ["a"]
    index = search.index_of(docs)
    found = starts(index, p.parse('"one one"~3'), ("Text",))
    assert sorted((r.doc_ref, r.first, r["last"]) for r in found.collect()) == [("a", 0, 2), ("a", 2, 4)]


def test_language(docs):
    """Stop words go from words, strict or not, and stay in phrases; synonyms of several words are phrases."""
    own = dataclasses.replace(PLAIN, stop_words=frozenset({"the", "on"}), synonyms=(("nyc", "big apple"), ("cat", "feline")))
    assert asked(docs, "the", language=own) == [] == asked(docs, "the", language=own, strict=True)
    assert asked(docs, '"the cat"', language=own) == ["d"]
    assert asked(docs, "nyc", language=own) == ["c", "d"] and asked(docs, "nyc", language=own, strict=True) == ["d"]
    assert asked(docs, '"nyc city"', language=own) == ["c"]
    assert asked(docs, "feline", language=own) == ["d"]
    many = dataclasses.replace(PLAIN, synonyms=tuple((f"w{i}", f"a{i} b{i}") for i in range(12)))
    with pytest.raises(QueryTooComplex):
        p.parse('"' + " ".join(f"w{i}" for i in range(12)) + '"', many)


def test_folded_fields(docs):
    """Titles are folded on both sides, texts on neither."""
    for query in ("Élan", "elan", "ÉLAN", "el*", "[elam TO elap]", "elam~1", '"élan vital"'):
        assert "a" in asked(docs, query, ("Title",)), query
    assert asked(docs, "elan", ("Title",)) == ["a", "c"]


def test_boosts_and_ranges(docs):
    index = search.index_of(docs)
    score = lambda q: {r.doc_ref: r.score for r in scores(index, c.Contains(("Text",), q)).collect()}
    plain, boosted = score("two cat"), score("(two cat)^3")
    assert boosted == pytest.approx({k: 3 * v for k, v in plain.items()})
    assert score("two^2 cat")["b"] == pytest.approx(2 * plain["b"]) and score("((two)^2)^2")["b"] == pytest.approx(4 * plain["b"])
    assert asked(docs, "[sat TO two]") == ["b", "d", "e"] and asked(docs, "{sat TO two}") == ["b", "d"] and asked(docs, "[* TO b]") == ["a", "c"]
    assert asked(docs, "{sat TO *]") == ["b", "d", "e"]
    for bad in ("[a", "a TO b]", "[a b]"):
        with pytest.raises(UnparsableQuery):
            p.parse(bad)


def test_clauses(docs):
    """A prefix, wildcard, range or pattern that stands for too many words is refused by a search, in phrases too."""
    engine = search.Engine(search.index_of(docs), most_clauses=3)
    assert engine.total(c.Contains(("Text",), "o*")).first().total == 4
    for query in ("*", "[a TO z]", "/.*/", '"one *e"', "one NOT t* NOT ??*"):
        with pytest.raises(QueryTooComplex):
            engine.search(c.And(c.ValueIn("Author", ("ann",)), c.Contains(("Text",), query)))
    assert search.Engine(search.index_of(docs), most_clauses=None).total(c.Contains(("Text",), "*")).first().total == 5


def test_many_words_of_a_prefix(spark, tmp_path):
    """A prefix alone may stand for more words than the bound of phrases; the whole count is that of the query's SQL."""
    texts = [" ".join(f"th{i:x}" for i in range(at, at + 1000)) for at in range(0, 17000, 1000)] + ["of thus", "Th", "of no such word", "", None]
    docs = spark.createDataFrame([(i, x, "en", "src1", len(x or "")) for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    own = duckdb.connect()
    own.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert queries.queries()["total_of_prefix"](spark, str(tmp_path)).first().total == 19 == own.execute(queries.oracle_sql()["total_of_prefix"]).fetchone()[0]
    engine = queries.engine(spark, str(tmp_path))
    with pytest.raises(QueryTooComplex):
        engine.total(c.Contains(("Text",), '"of th*"'))
    assert dataclasses.replace(engine, most_in_phrase=None).total(c.Contains(("Text",), '"of th*"')).first().total == 1
    with pytest.raises(QueryTooComplex):
        dataclasses.replace(engine, most_clauses=16384).total(c.Contains(("Text",), "th*"))


def test_tree(docs):
    """Clauses are one pass: conjunctions, prohibitions, and what only prohibits."""
    assert asked(docs, "one AND two") == ["b", "e"] and asked(docs, "one NOT two") == ["a"] and asked(docs, "NOT two") == []
    assert asked(docs, "+two three") == ["b", "e"] and asked(docs, "(one AND y) OR sat") == ["d", "e"] and asked(docs, "one AND (b OR z)") == ["a", "e"]
    plan = scores(search.plain_index(docs), c.Contains(("Text",), "one AND (b OR z) NOT q"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 3


def test_candidates(docs):
    for query in ("one", '"one two"', "cat NOT sat", "o*", "s?t", '"cat sat"~2', "ONE"):
        node = p.parse(query)
        whole = refs(matched_tokens(Index(docs, ft.token_table(docs)), node).select("doc_ref").distinct())
        few = candidates(docs, node)
        assert refs(matched_tokens(Index(few, ft.token_table(few)), node).select("doc_ref").distinct()) == whole


def test_written_index(spark, docs, tmp_path):
    """Segments answer as an index made at once does, after changes and when made one; a word reads one folder."""
    for analyse, language in ((True, ENGLISH), (False, PLAIN)):
        index = Segments(f"file://{tmp_path}/{analyse}", language, analyse, 8)
        index.upsert(docs)
        index.count(spark)
        changed = spark.createDataFrame([("a", "four cats", "New", "Ann"), ("g", "one more", "Seven", "Bob")], docs.schema)
        now = docs.where("doc_ref not in ('a', 'b')").unionByName(changed)
        queries = ("one", "one AND more", '"one more"', "c*", '"cat sat"~2', "four OR sat")
        for step in range(3):
            if step == 1:
                index.upsert(changed, spark.createDataFrame([("b",)], "doc_ref string"))
            if step == 2:
                index = index.compacted(spark, f"file://{tmp_path}/{analyse}-whole")
            held = index.open(spark)
            fresh = search.index_of(docs if step == 0 else now, language, analyse)
            for query in queries:
                mine, other = ({r.doc_ref: round(r.score, 9) for r in scores(x, c.Contains(("Text", "Title"), query)).collect()} for x in (held, fresh))
                assert mine == other, (analyse, step, query)
            stats = [sorted(map(tuple, x.term_stats().select("field", "term", "df", "cf").collect())) for x in (held, fresh)]
            assert stats[0] == stats[1]
        held = index.open(spark)
        assert held.terms is not None
        plan = scores(held, c.Contains(("Text",), "one"))._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [" in plan and "bucket" in plan


def test_split_buckets(spark, tmp_path, monkeypatch):
    """Many documents: a bucket is written by several tasks, and a word that all have is in several files of its one folder."""
    import glob

    from quirespark.operators import indexing

    monkeypatch.setattr(indexing, "SPLIT_DOCS", 100)
    many = spark.range(1000).select(F.concat(F.lit("d"), "id").alias("doc_ref"), F.concat(F.lit("common w"), F.col("id") % 7).alias("text"))
    index = Segments(f"file://{tmp_path}/s", buckets=4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else tables as small as this are put together
    try:
        index.upsert(many)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    folders = [glob.glob(f"{f}/*.parquet") for f in glob.glob(f"{tmp_path}/s/segment=00000000/postings/field=Text/bucket=*")]
    assert 1 < len(folders) <= 4 and max(map(len, folders)) > 1
    held = index.open(spark)
    assert scores(held, c.Contains(("Text",), "common")).count() == 1000 and scores(held, c.Contains(("Text",), "common AND w3")).count() == 143


def test_reindex(spark, docs, tmp_path):
    """Changed documents with their corrections; gone ones lose their entries; metadata alone leaves the texts as they were."""
    index = Segments(f"file://{tmp_path}/i")
    index.upsert(docs)
    made = spark.createDataFrame([(1, "Title", "Corrected", False, 1)], "id long, field string, new_value string, ignore boolean, rev long")
    links = spark.createDataFrame([(1, "c")], "correction_id long, doc_ref string")
    changed = spark.createDataFrame([("c",), ("zz",)], "doc_ref string")
    status = reindex.reindex(index, docs, changed, made, links)
    assert sorted(map(tuple, status.collect())) == [("c", "Indexed"), ("zz", "Gone")]
    assert refs(scores(index.open(spark), c.Contains(("Title",), "corrected"))) == ["c"]
    other = docs.withColumns({"text": F.lit("must not be read"), "title": F.lit("Metadata")})
    reindex.metadata_only(index, other, spark.createDataFrame([("b",)], "doc_ref string"))
    held = index.open(spark)
    assert refs(scores(held, c.Contains(("Title",), "metadata"))) == ["b"] and refs(scores(held, c.Contains(("Text",), "three"))) == ["b"]
    assert refs(scores(held, c.Contains(("Text",), "must"))) == []


def test_broken_words(spark):
    assert ft.broken('"רמב"ם"') == ['"', 'רמב"ם', '"']
    assert ft.broken("3.14,x") == ["3.14", ",", "x"] and ft.broken("it's.") == ["it's", "."] and ft.broken("...") == [".", ".", "."] and ft.broken("word") == ["word"] and ft.broken("") == [""]
    rect = F.struct(F.lit(100).alias("left"), F.lit(0).alias("top"), F.lit(70).alias("width"), F.lit(10).alias("height"))
    word = spark.createDataFrame([('"רמב"ם"',)], "content string").withColumn("rect", rect)
    for rtl, lefts in ((True, [160, 110, 100]), (False, [100, 110, 160])):
        parts = word.select(F.inline(layout.word_parts(F.col("content"), F.col("rect"), rtl))).collect()
        assert [x.rect.width for x in parts] == [10, 50, 10] and [x.rect.left for x in parts] == lefts


def test_suggested_pieces(spark):
    """A suggestion over two words takes its rectangle, is cut at punctuation, and gives its hyphen up at the end of a row."""
    box = lambda left, top, width: (left, top, width, 10)
    words = [("d", 0, 0, 0, "one", box(0, 0, 30)), ("d", 0, 0, 1, "tow", box(40, 0, 30)), ("d", 0, 1, 2, "a", box(0, 10, 10)), ("d", 0, 1, 3, "bx", box(20, 10, 20)), ("d", 0, 1, 4, "c", box(42, 10, 10))]
    schema = "doc_ref string, page_no int, row_no int, word_no int, content string, rect struct<left:int,top:int,width:int,height:int>"
    made = [("d", 0, 1, False, "two,", box(40, 0, 30)), ("d", 0, 2, False, "bet-", box(20, 10, 32)), ("d", 0, 3, True, "no", box(0, 0, 30))]
    table = spark.createDataFrame(made, "doc_ref string, page_no int, rev long, ignore boolean, suggestion string, grid struct<left:int,top:int,width:int,height:int>")
    pages = spark.createDataFrame([("d", 0, 10_000, 10_000)], "doc_ref string, page_no int, width int, height int")
    found = layout.suggested_pieces(spark.createDataFrame(words, schema), table, pages).orderBy("word_no", "part").collect()
    assert [(r.word_no, r.content, r.kind, r.rect.left, r.rect.width) for r in found] == [(0, "one", "word", 0, 30), (1, "two", "word", 40, 23), (1, ",", "word", 63, 7), (2, "a", "word", 0, 10), (3, "bet", "word", 20, 24), (3, "-", "hyphen", 44, 8)]


def test_hyphen_direction(spark):
    row = spark.createDataFrame([("bet-", (20, 0, 33, 10))], "content string, rect struct<left:int,top:int,width:int,height:int>")
    for rtl, places in ((False, [(20, 24), (44, 8)]), (True, [(28, 24), (20, 8)])):
        got = row.select(F.inline(layout.hyphen_split(F.col("content"), "rect", rtl))).collect()
        assert [(x.content, x.kind) for x in got] == [("bet", "word"), ("-", "hyphen")] and [(x.rect.left, x.rect.width) for x in got] == places


def test_highlighted_pages(spark):
    """Tokens that stand twice or overlap are marked once, cut at line ends, with divisions and the printed number."""
    rows = spark.createDataFrame([("d", 0, 0, "12", 10, 12), ("d", 0, 1, "", 13, 13), ("d", 0, 2, "Is the c-", 14, 23), ("d", 0, 3, "at happy?", 24, 33)], "doc_ref string, page_no int, row_no int, line string, start_offset int, end_offset int")
    hits = spark.createDataFrame([("d", 0, 21, 26), ("d", 0, 21, 26), ("d", 0, 22, 30), ("d", 0, 27, 32)], "doc_ref string, page_no int, start int, end int")
    plain = snippets.highlighted_pages(rows, hits).first()
    assert plain.text == "12\n\nIs the c-\nat happy?" and plain.logical_page == 12
    assert [(h.start, h.end) for h in plain.highlights] == [(11, 13), (14, 16), (17, 22)]
    marked = snippets.highlighted_pages(rows, hits, html=True).first()
    assert marked.text == '<div class="snippet">12</div><div class="snippet">Is the <b>c-</b><br><b>at</b> <b>happy</b>?</div>'


def test_touching_tokens(spark):
    """In a snippet, tokens that touch or overlap are marked as one."""
    found = spark.createDataFrame([("d", 0, 11, [(0, 3), (3, 5), (4, 7), (8, 11)])], "doc_ref string, start int, end int, tokens array<struct<start:int,end:int>>")
    docs = spark.createDataFrame([("d", "abcdefg hij")], "doc_ref string, text string")
    assert snippets.snippets(found, docs).first().snippet == "<b>abcdefg</b> <b>hij</b>"


def test_best_snippets(spark):
    """The best two of three snippets, in the order of the text."""
    rows = spark.createDataFrame([("d", 0, i, 10 * i, 10 * i + 9) for i in range(20)], "doc_ref string, page_no int, row_no int, start_offset int, end_offset int")
    hits = spark.createDataFrame([("d", 0, r, 10 * r + k, 10 * r + k + 1) for r, n in ((1, 1), (8, 2), (15, 3)) for k in range(n)], "doc_ref string, page_no int, row_no int, start int, end int")
    assert [(r.first_row, r.score) for r in snippets.islands(hits, rows, 1, 2).collect()] == [(7, 2.0), (14, 3.0)]
    assert len(snippets.islands(hits, rows, 1, None).collect()) == 3


def test_sources(spark, tmp_path):
    """Synonym files as text and zip reach a language; a broken image zip gives an error row."""
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.txt").write_text("# no\nnyc, Big Apple\ncat => feline\n")
    with zipfile.ZipFile(tmp_path / "s" / "b.zip", "w") as z:
        z.writestr("w.txt", "one, uno")
    lines = alto.synonym_lines(spark, f"file://{tmp_path}/s/a.txt", f"file://{tmp_path}/s/b.zip")
    assert lines == (("nyc", "big apple"), ("cat", "feline"), ("one", "uno"))
    assert PLAIN.with_synonyms(lines).synonyms_of("uno") == ("uno", "one")
    assert {(r.word, r.other) for r in alto.synonyms(spark, f"file://{tmp_path}/s/b.zip").collect()} == {("one", "uno"), ("uno", "one")}
    with zipfile.ZipFile(tmp_path / "i.zip", "w") as z:
        z.writestr("p1.png", b"png")
        z.writestr("x.txt", b"no")
    (tmp_path / "j.zip").write_bytes(b"nothing")
    found = {r.path.rsplit("/", 1)[1]: (r.entry, r.content and bytes(r.content), bool(r.error)) for r in alto.images(spark, f"file://{tmp_path}/*.zip").collect()}
    assert found == {"i.zip": ("p1.png", b"png", False), "j.zip": (None, None, True)}


def test_yiddish():
    assert YIDDISH.normalised("אﬞׅׄ") == "אא" and YIDDISH.decompose("ײַ") == "ײַ"
    node = p.parse("yidish", YIDDISH)
    assert node.words[:2] == ("yidish", "יידיש")


def test_simplified(spark):
    docs = spark.createDataFrame([("a", "Colour"), ("b", None)], "doc_ref string, text string")
    simple = dataclasses.replace(PLAIN, simplify=lambda x: x.replace("ou", "o"))
    assert [r.text for r in ft.simplified(docs, simple).orderBy("doc_ref").collect()] == ["Color", None]
    assert ft.simplified(docs, PLAIN) is docs


def test_physical_pages(spark):
    """The last page of an offset counts; numbers that are left out come with no text; unknown pages are -1."""
    pages = spark.createDataFrame([(1, 2, 0), (1, 3, 0), (1, 6, 50)], "rev int, page_no int, start_offset int")
    found = spark.createDataFrame([(1, 0, "x"), (1, 20, "?"), (1, 50, "y")], "rev int, start_offset int, text string")
    got = sorted((r.start_offset, r.page_no, r.text) for r in lookup.physical_pages(found, pages).collect())
    assert got == [(0, 3, "x"), (20, -1, "?"), (50, 4, ""), (50, 5, ""), (50, 6, "y")]


def test_criteria_trees():
    """The first query string of a tree, and all of them changed."""
    tree = c.And(c.ValueIn("Author", ("x",)), c.Or(c.Not(c.Contains(("Title",), "one", True)), c.Contains(("Text",), "two")))
    assert tree.contains() == c.Contains(("Title",), "one", True) and c.MatchAll().contains() is None
    changed = tree.replaced(str.upper)
    assert [x.query for x in search.contains(changed)] == ["ONE", "TWO"] and [x.query for x in search.contains(tree)] == ["one", "two"]
    assert refs_of(changed) == refs_of(tree)


def refs_of(criterion):
    return [type(x).__name__ for x in (criterion, *criterion.parts)]


def test_escaped_brackets():
    assert p.parse(r"\[a") == p.parse("a") and p.parse(r"a\]") == p.parse("a")


def test_where_required(spark, docs, tmp_path):
    """A new revision is analysed, a correction changes the fields alone, the rest is left; what was done is noted and not done again."""
    index = Segments(f"file://{tmp_path}/w")
    index.upsert(docs)
    state = {
        "documents": spark.createDataFrame([("a", 1, "Complete", None), ("a", 7, "Complete", None), ("b", 2, "Complete", None), ("c", 3, "Complete", None)], "reference string, rev long, status string, failure_reason string"),
        "suggestions": spark.createDataFrame([], "doc_ref string, rev long"),
        "corrections": spark.createDataFrame([(1, "Title", "Put right", False, 9)], "id long, field string, new_value string, ignore boolean, rev long"),
        "links": spark.createDataFrame([(1, "b")], "correction_id long, doc_ref string"),
        "indexed": spark.createDataFrame([("a", 1, None, "No"), ("b", 2, None, "No"), ("c", 3, None, "No")], "reference string, doc_rev long, word_suggestion_rev long, reindex string").withColumn("index_time", F.lit(None).cast("timestamp")),
        "indexed_corrections": spark.createDataFrame([], "reference string, field string, metadata_correction_rev long"),
    }
    newer = docs.withColumn("text", F.when(F.col("doc_ref") == "a", "brand new words").otherwise("must not be read"))
    indexed, noted = reindex.where_required(index, newer, state, "2024-01-01 00:00:00")
    held = index.open(spark)
    assert refs(scores(held, c.Contains(("Text",), "brand"))) == ["a"] and refs(scores(held, c.Contains(("Text",), "must"))) == []
    assert refs(scores(held, c.Contains(("Title",), '"put right"'))) == ["b"] and refs(scores(held, c.Contains(("Text",), "three"))) == ["b"]
    assert sorted((r.reference, r.doc_rev, r.index_time is not None) for r in indexed.collect()) == [("a", 7, True), ("b", 2, True), ("c", 3, False)]
    assert [tuple(r) for r in noted.collect()] == [("b", "Title", 9)]
    after = state | {"indexed": indexed, "indexed_corrections": noted}
    from quirespark.operators import corrections

    assert corrections.to_reindex(**after).count() == 0
    documents, left = reindex.failed(state | {"indexed": indexed.withColumn("reindex", F.lit("Yes"))}, spark.createDataFrame([("a",)], "reference string"), "broken")
    assert {(r.reference, r.rev): (r.status, r.failure_reason) for r in documents.collect()}[("a", 7)] == ("Failed", "broken") and documents.where("status = 'Failed'").count() == 1
    assert {r.reference: r.reindex for r in left.collect()} == {"a": "No", "b": "Yes", "c": "Yes"}
