"""Small texts with known answers: analysis, the query language, snippets, corrections."""

import datetime

import pytest
from pyspark.sql import functions as F

from quirespark import errors
from quirespark.functions import text as ft
from quirespark.functions.geometry import from_grid, to_grid
from quirespark.languages import ENGLISH, PLAIN, YIDDISH, Language
from quirespark.operators import corrections, layout, snippets, stats, store
from quirespark.operators.search import Engine, index_of
from quirespark.plans import criteria as c
from quirespark.plans import parser as p
from quirespark.plans.match import matched_tokens, scores

DOCS = [
    ("doc1", "שלום־עליכם װעלט", "Hello World", "Joe Schmoe", "דשאָו שמאָו", "1917", "Hello world!\n\nHello you.\n\nNice day to-\nday, Madam.\nIsn't it?\n\nOh yes, it is."),
    ("doc2", None, "Hello people", "Jack Sprat", None, "[192_]", "Hello people.\nHow are you?\n\nFine, thank you.\n\nWith pleasure.\n\n\nThink it will rain\ntomorrow? Oh no, I\ndon't think so.\n\n\nI think it will be\nsunny tomorrow, and even\nthe day after"),
    ("doc3", None, "Hi everyone", "Joe Schmoe", None, "1937", "Hello everyone"),
    ("doc4", None, "With great pleasure", "Joe Schmoe", None, "1937", "With pleasure.\nWith great pleasure.\nReally."),
]


@pytest.fixture(scope="module")
def engine(spark):
    docs = spark.createDataFrame(DOCS, "doc_ref string, title string, title_en string, author string, author_en string, pub_year_raw string, text string")
    hyphen = F.when(F.col("doc_ref") == "doc1", F.array(F.instr("text", "to-") - 1)).otherwise(F.array().cast("array<int>"))
    other = F.when(F.col("text").startswith("Hello"), F.create_map(F.lit(0), F.array(F.lit("hi"), F.lit("howdy"))))
    return Engine(index_of(docs.withColumn("hyphenated", hyphen).withColumn("alternatives", other), ENGLISH))


def refs(engine, query, **more):
    return {r.doc_ref for r in scores(engine.index, c.Contains(("Text",), query, **more)).collect()}


@pytest.mark.parametrize(
    ("query", "found"),
    [
        ("world", {"doc1"}),
        ("Hello", {"doc1", "doc2", "doc3"}),
        ('"Hi World"', {"doc1"}),
        ("today", {"doc1"}),
        ('"will rain tomorrow"', {"doc2"}),
        ('"will * tomorrow"', {"doc2"}),
        ('"tomorrow rain"', set()),
        ('"tomorrow rain"~3', {"doc2"}),
        ('"With * pleasure"', {"doc4"}),
        ("plea*", {"doc2", "doc4"}),
        ('"With gr* pleasure"', {"doc4"}),
        ('"With *eat pleasure"', {"doc4"}),
        ("world pleasure", {"doc1", "doc2", "doc4"}),
        ("hello AND world", {"doc1"}),
        ("hello -world", {"doc2", "doc3"}),
        ("+hello +(everyone OR people)", {"doc2", "doc3"}),
        ("plaesure~2", {"doc2", "doc4"}),
        ("/ever.*/", {"doc3"}),
        ("„hello everyone“", {"doc3"}),
        ("w?rld^2", {"doc1"}),
    ],
)
def test_queries(engine, query, found):
    assert refs(engine, query) == found


@pytest.mark.parametrize("query", ['"', "", "(a", "AND a", "a )"])
def test_unparsable(query):
    with pytest.raises(errors.UnparsableQuery):
        p.parse(query)


def test_too_complex(engine):
    from quirespark.plans.match import check_clauses

    with pytest.raises(errors.QueryTooComplex):
        check_clauses(engine.index, p.parse("t*"), ("Text",), 2)


def test_criteria(engine):
    def found(x):
        return {r.doc_ref for r in scores(engine.index, x).collect()}

    assert found(c.build(title="Hello")) == {"doc1", "doc2"}
    assert found(c.ValueIn("Author", ("joe schmoe",))) == {"doc1", "doc3", "doc4"}
    assert found(c.build(from_year=1920, to_year=1930)) == {"doc2"}
    assert found(c.Not(c.Contains(("Text",), "hello"))) == {"doc4"}
    assert found(c.build(query="hello", authors=("Jack Sprat",), include_authors=False)) == {"doc1", "doc3"}
    assert found(c.MatchAll()) == {"doc1", "doc2", "doc3", "doc4"}
    with pytest.raises(errors.NoSearchCriteria):
        c.build(match_all=False)
    with pytest.raises(errors.WrongFieldType):
        found(c.Contains(("Author",), "x"))
    told = c.And(c.Contains(("Text",), "a"), c.Not(c.ValueIn("Author", ("b",))))
    assert c.from_dict(told.as_dict()) == told
    assert told.replaced(str.upper).contains().query == "A"


def test_facets_and_authors(engine):
    def pairs(x):
        return [tuple(r) for r in x.collect()]

    hello = c.Contains(("Text",), "Hello")
    assert pairs(engine.facet(hello, "Author", 2)) == [("Joe Schmoe", 2), ("Jack Sprat", 1)]
    assert pairs(engine.facet(hello, "Author", 1)) == [("Joe Schmoe", 2)]
    assert pairs(engine.facet(hello, "Author", 2, True)) == [("Jack Sprat", 1), ("Joe Schmoe", 2)]
    assert pairs(engine.top_authors("J", 5)) == [("Jack Sprat", 1), ("Joe Schmoe", 3)]
    assert pairs(engine.top_authors("Jo", 5)) == [("Joe Schmoe", 3)]
    assert pairs(engine.top_authors("ד", 5)) == [("דשאָו שמאָו", 1)]
    with pytest.raises(errors.IndexFieldNotAggregatable):
        engine.facet(hello, "Title")
    with pytest.raises(errors.UnknownIndexField):
        engine.facet(hello, "Nothing")
    with pytest.raises(errors.DocumentNotFoundInIndex):
        engine.document("nowhere")
    with pytest.raises(errors.UnknownSort):
        engine.search(hello, "Sideways")


def test_sorts(engine):
    assert [r.doc_ref for r in engine.search(c.MatchAll(), "DateAscending").collect()] == ["doc1", "doc2", "doc3", "doc4"]
    assert [r.doc_ref for r in engine.search(c.MatchAll(), "DocReference", 1, 2).collect()] == ["doc2", "doc3"]
    assert engine.search(c.Contains(("Text",), "pleasure")).first().score > 0


def shown(engine, query, padding, offsets=False):
    docs = engine.index.docs
    rows = layout.lines(docs).withColumn("page_no", F.lit(0))
    hits = matched_tokens(engine.index, p.parse(query, ENGLISH)).select("doc_ref", "page_no", "row_no", "start", "end")
    found = snippets.islands(hits, rows, padding)
    return [r.snippet for r in snippets.snippets(found, docs, offsets=offsets).orderBy("doc_ref", "start").collect()]


def test_snippets(engine):
    assert shown(engine, "are", 0) == ["How <b>are</b> you?"]
    assert shown(engine, "are", 1) == ["Hello people.<br>How <b>are</b> you?<br>"]
    assert len(shown(engine, "think", 0)) == 3
    assert shown(engine, '"will * tomorrow"', 0) == ["Think it <b>will</b> rain<br><b>tomorrow</b>? Oh no, I"]
    assert shown(engine, "are", 0, True) == ['<span offset="14">How </span><b><span offset="18">are</span></b><span offset="21"> you?</span>']


def test_highlighted_pages(spark):
    """Highlights count from their page's start; those that touch stay two on a page (in a snippet they are one), and a page without any has none."""
    rows = spark.createDataFrame([("d", 0, 0, "one two", 0, 7), ("d", 0, 1, "three", 8, 13), ("d", 1, 2, "four five", 14, 23), ("d", 2, 3, "six", 24, 27)], "doc_ref string, page_no int, row_no int, line string, start_offset int, end_offset int")
    hits = spark.createDataFrame([("d", 4, 7), ("d", 14, 18), ("d", 18, 23), ("d", 8, 13)], "doc_ref string, start int, end int")
    found = {r.page_no: (r.text, [(h["start"], h["end"]) for h in r.highlights or ()]) for r in snippets.highlighted_pages(rows, hits).collect()}
    assert found == {0: ("one two\nthree", [(4, 7), (8, 13)]), 1: ("four five", [(0, 4), (4, 9)]), 2: ("six", [])}


def test_layout_values(spark):
    """A page number too long for an integer is none; far places of large pages do not overflow; groups keep their text."""
    one = spark.createDataFrame([("99999999999\n\nx", 9_999, 300_000)], "t string, v int, size int")
    row = one.select(layout.logical_page(F.col("t")).alias("n"), from_grid(F.col("v"), F.col("size")).alias("a"), to_grid(F.lit(299_970), F.col("size")).alias("b")).first()
    assert (row.n, row.a, row.b) == (None, 299_970, 9_999)
    words_ = spark.createDataFrame([(1, 0, 2), (1, 2, 3), (1, 4, 6)], "rev int, start_offset int, end_offset int")
    texts = spark.createDataFrame([(1, "ab! cd")], "rev int, text string")
    assert sorted((r.start_offset, r.end_offset, r.text) for r in layout.group_text(words_, texts).collect()) == [(0, 3, "ab!"), (4, 6, "cd")]


def test_ignored_suggestions(spark):
    table = spark.createDataFrame([("a", False, 1), ("b", False, 2), ("a", False, 3), (None, False, 4)], "username string, ignore boolean, rev int")
    found = corrections.ignored_suggestions(table, "a", 10).collect()
    assert sorted((r.username or "", r.ignore, r.rev) for r in found) == [("", False, 4), ("a", True, 10), ("a", True, 11), ("b", False, 2)]


def test_snippet_islands_against_a_walk(spark):
    """Random rows and padding: islands against joining rows one by one."""
    import random

    r = random.Random(3)
    for padding in (0, 1, 2):
        hits, rows, expected = [], [], []
        for d in range(25):
            n = r.randrange(1, 25)
            marked = sorted(r.sample(range(n), r.randrange(0, min(n, 6) + 1)))
            rows += [(f"d{d}", 0, i, 10 * i, 10 * i + 9) for i in range(n)]
            hits += [(f"d{d}", 0, i, 10 * i, 10 * i + 3) for i in marked]
            run = []
            for i in marked:
                if run and i - run[-1] <= 2 * padding + 1:
                    run[-1:] = [run[-1], i][1:]
                    expected[-1] = (f"d{d}", expected[-1][1], min(n - 1, i + padding))
                else:
                    expected.append((f"d{d}", max(0, i - padding), min(n - 1, i + padding)))
                    run.append(i)
        found = snippets.islands(spark.createDataFrame(hits, "doc_ref string, page_no int, row_no int, start int, end int"), spark.createDataFrame(rows, "doc_ref string, page_no int, row_no int, start_offset int, end_offset int"), padding)
        assert sorted((x.doc_ref, x.first_row, x.last_row) for x in found.collect()) == sorted(expected)


def words(text, language, **more):
    return [t.term for t in ft.analysed(text, language, **more)]


def test_analysis():
    assert words("He said: O'Neil's R.S.A. costs $3.50... isn't", ENGLISH) == ["he", "said", ":", "o", "'", "neil", "'s", "r.s.a.", "costs", "$", "3.50", "...", "isn't"]
    joined = ft.analysed("dog to-\nday cat", PLAIN, hyphenated=[4])
    assert [(t.term, t.start, t.end) for t in joined] == [("dog", 0, 3), ("today", 4, 11), ("cat", 12, 15)]
    varied = ft.analysed("dog mouse cat", PLAIN, alternatives={0: ("hound", "cur"), 10: ("feline",)})
    assert [(t.term, t.increment, t.start) for t in varied] == [("dog", 1, 0), ("hound", 0, 0), ("cur", 0, 0), ("mouse", 1, 4), ("cat", 1, 10), ("feline", 0, 10)]
    assert ft.searched("dog * * cat * mouse", PLAIN, gaps=True) == [("dog", 1), ("cat", 3), ("mouse", 2)]
    assert [t.kind for t in ft.analysed("! a, b", PLAIN)] == ["punct", "word", "punct", "word"]
    assert YIDDISH.normalised("אָ") == "א"
    assert YIDDISH.term_filter('רמב"ם') == "רמבם"


def test_synonyms_and_stop_words():
    language = Language(synonyms=(("hello", "hi"),), stop_words=frozenset({"the"}))
    assert p.parse("hello", language).words == ("hello", "hi")
    assert p.parse("hello", language, strict=True).words == ("hello",)
    assert p.positive_leaves(p.parse("the", language)) == []
    assert isinstance(p.parse('"the end"', language), p.Phrase)


def test_years_and_folding(spark):
    rows = spark.createDataFrame([("[192_]",), ("1917",), ("c. 5",), (None,)], "y string").select(ft.year(F.col("y")).alias("y")).collect()
    assert [r.y for r in rows] == [1920, 1917, None, None]
    assert spark.range(1).select(ft.keyword(F.lit("  Élan   Vital")).alias("k")).first().k == ft.keyword_text("  Élan   Vital") == "elan vital"


def test_as_of_and_band(spark):
    rows = spark.createDataFrame([(1, 0, 12, 10), (1, 0, 13, 20), (1, 0, 14, 40), (1, 1, 0, 60)], "rev int, page_no int, row_no int, start_offset int")
    spans = spark.createDataFrame([(1, 7, 10, 45)], "rev int, span int, from_offset int, to_offset int")
    assert sorted(r.row_no for r in layout.rows_between(rows, spans).collect()) == [12, 13, 14]
    far = spark.createDataFrame([(1, 7, 10, 65)], "rev int, span int, from_offset int, to_offset int")
    assert layout.rows_between(rows, far).count() == 0


def test_pages(spark):
    pages = spark.createDataFrame([(1, 42, 10), (1, 43, 20), (1, 44, 20)], "rev int, page_no int, start_offset int")
    assert sorted(r.page_no for r in layout.non_empty_pages(pages).collect()) == [42, 44]
    texts = spark.createDataFrame([("a", 0, "12\n\nHello"), ("b", 1, "Hello\n\n7"), ("c", 2, "x")], "d string, i int, t string")
    assert [r.n for r in texts.orderBy("i").select(layout.logical_page(F.col("t")).alias("n")).collect()] == [12, 7, None]


def test_suggestions(spark):
    rect = "struct<left:int,top:int,width:int,height:int>"
    words_ = spark.createDataFrame([("d", 0, 0, "Loki", (0, 0, 40, 10)), ("d", 0, 1, "is", (50, 0, 20, 10))], f"doc_ref string, page_no int, word_no int, content string, rect {rect}")
    pages = spark.createDataFrame([("d", 0, 100, 100)], "doc_ref string, page_no int, width int, height int")
    made = [("d", 0, 1, False, "Thor", (0, 0, 4000, 1000)), ("d", 0, 2, False, "Odin", (0, 0, 4000, 1000)), ("d", 0, 3, True, "Baldr", (0, 0, 4000, 1000))]
    found = layout.suggested(words_, spark.createDataFrame(made, f"doc_ref string, page_no int, rev int, ignore boolean, suggestion string, grid {rect}"), pages)
    assert [r.content for r in found.orderBy("word_no").collect()] == ["Odin", "is"]


def test_corrections(spark):
    table = spark.createDataFrame([(1, "Author", "A", False, 1), (2, "Author", "B", False, 2)], "id int, field string, new_value string, ignore boolean, rev int")
    links = spark.createDataFrame([(1, "d"), (2, "d")], "correction_id int, doc_ref string")
    docs = spark.createDataFrame([("d", "X"), ("e", "Y")], "doc_ref string, author string")
    assert {r.author for r in corrections.overlaid(docs, table, links).collect()} == {"B", "Y"}
    assert {r.author for r in corrections.overlaid(docs, corrections.undone(table, 2, 3), links).collect()} == {"A", "Y"}
    with pytest.raises(errors.UnknownMetadataCorrectionId):
        corrections.undone(table, 9, 3)
    with pytest.raises(errors.UnknownMetadataField):
        corrections.correction_targets(docs, "d", "Nothing", True)


def test_usage(spark):
    day = datetime.datetime(2024, 1, 2, 3)
    log = spark.createDataFrame([(1, "Joe", day), (2, "Joe", day), (3, "Jim", day), (4, "Jim", day + datetime.timedelta(days=1))], "id int, username string, executed timestamp")
    assert [tuple(r) for r in stats.usage(log, "day", "2024-01-02", "2024-01-02").collect()] == [("2024-01-02", 2, 3)]
    assert [tuple(r) for r in stats.top_users(log, "2024-01-02", "2024-01-02", 5).collect()] == [("Joe", 2), ("Jim", 1)]


def test_snapshots_and_streaming(spark, tmp_path):
    from quirespark.operators.indexing import Segments
    from quirespark.streaming.reindex import follow

    root = "file://" + str(tmp_path)
    docs = spark.createDataFrame([("a", "one two"), ("b", "three"), ("c", "five")], "doc_ref string, text string")
    store.saved(docs, f"{root}/docs")
    store.saved(docs.where("doc_ref <> 'c'"), f"{root}/docs")
    assert len(store.snapshots(spark, f"{root}/docs")) == 2 and store.current(spark, f"{root}/docs").count() == 2
    index = Segments(f"{root}/index")
    index.upsert(docs)
    changed = spark.createDataFrame([("a", "four"), ("b", "three")], "doc_ref string, text string")
    spark.createDataFrame([("a",), ("c",)], "doc_ref string").write.parquet(f"{root}/log")
    follow(spark, f"{root}/log", f"{root}/cp", index, lambda: changed, interval=None).awaitTermination()
    assert sorted(r.term for r in index.open(spark).postings.collect()) == ["four", "three"]
    assert index.numbers(spark) == [0, 1]


def test_layout_files(spark, tmp_path):
    import zipfile

    from quirespark.sources import alto

    xml = '<alto><Layout><Page WIDTH="100" HEIGHT="50" PHYSICAL_IMG_NR="3"><TextBlock><TextLine><String CONTENT="Hi" HPOS="1" VPOS="2" WIDTH="20" HEIGHT="10"/><SP/><String CONTENT="you" HPOS="30" VPOS="2" WIDTH="30" HEIGHT="10"/></TextLine></TextBlock></Page></Layout></alto>'
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("a.xml", xml)
    (tmp_path / "b.zip").write_bytes(b"nothing")
    found = alto.read(spark, "file://" + str(tmp_path))
    assert [r.content for r in found.where("error is null").orderBy("ord").collect()] == ["Hi", " ", "you"]
    assert found.where("error is not null").count() == 1
    pieces = found.where("error is null").select(F.lit(1).alias("rev"), F.lit(4).alias("ref_length"), "page_no", "block_no", "line_no", "ord", "kind", "content", "rect")
    assert [(r.start_offset, r.end_offset) for r in layout.flattened(pieces).orderBy("ord").collect()] == [(5, 7), (7, 8), (8, 11)]
