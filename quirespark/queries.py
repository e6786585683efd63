"""Registered queries over the driver's tables, with the SQL that gives the same rows.

``documents`` plays the corpus (source is the author, lines are rows), ``events`` the query log, ``conversations`` an ordered
layout, ``orders`` and ``customer`` dated metadata, ``labels`` and ``events`` the change logs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirespark.functions import geometry
from quirespark.functions import text as ft
from quirespark.operators import corrections, layout, snippets, stats, store
from quirespark.operators.search import Engine, plain_index
from quirespark.plans import criteria as c
from quirespark.plans import parser as p
from quirespark.plans.match import Index, candidates, matched_tokens, scores

Query = Callable[[SparkSession, str], DataFrame]
_found: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _found[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def corpus(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents")
    return docs.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_ref"),
        F.col("source").alias("author"),
        F.upper("lang").alias("author_en"),
        F.array("lang").alias("collections"),
        F.col("n_chars").cast("int").alias("pub_year"),
        F.concat(F.lit("Text "), F.col("lang"), F.lit(" of "), F.col("source")).alias("title"),
        F.col("text"),
    )


def index(spark: SparkSession, d: str, titles: bool = False) -> Index:
    return plain_index(corpus(spark, d), (("Text", "text"), ("Title", "title")) if titles else (("Text", "text"),))


def engine(spark: SparkSession, d: str, titles: bool = False) -> Engine:
    return Engine(index(spark, d, titles))


#: The postings, lengths and counts of the corpus, for any query's SQL.
TOK = r"""t0 AS (SELECT 'd' || doc_id AS doc_ref, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS ws FROM documents),
tok AS (SELECT doc_ref, unnest(ws) AS term, unnest(range(len(ws))) AS position FROM t0),
dl AS (SELECT doc_ref, count(*) AS dl FROM tok GROUP BY 1), st AS (SELECT count(*) AS n_docs, avg(dl) AS avg_dl FROM dl)"""


def bm25(where: str, name: str = "s") -> str:
    """The scores of one word set, as a table expression."""
    return f"""{name} AS (SELECT tf.doc_ref, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avg_dl)) AS score
FROM (SELECT doc_ref, count(*) AS tf FROM tok WHERE {where} GROUP BY 1) tf JOIN dl USING (doc_ref) CROSS JOIN st
CROSS JOIN (SELECT max(df) AS df FROM (SELECT term, count(DISTINCT doc_ref) AS df FROM tok WHERE {where} GROUP BY 1)))"""


def _rounded(found: DataFrame) -> DataFrame:
    return found.select("doc_ref", F.round("score", 4).alias("score"))


@query(f"WITH {TOK}, {bm25("term = 'that'", 'a')}, {bm25("term = 'from'", 'b')} SELECT doc_ref, round(sum(score), 4) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1 ORDER BY sum(score) DESC, doc_ref LIMIT 10")
def search_bm25(spark, d):
    return _rounded(engine(spark, d).search(c.Contains(("Text",), "that from"), most=10))


@query(f"WITH {TOK}, {bm25("term = 'with'")} SELECT doc_ref, round(score, 4) AS score FROM s ORDER BY s.score DESC, doc_ref LIMIT 10 OFFSET 10")
def search_second_page(spark, d):
    return _rounded(engine(spark, d).search(c.Contains(("Text",), "with"), first=10, most=10))


@query("SELECT 'd' || doc_id AS doc_ref FROM documents ORDER BY n_chars, 'd' || doc_id LIMIT 20")
def search_by_date(spark, d):
    return engine(spark, d).search(c.MatchAll(), "DateAscending", 0, 20).select("doc_ref")


@query("SELECT 'd' || doc_id AS doc_ref FROM documents ORDER BY n_chars DESC, 'd' || doc_id LIMIT 20")
def search_by_date_descending(spark, d):
    return engine(spark, d).search(c.MatchAll(), "DateDescending", 0, 20).select("doc_ref")


def _matching(name: str, text: str, where: str, having: str = "true") -> None:
    def run(spark, d):
        return scores(index(spark, d), c.Contains(("Text",), text)).select("doc_ref")

    run.__name__ = name
    query(f"WITH {TOK} SELECT DISTINCT doc_ref FROM tok WHERE {where}")(run)


_matching("match_prefix", "pathe*", "starts_with(term, 'pathe')")
_matching("match_wildcard", "s?upi*", "regexp_full_match(term, 's.upi.*')")
_matching("match_leading_wildcard", "*upid", "regexp_full_match(term, '.*upid')")
_matching("match_fuzzy", "stupjd~", "levenshtein(term, 'stupjd') <= 2")
_matching("match_regexp", "/lo[s]er|scum/", "regexp_full_match(term, 'lo[s]er|scum')")
_matching("match_any", "loser moron", "term IN ('loser', 'moron')")
_matching("match_none", '"the" AND zzzzzz', "false")


@query(f"WITH {TOK} SELECT DISTINCT doc_ref FROM tok WHERE term = 'that' AND doc_ref IN (SELECT doc_ref FROM tok WHERE term = 'from') AND doc_ref NOT IN (SELECT doc_ref FROM tok WHERE term = 'with')")
def match_boolean(spark, d):
    return scores(index(spark, d), c.Contains(("Text",), "that AND from NOT with")).select("doc_ref")


@query(f"WITH {TOK} SELECT a.doc_ref, count(*) AS n FROM tok a JOIN tok b ON b.doc_ref = a.doc_ref AND b.position = a.position + 1 WHERE a.term = 'of' AND b.term = 'the' GROUP BY 1")
def match_phrase(spark, d):
    from quirespark.plans.match import starts

    return starts(index(spark, d), p.parse('"of the"'), ("Text",)).groupBy("doc_ref").agg(F.count("*").alias("n"))


@query(f"WITH {TOK} SELECT a.doc_ref, count(*) AS n FROM tok a JOIN tok b ON b.doc_ref = a.doc_ref AND b.position = a.position + 2 WHERE a.term = 'of' AND b.term = 'the' GROUP BY 1")
def match_phrase_gap(spark, d):
    from quirespark.plans.match import starts

    return starts(index(spark, d), p.parse('"of * the"'), ("Text",)).groupBy("doc_ref").agg(F.count("*").alias("n"))


@query(f"WITH {TOK} SELECT DISTINCT a.doc_ref FROM tok a JOIN tok b ON b.doc_ref = a.doc_ref AND abs(b.position - a.position) BETWEEN 1 AND 4 WHERE a.term = 'that' AND b.term = 'from'")
def match_phrase_slop(spark, d):
    return scores(index(spark, d), c.Contains(("Text",), '"that from"~3')).select("doc_ref")


@query(f"WITH {TOK} SELECT DISTINCT a.doc_ref FROM tok a JOIN tok b ON b.doc_ref = a.doc_ref AND b.position = a.position + 1 WHERE a.term = 'of' AND starts_with(b.term, 'th') AND length(b.term) > 1")
def match_phrase_wildcard(spark, d):
    return scores(index(spark, d), c.Contains(("Text",), '"of th*"')).select("doc_ref")


@query(
    f"""WITH {TOK.replace("text) , '[", "text), '[")}, ph AS (SELECT a.doc_ref, count(*) AS tf FROM tok a JOIN tok b ON b.doc_ref = a.doc_ref AND b.position = a.position + 1 WHERE a.term = 'of' AND b.term = 'the' GROUP BY 1),
f AS (SELECT count(DISTINCT doc_ref) FILTER (term = 'of') AS a, count(DISTINCT doc_ref) FILTER (term = 'the') AS b FROM tok WHERE term IN ('of', 'the'))
SELECT doc_ref, round((ln(1 + (n_docs - a + 0.5) / (a + 0.5)) + ln(1 + (n_docs - b + 0.5) / (b + 0.5))) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avg_dl)), 4) AS score FROM ph JOIN dl USING (doc_ref) CROSS JOIN st CROSS JOIN f"""
)
def score_phrase(spark, d):
    return _rounded(scores(index(spark, d), c.Contains(("Text",), '"of the"')))


@query("SELECT 'd' || doc_id AS doc_ref FROM documents WHERE lang = 'fr' OR source = 'src3'")
def match_title(spark, d):
    return scores(index(spark, d, titles=True), c.Contains(("Title", "TitleEnglish"), "fr src3")).select("doc_ref")


@query("SELECT 'd' || doc_id AS doc_ref FROM documents WHERE source IN ('src1', 'src2')")
def filter_value_in(spark, d):
    return scores(index(spark, d), c.ValueIn("Author", ("SRC1", "src2"))).select("doc_ref")


@query("SELECT 'd' || doc_id AS doc_ref FROM documents WHERE lang IN ('fr', 'de')")
def filter_collection(spark, d):
    return scores(index(spark, d), c.ValueIn("Collection", ("fr", "de"))).select("doc_ref")


@query("SELECT 'd' || doc_id AS doc_ref FROM documents WHERE starts_with(source, 'src1')")
def filter_starts_with(spark, d):
    return scores(index(spark, d), c.StartsWith("Author", "Src1")).select("doc_ref")


@query("SELECT 'd' || doc_id AS doc_ref FROM documents WHERE n_chars BETWEEN 500 AND 2000")
def filter_range(spark, d):
    return scores(index(spark, d), c.And(c.GreaterThanOrEqualTo("PublicationYearAsNumber", 500), c.LessThanOrEqualTo("PublicationYearAsNumber", 2000))).select("doc_ref")


@query("SELECT 'd' || doc_id AS doc_ref FROM documents WHERE NOT coalesce(source IN ('src1'), false)")
def filter_not(spark, d):
    return scores(index(spark, d), c.Not(c.ValueIn("Author", ("src1",)))).select("doc_ref")


@query(f"WITH {TOK}, {bm25("term = 'that'")} SELECT doc_ref, round(coalesce(s.score, 0) + CASE WHEN source = 'src2' THEN 1 ELSE 0 END, 4) AS score FROM (SELECT 'd' || doc_id AS doc_ref, source FROM documents) LEFT JOIN s USING (doc_ref) WHERE s.score IS NOT NULL OR source = 'src2'")
def filter_or_scores(spark, d):
    return _rounded(scores(index(spark, d), c.Or(c.Contains(("Text",), "that"), c.ValueIn("Author", ("src2",)))))


@query("SELECT 'd' || doc_id AS doc_ref FROM documents WHERE source <> 'src4' AND n_chars >= 1000")
def request_to_criteria(spark, d):
    return scores(index(spark, d), c.build(authors=("src4",), include_authors=False, from_year=1000)).select("doc_ref")


@query("SELECT count(*) AS size FROM documents")
def index_size(spark, d):
    return engine(spark, d).size()


@query(f"WITH {TOK} SELECT count(DISTINCT doc_ref) AS total FROM tok WHERE term = 'that'")
def total_hits(spark, d):
    return engine(spark, d).total(c.Contains(("Text",), "that"))


@query("SELECT 'd' || doc_id AS doc_ref FROM documents WHERE lang = 'es' ORDER BY 1")
def list_refs(spark, d):
    return engine(spark, d).refs(c.ValueIn("Collection", ("es",)))


@query("SELECT 'd' || doc_id AS doc_ref, source AS author, text FROM documents WHERE doc_id = 5")
def get_document(spark, d):
    return engine(spark, d).document("d5").select("doc_ref", "author", "text")


@query(f"WITH {TOK} SELECT source AS label, count(*) AS n FROM documents WHERE 'd' || doc_id IN (SELECT doc_ref FROM tok WHERE term = 'that') GROUP BY 1 ORDER BY n DESC, label LIMIT 5")
def facet_top(spark, d):
    return engine(spark, d).facet(c.Contains(("Text",), "that"), "Author", 5)


@query("SELECT upper(lang) AS label, count(*) AS n FROM documents GROUP BY 1")
def facet_all(spark, d):
    return engine(spark, d).facet(c.MatchAll(), "AuthorEnglish", None, True)


@query(
    """WITH a AS (SELECT source AS label, count(*) AS n, 0 AS i FROM documents WHERE starts_with(source, 's') GROUP BY 1 ORDER BY n DESC, label LIMIT 3),
b AS (SELECT upper(lang) AS label, count(*) AS n, 1 AS i FROM documents WHERE starts_with(lang, 's') GROUP BY 1 ORDER BY n DESC, label LIMIT 3)
SELECT label, n FROM (SELECT * FROM a UNION ALL SELECT * FROM b ORDER BY n DESC, i, label LIMIT 3)"""
)
def top_authors(spark, d):
    return engine(spark, d).top_authors("s", 3)


@query(f"WITH {TOK} SELECT term, count(DISTINCT doc_ref) AS df, count(*) AS cf FROM tok GROUP BY 1")
def term_statistics(spark, d):
    return index(spark, d).term_stats().select("term", "df", "cf")


@query(f"WITH {TOK} SELECT doc_ref, dl FROM dl")
def document_lengths(spark, d):
    return index(spark, d).doc_stats().select("doc_ref", "dl")


@query(f"WITH {TOK} SELECT doc_ref, term, position::INTEGER AS position FROM tok")
def postings(spark, d):
    return index(spark, d).postings.select("doc_ref", "term", "position")


#: Tokens with offsets: runs of letters and digits, every other character alone; punctuation does not advance the position.
ANALYSED = r"""a0 AS (SELECT 'd' || doc_id AS doc_ref, regexp_extract_all(text, '[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}\s]|\s+') AS ps FROM documents),
a1 AS (SELECT doc_ref, unnest(ps) AS piece, unnest(range(len(ps))) AS i FROM a0),
a2 AS (SELECT *, sum(length(piece)) OVER w - length(piece) AS start, sum(length(piece) - length(replace(piece, chr(10), ''))) OVER w AS nl FROM a1 WINDOW w AS (PARTITION BY doc_ref ORDER BY i)),
a3 AS (SELECT *, regexp_full_match(piece, '[\p{P}\p{S}]+') AND NOT regexp_matches(piece, '[=+$%€°£#<>]') AS punct, row_number() OVER (PARTITION BY doc_ref ORDER BY i) AS n FROM a2 WHERE NOT regexp_full_match(piece, '\s+')),
an AS (SELECT doc_ref, 'Text' AS field, lower(piece) AS term, CASE WHEN punct THEN 'punct' ELSE 'word' END AS kind, (sum(CASE WHEN punct AND n > 1 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_ref ORDER BY i) - 1)::INTEGER AS position,
  start::INTEGER AS start, (start + length(piece))::INTEGER AS "end", 0 AS page_no, nl::INTEGER AS row_no FROM a3)"""


@query(f"WITH {ANALYSED} SELECT * FROM an")
def analysed_tokens(spark, d):
    """Tokens with offsets, rows and punctuation by the language's patterns."""
    return ft.token_table(corpus(spark, d).select("doc_ref", "text"))


@query(f'WITH {ANALYSED} SELECT field, term, start, "end", position FROM an WHERE doc_ref = \'d5\' AND start >= 10 AND start < 200')
def document_terms(spark, d):
    docs = corpus(spark, d).select("doc_ref", "text")
    return Engine(Index(docs, ft.token_table(docs))).list_terms("d5", 10, 200)


def _log(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("username"), F.col("ts").alias("executed"))


def _usage(unit: str, label: str) -> Query:
    def run(spark, d):
        return stats.usage(_log(spark, d), unit, "2024-01-01", "2024-01-20")

    run.__name__ = f"usage_by_{unit}"
    return query(f"SELECT strftime(date_trunc('{unit}', ts), '{label}') AS label, count(DISTINCT user_id) AS users, count(DISTINCT event_id) AS queries FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-21' GROUP BY 1")(run)


for _unit, _label in (("day", "%Y-%m-%d"), ("month", "%Y-%m"), ("year", "%Y")):
    _usage(_unit, _label)


@query("SELECT 'u' || user_id AS username, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-21' GROUP BY 1 ORDER BY n DESC, username LIMIT 10")
def top_users(spark, d):
    return stats.top_users(_log(spark, d), "2024-01-01", "2024-01-20", 10)


LINES = """l0 AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT 'd' || doc_id AS doc_ref, unnest(ls) AS line, unnest(range(len(ls)))::INTEGER AS row_no FROM l0),
ln AS (SELECT doc_ref, row_no, line, (sum(length(line) + 1) OVER (PARTITION BY doc_ref ORDER BY row_no) - length(line) - 1)::INTEGER AS start_offset FROM l)"""


def rows(spark: SparkSession, d: str) -> DataFrame:
    return layout.lines(corpus(spark, d))


@query(f"WITH {LINES} SELECT doc_ref, row_no, line, start_offset, (start_offset + length(line))::INTEGER AS end_offset FROM ln")
def row_offsets(spark, d):
    return rows(spark, d)


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as rows of pages: a conversation is a document, a turn a row, four turns a page."""
    turn = _t(spark, d, "conversations").select(F.col("conv_id").alias("rev"), F.col("turn").cast("int").alias("row_no"), F.floor(F.col("turn") / 4).cast("int").alias("page_no"), F.length("text").alias("size"), "text")
    before = Window.partitionBy("rev").orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    return turn.withColumn("start_offset", F.coalesce(F.sum(F.col("size") + 1).over(before), F.lit(0)).cast("int"))


TURNS = "tr AS (SELECT conv_id AS rev, turn::INTEGER AS row_no, (turn // 4)::INTEGER AS page_no, (sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn) - length(text) - 1)::INTEGER AS start_offset FROM conversations)"


def _ends(spark: SparkSession, d: str) -> DataFrame:
    return _turns(spark, d).groupBy("rev").agg(F.lit(100).alias("at"))


@query(f"""WITH {TURNS}, q AS (SELECT DISTINCT rev, 100 AS "at" FROM tr) SELECT q.rev, q."at", coalesce(max(row_no), -1)::INTEGER AS row_no FROM q LEFT JOIN tr ON tr.rev = q.rev AND start_offset < q."at" GROUP BY q.rev, q."at" """)
def row_before_offset(spark, d):
    return layout.as_of(_ends(spark, d), _turns(spark, d).select("rev", "start_offset", "row_no"), ["rev"], "at", "start_offset", "row_no", strict=True).fillna(-1, ["row_no"])


@query(f"""WITH {TURNS}, q AS (SELECT DISTINCT rev, 100 AS "at" FROM tr) SELECT q.rev, q."at", coalesce(min(row_no), -1)::INTEGER AS row_no FROM q LEFT JOIN tr ON tr.rev = q.rev AND start_offset >= q."at" GROUP BY q.rev, q."at" """)
def row_at_or_after_offset(spark, d):
    return layout.as_of(_ends(spark, d), _turns(spark, d).select("rev", "start_offset", "row_no"), ["rev"], "at", "start_offset", "row_no", forward=True).fillna(-1, ["row_no"])


@query(
    f"""WITH {TURNS}, s AS (SELECT rev, row_no AS span, page_no, row_no AS a, start_offset + 400 AS z FROM tr),
e AS (SELECT s.rev, s.span, s.page_no, s.a, arg_max(tr.page_no, start_offset) AS last_page, arg_max(tr.row_no, start_offset) AS b FROM s JOIN tr ON tr.rev = s.rev AND tr.start_offset < s.z GROUP BY ALL)
SELECT e.span, tr.rev, tr.page_no, tr.row_no, tr.start_offset FROM e JOIN tr ON tr.rev = e.rev AND tr.page_no = e.page_no AND tr.row_no BETWEEN a AND b WHERE last_page = e.page_no"""
)
def rows_between_offsets(spark, d):
    turns = _turns(spark, d).select("rev", "page_no", "row_no", "start_offset")
    spans = turns.select("rev", F.col("row_no").alias("span"), F.col("start_offset").alias("from_offset"), (F.col("start_offset") + 400).alias("to_offset"))
    return layout.rows_between(turns, spans)


def _words(spark: SparkSession, d: str) -> DataFrame:
    """Rectangles for the words of the corpus: ten wide a character, a row each line."""
    cut = rows(spark, d).withColumn("w", F.explode(F.expr("filter(transform(split(line, ' ', -1), (x, i) -> struct(i as word_no, x as content)), y -> y.content != '')")))
    return cut.select("doc_ref", "row_no", F.col("w.word_no").alias("word_no"), F.col("w.content").alias("content"), F.struct((F.col("w.word_no") * 100).alias("left"), (F.col("row_no") * 10).alias("top"), (F.length("w.content") * 10).alias("width"), F.lit(10).alias("height")).alias("rect"))


@query(
    """WITH l0 AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), l AS (SELECT 'd' || doc_id AS rev, unnest(ls) AS line, unnest(range(len(ls)))::INTEGER AS row_no FROM l0),
w0 AS (SELECT rev, row_no, string_split(line, ' ') AS ws FROM l), w AS (SELECT rev, row_no, unnest(ws) AS content, unnest(range(len(ws))) AS i FROM w0)
SELECT rev, row_no, min(i * 100)::INTEGER AS "left", (row_no * 10)::INTEGER AS top, (max(i * 100 + 10 * length(content)) - min(i * 100))::INTEGER AS width, 10 AS height FROM w WHERE content <> '' GROUP BY ALL"""
)
def row_rectangles(spark, d):
    boxes = layout.row_boxes(_words(spark, d).withColumns({"rev": F.col("doc_ref"), "page_no": F.lit(0)}))
    return boxes.select("rev", "row_no", "rect.left", "rect.top", "rect.width", "rect.height")


@query(
    """WITH w0 AS (SELECT 'd' || doc_id AS rev, regexp_extract_all(text, '\\S+|\\s+') AS ps FROM documents),
p AS (SELECT rev, unnest(ps) AS piece, unnest(range(len(ps))) AS i FROM w0), o AS (SELECT rev, piece, (sum(length(piece)) OVER (PARTITION BY rev ORDER BY i) - length(piece))::INTEGER AS start_offset FROM p)
SELECT rev, start_offset, (start_offset + length(piece))::INTEGER AS end_offset, piece AS text FROM o WHERE regexp_full_match(piece, '\\S+')"""
)
def word_group_texts(spark, d):
    """Tokens that touch make groups, which are what stands between white space."""
    docs = corpus(spark, d)
    words = ft.token_table(docs.select("doc_ref", "text")).select(F.col("doc_ref").alias("rev"), F.col("start").alias("start_offset"), F.col("end").alias("end_offset"))
    return layout.group_text(words, docs.select(F.col("doc_ref").alias("rev"), "text")).select("rev", "start_offset", "end_offset", "text")


@query(
    f"""WITH {TURNS}, w AS (SELECT rev, start_offset, row_no // 3 AS row_no, row_no // 6 AS page_no FROM tr),
f AS (SELECT rev, arg_min(page_no, start_offset) AS page_no, arg_min(row_no, start_offset) AS row_no FROM w WHERE start_offset >= 100 GROUP BY 1)
SELECT w.rev, w.page_no::INTEGER AS page_no, w.row_no::INTEGER AS row_no, w.start_offset FROM w JOIN f ON f.rev = w.rev AND f.page_no = w.page_no AND f.row_no = w.row_no"""
)
def words_of_row(spark, d):
    """Turns as words, three a row: the whole row of the first word at or after an offset."""
    words = _turns(spark, d).select("rev", "start_offset", F.floor(F.col("row_no") / 3).cast("int").alias("row_no"), F.floor(F.col("row_no") / 6).cast("int").alias("page_no"))
    return layout.words_in_row_of(words, _ends(spark, d).withColumnRenamed("at", "offset")).select("rev", "page_no", "row_no", "start_offset")


@query(
    """WITH l0 AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), l AS (SELECT 'd' || doc_id AS doc_ref, unnest(ls) AS line, unnest(range(len(ls))) AS row_no FROM l0),
w0 AS (SELECT doc_ref, row_no, string_split(line, ' ') AS ws FROM l), w AS (SELECT doc_ref, row_no, unnest(ws) AS content, unnest(range(len(ws))) AS word_no FROM w0)
SELECT doc_ref, row_no::INTEGER AS row_no, word_no::INTEGER AS word_no, greatest(word_no * 100 - 5, 0)::INTEGER AS "left", greatest(row_no * 10 - 5, 0)::INTEGER AS top,
  (word_no * 100 + 10 * length(content) + 5 - greatest(word_no * 100 - 5, 0))::INTEGER AS width, (row_no * 10 + 15 - greatest(row_no * 10 - 5, 0))::INTEGER AS height FROM w WHERE content <> ''"""
)
def word_crops(spark, d):
    """A margin of five around each word, within the page."""
    far = F.lit(100_000_000)
    cut = _words(spark, d).withColumn("crop", geometry.padded("rect", 5, far, far))
    return cut.select("doc_ref", "row_no", "word_no", "crop.left", "crop.top", "crop.width", "crop.height")


@query("SELECT l_orderkey, l_linenumber, floor(l_linenumber * 10000 / (l_suppkey + 100))::INTEGER AS grid, floor(floor(l_linenumber * 10000 / (l_suppkey + 100)) * (l_suppkey + 100) / 10000 + 0.5)::INTEGER AS pixels FROM lineitem")
def grid_round_trip(spark, d):
    size = F.col("l_suppkey") + 100
    grid = geometry.to_grid(F.col("l_linenumber"), size)
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", grid.alias("grid"), geometry.from_grid(grid, size).alias("pixels"))


@query(
    f"""WITH {LINES}, w0 AS (SELECT doc_ref, row_no, string_split(line, ' ') AS ws FROM l), w AS (SELECT doc_ref, row_no, unnest(ws) AS content, unnest(range(len(ws))) AS i FROM w0),
k AS (SELECT doc_ref, row_no, i, content, i * 100 AS x, length(content) * 10 AS width FROM w WHERE content <> ''),
s AS (SELECT *, CASE WHEN row_no % 2 = 0 AND least(x + width, 300) - greatest(x, 100) > 0.75 * width THEN row_no * 2 + 1 WHEN least(x + width, 200) - x > 0.75 * width THEN row_no * 2 END AS rev FROM k)
SELECT doc_ref, row_no * 100000 + i AS word_no, CASE WHEN rev = lag(rev) OVER (PARTITION BY doc_ref, row_no // 20 ORDER BY row_no, i) THEN '' WHEN rev IS NOT NULL THEN 's' || rev ELSE content END AS content FROM s"""
)
def suggested_words(spark, d):
    """Each row has a suggestion for its first two places; every other row a newer one for the second and third."""
    words = _words(spark, d).select(
        "doc_ref", "row_no", F.floor(F.col("row_no") / 20).alias("page_no"), (F.col("row_no").cast("long") * 100_000 + F.col("word_no")).alias("word_no"), "content",
        geometry.rectangle(F.col("rect.left"), F.col("row_no") % 20 * 10, F.col("rect.width"), F.col("rect.height")).alias("rect"),
    )
    each = words.select("doc_ref", "page_no", "row_no").distinct().withColumn("newer", F.explode(F.when(F.col("row_no") % 2 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    rev = (F.col("row_no") * 2 + F.col("newer")).cast("long")
    made = each.select("doc_ref", "page_no", rev.alias("rev"), F.lit(False).alias("ignore"), F.concat(F.lit("s"), rev.cast("string")).alias("suggestion"), geometry.rectangle(F.col("newer") * 100, F.col("row_no") % 20 * 10, F.lit(200), F.lit(10)).alias("grid"))
    pages = words.select("doc_ref", "page_no").distinct().withColumns({"width": F.lit(geometry.GRID), "height": F.lit(geometry.GRID)})
    return layout.suggested(words, made, pages).select("doc_ref", "word_no", "content")


@query(
    """WITH c AS (SELECT conv_id AS rev, turn AS line_no, turn // 4 AS page_no, regexp_extract_all(text, '[^ ]+| +') AS ps FROM conversations),
p AS (SELECT rev, page_no, line_no, unnest(ps) AS content, unnest(range(len(ps))) AS ord FROM c),
z AS (SELECT *, length(content) + (line_no IS DISTINCT FROM lead(line_no) OVER w)::INTEGER + (page_no IS DISTINCT FROM lead(page_no) OVER w)::INTEGER AS size FROM p WINDOW w AS (PARTITION BY rev ORDER BY line_no, ord)),
o AS (SELECT *, length(rev::VARCHAR) + 1 + sum(size) OVER (PARTITION BY rev ORDER BY line_no, ord) - size AS start_offset FROM z)
SELECT rev, line_no::INTEGER AS line_no, ord::INTEGER AS ord, content, start_offset::INTEGER AS start_offset, (start_offset + length(content))::INTEGER AS end_offset FROM o"""
)
def layout_offsets(spark, d):
    """Conversations as layout files: four turns a page, a turn a line, words and spaces its pieces."""
    turn = _t(spark, d, "conversations").select(F.col("conv_id").alias("rev"), F.col("turn").cast("int").alias("line_no"), F.posexplode(F.regexp_extract_all("text", F.lit("([^ ]+| +)"), 1)).alias("ord", "content"))
    pieces = turn.select("rev", F.length(F.col("rev").cast("string")).alias("ref_length"), F.floor(F.col("line_no") / 4).alias("page_no"), F.lit(0).alias("block_no"), "line_no", "ord", "content")
    return layout.flattened(pieces).select("rev", "line_no", "ord", "content", "start_offset", "end_offset")


@query(
    f"""WITH {TURNS}, t AS (SELECT rev, start_offset AS s, start_offset + 60 AS e FROM tr), n AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY rev ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM t),
g AS (SELECT *, sum(new) OVER (PARTITION BY rev ORDER BY s) AS island FROM n) SELECT 'c' || rev AS doc_ref, min(s)::INTEGER AS start, max(e)::INTEGER AS "end", count(*)::DOUBLE AS score FROM g GROUP BY rev, island"""
)
def merged_highlights(spark, d):
    """Tokens of sixty characters from the beginning of each turn: those that touch are one highlight."""
    tokens = _turns(spark, d).select(F.concat(F.lit("c"), F.col("rev").cast("string")).alias("doc_ref"), F.col("start_offset").alias("start"), (F.col("start_offset") + 60).alias("end"), F.lit(1.0).alias("score"))
    return snippets.merged(tokens)


_DIGITS = ", ".join(f"CASE WHEN regexp_full_match(trim(p[{i}]), '[0-9]+') THEN TRY_CAST(trim(p[{i}]) AS INTEGER) END" for i in ("1", "2", "len(p)"))


@query(f"""WITH t AS (SELECT conv_id, turn, string_split_regex(trim(CASE WHEN turn % 2 = 0 THEN turn || chr(10) || chr(10) || text ELSE text || chr(10) || chr(10) || turn END), '\n\n+') AS p FROM conversations) SELECT conv_id, turn, coalesce({_DIGITS}, -1) AS page FROM t""")
def logical_pages(spark, d):
    """Printed page numbers above or below the text of a page."""
    number = F.col("turn").cast("string")
    text = F.when(F.col("turn") % 2 == 0, F.concat(number, F.lit("\n\n"), "text")).otherwise(F.concat("text", F.lit("\n\n"), number))
    return _t(spark, d, "conversations").select("conv_id", "turn", F.coalesce(layout.logical_page(text), F.lit(-1)).alias("page"))


@query(
    f"""WITH {TOK}, {LINES}, rt AS (SELECT doc_ref, row_no, len(regexp_extract_all(lower(line), '[\\p{{L}}\\p{{M}}\\p{{N}}]+')) AS n FROM l),
hit AS (SELECT DISTINCT doc_ref, row_no FROM (SELECT doc_ref, row_no, unnest(regexp_extract_all(lower(line), '[\\p{{L}}\\p{{M}}\\p{{N}}]+')) AS term FROM l) WHERE term IN ('loser', 'moron')),
g AS (SELECT *, CASE WHEN row_no - lag(row_no) OVER (PARTITION BY doc_ref ORDER BY row_no) <= 3 THEN 0 ELSE 1 END AS new FROM hit),
i AS (SELECT *, sum(new) OVER (PARTITION BY doc_ref ORDER BY row_no) AS island FROM g),
e AS (SELECT doc_ref, island, min(row_no) - 1 AS a, max(row_no) + 1 AS b FROM i GROUP BY ALL)
SELECT e.doc_ref, min(row_no)::INTEGER AS first_row, max(row_no)::INTEGER AS last_row, min(start_offset)::INTEGER AS start, max(start_offset + length(line))::INTEGER AS "end" FROM e JOIN ln ON ln.doc_ref = e.doc_ref AND row_no BETWEEN a AND b GROUP BY e.doc_ref, island"""
)
def snippet_rows(spark, d):
    found, lines = _hits(spark, d)
    return snippets.islands(found, lines, 1, None).select("doc_ref", "first_row", "last_row", "start", "end")


def _hits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The postings of two rare words, and the lines of the documents that have them; only those are analysed."""
    asked = p.parse("loser moron")
    docs = candidates(corpus(spark, d).select("doc_ref", "text"), asked)
    own = Index(docs, ft.token_table(docs))
    lines = layout.lines(docs).withColumn("page_no", F.lit(0))
    return matched_tokens(own, asked).select("doc_ref", "page_no", "row_no", "start", "end"), lines


@query(f"WITH {LINES} SELECT doc_ref, min(row_no)::INTEGER AS first_row, max(row_no)::INTEGER AS last_row, 0 AS start, max(start_offset + length(line))::INTEGER AS \"end\" FROM ln WHERE row_no < 3 GROUP BY 1")
def snippet_fallback(spark, d):
    return snippets.beginnings(rows(spark, d).withColumn("page_no", F.lit(0)), 3).select("doc_ref", "first_row", "last_row", "start", "end")


@query("SELECT 'c' || conv_id AS doc_ref, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1")
def plain_text(spark, d):
    pages = _t(spark, d, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("doc_ref"), F.col("turn").alias("page_no"), "text")
    return snippets.plain_text(pages)


@query("SELECT 'c' || conv_id AS doc_ref, '<h1>' || conv_id || '</h1>' || string_agg('<div id=\"page' || turn || '\">' || replace(text, chr(10), '<br>') || '<hr></div>', '' ORDER BY turn) AS html FROM conversations GROUP BY conv_id")
def text_as_html(spark, d):
    pages = _t(spark, d, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("doc_ref"), F.col("turn").alias("page_no"), "text", F.col("conv_id").cast("string").alias("title"))
    return snippets.text_as_html(pages.select("doc_ref", "page_no", "text"), pages.select("doc_ref", "title").distinct())


@query(
    """WITH p AS (SELECT conv_id AS doc_ref, (turn + turn // 2)::INTEGER AS page_no, text FROM conversations), b AS (SELECT doc_ref, unnest(range(min(page_no), max(page_no) + 1))::INTEGER AS page_no FROM p GROUP BY doc_ref)
SELECT doc_ref, page_no, coalesce(text, '') AS text FROM b LEFT JOIN p USING (doc_ref, page_no)"""
)
def missing_pages(spark, d):
    """Turns numbered with a gap behind every second one."""
    return layout.all_pages(_t(spark, d, "conversations").select(F.col("conv_id").alias("doc_ref"), (F.col("turn") + F.floor(F.col("turn") / 2)).cast("int").alias("page_no"), "text"))


@query("SELECT conv_id AS rev, max(turn)::INTEGER AS page_no, (turn // 2)::INTEGER AS start_offset FROM conversations GROUP BY conv_id, turn // 2")
def non_empty_pages(spark, d):
    return layout.non_empty_pages(_t(spark, d, "conversations").select(F.col("conv_id").alias("rev"), F.col("turn").cast("int").alias("page_no"), F.floor(F.col("turn") / 2).cast("int").alias("start_offset")))


def _corrections(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Events as corrections: a user's event corrects the author of one document."""
    e = _t(spark, d, "events")
    table = e.select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "click", "Author").otherwise("Title").alias("field"), F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("new_value"), (F.col("user_id") % 5 == 0).alias("ignore"), F.col("event_id").alias("rev"))
    return table, e.select(F.col("event_id").alias("correction_id"), F.concat(F.lit("d"), (F.col("user_id") % 200).cast("string")).alias("doc_ref"))


CORR = "cr AS (SELECT event_id AS id, CASE WHEN event_type = 'click' THEN 'Author' ELSE 'Title' END AS field, 'v' || event_id AS new_value, user_id % 5 = 0 AS ignore, event_id AS rev, 'd' || (user_id % 200) AS doc_ref FROM events)"


@query(f"WITH {CORR} SELECT doc_ref, field, max(rev) AS rev, arg_max(new_value, rev) AS new_value FROM cr WHERE NOT ignore GROUP BY 1, 2")
def latest_corrections(spark, d):
    return corrections.latest(*_corrections(spark, d))


@query(
    f"""WITH {CORR}, la AS (SELECT doc_ref, field, arg_max(new_value, rev) AS v FROM cr WHERE NOT ignore GROUP BY 1, 2)
SELECT 'd' || doc_id AS doc_ref, coalesce(a.v, source) AS author, coalesce(t.v, 'Text ' || lang || ' of ' || source) AS title FROM documents LEFT JOIN la a ON a.doc_ref = 'd' || doc_id AND a.field = 'Author' LEFT JOIN la t ON t.doc_ref = 'd' || doc_id AND t.field = 'Title'"""
)
def corrected_metadata(spark, d):
    return corrections.overlaid(corpus(spark, d), *_corrections(spark, d)).select("doc_ref", "author", "title")


@query("SELECT 'd' || doc_id AS doc_ref FROM documents WHERE source = (SELECT source FROM documents WHERE doc_id = 7)")
def correction_everywhere(spark, d):
    return corrections.correction_targets(corpus(spark, d), "d7", "Author", True)


@query(f"WITH {CORR}, un AS (SELECT doc_ref, field, new_value, ignore OR id = 5 AS ignore, CASE WHEN id = 5 THEN 900000000 ELSE rev END AS rev FROM cr) SELECT doc_ref, field, max(rev) AS rev, arg_max(new_value, rev) AS new_value FROM un WHERE NOT ignore GROUP BY 1, 2")
def undone_correction(spark, d):
    table, links = _corrections(spark, d)
    return corrections.latest(corrections.undone(table, 5, 900_000_000), links)


@query("SELECT 'u' || user_id AS username, user_id = 7 AS ignore, CASE WHEN user_id = 7 THEN 900000000 + row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 ELSE event_id END AS rev FROM events")
def ignored_suggestions(spark, d):
    made = _t(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("username"), F.lit(False).alias("ignore"), F.col("event_id").alias("rev"))
    return corrections.ignored_suggestions(made, "u7", 900_000_000)


def _revisions(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    e, table = _t(spark, d, "events"), _corrections(spark, d)
    ref = F.concat(F.lit("d"), (F.col("user_id") % 200).cast("string"))
    documents = e.where("event_type <> 'error'").select(ref.alias("reference"), F.col("event_id").alias("rev"), F.when(F.col("value") < 5, "Underway").otherwise("Complete").alias("status"))
    suggestions = e.where("event_type = 'error'").select(ref.alias("doc_ref"), F.col("event_id").alias("rev"))
    indexed = e.groupBy(ref.alias("reference")).agg((F.max("event_id") - 300).alias("doc_rev"), F.when(F.max("event_id") % 3 == 0, F.max("event_id") - 400).alias("word_suggestion_rev"), F.when(F.max("event_id") % 50 == 0, "Yes").otherwise("No").alias("reindex"))
    known = e.groupBy(ref.alias("reference"), F.when(F.col("event_type") == "click", "Author").otherwise("Title").alias("field")).agg((F.max("event_id") - F.max("user_id") % 2).alias("metadata_correction_rev"))
    return {"documents": documents, "suggestions": suggestions, "corrections": table[0], "links": table[1], "indexed": indexed, "indexed_corrections": known}


REVS = """e AS (SELECT *, 'd' || (user_id % 200) AS ref, CASE WHEN event_type = 'click' THEN 'Author' ELSE 'Title' END AS field FROM events),
document AS (SELECT ref AS reference, event_id AS rev, CASE WHEN value < 5 THEN 'Underway' ELSE 'Complete' END AS status FROM e WHERE event_type <> 'error'),
word_suggestion AS (SELECT ref AS doc_ref, event_id AS rev FROM e WHERE event_type = 'error'),
indexed AS (SELECT ref AS reference, max(event_id) - 300 AS doc_rev, CASE WHEN max(event_id) % 3 = 0 THEN max(event_id) - 400 END AS word_suggestion_rev, CASE WHEN max(event_id) % 50 = 0 THEN 'Yes' ELSE 'No' END AS reindex FROM e GROUP BY 1),
idc AS (SELECT ref AS reference, field, max(event_id) - max(user_id) % 2 AS metadata_correction_rev FROM e GROUP BY 1, 2)"""


@query(
    f"""WITH {REVS} SELECT i.reference FROM indexed i WHERE EXISTS (SELECT 1 FROM document x WHERE x.reference = i.reference AND x.status = 'Complete' AND x.rev > i.doc_rev)
OR EXISTS (SELECT 1 FROM word_suggestion w WHERE w.doc_ref = i.reference AND w.rev > coalesce(i.word_suggestion_rev, 0))
OR EXISTS (SELECT 1 FROM e LEFT JOIN idc ON idc.reference = e.ref AND idc.field = e.field WHERE e.ref = i.reference AND (idc.reference IS NULL OR e.event_id > idc.metadata_correction_rev)) OR i.reindex IN ('Yes', 'MetadataOnly')"""
)
def documents_to_reindex(spark, d):
    return corrections.to_reindex(**_revisions(spark, d))


@query(
    f"""WITH {REVS} SELECT i.reference, coalesce((SELECT max(rev) FROM document x WHERE x.reference = i.reference AND x.status = 'Complete') > i.doc_rev, false) OR coalesce((SELECT max(rev) FROM word_suggestion w WHERE w.doc_ref = i.reference) > coalesce(i.word_suggestion_rev, 0), false) OR i.reindex = 'Yes' AS updated FROM indexed i"""
)
def content_updated(spark, d):
    r = _revisions(spark, d)
    return corrections.content_updated(r["documents"], r["suggestions"], r["indexed"])


@query(f"WITH {REVS} SELECT reference, max(rev) AS rev, arg_max(status, rev) AS status FROM document GROUP BY 1")
def latest_revisions(spark, d):
    return store.latest_revisions(_revisions(spark, d)["documents"])


@query(f"WITH {REVS} SELECT reference, coalesce(n.doc_rev, i.doc_rev) AS doc_rev, i.reindex FROM indexed i LEFT JOIN (SELECT reference, max(rev) AS doc_rev FROM document WHERE status = 'Complete' GROUP BY 1) n USING (reference)")
def upserted_index(spark, d):
    r = _revisions(spark, d)
    new = r["documents"].where("status = 'Complete'").groupBy("reference").agg(F.max("rev").alias("doc_rev"))
    changes = new.join(r["indexed"].select("reference", "reindex"), "reference")
    return store.upserted(r["indexed"].select("reference", "doc_rev", "reindex"), changes, ["reference"])


@query(f"""WITH {REVS} SELECT reference, rev, CASE WHEN status = 'Underway' THEN 'Failed' ELSE status END AS status, '' AS reindex FROM document
UNION ALL SELECT reference, doc_rev, '', CASE WHEN reference IN (SELECT reference FROM document WHERE status = 'Underway') THEN 'No' ELSE reindex END FROM indexed""")
def failed_at_start(spark, d):
    """What was underway has failed, and its document is no longer marked."""
    r = _revisions(spark, d)
    documents, indexed = store.failed_at_start(r["documents"].withColumn("failure_reason", F.lit(None).cast("string")), r["indexed"])
    none = F.lit("")
    return documents.select("reference", "rev", "status", none.alias("reindex")).unionByName(indexed.select("reference", F.col("doc_rev").alias("rev"), none.alias("status"), "reindex"))


@query(f"WITH {REVS} SELECT reference, CASE WHEN reference IN (SELECT reference FROM document WHERE rev % 100 = 7) THEN 'MetadataOnly' ELSE reindex END AS reindex FROM indexed")
def marked_for_reindex(spark, d):
    r = _revisions(spark, d)
    return store.marked(r["indexed"], r["documents"].where("rev % 100 = 7"), "MetadataOnly").select("reference", "reindex")


@query(f"WITH {REVS} SELECT reference, doc_rev FROM indexed WHERE reference NOT IN (SELECT doc_ref FROM word_suggestion WHERE rev % 10 = 3)")
def deleted_documents(spark, d):
    r = _revisions(spark, d)
    return store.deleted(r["indexed"], r["suggestions"].where("rev % 10 = 3").select(F.col("doc_ref").alias("reference")), ["reference"]).select("reference", "doc_rev")


@query("""WITH k AS (SELECT * FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations GROUP BY 1 HAVING count(*) >= 4))
SELECT 'page' AS kind, conv_id, (turn // 4)::INTEGER AS page_no, -1 AS row_no, -1 AS word_no FROM k GROUP BY ALL UNION ALL SELECT 'row', conv_id, (turn // 4)::INTEGER, turn::INTEGER, -1 FROM k
UNION ALL SELECT 'word', conv_id, (turn // 4)::INTEGER, turn::INTEGER, unnest(range(len(string_split(text, ' '))))::INTEGER FROM k""")
def cascaded_delete(spark, d):
    """Long conversations go, and their pages, rows and words with them."""
    rows = _turns(spark, d)
    pages = rows.select("rev", "page_no").distinct()
    words = rows.select("rev", "page_no", "row_no", F.posexplode(F.split("text", " ", -1)).alias("word_no", "content"))
    left = store.cascaded(rows.groupBy("rev").count().where("count >= 4"), pages, rows, words)
    kinds = [t.withColumns({c: F.lit(-1) for c in ("row_no", "word_no") if c not in t.columns} | {"kind": F.lit(k)}).select("kind", F.col("rev").alias("conv_id"), "page_no", "row_no", "word_no") for k, t in zip(("page", "row", "word"), left)]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


@query("SELECT n_nationkey::BIGINT AS rev, n_name AS reference FROM nation UNION ALL SELECT (SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY r_name), r_name FROM region")
def appended_documents(spark, d):
    table = _t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("rev"), F.col("n_name").alias("reference"))
    return store.appended(table, _t(spark, d, "region").select(F.col("r_name").alias("reference")), "rev", "reference")


@query("SELECT arg_max(value, event_id) AS preference FROM events WHERE user_id = 7 AND event_type = 'click' HAVING count(*) > 0")
def preference_of_user(spark, d):
    """The newest event of each kind is a user's preference."""
    e = _t(spark, d, "events")
    kept = e.groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("username"), F.col("event_type").alias("key")).agg(F.max_by("value", "event_id").alias("preference"))
    return store.preference(kept, "u7", "click")


@query("SELECT o_orderkey, o_orderkey % 2 = 0 AS hard FROM orders")
def hard_hyphens(spark, d):
    """States and priorities cut at a line's end; in every second order the joined word has kept the hyphen."""
    first, second = F.concat("o_orderstatus", F.lit("-")), F.col("o_orderpriority")
    joined = F.when(F.col("o_orderkey") % 2 == 0, F.concat(first, second)).otherwise(F.concat("o_orderstatus", second))
    return _t(spark, d, "orders").select("o_orderkey", ft.hard_hyphen(first, second, joined).alias("hard"))


@query("SELECT c_name, CASE WHEN c_name > 'Customer#000001000' THEN 'z' WHEN c_name > 'Customer#000000500' THEN 'y' ELSE 'x' END AS directory FROM customer")
def content_directories(spark, d):
    from quirespark.sources.metadata import content_directory

    return content_directory(_t(spark, d, "customer").select("c_name"), [("", "x"), ("Customer#000000500", "y"), ("Customer#000001000", "z")], "c_name")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN year(o_orderdate) WHEN o_orderkey % 3 = 0 THEN (year(o_orderdate) // 10) * 10 ELSE -1 END::INTEGER AS pub_year FROM orders")
def publication_years(spark, d):
    o = _t(spark, d, "orders")
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy")).when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("["), F.substring(F.date_format("o_orderdate", "yyyy"), 1, 3), F.lit("_]"))).otherwise(F.date_format("o_orderdate", "yyyy-MM"))
    return o.select("o_orderkey", F.coalesce(ft.year(raw), F.lit(-1)).alias("pub_year"))


@query("SELECT doc_id, CASE WHEN lang = 'fr' THEN 'https://fr.example.org/d' || doc_id || '?page=3' ELSE 'https://example.org/d' || doc_id END AS url FROM documents")
def deep_links(spark, d):
    docs = _t(spark, d, "documents")
    ref = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    return docs.select("doc_id", ft.templated(ref, F.lit(3), F.array("lang"), [("fr", "https://fr.example.org/${REF}?page=${PAGE}")], "https://example.org/${REF}").alias("url"))


@query("SELECT doc_id, source, lang, source AS author FROM documents")
def metadata_round_trip(spark, d):
    from quirespark.sources import metadata

    docs = _t(spark, d, "documents").select("doc_id", "source", "lang")
    null = F.lit(None).cast("string")
    record = F.struct(F.col("source").alias("title"), null.alias("title_en"), F.col("source").alias("author"), null.alias("author_en"), null.alias("pub_year_raw"), null.alias("publisher"), F.col("lang").alias("volume"), null.alias("url"), F.array("lang").alias("collections"))
    read = docs.withColumn("record", record).withColumn("xml", metadata.write("record")).withColumn("back", metadata.read(F.col("xml")))
    return read.select("doc_id", F.col("back.title").alias("source"), F.get("back.collections", F.lit(0)).alias("lang"), F.col("back.author").alias("author"))


def queries() -> dict[str, Query]:
    from quirespark import more_queries  # noqa: F401  it registers its own

    return dict(_found)


def oracle_sql() -> dict[str, str]:
    from quirespark import more_queries  # noqa: F401

    return dict(_sql)
