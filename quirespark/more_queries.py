"""More registered queries: lookups, images, suggestions, corrections and changes of tables, with the SQL that gives the same rows.

A conversation is a document, a turn a row, four turns a page, what stands between spaces a word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirespark.functions import geometry
from quirespark.functions import text as ft
from quirespark.operators import corrections, layout, lookup, snippets, store
from quirespark.plans import criteria as c
from quirespark.plans.match import scores
from quirespark.queries import ANALYSED, CORR, LINES, REVS, TOK, TURNS, _corrections, _hits, _revisions, _t, _turns, bm25, corpus, engine, index, query
from quirespark.sources import metadata
from quirespark.streaming.reindex import reindexed


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return _turns(spark, d).groupBy("rev", "page_no").agg(F.min("start_offset").alias("start_offset")).withColumns({"width": F.lit(2000), "height": F.lit(40)})


def _rows(spark: SparkSession, d: str) -> DataFrame:
    rect = geometry.rectangle(F.lit(0), (F.col("row_no") % 4 * 10).cast("int"), F.col("size") * 10, F.lit(10))
    return _turns(spark, d).select("rev", "page_no", "row_no", "start_offset", rect.alias("rect"))


def _words(spark: SparkSession, d: str) -> DataFrame:
    """Words ten wide a character; the last word of every even turn goes on with the first of the next."""
    turn = _turns(spark, d)
    following = F.lead("start_offset").over(Window.partitionBy("rev").orderBy("row_no"))
    cut = turn.withColumn("next", following).withColumn("n", F.size(F.split("text", " ", -1))).select("*", F.posexplode(F.split("text", " ", -1)).alias("word_no", "content"))
    before = Window.partitionBy("rev", "row_no").orderBy("word_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.withColumn("at", F.coalesce(F.sum(F.length("content") + 1).over(before), F.lit(0)).cast("int")).where("content <> ''")
    half = F.when((F.col("row_no") % 2 == 0) & (F.col("word_no") == F.col("n") - 1), F.col("next"))
    start = F.col("start_offset") + F.col("at")
    return placed.select("rev", "page_no", "row_no", "word_no", start.alias("start_offset"), (start + F.length("content")).alias("end_offset"), half.alias("hyphenated_offset"), "content", geometry.rectangle(F.col("at") * 10, (F.col("row_no") % 4 * 10).cast("int"), F.length("content") * 10, F.lit(10)).alias("rect"))


WORDS = f"""{TURNS.replace("FROM conversations)", "- 0 AS start_offset, text, length(text)::INTEGER AS size FROM conversations)").replace("::INTEGER AS start_offset - 0 AS start_offset", "::INTEGER AS start_offset")},
w0 AS (SELECT *, lead(start_offset) OVER (PARTITION BY rev ORDER BY row_no) AS nx, string_split(text, ' ') AS ws FROM tr),
w1 AS (SELECT *, len(ws) AS n, unnest(ws) AS content, unnest(range(len(ws)))::INTEGER AS word_no FROM w0),
w2 AS (SELECT *, (sum(length(content) + 1) OVER (PARTITION BY rev, row_no ORDER BY word_no) - length(content) - 1)::INTEGER AS "at" FROM w1),
w AS (SELECT rev, page_no, row_no, word_no, content, (start_offset + "at")::INTEGER AS start_offset, (start_offset + "at" + length(content))::INTEGER AS end_offset, CASE WHEN row_no % 2 = 0 AND word_no = n - 1 THEN nx END AS hyphenated_offset,
  "at" * 10 AS l, row_no % 4 * 10 AS t, (length(content) * 10)::INTEGER AS wd FROM w2 WHERE content <> ''),
pg AS (SELECT rev, page_no, min(start_offset)::INTEGER AS start_offset FROM tr GROUP BY ALL)"""


@query(f"WITH {WORDS} SELECT rev, page_no, start_offset FROM pg WHERE page_no = 1")
def page_of_number(spark, d):
    pages = _pages(spark, d)
    return lookup.pages_numbered(pages, pages.select("rev").distinct().withColumn("page_no", F.lit(1))).select("rev", "page_no", "start_offset")


@query(f"WITH {WORDS} SELECT rev, page_no, row_no, start_offset, size * 10 AS width FROM tr WHERE page_no = 0 AND row_no = 2")
def row_of_number(spark, d):
    rows = _rows(spark, d)
    keys = rows.select("rev").distinct().withColumns({"page_no": F.lit(0), "row_no": F.lit(2)})
    return lookup.rows_numbered(rows, keys).select("rev", "page_no", "row_no", "start_offset", F.col("rect.width").alias("width"))


@query(f"WITH {WORDS} SELECT rev * 1000000 + start_offset AS id, content FROM w WHERE start_offset % 7 = 0")
def word_of_id(spark, d):
    words = _words(spark, d).withColumn("id", F.col("rev") * 1_000_000 + F.col("start_offset"))
    return lookup.by_id(words, words.where("start_offset % 7 = 0").select("id")).select("id", "content")


@query(f"WITH {WORDS} SELECT w.rev, w.start_offset AS \"offset\", w.page_no, pg.start_offset FROM w JOIN pg ON pg.rev = w.rev AND pg.page_no = w.page_no WHERE w.start_offset % 5 = 0")
def page_of_word_offset(spark, d):
    words = _words(spark, d)
    keys = words.where("start_offset % 5 = 0").select("rev", F.col("start_offset").alias("offset"))
    return lookup.pages_of_words(_pages(spark, d), words, keys).select("rev", "offset", "page_no", "start_offset")


@query(f"WITH {WORDS} SELECT w.rev, w.start_offset AS \"offset\", w.page_no, w.row_no FROM w WHERE w.start_offset % 5 = 0")
def row_of_word_offset(spark, d):
    words = _words(spark, d)
    keys = words.where("start_offset % 5 = 0").select("rev", F.col("start_offset").alias("offset"))
    return lookup.rows_starting(_rows(spark, d), words, keys).select("rev", "offset", "page_no", "row_no")


@query(
    f"""WITH {WORDS}, p AS (SELECT rev, page_no * 2 AS page_no, start_offset FROM pg), l AS (SELECT *, lag(page_no) OVER (PARTITION BY rev ORDER BY start_offset) AS b FROM p)
SELECT rev, start_offset, 'x' AS text, page_no::INTEGER AS page_no FROM p UNION ALL SELECT rev, start_offset, '', (page_no - 1)::INTEGER FROM l WHERE b IS NOT NULL"""
)
def pages_with_numbers(spark, d):
    """Pages with every second number: those between are missing and come back empty."""
    pages = _pages(spark, d).withColumn("page_no", F.col("page_no") * 2)
    return lookup.physical_pages(pages.select("rev", "start_offset", F.lit("x").alias("text")), pages)


@query(
    f"""WITH {WORDS}, k AS (SELECT DISTINCT rev, 30 AS "offset" FROM w), f AS (SELECT k.rev, min(start_offset) AS s FROM k JOIN w ON w.rev = k.rev AND w.start_offset >= 30 GROUP BY 1),
a AS (SELECT w.* FROM w JOIN f ON f.rev = w.rev AND f.s = w.start_offset), g AS (SELECT a.rev, min(w.start_offset) AS s FROM a JOIN w ON w.rev = a.rev AND w.start_offset >= a.hyphenated_offset GROUP BY 1)
SELECT rev, 0 AS part, page_no, l AS "left", t AS top, wd AS width FROM a UNION ALL SELECT w.rev, 1, page_no, l, t, wd FROM w JOIN g ON g.rev = w.rev AND g.s = w.start_offset"""
)
def highlight_rectangles(spark, d):
    words = _words(spark, d)
    found = lookup.highlight_rects(words, words.select("rev").distinct().withColumn("offset", F.lit(30)))
    return found.select("rev", "part", "page_no", "rect.left", "rect.top", "rect.width")


@query(
    f"""WITH {WORDS}, r AS (SELECT rev, min(row_no % 4 * 10) AS t, max(row_no % 4 * 10 + 10) AS b, max(size * 10) AS wd FROM tr WHERE page_no = 0 AND row_no BETWEEN 1 AND 2 GROUP BY 1),
s AS (SELECT rev, 0 AS bl, floor(t * 1.5)::INTEGER AS bt, floor(wd * 0.5)::INTEGER AS bw, floor((b - t) * 1.5)::INTEGER AS bh FROM r),
k AS (SELECT rev, greatest(bl - 5, 0) AS cl, greatest(bt - 5, 0) AS ct, least(bl + bw + 5, 1000) - greatest(bl - 5, 0) AS cw, least(bt + bh + 5, 60) - greatest(bt - 5, 0) AS ch FROM s),
h AS (SELECT w.rev, greatest(floor(l * 0.5) - cl - 2, 0) AS hl, least(floor(l * 0.5) - cl - 2 + floor(wd * 0.5) + 4, cw) AS hr, greatest(floor(t * 1.5) - ct - 2, 0) AS ht, least(floor(t * 1.5) - ct - 2 + 15 + 4, ch) AS hb FROM w JOIN k USING (rev) WHERE row_no = 1 AND word_no < 3)
SELECT k.rev, cl AS "left", ct AS top, greatest(cw, 0)::INTEGER AS width, ch AS height, count(*) FILTER (hr > hl AND hb > ht) AS n, coalesce(sum(hr - hl) FILTER (hr > hl AND hb > ht), 0)::BIGINT AS wide FROM k LEFT JOIN h USING (rev) GROUP BY ALL"""
)
def image_crops(spark, d):
    """The second and third row of each document on an image of half the width and one and a half times the height."""
    rows, words = _rows(spark, d), _words(spark, d)
    spans = rows.where("page_no = 0 and row_no between 1 and 2").select("rev", F.lit(0).alias("span"), "page_no", "rect")
    marks = words.where("row_no = 1 and word_no < 3").select("rev", F.lit(0).alias("span"), "rect")
    pages = _pages(spark, d)
    images = pages.select("rev", "page_no", F.lit(1000).alias("image_width"), F.lit(60).alias("image_height"))
    found = lookup.image_snippets(spans, marks, pages, images)
    wide = F.aggregate("highlights", F.lit(0).cast("long"), lambda acc, x: acc + x["width"])
    return found.select("rev", "crop.left", "crop.top", "crop.width", "crop.height", F.size("highlights").cast("long").alias("n"), wide.alias("wide"))


@query(f"WITH {WORDS} SELECT rev, page_no, to_base64(encode('page' || page_no)) AS image FROM pg WHERE page_no = 0")
def image_bytes(spark, d):
    pages = _pages(spark, d)
    contents = pages.select("rev", "page_no", F.concat(F.lit("page"), F.col("page_no").cast("string")).cast("binary").alias("content"))
    return lookup.image_responses(pages.where("page_no = 0").select("rev", "page_no"), contents).select("rev", "page_no", "image")


@query(f"WITH {WORDS} SELECT rev AS doc_ref, page_no, row_no, rev AS suggestion FROM tr WHERE row_no % 4 < 2 AND size > 0")
def rows_of_suggestions(spark, d):
    """A suggestion on each page that covers its first two rows and ends where the third begins."""
    pages = _pages(spark, d).withColumnRenamed("rev", "doc_ref")
    made = pages.select("doc_ref", "page_no", F.col("doc_ref").alias("rev"), F.lit(False).alias("ignore"), F.col("doc_ref").alias("suggestion"), geometry.rectangle(F.lit(0), F.lit(0), F.lit(10_000), F.lit(5_000)).alias("grid"))
    found = lookup.suggested_rows(_rows(spark, d).withColumnRenamed("rev", "doc_ref"), made, pages)
    return found.select("doc_ref", "page_no", "row_no", "suggestion")


@query(
    f"""WITH {WORDS}, f AS (SELECT rev, min(start_offset) AS s FROM w WHERE start_offset >= 30 GROUP BY 1)
SELECT w.rev, w.start_offset, content AS previous_text, page_no, floor(l * 10000 / 2000)::INTEGER AS "left", floor(t * 10000 / 40)::INTEGER AS top, floor(wd * 10000 / 2000)::INTEGER AS width FROM w JOIN f ON f.rev = w.rev AND f.s = w.start_offset"""
)
def suggestions_made(spark, d):
    """A suggestion for the first word behind the thirtieth character of each document."""
    words, turn = _words(spark, d), _turns(spark, d)
    docs = turn.groupBy("rev").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row_no", "text"))), lambda x: x["text"]), "\n").alias("text"))
    asked = words.select("rev").distinct().withColumns({"offset": F.lit(30), "suggestion": F.lit("other")})
    return layout.suggestion_rows(words, docs, _pages(spark, d), asked).select("rev", "start_offset", "previous_text", "page_no", "grid.left", "grid.top", "grid.width")


@query(
    f"""WITH {WORDS}, h AS (SELECT rev, start_offset, CASE WHEN start_offset % 2 = 0 THEN content || '-' ELSE content END AS content, l, wd FROM w),
b AS (SELECT *, regexp_extract(content, '^(.+)([-־⸗])$', 1) AS body FROM h), e AS (SELECT *, floor(wd / (length(body) + 1))::INTEGER AS ea FROM b)
SELECT rev, start_offset, 'word' AS kind, CASE WHEN body = '' THEN content ELSE body END AS content, l AS "left", CASE WHEN body = '' THEN wd ELSE ea * length(body) END::INTEGER AS width FROM e
UNION ALL SELECT rev, start_offset, 'hyphen', right(content, 1), (l + ea * length(body))::INTEGER, ea FROM e WHERE body <> ''"""
)
def hyphens_split(spark, d):
    """Every second word with a hyphen behind it."""
    words = _words(spark, d).withColumn("content", F.when(F.col("start_offset") % 2 == 0, F.concat("content", F.lit("-"))).otherwise(F.col("content")))
    cut = words.select("rev", "start_offset", F.explode(layout.hyphen_split(F.col("content"), "rect")).alias("p"))
    return cut.select("rev", "start_offset", "p.kind", "p.content", "p.rect.left", "p.rect.width")


@query(
    f"""WITH {WORDS}, x AS (SELECT rev, start_offset, regexp_extract_all(content, '\\p{{P}}|[^\\p{{P}}]+') AS ps, l, wd, length(content) AS n FROM w WHERE NOT regexp_matches(content, '[‛“''"’.]')),
p AS (SELECT rev, start_offset, len(ps) AS k, unnest(ps) AS content, unnest(range(len(ps)))::INTEGER AS part, l, wd, n FROM x),
q AS (SELECT *, CASE WHEN part < k - 1 THEN floor(length(content) / n * wd + 0.5)::INTEGER END AS own FROM p),
z AS (SELECT *, coalesce(sum(own) OVER (PARTITION BY rev, start_offset ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM q)
SELECT rev, start_offset, part, content, (l + done)::INTEGER AS "left", coalesce(own, wd - done)::INTEGER AS width FROM z"""
)
def broken_words(spark, d):
    """Words without quotes and points, cut at their punctuation."""
    words = _words(spark, d).where(~F.col("content").rlike("[‛“'\"’.]"))
    cut = words.select("rev", "start_offset", F.posexplode(layout.word_parts(F.col("content"), F.col("rect"))).alias("part", "p"))
    return cut.select("rev", "start_offset", "part", "p.content", "p.rect.left", "p.rect.width")


_LAYOUT = """c AS (SELECT conv_id AS rev, turn AS line_no, turn // 4 AS page_no, regexp_extract_all(text, '[^ ]+| +') AS ps FROM conversations),
p AS (SELECT rev, page_no, line_no, unnest(ps) AS content, unnest(range(len(ps))) AS ord FROM c),
z AS (SELECT *, length(content) + (line_no IS DISTINCT FROM lead(line_no) OVER w)::INTEGER + (page_no IS DISTINCT FROM lead(page_no) OVER w)::INTEGER AS size FROM p WINDOW w AS (PARTITION BY rev ORDER BY line_no, ord)),
o AS (SELECT *, length(rev::VARCHAR) + 1 + sum(size) OVER (PARTITION BY rev ORDER BY line_no, ord) - size AS start_offset FROM z)"""


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    turn = _t(spark, d, "conversations").select(F.col("conv_id").alias("rev"), F.col("turn").cast("int").alias("line_no"), F.posexplode(F.regexp_extract_all("text", F.lit("([^ ]+| +)"), 1)).alias("ord", "content"))
    kind = F.when(F.trim("content") == "", "space").otherwise("word")
    rect = geometry.rectangle(F.col("ord") * 10, F.lit(0), F.length("content"), F.lit(10))
    pieces = turn.select("rev", F.length(F.col("rev").cast("string")).alias("ref_length"), F.floor(F.col("line_no") / 4).cast("int").alias("page_no"), F.lit(0).alias("block_no"), "line_no", "ord", "content", kind.alias("kind"), rect.alias("rect"))
    flat = layout.flattened(pieces)
    sizes = flat.select("rev", "page_no").distinct().withColumns({"width": F.lit(1), "height": F.lit(1)})
    return layout.layout_tables(flat, sizes)


@query(f"WITH {_LAYOUT} SELECT rev, page_no::INTEGER AS page_no, min(start_offset)::INTEGER AS start_offset FROM o GROUP BY ALL")
def loaded_pages(spark, d):
    return _tables(spark, d)[0].select("rev", "page_no", "start_offset")


@query(f"WITH {_LAYOUT} SELECT rev, page_no::INTEGER AS page_no, (row_number() OVER (PARTITION BY rev, page_no ORDER BY line_no) - 1)::INTEGER AS row_no, min(start_offset)::INTEGER AS start_offset FROM o GROUP BY rev, page_no, line_no")
def loaded_rows(spark, d):
    return _tables(spark, d)[1].select("rev", "page_no", "row_no", "start_offset")


@query(f"WITH {_LAYOUT}, r AS (SELECT *, dense_rank() OVER (PARTITION BY rev, page_no ORDER BY line_no) - 1 AS row_no FROM o) SELECT rev, page_no::INTEGER AS page_no, row_no::INTEGER AS row_no, start_offset::INTEGER AS start_offset, (start_offset + length(content))::INTEGER AS end_offset FROM r WHERE trim(content) <> ''")
def loaded_words(spark, d):
    return _tables(spark, d)[2].select("rev", "page_no", "row_no", "start_offset", "end_offset")


@query(f"WITH {CORR} SELECT doc_ref, id, field, rev FROM cr WHERE doc_ref IN ('d1', 'd2', 'd3')")
def corrections_of_documents(spark, d):
    table, links = _corrections(spark, d)
    refs = spark.createDataFrame([("d1",), ("d2",), ("d3",)], "doc_ref string")
    return corrections.corrections_of(table, links, refs).select("doc_ref", "id", "field", "rev")


@query(f"WITH {CORR} SELECT id AS correction_id, doc_ref FROM cr WHERE id % 10 = 3")
def documents_of_corrections(spark, d):
    _, links = _corrections(spark, d)
    return corrections.documents_of(links, links.where("correction_id % 10 = 3").select("correction_id"))


@query(f"WITH {CORR} SELECT id, id % 4 = 1 AS sent FROM cr")
def corrections_sent(spark, d):
    table = _corrections(spark, d)[0].withColumn("sent", F.lit(False))
    return corrections.sent(table, table.where("id % 4 = 1").select("id")).select("id", "sent")


@query(f"WITH {REVS} SELECT i.reference, cr.field, cr.event_id AS metadata_correction_rev FROM indexed i JOIN e cr ON cr.event_id = i.doc_rev WHERE i.doc_rev % 2 = 0")
def corrections_backfilled(spark, d):
    """Every second document knew the revision of one correction."""
    r = _revisions(spark, d)
    known = r["indexed"].select("reference", F.when(F.col("doc_rev") % 2 == 0, F.col("doc_rev")).alias("metadata_correction_rev"))
    return corrections.backfilled(known, r["corrections"])


def _preferences(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    return e.groupBy(F.col("user_id").alias("username"), F.col("event_type").alias("key")).agg(F.max("event_id").alias("preference"))


_PREF = "p AS (SELECT user_id AS username, event_type AS key, max(event_id) AS preference FROM events GROUP BY ALL)"


@query(f"WITH {_PREF} SELECT username, key, CASE WHEN username % 3 = 0 THEN -1 ELSE preference END AS preference FROM p UNION ALL SELECT DISTINCT username, 'new', -1 FROM p WHERE username % 3 = 0")
def preferences_changed(spark, d):
    kept = _preferences(spark, d)
    changed = kept.where("username % 3 = 0").withColumn("preference", F.lit(-1).cast("long"))
    return store.with_preferences(kept, changed.unionByName(changed.withColumn("key", F.lit("new")).distinct()))


@query(f"WITH {_PREF} SELECT * FROM p WHERE NOT (username % 3 = 0 AND key = 'click')")
def preferences_deleted(spark, d):
    kept = _preferences(spark, d)
    return store.without_preferences(kept, kept.where("username % 3 = 0 and key = 'click'").select("username", "key"))


@query(f"WITH {REVS}, g AS (SELECT max(rev) AS rev FROM document WHERE reference IN ('d1', 'd2', 'd5') GROUP BY reference) SELECT reference, rev, false AS is_page FROM document WHERE rev NOT IN (SELECT rev FROM g) UNION ALL SELECT reference, rev, true FROM document WHERE rev NOT IN (SELECT rev FROM g)")
def documents_removed(spark, d):
    """The newest revision of three documents goes, and its pages with it; here each revision has one page."""
    documents = _revisions(spark, d)["documents"].select("reference", "rev")
    refs = spark.createDataFrame([("d1",), ("d2",), ("d5",)], "reference string")
    left, pages, _, _ = store.removed(documents, documents, documents, documents, refs)
    return left.withColumn("is_page", F.lit(False)).unionByName(pages.select("reference", "rev").withColumn("is_page", F.lit(True)))


@query(f"WITH {REVS} SELECT reference, rev, CASE WHEN rev % 7 = 0 THEN 'Indexed' ELSE status END AS status, CASE WHEN rev % 7 = 0 THEN 'none' END AS failure_reason FROM document")
def status_changed(spark, d):
    documents = _revisions(spark, d)["documents"].withColumn("failure_reason", F.lit(None).cast("string"))
    return store.with_status(documents, documents.where("rev % 7 = 0").select("rev"), "Indexed", "none").select("reference", "rev", "status", "failure_reason")


@query("SELECT 'u1' AS username, 'that' AS query, 'Score' AS sort, 0 AS first_result, 10 AS max_result, 5::BIGINT AS result_count")
def logged_query(spark, d):
    return store.query_row(spark, "u1", c.And(c.ValueIn("Author", ("src1",)), c.Contains(("Text",), "that")), "Score", 0, 10, 5).select("username", "query", "sort", "first_result", "max_result", "result_count")


@query("SELECT 'u1' AS username, '10.0.0.1' AS ip, 'GET /search' AS method_and_url, 'q=that' AS querystring")
def logged_request(spark, d):
    return store.request_row(spark, "u1", "10.0.0.1", "GET /search", "q=that").drop("created")


@query(
    f"""WITH {REVS}, done AS (SELECT reference FROM indexed WHERE reindex = 'Yes' OR doc_rev % 3 = 0), nd AS (SELECT reference, max(rev) AS r FROM document WHERE status = 'Complete' GROUP BY 1), nw AS (SELECT doc_ref AS reference, max(rev) AS r FROM word_suggestion GROUP BY 1)
SELECT i.reference, CASE WHEN d.reference IS NULL THEN i.doc_rev ELSE nd.r END AS doc_rev, coalesce(CASE WHEN d.reference IS NULL THEN i.word_suggestion_rev ELSE nw.r END, -1) AS word_suggestion_rev, CASE WHEN d.reference IS NULL THEN i.reindex ELSE 'No' END AS reindex
FROM indexed i LEFT JOIN done d USING (reference) LEFT JOIN nd USING (reference) LEFT JOIN nw USING (reference)"""
)
def state_after_reindex(spark, d):
    """What is noted of each document after those that are marked, or whose revision divides by three, are indexed again."""
    r = _revisions(spark, d)
    done = r["indexed"].where("reindex = 'Yes' or doc_rev % 3 = 0").select("reference")
    state = r | {"indexed": r["indexed"].withColumn("index_time", F.lit(None).cast("timestamp"))}
    return reindexed(state, done, "2024-01-01 00:00:00").select("reference", "doc_rev", F.coalesce("word_suggestion_rev", F.lit(-1)).alias("word_suggestion_rev"), "reindex")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'p' || doc_id || '.png' WHEN doc_id % 3 = 1 THEN 'p' || doc_id || '.jpg' END AS path FROM documents")
def page_images(spark, d):
    """A third of the pages have a png and a jpg, a third a jpg alone, a third none."""
    docs = _t(spark, d, "documents").select("doc_id", F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("stem"))
    png = docs.where("doc_id % 3 = 0").select(F.concat("stem", F.lit(".png")).alias("path"))
    jpg = docs.where("doc_id % 3 < 2").select(F.concat("stem", F.lit(".jpg")).alias("path"))
    return metadata.image_paths(docs, png.unionByName(jpg)).select("doc_id", "path")


@query("SELECT doc_id, source, CASE WHEN source = 'src1' THEN 'one,uno' WHEN source = 'src2' THEN 'two' ELSE '' END AS alternatives FROM documents")
def spelling_alternatives(spark, d):
    lexicon = spark.createDataFrame([("Src1", "uno"), ("src1", "one"), ("src2", "two")], "word string, other string")
    words = _t(spark, d, "documents").select("doc_id", "source", F.col("source").alias("content"))
    return ft.with_alternatives(words, lexicon).select("doc_id", "source", F.array_join("alternatives", ",").alias("alternatives"))


@query(f"WITH {TOK} SELECT DISTINCT doc_ref FROM tok WHERE term >= 'stupa' AND term < 'stupie'")
def match_range(spark, d):
    return scores(index(spark, d), c.Contains(("Text",), "[stupa TO stupie}")).select("doc_ref")


@query(f"WITH {TOK}, {bm25("term = 'that'", 'a')}, {bm25("term = 'from'", 'b')}, {bm25("term = 'with'", 'x')} SELECT doc_ref, round(sum(score), 4) AS score FROM (SELECT doc_ref, 2.5 * score AS score FROM a UNION ALL SELECT doc_ref, 2.5 * score FROM b UNION ALL SELECT * FROM x) GROUP BY 1")
def search_group_boost(spark, d):
    return scores(index(spark, d), c.Contains(("Text",), "(that from)^2.5 with")).select("doc_ref", F.round("score", 4).alias("score"))


@query(
    f"""WITH {TOK}, h AS (SELECT doc_ref, position, lag(position, 2) OVER (PARTITION BY doc_ref ORDER BY position) AS p2 FROM tok WHERE term = 'of') SELECT DISTINCT doc_ref FROM h WHERE position - p2 + 1 - 3 <= 6"""
)
def match_slop_repeated(spark, d):
    """The same word three times within nine places: each place of the phrase takes a word of its own."""
    return scores(index(spark, d), c.Contains(("Text",), '"of of of"~6')).select("doc_ref")


@query(f"WITH {TOK} SELECT count(DISTINCT doc_ref) AS total FROM tok WHERE starts_with(term, 'th')")
def total_of_prefix(spark, d):
    """A prefix stands for more words the larger the corpus is; none are left out and the search is not refused."""
    return engine(spark, d).total(c.Contains(("Text",), "th*"))


_BOLD = "(?i)\\b(loser|moron)\\b"
_SNIPPETS = f"""{LINES}, rt AS (SELECT doc_ref, row_no, unnest(regexp_extract_all(lower(line), '[\\p{{L}}\\p{{M}}\\p{{N}}]+')) AS term FROM l),
hit AS (SELECT doc_ref, row_no, count(*) AS n FROM rt WHERE term IN ('loser', 'moron') GROUP BY ALL),
g AS (SELECT *, CASE WHEN row_no - lag(row_no) OVER (PARTITION BY doc_ref ORDER BY row_no) <= 3 THEN 0 ELSE 1 END AS new FROM hit),
i AS (SELECT *, sum(new) OVER (PARTITION BY doc_ref ORDER BY row_no) AS island FROM g),
e AS (SELECT doc_ref, island, min(row_no) - 1 AS a, max(row_no) + 1 AS b, sum(n) AS score FROM i GROUP BY ALL),
s AS (SELECT e.doc_ref, island, score, min(start_offset)::INTEGER AS start, max(start_offset + length(line))::INTEGER AS "end",
  string_agg(regexp_replace(line, '{_BOLD}', '<b>\\1</b>', 'g'), '<br>' ORDER BY row_no) AS snippet
  FROM e JOIN ln ON ln.doc_ref = e.doc_ref AND row_no BETWEEN a AND b GROUP BY e.doc_ref, island, score),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_ref ORDER BY score DESC, start, "end" DESC) <= 3)"""


@query(f"WITH {_SNIPPETS} SELECT doc_ref, start, \"end\", snippet FROM best")
def snippet_best(spark, d):
    """The three best snippets of a document, in the order of its text, with the matches in bold."""
    found, lines = _hits(spark, d)
    return snippets.snippets(snippets.islands(found, lines, 1, 3), corpus(spark, d)).select("doc_ref", "start", "end", "snippet")


@query(f"WITH {_SNIPPETS} SELECT doc_ref, start, '<div class=\"snippet\">' || replace(replace(snippet, '<br><br>', '</div><div class=\"snippet\">'), '<br>', ' ') || '</div>' AS snippet, 0 AS page_no, 'https://example.org/' || doc_ref || '/0' AS deep_link FROM best")
def snippets_shown(spark, d):
    """Snippets as they are shown: in divisions, without line ends, with the page and its address."""
    found, lines = _hits(spark, d)
    own = snippets.snippets(snippets.islands(found, lines, 1, 3), corpus(spark, d)).withColumn("rev", F.col("doc_ref"))
    words = lines.select(F.col("doc_ref").alias("rev"), "page_no", "start_offset")
    pages = lines.select(F.col("doc_ref").alias("rev"), "page_no").distinct()
    return snippets.shown_snippets(own, pages, words, corpus(spark, d), [], "https://example.org/${REF}/${PAGE}", newlines=False).select("doc_ref", "start", "snippet", "page_no", "deep_link")


@query(
    f"""WITH {ANALYSED}, h AS (SELECT doc_ref, string_agg(start || '-' || "end", ' ' ORDER BY start) AS highlights FROM an WHERE term IN ('loser', 'moron') GROUP BY 1)
SELECT doc_ref, 0 AS page_no, text, coalesce(highlights, '') AS highlights FROM (SELECT 'd' || doc_id AS doc_ref, text FROM documents WHERE lower(text) LIKE '%loser%' OR lower(text) LIKE '%moron%') LEFT JOIN h USING (doc_ref)"""
)
def pages_highlighted(spark, d):
    found, lines = _hits(spark, d)
    each = F.array_join(F.transform("highlights", lambda h: F.concat(h["start"].cast("string"), F.lit("-"), h["end"].cast("string"))), " ")
    return snippets.highlighted_pages(lines, found).select("doc_ref", "page_no", "text", each.alias("highlights"))


@query("SELECT 'c' || conv_id AS doc_ref, regexp_replace(string_agg(replace(text, ' the ', '-' || chr(10)), chr(10) ORDER BY turn), '[-־⸗]\n', '', 'g') AS text FROM conversations GROUP BY 1")
def plain_text_of_words(spark, d):
    """Pages with line ends inside words, which are joined again."""
    text = F.replace("text", F.lit(" the "), F.lit("-\n"))
    pages = _t(spark, d, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("doc_ref"), F.col("turn").alias("page_no"), text.alias("text"))
    return snippets.plain_text(pages, whole_words=True)


@query(f"WITH {TOK} SELECT DISTINCT a.doc_ref FROM tok a JOIN tok b ON b.doc_ref = a.doc_ref AND b.position = a.position + 1 WHERE a.term = 'of' AND b.term = 'src3' UNION SELECT 'd' || doc_id FROM documents WHERE source = 'src3'")
def match_phrase_fields(spark, d):
    """A phrase in either of two fields."""
    return scores(index(spark, d, titles=True), c.Contains(("Text", "Title"), '"of src3"')).select("doc_ref")
