"""Snippets and highlighted pages, as islands of rows.

Highlighted rows of a page belong to one snippet if at most ``2 * padding + 1`` apart; a snippet shows ``padding`` rows on each
side, within its page. Only documents that were chosen need to come here, so the windows are over a page of results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirespark.functions.text import dehyphenated, templated
from quirespark.operators.layout import as_of, logical_page
from quirespark.operators.lookup import pages_of_words


def islands(hits: DataFrame, rows: DataFrame, padding: int = 2, most: int | None = 100) -> DataFrame:
    """Rows ``(doc_ref, page_no, first_row, last_row, start, end, score, tokens)`` in the order of the text.

    ``hits``: doc_ref, page_no, row_no, start, end and, where known, last_row. ``rows``: doc_ref, page_no, row_no, start_offset,
    end_offset. The best ``most`` of a document stay, all where it is null.
    """
    marked = hits.withColumn("last_hit", F.coalesce("last_row", "row_no") if "last_row" in hits.columns else F.col("row_no"))
    by_row = marked.groupBy("doc_ref", "page_no", "row_no").agg(F.max("last_hit").alias("reach"), F.count("*").cast("double").alias("score"), F.sort_array(F.collect_set(F.struct("start", "end"))).alias("tokens"))
    order = Window.partitionBy("doc_ref", "page_no").orderBy("row_no")
    before = F.max("reach").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col("row_no") - before > 2 * padding + 1, F.lit(True)).cast("int")
    numbered = by_row.withColumn("new", new).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = numbered.groupBy("doc_ref", "page_no", "island").agg(
        (F.min("row_no") - padding).alias("a"), (F.max("reach") + padding).alias("b"), F.sum("score").alias("score"), F.sort_array(F.flatten(F.collect_list("tokens"))).alias("tokens")
    )
    shown = rows.join(grouped, ["doc_ref", "page_no"]).where(F.col("row_no").between(F.col("a"), F.col("b")))
    found = shown.groupBy("doc_ref", "page_no", "island", "score", "tokens").agg(F.min("row_no").alias("first_row"), F.max("row_no").alias("last_row"), F.min("start_offset").alias("start"), F.max("end_offset").alias("end"))
    if most is None:
        return found.select("doc_ref", "page_no", "first_row", "last_row", "start", "end", "score", "tokens").orderBy("doc_ref", "start")
    best = Window.partitionBy("doc_ref").orderBy(F.desc("score"), "start", F.desc("end"))
    return found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= most).select("doc_ref", "page_no", "first_row", "last_row", "start", "end", "score", "tokens").orderBy("doc_ref", "start")


def beginnings(rows: DataFrame, shown: int = 3) -> DataFrame:
    """The snippet of a document without a match: its first rows."""
    first = rows.groupBy("doc_ref").agg(F.min(F.struct("page_no", "row_no")).alias("f"))
    own = rows.join(first, "doc_ref").where((F.col("page_no") == F.col("f.page_no")) & (F.col("row_no") < F.col("f.row_no") + shown))
    return own.groupBy("doc_ref", "page_no").agg(F.min("row_no").alias("first_row"), F.max("row_no").alias("last_row"), F.min("start_offset").alias("start"), F.max("end_offset").alias("end"))


def merged(tokens: DataFrame) -> DataFrame:
    """Rows ``(doc_ref, start, end, score)``: tokens that touch or overlap joined, their scores added."""
    order = Window.partitionBy("doc_ref").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col("start") > reach, F.lit(True)).cast("int")
    numbered = tokens.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))) if "new" in tokens.columns else tokens.withColumn("new", new).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc_ref", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("score").alias("score")).drop("island")


def markup(text: F.Column, start: F.Column, end: F.Column, tokens: F.Column, pre: str = "<b>", post: str = "</b>", offsets: bool = False) -> F.Column:
    """The lines of ``text[start:end]`` joined by ``<br>``, the tokens (sorted, in document offsets) between the tags.

    A fold over the tokens that fall in each line; a token that runs over a line's end is cut there and goes on in the next.
    """
    cut = F.split(F.substring(text, start + 1, end - start), "\n", -1)
    none = F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<struct<start:int,line:string>>").alias("lines"))
    placed = F.aggregate(cut, none, lambda acc, line: F.struct((acc["at"] + F.length(line) + 1).cast("int").alias("at"), F.concat(acc["lines"], F.array(F.struct((start + acc["at"]).cast("int").alias("start"), line.alias("line")))).alias("lines")))["lines"]

    def span(at: F.Column, piece: F.Column) -> F.Column:
        return F.concat(F.lit('<span offset="'), at.cast("string"), F.lit('">'), piece, F.lit("</span>")) if offsets else piece

    def one(row: F.Column) -> F.Column:
        line, first = row["line"], row["start"]
        last = first + F.length(line)
        own = F.filter(tokens, lambda t: (t["end"] > first) & (t["start"] < last))

        def add(acc: F.Column, t: F.Column) -> F.Column:
            a, b = F.greatest(t["start"], first, acc["at"]), F.least(t["end"], last)
            between = F.when(acc["at"] < a, span(acc["at"], F.substring(line, acc["at"] - first + 1, a - acc["at"]))).otherwise("")
            marked = F.concat(F.lit(pre), span(a, F.substring(line, a - first + 1, b - a)), F.lit(post))
            return F.struct(F.when(b > a, b).otherwise(acc["at"]).cast("int").alias("at"), F.when(b > a, F.concat(acc["out"], between, marked)).otherwise(acc["out"]).alias("out"))

        folded = F.aggregate(own, F.struct(first.cast("int").alias("at"), F.lit("").alias("out")), add)
        rest = F.when(folded["at"] < last, span(folded["at"], F.substring(line, folded["at"] - first + 1, last - folded["at"]))).otherwise("")
        return F.concat(folded["out"], rest)

    return F.array_join(F.transform(placed, one), "<br>")


def snippets(found: DataFrame, docs: DataFrame, pre: str = "<b>", post: str = "</b>", offsets: bool = False) -> DataFrame:
    """``found`` (of :func:`islands`) with its ``snippet``; tokens that touch or overlap are marked as one."""
    joined = found.join(docs.select("doc_ref", F.col("text").alias("__text")), "doc_ref")
    return joined.withColumn("snippet", markup(F.col("__text"), F.col("start"), F.col("end"), touching(F.col("tokens")), pre, post, offsets)).drop("__text")


def touching(tokens: F.Column) -> F.Column:
    """Sorted tokens with those that touch or overlap joined."""
    none = F.array().cast("array<struct<start:int,end:int>>")

    def add(acc: F.Column, t: F.Column) -> F.Column:
        last = F.get(acc, F.size(acc) - 1)
        new = F.array(F.struct(t["start"].cast("int").alias("start"), t["end"].cast("int").alias("end")))
        longer = F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], t["end"].cast("int")).alias("end")))
        return F.when((F.size(acc) > 0) & (last["end"] >= t["start"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), longer)).otherwise(F.concat(acc, new))

    return F.aggregate(tokens, none, add)


def page_texts(rows: DataFrame) -> DataFrame:
    """Rows ``(doc_ref, page_no, start_offset, text)``: each page's lines joined."""
    each = rows.groupBy("doc_ref", "page_no").agg(F.min("start_offset").alias("start_offset"), F.sort_array(F.collect_list(F.struct("row_no", "line"))).alias("l"))
    return each.select("doc_ref", "page_no", "start_offset", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def uncovered(tokens: F.Column) -> F.Column:
    """Of sorted tokens those that begin at or behind the end of the one kept before: what stands twice is marked once."""
    none = F.struct(F.lit(-1).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("kept"))

    def add(acc: F.Column, t: F.Column) -> F.Column:
        more = F.concat(acc["kept"], F.array(F.struct(t["start"].alias("start"), t["end"].alias("end"))))
        return F.when(t["start"] >= acc["at"], F.struct(t["end"].alias("at"), more.alias("kept"))).otherwise(acc)

    return F.aggregate(tokens, none, add)["kept"]


def highlighted_pages(rows: DataFrame, hits: DataFrame, html: bool = False, pre: str = "<b>", post: str = "</b>", division: str = "snippet") -> DataFrame:
    """``page_texts`` with ``highlights``: page-relative ``[start, end)`` of the hits on each page, cut at line ends.

    Hits that know their page meet it by an equality; others get the last page that begins at or before them. With ``html`` the text has the hits between tags, lines end in ``<br>``
    and an empty line begins a new division. ``logical_page`` is the number printed on the page.
    """
    if "page_no" not in hits.columns:
        begun = rows.groupBy("doc_ref", "page_no").agg(F.min("start_offset").alias("begun"))
        hits = as_of(hits, begun, ["doc_ref"], "start", "begun", "page_no").where("page_no is not null")
    on = hits.groupBy("doc_ref", "page_no").agg(uncovered(F.sort_array(F.collect_set(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))))).alias("tokens"))
    found = page_texts(rows).join(on, ["doc_ref", "page_no"], "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<struct<start:int,end:int>>")))
    first = F.col("start_offset")

    def cut(t: F.Column) -> F.Column:
        """The token's pieces on each line it touches, from the page's beginning."""
        lines = F.split(F.substring(F.col("text"), t["start"] - first + 1, t["end"] - t["start"]), "\n", -1)
        none = F.struct((t["start"] - first).cast("int").alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

        def add(acc: F.Column, line: F.Column) -> F.Column:
            end = (acc["at"] + F.length(line)).cast("int")
            piece = F.array(F.struct(acc["at"].alias("start"), end.alias("end")))
            return F.struct((end + 1).cast("int").alias("at"), F.when(F.length(line) > 0, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(lines, none, add)["out"]

    shown = F.col("text")
    if html:
        marked = markup(F.col("text"), F.lit(0), F.length("text"), F.transform("tokens", lambda t: F.struct((t["start"] - first).alias("start"), (t["end"] - first).alias("end"))), pre, post)
        shown = divisions(marked, division)
    return found.select("doc_ref", "page_no", "start_offset", shown.alias("text"), F.flatten(F.transform("tokens", cut)).alias("highlights"), logical_page(F.col("text")).alias("logical_page"))


def divisions(text: F.Column, division: str = "snippet", newlines: bool = True) -> F.Column:
    """Text with ``<br>`` in divisions: an empty line begins a new one; without ``newlines`` the lines run on."""
    opened = f'<div class="{division}">'
    whole = F.concat(F.lit(opened), F.replace(text, F.lit("<br><br>"), F.lit(f"</div>{opened}")), F.lit("</div>"))
    return whole if newlines else F.replace(whole, F.lit("<br>"), F.lit(" "))


def shown_snippets(found: DataFrame, pages: DataFrame, words: DataFrame, docs: DataFrame, links: list[tuple[str, str]], default: str | None, division: str = "snippet", newlines: bool = True) -> DataFrame:
    """``found`` (rev, doc_ref, start, snippet, ...) as it is shown: in divisions, with ``page_no`` (-1 if unknown) and ``deep_link``.

    The page is that of the word that begins at the snippet's offset; all snippets meet their words in one join. ``docs`` has
    doc_ref and collections, by which ``links`` and ``default`` give the address.
    """
    place = pages_of_words(pages.select("rev", "page_no"), words, found.select("rev", F.col("start").alias("offset")).distinct()).select("rev", F.col("offset").alias("start"), F.col("page_no").alias("__page"))
    joined = found.drop("page_no").join(place, ["rev", "start"], "left").join(docs.select("doc_ref", "collections"), "doc_ref", "left")
    link = F.when(F.col("__page").isNotNull(), templated(F.col("doc_ref"), F.col("__page"), F.col("collections"), links, default))
    return joined.withColumns({"snippet": divisions(F.col("snippet"), division, newlines), "deep_link": link, "page_no": F.coalesce("__page", F.lit(-1))}).drop("__page", "collections")


def text_as_html(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows ``(doc_ref, html)``: the title, then a division for each page."""
    each = F.concat(F.lit('<div id="page'), F.col("page_no").cast("string"), F.lit('">'), F.replace("text", F.lit("\n"), F.lit("<br>")), F.lit("<hr></div>"))
    joined = pages.withColumn("part", each).groupBy("doc_ref").agg(F.sort_array(F.collect_list(F.struct("page_no", "part"))).alias("l"))
    title = F.coalesce(F.concat(F.lit("<h1>"), F.col("title"), F.lit("</h1>")), F.lit(""))
    return joined.join(docs.select("doc_ref", "title"), "doc_ref").select("doc_ref", F.concat(title, F.array_join(F.transform("l", lambda x: x["part"]), "")).alias("html"))


def plain_text(pages: DataFrame, whole_words: bool = False) -> DataFrame:
    """Rows ``(doc_ref, text)``: the pages joined by newlines; with ``whole_words`` those cut at line ends are joined again."""
    found = pages.groupBy("doc_ref").agg(F.sort_array(F.collect_list(F.struct("page_no", "text"))).alias("l")).select("doc_ref", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("text"))
    return found.withColumn("text", dehyphenated(F.col("text"))) if whole_words else found
