"""Substring deduplication by sliding sentence spans.

A text is cut into sentences (after ``. ! ?`` and the like before white space, and at line ends). Where ``WINDOW`` words in a row
have no sentence's end, as in text without punctuation, the text is cut behind the one with the smallest hash, the last of
equal ones, and so for each such window. A window's cut depends on its own words only, so equal passages are cut alike wherever
they stand, but for at most ``WINDOW`` words at either edge: of a passage of 50 words, 20 or more in at least two whole pieces
are left. What the cuts leave are called sentences from here on.

A run of ``least_sentences`` and ``least_words`` or more is repeated if its sentences, lower-cased, stand at an earlier place too,
in the order of id, text hash and position; the sentences of every repeated run go, with the white space behind them, and the
first place stays. A longer run holds the shortest ones that begin or end at its sentences, and these cover all of it: those
from its first sentences forward, as far as they end inside, and the one that ends with its last. So only the shortest runs of
either direction are hashed, about one for each sentence and direction, and every sentence of any longer repeated run is found.
A span's hash is of its words alone, so it also meets a place where the same words are cut in another way.

Spans are counted globally by 64 bits of their hash; the few that occur again are compared by 128 bits. Null and empty texts have
no sentences and stay; a text of any length is taken whole. Rows with the same id and text are one document: they get the same
result. Null ids come first in the order. An empty table gives none. Other columns pass through, whatever their names;
``n_removed_sentences`` replaces a column of that name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quirespark.llm.common import arrow_schema, dropped, map_rows, slices, text_key, with_columns, written

LEAST_SENTENCES = 2
LEAST_WORDS = 20
#: Words of which one at least ends a piece: 50 less 2 of these at the edges leave ``LEAST_WORDS``, in two pieces or more.
WINDOW = 15
#: A word with the white space behind it, and one that ends a sentence; what such a one has last.
_WORD = re.compile(r"\S+\s*")
_ENDED = re.compile(r"[.!?…。！？][\"'”’»)\]]*\Z")
_LAST = frozenset(".!?…。！？\"'”’»)]")


def _cut(text: str) -> tuple[list[int], list[bytes]]:
    """The number of words up to the end of each sentence, and the lower-cased words."""
    words: list[str] = []
    ends = set()
    for line in text.lower().split("\n"):
        if words:
            ends.add(len(words))
        words += line.split()
    if not words:
        return [], []
    ends.update([i + 1 for i, w in enumerate(words) if w[-1] in _LAST and _ENDED.search(w)])
    low, n = " ".join(words).encode().split(b" "), len(words)
    stops = sorted(ends | {n})
    cuts, first = stops[:], 0
    for behind in stops:
        end = behind - (behind in ends)
        if end - first >= WINDOW:
            ranks = list(map(crc32, low[first:end]))
            last = -1
            for new in range(WINDOW - 1, end - first):
                # The last of equal ones; as long as it stays in the window only the word that came in can replace it.
                if last <= new - WINDOW:
                    window = ranks[new - WINDOW + 1 : new + 1]
                    window.reverse()
                    last = new - window.index(min(window))
                elif ranks[new] <= ranks[last]:
                    last = new
                else:
                    continue
                cuts.append(first + last + 1)
        first = behind
    return sorted(set(cuts)), low


def sentences(text: str) -> list[tuple[int, int]]:
    """``[start, end)`` of each sentence with its trailing white space; together they cover the text from its first word on."""
    cuts, _ = _cut(text)
    ends = [m.end() for m in _WORD.finditer(text)] if cuts else []
    starts = [len(text) - len(text.lstrip()), *(ends[c - 1] for c in cuts)]
    return list(zip(starts, starts[1:]))


def spans(text: str, least_sentences: int = LEAST_SENTENCES, least_words: int = LEAST_WORDS) -> tuple[list[tuple[int, int]], bytes]:
    """``(first sentence, the one behind the last)`` of every span, each once, and their hashes of 16 bytes, joined."""
    cuts, low = _cut(text)
    bounds = [0, *cuts]
    counts = [b - a for a, b in zip(bounds, cuts)]
    n = len(cuts)
    found = set()
    total, end = 0, 0
    for start in range(n):
        while end < n and (total < least_words or end - start < least_sentences):
            total += counts[end]
            end += 1
        if total < least_words or end - start < least_sentences:
            break
        found.add((start, end))
        total -= counts[start]
    total, start = 0, n
    for end in range(n, 0, -1):
        while start > 0 and (total < least_words or end - start < least_sentences):
            start -= 1
            total += counts[start]
        if total < least_words or end - start < least_sentences:
            break
        found.add((start, end))
        total -= counts[end - 1]
    digest = xxhash.xxh3_128_digest
    ordered = sorted(found)
    return ordered, b"".join([digest(b" ".join(low[bounds[a] : bounds[b]])) for a, b in ordered])


def occurrences(docs: DataFrame, key: str, text: str, least_sentences: int, least_words: int) -> DataFrame:
    """Rows ``(span, more, id, th, place)``: 64 and 64 bits of the hash; ``place`` is the first sentence above 32 bits of their number."""
    ddl = f"span long, more long, id {docs.schema[key].dataType.simpleString()}, th long, place long"
    schema = arrow_schema(ddl)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            counts, hashes, places = [], [], []
            for one in batch.column(2).to_pylist():
                own, digests = spans(one, least_sentences, least_words) if one else ((), b"")
                counts.append(len(own))
                hashes.append(digests)
                places += [a << 32 | b - a for a, b in own]
            row = pa.array(np.repeat(np.arange(len(counts)), counts))
            both = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), batch.column(0).take(row), batch.column(1).take(row), pa.array(places, pa.int64())], schema=schema)

    return map_rows(docs.select(F.col(key).alias("id"), text_key(text).alias("th"), F.col(text).cast("string").alias("text")), ddl, found)


def repeated(found: DataFrame) -> DataFrame:
    """Rows ``(id, th, places)``: the spans of a document that are not the first of their hash.

    Spans are counted first, combined before the exchange; only those that occur again meet their places. The tables joined are
    written to the shared folder, so that both sides are plain exchanges, which adaptive execution can split where a hot
    passage has many places; an aggregate in the join's own stage would forbid that.
    """
    spark = found.sparkSession
    again, again_path = written(found.groupBy("span").agg(F.count("*").alias("n")).where("n > 1").select("span"), "spans")
    met, met_path = written(found.join(again.hint("merge"), "span"), "met")
    first, first_path = written(met.groupBy("span", "more").agg(F.min(F.struct("id", "th", "place")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "first")
    later = met.join(first.hint("merge"), ["span", "more"]).where(~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("th") == F.col("first.th")) & (F.col("place") == F.col("first.place"))))
    places, _ = written(later.groupBy("id", "th").agg(F.collect_set("place").alias("places")), "places")
    dropped(spark, again_path, met_path, first_path)
    return places


def without(text: str, places: list[int]) -> tuple[str, int]:
    """The text without the sentences of the spans, and how many went."""
    cut = sentences(text)
    gone = set()
    for place in places:
        start = place >> 32
        gone.update(range(start, start + (place & 0xFFFFFFFF)))
    kept = [text[a:b] for i, (a, b) in enumerate(cut) if i not in gone]
    head = text[: cut[0][0]] if cut else ""
    return head + "".join(kept), len(gone)


def span_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", least_sentences: int = LEAST_SENTENCES, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with sentences of later repeated spans removed from ``text``, and ``n_removed_sentences`` (long) added."""
    again = repeated(occurrences(docs, key, text, least_sentences, least_words)).select(F.col("id").alias("__quire_id"), F.col("th").alias("__quire_th"), F.col("places").alias("__quire_places"))
    keyed = docs.withColumn("__quire_key", text_key(text))
    joined = keyed.join(again.hint("merge"), keyed[key].eqNullSafe(again["__quire_id"]) & (keyed["__quire_key"] == again["__quire_th"]), "left").select(*[F.col(f"`{c}`") for c in docs.columns], "__quire_places")
    names = docs.columns
    out = with_columns(docs.schema, text, "n_removed_sentences")
    schema = to_arrow_schema(out)

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = names.index(text)
        for batch in slices(batches, text):
            texts, removed = [], []
            for one, places in zip(batch.column(where).to_pylist(), batch.column(len(names)).to_pylist()):
                new, n = without(one, places) if places else (one, 0)
                texts.append(new)
                removed.append(n)
            made = {text: pa.array(texts, pa.string()), "n_removed_sentences": pa.array(removed, pa.int64())}
            yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else batch.column(names.index(f.name)) for f in schema], schema=schema)

    return map_rows(joined, out, applied)
