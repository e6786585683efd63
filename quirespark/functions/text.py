"""Text functions as Column expressions, and the analysis of a text into tokens."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quirespark.languages import PLAIN, Language, folded, same

#: A run of letters, marks and digits; every other character that is no white space, symbols included, is punctuation.
WORD = r"([\p{L}\p{M}\p{N}]+)"
#: Symbols count as words though they are punctuation.
SYMBOLS = frozenset("=+$%€°£#<>")
_RUN = regex.compile(r"\S+")
_NEWLINE = regex.compile("\n")
#: Postings that a task gives on at once.
BATCH_ROWS = 50_000
_PUNCTUATION = regex.compile(r"[\p{P}\p{S}]+")


def terms(text: Column) -> Column:
    """The lower-cased words of a text, in order: an array whose index is the position."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 1)


def keyword(value: Column) -> Column:
    """A keyword field's value for comparison: lower case, Latin accents gone, white space single."""
    accented, plain = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ–—‐‑", "aaaaaaceeeeiiiinooooouuuuyy----"
    return F.trim(F.regexp_replace(F.translate(F.lower(value), accented, plain), r"\s+", " "))


def keyword_text(value: str) -> str:
    """What :func:`keyword` gives, for one value."""
    accented, plain = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ–—‐‑", "aaaaaaceeeeiiiinooooouuuuyy----"
    return regex.sub(r"\s+", " ", value.lower().translate(str.maketrans(accented, plain))).strip(" ")


def year(raw: Column) -> Column:
    """The digits of a date: four are the year, three stand for a decade, others give null."""
    digits = F.regexp_replace(raw, "[^0-9]", "")
    return F.when(F.length(digits) == 4, digits.cast("int")).when(F.length(digits) == 3, F.concat(digits, F.lit("0")).cast("int"))


def templated(ref: Column, page: Column, collections: Column, by_collection: list[tuple[str, str]], default: str | None, other: Column | None = None) -> Column:
    """The URL template of the first listed collection that the document has, else the default, else ``other``."""
    chosen = F.lit(default).cast("string")
    for name, template in reversed(by_collection):
        chosen = F.when(F.array_contains(collections, name), F.lit(template)).otherwise(chosen)
    filled = F.replace(F.replace(chosen, F.lit("${REF}"), ref), F.lit("${PAGE}"), page.cast("string"))
    return filled if other is None else F.coalesce(filled, other)


def hyphens(text: Column) -> Column:
    """How many hyphens a text has."""
    return F.length(text) - F.length(F.regexp_replace(text, "[-־⸗]", ""))


def hard_hyphen(first: Column, second: Column, joined: Column) -> Column:
    """Whether the hyphen between two halves belongs to the word: the joined word has more than its parts."""
    return hyphens(joined) > hyphens(F.regexp_replace(first, "[-־⸗]$", "")) + hyphens(second)


def dehyphenated(text: Column) -> Column:
    """Words cut at line ends joined again."""
    return F.regexp_replace(text, "[-־⸗]\\n", "")


@dataclass(slots=True)
class Token:
    """``increment`` 0 stands at the position of the token before: punctuation, spelling variants."""

    term: str
    start: int
    end: int
    kind: str = "word"
    increment: int = 1


def cut(text: str, language: Language = PLAIN) -> Iterator[tuple[str, int, int]]:
    """Words between white space, cut by the language's patterns; what stands before a match is a piece of its own."""
    pattern = regex.compile("|".join(f"(?:{p})" for p in language.tokens)) if language.tokens else None
    for word in regex.finditer(r"\S+", text):
        at, end = word.span()
        piece = word[0]
        while piece:
            found = pattern.search(piece) if pattern else None
            if not found or found.end() == 0:
                yield piece, at, end
                break
            if found.start():
                yield piece[: found.start()], at, at + found.start()
            yield found[0], at + found.start(), at + found.end()
            at += found.end()
            piece = piece[found.end() :]


def is_punctuation(term: str) -> bool:
    return bool(_PUNCTUATION.fullmatch(term)) and not (set(term) & SYMBOLS)


class Analyser:
    """Words to terms by a language; what a word gives is remembered, up to ``most`` words."""

    def __init__(self, language: Language = PLAIN, fold: bool = False, most: int = 200_000):
        self.language, self.fold, self.most = language, fold, most
        self.known: dict[str, list[tuple[str, int, int, str, bool]]] = {}

    def term(self, piece: str) -> tuple[str, bool]:
        shown = self.language.normalised(piece)
        term = self.language.term_filter(folded(shown) if self.fold else shown.lower())
        return term, is_punctuation(term)

    def word(self, text: str) -> list[tuple[str, int, int, str, bool]]:
        """``(piece, start, end, term, punctuation)`` of a run without white space."""
        found = self.known.get(text)
        if found is None:
            if len(self.known) >= self.most:
                self.known.clear()
            found = self.known[text] = [(piece, a, b, *self.term(piece)) for piece, a, b in cut(text, self.language)]
        return found

    def tokens(self, text: str, hyphenated: Iterable[int] = (), alternatives: dict[int, tuple[str, ...]] | None = None) -> list[Token]:
        variants, halves = alternatives or {}, set(hyphenated)
        raw = [(piece, at + a, at + b, term, p) for m in _RUN.finditer(text) for at in (m.start(),) for piece, a, b, term, p in self.word(m[0])]
        out: list[Token] = []
        i = 0
        while i < len(raw):
            piece, start, end, term, punctuation = raw[i]
            if start in halves and i + 2 < len(raw):
                piece, end = piece + raw[i + 2][0], raw[i + 2][2]
                term, punctuation = self.term(piece)
                i += 2
            if term:
                out.append(Token(term, start, end, "punct" if punctuation else "word", 0 if punctuation and out else 1))
                seen = {term}
                for other in variants.get(start, ()):
                    spelt = self.language.normalised(other.lower())
                    if spelt and spelt not in seen:
                        seen.add(spelt)
                        out.append(Token(spelt, start, end, "alt", 0))
            i += 1
        return out


def analysed(text: str, language: Language = PLAIN, hyphenated: Iterable[int] = (), alternatives: dict[int, tuple[str, ...]] | None = None, fold: bool = False) -> list[Token]:
    """The index side: cut, normalised, lower-cased, halves of hyphenated words joined, variants added, no token twice."""
    return Analyser(language, fold).tokens(text, hyphenated, alternatives)


def searched(text: str, language: Language = PLAIN, gaps: bool = False) -> list[tuple[str, int]]:
    """The query side: ``(term, increment)`` without punctuation; with ``gaps`` a lone ``*`` widens the next increment."""
    out: list[tuple[str, int]] = []
    waiting = 1
    for piece, _, _ in cut(language.normalised(language.decompose(text)), language):
        if gaps and piece == "*":
            waiting += 1
            continue
        term = language.term_filter(piece.lower())
        if not term or is_punctuation(term):
            continue
        out.append((term, waiting))
        waiting = 1
    return out


def with_alternatives(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``words`` (content, ...) with ``alternatives``: the other spellings that ``lexicon`` (word, other) has of each, by an equality join."""
    known = lexicon.groupBy(F.lower("word").alias("__word")).agg(F.sort_array(F.collect_set("other")).alias("alternatives"))
    joined = words.join(known, F.lower("content") == F.col("__word"), "left")
    return joined.withColumn("alternatives", F.coalesce("alternatives", F.array().cast("array<string>"))).drop("__word")


def simplified(docs: DataFrame, language: Language, text: str = "text") -> DataFrame:
    """``docs`` with the language's simpler spelling of ``text``; a language without one leaves the plan as it is."""
    if language.simplify is same:
        return docs
    simplify = language.simplify

    @F.pandas_udf("string")
    def simple(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else simplify(x))

    return docs.withColumn(text, simple(text))


def broken(word: str) -> list[str]:
    """A word cut at its punctuation; the quotes of an abbreviation and the points of a number stay with their neighbours."""
    parts = regex.findall(r"\p{P}|[^\p{P}]+", word)
    if len(parts) < 2:
        return [word]
    out: list[str] = []
    glued = False
    for i, part in enumerate(parts):
        around = (parts[i - 1] if i else "") + part + (parts[i + 1] if i + 1 < len(parts) else "")
        inner = bool(out) and bool(regex.fullmatch("[‛“'\"’]", part) and regex.fullmatch(r"\w+[‛“'\"’]\w+", around) or part == "." and regex.fullmatch(r"\d+\.\d+", around))
        if out and (inner or glued):
            out[-1] += part
        else:
            out.append(part)
        glued = inner
    return out


TOKEN_DDL = "doc_ref string, field string, term string, kind string, position int, start int, end int, page_no int, row_no int"


def token_table(docs: DataFrame, language: Language = PLAIN, fields: tuple[tuple[str, str, bool], ...] = (("Text", "text", False),)) -> DataFrame:
    """Postings of ``docs``, one pass over each document and no exchange.

    ``fields`` lists (field, column, folded). Optional columns ``page_offsets`` and ``hyphenated`` (array<int>) and
    ``alternatives`` (map<int, array<string>>) apply to the field Text. Rows are lines of the text.
    """
    own = [c for c in ("page_offsets", "hyphenated", "alternatives") if c in docs.columns]
    schema = to_arrow_schema(StructType.fromDDL(TOKEN_DDL))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        analysers = {fold: Analyser(language, fold) for _, _, fold in fields}
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), schema.types)], schema=schema)

        for batch in batches:
            columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                ref = columns["doc_ref"][i].as_py()
                for name, column, fold in fields:
                    text = columns[column][i].as_py()
                    if not text:
                        continue
                    told = {c: columns[c][i].as_py() for c in own} if name == "Text" else {}
                    lines = [0, *(m.end() for m in _NEWLINE.finditer(text))]
                    pages = sorted(set(told.get("page_offsets") or [0]))
                    position = -1
                    for t in analysers[fold].tokens(text, told.get("hyphenated") or (), dict(told.get("alternatives") or ())):
                        position += t.increment
                        rows.append((ref, name, t.term, t.kind, position, t.start, t.end, max(0, bisect_right(pages, t.start) - 1), bisect_right(lines, t.start) - 1))
                        if len(rows) >= BATCH_ROWS:
                            yield out()
                            rows.clear()
        if rows:
            yield out()

    return docs.select("doc_ref", *dict.fromkeys(c for _, c, _ in fields), *own).mapInArrow(made, TOKEN_DDL)
