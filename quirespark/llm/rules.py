"""Quality rules as a short-circuit cascade.

Each rule looks at one document and says whether it fails, by features of the text, each computed once when it is first asked
for. What a feature and a rule cost and which rules reject which documents is measured on a bounded sample of rows. The cascade
is then built step by step: of the rules left, the one with the most rejections, among the documents that no earlier rule has
rejected, per second it adds, features that an earlier rule has computed being free. A document that fails leaves at once. The
order changes what is spent, never the verdict.

Null texts count as empty; an empty text has no words and fails ``too_few_words``. A text of any length is judged whole. Rules
of equal worth keep their order. Repeated rows each get their row; an empty table gives none. Columns of other names pass
through :func:`passing` untouched.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.llm.common import arrow_schema, bounded_batches, map_rows, slices, utf8

#: Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEAT_PERCENT = 30
SPACES = b" \t\n\x0b\x0c\r"

BASE_DDL = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


class Document:
    """A text and what rules ask about it; each feature is computed when it is first asked for, and kept."""

    def __init__(self, raw: bytes):
        self.raw = raw

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def word_chars(self) -> int:
        return len(b"".join(self.words).decode("utf-8", "replace"))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip(SPACES)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return int(repeat_words([self.words])[0])


#: Features with those they need, which stand before them.
FEATURES = {"words": (), "word_chars": ("words",), "n_symbols": (), "lines": (), "n_dup_lines": ("lines",), "n_repeat_words": ("words",)}


def repeat_words(texts: list[list[bytes]], window: int = WINDOW) -> np.ndarray:
    """For each text, how many of its words stand in a window of ``window`` (a power of two) words found twice or more in it.

    Words become numbers; the rank of a window is the rank of the pair of its halves, so equal ranks are equal windows.
    """
    seen: dict[bytes, int] = {}
    number = seen.setdefault
    counts = np.array([len(x) for x in texts], dtype=np.int64)
    total = int(counts.sum())
    if total <= window or not len(texts):
        return np.zeros(len(texts), dtype=np.int64)
    rank = np.fromiter((number(w, len(seen)) for words in texts for w in words), dtype=np.int64, count=total)
    half = 1
    while half < window:
        rank = np.unique(rank[:-half] * (int(rank.max()) + 1) + rank[half:], return_inverse=True)[1].reshape(-1)
        half *= 2
    owner = np.repeat(np.arange(len(texts)), counts)
    inside = owner[: len(rank)] == owner[window - 1 :]
    at = np.flatnonzero(inside)
    _, back, times = np.unique(owner[at] * (int(rank.max()) + 1) + rank[at], return_inverse=True, return_counts=True)
    twice = at[times[back.reshape(-1)] > 1]
    steps = np.zeros(total + 1, dtype=np.int64)
    np.add.at(steps, twice, 1)
    np.add.at(steps, twice + window, -1)
    covered = np.cumsum(steps[:-1]) > 0
    return np.bincount(owner[covered], minlength=len(texts)).astype(np.int64)


@dataclass(frozen=True)
class Rule:
    """``fails(document)`` is true if the rule rejects it; ``needs`` are the features it asks for."""

    name: str
    fails: Callable[[Document], bool]
    needs: tuple[str, ...] = ()


def too_few_words(d: Document) -> bool:
    return len(d.words) < LEAST_WORDS


def repeated_windows(d: Document) -> bool:
    return 100 * d.n_repeat_words > MOST_REPEAT_PERCENT * len(d.words)


def many_symbols(d: Document) -> bool:
    """More than one symbol to five words."""
    return 5 * d.n_symbols > len(d.words)


def odd_word_length(d: Document) -> bool:
    """Words of fewer than 2 or more than 15 characters on average."""
    n, chars = len(d.words), d.word_chars
    return chars < 2 * n or chars > 15 * n


def mostly_repeated_lines(d: Document) -> bool:
    """Over half of the lines equal an earlier one."""
    return 2 * d.n_dup_lines > len(d.lines)


def repeated_neighbours(d: Document) -> bool:
    """Over a fifth of the words equal the word before."""
    words = d.words
    return 5 * sum(a == b for a, b in zip(words, words[1:])) > len(words)


BASE_RULES = (Rule("too_few_words", too_few_words, ("words",)), Rule("repeated_windows", repeated_windows, ("words", "n_repeat_words")))
METHOD_RULES = (
    Rule("many_symbols", many_symbols, ("words", "n_symbols")),
    Rule("odd_word_length", odd_word_length, ("words", "word_chars")),
    Rule("mostly_repeated_lines", mostly_repeated_lines, ("lines", "n_dup_lines")),
    Rule("repeated_neighbours", repeated_neighbours, ("words",)),
)


@dataclass(frozen=True)
class Costs:
    """Seconds by feature and by rule, over all documents of a sample, and how many were rejected by each set of rules.

    A rule's own seconds are without its features. ``rejected`` has a bit for each rule of ``rules``, by its place.
    """

    rules: tuple[str, ...]
    seconds: dict[str, float]
    rejected: dict[int, int]


def measured(docs: DataFrame, rules: tuple[Rule, ...], sample_rows: int = 2000, text: str = "text", seed: int = 20) -> Costs:
    """What features and rules cost and reject on about ``sample_rows`` rows, never over twice as many.

    Rows are drawn by chance, whatever they hold, so a text that fills half the table fills half the sample. Only sums leave
    the executors: a row for each feature and rule, and one for each set of rules that reject the same documents.
    """
    n = docs.count()
    picked = docs.select(F.col(text).cast("string").alias("text"))
    if n > sample_rows:
        picked = picked.sample(False, min(1.0, sample_rows / n), seed).limit(2 * sample_rows)
    ddl = "what string, pattern long, n long, seconds double"
    schema = arrow_schema(ddl)

    def timed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            documents = [Document(x) for x in utf8(batch.column(0))]
            out = []
            for feature in FEATURES:
                began = time.perf_counter()
                for d in documents:
                    getattr(d, feature)
                out.append((feature, None, 0, time.perf_counter() - began))
            patterns = [0] * len(documents)
            for i, rule in enumerate(rules):
                began = time.perf_counter()
                failed = [rule.fails(d) for d in documents]
                out.append((rule.name, None, 0, time.perf_counter() - began))
                patterns = [p | bool(f) << i for p, f in zip(patterns, failed)]
            out += [(None, p, k, 0.0) for p, k in Counter(patterns).items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    rows = map_rows(picked, ddl, timed).groupBy("what", "pattern").agg(F.sum("n").alias("n"), F.sum("seconds").alias("s")).collect()
    return Costs(tuple(r.name for r in rules), {x["what"]: x["s"] for x in rows if x["what"]}, {x["pattern"]: x["n"] for x in rows if not x["what"]})


def ordered(rules: tuple[Rule, ...], costs: Costs, ready: tuple[str, ...] = ()) -> tuple[Rule, ...]:
    """The rules by rejection per cost, step by step; ``ready`` features cost nothing. Without a measurement they keep their order."""
    place = {name: i for i, name in enumerate(costs.rules)}
    left, done, have = list(rules), [], set(ready)
    standing = dict(costs.rejected)
    while left:
        def worth(rule: Rule) -> float:
            bit = 1 << place[rule.name] if rule.name in place else 0
            new = sum(n for p, n in standing.items() if p & bit)
            asked = {f for need in rule.needs for f in (*FEATURES.get(need, ()), need)} - have
            seconds = costs.seconds.get(rule.name, 0.0) + sum(costs.seconds.get(f, 0.0) for f in asked)
            return new / max(seconds, 1e-9)

        best = max(left, key=worth)
        left.remove(best)
        done.append(best)
        have |= {f for need in best.needs for f in (*FEATURES.get(need, ()), need)}
        standing = {p: n for p, n in standing.items() if best.name not in place or not p >> place[best.name] & 1}
    return tuple(done)


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + METHOD_RULES, sample_rows: int = 2000, text: str = "text", ready: tuple[str, ...] = ()) -> tuple[Rule, ...]:
    """The rules in the order to run them on ``docs``, where ``ready`` features are there before the first."""
    return ordered(rules, measured(docs, rules, sample_rows, text), ready)


def passing(docs: DataFrame, rules: tuple[Rule, ...], text: str = "text") -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns; the first rule that fails ends a row's cascade."""
    bounded_batches(docs.sparkSession)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            texts = utf8(batch.column(batch.schema.get_field_index(text)))
            keep = [not any(rule.fails(d) for rule in rules) for d in map(Document, texts)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)


def scored(docs: DataFrame, rules: tuple[Rule, ...], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, the base counts, ``base_failed`` and ``kept``. ``rules`` judge what the base rules pass, in their order."""
    bounded_batches(docs.sparkSession)
    ddl = f"{key} {docs.schema[key].dataType.simpleString()}, {BASE_DDL}, kept boolean"
    schema = arrow_schema(ddl)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids, documents = batch.column(0), [Document(x) for x in utf8(batch.column(1))]
            repeats = repeat_words([d.words for d in documents])
            rows = []
            for d, repeat in zip(documents, repeats.tolist()):
                d.n_repeat_words = repeat
                failed = too_few_words(d) or repeated_windows(d)
                rows.append((len(d.words), d.word_chars, d.n_symbols, d.n_dup_lines, repeat, failed, not failed and not any(rule.fails(d) for rule in rules)))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(zip(*rows), schema.types[1:]))], schema=schema)

    return docs.select(key, F.col(text).cast("string").alias("text")).mapInArrow(judged, ddl)


def quality_scores(docs: DataFrame, sample_rows: int = 2000) -> DataFrame:
    """The base counts and the cascade's verdict for every row of ``docs (doc_id, text)``."""
    # The base counts are part of the result, so their features are there when the rules are run.
    return scored(docs, cascade(docs, METHOD_RULES, sample_rows, ready=tuple(FEATURES)))
