"""Toxicity by non-negative positive-unlabelled learning.

Positives are documents confirmed toxic; all other text is unlabelled, toxic or not. With class prior p, loss l and score g
the risk is p E_P[l(g)] + max(0, E_U[l(-g)] - p E_P[l(-g)]): the unlabelled part, less what its toxic share must add, is
kept from falling below zero, and where it does the step goes the other way. The scorer is linear over the presence of words
and of beginnings of words, chosen by how much likelier they are in positives than in the unlabelled text less its toxic
share; it is trained in numpy by full-batch Adam.

Bounds, all parameters: at most ``most_positive`` documents and about ``most_unlabelled`` train the scorer, chosen by a hash of
their id, of their id and text; ``most_features`` features are kept. A repeated row, or a repeated id of a positive, trains once.
Every document is scored, over its whole text, however long.

Null and empty texts have no features and get the score of the bias. Without positives or unlabelled text every score is 0.
Label rows with null ids or labels are not used; of repeated label rows the largest label counts; features of equal worth go by
name. Repeated documents each get their row; an empty table gives none. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirespark.llm.common import arrow_schema, map_rows, slices

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (3, 4, 5, 6)
THRESHOLD = 0.7


def word_features(word: str) -> tuple[str, ...]:
    """The word, and its beginnings of some lengths."""
    return ("=" + word, *(word[:n] for n in PREFIXES if len(word) >= n))


def text_features(text: str) -> set[str]:
    return {f for w in set(WORD.findall(text.lower())) for f in word_features(w)}


@dataclass(frozen=True)
class Model:
    """Weights by feature, and the bias; ``score`` is a probability."""

    weights: dict[str, float]
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        known: dict[str, tuple[tuple[str, float], ...]] = {}
        weights = self.weights
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            found: dict[str, float] = {}
            for word in set(WORD.findall(text.lower())):
                own = known.get(word)
                if own is None:
                    own = known[word] = tuple((f, weights[f]) for f in word_features(word) if f in weights)
                    if len(known) > 400_000:
                        known.clear()
                if own:
                    found.update(own)
            out[i] = self.bias + sum(sorted(found.values()))
        return 1 / (1 + np.exp(-np.clip(out, -60, 60)))


def fold(key: Column) -> Column:
    """crc32 of the id as text, modulo 3; a row of fold 1 is held out."""
    return F.crc32(key.cast("string").cast("binary")) % 3


@dataclass(frozen=True)
class Sample:
    """Documents as lists of feature numbers, joined: ``feature`` by ``owner``; ``positive`` marks the confirmed ones."""

    owner: np.ndarray
    feature: np.ndarray
    positive: np.ndarray
    n_features: int

    @classmethod
    def of(cls, rows: list[np.ndarray], positive: np.ndarray, n_features: int) -> Sample:
        sizes = np.array([len(r) for r in rows])
        feature = np.concatenate(rows).astype(np.int64) if sizes.sum() else np.empty(0, np.int64)
        return cls(np.repeat(np.arange(len(rows)), sizes), feature, positive, n_features)


def risk(sample: Sample, w: np.ndarray, b: float, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The parts of the risk, ``p E_P[l(g)]`` and ``E_U[l(-g)] - p E_P[l(-g)]``, and the slope of each by the documents' scores.

    The loss of a score g against label 1 is softplus(-g), which is softplus(g) - g, and against -1 softplus(g).
    """
    p, u = sample.positive, ~sample.positive
    g = np.bincount(sample.owner, w[sample.feature], len(p)) + b
    s = 1 / (1 + np.exp(-np.clip(g, -60, 60)))
    loss = np.logaddexp(0, g)
    first, second = prior * (loss[p] - g[p]).mean(), loss[u].mean() - prior * loss[p].mean()
    rise, fall = np.zeros(len(p)), np.zeros(len(p))
    rise[p] = prior * (s[p] - 1) / p.sum()
    fall[p], fall[u] = -prior * s[p] / p.sum(), s[u] / u.sum()
    return float(first), float(second), rise, fall


def by_weight(sample: Sample, slope: np.ndarray) -> np.ndarray:
    """The slope by each weight and the bias, from that by the documents' scores."""
    return np.append(np.bincount(sample.feature, slope[sample.owner], sample.n_features), slope.sum())


def nnpu(rows: list[np.ndarray], positive: np.ndarray, n_features: int, prior: float, rounds: int = 400, rate: float = 0.05, decay: float = 1e-4, beta: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights and bias that make the non-negative risk small. ``rows`` has each document's features by number.

    Where the second part falls below ``-beta`` the step goes against it, so that it does not stay negative.
    """
    sample = Sample.of(rows, positive, n_features)
    w, b = np.zeros(n_features), -1.0
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for t in range(1, rounds + 1):
        _, second, rise, fall = risk(sample, w, b, prior)
        grad = by_weight(sample, rise + fall if second >= -beta else -fall) + np.append(decay * w, 0.0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def _marked(docs: DataFrame, text: str) -> DataFrame:
    """Rows ``(positive, features)`` of the training documents; only features leave the task."""
    schema = arrow_schema("positive boolean, features array<string>")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [sorted(text_features(x or "")) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, schema.types[1])], schema=schema)

    return map_rows(docs.select("positive", F.col(text).cast("string").alias("text")), "positive boolean, features array<string>", made)


def chosen_features(positive: dict[str, int], other: dict[str, int], n_positive: int, n_other: int, prior: float, most: int) -> list[str]:
    """The features that are likelier in positives than in the unlabelled text less its toxic share, the clearest first."""
    scored = []
    for f, n in positive.items():
        p = n / n_positive
        rest = max(0.0, other.get(f, 0) / n_other - prior * p) / (1 - prior)
        gain = p * np.log((p + 1 / n_positive) / (rest + 1 / n_other)) if p > rest else 0.0
        if gain > 0:
            scored.append((-gain, f))
    return [f for _, f in sorted(scored)[:most]]


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most_positive: int = 3000, most_unlabelled: int = 9000, most_features: int = 4000, least_documents: int = 4) -> Model:
    """Train on the rows whose fold is not 1. The class prior is the share of positives among all their labels."""
    usable = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & (fold(F.col(key)) != 1)).groupBy(key).agg(F.max(label).alias("label"))
    told = usable.agg(F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("p"), F.count("*").alias("n")).first()
    total = docs.count()
    if not told["p"] or not total:
        return Model({}, -60.0)
    prior = min(0.9, max(told["p"], 1) / told["n"])
    # At most ``most_positive`` ids, so the broadcast has a bound; one row of each, so the sample has it too.
    ids = usable.where("label = 1").orderBy(F.xxhash64(key), key).limit(most_positive).select(F.col(key).alias("__quire_id"))
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).where(F.coalesce(fold(F.col("id")) != 1, F.lit(True)))
    named = rows.join(F.broadcast(ids), rows["id"] == ids["__quire_id"], "left_semi").groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    positives = named.select(F.lit(True).alias("positive"), "text")
    share = min(1.0, 1.5 * most_unlabelled / total)
    drawn = rows.where(F.pmod(F.xxhash64("id", "text", F.lit("unlabelled")), F.lit(1 << 30)) < int(share * (1 << 30))).dropDuplicates(["id", "text"])
    unlabelled = drawn.select(F.lit(False).alias("positive"), "text")
    # Counting first leaves only features with enough positives; both tables are of the bounded sample.
    marked = _marked(positives.unionAll(unlabelled), "text").cache()
    sizes = {r["positive"]: r["n"] for r in marked.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(True) or not sizes.get(False):
        marked.unpersist()
        return Model({}, -60.0)
    each = marked.select("positive", F.explode("features").alias("f")).groupBy("f").agg(F.sum(F.col("positive").cast("int")).alias("p"), F.sum((~F.col("positive")).cast("int")).alias("u"))
    spread = F.col("p") / sizes[True] - F.col("u") / sizes[False] * 1.0
    best = each.where(F.col("p") >= least_documents).orderBy(F.desc(spread / F.sqrt(F.col("p") / sizes[True] + F.col("u") / sizes[False])), "f").limit(4 * most_features).collect()
    names = chosen_features({r["f"]: r["p"] for r in best}, {r["f"]: r["u"] for r in best}, sizes[True], sizes[False], prior, most_features)
    number = {f: i for i, f in enumerate(names)}
    if not number:
        marked.unpersist()
        return Model({}, -60.0)
    schema = arrow_schema("positive boolean, own array<int>")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [[number[f] for f in x if f in number] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, schema.types[1])], schema=schema)

    sample = marked.mapInArrow(numbered, "positive boolean, own array<int>").collect()
    marked.unpersist()
    sample.sort(key=lambda r: (r["positive"], r["own"]))
    w, b = nnpu([np.array(r["own"], np.int64) for r in sample], np.array([r["positive"] for r in sample]), len(names), prior)
    return Model(dict(zip(names, w.tolist())), b)


def scored(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: key, ``held_out`` (false for a null key), ``score`` and ``predicted`` (1 from ``threshold`` on)."""
    ddl = f"{key} {docs.schema[key].dataType.simpleString()}, held_out boolean, score double, predicted int"
    schema = arrow_schema(ddl)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            score = model.scores([x or "" for x in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], schema=schema)

    return map_rows(docs.select(key, F.coalesce(fold(F.col(key)) == 1, F.lit(False)).alias("held_out"), F.col(text).cast("string").alias("text")), ddl, made)
