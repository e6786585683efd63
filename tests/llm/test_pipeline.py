"""The pipeline's stages, one by one and together."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from quirespark.llm import queries, simhash
from tests.llm.test_operators import D

LONG = " ".join(f"word{i}" for i in range(60))
LINES = "\n".join(" ".join(f"l{k}w{i}" for i in range(9)) for k in range(5))
CLASHING = "n_lines int, n_deleted_lines string, n_removed_sentences int, fp string, th int, node string, root int, id string, text_ string, runs string, places int, hits int"


def odd(spark, rows):
    """Rows with columns named like those that the operators use inside."""
    filled = [(i, t, "en", "s", len(t or ""), 1, "a", 2, "b", 3, "c", 4, "d", "e", "f", 5, 6) for i, t in rows]
    return spark.createDataFrame(filled, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}")


def test_pipeline(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, ids = docs.columns, None
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, D)
        assert docs.columns == columns, name
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids is None or now <= ids
        ids = now
        docs, _ = cp.written(docs, name)
    pieces = cp.STAGES[-1][1](spark, docs, D)
    assert {r.doc_id for r in pieces.collect()} == ids
    assert cp.run(spark, D).count() == pieces.count()


@pytest.mark.parametrize("name,stage", cp.STAGES)
def test_empty_and_odd(spark, name, stage):
    """Nulls, empty texts, ties, repeated rows, clashing names and an empty table: no stage fails, and columns stay as they are."""
    assert stage(spark, odd(spark, []), D).count() == 0
    rows = [(None, None), (None, LONG), (None, LINES), (1, None), (2, ""), (3, "  "), (4, LONG), (4, LONG), (5, LONG), (5, LINES), (6, LINES + " end"), (7, "few words"), (8, LONG + " " + LONG + " other"), (9, "x " * 60_000)]
    docs = odd(spark, rows)
    found = stage(spark, docs, D)
    got = found.collect()
    if name == "best_fit_packing":
        assert collections.Counter(r.doc_id for r in got if r.piece == 0) == collections.Counter(i for i, _ in rows)
        return
    assert found.columns == docs.columns and [f.dataType for f in found.schema] == [f.dataType for f in docs.schema]
    assert all(tuple(r)[5:] == tuple(docs.first())[5:] and r.lang == "en" for r in got)
    kept = collections.Counter((r.doc_id, r.text) for r in got)
    if name == "quality_rules":
        assert kept == collections.Counter([(None, LONG), (None, LINES), (4, LONG), (4, LONG), (5, LONG), (5, LINES), (6, LINES + " end")])
    if name == "line_winnowing":
        # Null ids come first; their runs stay, all later ones go, and with them the documents that had no others.
        assert kept == collections.Counter([(None, None), (None, LONG), (None, LINES), (1, None), (2, ""), (3, "  "), (6, LINES.split("\n")[-1] + " end"), (7, "few words"), (8, rows[12][1]), (9, rows[13][1])])
    if name == "simhash_near_duplicates":
        assert kept == collections.Counter([(1, None), (4, LONG), (5, LINES), (7, "few words"), (9, rows[13][1])])
    if name == "sentence_spans":
        assert kept[(1, None)] == 1 and kept[(None, LONG)] == 1 and kept[(None, LINES)] == 1 and (4, LONG) not in kept and (5, LINES) not in kept


def test_similar_recall_larger(spark):
    """Of all pairs at 0.8 or more in a table of thousands, found by a prefix filter and counted, none but a few are apart."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").unionAll(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 4000").select("text"))
    table = docs.select(simhash._node("text").alias("node"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["node"])
    sets = {r.node: frozenset(simhash.shingle_hashes(r.text.encode(), 5)) for r in table.collect()}
    often = collections.Counter(x for s in sets.values() for x in s)
    held, near = collections.defaultdict(list), []
    for node, s in sets.items():
        rarest = sorted(s, key=lambda x: (often[x], x))[: len(s) - -(-4 * len(s) // 5) + 1]
        met = {other for x in rarest for other in held[x]}
        near += [(node, other) for other in met if len(s & sets[other]) >= 0.8 * len(s | sets[other])]
        for x in rarest:
            held[x].append(node)
    classes = {r.node: r.root for r in simhash.similar_classes(docs).collect()}
    joined = sum(a in classes and classes[a] == classes.get(b) for a, b in near)
    assert len(near) >= 10 and joined >= 0.95 * len(near)
