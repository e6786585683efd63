"""The distinct-word table, long texts and many segments against the tokenizers library."""

import collections
import random

import pytest

from quirespark.llm import bpe, packing, queries
from tests.llm.test_operators import D, odd_rows

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def tok():
    return tokenizers.Tokenizer.from_file(queries.WORD_BPE)


def test_word_table(spark, tok):
    """Each distinct word once, with the library's ids and their decoding, whatever the number of buckets."""
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").unionAll(spark.createDataFrame(odd_rows(), "doc_id long, text string"))
    words = {w.decode() for r in docs.collect() for w in (r.text or "").encode().split()}
    for buckets in (1, None):
        found = bpe.word_table(docs, queries.WORD_BPE, buckets=buckets).collect()
        assert len(found) == len(words) and {r.word for r in found} == words
        for r in found:
            assert r.ids == tok.encode(r.word, add_special_tokens=False).ids
            assert r.decoded == tok.decode(r.ids, skip_special_tokens=False)


def test_long_texts(spark, tok):
    """A text beyond a segment and a batch, and several segments in one partition."""
    r = random.Random(2)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(1, 12))) for _ in range(5000)]
    rows = [(i, " ".join(r.choice(words) for _ in range(200_000))) for i in range(5)] + [(9, " ".join(r.choice(words) for _ in range(1_500_000)))]
    assert len(rows[-1][1]) > 2 * bpe.SEGMENT_BYTES
    found = {x.doc_id: x for x in bpe.coded(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), queries.WORD_BPE).collect()}
    for i, text in rows:
        ids = tok.encode(text, add_special_tokens=False).ids
        assert found[i].ids == ids and found[i].decoded == tok.decode(ids, skip_special_tokens=False)


def test_long_packing(spark, tok):
    """A text beyond a batch becomes many pieces of a whole sequence each, and the rest fills up."""
    text = "some words of a long text " * 400_000
    rows = [(1, text), (2, None)] + [(i, "few words") for i in range(3, 60)]
    pieces = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), queries.WORD_BPE).collect()
    n = len(tok.encode("some words of a long text", add_special_tokens=False).ids) * 400_000 + 1
    own = sorted((r.piece, r.start, r.length) for r in pieces if r.doc_id == 1)
    assert [x[2] for x in own] == [4096] * (n // 4096) + [n % 4096] * (n % 4096 > 0) and [x[1] for x in own] == [4096 * i for i in range(len(own))]
    used = collections.Counter()
    for r in pieces:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 4096 and len(used) == -(-sum(used.values()) // 4096)


def test_other_order(spark, tok):
    """A list whose ids were made for another one, as when a scan's rows come in another order, is encoded anew."""
    dealt = bpe._dealt({b"one", b"two", b"three"}, 2)
    ids, decoded = bpe._table(dealt, {0: (1, b""), 1: (2, b"")}, queries.WORD_BPE)
    assert set(ids) == set(decoded) == {b"one", b"two", b"three"}
    for word in ids:
        own = tok.encode(word.decode(), add_special_tokens=False).ids
        assert ids[word] == b" ".join(b"%d" % i for i in own) and decoded[word].decode() == tok.decode(own, skip_special_tokens=False)


def test_clashing_columns(spark):
    table = spark.createDataFrame([(1, "a b", 2, "x"), (1, "a b", 2, "x"), (None, None, 3, "y")], "doc_id long, text string, n_tokens int, decoded string")
    assert collections.Counter((r.doc_id, r.n_tokens) for r in bpe.encode_decode(table, queries.WORD_BPE).collect()) == {(1, 2): 2, (None, 0): 1}
