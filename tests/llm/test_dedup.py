"""Line and span deduplication against brute force that shares nothing with the operators but the definition."""

import collections
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quirespark.llm import linededup, spans
from quirespark.llm.common import text_key
from tests.llm.test_operators import odd_rows

D = "/root/testdata/sf0.001"


def in_order(spark, rows):
    """The distinct (id, text), in the operators' order: null ids first, then by id and the text's hash."""
    distinct = {(i, t or "") for i, t in rows}
    hashes = {r.text: r.h for r in spark.createDataFrame([(t,) for t in {t for _, t in distinct}], "text string").select("text", text_key().alias("h")).collect()}
    return sorted(distinct, key=lambda d: (d[0] is not None, d[0] or 0, hashes[d[1]]))


def later_runs(docs, long_enough):
    """Places of ``docs`` (a list of sequences) that some run, long enough, covers which also begins at an earlier place. All runs."""
    first, gone = {}, [set() for _ in docs]
    for d, units in enumerate(docs):
        for a in range(len(units)):
            for b in range(a + 1, len(units) + 1):
                if long_enough(units[a:b]):
                    run = tuple(units[a:b])
                    if first.setdefault(run, (d, a)) != (d, a):
                        gone[d].update(range(a, b))
    return gone


def brute_lines(spark, rows, least=3, least_words=20):
    docs = in_order(spark, rows)
    lines = [[x.strip(" \t\n\x0b\x0c\r") for x in t.split("\n")] for _, t in docs]
    shown = [[x for x in own if x] for own in lines]
    gone = later_runs(shown, lambda run: len(run) >= least or sum(len(re.findall("[^\x20\x09-\x0d]+", x)) for x in run) >= least_words)
    out = {}
    for doc, own, lost in zip(docs, lines, gone):
        numbers, number = [], 0
        for x in own:
            numbers.append(number if x else None)
            number += bool(x)
        kept = []
        for i, (raw, n) in enumerate(zip(doc[1].split("\n"), numbers)):
            if n is None:
                before = next((k for k in reversed(numbers[:i]) if k is not None), None)
                after = next((k for k in numbers[i:] if k is not None), None)
                if before in lost and after in lost:
                    continue
            elif n in lost:
                continue
            kept.append(raw)
        out[doc] = ("\n".join(kept), len(lost))
    return out


def check_lines(spark, rows):
    table = spark.createDataFrame([(i, t, "keep") for i, t in rows], "doc_id long, text string, n_lines string")
    found = linededup.line_dedup(table).collect()
    expected = brute_lines(spark, rows)
    assert len(found) == len(rows)
    assert collections.Counter((r.doc_id, r.text or "", r.n_deleted_lines) for r in found) == collections.Counter((i, *expected[(i, t or "")]) for i, t in rows)


def test_lines_random(spark):
    """Random texts of few different lines, short and long, with blank lines, copies and null ids."""
    r = random.Random(6)
    lines = [f"line {i}" for i in range(9)] + [" ".join(f"w{i}{k}" for k in range(n)) for i, n in enumerate((9, 12, 19, 20, 30))] + [""]
    rows = []
    for i in range(300):
        some = r.sample(lines, r.randrange(2, 8))
        rows.append((i if i % 9 else None, "\n".join(r.choice([" ", ""]) + r.choice(some) for _ in range(r.randrange(0, 9)))))
    rows += [rows[5], rows[6]] + odd_rows()
    check_lines(spark, rows)


def test_lines_lost_runs(spark):
    """A third document with the first two lines only does not hide a run of three; touching runs of different sources stay."""
    check_lines(spark, [(1, "p\nq\nr"), (2, "a\nb\nz"), (3, "x\na\nb\nc\ny"), (4, "u\na\nb\nc\nv")])
    rows = [(1, "A\nB"), (2, "C\nD"), (3, "A\nB\nC\nD")]
    assert {x.doc_id: x.text for x in linededup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == dict(rows)
    first = "intro a\nb\nc\nd\ne"
    pair = spark.createDataFrame([(1, first), (2, "own\nb\nc\nd\nown too"), (3, "b\nc")], "doc_id long, text string")
    assert {x.doc_id: x.text for x in linededup.line_dedup(pair).collect()} == {1: first, 2: "own\nown too", 3: "b\nc"}


def test_lines_words(spark):
    """Repeated runs of one or two lines go when they have 20 words; shorter ones stay."""
    long, half, rest = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("a", 20), ("b", 12), ("c", 8)))
    short = " ".join(f"d{i}" for i in range(19))
    rows = [(1, f"one\n{long}\ntwo\n{half}\n\n{rest}\nthree\n{short}"), (2, f"x\n {long}\ny"), (3, f"x2\n{half}\n{rest}\ny2"), (4, f"x3\n{short}\ny3"), (5, f"x4\n{half}\ny4"), (6, long), (7, f"x5\n{long}\ntwo\ny5")]
    found = {x.doc_id: (x.text, x.n_deleted_lines) for x in linededup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: (rows[0][1], 0), 2: ("x\ny", 1), 3: ("x2\ny2", 2), 4: (rows[3][1], 0), 5: (rows[4][1], 0), 6: ("", 1), 7: ("x5\ny5", 2)}


@pytest.mark.parametrize("gram,window", [(1, 1), (2, 2), (2, 4), (3, 3)])
def test_fingerprints(gram, window):
    """Each run of ``gram + window - 1`` lines belongs to one fingerprint, a gram inside it, the same wherever the run stands."""
    r = random.Random(7)
    owners = {}
    for _ in range(200):
        marks = [bytes([r.randrange(4)]) * 16 for _ in range(r.randrange(0, 14))]
        least, seen = gram + window - 1, []
        for g, first, runs in linededup.fingerprints(marks, gram, window):
            for i in range(len(runs) // 16):
                run = tuple(marks[first + i : first + i + least])
                assert len(run) == least and runs[16 * i : 16 * i + 16] == linededup._digest(b"".join(run))
                assert g in {linededup._digest(b"".join(run[j : j + gram])) for j in range(window)}
                assert owners.setdefault(run, g) == g
                seen.append(first + i)
        assert seen == list(range(max(0, len(marks) - least + 1)))


def brute_cut(text, window=15):
    """The pieces by their definition: word by word, each window without a sentence's end by itself."""
    at = len(text) - len(text.lstrip())
    words = [(m.start(), m.end()) for m in re.finditer(r"\S+\s*", text[at:])]
    words = [(a + at, b + at) for a, b in words]
    ends = set()
    for i, (a, b) in enumerate(words):
        word = text[a:b].rstrip()
        if re.search("[.!?…。！？][\"'”’»)\\]]*$", word) or "\n" in text[a + len(word) : b]:
            ends.add(i)
    cuts = set(ends)
    for i in range(len(words) - window + 1):
        if not any(j in ends for j in range(i, i + window)):
            ranks = [zlib.crc32(text[words[j][0] : words[j][1]].rstrip().lower().encode()) for j in range(i, i + window)]
            cuts.add(i + max(j for j in range(window) if ranks[j] == min(ranks)))
    out, start = [], 0
    for i in sorted(cuts | {len(words) - 1} if words else []):
        if i >= start:
            out.append((words[start][0], words[i][1]))
            start = i + 1
    return out


def brute_spans(spark, rows, whole, least_sentences=2, least_words=20):
    """Numbers of the sentences that go, by (id, text): runs are compared as sequences of sentences if ``whole``, else of words."""
    docs = in_order(spark, rows)
    first, out = {}, {}
    for i, t in docs:
        words = [tuple(t[a:b].lower().split()) for a, b in brute_cut(t)]
        out[(i, t)] = gone = set()
        for a in range(len(words)):
            for b in range(a + least_sentences, len(words) + 1):
                flat = tuple(w for x in words[a:b] for w in x)
                run = tuple(words[a:b]) if whole else flat
                if len(flat) >= least_words and first.setdefault(run, (i, t, a)) != (i, t, a):
                    gone.update(range(a, b))
    return out


def check_spans(spark, rows):
    """All that all repeated runs of sentences cover goes, and nothing but what repeated runs of words cover."""
    table = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_removed_sentences string")
    found = collections.Counter((x.doc_id, x.text or "", x.n_removed_sentences) for x in spans.span_dedup(table).collect())
    least, most = brute_spans(spark, rows, True), brute_spans(spark, rows, False)
    same = 0
    for (i, t), n in collections.Counter((i, t or "") for i, t in rows).items():
        cut = brute_cut(t)
        head = t[: cut[0][0]] if cut else t
        sure, maybe = least[(i, t)], sorted(most[(i, t)] - least[(i, t)])
        assert sure <= most[(i, t)] and len(maybe) <= 12
        same += not maybe
        possible = (sure | {x for k, x in enumerate(maybe) if bits >> k & 1} for bits in range(1 << len(maybe)))
        assert any(found[(i, head + "".join(t[a:b] for k, (a, b) in enumerate(cut) if k not in gone), len(gone))] >= n for gone in possible), (i, t)
    assert sum(found.values()) == len(rows) and same > 0.9 * len(rows)


def test_cuts():
    r = random.Random(9)
    for _ in range(300):
        text = "".join(r.choice(["a", "bc", " ", " ", ".", "\n", "! ", "d, ", "e f g h i j k l m "]) for _ in range(r.randrange(400)))
        cut = spans.sentences(text)
        assert all(x[1] == y[0] for x, y in zip(cut, cut[1:]))
        assert not cut or (cut[-1][1] == len(text) and not text[: cut[0][0]].strip())
        assert cut == brute_cut(text)


def test_spans_random(spark):
    """Every run of two sentences and 20 words or more, of any length, against the shortest runs that the operator hashes."""
    r = random.Random(8)
    sentences = [" ".join(f"w{r.randrange(40)}" for _ in range(r.randrange(1, 18))) + r.choice([".", "!", ".”"]) for _ in range(25)]
    bare = [" ".join(f"u{r.randrange(300)}" for _ in range(r.randrange(20, 60))) for _ in range(4)]
    rows = [(i if i % 8 else None, r.choice([" ", "\n"]).join(r.choice(sentences + bare) for _ in range(r.randrange(0, 12)))) for i in range(120)]
    check_spans(spark, rows + [rows[3], rows[8]] + [(i, t) for i, t in odd_rows() if len(t or "") < 3000])


def test_spans_passage(spark):
    passage = "The quick brown fox jumps over the lazy dog again. Then it sleeps for a while, and it dreams of hens and of geese."
    two = spark.createDataFrame([(1, "Mine. " + passage + " End."), (2, "Yours is another one. " + passage + " Other end.")], "doc_id long, text string")
    assert {x.doc_id: x.text for x in spans.span_dedup(two).collect()}[2] == "Yours is another one. Other end."


def test_span_passages(spark):
    """Of a repeated passage of 50 words or more, wherever its edges lie, only edges of at most 15 words stay."""
    r = random.Random(10)
    rows, inner = [], {}
    for i in range(150):
        words = [f"w{r.randrange(10**6)}" + ("." if r.random() < (0, 1 / 24, 1 / 12)[i % 3] else "") for _ in range(r.randrange(50, 62))]
        for copy in range(2):
            around = [" ".join(f"y{r.randrange(10**6)}" for _ in range(r.randrange(0, 30))) + r.choice(["", ".", "\n"]) for _ in range(2)]
            rows.append((2 * i + copy, f"{around[0]} {' '.join(words)} {around[1]}"))
        inner[2 * i + 1] = words[15:-15]
    found = {x.doc_id: x.text.split() for x in spans.span_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(len(x) >= 20 for x in inner.values())
    assert not any(set(words) & set(found[i]) for i, words in inner.items())
    assert all(found[i] == text.split() for i, text in rows if not i % 2)


def test_long_texts(spark):
    """Texts beyond a batch of 8 MB, in one row, and many rows of one id and text."""
    r = random.Random(12)
    long = "\n".join(" ".join(f"w{r.randrange(10**5)}" for _ in range(12)) + "." for _ in range(120_000))
    tail = "\n".join(long.split("\n")[-5:])
    rows = [(1, long), (2, "own\n" + tail)] + [(3, "same\nlines\nhere " + "x " * 30)] * 500
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(long) > linededup.LEAST_WORDS and len(long.encode()) > 8 << 20
    lines = linededup.line_dedup(table).groupBy("doc_id", "n_deleted_lines").agg(F.count("*").alias("n"), F.max(F.length("text")).alias("size")).collect()
    assert {(x.doc_id, x.n_deleted_lines): (x.n, x["size"]) for x in lines} == {(1, 0): (1, len(long)), (2, 5): (1, 3), (3, 0): (500, len(rows[2][1]))}
    cut = {x.doc_id: x.text for x in spans.span_dedup(table.where("doc_id < 3")).collect()}
    assert cut[1] == long and cut[2] == "own\n"
