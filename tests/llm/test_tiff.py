"""TIFF pages: round trips, files built by hand in every form that is read, vectors of the formats, and broken files."""

import collections
import itertools
import random
import struct
import zlib

import numpy as np
import pytest

from quirespark.llm import queries, tiff
from tests.llm.test_operators import D, odd_rows


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "n") for i, t in odd_rows()], "doc_id long, text string, n_lines string")


def test_tiff_round_trips():
    r = random.Random(1)
    for n, kind in itertools.product((0, 1, 300, 5000), range(3)):
        data = bytes(r.randrange(256) for _ in range(n)) if kind == 0 else bytes(r.choice(b"ab ") for _ in range(n)) if kind == 1 else b"x" * n
        padded = tiff.payload(data)
        image = np.frombuffer(padded, np.uint8).reshape(-1, 64)
        for compression, predictor, tile in itertools.product((tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS), (1, 2), (None, (16, 16), (32, 48))):
            pages = list(tiff.walk(tiff.stored([image, image[:1]], compression, predictor, 50, tile)))
            assert [p.error for p in pages] == [None, None]
            assert pages[0].pixels == padded and pages[1].pixels == padded[:64]


def test_tiff_broken():
    good = tiff.stored([np.zeros((4, 64), np.uint8)])
    assert [p.error for p in tiff.walk(b"")] == ["not a TIFF file"]
    for n in range(0, len(good), 7):
        assert all(p.error or p.pixels is not None for p in tiff.walk(good[:n]))
    loop = bytearray(good)
    loop[-4:] = loop[4:8]
    assert [bool(p.error) for p in tiff.walk(bytes(loop))] == [False, True]
    assert tiff.packbits(bytes([254, 7, 1, 8, 9, 128]), 99) == bytes([7, 7, 7, 8, 9])


def test_tiff_query(spark, odd):
    media = tiff.text_media(odd)
    got = tiff.tiff_pages(media, keep=("doc_id", "n_bytes")).collect()
    expected = collections.Counter((i, len((t or "").encode()), tiff.payload((t or "").encode())) for i, t in odd_rows())
    assert collections.Counter((r.doc_id, r.n_bytes, bytes(r.pixels)) for r in got) == expected
    q = queries.op2_tiff_media(spark, D).first()
    assert len(q.payload_sha256) == 64 and q.payload_bytes % 64 == 0


def built(pages, order="<", big=False, link_back=None):
    """A file of ``pages``, each a dict of tag to (kind, values) and ``blocks``, whose places fill tag 273 or 324."""
    word, size = ("Q", 8) if big else ("I", 4)
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(f"{order}H", 43 if big else 42) + (struct.pack(f"{order}HHQ", 8, 0, 0) if big else bytes(4)))
    link, heads = len(out) - size, []
    for page in pages:
        tags, blocks = dict(page["tags"]), page["blocks"]
        places = []
        for block in blocks:
            places.append(len(out))
            out += block
        tiled = 322 in tags
        tags[324 if tiled else 273] = (16 if big else 4, places)
        tags[325 if tiled else 279] = (16 if big else 4, [len(x) for x in blocks])
        entries = b""
        for tag, (kind, values) in sorted(tags.items()):
            body = struct.pack(f"{order}{len(values)}{ {3: 'H', 4: 'I', 16: 'Q'}[kind] }", *values)
            if len(body) > size:
                where = struct.pack(f"{order}{word}", len(out))
                out += body
            else:
                where = body.ljust(size, b"\0")
            entries += struct.pack(f"{order}HH{word}", tag, kind, len(values)) + where
        heads.append(len(out))
        out[link : link + size] = struct.pack(f"{order}{word}", len(out))
        out += struct.pack(f"{order}{'Q' if big else 'H'}", len(tags)) + entries
        link = len(out)
        out += bytes(size)
    if link_back is not None:
        out[link : link + size] = struct.pack(f"{order}{word}", heads[link_back])
    return bytes(out)


@pytest.mark.parametrize("order,big,bits,planar,predictor", list(itertools.product("<>", (False, True), (8, 16, 32), (1, 2), (1, 2))))
def test_forms(order, big, bits, planar, predictor):
    """Both byte orders and sizes, chunky and planar, 8 to 32 bits, with the horizontal predictor and without."""
    r = np.random.default_rng(bits + planar)
    image = r.integers(0, 1 << bits, (7, 10, 3), dtype=np.uint64).astype(f"u{bits // 8}")
    steps = image.copy()
    if predictor == 2:
        steps[:, 1:] -= image[:, :-1]
    stored = steps.astype(steps.dtype.newbyteorder(order))
    planes = [stored[:, :, i : i + 1] for i in range(3)] if planar == 2 else [stored]
    blocks = [zlib.compress(np.ascontiguousarray(p[y : y + 3]).tobytes()) for p in planes for y in range(0, 7, 3)]
    tags = {256: (3, [10]), 257: (4, [7]), 258: (3, [bits] * 3), 259: (3, [8]), 277: (3, [3]), 278: (3, [3]), 284: (3, [planar]), 317: (3, [predictor])}
    (page,) = tiff.walk(built([{"tags": tags, "blocks": blocks}], order, big))
    assert page.error is None and (page.width, page.height, page.samples, page.bits) == (10, 7, 3, bits)
    assert page.pixels == image.tobytes()


@pytest.mark.parametrize("order,bits", list(itertools.product("<>", (1, 2, 4))))
def test_few_bits(order, bits):
    image = np.random.default_rng(bits).integers(0, 1 << bits, (5, 13), dtype=np.uint8)
    rows = ["".join(f"{x:0{bits}b}" for x in row) for row in image]
    raw = b"".join(int(x.ljust(-(-len(x) // 8) * 8, "0"), 2).to_bytes(-(-len(x) // 8), "big") for x in rows)
    tags = {256: (3, [13]), 257: (3, [5]), 258: (3, [bits]), 259: (3, [1]), 278: (3, [5])}
    (page,) = tiff.walk(built([{"tags": tags, "blocks": [raw]}], order))
    assert page.error is None and page.pixels == image.tobytes()


@pytest.mark.parametrize("order,tile", list(itertools.product("<>", (False, True))))
def test_floats(order, tile):
    """The floating-point predictor: the bytes of a row by significance, then differences."""
    image = np.random.default_rng(3).normal(size=(16, 16)).astype("f4")
    rows = []
    for row in image:
        planes = np.frombuffer(row.astype(">f4").tobytes(), np.uint8).reshape(-1, 4).T.reshape(-1)
        rows.append(np.concatenate((planes[:1], planes[1:] - planes[:-1])).tobytes())
    tags = {256: (3, [16]), 257: (3, [16]), 258: (3, [32]), 259: (3, [8]), 317: (3, [3]), 339: (3, [3])} | ({322: (3, [16]), 323: (3, [16])} if tile else {278: (3, [16])})
    (page,) = tiff.walk(built([{"tags": tags, "blocks": [zlib.compress(b"".join(rows))]}], order))
    assert page.error is None and page.pixels == image.tobytes()


def test_vectors():
    """Known streams: the specification's LZW codes and the PackBits example."""
    bits = "".join(f"{x:09b}" for x in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    packed = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.lzw(packed, 9) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    assert tiff.packbits(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA"), 24) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22" + "AA" * 10)


def plain_lzw(data):
    """Codes cut from a string of bits, one table entry a code, the width by the table's size."""
    bits = "".join(f"{b:08b}" for b in data)
    out, table, at, width, before = b"", {}, 0, 9, None
    while at + width <= len(bits):
        code = int(bits[at : at + width], 2)
        at += width
        if code == 257:
            break
        if code == 256:
            table, width, before = {i: bytes([i]) for i in range(256)} | {256: None, 257: None}, 9, None
            continue
        entry = table.get(code) or before + before[:1]
        out += entry
        if before is not None:
            table[len(table)] = before + entry[:1]
        before = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return out


def test_lzw_widths():
    """Streams long enough for codes of every width and for a second table, read by another decoder as well."""
    r = random.Random(4)
    for n in (10, 3000, 40_000):
        for letters in (b"ab", bytes(range(256))):
            data = bytes(r.choice(letters) for _ in range(n))
            packed = tiff.lzw_pack(data)
            assert plain_lzw(packed) == data == tiff.lzw(packed, n)


def test_errors():
    """Short strips, strange sizes, and chains that turn back give error rows; the other pages are read."""
    good = {"tags": {256: (3, [64]), 257: (3, [8]), 258: (3, [8]), 259: (3, [1]), 278: (3, [8])}, "blocks": [bytes(range(256)) * 2]}
    short = good | {"blocks": [b"x" * 10]}
    packed = {"tags": good["tags"] | {259: (3, [8])}, "blocks": [zlib.compress(b"y" * 100)]}
    broken = {"tags": good["tags"] | {259: (3, [8])}, "blocks": [b"no stream"]}
    huge = {"tags": good["tags"] | {256: (4, [1 << 20]), 257: (4, [1 << 20])}, "blocks": [b""]}
    pages = list(tiff.walk(built([good, short, packed, broken, huge, good], ">")))
    assert [bool(p.error) for p in pages] == [False, True, True, True, True, False]
    assert all(p.pixels is None for p in pages if p.error) and "10 of 512 bytes" in pages[1].error and "too large" in pages[4].error
    back = list(tiff.walk(built([good, good], link_back=0)))
    assert [bool(p.error) for p in back] == [False, False, True] and "turns back" in back[2].error
    one = {"tags": {256: (3, [1]), 257: (3, [1]), 258: (3, [8]), 259: (3, [1]), 278: (3, [1])}, "blocks": [b"z"]}
    assert sum(p.pixels == b"z" for p in tiff.walk(built([one] * 70_000))) == 70_000


def test_clashing_names(spark):
    """Kept columns named like the result's give way; null files give an error row."""
    file = tiff.stored([np.zeros((4, 64), np.uint8)])
    table = spark.createDataFrame([(1, "a", "b", file), (2, "a", "b", None), (2, "a", "b", None)], "content int, page string, feature string, media binary")
    found = tiff.tiff_pages(table, keep=("page", "feature", "content", "content"))
    assert found.columns[:2] == ["content", "page"] and len(set(found.columns)) == len(found.columns)
    assert collections.Counter((r.content, r.page, r.error) for r in found.collect()) == {(1, 0, None): 1, (2, 0, "not a TIFF file"): 2}


def test_every_layout(spark):
    """Texts of every layout that the query uses, and one beyond a batch, come back whole."""
    rows = [(i, "word " * (i % 300) + str(i)) for i in range(400)] + [(1000, "long text " * 900_000)]
    used = {str(tiff.layout(tiff.payload(t.encode()))) for _, t in rows}
    assert len(used) == 7
    media = tiff.text_media(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: (bytes(r.pixels), r.error) for r in tiff.tiff_pages(media, keep=("doc_id",)).collect()}
    assert got == {i: (tiff.payload(t.encode()), None) for i, t in rows}
