"""BPE encoding and decoding by a table of distinct words.

Words are runs without ASCII white space, which no token crosses. A partition's documents form segments of bounded text.
Each segment gives its distinct words once, dealt into buckets by a hash. A bucket's lists meet, and what they hold, each word
once, is that bucket's part of the word table: every distinct word of all documents is encoded exactly once, however often and
wherever it occurs. The lists take their words' ids from the table by position and return to their segment, where the ids meet
the id-to-piece table of the vocabulary, whose size is fixed, in a join on the id (the piece table is dense, so the join is a
take), and the documents' words take both by position.

Two things are exchanged: a compressed list of distinct words a segment and bucket, with the ids back, and each segment's texts,
compressed. A word in every document costs one entry a segment, so frequent words make no hot task. Segments and buckets are of
a fixed size and their numbers follow the data, so no task grows with it; an empty list is not sent, so there are never more
lists than different words in segments.

Null and empty texts have no ids; their digests are those of the empty string. A text of any length is taken whole (one longer
than a segment is a segment of its own). Repeated rows each get their row; an empty table gives none. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.llm.common import arrow_schema, map_rows, slices, utf8

#: Entries that a worker remembers; the memory is emptied when it is full, which costs time and changes nothing.
MOST_PARTS, MOST_WORDS = 700_000, 300_000
#: Text of a segment, about; a longer document is a segment of its own.
SEGMENT_BYTES = 4 << 20
BLOB_BYTES = 4 << 20
#: Text of which a bucket holds the distinct words, as if they were dealt out evenly.
BUCKET_BYTES = 16 << 20

#: The normaliser and the pre-tokeniser that the fast path follows, and what it follows them on: ASCII and
#: Latin-1 letters, which normalise to their lower case alone.
FOLLOWED = (
    '{"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\\\s+"}, "content": " "}, {"type": "Lowercase"}]}',
    '{"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "\'s|\'t|\'re|\'ve|\'m|\'ll|\'d|[\\\\p{L}]+|[\\\\p{N}]|[^\\\\s\\\\p{L}\\\\p{N}]+"}, "behavior": "Removed", "invert": true}, {"type": "ByteLevel", "add_prefix_space": false, "trim_offsets": true, "use_regex": false}]}',
)
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


class Memory(dict):
    """A dictionary that fills itself by a function and starts again when it has ``most`` entries."""

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        self[key] = value = self.make(key)
        return value


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints, else the next from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _ids(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


_encoders: dict[str, Memory] = {}


def encoder(path: str) -> Memory:
    """Word (bytes) to ids (little-endian 32-bit bytes) by the tokenizers file at ``path``; a worker keeps one for all its tasks.

    Words of ASCII and Latin-1 letters are cut as the file's pre-tokeniser does and their parts go to its BPE model, each
    part once; all others, those that may hold a special token, and all words of files set up otherwise go through the whole
    tokeniser, word by word.
    """
    if path not in _encoders:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        added = [x["content"] for x in told["added_tokens"]]
        fast = tuple(json.dumps(told[k]) for k in ("normalizer", "pre_tokenizer")) == FOLLOWED and all(x.startswith("<|") for x in added)
        model, letters = tokenizer.model, byte_letters()

        def part(text: str) -> bytes:
            return _ids([x.id for x in model.tokenize(text.encode().decode("latin-1").translate(letters))])

        parts = Memory(part, MOST_PARTS)

        def word(raw: bytes) -> bytes:
            text = raw.decode()
            if fast and b"<|" not in raw and PLAIN.fullmatch(text):
                return b"".join(map(parts.__getitem__, PARTS.findall(text.lower())))
            return _ids(tokenizer.encode(text, add_special_tokens=False).ids)

        _encoders[path] = Memory(word, MOST_WORDS)
    return _encoders[path]


def pieces(path: str) -> list[str]:
    """The id-to-piece table, special tokens included."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
    out = [""] * (max(found.values()) + 1)
    for piece, number in found.items():
        out[number] = piece
    return out


def _segmented(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, pa.Array, list[bytes]]]:
    """``(segment, keys, texts)`` of runs of rows; a segment is a number within its scan partition."""
    seg = TaskContext.get().partitionId() << 31
    held = 0
    for batch in slices(batches, "text", min(BLOB_BYTES, most)):
        texts = utf8(batch.column(1))
        size = sum(map(len, texts))
        if held and held + size > most:
            seg, held = seg + 1, 0
        held += size
        yield seg, batch.column(0), texts


def segments(docs: DataFrame, key: str, text: str, most: int = SEGMENT_BYTES) -> DataFrame:
    """Rows ``(seg, ids, sizes, blob)``: compressed runs of documents, a few for a segment."""
    ddl = f"seg long, ids array<{docs.schema[key].dataType.simpleString()}>, sizes array<int>, blob binary"
    schema = arrow_schema(ddl)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=5)
        for seg, keys, texts in _segmented(batches, most):
            row = [[seg], [keys.to_pylist()], [[len(x) for x in texts]], [pack.compress(b"".join(texts))]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, schema.types)], schema=schema)

    return map_rows(docs.select(key, F.col(text).cast("string").alias("text")), ddl, cut)


def _texts(sizes: list[int], blob: bytes) -> Iterator[bytes]:
    data = zstandard.ZstdDecompressor().decompress(blob, max_output_size=max(1, sum(sizes)))
    at = 0
    for n in sizes:
        yield data[at : at + n]
        at += n


def _dealt(words: set[bytes], buckets: int) -> list[list[bytes]]:
    """The words of each bucket, in order, so that both sides of the exchange know the places without sending them."""
    out: list[list[bytes]] = [[] for _ in range(buckets)]
    for w in words:
        out[zlib.crc32(w) % buckets].append(w)
    for x in out:
        x.sort()
    return out


def distinct_words(docs: DataFrame, key: str, text: str, buckets: int, most: int = SEGMENT_BYTES) -> DataFrame:
    """Rows ``(seg, bucket, words)``: the distinct words of each segment, in order, by bucket."""
    ddl = "seg long, bucket int, words binary"
    schema = arrow_schema(ddl)

    def listed(seg: int, words: set[bytes]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        rows = [(seg, i, pack.compress(b"\n".join(x))) for i, x in enumerate(_dealt(words, buckets)) if x]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: set[bytes] = set()
        now = None
        for seg, _, texts in _segmented(batches, most):
            if seg != now:
                yield from listed(now, words)
                now, words = seg, set()
            for one in texts:
                words.update(one.split())
        yield from listed(now, words)

    return map_rows(docs.select(key, F.col(text).cast("string").alias("text")), ddl, made)


def _lists(table: pa.Table) -> list[bytes]:
    open_ = zstandard.ZstdDecompressor()
    return [open_.decompress(x) for x in table.column("words").to_pylist()]


def _word_ids(lists: list[bytes], path: str) -> dict[bytes, bytes]:
    """A bucket's part of the word table: each distinct word of its lists, encoded once."""
    encode = encoder(path).make
    return {w: encode(w) for w in dict.fromkeys(w for x in lists for w in x.split(b"\n"))}


def encoded_words(words: DataFrame, path: str, buckets: int) -> DataFrame:
    """Rows ``(seg, bucket, crc, ids)``: the ids of each list of words, in its order; ``crc`` is the list's."""
    ddl = "seg long, bucket int, crc long, ids binary"
    schema = arrow_schema(ddl)

    def made(lists: pa.Table) -> pa.Table:
        pack = zstandard.ZstdCompressor(level=3)
        held = _lists(lists)
        get = _word_ids(held, path).__getitem__
        crcs, out = [], []
        for listed in held:
            found = list(map(get, listed.split(b"\n")))
            sizes = np.fromiter(map(len, found), dtype="<u4", count=len(found)) // 4
            crcs.append(zlib.crc32(listed))
            out.append(pack.compress(np.concatenate((np.array([len(found)], "<u4"), sizes, np.frombuffer(b"".join(found), "<u4"))).tobytes()))
        return pa.Table.from_arrays([lists.column("seg"), lists.column("bucket"), pa.array(crcs, pa.int64()), pa.array(out, pa.binary())], schema=schema)

    return words.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(made, ddl)


def word_table(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """Rows ``(word, ids, decoded)``: every distinct word of all documents, once, with its ids and their pieces joined by a space."""
    ddl = "word string, ids array<int>, decoded string"
    schema = arrow_schema(ddl)

    def made(lists: pa.Table) -> pa.Table:
        found = _word_ids(_lists(lists), path)
        flat = np.frombuffer(b"".join(found.values()), "<u4")
        counts = np.array([len(x) // 4 for x in found.values()], np.int64)
        ids = pa.ListArray.from_arrays(pa.array(_ends(counts), pa.int32()), pa.array(flat.astype("i4")))
        decoded = _joined(piece_table(path), flat, counts)
        return pa.Table.from_arrays([pa.array([w.decode() for w in found], pa.string()), ids.cast(schema.types[1]), decoded.cast(pa.string())], schema=schema)

    buckets = buckets or bucket_count(docs, text)
    return distinct_words(docs, key, text, buckets).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(made, ddl)


def bucket_count(docs: DataFrame, text: str) -> int:
    """Buckets by the size of the texts: one number is asked of the table."""
    size = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    return max(16, -(-size // BUCKET_BYTES))


_piece_tables: dict[str, pa.Array] = {}


def piece_table(path: str) -> pa.Array:
    """The id-to-piece table: the piece of id i at place i."""
    if path not in _piece_tables:
        _piece_tables[path] = pa.array([x.encode() for x in pieces(path)], pa.large_binary())
    return _piece_tables[path]


def _ends(counts: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(1, np.int64), np.cumsum(counts)))


def _joined(names: pa.Array, flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The names of each word's ids, taken by id and joined by a space."""
    taken = pa.LargeListArray.from_arrays(pa.array(_ends(counts)), names.take(pa.array(flat)))
    return pc.binary_join(taken, pa.scalar(b" ", pa.large_binary()))


def _table(dealt: list[list[bytes]], lists: dict[int, tuple[int, bytes]], path: str) -> tuple[dict[bytes, bytes], dict[bytes, bytes]]:
    """Word to its decimal ids, and word to its pieces, each joined by a space.

    A list that isn't the one its ids were made for (the rows of a scan can come in another order when a task runs again)
    is encoded here.
    """
    open_ = zstandard.ZstdDecompressor()
    flats, counts = [np.empty(0, "<u4")], [np.empty(0, np.int64)]
    for bucket, words in enumerate(dealt):
        if not words:
            continue
        crc, blob = lists.get(bucket, (-1, b""))
        if crc == zlib.crc32(b"\n".join(words)):
            flat = np.frombuffer(open_.decompress(blob), "<u4")
            counts.append(flat[1 : len(words) + 1].astype(np.int64))
            flats.append(flat[len(words) + 1 :])
        else:
            own = [encoder(path)[w] for w in words]
            counts.append(np.array([len(x) // 4 for x in own], np.int64))
            flats.append(np.frombuffer(b"".join(own), "<u4"))
    flat, count = np.concatenate(flats), np.concatenate(counts)
    names = piece_table(path)
    decimals = pa.array(np.arange(len(names))).cast(pa.string()).cast(pa.large_binary())
    words = [w for x in dealt for w in x]
    return tuple(dict(zip(words, _joined(table, flat, count).to_pylist())) for table in (decimals, names))


def encode_decode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """Per row: key, ``ids`` digest and decoded digest.

    Columns: key, ``n_tokens`` (long), ``ids_sha256`` (of decimal ids joined by a space), ``decoded_sha256`` (of the pieces
    joined by a space, which is how a vocabulary without a decoder is decoded).
    """
    return coded(docs, path, key, text, buckets, digests=True)


def coded(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", buckets: int | None = None, digests: bool = False) -> DataFrame:
    """Per row: key, ``ids`` (array of int) and ``decoded``; or their digests."""
    buckets = buckets or bucket_count(docs, text)
    ids = encoded_words(distinct_words(docs, key, text, buckets), path, buckets)
    kind = docs.schema[key].dataType.simpleString()
    ddl = f"{key} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else f"{key} {kind}, ids array<int>, decoded string"
    schema = arrow_schema(ddl)

    def joined(docs_: pa.Table, ids_: pa.Table) -> pa.Table:
        held = [(keys, [one.split() for one in _texts(sizes, blob)]) for keys, sizes, blob in zip(docs_.column("ids").to_pylist(), docs_.column("sizes").to_pylist(), docs_.column("blob").to_pylist())]
        words: set[bytes] = set()
        for _, texts in held:
            words.update(*texts)
        lists = dict(zip(ids_.column("bucket").to_pylist(), zip(ids_.column("crc").to_pylist(), ids_.column("ids").to_pylist())))
        decimal, piece = _table(_dealt(words, buckets), lists, path)
        # A word that has no ids leaves no space behind.
        none = {w for w, x in decimal.items() if not x}
        out = []
        for keys, texts in held:
            rows = []
            for own in texts:
                if none and not none.isdisjoint(own):
                    own = [w for w in own if w not in none]
                numbers = b" ".join(map(decimal.__getitem__, own))
                decoded = b" ".join(map(piece.__getitem__, own))
                if digests:
                    rows.append((numbers.count(b" ") + bool(numbers), hashlib.sha256(numbers).hexdigest(), hashlib.sha256(decoded).hexdigest()))
                else:
                    rows.append(([int(x) for x in numbers.split()], decoded.decode()))
            out.append(pa.RecordBatch.from_arrays([pa.array(keys, schema.types[0]), *(pa.array(c, t) for c, t in zip(zip(*rows), schema.types[1:]))], schema=schema))
        return pa.Table.from_batches(out, schema=schema)

    return segments(docs, key, text).groupBy("seg").cogroup(ids.groupBy("seg")).applyInArrow(joined, ddl)
