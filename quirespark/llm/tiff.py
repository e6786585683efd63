"""TIFF pages as rows: directories walked, strips and tiles decoded, predictors undone; and the writer that stores samples.

Read: both byte orders, classic and big files, chunky and planar samples of 1, 2, 4, 8, 16 or 32 bits, no compression,
PackBits, LZW and deflate, horizontal and floating-point predictors. Samples of under 8 bits become bytes.

A null or broken file gives one row with ``error`` set and no pixels; a directory that cannot be decoded gives its row with
``error`` set, and the walk goes on. So does a strip or tile that holds less than its size: no sample is invented. A chain of
directories of any length is walked; one that turns back on itself ends there with a row that says so. A page of over
``MOST_PIXELS`` samples, which no row of Spark could hold, gives an error row; :func:`text_media` stores a text of more bytes on
several pages. Repeated rows each get their rows, equal texts equal ones; an empty table gives none. Columns named in ``keep``
pass through; one that is named like a column of the result gives way to it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.llm.common import arrow_schema, kept_columns, map_rows, names_of, slices, utf8

#: Numbers of tags and of compressions.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, SAMPLE_FORMAT = 284, 317, 322, 323, 324, 325, 339
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
KINDS = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 13: "I", 16: "Q", 17: "q", 18: "Q"}
#: Samples of a page, and bytes of them: a row's binary column is an array of fewer than 2 GB.
MOST_PIXELS = 1 << 30


class TiffError(ValueError):
    """The file does not hold what its directory says."""


@dataclass
class Page:
    """One decoded image directory; ``pixels`` are its samples, row by row, in machine order."""

    page: int
    width: int = 0
    height: int = 0
    samples: int = 1
    bits: int = 1
    compression: int = 1
    predictor: int = 1
    layout: str = ""
    pixels: bytes | None = None
    error: str | None = None


def packbits(data: bytes, size: int) -> bytes:
    """Runs and literals until ``size`` bytes are out or the data ends."""
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 1 + (n > 128)
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    """The runs of ``data``: three equal bytes or more repeat, the rest are literals."""
    out, at, n = bytearray(), 0, len(data)
    while at < n:
        end = at + 1
        while end < n and end - at < 128 and data[end] == data[at]:
            end += 1
        if end - at >= 3:
            out += bytes((257 - (end - at), data[at]))
            at = end
            continue
        start = at
        while at < n and at - start < 128 and not (at + 2 < n and data[at] == data[at + 1] == data[at + 2]):
            at += 1
        out += bytes((at - start - 1,)) + data[start:at]
    return bytes(out)


def lzw(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, the highest bit first; 256 starts a new table and 257 ends."""
    out = bytearray()
    table: list[bytes] = []
    width, held, bits = 9, 0, 0
    before = b""
    first = [bytes((i,)) for i in range(256)] + [b"", b""]
    table = first[:]
    for byte in data:
        held = held << 8 | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, before = first[:], 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table) and before:
            entry = before + before[:1]
        else:
            raise TiffError("an LZW code that no table has")
        out += entry
        if before:
            table.append(before + entry[:1])
        before = entry
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
        if len(out) >= size:
            break
    return bytes(out)


def lzw_pack(data: bytes) -> bytes:
    """The codes that :func:`lzw` reads."""
    out, held, bits, width = bytearray(), 0, 0, 9
    table: dict[bytes, int] = {}

    def put(code: int) -> None:
        nonlocal held, bits
        held = held << width | code
        bits += width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    def fresh() -> dict[bytes, int]:
        return {bytes((i,)): i for i in range(256)}

    put(256)
    table, nextcode, now = fresh(), 258, b""
    for i in range(len(data)):
        more = now + data[i : i + 1]
        if more in table:
            now = more
            continue
        put(table[now])
        table[more] = nextcode
        nextcode += 1
        now = data[i : i + 1]
        if nextcode == 4094:
            put(table[now])
            now = b""
            put(256)
            table, nextcode, width = fresh(), 258, 9
        elif nextcode >= (1 << width) and width < 12:
            width += 1
    if now:
        put(table[now])
        if nextcode + 1 >= (1 << width) and width < 12:
            width += 1
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def _unpacked(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        return data
    if compression == PACKBITS:
        return packbits(data, size)
    if compression == LZW:
        return lzw(data, size)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size or 1)
    raise TiffError(f"compression {compression} is not read")


def _samples(raw: bytes, rows: int, columns: int, samples: int, bits: int, order: str, predictor: int) -> np.ndarray:
    """One strip's or tile's samples as ``(rows, columns, samples)``."""
    per_row = columns * samples
    line = -(-per_row * bits // 8)
    if len(raw) < rows * line:
        raise TiffError(f"a strip or tile has {len(raw)} of {rows * line} bytes")
    if bits < 8:
        data = np.frombuffer(raw[: rows * line], np.uint8).reshape(rows, line)
        flags = np.unpackbits(data, axis=1)[:, : per_row * bits].reshape(rows, per_row, bits)
        weights = (1 << np.arange(bits - 1, -1, -1)).astype(np.uint8)
        return (flags * weights).sum(axis=2).astype(np.uint8).reshape(rows, columns, samples)
    width = bits // 8
    raw = raw[: rows * line]
    if predictor == 3:
        planes = np.frombuffer(raw, np.uint8).reshape(rows, per_row * width)
        steps = planes.reshape(rows, -1, samples)
        planes = np.cumsum(steps, axis=1, dtype=np.uint8).reshape(rows, width, per_row)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">u{width}").astype(f"=u{width}").reshape(rows, columns, samples)
    data = np.frombuffer(raw, np.dtype(f"{order}u{width}")).astype(f"=u{width}").reshape(rows, columns, samples)
    return np.cumsum(data, axis=1, dtype=data.dtype) if predictor == 2 else data


def _decoded(data: bytes, tags: dict[int, tuple], order: str, page: Page) -> np.ndarray:
    one = lambda tag, other: (tags.get(tag) or (other,))[0]
    page.width, page.height, page.samples = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
    depths = tags.get(BITS) or (1,)
    page.bits, page.compression, page.predictor = depths[0], one(COMPRESSION, 1), one(PREDICTOR, 1)
    if not page.width or not page.height or page.samples < 1 or page.width * page.height * page.samples * max(1, page.bits // 8) > MOST_PIXELS:
        raise TiffError("no size, or too large")
    if len(set(depths)) > 1 or page.bits not in (1, 2, 4, 8, 16, 32):
        raise TiffError(f"{depths} bits are not read")
    if page.predictor not in (1, 2, 3) or page.predictor > 1 and page.bits < 8:
        raise TiffError(f"predictor {page.predictor} is not read")
    planes = page.samples if one(PLANAR, 1) == 2 else 1
    samples = page.samples // planes
    tiled = TILES in tags
    page.layout = "tiles" if tiled else "strips"
    wide, high = (one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)) if tiled else (page.width, min(one(ROWS, page.height), page.height))
    offsets, sizes = tags.get(TILES if tiled else STRIPS, ()), tags.get(TILE_BYTES if tiled else STRIP_BYTES, ())
    if not wide or not high:
        raise TiffError("tiles or strips have no size")
    across, down = -(-page.width // wide), -(-page.height // high)
    if len(offsets) != across * down * planes or len(sizes) != len(offsets):
        raise TiffError("as many strips or tiles as the size needs aren't there")
    out = np.zeros((page.height, page.width, page.samples), dtype=f"=u{max(1, page.bits // 8)}")
    for i, (offset, size) in enumerate(zip(offsets, sizes)):
        plane, at = divmod(i, across * down)
        top, left = at // across * high, at % across * wide
        rows = high if tiled else min(high, page.height - top)
        if offset + size > len(data):
            raise TiffError("data beyond the file's end")
        need = rows * -(-wide * samples * page.bits // 8)
        block = _samples(_unpacked(data[offset : offset + size], page.compression, need), rows, wide, samples, page.bits, order, page.predictor)
        shown = block[: page.height - top, : page.width - left]
        out[top : top + shown.shape[0], left : left + shown.shape[1], plane * samples : (plane + 1) * samples] = shown
    return out


def walk(data: bytes) -> Iterator[Page]:
    """The pages of a file, in the order of its directories."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    magic = struct.unpack_from(f"{order}H", data, 2)[0] if order and len(data) >= 8 else 0
    if magic not in (42, 43) or magic == 43 and len(data) < 16:
        yield Page(0, error="not a TIFF file")
        return
    big = magic == 43
    number, offset_kind, entry, head = ("Q", "Q", 20, 8) if big else ("H", "I", 12, 2)
    inline = 8 if big else 4
    offset = struct.unpack_from(f"{order}{offset_kind}", data, 8 if big else 4)[0]
    seen: set[int] = set()
    page = 0
    while offset:
        if offset in seen:
            yield Page(page, error="the chain of directories turns back on itself")
            return
        seen.add(offset)
        now = Page(page)
        following = 0
        try:
            n = struct.unpack_from(f"{order}{number}", data, offset)[0]
            tags: dict[int, tuple] = {}
            following = struct.unpack_from(f"{order}{offset_kind}", data, offset + head + n * entry)[0]
            for i in range(n):
                at = offset + head + i * entry
                tag, kind, count = struct.unpack_from(f"{order}HH{offset_kind}", data, at)
                form = KINDS.get(kind)
                if form is None or form == "c":
                    continue
                size = struct.calcsize(form) * count
                where = at + (12 if big else 8)
                if size > inline:
                    where = struct.unpack_from(f"{order}{offset_kind}", data, where)[0]
                if where + size > len(data):
                    raise TiffError("a tag's values lie beyond the file's end")
                tags[tag] = struct.unpack_from(f"{order}{count}{form}", data, where)
            now.pixels = _decoded(data, tags, order, now).tobytes()
        except (TiffError, struct.error, zlib.error, ValueError, MemoryError) as e:
            now.error = str(e) or type(e).__name__
        yield now
        offset = following
        page += 1
    if not page:
        yield Page(0, error="no directory")


def stored(images: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, rows: int = 1024, tile: tuple[int, int] | None = None, level: int = 1) -> bytes:
    """A little-endian file with a page for each ``(height, width)`` array of bytes, in strips of ``rows`` or in tiles."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for image in images:
        high, wide = image.shape
        if tile:
            th, tw = tile
            padded = np.zeros((-(-high // th) * th, -(-wide // tw) * tw), np.uint8)
            padded[:high, :wide] = image
            blocks = [padded[y : y + th, x : x + tw] for y in range(0, padded.shape[0], th) for x in range(0, padded.shape[1], tw)]
        else:
            blocks = [image[y : y + rows] for y in range(0, high, rows)]
        offsets, sizes = [], []
        for block in blocks:
            if predictor == 2:
                block = np.concatenate((block[:, :1], block[:, 1:] - block[:, :-1]), axis=1)
            raw = block.tobytes()
            packed = zlib.compress(raw, level) if compression in (DEFLATE, OLD_DEFLATE) else lzw_pack(raw) if compression == LZW else pack_bits(raw) if compression == PACKBITS else raw
            offsets.append(len(out))
            sizes.append(len(packed))
            out += packed
        tags = [(WIDTH, 4, [wide]), (HEIGHT, 4, [high]), (BITS, 3, [8]), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]), (PREDICTOR, 3, [predictor])]
        tags += [(TILE_WIDTH, 4, [tile[1]]), (TILE_HEIGHT, 4, [tile[0]]), (TILES, 4, offsets), (TILE_BYTES, 4, sizes)] if tile else [(ROWS, 4, [rows]), (STRIPS, 4, offsets), (STRIP_BYTES, 4, sizes)]
        entries = []
        for tag, kind, values in sorted(tags):
            body = struct.pack(f"<{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(body) > 4:
                out += b"\0" * (len(out) % 2)
                where = struct.pack("<I", len(out))
                out += body
            else:
                where = body.ljust(4, b"\0")
            entries.append(struct.pack("<HHI", tag, kind, len(values)) + where)
        out += b"\0" * (len(out) % 2)
        out[link : link + 4] = struct.pack("<I", len(out))
        out += struct.pack("<H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def payload(raw: bytes, block: int = 64) -> bytes:
    """``raw`` with zero bytes up to a positive multiple of ``block``."""
    return raw.ljust(max(1, -(-len(raw) // block)) * block, b"\0")


def layout(data: bytes) -> dict:
    """How :func:`stored` lays ``data`` out: deflate strips, and by their checksum, for one in 64 each, the slower forms."""
    rare = {0: {"compression": LZW}, 1: {"compression": LZW, "tile": (32, 48)}, 2: {"compression": PACKBITS, "predictor": 1}, 3: {"compression": PACKBITS, "predictor": 1, "tile": (16, 64)}, 4: {"compression": NONE, "predictor": 1, "tile": (64, 16)}, 5: {"tile": (64, 32)}}
    return rare.get(zlib.crc32(data) % 64, {})


def images(data: bytes, width: int) -> Iterator[np.ndarray]:
    """Rows of ``width`` bytes, on as many pages as their bound needs."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, width)
    most = MOST_PIXELS // width
    for start in range(0, len(rows), most):
        yield rows[start : start + most]


def text_media(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 64) -> DataFrame:
    """Rows ``(key, n_bytes, media)``: each text's padded bytes stored as the grey samples of a page ``width`` wide, null as empty.

    Equal texts are stored alike; the layout follows their checksum.
    """
    ddl = f"{key} {docs.schema[key].dataType.simpleString()}, n_bytes long, media binary"
    schema = arrow_schema(ddl)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = utf8(batch.column(1))
            media = [stored(list(images(x, width)), **layout(x)) for x in (payload(t, width) for t in texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array(media, pa.binary())], schema=schema)

    return map_rows(docs.select(key, F.col(text).cast("string").alias("text")), ddl, made)


def feature(page: Page) -> str:
    """Size, mean and a 64-bit hash of the columns: a bit is one where a 64th of the width is lighter than the page."""
    if page.pixels is None:
        return ""
    image = np.frombuffer(page.pixels, np.uint8 if page.bits <= 8 else f"=u{page.bits // 8}").reshape(page.height, -1)
    sums = image.sum(axis=0, dtype=np.float64)
    bands = [float(x.mean()) if len(x) else 0.0 for x in np.array_split(sums / page.height, 64)]
    mean = float(sums.sum()) / image.size
    bits = sum(1 << (63 - i) for i, x in enumerate(bands) if x > mean)
    return f"{page.width}x{page.height}:{mean:.3f}:{bits:016x}"


PAGE_DDL = "page int, width int, height int, samples int, bits int, compression int, predictor int, layout string, feature string, pixels binary, error string"


def tiff_pages(media: DataFrame, content: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per page of each file in ``content``: the columns of ``keep``, then the page's description and pixels."""
    keep = kept_columns(keep, names_of(PAGE_DDL))
    kept = ", ".join(f"`{c}` {media.schema[c].dataType.simpleString()}" for c in keep)
    ddl = f"{kept}, {PAGE_DDL}" if kept else PAGE_DDL
    schema = arrow_schema(ddl)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__quire_content"):
            row, rows, held = [], [], 0
            for i, data in enumerate(utf8(batch.column(len(keep)))):
                for p in walk(data):
                    row.append(i)
                    rows.append((p.page, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.layout, feature(p), p.pixels, p.error))
                    held += len(p.pixels or b"")
                    if held > 1 << 26:
                        yield out(batch, row, rows)
                        row, rows, held = [], [], 0
            if rows:
                yield out(batch, row, rows)

    def out(batch: pa.RecordBatch, row: list[int], rows: list[tuple]) -> pa.RecordBatch:
        take = pa.array(row, pa.int64())
        return pa.RecordBatch.from_arrays([*(batch.column(i).take(take) for i in range(len(keep))), *(pa.array(c, t) for c, t in zip(zip(*rows), schema.types[len(keep) :]))], schema=schema)

    return map_rows(media.select(*keep, F.col(content).cast("binary").alias("__quire_content")), ddl, made)
