"""Layout files: the first entry of a zip is an XML file of pages, blocks, lines and words."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quirespark.errors import BadAltoFileFormat

DDL = "page_no int, page_width int, page_height int, block_no int, line_no int, ord int, kind string, content string, rect struct<left:int,top:int,width:int,height:int>, alternatives array<string>, error string"


def _number(e: ElementTree.Element, name: str) -> int:
    return round(float(e.get(name) or 0))


def pieces(xml: bytes) -> Iterator[tuple]:
    """The words, spaces and hyphens of a layout file, in order."""
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError as e:
        raise BadAltoFileFormat(str(e)) from e
    name = lambda e: e.tag.rpartition("}")[2]
    pages = [e for e in root.iter() if name(e) == "Page"]
    if not pages:
        raise BadAltoFileFormat("no page")
    for i, page in enumerate(pages):
        number = int(page.get("PHYSICAL_IMG_NR") or i)
        for b, block in enumerate(e for e in page.iter() if name(e) == "TextBlock"):
            for n, line in enumerate(e for e in block if name(e) == "TextLine"):
                for o, piece in enumerate(e for e in line if name(e) in ("String", "SP", "HYP")):
                    kind = {"String": "word", "SP": "space", "HYP": "hyphen"}[name(piece)]
                    rect = dict(zip(("left", "top", "width", "height"), (_number(piece, k) for k in ("HPOS", "VPOS", "WIDTH", "HEIGHT"))))
                    other = [(a.text or a.get("CONTENT") or "") for a in piece if name(a) == "ALTERNATIVE"]
                    yield number, _number(page, "WIDTH"), _number(page, "HEIGHT"), b, n, o, kind, " " if kind == "space" else piece.get("CONTENT") or "-", rect, other, None


def first_entry(data: bytes) -> bytes:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = z.namelist()
            if not names:
                raise BadAltoFileFormat("no entry")
            return z.read(names[0])
    except (zipfile.BadZipFile, zlib.error) as e:
        raise BadAltoFileFormat(str(e)) from e


def flattened(files: DataFrame) -> DataFrame:
    """``files`` (path, content) as rows of pieces; a file that cannot be read gives one row with its ``error``."""
    ddl = f"path string, {DDL}"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows = list(pieces(first_entry(data)))
                except BadAltoFileFormat as e:
                    rows = [(*[None] * 10, str(e))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), *(pa.array(c, t) for c, t in zip(zip(*rows), schema.types[1:]))], schema=schema)

    return files.select("path", "content").mapInArrow(made, ddl)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The pieces of the layout zips at ``path``."""
    return flattened(spark.read.format("binaryFile").load(path))


def images(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``(path, entry, content, error)`` of the png and jpg entries of zips; what cannot be read gives a row with its ``error``."""
    ddl = "path string, entry string, content binary, error string"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def entries(where: str, data: bytes) -> Iterator[tuple]:
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for entry in z.namelist():
                    if entry.lower().endswith((".png", ".jpg", ".jpeg")):
                        try:
                            yield where, entry, z.read(entry), None
                        except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError) as e:
                            yield where, entry, None, str(e)
        except zipfile.BadZipFile as e:
            yield where, None, None, str(e)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for row in entries(where, data):
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, schema.types)], schema=schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(made, ddl)


def synonym_lines(spark: SparkSession, *paths: str) -> tuple[tuple[str, ...], ...]:
    """The lines of synonym files, text or the first entry of a zip, for ``Language.with_synonyms``: configuration of bounded size.

    The words of a line stand for each other; ``a, b => c`` makes the left ones stand for the right. Lines with ``#`` are left out.
    """
    out: list[tuple[str, ...]] = []
    for path in paths:
        for row in spark.read.format("binaryFile").load(path).select("path", "content").orderBy("path").collect():
            data = first_entry(bytes(row["content"])) if row["path"].lower().endswith(".zip") else bytes(row["content"])
            for line in data.decode("utf-8").splitlines():
                words = tuple(dict.fromkeys(w.strip().lower() for w in line.replace("=>", ",").split(",") if w.strip()))
                if len(words) > 1 and not line.lstrip().startswith("#"):
                    out.append(words)
    return tuple(out)


def synonyms(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``(word, other)`` of a synonym file: the words of a line stand for each other."""
    pairs = [(a, b) for line in synonym_lines(spark, path) for a in line for b in line if a != b]
    return spark.createDataFrame(pairs, "word string, other string").distinct()
