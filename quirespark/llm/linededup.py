"""Line deduplication by winnowing over line hashes.

A document's lines (stripped; blank ones skipped) become hashes. Every ``gram`` consecutive lines make one gram; in each
window of ``window`` grams the smallest gram hash is selected, the last of equal ones. So every run of
``least = gram + window - 1`` lines has a fingerprint that depends on its own lines only: wherever the run stands again, the
same gram of it is selected. Positions of a fingerprint meet by a join; one that stands nowhere else ends there.

A match is extended both ways from its fingerprint to the runs of ``least`` lines that it was selected for, and each of those
is looked for among all places, by its first one in the order of id, text hash and position. A longer repeated run is the union
of such runs, so the extension reaches as far as the texts agree, whichever of many places they agree with, and no pair of
places is ever listed. Every run that is not the first of its kind is deleted, with the blank lines inside it.

A run is long by its words as well: each line of ``LEAST_WORDS`` words, and each two lines in a row that together have as many,
are fingerprints and runs of their own. So a line goes exactly if some run that holds it, of ``least`` lines or
``LEAST_WORDS`` words or more, stands at an earlier place too. Places may overlap: of five equal lines the first stays.

Runs are compared by 128 bits of their lines' hashes of 128 bits. Null and empty texts have no lines and stay as they are; a
text of any length is taken whole. Rows with the same id and text are one document: they get the same result and do not delete
each other's lines. Null ids come first in the order. An empty table gives none. Other columns pass through, whatever their
names; ``n_lines`` and ``n_deleted_lines`` replace columns of the same names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quirespark.llm.common import arrow_schema, dropped, map_rows, slices, text_key, utf8, with_columns, written

GRAM = 2
WINDOW = 2
#: A run of so many words is deleted, whatever the number of its lines.
LEAST_WORDS = 20

_digest = xxhash.xxh3_128_digest


def stripped(raw: bytes) -> list[bytes]:
    """The lines that are not blank."""
    return [x for x in map(bytes.strip, raw.split(b"\n")) if x]


def fingerprints(marks: list[bytes], gram: int = GRAM, window: int = WINDOW) -> list[tuple[bytes, int, bytes]]:
    """``(gram hash, first, runs)`` of each selected gram; ``runs`` joins the hashes of the runs it stands for.

    Those runs of ``gram + window - 1`` lines begin at ``first`` and at the lines behind it, one after the other.
    """
    least = gram + window - 1
    grams = [_digest(b"".join(marks[i : i + gram])) for i in range(len(marks) - gram + 1)]
    out: list[tuple[bytes, int, bytes]] = []
    before = -1
    for first in range(len(marks) - least + 1):
        at = min(range(first + window - 1, first - 1, -1), key=grams.__getitem__)
        run = _digest(b"".join(marks[first : first + least]))
        if at == before:
            out[-1] = (out[-1][0], out[-1][1], out[-1][2] + run)
        else:
            out.append((grams[at], first, run))
            before = at
    return out


def wordy(lines: list[bytes], marks: list[bytes], least_words: int = LEAST_WORDS) -> list[tuple[bytes, int, int]]:
    """``(hash, position, lines)`` of each line with ``least_words`` words, and of each two in a row with as many."""
    counts = [len(x.split()) for x in lines]
    found = []
    for i, n in enumerate(counts):
        if n >= least_words:
            found.append((_digest(marks[i], 1), i, 1))
        if i + 1 < len(counts) and n + counts[i + 1] >= least_words:
            found.append((_digest(marks[i] + marks[i + 1], 2), i, 2))
    return found


def occurrences(docs: DataFrame, key: str, text: str, gram: int, window: int) -> DataFrame:
    """Rows ``(gram, id, th, at, lines, runs)``: a fingerprint, and the runs of so many lines from ``at`` on that it stands for."""
    ddl = f"gram binary, id {docs.schema[key].dataType.simpleString()}, th long, at int, lines int, runs binary"
    schema = arrow_schema(ddl)
    least = gram + window - 1

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            row, grams, ats, sizes, runs = [], [], [], [], []
            for i, raw in enumerate(utf8(batch.column(2))):
                lines = stripped(raw)
                marks = [_digest(x) for x in lines]
                own = [(g, at, least, run) for g, at, run in fingerprints(marks, gram, window)]
                own += [(g, at, size, g) for g, at, size in wordy(lines, marks)]
                for g, at, size, run in own:
                    row.append(i)
                    grams.append(g)
                    ats.append(at)
                    sizes.append(size)
                    runs.append(run)
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(grams, pa.binary()), batch.column(0).take(take), batch.column(1).take(take), pa.array(ats, pa.int32()), pa.array(sizes, pa.int32()), pa.array(runs, pa.binary())], schema=schema)

    return map_rows(docs.select(F.col(key).alias("id"), text_key(text).alias("th"), F.col(text).cast("string").alias("text")), ddl, found)


def covered(found: DataFrame) -> DataFrame:
    """Rows ``(id, th, runs)``: the lines, as ``[a, b)``, of runs that stand at an earlier place too.

    Counts and first places are aggregates, combined before their exchange and written to the shared folder: where a hot run
    has many places, adaptive execution splits the join, as both of its sides are plain exchanges. Joins are by sorted exchanges at
    every size: Spark would judge a broadcast by the size of a compressed file.
    """
    spark = found.sparkSession
    again, again_path = written(found.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "grams")
    met, met_path = written(found.join(again.hint("merge"), "gram").drop("gram"), "met")
    number = F.explode(F.sequence(F.lit(0), (F.octet_length("runs") / 16).cast("int") - 1)).alias("i")
    places = met.select("id", "th", "at", "lines", "runs", number).select(F.expr("substring(runs, 16 * i + 1, 16)").alias("run"), "id", "th", (F.col("at") + F.col("i")).alias("at"), "lines")
    first, first_path = written(places.groupBy("run").agg(F.min(F.struct("id", "th", "at")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "first")
    later = places.join(first.hint("merge"), "run").where(~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("th") == F.col("first.th")) & (F.col("at") == F.col("first.at"))))
    spans = later.groupBy("id", "th").agg(F.collect_set(F.struct(F.col("at").alias("a"), (F.col("at") + F.col("lines")).alias("b"))).alias("runs"))
    runs, _ = written(spans, "runs")
    dropped(spark, again_path, met_path, first_path)
    return runs


def without_runs(raw: bytes, runs: list[tuple[int, int]]) -> tuple[bytes, int]:
    """The text without the lines of the runs and the blank lines between two lines of a run, and how many lines went."""
    joined: list[list[int]] = []
    for a, b in sorted(runs):
        if joined and a < joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b])
    if not joined:
        return raw, 0
    out, number, deleted = [], 0, 0
    spans = iter(joined)
    span = next(spans)
    for line in raw.split(b"\n"):
        blank = not line.strip()
        while span and number >= span[1]:
            span = next(spans, None)
        inside = span is not None and (span[0] < number < span[1] if blank else span[0] <= number < span[1])
        if not inside:
            out.append(line)
        elif not blank:
            deleted += 1
        number += not blank
    return b"\n".join(out), deleted


def line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``docs`` with later repeated runs of lines deleted from ``text``, and ``n_lines``, ``n_deleted_lines`` (long) added."""
    runs = covered(occurrences(docs, key, text, gram, window)).select(F.col("id").alias("__quire_id"), F.col("th").alias("__quire_th"), F.col("runs").alias("__quire_runs"))
    keyed = docs.withColumn("__quire_key", text_key(text))
    joined = keyed.join(runs.hint("merge"), keyed[key].eqNullSafe(runs["__quire_id"]) & (keyed["__quire_key"] == runs["__quire_th"]), "left").select(*[F.col(f"`{c}`") for c in docs.columns], "__quire_runs")
    names = docs.columns
    ddl_schema = with_columns(docs.schema, text, "n_lines", "n_deleted_lines")
    schema = to_arrow_schema(ddl_schema)

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = names.index(text)
        for batch in slices(batches, text):
            raw = batch.column(where).to_pylist()
            spans = batch.column(len(names)).to_pylist()
            texts, lines, deleted = [], [], []
            for one, gaps in zip(raw, spans):
                data = (one or "").encode()
                new, n = without_runs(data, [(g["a"], g["b"]) for g in gaps]) if gaps else (data, 0)
                texts.append(one if not n else new.decode())
                lines.append(len(stripped(data)))
                deleted.append(n)
            made = {text: pa.array(texts, pa.string()), "n_lines": pa.array(lines, pa.int64()), "n_deleted_lines": pa.array(deleted, pa.int64())}
            yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else batch.column(names.index(f.name)) for f in schema], schema=schema)

    return map_rows(joined, ddl_schema, applied)
