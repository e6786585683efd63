"""Best-fit packing planned on the histogram of lengths.

Documents become token pieces of at most ``capacity`` tokens. Only the count of pieces of each length (at most ``capacity``
numbers) reaches the driver, where best-fit decreasing runs over counts: equal sequences form one group, and a step moves a
whole group. The plan is a table of slots by (length, rank); the pieces get their rank within their length by a sum of
counts over scan partitions and join the plan on length and rank. No step sorts or gathers the pieces themselves.

Null and empty texts become the end token alone; a text of any length is taken whole, in as many pieces as it needs. Repeated
rows are packed each; which of equal lengths goes where is left to the order of a scan. An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirespark.llm.bpe import encoder
from quirespark.llm.common import arrow_schema, map_rows, slices, utf8, written

CAPACITY = 4096
END = 1


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit decreasing over ``{length: count}``.

    Gives slots ``(length, rank, end, sequence, each, offset)``: the pieces of a length with ranks from ``rank`` to before
    ``end`` go, ``each`` to a sequence, to sequences from ``sequence`` on, the first at ``offset`` and the others behind it;
    and the number of sequences. A group of equal sequences is split at most once a length, so the slots are bounded by the
    capacity (a group's room at least halves when it is used), whatever the counts.
    """
    slots: list[tuple[int, int, int, int, int, int]] = []
    groups: list[tuple[int, int, int]] = []  # (room, first sequence, sequences), by room
    made = 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        if not 0 < length <= capacity:
            raise ValueError("a piece has from 1 to the capacity's tokens")
        while left:
            at = bisect_left(groups, (length, -1, -1))
            if at == len(groups):
                each = capacity // length
                new = -(-left // each)
                groups.append((capacity, made, new))
                made += new
                at = len(groups) - 1
            room, first, n = groups.pop(at)
            each = room // length
            whole = min(n, left // each)
            offset = capacity - room
            if whole:
                slots.append((length, rank, rank + whole * each, first, each, offset))
                insort(groups, (room - each * length, first, whole))
                rank, left, first, n = rank + whole * each, left - whole * each, first + whole, n - whole
            if n and left:
                slots.append((length, rank, rank + left, first, left, offset))
                insort(groups, (room - left * length, first, 1))
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            if n:
                insort(groups, (room, first, n))
    return slots, made


def token_pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Rows ``(key, piece, start, length, ids_crc32, part, local)``; ``local`` counts the pieces of a length in a partition."""
    ddl = f"{key} {docs.schema[key].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, part int, local long"
    schema = arrow_schema(ddl)
    last = end.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(tokenizer)
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in slices(batches, "text"):
            row, pieces, starts, lengths, crcs, local = [], [], [], [], [], []
            for i, raw in enumerate(utf8(batch.column(1))):
                data = b"".join(map(ids.__getitem__, raw.split())) + last
                for number, at in enumerate(range(0, len(data), 4 * capacity)):
                    one = data[at : at + 4 * capacity]
                    length = len(one) // 4
                    row.append(i)
                    pieces.append(number)
                    starts.append(at // 4)
                    lengths.append(length)
                    crcs.append(zlib.crc32(one))
                    local.append(seen.get(length, 0))
                    seen[length] = local[-1] + 1
            columns = (pieces, starts, lengths, crcs, [part] * len(row), local)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, schema.types[1:]))], schema=schema)

    return map_rows(docs.select(key, F.col(text).cast("string").alias("text")), ddl, cut)


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` (long) in place of ``part`` and ``local``.

    Driver and broadcast hold the histogram and the slots, both bounded by ``capacity``; the counts of a length in each
    partition are summed by a window of one row a partition. The pieces' one exchange is on (partition, length).
    """
    spark = pieces.sparkSession
    table, _ = written(pieces, "pieces")
    counts = table.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots, _ = best_fit(histogram, capacity)
    plan = spark.createDataFrame(slots, "length long, rank long, `end` long, sequence long, each long, base long")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = table.join(bases, ["length", "part"]).withColumn("place", F.col("first") + F.col("local"))
    met = ranked.join(F.broadcast(plan.withColumnRenamed("length", "of")), (F.col("length") == F.col("of")) & (F.col("place") >= F.col("rank")) & (F.col("place") < F.col("end")))
    step = F.col("place") - F.col("rank")
    out = [c for c in pieces.columns if c not in ("part", "local")]
    return met.select(*out, (F.col("sequence") + F.floor(step / F.col("each"))).cast("long").alias("sequence_id"), (F.col("base") + F.pmod(step, F.col("each")) * F.col("length")).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Per piece: key, piece, start, length, ids_crc32, sequence_id and offset."""
    return packed(token_pieces(docs, tokenizer, key, text, capacity, end), capacity)
