"""What the operators of this subpackage share: shared tables, row batches and row keys."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Output batches are flushed at about so many bytes, so a Python worker holds a bounded piece of its partition.
FLUSH_BYTES = 8 << 20


_own_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder all executors and the driver share: ``spark.checkpoint.dir``.

    Where that is unset and all tasks run in this machine's one process, it is a temporary folder, removed at exit. On a cluster
    an unset folder is an error: executors would not see each other's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that the driver and all executors share (the master is {master})")
    run = spark.sparkContext.applicationId
    if run not in _own_roots:
        _own_roots[run] = tempfile.mkdtemp(prefix="quire-shared-")
        atexit.register(shutil.rmtree, _own_roots[run], ignore_errors=True)
    return "file://" + _own_roots[run]


_cleaned: set[tuple[str, str]] = set()


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there and survives lost executors.

    A result may read the table long after its operator has returned, so what :func:`dropped` has not removed goes when the
    driver's Python ends, with the application's own folder.
    """
    spark = df.sparkSession
    own = f"{shared_root(spark)}/quire-{spark.sparkContext.applicationId}"
    if (spark.sparkContext.applicationId, own) not in _cleaned:
        _cleaned.add((spark.sparkContext.applicationId, own))
        atexit.register(_ended, spark, own)
    path = f"{own}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def _ended(spark: SparkSession, own: str) -> None:
    """Remove an application's folder, if its session still answers."""
    try:
        dropped(spark, own)
    except Exception:  # noqa: BLE001  the gateway may be gone before the interpreter ends; the folder's owner clears it then
        pass


def dropped(spark: SparkSession, *paths: str) -> None:
    """Remove tables that :func:`written` made and that no later plan reads."""
    jvm = spark._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep Arrow batches small for tables of long texts; a smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def utf8(column: pa.Array) -> list[bytes]:
    """A string or binary Arrow column as bytes; null becomes empty."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary())
    return [b"" if x is None else x for x in column.to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], text: str, most_bytes: int = FLUSH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut incoming batches into runs of rows with at most ``most_bytes`` of ``text`` each (one row at least)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pc.binary_length(column).to_pylist() if len(column) else []
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + (n or 0) > most_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n or 0
        if len(sizes) > start:
            yield batch.slice(start)


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a Spark DDL string."""
    return to_arrow_schema(StructType.fromDDL(ddl))


def with_columns(schema: StructType, text: str, *longs: str) -> StructType:
    """``schema`` with ``text`` as a string and the columns ``longs``, which replace columns of the same names."""
    kept = [StructField(f.name, StringType() if f.name == text else f.dataType, f.nullable or f.name == text) for f in schema.fields if f.name not in longs]
    return StructType(kept + [StructField(c, LongType()) for c in longs])


def map_rows(df: DataFrame, ddl: str, make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``mapInArrow`` with the session's batches held small."""
    bounded_batches(df.sparkSession)
    return df.mapInArrow(make, ddl)


def kept_columns(keep: Iterable[str], own: Iterable[str]) -> tuple[str, ...]:
    """The columns of ``keep``, each once, without those that the operator makes itself: a clashing column gives way to the operator's."""
    made = {c.lower() for c in own}
    return tuple(c for c in dict.fromkeys(keep) if c.lower() not in made)


def names_of(ddl: str) -> list[str]:
    """The column names of a DDL string."""
    return StructType.fromDDL(ddl).fieldNames()


def text_key(text: str = "text") -> Column:
    """64 bits of the text's hash: with the document's id it names a row, whatever order a table is read in.

    Rows with the same id and the same text are one document to the operators; each of them gets the same result. Rows
    without an id are named by these bits alone.
    """
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """Connected components of an undirected edge table ``(a, b)`` of longs: rows ``(node, root)``, root the smallest node.

    Large-star and small-star rounds over the edge table, each written to the shared folder, until the star edges no longer
    change. The least neighbour of each node is an aggregate, combined before its exchange and written before it is joined, so
    both sides of the join are plain exchanges and adaptive execution can split the rows of a hub.
    """
    spark = edges.sparkSession
    now, path = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    for _ in range(most_rounds):
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low, low_path = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        # A node and its larger neighbours take the node's least neighbour.
        large, large_path = written(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "edges")
        least, least_path = written(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(least, "u")
        step = small.select("u", F.col("m").alias("v")).unionAll(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        after, after_path = written(step, "edges")
        row = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        dropped(spark, path, low_path, large_path, least_path)
        now, path = after, after_path
        if (row["n"], row["h"]) == state:
            break
        state = (row["n"], row["h"])
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
