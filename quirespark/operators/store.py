"""Tables that change: each change is a new DataFrame, and a snapshot folder makes it lasting.

A snapshot is a folder of its own below the table's; the newest complete one is the table. Readers keep the snapshot they
have begun with, and a writer that dies leaves no half-written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STATUSES = ("Underway", "Complete", "Indexed", "Failed")


def upserted(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with the rows of ``changes`` in place of those with the same keys."""
    return table.join(changes.select(*keys).distinct(), keys, "left_anti").select(*table.columns).unionByName(changes.select(*table.columns))


def deleted(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(gone.select(*keys).distinct(), keys, "left_anti").select(*table.columns)


#: Rows of one change that are numbered in one window.
MOST_APPENDED = 100_000


def appended(table: DataFrame, rows: DataFrame, sequence: str, order: str, most: int = MOST_APPENDED) -> DataFrame:
    """``rows`` added with the next numbers of ``sequence``, in ``order``; for the rows of one change, of which ``most`` are allowed."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"over {most} rows in one change; number a bulk load before it is appended")
    last = table.agg(F.coalesce(F.max(sequence), F.lit(0)).alias("__last"))
    numbered = rows.withColumn("__n", F.row_number().over(Window.orderBy(order))).join(F.broadcast(last)).withColumn(sequence, (F.col("__last") + F.col("__n")).cast("long"))
    return table.unionByName(numbered.select(*table.columns))


def latest_revisions(documents: DataFrame) -> DataFrame:
    """The newest row of each reference."""
    rest = [c for c in documents.columns if c not in ("reference", "rev")]
    return documents.groupBy("reference").agg(F.max(F.struct("rev", *rest)).alias("d")).select("reference", "d.*").select(*documents.columns)


def cascaded(document_revs: DataFrame, pages: DataFrame, rows: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages, rows and words without those of deleted document revisions."""
    return tuple(t.join(document_revs.select("rev").distinct(), "rev", "left_anti") for t in (pages, rows, words))


def marked(indexed: DataFrame, refs: DataFrame | None, how: str = "Yes") -> DataFrame:
    """``indexed`` with ``reindex`` set for ``refs``, or for all."""
    if refs is None:
        return indexed.withColumn("reindex", F.lit(how))
    here = refs.select(F.col("reference").alias("__ref")).distinct()
    return indexed.join(here, F.col("reference") == F.col("__ref"), "left").withColumn("reindex", F.when(F.col("__ref").isNotNull(), how).otherwise(F.col("reindex"))).drop("__ref")


def with_status(documents: DataFrame, revs: DataFrame, status: str, reason: str | None = None) -> DataFrame:
    """``documents`` with the status of some revisions changed."""
    if status not in STATUSES:
        raise ValueError(f"{status} is not one of {STATUSES}")
    here = revs.select(F.col("rev").alias("__rev")).distinct()
    joined = documents.join(here, F.col("rev") == F.col("__rev"), "left")
    hit = F.col("__rev").isNotNull()
    return joined.withColumns({"status": F.when(hit, status).otherwise(F.col("status")), "failure_reason": F.when(hit, F.lit(reason)).otherwise(F.col("failure_reason"))}).drop("__rev")


def failed_at_start(documents: DataFrame, indexed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What was underway when the process ended has failed, and is not tried again by itself."""
    lost = documents.where("status = 'Underway'")
    unmarked = indexed.join(lost.select(F.col("reference").alias("__ref")).distinct(), F.col("reference") == F.col("__ref"), "left")
    unmarked = unmarked.withColumn("reindex", F.when(F.col("__ref").isNotNull(), "No").otherwise(F.col("reindex"))).drop("__ref")
    hit = F.col("status") == "Underway"
    return documents.withColumns({"failure_reason": F.when(hit, "Unknown").otherwise(F.col("failure_reason")), "status": F.when(hit, "Failed").otherwise(F.col("status"))}), unmarked


def query_row(spark: SparkSession, username: str, criterion, sort: str, first: int, most: int, total: int) -> DataFrame:
    """A row of the query log; ``query`` is the first query string of the criteria."""
    asked = criterion.contains()
    row = [(username, criterion.to_json(), asked.query if asked else None, sort, first, most, total)]
    return spark.createDataFrame(row, "username string, criteria string, query string, sort string, first_result int, max_result int, result_count long").withColumn("executed", F.current_timestamp())


def request_row(spark: SparkSession, username: str, ip: str | None, method_and_url: str, querystring: str | None) -> DataFrame:
    """A row of the request log."""
    row = [(username, ip, method_and_url, querystring)]
    return spark.createDataFrame(row, "username string, ip string, method_and_url string, querystring string").withColumn("created", F.current_timestamp())


def with_preferences(preferences: DataFrame, changes: DataFrame) -> DataFrame:
    """``preferences`` (username, key, preference) with those of ``changes`` added or put in the place of what was."""
    return upserted(preferences, changes, ["username", "key"])


def without_preferences(preferences: DataFrame, gone: DataFrame) -> DataFrame:
    """``preferences`` without those of ``gone`` (username, key)."""
    return deleted(preferences, gone, ["username", "key"])


def removed(documents: DataFrame, pages: DataFrame, rows: DataFrame, words: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The four tables without the newest revision of each document of ``refs`` (reference); earlier revisions stay.

    The entries of the index go by ``indexing.Segments.upsert`` with the references as what is gone.
    """
    here = refs.select("reference").distinct()
    revs = documents.join(here, "reference", "left_semi").groupBy("reference").agg(F.max("rev").alias("rev")).select("rev")
    return documents.join(revs, "rev", "left_anti").select(*documents.columns), *cascaded(revs, pages, rows, words)


def preference(preferences: DataFrame, username: str, key: str) -> DataFrame:
    return preferences.where((F.col("username") == username) & (F.col("key") == key)).select("preference")


def saved(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> str:
    """Write the next snapshot of a table; Spark's ``_SUCCESS`` makes it complete."""
    number = len(snapshots(df.sparkSession, path))
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}/v{number:08d}")
    return f"{path}/v{number:08d}"


def snapshots(spark: SparkSession, path: str) -> list[str]:
    """The complete snapshots of a table, the oldest first; any store that Spark reads will do."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(root, "v*/_SUCCESS"))
    return sorted(x.getPath().getParent().toString() for x in found) if found else []


def current(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(snapshots(spark, path)[-1])
