"""Usage statistics over the query log."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELS = {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}


def _within(log: DataFrame, start: str, end: str) -> DataFrame:
    """From the start to the end of the last day. The bounds are of the column's own type, so they reach the scan."""
    after = (datetime.date.fromisoformat(end) + datetime.timedelta(days=1)).isoformat()
    kind = log.schema["executed"].dataType.simpleString()
    return log.where((F.col("executed") >= F.lit(start).cast(kind)) & (F.col("executed") < F.lit(after).cast(kind)))


def usage(log: DataFrame, unit: str, start: str, end: str) -> DataFrame:
    """Rows ``(label, users, queries)`` by day, month or year, the newest first; ``log`` has id, username and executed."""
    label = F.date_format(F.date_trunc(unit, "executed"), LABELS[unit])
    found = _within(log, start, end).groupBy(label.alias("label")).agg(F.countDistinct("username").alias("users"), F.countDistinct("id").alias("queries"))
    return found.orderBy(F.desc("label"))


def top_users(log: DataFrame, start: str, end: str, most: int) -> DataFrame:
    """Rows ``(username, n)``, the busiest first, then by name."""
    return _within(log, start, end).groupBy("username").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "username").limit(most)
