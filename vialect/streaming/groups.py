"""Names that keep arriving: grouping without state, and windowed counts of groups. An extension; all else is batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vialect.functions.text import suffix_key


def grouped_stream(names: DataFrame, name: str = "name") -> DataFrame:
    """The suffix-stripping group of each arriving name; names without one are dropped."""
    return names.withColumn("group_id", suffix_key(F.col(name))).filter("group_id <> ''")


def windowed_counts(names: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Names of each group in each window of event time; rows later than ``late`` don't count."""
    rows = grouped_stream(names).withWatermark(time, late)
    return rows.groupBy(F.window(time, width), "group_id").agg(F.count(F.lit(1)).alias("n")).select("window.start", "window.end", "group_id", "n")
