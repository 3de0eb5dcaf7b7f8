"""Groups of names with their totals and representatives, and the mapping of names to groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def groups(rows: DataFrame) -> DataFrame:
    """From (name, total_m, segments_count, street_count, pos, group_id): one row for each group that isn't empty.

    The representative is the longest name, the earliest of equal ones, and null if no length is positive; variants keep
    the order of ``pos``.
    """
    longest = F.max_by(F.when(F.col("total_m") > 0, F.col("name")), F.when(F.col("total_m") > 0, F.struct("total_m", -F.col("pos"))))
    return (
        rows.filter("group_id <> ''")
        .groupBy("group_id")
        .agg(
            longest.alias("representative"),
            F.bround(F.sum("total_m"), 1).alias("total_length"),
            F.sum("segments_count").alias("segment_count"),
            F.sum("street_count").alias("street_count"),
            F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("variants"),
        )
    )


def mapping(rows: DataFrame) -> DataFrame:
    """(name, group_id) of every name with a group; the last of repeated names counts."""
    return rows.filter("group_id <> ''").groupBy("name").agg(F.max_by("group_id", "pos").alias("group_id"))


def nested(rows: DataFrame, method: str) -> DataFrame:
    """Mapping and groups of a method as one row of two maps, for JSON; made at the sink only."""
    whole = groups(rows).agg(F.map_from_entries(F.collect_list(F.struct("group_id", F.struct("representative", "total_length", "segment_count", "street_count", "variants")))).alias("groups"))
    pairs = mapping(rows).agg(F.map_from_entries(F.collect_list(F.struct("name", "group_id"))).alias("mapping"))
    return pairs.crossJoin(whole).select(F.lit(method).alias("method"), "mapping", "groups")
