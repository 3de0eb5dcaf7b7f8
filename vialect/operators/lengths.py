"""Length and count rollups over line segments, and counts about the table itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vialect.functions import geo
from vialect.operators.graph import stored
from vialect.operators.spatial import segment_components
from vialect.settings import DEFAULTS


def named(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("name").isNotNull() & F.col("highway").isNotNull())


def rollup(segments: DataFrame, name: str = "name", length: str = "length_m", cluster: str = "cluster_id") -> DataFrame:
    """Per name: total length, segments and distinct clusters; longest first, nulls before all, ties by name."""
    out = segments.groupBy(name).agg(F.sum(length).alias("total_m"), F.count(F.lit(1)).alias("segments_count"), F.count_distinct(cluster).alias("street_count"))
    return out.orderBy(F.desc_nulls_first("total_m"), name)


def street_lengths(lines: DataFrame, eps: float = DEFAULTS.cluster_eps, spheroid: bool = True) -> DataFrame:
    """Lengths of all names from Web Mercator lines: geodesic metres, and clusters of segments within ``eps`` metres."""
    # Ids are stored before two branches read them: a scan that is repeated might number its rows otherwise.
    rows = stored(named(lines).withColumn("line_id", F.monotonically_increasing_id()))
    measured = rows.withColumn("length_m", geo.geodesic_length(F.col("way")) if spheroid else geo.haversine_length(F.col("way")))
    clusters = segment_components(rows.select("line_id", "name", geo.to_metric(F.col("way")).alias("way")), eps)
    return rollup(measured.join(clusters, "line_id", "left"))


def untagged(lines: DataFrame, tag: str = DEFAULTS.etymology_tag) -> DataFrame:
    """Distinct names with a segment that lacks the tag, in order."""
    return named(lines).filter(F.try_element_at("tags", F.lit(tag)).isNull()).select("name").distinct().orderBy("name")


def tag_counts(lines: DataFrame, tag: Column) -> DataFrame:
    """Distinct names, and distinct names with the tag."""
    return lines.agg(F.count_distinct("name").alias("total_street_names"), F.count_distinct(F.when(tag.isNotNull(), F.col("name"))).alias("etymology_tagged"))


def metadata_value(metadata: DataFrame, key: str) -> DataFrame:
    return metadata.filter(F.col("key") == key).select("value")


def upsert(metadata: DataFrame, new: DataFrame) -> DataFrame:
    """The union, where a new row replaces that of its key; of several new rows of a key the largest value stays."""
    both = metadata.select("key", "value", F.lit(0).alias("_new")).unionByName(new.select("key", "value", F.lit(1).alias("_new")))
    order = Window.partitionBy("key").orderBy(F.desc("_new"), F.desc("value"))
    return both.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select("key", "value")
