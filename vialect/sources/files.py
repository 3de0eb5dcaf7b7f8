"""Readers and writers of the engine's tables and files; schemas are declared, never inferred."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vialect import schemas


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.LINES).parquet(path)


def read_lines_jdbc(spark: SparkSession, url: str, table: str = "planet_osm_line", partitions: int = 8, **options: str) -> DataFrame:
    """Lines from a database; geometry as text in well-known form, tags as JSON text. Split over partitions by a hash of the name."""
    query = f"SELECT name, highway, hstore_to_json(tags)::text AS tags, ST_AsText(way) AS way FROM {table} WHERE name IS NOT NULL AND highway IS NOT NULL"
    slices = [f"mod(abs(hashtext(name)::bigint), {partitions}) = {k}" for k in range(partitions)]
    rows = spark.read.jdbc(url, f"({query}) AS lines", predicates=slices, properties=options)
    return rows.select("name", "highway", F.from_json("tags", "map<string,string>").alias("tags"), parse_line(F.col("way")).alias("way"))


def parse_line(wkt: Column) -> Column:
    """The points of LINESTRING text; null for anything else."""
    inner = F.regexp_extract(wkt, r"^\s*LINESTRING\s*\(([^()]*)\)\s*$", 1)
    points = F.transform(F.split(F.trim(inner), r"\s*,\s*"), lambda p: F.struct(F.split(p, r"\s+")[0].cast("double").alias("x"), F.split(p, r"\s+")[1].cast("double").alias("y")))
    return F.when((inner != "") & inner.isNotNull(), points)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header line and doubled quotes; an empty field is null."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def read_lengths(spark: SparkSession, path: str) -> DataFrame:
    """Lengths by position: rows of fewer than four fields are dropped, more fields ignored, names trimmed; a number that can't be read fails."""
    raw = spark.read.schema("a string, b string, c string, d string").option("header", True).option("enforceSchema", True).option("escape", '"').csv(path)
    rows = raw.filter("d is not null")
    return rows.select(F.regexp_replace("a", r"^\s+|\s+$", "").alias("name"), F.col("b").cast("double").alias("total_m"), F.col("c").cast("bigint").alias("segments_count"), F.col("d").cast("bigint").alias("street_count"))


def read_or_empty(spark: SparkSession, path: str, schema: str, form: str = "parquet") -> DataFrame:
    """A table, or an empty one if there is nothing at the path."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    return spark.read.schema(schema).format(form).load(path) if there else spark.createDataFrame([], schema)


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header; for reports and rollups, which one task can write."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Indented JSON of each row."""
    df.select(F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"})).coalesce(1).write.mode("overwrite").text(path)


def append_cache(new: DataFrame, path: str) -> None:
    new.write.mode("append").parquet(path)


def report(lengths: DataFrame) -> Iterator[str]:
    """Lines of a report, a partition at a time: metres to three places, counts and names."""
    text = F.format_string("%.3f m | %d segments | %d streets | %s", "total_m", "segments_count", "street_count", F.coalesce("name", F.lit("<NULL>")))
    return (r[0] for r in lengths.select(text).toLocalIterator())


def printed(lengths: DataFrame, n: int = 20) -> list[str]:
    """The first lines of a report."""
    return list(report(lengths.limit(n)))
