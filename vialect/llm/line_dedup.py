"""Line dedup over levelled sorted runs of line hashes.

The index is a list of runs. A run is a table of (128-bit line hash, smallest document) with one file a bucket, each
sorted by the hash, and no hash is in two runs. A batch of documents is grouped by hash and merge-joined with every run,
whose files are read in their order, so that a run is neither shuffled nor sorted. The hashes that no run holds become a
new run of level 0, also those of the last batch. When a level has ``FANOUT`` runs they are compacted into one run of the
next level, so a new batch meets a number of runs that grows with the logarithm of the batches. Batches come in rising
order of the document key, so the document a run names is the first. The joins are left joins that keep the first document
of a known hash; what they find unknown, the anti-join, is what the batch adds. An index in a folder can be opened again,
in another session too, and the next corpus joined with it.
"""

from __future__ import annotations

import string
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vialect.llm.common import arrow_batches, exists, named_table, new_path, written

#: Runs of a level before they are merged; least batches of a table and most documents of one; least code points of a key.
FANOUT, BATCHES, BATCH_DOCS, LEAST = 2, 3, 100_000_000, 10
BLANK = " \t\n\x0b\x0c\r"
#: With this setting Spark takes files of buckets as sorted, as they are where a bucket has one file.
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANK)), string.ascii_uppercase, string.ascii_lowercase)


@contextmanager
def _in_order(spark: SparkSession) -> Iterator[None]:
    """Bucket files count as sorted for plans that are made meanwhile; the caller's setting comes back."""
    before = spark.conf.get(ORDERED)
    spark.conf.set(ORDERED, "true")
    try:
        yield
    finally:
        spark.conf.set(ORDERED, before)


class LineIndex:
    """Levelled runs in a folder that driver and executors share; a manifest lists them, a version for each change.

    Without a folder the index lasts as long as the session's intermediate tables.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, fanout: int = FANOUT):
        self.spark, self.fanout, self.version = spark, fanout, 0
        self.folder = folder.rstrip("/") if folder else new_path(spark, "line_index")
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[DataFrame, str, int]]] = []
        if exists(spark, f"{self.folder}/manifest"):
            listed = spark.read.parquet(f"{self.folder}/manifest").orderBy("version", "level", "at").collect()  # a few runs a version
            self.version = listed[-1]["version"]
            for r in listed:
                if r["version"] == self.version and r["path"]:
                    self.levels += [[] for _ in range(r["level"] + 1 - len(self.levels))]
                    self.levels[r["level"]].append((self._table(r["path"], r["buckets"]), r["path"], r["buckets"]))

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run, _, _ in level]

    def _table(self, path: str, buckets: int) -> DataFrame:
        name = named_table(f"line_run_{uuid.uuid4().hex}")
        self.spark.sql(f"CREATE TABLE {name} (h1 BIGINT, h2 BIGINT, first BIGINT) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {buckets} BUCKETS LOCATION '{path}'")
        return self.spark.table(name)

    def _run(self, rows: DataFrame) -> tuple[DataFrame, str, int]:
        """Writes a run: rows are dealt as the buckets are, so each task writes the one file of a bucket."""
        name, path = named_table(f"line_run_{uuid.uuid4().hex}"), f"{self.folder}/{uuid.uuid4().hex}"
        dealt = rows.select("h1", "h2", "first").repartition(self.buckets, "h1", "h2")
        dealt.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable(name)
        return self.spark.table(name), path, self.buckets

    def firsts(self, own: DataFrame) -> DataFrame:
        """``own`` (h1, h2, ...) with ``known``: the first document by the runs, null where no run has the hash."""
        for k, run in enumerate(self.runs()):
            own = own.join(run.select("h1", "h2", F.col("first").alias(f"_r{k}")), ["h1", "h2"], "left")
        names = [f"_r{k}" for k in range(len(self.runs()))]
        return own.withColumn("known", F.coalesce(*names) if names else F.lit(None).cast("long")).drop(*names)

    def add(self, new: DataFrame) -> None:
        """Adds (h1, h2, first) of hashes that no run holds, then merges levels that are full."""
        run, level = self._run(new), 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fanout:
                break
            merged = self.levels[level][0][0]
            for other, _, _ in self.levels[level][1:]:
                merged = merged.unionByName(other)
            run, self.levels[level], level = self._run(merged), [], level + 1
        self.version += 1
        rows = [(self.version, level, at, path, n) for level, runs in enumerate(self.levels) for at, (_, path, n) in enumerate(runs)]
        self.spark.createDataFrame(rows, "version int, level int, at int, path string, buckets int").coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")


def occurrences(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = LEAST) -> DataFrame:
    """A row for each line whose key counts: doc, t (hash of the text, to tell rows of one key apart), pos, h1, h2."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = docs.select(F.col(key).cast("long").alias("doc"), F.xxhash64(body).alias("t"), F.posexplode(F.split(body, "\n", -1)).alias("pos", "line"))
    keys = lines.select("doc", "t", "pos", line_key(F.col("line")).alias("k")).filter(F.length("k") >= least)
    return keys.select("doc", "t", "pos", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(7), F.col("k")).alias("h2"))


def dropped(docs: DataFrame, text: str, key: str, least: int, batches: int, index: LineIndex) -> DataFrame:
    """(doc, t, pos) of the lines that go: those whose key the index or a document of smaller key holds too."""
    spark = docs.sparkSession
    edges = docs.select(F.percentile_approx(F.col(f"`{key}`").cast("long"), [k / batches for k in range(1, batches)], 1000)).head()[0] if batches > 1 else []
    edges = sorted(set(edges or []))
    batch = sum((F.when(F.col("doc") > e, 1).otherwise(0) for e in edges), F.lit(0))
    batch = F.when(F.col("doc").isNull(), F.lit(len(edges))).otherwise(batch)  # documents without key come last
    path = new_path(spark, "lines")
    occurrences(docs, text, key, least).withColumn("batch", batch).write.partitionBy("batch").parquet(path)
    out = []
    for b in range(len(edges) + 1):
        rows = spark.read.schema("doc long, t long, pos int, h1 long, h2 long, batch int").parquet(path).filter(F.col("batch") == b).drop("batch")
        own = rows.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.max(F.col("doc").isNull()).alias("odd"))
        with _in_order(spark):
            found = written(index.firsts(own), "firsts")
        # Only hashes of several documents matter to the lines; Spark splits a hash that has too many of them.
        twice = found.filter(F.col("known").isNotNull() | (F.col("first") < F.col("last")) | (F.col("odd") & F.col("first").isNotNull()))
        both = rows.join(twice.select("h1", "h2", "known", "first"), ["h1", "h2"])
        later = F.when(F.col("known").isNotNull(), ~F.col("known").eqNullSafe(F.col("doc"))).otherwise(F.col("doc").isNull() | (F.col("first") < F.col("doc")))
        out.append(both.filter(later).select("doc", "t", "pos"))
        index.add(found.filter(F.col("known").isNull() & F.col("first").isNotNull()))
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    return rows


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = LEAST, batches: int | None = None, index: LineIndex | None = None) -> DataFrame:
    """``docs`` with the kept text in place of ``text``, n_lines (before) and n_dropped; columns of these names are replaced.

    A null or empty text has one empty line. A key found in one document only, however often, loses nothing. Rows of a
    repeated document key count as one document; documents without key come after all others, lose every line that a
    document with a key holds, and are not in the index. An empty table gives no rows. With an ``index`` the documents are
    its next batches: they come after all that it holds, and lose every line that another document in it has.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    batches = batches or max(BATCHES, -(-docs.count() // BATCH_DOCS))
    index = index or LineIndex(spark)
    gone = dropped(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")), "text", "key", least, batches, index)
    gone = gone.groupBy("doc", "t").agg(F.collect_set("pos").alias("gone"))
    left = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)]).alias("row"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("own"))
    at = kept.index(text)
    both = left.join(gone, left["row"][f"c{kept.index(key)}"].eqNullSafe(gone["doc"]) & (left["own"] == gone["t"]), "left").select("row.*", "gone")

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in found:
            texts, lines, lost = [], [], []
            for body, gone in zip(rows.column(at).to_pylist(), rows.column(len(kept)).to_pylist(), strict=True):
                parts = (body or "").split("\n")
                lines.append(len(parts))
                lost.append(len(gone) if gone else 0)
                if gone:
                    out = set(gone)
                    body = "\n".join(x for i, x in enumerate(parts) if i not in out)
                texts.append(body)
            columns = [*rows.columns[:at], pa.array(texts, rows.column(at).type), *rows.columns[at + 1 : len(kept)]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(lost, pa.int64())], [*kept, "n_lines", "n_dropped"])

    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept]
    return both.mapInArrow(run, ", ".join([*fields, "n_lines long", "n_dropped long"]))


def sha256_hex(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)
