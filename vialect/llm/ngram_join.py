"""N-gram Jaccard join: MinHash banding, then verification on full n-gram sets.

Texts with equal n-gram sets are one class. The number of bands and of rows in a band follow from the recall that a pair
just at the threshold must reach. Classes are shuffled on their band hashes; a band hash ties its classes to the smallest
of them, so that a bucket of m classes gives m - 1 ties and no pairs. Tied classes form neighbourhoods, and within these
every pair is verified exactly: a neighbourhood is dealt into blocks of bounded size, every two blocks meet in one task,
and that task counts common n-grams for all its pairs at once - frequent n-grams by a matrix product, rare ones by their
lists. It returns the number of links of each class and a forest of its links, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vialect.llm.common import arrow_batches, mix, written
from vialect.llm.components import components

N, THRESHOLD, RECALL, HASHES = 5, Fraction(4, 5), 0.9999, 200
#: Most n-grams and classes, about, of a block; n-grams held by so many classes go into the matrix product.
BLOCK_GRAMS, BLOCK_CLASSES, FREQUENT = 1_000_000, 2000, 48
_BASE, _SEED = np.uint64(0x9E3779B97F4A7C15), 7
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def bands_and_rows(threshold: float, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """The most rows, and so the fewest false ties, with which at most ``hashes`` hashes reach the recall at the threshold."""
    best = None
    for rows in range(1, 64):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))) if threshold < 1 else 1
        if bands * rows > hashes:
            break
        best = bands, rows
    return best or (hashes, 1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("up", _BASE), ("down", inverse)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def gram_sets(texts: list[str | None], n: int = N) -> list[np.ndarray]:
    """The distinct word n-grams of each text as sorted 64-bit hashes.

    Words are what stands between white space, lower-cased. A text of fewer than n words has one n-gram of all its words;
    a text without words, or null, has none.
    """
    out: list[np.ndarray] = []
    texts = ["" if t is None else t for t in texts]
    low = 0
    while low < len(texts):
        high, size = low, 0
        while high < len(texts) and (high == low or size + len(texts[high]) < 1 << 20):
            size += len(texts[high])
            high += 1
        split = [t.lower().split() for t in texts[low:high]]
        data = np.frombuffer(" ".join([" ".join(w) for w in split if w]).encode("utf-8", "surrogatepass"), np.uint8)
        ends = np.append(np.flatnonzero(data == 32), len(data))
        starts = np.concatenate([np.zeros(1, np.int64), ends[:-1] + 1])
        up, down = _powers(len(data) + 1)
        run = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(data * up[:-1], dtype=np.uint64, out=run[1:])
        at = 0
        for words in split:
            k = len(words)
            if not k:
                out.append(np.zeros(0, np.uint64))
                continue
            first = np.arange(at, at + max(1, k - n + 1))
            s, e = starts[first], ends[first + min(n, k) - 1]
            out.append(np.unique(mix((run[e] - run[s]) * down[s])))
            at += k
        low = high
    return out


class Bands:
    """Band hashes of n-gram sets."""

    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(_SEED)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(1, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, bands * rows, np.uint64)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        least = np.full(self.bands * self.rows, np.iinfo(np.uint64).max, np.uint64)
        for low in range(0, len(grams), 2048):
            np.minimum(least, (grams[low : low + 2048, None] * self.a + self.b).min(0), out=least)
        key = np.arange(1, self.bands + 1, dtype=np.uint64)
        for column in least.reshape(self.bands, self.rows).T:
            key = mix(key * _BASE + column)
        return key.view(np.int64)


def signature(grams: np.ndarray) -> tuple[int, int]:
    """A hash of 128 bits of a set."""
    size = np.uint64(len(grams))
    parts = [mix(mix(grams ^ np.uint64(s)).sum(dtype=np.uint64, keepdims=True).reshape(1) + size)[0] for s in (0x1234567, 0x89ABCDEF01)]
    return tuple(int(p.astype(np.int64)) for p in parts)


def text_hash(text: str) -> Column:
    """Tells rows of one key but of different texts apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def signatures(docs: DataFrame, text: str, key: str, bands: Bands, n: int) -> DataFrame:
    """doc, t (hash of the text), h1, h2 (the set's hash), n_grams and the band keys of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = gram_sets(batch.column(1).to_pylist(), n)
            marks = [signature(s) for s in sets]
            keys = [bands(s) if len(s) else np.zeros(0, np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), *(pa.array([m[k] for m in marks], pa.int64()) for k in (0, 1)), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc", "t", "h1", "h2", "n_grams", "keys"],
            )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc"), F.col(text), text_hash(text).alias("t"))
    return rows.mapInArrow(run, f"doc {kind}, t long, h1 long, h2 long, n_grams long, keys array<long>")


def linked(sets: list[np.ndarray], split: int, threshold: Fraction) -> np.ndarray:
    """Which pairs reach the threshold: rows before ``split`` against the rows from it on, or all against all if it is 0."""
    n, size = len(sets), np.array([len(s) for s in sets], np.int64)
    rows = np.repeat(np.arange(n, dtype=np.int32), size)
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    holders = np.bincount(column)
    top, left = (split or n), split
    common = np.zeros((top, n - left), np.float32)
    frequent = holders >= FREQUENT
    rare = ~frequent[column] & (holders[column] > 1)
    r, c = rows[rare], column[rare]
    for step in range(1, min(FREQUENT, int(holders[~frequent].max(initial=0)))):
        same = c[:-step] == c[step:]
        x, y = r[:-step][same], r[step:][same]
        if not len(x):
            break
        if split:
            cross = (x < split) & (y >= split)
            x, y = x[cross], y[cross] - split
        np.add.at(common.reshape(-1), x.astype(np.int64) * common.shape[1] + y, np.float32(1))
    many = np.flatnonzero(frequent)
    place = np.full(len(holders), -1)
    place[many] = np.arange(len(many))
    r, c = rows[frequent[column]], place[column[frequent[column]]]
    for low in range(0, len(many), 2048):
        part = (c >= low) & (c < low + 2048)
        held = np.zeros((n, min(2048, len(many) - low)), np.float32)
        held[r[part], c[part] - low] = 1
        product = held[:top] @ held[left:].T
        if not split:
            product = np.triu(product, 1)
        common += product
    p, q = threshold.numerator, threshold.denominator
    out = np.empty(common.shape, bool)
    for low in range(0, top, 256):
        total = size[low : min(low + 256, top), None] + size[None, left:]
        out[low : low + 256] = (common[low : low + 256].astype(np.float64) * (p + q) >= p * total) & (total > 0)
    return out if split else np.triu(out, 1) | np.triu(out, 1).T


def _forest(links: np.ndarray, split: int) -> list[tuple[int, int]]:
    """(root, node) for every node that a search from a smaller root reaches; rows and columns are the same nodes if split is 0."""
    n = links.shape[0] + (links.shape[1] if split else 0)
    fresh, out = np.ones(n, bool), []
    for root in range(n):
        if not fresh[root]:
            continue
        fresh[root] = False
        todo = [root]
        while todo:
            x = todo.pop()
            near = links[x] if not split else (links[x] if x < split else links[:, x - split])
            shift = split if split and x < split else 0
            found = np.flatnonzero(near & fresh[shift : shift + len(near)]) + shift
            fresh[found] = False
            todo += found.tolist()
            out += [(root, y) for y in found.tolist()]
    return out


def _verify(rows: pd.DataFrame, n: int, threshold: Fraction) -> pd.DataFrame:
    """The links of the neighbourhoods of a cell: (node, root, links) where root is null for a mere count."""
    out: list[tuple] = []
    sets = dict(zip(rows.index, gram_sets(rows["text"].tolist(), n), strict=True))
    for _, group in rows.groupby("comp", sort=False):
        group = group.sort_values(["blk", "node"])
        i, j = int(group["i"].iloc[0]), int(group["j"].iloc[0])
        split = int((group["blk"] == i).sum()) if i != j else 0
        if i != j and split in (0, len(group)):
            continue
        node, copies = group["node"].to_numpy(), group["copies"].to_numpy(np.float64)
        links = linked([sets[k] for k in group.index], split, threshold)
        if split:
            count = np.concatenate([links @ copies[split:], copies[:split] @ links])
        else:
            count = links @ copies
        out += [(x, None, int(c)) for x, c in zip(node.tolist(), count.tolist(), strict=True) if c]
        out += [(node[b], node[a], 0) for a, b in _forest(links, split)]
    return pd.DataFrame({"node": pd.array([x[0] for x in out], "Int64"), "root": pd.array([x[1] for x in out], "Int64"), "links": pd.array([x[2] for x in out], "Int64")})


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", n: int = N, threshold: Fraction = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """A row for each row of ``docs``: its key, class_id, n_links, copy_of, text_hash and stays.

    ``class_id`` is the smallest key of those that links connect it with, ``copy_of`` the smallest key with its very set
    of n-grams, and ``n_links`` the number of other rows whose Jaccard similarity with it reaches the threshold. Texts
    without words are copies of each other and linked with no others. ``stays`` holds for the rows of one key and text of
    each class: of the smallest key that isn't null, if there is one. Repeated rows count as copies; a null key stays null
    and never names a class unless all keys of the class are null. Pairs at the threshold are found with probability
    ``recall`` each, more similar ones more surely; what is reported has been verified.
    """
    arrow_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    bands = Bands(*bands_and_rows(float(threshold), recall))
    marks = written(signatures(docs, text, key, bands, n), "signatures")
    classes = marks.groupBy("h1", "h2").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("n_grams").alias("n_grams"), F.any_value("keys").alias("keys"))
    # A class is known by 128 bits; its node is a number that is given once, when the classes are written.
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    ties = classes.select(F.explode("keys").alias("band"), "node")
    hubs = ties.groupBy("band").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("m")).filter("m > 1").select("band", "hub")
    tied = components(ties.join(hubs, "band").filter("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b")))

    placed = tied.withColumnRenamed("root", "comp").join(classes.select("node", "h1", "h2", "rep", "copies", "n_grams"), "node")
    sizes = placed.groupBy("comp").agg(F.count(F.lit(1)).alias("m"), F.sum("n_grams").alias("g"))
    blocks = F.greatest(F.ceil(F.col("g") / BLOCK_GRAMS), F.ceil(F.col("m") / BLOCK_CLASSES)).cast("int")
    sizes = written(sizes.select("comp", "g", blocks.alias("blocks")), "sizes")
    small = sizes.filter("blocks = 1").agg(F.sum("g")).head()[0] or 0
    shared = -(-small // BLOCK_GRAMS) or 1
    placed = placed.join(sizes, "comp")
    placed = placed.withColumn("blk", F.pmod(F.xxhash64(F.lit("block"), "node"), F.col("blocks")).cast("int"))
    placed = placed.select("comp", "node", "h1", "h2", "rep", "copies", "blocks", "blk")

    body = docs.select(F.col(key).alias("rep"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    texts = body.join(placed, body["rep"].eqNullSafe(placed["rep"])).select(*[placed[c] for c in ("comp", "node", "copies", "blocks", "blk", "h1", "h2")], "text")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows whose text is the class's: several texts may have the key, or none."""
        for batch in batches:
            found = np.array([signature(s) for s in gram_sets(batch.column(7).to_pylist(), n)], np.int64).reshape(-1, 2)
            same = (found[:, 0] == np.asarray(batch.column(5))) & (found[:, 1] == np.asarray(batch.column(6)))
            yield batch.select(["comp", "node", "copies", "blocks", "blk", "text"]).filter(pa.array(same))

    texts = texts.mapInArrow(own, "comp long, node long, copies long, blocks int, blk int, text string")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = texts.withColumn("_o", other)
    cells = cells.withColumn("i", F.least("blk", "_o")).withColumn("j", F.greatest("blk", "_o"))
    cells = cells.withColumn("cell", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64(F.lit("cell"), "comp"), F.lit(shared))).otherwise(F.col("comp")))
    cells = cells.withColumn("many", F.col("blocks") > 1)

    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        return _verify(rows.drop_duplicates("node").reset_index(drop=True), n, threshold)

    found = cells.select("many", "cell", "i", "j", "comp", "node", "copies", "blk", "text").groupBy("many", "cell", "i", "j").applyInPandas(verify, "node long, root long, links long")
    found = written(found, "links")
    counts = found.filter("root is null").groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.filter("root is not null").select(F.col("node").alias("a"), F.col("root").alias("b")))
    info = classes.select("node", "h1", "h2", "rep", "copies").join(counts, "node", "left").join(roots, "node", "left")
    info = info.withColumn("root", F.coalesce("root", "node"))
    info = info.join(info.groupBy("root").agg(F.min("rep").alias("class_id")), "root")
    info = info.select("h1", "h2", "root", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.col("rep").alias("copy_of"))
    rows = marks.select("doc", "t", "h1", "h2").join(info, ["h1", "h2"])
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc").isNull().alias("odd"), "doc", "t")).alias("first"))
    out = rows.join(first, "root")
    stays = F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("t") == F.col("first.t"))
    return out.select(F.col("doc").cast(kind).alias(key), "class_id", "n_links", "copy_of", F.col("t").alias("text_hash"), stays.alias("stays"))


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", **options: Fraction | float) -> DataFrame:
    """``docs`` with one row of each class of near duplicates; the columns are those of ``docs``, whatever their names.

    Of rows that are repeated in key and text one stays. Texts without words, nulls among them, are one class. An empty
    table gives no rows.
    """
    marked = near_duplicates(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")), "text", "key", **options)
    marked = written(marked.filter("stays").select("key", "text_hash"), "stay")
    rows = docs.select(F.struct("*").alias("row"), F.col(f"`{key}`").alias("own"), text_hash(f"`{text}`").alias("own_hash"))
    kept = rows.join(marked.distinct(), F.col("own").eqNullSafe(F.col("key")) & (F.col("own_hash") == F.col("text_hash")), "left_semi")
    total, distinct = marked.select(F.count(F.lit(1)), F.count_distinct(F.struct(F.coalesce(F.col("key").cast("string"), F.lit("")), "text_hash"))).head()
    if total > distinct:  # rows that are repeated in key and text
        kept = kept.dropDuplicates(["own", "own_hash"])
    return kept.select("row.*")
