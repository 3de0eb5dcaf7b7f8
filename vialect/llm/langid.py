"""Language identification by prediction by partial matching over bytes.

For each language a context tree of order 3 holds how often each byte followed each context. Under frozen statistics the
probability of a byte is c / (n + t) in the longest context that has seen it (n occurrences, t different followers), and
each shorter context that had to be tried costs its escape, t / (n + t); below order 0 all 257 symbols are alike. The
trees are kept whole, as sorted arrays of what was seen: an executor compiles those of a language from its counts. A text
is scored by the exact code length of each of its bytes: a batch looks up its distinct four-byte grams once for each
language and sums them by text, whole texts at a time. The language with the shortest code wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vialect.llm.common import arrow_batches, utf8

#: Most training documents of a language, about: the bound of the model. Bytes that are scored at a time.
SAMPLE_DOCS, WINDOW = 3000, 1 << 21
ORDER = 3
LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Tree:
    """A language: for each order the sorted grams that were seen with their bits, and the sorted contexts with the bits of
    their escape."""

    grams: list[np.ndarray]
    bits: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]


@dataclass
class Model:
    langs: list[str]
    trees: list[Tree]


def _grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte, it and the three before it in its own text (0 before the start), as one integer."""
    x = data.astype(np.uint32)
    out = x.copy()
    starts = offsets[:-1]
    for back in (1, 2, 3):
        shifted = np.zeros_like(x)
        shifted[back:] = x[:-back] if back < len(x) else 0
        for k in range(back):  # positions less than ``back`` after a start
            at = starts + k
            shifted[at[at < offsets[1:]]] = 0
        out |= shifted << np.uint32(8 * back)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for lang in set(langs):
            data, offsets = utf8(batch.column(1).take(pa.array(np.flatnonzero(langs == lang))))
            if not len(data):
                continue
            k, n = np.unique(_grams(data, offsets), return_counts=True)
            if lang in keys:
                k, n = np.concatenate([keys[lang][0], k]), np.concatenate([keys[lang][1], n])
                k, inverse = np.unique(k, return_inverse=True)
                n = np.bincount(inverse, n).astype(np.int64)
            keys[lang] = k, n
    for lang, (k, n) in keys.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(k.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


def sampled(df: DataFrame, lang: str, key: str, bound: int) -> DataFrame:
    """At most about ``bound`` rows of each value of ``lang``, chosen by a hash of the key."""
    counts = {r[0]: r[1] for r in df.groupBy(lang).count().collect()}
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(lang) == value, F.lit(min(1.0, bound / n))).otherwise(share)
    drawn = F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return df.filter(drawn < share)


def compiled(grams: np.ndarray, counts: np.ndarray) -> Tree:
    """The tree of a language from the counts of its four-byte grams: context bytes above, the byte itself lowest."""
    tree = Tree([], [], [], [])
    for order in range(ORDER + 1):
        seen, at = np.unique(grams & ((1 << 8 * (order + 1)) - 1), return_inverse=True)
        c = np.bincount(at, counts, len(seen))
        contexts, at = np.unique(seen >> 8, return_inverse=True)
        n, t = np.bincount(at, c, len(contexts)), np.bincount(at, minlength=len(contexts))
        tree.grams.append(seen.astype(np.uint32))
        tree.bits.append((np.log2(n + t)[at] - np.log2(c)).astype(np.float32))
        tree.contexts.append(contexts.astype(np.uint32))
        tree.escapes.append((np.log2(n + t) - np.log2(t)).astype(np.float32))
    return tree


def _packed(tree: Tree) -> bytes:
    parts = [a for arrays in zip(tree.grams, tree.bits, tree.contexts, tree.escapes, strict=True) for a in arrays]
    return np.array([len(a) for a in parts], "<i8").tobytes() + b"".join(a.astype(a.dtype.newbyteorder("<")).tobytes() for a in parts)


def _unpacked(data: bytes) -> Tree:
    sizes = np.frombuffer(data, "<i8", 4 * (ORDER + 1))
    at, parts = sizes.nbytes, []
    for k, n in enumerate(sizes.tolist()):
        parts.append(np.frombuffer(data, "<u4" if k % 2 == 0 else "<f4", n, at))
        at += 4 * n
    return Tree(*(parts[k::4] for k in range(4)))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", bound: int = SAMPLE_DOCS) -> Model:
    """Learns from rows with text and language, at most about ``bound`` of each language; an empty table gives a model
    without languages, and a language of empty texts only isn't learned.

    The tree of a language is compiled in one task, from the distinct grams of at most ``bound`` documents; it comes to the
    driver as a few MB.
    """
    arrow_batches(docs.sparkSession)
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = sampled(rows.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(key).alias("key")), "lang", "key", bound)
    counts = rows.select("lang", "text").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))

    def tree(found: pd.DataFrame) -> pd.DataFrame:
        packed = _packed(compiled(found["gram"].to_numpy(np.int64), found["n"].to_numpy(np.float64)))
        return pd.DataFrame({"lang": [found["lang"].iloc[0]], "tree": [packed]})

    trees = sorted((r["lang"], bytes(r["tree"])) for r in counts.groupBy("lang").applyInPandas(tree, "lang string, tree binary").collect())
    return Model([lang for lang, _ in trees], [_unpacked(t) for _, t in trees])


def gram_bits(tree: Tree, grams: np.ndarray) -> np.ndarray:
    """The exact code length of the last byte of each gram after the three before it."""
    out, left = np.zeros(len(grams), np.float64), np.arange(len(grams))
    for order in range(ORDER, -1, -1):
        g = grams[left] & np.uint32((1 << 8 * (order + 1)) - 1)
        at = np.minimum(np.searchsorted(tree.grams[order], g), len(tree.grams[order]) - 1)
        hit = tree.grams[order][at] == g
        out[left[hit]] += tree.bits[order][at[hit]]
        left, context = left[~hit], g[~hit] >> np.uint32(8)
        at = np.minimum(np.searchsorted(tree.contexts[order], context), len(tree.contexts[order]) - 1)
        known = tree.contexts[order][at] == context
        out[left[known]] += tree.escapes[order][at[known]]
    out[left] += np.log2(257)
    return out


def code_lengths(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of each text in each language; texts are whole, the buffer is taken in windows."""
    out = np.zeros((len(offsets) - 1, len(model.langs)))
    if not len(data) or not model.langs:
        return out
    for low in range(0, len(data), WINDOW):
        high = min(len(data), low + WINDOW)
        first, last = np.searchsorted(offsets, low, "right") - 1, np.searchsorted(offsets, high, "left")
        begin = max(offsets[first], low - ORDER)  # bytes before the window that are context
        edges = np.clip(offsets[first : last + 1], begin, high) - begin
        grams = _grams(data[begin:high], edges)[low - begin :]
        places, distinct = pd.factorize(grams)
        starts = np.clip(offsets[first:last], low, high) - low
        full = np.clip(offsets[first + 1 : last + 1], low, high) - low > starts
        rows = np.arange(first, last)[full]
        for j, tree in enumerate(model.trees):
            out[rows, j] += np.add.reduceat(gram_bits(tree, distinct)[places], starts[full])
    return out


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and bits_per_byte; columns of these names are replaced.

    ``und`` and score 0 where the text is null or has no letter or the model knows no language. Equal texts get equal
    results; of equal code lengths the first language in code point order wins. The score is the posterior of the
    language under equal priors.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "bits_per_byte")]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.langs, "und"], object)
        for batch in batches:
            data, offsets = utf8(batch.column(at))
            bits = code_lengths(m, data, offsets)
            letters = np.array([LETTER.search(t) is not None if t else False for t in batch.column(at).to_pylist()], bool)
            if m.langs:
                best = bits.argmin(1)
                low = bits[np.arange(len(bits)), best]
                score = 1 / np.exp2(np.maximum(-1000.0, low[:, None] - bits)).sum(1)
            else:
                best, low, score = np.zeros(len(letters), int), np.zeros(len(letters)), np.zeros(len(letters))
            known = letters & bool(m.langs)
            per = low / np.maximum(1, np.diff(offsets))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names[np.where(known, best, len(m.langs))], pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(np.where(known, per, 0.0))],
                [*batch.schema.names, "lang_pred", "score", "bits_per_byte"],
            )

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    return docs.mapInArrow(run, ", ".join([*fields, "lang_pred string", "score double", "bits_per_byte double"]))


def held_out(key: Column) -> Column:
    """Whether crc32(key as text) leaves 2 modulo 4; false for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))
