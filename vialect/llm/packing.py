"""Harmonic packing of tokenized documents into sequences of bounded length.

Class k holds pieces of at most capacity // k tokens, so k of them always fit into one sequence whatever their lengths.
A document is cut into full sequences and a rest; the rest goes into its class where it nearly fills the class's slot,
else a piece that fills the next class's slot exactly is cut off and what is left is treated alike. Each class is dealt
to workers in groups of bounded size, and every group fills its own sequences with k pieces each, without knowing of the
others. What is left over of each group, less than a sequence, meets other leftovers in a bounded first fit.

Only lengths and checksums are moved: token ids stay where they were made.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vialect.llm.common import arrow_batches, written

CAPACITY = 1024
#: A rest may leave this share of its slot empty before it is cut again; pieces of at most so many tokens never are.
SLACK, SMALL = 1 / 32, 16
#: About so many pieces of a class make a group; so many groups' leftovers meet.
GROUP, MEET = 1024, 64
#: Spaces-separated chunks that a worker remembers.
CACHE = 300_000

_RARE = re.compile(r"[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteEncoder:
    """Encodes as the tokenizer file does, with ids as little-endian 32-bit integers.

    A chunk between single spaces is encoded once with its leading space and remembered: no token reaches over such a
    space. Texts where white space stands beside a space, or with a special token, are encoded in one go.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec["pre_tokenizer"] or {}
        if spec["normalizer"] is not None or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex"):
            raise ValueError(f"{path}: unknown normalizer or pre-tokenizer")
        back, vocab = byte_alphabet(), spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(back[c] for c in token): i for token, i in vocab.items() if token not in special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        if any(vocab[a + b] != 256 + i for i, (a, b) in enumerate(merges)):
            raise ValueError(f"{path}: ids don't follow the order of merges")
        self.special = list(special)
        self.whole = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.chunks = _Chunks(self.whole.encode_ordinary)

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.whole.encode(text, allowed_special="all"), "<u4").tobytes()
        if "  " in text or " \n" in text or "\n " in text or _RARE.search(text):
            return np.array(self.whole.encode_ordinary(text), "<u4").tobytes()
        first, *rest = text.split(" ")
        if len(self.chunks) > CACHE:
            self.chunks.clear()
        head = np.array(self.whole.encode_ordinary(first), "<u4").tobytes() if first else b""
        return head + b"".join(map(self.chunks.__getitem__, rest))


class _Chunks(dict):
    def __init__(self, encode: Callable[[str], list[int]]):
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        found = self[chunk] = np.array(self.encode(" " + chunk), "<u4").tobytes()
        return found


def cut(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of a document of n tokens."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        slot = capacity // k
        piece = rest if rest <= SMALL or slot - rest <= SLACK * slot else capacity // (k + 1)
        out.append(piece)
        rest -= piece
    return out


_ENCODERS: dict[str, ByteEncoder] = {}


def pieces(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document: key, start, length, ids_crc32, doc_tokens. A null text counts as empty."""
    arrow_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:
            _ENCODERS[path] = ByteEncoder(path)
        encode = _ENCODERS[path]
        for batch in batches:
            out: list[tuple] = []
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(body) + end
                start, total = 0, len(ids) // 4
                for length in cut(total, capacity):
                    out.append((doc, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), total))
                    start += length
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k else batch.column(0).type) for k, c in enumerate(columns)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long")


def _first_fit(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Longest first, each piece into the fullest sequence that still has room."""
    rows = rows.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
    room: dict[int, list[int]] = {}
    free = np.zeros(capacity + 1, bool)
    numbers, offsets, n = [], [], 0
    for length in rows["length"]:
        fits = np.flatnonzero(free[length:])
        if len(fits):
            left = int(fits[0]) + length
            number = room[left].pop()
            free[left] = bool(room[left])
        else:
            left, number, n = capacity, n, n + 1
        numbers.append(number)
        offsets.append(capacity - left)
        room.setdefault(left - length, []).append(number)
        free[left - length] = left > length
    return rows.assign(number=numbers, offset=offsets)


def packed(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` with sequence_id and offset; ``parts`` is read several times, so it should be stored.

    Sequence ids are unique but not dense. Equal rows are packed as separate pieces. No rows give no sequences.
    """
    parts = parts.withColumn("_k", F.expr(f"{capacity} div length"))
    sizes = {r[0]: r[1] for r in parts.groupBy("_k").count().collect()}  # at most 2 * sqrt(capacity) classes
    dealt = F.lit(1)
    for k, n in sizes.items():
        if n > GROUP:
            dealt = F.when(F.col("_k") == k, F.lit(-(-n // GROUP))).otherwise(dealt)
    parts = parts.withColumn("_g", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), dealt))
    group = Window.partitionBy("_k", "_g")
    numbered = parts.withColumn("_n", F.row_number().over(group.orderBy("doc_id", "start", "ids_crc32")) - 1)
    numbered = numbered.withColumn("_all", F.count(F.lit(1)).over(group)).withColumn("_bin", F.expr("_n div _k"))
    whole = F.col("_bin") * F.col("_k") + F.col("_k") <= F.col("_all")
    columns = [c for c in parts.columns if not c.startswith("_")]
    before = Window.partitionBy("_k", "_g", "_bin").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    full = numbered.filter(whole).select(
        *columns,
        ((F.col("_g") * 2048 + F.col("_k")) * (1 << 20) + F.col("_bin")).alias("sequence_id"),
        F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"),
    )
    rest = numbered.filter(~whole).select(*columns, F.expr(f"_g div {MEET}").alias("_m"))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        out = _first_fit(rows, capacity)
        out["sequence_id"] = (out["_m"] * 2048) * (1 << 20) + out["number"]
        return out[[*columns, "sequence_id", "offset"]]

    # Class 0 doesn't exist (no piece is longer than the capacity), so its ids are those of the leftovers.
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema.fields if not f.name.startswith("_")), "sequence_id long", "offset long"])
    return full.unionByName(rest.groupBy("_m").applyInPandas(fit, schema))


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece of each document: its place in the document, its checksum, and its place in a sequence.

    A null or empty text is its end id alone. Repeated rows, and rows without key, are packed as documents of their own;
    other columns of ``docs`` are not looked at. An empty table gives no rows.
    """
    return packed(written(pieces(docs, path, capacity=capacity), "pieces"), capacity)
