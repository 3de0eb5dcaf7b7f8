"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The chunks between white space that the corpus holds most often are encoded once and compiled into a minimal acyclic
automaton over their bytes: equal suffixes share states, and numbers on the edges add up to the number of the word, which
leads to its ids. The arrays of the automaton are one file that every worker maps into memory. A batch walks all its
distinct chunks through the automaton at once; chunks that it doesn't know are merged exactly by the tokenizer's own
model and remembered for a while. No token reaches over white space, so chunks can be encoded one by one.
"""

from __future__ import annotations

import atexit
import json
import os
import re
import shutil
import tempfile
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vialect.llm.common import arrow_batches, written

#: Words of the lexicon, most bytes of one, and chunks that a worker counts or remembers before it forgets older ones.
WORDS, LONGEST, KEEP = 65_536, 40, 150_000
#: Chunks that are merged at a time.
TOGETHER = 5_000
#: White space as the tokenizer's patterns see it.
_SPACE = re.compile(r"[\t-\r \x85\xa0  -     　]+")
#: What the tokenizer file must say for the splitting here to be its own.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PATTERN = {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}


class Automaton:
    """Arrays: ``edges`` (state * 256 + byte, sorted), ``target``, ``number``; ``final`` by state; ``start`` and ``ids`` by word."""

    NAMES = (("edges", np.int64), ("target", np.int32), ("number", np.int32), ("final", np.int8), ("start", np.int32), ("ids", np.uint32))

    def __init__(self, **arrays: np.ndarray):
        self.__dict__.update(arrays)

    @classmethod
    def build(cls, words: dict[bytes, list[int]]) -> Automaton:
        """Minimal automaton of sorted words: a state is merged with an equal one as soon as nothing can be added to it."""
        ordered = sorted(words)
        register: dict[tuple, int] = {}
        nodes: list[tuple[bool, tuple]] = []

        def frozen(node: list) -> int:
            shape = (node[0], tuple(node[1]))
            if shape not in register:
                register[shape] = len(nodes)
                nodes.append(shape)
            return register[shape]

        path: list[list] = [[False, []]]  # states of the last word: is final, edges
        last = b""
        for word in [*ordered, None]:
            common = len(os.path.commonprefix([last, word])) if word is not None else 0
            while len(path) - 1 > common:
                node = path.pop()
                path[-1][1].append((last[len(path) - 1], frozen(node)))
            if word is None:
                break
            path.extend([False, []] for _ in range(len(word) - common))
            path[-1][0] = True
            last = word
        root = frozen(path[0])
        below = np.zeros(len(nodes), np.int64)
        edges, target, number = [], [], []
        for state, (final, out) in enumerate(nodes):  # targets come before their sources
            total = int(final)
            for byte, to in out:
                edges.append(state * 256 + byte)
                target.append(to)
                number.append(total)
                total += below[to]
            below[state] = total
        ids = [words[w] for w in ordered]
        start = np.zeros(len(ids) + 1, np.int32)
        np.cumsum([len(x) for x in ids], out=start[1:])
        return cls(
            edges=np.array(edges, np.int64), target=np.array(target, np.int32), number=np.array(number, np.int32),
            final=np.array([n[0] for n in nodes], np.int8), start=start, ids=np.array([i for x in ids for i in x], np.uint32), root=root,
        )

    def save(self, path: str) -> None:
        arrays = [np.ascontiguousarray(getattr(self, name), kind) for name, kind in self.NAMES]
        head = json.dumps({"root": self.root, "sizes": [len(a) for a in arrays]}).encode()
        with open(path, "wb") as f:
            f.write(len(head).to_bytes(8, "little") + head)
            for a in arrays:
                f.write(b"\0" * (-f.tell() % 8))
                f.write(a.tobytes())

    @classmethod
    def load(cls, path: str) -> Automaton:
        """The automaton over a read-only memory map of the file."""
        with open(path, "rb") as f:
            size = int.from_bytes(f.read(8), "little")
            head = json.loads(f.read(size))
        at, arrays = 8 + size, {}
        for (name, kind), n in zip(cls.NAMES, head["sizes"], strict=True):
            at += -at % 8
            arrays[name] = np.memmap(path, kind, "r", at, n) if n else np.zeros(0, kind)
            at += n * np.dtype(kind).itemsize
        return cls(root=head["root"], **arrays)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 for one that isn't in the lexicon; all words take a step at a time."""
        out = np.full(len(words), -1, np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        live = np.flatnonzero(size <= LONGEST)
        if not len(self.edges) or not len(live):
            return out
        data = np.frombuffer(b"".join(words), np.uint8)
        at = (np.cumsum(size) - size)[live]
        left, state, sum_ = size[live], np.full(len(live), self.root, np.int64), np.zeros(len(live), np.int64)
        while len(live):
            done = left == 0
            if done.any():
                ends = done & (self.final[state] == 1)
                out[live[ends]] = sum_[ends]
                live, at, left, state, sum_ = (x[~done] for x in (live, at, left, state, sum_))
                if not len(live):
                    break
            key = state * 256 + data[at]
            edge = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            ok = self.edges[edge] == key
            edge = edge[ok]
            live, at, left, sum_ = live[ok], at[ok] + 1, left[ok] - 1, sum_[ok] + self.number[edge]
            state = self.target[edge].astype(np.int64)
        return out


def _byte_letters() -> dict[int, int]:
    """The character that stands for each byte: itself where it prints, else one from U+0100 on, in order."""
    hidden = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD)]
    return {b: 256 + n for n, b in enumerate(hidden)}


def _normal(c: str) -> str:
    return unicodedata.normalize("NFC", c).lower()


class Tokenizer:
    """The file's normalization, splitting at white space, and merges by its own model without normalizing again.

    Texts of characters for which Python agrees with the library, and which never combine, are normalized by Python; all
    others by the library itself, whose tables of Unicode may be newer. A file of another make is refused.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        splits = [p for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        if spec["normalizer"] != NORMALIZER or not splits or splits[0].get("pattern") != PATTERN or spec["decoder"] is not None:
            raise ValueError(f"{path}: unknown normalizer, pre-tokenizer or decoder")
        self.normalizer = tokenizers.Tokenizer.from_file(path).normalizer
        spec["normalizer"] = None
        self.model = tokenizers.Tokenizer.from_str(json.dumps(spec))
        self.model.encode_special_tokens = True
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pattern = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.tokens = [self.model.id_to_token(i) for i in range(self.model.get_vocab_size(with_added_tokens=True))]
        # Bytes that a token covers: a character of it stands for each, but for the mark of a word's end.
        self.sizes = np.array([len(t) - 4 * t.endswith("</w>") for t in self.tokens], np.int64)
        same = "".join(c for c in map(chr, (*range(0x20, 0x7F), *range(0xA1, 0x300), *range(0x2010, 0x2028))) if self.normalizer.normalize_str(c) == _normal(c))
        self.strange = re.compile(f"[^\\t-\\r{re.escape(same)}]")
        # Chunks of these letters, digits and marks are cut here as PATTERN says; only an apostrophe may begin something else.
        letters, marks = "".join(c for c in same if c.isalpha()), "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c != "'")
        self.plain = re.compile(f"[{re.escape(letters + marks)}0-9]+")
        self.piece = re.compile(f"[{re.escape(letters)}]+|[0-9]|[{re.escape(marks)}]+")
        self.bytes, self.bpe = _byte_letters(), self.model.model
        self.packed = [i.to_bytes(4, "little") for i in range(len(self.tokens))]
        self.short: dict[str, bytes] = {}

    def chunks(self, text: str) -> list:
        """The normalized chunks of a text; a special token is its id."""
        if self.pattern.search(text):
            out, at = [], 0
            for m in self.pattern.finditer(text):
                out += [*self._split(text[at : m.start()]), self.special[m.group()]]
                at = m.end()
            return out + self._split(text[at:])
        return self._split(text)

    def _split(self, text: str) -> list[str]:
        if self.strange.search(text):
            return [x for x in _SPACE.split(self.normalizer.normalize_str(text)) if x]
        return text.lower().split()

    def _merged_plain(self, chunk: str) -> bytes:
        """The ids of a plain chunk, piece by piece; those of short pieces, of which there are few, are kept."""
        out = []
        for piece in self.piece.findall(chunk):
            ids = self.short.get(piece)
            if ids is None:
                body = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.bytes)
                ids = b"".join([self.packed[t.id] for t in self.bpe.tokenize(body)])
                if len(piece) <= 2:
                    self.short[piece] = ids
            out.append(ids)
        return b"".join(out)

    def merge(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk as little-endian bytes: of plain ones piece by piece, of others by the whole library."""
        plain, merged = self.plain.fullmatch, self._merged_plain
        out = [merged(c) if plain(c) else None for c in chunks]
        odd = [k for k, ids in enumerate(out) if ids is None]
        for k, ids in zip(odd, self._merged_together([chunks[k] for k in odd]), strict=True):
            out[k] = ids
        return out

    def _merged_together(self, chunks: list[str]) -> list[bytes]:
        """Chunks are merged many at a time, with spaces between them, and told apart by the bytes that their tokens cover;
        where these don't add up, one by one.
        """
        out: list[bytes] = []
        for low in range(0, len(chunks), TOGETHER):
            some = chunks[low : low + TOGETHER]
            ids = np.array(self.model.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            ends, covered = np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in some]), np.cumsum(self.sizes[ids])
            last = np.searchsorted(covered, ends)
            if len(covered) and last[-1] == len(covered) - 1 and np.array_equal(covered[last], ends):
                flat, stops = ids.tobytes(), (4 * (last + 1)).tolist()
                out += [flat[i:j] for i, j in zip([0, *stops], stops, strict=False)]
            else:
                out += [np.array(e.ids, "<u4").tobytes() for e in self.model.encode_batch(some, add_special_tokens=False)]
        return out


def frequent_words(docs: DataFrame, path: str, text: str = "text", words: int = WORDS) -> list[str]:
    """At most ``words`` chunks: the most frequent of all texts, up to ties. A chunk counts where a worker saw it twice."""
    arrow_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = Tokenizer(path).chunks, Counter()

        def flush() -> pa.RecordBatch:
            kept = [(w, n) for w, n in seen.items() if n > 1 and isinstance(w, str) and len(w.encode("utf-8", "replace")) <= LONGEST]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

        for batch in batches:
            for body in batch.column(0).to_pylist():
                if body:
                    seen.update(split(body))
            if len(seen) > 4 * KEEP:
                yield flush()
        yield flush()

    counts = docs.select(F.col(text)).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter("n > 3")
    counts = written(counts, "words")
    level = F.floor(F.log2("n") * 8)
    histogram = sorted(((r[0], r[1]) for r in counts.groupBy(level.alias("level")).count().collect()), reverse=True)
    total, least = 0, None
    for at, n in histogram:
        if total + n > words:
            break
        total, least = total + n, at
    return [] if least is None else [r[0] for r in counts.filter(level >= least).select("word").collect()]


def lexicon(docs: DataFrame, path: str, text: str = "text", words: int = WORDS) -> str:
    """Builds the automaton and gives it to all executors; returns the name of its file."""
    found = frequent_words(docs, path, text, words)
    ids = (np.frombuffer(x, "<u4").tolist() for x in Tokenizer(path).merge(found))
    automaton = Automaton.build(dict(zip((w.encode() for w in found), ids, strict=True)))
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    # The driver's own folder: Spark serves the file from there to every executor, new ones too, until the session ends.
    folder = tempfile.mkdtemp(prefix="lexicon")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    automaton.save(os.path.join(folder, name))
    docs.sparkSession.sparkContext.addFile(os.path.join(folder, name))
    return name


class Encoder:
    """A worker's encoder: what it remembers first, then the lexicon, then exact merges."""

    def __init__(self, tokenizer: Tokenizer, automaton: Automaton):
        self.tokenizer, self.automaton, self.seen, self.older = tokenizer, automaton, {}, {}

    def table(self, chunks: Iterable) -> dict:
        """The ids of each chunk as little-endian bytes."""
        words = [c for c in chunks if isinstance(c, str)]
        out = {c: np.array([c], "<u4").tobytes() for c in chunks if not isinstance(c, str)}
        number = self.automaton.numbers([w.encode("utf-8", "surrogatepass") for w in words])
        start, ids = self.automaton.start, np.asarray(self.automaton.ids, "<u4").tobytes()
        held = np.flatnonzero(number >= 0)
        low, high = 4 * start[:-1][number[held]].astype(np.int64), 4 * start[1:][number[held]].astype(np.int64)
        for k, a, b in zip(held.tolist(), low.tolist(), high.tolist(), strict=True):
            out[words[k]] = ids[a:b]
        fresh = [words[k] for k in np.flatnonzero(number < 0).tolist()]
        out.update(zip(fresh, self.tokenizer.merge(fresh), strict=True))
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [self.tokenizer.chunks(t) if t else [] for t in texts]
        if len(self.seen) > KEEP:  # what isn't met again before the next time is forgotten then
            self.seen, self.older = {}, self.seen
        fresh = set().union(*split).difference(self.seen)
        known = fresh.intersection(self.older)
        self.seen.update(zip(known, map(self.older.__getitem__, known), strict=True))
        self.seen.update(self.table(fresh.difference(known)))
        return [b"".join(map(self.seen.__getitem__, x)) for x in split]

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.tokenizer.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoded(docs: DataFrame, path: str, text: str = "text", words: int = WORDS) -> DataFrame:
    """``docs`` with ids (little-endian 32-bit, binary) and decoded text; columns of these names are replaced.

    A null or empty text, or one of white space only, has no ids and decodes to the empty text.
    """
    name = lexicon(docs, path, text, words)
    kept = [c for c in docs.columns if c not in ("ids", "decoded")]
    docs, at = docs.select(*[F.col(f"`{c}`") for c in kept]), kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path, name) not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[path, name] = Encoder(Tokenizer(path), Automaton.load(SparkFiles.get(name)))
        encoder = _ENCODERS[path, name]
        for batch in batches:
            ids = encoder.encode(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary()), pa.array([encoder.decode(x) for x in ids], pa.string())], [*batch.schema.names, "ids", "decoded"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    return docs.mapInArrow(run, ", ".join([*fields, "ids binary", "decoded string"]))
