"""Held-out accuracy and brute force for the operators that learn or encode."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vialect.llm import bpe, langid, packing, quality
from vialect.llm.queries import tokenizer

ODD = [None, "", " ", "a", "ÉÀ", "\n\n", "x" * 30_000, "<|endoftext|>", "a  b \n c\t d", "Don't we'LL 123 45 ² ½!", "ΑΣ ΟΔΟΣ", "e\u0301 \u00a0 \x1c z", "<|startoftext|>mid<|endoftext|>end", "日本語 テキスト 한국어", "İstanbul", "🎉🎉 ok"]


@pytest.fixture(scope="module")
def words():
    rng = random.Random(5)
    return {lang: ["".join(rng.choice(s) for _ in range(rng.randint(2, 4))) for _ in range(80)] for lang, s in {"aa": ["th", "er", "ing"], "bb": ["que", "eau", "é"], "cc": ["sch", "ung", "ü"]}.items()}


def texts(words, n, seed, odd=True):
    rng = random.Random(seed)
    out = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(3, 60))), lang) for i in range(n) for lang in [rng.choice(sorted(words))]]
    return out + ([(n + i, t, None) for i, t in enumerate(ODD)] if odd else [])


def test_language_is_learned(spark, words):
    docs = spark.createDataFrame(texts(words, 400, 1), "doc_id long, text string, lang string")
    model = langid.fit(docs.filter(~langid.held_out(F.col("doc_id"))))
    out = langid.predict(docs.withColumn("score", F.lit("clash")), model).collect()
    known = [r for r in out if r.lang]
    assert np.mean([r.lang_pred == r.lang for r in known]) > 0.97
    by = {r.doc_id: r for r in out}
    assert {by[400 + i].lang_pred for i in (0, 1, 2, 5)} == {"und"} and all(0 <= r.score <= 1 for r in out)
    assert langid.predict(docs.limit(0), model).count() == 0


def slow_bits(counts, text, size=257):
    """Code length by following the escapes one by one."""
    total, data = 0.0, text.encode()
    for i, x in enumerate(data):
        context = bytes(data[max(0, i - 3) : i]).rjust(3, b"\0")
        p = 1.0
        for order in (3, 2, 1, 0):
            seen = counts.get(context[3 - order :], {})
            n, t = sum(seen.values()), len(seen)
            if not n:
                continue
            if x in seen:
                p *= seen[x] / (n + t)
                break
            p *= t / (n + t)
        else:
            p /= size
        total -= math.log2(p)
    return total


def trained(texts):
    data, offsets = langid.utf8(pa.array(texts))
    grams, n = np.unique(langid._grams(data, offsets), return_counts=True)
    return langid.compiled(grams.astype(np.int64), n.astype(float))


def counted(texts):
    counts: dict[bytes, dict[int, int]] = {}
    for t in texts:
        for i, x in enumerate(t.encode()):
            context = t.encode()[max(0, i - 3) : i].rjust(3, b"\0")
            for order in range(4):
                at = counts.setdefault(context[3 - order :], {})
                at[x] = at.get(x, 0) + 1
    return counts


def test_code_lengths_follow_escapes():
    train = ["the cat sat on the mat", "a cat", "then"]
    model = langid.Model(["x"], [langid._unpacked(langid._packed(trained(train)))])
    for t in ["the cat", "a mat on", "thq cat", "", "zz top"]:
        got = langid.code_lengths(model, *langid.utf8(pa.array([t, t])))
        assert got[0, 0] == pytest.approx(slow_bits(counted(train), t), rel=1e-5) and got[1, 0] == pytest.approx(got[0, 0])


def test_windows_don_t_change_code_lengths(words, monkeypatch):
    data, offsets = langid.utf8(pa.array([t for _, t, lang in texts(words, 60, 3, False)]))
    model = langid.Model(["x"], [trained([t for _, t, lang in texts(words, 9, 4, False)])])
    whole = langid.code_lengths(model, data, offsets)
    for window in (37, 1):
        monkeypatch.setattr(langid, "WINDOW", window)
        assert np.allclose(langid.code_lengths(model, data, offsets), whole, rtol=1e-9)


def test_predictions_of_many_languages_equal_brute_force(spark):
    """200 languages of a few documents each: the prediction is the language of the least code length, ties to the first."""
    rng = random.Random(21)
    made = {f"l{k:03}": ["".join(chr(97 + rng.randrange(26)) for _ in range(rng.randint(2, 6))) for _ in range(6)] for k in range(200)}
    docs = [(i, " ".join(rng.choice(made[lang]) for _ in range(12)), lang) for i, lang in enumerate(sorted(made) * 2)]
    model = langid.fit(spark.createDataFrame([*docs, (900, None, "none"), (901, "", "empty"), (902, "x", None)], "doc_id long, text string, lang string"))
    assert model.langs == sorted(made)
    asked = docs[::29]
    trees = {lang: counted([t for _, t, x in docs if x == lang]) for lang in made}
    out = {r.doc_id: r.lang_pred for r in langid.predict(spark.createDataFrame(asked, "doc_id long, text string, lang string"), model).collect()}
    for i, t, _ in asked:
        bits = {lang: slow_bits(c, t) for lang, c in trees.items()}
        assert bits[out[i]] == pytest.approx(min(bits.values()), rel=1e-5)


def test_quality(spark, words):
    rng = random.Random(9)
    rows = [(i, t if i % 4 else "".join(c + rng.choice("###$$&& ") for c in t), int(i % 4 > 0)) for i, t, _ in texts(words, 500, 2, False)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels, ~quality.held_out(F.col("doc_id")))
    out = {r.doc_id: r for r in quality.score(docs.withColumn("score", F.lit("x")).withColumn("held", quality.held_out(F.col("doc_id"))), model).collect()}
    held = [(out[i].predicted, q) for i, _, q in rows if out[i].held]
    assert np.mean([p == q for p, q in held]) > 0.95 and len(out) == 500 + len(ODD)
    assert all(0 <= r.score <= 1 for r in out.values()) and out[1000].score == out[1001].score
    blank = quality.fit(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in quality.score(docs, blank).collect()} == {0.5}


def slow_shares(text):
    """Shares of lower-case letters, capitals and digits among the characters, and the logarithms of bytes and words."""
    data = text.encode()
    chars = max(1, len(text))
    return [sum(97 <= b <= 122 for b in data) / chars, sum(65 <= b <= 90 for b in data) / chars, sum(48 <= b <= 57 for b in data) / chars], [math.log1p(len(data)), math.log1p(len(text.split()))]


def test_quality_equals_one_pass_in_numpy(spark, words):
    """Statistics by a plain loop; the ridge from the whole design matrix at once instead of partitions' sums."""
    rng = random.Random(31)
    rows = [(i, t if i % 3 else t.upper() + " 12 34", int(i % 3 > 0)) for i, t, _ in texts(words, 300, 8, False)] + [(900, "", 0), (901, "é É 5", 1)]
    x = quality.statistics(pa.array([t for _, t, _ in rows]))
    for row, (_, t, _) in zip(x, rows, strict=True):
        shares, logs = slow_shares(t)
        if t:
            assert list(row[:3]) == pytest.approx(shares) and [row[len(quality._CLASSES) + 2], row[len(quality._CLASSES) + 3]] == pytest.approx(logs)
        else:
            assert not row.any()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(5)
    model = quality.fit(docs, spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int"), F.lit(True))
    c = {r[0]: r[1] for r in docs.select("doc_id", F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(4)) == 0).collect()}
    c, y = np.array([c[i] for i, _, _ in rows]), np.array([float(q) for _, _, q in rows])
    assert model.mean == pytest.approx(x.mean(0)) and model.scale == pytest.approx(x.std(0) + 1e-6)
    z = np.clip((x - x.mean(0)) / (x.std(0) + 1e-6), -6, 6)
    a = np.column_stack([np.cos(z @ model.weights + model.phase) * math.sqrt(2 / quality.FEATURES), z / 10, np.ones(len(z))])
    ridge = np.linalg.solve(a[~c].T @ a[~c] + quality.RIDGE * np.eye(a.shape[1]), a[~c].T @ y[~c])
    assert model.ridge == pytest.approx(ridge, rel=1e-5, abs=1e-7)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert [got[i] for i, _, _ in rows] == pytest.approx(list(np.clip(np.interp(a @ ridge, model.at, model.value), 0, 1)), abs=1e-6)
    assert quality.score(docs.limit(0), model).count() == 0


def test_pieces_hold_the_library_s_ids(spark, words):
    """Every piece's checksum, start and total against the ids of the library."""
    import zlib

    path = tokenizer("byte_bpe_50k.json")
    body = texts(words, 40, 9)
    lib, seen = reference(path), {}
    for r in packing.pack(spark.createDataFrame([(i, t, 5) for i, t, _ in body], "doc_id long, text string, length int"), path).collect():
        seen.setdefault(r.doc_id, []).append(r)
    for i, t, _ in body:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(seen.pop(i), key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    assert not seen


def test_isotonic():
    x, y = quality.isotonic(np.arange(5.0), np.array([0.0, 2, 1, 3, 4]), np.array([4.0, 4, 4, 4, 4]))
    assert list(x) == [0, 1.5, 3, 4] and np.all(np.diff(y) > 0)


def reference(path):
    import tokenizers

    return tokenizers.Tokenizer.from_file(path)


def test_bpe_equals_the_library(spark, words):
    path = tokenizer("word_bpe_49k.json")
    body = texts(words, 60, 4)
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _ in body], "doc_id long, text string, ids string")
    out = {r.doc_id: r for r in bpe.encoded(docs, path, words=20).collect()}
    lib = reference(path)
    for i, t, _ in body:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(out[i].ids, "<u4").tolist() == ids, t
        assert out[i].decoded == lib.decode(ids, skip_special_tokens=False)


def test_every_code_point_equals_the_library():
    path = tokenizer("word_bpe_49k.json")
    lib, encoder = reference(path), bpe.Encoder(bpe.Tokenizer(path), bpe.Automaton.build({}))
    chars = [chr(c) for c in (*range(1, 0xD800), *range(0xE000, 0x20000), *range(0xE0000, 0xE0200), 0x10FFFF)]
    for shown in (lambda c: c, lambda c: f"a{c}b {c}x", lambda c: f"b{c}, {c}a!)"):
        texts = [shown(c) for c in chars]
        got = encoder.encode(texts)
        assert [t for t, g, w in zip(texts, got, lib.encode_batch(texts, add_special_tokens=False), strict=True) if np.frombuffer(g, "<u4").tolist() != w.ids] == []


def test_chunks_cut_in_pieces_equal_the_library(words, monkeypatch):
    """Letters, digits, marks and apostrophes mixed, with a memory that forgets after every few texts."""
    monkeypatch.setattr(bpe, "KEEP", 50)
    path, dice = tokenizer("word_bpe_49k.json"), random.Random(4)
    lib, encoder = reference(path), bpe.Encoder(bpe.Tokenizer(path), bpe.Automaton.build({}))
    parts = [*(w for some in words.values() for w in some[:10]), "ß", "été", "ñandú", "straße", "Ünder", "ﬁn", "日本", "'s", "'LL", "'", "''t", "!!", "###", "-", "3", "42", "²", "½", "ª", "¡", "§", "</w>", "<|", "|>", "_", "a"]
    for _ in range(60):
        texts = [" ".join("".join(dice.choices(parts, k=dice.randint(1, 4))) for _ in range(12)) for _ in range(5)]
        for text, got, want in zip(texts, encoder.encode(texts), lib.encode_batch(texts, add_special_tokens=False), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == want.ids, text


def test_other_tokenizer_files_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="unknown"):
        bpe.Tokenizer(tokenizer("byte_bpe_50k.json"))
    with pytest.raises(ValueError, match="unknown"):
        packing.ByteEncoder(tokenizer("word_bpe_49k.json"))


def test_bpe_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, decoded string")
    assert bpe.encoded(docs, tokenizer("word_bpe_49k.json")).columns == ["doc_id", "text", "ids", "decoded"] and bpe.encoded(docs, tokenizer("word_bpe_49k.json")).count() == 0


def test_automaton(tmp_path):
    words = {w.encode(): [k, len(w)] for k, w in enumerate(["a", "ab", "abc", "xbc", "xb", "é", "tion", "nation", "station"])}
    a = bpe.Automaton.build(words)
    a.save(str(tmp_path / "a"))
    b = bpe.Automaton.load(str(tmp_path / "a"))
    asked = [*words, b"", b"abcd", b"n", b"x", b"stations", b"z" * 99]
    numbers = b.numbers(asked)
    assert [b.ids[b.start[n] : b.start[n + 1]].tolist() for n in numbers[: len(words)]] == list(words.values()) and set(numbers[len(words) :]) == {-1}
    assert len(a.final) < 1 + sum(map(len, words))  # suffixes are shared
    empty = bpe.Automaton.build({})
    assert list(empty.numbers([b"a"])) == [-1]


def test_byte_encoder_equals_the_library(words):
    path = tokenizer("byte_bpe_50k.json")
    encode, lib = packing.ByteEncoder(path), reference(path)
    for _, t, _ in texts(words, 40, 6):
        assert np.frombuffer(encode(t or ""), "<u4").tolist() == lib.encode(t or "", add_special_tokens=False).ids, t


@pytest.mark.parametrize("n", [1, 16, 17, 340, 341, 512, 700, 1023, 1024, 1025, 99_999])
def test_cut(n):
    parts = packing.cut(n)
    assert sum(parts) == n and all(0 < p <= 1024 for p in parts)


def test_packing(spark, words):
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choice(words["aa"]) for _ in range(rng.randint(0, 900)))) for i in range(150)] + [(500 + i, t) for i, t in enumerate(ODD)] + [(3, "again"), (3, "again"), (None, "no key")]
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), tokenizer("byte_bpe_50k.json")).collect()
    held: dict[int, list] = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    tokens = padding = 0
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
        tokens += at
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert tokens == sum(r.length for r in rows) and padding / (tokens + padding) < 0.02
    assert sum(r.doc_tokens for r in rows if r.start == 0) == tokens
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), tokenizer("byte_bpe_50k.json")).count() == 0
