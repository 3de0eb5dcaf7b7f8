"""Brute force for the operators that match, filter and extract."""

from __future__ import annotations

import base64
import functools
import hashlib
import os
import random
import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from vialect.llm import common, fingerprints, html_extract, line_dedup, ngram_join, topk, url_filter

ODD = [None, "", " ", "\n", "one", "one two three four", "same text\nsame text", "x" * 20_000]


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5))) + rng.choice(["", "", ",", "."]) for _ in range(n))


def frame(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def parts(t):
    return {x for x in re.split(r"\n|(?<=[.!?,;:])[ \t\n\x0b\f\r]+", t or "") if x}


def near(a, b):
    a, b = parts(a), parts(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(spark):
    rng = random.Random(1)
    texts = [prose(rng, rng.choice([3, 20, 200])) for _ in range(30)] + ODD + [prose(rng, 3000)]
    ids = list(range(len(texts) - 1)) + [10_000]
    rows = spark.createDataFrame([*zip(ids, texts, strict=True)], "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(rows).collect()}
    order = sorted(zip(ids, texts, strict=True), reverse=True)
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        m = len(t) // 3
        edited = t[: len(t) - m] + after[:m]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(near(t, edited)) and r.near_next == pytest.approx(near(t, after))
    assert got[30].fingerprint == got[31].fingerprint
    one = fingerprints.edited_fingerprints(rows.filter("doc_id = 3")).head()
    assert one.near_next == 1.0
    assert fingerprints.edited_fingerprints(rows.limit(0)).count() == 0


def test_fingerprints_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET", 5)
    rows = frame(spark, [f"text {i}" for i in range(47)] + ["a", "b"])
    rows = rows.unionByName(spark.createDataFrame([(None, "none"), (5, "text 5")], "doc_id long, text string"))
    got = fingerprints.with_next(rows, "doc_id", ["text"]).collect()
    assert len(got) == 51
    after = {r.doc_id: r.next_text for r in got if r.doc_id not in (5, None)}
    assert after[48] == "a" and after[6] == "text 5" and after[0] == "none" and after[20] == "text 19"
    assert [r.next_text for r in got if r.doc_id is None] == ["b"]


def decoded(fingerprint):
    """Peels a printed sketch alone: its digests, by a plain loop over (table, cell)."""
    raw = base64.b64decode(fingerprint)
    cells = {}
    for at in range(0, len(raw), 22):
        i, c, k, h = struct.unpack(">IHQQ", raw[at : at + 22])
        cells[i] = [c, k, h]
    out = set()
    while any(cell[0] for cell in cells.values()):
        k, h = next((k, h) for c, k, h in cells.values() if c == 1)
        hit = [i for i, cell in cells.items() if cell[0] and (cell[1], cell[2]) == (k, h) or cell[0] > 1]
        assert k not in out and len(hit) >= 3
        out.add(k)
        for i in [i for i in hit if cells[i][0] == 1][:3]:
            cells[i] = [0, 0, 0]
    return out


def test_likeness_follows_from_the_printed_fingerprints(spark, monkeypatch):
    """No round for all pairs at once: then every pair is settled by ``likeness``. The strings alone give the same values."""
    rng = random.Random(12)
    base = [prose(rng, 5) + "." for _ in range(60)]
    texts = ["\n".join([*rng.sample(base, rng.randint(0, 40)), *(prose(rng, 4) for _ in range(rng.randint(0, 30)))]) for _ in range(25)] + ODD
    rows = frame(spark, texts)
    first = {r.doc_id: r for r in fingerprints.edited_fingerprints(rows).collect()}
    monkeypatch.setattr(fingerprints, "ROUNDS", ())
    assert {r.doc_id: r for r in fingerprints.edited_fingerprints(rows).collect()} == first
    for i, r in first.items():
        a, e = decoded(r.fingerprint), decoded(r.edited_fingerprint)
        assert len(a) == len(parts(texts[i])) and r.near_edited == pytest.approx(len(a & e) / len(a | e) if a | e else 1.0)
        n = decoded(first[i - 1 if i else len(texts) - 1].fingerprint)
        assert r.near_next == pytest.approx(len(a & n) / len(a | n) if a | n else 1.0)


def test_smallest_sketches_are_doubled(spark, monkeypatch):
    """With one cell a table to begin with, every pair that differs has to go on to larger sizes."""
    rng = random.Random(13)
    texts = [prose(rng, n) for n in (1, 2, 9, 40, 90)]
    rows = frame(spark, texts)
    want = {r.doc_id: r for r in fingerprints.edited_fingerprints(rows).collect()}
    monkeypatch.setattr(fingerprints, "_size", lambda digests: "0")
    assert {r.doc_id: r for r in fingerprints.edited_fingerprints(rows).collect()} == want


def test_equal_cells_of_a_sketch_are_added(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "WIDEST", 4)
    r = spark.sql(f"SELECT {fingerprints.sketch('transform(sequence(1L, 40L), x -> xxhash64(x))')} AS s").head().s
    assert sum(x.c for x in r) == 120 and len({x.i for x in r}) == len(r) <= 48


def test_recovered_digests(spark):
    rng = random.Random(2)
    a = [prose(rng, 4) + "." for _ in range(80)]
    rows = spark.createDataFrame([("\n".join(a), "\n".join([*a[:70], "new one", "new two"]))], "a string, b string")
    prints = rows.select(fingerprints.fingerprint("a").alias("a"), fingerprints.fingerprint("b").alias("b"))
    r = prints.select(fingerprints.difference("a", "b").alias("changed"), fingerprints.likeness("a", "b").alias("near")).head()
    x, y = parts(rows.head().a), parts(rows.head().b)
    assert sorted(c.s for c in r.changed) == [-1] * len(y - x) + [1] * len(x - y) and r.near == pytest.approx(len(x & y) / len(x | y))


def test_fingerprints_of_clashing_columns(spark):
    """Names that the operator uses itself; repeated rows; rows without key; one very long text."""
    rng = random.Random(14)
    long = prose(rng, 30_000)
    rows = [(1, "a, b. c", "x", 0), (1, "a, b. c", "x", 0), (None, "tail", "x", 0), (7, long, "x", 0), (9, None, "x", 0)]
    got = fingerprints.edited_fingerprints(spark.createDataFrame(rows, "bucket long, doc string, at string, tail int"), "doc", "bucket").collect()
    assert sorted(str(r.bucket) for r in got) == ["1", "1", "7", "9", "None"]
    assert len({r.fingerprint for r in got if r.bucket == 1}) == 1
    after = fingerprints.with_next(spark.createDataFrame(rows, "bucket long, row string, at string, next_row int"), "bucket", ["row"])
    assert after.columns == ["bucket", "row", "at", "next_row"] and {r.next_row for r in after.collect() if r.bucket == 9} == {long}


def grams(t, n=5):
    w = (t or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def slow_links(rows):
    sets = [grams(t) for _, t in rows]
    n = len(rows)
    linked = [[i != j and (sets[i] == sets[j] or bool(sets[i] | sets[j]) and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])) for j in range(n)] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            x = todo.pop()
            new = {j for j in range(n) if linked[x][j]} - seen
            seen |= new
            todo += new
        keys = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], min(keys) if keys else None, sum(linked[i])))
    return out


def near_copies(rng, n):
    base = [prose(rng, 120).split() for _ in range(3)]
    out = []
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = "zz" + str(rng.randrange(50))
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [2000, 7])
def test_near_duplicates(spark, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", block)
    monkeypatch.setattr(ngram_join, "FREQUENT", 5 if block == 7 else 48)
    rng = random.Random(3)
    rows = [*enumerate([*near_copies(rng, 40), *(prose(rng, 60) for _ in range(10)), *ODD])]
    rows += [(4, rows[4][1]), (4, rows[4][1]), (None, rows[7][1]), (None, "alone and without any key at all"), (77, rows[0][1].upper())]
    out = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    found = sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in out.collect())
    assert found == sorted((str(a), str(b), c) for a, b, c in slow_links(rows))
    kept = ngram_join.one_of_each(spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, text string, _x string"))
    assert kept.columns == ["doc_id", "text", "_x"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted({str(b) for _, b, _ in slow_links(rows)})


def test_no_near_duplicates(spark):
    assert ngram_join.near_duplicates(frame(spark, []).limit(0)).count() == 0
    assert {r.class_id for r in ngram_join.near_duplicates(frame(spark, ["a b c d e f", "g h i j k l"])).collect()} == {0, 1}


def test_bands():
    bands, rows = ngram_join.bands_and_rows(0.8)
    assert bands * rows <= ngram_join.HASHES and 1 - (1 - 0.8**rows) ** bands >= ngram_join.RECALL


def test_top_k(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.normal(0, 0.3, 16).astype(np.float32)]) for i in range(350)]
    rows += [(400, rows[3][1]), (401, rows[3][1]), (402, None), (403, [None, 1.0]), (404, [float("nan")] * 16), (405, [float("inf")] * 16), (None, rows[1][1]), (5, rows[5][1]), (406, [1.0, 2.0]), (500, [])]
    out = topk.top_k(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int"), "vec_id", "embedding", "vec_id % 100 = 0")
    got = {}
    for r in out.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    whole = {(i, tuple(np.floor(1024 * np.array(v)))) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()}
    for q, x in whole:
        if q % 100 == 0:
            scores = sorted((-int(np.dot(x, y)), i) for i, y in whole if i != q and len(y) == len(x))[:10]
            assert sorted(got.pop(q)) == [(k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert not got


def test_top_k_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 20)
    monkeypatch.setattr(topk, "QUERIES", 1)
    rng = np.random.default_rng(8)
    rows = [(i, [float(v) for v in rng.normal(0, 0.3, 8)]) for i in range(201)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding", "vec_id % 100 = 0").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    x = np.floor(1024 * np.array([v for _, v in rows]))
    for q in (0, 100, 200):
        scores = sorted((-int(x[q] @ x[i]), i) for i in range(201) if i != q)[:10]
        assert sorted((r["rank"], r.vec_id, r.score) for r in out if r.query_id == q) == [(k + 1, i, -s) for k, (s, i) in enumerate(scores)]


def test_top_k_of_huge_components(spark):
    """Products beyond a long count as its largest or smallest value and tie; none is lost, none crashes."""
    rows = [(0, [1e9, 2e9]), (1, [1e9, 1e9]), (2, [-1e300, 1.0]), (3, [1e300, 1e300]), (4, [0.5, 0.25]), (5, [1e308, -1e308]), (100, [1e-9, 1.0])]
    got = {}
    for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding", "vec_id % 100 = 0").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    from fractions import Fraction
    from math import floor

    x = {i: [floor(Fraction(a) * 1024) for a in v] for i, v in rows}
    for q in (0, 100):
        scores = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(x[q], y, strict=True)))), i) for i, y in x.items() if i != q)
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(scores)]


def test_top_k_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert topk.top_k(empty, "vec_id", "embedding", "vec_id % 100 = 0").count() == 0


def test_top_k_with_seeds(spark, monkeypatch):
    """Blocks so small that none holds the ten best: the sample's bound drops candidates early, and no result changes."""
    rng = np.random.default_rng(9)
    centers = rng.normal(0, 0.5, (6, 32))
    rows = [(i, [float(v) for v in centers[i % 6] + rng.normal(0, 0.05, 32)]) for i in range(601)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {tuple(r) for r in topk.top_k(frame, "vec_id", "embedding", "vec_id % 100 = 0").collect()}
    monkeypatch.setattr(topk, "CANDIDATES", 50)
    monkeypatch.setattr(topk, "SEEDS", 200)
    assert {tuple(r) for r in topk.top_k(frame, "vec_id", "embedding", "vec_id % 100 = 0").collect()} == whole
    x = np.floor(1024 * np.array([v for _, v in rows]))
    made = [topk.search(x[:1], np.arange(1), x[300:], np.arange(300, 601), 10, s)[2] for s in (None, np.array([np.sort(x[1:300] @ x[0])[-10]]))]
    assert made[1] < made[0]


def test_pruning_is_exact_and_prunes():
    rng = np.random.default_rng(6)
    centers = rng.normal(0, 300, (20, 64))
    data = np.floor(centers[rng.integers(0, 20, 4000)] + rng.normal(0, 30, (4000, 64)))
    ids = np.arange(4000)
    found, scores, made = topk.search(data[:20], ids[:20], data, ids, 10)
    for q in range(20):
        s = data @ data[q]
        s[q] = -np.inf
        assert list(found[q]) == list(np.lexsort((ids, -s))[:10]) and list(scores[q]) == sorted(s, reverse=True)[:10]
    assert made < 0.7 * 20 * 4000


def test_url_rules(spark):
    cases = {
        "https://www.Example.com/en/7198#top": ("www.example.com", "/en/7198", "example.com/en/7", "allow"), "http://a.com/en/x?u=1": ("a.com", "/en/x", "com/en/", "block"),
        "http://xcom/en/x": ("xcom", "/en/x", None, "allow"), "http://example.net/de/8": ("example.net", "/de/8", "example.net/de/8", "block"), "http://n.net/de/": ("n.net", "/de/", "net/de/", "allow"),
        "http://n.net/DE/": ("n.net", "/DE/", None, "allow"), "http://b.org/es": ("b.org", "/es", None, "allow"), "http://b.org/x/cart": ("b.org", "/x/cart", None, "block"),
        None: ("", "", None, "allow"), "no url": ("", "", None, "allow"), "": ("", "", None, "allow"), "x://h?q/en/": ("h", "", None, "allow"), "http://com/en/": ("com", "/en/", "com/en/", "block"),
    }
    rows = spark.createDataFrame([(u, "clash") for u in cases], "url string, host string")
    out = url_filter.filter_urls(rows, [*url_filter.SITE_RULES, *url_filter.PATTERN_RULES])
    assert {r.url: (r.host, r.path, r.rule, r.verdict) for r in out.collect()} == cases
    every = len(url_filter.SITE_RULES) + len(url_filter.PATTERN_RULES)
    assert max(r.tried for r in out.collect()) < every / 2  # only candidates run
    assert url_filter.filter_urls(rows.limit(0), url_filter.SITE_RULES).count() == 0


def test_url_rules_and_clashing_columns(spark):
    rows = spark.createDataFrame([("http://a.com/en/x", 1, 2, 3, 4, "r")], "url string, _tried int, _best int, candidates int, best int, row string")
    r = url_filter.filter_urls(rows, url_filter.SITE_RULES).head()
    assert (r._tried, r._best, r.candidates, r.best, r.row, r.verdict) == (1, 2, 3, 4, "r", "block")


def test_one_of_each_of_clashing_columns(spark):
    names = "doc_id long, text string, _t int, _key int, _hash int, key int, own int, row int, own_hash int, text_hash int, node int"
    rows = [(k, t, 1, 2, 3, 4, 5, 6, 7, 8, 9) for k, t in enumerate(["a b c d e f", "a b c d e f", None, "", "z y x w v u"])]
    out = ngram_join.one_of_each(spark.createDataFrame([*rows, rows[4]], names))
    assert out.columns == [c.split()[0] for c in names.split(", ")]
    assert sorted(tuple(r) for r in out.collect()) == sorted([rows[0], rows[2], rows[4]], key=lambda r: r[0])


def slow_lines(rows):
    strip, lower = " \t\n\x0b\x0c\r", str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    first: dict[str, int] = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = line.strip(strip).translate(lower)
            first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(k := x.strip(strip).translate(lower)) < 10 or first[k] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("batches", [1, 5])
def test_line_dedup(spark, batches):
    rng = random.Random(7)
    shared = [prose(rng, 4) + " shared" for _ in range(12)]
    rows = [(i, "\n".join(rng.choice([rng.choice(shared), rng.choice(shared).upper() + " \t", prose(rng, 5), "short", ""]) for _ in range(rng.randint(1, 9)))) for i in range(60)]
    rows += [(100 + i, t) for i, t in enumerate(ODD)] + [(3, rows[3][1]), (200, "é" * 10), (201, "É" * 10), (202, "é" * 10)]
    out = line_dedup.dedup_lines(spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, n_lines string"), batches=batches)
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in out.collect())
    assert got == sorted(slow_lines(rows))


def test_line_dedup_without_keys(spark):
    rows = spark.createDataFrame([(None, "a line of some length"), (4, "a line of some length"), (None, "another long line")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.text) for r in line_dedup.dedup_lines(rows).collect()) == [("4", "a line of some length"), ("None", ""), ("None", "another long line")]
    assert line_dedup.dedup_lines(rows.limit(0)).count() == 0


def test_lines_of_a_next_corpus(spark, tmp_path):
    """The index of one corpus, opened again in another session, and the next corpora joined with it; an empty one too."""
    rng = random.Random(17)
    shared = [prose(rng, 5) + " shared" for _ in range(15)]

    def corpus(first, n):
        return [(first + i, "\n".join(rng.choice([rng.choice(shared), prose(rng, 6)]) for _ in range(6))) for i in range(n)]

    corpora = [corpus(0, 30), [], corpus(100, 20), corpus(50, 10)]
    want, before = [], []
    for docs in corpora:
        # Documents of an earlier corpus come first, whatever their ids.
        rows = [(10_000 * k + i, t) for k, batch in enumerate([*before, docs]) for i, t in batch]
        want += [(i % 10_000, a, b, t) for i, a, b, t in slow_lines(rows) if i >= 10_000 * len(before)]
        before.append(docs)
    got = []
    for docs in corpora:
        session = spark.newSession()
        out = line_dedup.dedup_lines(session.createDataFrame(docs, "doc_id long, text string"), batches=2, index=line_dedup.LineIndex(session, f"file://{tmp_path}/index"))
        got += [(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()]
    assert sorted(got) == sorted(want)
    index = line_dedup.LineIndex(spark, f"file://{tmp_path}/index")
    every = functools.reduce(lambda a, b: a.unionByName(b), index.runs()).select("h1", "h2")
    assert 1 <= len(index.runs()) <= 3 and every.count() == every.distinct().count()
    again = line_dedup.dedup_lines(spark.createDataFrame(corpora[0], "doc_id long, text string"), index=index)
    assert all(r.n_dropped == 0 or any(r.doc_id == i and n for i, _, n, _ in want) for r in again.collect())


def test_runs_are_read_in_order(spark):
    """One file a bucket; in the merge join the side of a run has neither an exchange nor a sort."""
    index = line_dedup.LineIndex(spark)
    hashes = spark.range(5000).select(F.xxhash64("id").alias("h1"), F.col("id").alias("h2"), F.col("id").alias("first")).repartition(7)
    index.add(hashes)
    run, path, buckets = index.levels[0][0]
    assert len([f for f in os.listdir(path.removeprefix("file:")) if f.endswith(".parquet")]) == buckets
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        with line_dedup._in_order(spark):
            found = index.firsts(hashes.select("h1", "h2"))
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert found.filter("known is null or known <> h2").count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    # Only the batch is dealt and sorted.
    assert "SortMergeJoin" in plan and plan.count(" Sort [") == 1 and plan.count("hashpartitioning") == 1, plan
    assert spark.conf.get(line_dedup.ORDERED) == "false"


def test_line_dedup_of_clashing_columns(spark):
    names = "doc_id long, text string, _t string, _gone string, gone int, t int, own int, row int, key int, doc int, pos int, n_dropped int"
    rows = [(k, "the very same line\nbut " + "x" * 20 + str(k), "a", "b", 1, 2, 3, 4, 5, 6, 7, 8) for k in range(3)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, names))
    assert out.columns == [c.split()[0] for c in names.split(", ")][:-1] + ["n_lines", "n_dropped"]
    assert sorted((r.doc_id, r.n_dropped, r._t, r.pos) for r in out.collect()) == [(0, 0, "a", 7), (1, 1, "a", 7), (2, 1, "a", 7)]


def test_release(spark):
    rows = common.written(spark.range(3), "kept")
    path = common._MADE[-1].removeprefix("file:")
    assert rows.count() == 3 and os.path.isdir(path)
    common.release(spark)
    assert not os.path.exists(path) and not common._MADE and not common._TABLES


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a='<p>x</p>';</script></head><body>
<header><div class="logo">Site</div><nav><ul><li><a href="/">Home</a></li></ul></nav></header><div class="cookie-notice"><p>We use cookies.</p></div>
<article><h1>The &amp; title</h1><p>First   <b>bold</b>
text&nbsp;here.<p>Second &lt;tag&gt; text.<div class="ad"><p>Buy now</p></div><ul><li>one item of it</li><li>two</li></ul></article>
<section class="comments"><h2>Comments</h2><div class="comment"><p>I disagree strongly.</p></div></section><aside><h3>Most read</h3><p>Other story</p></aside>
<form><label>Mail</label><textarea>t</textarea></form><footer>&copy; 2020</footer></body></html>"""


def test_extraction(spark):
    rows = spark.createDataFrame([(1, "u", PAGE, "c"), (2, "v", None, "c"), (3, None, "", "c"), (4, "w", "<nav><a>x</a></nav>", "c"), (5, "w", PAGE, "c"), (6, "z", "a < b <unclosed", "c")], "page_id long, url string, html string, text string")
    out = {r.page_id: r for r in html_extract.extract(rows).collect()}
    assert out[1].text == "The & title\n\nFirst bold text here.\n\nSecond <tag> text.\n\none item of it\n\ntwo"
    assert out[1].n_chars == len(out[1].text) and out[5].text == out[1].text and out[2].text == out[3].text == out[4].text == "" and 6 in out
    assert html_extract.extract(rows.limit(0)).count() == 0


def test_labeller_on_unseen_pages():
    source = html_extract.SamplePages(4242)
    pages = [source.marked() for _ in range(120)]
    scores = html_extract.trained().scores([html_extract.vectors(b) for b, _ in pages])
    wrong = sum(int(((y >= 0.5) != (m >= 0.5)).sum()) for y, (_, m) in zip(scores, pages, strict=True))
    assert wrong / sum(len(m) for _, m in pages) < 0.01


def test_labeller_gradients():
    labeller, rng = html_extract.Labeller(1), np.random.default_rng(2)
    labeller.w = {k: w.astype(np.float64) for k, w in labeller.w.items()}
    x, mask, y = rng.normal(size=(4, 3, html_extract.WIDTH)) * 0.3, np.ones((4, 3)), rng.integers(0, 2, (4, 3)).astype(float)
    mask[3, 1] = mask[2:, 2] = 0

    def loss():
        states = np.concatenate([labeller._run(x @ labeller.w[f"x{d}"] + labeller.w[f"c{d}"], mask, d)[0] for d in "fb"], 2)
        p = html_extract._sigmoid(states @ labeller.w["o"] + labeller.w["p"])[..., 0]
        return -(mask * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / mask.sum()

    g = labeller.gradients(x, mask, y)
    for name in labeller.w:
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        keep, h = labeller.w[name][at], 1e-4
        labeller.w[name][at] = keep + h
        up = loss()
        labeller.w[name][at] = keep - h
        down = loss()
        labeller.w[name][at] = keep
        assert (up - down) / (2 * h) == pytest.approx(g[name][at], rel=0.02)


def test_blocks():
    found = html_extract.blocks('<p title="a>b">x<p>y<br>z</p><ul><li>1<li>2</ul><!-- <p>no</p> --><style>p{}</style>t&#233;st <a href=x>link</a>')
    assert [b.text for b in found] == ["x", "y z", "1", "2", "tést link"] and found[-1].linked == 4
