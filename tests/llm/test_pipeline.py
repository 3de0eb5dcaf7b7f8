"""The registered queries against their SQL, and each stage of the pipeline against brute force on its own input."""

from __future__ import annotations

import os

import pytest

import corpus_pipeline
from tests.llm.test_matching import slow_lines, slow_links
from vialect.llm import langid, queries

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SMALL)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, want))


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, inputs = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        inputs[name] = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] if "text" in docs.columns else []
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    kept = {i for i, _ in inputs["language ID"]}
    good = [i for i, q in quality.items() if q == 1]
    assert sum(i in kept for i in good) > 0.9 * len(good) and len(kept) < len(inputs["quality classifier"])
    assert {i for i, _ in inputs["line dedup"]} == {i for i, t in inputs["language ID"] if t and langid.LETTER.search(t)}
    assert sorted(inputs["n-gram Jaccard join"]) == sorted((i, t) for i, _, _, t in slow_lines(inputs["line dedup"]))
    assert sorted(i for i, _ in inputs["packing"]) == sorted({c for _, c, _ in slow_links(inputs["n-gram Jaccard join"])})
    pieces = docs.collect()
    assert {r.doc_id for r in pieces} == {i for i, _ in inputs["packing"]}
    assert sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0)


NAMES = "doc_id long, text string, lang string, source string, n_chars long, _t int, key int, gone int, score string, predicted string, lang_pred string, own int, row int, node int"


def tables(spark, folder, rows):
    extra = (1, 2, 3, "s", "p", "l", 4, 5, 6)
    spark.createDataFrame([(i, t, lang, "web", len(t or ""), *extra) for i, t, lang in rows], NAMES).write.parquet(f"file://{folder}/documents.parquet")
    labels = [(i, int(t is not None and "####" not in t), 0) for i, t, _ in rows if i is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{folder}/labels.parquet")
    return f"file://{folder}"


def test_stages_with_odd_rows_and_columns(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows, and columns of names that the operators use."""
    good = ["The river runs under the old bridge, and the mill has stood there for years.", "Nobody in the village remembers when the road was built or who built it."]
    rows = [(i, f"{good[i % 2]} Number {'abcdefgh'[i % 8]} of the long list number {i}.\nA line that all of the documents share.", "en") for i in range(60)]
    rows += [(100 + i, "#### @@ || " * 9, "en") for i in range(30)]
    rows += [rows[3], rows[3], (None, rows[5][1], None), (200, None, None), (201, "", None), (202, " \n", "en"), (203, " ".join(good * 2000), None), (204, good[0], None), (205, good[0], None)]
    folder = tables(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, folder).write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True)
    kept = {r.doc_id: r for r in docs.collect()}
    assert len(kept) == counts[-1] and 203 in kept and 204 in kept and not any(i in kept for i in range(100, 130))
    assert all((r._t, r.key, r.score, r.own, r.node) == (1, 2, "s", 4, 6) for r in kept.values())
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in pieces} == set(kept)


def test_pipeline_of_empty_tables(spark, tmp_path):
    folder = tables(spark, tmp_path, [(1, "x", "en")])
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    empty.write.parquet(f"file://{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"file://{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/none").count() == 0
