from __future__ import annotations

import datetime
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vialect import schemas
from vialect.functions import geo
from vialect.operators import enrich, evaluation, ground_truth, lengths, mappings, normalizers, tiles
from vialect.plans import cli
from vialect.settings import Settings
from vialect.sources import files, services
from vialect.streaming import groups

GROUPED = "wikidata_id,entity_label,is_human,street_names\nQ1,Ann Old,True,Annova; A. Anny; Anna\nQ2,\"Bo, B\",False,Bova; Annova\n"


@pytest.fixture
def grouped_csv(tmp_path):
    path = tmp_path / "g.csv"
    path.write_text(GROUPED)
    return str(path)


def test_evaluate(spark, grouped_csv, tmp_path, capsys):
    out = cli.evaluate(spark, grouped_csv, ["suffix_stripping"], normalizers.default_registry(), str(tmp_path / "e"), True)
    row = out.head()
    assert (row.total_entities, row.total_variants, row.total_groups, row.colliding_groups) == (2, 5, 2, 1)
    assert (row.grouping_rate, row.collision_rate) == (0.75, 0.5)
    assert "suffix_stripping" in capsys.readouterr().out
    text = "".join(r[0] for r in spark.read.text(str(tmp_path / "e")).collect())
    assert json.loads(text)["method"] == "suffix_stripping"


def test_evaluation_by_hand(spark):
    rows = [("Q1", "a", "x"), ("Q1", "a", "x"), ("Q1", "a", "y"), ("Q2", "b", "x"), ("Q2", "b", ""), ("Q3", "c", "")]
    assigned = spark.createDataFrame(rows, "wikidata_id string, entity_label string, group_id string")
    s = evaluation.summary(assigned).head()
    assert (s.grouping_rate, s.collision_rate, s.total_entities, s.total_variants) == (pytest.approx((2 / 3 + 1) / 2), 0.5, 2, 4)
    assert [tuple(r) for r in evaluation.collisions(assigned).orderBy("wikidata_id").collect()] == [("x", "Q1", "a"), ("x", "Q2", "b")]
    assert [r.wikidata_id for r in evaluation.problem_entities(assigned).collect()] == ["Q1"]
    empty = evaluation.summary(assigned.limit(0)).head()
    assert (empty.grouping_rate, empty.collision_rate, empty.total_groups) == (0.0, 0.0, 0)


def test_report_order_and_rounding(spark):
    """All problem entities beyond the console's ten, equal scores and collisions in the order of the ground truth."""
    rows = [(f"Q{90 - e}", f"label {e}", f"n{e}-{k}", 10 * e + k, f"g{e}" if k else "shared" if e > 3 else f"h{30 - e}") for e in range(20) for k in range(3)]
    rows += [("Q5", "same", "x", 900, "h29"), ("Q5", "same", "y", 901, "h29")]
    r = evaluation.report(spark.createDataFrame(rows, "wikidata_id string, entity_label string, name string, pos long, group_id string"), "m").head()
    assert [(e.wikidata_id, e.score, e.dominant_count) for e in r.problem_entities] == [(f"Q{90 - e}", 0.6667, 2) for e in range(20)]
    assert [c.group_id for c in r.collisions] == ["h29", "shared"] and [(e.wikidata_id, e.label) for e in r.collisions[0].entities] == [("Q89", "label 1"), ("Q5", "same")]
    assert [e.wikidata_id for e in r.collisions[1].entities] == [f"Q{90 - e}" for e in range(4, 20)]


def test_mapping_groups(spark):
    rows = [("a", 5.0, 1, 1, 0, "g"), ("b", 5.0, 2, 1, 1, "g"), ("c", 0.0, 1, 1, 2, "h"), ("d", 9.0, 1, 1, 3, "")]
    frame = spark.createDataFrame(rows, "name string, total_m double, segments_count long, street_count long, pos long, group_id string")
    found = {r.group_id: r for r in mappings.groups(frame).collect()}
    assert found["g"].representative == "a" and found["g"].variants == ["a", "b"] and found["h"].representative is None and set(found) == {"g", "h"}
    assert mappings.nested(frame, "m").head().mapping == {"a": "g", "b": "g", "c": "h"}


def test_lengths_reader(spark, tmp_path):
    (tmp_path / "l.csv").write_text('name,total_m,segments_count,street_count\n" A, b ",1.5,2,1\nshort,1\nC,2,1,1,extra\n')
    assert [tuple(r) for r in files.read_lengths(spark, str(tmp_path / "l.csv")).orderBy("name").collect()] == [("A, b", 1.5, 2, 1), ("C", 2.0, 1, 1)]


def lines(spark):
    def way(x, y, dx):
        return [{"x": 1_900_000.0 + x, "y": 6_200_000.0 + y}, {"x": 1_900_000.0 + x + dx, "y": 6_200_000.0 + y}]

    tag = {"name:etymology:wikidata": "Q1"}
    rows = [
        ("Main", "residential", tag, way(0, 0, 100)), ("Main", "residential", {}, way(150, 0, 100)), ("Main", "residential", {}, way(5000, 0, 100)),
        ("Side", "path", {}, None), (None, "path", {}, way(0, 0, 1)), ("Off", None, {}, way(0, 0, 1)),
    ]
    return spark.createDataFrame(rows, schemas.LINES)


def test_street_lengths(spark):
    found = [tuple(r) for r in lengths.street_lengths(lines(spark)).collect()]
    assert [r[0] for r in found] == ["Side", "Main"] and found[0][1:] == (None, 1, 0)
    assert found[1][2:] == (3, 2) and found[1][1] == pytest.approx(300 * math.cos(math.radians(48.58)), rel=0.01)
    assert [r[0] for r in lengths.untagged(lines(spark)).collect()] == ["Main", "Side"]
    counted = lengths.tag_counts(lengths.named(lines(spark)), F.try_element_at("tags", F.lit("name:etymology:wikidata"))).head()
    assert tuple(counted) == (2, 1)
    assert [tuple(r) for r in ground_truth.pairs(lines(spark)).collect()] == [("Main", "Q1")]


def test_geodesy():
    def one(*p):
        return geo.vincenty(*(np.array([float(x)]) for x in p))[0]

    assert one(0, 0, 1, 0) == pytest.approx(111319.49, abs=0.01)
    assert one(0, 0, 0, 1) == pytest.approx(110574.39, abs=0.01)
    assert one(17.1, 48.1, 17.1, 48.1) == 0
    east, north = geo.krovak(np.array([17.1, 17.1013]), np.array([48.15, 48.15]))
    assert math.hypot(east[1] - east[0], north[1] - north[0]) == pytest.approx(one(17.1, 48.15, 17.1013, 48.15), rel=2e-3)


def test_tiles(spark):
    assert tiles.clip([(-10, 5), (20, 5)], 0, 10) == [[(0.0, 5.0), (10.0, 5.0)]] and tiles.clip([(20, 20), (30, 30)], 0, 10) == []
    assert tiles.encode([]) == b""
    body = tiles.encode([({"name": "A", "highway": None}, [[(0, 0), (5, 5)]])])
    assert body[0] == 0x1A and b"streets" in body and b"name" in body and b"highway" in body or b"highway" not in body
    found = tiles.tiles(tiles.features(lines(spark), 14)).collect()
    assert found and all(r.mvt for r in found) and sum(r.n_features for r in found) >= 3
    r = found[0]
    assert tiles.tile(lines(spark), r.z, r.x, r.y).head().mvt == r.mvt


def test_enrichment(spark):
    quick = Settings(llm_delay=0, request_delay=0)
    names = spark.createDataFrame([("Štúrova",), ("Hlavná",), ("bad",)], "name string")
    cache = spark.createDataFrame([("m", "Hlavná", "", "2020-01-01")], schemas.LLM_CACHE)
    out = enrich.warm(names, cache, "m", enrich.stub_reply, quick)
    assert {r["name"]: r.group_id for r in enrich.assign(names, out, "m").collect()} == {"Štúrova": "sturova", "Hlavná": "", "bad": "bad"}
    assert enrich.cache_date(out, "m").head()[0] == datetime.date.today().isoformat()

    def broken(task, message, most):
        raise RuntimeError("down")

    assert {r.canonical for r in enrich.warm(names, cache, "m", broken, quick).collect()} == {""}
    fallback = Settings(llm_delay=0, llm_fallback=True)
    assert "sturova" in {r.canonical for r in enrich.warm_single(names, cache, "m", broken, fallback).collect()}

    payload = json.dumps({"entities": {"Q1": {"labels": {"en": {"value": "Ann"}}, "aliases": {"sk": [{"value": "Anna"}]}, "claims": {"P31": [{"mainsnak": {"datavalue": {"value": {"id": "Q5"}}}}, {"mainsnak": {}}]}}}})
    ids = spark.createDataFrame([("Q1",), ("Q2",)], "qid string")
    got = enrich.fetch_entities(ids, spark.createDataFrame([], schemas.ENTITIES), {"Q1": payload}.__getitem__, quick).collect()
    assert [tuple(r) for r in got] == [("Q1", ["Anna", "Ann"], ["Q5"], True, "Anna")]


def test_answers_are_saved_batch_by_batch(spark, tmp_path, monkeypatch):
    """A job that fails keeps what was answered before; run again it asks only for the rest."""
    path, quick = f"{tmp_path}/answers", Settings(llm_delay=0, llm_batch=2)
    names = spark.createDataFrame([(f"name {k}",) for k in range(7)], "name string")
    real, calls = files.append_cache, []

    def failing(rows, where):
        calls.append(rows.count())
        if len(calls) == 3:
            raise RuntimeError("lost")
        real(rows, where)

    monkeypatch.setattr(files, "append_cache", failing)
    with pytest.raises(RuntimeError):
        enrich.warm_saved(names, path, "m", enrich.stub_reply, quick)
    assert spark.read.parquet(path).count() == 4
    calls.clear()
    saved = enrich.warm_saved(names, path, "m", enrich.stub_reply, quick)
    assert calls == [2, 1] and {r.canonical for r in saved.collect()} == {f"name {k}" for k in range(7)}
    assert enrich.warm_saved(names, path, "m", enrich.stub_reply, quick).count() == 7 and len(calls) == 2
    method = normalizers.ModelNormalizer("openai", "m", enrich.stub_reply, path=path)
    assert {r.group_id for r in method(names).collect()} == {f"name {k}" for k in range(7)}


def test_services(monkeypatch):
    """Requests and replies of each adapter against a server of our own."""
    import http.server
    import threading

    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def _reply(self):
            size = int(self.headers.get("Content-Length") or 0)
            seen.append((self.path, dict(self.headers), json.loads(self.rfile.read(size) or b"null")))
            bodies = {"/entity/Q1.json": {"entities": {}}, "/openai": {"choices": [{"message": {"content": "a"}}]}, "/anthropic": {"content": [{"text": "b"}]}, "/gemini/g:generateContent": {"candidates": [{"content": {"parts": [{"text": "c"}]}}]}}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(bodies[self.path]).encode())

        do_GET = do_POST = _reply  # noqa: N815

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    try:
        assert json.loads(services.entity_source(address=f"{at}/entity")("Q1")) == {"entities": {}} and seen[0][1]["User-Agent"] == services.AGENT
        for provider, model, want in (("openai", "o", "a"), ("anthropic", "h", "b"), ("gemini", "g", "c")):
            monkeypatch.delenv(services.KEYS[provider], raising=False)
            assert services.model_source(provider, model) is None
            monkeypatch.setenv(services.KEYS[provider], "secret")
            assert services.model_source(provider, model, address=f"{at}/{provider}")("task", "message", 5) == want
            assert "task" in json.dumps(seen[-1][2]) and "message" in json.dumps(seen[-1][2]) and "secret" in str(seen[-1][1])
        with pytest.raises(OSError):
            services.entity_source(Settings(request_timeout=0.2), "http://127.0.0.1:9")("Q1")
    finally:
        server.shutdown()


def test_registry(spark):
    registry = normalizers.default_registry()
    assert registry.ids() == ["suffix_stripping", "levenshtein", "ngram", "llm_gpt4o_mini", "llm_claude_haiku", "llm_gemini_flash"]
    with pytest.raises(KeyError):
        registry.get("none")
    names = spark.createDataFrame([("Štúrova", 0)], "name string, pos long")
    with pytest.raises(LookupError):
        registry.get("llm_gpt4o_mini")(names)
    registry.register("first", normalizers.from_function(lambda n: n[0]))
    assert registry.get("first")(names).head().group_id == "Š"


def test_upsert_and_caches(spark, tmp_path):
    old = spark.createDataFrame([("a", "1"), ("b", "2")], schemas.METADATA)
    new = spark.createDataFrame([("a", "3"), ("c", "4")], schemas.METADATA)
    assert sorted(map(tuple, lengths.upsert(old, new).collect())) == [("a", "3"), ("b", "2"), ("c", "4")]
    assert files.read_or_empty(spark, str(tmp_path / "none"), schemas.METADATA).count() == 0
    files.append_cache(old, str(tmp_path / "c"))
    assert files.read_or_empty(spark, str(tmp_path / "c"), schemas.METADATA).count() == 2
    wkt = spark.createDataFrame([("LINESTRING(1 2, 3 4.5)",), ("POINT(1 2)",)], "w string").select(files.parse_line(F.col("w")).alias("p")).collect()
    assert [None if r.p is None else [tuple(q) for q in r.p] for r in wkt] == [[(1.0, 2.0), (3.0, 4.5)], None]


def test_command_line_flow(spark, tmp_path):
    table = str(tmp_path / "lines")
    lines(spark).write.parquet(table)
    cli.compute(spark, table, str(tmp_path / "out"), str(tmp_path / "untagged"), None)
    out = cli.export_mappings(spark, str(tmp_path / "out"), str(tmp_path / "m"), ["suffix_stripping", "ngram"], normalizers.default_registry())
    assert out.count() == 2
    cli.make_ground_truth(spark, table, str(tmp_path / "none"), str(tmp_path / "gt"), str(tmp_path / "gg"))
    assert files.read_csv(spark, str(tmp_path / "gt"), schemas.GROUND_TRUTH).head().confidence == 0.0


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("Štúrova", datetime.datetime(2024, 1, 1)), ("Ulica", datetime.datetime(2024, 1, 1))], "name string, ts timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = groups.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.group_id, r.n) for r in spark.table("counts").collect()] == [("stur", 1)]
