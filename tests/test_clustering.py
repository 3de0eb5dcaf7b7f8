from __future__ import annotations

import math
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from vialect.functions.similarity import lcs_length
from vialect.operators import clustering, graph, leader_blocks, leg_cells, spatial


def grams(p):
    return {t if len(t) < 3 else t[i : i + 3] for t in p.split() for i in range(max(1, len(t) - 2))}


def jaccard(a, b):
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x and y else 0.0


def ratio(a, b):
    return 2 * lcs_length(a, b) / (len(a) + len(b))


def sequential(names, similarity, threshold):
    leaders, out = [], {}
    for name in names:
        p = name.lower()
        if name in out:
            continue
        best, score = None, 0
        for leader in leaders:
            s = similarity(p, leader)
            if s > score:
                best, score = leader, s
        if best is not None and score >= threshold:
            out[name] = best
        else:
            leaders.append(p)
            out[name] = p
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_leaders_equal_a_loop(spark, seed):
    rng = random.Random(seed)
    stems = ["sturov", "kolarov", "hlavna", "jesenskeho", "palarik", "safarik", "nova", "novova"]
    names = ["".join(w if rng.random() > 0.2 else w.capitalize() for w in [rng.choice(stems)]) + rng.choice(["", "a", "o", "ho", " dolna", "x"]) for _ in range(120)]
    rows = spark.createDataFrame(list(enumerate(names)), "pos long, name string")
    got = {r["name"]: r.group_id for r in clustering.leader_jaccard(rows).collect()}
    assert got == sequential(names, jaccard, 0.5)
    got = {r["name"]: r.group_id for r in clustering.leader_indel(rows).collect()}
    assert got == sequential(names, ratio, 0.8)


@pytest.mark.parametrize("threshold", [0.8, 0.67, 0.6])
def test_indel_edges_equal_all_pairs(spark, threshold):
    rng = random.Random(5)
    names = sorted({"".join(rng.choice("abcde") for _ in range(rng.randint(1, 9))) for _ in range(150)} - set("abcde")) + ["aa bb", "z"]
    rows = spark.createDataFrame([(i, p, p) for i, p in enumerate(names)], "pos long, name string, p string")
    got = {(r.i, r.j) for r in clustering.indel_edges(rows, threshold).collect()}
    assert got == {(i, j) for i, a in enumerate(names) for j, b in enumerate(names[:i]) if ratio(a, b) >= threshold}


@pytest.mark.parametrize("eps", [0.5, 1.5, 4.0])
def test_points_of_the_plane(spark, eps):
    """Clusters in two dimensions against a search over all pairs; hot places, nulls and several keys."""
    rng = random.Random(int(eps * 10))
    points = [(i, rng.choice("ab"), rng.gauss(0, 6), rng.gauss(0, 6)) for i in range(150)] + [(200 + i, "a", 1.0, 2.0) for i in range(40)] + [(300, "a", None, 1.0), (301, None, 0.0, 0.0)]
    rng.shuffle(points)
    got = {r.id: r.cluster_id for r in spatial.point_components(spark.createDataFrame(points, "id long, name string, x double, y double"), eps).collect()}
    want = {i: None for i, *_ in points}
    for key in "ab":
        left = {i: (x, y) for i, k, x, y in points if k == key and x is not None}
        while left:
            first = min(left)
            todo, seen = [left.pop(first)], [first]
            while todo:
                x, y = todo.pop()
                near = [i for i, (u, v) in left.items() if (x - u) ** 2 + (y - v) ** 2 <= eps * eps]
                seen += near
                todo += [left.pop(i) for i in near]
            want |= dict.fromkeys(seen, first)
    assert got == want


def test_leaders_of_nothing(spark):
    rows = spark.createDataFrame([(0, "Ulica"), (1, "")], "pos long, name string")
    assert clustering.leader_jaccard(rows).count() == 0


def union_find(n, edges):
    root = list(range(n))
    for a, b in edges:
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        root[max(a, b)] = min(a, b)
    return [next(r for r in iter(lambda x=[i]: x.__setitem__(0, root[x[0]]) or x[0], None) if root[r] == r) for i in range(n)]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)] + [(7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = union_find(131, edges)
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: want[x] for x in touched}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_points_within_a_distance(spark):
    rng = random.Random(4)
    points = [(i, rng.choice("ab"), rng.uniform(0, 30), rng.uniform(0, 30)) for i in range(150)]
    rows = spark.createDataFrame([*points, (900, "a", None, 1.0), (901, "a", points[0][2], points[0][3])], "id long, name string, x double, y double")
    got = {r.id: r.cluster_id for r in spatial.point_components(rows, 2.0).collect()}
    near = [(i, j) for i, k, x, y in points for j, m, u, v in points if i < j and k == m and (x - u) ** 2 + (y - v) ** 2 <= 4]
    want = union_find(150, near)
    assert got[900] is None and {i: got[i] for i in range(150)} == dict(enumerate(want))
    assert got[901] == (got[0] if points[0][1] == "a" else got[901])


def test_segments(spark):
    def line(*p):
        return [{"x": float(x), "y": float(y)} for x, y in p]

    rows = [(0, "n", line((0, 0), (100, 0))), (1, "n", line((50, -40), (50, 40))), (2, "n", line((100, 9), (200, 9))), (3, "n", line((100, 20.1), (150, 20.1))), (4, "m", line((0, 0), (1, 0))), (5, "n", None), (6, "n", line((500, 500)))]
    frame = spark.createDataFrame(rows, "line_id long, name string, way array<struct<x:double,y:double>>")
    got = {r.line_id: r.cluster_id for r in spatial.segment_components(frame, 10.0).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: None, 6: 6}
    assert frame.filter(F.col("way").isNull()).count() == 1


def to_segment(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    size = dx * dx + dy * dy
    t = max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / size)) if size else 0.0
    return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)


def apart(a, b, c, d):
    def side(p, q, r):
        return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])

    crosses = side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0
    return 0.0 if crosses else min(to_segment(a, c, d), to_segment(b, c, d), to_segment(c, a, b), to_segment(d, a, b))


@pytest.mark.parametrize(("seed", "eps", "spread"), [(1, 1.0, 12), (2, 3.0, 40), (3, 0.4, 3), (4, 2.0, 12)])
def test_segments_equal_all_pairs(spark, seed, eps, spread):
    """Lines of one to four points in all directions and quadrants, some through many cells, against a search over all pairs."""
    rng = random.Random(seed)
    rows = []
    for i in range(160):
        way = [(rng.uniform(-spread, spread), rng.uniform(-spread, spread))]
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            step = rng.choice([0.3, 1, 3]) * eps
            way.append((way[-1][0] + rng.choice([0, 1, rng.gauss(0, 1)]) * step, way[-1][1] + rng.choice([0, -1, rng.gauss(0, 1)]) * step))
        rows.append((i * 7 % 160, rng.choice("abc"), way))
    rows += [(500 + i, "a", rows[3][2]) for i in range(5)]
    legs = {i: list(zip(w, w[1:], strict=False)) or [(w[0], w[0])] for i, _, w in rows}
    near = [(i, j) for i, k, _ in rows for j, m, _ in rows if i < j and k == m and any(apart(*x, *y) <= eps for x in legs[i] for y in legs[j])]
    want = union_find(505, near)
    odd = [(900, "a", [(math.nan, 0.0), (1.0, 1.0)]), (901, "a", None), (902, "a", []), (903, None, rows[0][2]), (904, "a", [(math.inf, 0.0)])]
    frame = spark.createDataFrame([(i, k, w and [{"x": x, "y": y} for x, y in w]) for i, k, w in rows + odd], "line_id long, name string, way array<struct<x:double,y:double>>")
    got = {r.line_id: r.cluster_id for r in spatial.segment_components(frame, eps).collect()}
    assert got == {i: want[i] for i in legs} | {900: 900, 901: None, 902: None, 903: None, 904: 904}


def test_many_segments_in_one_place(spark):
    """40,000 different lines within a few cells, and as many in a place just out of reach: far too many to measure in pairs."""
    k = F.col("id")
    x, y = (F.pmod(F.xxhash64(k, F.lit(c)), F.lit(10_000)) / 2500 + F.when(k % 2 == 0, 0.0).otherwise(d) for c, d in (("x", 14.5), ("y", 0.0)))
    rows = spark.range(80_000, numPartitions=4).select(k.alias("line_id"), F.lit("n").alias("name"), F.array(F.struct(x.alias("x"), y.alias("y")), F.struct((x + 0.4).alias("x"), (y + 0.1).alias("y"))).alias("way"))
    stop = threading.Timer(120, spark.sparkContext.cancelAllJobs)
    stop.start()
    try:
        found = {tuple(r) for r in spatial.segment_components(rows, 10.0).groupBy("cluster_id").count().collect()}
    finally:
        stop.cancel()
    assert found == {(0, 40_000), (1, 40_000)}


def test_copied_segments_on_an_axis(spark):
    """200,000 lines at 50 places, 4,000 copies each; gaps of 4.5 and 5.5 by turns."""
    k = F.col("id")
    x = F.floor((k % 50) / 2) * 11.0 + (k % 2) * 5.0
    rows = spark.range(200_000, numPartitions=4).select(k.alias("line_id"), F.lit("n").alias("name"), F.array(*[F.struct(c.alias("x"), F.lit(0.0).alias("y")) for c in (x, x + 0.5)]).alias("way"))
    stop = threading.Timer(120, spark.sparkContext.cancelAllJobs)
    stop.start()
    try:
        found = {tuple(r) for r in spatial.segment_components(rows, 5.005).groupBy("cluster_id").count().collect()}
    finally:
        stop.cancel()
    assert found == {(2 * i, 8_000) for i in range(25)}


@pytest.mark.parametrize("block", [40])
def test_leaders_by_blocks_equal_a_loop(spark, block):
    """Over several blocks, with names given twice, words of one and two letters, and equal similarities."""
    rng = random.Random(9)
    stems = ["sturov", "kolarov", "hlavna", "jesenskeho", "palarik", "safarik", "nova", "novova", "x1", "7", "ab"]
    names = [" ".join(rng.choice(stems) + rng.choice(["", "a", "ho"]) for _ in range(rng.randint(1, 5))) for _ in range(150)]
    rows = spark.createDataFrame([(3 * i, n) for i, n in enumerate(names)] + [(1, ""), (2, None)], "pos long, name string")
    at = {3 * i: n for i, n in enumerate(names)}
    found = {at[r.pos]: at[r.leader] for r in leader_blocks.leader_positions(rows, block=block).collect()}
    assert found == sequential(names, jaccard, 0.5)
    assert leader_blocks.leader_positions(rows.filter("pos in (1, 2)"), block=block).count() == 0


def test_leaders_of_long_texts(spark):
    """600 texts of one language share most of their n-grams: nearly all pairs share one of the rarer ones."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeiorst") for _ in range(6)) for _ in range(400)]
    names = [" ".join(rng.sample(words, rng.randint(40, 160))) for _ in range(600)]
    rows = spark.createDataFrame(list(enumerate(names)), "pos long, name string").repartition(4)
    stop = threading.Timer(60, spark.sparkContext.cancelAllJobs)
    stop.start()
    try:
        found = {r.pos: r.leader for r in leader_blocks.leader_positions(rows).collect()}
    finally:
        stop.cancel()
    grams_of = [grams(n) for n in names]
    want, leaders = {}, []
    for i, g in enumerate(grams_of):
        s, j = max(((len(g & grams_of[j]) / len(g | grams_of[j]), -j) for j in leaders), default=(0, 0))
        want[i] = -j if s >= 0.5 else i
        leaders += [i] if s < 0.5 else []
    assert found == want


@pytest.mark.parametrize("count", [1, 40, 400, 5000])
def test_bounds_of_leaders(monkeypatch, count):
    """However few n-grams have columns, the leaders are those of all pairs; with most of them few pairs are compared further."""
    monkeypatch.setattr(leader_blocks, "COLUMNS", count)
    compared, exact = [], leader_blocks.similarities
    monkeypatch.setattr(leader_blocks, "similarities", lambda x, i, *rest: compared.append(len(i)) or exact(x, i, *rest))
    rng = np.random.default_rng(count)
    roots = [rng.choice(3000, 300, False) for _ in range(3)]
    sets = [np.unique(np.concatenate([rng.choice(roots[k % 3], rng.integers(1, 280), False), rng.integers(0, 3000, 5)])).astype(np.uint16) for k in range(600)]
    sets += [s[: len(s) - k % 3] for k, s in enumerate(sets[:100])]
    pos = np.arange(len(sets)) * 2
    want, leaders = [], []
    for i, a in enumerate(sets):
        s, j = max(((c / (len(a) + len(sets[j]) - c), -j) for j in leaders for c in [len(np.intersect1d(a, sets[j]))]), default=(0, 0))
        want.append(-j if s >= 0.5 else i)
        leaders += [i] if s < 0.5 else []
    column = leader_blocks.columns(np.bincount(np.concatenate(sets), minlength=leader_blocks.BASE**3))
    x = leader_blocks.Counted(leader_blocks.Sets(pos, sets), column)
    found = np.sort(x.pos[leader_blocks.leading(x, 0.5)]) // 2
    assert found.tolist() == leaders
    parts = [leader_blocks.Sets(pos[k], [sets[i] for i in k]) for k in np.array_split(found, 3)]
    where, _ = leader_blocks.best(x, parts, column, 0.5)
    assert {p // 2: (p if w < 0 else w) // 2 for p, w in zip(x.pos, where, strict=True)} == dict(enumerate(want))
    assert count < 5000 or sum(compared[1:]) < 0.05 * len(sets) * len(leaders)


@pytest.mark.parametrize(("seed", "few"), [(1, 200_000), (2, 0)])
def test_segments_over_tiles_equal_all_pairs(spark, monkeypatch, seed, few):
    """Lines about the corners of tiles, crowded cells, long legs and lines with holes, by ids that are texts, against a search over all pairs."""
    monkeypatch.setattr(spatial, "FEW", few)
    rng, eps = random.Random(seed), 1.0
    corner = leg_cells.MIDDLE * eps / math.sqrt(2)
    rows = []
    for i in range(420):
        if i < 240:
            x, y, d = rng.choice([-corner, corner]) + rng.gauss(0, 6), rng.choice([-corner, corner]) + rng.gauss(0, 6), 1.0
        elif i < 400:  # crowded cells on both sides of a border
            x, y, d = corner + rng.choice([-0.75, 0.75, 2.4]) + rng.uniform(-0.3, 0.3), rng.choice([30, 32.6]) + rng.uniform(-0.3, 0.3), 0.05
        else:
            x, y, d = rng.uniform(-300, 300), rng.uniform(-300, 300), 90.0
        way = [(x, y)]
        for _ in range(rng.choice([0, 1, 1, 2])):
            way.append((way[-1][0] + rng.gauss(0, d), way[-1][1] + rng.choice([0, rng.gauss(0, d)])))
        rows.append((f"{i * 13 % 420:03}", rng.choice("aab"), way))
    hole = (math.nan, 0.0)
    rows += [("600", "a", [(500.0, 0.0), (500.5, 0.0), hole, (-500.0, 0.0), (-500.5, 0.0)]), ("601", "a", [(-500.9, 0.0)]), ("602", "a", [(500.0, 0.7), None]), ("603", "b", [(500.0, 0.0)])]
    legs = {}
    for i, _, w in rows:
        each = [(p, q or p) for p, q in zip(w, w[1:] or w, strict=False) if p]
        legs[i] = [g for g in each if hole not in g]
    ids = sorted(legs)
    near = [(ids.index(i), ids.index(j)) for i, k, _ in rows for j, m, _ in rows if i < j and k == m and any(apart(*x, *y) <= eps for x in legs[i] for y in legs[j])]
    want = {i: ids[r] for i, r in zip(ids, union_find(len(ids), near), strict=True)}
    frame = spark.createDataFrame([(i, k, [p and {"x": p[0], "y": p[1]} for p in w]) for i, k, w in rows], "line_id string, name string, way array<struct<x:double,y:double>>")
    got = {r.line_id: (r.name, r.cluster_id) for r in spatial.segment_components(frame, eps, keyed=True).collect()}
    assert got == {i: (k, want[i]) for i, k, _ in rows}
    assert len(set(want.values())) > 20 and want["601"] == want["602"] == "600"


def test_crowded_cells_left_open(spark, monkeypatch):
    """Two crowded cells that only legs which aren't outermost bring within reach, and two whose bounds alone are."""
    asked = []
    monkeypatch.setattr(spatial, "segment_distance", lambda *legs, f=spatial.segment_distance: asked.append(1) or f(*legs))
    rows = []
    for k, x in (("near", 16.4), ("far", 16.6)):
        rows += [(k, 0.1, 3.0), (k, 6.6, 0.1), (k, 6.0, 7.0), (k, 6.5, 3.5)] + [(k, 1 + i / 100, 3.5) for i in range(20)]
        rows += [(k, 16.3, 7.0), (k, 20.5, 0.1), (k, x, 3.5)] + [(k, 20 + i / 100, 3.5) for i in range(20)]
    frame = spark.createDataFrame([(i, k, [{"x": x, "y": y}]) for i, (k, x, y) in enumerate(rows)], "line_id long, name string, way array<struct<x:double,y:double>>")
    got = {r.line_id: r.cluster_id for r in spatial.segment_components(frame, 10.0).collect()}
    near = [(i, j) for i, (k, x, y) in enumerate(rows) for j, (m, u, v) in enumerate(rows) if i < j and k == m and math.hypot(x - u, y - v) <= 10]
    assert got == dict(enumerate(union_find(len(rows), near))) and len(set(got.values())) == 3 and asked


def test_segments_in_few_jobs(spark):
    """A chain of 30,000 lines over many tiles, copies and lines apart: cells are joined by tiles, not in rounds of jobs over all of them."""
    k = F.col("id")
    x = F.floor(k / 2) * 5.0 + F.when(k >= 60_000, 100.0).otherwise(0.0)
    rows = spark.range(80_000, numPartitions=4).select(k.alias("line_id"), F.lit("n").alias("name"), F.array(*[F.struct(c.alias("x"), F.lit(0.0).alias("y")) for c in (x, x + 0.5)]).alias("way"))
    spark.sparkContext.setJobGroup("few jobs", "test_segments_in_few_jobs")
    try:
        found = {tuple(r) for r in spatial.segment_components(rows, 5.005).groupBy("cluster_id").count().collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found == {(0, 60_000), (60_000, 20_000)}
    assert 0 < len(spark.sparkContext.statusTracker().getJobIdsForGroup("few jobs")) < 25
