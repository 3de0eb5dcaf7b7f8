"""Density clusters with one point as minimum: components of the graph of neighbours within a distance."""

from __future__ import annotations

import math

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vialect.operators import leg_cells
from vialect.operators.graph import components, stored

#: Edges that the driver joins by itself.
FEW = 200_000


def point_components(points: DataFrame, eps: float, id_: str = "id", key: str = "name", x: str = "x", y: str = "y") -> DataFrame:
    """(id, cluster_id) of points within ``eps`` of each other, directly or over others, inside each key.

    Cells have the diagonal ``eps``, so all points of a cell are one cluster, named by its smallest id; of two cells that
    are near each other the closest points decide. Components are sought among the cells only, so their rounds don't see
    the points. Points of equal place are taken once.
    """
    side = eps / math.sqrt(2)
    here = F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(key).isNotNull()
    cells = points.filter(here).select(F.col(id_).alias("id"), F.col(key).alias("k"), F.col(x).alias("x"), F.col(y).alias("y"), F.floor(F.col(x) / side).alias("cx"), F.floor(F.col(y) / side).alias("cy"))
    heads = cells.groupBy("k", "cx", "cy").agg(F.min("id").alias("head"))
    places = cells.groupBy("k", "cx", "cy", "x", "y").agg(F.min("id").alias("id"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(3) for j in range(-2, 3) if (i, j) > (0, 0)])
    sent = places.withColumn("s", F.explode(steps)).select("k", (F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("cx").alias("fx"), F.col("cy").alias("fy"))
    near = places.join(sent, ["k", "cx", "cy"]).filter(F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2")) <= eps)
    linked = near.select("k", "cx", "cy", "fx", "fy").distinct().join(heads, ["k", "cx", "cy"])
    across = linked.join(heads.select("k", F.col("cx").alias("fx"), F.col("cy").alias("fy"), F.col("head").alias("other")), ["k", "fx", "fy"])
    roots = components(across.select(F.col("head").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "head")
    named = heads.join(roots, "head", "left").select("k", "cx", "cy", F.coalesce("root", "head").alias("cluster_id"))
    found = cells.join(named, ["k", "cx", "cy"]).select(F.col("id").alias(id_), "cluster_id")
    return points.select(id_).join(found, id_, "left")


def _to_segment(p: Column, a: Column, b: Column) -> Column:
    """Distance of a point from a segment."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    size = dx * dx + dy * dy
    t = F.when(size > 0, ((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy) / F.when(size > 0, size)).otherwise(0.0)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.hypot(p["x"] - (a["x"] + t * dx), p["y"] - (a["y"] + t * dy))


def segment_distance(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Distance of two segments: 0 if they cross, else the least of their ends' distances from the other one."""
    def side(p: Column, q: Column, r: Column) -> Column:
        return F.signum((q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"]))

    crosses = (side(a, b, c) * side(a, b, d) < 0) & (side(c, d, a) * side(c, d, b) < 0)
    return F.when(crosses, 0.0).otherwise(F.least(_to_segment(a, c, d), _to_segment(b, c, d), _to_segment(c, a, b), _to_segment(d, a, b)))


def _gap(a: str, b: str) -> Column:
    """Distance of two boxes."""
    def along(c: str) -> Column:
        return F.greatest(F.lit(0.0), F.col(f"{b}.{c}0") - F.col(f"{a}.{c}1"), F.col(f"{a}.{c}0") - F.col(f"{b}.{c}1"))

    return F.hypot(along("x"), along("y"))


def _roots(edges: DataFrame) -> DataFrame:
    """``components`` as (node, root); few edges, which are between tiles only, are joined on the driver in one step."""
    found = edges.limit(FEW + 1).toArrow()
    if found.num_rows > FEW:
        return components(edges)
    a, b = (found[c].combine_chunks() for c in "ab")
    nodes = pa.concat_arrays([a, b]).unique()
    nodes = nodes.take(pc.sort_indices(nodes))
    at = [pc.index_in(v, nodes).to_numpy(zero_copy_only=False) for v in (a, b)]
    root = nodes.take(pa.array(leg_cells.roots(len(nodes), *at)))
    return F.broadcast(edges.sparkSession.createDataFrame(pa.table({"node": nodes, "root": root})))


def segment_components(lines: DataFrame, eps: float, id_: str = "line_id", key: str = "name", way: str = "way", keyed: bool = False) -> DataFrame:
    """(id, cluster_id) of lines within ``eps`` of each other inside each key; a line of one point counts as that point.

    With ``keyed`` the key comes along. Cells have a diagonal just under ``eps``, so all lines through a cell are one
    cluster, and so are all cells of a line. Tiles of cells, with the first cells of the next tiles, are joined one by one by
    the legs kept of each cell (``leg_cells``); components are sought among the labels on their borders only. Of cells near
    each other that this left apart, and of which not all legs were kept, first the nearest leg to the other cell's bounds is
    measured, then all legs near these. A leg takes as many cells as it is long. Legs without a finite place reach nothing.
    """
    side, reach = eps / math.sqrt(2) * (1 - 1e-6), eps * (1 + 1e-6)

    def finite(p: Column) -> Column:
        return (F.abs(p["x"]) < math.inf) & (F.abs(p["y"]) < math.inf)

    def cell(v: Column) -> Column:
        return F.greatest(F.least(F.floor(v / side), F.lit(2**62)), F.lit(-(2**62)))

    here = F.col(way).isNotNull() & (F.size(way) > 0) & F.col(key).isNotNull()
    told = lines.filter(here).select(F.col(id_).alias("id"), F.col(key).alias("k"), F.col(way).alias("way"))
    id_type, k_type = (told.schema[c].dataType.simpleString() for c in ("id", "k"))
    row = f"k {k_type}, id {id_type}, cx long, cy long, px double, py double, qx double, qy double, x0 double, x1 double, y0 double, y1 double, flags long"
    known = told.filter(F.col("id").isNotNull())

    rows = known.mapInArrow(lambda batches: leg_cells.tiled(batches, side), row + ", tx long, ty long")
    rows = rows.repartition("k", "tx", "ty").sortWithinPartitions(F.xxhash64("k", "tx", "ty"), "k", "tx", "ty")
    box = ", ".join(f"{c}{n} double" for c in "ab" for n in ("x0", "x1", "y0", "y1"))
    found = stored(rows.mapInArrow(lambda batches: leg_cells.of_tiles(batches, side, eps), f"kind long, k {k_type}, cx long, cy long, a {id_type}, b {id_type}, pair struct<bx long, by long, {box}>"))
    roots = _roots(found.filter("kind = 1").select("a", "b"))

    def rooted(df: DataFrame, *labels: str) -> DataFrame:
        """``df`` with the roots of its labels."""
        for c in labels:
            df = df.join(roots.select(F.col("node").alias(c), "root"), c, "left").withColumn(c, F.coalesce("root", c)).drop("root")
        return df

    cells = rooted(found.filter("kind = 0").select("k", "cx", "cy", F.col("a").alias("label")), "label")
    left = found.filter("kind = 2")
    if not left.isEmpty():
        bounds = [F.struct(*[F.col(f"pair.{c}{n}").alias(n) for n in ("x0", "x1", "y0", "y1")]).alias(f"box_{c}") for c in "ab"]
        pairs = stored(rooted(left.select("k", "cx", "cy", "pair.bx", "pair.by", *bounds, "a", "b"), "a", "b").filter("a <> b"))
        wanted = pairs.select("k", "cx", "cy").union(pairs.select("k", "bx", "by")).distinct()
        places = known.mapInArrow(lambda batches: (b for part in leg_cells.filed(batches, side) for b in part.to_batches(10_000)), row).filter(f"flags < {leg_cells.TIE}")
        leg = F.struct(*[F.struct(F.col(f"{c}x").alias("x"), F.col(f"{c}y").alias("y")).alias(c) for c in "pq"]).alias("leg")
        places = stored(places.join(wanted, ["k", "cx", "cy"], "left_semi").groupBy("k", "cx", "cy", "px", "py", "qx", "qy").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1")).select("k", "cx", "cy", leg, F.struct("x0", "x1", "y0", "y1").alias("box")))
        others = places.select("k", F.col("cx").alias("bx"), F.col("cy").alias("by"), F.col("leg").alias("other"), F.col("box").alias("box_o"))
        within = segment_distance(F.col("leg.p"), F.col("leg.q"), F.col("other.p"), F.col("other.q")) <= eps

        nearest = pairs.join(places, ["k", "cx", "cy"]).groupBy("k", "cx", "cy", "bx", "by").agg(F.min_by("leg", _gap("box", "box_b")).alias("leg"), F.first("a").alias("a"), F.first("b").alias("b"))
        links = stored(nearest.join(others, ["k", "bx", "by"]).filter(within).select("a", "b").distinct())
        roots = _roots(links)
        pairs = stored(rooted(pairs, "a", "b").filter("a <> b"))
        if not pairs.isEmpty():
            near = pairs.join(places, ["k", "cx", "cy"]).filter(_gap("box", "box_b") <= reach).select("k", "cx", "cy", "bx", "by", "box_a", "leg").distinct()
            other = pairs.select("k", "cx", "cy", "bx", "by", "box_a").join(others, ["k", "bx", "by"]).filter(_gap("box_o", "box_a") <= reach).select("k", "cx", "cy", "bx", "by", "other").distinct()
            met = near.join(other, ["k", "cx", "cy", "bx", "by"]).filter(within).select("k", "cx", "cy", "bx", "by").distinct()
            roots = _roots(stored(links.union(met.join(pairs, ["k", "cx", "cy", "bx", "by"]).select("a", "b")).distinct()))
        cells = rooted(cells, "label")
    first = F.get("way", F.lit(0))
    whole = finite(first) & (F.size("way") > 1) & finite(F.get("way", F.lit(1)))
    last = F.greatest(F.size("way") - 2, F.lit(0))
    legs = F.filter(F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.get("way", i).alias("p"), F.coalesce(F.get("way", i + 1), F.get("way", i)).alias("q"))), lambda g: finite(g["p"]) & finite(g["q"]))
    start = F.when(whole, first).otherwise(F.get(legs, F.lit(0))["p"])
    homes = told.select("id", "k", start.alias("p")).select("id", "k", cell(F.col("p.x")).alias("cx"), cell(F.col("p.y")).alias("cy"))
    named = homes.join(cells, ["k", "cx", "cy"], "left").select(F.col("id").alias(id_), F.col("k").alias(key), F.coalesce("label", "id").alias("cluster_id"))
    out = lines.filter(~F.coalesce(here, F.lit(False))).select(id_, key, F.lit(None).cast(id_type).alias("cluster_id")).unionByName(named)
    return out if keyed else out.drop(key)
