"""Vector tiles: clip lines to tiles, move them to the tile's grid and encode them as protocol buffers."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vialect.functions import geo

EXTENT, BUFFER, LAYER = 4096, 64, "streets"


def clip(points: list[tuple[float, float]], low: float, high: float) -> list[list[tuple[float, float]]]:
    """The parts of a line inside a square: every leg is cut to the range of its parameter in which it is inside (Liang and Barsky)."""
    parts: list[list[tuple[float, float]]] = []
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        dx, dy, t0, t1 = x1 - x0, y1 - y0, 0.0, 1.0
        for p, q in ((-dx, x0 - low), (dx, high - x0), (-dy, y0 - low), (dy, high - y0)):
            if p == 0:
                if q < 0:
                    t0 = 2.0
            elif p < 0:
                t0 = max(t0, q / p)
            else:
                t1 = min(t1, q / p)
        if t0 > t1:
            continue
        a, b = (x0 + t0 * dx, y0 + t0 * dy), (x0 + t1 * dx, y0 + t1 * dy)
        if parts and t0 == 0 and parts[-1][-1] == a:
            parts[-1].append(b)
        else:
            parts.append([a, b])
    return parts


def to_tile(points: list[tuple[float, float]], bounds: tuple[float, float, float, float], extent: int = EXTENT, buffer: int = BUFFER) -> list[list[tuple[int, int]]]:
    """A line on the tile's integer grid, y downwards, clipped with a buffer; parts of a single grid point are dropped."""
    xmin, ymin, xmax, ymax = bounds
    scaled = [((x - xmin) / (xmax - xmin) * extent, (ymax - y) / (ymax - ymin) * extent) for x, y in points]
    out = []
    for part in clip(scaled, -buffer, extent + buffer):
        whole = [(round(x), round(y)) for x, y in part]
        thin = [p for k, p in enumerate(whole) if k == 0 or p != whole[k - 1]]
        if len(thin) > 1:
            out.append(thin)
    return out


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, body: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(body)) + body


def _packed(numbers: list[int]) -> bytes:
    return b"".join(map(_varint, numbers))


def _commands(parts: list[list[tuple[int, int]]]) -> list[int]:
    """Move-to and line-to commands with zigzag steps from the point before."""
    out: list[int] = []
    x = y = 0
    for part in parts:
        for k, (px, py) in enumerate(part):
            if k < 2:
                out.append(1 << 3 | 1 if k == 0 else len(part) - 1 << 3 | 2)
            out += [(d << 1) ^ (d >> 63) for d in (px - x, py - y)]
            x, y = px, py
    return out


def encode(features: list[tuple[dict[str, str | None], list[list[tuple[int, int]]]]], layer: str = LAYER, extent: int = EXTENT) -> bytes:
    """A tile of one layer of lines with text attributes; nulls are left out. No features give no bytes."""
    if not features:
        return b""
    keys: dict[str, int] = {}
    values: dict[str, int] = {}
    body = b""
    for attributes, parts in features:
        tags = [n for k, v in attributes.items() if v is not None for n in (keys.setdefault(k, len(keys)), values.setdefault(v, len(values)))]
        body += _field(2, _field(2, _packed(tags)) + _varint(3 << 3) + _varint(2) + _field(4, _packed(_commands(parts))))
    found = _varint(15 << 3) + _varint(2) + _field(1, layer.encode()) + body
    found += b"".join(_field(3, k.encode()) for k in keys) + b"".join(_field(4, _field(1, v.encode())) for v in values)
    return _field(3, found + _varint(5 << 3) + _varint(extent))


def features(lines: DataFrame, zoom: int) -> DataFrame:
    """(z, x, y, name, highway, geom) for every tile of a zoom level that a named line reaches; geom has the points of
    the clipped line with the number of their part.

    The tiles of a line follow from its bounds and the buffer, so no tile meets lines that are elsewhere.
    """
    size = geo.WORLD / 2**zoom
    edge = size * BUFFER / EXTENT
    rows = lines.filter(F.col("name").isNotNull() & F.col("highway").isNotNull() & F.col("way").isNotNull() & (F.size("way") > 1))
    b = geo.bbox(F.col("way"))
    last = 2**zoom - 1

    def span(low: Column, high: Column) -> Column:
        lowest, highest = F.greatest(F.floor(low).cast("int"), F.lit(0)), F.least(F.floor(high).cast("int"), F.lit(last))
        return F.when(lowest <= highest, F.sequence(lowest, F.greatest(lowest, highest)))

    half = geo.WORLD / 2
    rows = rows.withColumn("x", F.explode(span((b["xmin"] + half - edge) / size, (b["xmax"] + half + edge) / size)))
    rows = rows.withColumn("y", F.explode(span((half - b["ymax"] - edge) / size, (half - b["ymin"] + edge) / size)))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for x, y, way in zip(batch["x"], batch["y"], batch["way"], strict=True):
                bounds = (x * size - half, half - (y + 1) * size, (x + 1) * size - half, half - y * size)
                parts = to_tile([(p["x"], p["y"]) for p in way], bounds)
                found.append([{"part": k, "x": px, "y": py} for k, part in enumerate(parts) for px, py in part] or None)
            yield batch.assign(z=zoom, geom=found)[["z", "x", "y", "name", "highway", "geom"]]

    cut_rows = rows.select("x", "y", "name", "highway", "way").mapInPandas(cut, "z int, x int, y int, name string, highway string, geom array<struct<part:int,x:int,y:int>>")
    return cut_rows.filter("geom is not null")


def _parts(geom: Iterable[dict[str, int]]) -> list[list[tuple[int, int]]]:
    return [[(p["x"], p["y"]) for p in part] for _, part in itertools.groupby(geom, key=lambda p: p["part"])]


def tiles(found: DataFrame, layer: str = LAYER) -> DataFrame:
    """(z, x, y, n_features, mvt): the encoded tile of each group of features, in the order of names."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["name", "highway"], kind="stable")
        body = [({"name": n, "highway": h}, _parts(g)) for n, h, g in zip(rows["name"], rows["highway"], rows["geom"], strict=True)]
        return pd.DataFrame({**{c: [rows[c].iloc[0]] for c in "zxy"}, "n_features": [len(rows)], "mvt": [encode(body, layer)]})

    return found.groupBy("z", "x", "y").applyInPandas(one, "z int, x int, y int, n_features bigint, mvt binary")


def tile(lines: DataFrame, z: int, x: int, y: int) -> DataFrame:
    """The one tile of a request; lines that don't reach it are filtered by their bounds first."""
    size, half = geo.WORLD / 2**z, geo.WORLD / 2
    edge = size * BUFFER / EXTENT
    b = geo.bbox(F.col("way"))
    near = lines.filter((b["xmin"] <= (x + 1) * size - half + edge) & (b["xmax"] >= x * size - half - edge) & (b["ymin"] <= half - y * size + edge) & (b["ymax"] >= half - (y + 1) * size - edge))
    return tiles(features(near, z).filter((F.col("x") == x) & (F.col("y") == y)))
