"""Legs of lines by cells of a grid in numpy: the cells that a leg runs through, and the cells of a tile that touch.

Rows of legs have their cell, the smallest id, both ends and the bounds of what lies in the cell. They are merged before
and after they are dealt out by tiles: legs of equal place become one, and of a cell with more than ``KEPT`` legs only the
outermost stay, whose bounds are then those of the whole cell. So a tile is as large as its cells are many, not its legs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Cells along a tile, legs kept of a cell, and rows that are handled at once.
SPAN, KEPT, ROWS = 256, 4, 200_000
#: Tiles begin so far before the axes: lines along an axis don't run along a border.
MIDDLE = SPAN // 2
#: The leg goes on in the next cell of its column, or of its row; the cell has more legs; a row that only ties its id to its cell.
NORTH, EAST, MORE, TIE = 1, 2, 4, 8
PLACE, ENDS, BOX = ("tx", "ty", "cx", "cy"), ("px", "py", "qx", "qy"), ("x0", "x1", "y0", "y1")
_FAR = 2**62
Columns = dict[str, np.ndarray]
#: Half of the neighbours of a cell that may be within a diagonal.
AROUND = [(i, j) for i in range(3) for j in range(-2, 3) if (i, j) > (0, 0)]


def _floor(v: np.ndarray, side: float) -> np.ndarray:
    return np.clip(np.floor(v / side), -_FAR, _FAR).astype(np.int64)


def _numbers(values: pa.Array) -> tuple[np.ndarray, pa.Array | None]:
    """Values as whole numbers of the same order, and what the numbers stand for (None: themselves)."""
    if pa.types.is_integer(values.type):
        return values.to_numpy(zero_copy_only=False).astype(np.int64), None
    coded = values.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[coded.indices.to_numpy(zero_copy_only=False)], coded.dictionary.take(pa.array(order))


def _values(numbers: np.ndarray, stand: pa.Array | None, kind: pa.DataType) -> pa.Array:
    return pa.array(numbers).cast(kind) if stand is None else stand.take(pa.array(numbers))


def _column(table: pa.Table, name: str) -> pa.Array:
    found = table[name].combine_chunks()
    return found if isinstance(found, pa.Array) else pa.concat_arrays(found.chunks)


def _spread(counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each index as often as it counts, with its running number; about ``ROWS`` at a time, whatever the counts."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    for first in range(0, total, ROWS):
        at = np.arange(first, min(first + ROWS, total))
        i = np.searchsorted(ends, at, side="right")
        yield i, at - (ends[i] - counts[i])


def legs(batch: pa.RecordBatch) -> tuple[np.ndarray, Columns, np.ndarray]:
    """The line, both ends and the tie of each finite leg; lines whose legs don't hang together tie their ids to all of them."""
    way = batch["way"]
    n = pc.list_value_length(way).to_numpy(zero_copy_only=False).astype(np.int64)
    points = way.flatten()
    x, y = (pc.struct_field(points, c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in "xy")
    missing = points.is_null().to_numpy(zero_copy_only=False)
    m = np.maximum(n - 1, 1)
    line = np.repeat(np.arange(len(n)), m)
    p = np.arange(len(line)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(np.cumsum(n) - n, m)
    q = np.where(n[line] > 1, p + 1, p)
    q = np.where(missing[q], p, q)
    kept = np.isfinite(x[p]) & np.isfinite(y[p]) & np.isfinite(x[q]) & np.isfinite(y[q])
    gaps = np.bincount(line[kept], minlength=len(n)) < m
    line, p, q = line[kept], p[kept], q[kept]
    return line, {"px": x[p], "py": y[p], "qx": x[q], "qy": y[q]}, gaps[line]


def crossed(leg: Columns, side: float) -> Iterator[tuple[np.ndarray, Columns]]:
    """The cells that legs run through, those of both ends among them: the leg's index, the cell, bounds of the part in it, flags."""
    px, py, qx, qy = (leg[c] for c in ENDS)
    left, right, low, high = np.minimum(px, qx), np.maximum(px, qx), np.minimum(py, qy), np.maximum(py, qy)
    cx, cy = _floor(px, side), _floor(py, side)
    alone = (cx == _floor(qx, side)) & (cy == _floor(qy, side))
    i = np.flatnonzero(alone)
    if len(i):
        yield i, {"cx": cx[i], "cy": cy[i], "x0": left[i], "x1": right[i], "y0": low[i], "y1": high[i], "flags": np.zeros(len(i), np.int64)}
    long = np.flatnonzero(~alone)
    first, last = _floor(left[long], side), _floor(right[long], side)
    for at, step in _spread(last - first + 1):
        i, c = long[at], first[at] + step
        x0, x1 = np.minimum(np.maximum(left[i], c * side), right[i]), np.maximum(np.minimum(right[i], (c + 1) * side), left[i])
        slanted = qx[i] != px[i]
        width = np.where(slanted, qx[i] - px[i], 1.0)
        h0, h1 = (np.clip(py[i] + (x - px[i]) / width * (qy[i] - py[i]), low[i], high[i]) for x in (x0, x1))
        y0, y1 = np.where(slanted, np.minimum(h0, h1), low[i]), np.where(slanted, np.maximum(h0, h1), high[i])
        for x, y in ((px[i], py[i]), (qx[i], qy[i])):
            here = c == _floor(x, side)
            y0, y1 = np.where(here, np.minimum(y0, y), y0), np.where(here, np.maximum(y1, y), y1)
        r0, r1, east = _floor(y0, side), _floor(y1, side), np.where(c < last[at], _floor(h1, side), _FAR + 1)
        for b, up in _spread(r1 - r0 + 1):
            r = r0[b] + up
            bottom, top = np.maximum(y0[b], np.minimum(r * side, y1[b])), np.minimum(y1[b], np.maximum((r + 1) * side, y0[b]))
            flags = NORTH * (r < r1[b]) + EAST * (r == east[b])
            yield i[b], {"cx": c[b], "cy": r, "x0": x0[b], "x1": x1[b], "y0": bottom, "y1": top, "flags": flags}


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _merged(c: Columns, side: float) -> Columns:
    """Rows in order of tile, cell and leg: legs of equal place once, and the outermost ones of a cell with more than ``KEPT``."""
    by = ("k", *PLACE, *ENDS)
    order = np.lexsort([c[n] for n in reversed(by)])
    c = {n: v[order] for n, v in c.items()}

    def grouped(at: np.ndarray) -> Columns:
        ways = {"id": np.minimum, "x0": np.minimum, "x1": np.maximum, "y0": np.minimum, "y1": np.maximum, "flags": np.bitwise_or}
        return {n: f.reduceat(c[n], at) for n, f in ways.items()}

    at = _starts(*(c[n] for n in by))
    if len(at) < len(order):
        c = {n: c[n][at] for n in by} | grouped(at)
    at = _starts(*(c[n] for n in by[:5]))
    sizes = np.diff(np.append(at, len(c["k"])))
    if not (sizes > KEPT).any():
        return c
    cell = np.repeat(np.arange(len(at)), sizes)
    crowded = np.flatnonzero(sizes[cell] > KEPT)
    kept = [np.flatnonzero(sizes[cell] <= KEPT)]
    for u, n in (("x", "cx"), ("y", "cy")):
        p, q, edge = c[f"p{u}"][crowded], c[f"q{u}"][crowded], c[n][crowded] * side
        for outer in (np.maximum(np.minimum(p, q), edge), -np.minimum(np.maximum(p, q), edge + side)):
            ranked = crowded[np.lexsort([outer, cell[crowded]])]
            kept.append(ranked[_starts(cell[ranked])])
    whole = grouped(at)
    whole["flags"] = np.where(sizes > KEPT, whole["flags"] | MORE, whole["flags"])
    for n, v in whole.items():
        c[n] = np.where(sizes[cell] > KEPT, v[cell], c[n])
    rows = np.unique(np.concatenate(kept))
    return {n: v[rows] for n, v in c.items()}


def merged(table: pa.Table, side: float) -> pa.Table:
    k, keys = _numbers(_column(table, "k"))
    id_, ids = _numbers(_column(table, "id"))
    c = {n: table[n].to_numpy() for n in table.column_names if n not in ("k", "id")} | {"k": k, "id": id_}
    ties = (c["flags"] & TIE) > 0
    found = _merged({n: v[~ties] for n, v in c.items()}, side)
    if ties.any():
        found = {n: np.concatenate([v, c[n][ties]]) for n, v in found.items()}
    return pa.table([_values(found["k"], keys, table.schema.field("k").type), _values(found["id"], ids, table.schema.field("id").type), *[pa.array(found[n]) for n in table.column_names[2:]]], schema=table.schema)


def filed(batches: Iterator[pa.RecordBatch], side: float) -> Iterator[pa.Table]:
    """Lines (id, k, way) as rows of legs in cells."""
    for batch in batches:
        line, leg, ties = legs(batch)
        for tie in (False, True) if ties.any() else (False,):
            part = {n: v[ties] if tie else v for n, v in leg.items()}
            start = part | {"qx": part["px"], "qy": part["py"]} if tie else part
            for i, c in crossed(start, side):
                at = pa.array((line[ties] if tie else line)[i])
                flags = np.full(len(i), TIE, np.int64) if tie else c["flags"]
                yield pa.table({"k": batch["k"].take(at), "id": batch["id"].take(at)} | {n: c[n] for n in ("cx", "cy")} | {n: part[n][i] for n in ENDS} | {n: c[n] for n in BOX} | {"flags": flags})


def tiled(batches: Iterator[pa.RecordBatch], side: float) -> Iterator[pa.RecordBatch]:
    """Lines as merged rows in the tile of their cell and in those of the cells before it that it may touch."""
    held: list[pa.Table] = []

    def sent() -> Iterator[pa.RecordBatch]:
        table = pa.concat_tables(held)
        cx, cy = (table[n].to_numpy() for n in ("cx", "cy"))
        for n, v in (("tx", cx), ("ty", cy)):
            table = table.append_column(n, pa.array((v + MIDDLE) // SPAN))
        table = merged(table, side)
        cx, cy, own = table["cx"].to_numpy(), table["cy"].to_numpy(), (table["flags"].to_numpy() & TIE) == 0
        yield from table.to_batches(10_000)
        west, south, north = (cx + MIDDLE) % SPAN < 2, (cy + MIDDLE) % SPAN < 2, (cy + MIDDLE) % SPAN >= SPAN - 2
        for dx, dy, here in ((-1, 0, west), (0, -1, south), (0, 1, north), (-1, -1, west & south), (-1, 1, west & north)):
            at = np.flatnonzero(here & own)
            if len(at):
                part = table.take(pa.array(at))
                for n, d in (("tx", dx), ("ty", dy)):
                    part = part.set_column(part.schema.get_field_index(n), n, pa.array(part[n].to_numpy() + d))
                yield from part.to_batches(10_000)

    for part in filed(batches, side):
        held.append(part)
        if sum(map(len, held)) >= ROWS:
            yield from sent()
            held.clear()
    if held:
        yield from sent()


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that edges join each of n indices to."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            return root
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != (up := root[root])).any():
            root = up


def _to_segment(x: np.ndarray, y: np.ndarray, leg: tuple[np.ndarray, ...]) -> np.ndarray:
    ax, ay, bx, by = leg
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    t = np.clip(((x - ax) * dx + (y - ay) * dy) / np.where(size > 0, size, 1.0), 0.0, 1.0)
    return np.hypot(x - (ax + t * dx), y - (ay + t * dy))


def distances(g: tuple[np.ndarray, ...], h: tuple[np.ndarray, ...]) -> np.ndarray:
    """Distances of legs (px, py, qx, qy): 0 if they cross, else the least of their ends' distances from the other one."""
    def side(x: np.ndarray, y: np.ndarray, leg: tuple[np.ndarray, ...]) -> np.ndarray:
        return np.sign((leg[2] - leg[0]) * (y - leg[1]) - (leg[3] - leg[1]) * (x - leg[0]))

    crosses = (side(*h[:2], g) * side(*h[2:], g) < 0) & (side(*g[:2], h) * side(*g[2:], h) < 0)
    ends = [_to_segment(*g[:2], h), _to_segment(*g[2:], h), _to_segment(*h[:2], g), _to_segment(*h[2:], g)]
    return np.where(crosses, 0.0, np.minimum.reduce(ends))


def joined(table: pa.Table, side: float, eps: float) -> pa.Table:
    """Whole tiles: own cells with a label (kind 0), ids of one cluster (1), and pairs of cells that kept legs leave open (2)."""
    table = merged(table, side)
    kind, key = table.schema.field("id").type, table.schema.field("k").type
    k, keys = _numbers(_column(table, "k"))
    id_, ids = _numbers(_column(table, "id"))
    c = {n: table[n].to_numpy() for n in table.column_names[2:]} | {"k": k, "id": id_}
    tie = (c["flags"] & TIE) > 0
    ties, c = {n: v[tie] for n, v in c.items()}, {n: v[~tie] for n, v in c.items()}
    at = _starts(c["k"], *(c[n] for n in PLACE))
    sizes = np.diff(np.append(at, len(c["k"])))
    cell = {n: c[n][at] for n in ("k", *PLACE)} | {n: f.reduceat(c[n], at) for n, f in (("id", np.minimum), ("x0", np.minimum), ("x1", np.maximum), ("y0", np.minimum), ("y1", np.maximum), ("flags", np.bitwise_or))}
    first = _starts(cell["k"], cell["tx"], cell["ty"])
    tile = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(at))))
    lx, ly = cell["cx"] + MIDDLE - cell["tx"] * SPAN, cell["cy"] + MIDDLE - cell["ty"] * SPAN + 2
    codes = (tile * (SPAN + 2) + lx) * (SPAN + 4) + ly
    own = (lx < SPAN) & (ly >= 2) & (ly < SPAN + 2)
    mine, pairs, sure = np.flatnonzero(own), [], []
    for dx, dy in AROUND:
        wanted = codes[mine] + dx * (SPAN + 4) + dy
        b = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
        hit = codes[b] == wanted
        a, b = mine[hit], b[hit]
        gap = np.hypot(*(np.maximum(0.0, np.maximum(cell[f"{u}0"][b] - cell[f"{u}1"][a], cell[f"{u}0"][a] - cell[f"{u}1"][b])) for u in "xy"))
        near = gap <= eps * (1 + 1e-6)
        flag = {(0, 1): NORTH, (1, 0): EAST}.get((dx, dy), 0)
        sure.append(((cell["flags"][a] & flag) > 0)[near | ((cell["flags"][a] & flag) > 0)])
        near |= (cell["flags"][a] & flag) > 0
        pairs.append((a[near], b[near]))
    a, b, sure = (np.concatenate(v) for v in (*zip(*pairs, strict=True), sure))
    label = roots(len(at), a[sure], b[sure])
    open_ = label[a] != label[b]
    a, b = a[open_], b[open_]
    hit = np.zeros(len(a), bool)
    for i in range(KEPT):
        for j in range(KEPT):
            at_ = np.flatnonzero(~hit & (sizes[a] > i) & (sizes[b] > j))
            if len(at_):
                g, h = (tuple(c[n][at[v[at_]] + s] for n in ENDS) for v, s in ((a, i), (b, j)))
                hit[at_] = distances(g, h) <= eps
    up = roots(len(at), label[a[hit]], label[b[hit]])
    label = up[label]
    open_ = ~hit & (((cell["flags"][a] | cell["flags"][b]) & MORE) > 0) & (label[a] != label[b])
    a, b = a[open_], b[open_]
    root = np.full(len(at), np.iinfo(np.int64).max)
    np.minimum.at(root, label, cell["id"])
    root = root[label]

    border = np.flatnonzero((~own | (lx < 2) | (ly < 4) | (ly >= SPAN)) & (cell["id"] != root))
    nodes, tops = [cell["id"][border]], [root[border]]
    if len(ties["k"]):
        where = {r: i for i, r in enumerate(zip(*(cell[n].tolist() for n in ("k", *PLACE)), strict=True))}
        found = np.array([where[r] for r in zip(*(ties[n].tolist() for n in ("k", *PLACE)), strict=True)])
        nodes.append(ties["id"])
        tops.append(root[found])
    nodes, tops = np.unique(np.stack([np.concatenate(nodes), np.concatenate(tops)], 1), axis=0).T
    n0, n1, n2 = len(mine), len(nodes), len(a)
    box = {f"{s}{n}": v[at_] for s, at_ in (("a", a), ("b", b)) for n, v in cell.items() if n in BOX}
    pair = pa.StructArray.from_arrays([pa.array(v) for v in (cell["cx"][b], cell["cy"][b], *box.values())], ["bx", "by", *box])
    here = np.concatenate([mine, a])
    cells = {n: pa.concat_arrays([v.slice(0, n0), pa.nulls(n1, v.type), v.slice(n0)]) for n, v in (("k", _values(cell["k"][here], keys, key)), ("cx", pa.array(cell["cx"][here])), ("cy", pa.array(cell["cy"][here])))}
    out = {"kind": pa.array(np.repeat([0, 1, 2], [n0, n1, n2])), **cells, "a": _values(np.concatenate([root[mine], nodes, root[a]]), ids, kind)}
    out["b"] = pa.concat_arrays([pa.nulls(n0, kind), _values(np.concatenate([tops, root[b]]), ids, kind)])
    out["pair"] = pa.concat_arrays([pa.nulls(n0 + n1, pair.type), pair])
    return pa.table(out)


def of_tiles(batches: Iterator[pa.RecordBatch], side: float, eps: float) -> Iterator[pa.RecordBatch]:
    """``joined`` over rows that come tile by tile, some whole tiles at a time."""
    held: list[pa.Table] = []
    most = ROWS

    def last(table: pa.Table) -> int:
        """Where the last tile begins."""
        k = _numbers(_column(table, "k"))[0]
        return int(_starts(k, table["tx"].to_numpy(), table["ty"].to_numpy())[-1])

    for batch in batches:
        if len(batch):
            held.append(pa.Table.from_batches([batch]))
        if sum(map(len, held)) < most:
            continue
        table = pa.concat_tables(held)
        cut = last(table)
        if cut:
            yield from joined(table.slice(0, cut), side, eps).to_batches(10_000)
        rest = table.slice(cut)
        if len(rest) >= ROWS:
            rest = merged(rest, side)  # a tile of very many rows shrinks as it comes
        held, most = [rest], max(ROWS, 2 * len(rest))
    if held:
        yield from joined(pa.concat_tables(held), side, eps).to_batches(10_000)
