"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in DataFrame and SQL expressions only.

A text is the set of the digests of its paragraphs: lines, cut further after punctuation so that a text of one line has
parts too. A sketch has 3 tables of 2 ** j cells; every digest is added to one cell of each table, which keeps the count
and the exclusive ors of its digests and of their 64-bit checks. A digest's place in a table of 2 ** j cells is the lowest
j bits of a hash, so the sketch of half the size is the larger one folded: cells that fall together are added. The
fingerprint is the sketch with 2 ** 28 cells a table, written without its empty cells, and so holds the sketches of all
smaller sizes.

Two fingerprints are compared by their cells alone. Both are folded to a size that follows from their counts and
subtracted cell by cell, so that common digests vanish, and the rest is peeled: a cell with count 1 or -1 and a fitting
check holds a single digest, which is recovered and taken out of its other cells, until no such cell is left. Where cells
remain, the fingerprints are folded to twice the size and it begins again. The recovered digests are those in which the
texts differ; with the counts they give the likeness, common digests by all digests.

``likeness`` and ``difference`` do this for two columns. ``edited_fingerprints`` does the first size for all pairs of a
table at once, as rows (pair, cell) that one aggregation after the other peels inside the partitions of one shuffle; the
few pairs that are not finished by then go on as ``difference`` says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells of a table as powers of two: in the fingerprint, and at least in a comparison; the tables peeled for all pairs at once.
WIDEST, LEAST, ROUNDS = 28, 4, (0, 1, 2, 0, 1, 2, 0, 1)
#: Rows of a bucket of neighbours, about, and most buckets (beyond these they hold more rows each).
BUCKET, BUCKETS = 2000, 65_536
PARTS = r"\\n|(?<=[.!?,;:])\\s+"

_CELL = "struct<i:int,c:int,k:bigint,h:bigint>"
_ZERO = "named_struct('i', -1, 'c', 0, 'k', 0L, 'h', 0L)"
_TOP = 3 << WIDEST


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _check(k: str) -> str:
    return f"xxhash64({k}, 7L)"


def _place(k: str, table: int) -> str:
    """The cell of a digest in a table of the widest sketch; its lowest j bits are the cell in one of 2 ** j cells."""
    return f"(xxhash64({k}, {table}L) & {(1 << WIDEST) - 1}L)"


def digests(text: str) -> str:
    """The distinct digests of the paragraphs of a text that isn't null."""
    return f"array_distinct(transform(filter(split({text}, '{PARTS}'), part -> part != ''), part -> xxhash64(part)))"


def sketch(digests: str) -> str:
    """The cells of the widest sketch that aren't empty, in order; ``i`` is 2 ** 28 times the table plus the cell."""
    cells = ", ".join(f"named_struct('i', cast({t << WIDEST}L + {_place('d', t)} as int), 'c', 1, 'k', d, 'h', {_check('d')})" for t in range(3))
    same = f"aggregate(filter(s, z -> z.i = y.x.i), {_ZERO}, (a, z) -> named_struct('i', z.i, 'c', a.c + z.c, 'k', a.k ^ z.k, 'h', a.h ^ z.h))"
    marked = "transform(s, (x, n) -> named_struct('x', x, 'first', n = 0 OR get(s, n - 1).i <> x.i, 'more', coalesce(get(s, n + 1).i = x.i, false)))"
    added = f"transform(filter({marked}, y -> y.first), y -> if(y.more, {same}, y.x))"
    return _let("s", f"sort_array(flatten(transform({digests}, d -> array({cells}))))", f"if(array_contains(transform(s, (x, n) -> coalesce(get(s, n + 1).i = x.i, false)), true), {added}, s)")


def printed(cells: str) -> str:
    """A sketch as text: 22 bytes a cell (place 4, count 2, digests 8, checks 8) in base 64."""
    one = "concat(lpad(hex(x.i * 65536L + x.c), 12, '0'), lpad(hex(x.k), 16, '0'), lpad(hex(x.h), 16, '0'))"
    return f"base64(unhex(array_join(transform({cells}, x -> {one}), '')))"


def cells(fingerprint: str) -> str:
    """The cells of a printed sketch."""

    def part(start: int, size: int, kind: str) -> str:
        return f"cast(conv(substr(x, {start}, {size}), 16, -10) as {kind})"

    one = f"named_struct('i', {part(1, 8, 'int')}, 'c', {part(9, 4, 'int')}, 'k', {part(13, 16, 'bigint')}, 'h', {part(29, 16, 'bigint')})"
    every = "transform(filter(sequence(0, cast(length(t) / 44 as int)), n -> n * 44 < length(t)), n -> substr(t, n * 44 + 1, 44))"
    return _let("t", f"hex(unbase64({fingerprint}))", f"transform({every}, x -> {one})")


def _held(cells: str) -> str:
    """How many digests a sketch holds."""
    return f"aggregate(filter({cells}, x -> x.i < {1 << WIDEST}), 0, (n, x) -> n + x.c)"


def _size(digests: str) -> str:
    """The power of two from which a pair of so many digests is compared: twice as many cells a table as digests."""
    return f"cast(least({WIDEST}, greatest({LEAST}, ceil(log2(2 * greatest(1, {digests}))))) as int)"


def _folded(cells: str, j: str, sign: int) -> str:
    return f"transform({cells}, x -> named_struct('i', x.i & ({_TOP} + shiftleft(1, {j}) - 1), 'c', {sign} * x.c, 'k', x.k, 'h', x.h))"


def _added(entries: str) -> str:
    """Entries of equal place added up; cells in which nothing is left are dropped."""
    rest = "if(a.at.c = 0 AND a.at.k = 0L AND a.at.h = 0L, a.out, concat(a.out, array(a.at)))"
    same = "named_struct('out', a.out, 'at', named_struct('i', x.i, 'c', a.at.c + x.c, 'k', a.at.k ^ x.k, 'h', a.at.h ^ x.h))"
    return f"aggregate(sort_array({entries}), named_struct('out', cast(array() as array<{_CELL}>), 'at', {_ZERO}), (a, x) -> if(a.at.i = x.i, {same}, named_struct('out', {rest}, 'at', x)), a -> {rest})"


def _peeled(cells: str, j: str) -> str:
    """(cells, out): what is left when nothing can be peeled any more, and the signed digests that were recovered."""
    pure = f"array_distinct(transform(filter(st.cells, x -> abs(x.c) = 1 AND x.h = {_check('x.k')}), x -> named_struct('s', x.c, 'k', x.k)))"
    taken = ", ".join(f"named_struct('i', cast({t << WIDEST}L + ({_place('p.k', t)} & (shiftleft(1L, {j}) - 1)) as int), 'c', -p.s, 'k', p.k, 'h', {_check('p.k')})" for t in range(3))
    left = _added(f"concat(st.cells, flatten(transform(pure, p -> array({taken}))))")
    step = _let("pure", pure, f"if(size(pure) = 0, named_struct('cells', st.cells, 'out', st.out, 'on', false), named_struct('cells', {left}, 'out', concat(st.out, pure), 'on', true))")
    start = f"named_struct('cells', {cells}, 'out', cast(array() as array<struct<s:int,k:bigint>>), 'on', true)"
    # A step recovers at least one digest, and no more digests can be recovered than there are cells.
    return _let("first", start, f"aggregate(sequence(0, size(first.cells)), first, (st, n) -> if(st.on, {step}, st))")


def _recovered(a: str, b: str) -> str:
    """The signed digests in which two sketches differ, from the first size at which all of them are recovered."""
    attempt = _let("r", _peeled(_added(f"concat({_folded('z.a', 'j', 1)}, {_folded('z.b', 'j', -1)})"), "j"), "if(size(r.cells) = 0, r.out, null)")
    sizes = f"sequence({_size(f'({_held("z.a")} + {_held("z.b")})')}, {WIDEST})"
    found = f"aggregate({sizes}, cast(null as array<struct<s:int,k:bigint>>), (found, j) -> if(found is not null, found, {attempt}))"
    return _let("z", f"named_struct('a', {a}, 'b', {b})", found)


def _alike(size: str, mine: str, theirs: str) -> str:
    return f"if({size} + {theirs} = 0, 1D, ({size} - {mine}) / cast({size} + {theirs} as double))"


def _likeness(a: str, b: str) -> str:
    only = "aggregate(w.diff, 0, (n, x) -> n + if(x.s = {s}, 1, 0))"
    return _let("w", f"named_struct('n', {_held(a)}, 'diff', {_recovered(a, b)})", _alike("w.n", only.format(s=1), only.format(s=-1)))


def difference(one: str, other: str) -> Column:
    """The differing digests of two columns of fingerprints as array<struct<s, k>>: s is 1 if only ``one`` has k, else -1."""
    return F.expr(_let("f", f"named_struct('a', {cells(f'`{one}`')}, 'b', {cells(f'`{other}`')})", _recovered("f.a", "f.b")))


def likeness(one: str, other: str) -> Column:
    """Common digests by all digests of two columns of fingerprints; 1 for two texts without any."""
    return F.expr(_let("f", f"named_struct('a', {cells(f'`{one}`')}, 'b', {cells(f'`{other}`')})", _likeness("f.a", "f.b")))


def fingerprint(text: str) -> Column:
    """The fingerprint of a column of texts; a null counts as empty, and an empty text has an empty fingerprint."""
    return F.expr(printed(sketch(digests(f"coalesce(`{text}`, '')"))))


def _list(values: list, kind: str) -> str:
    """A literal array, which is parsed once however long it is."""
    body = ",".join("" if v is None else str(v) for v in values)
    return f"cast(split('{body}', ',') as array<{kind}>)" if values else f"cast(array() as array<{kind}>)"


def _rank(bounds: list[int], value: str) -> str:
    """How many of the sorted bounds are smaller, by binary search."""
    if not bounds:
        return "0"
    steps = _list([1 << k for k in reversed(range(len(bounds).bit_length()))], "int")
    return f"aggregate({steps}, 0, (low, step) -> if(coalesce(get({_list(bounds, 'bigint')}, low + step - 1) < {value}, false), low + step, low))"


def neighbours(df: DataFrame, key: str, columns: list[Column], order: Column) -> DataFrame:
    """(row, bucket, place, own, after): each row as a struct, its bucket and its place there, the values of ``columns``
    and those of the row with the next smaller key; the row of the smallest key gets the largest's.

    Rows are dealt into buckets of neighbouring keys by one shuffle; the first row of a bucket is also sent to the bucket
    before it, so no bucket needs another. ``columns`` are computed after the shuffle. Rows without key come after all
    others; rows of equal key follow each other in the order of ``order``. A single row is its own next.
    """
    n = df.select(key).count()
    k = max(1, min(BUCKETS, n // BUCKET))
    cuts = df.select(F.expr(f"percentile_approx(`{key}`, {_list([i / k for i in range(1, k)], 'double')}, {20 * k})")).head()[0] if k > 1 else []
    at = F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(-(1 << 63)))
    rows = df.select(F.struct("*").alias("row"), at.alias("at")).withColumn("b", F.expr(_rank(sorted(set(cuts or [])), "at")))
    firsts = sorted((r[0], r[1]) for r in rows.groupBy("b").agg(F.max("at")).collect())  # at most BUCKETS rows
    tops, before = ([None] * (max((b for b, _ in firsts), default=0) + 1) for _ in range(2))
    for i, (b, top) in enumerate(firsts):
        tops[b], before[b] = top, firsts[(i + 1) % len(firsts)][0]
    own = "named_struct('b', b, 'tail', 0)"
    places = F.expr(f"if(get({_list(tops, 'bigint')}, b) = at, array({own}, named_struct('b', get({_list(before, 'int')}, b), 'tail', 1)), array({own}))")
    rows = rows.select("row", "at", F.explode(places).alias("p")).select("row", "at", F.col("p.b").alias("bucket"), F.col("p.tail").alias("tail"))
    rows = rows.repartitionById(len(tops), "bucket")
    kept = [c.alias(f"c{i}") for i, c in enumerate(columns)]
    rows = rows.select("bucket", "tail", "at", "row", F.struct(*kept).alias("own"), order.alias("h"))
    window = Window.partitionBy("bucket").orderBy("tail", F.desc("at"), "h")
    rows = rows.withColumns({"after": F.lead("own").over(window), "place": F.row_number().over(window)})
    return rows.filter("tail = 0").select("row", "bucket", "place", "own", "after")


def with_next(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``df`` with ``next_<column>`` from the row of the next smaller key; see ``neighbours``. Columns of these names are replaced."""
    rows = neighbours(df, key, [F.col(f"row.`{c}`") for c in columns], F.xxhash64(*[F.col(f"row.`{c}`") for c in columns]))
    names = [f"next_{c}" for c in columns]
    return rows.select(*[F.col(f"row.`{c}`") for c in df.columns if c not in names], *[F.col(f"after.c{i}").alias(c) for i, c in enumerate(names)])


def _peel_table(rows: DataFrame, table: int) -> DataFrame:
    """Takes the digests of all pure cells of a table out of the other two, and counts them for their pair.

    ``g`` is place of the document (from bit 36), pair (bit 35), j (5 bits), table (2 bits) and cell (28 bits). Table 3 is
    no table: its cell 0 holds the document itself in ``doc``, cells 1 and 2 count the recovered digests of either sign.
    """
    low, mask = f"(g & {(1 << WIDEST) - 1}L)", "(shiftleft(1L, cast(shiftright(g, 30) & 31 as int)) - 1)"
    pure = f"shiftright(g, {WIDEST}) & 3 = {table} AND abs(c) = 1 AND h = {_check('k')} AND {low} = {_place('k', table)} & {mask}"
    base = "shiftleft(shiftright(g, 30), 30)"
    entry = "named_struct('g', {g}, 'c', {c}, 'k', {k}, 'h', {h}, 'doc', if(false, doc, null))"
    found = entry.format(g=f"{base} + {_TOP}L + if(c = 1, 1, 2)", c="1L", k="0L", h="0L")
    taken = [entry.format(g=f"{base} + {t << WIDEST}L + ({_place('k', t)} & {mask})", c="-c", k="k", h="h") for t in range(3) if t != table]
    empty = f"shiftright(g, {WIDEST}) & 3 <> 3 AND c = 0 AND k = 0 AND h = 0"
    itself = "named_struct('g', g, 'c', c, 'k', k, 'h', h, 'doc', doc)"
    moved = f"CASE WHEN {pure} THEN array({found}, {', '.join(taken)}) WHEN {empty} THEN slice(array({itself}), 1, 0) ELSE array({itself}) END"
    return _summed(rows.select("bucket", F.explode(F.expr(moved)).alias("x")))


def _summed(rows: DataFrame) -> DataFrame:
    rows = rows.select("bucket", "x.*")
    return rows.groupBy("bucket", "g", "doc").agg(F.sum("c").alias("c"), F.bit_xor("k").alias("k"), F.bit_xor("h").alias("h"))


def edited_fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row for each row of ``docs``: its key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last third (floor) of its code points replaced by as many first ones of the text with the next
    smaller key. A null text counts as empty; texts without paragraphs are wholly alike and have no likeness to others.
    Equal texts have equal fingerprints. Repeated rows stay, one following the other; rows without key come last; an empty
    table gives no rows. Both likenesses depend on the printed fingerprints only: ``likeness`` gives the same.
    """
    body = F.coalesce(F.col("row.text"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    rows = neighbours(rows, "key", [body, F.expr(digests("coalesce(row.text, '')"))], F.xxhash64(body))
    edited = "concat(substr(own.c0, 1, length(own.c0) - cast(length(own.c0) div 3 as int)), substr(after.c0, 1, cast(length(own.c0) div 3 as int)))"
    rows = rows.select("bucket", "place", "row.key", "own", "after", F.expr(edited).alias("edited"))
    doc = F.expr(f"named_struct('key', key, 'n', cast(length(own.c0) as bigint), 'sha', sha2(cast(edited as binary), 256), 'a', own.c1, 'e', {digests('edited')}, 'b', after.c1)")
    rows = rows.select("bucket", "place", doc.alias("doc"))

    def entries(side: str, pair: int, j: str, sign: int) -> str:
        at = f"shiftleft(cast(place as bigint), 36) + {pair << 35}L + shiftleft(cast({j} as bigint), 30) + (x.i & ({_TOP} + shiftleft(1, {j}) - 1))"
        return f"transform({side}, x -> named_struct('g', {at}, 'c', cast({sign} * x.c as bigint), 'k', x.k, 'h', x.h, 'doc', if(false, doc, null)))"

    itself = f"array(named_struct('g', shiftleft(cast(place as bigint), 36) + {_TOP}L, 'c', 0L, 'k', 0L, 'h', 0L, 'doc', doc))"
    every = f"concat({itself}, {entries('f.a', 0, 'f.je', 1)}, {entries('f.e', 0, 'f.je', -1)}, {entries('f.a', 1, 'f.jb', 1)}, {entries('f.b', 1, 'f.jb', -1)})"
    sizes = f"'je', {_size('(size(doc.a) + size(doc.e))')}, 'jb', {_size('(size(doc.a) + size(doc.b))')}"
    every = _let("f", f"named_struct('a', {sketch('doc.a')}, 'e', {sketch('doc.e')}, 'b', {sketch('doc.b')}, {sizes})", every)
    rows = _summed(rows.select("bucket", F.explode(F.expr(every)).alias("x")))
    for table in ROUNDS:
        rows = _peel_table(rows, table)

    def total(what: str, pair: int, cell: int | None = None) -> Column:
        here = f"shiftright(g, 35) & 1 = {pair} AND shiftright(g, {WIDEST}) & 3 {'<> 3' if cell is None else '= 3'}" + ("" if cell is None else f" AND g & 3 = {cell}")
        return F.expr(f"coalesce(sum(if({here}, {what}, 0)), 0)")

    left = "if(c <> 0 OR k <> 0 OR h <> 0, 1, 0)"
    found = {f"{name}{p}": total(what, p, cell) for p in (0, 1) for name, what, cell in (("left", left, None), ("mine", "c", 1), ("theirs", "c", 2))}
    out = rows.groupBy("bucket", F.expr("shiftright(g, 36)").alias("place")).agg(F.any_value("doc", True).alias("doc"), *[c.alias(n) for n, c in found.items()])

    def near(pair: int, other: str) -> Column:
        return F.expr(f"if(left{pair} = 0, {_alike('size(doc.a)', f'mine{pair}', f'theirs{pair}')}, {_let('f', f"named_struct('a', {sketch('doc.a')}, 'b', {sketch(other)})", _likeness('f.a', 'f.b'))})")

    prints = [F.expr(printed(sketch(f"doc.{s}"))).alias(n) for s, n in (("a", "fingerprint"), ("e", "edited_fingerprint"))]
    return out.select(F.col("doc.key").alias(key), F.col("doc.n").alias("n_chars"), F.col("doc.sha").alias("edited_sha256"), *prints, near(0, "doc.e").alias("near_edited"), near(1, "doc.b").alias("near_next"))
