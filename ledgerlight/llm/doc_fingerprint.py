"""Document fingerprints as invertible Bloom lookup sketches, with SQL functions only.

A text is cut into passages where a hash of the words before picks the spot (of
the characters before, in long runs without blanks), so equal passages are cut
equally in any script and wherever they stand. A passage's digest is 48 bits of its
XXH64 with 16 check bits of its own behind them. The distinct digests are dealt by
their top bits to parts, about ``LOAD`` of them each at most, and each part is a
sketch of ``CELLS`` cells in three rows, each digest in one cell of each row; a cell
is the xor of its digests, check bits included. The fingerprint is these cells and
the number of digests, written down; its size follows the text.

Two fingerprints subtract cell by cell (of two sizes, parts of the larger are added
up first): what the texts share cancels. Cells that hold a single digest, as their
check bits tell, are peeled off until nothing is left, which recovers the digests by
which the texts differ and so their likeness. Digests of parts whose peeling sticks
are sketched again, larger, and so on; what sticks in all sizes is compared at last.

Null texts are empty: no digests, like another empty one (1.0). Rows with a null id
come last in descending order, by a hash of their text; equal ids are in order of
that hash, too. In a table of one row the next document is the row itself. An empty
table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.llm.cluster import broadcast_if_small, materialize

ROWS, SLOTS = 3, 4
CELLS = ROWS * SLOTS
#: A unit is a word with the blanks behind it; longer ones are cut into single characters.
_WORD, _LONG = r"(?<=\\s)(?!\\s)", 24
#: A passage ends where the hash of the last WINDOW units is 0 modulo PASSAGE, or after MOST units.
WINDOW, PASSAGE, MOST = 3, 8, 64
#: Digests of a text for a part of its sketch, at most on average.
LOAD = 4
#: Peeling rounds of a part, and how often digests of parts that stick are sketched again, larger (then they are compared).
_ROUNDS, _LEVELS = 8, 6
#: The bits of a digest that check the others.
_CHECK = 65535


def _units(text: str) -> str:
    """SQL of the units of a text."""
    return f"flatten(transform(split({text}, '{_WORD}'), w -> if(length(w) > {_LONG}, split(w, ''), array(w))))"


def passages(text: str) -> Column:
    """The passages of a text (SQL), in order; together they are the text."""
    window = ", ".join(f"get(u, i - {k})" for k in range(WINDOW, 0, -1))
    ends = f"filter(sequence(0, size(u)), i -> i = 0 or i = size(u) or pmod(xxhash64({window}), {PASSAGE}) = 0)"
    # A run without such a spot is cut by count from its start: what stands before an edit is still cut alike.
    part = f"transform(sequence(p[k], p[k + 1] - 1, {MOST}), i -> array_join(slice(u, i + 1, least({MOST}, p[k + 1] - i)), ''))"
    cut = f"transform(array({ends}), p -> flatten(transform(sequence(0, size(p) - 2), k -> {part})))[0]"
    return F.expr(f"if({text} = '', cast(array() as array<string>), transform(array({_units(text)}), u -> {cut})[0])")


def digests(text: str) -> Column:
    """Distinct digests of the passages of a text (a column), sorted."""
    top = F.transform(passages(text), lambda p: F.xxhash64(p).bitwiseAND(F.lit(~_CHECK)))
    return F.sort_array(F.array_distinct(F.transform(top, lambda t: t.bitwiseOR(F.xxhash64(t).bitwiseAND(F.lit(_CHECK))))))


def _let(name: str, value: str, body: str) -> str:
    """SQL of ``body``, in which ``name`` is ``value``, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _bits(n: str) -> str:
    """SQL of how many top bits name the part of a digest, for n digests."""
    return f"if({n} <= {LOAD}, 0, cast(ceil(log2({n} / {LOAD}D)) as int))"


def _part(x: str, bits: str) -> str:
    """SQL of the number of the part of a digest: its top bits."""
    return f"if({bits} = 0, 0, cast(shiftrightunsigned({x}, 64 - {bits}) as int))"


def _parts(keys: str, bits: str) -> str:
    """SQL of the 2 ** bits parts of an array of digests in the order of their numbers, each bit halving all."""
    half = lambda j: f"filter(z, x -> (shiftright(x, 64 - l) & 1) = {j})"
    return f"aggregate(if({bits} < 1, cast(array() as array<int>), sequence(1, {bits})), array({keys}), (ps, l) -> flatten(transform(ps, z -> array({half(0)}, {half(1)}))))"


def _cuts(keys: str, bits: str) -> str:
    """SQL of where the parts of sorted digests (one at least) begin, and of their end."""
    new = f"filter(if(size({keys}) < 2, cast(array() as array<int>), sequence(1, size({keys}) - 1)), i -> {_part(f'{keys}[i]', bits)} != {_part(f'{keys}[i - 1]', bits)})"
    return f"concat(array(0), {new}, array(size({keys})))"


def _slices(keys: str, cuts: str) -> str:
    return f"transform(sequence(0, size({cuts}) - 2), j -> slice({keys}, {cuts}[j] + 1, {cuts}[j + 1] - {cuts}[j]))"


def _in_slot(x: str, row: int | str, slot: int | str) -> str:
    """SQL of whether a digest goes to this cell of a row."""
    return f"(shiftright({x}, 16 + {SLOTS // 2} * {row}) & {SLOTS - 1}) = {slot}"


def _cells(z: str) -> str:
    """SQL of the cells of a part z, an array of digests."""
    cell = lambda r, c: f"aggregate({z}, 0L, (s, x) -> if({_in_slot('x', r, c)}, s ^ x, s))"
    return "array(" + ", ".join(cell(r, c) for r in range(ROWS) for c in range(SLOTS)) + ")"


def _sketch(keys: str, bits: str) -> str:
    """SQL of the sketch of an array of digests: the cells of its parts, one part after another."""
    return f"flatten(transform({_parts(keys, bits)}, z -> {_cells('z')}))"


def _folded(sketch: str, bits: str, to: str) -> str:
    """SQL of a sketch with its parts added up to those of fewer bits."""
    cell = f"{sketch}[((j div {CELLS}) * shiftleft(1, {bits} - {to}) + i) * {CELLS} + j % {CELLS}]"
    added = f"transform(sequence(0, shiftleft(1, {to}) * {CELLS} - 1), j -> aggregate(sequence(0, shiftleft(1, {bits} - {to}) - 1), 0L, (s, i) -> s ^ {cell}))"
    return f"if({bits} = {to}, {sketch}, {added})"


def _less(sa: str, na: str, sb: str, nb: str) -> str:
    """SQL of the cells of one sketch less those of another, parts by the fewer bits."""
    return _let("m", f"least({na}, {nb})", f"zip_with({_folded(sa, na, 'm')}, {_folded(sb, nb, 'm')}, (x, y) -> x ^ y)")


_MIXED = f"(c != 0 and (c & {_CHECK}L) != (xxhash64(c & {~_CHECK}L) & {_CHECK}L))"


def _peel(cells: str) -> str:
    """SQL of the digests recovered from the subtracted cells of a part; null if peeling sticks."""
    pure = f"array_distinct(filter(t.cells, c -> c != 0 and not {_MIXED}))"
    drop = f"transform(t.cells, (c, i) -> aggregate(ps, c, (s, x) -> if({_in_slot('x', f'(i div {SLOTS})', f'i % {SLOTS}')}, s ^ x, s)))"
    step = _let("ps", pure, f"if(size(ps) = 0, named_struct('cells', t.cells, 'got', t.got, 'done', true), named_struct('cells', {drop}, 'got', concat(t.got, ps), 'done', false))")
    start = f"named_struct('cells', {cells}, 'got', cast(array() as array<bigint>), 'done', false)"
    return f"aggregate(sequence(1, {_ROUNDS}), {start}, (t, r) -> if(t.done, t, {step}), t -> if(exists(t.cells, c -> c != 0), null, t.got))"


def _recovered(cells: str) -> str:
    """SQL of the digests that a part's subtracted cells hold; null if peeling sticks.

    A row of cells with one digest at most in each holds all of them: most parts are read from one row.
    """
    row = lambda r: _let("cs", f"slice({cells}, {SLOTS * r + 1}, {SLOTS})", f"if(exists(cs, c -> {_MIXED}), null, filter(cs, c -> c != 0))")
    return f"coalesce({', '.join(row(r) for r in range(ROWS))}, {_peel(cells)})"


def _by_part(less: str) -> str:
    """SQL of what a subtracted sketch gives up, part by part."""
    return f"transform(sequence(0, size({less}) div {CELLS} - 1), p -> {_let('w', f'slice({less}, p * {CELLS} + 1, {CELLS})', _recovered('w'))})"


def _differing(a: str, b: str, got: str, bits: str) -> str:
    """SQL of the number of digests in one of the sorted arrays a and b only; ``got``: what their sketch of so many bits gave up.

    The digests of both texts in the parts that stick are sketched again together (what
    is in both cancels, as by subtraction), in more parts of about one and a half
    digests, then in four times as many, and so on.
    """
    count = lambda of: f"aggregate({of}, 0, (s, g) -> s + if(g is null, 0, size(g)))"
    stuck = lambda keys: f"filter({keys}, x -> {got}[{_part('x', bits)}] is null)"
    finer = f"least(40, greatest({bits} + 1, cast(ceil(log2(size(t.keys) / 1.5D)) as int)) + 2 * level)"
    # Twice as many digests as cells are beyond peeling: such a part is split at once.
    tried = f"transform(zs, z -> if(size(z) > {2 * CELLS}, null, {_let('w', _cells('z'), _recovered('w'))}))"
    left = "flatten(filter(zs, (z, i) -> found[i] is null))"
    step = _let("n", finer, _let("cuts", _cuts("t.keys", "n"), _let("zs", _slices("t.keys", "cuts"), _let("found", tried, f"named_struct('keys', {left}, 'd', t.d + {count('found')})"))))
    start = f"named_struct('keys', sort_array(concat({stuck(a)}, {stuck(b)})), 'd', {count(got)})"
    # A digest of both texts stands twice in what is left, one of a single text once.
    exact = "t.d + 2 * size(array_distinct(t.keys)) - size(t.keys)"
    return f"if(exists({got}, g -> g is null), aggregate(sequence(0, {_LEVELS - 1}), {start}, (t, level) -> if(size(t.keys) = 0, t, {step}), t -> {exact}), {count(got)})"


def _difference(a: str, b: str, sa: str, sb: str) -> str:
    na, nb = _bits(f"size({a})"), _bits(f"size({b})")
    found = _let("got", _by_part("less"), _let("m", "least(na, nb)", _differing(a, b, "got", "m")))
    return _let("na", na, _let("nb", nb, _let("sa", sa, _let("sb", sb, _let("less", _less("sa", "na", "sb", "nb"), found)))))


def difference(a: str, b: str) -> Column:
    """Number of digests in one of two arrays (columns) and not in the other, from their sketches."""
    return F.expr(_difference(a, b, _sketch(a, _bits(f"size({a})")), _sketch(b, _bits(f"size({b})"))))


def likeness(a: str, b: str, sa: str, sb: str) -> Column:
    """Jaccard likeness of two arrays of digests with their sketches (columns): (all - differing) / (all + differing)."""
    n = f"(size({a}) + size({b}))"
    return F.expr(f"if({n} = 0, 1D, {_let('differ', _difference(a, b, sa, sb), f'cast(({n} - differ) / ({n} + differ) as double)')})")


def written(keys: str, sketch: str) -> Column:
    """The fingerprint as base64: the number of digests and the cells of their sketch, eight bytes each."""
    return F.expr(rf"translate(base64(unhex(array_join(transform(concat(array(cast(size({keys}) as bigint)), {sketch}), c -> lpad(hex(c), 16, '0')), ''))), '\r\n', '')")


def _read(fingerprint: str) -> str:
    """SQL of the longs of a written fingerprint: the number of digests, then the cells."""
    return _let("x", f"hex(unbase64({fingerprint}))", "transform(sequence(0, length(x) div 16 - 1), i -> cast(conv(substr(x, 16 * i + 1, 16), 16, -10) as bigint))")


def recovered_digests(a: str, b: str) -> Column:
    """Of two written fingerprints (columns), by part: the digests that stand in one text only; null for a part that sticks."""
    bits = lambda s: f"cast(round(log2((size({s}) - 1) / {CELLS})) as int)"
    rest = lambda s: f"slice({s}, 2, size({s}) - 1)"
    found = _let("less", _less("sa", "na", "sb", "nb"), _by_part("less"))
    return F.expr(_let("fa", _read(a), _let("fb", _read(b), _let("na", bits("fa"), _let("nb", bits("fb"), _let("sa", rest("fa"), _let("sb", rest("fb"), found)))))))


def written_likeness(a: str, b: str) -> Column:
    """Likeness of two written fingerprints (columns) from nothing else; null if a part sticks: then the texts are needed, for larger sketches."""
    n = F.expr(f"{_read(a)}[0] + {_read(b)}[0]")
    found = recovered_digests(a, b)
    d = F.aggregate(found, F.lit(0), lambda t, g: t + F.size(g))
    return F.when(~F.exists(found, lambda g: g.isNull()), F.when(n == 0, F.lit(1.0)).otherwise((n - d) / (n + d)))


def _range_of(value: str, borders: list[int]) -> str:
    """SQL of how many of the sorted borders a value has reached, found in two steps."""
    step = max(1, math.isqrt(len(borders)))
    groups = [borders[i : i + step] for i in range(0, len(borders), step)]
    listed = lambda xs: "array(" + ", ".join(f"{x}L" if x > -(1 << 63) else "(-9223372036854775807L - 1L)" for x in xs) + ")"
    if not borders:
        return "0L"
    within = f"size(filter(get(array({', '.join(map(listed, groups))}), g - 1), x -> x <= {value}))"
    return _let("g", f"size(filter({listed([g[0] for g in groups])}, x -> x <= {value}))", f"if(g = 0, 0L, cast((g - 1) * {step} + {within} as bigint))")


def _borders(rows: DataFrame, value: Column, n: int, min_bucket: int) -> list[int]:
    """Borders that cut a column's values into ranges of about max(min_bucket, sqrt(n)) rows."""
    ranges = math.ceil(n / max(min_bucket, math.isqrt(n))) if n else 1
    if ranges < 2:
        return []
    found = rows.agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], max(10_000, 4 * ranges))).first()[0]
    return sorted(set(found or []))


def with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_bucket: int = 256) -> DataFrame:
    """doc_id, text, keys (digests), and next_text, next_keys of the next document in descending order of id; the first follows the last.

    Ids are cut into ranges of about equally many rows, rows without an id into ranges
    of a hash of their text. A range is sorted by itself (one shuffle of the texts)
    and holds, behind its own rows, the first row of the range below. Only those first
    rows are gathered, one for each range of about sqrt(n) rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n, known = docs.agg(F.count(F.lit(1)), F.count(F.col(id_col))).first()
    mixed = F.xxhash64("text")
    by_id = _borders(rows, F.col("doc_id"), known, min_bucket)
    by_hash = _borders(rows.filter("doc_id is null"), mixed, n - known, min_bucket)
    rows = rows.withColumn("range", F.expr(f"if(doc_id is null, -1L - {_range_of('xxhash64(text)', by_hash)}, {_range_of('doc_id', by_id)})"))
    down = F.bitwise_not("doc_id")  # ascending as ids descend, nulls last below
    first = F.struct(down.isNull().alias("unknown"), down.alias("down"), mixed.alias("mixed"), F.col("text").alias("text"))
    tops = materialize(rows.groupBy("range").agg(F.min(first).alias("top")), "fingerprint-tops")
    every = Window.orderBy(F.col("range").desc())
    below = tops.select("range", F.coalesce(F.lead("range").over(every), F.max("range").over(Window.partitionBy())).alias("of"))
    guests = tops.select(F.col("range").alias("of"), F.col("top.text").alias("text")).join(broadcast_if_small(below, 100_000), "of")
    guests = guests.select(F.lit(None).cast("long").alias("doc_id"), "text", "range", F.lit(True).alias("guest"))
    both = rows.withColumn("guest", F.lit(False)).unionByName(guests).withColumn("keys", digests("text"))
    # Ranges are many where there is much: so are the partitions, whatever the session's setting.
    both = both.repartition(max(1, (len(by_id) + len(by_hash)) // 2), "range")
    order = Window.partitionBy("range").orderBy("guest", F.col("doc_id").desc_nulls_last(), mixed, "text")
    both = both.withColumn("_next", F.lead(F.struct("text", "keys")).over(order)).filter(~F.col("guest"))
    return both.select("doc_id", "text", "keys", F.col("_next.text").alias("next_text"), F.col("_next.keys").alias("next_keys"))


def fingerprint_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: n_chars, the edited text's sha256, both fingerprints, near_edited and near_next.

    The edited text has its last floor(n / 2) code points replaced by the first as
    many of the next document. Likeness is that of the fingerprints: their sketches subtract and peel.
    """
    rows = with_next(docs, id_col=id_col, text_col=text_col)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    # One row is made of each, so that what several columns need is computed once.
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), "keys", "next_keys", F.explode(F.array(edited)).alias("edited"))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.explode(F.array(F.struct("keys", "next_keys", digests("edited").alias("edited_keys")))).alias("_held"))
    sketch = lambda keys: F.expr(_sketch(keys, _bits(f"size({keys})")))
    rows = rows.select("doc_id", "n_chars", "edited_sha256", "_held", F.explode(F.array(F.struct(sketch("_held.keys").alias("own"), sketch("_held.edited_keys").alias("edited"), sketch("_held.next_keys").alias("next")))).alias("_made"))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        written("_held.keys", "_made.own").alias("fingerprint"),
        written("_held.edited_keys", "_made.edited").alias("edited_fingerprint"),
        likeness("_held.keys", "_held.edited_keys", "_made.own", "_made.edited").alias("near_edited"),
        likeness("_held.keys", "_held.next_keys", "_made.own", "_made.next").alias("near_next"),
    )
