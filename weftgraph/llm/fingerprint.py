"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

Native: only DataFrame functions. A document's paragraphs (lines that aren't blank; long
ones cut after a sentence end past 80 characters, or at the first blank past 160) become
a set of 64-bit digests. The set is dealt by hash into groups, 2**k of them so that a group
has about GROUP digests at most, and every group is a sketch of CELLS cells in three tables:
a digest enters one cell of each, and a cell holds a count, the xor of its digests and the
xor of their 16-bit checks. If a group has over FULL digests, or two with the same three
cells, it can't be peeled, and the set is dealt again into twice as many groups (RETRIES
times at most). Adding group i and group i + 2**(k-1) gives the sketch
with half as many groups, so one fingerprint is a ladder of sketches of all smaller sizes.

Likeness needs the two fingerprints and nothing else. Both are brought to one size;
subtracting them cell by cell leaves the digests in which the sets differ, and peeling cells
that hold a single one, all of them at once, recovers them. Groups that hold nothing, or the
same in both, have no cells until the fingerprint is written: values of lambda functions are
copied, so what these carry is kept small. On failure (foreseen if one is over FAR times as large
as the other, or if over CROWDED of the cells are taken), each is peeled alone at its own
size, which gives the sets themselves. Digests that even this can't part (three or more that
hold each other's cells; about 1 text in 100 has such) are counted by the cells they leave:
as differing if the sets share nothing else, or else as few as the subtraction allows. The result is the Jaccard similarity |A & B| / |A | B|, which follows from
the set sizes and the number of differing digests; two empty sets: 1.

The fingerprint is written as the set's size (8 hex digits) and, for each cell, its count
(2, modulo 256), xor of digests (16) and xor of checks (4). Equal texts have equal ones.

``edited`` needs the next document in descending doc_id. Rows are cut at quantiles of
doc_id into ranges of about RANGE_ROWS rows (RANGES at most), so outlying ids don't matter;
an id that fills several ranges, and null ids, are dealt to theirs by text hash. Each range
is one window partition, and the first row of each is also sent to the end of the one
before it, so texts are shuffled once and no window spans the table.

Cases: null text counts as empty; blank lines aren't paragraphs; repeated paragraphs
count once; very long texts have as many groups as they need; a null doc_id comes last;
equal doc_ids are ordered by text hash, then text; a single document is its own next; rows
repeated with id and text stay in one range; ids of the whole 64-bit range are fine. Other
columns are dropped. Empty tables give no rows.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .tables import materialize, read

CELLS, GROUP, FULL, RETRIES = 24, 10, 16, 4
FAR, CROWDED = 2, 0.8
RANGE_ROWS, RANGES = 4000, 1 << 16
_THIRD = CELLS // 3
_CHECK = "shiftrightunsigned(xxhash64({0}, 'check'), 48)"
_EMPTY = "named_struct('n', 0L, 'x', 0L, 'h', 0L)"
_BLANK = f"array_repeat({_EMPTY}, {CELLS})"
_NONE = "cast(array() as array<struct<n:bigint,x:bigint,h:bigint>>)"


def _place(x: str, j: int) -> str:
    return f"cast({j * _THIRD} + pmod(xxhash64({x}, {j}), {_THIRD}) as int)"


def _mask(x: str) -> str:
    """SQL: a bit for each of the three cells of a digest."""
    return " | ".join(f"shiftleft(1L, {_place(x, j)})" for j in range(3))


def _let(value: str, name: str, body: str) -> str:
    """SQL: body with name bound to value, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def digests(text: Column) -> Column:
    units = r"[ \t]*([^\n]{80,159}?[.!?](?=[ \t])|[^\n]{160}\S*|[^\n]+)"
    lines = F.filter(F.regexp_extract_all(text, F.lit(units), 1), lambda x: F.trim(x) != "")
    return F.sort_array(F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x))))


def _sketch(digest_array: str) -> str:
    """SQL: the groups of cells of an array of digests; a group without digests has no cells."""
    entries = f"transform(s, d -> named_struct('d', d, 'k', {_CHECK.format('d')}, 'g', xxhash64(d, 'group'), 'm', {_mask('d')}))"
    least = f"cast(greatest(0, ceil(log2(greatest(size(s), 1) / {GROUP}.0D))) as int)"
    # an entry's group and its cells in one number
    codes = f"transform(y.en, p -> shiftleft(p.g & (shiftleft(1L, y.least + r) - 1L), {CELLS}) | p.m)"
    full = _let(f"sort_array(transform(codes, c -> shiftright(c, {CELLS})))", "own", f"exists(sequence(0, size(own) - {FULL + 1}), i -> own[i] = own[i + {FULL}])")
    stuck = _let(codes, "codes", f"size(array_distinct(codes)) < size(codes) or (size(codes) > {FULL} and {full})")
    tries = f"aggregate(sequence(0, {RETRIES - 1}), 0, (t, r) -> if(t = r and {stuck}, r + 1, t))"
    # dealt in two steps, by the low half of the group's bits first, so that long arrays aren't read once a group
    step = "shiftleft(1, cast(floor(z.k / 2) as int))"
    first = "transform(sequence(0, v.m - 1), i -> filter(v.en, p -> p.g & (v.m - 1L) = i))"
    second = "transform(sequence(0, w.n - 1), i -> filter(w.p[i % w.m], p -> p.g & (w.n - 1L) = i))"
    dealt = _let(f"named_struct('en', z.en, 'm', {step}, 'n', shiftleft(1, z.k))", "v", _let(f"named_struct('p', {first}, 'm', v.m, 'n', v.n)", "w", second))
    groups = _let(f"named_struct('en', y.en, 'k', y.least + {tries})", "z", f"if(z.k = 0, array(z.en), {dealt})")
    groups = _let(digest_array, "s", _let(f"named_struct('en', {entries}, 'least', {least})", "y", groups))
    groups = f"transform({groups}, en -> named_struct('en', en, 'm', aggregate(en.m, 0L, (t, m) -> t | m)))"
    cell = _let("filter(g.en, p -> getbit(p.m, i) = 1Y)", "of", "named_struct('n', cast(size(of) as bigint), 'x', aggregate(of.d, 0L, (t, d) -> t ^ d), 'h', aggregate(of.k, 0L, (t, k) -> t ^ k))")
    return f"transform({groups}, g -> if(g.m = 0L, {_NONE}, transform(sequence(0, {CELLS - 1}), i -> if(getbit(g.m, i) = 0Y, {_EMPTY}, {cell}))))"


def _combined(a: str, b: str, sign: str) -> str:
    cells = f"zip_with(u, v, (m, o) -> named_struct('n', m.n {sign} o.n, 'x', m.x ^ o.x, 'h', m.h ^ o.h))"
    if sign == "+":
        return f"zip_with({a}, {b}, (u, v) -> if(size(v) = 0, u, if(size(u) = 0, v, {cells})))"
    return f"zip_with({a}, {b}, (u, v) -> if(size(v) = 0, u, if(size(u) = 0, transform(v, o -> named_struct('n', -o.n, 'x', o.x, 'h', o.h)), if(u = v, {_NONE}, {cells}))))"


def _folded(groups: str, size: str) -> str:
    """SQL: a sketch brought to so many groups by adding halves."""
    half = "cast(size(f) / 2 as int)"
    by_two = _combined(f"slice(f, 1, {half})", f"slice(f, {half} + 1, {half})", "+")
    return f"if(size({groups}) <= {size}, {groups}, aggregate(sequence(1, cast(round(log2(size({groups}) / {size})) as int)), {groups}, (f, turn) -> {by_two}))"


def _peeled(groups: str) -> str:
    """SQL: (ds: digests recovered from all groups, rest: number of those that stay).

    All cells that hold a single digest are emptied at once, and again while there are such.
    """
    single = lambda cells: f"transform(array_distinct(filter({cells}, c -> abs(c.n) = 1L and {_CHECK.format('c.x')} = c.h)), c -> named_struct('n', c.n, 'x', c.x, 'h', c.h, 'm', {_mask('c.x')}))"
    out = "transform(s.cells, (c, i) -> aggregate(filter(s.q, q -> getbit(q.m, i) = 1Y), c, (t, q) -> named_struct('n', t.n - q.n, 'x', t.x ^ q.x, 'h', t.h ^ q.h)))"
    step = _let(out, "out", f"named_struct('cells', out, 'ds', concat(s.ds, s.q.x), 'q', {single('out')}, 'rest', 1L)")
    left = [f"aggregate(slice(s.cells, {j * _THIRD + 1}, {_THIRD}), 0L, (t, c) -> t + if(c.n <> 0L, abs(c.n), if(c.x <> 0L or c.h <> 0L, 2L, 0L)))" for j in range(3)]
    # at the end the cells are given up, so that later turns have little to carry
    end = f"named_struct('cells', {_NONE}, 'ds', s.ds, 'q', s.q, 'rest', if(s.cells = {_BLANK}, 0L, greatest({', '.join(left)})))"
    run = f"aggregate(sequence(0, {CELLS + 1}), named_struct('cells', g, 'ds', cast(array() as array<bigint>), 'q', {single('g')}, 'rest', 1L), (s, turn) -> if(size(s.cells) = 0, s, if(size(s.q) = 0, {end}, {step})))"
    # several digests whose check is that of a single one by chance are taken for it, and it is found again with the other sign
    found = "if(size(array_distinct(flatten(parts.ds))) = size(flatten(parts.ds)), flatten(parts.ds), filter(array_distinct(flatten(parts.ds)), x -> size(filter(flatten(parts.ds), y -> y = x)) % 2 = 1))"
    return _let(f"transform(filter({groups}, g -> size(g) > 0), g -> {run})", "parts", f"named_struct('ds', {found}, 'rest', aggregate(parts.rest, 0L, (t, rest) -> t + rest))")


def _differing(a: str, b: str, own_a: str | None = None) -> str:
    """SQL: number of digests in which sketches a and b differ; own_a: a peeled alone, if known."""
    gap = _combined(_folded("two.a", "least(size(two.a), size(two.b))"), _folded("two.b", "least(size(two.a), size(two.b))"), "-")
    found = "(size(array_except(own.a.ds, own.b.ds)) + size(array_except(own.b.ds, own.a.ds)))"
    # of sets that share nothing else, what stays differs too; else one that stays in one sketch
    # may be one that the other gave up and add two, but the subtraction gives a lower bound
    least = _let(_peeled(gap), "part", f"greatest(size(part.ds) + part.rest, {found} - own.a.rest - own.b.rest)")
    sets = _let(f"named_struct('a', {own_a or _peeled('two.a')}, 'b', {_peeled('two.b')})", "own", f"if(own.a.rest + own.b.rest = 0L or not arrays_overlap(own.a.ds, own.b.ds), {found} + own.a.rest + own.b.rest, {least})")
    fails = "named_struct('ds', cast(array() as array<bigint>), 'rest', 1L)"
    taken = "aggregate(gap, 0, (t, g) -> t + size(filter(g, c -> c.n <> 0L or c.x <> 0L)))"
    tried = f"if({taken} > {CROWDED} * {CELLS} * size(gap), {fails}, {_peeled('gap')})"
    near = f"if(greatest(size(two.a), size(two.b)) > {FAR} * least(size(two.a), size(two.b)), {fails}, {_let(gap, 'gap', tried)})"
    return _let(f"named_struct('a', {a}, 'b', {b})", "two", _let(near, "whole", f"if(whole.rest = 0L, cast(size(whole.ds) as bigint), {sets})"))


def written(size: Column, groups: Column) -> Column:
    cell = lambda c: F.when((c["n"] == 0) & (c["x"] == 0) & (c["h"] == 0), F.lit("0" * 22)).otherwise(F.concat(F.lpad(F.hex(F.pmod(c["n"], F.lit(256))), 2, "0"), F.lpad(F.hex(c["x"]), 16, "0"), F.lpad(F.hex(c["h"]), 4, "0")))
    group = lambda g: F.when(F.size(g) == 0, F.lit("0" * 22 * CELLS)).otherwise(F.array_join(F.transform(g, cell), ""))
    return F.lower(F.concat(F.lpad(F.hex(size), 8, "0"), F.array_join(F.transform(groups, group), "")))


def parsed(fingerprint: str) -> tuple[str, str]:
    """SQL: (set size, groups of cells) of a written fingerprint."""
    cell = "named_struct('n', cast(conv(substr(c, 1, 2), 16, 10) as bigint), 'x', cast(conv(substr(c, 3, 16), 16, -10) as bigint), 'h', cast(conv(substr(c, 19, 4), 16, 10) as bigint))"
    parts = lambda of, width: f"regexp_extract_all({of}, '.{{{width}}}', 0)"
    group = f"if(g = repeat('0', {22 * CELLS}), {_NONE}, transform({parts('g', 22)}, c -> {cell}))"
    return f"cast(conv(substr({fingerprint}, 1, 8), 16, 10) as bigint)", f"transform({parts(f'substr({fingerprint}, 9)', 22 * CELLS)}, g -> {group})"


def likeness(a: str, b: str, size_a: str, size_b: str, own_a: str | None = None) -> Column:
    """Jaccard similarity of the sets behind sketches a and b (SQL), by subtraction; own_a: a peeled alone, if known."""
    both = f"({size_a} + {size_b})"
    return F.expr(_let(_differing(a, b, own_a), "d", f"if({both} + d = 0, 1.0D, greatest(0.0D, ({both} - d) / cast({both} + d as double)))"))


def likeness_of(a: str, b: str) -> Column:
    """Likeness of two columns of written fingerprints."""
    (size_a, cells_a), (size_b, cells_b) = parsed(a), parsed(b)
    return likeness(cells_a, cells_b, size_a, size_b)


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text): next in descending doc_id, the last one's next is the first."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n, nulls = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    ranges = max(1, min(RANGES, -(-n // RANGE_ROWS)))
    cuts: list[int] = []
    if ranges > 1 and n > nulls:
        cuts = sorted(docs.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], 20 * ranges)).first()[0])
    last = max(1, min(RANGES, -(-nulls // RANGE_ROWS)))  # ranges of null ids
    docs = docs.withColumn("hash", F.xxhash64("text"))
    unit = "(hash / 18446744073709551616D + 0.5D)"
    steps = max(1, len(cuts).bit_length())
    array = f"from_json('{json.dumps(cuts)}', 'array<bigint>')"
    below = lambda op: f"aggregate(sequence(1, {steps}), named_struct('lo', 0, 'hi', {len(cuts)}), (s, i) -> if(s.lo >= s.hi, s, if({array}[cast((s.lo + s.hi) div 2 as int)] {op} doc_id, named_struct('lo', cast((s.lo + s.hi) div 2 as int) + 1, 'hi', s.hi), named_struct('lo', s.lo, 'hi', cast((s.lo + s.hi) div 2 as int))))).lo"
    if cuts:  # ranges by falling id; rows of an id that is a cut several times are dealt to all its ranges
        docs = docs.withColumn("low", F.expr(below("<"))).withColumn("top", F.expr(below("<=")))
        own = F.expr(f"{len(cuts)} - top + least(top - low, cast(floor({unit} * (top - low + 1)) as int))")
    else:
        own = F.lit(0)
    docs = docs.withColumn("range", F.when(F.col("doc_id").isNull(), F.expr(f"{len(cuts) + 1} + least({last - 1}, cast(floor({unit} * {last}) as int))")).otherwise(own).cast("int")).drop("low", "top")
    lead = F.max(F.struct("doc_id", F.bitwise_not("hash").alias("not_hash"))).alias("first")
    firsts = docs.groupBy("range").agg(lead).orderBy("range").collect()  # a small row for each of RANGES at most, twice that with null ids
    known = [(r["range"], r["first"]["doc_id"], ~r["first"]["not_hash"], firsts[k - 1]["range"]) for k, r in enumerate(firsts)]
    opens = docs.sparkSession.createDataFrame(known, "range int, first_id long, first_hash long, before int")
    docs = docs.join(F.broadcast(opens), "range", "left")
    first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("hash") == F.col("first_hash"))
    stay, ghost = F.struct("range", F.lit(0).alias("ghost")), F.struct(F.col("before").alias("range"), F.lit(1).alias("ghost"))
    dealt = docs.withColumn("at", F.explode(F.when(first, F.array(stay, ghost)).otherwise(F.array(stay)))).select("doc_id", "text", "hash", "at.range", "at.ghost")
    order = W.partitionBy("range").orderBy("ghost", F.col("doc_id").desc_nulls_last(), "hash", "text")
    return dealt.withColumn("next_text", F.lead("text").over(order)).where("ghost = 0").select("doc_id", "text", "next_text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    d = with_next(docs)
    half = F.floor(F.col("n_chars") / 2).cast("int")
    d = d.withColumn("n_chars", F.char_length("text").cast("long"))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(F.col("next_text"), F.lit(1), half))
    d = d.withColumn("edited", edited).select("doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), digests(F.col("text")).alias("a"), digests(F.col("edited")).alias("e"), digests(F.col("next_text")).alias("x"))
    for c in ("a", "e", "x"):
        d = d.withColumn(f"n{c}", F.size(c).cast("long")).withColumn(f"s{c}", F.expr(_sketch(c)))
    d = d.withColumn("alone", F.expr(_peeled("sa")))
    return d.select(
        "doc_id", "n_chars", "edited_sha256", written(F.col("na"), F.col("sa")).alias("fingerprint"), written(F.col("ne"), F.col("se")).alias("edited_fingerprint"),
        likeness("sa", "se", "na", "ne", "alone").alias("near_edited"), likeness("sa", "sx", "na", "nx", "alone").alias("near_next"),
    )


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness."""
    return fingerprints(read(spark, sf_dir, "documents"))
