"""Document fingerprints: invertible Bloom lookup sketches of a text's paragraphs, in DataFrame operations only.

A text is cut at line ends, and long lines into stretches of ``PIECE`` characters (``FINE`` at the text's beginning); every distinct paragraph has a 64-bit digest. A sketch has three
parts of eight cells; a digest goes into one cell of each part, where a count, the exclusive-or of digests and that of their check hashes are kept. Two
sketches subtract cell by cell, and peeling takes digests out of cells that hold just one until nothing is left: the digests that only one
text has. If peeling sticks, the texts' digests are dealt by hash to as many sketches of the same size as they need, a larger sketch in parts
that peel by themselves; a part that sticks is dealt again, to eight, and should these stick under every hash function, their digests are
compared as sets. The likeness is the share of digests in common, (a + b - d) / (a + b + d) for a and b digests of which d differ.

The edited text of a document takes the beginning of the next one by doc_id. Documents are dealt into ranges of ids, and the rows of an id that
fills ranges of its own (also those without an id) by a hash of their text; the first document of each range is also sent to the range before it
(that of the first range to the last), so that each range finds its neighbours itself. The bounds come from approximate quantiles, about one for
``RANGE`` rows, or ``RANGES`` of them where that were more: ranges then hold more rows, which are sorted with spilling and read as a stream.

Work is linear in a text's length but for a sort of its digests: lines are cut by one pass of a pattern, and digests meet their parts by sorting.

Defined cases: null text is empty; rows of equal ids are ordered by a hash of the text; null ids come first; a lone document is its own next
one; texts without a character are alike (1.0); repeated rows are neighbours of each other; very long texts are cut and sketched whole; an empty table
gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, id_text

#: Characters of a paragraph at most; longer lines are cut.
PIECE = 256
#: Characters of a paragraph in the first ``PIECE`` of a text, so that short texts have several.
FINE = 32
#: A sketch has three parts of eight cells; a digest's cell in part p is three bits of its hash, from bit 8p.
PARTS, SIDE = 3, 8
#: Rounds of peeling at most; digests a sketch gets on average where one doesn't do; more hash functions for the smallest parts.
ROUNDS, PER_SKETCH, SALTS = 12, 9, (3, 4, 5)
RANGE, RANGES = 2048, 65536


def digests(text: str) -> str:
    """SQL for the distinct paragraph digests of a text."""
    first = f"substring_index(substring({text}, 1, {PIECE}), '\\n', 1)"
    cut = let("f", first, f"concat(regexp_extract_all(f, '[^\\n]{{1,{FINE}}}', 0), regexp_extract_all(substring({text}, length(f) + 1), '[^\\n]{{1,{PIECE}}}', 0))")
    return f"array_distinct(transform({cut}, l -> xxhash64(l)))"


def let(name: str, value: str, then: str) -> str:
    """SQL that evaluates ``value`` once under a name."""
    return f"element_at(transform(array({value}), {name} -> {then}), 1)"


def hashed(of: str, salt: int) -> str:
    """SQL for the digests with the numbers of their three cells and their check hash."""
    cells = ", ".join(f"'p{p}', {p * SIDE} + cast(shiftright(h, {8 * p}) & {SIDE - 1}L as int)" for p in range(PARTS))
    return f"transform({of}, d -> {let('h', f'xxhash64(d, {salt})', f'named_struct({chr(39)}key{chr(39)}, d, {cells}, {chr(39)}chk{chr(39)}, xxhash64(d, {chr(39)}check{chr(39)}))')})"


def sketch(of: str) -> str:
    """SQL for the cells (n, key, chk) of hashed digests."""
    empty = "named_struct('n', 0, 'key', 0L, 'chk', 0L)"
    add = "named_struct('n', s.n + 1, 'key', s.key ^ x.key, 'chk', s.chk ^ x.chk)"
    parts = (f"transform(sequence({p * SIDE}, {p * SIDE + SIDE - 1}), i -> aggregate(filter(q, x -> x.p{p} = i), {empty}, (s, x) -> {add}))" for p in range(PARTS))
    return let("q", of, f"concat({', '.join(parts)})")


def subtracted(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (x, y) -> named_struct('n', x.n - y.n, 'key', x.key ^ y.key, 'chk', x.chk ^ y.chk))"


def peeled(cells: str, salt: int) -> str:
    """SQL for the number of digests that peel off, or null if some are left. A round takes every digest that is alone in a cell out of all its cells."""
    alone = "abs(x.n) = 1 and xxhash64(x.key, 'check') = x.chk"
    places = ", ".join(f"'p{p}', {p * SIDE} + cast(shiftright(xxhash64(x.key, {salt}), {8 * p}) & {SIDE - 1}L as int)" for p in range(PARTS))
    pure = f"array_distinct(transform(filter(s.cells, x -> {alone}), x -> named_struct('n', x.n, 'key', x.key, {places}, 'chk', x.chk)))"
    mine = f"filter(p, d -> {' or '.join(f'd.p{p} = i' for p in range(PARTS))})"
    less = f"aggregate({mine}, x, (t, d) -> named_struct('n', t.n - d.n, 'key', t.key ^ d.key, 'chk', t.chk ^ d.chk))"
    take = let("p", pure, f"if(size(p) = 0, named_struct('cells', s.cells, 'd', s.d, 'on', false), named_struct('cells', transform(s.cells, (x, i) -> {less}), 'd', s.d + size(p), 'on', true))")
    left = "exists(s.cells, x -> x.n <> 0 or x.key <> 0)"
    return f"aggregate(sequence(1, {ROUNDS}), named_struct('cells', {cells}, 'd', 0, 'on', true), (s, r) -> if(s.on, {take}, s), s -> if({left}, cast(null as int), s.d))"


def both(a: str, b: str, salt: int) -> str:
    """SQL: sketch, subtract and peel two arrays of digests."""
    return peeled(subtracted(sketch(hashed(a, salt)), sketch(hashed(b, salt))), salt)


def dealt(a: str, b: str, parts: str, depth: int) -> str:
    """SQL for the difference of two arrays by one sketch for each part of their digests, by hash.

    A part that doesn't peel is dealt to eight; of those that don't either, other hash functions are tried, and then the digests compared as sets.
    """
    e, f, p = (f"{x}{depth}" for x in "efp")
    tagged = lambda x, sign: f"transform({x}, z -> struct(pmod(xxhash64(z, 'part', {depth}), n{depth}) as g, {sign} as s, z))"
    own = lambda sign: f"transform(filter({p}, x -> x.s = {sign}), x -> x.z)"
    x, y = f"ab{depth}.a", f"ab{depth}.b"
    one = both(x, y, depth)
    if depth == 1:
        one = f"coalesce({one}, {dealt(x, y, '8L', 2)})"
    else:
        one = f"coalesce({', '.join([one, *(both(x, y, salt) for salt in SALTS)])}, size(array_except({x}, {y})) + size(array_except({y}, {x})))"
    each = let(p, f"slice({e}, i + 1, coalesce(get({f}, cast(j + 1 as int)), size({e})) - i)", let(f"ab{depth}", f"named_struct('a', {own(0)}, 'b', {own(1)})", one))
    begins = f"filter(sequence(0, size({e}) - 1), i -> i = 0 or {e}[greatest(i - 1, 0)].g <> {e}[i].g)"
    whole = let(f, begins, f"aggregate(transform({f}, (i, j) -> {each}), 0, (t, d) -> t + d)")
    return let(f"n{depth}", parts, let(e, f"sort_array(concat({tagged(a, 0)}, {tagged(b, 1)}))", whole))


def likeness(a: str, b: str, sketch_a: str, sketch_b: str) -> Column:
    """(common digests) / (all digests) of two arrays: from their sketches, and larger ones where these don't peel."""
    n = f"(size({a}) + size({b}))"
    found = f"coalesce({peeled(subtracted(sketch_a, sketch_b), 0)}, {dealt(a, b, f'greatest(1L, cast(ceil({n} / {PER_SKETCH}.0D) as bigint))', 1)})"
    return F.expr(f"if({n} = 0, 1.0D, {let('d', found, f'({n} - d) / cast({n} + d as double)')})")


def written(of: str, cells: str) -> Column:
    """A sketch as a string: the number of digests, then each cell as count.key.check in hexadecimal, empty ones blank."""
    return F.expr(f"concat(size({of}), ':', array_join(transform({cells}, x -> if(x.n = 0, '', concat(x.n, '.', lower(hex(x.key)), '.', lower(hex(x.chk))))), ','))")


def ranged(rows: DataFrame) -> DataFrame:
    """Adds h, a hash of the text, and (r, part), the range of a row: ranges in order hold the rows in order of (doc_id, h), none first."""
    n, named = rows.agg(F.count(F.lit(1)), F.count("doc_id")).head()
    k = max(1, min(RANGES, -(-n // RANGE)))
    found = rows.agg(F.percentile_approx("doc_id", [i / k for i in range(1, k)], max(10_000, 4 * k))).head()[0] if k > 1 else None
    often = Counter(b for b in found or [] if b is not None)
    bounds, m = sorted(often), len(often)
    # a row's range is the number of bounds up to its id, by bisection in a constant array; an id that is several quantiles has as many parts
    sought, parts, steps = F.lit(bounds or [0]), F.lit([often[b] for b in bounds] or [1]), F.array(*(F.lit(1 << j) for j in range(max(1, m.bit_length()) - 1, -1, -1)))
    upto = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= m) & (F.try_element_at(sought, at + step) <= F.col("doc_id")), at + step).otherwise(at))
    at = F.greatest("r", F.lit(1))
    heavy = F.when(F.col("r") < 0, F.lit(max(1, -(-(n - named) * k // max(1, n))))).otherwise(F.try_element_at(parts, at))
    part = F.when((F.col("r") < 0) | (F.col("r") > 0) & (F.try_element_at(sought, at) == F.col("doc_id")), F.floor(F.shiftrightunsigned("h", 33) * heavy / F.lit(float(1 << 31)))).otherwise(heavy)
    return rows.withColumn("h", F.xxhash64("text")).withColumn("r", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(upto)).withColumn("part", part)


def neighbours(docs: DataFrame) -> DataFrame:
    """(doc_id, text, a, next_text, c): each document with the one that follows by doc_id, the first after the last, and both digests."""
    rows = ranged(id_text(docs))
    order = [F.col("doc_id").asc_nulls_first(), F.shiftrightunsigned("h", 33), F.col("h")]
    # a row for each range: its first document's id and hash, and the range before it
    firsts = rows.groupBy("r", "part").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id", F.shiftrightunsigned("h", 33), "h")).alias("first"))
    along = Window.orderBy("r", "part")
    last = F.last(F.struct("r", "part")).over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    before = firsts.select(F.col("first.doc_id").alias("first_id"), F.col("first.h").alias("first_h"), F.coalesce(F.lag(F.struct("r", "part")).over(along), last).alias("to"))
    # at most about 2 * RANGES rows of four numbers
    guests = rows.join(F.broadcast(before), F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h"))).groupBy("to").agg(F.min(F.struct("doc_id", "text", "h")).alias("x"))
    guests = guests.select("x.doc_id", "x.text", "x.h", "to.r", "to.part", F.lit(1).alias("guest"))
    dealt = rows.withColumn("guest", F.lit(0)).unionByName(guests).repartition("r", "part").withColumn("a", F.expr(digests("text")))
    here = Window.partitionBy("r", "part").orderBy("guest", *order, "text")
    return dealt.select("*", F.lead("text").over(here).alias("next_text"), F.lead("a").over(here).alias("c")).where("guest = 0").select("doc_id", "text", "a", "next_text", "c")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, digests, fingerprint): each document's paragraph digests and their sketch."""
    return id_text(docs).select("doc_id", F.expr(digests("text")).alias("digests")).withColumn("fingerprint", written("digests", sketch(hashed("digests", 0))))


def compare(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint against those of its edited text and of the next document."""
    edited = neighbours(docs).select("doc_id", "text", "a", "next_text", "c", F.length("text").cast("long").alias("n_chars")).withColumn("edited", F.expr("concat(substring(text, 1, n_chars - n_chars div 4), substring(next_text, 1, cast(n_chars div 4 as int)))"))
    found = edited.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "a", F.expr(digests("edited")).alias("b"), "c")
    found = found.select("*", *(F.expr(sketch(hashed(x, 0))).alias(f"s{x}") for x in "abc"))
    return found.select("doc_id", "n_chars", "edited_sha256", written("a", "sa").alias("fingerprint"), written("b", "sb").alias("edited_fingerprint"), likeness("a", "b", "sa", "sb").alias("near_edited"), likeness("a", "c", "sa", "sc").alias("near_next"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare(documents(spark, sf_dir))
