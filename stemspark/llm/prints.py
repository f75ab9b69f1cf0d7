"""Fingerprints of documents that tell which paragraphs differ, in DataFrame operations alone.

A text is cut into paragraphs that end with a line or a sentence: the first such end after SHORT characters, or LONG more
where there is none, so that the pieces hold all of it. The fingerprint is an invertible Bloom lookup sketch of the distinct paragraphs' digests: each digest is added to
one cell of each of three tables, a cell holds the number of its digests and the exclusive or of the digests and of their
check hashes. Two sketches are subtracted cell by cell, so what both documents hold is gone; cells with one digest left
are peeled until none is left, and the differing digests are known. Likeness is the Jaccard similarity of both sets of
paragraphs, from their sizes and these.

A fingerprint has WIDTHS[0] cells a table, whatever the document. Where peeling fails, the sketches are made
again larger: the digests are dealt by their hash into groups of about SHARE, each of which has a sketch of the first width, then,
where that fails too, of the next widths. Work grows with the number of paragraphs, and nothing moves for it.

The next document comes from a window over ranges of doc_id (quantiles of the ids, so many as there are partitions times
RANGES); the first document of the following range stands at each range's end. Texts move once.

Defined results: a null text is empty; the empty text has no paragraphs and an empty sketch; two documents without
paragraphs are alike (1); null ids come first, equal ids go by their texts; a single document is its own next one; ids that
are no integers are refused; an empty table gives an empty table; other columns don't matter. Rows of one doc_id are in
one range. A likeness is null if no width can tell the paragraphs apart, which takes digests that agree in all 64 bits of two hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Scratch, kept, long_id, parts

#: Characters of a paragraph before an end of a line or sentence counts, and those after that without one.
SHORT, LONG = 60, 200
PARAGRAPH = rf"[\s\S]{{1,{SHORT}}}[^.!?\n]{{0,{LONG}}}[.!?\n]*"
#: Cells of each of the three tables: those of a fingerprint first, then those of each retry.
WIDTHS = (8, 32, 128, 4096)
#: Digests of both documents in one group of a retry.
SHARE = 8
RANGES = 4

_ELEMENT = "struct<c: int, d: bigint, t: int>"


def _let(value: str, name: str, body: str) -> str:
    """A SQL expression in which `name` stands for a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _cells_of(digest: str, rung: int) -> str:
    """The cells of a digest, one a table; each width looks at bits of its own."""
    width = WIDTHS[rung]
    low, bits = (digest, sum(w.bit_length() - 1 for w in WIDTHS[:rung])) if rung < 3 else (f"xxhash64({digest})", 0)
    return "array(" + ", ".join(f"int(shiftright({low}, {20 * k + bits}) & {width - 1}) + {k * width}" for k in range(3)) + ")"


def digests(text: Column) -> Column:
    """The distinct digests of a text's paragraphs."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.xxhash64(p)))


def _sketch(digests_: str, rung: int) -> str:
    """The cells of an array of digests: n digests, the exclusive or of them and of their hashes."""
    items = f"transform({digests_}, d -> named_struct('c', hash(d), 'd', d, 'at', {_cells_of('d', rung)}))"
    cell = "named_struct('n', size(f), 'x', aggregate(f, 0L, (a, e) -> a ^ e.d), 'h', aggregate(f, 0, (a, e) -> a ^ e.c))"
    cells = f"transform(sequence(0, {3 * WIDTHS[rung] - 1}), i -> {_let('filter(items, e -> array_contains(e.at, i))', 'f', cell)})"
    return _let(items, "items", cells)


def _difference(items: str, rung: int) -> str:
    """The cells of two documents' digests at once (items: c, d, t; t is 0 for the first document's): those of the second are
    subtracted as they come."""
    placed = f"transform({items}, e -> named_struct('c', e.c, 'd', e.d, 's', 1 - 2 * e.t, 'at', {_cells_of('e.d', rung)}))"
    add = "aggregate(filter(items, e -> array_contains(e.at, i)), named_struct('n', 0, 'x', 0L, 'h', 0), (v, e) -> named_struct('n', v.n + e.s, 'x', v.x ^ e.d, 'h', v.h ^ e.c))"
    return _let(placed, "items", f"transform(sequence(0, {3 * WIDTHS[rung] - 1}), i -> {add})")


def _peeled(difference: str, rung: int, rounds: int = 16) -> str:
    """How many digests the first and the second document have alone, by peeling the difference of their sketches; null if that
    fails."""
    single = "array_distinct(transform(filter(s.cells, c -> abs(c.n) = 1 AND c.h = hash(c.x)), c -> named_struct('d', c.x, 's', c.n, 'c', c.h)))"
    single = f"transform({single}, p -> named_struct('d', p.d, 's', p.s, 'c', p.c, 'at', {_cells_of('p.d', rung)}))"
    less = "transform(s.cells, (c, i) -> aggregate(filter(single, p -> array_contains(p.at, i)), c, (v, p) -> named_struct('n', v.n - p.s, 'x', v.x ^ p.d, 'h', v.h ^ p.c)))"
    more = "named_struct('cells', {0}, 'a', s.a + size(filter(single, p -> p.s = 1)), 'b', s.b + size(filter(single, p -> p.s = -1)), 'live', size(single) > 0)"
    step = _let(single, "single", f"if(size(single) = 0, {more.format('s.cells')}, {more.format(less)})")
    start = f"named_struct('cells', {difference}, 'a', 0, 'b', 0, 'live', true)"
    ends = "if(exists(s.cells, c -> c.n <> 0 OR c.x <> 0 OR c.h <> 0), null, named_struct('a', s.a, 'b', s.b))"
    return f"aggregate(sequence(1, {rounds}), {start}, (s, k) -> if(s.live, {step}, s), s -> {ends})"


def _subtracted(a: str, b: str) -> str:
    """The difference of two sketches, cell by cell."""
    return f"zip_with({a}, {b}, (p, q) -> named_struct('n', p.n - q.n, 'x', p.x ^ q.x, 'h', p.h ^ q.h))"


def _retried(a: str, b: str) -> str:
    """The same from arrays of digests, by groups of their hashes; null if some group fails at every width."""
    elements = ", ".join(f"transform({x}, d -> named_struct('c', hash(d), 'd', d, 't', {t}))" for t, x in enumerate((a, b)))
    bits = f"least(30, greatest(1, int(ceil(log2((size({a}) + size({b})) / {SHARE})))))"
    nothing = f"named_struct('done', cast(array() AS array<array<{_ELEMENT}>>), 'now', cast(array() AS array<{_ELEMENT}>), 'g', -1)"
    add = "named_struct('done', s.done, 'now', concat(s.now, array(e)), 'g', s.g)"
    next_ = "named_struct('done', concat(s.done, array(s.now)), 'now', array(e), 'g', shiftrightunsigned(e.c, 32 - bits))"
    groups = _let(bits, "bits", f"aggregate(sort_array(concat({elements})), {nothing}, (s, e) -> if(shiftrightunsigned(e.c, 32 - bits) = s.g, {add}, {next_}), s -> concat(s.done, array(s.now)))")
    tries = ", ".join(_peeled(_difference("g", rung), rung) for rung in range(len(WIDTHS)))
    total = "named_struct('a', aggregate(r, 0, (v, x) -> v + x.a), 'b', aggregate(r, 0, (v, x) -> v + x.b))"
    return _let(f"transform({groups}, g -> coalesce({tries}))", "r", f"if(exists(r, x -> x IS NULL), null, {total})")


def likeness(a: str, b: str, sketch_a: str, sketch_b: str) -> Column:
    """Jaccard similarity of two sets of paragraphs (columns of digests and of their sketches)."""
    both = f"if(r IS NULL, null, if(size({b}) + r.a = 0, 1D, double(size({a}) - r.a) / (size({b}) + r.a)))"
    return F.expr(_let(f"coalesce({_peeled(_subtracted(sketch_a, sketch_b), 0)}, {_retried(a, b)})", "r", both))


def as_text(sketch: str) -> Column:
    """A sketch's cells in Base64: 16 bytes a cell."""
    cell = "concat(lpad(hex(c.n), 8, '0'), lpad(hex(c.x), 16, '0'), right(concat('0000000', hex(c.h)), 8))"
    return F.expr(f"translate(base64(unhex(array_join(transform({sketch}, c -> {cell}), ''))), '\\r\\n', '')")


def _range_of(id_: str, borders: list[int]) -> Column:
    """In which range of sorted borders an id lies, looked up in two steps of the root of their number."""
    step = max(1, int(len(borders) ** 0.5))
    groups = [borders[k : k + step] for k in range(0, len(borders), step)]
    arrays = [f"array({', '.join(f'{b}L' for b in g)})" for g in groups]
    heads = f"array({', '.join(f'{g[0]}L' for g in groups)})"
    fine = f"size(filter(array({', '.join(arrays)})[k - 1], b -> b <= {id_}))"
    return F.expr(f"if({id_} IS NULL, 0, {_let(f'size(filter({heads}, b -> b <= {id_}))', 'k', f'if(k = 0, 0, (k - 1) * {step} + {fine})')})")


def with_next(docs: DataFrame, work: Scratch) -> DataFrame:
    """doc_id, text, next (the text of the next document) of each row."""
    n = parts(docs.sparkSession) * RANGES
    rows = docs.select(long_id(docs).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    borders = rows.select(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 10 * n)).first()[0]
    borders = sorted(set(borders or []))
    rows = rows.withColumn("range", _range_of("doc_id", borders) if borders else F.lit(0)).withColumn("end", F.lit(False))
    lows = rows.groupBy("range").agg(F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("low"))  # nulls come first; a row a range
    first = rows.join(F.broadcast(lows), (F.coalesce("doc_id", F.lit(-(1 << 63))) == F.col("low")) & (rows["range"] == lows["range"]), "left_semi")
    first = first.groupBy("range").agg(F.min(F.struct("doc_id", "text")).alias("f"))
    before = Window.orderBy("range")  # as many rows as ranges
    first = work.kept(first, "firsts").withColumn("of", F.coalesce(F.lag("range").over(before), F.max("range").over(before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    rows = rows.unionByName(first.select(F.lit(None).cast("long").alias("doc_id"), "f.text", F.col("of").alias("range"), F.lit(True).alias("end")))
    order = Window.partitionBy("range").orderBy("end", "doc_id", "text")
    return rows.withColumn("next", F.lead("text").over(order)).where(~F.col("end")).select("doc_id", "text", "next")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row of docs."""
    work = Scratch(docs.sparkSession, "fingerprints")
    rows = with_next(docs, work).withColumn("n_chars", F.char_length("text").cast("long"))
    less = F.floor(F.col("n_chars") / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.expr("left(text, int(n_chars) - int(floor(n_chars / 4)))"), F.left("next", less)))
    rows = rows.select("doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), *(digests(F.col(c)).alias(a) for c, a in (("text", "own"), ("edited", "changed"), ("next", "other"))))
    rows = rows.withColumns({f"{c}_sketch": F.expr(_sketch(c, 0)) for c in ("own", "changed", "other")})
    rows = rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text("own_sketch").alias("fingerprint"),
        as_text("changed_sketch").alias("edited_fingerprint"),
        likeness("own", "changed", "own_sketch", "changed_sketch").alias("near_edited"),
        likeness("own", "other", "own_sketch", "other_sketch").alias("near_next"),
    )
    out = kept(rows, "fingerprints")
    work.drop()
    return out
