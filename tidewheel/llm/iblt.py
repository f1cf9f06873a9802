"""Document fingerprints: invertible Bloom lookup sketches of paragraphs, in DataFrame expressions only.

A paragraph unit is a line, a long one cut every UNIT code points from its start. A text's sketch has CELLS
cells of (count, XOR of digests, XOR of check digests); each distinct unit's 64-bit digest falls into three of
them, one per third. Two sketches subtract cell by cell, units in common cancel, and peeling takes out digests
that are alone in a cell until none is left: then the differing digests are known. Where that gets stuck, a larger sketch is
tried: the digests are split by one to MOST_BITS further bits into parts of about AIM, and each part is sketched again;
parts of more than PART_UNITS digests are split further at once. Digests that no bits are left for are compared as sets.

Likeness of two sketches is the share of their units in common: (a + b - differing) / (a + b), 1 for two
empty ones.

Cases: a null text counts as empty; empty lines are no units and repeated units count once; of one document
only, the next is itself; ids of any type that can be ordered do; rows that repeat an id follow each other in the order
of their texts; a null id comes first, and so also after the last; an empty table gives no rows; other columns are ignored.

Scale: texts are shuffled once, to buckets of consecutive ids whose borders come from BORDER_IDS ids a bucket, those with
the smallest hashes; each bucket also gets the first document of the next one. There are no more buckets than BUCKETS
or, if that is more, shuffle partitions, so that the driver's list of borders is bounded by the session's setting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm.common import body, discard, partitions, saved

UNIT, CELLS, ROUNDS = 160, 24, 7
BUCKET_DOCS, BUCKETS, BORDER_IDS = 512, 4096, 32
AIM, MOST_BITS, PART_UNITS = 16, 4, 48
_THIRD = CELLS // 3


def _mask(k: str) -> str:
    """The cells that a digest falls into, as bits."""
    bits = [f"shiftleft(1, {third * _THIRD} + cast(shiftright({k}, {8 * third}) & {_THIRD - 1} as int))" for third in range(3)]
    return f"({' | '.join(bits)})"


def _check(k: str) -> str:
    return f"xxhash64({k}, 1)"


def units(text: Column) -> Column:
    """Distinct 64-bit digests of a text's paragraph units."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"[^\\n]{{1,{UNIT}}}"), F.lit(0)), lambda u: F.xxhash64(u)))


def sketch(digests: str) -> Column:
    """CELLS cells (i, n, k, x) of an array of digests."""
    marked = f"transform({digests}, u -> named_struct('u', u, 'm', {_mask('u')}, 'x', {_check('u')}))"
    return F.expr(f"""element_at(transform(array({marked}), p -> transform(sequence(0, {CELLS - 1}), i -> aggregate(filter(p, e -> (e.m & shiftleft(1, i)) != 0),
        named_struct('i', i, 'n', 0, 'k', 0L, 'x', 0L),
        (a, e) -> named_struct('i', a.i, 'n', a.n + 1, 'k', a.k ^ e.u, 'x', a.x ^ e.x)))), 1)""")


def subtracted(one: str, other: str) -> Column:
    return F.expr(f"zip_with({one}, {other}, (a, b) -> named_struct('i', a.i, 'n', a.n - b.n, 'k', a.k ^ b.k, 'x', a.x ^ b.x))")


def peeled(cells: str) -> Column:
    """Number of digests recovered from subtracted cells; null if some are left."""
    pure = f"array_distinct(transform(filter(s.cells, c -> abs(c.n) = 1 and c.x = {_check('c.k')}), c -> named_struct('k', c.k, 'n', c.n, 'm', {_mask('c.k')}, 'x', c.x)))"
    less = """transform(s.cells, c -> aggregate(filter(p, e -> (e.m & shiftleft(1, c.i)) != 0), c,
        (a, e) -> named_struct('i', a.i, 'n', a.n - e.n, 'k', a.k ^ e.k, 'x', a.x ^ e.x)))"""
    step = f"element_at(transform(array({pure}), p -> if(size(p) = 0, s, named_struct('cells', {less}, 'd', s.d + size(p)))), 1)"
    return F.expr(f"""aggregate(sequence(1, {ROUNDS}), named_struct('cells', {cells}, 'd', 0), (s, r) -> if(exists(s.cells, c -> c.n != 0 or c.k != 0), {step}, s),
        s -> if(exists(s.cells, c -> c.n != 0 or c.k != 0), cast(null as int), s.d))""")


def written(cells: str) -> Column:
    """A sketch as text: count and digest sum of each cell, in hexadecimal."""
    return F.lower(F.array_join(F.transform(F.col(cells), lambda c: F.concat(F.hex(c["n"].cast("long")), F.lit(":"), F.hex(c["k"]))), " "))


def _borders(rows: DataFrame) -> list:
    """Ids that cut rows into buckets of about BUCKET_DOCS: of those with the smallest hashes, every BORDER_IDS-th in order."""
    n = max(1, min(max(BUCKETS, partitions(rows.sparkSession)), -(-rows.count() // BUCKET_DOCS)))
    if n == 1:
        return []
    ids = rows.where("doc_id is not null").select("doc_id").distinct()
    some = sorted(r.doc_id for r in ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(BORDER_IDS * n).collect())
    step = max(1, len(some) // n)
    return some[step::step]


def _bucket(cuts: list, kind: str) -> Column:
    """The number of borders at or under an id, found among every WIDTH-th first; 0 for a null id."""
    if not cuts:
        return F.lit(0)
    width = max(1, int(len(cuts) ** 0.5))
    below = lambda a: F.size(F.filter(a, lambda s: s <= F.col("doc_id")))
    literal = lambda v: F.array(*map(F.lit, v)).cast(f"array<{kind}>")
    block = below(literal(cuts[width - 1 :: width]))
    groups = [cuts[k : k + width] for k in range(0, len(cuts), width)] + [[]] * (len(cuts) % width == 0)
    within = below(F.get(F.array(*map(literal, groups)), block))
    return F.when(F.col("doc_id").isNull(), 0).otherwise(block * width + within).cast("int")


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, a (digests of its units), sa (its sketch), next_text, b, sb: of the next document by id, after the last the first."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), body(text_col).alias("text"))
    rows = rows.withColumn("bucket", _bucket(_borders(rows), kind))
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("_some"), "doc_id"))
    heads = sorted((r.bucket, r.head.doc_id) for r in rows.groupBy("bucket").agg(first.alias("head")).collect())
    moved = [(head, heads[k - 1][0]) for k, (_, head) in enumerate(heads)]
    after = F.broadcast(spark.createDataFrame(moved, f"_head {kind}, _to int"))  # a row per bucket
    guests = rows.drop("bucket").join(after, F.col("doc_id").eqNullSafe(F.col("_head"))).groupBy(F.col("_to").alias("bucket")).agg(F.first("doc_id").alias("doc_id"), F.min("text").alias("text"))
    both = rows.withColumn("_guest", F.lit(False)).unionByName(guests.withColumn("_guest", F.lit(True)))
    order = ["_guest", F.col("doc_id").asc_nulls_first(), "text"]
    both = both.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", *order)
    both = both.withColumn("a", units(F.col("text"))).withColumn("sa", sketch("a"))
    turn = Window.partitionBy("bucket").orderBy(*order)
    both = both.withColumns({n: F.lead(c).over(turn) for n, c in (("next_text", "text"), ("b", "a"), ("sb", "sa"))}).where("not _guest")
    return both.select("doc_id", "text", "a", "sa", "next_text", "b", "sb")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by the next document's first as many.
    """
    rows = with_next(docs, id_col, text_col).withColumn("n", F.char_length("text"))
    half = F.floor(F.col("n") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n") - half), F.substring("next_text", F.lit(1), half)))
    rows = rows.select("doc_id", F.col("n").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "a", "sa", "b", "sb", units(F.col("edited")).alias("e"))
    rows = rows.withColumn("se", sketch("e"))
    rows = rows.withColumns({"de": subtracted("sa", "se"), "db": subtracted("sa", "sb")})
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_chars", "edited_sha256", written("sa").alias("fingerprint"), written("se").alias("edited_fingerprint"), "a", "e", "b", peeled("de").alias("de"), peeled("db").alias("db"))
    once = F.when(F.col("de").isNull() | F.col("db").isNull(), F.col("a"))
    rows = rows.withColumns({"na": F.size("a"), "ne": F.size("e"), "nb": F.size("b"), "a": once, "e": F.when(F.col("de").isNull(), F.col("e")), "b": F.when(F.col("db").isNull(), F.col("b"))})
    base = saved(rows, "sketches")

    parts = base.select("row", F.explode(F.array(F.struct(F.lit("e").alias("kind"), F.col("e").alias("other")), F.struct(F.lit("b").alias("kind"), F.col("b").alias("other")))).alias("o"), F.col("a").alias("one"))
    stuck = parts.select("row", "o.kind", "one", "o.other", F.lit(24).alias("bit")).where("other is not null")
    found, last = None, None
    while True:
        total = F.size("one") + F.size("other")
        more = F.when(F.col("bit") > 59, 0).otherwise(F.least(F.greatest(F.ceil(F.log2(total / AIM)), F.lit(1)), F.lit(MOST_BITS)).cast("int"))
        child = lambda a: f"filter({a}, u -> (shiftright(u, bit) & (ways - 1)) = q)"
        split = stuck.withColumn("more", more).withColumn("ways", F.expr("shiftleft(1, more)")).select("row", "kind", "bit", "more", "ways", F.expr(f"inline(transform(sequence(0, ways - 1), q -> named_struct('one', {child('one')}, 'other', {child('other')})))"))
        split = split.where(total > 0)  # of a stuck pair some part is left
        sets = F.expr("size(array_except(one, other)) + size(array_except(other, one))")
        tried = F.when(F.col("ways") == 1, sets).when(total <= PART_UNITS, peeled("cells"))
        some = (total <= PART_UNITS) & (F.col("ways") > 1)
        split = split.withColumns({"x": F.when(some, sketch("one")), "y": F.when(some, sketch("other"))})
        split = split.withColumn("cells", F.when(some, subtracted("x", "y"))).withColumn("d", tried)
        level = split.select("row", "kind", "d", *(F.when(F.col("d").isNull(), F.col(c)).alias(c) for c in ("one", "other")), (F.col("bit") + F.col("more")).alias("bit"))
        level = saved(level, "sketch-level")
        done = saved(level.where("d is not null").groupBy("row", "kind").agg(F.sum("d").alias("d")), "sketch-found")
        found = done if found is None else found.unionByName(done)
        if last is not None:
            discard(last)
        last = level
        stuck = level.where("d is null").select("row", "kind", "one", "other", "bit")
        if not stuck.head(1):
            break
    discard(last)
    late = found.groupBy("row").agg(F.sum(F.when(F.col("kind") == "e", F.col("d"))).alias("le"), F.sum(F.when(F.col("kind") == "b", F.col("d"))).alias("lb"))
    out = base.drop("a", "e", "b").join(late.hint("merge"), "row", "left")
    like = lambda n, d, later: F.when(F.col("na") + F.col(n) == 0, F.lit(1.0)).otherwise((F.col("na") + F.col(n) - F.coalesce(d, later)) / (F.col("na") + F.col(n)))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", like("ne", "de", "le").alias("near_edited"), like("nb", "db", "lb").alias("near_next"))
