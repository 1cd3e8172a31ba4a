"""Order MinHash fingerprints, in DataFrame expressions alone.

A text is a sequence of words, its k-mers are runs of k words, and equal k-mers of a text are told
apart by the number of their occurrence. Under each of m permutations the l least k-mers are taken,
put back into the order of the text, and hashed as a tuple. Two texts agree in a tuple if they share
the selected k-mers in the same order, so the share of equal tuples follows edit distance, where
plain MinHash only sees sets.

The m permutations come from ``ORDERS`` independent ones, each a further hash of the k-mers, sorted, and as
many rotations of each: the next one begins at a later part of the hash's range and wraps around. Every
tuple is as from a random permutation, though those of one order depend on each other a little. For a text
of 8 k-mers one of which changes, the likeness has a standard deviation of 0.064 by simulation; with 64
independent permutations it has 0.061, and with 64 rotations of one order 0.168.

Everything is done within a row: no k-mer leaves it. A k-mer is one long, its hash above its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import SPACE, only, partitions, saved, text_of

K = 3
TUPLE = 2
PERMUTATIONS = 64
#: Bits of a k-mer's place in the text, and of its hash.
PLACE_BITS, HASH_BITS = 27, 36
#: A document among others: a null id is last.
KEY = ["no_id", "id", "h"]
#: Independent orders of the k-mers, each with as many rotations as the others; a hash times a factor is one.
ORDERS = 8
FACTORS = tuple(0x9E3779B97F4A7C15 * (2 * i + 1) ** 5 % (1 << (63 - HASH_BITS)) | 1 for i in range(ORDERS))


def with_fingerprint(df: DataFrame, text: str, out: str, k: int = K, m: int = PERMUTATIONS, size: int = TUPLE) -> DataFrame:
    """Adds ``out``: m tuples of eight hexadecimal digits for the column ``text``, which has no nulls.

    A text of fewer than k words is one k-mer; one without words is the k-mer of an empty word. Each
    step is a column of its own that the next refers to more than once, so none is evaluated anew
    for every element.
    """
    place, mask = (1 << PLACE_BITS) - 1, (1 << HASH_BITS) - 1
    run = ", ".join(f"get(_w, i + {j})" for j in range(k))
    trimmed = F.btrim(F.col(text), F.lit(" \t\n\x0b\f\r"))
    kmers = f"transform(sequence(0, greatest(size(_w) - {k}, 0)), i -> shiftleft(xxhash64({run}) & {mask}L, {PLACE_BITS}) | (i & {place}))"
    # the last element of a sorted array that is less than a limit, by halving; -1 if none is
    halves = "transform(sequence(cast(log2(size({a})) as int), 0, -1), e -> shiftleft(1, e))"
    last = "aggregate({h}, -1, (lo, step) -> if(lo + step < size({a}) and get({a}, lo + step) < {limit}, lo + step, lo))"
    first_of_run = last.format(h="_h", a="_s", limit=f"shiftleft(shiftright(x, {PLACE_BITS}), {PLACE_BITS})")
    numbered = (
        f"transform(_s, (x, i) -> if(shiftright(get(_s, i - 1), {PLACE_BITS}) = shiftright(x, {PLACE_BITS}), "
        f"shiftleft(xxhash64(shiftright(x, {PLACE_BITS}), i - 1 - {first_of_run}) & {mask}L, {PLACE_BITS}) | (x & {place}), x))"
    )
    steps = [
        ("_w", F.split(trimmed, f"{SPACE}+")),
        ("_p", F.expr(kmers)),
        ("_s", F.sort_array("_p")),
        ("_h", F.expr(halves.format(a="_s"))),
        ("_t", F.expr(numbered)),
    ]
    turns = m // ORDERS
    for order in range(ORDERS):
        u = f"_u{order}"
        own = f"(shiftright(x, {PLACE_BITS}) * {FACTORS[order]}L) & {mask}L"
        steps.append((u, F.sort_array(F.expr(f"transform(_t, x -> shiftleft({own}, {PLACE_BITS}) | (x & {place}))"))))
        start = last.format(h="_h", a=u, limit=f"shiftleft(cast(b as bigint) * {(1 << HASH_BITS) // turns}L, {PLACE_BITS})")
        # the hash of the l-th k-mer from a start on, below its place, so that sorting gives the text's order
        chosen = (
            f"sort_array(transform(sequence(1, least({size}, size({u}))), j -> shiftleft(get({u}, (lo + j) % size({u})) & {place}, "
            f"{HASH_BITS}) | shiftrightunsigned(get({u}, (lo + j) % size({u})), {PLACE_BITS})))"
        )
        hashed = f"xxhash64(transform({chosen}, y -> y & {mask}L))"
        digits = f"lower(right(lpad(hex({hashed}), 16, '0'), 8))"
        steps.append((f"_d{order}", F.array_join(F.expr(f"transform(transform(sequence(0, {turns - 1}), b -> {start}), lo -> {digits})"), "")))
    steps.append((out, F.concat(*(f"_d{order}" for order in range(ORDERS)))))
    for name, column in steps:
        df = df.withColumn(name, column)
    return df.drop(*(name for name, _ in steps[:-1]))


def likeness(a: Column, b: Column, m: int = PERMUTATIONS) -> Column:
    """Share of equal tuples of two fingerprints, 0 to 1."""
    same = (F.substring(a, 8 * i + 1, 8) == F.substring(b, 8 * i + 1, 8) for i in range(m))
    return sum((s.cast("int") for s in same), F.lit(0)).cast("double") / m


def _following(keys: DataFrame) -> DataFrame:
    """no_id, id, h, n and the next row's keys in ascending order; the first follows the last.

    Rows are cut into ranges, and a window runs within each; the first row of the next range comes
    from a table of one row a range. Only ids, hashes and lengths move.
    """
    n = partitions(keys.sparkSession)
    ranges = saved(keys.repartitionByRange(n, *KEY).withColumn("range", F.spark_partition_id()))
    heads = ranges.groupBy("range").agg(F.min(F.struct(*KEY)).alias("head"))
    order = Window.orderBy("range")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("range", F.coalesce(F.lead("head").over(order), F.first("head").over(whole)).alias("after"))
    own = Window.partitionBy("range").orderBy(*KEY)
    leads = ranges.withColumn("lead", F.lead(F.struct(*KEY)).over(own)).join(heads, "range")
    return leads.select(*KEY, "n", F.coalesce("lead", "after").alias("next"))


def fingerprints_of_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many of the
    next document, ascending doc_id; after the last comes the first, and a single document follows
    itself. Null texts are empty. Rows that share an id are ordered by the hash of their text, and
    rows that share both are one document that is listed as often. A null id comes last.

    A text's own fingerprint is made where it is read and moves with it.
    """
    doc_id = F.col(id_col)
    rows = only(docs, no_id=doc_id.isNull(), id=F.coalesce(doc_id, F.lit(0)), text=text_of(text_col))
    rows = rows.select("no_id", "id", F.xxhash64("text").alias("h"), "text")
    keys = rows.groupBy(*KEY).agg(F.max(F.length("text")).alias("n"))
    following = saved(_following(keys))
    # both joins read one exchange of the texts; only the given halves move again
    printed = with_fingerprint(rows, "text", "fingerprint")
    own = printed.join(following.drop("next"), KEY)
    before = following.select(
        *(F.col("next")[c].alias(c) for c in KEY), *(F.col(c).alias(f"to_{c}") for c in KEY), F.floor(F.col("n") / 2).cast("int").alias("room")
    )
    given = printed.join(before, KEY).select(
        *(F.col(f"to_{c}").alias(c) for c in KEY), F.left("text", "room").alias("given"), F.col("fingerprint").alias("next_fingerprint")
    ).dropDuplicates(KEY)
    left = F.left("text", F.col("n") - F.floor(F.col("n") / 2).cast("int"))
    joined = own.join(given, KEY).select("no_id", "id", "n", "fingerprint", "next_fingerprint", F.concat(left, "given").alias("edited"))
    return with_fingerprint(joined, "edited", "edited_fingerprint").select(
        F.when(~F.col("no_id"), F.col("id")).alias("doc_id"),
        F.col("n").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
