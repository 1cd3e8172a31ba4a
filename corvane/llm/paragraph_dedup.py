"""Substring dedup: paragraphs that repeat, by MinHash banding, and passages that repeat wherever they lie.

Every document is reduced where it is read: each paragraph to a digest and the keys of its bands, the
whole text to pieces of fixed length. Equal paragraphs are one node. Different ones that share a band
meet, their texts are fetched, and the exact Jaccard similarity of their five-word shingles decides.
Linked paragraphs make components; of each, the first paragraph stays and all others are removed.

A passage inside of otherwise different paragraphs, or over several short ones, leaves their
similarity low. So pieces of the document's whole sequence of words, line ends or not, are compared
too. They begin where a shingle's hash is the least of its neighbourhood: wherever a run of ``RUN``
words or more occurs, one of its pieces at least begins at the same word. Equal pieces in a row are an
island; its words are compared with those of the first document that has them, and it grows to both
sides as far as these agree. The first document keeps the passage.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm import minhash
from corvane.llm.common import WORD, batches_of, only, saved, small, text_of, written
from corvane.llm.graph import bucket_components
from corvane.llm.set_join import links_across
from corvane.llm.simhash import alike

WIDTH = 5
SIMILARITY = 0.8
RECALL = 0.999
MAX_ROWS_OF_A_BAND = 3
#: Words from which on the registered query takes a line as a paragraph: three shingles that share no word. Any other number can be given.
MIN_WORDS = 3 * WIDTH
#: Ids that stand for rows without one, from the least long on, each row a document of its own.
NO_ID, LAST_NO_ID = -(1 << 63), -(1 << 63) + (1 << 53)
#: Words of a shared run that is certain to be found, and of a piece.
RUN = 50
PIECE_WORDS = 30
#: Words by which an island grows at most: further ones belong to another island.
REACH = RUN - PIECE_WORDS

LISTS = ("starts", "lengths", "first_words", "sizes", "digests", "bands")
DOCUMENT = (
    "doc_id long, starts array<long>, lengths array<long>, first_words array<int>, sizes array<int>, "
    "digests array<binary>, bands array<array<long>>, pieces array<long>, places array<int>"
)
#: keep_a is null where the island is what another one keeps.
CUT = "doc_id long, a int, b int, keep_id long, keep_a int, n long, digest binary, before array<int>, after array<int>, starts array<int>, ends array<int>"
RESULT = ["doc_id", "kind", "start", "length", "first_word", "n_words", "keep_doc_id", "keep_start", "group_size"]

_WORD = re.compile(WORD)
_FACTORS = np.array([xxhash.xxh64_intdigest(bytes([i])) | 1 for i in range(WIDTH + PIECE_WORDS // WIDTH)], dtype=np.uint64)


def tuned_bands(similarity: float = SIMILARITY, recall: float = RECALL, most: int = MAX_ROWS_OF_A_BAND) -> tuple[int, int]:
    """``minhash.tuned_bands`` for paragraphs."""
    return minhash.tuned_bands(similarity, recall, most)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of texts, A-Z in lower case, and the number of each text's."""
    found = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = found.flatten()
    filled = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(filled.to_numpy(zero_copy_only=False))])
    ends = np.cumsum(pc.list_value_length(found).to_numpy(zero_copy_only=False))
    return flat.filter(filled), np.diff(before[np.concatenate([[0], ends]).astype(np.int64)])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ x >> np.uint64(29)


def shingles_of(words: pa.Array) -> np.ndarray:
    """A hash of every run of ``WIDTH`` words."""
    coded = words.dictionary_encode()
    hashes = map(xxhash.xxh64_intdigest, coded.dictionary.to_pylist())
    own = np.fromiter(hashes, dtype=np.uint64, count=len(coded.dictionary))[coded.indices.to_numpy()]
    n = max(0, len(own) - WIDTH + 1)
    return _mixed(sum((own[j : j + n] * _FACTORS[j] for j in range(WIDTH)), np.zeros(n, dtype=np.uint64)))


def _sliding(op: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """``op`` of every ``width`` neighbours."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = op(x[:-step], x[step:])
        done += step
    return x


def pieces_of(shingles: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of pieces in the words of all texts, and their hashes; ``sizes`` has the words of each text.

    A place is taken if its shingle is the least of the possible first shingles of the pieces of some run.
    """
    runs, around = int(sizes.sum()) - RUN + 1, RUN - PIECE_WORDS + 1
    if runs <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes)
    least = _sliding(np.minimum, shingles | np.uint64(1), around)[:runs]
    least = np.where(text[:runs] == text[RUN - 1 :], least, np.uint64(0))
    edge = np.zeros(around - 1, dtype=np.uint64)
    most = _sliding(np.maximum, np.concatenate([edge, least, edge]), around)
    at = np.nonzero(most == shingles[: len(most)] | np.uint64(1))[0]
    parts = (shingles[at + WIDTH * k] * _FACTORS[WIDTH + k] for k in range(PIECE_WORDS // WIDTH))
    return at, _mixed(sum(parts, np.zeros(len(at), dtype=np.uint64))).view(np.int64)


def _lists(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def _offsets(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def _digests(words: pa.Array, counts: np.ndarray) -> list[bytes]:
    """128 bits for each text of so many words."""
    return [xxhash.xxh3_128_digest(x) for x in pc.binary_join(_lists(words, counts), " ").to_pylist()]


def _documents(min_words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lists of ``DOCUMENT`` for (doc_id, text)."""
    bands, rows = tuned_bands()
    for whole in batches:
        for a, b in batches_of(whole.column(1)):
            batch = whole.slice(a, b - a)
            split = pc.split_pattern(batch.column(1), "\n")
            lines, per_doc = split.flatten(), pc.list_value_length(split).to_numpy()
            words, counts = words_of(lines)
            shingles = shingles_of(words)
            of_line = np.repeat(np.arange(len(lines)), counts)
            doc_of = np.repeat(np.arange(len(per_doc)), per_doc)
            heads = _offsets(per_doc)

            taken = np.nonzero(counts >= max(1, min_words))[0]
            chars, at = pc.utf8_length(lines).to_numpy(), _offsets(counts)
            lengths = chars[taken]
            starts = _offsets(chars + 1)[taken] - _offsets(chars + 1)[heads][doc_of[taken]]
            first = at[taken] - at[heads][doc_of[taken]]
            mine = np.isin(of_line, taken)
            own = shingles[mine[: len(shingles)] & (of_line[: len(shingles)] == of_line[WIDTH - 1 :])]
            # a paragraph without a shingle has no band: it can only be equal to others
            banded = counts[taken] >= WIDTH
            keys = minhash.band_keys(own, _offsets(counts[taken][banded] - WIDTH + 1), bands, rows)
            per_taken = np.bincount(doc_of[taken], minlength=len(per_doc))

            sizes = np.add.reduceat(counts, heads) if len(heads) else counts
            places, hashes = pieces_of(shingles, sizes)
            doc_of_piece = np.searchsorted(np.cumsum(sizes), places, side="right")
            per_piece = np.bincount(doc_of_piece, minlength=len(per_doc))
            columns = [
                _lists(pa.array(starts, pa.int64()), per_taken),
                _lists(pa.array(lengths, pa.int64()), per_taken),
                _lists(pa.array(first, pa.int32()), per_taken),
                _lists(pa.array(counts[taken], pa.int32()), per_taken),
                _lists(pa.array(_digests(words.filter(pa.array(mine)), counts[taken]), pa.binary()), per_taken),
                _lists(_lists(pa.array(keys.ravel()), np.where(banded, bands, 0)), per_taken),
                _lists(pa.array(hashes), per_piece),
                _lists(pa.array(places - _offsets(sizes)[doc_of_piece], pa.int32()), per_piece),
            ]
            found = pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *LISTS, "pieces", "places"])
            yield found.filter(pa.array((per_taken > 0) | (per_piece > 0)))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, spans of paragraphs [start, start + length)) to the digest of each paragraph and its set of shingles."""
    for batch in batches:
        rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
        words, counts = words_of(pa.array([t[s["start"] : s["start"] + s["length"]] for t, spans in rows for s in spans], pa.string()))
        shingles, at = shingles_of(words), _offsets(counts)
        sets = [np.unique(shingles[i : i + max(0, n - WIDTH + 1)]).view(np.int64) for i, n in zip(at, counts, strict=True)]
        columns = [pa.array(_digests(words, counts), pa.binary()), pa.array(sets, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["node", "body"])


def _cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (doc_id, text, islands) each island [a, b) of words with its digest, and on both sides 32 bits of each word and its offset."""
    hashed = xxhash.xxh32_intdigest
    names = [c.strip().split()[0] for c in CUT.split(",")]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), *[pa.list_(pa.int32())] * 4]
    for batch in batches:
        for doc_id, text, islands in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            low = text.encode("utf-8", "replace").lower().decode()
            at = [m.span() for m in _WORD.finditer(low)]
            found = []
            for island in islands:
                a, b = island["a"], island["b"]
                if b > len(at):
                    continue
                words = [low[x:y] for x, y in at[max(0, a - REACH) : b + REACH]]
                left = min(a, REACH)
                middle = " ".join(words[left : left + b - a])
                before, after = ([hashed(w) - (1 << 31) for w in x] for x in (words[:left][::-1], words[left + b - a :]))
                starts = [at[i][0] for i in range(a, a - left - 1, -1)]
                ends = [at[i][1] for i in range(b - 1, b + len(after))]
                of = (doc_id, a, b, island["keep_id"], island["keep_a"], island["n"])
                found.append((*of, xxhash.xxh3_128_digest(middle), before, after, starts, ends))
            if found:
                columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names)


def _common(x: str, y: str) -> Column:
    """The number of first elements in which two arrays agree."""
    same = F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False)))
    return F.when(F.array_position(same, False) > 0, F.array_position(same, False) - 1).otherwise(F.size(same)).cast("int")


def _same(x: DataFrame, y: DataFrame, **columns: str) -> Column:
    """The condition that columns of x are those of y, nulls included."""
    condition = F.lit(True)
    for mine, other in columns.items():
        condition = condition & x[mine].eqNullSafe(y[other])
    return condition


def repeated_passages(named: DataFrame, rows: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Columns ``RESULT`` for passages of which an earlier document has the same and that lie in no removed paragraph."""
    pieces = rows.select("doc_id", F.inline(F.arrays_zip("pieces", "places"))).toDF("doc_id", "piece", "at")
    counts = pieces.groupBy("piece").agg(
        F.min("doc_id").alias("least"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("with_id")
    )
    several = (F.col("least") < F.col("last")) | ((F.col("with_id") > 0) & (F.col("with_id") < F.col("n")))
    shared = saved(counts.filter(several).select("piece", "n"))
    hits = saved(pieces.join(small(shared), "piece"))
    keep = hits.groupBy("piece").agg(F.min(F.struct("doc_id", "at")).alias("keep"))
    hits = hits.join(keep, "piece").filter(~F.col("doc_id").eqNullSafe(F.col("keep.doc_id")))
    hits = hits.select("doc_id", "at", F.col("keep.doc_id").alias("keep_id"), (F.col("keep.at") - F.col("at")).alias("shift"), "n")
    order = Window.partitionBy("doc_id", "keep_id", "shift").orderBy("at")
    apart = F.col("at") > F.coalesce(F.lag("at").over(order), F.lit(-1 - PIECE_WORDS)) + PIECE_WORDS
    numbered = hits.withColumn("apart", apart.cast("int")).withColumn("island", F.sum("apart").over(order))
    islands = numbered.groupBy("doc_id", "keep_id", "shift", "island").agg(
        F.min("at").alias("a"), (F.max("at") + PIECE_WORDS).alias("b"), F.max("n").alias("n")
    )
    removed = paragraphs.groupBy("doc_id").agg(F.collect_list(F.struct("first_word", "n_words")).alias("removed"))
    inside = F.expr("exists(removed, x -> x.first_word <= i.a and i.b <= x.first_word + x.n_words)")
    islands = islands.withColumn("keep_a", F.col("a") + F.col("shift")).drop("shift", "island").alias("i")
    islands = islands.join(removed.alias("r"), F.expr("i.doc_id <=> r.doc_id"), "left")
    islands = saved(islands.filter(~F.coalesce(inside, F.lit(False))).select("i.*"))
    kept = islands.select("keep_id", "keep_a", (F.col("keep_a") + F.col("b") - F.col("a")).alias("keep_b")).distinct()
    nothing = [F.lit(None).cast("long").alias("keep_id"), F.lit(None).cast("int").alias("keep_a"), F.lit(None).cast("long").alias("n")]
    asked = islands.select("doc_id", "a", "b", "keep_id", "keep_a", "n").unionByName(
        kept.select(F.col("keep_id").alias("doc_id"), F.col("keep_a").alias("a"), F.col("keep_b").alias("b"), *nothing)
    )
    asked = saved(asked.groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct("a", "b", "keep_id", "keep_a", "n")).alias("islands")))
    ids = asked.select("id")
    texts = named.join(small(ids), _same(named, ids, doc_id="id"), "left_semi")
    cuts = texts.join(asked, F.expr("doc_id <=> id")).select("doc_id", "text", "islands").mapInArrow(_cuts, CUT)
    cuts = written(cuts, "cuts")
    other = cuts.filter("keep_a is null").drop("keep_id", "keep_a", "n", "ends").alias("o")
    both = cuts.filter("keep_a is not null").alias("i").join(
        other, F.expr("i.keep_id <=> o.doc_id and i.keep_a = o.a and i.b - i.a = o.b - o.a and i.digest = o.digest")
    )
    grown = both.withColumns({"left": _common("i.before", "o.before"), "right": _common("i.after", "o.after")})
    start = F.get("i.starts", F.col("left"))
    return grown.select(
        F.col("i.doc_id").alias("doc_id"),
        F.lit("passage").alias("kind"),
        start.cast("long").alias("start"),
        (F.get("i.ends", F.col("right")) - start).cast("long").alias("length"),
        (F.col("i.a") - F.col("left")).alias("first_word"),
        (F.col("i.b") - F.col("i.a") + F.col("left") + F.col("right")).alias("n_words"),
        F.col("i.keep_id").alias("keep_doc_id"),
        F.get("o.starts", F.col("left")).cast("long").alias("keep_start"),
        F.col("i.n").alias("group_size"),
    )


def _texts(named: DataFrame, nodes: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A function from paragraphs (node: the digest) to their shingles, by the first document that has them."""

    def texts(ids: DataFrame) -> DataFrame:
        wanted = ids.withColumnRenamed("node", "digest").join(nodes, "digest").select("first.*")
        wanted = wanted.groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct("start", "length")).alias("spans"))
        wanted = saved(wanted)
        found = named.join(small(wanted, F.size("spans")), _same(named, wanted, doc_id="id")).select("text", "spans")
        return saved(found.mapInArrow(_sets, "node binary, body array<long>").dropDuplicates(["node"]))

    return texts


def repeated_paragraphs(named: DataFrame, rows: DataFrame) -> DataFrame:
    """Columns ``RESULT`` for paragraphs that are equal or similar to an earlier one."""
    parts = rows.select("doc_id", F.inline(F.arrays_zip(*LISTS)))
    parts = parts.toDF("doc_id", "start", "length", "first_word", "n_words", "digest", "bands")
    first = F.min(F.struct("doc_id", "start", "length")).alias("first")
    nodes = parts.groupBy("digest").agg(first, F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands"))
    nodes = written(nodes, "nodes")
    met = minhash.meetings(nodes.select(F.col("digest").alias("node"), F.lit(0).alias("sign"), "bands"))
    nodes = nodes.drop("bands")
    texts = _texts(named, nodes)
    groups = bucket_components(met, texts=texts, alike=alike, across=lambda mixed: links_across(mixed, texts, alike, SIMILARITY))
    groups = saved(groups).withColumnRenamed("node", "digest")
    linked = nodes.join(groups, "digest", "left").withColumn("group", F.coalesce("component", "digest"))
    linked = linked.filter(F.col("component").isNotNull() | (F.col("n") > 1))
    heads = linked.groupBy("group").agg(
        F.min(F.struct("first.doc_id", "first.start")).alias("keep"), F.sum("n").alias("group_size")
    )
    of_node = saved(linked.select("digest", "group").join(heads, "group").select("digest", "keep", "group_size"))
    repeats = parts.drop("bands").join(small(of_node), "digest")
    repeats = repeats.filter(~F.struct("doc_id", "start").eqNullSafe(F.col("keep"))).withColumn("kind", F.lit("paragraph"))
    return repeats.withColumns({"keep_doc_id": F.col("keep.doc_id"), "keep_start": F.col("keep.start")}).select(*RESULT)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row a removed span: doc_id, kind (paragraph or passage), start, length (in code points), first_word,
    n_words (in the document's words), keep_doc_id, keep_start (of what stays), group_size.

    Paragraphs end at line feeds; those of fewer than ``min_words`` words are lines and are removed only as part of a
    passage. With ``min_words=1`` every line with a word is a paragraph: those of fewer than five words are compared whole.
    Words are compared with A-Z in lower case
    and any ASCII white space as one space. Of each group the paragraph of the smallest doc_id, and the
    first in it, stays. Every run of ``RUN`` words or more that an earlier document has too is found,
    wherever its line ends are; up to ``REACH`` words at its ends may stay if only a later one of its
    documents has them. Shorter runs are found where a piece falls into them. Passages that lie in a
    removed paragraph are not listed; spans may overlap otherwise. Documents without repeats have no row,
    and null texts have no words. Rows without doc_id are documents of their own, which come before others. Rows that repeat an id are one document.
    """
    named = with_ids(only(docs, doc_id=F.col(id_col).cast("long"), text=text_of(text_col)))
    rows = written(named.mapInArrow(partial(_documents, min_words), DOCUMENT), "paragraphs")
    whole = saved(repeated_paragraphs(named, rows).distinct())
    found = whole.unionByName(repeated_passages(named, rows, whole).distinct())
    own = lambda c: F.when(F.col(c) > LAST_NO_ID, F.col(c)).alias(c)
    return found.select(*(own(c) if c.endswith("doc_id") else F.col(c) for c in RESULT))


def with_ids(named: DataFrame) -> DataFrame:
    """The rows (doc_id, text), those without doc_id with one of the numbers that stand for none; they are written so that each keeps its own."""
    without = named.filter("doc_id is null")
    if without.isEmpty():
        return named
    own = (F.lit(NO_ID) + F.monotonically_increasing_id()).alias("doc_id")
    return named.filter("doc_id is not null").unionByName(written(without.select(own, "text"), "without-ids"))
