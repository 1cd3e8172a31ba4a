"""The registered queries on the given tables, against SQL or a brute-force version."""

import bisect
import collections
import hashlib
import html
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from corvane.llm import mixing, order_minhash, packing, paragraph_dedup, simhash, toxicity
from corvane.llm.common import saved
from corvane.llm.queries import tokenizer_path

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def query(spark, name, sf_dir):
    return entry.queries()[name](spark, sf_dir).toPandas()


def documents(sf_dir):
    return duckdb.sql(f"SELECT doc_id, text, source FROM '{sf_dir}/documents.parquet' ORDER BY doc_id").fetchall()


class Groups:
    """Disjoint sets; a group's name is its least member."""

    def __init__(self, n):
        self.parent = list(range(n))

    def find(self, a):
        while self.parent[a] != a:
            self.parent[a] = self.parent[self.parent[a]]
            a = self.parent[a]
        return a

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


@pytest.mark.parametrize("name", ["op8_warc", "op9_exact_dedup", "op10_line_dedup"])
def test_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "pages"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{MIDDLE}/{table}.parquet'")
    got = entry.queries()[name](spark, MIDDLE)
    want = db.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    key = lambda row: tuple((x is None, x) for x in row)
    assert sorted(map(tuple, got.select(columns).collect()), key=key) == sorted(want.fetchall(), key=key)


def spark_hash(*values):
    """Spark's xxhash64 of strings, longs and 32-bit integers; nulls are passed over."""
    h = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else int(v).to_bytes(4 if isinstance(v, np.int32) else 8, "little", signed=True)
        h = xxhash.xxh64_intdigest(data, h)
    return h


def order_minhash_of(text):
    words = re.split(r"[\x20\x09-\x0D]+", text.strip(" \t\n\x0b\f\r"))
    mask, seen, kmers = (1 << order_minhash.HASH_BITS) - 1, collections.Counter(), []
    for i in range(max(len(words) - order_minhash.K, 0) + 1):
        h = spark_hash(*words[i : i + order_minhash.K]) & mask
        kmers.append((h if not seen[h] else spark_hash(h, np.int32(seen[h])) & mask, i))
        seen[h] += 1
    out = []
    turns = order_minhash.PERMUTATIONS // order_minhash.ORDERS
    for factor in order_minhash.FACTORS:
        own = sorted(((k * factor) & mask, i) for k, i in kmers)
        for b in range(turns):
            at = bisect.bisect_left(own, (b * ((mask + 1) // turns), 0))
            least = (own[at:] + own[:at])[: order_minhash.TUPLE]
            chosen = sorted(least, key=lambda k: (k[1], k[0]))
            out.append(f"{spark_hash(*(k[0] for k in chosen)):016x}"[8:])
    return out


def test_order_minhash(spark):
    rows = documents(SMALL)
    got = query(spark, "op1_order_minhash", SMALL).set_index("doc_id")
    texts = [t for _, t, _ in rows]
    prints = {}
    for i, (doc_id, text, _) in enumerate(rows):
        half = len(text) // 2
        edited = text[: len(text) - half] + texts[(i + 1) % len(texts)][:half]
        row = got.loc[doc_id]
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        prints[i], other = order_minhash_of(text), order_minhash_of(edited)
        assert row.fingerprint == "".join(prints[i])
        assert row.edited_fingerprint == "".join(other)
        assert row.near_edited == sum(a == b for a, b in zip(prints[i], other, strict=True)) / len(other)
    for i, doc_id in enumerate(r[0] for r in rows):
        same = sum(a == b for a, b in zip(prints[i], prints[(i + 1) % len(rows)], strict=True))
        assert got.loc[doc_id].near_next == same / len(prints[i])
    assert got.near_edited.mean() > 0.05 > got.near_next.mean()


@pytest.mark.parametrize(("sf_dir", "min_words"), [(MIDDLE, paragraph_dedup.MIN_WORDS), (SMALL, 1)])
def test_paragraphs(spark, sf_dir, min_words):
    texts = {i: t for i, t, _ in documents(sf_dir)}
    rows, at = [], {}
    for i, text in texts.items():
        start = 0
        for part in text.split("\n"):
            if len(words := part.encode().lower().split()) >= min_words:
                rows.append((i, start, b" ".join(words)))
                at[i, start] = len(part)
            start += len(part) + 1
    distinct = list(dict.fromkeys(r[2] for r in rows))
    number, groups = {t: i for i, t in enumerate(distinct)}, Groups(len(distinct))
    sets, holders = [], collections.defaultdict(list)
    for i, text in enumerate(distinct):
        words = text.split()
        sets.append({tuple(words[a : a + 5]) for a in range(len(words) - 4)})
        for shingle in sets[-1]:
            holders[shingle].append(i)
    for a, b in {(a, b) for v in holders.values() for a in v for b in v if a < b}:
        shared = len(sets[a] & sets[b])
        if shared >= 0.8 * (len(sets[a]) + len(sets[b]) - shared):
            groups.join(a, b)
    members = collections.defaultdict(list)
    for i, start, text in rows:
        members[groups.find(number[text])].append((i, start))
    want = {(*m, at[m], *min(v), len(v)) for v in members.values() for m in v if m != min(v)}
    if min_words == paragraph_dedup.MIN_WORDS:
        got = query(spark, "op2_paragraph_dedup", sf_dir)
    else:
        got = paragraph_dedup.repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), min_words=min_words).toPandas()
    whole = got[got.kind == "paragraph"]
    assert set(zip(whole.doc_id, whole.start, whole.length, whole.keep_doc_id, whole.keep_start, whole.group_size, strict=True)) == want

    words = {i: t.encode().lower().split() for i, t in texts.items()}
    covered = collections.defaultdict(set)
    for r in got.itertuples():
        span = texts[r.doc_id][r.start : r.start + r.length].encode().lower().split()
        assert span == words[r.doc_id][r.first_word : r.first_word + r.n_words]
        covered[r.doc_id].update(range(r.first_word, r.first_word + r.n_words))
        if r.kind == "passage":
            # the passage is in the document that keeps it, which comes before, and grows no further unless it has done so far
            assert r.keep_doc_id < r.doc_id
            kept = texts[r.keep_doc_id][r.keep_start :].encode().lower().split()
            assert kept[: r.n_words] == span
    # every run of words that an earlier document has too, over line ends or not, is removed
    first, missed, total = {}, set(), 0
    for i in sorted(words):
        for a in range(len(words[i]) - paragraph_dedup.RUN + 1):
            run = b" ".join(words[i][a : a + paragraph_dedup.RUN])
            if first.setdefault(run, i) != i:
                total += 1
                here = sum(x in covered[i] for x in range(a, a + paragraph_dedup.RUN))
                assert here >= paragraph_dedup.PIECE_WORDS
                missed |= {(i, x) for x in range(a, a + paragraph_dedup.RUN) if x not in covered[i]}
    assert total > 1000 or sf_dir == SMALL
    assert len(missed) <= 0.01 * total


def test_bands_have_the_recall():
    bands, rows = paragraph_dedup.tuned_bands()
    assert 1 - (1 - paragraph_dedup.SIMILARITY**rows) ** bands >= paragraph_dedup.RECALL


def test_mixing(spark):
    got = query(spark, "op3_mixing", MIDDLE).merge(
        duckdb.sql(f"SELECT doc_id, text FROM '{MIDDLE}/documents.parquet'").df(), on="doc_id"
    )
    assert (got["size"] == got.text.map(lambda t: len(t.encode().split()))).all()
    sizes = got.groupby("source")["size"].sum().sort_index()
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sizes.index)}
    capped = set()
    while True:
        left = 1.5 * sizes.sum() - sum(2 * sizes[s] for s in capped)
        share = left / sum(w for s, w in weights.items() if s not in capped)
        more = {s for s in weights if s not in capped and share * weights[s] > 2 * sizes[s]}
        if not more:
            break
        capped |= more
    for s, rows in got.groupby("source"):
        want = 2 * sizes[s] if s in capped else share * weights[s]
        assert (rows.source_size == sizes[s]).all()
        assert rows.target.iloc[0] == pytest.approx(want)
        assert 0 <= want - rows.taken.sum() < 1
    assert (got.taken <= 2 * got["size"]).all()
    again = query(spark, "op3_mixing", MIDDLE)
    assert dict(zip(again.doc_id, again.taken, strict=True)) == dict(zip(got.doc_id, got.taken, strict=True))


def test_toxicity(spark):
    got = query(spark, "op4_toxicity", "/root/testdata/sf0.1")
    labels = duckdb.sql("SELECT doc_id, toxic FROM '/root/testdata/sf0.1/labels.parquet'").df()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    assert got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= toxicity.REJECT)).all()
    held = got[got.held_out].merge(labels, on="doc_id")
    clean, toxic = held[held.toxic == 0], held[held.toxic == 1]
    assert (clean.predicted == 0).mean() > 0.99
    assert (toxic.predicted == 1).mean() > 0.75
    assert (toxic.score.to_numpy()[:, None] > clean.score.to_numpy()).mean() > 0.9


def test_packing(spark):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    got = query(spark, "op5_packing", SMALL)
    pieces = collections.defaultdict(list)
    for r in got.itertuples():
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for doc_id, text, _ in documents(SMALL):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for start, length, crc, total in sorted(pieces.pop(doc_id)):
            assert (start, total, crc) == (at, len(ids), zlib.crc32(ids[start : start + length].tobytes()))
            at += length
        assert at == len(ids)
    assert not pieces
    whole = query(spark, "op5_packing", MIDDLE).sort_values(["sequence_id", "offset"])
    lengths = whole.groupby("sequence_id").length
    assert (whole.offset == lengths.cumsum() - whole.length).all()
    assert lengths.sum().max() <= 2048
    assert whole.length.sum() / (2048 * whole.sequence_id.nunique()) > 0.98


@pytest.mark.parametrize("sizes", [[], [2048], [2048, 1], [1], [700] * 30, list(range(1, 257))])
def test_windows(sizes):
    sizes = np.array(sizes, dtype=np.int64)
    window = packing.windows_of(sizes, 2048)
    assert len(window) == len(sizes)
    assert (window >= 0).all()
    assert np.bincount(window, weights=sizes, minlength=1).max(initial=0) <= 2048


def test_pages(spark):
    got = query(spark, "op6_html_text", MIDDLE).set_index("page_id")
    for page_id, url, page in duckdb.sql(f"SELECT * FROM '{MIDDLE}/pages.parquet'").fetchall():
        article = re.search(r"<article>(.*)</article>", page, re.DOTALL)[1]
        blocks = (" ".join(html.unescape(re.sub("<(br|/?b)>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", article))
        row = got.loc[page_id]
        assert (row.url, row.text) == (url, "\n\n".join(b for b in blocks if b))
        assert row.n_chars == len(row.text)


def simhash_of(text, width):
    words = text.encode().lower().split()
    if not words:
        return 0
    runs = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark):
    rows = documents(MIDDLE)
    prints = [simhash_of(t, 4) for _, t, _ in rows]
    distinct, groups = np.array(prints, dtype=np.uint64), Groups(len(rows))
    for i in range(len(rows)):
        for j in np.nonzero(np.bitwise_count(distinct[i + 1 :] ^ distinct[i]) <= 4)[0]:
            groups.join(i, i + 1 + int(j))
    want = {(r[0], f"{p:016x}", rows[groups.find(i)][0]) for i, (r, p) in enumerate(zip(rows, prints, strict=True))}
    assert set(entry.queries()["op7_simhash"](spark, MIDDLE).collect()) == want


def test_similar_documents(spark):
    rows = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    base = [r.text.split() for r in rows.filter("length(text) between 1500 and 4000").limit(40).collect()]
    made, rng = [], np.random.default_rng(3)
    for n, words in enumerate(base):
        for copy in range(4):
            edited = list(words)
            for at in rng.choice(len(words), len(words) * copy // 150, replace=False):
                edited[at] = f"changed{at}x{copy}"
            made.append((1000 * n + copy, " ".join(edited)))
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for _, t in made]
    groups = Groups(len(made))
    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if shared >= 0.8 * (len(a) + len(sets[j]) - shared):
                groups.join(j, i)
    want = {made[i][0]: made[groups.find(i)][0] for i in range(len(made))}
    frame = spark.createDataFrame(made, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(frame).collect()}
    assert sum(got[i] == want[i] for i in want) >= 0.95 * len(want)
    assert all(got[i] // 1000 == i // 1000 or got[i] == want[i] for i in got)
    kept = {r.doc_id for r in simhash.representatives(frame).collect()}
    assert kept == set(got.values())


def brute_force_groups(made):
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for _, t in made]
    groups = Groups(len(made))
    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if shared >= 0.8 * (len(a) + len(sets[j]) - shared):
                groups.join(j, i)
    return {made[i][0]: made[groups.find(i)][0] for i in range(len(made))}


def similar_groups(spark, made):
    frame = spark.createDataFrame(made, "doc_id long, text string")
    return {r.doc_id: r.component_id for r in simhash.similar_documents(frame).collect()}


def test_near_copies_among_texts_of_the_same_words(spark):
    """The signs of words of all these texts are equal, but only pairs of them are near copies."""
    rng, made = np.random.default_rng(7), []
    for n in range(60):
        words = [f"w{x}" for x in rng.permutation(300)]
        made += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(words[1:] + words[:1]))]
    want = brute_force_groups(made)
    assert want == {i: i - i % 2 for i in range(120)}
    assert similar_groups(spark, made) == want


def test_near_copies_that_differ_in_a_block(spark):
    rng, made = np.random.default_rng(5), []
    for n in range(60):
        words, other = ([f"w{x}" for x in rng.integers(0, 30_000, 400)] for _ in range(2))
        at, size = int(rng.integers(0, 300)), int(rng.integers(20, 80))
        added, removed = words[:at] + other[:size] + words[at:], words[:at] + words[at + size :]
        replaced = words[:at] + other[: size // 2] + words[at + size // 2 :]
        made += [(10 * n + i, " ".join(x)) for i, x in enumerate((words, added, removed, replaced))]
    assert similar_groups(spark, made) == brute_force_groups(made)


def test_pipeline(spark):
    """What each stage keeps of what it is given, and the rows of the whole."""
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    given, kept = docs.toPandas(), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = saved(stage(spark, docs, MIDDLE))
        kept[name] = docs.toPandas()
        assert list(kept[name].columns) == list(given.columns)
    ids = {name: set(x.doc_id) for name, x in kept.items()}
    labels = duckdb.sql(f"SELECT doc_id, toxic FROM '{MIDDLE}/labels.parquet'").df()
    toxic, clean = set(labels[labels.toxic == 1].doc_id), set(labels[labels.toxic == 0].doc_id)
    assert len(toxic & ids["toxicity"]) < 0.5 * len(toxic)
    assert len(clean & ids["toxicity"]) > 0.98 * len(clean)
    bare = lambda frame: frame.text.fillna("").map(lambda t: "".join(t.encode().decode("utf-8").split()))
    before = kept["toxicity"].assign(bare=bare(kept["toxicity"]), n=kept["toxicity"].text.fillna("").str.len())
    best = before.sort_values(["n", "doc_id"], ascending=[False, True]).drop_duplicates("bare")
    assert ids["exact_dedup"] == set(best.doc_id)
    rows = kept["exact_dedup"].sort_values("doc_id")
    made = list(zip(rows.doc_id, rows.text.fillna(""), strict=True))
    sets, holders, groups = [set(simhash.shingle_hashes(t, 5).tolist()) for _, t in made], collections.defaultdict(list), Groups(len(made))
    for i, s in enumerate(sets):
        for shingle in s or {0}:
            holders[shingle].append(i)
    for a, b in {(a, b) for v in holders.values() for a in v for b in v if a < b}:
        shared = len(sets[a] & sets[b])
        if shared >= 0.8 * (len(sets[a]) + len(sets[b]) - shared):
            groups.join(a, b)
    assert ids["simhash"] == {made[groups.find(i)][0] for i in range(len(made))}
    mix = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(kept["simhash"])).collect() if r.copies}
    assert collections.Counter(kept["mixing"].doc_id.tolist()) == mix
    got = query(spark, "pipeline", MIDDLE)
    assert got.groupby("sequence_id").length.sum().max() <= 2048
    whole = got[got.start == 0].doc_id.tolist()
    assert collections.Counter(whole) == mix
    assert got.groupby("doc_id").length.sum().to_dict() == {r.doc_id: r.doc_tokens * mix[r.doc_id] for r in got.itertuples()}


def test_ranges_of_the_mix(spark):
    """A twentieth of the rows of low quality does not fill one range."""
    rows = [(i, "9 8 7 6 % $ # @ !" if i % 20 == 0 else "plain words of a usual text here", "s") for i in range(60_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    keys = mixing.sampled(frame)
    sizes = keys.repartitionByRange(12, "source", "key", "doc_id").groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert sizes.max() < 2 * 60_000 / 12
    got = mixing.mix(frame).agg(F.sum("taken"), F.first("target")).first()
    assert 0 <= got[1] - got[0] < 1
