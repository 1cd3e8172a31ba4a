"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import html
import math
import re
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from corvane.llm import exact_dedup, html_text, line_dedup, mixing, order_minhash, packing, paragraph_dedup, simhash, toxicity, warc
from corvane.llm.queries import tokenizer_path

MIDDLE = "/root/testdata/sf0.01"
DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use for columns of their own
        T.StructField("h", T.StringType()),
        T.StructField("size", T.StringType()),
        T.StructField("bucket", T.StringType()),
        T.StructField("features", T.StringType()),
        T.StructField("digest", T.StringType()),
        T.StructField("node", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("prediction", T.StringType()),
    ]
)
LONG = "one two three four five six seven eight nine ten " * 30_000
PASSAGE = " ".join(f"word{i}" for i in range(60))
ROWS = [
    (1, "a b c d e f g", "en", "x", 13),
    (2, "a b c  d e f g", "en", "x", None),
    (2, "a b c  d e f g", "en", "x", None),
    (3, None, None, None, None),
    (4, "", "", "", 0),
    (5, " \t\n", "en", None, 3),
    (6, LONG, "en", "y", None),
    (7, "Ünïcödé 中文 😀", "de", "y", None),
    (8, f"first\n{PASSAGE}\nlast", "en", "y", None),
    (9, f"{PASSAGE}\nother", "en", None, None),
    (None, "no id here", "en", "x", None),
    (None, None, None, None, None),
    (5, "another text of the same id", "en", "x", None),
]


def docs(spark, rows=ROWS):
    return spark.createDataFrame([(*r, *["?"] * 8) for r in rows], DOCS).repartition(3)


OPERATORS = {
    "order_minhash": order_minhash.fingerprints_of_edits,
    "mixing": mixing.mix,
    "packing": lambda d: packing.pack(d, tokenizer_path()),
    "simhash": simhash.near_duplicates,
    "similar": simhash.similar_documents,
    "exact_dedup": exact_dedup.exact_dedup,
    "toxicity": lambda d: toxicity.score(d, toxicity.Model(0.25, {})),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_a_result(spark, name):
    got = OPERATORS[name](docs(spark))
    ids = got.select("doc_id").distinct().collect() if name == "packing" else got.select("doc_id").collect()
    want = [r[0] for r in ROWS]
    want = set(want) if name == "packing" else want
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in ids) == sorted((i is None, i or 0) for i in want)


@pytest.mark.parametrize("name", [*OPERATORS, "paragraph_dedup"])
def test_empty_table(spark, name):
    operator = OPERATORS.get(name, paragraph_dedup.repeats)
    assert operator(docs(spark, [])).collect() == []


@pytest.mark.parametrize("stage", [f for name, f in corpus_pipeline.STAGES if name not in ("toxicity", "packing")])
def test_stages_keep_the_columns(spark, stage):
    got = stage(spark, docs(spark), "")
    assert got.columns == DOCS.fieldNames()
    got.collect()
    assert stage(spark, docs(spark, []), "").collect() == []


def fitted(spark):
    texts = [(i, f"you are a fool and an idiot {i} " * 3 if i % 2 else f"a calm sentence of number {i} " * 3) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in texts], "doc_id long, toxic int")
    return toxicity.fit(spark.createDataFrame(texts, "doc_id long, text string"), labels)


def test_fitted_toxicity_of_edges(spark):
    model = fitted(spark)
    assert model.trees is not None
    got = toxicity.score(docs(spark), model).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in ROWS)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= toxicity.REJECT) for r in got)
    assert len({r.score for r in got if r.doc_id in (3, 4)}) == 1
    assert toxicity.score(docs(spark, []), model).collect() == []
    both = spark.createDataFrame([(1, "you fool, you idiot"), (2, "a calm sentence")], "doc_id long, text string")
    assert {r.doc_id: r.predicted for r in toxicity.score(both, model).collect()} == {1: 1, 2: 0}
    assert toxicity.accepted(docs(spark), model).columns == DOCS.fieldNames()


def features_plainly(text, lexicon):
    """The features of a text by counting, word by word and letter by letter."""
    words = [w.strip(toxicity._EDGES) for w in text.lower().split()]
    n, chars = max(1, len(words)), max(1, len(text.encode()))
    hits = [i for i, w in enumerate(words) if w in lexicon]
    you = [i for i, w in enumerate(words) if w in toxicity.SECOND_PERSON]
    odd = []
    for w in text.split():
        inner = [i for i, c in enumerate(w) if c in "0123456789@$!|*"]
        runs = [i for i in inner if i - 1 not in inner]
        if any(i > 0 and w[i - 1].isalpha() and w[i:].lstrip("0123456789@$!|*")[:1].isalpha() for i in runs):
            odd.append(w.lower().strip(toxicity._EDGES))
    return [
        len(hits) / n,
        sum(lexicon[words[i]] for i in hits) / n,
        math.log1p(len(hits)),
        len({words[i] for i in hits}),
        sum(any(abs(i - j) <= toxicity.NEAR for j in you) for i in hits) / n,
        len(you) / n,
        sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in text) / chars,
        sum(w.isupper() and len(w) > 2 for w in text.split()) / n,
        (text.count("!") + text.count("?")) / n,
        sum(c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" for c in text) / chars,
        len(odd) / n,
        sum("".join(dict(zip("0134578@$!|", "oieastbasil", strict=True)).get(c, c) for c in w) in lexicon for w in odd) / n,
        math.log1p(len(words)),
    ]


@pytest.mark.parametrize("text", ["", " \n", "You FOOL, y0u id1ot!! why? a1 1a b@d|y", "x " * 50 + "you are. not a fool", "Ünï ÉÉÉ! 😀 fool fool", "a*b c$ $d e!!f"])
def test_features(text):
    lexicon = {"fool": 2.0, "idiot": 3.5, "bad": 1.0}
    assert toxicity.features_of(text, lexicon) == pytest.approx(features_plainly(text, lexicon))


def test_names_that_operators_use(spark):
    """Columns of the input by the names that operators use for their own are returned as they are."""
    own = ["row", "own", "node", "stays", "first_id", "bare", "chars", "id", "no_id", "digest", "check", "copies", "again", "text_hash", "features", "p", "prediction", "toxicity", "_id"]
    rows = [(i, t, "en", s, *[f"{c}{i}" for c in own]) for i, t, s in ((1, "some words", "x"), (2, "other words here", "y"), (None, "third", None))]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in own))
    for name, result in {
        "exact": exact_dedup.deduplicated(frame),
        "near": simhash.representatives(frame),
        "toxic": toxicity.accepted(frame, fitted(spark)),
    }.items():
        assert result.columns == frame.columns, name
        assert {tuple(r) for r in result.collect()} == set(rows), name
    got = mixing.mixed(frame)
    assert got.columns == frame.columns
    assert {tuple(r) for r in got.collect()} <= set(rows)


def test_largest_id(spark):
    last = (1 << 63) - 1
    frame = spark.createDataFrame([(last, "a text"), (None, "another text"), (1, "a text")], "doc_id long, text string")
    assert {r.doc_id for r in order_minhash.fingerprints_of_edits(frame).collect()} == {last, None, 1}
    assert {(r.doc_id, r.keep_id) for r in exact_dedup.exact_dedup(frame).collect()} == {(last, 1), (None, None), (1, 1)}
    assert {(r.doc_id, r.component_id) for r in simhash.similar_documents(frame).collect()} == {(last, 1), (None, None), (1, 1)}


def test_toxicity_stage(spark):
    model = toxicity.fit(docs(spark), spark.createDataFrame([(1, 1), (2, None), (None, 1)], "doc_id long, toxic int"))
    assert model.trees is None
    assert toxicity.accepted(docs(spark), toxicity.Model(0.25, {})).columns == DOCS.fieldNames()
    assert toxicity.accepted(docs(spark), toxicity.Model(0.25, {})).count() == len(ROWS)


def test_exact_dedup_rules(spark):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs(spark)).collect()}
    assert (1, 2, 3, False) in got  # the longer text stays
    assert (2, 2, 3, True) in got
    # null, empty and blank texts are equal: the blank one is the longest
    assert {(3, 5, 4, False), (4, 5, 4, False), (None, 5, 4, False), (5, 5, 4, True)} <= got
    kept = exact_dedup.deduplicated(docs(spark))
    assert kept.count() == len({("".join((r[1] or "").split())) for r in ROWS})


def test_ties_go_to_the_smallest_id(spark):
    got = exact_dedup.exact_dedup(docs(spark, [(i, "same text", "en", "x", None) for i in (5, 3, 9)])).collect()
    assert {r.keep_id for r in got} == {3}


def test_paragraph_in_two_documents(spark):
    got = paragraph_dedup.repeats(docs(spark)).collect()
    assert [(r.doc_id, r.kind, r.start, r.n_words, r.keep_doc_id, r.keep_start, r.group_size) for r in got] == [(9, "paragraph", 0, 60, 8, 6, 2)]


def test_equal_paragraphs_of_documents_without_id(spark):
    rows = [(None, PASSAGE, "en", "x", 1), (None, PASSAGE, "en", "x", 1), (None, None, None, None, None), (4, f"more\n{PASSAGE}", "en", "x", 1)]
    got = paragraph_dedup.repeats(docs(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.start, r.n_words, r.keep_doc_id, r.keep_start, r.group_size) for r in got) == [(0, 0, 60, None, 0, 3), (4, 5, 60, None, 0, 3)]
    one = paragraph_dedup.repeats(docs(spark, rows[:1])).collect()
    assert one == []


def test_many_equal_rows_are_packed_in_several_groups(spark):
    n = 150_000
    rows = spark.range(n).selectExpr("CAST(NULL AS long) AS doc_id", "'a' AS text")
    got = packing.pack(rows, tokenizer_path())
    groups = got.groupBy(F.shiftright("sequence_id", 24).alias("part")).count().collect()
    assert len(groups) == -(-n // packing.GROUP_PIECES) and max(r["count"] for r in groups) < 1.1 * packing.GROUP_PIECES
    per_window = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count(F.lit(1)).alias("pieces")).collect()
    assert sum(r.n for r in per_window) == 2 * n and max(r.n for r in per_window) <= packing.CAPACITY


@pytest.mark.parametrize("parts", [1, 7, 20])
def test_shards_of_digests(spark, monkeypatch, parts):
    """Shards of a few rows in many runs give the groups that a plain grouping gives."""
    monkeypatch.setattr(exact_dedup, "SHARD_ROWS", 5)
    rows = [(i, f" t e x t {i % 37 * (i % 3)}" + " " * (i % 4), None) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, more map<string,int>").repartition(parts)
    groups = {}
    for i, text, _ in rows:
        groups.setdefault("".join(text.split()), []).append((-len(text), i))
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs).collect()}
    assert got == {i: (min(g)[1], len(g)) for g in groups.values() for _, i in g}
    assert sorted(r.doc_id for r in exact_dedup.deduplicated(docs).collect()) == sorted(min(g)[1] for g in groups.values())


def test_ties_of_exact_copies_are_settled(spark):
    rows = [(1, "a b", "x"), (1, "a b", "y"), (1, "a b", "z"), (None, "c", "u"), (None, "c", "v")]
    for seed in range(4):
        docs = spark.createDataFrame(rows[seed:] + rows[:seed], "doc_id long, text string, source string").repartition(1 + seed)
        got = sorted(map(tuple, exact_dedup.deduplicated(docs).collect()), key=str)
        first = first if seed else got
        assert got == first and len(got) == 2


def test_templates_never_meet(spark):
    """Paragraphs of a template, that differ in a middle word, are not alike, and cost about as much as unrelated ones."""
    n, took = 3000, []
    line = [f"word{i}" for i in range(40)]
    template = [(i, " ".join([*line[:20], f"name{i}", *line[21:]])) for i in range(n)]
    unrelated = [(i, " ".join(f"w{i}x{j}" for j in range(40))) for i in range(n)]
    for rows in (unrelated, unrelated, template):
        began = time.perf_counter()
        assert paragraph_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).filter("kind = 'paragraph'").collect() == []
        took.append(time.perf_counter() - began)
    assert took[2] < 4 * took[1] + 10


@pytest.mark.parametrize("ends", [" ", "\n", " \r\n\t"])
def test_passage_in_other_paragraphs(spark, ends):
    """The whole passage is removed, and nothing else, though its lines are short and end elsewhere in each document."""
    rows = [(9, "", "en", "x", None), (None, None, "en", "x", None)]
    for i in (1, 2, 3):
        words = PASSAGE.split()
        lines = ends.join(" ".join(words[a : a + 7 + i]) for a in range(0, 60, 7 + i))
        rows.append((i, " ".join(f"w{i}x{j}" for j in range(40 * i)) + f"\n{lines.upper()} " + " ".join(f"end{i}x{j}" for j in range(30)), "en", "x", None))
    got = paragraph_dedup.repeats(docs(spark, rows)).collect()
    assert {(r.doc_id, r.kind, r.first_word, r.n_words, r.keep_doc_id) for r in got} == {(i, "passage", 40 * i, 60, 1) for i in (2, 3)}
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        assert texts[r.doc_id][r.start : r.start + r.length].lower().split() == PASSAGE.split()
        assert texts[1][r.keep_start :].lower().split()[:60] == PASSAGE.split()


def test_hot_passage(spark):
    rows = [(i, f"own{i} words{i} {PASSAGE} more{i}", "en", "x", None) for i in range(500)]
    got = paragraph_dedup.repeats(docs(spark, rows), min_words=1000).collect()
    assert {(r.doc_id, r.first_word, r.n_words, r.keep_doc_id, r.group_size) for r in got} == {(i, 2, 60, 0, 500) for i in range(1, 500)}


def test_packing_of_odd_texts(spark):
    got = packing.pack(docs(spark), tokenizer_path()).collect()
    assert {r.doc_tokens for r in got if r.doc_id in (3, 4)} == {1}
    assert sum(r.length for r in got if r.doc_id == 6) == next(r.doc_tokens for r in got if r.doc_id == 6)
    assert sum(r.length for r in got if r.doc_id == 2) == 2 * next(r.doc_tokens for r in got if r.doc_id == 2)


def test_mixing_of_one_empty_source(spark):
    got = mixing.mix(docs(spark, [(1, "", "en", "x", 0), (2, None, "en", "x", 0)])).collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in got] == [(0, 0, 0.0, 0)] * 2


PAGES = "page_id long, url string, html string, text string, host string, sha1 string, line string, first_id string"
PAGE_ROWS = [
    (1, "http://a.example/x", "<p>one</p>"),
    (2, "http://a.example/y", "<p>one</p>"),
    (2, "http://a.example/y", "<p>one</p>"),
    (3, None, None),
    (4, "not a url", ""),
    (None, "http://b.example/\n z", "<p>" + "long text " * 50_000),
    (5, "http://a.example/z", "<div><p>broken <b>markup &amp &#x41; <script>x</p>"),
]


def pages(spark, rows=PAGE_ROWS):
    return spark.createDataFrame([(*r, *["?"] * 5) for r in rows], PAGES).repartition(3)


def test_pages(spark):
    got = {(r.page_id, r.text, r.n_chars) for r in html_text.extract(pages(spark)).collect()}
    assert {(1, "one", 3), (3, "", 0), (4, "", 0), (5, "broken markup & A", 17)} <= got
    assert html_text.extract(pages(spark)).count() == len(PAGE_ROWS)
    assert html_text.extract(pages(spark, [])).collect() == []


STORY = "<h1>A title of the story</h1>" + "".join(f"<p>{'A sentence of the story. ' * (5 * i + 1)}</p>" for i in range(5))
PLAIN_STORY = html_text.main_text(f"<article>{STORY}</article>")


@pytest.mark.parametrize(
    "page",
    [
        "<div class='layout has-sidebar'><article>{}</article></div>",
        "<article class='post share-enabled'>{}</article>",
        "<nav><a href='/'>Home</a> <a href='/n'>News</a><article>{}</article>",
        "<form><nav><a>Home</a></nav><article>{}</article><footer>Words at the foot of the page</footer></form>",
        "<div><a>Home</a> <a>News</a> <a>Sport</a></div><div>{}</div>",
        "<article>{}<ul><li><a>Related one</a></li><li><a>Related two</a></li></ul></article>",
        "<article>{}<div class='comments'><p>A reader likes this a lot and says so at some length.</p></div></article>",
        "<div>{}</div><div><span>Log</span><span>in</span> <i>or</i> <b>join</b></div>",
    ],
)
def test_content_of_pages(page):
    assert html_text.main_text(page.format(STORY)) == PLAIN_STORY


def test_content_beside_a_teaser():
    got = html_text.main_text(f"<article><p>A few words of a teaser.</p></article><div>{STORY}</div>")
    assert got == f"A few words of a teaser.\n\n{PLAIN_STORY}"
    assert html_text.main_text("<nav><a>x</a></nav><article></article><footer>Words at the foot of the page.</footer>") == ""


def test_short_parts_of_an_article_stay():
    got = html_text.main_text(f"<article>{STORY}<ul><li>First point</li><li>Second</li></ul><section><h2>Next</h2><p>Done.</p></section></article>")
    assert got == f"{PLAIN_STORY}\n\nFirst point\n\nSecond\n\nNext\n\nDone."


def given_pages():
    """The pages of the middle table, as they are and without article elements, and the blocks of their articles."""
    found = []
    for (page,) in duckdb.sql(f"SELECT html FROM '{MIDDLE}/pages.parquet' ORDER BY page_id").fetchall():
        article = re.search(r"<article>(.*)</article>", page, re.DOTALL)[1]
        blocks = (" ".join(html.unescape(re.sub("<(br|/?b)>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", article))
        want = "\n\n".join(b for b in blocks if b)
        found += [(page, want), (page.replace("<article>", "<div>").replace("</article>", "</div>"), want)]
    return found


def test_each_part_of_the_method_decides_on_the_given_pages(monkeypatch):
    """Without the ratio, the smoothing or the threshold, given pages lose or gain lines, with article elements and without."""
    given = given_pages()
    wrong = lambda rows: sum(html_text.main_text(page) != want for page, want in rows)
    assert wrong(given) == 0
    parts = {"ratios": lambda chars, tags: np.full(len(chars), 50.0), "smoothed": lambda ratios, *_: ratios, "THRESHOLD": 0.0}
    for name, without in parts.items():
        monkeypatch.setattr(html_text, name, without)
        assert wrong(given[::2]) > len(given) // 20, name
        assert wrong(given[1::2]) > len(given) // 4, name
        monkeypatch.undo()


SHORT = "<div><h2>A heading</h2></div><div><p>{}</p></div><div><p>Yes.</p></div><div><p>{}</p></div><div><p>Why?</p></div><div><p>{}</p></div>"
LONG_PARTS = [f"Sentence {i} of the story goes on and on about its matter, and says what there is to say of it. " * 3 for i in range(3)]


@pytest.mark.parametrize("around", ["<main>{}</main>", "<article>{}</article>", "<div><ul><li><a>Home</a></ul></div><div>{}</div>", "{}"])
def test_short_blocks_in_containers_of_their_own(around):
    got = html_text.main_text(around.format(SHORT.format(*LONG_PARTS)))
    one, two, three = (x.strip() for x in LONG_PARTS)
    assert got == "\n\n".join(["A heading", one, "Yes.", two, "Why?", three])


@pytest.mark.parametrize(
    "page",
    [
        "<div class='msg'><p>This site keeps cookies, as all do.</p></div><div>{}</div>",
        "<div>{}</div><div class='msg'><p>This site keeps cookies, as all do.</p></div>",
        "<table><tr><td>Home News</td><td>{}</td></tr></table>",
        "<h3>Menu</h3><ul><li><a>One</a></li><li><a>Two</a></li></ul><div>{}</div>",
        "<main>{}<div class='newsletter'><p>Subscribe to us and get a letter each and every week of the year.</p></div></main>",
    ],
)
def test_unnamed_lines_beside_the_content_go(page):
    assert html_text.main_text(page.format(STORY)) == PLAIN_STORY


@pytest.mark.parametrize("page", ["<span>" * 20_000 + "</b>" * 20_000, "<span>" * 20_000 + "<p>x</p>" * 20_000, "<div><p>" * 20_000])
def test_pages_of_many_tags(page):
    began = time.perf_counter()
    html_text.main_text(page)
    assert time.perf_counter() - began < 10


def test_lines_of_many_tags(spark):
    rows = [(1, "http://a/1", "<div>" * 100_000 + "x" + "</div>" * 100_000), (2, "http://a/2", "y<!-- open " + "<p>z" * 50_000), (3, "http://a/3", "<" * 100_000)]
    got = {r.page_id: r for r in line_dedup.without_boilerplate(pages(spark, rows)).collect()}
    assert (got[1].text, got[2].text) == ("x", "y")


@pytest.mark.parametrize("mark", ["<a ", '<a x="', "<!--", "</a", "<script", "<a <b", "&lt;<", "<p>x<"])
def test_a_megabyte_of_open_tags(spark, mark):
    page = "<p>Before</p>" + mark * ((1 << 20) // len(mark))
    began = time.perf_counter()
    (row,) = line_dedup.without_boilerplate(pages(spark, [(1, "http://a/1", page)])).collect()
    assert row.text.startswith("Before")
    assert html_text.main_text(page).startswith("Before")
    assert html_text.main_text(page + ">").startswith("Before")
    assert time.perf_counter() - began < 20


def test_open_tags_are_text(spark):
    rows = [(1, "http://a/1", "<p>a < b</p><p>one <b"), (2, "http://a/2", "x"), (3, "http://a/3", "<i>y</i> <"), (4, "http://a/4", "<a <b>z")]
    got = {r.page_id: r.text for r in line_dedup.without_boilerplate(pages(spark, rows)).collect()}
    assert got == {1: "a < b\none <b", 2: "x", 3: "y <", 4: "z"}


def test_archives(spark):
    got = warc.round_trip(spark, pages(spark)).collect()
    found = sorted((r.page_id or -1, r.payload_bytes, r.record_type, r.refers_to) for r in got)
    assert [f[0] for f in found] == [-1, 1, 2, 2, 3, 4, 5]
    assert [(f[2], f[3]) for f in found] == [
        ("response", None), ("response", None), ("revisit", 1), ("revisit", 1), ("response", None), ("revisit", 3), ("response", None),
    ]
    assert {r.record_type for r in warc.round_trip(spark, pages(spark), min_bytes=1).collect() if r.page_id in (3, 4)} == {"response"}
    assert warc.round_trip(spark, pages(spark, [])).collect() == []


def test_lines(spark):
    got = line_dedup.without_boilerplate(pages(spark), min_pages=2, ratio=0.5).collect()
    assert sorted((r.page_id or -1, r.n_lines, r.n_dropped) for r in got)[1:] == [(1, 1, 1), (2, 1, 1), (2, 1, 1), (3, 0, 0), (4, 0, 0), (5, 1, 0)]
    assert line_dedup.without_boilerplate(pages(spark, [])).collect() == []


def test_large_hot_groups(spark):
    hot = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("the same text for all of them").alias("text"), F.lit("s").alias("source"))
    assert exact_dedup.exact_dedup(hot).filter("kept").count() == 1
    assert {r.component_id for r in simhash.near_duplicates(hot).collect()} == {0}
    assert simhash.representatives(hot).count() == 1
    assert mixing.mix(hot).agg(F.sum("taken")).first()[0] == 1.5 * 2000 * 7
