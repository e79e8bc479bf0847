"""The training-data operators against brute force on small tables, and their edge cases."""

import hashlib
import itertools
import os
import re
import subprocess
import sys
import time
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser
from pathlib import Path

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import decontam, exact_dedup, html_extract, line_dedup, packing, quality, queries, sharding, simhash, substring, url_filter

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and columns named like inner ones."""
    long = " ".join(f"word{i % 997}" for i in range(30_000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t", "en", "a", 3), (4, long, "en", "a", len(long)), (4, long, "en", "a", len(long)), (5, long, None, "b", 1), (None, "no id here", "en", "a", 10), (6, "One. Two", "en", "a", 8), (7, "ONE. tWO", "en", "a", 8)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("*", "1 as id", "2 as h", "'x' as t", "3 as run", "4 as fp", "5 as u", "6 as rank", "7 as tokens", "8 as at", "9 as leaf", "10 as n", "11 as w", "12 as phrase", "13 as html_x")


def by_duckdb(name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con.sql(queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_agrees(spark, name):
    want = by_duckdb(name)
    columns = sorted(want.columns)
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    key = lambda rows: sorted(map(repr, rows))
    assert key(tuple(r[c] for c in columns) for r in got.collect()) == key(want.select(*columns).fetchall())


# --- quality


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    scored = queries.op1_quality_crf(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = scored.where("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 50 and np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95
    good, bad = ([r["score"] for r in rows if r["quality"] == k] for k in (1, 0))
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.97  # area under the curve
    assert -np.mean([np.log(max(r["score"] if r["quality"] else 1 - r["score"], 1e-6)) for r in rows]) < 0.2
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def test_marginals_equal_enumeration():
    random = np.random.default_rng(1)
    evidence, moves = random.normal(size=7), random.normal(size=(2, 2))
    at = np.array([[0, 1, 2, 3], [4, 5, 6, -1]])
    good, total, pairs = quality.marginals(evidence, at, moves)
    want_pairs = np.zeros((2, 2))
    for row, z in zip(at, total, strict=True):
        places = [i for i in row if i >= 0]
        mass, by_line = 0.0, np.zeros(len(places))
        counts = np.zeros((2, 2))
        for ys in itertools.product((0, 1), repeat=len(places)):
            p = np.exp(sum(evidence[i] * y for i, y in zip(places, ys, strict=True)) + sum(moves[a, b] for a, b in zip(ys, ys[1:], strict=False)))
            mass += p
            by_line += p * np.array(ys)
            for a, b in zip(ys, ys[1:], strict=False):
                counts[a, b] += p
        assert np.isclose(np.log(mass), z) and np.allclose(good[places], by_line / mass)
        want_pairs += counts / mass
    assert np.allclose(pairs, want_pairs)


def test_neighbours_smooth_a_line():
    """A doubtful line among good ones is likelier good with moves than without, and among bad ones likelier bad."""
    at, moves = np.arange(5)[None, :], np.array([[0.5, -0.5], [-0.5, 0.5]])
    for sign in (1, -1):
        evidence = sign * np.array([3.0, 3.0, -0.3, 3.0, 3.0])
        with_moves, alone = (quality.marginals(evidence, at, m)[0][2] for m in (moves, np.zeros((2, 2))))
        assert sign * (with_moves - 0.5) > 0 > sign * (alone - 0.5)


def test_question_marks_are_sentence_marks():
    own = quality.line_features("wer? \u4e2d\u6587 ok")[0][0]
    assert np.isclose(own[5], 1 / 10) and own[1] == 0


def test_quality_edges(spark, docs, edge):
    field = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = quality.with_quality(edge, field).collect()
    assert len(rows) == 9 and all(0 <= r["quality_score"] <= 1 for r in rows) and rows[0]["h"] == 2
    assert rows[0]["quality_score"] == rows[1]["quality_score"]
    assert quality.with_quality(edge.limit(0), field).count() == 0
    blank = quality.train(docs, spark.createDataFrame([(1, 1), (2, None)], "doc_id long, quality int"))
    assert {r["quality_score"] for r in quality.with_quality(edge, blank).collect()} == {0.5}


def test_long_texts_are_scored_like_short_ones():
    random = np.random.default_rng(8)
    n = quality.with_neighbours(np.zeros((1, quality.FEATURES))).shape[1]
    field = quality.Field(random.normal(size=n), np.array([[0.7, -0.4], [-0.6, 0.9]]))
    lines = ["", "One two.", "SHOUT!! now!!", "a b a b a b", "x | y | z", "12 34 56"]
    for size in (1, 2, 3, 50, 1003):
        text = "\n".join(random.choice(lines, size))
        want = quality.document_means(field, [quality.line_features(text)])[0]
        for block in (1, 7, 20_000):
            assert np.isclose(quality.long_mean(field, text, block), want, atol=1e-9), (size, block)
    texts = ["\n".join(random.choice(lines, k)) for k in random.integers(1, 60, 100)] + [None, ""]
    want = quality.document_means(field, [quality.line_features(t) for t in texts])
    assert np.allclose(quality.text_means(field, texts, most_lines=100, long_lines=40), want, atol=1e-9)


def test_five_million_lines_fit_into_a_gigabyte():
    code = """
import resource, numpy as np
from millrace.llm import quality
n = quality.with_neighbours(np.zeros((1, quality.FEATURES))).shape[1]
field = quality.Field(np.full(n, 0.1), np.array([[0.5, -0.5], [-0.5, 0.5]]))
text = "a b.\\n\\n" * 2_500_000
assert 0 < quality.text_means(field, [text])[0] < 1
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)
"""
    root = str(Path(__file__).resolve().parents[2])
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env={**os.environ, "PYTHONPATH": root}, check=True)
    assert int(out.stdout) < 1_000_000, out.stdout


# --- decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def brute_contamination(text, items, window=10):
    w = WORD.findall(lowered(text))
    hit, found = set(), set()
    for item, phrase in items:
        p = WORD.findall(lowered(phrase))
        n = min(len(p), window)
        if not n:
            continue
        known = {tuple(p[i : i + n]) for i in range(len(p) - n + 1)}
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in known:
                hit.update(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


def test_contamination_with_short_items(spark):
    items = [(1, "alpha beta gamma"), (2, "one"), (3, "a b c d e f g h i j k l"), (4, None), (5, " - "), (6, "É é"), (7, "p q r s")]
    texts = [None, "", "x alpha BETA, gamma y", "none ONE, two", "z a b c d e f g h i j k", "b c d e f g h i j k l m", "É-é é É", "a b c d e f g h i", "p q r s p q r s", "p q r", "alpha beta gamma alpha beta gamma"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[2])]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as w", "2 as h", "3 as items", "4 as id")
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("w", F.lit(1))
    got = Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in decontam.contamination(d, b).collect())
    want = Counter()
    for i, t in rows:
        n, hit, found = brute_contamination(t, items)
        want[(i, n, hit, tuple(found), hit > 0)] += 1
    assert got == want
    kept = decontam.drop_contaminated(d, b)
    assert kept.count() == sum(n for k, n in want.items() if not k[4]) and kept.columns == d.columns
    cleaned = {r["doc_id"]: r["text"] for r in decontam.remove_spans(d, b).collect() if r["doc_id"] is not None}
    assert cleaned[2] == "x y" and cleaned[0] is None and cleaned[7] == texts[7] and cleaned[8] == ""
    assert decontam.contamination(d, b.limit(0)).where("contaminated").count() == 0
    assert decontam.contamination(d.limit(0), b).count() == 0
    found = lambda df: sorted((r["id"] or 0, r["text_hash"], sorted(map(tuple, r["spans"])), sorted(r["items"])) for r in df.collect())
    assert found(decontam.find_hits(d, b, broadcast_rows=0)) == found(decontam.find_hits(d, b)) == found(decontam.find_hits(d, b, broadcast_bytes=0))
    long = " ".join(f"v{i} x" for i in range(100_000)) + " alpha beta gamma end"
    one = decontam.remove_spans(spark.createDataFrame([(1, long)], "doc_id long, text string"), b).first()["text"]
    assert one == long.replace("alpha beta gamma ", "")


# --- packing


def check_packing(rows, tokens):
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= tokens
    return len(by_sequence)


def test_packing_round_trip(spark, docs):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(packing.vocabulary())
    rows = queries.op3_best_fit_packing(spark, SF).collect()
    sequences = check_packing(rows, 2048)
    total = sum(r["length"] for r in rows)
    assert sequences <= -(-total // 2048) * 1.02 + 1
    got = {(r["doc_id"], r["piece"]): r for r in rows}
    assert len(got) == len(rows)
    for doc in docs.collect():
        ids = np.array([*model.encode(doc["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        start = k = 0
        while start < len(ids):
            r = got.pop((doc["doc_id"], k))
            assert r["start"] == start and r["ids_crc32"] == zlib.crc32(ids[start : start + r["length"]].tobytes())
            assert r["length"] == 2048 or k == 0
            start, k = start + r["length"], k + 1
    assert not got


@pytest.mark.parametrize("text", [" " * 5_000_000, "\n" * 5_000_000, "\t" * 5_000_000, "\u00a0" * 1_000_000 + "x", "a" + " " * 5_000_000 + "b", " \n" * 300_000, "a" * 2_000_000, "." * 2_000_000], ids=lambda t: f"{t[:1]!r}{len(t)}")
def test_long_runs_have_the_librarys_ids(text):
    encode = packing.encoder(packing.vocabulary())
    want = np.array(encode.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert encode(text) == want


def best_fit_one_by_one(lengths, tokens):
    """Sequences of best fit, longest first, one piece at a time."""
    gaps, opened = Counter(), 0
    for n in sorted(lengths, reverse=True):
        gap = next((g for g in range(n, tokens + 1) if gaps[g]), None)
        opened += gap is None
        gaps[gap] -= 1
        gaps[(tokens if gap is None else gap) - n] += 1
    return opened


def test_packing_rounds_are_near_one_by_one(spark, docs):
    random = np.random.default_rng(3)
    cases = [random.integers(1, 65, 700), np.minimum(random.geometric(0.05, 900), 64), np.repeat([33, 1], [200, 3000]), np.full(500, 40), np.array([64, 1]), np.repeat([22, 21, 5], [300, 300, 300])]
    for lengths in map(np.ndarray.tolist, cases):
        rows = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(lengths)], packing.PIECES)
        got = packing.pack(rows, tokens=64, rows_per_split=100).collect()
        assert sorted(r["length"] for r in got) == sorted(lengths)
        assert check_packing(got, 64) <= best_fit_one_by_one(lengths, 64) * 1.01 + 1
    got = packing.pack(packing.pieces(docs)).collect()
    assert check_packing(got, 2048) <= best_fit_one_by_one([r["length"] for r in got], 2048) * 1.01 + 1


def test_packing_edges(spark, edge):
    rows = packing.pack(packing.pieces(edge, tokens=16), tokens=16).collect()
    check_packing(rows, 16)
    assert sum(r["id"] == 1 for r in rows) == 1 and {r["length"] for r in rows if r["id"] in (1, 2)} == {1}
    assert any(r["id"] is None for r in rows)
    assert packing.pack(packing.pieces(edge.limit(0))).count() == 0
    texts = ["a  b\n c ", "  x", "", "é  b\t c", " ", "\n\n a", "don't <|endoftext|> 12 x", "<|endoftext|><|endoftext|>", " <|endoftext |>"]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(packing.vocabulary())
    assert [np.frombuffer(packing.encoder(packing.vocabulary())(t), "<u4").tolist() for t in texts] == [model.encode(t, add_special_tokens=False).ids for t in texts]


# --- HTML


def page(body):
    return f'<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{{}}</style><script>var t="</p>";</script></head><body>{body}</body></html>'


def test_html_extraction(spark):
    nav = '<nav><ul><li><a href="/a">Menu one</a></li><li><a>Two</a></li></ul></nav><!-- ad --><div class="ad">Buy this very long advert text now, it is quite long, really.</div>'
    foot = '<footer>&copy; site &middot; A footer text\nthat is long enough to look like a text.</footer>'
    cases = {
        page(nav + "<article><h1>Head &amp; line</h1><p><b>First\n  part &lt;x&gt;.<br><p>Ti.</p><p>Second paragraph of the text.</p></article>" + foot): "Head & line\nFirst part <x>.\nTi.\nSecond paragraph of the text.",
        page(nav + "<article><h1>Head</h1><p>One.</p><aside>Side <p>note</p></aside><p>Two.</p><form>Mail <input></form><div class='comments'><article><p>Reader says a thing.</p></article></div></article>" + foot): "Head\nOne.\nTwo.",
        page("<header>Site name</header><div id=main><p>" + "A long paragraph. " * 20 + "</p><p>Short.</p></div>" + foot): ("A long paragraph. " * 20).strip() + "\nShort.",
        "just text": "just text",
        "<article><p>cut off &am": "cut off &am",
        "": "",
        "<p": "",
    }
    d = spark.createDataFrame([(i, h) for i, h in enumerate([*cases, None])], "page_id long, html string").withColumn("text_x", F.lit(1))
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(d).collect()}
    assert got == dict(enumerate([*cases.values(), ""]))
    assert html_extract.extract_pages(d.limit(0)).count() == 0


def test_only_articles_of_the_page_itself_mark_its_text():
    long = "A paragraph that is long enough to be running text. " * 3
    body = f"<div><p>{long}</p><p>And its end.</p></div>"
    want = f"{long.strip()}\nAnd its end."
    for other in ('<article class="comment-body"><p>Reader says a thing.</p></article>', '<article class="promo"><a>Teaser</a></article>', "<script>x='<article>'</script>", "<template><main>x</main></template>", "<!-- <article> -->", "<aside><article>Side</article></aside>", "<article></article>"):
        assert html_extract.main_text(page(body + other)) == want, other
    links = "<p><a>One link</a></p><p><a>Two</a></p><p><a>Three</a></p>"
    text = html_extract.main_text(page(f'<article><div class="entry-header"><h1>Title</h1></div><p>{long}</p>{links}<p>More text.</p><p><a>Last link</a></p></article>'))
    assert text == f"Title\n{long.strip()}\nOne link\nTwo\nThree\nMore text.\nLast link"


def test_names_are_judged_as_a_whole():
    long = "A paragraph that is long enough to be running text. " * 3
    want = long.strip()
    assert html_extract.main_text(f'<script>var x="<main>";</script><p>{long}</p>') == want
    assert html_extract.main_text(f'<article class="post has-sidebar"><p>{long}</p></article>') == want
    body = f'<article><h2 id="search-trees">Trees</h2><p>{long}</p><section id="related-work"><h2 id="comments">Related work</h2><p class="share-price">Its price.</p></section></article>'
    assert html_extract.main_text(page(body)) == f"Trees\n{want}\nRelated work\nIts price."
    for noise in ('<div class="left-sidebar">x</div>', "<div id=comments>x</div>", '<div class="x cookieNotice">x</div>', '<ul class="share_buttons"><li>x</ul>', '<section role="search">x</section>', '<p class="ad">x</p>', '<ol class="comment-list"><li>x</li></ol>'):
        assert html_extract.main_text(page(f"<article><p>{long}</p>{noise}<p>End.</p></article>")) == f"{want}\nEnd.", noise
    assert html_extract.main_text(page(f'<div class="site-header">Site</div><div class="post-header"><h1>Title</h1></div><p>{long}</p>')) == f"Title\n{want}"


def test_comment_roots_and_chapters():
    long = "A paragraph that is long enough to be running text. " * 3
    want = long.strip()
    for name in ("disqus_thread", "wp-block-comments", "fb-comments", "c-comment__body", "gdpr-banner", "navbar-collapse", "breadcrumb-trail", "comment-42", "user-comments"):
        for element in (f'<div class="{name}"><p>{long}</p></div>', f'<section id="{name}"><h2>Said</h2><p>{long}</p></section>'):
            assert html_extract.main_text(page(f"<article><p>{long}</p>{element}<p>End.</p></article>")) == f"{want}\nEnd.", name
    for name in ("no-comments", "comments-open", "has-comments", "post comments-closed"):
        assert html_extract.main_text(page(f'<article class="{name}"><p>{long}</p></article>')) == want, name
    chapter = f'<section id="login" class="search"><h2>Login</h2><p>{long}</p></section>'
    assert html_extract.main_text(page(f"<article><p>{long}</p>{chapter}</article>")) == f"{want}\nLogin\n{want}"
    assert html_extract.main_text(page(f"<article><p>{long}</p></article>{chapter}")) == want
    assert html_extract.main_text(page(f'<article><p>{long}</p><div class="search"><h2>Find</h2></div></article>')) == want


def test_the_distribution_decides_on_every_page():
    """Pages without marks, with marks around a part and with marks around something else, and their texts by hand."""
    long = "A paragraph that is long enough to be running text. " * 3
    want = long.strip()
    cards = "<article><a href=x>Teaser one</a></article><article><a href=y>Teaser two</a></article>"
    plain_cards = '<article><h2>First story</h2><p>Its summary in a few words.</p></article><article><h2>Second story</h2><p>Another few words.</p></article>'
    links = "".join(f"<p><a href={i}>Link number {i} to another page</a></p>" for i in range(5))
    body = f"<div><h1>Title</h1><p>{long}</p><p>Short.</p><p>{long}</p></div>"
    text = f"Title\n{want}\nShort.\n{want}"
    cases = [
        (body, text, "unmarked"),
        (links + body + links, text, "unmarked"),
        (f"<div>{body}</div>{links}<div><p>{long}</p></div>", f"{text}\n{want}", "unmarked"),
        (cards + body, text, "free"),
        (body + cards, text, "free"),
        (plain_cards + body + f"<p>{long * 2}</p>", f"{text}\n{(long * 2).strip()}", "free"),
        (f"<article><h1>Title</h1><p>The beginning of the text.</p></article><div><p>{long}</p><p>Short.</p></div>", f"Title\nThe beginning of the text.\n{want}\nShort.", "free"),
        (f"<article>{body}</article>{links}<div><p>{long}</p></div>", text, "marked"),
        (f"<p>{long}</p><main>{body}</main>{plain_cards}", f"{text}\nFirst story\nIts summary in a few words.\nSecond story\nAnother few words.", "marked"),
        (f"<main>{body}{cards}</main>", f"{text}\nTeaser one\nTeaser two", "marked"),
        ("<article><p>No.</p></article>", "No.", "marked"),
        (f"<article><p></p></article>{body}", text, "unmarked"),
        ("<p>Short.</p>", "Short.", "unmarked"),
        (links, "", "unmarked"),
        ("", "", "unmarked"),
    ]
    for html, expected, by in cases:
        lines, how = html_extract.main_lines(page(html))
        assert ("\n".join(lines), how) == (expected, by), html


@pytest.mark.parametrize("part", ["<a b='", "<div>", "</p>", "<div></p>", "<!--", "<", "<p class=\"", "&amp", "<script>", "<b =  ", "<article><div class=ad>"])
def test_hostile_pages_take_linear_time(part):
    began = time.perf_counter()
    html_extract.main_text(part * (2_000_000 // len(part)))
    assert time.perf_counter() - began < 8
    assert html_extract.main_text(f"<p>{'Text of a page. ' * 9}</p><p>5 < 6 &lt; 7</p>" + part * 3).startswith("Text of a page.")


class Reference(HTMLParser):
    """The text of an article by the standard library's parser, for pages that mark it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.now, self.inside, self.out = [], "", 0, 0

    def flush(self):
        self.blocks.append(" ".join(self.now.split()))
        self.now = ""

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "h1", "h2", "li", "ul", "div", "article"):
            self.flush()
        self.inside += tag == "article"
        self.now += " " * (tag == "br")

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "h2", "li", "ul", "div", "article"):
            self.flush()
        self.inside -= tag == "article"

    def handle_data(self, data):
        if self.inside:
            self.now += data


def test_pages_equal_a_reference_parser(spark):
    for r in queries.op4_html_main_text(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html"), "page_id").collect():
        reference = Reference()
        reference.feed(r["html"] or "")
        reference.close()
        reference.flush()
        assert r["text"] == "\n".join(b for b in reference.blocks if b) and r["n_chars"] == len(r["text"])


def test_distribution_alone_finds_the_articles(spark):
    """The table's pages all mark their article; without the marks surge and dive find the same lines on at least 19 of 20."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    same = ways = 0
    for r in rows:
        html = r["html"] or ""
        lines, by = html_extract.main_lines(html)
        bare, how = html_extract.main_lines(html.replace("<article>", "<div>").replace("</article>", "</div>"))
        same, ways = same + (lines == bare), ways + (by == "marked" and how == "unmarked")
    assert ways == len(rows) and same >= 0.95 * len(rows), (same, ways, len(rows))


# --- urls


def test_urls(spark):
    cases = [(None, "", "", None, "allow"), ("no scheme", "", "", None, "allow"), ("http://A.net/x", "a.net", "/x", "net/", "block"), ("http://a.net", "a.net", "", None, "allow"), ("http://b.example.net/en/1?porn", "b.example.net", "/en/1", "example.net/en/", "allow"), ("http://myexample.com/de/", "myexample.com", "/de/", None, "allow"), ("https://example.com/de/x#y", "example.com", "/de/x", "example.com/de/", "block"), ("https://casino.org/fr/", "casino.org", "/fr/", "org/fr/", "allow"), ("https://casino.org/en/", "casino.org", "/en/", None, "block"), ("https://casinos2.org/", "casinos2.org", "/", None, "allow"), ("https://x.org/free/free", "x.org", "/free/free", None, "allow"), ("https://x.org/free/bets", "x.org", "/free/bets", None, "block")]
    d = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "page_id long, url string").withColumn("hits", F.lit(1))
    got = {r["page_id"]: (r["url"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(d).collect()}
    assert got == dict(enumerate(cases))
    assert url_filter.judge_urls(d.limit(0)).count() == 0
    named = url_filter.judge_urls(d.selectExpr("*", "7 as _url", "8 as _hits", "9 as host"))
    assert {(r["_url"], r["_hits"]) for r in named.collect()} == {(7, 8)} and {r["host"] for r in named.collect()} == {c[1] for c in cases}
    long = "http://x.org/" + "free-" * 200_000
    rows = url_filter.judge_urls(spark.createDataFrame([(1, long), (1, long), (2, long + "bets")], "page_id long, url string")).collect()
    assert sorted(r["verdict"] for r in rows) == ["allow", "allow", "block"]
    own = url_filter.judge_urls(spark.createDataFrame([(1, "http://x.org/Alpha"), (2, "http://x.org/alphas?beta=alpha")], "page_id long, url string"), weights={"alpha": 1, "beta": 1.5})
    assert {r["page_id"]: (r["term_hits"], r["term_weight"], r["verdict"]) for r in own.collect()} == {1: (1, 1.0, "allow"), 2: (2, 2.5, "block")}


def test_url_terms():
    weights = url_filter.vocabulary()
    assert {1.0, 2.0} == set(weights.values()) and len(weights) > 150


# --- passages


def test_chain_beats_every_order():
    random = np.random.default_rng(5)
    for _ in range(30):
        n = int(random.integers(1, 9))
        x, y = random.permutation(30)[:n], random.permutation(30)[:n]
        best = 0.0
        for size in range(1, n + 1):
            for path in itertools.combinations(sorted(range(n), key=lambda i: x[i]), size):
                if all(x[a] < x[b] and y[a] < y[b] for a, b in zip(path, path[1:], strict=False)):
                    best = max(best, 8 * size - 0.05 * sum(x[b] - x[a] + y[b] - y[a] for a, b in zip(path, path[1:], strict=False)))
        first = substring.chain(x, y, 8, 0.05, 1000)[0]  # no gap is too far here
        assert np.isclose(8 * first[4] - 0.05 * ((first[1] - 8 - first[0]) + (first[3] - 8 - first[2])), best)


def test_passages(spark):
    random = np.random.default_rng(6)
    vocabulary = np.array([f"w{i}" for i in range(5000)])
    prose = lambda n: random.choice(vocabulary, n).tolist()
    shared, fuzzy = prose(80), prose(90)
    changed = list(fuzzy)
    for i in (30, 60):
        changed[i] = "other"
    texts = {1: prose(100) + shared + prose(50), 2: prose(10) + shared + prose(300), 3: prose(40) + fuzzy, 4: changed + prose(60), 5: prose(200), 6: prose(30) + shared[:40] + prose(30), 7: prose(49), 8: None, 9: "", 10: shared}
    d = spark.createDataFrame([(k, None if t is None else " ".join(t)) for k, t in texts.items()] + [(None, " ".join(shared))], "doc_id long, text string").selectExpr("*", "1 as seed", "2 as id", "3 as t")
    rows = substring.passages(d).collect()
    assert {(r["doc_id"], r["other_id"]) for r in rows} == {(1, 2), (2, 1), (1, 10), (10, 1), (2, 10), (10, 2), (3, 4), (4, 3)}
    spans = {(r["doc_id"], r["start"], r["end"]) for r in rows}
    assert spans == {(1, 100, 180), (2, 10, 90), (10, 0, 80), (3, 40, 130), (4, 0, 90)}
    assert substring.passages(d.limit(0)).count() == 0


def test_passages_far_apart_are_chains_of_their_own():
    x = np.concatenate([np.arange(0, 60, 4), np.arange(160, 220, 4), np.arange(420, 480, 4)])
    for y in (x, np.concatenate([x[15:30], x[:15] + 900, x[30:]])):
        chains = substring.chain(x, y, 5, 0.05, 60)
        assert sorted((c[0], c[1], c[4]) for c in chains) == [(0, 61, 15), (160, 221, 15), (420, 481, 15)]


def test_passages_among_edits_repeats_and_common_lines(spark):
    """Edited passages are found, the parts of one whose parts stand elsewhere first too, and clean texts are left alone."""
    random = np.random.default_rng(12)
    prose = lambda n: [f"w{i}" for i in random.integers(0, 3000, n)]
    texts, want = {}, set()
    for i in range(60):
        passage = prose(75 + i)
        for k in (0, 1):
            changed = [w if not k or random.random() > 0.1 else "changed" for w in passage]
            texts[2 * i + k + 1] = prose(40) + changed + prose(40)
            want.add(2 * i + k + 1)
    common = [prose(20) for _ in range(3)]
    for i in range(200, 260):  # lines that many share, and junk, but no passage
        texts[i] = prose(150) + common[i % 3] + prose(30) + common[(i + 1) % 3] + ["ad"] * int(random.integers(5, 25)) + prose(30)
    parts = [prose(30) for _ in range(3)]
    for i in range(3):
        texts[300 + i] = prose(60) + parts[i] + prose(60)
    whole = parts[0] + parts[1] + parts[2]
    texts[310], texts[311] = prose(20) + whole, whole + prose(20)
    rows = [(k, " ".join(t)) for k, t in texts.items()] + [(1, "shorter")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    found = substring.passages(d).collect()
    seen = {r["doc_id"] for r in found}
    assert len(want - seen) <= 2 and (310, 311) in {(r["doc_id"], r["other_id"]) for r in found}
    assert not seen - want - {300, 301, 302, 310, 311}
    # an id on several rows is one document, of which the longest text counts
    again = substring.passages(d.union(spark.createDataFrame([(2, " ".join(texts[2])), (2, "x")], d.schema))).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, found))


@pytest.mark.parametrize(("share", "least"), [(0.1, 0.99), (0.15, 0.95), (0.18, 0.9)])
def test_recall_of_edited_passages(spark, share, least):
    """Passages of 60 to 120 words with words replaced, dropped and put in; those that stay similar enough are found."""
    random = np.random.default_rng(int(share * 100))
    prose = lambda n: [f"w{i}" for i in random.integers(0, 20_000, n)]
    texts, similar = {}, set()
    for i in range(300):
        passage = prose(int(random.integers(60, 120)))
        edited, kept = [], 0
        for w in passage:
            kind = random.random()
            if kind >= share:
                edited.append(w)
                kept += 1
            elif kind < share * 0.6:
                edited.append("other")
            elif kind > share * 0.8:
                edited += [w, "more"]
                kept += 1
        texts[2 * i + 1], texts[2 * i + 2] = prose(60) + passage + prose(60), prose(50) + edited + prose(70)
        if kept / max(len(passage), len(edited)) >= 0.8:
            similar.add((2 * i + 1, 2 * i + 2))
    d = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id long, text string")
    found = {tuple(sorted((r["doc_id"], r["other_id"]))) for r in substring.passages(d).collect()}
    recall = len(found & similar) / len(similar)
    print(f"recall of passages with {share:.0%} of words changed: {recall:.3f} of {len(similar)}")
    assert recall >= least and all(b == a + 1 and a % 2 for a, b in found)


@pytest.mark.parametrize("limits", [{"bucket_rows": 5}, {"filter_bits": 4}, {"bucket_rows": 3, "hot_rows": 0, "filter_bits": 20}])
def test_buckets_and_filters_change_nothing(spark, docs, limits):
    rows = lambda frame: sorted(map(repr, frame.collect()))
    plain, dealt = rows(substring.passages(docs)), rows(substring.passages(docs, **limits))
    if "bucket_rows" not in limits:
        assert dealt == plain
    covered = lambda found: {eval(r.replace("Row(", "dict("))["doc_id"] for r in found}  # noqa: E731, S307
    assert covered(plain) == covered(dealt) and plain


@pytest.mark.parametrize(("lines", "size", "holders", "limits"), [(3, 20, 5, {}), (3, 20, 40, {}), (4, 15, 7, {"pair_rows": 4, "chunk": 3}), (4, 15, 7, {"pair_rows": 4, "hot_rows": 0, "filter_bits": 4})])
def test_passages_whose_parts_are_common_elsewhere(spark, lines, size, holders, limits):
    """Texts that share a passage are linked though every part of it, and with four lines any three of them, stand in many others."""
    random = np.random.default_rng(31)
    prose = lambda n: [f"w{i}" for i in random.integers(0, 100_000, n)]
    # a word of their own between parts, so no seed reaches over their edges
    joined = lambda held: held[0] + [w for part in held[1:] for w in prose(1) + part]
    parts = [prose(size) for _ in range(lines)]
    texts = []
    for _ in range(holders):
        for i in range(lines):
            held = [parts[i]] if lines == 3 else parts[:i] + parts[i + 1 :]
            texts.append(prose(70) + joined(held) + prose(70))
    both = [len(texts) // 3, 2 * len(texts) // 3]
    for i in both:
        texts[i] = prose(70) + joined(parts) + prose(70)
    d = spark.createDataFrame(list(enumerate(map(" ".join, texts))), "doc_id long, text string")
    rows = substring.passages(d, **limits).collect()
    assert {(r["doc_id"], r["start"], r["end"], r["other_id"]) for r in rows} == {(a, 70, 129 + lines, b) for a, b in (both, both[::-1])}


@pytest.mark.parametrize("limits", [{"pair_rows": 2}, {"pair_rows": 4, "chunk": 5, "hot_rows": 0}, {"pair_rows": 1, "chunk": 7, "filter_bits": 4}])
def test_no_link_between_texts_is_lost(spark, docs, limits):
    """Each link of all pairs of occurrences is there, or both texts are linked to one at that place, or are copies of such."""
    every, found = (substring.passages(docs, **x).collect() for x in ({"pair_rows": 10**9, "bucket_rows": 10**9}, limits))
    linked = defaultdict(list)
    for r in found:
        linked[r["doc_id"]].append((r["start"], r["end"], r["other_id"]))
    around = lambda i, a, b: {i} | {o for s, e, o in linked[i] if s < b and e > a}
    assert len(every) >= len(found)
    for r in every:
        one, two = around(r["doc_id"], r["start"], r["end"]), around(r["other_id"], r["other_start"], r["other_end"])
        assert one & two, r


def test_passages_of_the_table(spark, docs):
    """Every run of 60 words that two documents share is inside a reported passage of both."""
    texts = {r["doc_id"]: substring.words((r["text"] or "").encode()) for r in docs.collect()}
    seen = defaultdict(set)
    for k, w in texts.items():
        for i in range(len(w) - 59):
            seen[tuple(w[i : i + 60])].add((k, i))
    covered = defaultdict(set)
    for r in queries.op6_repeated_passages(spark, SF).collect():
        covered[r["doc_id"]].update(range(r["start"], r["end"]))
    for places in seen.values():
        if len({k for k, _ in places}) > 1:
            for k, i in places:
                assert len(covered[k] & set(range(i, i + 60))) >= 58


# --- sharding


def brute_minimax(sizes, shards):
    best = [0] + [float("inf")] * len(sizes)
    for _ in range(shards):
        best = [min([best[j], *(max(best[i], sum(sizes[i:j])) for i in range(j))]) if j else 0 for j in range(len(sizes) + 1)]
    return best[-1]


def test_capacity_is_minimax():
    random = np.random.default_rng(2)
    for _ in range(60):
        sizes = random.integers(1, 40, random.integers(1, 14)).tolist()
        shards = int(random.integers(1, 5))
        assert sharding.smallest_capacity(sizes, shards) == brute_minimax(sizes, shards)


def test_shards(spark, docs):
    rows = queries.op7_minimax_shards(spark, SF).collect()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    of = {}
    for r in rows:
        data = (text[r["doc_id"]] or "").encode()
        assert r["size"] == len(data) + 1 and r["text_crc32"] == zlib.crc32(data)
        assert of.setdefault(data, r["shard"]) == r["shard"]
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) <= set(range(8)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    groups = docs.groupBy(F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).agg(F.sum(F.octet_length("text") + 1).alias("bytes"))
    ordered = [r["bytes"] for r in groups.orderBy("h").collect()]
    load = Counter()
    for r in rows:
        load[r["shard"]] += r["size"]
    assert max(load.values()) == sharding.smallest_capacity(ordered, 8)


@pytest.mark.parametrize("hot", [1, 4000])
def test_cuts_by_ranges_equal_cuts_by_groups(spark, hot):
    random = np.random.default_rng(hot)
    h = random.integers(-(2**63), 2**63, 3000)
    h[:500] = -(2**63) + np.arange(500)
    size = random.integers(1, 50, 3000)
    size[7] *= hot
    groups = spark.createDataFrame([(int(a), int(b)) for a, b in zip(h, size, strict=True)], "h long, bytes long")
    cuts = sharding.find_cuts(groups, 8, first_bits=3, next_bits=4)
    order = np.argsort(h)
    capacity = sharding.smallest_capacity(size[order].tolist(), 8)
    shard = np.searchsorted(np.array(cuts), h, side="right")
    assert max(np.bincount(shard, size)) == capacity


def test_shard_edges(spark, edge):
    rows = sharding.shard_documents(edge, shards=3).collect()
    assert len(rows) == 9 and rows and {r["size"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    assert sharding.shard_documents(edge.limit(0)).count() == 0


# --- lines


def test_line_templates(spark):
    own = [f"alpha{chr(97 + i)} beta{chr(98 + i)} gamma{chr(99 + i)} delta{chr(100 + i)} epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau" for i in range(12)]
    rows = [(i, f"{own[i]}\nUser {i} logged in from host{i} at noon today\nSee you again soon dear {own[i][:6]} friend of ours") for i in range(12)]
    rows += [(100 + i, "Copy of one long text that is the very same everywhere\nwith another line that is also the same everywhere") for i in range(20)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (0, rows[0][1])]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as at", "2 as leaf", "3 as line", "4 as n")
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(d).collect()}
    assert all(got[i]["text"] == own[i] and got[i]["dropped_lines"] == [1, 2] for i in range(12))
    assert all(got[100 + i]["dropped_lines"] == [] for i in range(20))  # one text in twenty copies
    assert got[200]["text"] is None and got[201]["text"] == "" and got[202]["text"] == "\n\n"
    assert line_dedup.dedup_lines(d.limit(0)).count() == 0
    same = line_dedup.dedup_lines(d, broadcast_rows=0)
    assert {r["doc_id"]: r["text"] for r in same.collect()} == {k: r["text"] for k, r in got.items()}


def test_heavy_carriers_lose_their_lines(spark):
    """Whatever share of a document recurs, it goes."""
    texts = [f"Share this article\nThe first line of a notice that stands everywhere\nOnly {'abcdefghijkl'[i]}{'mnopqrstuvwx'[i]} differs\nThe last line of that notice is this" for i in range(12)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = line_dedup.dedup_lines(d).collect()
    assert {r["text"] for r in rows} == {t.split("\n")[2] for t in texts} and all(r["dropped_lines"] == [0, 1, 3] for r in rows)


def test_lines_are_dropped_in_linear_time(spark):
    """A document of 100,000 lines, half of which recur, among copies of its lines."""
    notice = [f"notice {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} stands everywhere" for i in range(2000)]
    long = "\n".join(f"{notice[i % 2000]}\nown{chr(97 + i % 26)} x{i}y line of this text {i * 7919 % 100003}z" for i in range(50_000))
    rows = [(i, f"{'abcdefghijkl'[i]}\n" + "\n".join(notice)) for i in range(8)] + [(99, long)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.perf_counter()
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(d).collect()}
    assert time.perf_counter() - began < 60
    assert got[99]["dropped_lines"] == list(range(0, 100_000, 2)) and got[99]["text"].count("\n") == 49_999
    assert all(got[i]["text"] == "abcdefghijkl"[i] for i in range(8))


# --- exact copies


def test_exact_edges(spark, edge):
    rows = exact_dedup.exact_groups(edge.repartition(11), fan_in=2).collect()
    groups = {(r["doc_id"], r["keep_id"], r["group_size"]) for r in rows}
    assert groups == {(1, 2, 2), (2, 2, 2), (3, 3, 1), (4, 5, 3), (5, 5, 3), (None, None, 1), (6, 7, 2), (7, 7, 2)}
    assert len(rows) == 9 and sum(r["kept"] for r in rows) == 5
    twice = exact_dedup.exact_groups(edge.where("doc_id = 4"), keep="min").collect()
    assert [r["kept"] for r in twice].count(True) == 1
    low = {r["doc_id"]: hashlib.sha256(lowered(r["text"]).encode()).hexdigest() for r in edge.collect()}
    assert {(r["doc_id"], r["text_sha256"]) for r in rows} == set(low.items())
    assert exact_dedup.exact_groups(edge.limit(0)).count() == 0


# --- SimHash


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    ones = Counter(b for s in shingles for b in range(64) if xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1)
    return sum(1 << b for b, n in ones.items() if n * 2 > len(shingles))


def brute_sketch(text, size=5, prints=8):
    """Fingerprints of mixed hashes, in Python's whole numbers."""
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    shingles = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or ([" ".join(w)] if w else [])
    hashes, mask, out = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles], 2**64 - 1, []
    for k in range(prints):
        ones = Counter()
        for h in hashes:
            if k:
                h = (h + 0x9E3779B97F4A7C15 * k) & mask
                h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & mask
                h = (h ^ h >> 27) * 0x94D049BB133111EB & mask
                h ^= h >> 31
            ones.update(b for b in range(64) if h >> b & 1)
        out.append(sum(1 << b for b, n in ones.items() if n * 2 > len(shingles)))
    return out


def brute_sketch_components(sketches, bits=5):
    """{key: smallest key reachable}, of all pairs of which one print differs by few bits and all by no more than of similar texts."""
    parent = {k: k for k in sketches}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(sorted(sketches), 2):
        d = [(x ^ y).bit_count() for x, y in zip(sketches[a], sketches[b], strict=True)]
        if min(d) <= bits and sum(d) <= simhash.bits_of(0.8, 64 * len(d)):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {k: find(k) for k in sketches}


def brute_components(prints):
    parent = {k: k for k in prints}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {k: find(k) for k in prints}


def test_simhash_of_the_table(spark, docs):
    rows = queries.op10_simhash_vp_trees(spark, SF).collect()
    prints = {r["doc_id"]: brute_fingerprint(r["text"]) for r in docs.collect()}
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {k: f"{p:016x}" for k, p in prints.items()}
    assert {r["doc_id"]: r["component_id"] for r in rows} == brute_components(prints)


@pytest.mark.parametrize("limits", [{}, {"leaf_rows": 8}, {"leaf_rows": 32, "shard_rows": 20}])
def test_links_equal_all_pairs(spark, limits):
    random = np.random.default_rng(9)
    prints = [int(x) for x in random.integers(0, 2**63, 300)]
    for x in prints[:60]:
        for _ in range(4):
            for b in random.integers(0, 64, random.integers(1, 5)):
                x ^= 1 << int(b)
            prints.append(x)
    prints = {i: p for i, p in enumerate(sorted(set(prints)))}
    df = spark.createDataFrame([(int(np.array(p, np.uint64).view(np.int64)),) for p in prints.values()], "fp long")
    roots = {np.int64(r["node"]).view(np.uint64).item(): np.int64(r["root"]).view(np.uint64).item() for r in simhash.components(simhash.links(df, **limits)).collect()}
    want = brute_components(prints)
    groups = defaultdict(set)
    for i, root in want.items():
        groups[root].add(prints[i])
    got = defaultdict(set)
    for p in prints.values():
        got[roots.get(p, p)].add(p)
    assert {frozenset(x) for x in got.values()} == {frozenset(x) for x in groups.values()}


def test_no_group_holds_over_two_chunks(spark):
    """One crowded shard: every pair of residents, and of a resident and a visitor, meets once and in groups of two chunks."""
    random = np.random.default_rng(11)
    fps = np.unique(random.integers(-(2**62), 2**62, 1500))
    rows = [(7, int(f), bool(i % 3 == 0)) for i, f in enumerate(fps)] + [(8, int(f), bool(i)) for i, f in enumerate(fps[:20])] + [(9, int(f), True) for f in fps[:450]]
    placed = spark.createDataFrame(rows, "shard long, fp long, visitor boolean")
    got = simhash.in_pairs(placed, 100).collect()
    groups = defaultdict(list)
    for r in got:
        groups[r["shard"], r["a"], r["b"]].append((r["fp"], r["resident"]))
    assert max(len(g) for k, g in groups.items() if k[0] == 7) < 330 and len([k for k in groups if k[0] == 7]) == 10 * 11 // 2 + 10 * 5
    met = {(7, frozenset((a, b))) for k, g in groups.items() if k[0] == 7 for a, resident in g if resident for b, _ in g if a != b}
    visitor = {f: v for s, f, v in rows if s == 7}
    assert met == {(7, frozenset((a, b))) for a, b in itertools.combinations(visitor, 2) if not (visitor[a] and visitor[b])}
    assert sorted(groups[8, 0, 0]) == sorted((f, not v) for s, f, v in rows if s == 8)


def test_several_fingerprints_link_more(spark):
    random = np.random.default_rng(13)
    texts = {}
    for i in range(60):
        w = [f"w{x}" for x in random.integers(0, 5000, 300)]
        texts[3 * i] = " ".join(w)
        for k, share in ((1, 0.01), (2, 0.2)):  # a near copy, and a text that has half of its words
            texts[3 * i + k] = " ".join("other" if random.random() < share else x for x in w)
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sketches = {k: brute_sketch(t) for k, t in texts.items()}
    of = brute_sketch_components(sketches)
    assert all(np.array_equal(simhash.fingerprints(t, 5, 8), np.array(sketches[k], np.uint64)) for k, t in list(texts.items())[:30])
    kept = {r["doc_id"] for r in simhash.keep_one(d, prints=8, shingle=5, max_bits=5).collect()}
    assert kept == {k for k in texts if of[k] == k}
    assert len({3 * i + 1 for i in range(60)} - kept) >= 50 and {3 * i + 2 for i in range(60)} <= kept
    assert len({3 * i + 1 for i in range(60)} - {r["doc_id"] for r in simhash.keep_one(d).collect()}) < 45


def test_simhash_edges(spark, edge):
    rows = {(r["doc_id"], r["component_id"]) for r in simhash.near_groups(edge).collect()}
    assert rows >= {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 6)}
    edge = edge.selectExpr("*", "16 as _hash", "17 as _id", "18 as _gone_id")
    kept = simhash.keep_one(edge)
    assert kept.columns == edge.columns and {r["doc_id"] for r in kept.collect()} == {1, 4, 6, None} and kept.count() == 4
    assert simhash.keep_one(edge, prints=2).count() == 4
    several = simhash.keep_one(edge, prints=3, shingle=5, max_bits=5)
    assert several.columns == edge.columns and sorted(map(repr, several.collect())) == sorted(map(repr, kept.collect()))
    assert simhash.near_groups(edge.limit(0)).count() == 0 and simhash.keep_one(edge.limit(0), prints=3).count() == 0


def test_one_of_each_group_stays_whatever_the_ids(spark):
    """A row that is redundant takes no row of another group along that has the same id, or none."""
    prose = lambda n: " ".join(f"{'abcdefghij'[n]}{i * (n + 3) % 101}" for i in range(60))
    rows = [(3, prose(1)), (5, prose(1)), (5, prose(2)), (None, prose(1)), (None, prose(3)), (None, prose(4)), (7, prose(5)), (7, prose(6)), (7, prose(6)), (None, prose(3))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    kept = Counter((r["doc_id"], r["text"]) for r in simhash.keep_one(d).collect())
    assert kept == Counter([(3, prose(1)), (5, prose(2)), (None, prose(3)), (None, prose(4)), (7, prose(5)), (7, prose(6))])
