"""Bit-sliced search, main text of pages and benchmark hits against brute force."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from understory.llm import bitsliced
from understory.llm.bitsliced import top_k
from understory.llm.decontaminate import benchmark_hits, contaminated
from understory.llm.html_text import extract_text, main_text

VECTORS = "vec_id bigint, embedding array<float>, rank int, id string"


def test_top_k_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(bitsliced, "BLOCK_ROWS", 64)
    monkeypatch.setattr(bitsliced, "QUERY_ROWS", 3)
    rng = np.random.default_rng(0)
    vectors = [np.round(rng.normal(0, 0.3, 6), 1).astype(np.float32).tolist() for _ in range(300)]  # many ties
    rows = [(k, v, 1, "x") for k, v in enumerate(vectors)]
    rows += [(900, vectors[5], 1, "x"), (1000, [0.0] * 6, 1, "x"), (1100, None, 1, "x"), (1200, [None] + [0.1] * 5, 1, "x"),
             (1300, [math.nan] * 6, 1, "x"), (1400, [math.inf] + [0.1] * 5, 1, "x"), (None, vectors[1], 1, "x")]
    got = {}
    for r in top_k(spark.createDataFrame(rows, VECTORS).repartition(5), F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    whole = {k: [math.floor(1024 * float(np.float32(x))) for x in v] for k, v, *_ in rows
             if k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    assert set(got) == {k for k in whole if k % 100 == 0}
    for q, hits in got.items():
        want = sorted((-sum(a * b for a, b in zip(whole[q], v)), k) for k, v in whole.items() if k != q)[:10]
        assert sorted(hits) == [(n, k, -s) for n, (s, k) in enumerate(want, 1)]


def test_partitions_of_any_size_are_searched(spark, monkeypatch):
    monkeypatch.setattr("understory.llm.bitsliced.BLOCK_ROWS", 64)
    df = spark.range(500).selectExpr("id AS vec_id", "array(CAST(id AS FLOAT), 1F) AS embedding")
    monkeypatch.setattr(type(df), "repartition", lambda self, n: self.coalesce(1))  # all rows in one partition
    got = top_k(df, F.col("vec_id") == 100, k=3, scale=1).orderBy("rank").collect()
    assert [(r["rank"], r.id, r.score) for r in got] == [(1, 499, 49901), (2, 498, 49801), (3, 497, 49701)]


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0], 1, "x"), (7, [2.0], 1, "x"), (8, [-3.0], 1, "x")], VECTORS)
    got = sorted((r["rank"], r.id, r.score) for r in top_k(df, F.col("vec_id") % 100 == 0).collect())
    assert got == [(1, 7, 1024 * 2048), (2, 8, -3072 * 1024)]
    assert top_k(df.limit(0), F.lit(True)).count() == 0


PARAGRAPH = "A sentence of some length, with a comma, which goes on for a while and then ends. " * 3


@pytest.mark.parametrize(("page", "want"), [
    (None, ""), ("", ""), ("<html><body><nav><a href='/'>Home</a></nav></body></html>", ""),
    (f"<body><div class='menu'><ul><li><a>Home</a><li><a>News</a></ul></div><div id='content'><h2>Title &amp; more</h2><p>{PARAGRAPH}<p>Short.<br>Line</div>"
     f"<div class='sidebar'><p>{PARAGRAPH}</p></div><div class='comments'><p>{PARAGRAPH}</p></div><div class='cookie-notice'>We use cookies, a lot.</div></body>",
     "Title & more\n" + PARAGRAPH.strip() + "\nShort. Line"),
    (f"<article><header><h1>Head</h1></header><p>{PARAGRAPH}</p><form><input value=x><p>Sign up, now</p></form><aside>More, more</aside>"
     f"<p>Five &lt; six &eacute; &#8364; &#x41;</p><script>var a = '<p>no</p>';</script><style>p{{}}</style><!-- <p>no</p> --></article><footer>Foot</footer>",
     f"Head\n{PARAGRAPH.strip()}\nFive < six é € A"),
    (f"<div class='page has-sidebar'><main><p>{PARAGRAPH}</p><ul><li>one<li>two</ul><table><tr><td>a<td>b</table></main></div>",
     f"{PARAGRAPH.strip()}\none\ntwo\na\nb"),
    ("<article><h1>Only</h1><p><b>Text here, cut of", "Only\nText here, cut of"),
    (f"<article><p>{PARAGRAPH}</p><section id='comments'><article class='comment'><p>{PARAGRAPH * 4}</p></article></section></article>", PARAGRAPH.strip()),
    (f"<article><p>1 < 2 and <b>bold</b>\n\t text</p><div class=ad><p>Buy, buy, buy</p></div><p>{PARAGRAPH}</p></article>", f"1 < 2 and bold text\n{PARAGRAPH.strip()}"),
])
def test_main_text(page, want):
    assert main_text(page) == want


@pytest.mark.parametrize(("page", "want"), [
    (f"<html><body>{PARAGRAPH}<br><br>And <b>more</b>, in the end.</body></html>", f"{PARAGRAPH.strip()} And more, in the end."),
    ("Plain text, no tags.", "Plain text, no tags."),
    ("<body><a href='/'>Home</a> <a href='/n'>News</a></body>", ""),
    (f"<article><p>{PARAGRAPH}</p></article><article><h2>Two</h2><p>Short, but of the story.</p></article><article class='related'><p>{PARAGRAPH}</p></article>"
     f"<article class='comment'><p>{PARAGRAPH}</p></article>", f"{PARAGRAPH.strip()}\nTwo\nShort, but of the story."),
    (f"<main><article><p>{PARAGRAPH}</p></article></main><p>{PARAGRAPH}</p><p>Short.</p><aside>{PARAGRAPH}</aside>", f"{PARAGRAPH.strip()}\n{PARAGRAPH.strip()}"),
    (f"<article><p>{PARAGRAPH}</p></article>Then, <i>bare</i> text: {PARAGRAPH}<div class='sidebar'>{PARAGRAPH}</div><a href='/'>{PARAGRAPH}</a>",
     f"{PARAGRAPH.strip()}\nThen, bare text: {PARAGRAPH.strip()}"),
    (f"<div class='content'><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></div><b>Beside</b> it: {PARAGRAPH}", f"{PARAGRAPH.strip()}\n{PARAGRAPH.strip()}\nBeside it: {PARAGRAPH.strip()}"),
])
def test_main_text_beside_the_best_container(page, want):
    assert main_text(page) == want


def test_deep_and_long_pages():
    assert main_text("<div>" * 20000 + "<p>" + PARAGRAPH + "</p>") == PARAGRAPH.strip()
    long = "".join(f"<p>Paragraph {k}, with text.</p>" for k in range(20000))
    assert main_text(f"<article>{long}</article>").count("\n") == 19999
    assert main_text("<" * 5000) is not None and main_text('<p class="' * 3000) is not None


def test_pages_table(spark):
    df = spark.createDataFrame([(1, "u", f"<article><p>{PARAGRAPH}</p></article>", 3, "t"), (1, None, None, 3, "t")], "page_id bigint, url string, html string, n_chars int, text string")
    got = sorted(map(tuple, extract_text(df).collect()), key=repr)
    assert got == [(1, "u", PARAGRAPH.strip(), len(PARAGRAPH.strip())), (1, None, "", 0)] or got == [(1, None, "", 0), (1, "u", PARAGRAPH.strip(), len(PARAGRAPH.strip()))]
    assert extract_text(df.limit(0)).count() == 0


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, span):
    w, hit, names = words(text), set(), set()
    for name, other in items:
        v = words(other)
        n = min(span, len(v))
        grams = {tuple(v[i:i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i:i + n]) in grams:
                hit |= set(range(i, i + n))
                names.add(name)
    return len(w), len(hit), sorted(names)


@pytest.mark.parametrize(("span", "block_words"), [(13, 1 << 20), (7, 40)])
def test_hits_as_brute_force(spark, span, block_words):
    rng = random.Random(span)
    vocab = ["Alpha", "beta", "Gämma", "d1", "e", "f_g", "日本", "x-y"]
    items = [(str(k), " ".join(rng.choices(vocab, k=rng.randint(0, 30)))) for k in range(25)] + [("90", "e " * 40), ("91", "one"), ("92", None)]
    docs = []
    for k in range(60):
        parts = [rng.choices(vocab, k=rng.randint(0, 25)) for _ in range(3)]
        if rng.random() < 0.7:
            parts.insert(1, (rng.choice(items)[1] or "").split())
        docs.append((k, rng.choice([" ", ", ", "\n"]).join(x for p in parts for x in p)))
    docs += [(100, None), (101, ""), (102, "e " * 3000), (103, "...!")]
    df = spark.createDataFrame([(*d, 1, "z") for d in docs], "doc_id bigint, text string, n_hit int, keep string").repartition(3)
    bench = spark.createDataFrame([(int(k), t, "c") for k, t in items] + [(None, "beta", "c")], "item_id bigint, text string, n_words string")
    got = {r.doc_id: r for r in benchmark_hits(df, bench, span, block_words=block_words).withColumn("bad", contaminated()).collect()}
    assert len(got) == len(docs)
    for k, t in docs:
        n, hit, names = brute(t, items, span)
        r = got[k]
        assert (r.n_words, r.n_hit, r["items"], r.bad) == (n, hit, names, hit > 0 and 20 * hit >= n) and r.keep == "z"


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert benchmark_hits(docs, bench).first().n_hit == 0 and benchmark_hits(docs.limit(0), bench).count() == 0


def test_deep_inline_and_unclosed_markup():
    lines = "".join(f"<font size=2>Item {k}, of a list that is long enough.<br>" for k in range(1500))
    assert main_text(f"<body>{lines}</body>").count("Item") == 1500
    deep = "<b><i>" * 900 + PARAGRAPH + "</i></b>" * 900
    assert main_text(f"<body><p>{deep}</p></body>") == PARAGRAPH.strip()


def test_closed_drawings_lose_nothing():
    page = f"<body><div><p>{PARAGRAPH}</p><svg/><math /><p>Second. {PARAGRAPH}</p><svg><text>no</text></svg></div></body>"
    assert main_text(page) == PARAGRAPH.strip() + "\nSecond. " + PARAGRAPH.strip()


def test_a_form_around_the_page_is_no_form():
    inner = f"<div id=content><p>{PARAGRAPH}</p><p>More. {PARAGRAPH}</p><p>{PARAGRAPH}</p></div>"
    want = "\n".join([PARAGRAPH.strip(), "More. " + PARAGRAPH.strip(), PARAGRAPH.strip()])
    for form in ("<form id='aspnetForm' action='x'>", "<form>"):
        assert main_text(f"<body>{form}<input type=hidden name=state>{inner}<input type=submit></form></body>") == want
    asked = "<form><label>Your name, please</label><input><label>Your message to us</label><textarea></textarea><button>Send</button></form>"
    assert main_text(f"<body>{asked}{inner}</body>") == want
    survey = "<form>" + "".join(f"<p>Question {k}, which you should answer?</p><input><input>" for k in range(40)) + "</form>"
    assert "Question" not in main_text(f"<body>{survey}{inner}</body>")


def test_stray_end_tags_take_linear_time():
    import time

    def took(n):
        start = time.perf_counter()
        main_text("<div>" * n + "</section>" * n + f"<p>{PARAGRAPH}</p>")
        return time.perf_counter() - start

    took(500)
    assert took(16_000) < 40 * max(took(2_000), 0.004)


def test_broken_markup_never_raises():
    rng = random.Random(8)
    bits = ["<p>", "</p>", "<div class='ad'>", "</div>", "<b>", "<a href=x>", "</a>", "<form>", "</form>", "<table><tr><td>", "</table>", "<li>", "<svg/>", "<script>",
            "</script>", "<", "&amp", "&#x41;", "text, more text. ", "<!--", "-->", "<header>", "<article>", "</article>", "<h1>", "<h2>", "<option>", "\x00", "<br/>", "</x>"]
    for _ in range(400):
        got = main_text("".join(rng.choices(bits, k=rng.randint(0, 120))))
        assert got == got.strip() and "\n\n" not in got
