"""Operators 1, 2, 8, 9: encoding, extraction, scoring and URL rules."""

import hashlib
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from kgflow.llm import op01_bpe, op02_html_extraction, op08_quality_gam, op09_url_filters
from kgflow.llm.common import Scratch, table

TEXTS = [
    "", None, " ", "\n", " a", "a ", "a  b", "a   b", "a\n\nb", "a \n b\t c\r\nd", "<|endoftext|>", "a <|endoftext|> b", "x\0y \0 z", "don't we'll",
    "naïve café", "日本語 テキスト", "a b c", "🙂 ok  🙂", "\x1c a \x1d b", "1 23 456", "z" * 5000, "word " * 3000, "same", "same",
]


def _expected(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(",".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False))


def test_bpe_equals_the_library(spark):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice([" ", "\n", "a", "b1", "  ", "\t", "é", "'s", ".", "<|endoftext|>", "\0"]) for _ in range(rng.randint(1, 14))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumnRenamed("ids", "ids")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op01_bpe.digests(op01_bpe.bpe_round_trip(df)).collect()}
    tokenizer = op01_bpe.load(op01_bpe.default_path())
    assert got == {i: _expected(tokenizer, t) for i, t in enumerate(texts)}


def test_bpe_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, ids string, block string")
    assert op01_bpe.bpe_round_trip(empty).collect() == []
    one = spark.createDataFrame([(None, "hi", "x", "y"), (4, None, None, None), (4, "hi", "", ""), (4, "hi", "", "")], empty.schema)
    rows = sorted((r.doc_id or 0, r.decoded, len(r.ids)) for r in op01_bpe.bpe_round_trip(one).collect())
    assert rows == [(0, "hi", 1), (4, "", 0), (4, "hi", 1), (4, "hi", 1)]
    with Scratch(spark) as scratch:
        assert op01_bpe.bpe_round_trip(one, scratch=scratch).count() == 4
        name = next(iter(scratch.paths.values()))
        assert spark.catalog.tableExists(name)
    assert not spark.catalog.tableExists(name)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site name</header><nav><a href=x>Home</a></nav>
<div class="cookie-notice">We use cookies</div><article class="post"><h1>A &amp; B</h1><p>First <b>pa</b>ra&nbsp;one<br>two.
<p>Second para &lt;tag&gt; here.<div class="ad">Buy now</div><ul><li>one<li>two</ul><form><label>x</label><input></form>
<section id="comments"><p>Reader says hello</p></section></article><aside>side</aside><footer>f &copy;</footer></body></html>"""


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (PAGE, "A & B First para one two. Second para <tag> here. one two"),
        ("<body><div id='menu'><a href=1>a</a></div><div><h2>Title</h2><p>Some long paragraph of words.</p></div><div class='sidebar'>x y</div></body>", "Title Some long paragraph of words."),
        (None, ""), ("", ""), ("<nav>only a menu</nav>", ""), ("plain text < 5 &amp more", "plain text < 5 & more"), ("<p>cut off &am", "cut off &am"),
        ("<script>var t='</p>';</script><p>seen words here</p><!-- hidden", "seen words here"),
    ],
)
def test_extract(page, text):
    assert op02_html_extraction.extract(page, op02_html_extraction.Weights()) == text


def _article(page):
    import html
    import re

    inside = re.sub(r"</?b>", "", page.split("<article>")[1].split("</article>")[0])
    return " ".join(html.unescape(re.sub(r"<[^>]+>", "\n", inside)).split())


def test_extract_pages(spark, sf):
    rows = op02_html_extraction.query(spark, sf).collect()
    pages = {r.page_id: r.html for r in table(spark, sf, "pages").collect()}
    assert {r.page_id: (r.text, r.n_chars) for r in rows} == {i: (t := _article(p), len(t)) for i, p in pages.items()}


def test_extract_by_learned_weights_alone(spark, sf):
    pages = table(spark, sf, "pages")
    hidden = lambda p: p.replace("<article>", "<div>").replace("</article>", "</div>")
    plain = lambda p: p.replace(' class="ad"', "")
    html = [r.html for r in pages.collect()]
    weights = op02_html_extraction.learn(pages)
    assert [op02_html_extraction.extract(hidden(p), weights) for p in html] == [_article(p) for p in html]
    bare = op02_html_extraction.learn(pages.withColumn("html", F.replace("html", F.lit(' class="ad"'), F.lit(""))))
    for made in (plain, lambda p: hidden(plain(p))):
        assert [op02_html_extraction.extract(made(p), bare) for p in html] == [_article(p) for p in html]
    odd = [p.replace('class="ad"', 'class="xq7"') for p in html]  # a class name that no list has
    taught = op02_html_extraction.learn(spark.createDataFrame(list(enumerate(odd)), "page_id long, html string"))
    inner = [hidden(p.replace("<p>", '<span class="xq7">Buy now here</span><p>', 2)) for p in odd]
    assert [op02_html_extraction.extract(p, taught) for p in inner] == [_article(p) for p in html]
    assert taught["c:xq"] < -0.9 and op02_html_extraction.Weights()["c:xq"] == 1


def test_extract_deep_pages():
    """The work is linear in the depth: 100,000 elements in each other, with markers, and what they hold."""
    deep = "".join(f'<div class="box{i % 7} part">' for i in range(100_000)) + "the text " * 30 + "</div>" * 100_000
    weights = op02_html_extraction.Weights({"c:box": (5, 900)})
    assert op02_html_extraction.extract("<p>" + "words of an article " * 50 + "</p>" + deep, weights) == ("words of an article " * 50).strip()
    seen = op02_html_extraction.observed("<article>own text</article>" + deep)
    assert seen["c:box", False] == seen["c:part", False] == 60 and seen["b:article", True] == 2
    _, elements = op02_html_extraction.tokens(deep)
    assert len(elements) == 100_000 and elements[-1].parent is elements[-2]


def test_learning_takes_one_text_of_a_repeated_page(spark):
    page = "<article><p class='lead'>" + "good words " * 30 + "</p></article><div class='zone'>" + "bad words " * 30 + "</div>"
    rows = [(1, page), (1, page.replace("lead", "other")), (2, page)]
    learned = [op02_html_extraction.learn(spark.createDataFrame(r, "page_id long, html string").repartition(3)).counts for r in (rows, rows[::-1])]
    assert learned[0] == learned[1] and learned[0]["c:lead"] == (120, 0) and "c:other" not in learned[0]


def test_extract_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "<p>one two three</p>", "old", 9)], "page_id long, html string, text string, n_chars long")
    weights = op02_html_extraction.learn(df)
    assert [tuple(r) for r in op02_html_extraction.extract_pages(df, weights).select("page_id", "text", "n_chars").collect()] == [(1, "one two three", 13)]
    again = spark.createDataFrame([(1, "<p>one two</p>"), (1, "<p>one two</p>"), (1, None), (2, "<p>" + "word " * 300_000 + "</p>")], "page_id long, html string")
    rows = op02_html_extraction.extract_pages(again, op02_html_extraction.learn(again)).collect()
    assert sorted((r.page_id, r.n_chars) for r in rows) == [(1, 0), (1, 7), (1, 7), (2, 1_499_999)]
    assert op02_html_extraction.extract_pages(df.limit(0), op02_html_extraction.learn(df.limit(0))).collect() == []


def test_best_region_is_the_best_of_all():
    rng = random.Random(1)
    for _ in range(300):
        s = [rng.choice([-3.0, -1.0, 0.5, 1.0, 2.0]) for _ in range(rng.randint(1, 12))]
        a, b = op02_html_extraction.best_region(s)
        assert sum(s[a:b]) == max(0, max(sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)))


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = op08_quality_gam.query(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert np.mean([r.predicted for r in rows if r.quality == 1]) > 0.97


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 2.0), (2, "", 2.0), (3, "a " * 50000, 2.0), (None, "x", 2.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = op08_quality_gam.train(docs, none)
    rows = op08_quality_gam.classify(docs, model).collect()
    assert {r.score for r in rows} == {0.5} and {r.predicted for r in rows} == {1}
    assert op08_quality_gam.classify(docs.limit(0), model).collect() == []


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = op08_quality_gam.fit(x, y)
    assert np.mean((model.score(x) > 0.5) == y) > 0.95


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        (None, "", "", None, "allow"), ("nothing", "", "", None, "allow"), ("http://A.Example.com/en/x?q#f", "a.example.com", "/en/x", "example.com/en/", "block"),
        ("http://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"), ("https://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        ("http://x.net/fr/1", "x.net", "/fr/1", "net/fr/", "block"), ("http://x.net", "x.net", "", None, "allow"), ("http://x.org/" + "a" * 300_000, "x.org", "/" + "a" * 300_000, None, "allow"),
        ("ftp://example.com?en/", "example.com", "", None, "allow"), ("http://x.org/.example.com/en/", "x.org", "/.example.com/en/", None, "allow"),
    ],
)
def test_url_rules(spark, url, host, path, rule, verdict):
    df = spark.createDataFrame([(1, url, "old")], "page_id long, url string, verdict string")
    r = op09_url_filters.url_filter(df).collect()[0]
    assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)


def test_url_filter_with_tables_of_rules(spark):
    import fnmatch

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 4)))
    rules = sorted({(rng.choice(["allow", "block"]), f"{word()}.{word()}", f"/{word()}") for _ in range(2000)}, key=lambda r: r[1:])
    rules = list({r[1:]: r for r in rules}.values())
    globs = [(rng.choice(["allow", "block"]), f"*{word()}{rng.choice(['?', '*', ''])}{word()}*") for _ in range(1000)]
    urls = [(i, f"http://{word()}.{rng.choice(rules)[1]}{rng.choice(rules)[2]}{word()}") for i in range(300)] + [(300, None), (301, "http://" + word())] * 2
    got = op09_url_filters.url_filter(
        spark.createDataFrame(urls, "page_id long, url string"),
        rules=spark.createDataFrame(rules, "verdict string, host string, path string"),
        globs=spark.createDataFrame(globs, "verdict string, glob string"),
    )

    def want(url):
        host, path = (url or "://").split("://")[1], ""
        if "/" in host:
            host, path = host[: host.index("/")], host[host.index("/") :]
        fit = [r for r in rules if ("." + host).endswith("." + r[1]) and path.startswith(r[2])]
        if fit:
            best = min(fit, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
            return best[1] + best[2], best[0]
        hit = {v for v, g in globs if fnmatch.fnmatchcase(f".{host}\0{path}", g)}
        return None, "block" if "block" in hit else "allow"

    rows = got.collect()
    assert len(rows) == 304 and sum(r.rule is not None for r in rows) > 20 and len({r.verdict for r in rows}) == 2
    assert all((r.rule, r.verdict) == want(r.url) for r in rows)
    assert op09_url_filters.url_filter(got.limit(0)).collect() == []


def test_globs_equal_fnmatch():
    import re

    rng = random.Random(5)
    globs = ["".join(rng.choice("ab*?") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    strings = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 12))) for _ in range(200)]
    got = op09_url_filters.GlobAutomaton(globs).match([s.encode() for s in strings])
    for j, g in enumerate(globs):
        pattern = re.compile("".join({"*": ".*", "?": "."}.get(c, c) for c in g) + r"\Z")
        assert [bool(x) for x in got[:, j]] == [bool(pattern.match(s)) for s in strings], g
    assert op09_url_filters.GlobAutomaton(["a"]).match([]).shape == (0, 1)
