"""URL filters, quality, HTML extraction and token counts."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pytest

from affinity.llm import html_text, quality, queries, token_counts, url_filter
from tests.conftest import SMALL, TABLES

CASES = [None, "", " \t\n ", "word", "Ünïcode ﬁ 中文 😀 \x00", "same same same", "A" * 30_000, "lorem ipsum " * 20_000, "  two  spaces ", "\nline\n\nline "]


def documents(spark, texts=CASES):
    """With columns whose names the operators use themselves."""
    rows = [(k, t, "en", "n", "x", 1, 2) for k, t in enumerate(texts)] + [(0, texts[0], "en", "n", "x", 1, 2), (None, "no id", None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, id string, n long, row int")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


# --- URL filters


def test_urls_match_sql(spark, db):
    got = sorted(map(tuple, queries.op4_url_filter(spark, SMALL).select("page_id", "host", "path", "rule", "verdict", "pattern").collect()), key=str)
    assert got == sorted(db.sql("SELECT page_id, host, path, rule, verdict, pattern FROM (" + queries.oracle_sql()["op4_url_filter"] + ")").fetchall(), key=str)


URLS = [
    ("https://A.Example.COM/en/7817?x", "a.example.com", "/en/7817", "example.com/en/7", "allow"),
    ("http://b.com/en/8", "b.com", "/en/8", "com/en/", "block"),
    ("http://com/en/", "com", "/en/", "com/en/", "block"),
    ("http://xcom/en/", "xcom", "/en/", None, "allow"),
    ("http://example.net/de/8", "example.net", "/de/8", "example.net/de/8", "block"),
    ("http://example.net/de/9#f", "example.net", "/de/9", "net/de/", "allow"),
    ("http://m.casino-win.example.com/fr/", "m.casino-win.example.com", "/fr/", None, "block"),
    ("http://m.casino-win.example.com/en/7", "m.casino-win.example.com", "/en/7", "example.com/en/7", "allow"),
    ("http://casinos.org/", "casinos.org", "/", None, "allow"),
    ("http://a.org", "a.org", "", None, "allow"),
    ("http://ÀB.org?q=1/2", "Àb.org", "", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("", "", "", None, "allow"),
]


def test_rules_run_without_python(spark):
    from affinity.llm.common import table

    plan = queries.op4_url_filter(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "ExistingRDD", "Arrow", "Pandas"))
    rules = url_filter.SITE_RULES + url_filter.PATTERN_RULES
    pages = table(spark, SMALL, "pages")
    assert sorted(map(str, url_filter.judge(pages, url_filter.rule_table(spark, rules)).collect())) == sorted(map(str, url_filter.judge(pages, rules).collect()))


PATTERNS = [("||ads.example.com^", "http://x.ads.example.com/a", True), ("||ads.example.com^", "http://bads.example.com/a", False), ("/banner/*/img^", "http://a.b/banner/7/img?x", True), ("/banner/*/img^", "http://a.b/banner/7/imgs", False), ("|a.b/c|", "http://a.b/c", True), ("|a.b/c|", "http://a.b/cd", False)]


@pytest.mark.parametrize("text,url,fits", PATTERNS)
def test_pattern_syntax(spark, text, url, fits):
    rule = url_filter.pattern_rule(text)
    df = spark.createDataFrame([(1, url)], "page_id long, url string")
    row = url_filter.judge(df, [rule]).first()
    assert (row["pattern"] == text) == fits and (row["verdict"] == "block") == fits


def test_rules_without_tokens_are_refused(spark):
    with pytest.raises(ValueError):
        url_filter.rule_table(spark, [url_filter.pattern_rule("*x*")])


def test_url_cases(spark):
    rows = [(k, u, "rule", "t") for k, (u, *_) in enumerate(URLS)] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, rule string, token string")
    got = url_filter.judge(df, url_filter.SITE_RULES + url_filter.PATTERN_RULES).orderBy("page_id").collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == URLS[r["page_id"]][1:]
        assert r["candidates"] <= 6
    assert url_filter.judge(df.limit(0), url_filter.SITE_RULES).count() == 0
    assert {r["verdict"] for r in url_filter.judge(df, []).collect()} == {"allow"}
    with pytest.raises(ValueError):
        url_filter.judge(df, [url_filter.Rule("x", "pattern", "block", ".", (), 1)])


# --- quality


def test_quality_held_out(spark):
    from affinity.llm.common import table

    sf = SMALL.replace("sf0.001", "sf0.01")
    got = queries.op5_quality(spark, sf).join(table(spark, sf, "labels"), "doc_id").filter("held_out").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.97 and got["score"].between(0, 1).all()
    assert queries.op5_quality(spark, sf).count() == 1000


def test_quality_cases(spark):
    docs = documents(spark, CASES + ["good text of words"] * 3 + ["BAD!! BAD!!"] * 3)
    labels = spark.createDataFrame([(10, 1, 0), (11, 1, 0), (13, 0, 0), (14, 0, 1), (15, None, 0), (999, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.learn(docs, labels)
    got = docs.select("doc_id", quality.scorer(docs, model).alias("score")).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[12] > by[15]
    for none in (labels.limit(0), labels.filter("quality = 1")):
        assert quality.learn(docs, none).weights.sum() == 0
    assert docs.limit(0).select(quality.scorer(docs, model).alias("s")).count() == 0


def test_long_training_texts_count_whole(spark):
    long, short = " ".join(f"w{k}" for k in range(20_000)), "BAD!! BAD!! few"
    docs = spark.createDataFrame([(0, long), (1, short)], "doc_id long, text string")
    model = quality.learn(docs, spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int"))
    x = np.setdiff1d(quality.features(long), quality.features(short))
    unseen = np.setdiff1d(np.arange(1 << quality.BITS), np.union1d(x, quality.features(short)))
    assert len(x) > 10_000 and not np.isin(model.squares[x], model.squares[unseen]).any()


def test_against_plain_nb_svm():
    """Log-count ratios by counting, and the hinge-loss optimum by plain sweeps over dense rows."""
    r = np.random.default_rng(1)
    words = [f"w{k}" for k in range(40)]
    texts = [" ".join(r.choice(words[: 25 + 15 * (k % 2)], 12)) for k in range(50)]
    y = np.arange(50) % 2
    sets = [set(quality.features(t).tolist()) for t in texts]
    size = 1 << quality.BITS
    up, down = np.ones(size), np.ones(size)
    for s, label in zip(sets, y):
        for f in s:
            (up if label else down)[f] += 1
    want = np.log(up / up.sum()) - np.log(down / down.sum())
    got = quality._ratios([quality.features(t) for t in texts], y * 2 - 1)
    assert np.abs(got - want).max() < 1e-12
    used = sorted(set().union(*sets))
    place = {f: k for k, f in enumerate(used)}
    x = np.zeros((50, len(used) + 1))
    for row, s in zip(x, sets):
        for f in s:
            row[place[f]] = want[f]
        row /= np.linalg.norm(row)
        row[-1] = 1  # the bias
    sign, alpha = y * 2.0 - 1, np.zeros(50)
    gram = (x @ x.T) * np.outer(sign, sign)
    for _ in range(3000):
        for i in range(50):
            alpha[i] = min(max(alpha[i] - (gram[i] @ alpha - 1) / gram[i, i], 0), 1.0)
    plain = x.T @ (alpha * sign)
    rows = [quality.features(t) for t in texts]
    values = [want[f] / np.linalg.norm(want[f]) for f in rows]
    w, b = quality.descend(rows, values, sign, np.ones(50), size, epochs=3000)
    assert np.abs(w[used] - plain[:-1]).max() < 2e-3 and abs(b - plain[-1]) < 2e-3


def test_descent_separates():
    r = np.random.default_rng(0)
    x = r.normal(size=(60, 5))
    y = np.where(x[:, 0] + 0.3 > 0, 1.0, -1.0)
    rows = [np.arange(5)] * 60
    w, b = quality.descend(rows, list(x), y, np.full(60, 10.0), 5, epochs=200)
    assert ((x @ w + b > 0) == (y > 0)).all()


# --- HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><p>no</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><a href=x>Menu</a></nav><div id="cookieNotice">We use cookies and all that is of use to the site and to you, as you may know by now.</div>
{open}<h1>Title &amp; more</h1><p>The first part of the text is about the cat and the dog that were in the house of the man who was not at home.<br>It goes&nbsp;on.
<p><b>Short one.<p>And this is the second part, in which the dog is out of the house and the cat has it all to herself for the day.</p>
<div class="ad-slot">Buy the best of the things that are in the shop, and more of it, for you and for all of us.</div>
<ul><li>The list of it has what is to be said of the first of the points that were made here and there.</ul>
<!-- <p>comment of the page</p> --><form><label>Your name is to be put in here</label><input></form>{close}
<aside>The side of it all is here for you to see and to read at the end of the day.</aside>
<section class="comments"><p>I think that this is the best of the texts that I have read on it, and it was good.</p></section>
<footer>&copy; the site and all of its makers, who are to be thanked for it.</footer></body></html>"""
WANT = ["Title & more", "The first part of the text is about the cat and the dog that were in the house of the man who was not at home. It goes on.", "Short one.", "And this is the second part, in which the dog is out of the house and the cat has it all to herself for the day.", "The list of it has what is to be said of the first of the points that were made here and there."]


@pytest.mark.parametrize("tags", [("<article>", "</article>"), ("<main>", "</main>"), ("<div>", "</div>")])
def test_main_text(tags):
    assert html_text.main_text(PAGE.format(open=tags[0], close=tags[1])).split("\n") == WANT


@pytest.mark.parametrize("tag", ["article", "main"])
@pytest.mark.parametrize("around", ['<div class="has-sidebar">', '<div id="page" class="menu-open">', '<div class="has-sidebar"><main><div id="search-page">'])
def test_marks_of_what_holds_the_article(tag, around):
    card = '<div class="related"><article><p>More of the texts that are on the site and that you may want to read in the time to come.</p></article></div>'
    page = PAGE.format(open=f"{around}{card}<{tag}>", close=f"</{tag}>{card}").replace("</body>", "</div></body>")
    assert html_text.main_text(page).split("\n") == WANT
    assert html_text.main_text(f'<div class="comments"><{tag}><p>I think that this is the best of the texts that I have read on it, and it was good.</p></{tag}></div>') == ""


LONG = "<p>This is the first of the paragraphs of the article and it is long enough to tell that it is text, as it has many of the words that are in all texts.</p>"
KEPT = [
    "<p>© 2020 is what the first of the notes said to all who had read it.</p>",
    '<p><a href="/x">The whole report on it is here</a></p>',
    '<div class="form-factor">The form factor of the device is small and it is light.</div>',
    "<figure><figcaption>A view of the sea</figcaption></figure>",
    '<section id="search-engines"><p>Engines for search are the next of the themes.</p></section>',
]
DROPPED = [
    '<div class="ad">Buy the best of the shoes now.</div>',
    '<ul class="share"><li><a href=x>Tweet</a></li></ul>',
    '<ul><li><a href=1>One more link</a></li><li><a href=2>Two more links</a></li></ul>',
    '<div id="comments"><p>I think that it is the best of the texts that I have read.</p></div>',
    '<section class="search"><p>Suchbegriff eingeben</p></section>',
]


@pytest.mark.parametrize("tag", ["article", "div"])
@pytest.mark.parametrize("block", KEPT + DROPPED)
def test_blocks_within(block, tag):
    text = html_text.main_text(f"<nav><a>Home</a></nav><{tag}>{LONG}{block}{LONG}</{tag}><footer>x</footer>")
    assert text.count("\n") == 1 + (block in KEPT)


def test_first_pass_decides_within_articles():
    found = html_text.blocks("<article><p>Short.</p>" + LONG + "<ul><li><a>One</a> <a>Two</a></li></ul></article>")
    assert [html_text.first_pass(b) for b in found] == [None, True, False]


@pytest.mark.parametrize("part", ["<b>x", "<div>x", '<div class="ad">x', "<article>x", "<h1>x", "<a '", "<i><b>x</i>"])
def test_time_is_linear(part):
    import time

    began = time.process_time()
    html_text.main_text(part * (300_000 // len(part)))
    html_text.main_text("<div>" + "<b>" * 50_000 + "<p>x</p>" * 20_000)
    assert time.process_time() - began < 8


def test_pages_without_their_article_tag(spark):
    from affinity.llm.common import table

    for r in table(spark, SMALL, "pages").collect():
        plain = r["html"].replace("<article>", "<div>").replace("</article>", "</div>")
        assert html_text.main_text(plain) == html_text.main_text(r["html"])


BIG = [2**53 + 1, None, 2**53 + 3]


def test_large_ids_beside_a_missing_one(spark):
    df = spark.createDataFrame([(i, "u", "<p>x y z</p>", "x y z") for i in BIG], "page_id long, url string, html string, text string").coalesce(1)
    assert {r["page_id"] for r in html_text.extract(df).collect()} == set(BIG)
    assert {r["page_id"] for r in token_counts.count_tokens(df, {"x": 1.0}, 5, id_col="page_id").collect()} == set(BIG)


def test_second_pass():
    assert html_text.second_pass([True, None, True, None, None, False], [False] * 6, False) == [True, True, True, True, False, False]
    assert html_text.second_pass([None, None], [True, False], None) == [True, False]
    assert html_text.second_pass([None, True, None], [False] * 3, False) == [False, True, False]
    assert html_text.second_pass([], [], False) == []


def test_pages(spark):
    odd = [None, "", "plain text", "<p>unclosed <b>bold", "<", "<p", "</p></p>", "<script>never closed", "<!-- open", "a &lt; b &#65; &bogus;", "<p>" + "long and of the text " * 20_000 + "</p>", "<p>\x00</p>"]
    df = spark.createDataFrame([(k % 11, "u", h, "t", 1) for k, h in enumerate(odd)], "page_id long, url string, html string, text string, id int")
    got = html_text.extract(df).collect()
    assert len(got) == len(odd) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert max(r["n_chars"] for r in got) == len("long and of the text " * 20_000) - 1
    assert html_text.extract(df.limit(0)).count() == 0


def test_articles_are_whole(spark):
    """On the given pages the text is the article's blocks and nothing else."""
    import html
    import re

    from affinity.llm.common import table

    pages = {r["page_id"]: r["html"] for r in table(spark, SMALL, "pages").collect()}
    for r in queries.op6_html_text(spark, SMALL).collect():
        page = pages[r["page_id"]]
        article = page[page.index("<article>") + 9 : page.index("</article>")].replace("<br>", " ")
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(p for p in parts if p)


# --- token counts


@pytest.fixture(scope="module")
def model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path())


def test_every_prefix(model):
    counter = token_counts.PrefixCounter(token_counts.vocabulary(queries.tokenizer_path()))
    r = random.Random(5)
    texts = ["the   cat\n\n sat", " a", "\n", "▁x ▁", "<s>the</s>", *("".join(r.choice("abethe in\n\t  ▁é😀ç|!．<s>　\x00中the") for _ in range(r.randint(1, 40))) for _ in range(300))]
    for t in texts:
        want = [len(model.encode(t[:k])) for k in range(1, len(t) + 1)]
        table = counter.table(t)
        assert np.cumsum(table, dtype=int).tolist() == want
        assert token_counts.count_at(table, len(t)) == want[-1] and token_counts.count_at(table, 0) == 0
        for budget in (0, 1, 3, 10_000):
            k = token_counts.longest_within(table, budget)
            assert k == max([i + 1 for i, n in enumerate(want) if n <= budget], default=0)


def test_counts(spark, model):
    docs = documents(spark)
    got = token_counts.count_tokens(docs, token_counts.vocabulary(queries.tokenizer_path()), 100).collect()
    assert len(got) == docs.count()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in got:
        t = texts[r["doc_id"]]
        assert (r["n_tokens"], r["n_bytes"]) == (len(model.encode(t)), len(t.encode())) and len(r["prefix_table"]) == len(t)
        assert len(model.encode(t[: r["fits_chars"]])) <= 100
    assert token_counts.count_tokens(docs.limit(0), {"a": 1.0}, 5).count() == 0


def test_query_counts(spark, model):
    from affinity.llm.common import table

    texts = {r["doc_id"]: r["text"] for r in table(spark, SMALL, "documents").collect()}
    assert all(r["n_tokens"] == len(model.encode(texts[r["doc_id"]] or "")) for r in queries.op8_token_counts(spark, SMALL).collect())
