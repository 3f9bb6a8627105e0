"""Main text of pages: the given ones by a plain rule, and other markup."""

import re
import time
from html import unescape

import pytest

from tallyframe.llm import html_extract
from tallyframe.llm.html_extract import page_texts

SCHEMA = "page_id long, url string, html string, text string, host string"


def extracted(spark, pages):
    rows = [(i, url, html, "old", "h") for i, (url, html) in enumerate(pages)]
    return {r["page_id"]: (r["text"], r["n_chars"]) for r in page_texts(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    rows = page_texts(pages).collect()
    assert len(rows) == len(html)
    for r in rows:
        whole = html[r["page_id"]]
        article = whole[whole.index("<article>") + 9 : whole.index("</article>")]
        blocks = (" ".join(unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:h1|p)>", article))
        assert r["text"] == "\n\n".join(b for b in blocks if b)


def page(body, title="t"):
    return f"<html><head><title>{title}</title></head><body class='has-sidebar'><nav><a href='/'>Home</a></nav>{body}<footer>&copy; us</footer></body></html>"


ARTICLE = "<article><h1>Head &amp; tail</h1><p>One <b>bold</b>\n word.<p>Two&nbsp;parts{}</article>"
TEXT = "Head & tail\n\nOne bold word.\n\nTwo parts"


@pytest.mark.parametrize("copies", [1, 7])
@pytest.mark.parametrize(
    "inside, around",
    [
        ("", ""),
        ("<!-- <p>no</p> -->", "<div class='ad banner'>Buy</div>"),
        ("<script>var a = '<p>x</p>';</script>", "<aside><p>More</p></aside>"),
        ("<section class='comments'><p>Nice!</p></section>", "<form><label>Search</label><input></form>"),
        ("<div id='related-posts'><ul><li>Other</ul></div>", "<div role='alert'><p>We use cookies</p></div>"),
        ("<aside class='share'>Tweet</aside>", "<section class='comments'><p>I agree</p></section>"),
    ],
)
def test_boilerplate_goes(spark, inside, around, copies):
    pages = [(f"http://one.example/{i}", page(around + ARTICLE.format(inside) + around, f"t{i}")) for i in range(copies)]
    assert {t for t, _ in extracted(spark, pages).values()} == {TEXT}


def test_pages_that_differ_on_one_host(spark):
    bodies = [ARTICLE.format(""), ARTICLE.format("<div class='comments'>" + "<p>me too, really</p>" * 9 + "</div>"), "<div class='ad'>x</div>" + ARTICLE.format("")]
    found = extracted(spark, [(f"http://two.example/{i}", page(b)) for i, b in enumerate(bodies * 3)])
    assert {t for t, _ in found.values()} == {TEXT}


def test_without_an_article(spark):
    found = extracted(spark, [("http://three.example/", page("<div id='content'><p>Plain &lt;text&gt;</p><p>Second</p></div>"))])
    assert found[0][0] == "Plain <text>\n\nSecond"


PLAIN = "<div class='content'><h2>Plain {0}</h2><p>Body of {0}</p></div>"


@pytest.mark.parametrize("articles, plain", [(1, 99), (1, 1), (50, 50), (99, 1)])
@pytest.mark.parametrize("url", ["http://four.example/{}", None])
def test_layouts_of_one_host_are_apart(spark, articles, plain, url):
    bodies = [ARTICLE.format("")] * articles + [PLAIN.format(i) for i in range(plain)]
    found = extracted(spark, [(url and url.format(i), page(b)) for i, b in enumerate(bodies)])
    assert [found[i][0] for i in range(len(bodies))] == [TEXT] * articles + [f"Plain {i}\n\nBody of {i}" for i in range(plain)]


def test_an_article_without_text_is_none(spark):
    found = extracted(spark, [("http://five.example/0", page(ARTICLE.format(""))), ("http://five.example/1", page("<main> </main>" + PLAIN.format(1)))])
    assert [found[0][0], found[1][0]] == [TEXT, "Plain 1\n\nBody of 1"]


SECTIONS = [
    "<section id='related-work'><h2>Related</h2><p>Text</p></section>",
    "<section id='sharing-memory-between-processes'><h2>Related</h2><p>Text</p></section>",
    "<h2 id='comments-in-yaml'>Related</h2><p>Text</p>",
    "<h2 id='comments'>Related</h2><p id='share'>Text</p>",
    "<div id='login'><h2>Related</h2><p>Text</p></div>",
    "<h2>Related</h2><p class='notice'>Text</p>",
]


@pytest.mark.parametrize("wrap", ["<article><h1>Head</h1><p>One.</p>{}</article>", "<main><h1>Head</h1><p>One.</p>{}</main>"])
def test_slugs_of_headings_are_no_boilerplate(spark, wrap):
    bodies = [wrap.format(x) for x in SECTIONS + ["<p>Another.</p>"] * 6]
    found = extracted(spark, [(f"http://six.example/{i}", page(b)) for i, b in enumerate(bodies)] + [(f"http://{i}.example/", page(b)) for i, b in enumerate(bodies)])
    want = ["Head\n\nOne.\n\nRelated\n\nText"] * len(SECTIONS) + ["Head\n\nOne.\n\nAnother."] * 6
    assert [found[i][0] for i in range(2 * len(bodies))] == want * 2


def test_slugs_on_pages_without_an_article(spark):
    bodies = [f"<div class='content'><h1>Head</h1>{x}</div>" for x in SECTIONS[:4]]
    found = extracted(spark, [(f"http://{i}.example/", page(b)) for i, b in enumerate(bodies)])
    assert {t for t, _ in found.values()} == {"Head\n\nRelated\n\nText"}


def test_names_that_recur_on_a_host_are_boilerplate(spark):
    bodies = [ARTICLE.format(f"<div id='comments'><p>Remark {i}</p></div><div class='post-comments'><p>Remark {i}</p></div>") for i in range(6)]
    found = extracted(spark, [(f"http://seven.example/{i}", page(b)) for i, b in enumerate(bodies)])
    assert {t for t, _ in found.values()} == {TEXT}


STORY = "<div class='x{0}'>Look at our offers</div><div class='x9'><h2>Story {1}</h2><p>What {1} did, and <i>why</i>.<br>More of {1}</p></div><div class='x{0}'>All rights reserved here</div>"


def plain_pages(n=12):
    # The number stands where digits make no difference to the token.
    return [(f"http://eight.example/{i}", "<html><body>" + STORY.format(1 + i % 3, f"s{i}") + "</body></html>") for i in range(n)]


def test_equal_text_is_template_whatever_its_markup(spark):
    found = extracted(spark, plain_pages())
    assert [found[i][0] for i in range(12)] == [f"Story s{i}\n\nWhat s{i} did, and why. More of s{i}" for i in range(12)]


def test_template_texts_equal_a_brute_force_deduction(spark):
    pages = plain_pages(9) + [("http://eight.example/odd", "<html><body><div class='x9'><h2>Only here</h2><p>Look at our offers</p></div></body></html>")]
    bodies = [re.findall(r"<(?:div class='x\d'|h2|p)>((?:[^<]|<i>|</i>|<br>)+)", html) for _, html in pages]
    words = [[" ".join(unescape(re.sub("</?i>", "", re.sub("<br>", " ", b))).split()) for b in body] for body in bodies]
    often = {w for body in words for w in body if sum(w in other for other in words[:9]) >= 3}
    found = extracted(spark, pages)
    for i, body in enumerate(words[:9]):
        assert found[i][0] == "\n\n".join(w for w in body if w not in often)
    # In another place the same words are no template text.
    assert found[9][0] == "Only here\n\nLook at our offers"


def test_the_template_decides(spark, monkeypatch):
    pages = plain_pages()
    with_template = extracted(spark, pages)
    own = html_extract.main_text
    assert own(pages[0][1], [], []).startswith("Look at our offers")
    assert with_template[0][0] != own(pages[0][1], [], [])


def test_copies_without_an_article_keep_their_text(spark):
    copies = [("http://nine.example/", page(PLAIN.format(1)))] * 30 + [("http://nine.example/2", page(PLAIN.format(2)))]
    found = extracted(spark, copies)
    assert found[0][0] == "Plain 1\n\nBody of 1" and found[30][0] == "Plain 2\n\nBody of 2"


def test_equal_text_in_articles_stays(spark):
    bodies = [f"<article><p>A passage that many pages quote</p><p>Own {i}</p></article>" for i in range(12)]
    found = extracted(spark, [(f"http://ten.example/{i}", page(b)) for i, b in enumerate(bodies)])
    assert [found[i][0] for i in range(12)] == [f"A passage that many pages quote\n\nOwn {i}" for i in range(12)]


def test_slots_with_little_text_go_the_way_of_their_slot():
    def token(number, place, last, kind, main, thin):
        return {"token": number, "place": place, "last": last, "class": kind, "main": main, "thin": thin, "again": True}

    tokens = [token(0, 0, 0, 1, False, True), token(5, 1, 1, 7, True, False), token(6, 2, 8, 9, False, True), token(8, 4, 9, 9, False, False), token(7, 20, 20, 7, False, False)]
    assert html_extract.nested_verdicts(tokens) == {0: False, 5: True, 6: True, 8: False, 7: False}


@pytest.mark.parametrize(
    "inside",
    ["<article class='comment-body'><p>Nice!</p></article>", "<ol class='commentlist'><li>Nice!</ol>", "<p><span hidden>secret</span></p>", "<p><span class='ad'>Buy <span>now</span>!</span></p>"],
)
def test_comments_and_hidden_words_go(spark, inside):
    found = extracted(spark, [("http://eleven.example/0", page(ARTICLE.format(inside))), ("http://eleven.example/1", page(ARTICLE.format("") + inside))])
    assert {t for t, _ in found.values()} == {TEXT}


def test_line_breaks_are_white_space(spark):
    found = extracted(spark, [("http://twelve.example/", page("<article><p>One<br>Two<br/>Th<wbr>ree</p></article>"))])
    assert found[0][0] == "One Two Three"


BROKEN = ["<a ", '<a b="x ', "<a b='x' \"", "<center>", "<center></section>", "<div id='login'>", "<li><ul><center></li>", "<!--", "<!", "<script>", "<p <p>", "<a \">'", "<span class='ad'>", "&#", "</b>"]


@pytest.mark.parametrize("piece", BROKEN)
def test_long_broken_pages_take_linear_time(piece):
    html = "<article>start " + piece * (1_000_000 // len(piece)) + "</section>" * 8000 + ">"
    begun = time.process_time()
    html_extract.main_text(html, [], [])
    assert time.process_time() - begun < 8


def test_odd_pages(spark):
    long = "<p>word " * 20_000
    pages = [(None, None), ("", ""), ("no url", "just text"), ("http://x", "<article>" + long + "</article>"), ("http://y", "<article><p>a < b <c"), ("http://z/", page(ARTICLE.format(""))), ("http://z/", page(ARTICLE.format("")))]
    found = extracted(spark, pages)
    assert found[0] == found[1] == ("", 0) and found[2][0] == "just text"
    assert found[3][0] == "\n\n".join(["word"] * 20_000)
    assert found[5][0] == found[6][0] == TEXT and found[5][1] == len(TEXT)
    assert extracted(spark, []) == {}
