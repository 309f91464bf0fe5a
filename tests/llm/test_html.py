import html as H
import re

import pytest

from llm_cases import SF
from tidemark.llm import html_extract as X

PAGE = """<html><head><title>x</title><style>p{}</style></head><body><header><a href=a>Home</a> Site</header><nav>Menu one two</nav>
<div class="cookie-notice">We use cookies on this site to give you the best of it and more of the same, thanks.</div>
<main><article><header><h1>Title here</h1></header><p>Long paragraph with the words of a normal text that is in English and goes on
for a while.<p>Short.</p><form><label>Name</label><input></form>
<aside>See also the other things that are on this site and in the world and more</aside>
<p>&Uuml;n&iuml;code &eacute; &#x41; &nbsp; end<br>of it</article></main>
<section id="comments"><h2>Comments</h2><div class=comment><p>I think the article is of the best that I have read in years.</div></section>
<div class="sidebar">Other</div><footer>&copy; me</footer><script>if(a<b){"</p><p>x</p>"}</script></body></html>"""


def test_page():
    assert X.extract(PAGE).split("\n\n") == [
        "Title here", "Long paragraph with the words of a normal text that is in English and goes on for a while.",
        "Short.", "Ünïcode é A end of it"]


def test_short_blocks_inherit():
    page = ("<body><div>open one</div><p>A long block of the text that has the words which are common in it, and so it is good by itself.</p>"
            "<div>open two</div><ul><li><a href=x>link link link</a></li><li><a href=y>another link that is here</a></li></ul><div>open three</div></body>")
    assert X.extract(page).split("\n\n")[0] == "open one"
    assert "open three" not in X.extract(page) and "link" not in X.extract(page)


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("plain", "plain"), ("<p>a<b>b</b>c &lt;x&gt; <!-- open", "abc <x>"), ("<<p>", "<"),
    ("<p title=\"a>b\">t</p>", "t"), ("<script>never closed <p>x", ""), ("<div hidden>x</div>", ""), ("a &am b &amp", "a &am b &")])
def test_odd_pages(page, text):
    assert X.extract(page) == text


LANGUAGES = {
    "pl": "Wczoraj wieczorem mieszkańcy naszego miasta spotkali się przy rynku, żeby porozmawiać o nowym moście nad rzeką",
    "fi": "Kaupungin asukkaat kokoontuivat eilen illalla torille keskustelemaan uudesta sillasta, joka rakennetaan joen yli",
    "ru": "Вчера вечером жители нашего города собрались на площади, чтобы поговорить о новом мосте через широкую реку",
    "none": "Bridge building river market square evening residents discussion budget council engineer concrete steel cable tower"}


@pytest.mark.parametrize("lead", ["<nav>Home News Contact</nav>", "<header>Site</header><nav>Home News</nav>",
                                  "<nav>Home</nav><div><a href=a>One link of a list</a> <a href=b>another link of the list</a></div>"])
@pytest.mark.parametrize("lang", LANGUAGES)
def test_languages_without_article(lang, lead):
    parts = [f"{LANGUAGES[lang]} {i}." for i in range(3)]
    page = f"<body>{lead}<div>{''.join(f'<p>{p}</p>' for p in parts)}</div><footer>Contact us by mail</footer></body>"
    assert X.extract(page) == "\n\n".join(parts)


def test_long_page_is_whole():
    words = "the words of this paragraph are repeated in it and they go on to the end"
    page = "<article>" + "".join(f"<p>{words} {i}</p>" for i in range(5000)) + "</article>"
    assert X.extract(page).count("\n\n") == 4999


def test_all_pages(spark):
    rows = X.main_text(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        parts = [" ".join(H.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", p))).split()) for p in re.split(r"</?p>|</?h1>", article)]
        assert r.text == "\n\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_null_columns_and_empty_table(spark):
    df = spark.createDataFrame([(None, None, None, "x"), (1, "u", "<p>a</p>", "y"), (1, "u", "<p>a</p>", "y")],
                               "page_id long, url string, html string, text string")
    assert sorted(map(tuple, X.main_text(df).collect()), key=str) == sorted([(None, None, "", 0), (1, "u", "a", 1), (1, "u", "a", 1)], key=str)
    assert X.main_text(df.limit(0)).count() == 0


SENTENCE = "This is a paragraph with the words of a normal text that is in English and goes on for a while"


@pytest.mark.parametrize("untidy", [
    "<a href=x title=it's>link</a>", "<p title=it's>don't</p>", "<img alt=\"a > b\" src='x>y'>", "<p \"stray>quote</p>", "<div data-x = it's>don't</div>"])
def test_untidy_attributes_lose_nothing(untidy):
    page = f"<body><article><p>{SENTENCE} one.</p>{untidy}<p>{SENTENCE} isn't two.</p><p>{SENTENCE} three.</p></article></body>"
    found = X.extract(page)
    assert all(f"{SENTENCE} {x}" in found for x in ("one.", "isn't two.", "three."))


@pytest.mark.parametrize("name,kept", [("legal-analysis", True), ("share-price news", True), ("article-footer", True), ("comments", False), ("comment-list", False),
                                       ("share-buttons", False), ("ad-slot-2", False), ("related_links", False), ("sidebar widget", False)])
def test_class_names_inside_an_article(name, kept):
    page = f'<article><p>{SENTENCE} first.</p><div class="{name}"><p>{SENTENCE} inside.</p></div></article>'
    assert (f"{SENTENCE} inside." in X.extract(page)) == kept and f"{SENTENCE} first." in X.extract(page)


def test_links_around_blocks_count_as_links():
    cards = "".join(f'<a href="/{i}"><div><p>{SENTENCE} of card {i}</p></div></a>' for i in range(2))
    found = X.blocks(f"<body><div>{cards}</div><p>{SENTENCE} outside</p></body>")
    assert [round(b[1], 1) for b in found] == [1.0, 1.0, 0.0]
    # an inline link left open ends with its block, one around blocks with its container
    assert [b[1] for b in X.blocks(f"<p>word <a href=x>link<p>{SENTENCE}<div><a href=y><p>card</div><p>{SENTENCE}")][1::2] == [0.0, 0.0]


@pytest.mark.parametrize("hostile", ['<p a="' * 150_000, "<div>" * 60_000 + "</b>" * 60_000, "<!" * 300_000, "<a href=x " * 100_000, "<p a='" * 150_000 + ">",
                                     "<script " * 100_000, "</div" * 150_000, "<div><p>" * 50_000 + "</x>" * 50_000])
def test_hostile_pages_take_linear_time(hostile):
    import time
    start = time.process_time()
    X.extract(hostile)
    assert time.process_time() - start < 3
