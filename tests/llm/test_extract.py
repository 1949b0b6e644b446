"""Main text of pages: the given pages against a plain reading, and hand-made pages."""

import html
import random
import re

import pytest

from hedgemark.llm.extract import extract, main_text

LONG = "The quick brown fox, which nobody had seen before, jumped over the dog, the fence and the wall of the garden."
MORE = "Later, when the evening came, all of them sat down, ate some bread, and told each other stories of old."


def test_like_a_plain_reading_of_the_given_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    for r in pages.select("html", main_text(pages["html"]).alias("text")).collect():
        m = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)
        body = m[1] if m[2] else re.sub(r"<[^>]*\Z", "", m[1])
        parts = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split())
                 for x in re.split(r"</?(?:p|h1)>", body.replace("<br>", " "))]
        assert r.text == "\n\n".join(p for p in parts if p)


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("   ", ""), ("<p>", ""), ("<", "<"), ("plain words", "plain words"), ("<nav><a href=x>Menu</a></nav>", ""),
    (f"<p>{LONG}", LONG),
    (f"<script>if (a<b) x='</p>'</script><p>{LONG}</p><style>p{{}}</style><!-- <p>no</p> -->", LONG),
    (f"<div id=menu><ul><li><a href=1>Home</a></ul></div><div><p>{LONG}</p><p>{MORE}</p></div><footer>&copy; x</footer>",
     f"{LONG}\n\n{MORE}"),
    (f"<main><h1>A &amp; B</h1><div><p>{LONG}</p></div><div class='ad-box'>Buy, buy, buy</div><section><p>{MORE}</p></section></main>",
     f"A & B\n\n{LONG}\n\n{MORE}"),
    (f"<article><header><h1>Title</h1></header><p>{LONG}</p><ul><li>one</li><li>two</li></ul><table><tr><td>x<td>y</table>"
     f"<form><p>mail, please</p></form><aside>{MORE}</aside></article><section id='comments'><p>{MORE}</p></section>",
     f"Title\n\n{LONG}\n\none\n\ntwo\n\nx\n\ny"),
    (f"<body><div class='cookie-notice'>{MORE}</div><div class=content><h2>Head</h2>{LONG}<br>next&nbsp;line<p>{MORE}</div></body>",
     f"Head\n\n{LONG} next line\n\n{MORE}"),
    (f"<article><p>{LONG}</p><ul><li><a href=1>one</a><li><a href=2>two</a><li><a href=3>three</a></ul><p hidden>x</p></article>",
     f"{LONG}\n\none\n\ntwo\n\nthree"),
    (f"<article><p>{LONG} 1 &lt; 2 &#233; &amp</p><p>{MORE[:20]}&am", f"{LONG} 1 < 2 é &\n\n{MORE[:20]}&am"),
    (f"<ARTICLE><P>{LONG}<P>{MORE}</ARTICLE><SCRIPT>var x = 1", f"{LONG}\n\n{MORE}"),
    (f"<article><p>{LONG}</p><p title='a > b'>{MORE}</p></article>", f"{LONG}\n\n{MORE}"),
])
def test_hand_made_pages(page, text):
    assert extract(page) == text


def test_deep_and_broken_pages_end():
    assert extract("<div>" * 20_000 + LONG) == LONG
    assert extract("</p></div>" * 5_000 + f"<p>{LONG}") == LONG
    assert extract("<a href='" * 3_000 + LONG) is not None
    assert extract(f"<p>{LONG}</p>" * 3000).count("\n\n") == 2999


@pytest.mark.parametrize("wrapper", [
    "div class='content has-sidebar'", "div class='no-sidebar'", "div class='with-header'", "div id='search-page'", "form action=x",
    "div role=form"])
def test_a_wrapper_does_not_take_the_text_along(wrapper):
    end = wrapper.split()[0]
    menu = "<div class=sidebar><a href=1>Home</a></div>"
    for inner in (f"<article><p>{LONG}</p><p>{MORE}</p></article>", f"<div><p>{LONG}</p><p>{MORE}</p></div>"):
        assert extract(f"<body><{wrapper}>{menu}{inner}</{end}><footer>x</footer>") == f"{LONG}\n\n{MORE}"


def test_long_comments_stay_out():
    comments = f"<div class=comments>{f'<p>{MORE}</p>' * 9}</div>"
    assert extract(f"<body><article><p>{LONG}</p></article>{comments}") == LONG
    assert extract(f"<body><div><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>{comments}") == "\n\n".join([LONG] * 3)


def test_all_blocks_of_a_page_without_article():
    page = (f"<body><div><h1>Head</h1><section>{f'<p>{LONG}</p>' * 5}</section><p>Short.</p><ul><li>one<li>two</ul>"
            f"<blockquote>said</blockquote><pre>x = 1</pre><table><tr><td>cell</table><section><p>{MORE}</p></section>"
            "<section><p>Bye.</p></section></div>")
    assert extract(page).split("\n\n") == ["Head", *[LONG] * 5, "Short.", "one", "two", "said", "x = 1", "cell", MORE, "Bye."]
    nested = f"<body><div><div><div><p>{LONG}</p><p>{LONG}</p></div></div><div><div><p>{MORE}</p></div></div></div>"
    assert extract(nested).split("\n\n") == [LONG, LONG, MORE]


def test_like_articles_beside_each_other_stay():
    first, second = f"<article>{f'<p>{LONG}</p>' * 5}</article>", f"<article><p>{LONG}</p><p>{MORE}</p></article>"
    assert extract(f"<body>{first}<div>Teaser</div>{second}").split("\n\n") == [LONG] * 6 + [MORE]


@pytest.mark.parametrize(("page", "text"), [
    (f"<article><p>Short.</p></article><ol class='commentlist'>{f'<li><p>{MORE}</p></li>' * 8}</ol>", "Short."),
    ("<body><article><p>One.</p></article><article><p>Two.</p></article>", "One.\n\nTwo."),
    (f"<article><p>{LONG}</p><ol>{''.join(f'<li><a href={k}>Source {k}</a></li>' for k in range(4))}</ol></article>",
     "\n\n".join([LONG, *(f"Source {k}" for k in range(4))])),
    (f"<article><p class='social-history'>{LONG}</p><p class='skip-ahead'>{MORE}</p><dl><dt>Level</dt><dd class='alert-level'>high</dd></dl></article>",
     f"{LONG}\n\n{MORE}\n\nLevel\n\nhigh"),
    (f"<article><p>{LONG}</p><p><label>Note</label> said the fox.</p></article>", f"{LONG}\n\nNote said the fox."),
    (f"<body><div><h1>Title</h1></div><div><p>{LONG}</p><p>{MORE}</p></div>", f"Title\n\n{LONG}\n\n{MORE}"),
    (f"<body><div><h1>Title</h1></div><article><p>{LONG}</p></article>", f"Title\n\n{LONG}"),
    (f"<body><div><p>{LONG}</p><p><a href=x>{MORE}</a></p><p>{LONG}</p></div>", f"{LONG}\n\n{MORE}\n\n{LONG}"),
    (f"<body><nav><article><a href=1>Home</a></article></nav><div><p>{LONG}</p></div>", LONG),
])
def test_nothing_of_the_article_is_lost(page, text):
    assert extract(page) == text


@pytest.mark.parametrize("seed", range(60))
def test_generated_pages(seed):
    """Articles of random blocks in random wrappers and with random furniture, against what was put in."""
    pick = random.Random(seed)
    said = iter(range(10 ** 6))
    words = lambda n: " ".join(f"word{next(said)}" for _ in range(n))
    want, body = [], []
    names = ["", " class='lead'", " class='social-history'", " id='search-results-explained'", " class='widget-theory'", " class='header-art'"]
    def blocks(depth):
        for _ in range(pick.randrange(1, 5)):
            kind, name = pick.choice(["p", "h2", "li", "refs", "quote", "table", "div", "section", "furniture"]), pick.choice(names)
            text = words(pick.choice([1, 3, 30]))
            if kind in ("div", "section") and depth < 3:
                body.append(f"<{kind}{name}>")
                blocks(depth + 1)
                body.append(f"</{kind}>")
            elif kind == "furniture":
                body.append(pick.choice(["<div class='share-buttons'>{}</div>", "<aside>{}</aside>", "<div class='ad'>{}</div>",
                                         "<form>{}</form>", "<script>{}</script>", "<div id='newsletter-box'>{}</div>"]).format(text))
            else:
                made = {"p": f"<p{name}>{text}</p>", "h2": f"<h2>{text}</h2>", "li": f"<ul{name}><li>{text}</ul>", "quote": f"<blockquote>{text}</blockquote>",
                        "refs": f"<ol><li><a href=x>{text}</a></ol>", "table": f"<table><tr><td>{text}</table>"}
                body.append(made.get(kind, f"<p>{text}</p>"))
                want.append(text)
    for _ in range(pick.randrange(1, 3)):
        body.append("<article>")
        blocks(0)
        want.append(words(20))
        body.append(f"<p>{want[-1]}</p></article>")
    wrapper = pick.choice(["div", "div class='has-sidebar'", "section", "div id=page"])
    menu = f"<nav>{words(4)}</nav><div class='sidebar'><p>{words(30)}</p></div>"
    comments = f"<section class='comments'><p>{words(200)}</p></section>"
    page = f"<body>{menu}<{wrapper}>{''.join(body)}</{wrapper.split()[0]}>{comments}<footer>{words(9)}</footer>"
    assert extract(page).split("\n\n") == want


def test_tables_of_pages(spark):
    """Repeated rows, an empty table, and columns that bear the operator's words."""
    page = f"<article><p>{LONG}</p></article>"
    pages = spark.createDataFrame([(1, page, "a"), (1, page, "a"), (None, None, "b")], "page_id long, html string, text string")
    got = pages.select("page_id", "text", main_text(pages["html"]).alias("found")).collect()
    assert sorted((r.page_id or 0, r.text, r.found) for r in got) == [(0, "b", ""), (1, "a", LONG), (1, "a", LONG)]
    assert pages.where("false").select(main_text(pages["html"])).collect() == []
