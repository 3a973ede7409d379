from __future__ import annotations

import random
import time

import pytest

from tracklake.llm.html_text import extract_text, main_text

BODY = "A first sentence, with commas, and more of it. " * 4


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("   ", ""),
        ("plain words", "plain words"),
        (f"<html><head><title>t</title><script>if (a < b) '</p>'</script></head><body><nav><a href=x>menu</a></nav><article><h1>Head</h1><p>{BODY}</p><p>Short.</p></article><footer>&copy; x</footer></body></html>", f"Head {BODY.strip()} Short."),
        (f"<div class='sidebar'><p>{BODY}</p></div><div><p>{BODY}<p>next &amp; last<br>line</div><div id=comments><p>{BODY}</div>", f"{BODY.strip()} next & last line"),
        (f"<main><p>{BODY}</p><div class='ad'>buy</div><aside>x</aside><form><p>{BODY}</form><p>end</p></main>", f"{BODY.strip()} end"),
        (f"<article><p><b>{BODY}<p>cut in a ta", f"{BODY.strip()} cut in a ta"),
        (f"<article><p>{BODY}</p><p>tag <a hre", f"{BODY.strip()} tag"),
        (f"<article><p>{BODY}<!-- no --> x &#65;&lt;y&nbsp;z &unknown; &am</p>", f"{BODY.strip()} x A<y z &unknown; &am"),
        (f"<article><ul><li>one<li>two, {BODY}</ul><table><tr><td>c1<td>c2</table></article>", f"one two, {BODY.strip()} c1 c2"),
        (f"<ARTICLE><P>{BODY}</P><SCRIPT>var a='<p>';</SCRIPT><style>p{{}}</style><p hidden>gone</p></ARTICLE>", BODY.strip()),
        ("<nav>only <a>menu</a></nav><footer>f</footer>", ""),
    ],
)
def test_pages(page, text):
    assert main_text(page) == text


def test_odd_markup_ends():
    assert isinstance(main_text("<p" * 3000), str)
    assert isinstance(main_text('<a "' * 500 + "x"), str)
    assert main_text("<div>" * 5000 + "deep words here" + "</div>" * 5000) == "deep words here"
    assert main_text("1 < 2 and 3 > 2") == "1 < 2 and 3 > 2"


def test_table(spark):
    df = spark.createDataFrame([(1, None, "u"), (2, "<p>x</p>", "v"), (2, "<p>x</p>", "v")], "page_id bigint, html string, text string")
    rows = extract_text(df, keep=["page_id", "text"]).orderBy("page_id").collect()
    assert [(r.page_id, r.text, r.n_chars) for r in rows] == [(1, "", 0), (2, "x", 1), (2, "x", 1)]
    assert extract_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("marked", ['class="content with-sidebar"', 'id="page" class="no-sidebar"', 'class="nav-fixed"', 'class="post has-comments"', 'class="layout-widget"', 'class="page form"', "id=search"])
@pytest.mark.parametrize("frame", ["", "<div class='sidebar'><p>Other words, of the frame.</p></div>", "<p>&copy; x</p>"])
def test_marked_wrappers_keep_the_article(marked, frame):
    text = f"Head {BODY.strip()} {BODY.strip()}"
    assert main_text(f"<body><div {marked}><div><h1>Head</h1><p>{BODY}</p><p>{BODY}</p></div></div>{frame}</body>").startswith(text)
    assert BODY.strip() in main_text(f"<body><div {marked}><p>{BODY}</p><p>{BODY}</p></div>{frame}</body>")


def test_marked_frames_go():
    article = f"<h1>Head</h1><p>{BODY}</p>"
    for marked in ("class=comments", "class='comment-list'", "class='widget-area'", "id=site_nav", "role=complementary"):
        frame = f"<div {marked}>" + f"<p>Said a reader, {BODY}</p>" * (3 if "comment" in marked else 1) + "</div>"
        assert main_text(f"<body><div>{article}<p>{BODY}</p></div>{frame}</body>") == f"Head {BODY.strip()} {BODY.strip()}"
    assert main_text(f"<article><div class='article-header'><h1>Head</h1></div><p>{BODY}</p></article>") == f"Head {BODY.strip()}"
    assert main_text(f"<form><div class=login><p>{BODY}</p></div></form>") == BODY.strip()


LONG = ("Some words of the text, and others, " + "and more " * 29).strip()
SECTIONS = "<section>" + f"<p>{LONG}</p>" * 20 + "</section><section>" + f"<p>{LONG}</p>" * 2 + "</section>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<article><h1>Head</h1>{SECTIONS}</article>", " ".join(["Head", *[LONG] * 22])),
        (f"<article><h1>Head</h1><div class=body>{SECTIONS}</div></article>", " ".join(["Head", *[LONG] * 22])),
        (f"<article><header><h1>Head</h1></header><div>{SECTIONS}</div></article>", " ".join(["Head", *[LONG] * 22])),
        (f"<main><h1>Head</h1><div>{SECTIONS}</div><p>Short.</p><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table></main>", " ".join(["Head", *[LONG] * 22, "Short. one two c1 c2"])),
        (f"<body><div><h1>Head</h1><div>{SECTIONS}</div><div><h2>Part</h2><p>{BODY}</p></div></div></body>", " ".join(["Head", *[LONG] * 22, "Part", BODY.strip()])),
        (f"<body><h1>Head</h1><article>{SECTIONS}</article></body>", " ".join(["Head", *[LONG] * 22])),
        (f"<article><div><div>{SECTIONS}</div></div><div><p>{BODY}</p></div><div><h3>More</h3><ul><li><a href=x>other page</a><li><a href=y>and one more</a></ul></div></article>", " ".join([*[LONG] * 22, BODY.strip()])),
        (f"<body><div><a href=a>one page</a></div><div>{SECTIONS}</div><ul><li><a href=x>other page</a></ul><div>&copy; x</div></body>", " ".join([LONG] * 22)),
    ],
)
def test_all_of_the_article(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("marked", ["class='content has-sidebar'", "class='post-search'", "class='form-content'", "class='story social-science'", "class='related-work'", "class='block hidden md:block'", "title='the hidden life'", "data-x=hidden"])
def test_what_only_looks_like_a_mark(marked):
    assert main_text(f"<div {marked}><p>{BODY}</p></div>") == BODY.strip()
    assert main_text(f"<article><div {marked}><p>{BODY}</p></div></article>") == BODY.strip()


def test_parts_of_an_article_stay():
    assert main_text(f"<article><p>{BODY}</p><p class='share-price'>{BODY}</p></article>") == f"{BODY.strip()} {BODY.strip()}"
    assert main_text(f"<article><p>{BODY}</p><p>The end.</p></article>") == f"{BODY.strip()} The end."
    for gone in ("<p hidden>x</p>", "<p aria-hidden=true>x</p>", "<p style='color:red; display : none'>x</p>", "<p class=ad>x</p>", "<p HIDDEN=''>x</p>"):
        assert main_text(f"<article><p>{BODY}</p>{gone}</article>") == BODY.strip()
    assert main_text("<div>" * 30 + f"<p>{BODY}</p>" + "</div>" * 30) == BODY.strip()


@pytest.mark.parametrize("page", ["<p>" + "a<" * 500_000, '<a "' * 250_000, "<p title='" * 100_000 + ">", "<!--" * 250_000, "<script>" * 100_000, "</script " * 100_000, "<script></script " * 60_000, "<a '>" * 200_001, "<div>" * 100_000, "<b>" * 200_000 + "x" + "</i>" * 200_000, "<li>" * 200_000, "&" * 1_000_000, "<p>x" * 200_000], ids=str.__len__)
def test_odd_pages_of_a_megabyte_end_soon(page):
    began = time.perf_counter()
    main_text(page)
    assert time.perf_counter() - began < 15


def test_generated_pages_give_their_text():
    """Pages made from known articles: a plain walk over what was put in tells the text."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9)))
    sentence = lambda n: " ".join(word() + ("," if rng.random() < 0.1 else "") for _ in range(n)) + "."
    frames = ["<nav><a href=x>menu</a> <a href=y>more</a></nav>", "<div class='sidebar'><p>side words</p></div>", "<aside>noted</aside>", "<div class=ad>buy it</div>", "<footer>(c) x</footer>", "<form><input name=q><label>find</label></form>", "<div id=comments><p>said a reader</p></div>", "<script>var a = '<p>no</p>';</script>", "<!-- <p>none</p> -->", "<div class='cookie-notice'>we use cookies</div>"]
    for _ in range(300):
        own, inner = [], []
        for _ in range(rng.randint(2, 12)):
            kind = rng.choice(["p", "p", "p", "h2", "ul", "blockquote", "table", "section"])
            parts = [sentence(rng.randint(3, 60) if kind != "h2" else 3) for _ in range(1 if kind in ("p", "h2", "blockquote") else rng.randint(1, 4))]
            own += parts
            inner.append({"ul": lambda x: "<ul>" + "".join(f"<li>{t}" for t in x) + "</ul>", "table": lambda x: "<table><tr>" + "".join(f"<td>{t}" for t in x) + "</table>", "section": lambda x: "<section>" + "".join(f"<p>{t}</p>" for t in x) + "</section>"}.get(kind, lambda x, k=kind: f"<{k}>{x[0]}</{k}>")(parts))
            if rng.random() < 0.3:
                inner.append(rng.choice(frames))
        title = sentence(4)
        holder = rng.choice(["article", "main"])
        page = f"<html><body>{rng.choice(frames)}<{holder} class='post {rng.choice(['', 'with-sidebar', 'no-nav'])}'><h1>{title}</h1>{''.join(inner)}</{holder}>{rng.choice(frames)}</body></html>"
        assert main_text(page) == " ".join([title, *own]), page
