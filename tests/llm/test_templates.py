"""Main text of pages, on pages made here and on given ones."""

import html
import random
import re

import pytest

from boletim.llm import templates
from boletim.llm.queries import QUERIES


def page(n, pick, layout):
    words = lambda k: " ".join("w%d" % pick.randrange(10**5) for _ in range(k))
    paragraphs = [f"{words(60)} &amp; {words(3)}\n  x" for _ in range(pick.randrange(2, 6))]
    if n % 3 == 0:
        paragraphs.append("Licensed under the same terms.")
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    wanted = " ".join(" ".join(html.unescape(p).split()) for p in [f"Title {n}", *paragraphs])
    links = "".join(f"<li><a href='/{i}'>{words(2)}</a></li>" for i in range(pick.randrange(5, 12)))
    if layout == "semantic":
        text = f"""<!DOCTYPE html><html><head><title>Title {n}</title><style>p{{}}</style></head><body>
        <header><h2>Site {n}</h2></header><nav><ul>{links}</ul></nav>
        <div class="cookie-notice">We use cookies {words(5)}</div><main><article id="post-{n}"><h1>Title {n}</h1>{body}
        <div class="share">Share this</div><form><input name=q><label>Search</label><button>Go</button></form></article>
        <section class="comments"><p>{words(80)}</p><p>{words(90)}</p></section></main>
        <aside><p>{words(50)}</p></aside><script>var t = "</p><article>";</script>
        <footer>&copy; {words(6)}</footer></body></html>"""
    else:
        text = f"""<html><body><div><div><ul>{links}</ul></div><div><h1>Title {n}</h1>{body}<div>Follow us everywhere</div></div>
        <div><ul>{links}</ul></div></div><div>Made by us {n}</div><!-- <p>no</p> --></body>"""
    return text, wanted


@pytest.mark.parametrize("layout", ["semantic", "plain"])
def test_article_of_a_host(shipped, layout):
    pick = random.Random(3)
    made = [page(n, pick, layout) for n in range(40)]
    rows = [(n, f"https://Host.example:80/{n}", t) for n, (t, _) in enumerate(made)]
    rows.append((40, "https://host.example/40", rows[0][2]))  # a copy
    df = shipped.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, host int")
    found = {r.page_id: r for r in templates.extract(df.repartition(3)).collect()}
    for n, (_, wanted) in enumerate(made):
        assert found[n].text == wanted and found[n].n_chars == len(wanted) and found[n].url == rows[n][1]
    assert found[40].text == made[0][1]


def test_single_and_broken_pages(shipped):
    text, wanted = page(1, random.Random(9), "semantic")
    rows = [
        (1, "https://a.example/x", text), (2, None, text), (3, "no host", text), (4, "https://b.example", None),
        (5, "https://b.example", ""), (None, "https://b.example/2", "<p>only &lt;text&gt;&nbsp;here<br>and there"),
        (7, "https://c.example", "just words  "), (8, "https://c.example", "<div class='x><p>unclosed"),
        (9, "https://d.example", "<" * 2000), (9, "https://d.example", "<p>" * 3000 + "deep " * 3000),
    ]
    df = shipped.createDataFrame(rows, "page_id long, url string, html string")
    found = templates.extract(df).collect()
    text_of = {r.page_id: r.text for r in found if r.page_id not in (8, 9)}
    assert text_of == {1: wanted, 2: wanted, 3: wanted, 4: "", 5: "", None: "only <text> here and there", 7: "just words"}
    assert len(found) == len(rows) and max(r.n_chars for r in found) >= 14_999
    assert templates.extract(df.limit(0)).count() == 0


def test_copies_of_one_article_stay(shipped):
    text, wanted = page(2, random.Random(4), "semantic")
    df = shipped.createDataFrame([(n, "http://e.example/", text) for n in range(30)], "page_id long, url string, html string")
    assert {r.text for r in templates.extract(df).collect()} == {wanted}


def test_equal_vectors_have_equal_digests(shipped):
    rows = [(n, "<body><div id=a><p>x</p></div>" + "<div id=b>y</div>" * (n % 2) + "<i>t</i>" * n) for n in range(6)]
    df = shipped.createDataFrame(rows, "number long, html string").selectExpr("number", "html", "'h' AS host")
    found = templates.occurrences(df.repartition(3)).collect()
    vectors = {}
    for r in found:
        vectors.setdefault((r.vector, r.pages, r.total), set()).add((r.kind, r.role))
    sizes = sorted((pages, total, len(v)) for (_, pages, total), v in vectors.items())
    assert sizes == [(3, 3, 2), (5, 15, 2), (6, 6, 5)]


def test_given_pages(shipped, small):
    found = {r.page_id: r.text for r in QUERIES["op1_template_extraction"](shipped, "/root/testdata/sf0.001").collect()}
    for id_, source in small("SELECT page_id, html FROM pages"):
        inside = re.search(r"<article>(.*)</article>", source, re.S)[1]
        plain = re.sub(r"</?b>", "", re.sub(r"<(?:/?(?:p|h1)|br)>", " ", inside))
        assert found[id_] == " ".join(html.unescape(plain).split())


def extracted(spark, sources, host="one.example"):
    rows = [(n, f"https://{host}/{n}", source) for n, source in enumerate(sources)]
    found = templates.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r.text for r in sorted(found, key=lambda r: r.page_id)]


def test_nothing_around_the_longest_part_is_lost(shipped):
    long = [" ".join(f"t{n}x{k}" for k in range(200)) for n in range(8)]
    article = "<html><body><article><h1>Head {0}</h1><p>intro {1}</p><div class='body'><p>{1}</p></div></article></body></html>"
    made = [article.format(n, t) for n, t in enumerate(long)]
    assert extracted(shipped, made) == [f"Head {n} intro {t} {t}" for n, t in enumerate(long)]
    assert extracted(shipped, made[:1]) == [f"Head 0 intro {long[0]} {long[0]}"]
    assert extracted(shipped, [f"<p>{long[0]}</p><div>few words</div>"]) == [f"{long[0]} few words"]
    table = f"<body><div id=a><p>before</p><table><tr><td>{long[0]}</td></tr></table><p>after</p></div></body>"
    assert extracted(shipped, [table]) == [f"before {long[0]} after"]


@pytest.mark.parametrize("name", ["content-sidebar-wrap", "page-with-sidebar", "has-ads", "side-by-side", "search widget"])
def test_a_hint_around_the_article_says_nothing(shipped, name):
    text = " ".join(f"t{k}" for k in range(60))
    inside = "<{0}><h1>Head</h1><p>{1}</p></{0}><div class='sidebar'><p>aside</p></div><section class='comments'><article><p>{2}</p></article></section>"
    made = [
        f"<body><div class='{name}'>{inside.format(element, text, 'no ' * 300)}</div><div class='related'><p>other</p></div></body>"
        for element in ("article", "main", "div")
    ] + [f"<body><form class='{name}'>{inside.format('article', text, 'no')}</form></body>"]
    for source in made:
        assert extracted(shipped, [source]) == [f"Head {text}"]


def test_shared_words_inside_a_paragraph_stay(shipped):
    made = [
        f"<body><article><p><strong>Summary:</strong> s{c} <b>{n} %</b> <em>of <i>all</i></em> t{c}</p><div>Follow us</div></article></body>"
        for n, c in enumerate("abcdefghijkl")
    ]
    assert extracted(shipped, made) == [f"Summary: s{c} {n} % of all t{c}" for n, c in enumerate("abcdefghijkl")]


@pytest.mark.parametrize("odd", ["<svg class='x' />", "<svg-icon name='a'></svg-icon>", "<template-x></template-x>"])
def test_an_icon_takes_no_text(odd):
    assert templates.Page(f"<body>{odd}<article><p>text</p></article></body>").text(None) == "text"
    assert templates.Page("<body><svg><text>no</text></svg><article><p>text</p></article></body>").text(None) == "text"


NEUTRAL = {"nav": "qa", "article": "qb", "footer": "qc", "header": "qd", "aside": "qe", "main": "qf", "section": "qg"}


def neutral(html):
    """The page with neutral names for its parts."""
    for name, mark in NEUTRAL.items():
        html = re.sub(rf"<{name}\b[^>]*>", f'<div class="{mark}">', html)
        html = html.replace(f"</{name}>", "</div>")
    return re.sub(r'class="ad"', 'class="qz"', html)


def test_the_template_tells_slots_apart(shipped, small):
    rows = small("SELECT page_id, url, html FROM pages", "/root/testdata/sf0.01")
    schema = "page_id long, url string, html string"
    named = {r.page_id: r.text for r in templates.extract(shipped.createDataFrame(rows, schema)).collect()}
    plain = [(i, u, neutral(h)) for i, u, h in rows]
    found = {r.page_id: r.text for r in templates.extract(shipped.createDataFrame(plain, schema)).collect()}
    assert sum(found[i] == named[i] for i in named) >= 0.99 * len(rows)
    # No page says so by itself, and a page without a host is read whole.
    assert not any(templates.Page(h).text(None) == named[i] for i, _, h in plain)
    alone = [(i, None, h) for i, _, h in plain[:5]]
    for r in templates.extract(shipped.createDataFrame(alone, schema)).collect():
        assert named[r.page_id] in r.text


def pages_of(*bodies):
    return [(k, f"http://h.example/{k}", f"<html><head><title>t</title></head><body>{b}</body></html>") for k, b in enumerate(bodies)]


@pytest.mark.parametrize(
    "around",
    [
        # Bare text of what holds the slots, and paragraphs beside them, belong to the article.
        "bare intro {k} <div class=x>menu {k}</div><div class=y><p>long text of page {k} with some words</p></div>",
        "<div class=x><p>intro {k}</p></div><div class=y><p>long text of page {k} with some words</p></div>",
    ],
)
def test_slots_are_not_left_with_their_paragraphs(shipped, around):
    rows = pages_of(*[around.format(k=k) for k in range(6)])
    for r in templates.extract(shipped.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert f"intro {r.page_id}" in r.text and f"page {r.page_id} with" in r.text


def test_a_page_unlike_its_host_keeps_its_paragraphs(shipped):
    usual = "<div class=x>advert {k}</div><div class=y><p>long text of page {k} with some words and more words</p></div>"
    rows = pages_of(*[usual.format(k=k) for k in range(8)], usual.format(k=8) + "<div class=z><p>a part of its own</p></div>")
    text = {r.page_id: r.text for r in templates.extract(shipped.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert "advert" not in text[0] and text[0].startswith("long text of page 0")
    assert text[8].endswith("a part of its own")


def test_slots_equal_a_plain_count():
    page = templates.Page("<body>own <b>bold</b><div class=a><p>one two</p>three<ul><li>four</li></ul></div><div class=a><a>x</a>five</div></body>")
    slots = {n.name + str(n.parent): page.elements()[n.role] for n in page.nodes}
    body, div = next(s for k, s in slots.items() if k.startswith("body")), next(s for k, s in slots.items() if k.startswith("div"))
    assert (body.plain, body.para, body.bare) == (len("ownboldonetwothreefourfive"), len("onetwofour"), len("ownbold"))
    assert (div.plain, div.para, div.bare) == (len("onetwothreefourfive"), len("onetwofour"), len("threefive"))
