from __future__ import annotations

import random
import time

import pytest

from rosterspark.llm import html_extract as h

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body class="has-sidebar">
<nav><ul><li><a href="/">menu</a></li></ul></nav><!-- no <p>no</p> --><div class="ad-box ad">buy this now</div><div class="cookie-notice">we use cookies</div>
<article class="post-17"><header><h1>Head &amp; more</h1><span>by nobody</span></header><p>First<br>line <b>bold</b>face.<p>Second &#233; line with enough words, and a <a href="x">link</a>.
<div class="related">read on</div><form><input><button>go</button></form></article><div id="comments"><p>a reader says no</p></div><aside>no</aside><footer>&copy; no</footer></body></html>"""
TEXT = "Head & more First line boldface. Second é line with enough words, and a link."


def test_article_alone():
    path = h.best(h.Page(PAGE).scores())
    assert path == "/body.has-sidebar/article.post-#"
    assert h.main_text(PAGE, path) == TEXT
    assert h.main_text(PAGE, "/body/elsewhere") == TEXT
    assert h.main_text(PAGE[: PAGE.index("<form>")], path) == TEXT


def test_odd_pages():
    for page in (None, "", "   ", "<p", "<!-- open", "<script>x", "<div></div>", "</p></div>"):
        assert h.main_text(page, None) == ""
    assert h.main_text("just text &lt;b&gt;", None) == "just text <b>"
    assert h.main_text("<p>a < b</p><p title='x>y'>c</p>", None) == "a < b c"
    assert h.main_text("<p>" * 3000 + "deep" + "<div>" * 3000 + "er", None).startswith("deep")
    assert h.main_text("<pre>a\n  b</pre><h2>c</h2>", "") == "a b c"


def test_hosts_vote(spark):
    good = "<body><div class='main-col'><p>" + "many words of a text " * 30 + "</p></div><div class='x1'><p>" + "other side words " * 10 + "</p></div></body>"
    odd = "<body><div class='main-col'><p>short text</p></div><div class='x1'><p>" + "other side words " * 10 + "</p></div></body>"
    rows = [(i, "http://a.example/%d" % i, good) for i in range(5)] + [(9, "https://A.example:80/x", odd), (10, None, odd), (11, "bad url", None), (9, "https://A.example:80/x", odd)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as text", "1 as host", "2 as path")
    for small in (1000, 0):
        out = h.extract(pages, small=small).collect()
        assert len(out) == len(rows)
        by = {r["page_id"]: r for r in out}
        assert by[9]["text"] == "short text" and by[9]["n_chars"] == 10
        assert by[10]["text"].startswith("other side") and by[11]["text"] == "" and by[10]["url"] is None
    assert h.extract(pages.filter("false")).count() == 0


LONG = "<p>" + "A long article with many words in it. " * 20 + "</p>"
WANT = " ".join(("A long article with many words in it. " * 20).split())


@pytest.mark.parametrize("name", ["content has-sidebar", "post-content share-enabled", "entry hidden-gem", "main-content search", "no-sidebar", "wrapper with-banner", "hidden-xs", "page ads"])
def test_marked_containers_that_hold_the_page_stay(name):
    page = f"<html><head><meta charset=x><body><nav>menu</nav><div class='{name}'>{LONG}</div><div class='sidebar'>side</div></body></html>"
    assert h.main_text(page, None) == WANT


def test_forms_empty_elements_and_open_heads():
    assert h.main_text(f"<body><form action=x><nav>menu</nav><div>{LONG}</div></form></body>", None) == WANT
    assert h.main_text(f"<body>{LONG}<form>Your name <input></form></body>", None) == WANT
    assert h.main_text(f"<html><head><title>t</title><link href=x><article>{LONG}</article></html>", None) == WANT
    assert h.main_text(f"<body><svg width=1/><canvas id='a'/>{LONG}<svg><text>no</text></svg></body>", None) == WANT
    comments = f"<article><p>Short one here.</p></article><div class='comments'><p>{'talk ' * 200}</p></div><article class='comment-body'>{LONG}</article>"
    assert h.main_text(f"<body>{comments}</body>", None) == "Short one here."


def test_deep_and_unclosed_elements_take_linear_time():
    start = time.time()
    assert h.main_text("<div>" * 100_000 + "deep<p>er", None) == "deep er"
    assert time.time() - start < 4  # two seconds on an idle core
    text = h.main_text("".join(f"<div class='c{'ab'[i % 2]}'>x" for i in range(20_000)) + "</section>" * 20_000, None)
    assert text == " ".join("x" * 20_000)


def _tree(rnd, depth=0):
    """A random element: tag, class, children (elements or texts)."""
    tag = rnd.choice(["div", "div", "section", "article", "p", "nav", "aside", "ul", "h2", "form"]) if depth else "body"
    name = rnd.choice(["", "", "main-col", "col-3", "sidebar", "ad box", "entry related", "x y"]) if tag in ("div", "section") else ""
    if tag in ("p", "h2") or depth > 4:
        return tag, name, [" ".join(rnd.choice("stone river light house paper".split()) for _ in range(rnd.randint(1, 30)))]
    return tag, name, [_tree(rnd, depth + 1) for _ in range(rnd.randint(1, 4))]


def _html(node):
    if isinstance(node, str):
        return node
    tag, name, children = node
    return f"<{tag}{f' class="{name}"' if name else ''}>" + "".join(map(_html, children)) + f"</{tag}>"


def _walk(node, sure=False):
    """Characters below a node that are not within what goes in any case."""
    if isinstance(node, str):
        return 0 if sure else len(node)
    return sum(_walk(c, sure or node[0] in ("nav", "aside")) for c in node[2])


def _kept(node, all_, paths, out):
    tag, name, children = node
    if tag in ("nav", "aside"):
        return
    least = {"sidebar": 0.9, "ad box": 0.9, "entry related": 0.3}.get(name, 0.5 if tag == "form" else 0)
    if _walk(node) < least * all_:
        return
    if tag in ("body", "div", "section", "article"):
        kind = ".".join(sorted(name.replace("3", "#").split()))
        paths = [*paths, paths[-1] + f"/{tag}" + (f".{kind}" if kind else "")]
    for c in children:
        if isinstance(c, str):
            out.append((c, paths))
        else:
            _kept(c, all_, paths, out)


def test_random_pages_against_a_walk_of_the_tree():
    rnd = random.Random(4)
    for _ in range(300):
        tree = _tree(rnd)
        out = []
        _kept(tree, _walk(tree), [""], out)
        sums = {}
        for text, paths in out:
            for path in paths:
                sums[path] = sums.get(path, 0) + len(text)
        page = h.Page(_html(tree))
        assert page.texts == [t for t, _ in out]
        assert page.scores() == {p: n * (h._leaning(p) if p else 60) for p, n in sums.items()}
        for path in sums:
            assert page.under(path) == [t for t, paths in out if path in paths]


def test_the_vote_changes_what_a_page_alone_would_give(spark):
    def page(main, side):
        return f"<body><div class='story-{rnd.randint(1, 9)}'><p>{main}</p></div><div class='feed'><p>{side}</p></div></body>"

    rnd = random.Random(2)
    usual = [page("words of the story " * 30, "other news " * 3) for _ in range(8)]
    brief = page("a brief story", "other news " * 30)
    assert h.main_text(brief, None) == ("other news " * 30).strip() or h.main_text(brief, None).startswith("a brief story")
    rows = [(i, f"https://a.example/{i}", html) for i, html in enumerate([*usual, brief])]
    rows += [(100 + i, f"https://b.example/{i}", page("a brief story", "the feed is the text of this host " * 20)) for i in range(5)]
    got = {r["page_id"]: r["text"] for r in h.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[8] == "a brief story"
    assert all(got[100 + i] == ("the feed is the text of this host " * 20).strip() for i in range(5))
