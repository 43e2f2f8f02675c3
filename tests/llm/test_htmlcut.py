import html
import random
import re

from rarefold.llm import htmlcut


def energy(z, edges, side):
    return sum(max(x, 0) if not s else max(-x, 0) for x, s in zip(z, side)) + sum(c for a, b, c in edges if side[a] != side[b])


def test_cut_is_the_cheapest_labelling():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randint(1, 9)
        z = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(i, i + 1, rng.choice([0.1, 0.3, 0.7, 2])) for i in range(n - 1)] + [(i, j, 0.3) for i in range(n) for j in range(i + 2, n) if rng.random() < 0.2]
        best = min(energy(z, edges, [bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert abs(energy(z, edges, htmlcut.minimum_cut(z, edges)) - best) < 1e-6


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><div id="header"><a href=x>Home</a> <a>About</a></div>
<div class="cookie-notice">We use cookies. Accept?</div><div class="wrap"><div class="content"><h1>Title&nbsp;here</h1>
<p>First paragraph of the story, with enough words to look like prose, and&#32;more &lt;b&gt;.</p><p>Second   paragraph:
also long enough, it carries on for a while so that it reads as text.<div class="share">Share on X</div><p>Short.</div>
<div class="sidebar"><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div>
<section id="comments"><article class="comment"><p>I think this is a really long reader comment which goes on and on, and on.</p></article></section>
<form><label>Mail</label><input><button>Go</button></form></div><div id="footer">&copy; 2020 Someone</div><script>if (a<b) "</p>"</script></body></html>"""


def test_page_without_semantic_elements():
    want = "Title here\n\nFirst paragraph of the story, with enough words to look like prose, and more <b>.\n\nSecond paragraph: also long enough, it carries on for a while so that it reads as text.\n\nShort."
    assert htmlcut.main_text(PAGE, htmlcut.PRIOR) == want


def test_broken_markup_never_fails():
    rng = random.Random(1)
    for _ in range(300):
        lo = rng.randrange(len(PAGE))
        broken = PAGE[lo : lo + rng.randrange(400)] + rng.choice(["<", "</", "<a href=\"", "<!--", "<script>", "&#xD800;", ""])
        htmlcut.main_text(broken, htmlcut.PRIOR)


def test_given_pages_and_awkward_rows(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r for r in htmlcut.op9_html(spark, "/root/testdata/sf0.001").collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S).group(1)
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert got[r.page_id].text == "\n\n".join(x for x in parts if x)
    odd = spark.createDataFrame([(1, None, None, 1), (None, "u", "", 2), (2, "u", "<p>" + "word " * 200000, 3), (2, "u", "no markup at all, only a line of text.", 4)], "page_id long, url string, html string, n_chars int")
    rows = {(r.page_id, r.url): r for r in htmlcut.extract(odd, htmlcut.train(odd)).collect()}
    assert rows[1, None].text == "" and rows[None, "u"].n_chars == 0
    assert sum(r.n_chars for r in htmlcut.extract(odd, htmlcut.PRIOR).collect()) >= 999999
    assert htmlcut.extract(odd.limit(0), htmlcut.train(odd.limit(0))).count() == 0


def shown(page):
    return [b.text for b in htmlcut.parse(page)[1]]


def test_hidden_is_an_attribute_not_a_word():
    for start in ('a href="/hidden-gems"', 'span title="the hidden cost"', 'article id="hidden-valley"', 'div class="overflow-hidden"', 'div class="hidden md:block"', "div data-x='display:none'", 'div hidden=false'):
        tag = start.split()[0]
        assert shown(f"<div><{start}>kept text</{tag}></div>") == ["kept text"], start
    for start in ("div hidden", 'div class=x hidden=""', 'div style="color:red; display : none"', "span style=visibility:hidden", "div HIDDEN"):
        tag = start.split()[0]
        assert shown(f"<div>a <{start}>gone<{tag}>gone</{tag}>gone</{tag}> b</div>") in (["a", "b"], ["a b"]), start


def test_left_out_end_tags_end_what_is_not_shown():
    assert shown("<html><head><title>T</title><meta charset=x><body><p>One<p>Two") == ["One", "Two"]
    assert shown("<head><title>T</title><h1>One</h1>two") == ["One", "two"]
    assert shown("<head><title>T</title>bare text") == ["bare text"]
    assert shown("<div><p hidden>gone <b>gone<p>One</div><p>Two") == ["One", "Two"]
    assert shown("<ul><li>One<li style=display:none>gone<p>gone<li>Two</ul>Three") == ["One", "Two", "Three"]
    assert shown("<table><tr><td hidden>gone<td>One<tr hidden><td>gone<tr><td>Two</table>Three") == ["One", "Two", "Three"]
    assert shown("<dl><dt>a<dd hidden>gone<dt>b</dl>") == ["a", "b"]
    assert shown("<p>One <span hidden>gone</p><p>Two") == ["One", "Two"]
    assert shown("<div><select><option>gone<option>gone<p>One</div>Two") == ["One", "Two"]
    assert shown("<div hidden><script>'</div>'</script>gone</div>One") == ["One"]


STORY = "".join(f"<p>Paragraph {w} of the story has enough words to look like prose, and it carries on for a while.</p>" for w in ("one", "two", "three"))


def test_boilerplate_names_that_wrap_the_page_keep_its_text():
    menu = '<div class="menu"><a href=1>Home</a> <a href=2>About</a></div>'
    for start in ("form id=aspnetForm", "fieldset", "dialog open", "aside", 'div class="comments-closed"'):
        tag = start.split()[0]
        for inner in (STORY, f"<article>{STORY}</article>", f"<main>{STORY}</main>"):
            got = htmlcut.main_text(f"<html><body><{start}>{menu}{inner}</{tag}></body></html>", htmlcut.PRIOR)
            assert got.count("of the story") == 3 and "About" not in got, start
            got = htmlcut.main_text(f"<html><body><main><{start}>{inner}</{tag}></main></body></html>", htmlcut.PRIOR)
            assert got.count("of the story") == 3, start
    two = htmlcut.main_text(f"<body><form>{STORY}</form><form>{STORY}</form><form><label>Mail</label><button>Go</button></form></body>", htmlcut.PRIOR)
    assert two.count("of the story") == 6 and "Mail" not in two


def test_boilerplate_names_beside_an_article_stay_boilerplate():
    talk = "<p>I think this is a really long reader comment which goes on and on, and on.</p>" * 9
    for start in ("aside", "dialog open", 'div class="comments"'):
        got = htmlcut.main_text(f"<body><article>{STORY}</article><{start}>{talk}</{start.split()[0]}></body>", htmlcut.PRIOR)
        assert got.count("of the story") == 3 and "reader" not in got, start


def test_letter_shares_are_of_the_whole_block():
    nodes, blocks = htmlcut.parse("<p>" + "a" * 400 + "B" * 200 + "7" * 200)
    x = htmlcut.text_features(nodes, blocks)[0]
    assert x[4] == 0.25 and x[5] == 0.25


def test_deep_and_unbalanced_markup_takes_linear_time():
    """A megabyte of nested, unclosed or stray tags: open elements are found by tag, the path is never searched."""
    import time

    pages = ["<div>t" * 160_000, "<div>x" * 40_000 + "</section>" * 80_000, "</a></b></div>" * 80_000, "<ul><li>w" * 100_000, "<span hidden>" * 40_000 + "<p>" * 80_000]
    for page in pages:
        start = time.process_time()
        htmlcut.parse(page)
        assert time.process_time() - start < 20  # two seconds as a rule; the search of the path took half an hour
