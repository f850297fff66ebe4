"""Main text extraction on small pages, and on the given ones."""

import html
import re

import pytest

from dunegrid.llm import main_text, queries
from dunegrid.llm.main_text import Weights, best_region, runs
from tests.llm.test_files import PAGES, SF

W = Weights()
BODY = "<p>One two three four five six seven eight nine ten eleven twelve.</p>"
TEXT = "One two three four five six seven eight nine ten eleven twelve."


def page(inner, before="", after=""):
    return (f"<!DOCTYPE html><html><head><title>T t</title><style>p{{margin:0}}</style><script>var t='</p>';</script>"
            f"</head><body class='has-sidebar'>{before}<article>{inner}</article>{after}</body></html>")


CASES = {
    "plain": (page(BODY), TEXT),
    "title": (page("<h1>Big  title</h1>" + BODY), "Big title " + TEXT),
    "furniture": (page(BODY, "<header><p>Site name and slogan of many words here</p></header><nav><ul><li><a href='/'>Home"
                       "</a></li></ul></nav><div class='ad'>Buy this now and save a lot of money today friends</div>"
                       "<div id='cookie-notice'>We use cookies for all kinds of things you know</div>",
                       "<aside><p>Side side side side</p></aside><section class='comments'><p>First! A long reader "
                       "comment with many words that should not count at all really.</p></section>"
                       "<form><label>Mail</label><input><button>Go</button></form><footer>&copy; me</footer>"), TEXT),
    "inside": (page("<p>Begin here.</p><div class='advert'>Buy it now</div><script>x()</script><!-- no > --><aside>s"
                    "</aside>" + BODY + "<div class=\"reader-comments\"><p>Nice</p></div><form>Sign <b>up</b></form>"),
               "Begin here. " + TEXT),
    "references": (page("<p>a &amp; b&nbsp;&lt;c&gt; &#228;&#xE4; &quot;q&quot; &amp;lt;</p>" + BODY),
                   'a & b <c> ää "q" &lt; ' + TEXT),
    "inline": (page("<p>al<b>pha</b> <i>be</i>ta<br>gamma</p><p>de\n\n lta</p>" + BODY), "alpha beta gamma de lta " + TEXT),
    "unclosed": (page("<p><b>One two<br><p>three<p>four" + BODY), "One two three four " + TEXT),
    "cut off": (page(BODY)[:-20], TEXT),
    "no end": ("<body><nav><a>x</a></nav><article>" + BODY + "<p>tail", TEXT + " tail"),
    "less than": (page("<p>1 < 2 and 3 > 2</p>" + BODY), "1 < 2 and 3 > 2 " + TEXT),
    "quotes": (page("<p title='a > b' data-x=\"</p>\">ok</p>" + BODY), "ok " + TEXT),
    "bare div": ("<html><body><ul><li><a href=1>Home</a></li><li><a href=2>News</a></li></ul><div><div>" + BODY * 3
                 + "</div></div><div class=footer>bye bye</div></body></html>", " ".join([TEXT] * 3)),
    "list": (page("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>" + BODY), "a b c d e " + TEXT),
    "none": ("", ""), "null": (None, ""), "tags only": ("<p></p><div></div>", ""), "text only": ("just a text", "just a text"),
    "long": (page(BODY * 20_000), " ".join([TEXT] * 20_000)),
    "stray quote": (page("<p class=\"x>y</p>" + BODY), None),
    "open tag": ("<article>" + BODY + "<p", TEXT),
}


@pytest.mark.parametrize("name", CASES)
def test_small_pages(name):
    given, expected = CASES[name]
    got = main_text.main_text(given, W)
    assert expected is None or got == expected


def test_best_region_against_brute_force():
    import random

    rng = random.Random(4)
    for _ in range(300):
        v = [rng.choice([-3, -1, 0, 1, 2]) for _ in range(rng.randint(0, 12))]
        a, b = best_region(v)
        top = max((sum(v[i:j]) for i in range(len(v)) for j in range(i, len(v) + 1)), default=0)
        assert sum(v[a:b]) == top


def test_given_pages(spark):
    rows = queries.op4_main_text(spark, SF).collect()
    given = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert sorted(r.page_id for r in rows) == sorted(given)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", given[r.page_id].html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in
                  re.split(r"</?(?:p|h1|br)>", article)]
        assert r.text == " ".join(x for x in blocks if x) and r.n_chars == len(r.text)
        assert r.url == given[r.page_id].url


def test_learned_weights(spark):
    w = main_text.learn(spark.read.parquet(f"{SF}/pages.parquet"))
    assert w.word > 0 and w.link_word <= 1 and w.tags["body"] < w.tags["p"] < 0
    for given, expected in CASES.values():
        if expected is not None:
            assert main_text.main_text(given, w) == expected


def test_odd_rows(spark):
    rows = [(1, "u", None), (None, None, page(BODY)), (2, "v", ""), (2, "v", "")]
    df = spark.createDataFrame([(*r, "c", "c") for r in rows], PAGES)
    got = sorted(((r.page_id or 0, r.text, r.n_chars) for r in main_text.extract(df, main_text.learn(df)).collect()))
    assert got == [(0, TEXT, len(TEXT)), (1, "", 0), (2, "", 0), (2, "", 0)]
    assert main_text.extract(df.limit(0), main_text.learn(df.limit(0))).collect() == []
    assert main_text.learn(df.filter("page_id = 1")) == Weights()
    assert [r.name for r in runs("<br/>x")] == ["br", ""]


def words(first, n):
    return " ".join(f"{first}{i}" for i in range(n))


@pytest.fixture(scope="module")
def learned(spark):
    return main_text.learn(spark.read.parquet(f"{SF}/pages.parquet"))


@pytest.mark.parametrize("n_cards", [1, 6])
def test_teaser_articles_do_not_replace_the_text(learned, n_cards):
    body = words("body", 1000)
    card = "<article class='card'><h3><a href='/x'>Next story</a></h3><p>Read all about it here</p></article>"
    given = f"<html><body><div id='content'><p>{body}</p></div><div>{card * n_cards}</div></body></html>"
    for w in (W, learned):
        assert main_text.main_text(given, w).startswith(body)
    assert main_text.main_text(given, W) == body


def test_several_marked_regions(learned):
    one, between, two = words("one", 100), words("between", 150), words("two", 80)
    given = (f"<html><body><article><p>{one}</p></article><div><p>{between}</p></div>"
             f"<article><p>{two}</p></article></body></html>")
    for w in (W, learned):
        assert main_text.main_text(given, w) == f"{one} {between} {two}"


def test_marked_text_uses_the_weights_of_tags_and_links():
    given = "<article><x-menu>a b c d</x-menu><x-menu></x-menu><p>" + words("w", 40) + "</p></article>"
    assert main_text.main_text(given, W).startswith("a b c d")
    assert main_text.main_text(given, Weights(tags={"x-menu": -100.0})) == words("w", 40)


WRAPPERS = ["<form id='aspnetForm' action='/'>", "<div class='content has-sidebar'>", "<div class='no-sidebar'>",
            "<div class='elementor-widget-theme-post-content'>", "<div id='page' class='with-footer'>",
            "<form><div class='no-sidebar'>", "<section role='form'>"]
AROUND = ("<header><p>Site name here</p></header><nav><ul><li><a href='/'>Home</a></li></ul></nav>",
          "<div class='sidebar'><p>Popular things of this week</p></div><section class='comments'><p>First! A long "
          "reader comment</p></section><form><label>Mail</label><button>Go</button></form><footer>&copy; me</footer>")


@pytest.mark.parametrize("wrapper", WRAPPERS)
@pytest.mark.parametrize("inner", ["<article><h1>Big title</h1>{}</article>", "<div>{}</div>"])
def test_furniture_around_the_text(learned, wrapper, inner):
    body = words("w", 300)
    ends = "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", wrapper)))
    text = inner.format(f"<p>{body}</p>")
    for given in (f"<body>{wrapper}{AROUND[0]}{text}{AROUND[1]}{ends}</body>",
                  f"<body>{AROUND[0]}{wrapper}{text}{ends}{AROUND[1]}</body>"):
        for w in (W, learned):
            got = main_text.main_text(given, w)
            assert got == ("Big title " if "h1" in inner else "") + body


def test_text_in_several_widgets():
    parts = [words(f"p{i}x", n) for i, n in enumerate((300, 12, 80, 200))]
    widgets = "".join(f"<div class='elementor-widget'><p>{p}</p></div>" for p in parts)
    assert main_text.main_text(f"<body>{AROUND[0]}<div>{widgets}</div>{AROUND[1]}</body>", W) == " ".join(parts)


def test_long_furniture_beside_a_longer_text_stays_out():
    body = words("w", 1000)
    given = f"<body><div><p>{body}</p></div><section class='comments'><p>{words('c', 300)}</p></section></body>"
    assert main_text.main_text(given, W) == body
    assert main_text.main_text(f"<form>{given}</form>", W) == body


ASIDE = {
    "comments after": ("<article><p>{0}</p></article><section class='comments'><p>{1}</p></section>", 100, 500),
    "footer": ("<article><p>{0}</p></article><footer><p>{1}</p></footer>", 60, 300),
    "cookie notice": ("<div id='cookie-notice'><p>{1}</p></div><article><p>{0}</p></article>", 60, 300),
    "aside in main": ("<main><p>{0}</p><aside><p>{1}</p></aside></main>", 60, 300),
    "comments inside": ("<article><p>{0}</p><div class='reader-comments'><p>{1}</p></div></article>", 100, 500),
    "without a mark": ("<div><p>{0}</p></div><div class='sidebar'><p>{1}</p></div>", 60, 3000),
    "in a page-wide form": ("<form id='f'><article><p>{0}</p></article><section id='comments'><p>{1}</p></section></form>", 60, 500),
    "short text": ("<article><p>{0}</p></article><section class='comments'><p>{1}</p></section>", 6, 500),
    "teaser in the footer": ("<article><p>{0}</p></article><footer><article><p>{1}</p></article></footer>", 60, 300),
    "mark in a wrapper": ("<form><main><p>{0}</p></main></form><div><p>{1}</p></div>", 200, 30),
    "wrapper says what is beside": ("<div class='with-sidebar'><p>{0}</p></div><div class='sidebar'><p>{1}</p></div>", 40, 900),
}


@pytest.mark.parametrize("name", ASIDE)
def test_furniture_stays_out_whatever_its_length(learned, name):
    given, n, long = ASIDE[name]
    body = words("w", n)
    given = f"<html><body><nav><a href='/'>Home</a></nav>{given.format(body, words('c', long))}</body></html>"
    for w in (W, learned):
        got = main_text.main_text(given, w)
        assert got == body or name == "mark in a wrapper" and got.startswith(body)


def test_deeply_nested_furniture():
    body = words("w", 300)
    assert main_text.main_text("<div class='ad'>" * 3000 + body, W) == body


def test_few_labelled_pages_among_many_teach(spark):
    """The sample is one of labelled pages, and rare tag names count."""
    rare = "".join(f"<x-t{i}>a</x-t{i}>" for i in range(300))
    labelled = f"<body><rare-menu>a b</rare-menu>{rare}<article>{BODY * 9}</article></body>"
    other = "<body><div><p>some text</p></div></body>"
    rows = [(i, "u", labelled if i % 200 == 7 else other, "c", "c") for i in range(4000)]
    w = main_text.learn(spark.createDataFrame(rows, PAGES), sample_pages=40)
    assert w.tags["p"] == -0.05 and w.tags["rare-menu"] < -0.05
    assert sum(k.startswith("x-t") for k in w.tags) == 300
    for mark in ("<main >", "<MAIN\n id='x'>", "<div role=main>", "<div ROLE = 'main'>"):
        one = spark.createDataFrame([(1, "u", f"{mark}{BODY}", "c", "c")], PAGES)
        assert ("p" in main_text.learn(one).tags) == any(r.marked for r in runs(f"{mark}{BODY}"))
