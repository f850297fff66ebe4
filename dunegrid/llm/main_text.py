"""Main text of web pages by the maximum-scoring subsequence.

A page is cut into tags and text runs.  Words score positive and tags negative;
the weights are log ratios learned from labelled pages (pages that mark their
article with ``<article>`` or ``<main>``; about ``sample_pages`` of them at
most, wherever they are in the table, chosen by the hash of page_id): how often
a word, a word in a link, or a tag of some name stands inside the marked
content rather than outside.  One linear scan finds
the contiguous region with the best sum.  The region's text is returned without
what is no visible text (scripts, styles, form fields, hidden elements) and
without furniture: menus, page headers, footers, sidebars, forms, notices,
adverts and reader comments, known by element name, role, class or id.  Such an
element is one bounded negative score, so the region can reach across it.
Furniture that
holds the page's content (a form around the page, widgets around the text) is
read like any other element: that of one kind (the name, the role, or the class
as written) with the best region of its own, where a mark begins inside it and
none stands outside, or where no region outside furniture scores more than
``least``.  Beside a region of content, furniture stays out whatever its length;
the same holds again inside furniture that is read.  A mark is one more, bounded feature: on a
page whose mark holds all words, a word in it scores half as much again and a
tag in it a tenth, so short blocks at its ends stay; the smaller the mark's
share of the words, the weaker it is, so a teaser in an ``<article>`` does not
beat a long text outside.  The region alone decides what is returned.

Character references are decoded, white space inside a block becomes one space,
block texts are trimmed and joined by one space in page order.  Inline tags
leave no space.  A NULL or empty html, and a page without content, has an empty
text; unclosed or stray tags are tolerated (an unclosed element ends with its
parent or the page); repeated rows give repeated results; an empty table gives
no rows.  Other columns are not read.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dunegrid.llm.common import prepare

# Element names of the HTML standard, and class words in common use.
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output "
                   "q ruby s samp small span strike strong sub sup time tt u var wbr".split())
NEVER = frozenset("script style noscript template head title select option textarea input iframe object embed svg "
                  "canvas audio video datalist noembed noframes xmp".split())
FURNITURE = frozenset("nav aside footer form button menu dialog".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar alert dialog form "
                            "alertdialog toolbar".split())
FURNITURE_WORDS = frozenset("ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored "
                            "promo promos promotion promoted sidebar aside comment comments commentlist disqus replies "
                            "cookie cookies consent gdpr notice notices notification alert banner popup modal overlay "
                            "newsletter subscribe subscription signup login social share sharing related recommended "
                            "recommendations breadcrumb breadcrumbs menu nav navbar navigation footer toolbar widget "
                            "masthead paywall pagination pager teaser teasers".split())
#: Those of an article, whose class often names the topic.
ARTICLE_WORDS = frozenset("comment comments teaser related promo ad sponsored".split())
#: A class that starts so says what is (not) beside an element: has-sidebar, no-footer.
BESIDE = frozenset("has have with without no not is hide".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 "
                     "h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES_SELF = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
               "th": ("td", "th"), "option": ("option",)}
#: An implied end does not reach past these.
SCOPE = frozenset("ul ol dl table select div section article main body html td th blockquote".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[A-Za-z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


#: What a page that marks its content holds; ``learn`` takes a sample of these.
LABELLED = r"(?i)<(article|main)[\s/>]|role\s*=\s*[\"']?main\b"
#: Steps of a sample's share.
PLACES = 1 << 40


@dataclass(frozen=True)
class Weights:
    """Scores of a word, of a word in a link, and of tags by name."""

    word: float = 1.0
    link_word: float = 0.2
    tag: float = -3.25
    tags: dict[str, float] = field(default_factory=dict)
    dropped: float = -2.0
    #: What a mark that holds all words adds to a word's score, and takes off a tag's.
    mark_word: float = 0.5
    mark_tag: float = 0.9
    #: A region without a mark that scores no more is not the page's content.
    least: float = 10.0


@dataclass
class Run:
    """A piece of the page: a text (``name`` empty), a tag, a dropped element or
    furniture (of some ``kind``, with its own pieces ``inner``)."""

    name: str
    text: str = ""
    link: bool = False
    marked: bool = False
    dropped: bool = False
    kind: str = ""
    inner: list[Run] = field(default_factory=list)


#: Furniture nested deeper than this belongs to what is around it.
MOST_NESTED = 32


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html_lib.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(text)}


def _kind(name: str, attrs: str, in_article: bool) -> tuple[bool, str]:
    """Whether an element holds no visible text, and as what furniture it is known (or "")."""
    if name in NEVER:
        return True, ""
    known = name if name in FURNITURE or (name == "header" and not in_article) else ""
    if "=" not in attrs and "hidden" not in attrs or name in ("html", "body", "main"):
        return False, known
    a = _attributes(attrs)
    if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", "")):
        return True, ""
    role = a.get("role", "").lower()
    if known or role in FURNITURE_ROLES:
        return False, known or role
    known_words = ARTICLE_WORDS if name == "article" else FURNITURE_WORDS
    found: dict[str, str] = {}  # a word and the shortest name it stands in
    for given in f"{a.get('class', '')} {a.get('id', '')}".split():
        words = [w.lower() for w in _WORDS.findall(given)]
        for word in set(words if words and words[0] not in BESIDE else ()):
            if word in known_words or (word == "header" and name != "article" and not in_article):
                found[word] = min(found.get(word, given), given, key=len)
    return False, " ".join(sorted({re.sub(r"\d+", "", x).lower() for x in found.values()}))


def runs(page: str) -> list[Run]:
    """Tags, texts, dropped elements and furniture of a page in order."""
    out: list[Run] = []
    # name, dropped, marked, link below, pieces, how deep in furniture
    open_: list[tuple[str, bool, bool, bool, list[Run], int]] = []
    outer = ("", False, False, False, out, 0)
    at, n = 0, len(page)

    def text(piece: str) -> None:
        if piece:
            top = open_[-1] if open_ else outer
            if not top[1]:
                top[4].append(Run("", html_lib.unescape(piece) if "&" in piece else piece, top[3], top[2]))

    def close(k: int) -> None:
        """Close the elements from the k-th on."""
        for name, dropped, marked, _, pieces, _ in reversed(open_[k:]):
            if not dropped:
                pieces.append(Run(name, marked=marked))
        del open_[k:]

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            break
        text(page[at:m.start()])
        at = m.end()
        name = m["name"] or m["name2"]
        if name is None:
            continue
        name, end = name.lower(), m["end"] or m["end2"]
        if end:
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == name:
                    close(k)
                    break
            else:
                if name in ("p", "br") and not (open_ and open_[-1][1]):
                    top = open_[-1] if open_ else outer
                    top[4].append(Run(name, marked=top[2]))
            continue
        attrs = m["attrs"] if m["name"] else m["attrs2"]
        if name in CLOSES_P or name in CLOSES_SELF:
            ends = ("p",) if name in CLOSES_P else CLOSES_SELF[name]
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] in ends:
                    close(k)
                    break
                if open_[k][0] in SCOPE and not (name == "tr" and open_[k][0] in ("td", "th")):
                    break
        top = open_[-1] if open_ else outer
        article = name in ("article", "main") or (name != "body" and "role" in attrs
                                                  and _attributes(attrs).get("role") == "main")
        never, kind = _kind(name, attrs, top[2])
        dropped = top[1] or never
        marked = top[2] or (article and not dropped and not kind)
        pieces, depth = top[4], top[5]
        if dropped and not top[1]:
            pieces.append(Run(name, dropped=True, marked=marked))
        elif not dropped:
            if kind and depth < MOST_NESTED and name not in VOID:
                pieces.append(Run(name, marked=marked, kind=kind))
                pieces, depth = pieces[-1].inner, depth + 1
            pieces.append(Run(name, marked=marked))
        if name in RAW:
            close_tag = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            if not dropped:
                open_.append((name, dropped, marked, top[3], pieces, depth))
                text(page[at:close_tag.start() if close_tag else n])
                close(len(open_) - 1)
            at = close_tag.end() if close_tag else n
        elif name not in VOID and not attrs.endswith("/") or name in ("div", "p", "span", "a") and attrs.endswith("/"):
            open_.append((name, dropped, marked, top[3] or name == "a", pieces, depth))
    text(page[at:])
    return out


def scores(items: list[Run], w: Weights) -> list[float]:
    lengths = [0 if r.name else len(r.text.split()) for r in items]
    share = sum(n for n, r in zip(lengths, items) if r.marked) / max(1, sum(lengths))
    more, less = 1 + w.mark_word * share, 1 - w.mark_tag * share
    out = []
    for n, r in zip(lengths, items):
        if r.name:
            v = w.dropped if r.dropped else w.tags.get(r.name, w.tag)
            out.append(v * less if r.marked else v)
        else:
            v = n * (w.link_word if r.link else w.word)
            out.append(v * more if r.marked and v > 0 else v)
    return out


def best_region(values: list[float]) -> tuple[int, int]:
    """[start, end) of the contiguous items with the greatest positive sum (the
    first, and the shortest of those that start there); (0, 0) if none is positive."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, v in enumerate(values):
        if total <= 0:
            total, start = 0.0, i
        total += v
        if total > best:
            best, found = total, (start, i + 1)
    return found


def _opened(items: list[Run], kinds: set[str]) -> list[Run]:
    """``items`` with the pieces of furniture of ``kinds``; other furniture is one dropped element."""
    out = []
    for r in items:
        if not r.kind:
            out.append(r)
        elif r.kind in kinds:
            out += r.inner
        else:
            out.append(Run(r.name, dropped=True, marked=r.marked))
    return out


def _value(items: list[Run], w: Weights) -> float:
    values = scores(items, w)
    start, end = best_region(values)
    return sum(values[start:end])


def settle(items: list[Run], w: Weights) -> list[Run]:
    """``items`` with all furniture either opened or dropped, innermost first."""
    if not any(r.kind for r in items):
        return items
    held: dict[str, float] = {}
    marks: set[str] = set()  # kinds in which a mark begins
    for r in items:
        if r.kind:
            r.inner = settle(r.inner, w)
            held[r.kind] = held.get(r.kind, 0.0) + _value(r.inner, w)
            if not r.marked and any(x.marked and x.text.strip() for x in r.inner):
                marks.add(r.kind)
    closed = _opened(items, set())
    marked = any(r.marked and r.text.strip() for r in closed)
    kinds = held.keys() if marked or not marks else marks
    if (marked or not marks) and _value(closed, w) > (0 if marked else w.least):
        return closed
    value, kind = max((held[k], k) for k in kinds)
    return _opened(items, {kind}) if kind in marks or value > w.least else closed


def main_text(page: str | None, w: Weights) -> str:
    """The article's text of one page."""
    items = settle(runs(page or ""), w)
    start, end = best_region(scores(items, w))
    parts = []
    for r in items[start:end]:
        if not r.name:
            parts.append(r.text)
        elif r.dropped or r.name not in INLINE:
            parts.append(" ")
    return " ".join("".join(parts).split())


def learn(pages: DataFrame, sample_pages: int = 2000, seed: int = 5) -> Weights:
    """Weights from about ``sample_pages`` of the labelled pages (all, when
    there are no more) of ``pages`` (page_id, html); ``Weights()`` when no page
    is labelled."""
    prepare(pages.sparkSession)
    html = F.col("html").cast("string")
    labelled = pages.filter(html.rlike(LABELLED))
    share = min(1.0, sample_pages / max(1, labelled.count()))
    place = F.pmod(F.xxhash64(F.lit(seed), F.col("page_id").cast("long")), F.lit(PLACES))
    sample = pages.filter(place < math.ceil(share * PLACES)).filter(html.rlike(LABELLED)).select(html.alias("html"))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        for b in batches:
            for page in b.column("html"):
                items = settle(runs(page.as_py() or ""), Weights())
                if not any(r.marked for r in items):
                    continue
                for r in items:
                    kind = f"<{r.name}" if r.name else "link" if r.link else "word"
                    c = counts.setdefault(kind, [0, 0])
                    c[0 if r.marked and not r.dropped else 1] += 1 if r.name else len(r.text.split())
        if counts:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(counts)), pa.array([c[0] for c in counts.values()], pa.int64()),
                 pa.array([c[1] for c in counts.values()], pa.int64())], names=["kind", "inside", "outside"])

    found = (sample.mapInArrow(tally, "kind string, inside long, outside long").groupBy("kind")
             .agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")))  # a row per name of a tag
    ratio = {r["kind"]: math.log((r["inside"] + 1) / (r["outside"] + 1)) for r in found.collect()}
    if "word" not in ratio:
        return Weights()
    word = max(0.1, ratio["word"])
    return Weights(
        word=1.0, link_word=min(1.0, ratio.get("link", 0.2 * word) / word),
        tags={k[1:]: min(-0.05, max(-10.0, v / word)) for k, v in ratio.items() if k[0] == "<"})


def extract(pages: DataFrame, weights: Weights) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    prepare(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py(), weights) for h in b.column("html")]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
