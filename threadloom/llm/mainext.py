"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped into lines, one for each block of text in page order.  A
line weighs its length, or nothing where it lies in something else than the
article (menus, headers, footers, side bars, notices, adverts, forms, comments)
or is mostly links.  Weights are summed over a sliding window of lines; no
window crosses the edge of an ``article`` or ``main``.  The sums rise to a surge
point (``SURGE``, or the page's largest sum where that is less) and fall back to
nothing at a dive point; the lines between a surge and its dive are a run, and
are kept whole, short ones included.  Where a run inside a marked article weighs a
quarter of the heaviest run or more, the marked articles are the text: each that
holds more than links is kept whole, however short.  Elsewhere all runs are kept.

An element is something else by its tag, role, or being hidden, or by its name:
a class or id all of whose words say so (``cookie-notice``, ``post-comments``; not
``social-science``), or one with a word that is rarely used of an article
(``google-ads``), unless it tells a state (``has-sidebar``).  None of that counts for an element that
holds a marked article of a quarter of the page's text; a name or a form
doesn't count either where the element holds nearly all text of the page, and a
name doesn't where it holds the first heading and half of the text.

Inside a marked article the text itself has a say.  Names of headings are no
names.  An id that repeats the element's first heading is a section of the article,
if nothing in it is set apart (``comments`` excepted).  An ``aside`` or a
``fieldset`` outside of a form, and a name with other words in it of which the
last is not the one that tells (``ad-hoc-analysis``) or is one that a topic may
have as well (``tasting-menu``), are set apart only if most of their text is links.
A button in the middle of a sentence is a word of it.

Character references are decoded, white space inside a block becomes one space,
and blocks are joined by line feeds.

Defined results: null and empty html give an empty text; repeated rows are
extracted alike; no tie changes the result; unclosed and stray tags are tolerated and read in linear time; a page is read
whole however long it is; an empty table gives no rows; other columns are passed
through by ``extract``, and a column ``text`` is replaced.
"""

from __future__ import annotations

import html as references
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from threadloom.llm.common import bound_batches, map_batches, table

#: Lines in a window, and the sum that makes a surge.
LINES, SURGE = 3, 40
#: Share of a line's characters inside links from which it counts as links.
LINKS = 0.5
#: Shares of the page's text: of an article that counts, of an element with the first heading, of one that holds nearly all.
ARTICLE, HEADED, ALL = 0.25, 0.5, 0.95

_words = lambda text: frozenset(text.split())
BLOCKS = _words(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol "
    "optgroup option p pre section select summary table tbody td tfoot th thead title tr ul"
)
VOID = _words("area base br col embed hr img input link meta param source track wbr")
#: Elements whose content is no markup.
RAW = _words("script style textarea title noscript template svg math iframe object canvas audio video xmp")
#: Elements that are never the article's text, whatever they are called.
APART = _words("nav footer aside dialog menu button select head fieldset label option datalist")
#: Words in class or id that name something else than the article.
NAMES = _words(
    "ad ads advert adverts advertisement advertising adsense adbox adslot banner sponsor sponsored promo promotion "
    "nav navbar navigation menu submenu breadcrumb breadcrumbs crumbs sidebar sidebars rail aside footer masthead "
    "topbar toolbar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter "
    "subscribe subscription signup signin login register paywall share sharing social related recommended "
    "recommendations teaser teasers trending popular comment comments commentlist respond reply replies disqus "
    "discussion responses reviews widget widgets pagination pager search searchform form copyright legal disclaimer "
    "skip hidden outbrain taboola"
)
#: Words of these that tell so in any company, and words that make a name tell a state instead.
STRONG = _words(
    "ad ads advert adverts advertisement advertising adsense adbox adslot sponsored cookie cookies consent gdpr newsletter "
    "breadcrumb breadcrumbs sidebar nav navbar menu submenu footer comments commentlist disqus popup outbrain taboola"
)
STATE = _words("has no not with without is are open opened closed enabled disabled allowed hide show on off")
#: Words of these that name a topic as well.
TOPICS = _words("menu nav cookie cookies consent")
HEADINGS = _words("h1 h2 h3 h4 h5 h6 hgroup")
#: Tags among ``APART`` that an article may hold as text.
INSERTED = _words("aside fieldset")
ROLES = _words("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar")
#: Words in a name that say nothing about the content.
NEUTRAL = _words(
    "site page pages post posts article articles main top bottom left right inner outer box block container wrapper wrap area section sections list item items "
    "row col column group panel bar slot unit body content text title inline fixed global primary secondary the"
)
#: Elements that are judged by what they are, not by what they are called.
PLAIN = _words("html body main article")
#: What sets an element apart: its tag, role or style; being a form; its name; or, in an article, one of these that links must confirm.
TAG, FORM, NAME, LINKED = 1, 2, 3, 4
#: Lines of a form or a named element from which it may be the whole page.
WHOLE = {FORM: 2, NAME: 3}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|"
    r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_IN_SENTENCE = re.compile(r"[^<]*</button\s*>\s*[^<\s]", re.I)


def _named(value: str, in_article: bool) -> int:
    """``NAME`` or ``LINKED`` if a name in a class or id says that something else than the article follows, or 0."""
    found = 0
    for name in value.split():
        said = [w.lower() for w in _NAME.findall(name) if not w.isdigit()]
        words = set(said)
        told = words & NAMES
        if "header" in words and not in_article:
            told = told | {"header"}
        if told and words <= told | NEUTRAL:
            return NAME
        if told & STRONG and not words & STATE:
            last = [w for w in said if w not in NEUTRAL][-1]
            if not in_article or last in STRONG and last not in TOPICS:
                return NAME
            found = LINKED
    return found


def _apart(tag: str, attributes: str, in_article: bool) -> int:
    """What sets an element apart from the article, or 0."""
    if tag in INSERTED and in_article:
        found = LINKED
    elif tag in APART or (tag == "header" and not in_article):
        return TAG
    else:
        found = FORM if tag == "form" else 0
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return found
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return TAG
        if key == "role" and value.lower() in ROLES and tag not in PLAIN:
            if value.lower() != "form":
                return TAG
            found = FORM
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return TAG
        if key in ("class", "id") and found in (0, LINKED) and tag not in ("html", "body", "main") and not (in_article and tag in HEADINGS):
            found = _named(value, in_article) or found
    return found


def _slug(text: str) -> str:
    """The id that a heading gets."""
    return "-".join(re.findall(r"\w+", text.lower()))


def _section(tag: str, attributes: str) -> str:
    """The id of an element that a section's heading may have given, or nothing."""
    if tag in ("section", "div"):
        for m in _ATTRIBUTE.finditer(attributes):
            if m[1].lower() == "id":
                name = (m[2] or m[3] or m[4] or "").strip()
                words = {w.lower() for w in _NAME.findall(name) if not w.isdigit()}
                return _slug(name) if words - NAMES - NEUTRAL or not words & STRONG else ""
    return ""


class _Lines:
    """The lines of a page (text, characters in links, apart, number of the article around it or 0)."""

    def __init__(self, page: str):
        self.found: list[tuple[str, int, int, int]] = []
        self.number = 0
        self.text: list[str] = []
        self.linked = 0
        # by element: parent, what sets it apart, article or main, weight, lines, holds the first heading
        self.parent, self.kind, self.marked = [0], [0], [False]
        self.weight, self.count, self.headed = [0], [0], [False]
        # characters in all, an id that a heading may have given, whether the first line did, whether there was a line
        self.size, self.section, self.titled, self.begun = [0], [""], [False], [True]
        self.open: list[tuple[str, int]] = []
        self.times: dict[str, int] = {}
        self.article = self.links = 0
        self.endless: set[str] = set()
        self._read(page)
        self._end()
        apart = self._judge()
        self.lines = [(line, linked, apart[at], number) for line, linked, at, number in self.found]

    def _judge(self) -> list[bool]:
        """Whether each element is something else than the article."""
        n, parent = len(self.parent), self.parent
        for i in range(n - 1, 0, -1):
            self.weight[parent[i]] += self.weight[i]
            self.count[parent[i]] += self.count[i]
            self.headed[parent[i]] |= self.headed[i]
            self.size[parent[i]] += self.size[i]
        total = self.weight[0]
        within = [False] * n  # something set apart below it
        for i in range(n - 1, 0, -1):
            within[parent[i]] |= within[i] or self.kind[i] in (TAG, FORM, NAME)
        holds = [False] * n  # a large article below it
        for i in range(n - 1, 0, -1):
            large = self.marked[i] and not self.kind[i] and self.weight[i] > 0 and self.weight[i] >= ARTICLE * total
            holds[parent[i]] |= large or holds[i]
        apart = [False] * n
        for i in range(1, n):
            kind, weight = self.kind[i], self.weight[i]
            if kind and holds[i]:
                kind = 0
            elif kind == LINKED and 2 * weight >= self.size[i]:
                kind = 0
            elif kind == NAME and self.titled[i] and not within[i]:
                kind = 0
            elif self.count[i] >= WHOLE.get(kind, len(self.found) + 1) and weight >= ALL * total:
                kind = 0
            elif kind == NAME and self.headed[i] and weight >= HEADED * total:
                kind = 0
            apart[i] = apart[parent[i]] or kind > 0
        return apart

    def _end(self) -> None:
        if self.text:
            line = " ".join(references.unescape("".join(self.text)).split())
            if line:
                at = self.open[-1][1] if self.open else 0
                self._title(line)
                self.size[at] += len(line)
                self.found.append((line, self.linked, at, self.number if self.article else 0))
                self.count[at] += 1
                self.weight[at] += len(line) if self.linked <= LINKS * len(line) else 0
            self.text, self.linked = [], 0

    def _title(self, line: str) -> None:
        """Settles whether the section around this line is titled by it; others that it begins aren't."""
        if len(self.open) > 1 and self.open[-1][0] in HEADINGS:
            above = self.open[-2][1]
            if self.section[above]:
                self.titled[above] = self.section[above] == _slug(line)
        for _, number in reversed(self.open):
            if self.begun[number]:
                break
            self.begun[number] = True
            self.section[number] = ""

    def _say(self, text: str) -> None:
        self.text.append(text)
        if self.links:
            self.linked += len(" ".join(text.split()))

    def _push(self, tag: str, attributes: str) -> None:
        kind = _apart(tag, attributes, self.article > 0)
        if not kind and tag not in BLOCKS and tag != "a":  # says nothing about where a line lies
            return
        if tag == "a" and self.links:
            self._pop("a")
        marked = tag in ("article", "main")
        self.parent.append(self.open[-1][1] if self.open else 0)
        self.kind.append(kind)
        self.marked.append(marked)
        self.weight.append(0)
        self.count.append(0)
        self.headed.append(tag == "h1" and "h1" not in self.times)
        self.size.append(0)
        self.section.append(_section(tag, attributes) if kind == NAME and self.article else "")
        self.titled.append(False)
        self.begun.append(False)
        self.open.append((tag, len(self.parent) - 1))
        self.times[tag] = self.times.get(tag, 0) + 1
        self.number += marked and (tag == "article" or not self.article)
        self.article += marked
        self.links += tag == "a"

    def _pop(self, tag: str, within: tuple[str, ...] = ()) -> None:
        if not self.times.get(tag):
            return
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                for name, _ in self.open[at:]:
                    self.times[name] -= 1
                    self.article -= name in ("article", "main")
                    self.links -= name == "a"
                del self.open[at:]
                return
            if self.open[at][0] in within:
                return

    def _read(self, page: str) -> None:
        at, size, last = 0, len(page), page.rfind(">")
        spoken = False  # inside a button that is a word of a sentence
        while at < size:
            m = _TAG.search(page, at) if at <= last else None
            if not m:
                self._say(page[at:])
                return
            if m.start() > at:
                self._say(page[at : m.start()])
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                if page.startswith("<![CDATA[", m.start()):
                    self._say(references.escape(m[0][9:].removesuffix("]]>")))
                continue
            attributes, closing = m[3] or m[6] or "", bool(m[1] or m[4])
            if tag == "button":
                if closing and spoken:
                    spoken = False
                    continue
                spoken = not closing and self.article > 0 and any(map(str.strip, self.text)) and bool(_IN_SENTENCE.match(page, at))
                if spoken:
                    continue
            if tag in BLOCKS:
                self._end()
            if closing:
                self._pop(tag)
            elif tag in RAW:
                end = None
                if tag not in self.endless:
                    end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                    if not end:
                        self.endless.add(tag)
                if not attributes.rstrip().endswith("/"):
                    at = end.end() if end else size if tag in ("script", "style") else at
            elif tag not in VOID:
                if tag == "p":
                    self._pop("p", ("article", "main", "div", "section", "td", "li", "blockquote", "body"))
                elif tag == "li":
                    self._pop("li", ("ul", "ol", "menu", "nav"))
                self._push(tag, attributes)


def runs(weights: list[int], surge: int) -> list[tuple[int, int]]:
    """(first, end) of the lines between each surge of the window sums and its dive."""
    n = len(weights)
    sums = [sum(weights[i : i + LINES]) for i in range(n)]
    found = []
    at = 0
    while at < n:
        if not weights[at] or sums[at] < surge:
            at += 1
            continue
        dive = at
        while dive < n and sums[dive]:  # a window without text
            dive += 1
        found.append((at, dive))
        at = dive
    return found


def main_text(page: str | None) -> str:
    """The article's text of one page."""
    if not page:
        return ""
    lines = _Lines(page).lines
    weights = [0 if apart or linked > LINKS * len(line) else len(line) for line, linked, apart, _ in lines]
    # stretches of lines in one article, or outside of all
    edges = [i for i in range(len(lines)) if not i or lines[i][3] != lines[i - 1][3]] + [len(lines)]
    stretches = list(zip(edges, edges[1:]))
    largest = max((sum(weights[i : min(hi, i + LINES)]) for lo, hi in stretches for i in range(lo, hi)), default=0)
    if not largest:
        return ""
    surge = min(SURGE, largest)
    found = [(sum(weights[lo + a : lo + b]), lo + a, lo + b) for lo, hi in stretches for a, b in runs(weights[lo:hi], surge)]
    heaviest = max(weight for weight, _, _ in found)
    if any(lines[a][3] and weight >= ARTICLE * heaviest for weight, a, _ in found):
        told = {lines[i][3] for i, weight in enumerate(weights) if weight and lines[i][3]}
        kept = [i for i, (_, _, apart, number) in enumerate(lines) if number in told and not apart]
    else:
        kept = [i for _, a, b in found for i in range(a, b) if not lines[i][2]]
    return "\n".join(lines[i][0] for i in kept)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``text`` in place of ``html``; a column ``text`` is replaced."""
    bound_batches(pages.sparkSession)
    passed = [c for c in pages.columns if c not in (html, "text")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*passed).schema)

    def run(batch: pa.RecordBatch) -> dict:
        found = [main_text(h) for h in batch.column(html).to_pylist()]
        return {c: batch.column(c) for c in passed} | {"text": found}

    return map_batches(pages, run, f"{schema}, text string" if passed else "text string")


def op6_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.selectExpr("page_id", "url", "text", "cast(char_length(text) AS bigint) AS n_chars")
