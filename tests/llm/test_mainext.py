import html as references
import random
import re
import time
from html.parser import HTMLParser

import pytest

from threadloom.llm import mainext

PAGES = "page_id long, url string, html string"

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>if(a<b){"</p>"}</script><style>p{}</style></head>
<body class="has-sidebar"><header class="site-header"><div>My Site</div><nav><a href=/>Home</a></nav></header>
<div id="cookie-notice">We use cookies to improve your experience on this website and to show adverts. <button>OK</button></div>
<div class="content"><h1>Title of the story</h1><p>First paragraph, long enough to count as text &amp; more, really   it
is.</p><p>Short.</p><ul><li>item one<li>item two</ul><div class="ad-slot">Buy now! The best product ever made in the
history of things.</div><p>Second paragraph with <a href=x>a link</a> that is also rather long and readable.</p></div>
<aside><p>Something else that has a long text but is in the side bar, so it must be dropped from the text.</p></aside>
<form><label>Name</label><input><textarea>hello</textarea></form>
<section id="comments"><h2>Comments</h2><div><p>I really like this article a lot and want to tell everyone, thanks for
writing it all down.</p></div></section><footer>&copy; 2024 site</footer></body></html>"""
TEXT = """Title of the story
First paragraph, long enough to count as text & more, really it is.
Short.
item one
item two
Second paragraph with a link that is also rather long and readable."""


def test_page_without_article():
    assert mainext.main_text(PAGE) == TEXT


def test_marked_article_keeps_short_blocks():
    page = '<nav><li><a href="/a">x</a></nav><!-- <p>no</p> --><div class="ad">long advert text here, rather long</div><article><header><h1>H</h1></header><p>a<br>b<p>c &lt;x&gt; 1 < 2<div class="share">no</div></article><p>out</p><footer>f'
    assert mainext.main_text(page) == "H\na\nb\nc <x> 1 < 2"


def test_odd_pages():
    assert mainext.main_text(None) == mainext.main_text("") == ""
    assert mainext.main_text("<p>short") == "short"
    assert mainext.main_text("<article>x") == "x"
    assert mainext.main_text("<script>never closed <article>x") == ""
    assert mainext.main_text("</p></div><main>" + "é&nbsp;b " * 3 + "</main>") == "é b é b é b"
    assert len(mainext.main_text("<p>" + "word " * 300_000)) == 1_499_999
    assert mainext.main_text("<a \"<b '" * 2000) is not None


def test_links_are_no_text():
    menu = "".join(f'<p><a href="/{i}">A rather long headline of another page, number {i}</a></p>' for i in range(30))
    assert mainext.main_text(menu + "<p>x</p>" * 5 + "<p>" + "The text itself. " * 20 + "</p>" + menu).startswith("x\nx")
    assert "headline" not in mainext.main_text(menu + "<p>" + "The text itself. " * 20 + "</p>" + menu)


def test_tables_of_pages(spark, sf_dir, save):
    """On these pages the article element holds the text; a plain reading of it gives the same."""
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    found = {r["page_id"]: r for r in mainext.op6_line_blocks(spark, sf_dir).collect()}
    for r in rows:
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(references.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", body)]
        want = "\n".join(b for b in blocks if b)
        assert found[r["page_id"]]["text"] == want and found[r["page_id"]]["n_chars"] == len(want)
    folder = save("pages", [(1, None, None), (1, None, None), (None, "u", "<article>é</article>")], PAGES)
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in mainext.op6_line_blocks(spark, folder).collect()) == [(0, "é", 1), (1, "", 0), (1, "", 0)]
    assert mainext.op6_line_blocks(spark, save("pages", [], PAGES)).count() == 0
    clash = spark.createDataFrame([("<article>a</article>", "old")], "html string, text string")
    assert mainext.extract(clash).first()["text"] == "a"


class Plain(HTMLParser):
    """Lines of a well-formed page, each with the elements around it."""

    def __init__(self, page):
        super().__init__()
        self.stack, self.lines, self.text, self.links, self.names = [], [], "", 0, 0
        self.feed(page)
        self.line()

    def line(self):
        if self.text.strip():
            self.lines.append((" ".join(self.text.split()), self.links, list(self.stack)))
        self.text, self.links = "", 0

    def handle_starttag(self, tag, attributes):
        if tag != "a" and tag != "b":
            self.line()
        self.names += 1
        self.stack.append((tag, dict(attributes).get("class", ""), self.names))

    def handle_endtag(self, tag):
        if tag != "a" and tag != "b":
            self.line()
        self.stack.pop()

    def handle_data(self, data):
        self.text += data
        if any(tag == "a" for tag, _, _ in self.stack):
            self.links += len(" ".join(data.split()))


def plain_text(page):
    """The line-block method with nothing shared or precomputed, for the names of ``random_page``."""
    lines = Plain(page).lines
    weight = [len(t) if 2 * n <= len(t) else 0 for t, n, _ in lines]
    within = lambda e: [i for i in range(len(lines)) if e in lines[i][2]]
    mass = lambda e: sum(weight[i] for i in within(e))
    elements = {e for _, _, around in lines for e in around}
    first_h1 = min((e[2] for e in elements if e[0] == "h1"), default=None)

    def kind(e):
        return 1 if e[0] in ("nav", "aside", "footer") else 2 if e[0] == "form" else 3 if e[1] in ("ad", "cookie-notice", "post-comments") else 0

    def apart(e):
        inside = {x for i in within(e) for x in lines[i][2][lines[i][2].index(e) + 1 :]}
        if any(x[0] == "article" and not kind(x) and 0 < mass(x) >= sum(weight) / 4 for x in inside):
            return False
        if kind(e) > 1 and len(within(e)) >= kind(e) and mass(e) >= 0.95 * sum(weight):
            return False
        if kind(e) == 3 and any(x[2] == first_h1 for x in inside) and mass(e) >= sum(weight) / 2:
            return False
        return kind(e) > 0

    out = [any(apart(e) for e in around) for _, _, around in lines]
    article = [max([e[2] for e in around if e[0] == "article"], default=0) for _, _, around in lines]
    w = [0 if o else x for o, x in zip(out, weight)]
    n = len(w)
    block = [sum(w[j] for j in range(i, min(n, i + 3)) if article[i : j + 1] == [article[i]] * (j + 1 - i)) for i in range(n)]
    if not any(block):
        return ""
    runs, i = [], 0
    while i < n:
        if w[i] and block[i] >= min(40, max(block)):
            j = i
            while j < n and block[j] and article[j] == article[i]:
                j += 1
            runs.append((i, j))
            i = j
        else:
            i += 1
    heavy = max(sum(w[a:b]) for a, b in runs)
    if any(article[a] and 4 * sum(w[a:b]) >= heavy for a, b in runs):
        text = {article[i] for i in range(n) if w[i] and article[i]}
        keep = [i for i in range(n) if article[i] in text]
    else:
        keep = [i for a, b in runs for i in range(a, b)]
    return "\n".join(lines[i][0] for i in keep if not out[i])


def random_page(rng, article):
    words = lambda a, b: " ".join("word"[: rng.randint(1, 4)] for _ in range(rng.randint(a, b)))
    link = lambda: f"<a>{words(1, 6)}</a>"
    paragraph = lambda: f"<p>{words(1, rng.choice([2, 5, 40]))}{rng.choice(['', '', ' ' + link()])}</p>"
    menu = lambda: f"<{(tag := rng.choice(['nav', 'div', 'aside', 'footer']))}>" + "".join(f"<p>{link()}</p>" for _ in range(rng.randint(1, 6))) + f"</{tag}>"
    name = lambda: rng.choice(["ad", "cookie-notice", "post-comments", "has-sidebar", "social-science", "content"])
    extra = lambda: f'<div class="{name()}">' + "".join(paragraph() for _ in range(rng.randint(1, 4))) + "</div>"
    body = f"<h1>{words(1, 5)}</h1>" + "".join(rng.choice([paragraph, paragraph, paragraph, extra])() for _ in range(rng.randint(0, 9)))
    if article:
        body = f"<article>{body}</article>" + rng.choice(["", f"<article>{paragraph()}</article>"])
    for _ in range(rng.randint(0, 2)):
        body = rng.choice(['<div class="{}">'.format(name()) + body + "</div>", f"<form>{body}</form>", f"<div>{body}</div>", f"<aside>{body}</aside>"])
    around = [rng.choice([menu, extra, paragraph])() for _ in range(rng.randint(0, 4))]
    at = rng.randint(0, len(around))
    return "<body>" + "".join(around[:at]) + body + "".join(around[at:]) + "</body>"


def test_against_plain_line_blocks():
    rng, kept = random.Random(3), 0
    for number in range(4000):
        page = random_page(rng, number % 2)
        found = mainext.main_text(page)
        assert found == plain_text(page), page
        kept += bool(found)
    assert kept > 3500


TWO = "<p>First paragraph, which is long enough to count as the text of a page.</p><p>Second.</p>"
WANT = "First paragraph, which is long enough to count as the text of a page.\nSecond."


def test_names_empty_no_article():
    for before, after in (
        ('<div class="layout has-sidebar"><article>', "</article></div>"), ('<article class="post comments-open">', "</article>"),
        ('<div class="container no-header">', "</div>"), ('<div class="social-science">', "</div>"),
        ('<article><div class="legal-analysis">', "</div></article>"), ('<form id="aspnetForm"><div><h2>', "</h2></div></form>"),
        ('<div class="content-sidebar-wrap"><main>', "</main></div>"), ('<div class="social"><article>', "</article></div>"),
    ):
        assert mainext.main_text(f'<nav><a href="/">Home</a></nav>{before}{TWO}{after}<footer>f</footer>') == WANT
    named = '<div class="{}"><p>Something that is no part of the article, in as many words as the article.</p></div>'
    for name in ("ad", "site-header", "cookie-notice", "post-comments", "newsletter signup", "sidebarLeft", "related_posts", "google-ads", "userComments", "mega-menu x"):
        assert mainext.main_text(TWO + named.format(name)) == WANT == mainext.main_text(named.format(name) + TWO)


LINE = "This sentence belongs to the article and is as long as the others are."


def test_articles_keep_sections_with_ambiguous_names():
    """Names, ids of headings, asides, field sets and buttons that an article has as text."""
    menu, foot = '<nav><a href="/">Home</a></nav>', "<footer>f</footer>"
    for inner, want in (
        (f'<section id="discussion"><h2>Discussion</h2><p>{LINE}</p></section>', f"Discussion\n{LINE}"),
        (f'<div id="related"><h3>Related</h3><p>{LINE}</p></div>', f"Related\n{LINE}"),
        (f'<h2 id="discussion">Discussion</h2><p>{LINE}</p>', f"Discussion\n{LINE}"),
        (f'<h2 id="baking-cookies">Baking cookies</h2><p>{LINE}</p>', f"Baking cookies\n{LINE}"),
        (f'<section id="baking-cookies"><h2>Baking cookies</h2><p>{LINE}</p></section>', f"Baking cookies\n{LINE}"),
        (f'<div class="ad-hoc-analysis"><p>{LINE}</p></div>', LINE),
        (f'<div class="tasting-menu"><p>{LINE}</p></div>', LINE),
        (f"<fieldset><p>{LINE}</p></fieldset>", LINE),
        (f"<aside><p>{LINE}</p></aside>", LINE),
        ("<p>Press the <button>Start</button> key to go on with it.</p>", "Press the Start key to go on with it."),
    ):
        assert mainext.main_text(f"{menu}<article>{TWO}{inner}</article>{foot}") == f"{WANT}\n{want}", inner
        assert mainext.main_text(f"{menu}<article>{inner}{TWO}</article>{foot}") == f"{want}\n{WANT}", inner


def test_articles_lose_what_is_something_else():
    for inner in (
        f'<section id="comments"><h2>Comments</h2><p>{LINE}</p></section>',
        f'<section id="discussion"><h2>Discussion</h2><div class="comment"><p>{LINE}</p></div></section>',
        f'<section id="discussion"><h2>Join in</h2><p>{LINE}</p></section>', f'<div class="discussion"><h2>Discussion</h2><p>{LINE}</p></div>',
        f'<section id="discussion"><p>{LINE}</p><h2>Discussion</h2></section>',
        f'<div class="google-ads"><p>{LINE}</p></div>', f'<div class="in-article-ad"><p>{LINE}</p></div>',
        '<aside><p><a href="/x">Another story that you may like as well</a></p></aside>', '<div class="chapter-menu"><a href="/1">One</a> <a href="/2">Two</a></div>',
        f"<form><fieldset><p>{LINE}</p></fieldset></form>", f'<aside class="sidebar"><p>{LINE}</p></aside>', "<p><button>Print</button></p>",
    ):
        assert mainext.main_text(f"<article>{TWO}{inner}</article>") == WANT, inner
    assert mainext.main_text(f"<article>{TWO}</article><aside><p>{LINE}</p></aside>") == WANT


def test_stray_tags_take_linear_time():
    for page in ("<b>" * 50_000 + "</i>" * 50_000, "<p><td>" + "<b>" * 50_000 + "<p></p>" * 50_000, "<title>" * 100_000, "<a " * 100_000, "<a>" * 50_000 + "<p>x</p>" * 50_000, "<article>x" + "<button>" * 100_000, "<article>" + "<div>" * 30_000 + "<p>x</p>" * 30_000, "<article>" + "<section id=discussion><h2>" * 50_000):
        began = time.process_time()
        mainext.main_text(page)
        assert time.process_time() - began < 3


STORY = "<h1>Big title</h1><p>This is the first paragraph of the text, it has quite some words in it.</p><p>Short one.</p><h2>Part</h2><ul><li>one</li><li>two</li></ul><p>And the last paragraph of the text, which ends here with a sentence.</p>"
COMMENTS = "<h3>3 Comments</h3><div class='comment'><p>I really liked this, thanks for the article, it helped me a lot with my work.</p></div><div class='comment'><p>Me too, although I would have written it in another way and with more words.</p></div>"
USUAL = {
    "wp": f"<body class='single has-sidebar'><div id='page'><header id='masthead' class='site-header'><p>My blog, a tagline of the site</p></header><div id='content' class='site-content'><div id='primary'><div class='entry-content'>{STORY}</div><div id='comments' class='comments-area'>{COMMENTS}</div></div><div id='secondary' class='widget-area'><p>About me: this is a text about the author that is long enough to count.</p></div></div><footer>c 2020</footer></div></body>",
    "article": f"<body><nav><a href=/>x</a></nav><main><article><header>{STORY[:18]}</header>{STORY[18:]}<footer>Posted by me in some category of the site</footer></article><section id='comments'>{COMMENTS}</section></main><aside><p>Side bar text which is long enough to be counted as text here.</p></aside></body>",
    "comments_in_article": f"<article>{STORY}<section class='comments'>{COMMENTS}</section><div class='ad'>Buy this thing now, it is the best thing that money can buy today.</div></article>",
    "notice": f"<div class='cookie-banner'><p>We use cookies to improve your experience on this site and others.</p></div><div>{STORY}</div>",
    "form": f"<div>{STORY}</div><form class='contact'><p>Leave your name and address in this form so that we can call you.</p></form>",
    "footer_div": f"<div>{STORY}</div><div class='footer'><p>Copyright 2020 by the owner of this site, all rights are reserved.</p></div>",
    "reader": f"<article>{STORY}</article><article class='comment'><p>Comment in an article element that is long enough to be text.</p></article>",
    "teasers": f"<div id=main>{STORY}</div><div class='related'><article><a href=x>Other story</a></article><article><a href=y>Another story</a></article></div>",
}


@pytest.mark.parametrize("name", sorted(USUAL))
def test_usual_pages(name):
    """The story and nothing else, on pages built in the usual ways."""
    want = [" ".join(re.sub("<[^>]+>", "", x).split()) for x in re.split("</?(?:h1|h2|p|ul|li)>", STORY)]
    assert mainext.main_text(USUAL[name]) == "\n".join(x for x in want if x)
