"""Main text of web pages by a maximum-scoring subsequence.

A page is read once into events: words and tags, each of a kind. Kinds are plain words, words of links, words that an element's
name, role, class or id tells to be menus, footers, adverts and the like, and tags by name. What an event of each kind is worth
follows from labelled pages: words gain what their share within the labelled content is above a half, and cost what it is below;
tags cost by how often they stand outside of it. A linear scan finds the contiguous run of events of the highest score; the
blocks it touches are the text. It begins and ends with words that gain; words told by an element between such words are left out.
White space within a block becomes one space, blocks are joined by line feeds in page order.

So that a run can go on after it, an element that is told costs at most BRIDGE words, and next to nothing within an article; links
cost at most LINKED words a block. Classes and ids that may as well name what a text is about tell only elements whose
words are mostly links; headings are never told by them, nor is anything within an article but containers.

Comments, scripts, styles and forms' controls are no events. An element that is never closed ends where an article or a main
element opens, and so does one that would hold an article with most of the page's words. A null page counts as empty, a page
without words has the text "". Rows keep their page_id and url, null or repeated, one for one; further columns are left behind.
An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import functools
import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import python_pass, slices

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)"
    r"|[^<]+|<",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_BARE_HIDDEN = re.compile(r"\shidden(?=[\s/]|\Z)", re.IGNORECASE)

#: Elements whose content is no text of the page.
RAW = {"script", "style", "title", "textarea", "iframe", "noscript", "template", "svg", "math", "object", "canvas", "audio", "video", "select", "xmp", "noembed", "noframes"}
#: Elements that never hold the article.
CHROME = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "fieldset", "header"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "form", "menu", "menubar", "toolbar", "status"}
#: Classes and ids, whole, of a page's own header; "entry-header" and the like hold the title of the article.
PAGE_HEADERS = {"header", "site-header", "top-header", "main-header", "global-header", "header-top", "header-main", "header-wrap", "header-wrapper", "header-container"}
#: Words of a class or id that mark a part beside the article.
MARKS = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promoted promotion banner banners "
    "sidebar sidebars sidenav rail menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar "
    "cookie cookies consent gdpr notice notices notification notifications popup modal overlay lightbox alert paywall disclaimer copyright legal "
    "newsletter subscribe subscription signup login signin register search share sharing social follow "
    "related recommended recommendations recommendation popular trending more-stories readmore "
    "comment comments commentlist disqus respond reply replies discussion widget widgets pagination pager skip-link skiplink".split()
)
#: Marks that are as well what a part of the text is about: id="discussion", id="In_popular_culture".
TOPICS = set(
    "advertising promotion banner banners menu menus navigation cookie cookies consent notice notices notification notifications overlay alert "
    "disclaimer copyright legal subscription register search share sharing social follow related recommended recommendations recommendation popular "
    "trending respond reply replies discussion sponsor sponsors".split()
)
#: Marks of what readers wrote.
REMARKS = {"comment", "comments", "commentlist", "disqus"}
#: Words that leave a mark what it is: class="share-buttons".
FURNITURE = set("area bar block box button buttons container count form icons inner links list outer panel post posts section slot stories unit wrap wrapper".split())
#: Elements that hold a part of a page, rather than a heading, a paragraph or words of one.
CONTAINERS = {"div", "section", "aside", "ul", "ol", "dl", "table", "ins", "center", "details"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
#: Words that turn the marks after them into their absence or a layout: class="no-sidebar", class="content-with-sidebar".
ABSENT = {"no", "has", "with", "without", "hide"}
#: Classes, whole, by which an article element of its own is a reader's comment, an advert or a teaser.
SIDE_ARTICLES = {"comment", "comments", "reply", "ad", "advert", "sponsored", "promo", "related", "teaser"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main",
    "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: What ends an open element of this name that has no end tag of its own.
ENDS = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}

#: Labelled pages of several layouts: what stands between the marks is content.
LABELLED = (
    '<body><nav><ul><li><a>home</a></li><li><a>news</a></li></ul></nav><div class="ad">buy this now</div><!--[--><article><h1>title of the page</h1>'
    "<p>first words of a long paragraph that tells a story <a>with a link</a> and goes on</p><p>and a second one</p></article><!--]--><footer>all rights reserved</footer></body>",
    "<body><div><a>home</a> <a>about us</a> <a>contact</a></div><hr><table><tr><td><a>latest</a></td><td><a>archive</a></td></tr></table>"
    "<!--[--><h2>a heading</h2><p>some <b>bold</b> and <i>other</i> words in a paragraph of the text<br>after a break</p><ul><li>one item of a list</li><li>another item</li></ul><!--]-->"
    "<div><a>terms</a> <a>privacy</a></div></body>",
    "<body><ul><li><a>a</a></li><li><a>b</a></li><li><a>c</a></li></ul><div><span><a>sign in</a></span></div><!--[--><div><p>plain words without any heading at all</p>"
    "<blockquote>what someone said at length</blockquote><pre>code line</pre><p>last words of the text</p></div><!--]--><ul><li><a>next</a></li></ul><hr></body>",
    "<body><table><tr><td><a>menu</a></td></tr></table><!--[--><main><h1>main title</h1><h3>sub title</h3><p>a paragraph <em>with stress</em> and <strong>weight</strong> in it</p>"
    "<figure><figcaption>what the picture shows</figcaption></figure><p>closing paragraph</p></main><!--]--><section><ul><li><a>x</a></li><li><a>y</a></li></ul></section></body>",
    "<body><div><a>start</a> <a>topics</a></div><!--[--><section><h1>a title</h1><div>first part of a text without paragraphs</div><div>second <span>part</span> of it</div>"
    "<section><h2>a part</h2><div>third part</div><table><tr><th>name</th><th>size</th></tr><tr><td>one</td><td>two</td></tr></table></section><div>last part</div></section><!--]-->"
    "<div><a>next</a> <a>back</a></div></body>",
    '<body><header><div class="logo">the name of the site</div><nav><a>world</a> <a>sport</a></nav></header><div id="cookie-notice"><p>we use cookies on this site</p><button>fine</button></div>'
    "<main><!--[--><article><header><h1>what happened</h1></header><p>a long report of the day begins here</p><!--]--><aside><h3>see also</h3><ul><li><a>another report</a></li></ul></aside>"
    '<!--[--><p>and goes on after what stood beside it</p><!--]--><div class="share-buttons">send this to a friend</div></article></main>'
    '<section id="comments"><h2>what readers say</h2><article class="comment"><p>I do not agree with any of this</p></article></section>'
    "<footer><p>printed and published by the firm</p><ul><li><a>contact</a></li></ul></footer></body>",
    '<body><div id="header"><h1>a journal of things</h1><p>its motto</p></div><div class="sidebar"><h3>about</h3><p>this journal is written by three friends</p></div><!--[--><div class="entry"><h2>an entry</h2>'
    '<p>words of the entry</p><!--]--><div class="related">more of it: <a>one</a> <a>two</a></div><!--[--><p>more words of the entry, as many as there were before or more</p></div><!--]--><div class="comments"><p>first comment</p><p>second comment</p></div>'
    '<div role="contentinfo">made with care</div></body>',
    '<body><div class="topbar"><a>log in</a></div><div class="newsletter"><form><p>get the letter each week</p><input></form></div><!--[--><article><h1>a guide</h1><p>how it is done</p>'
    '<ol><li>first this</li><li>then that</li></ol><!--]--><div class="ad-slot">an offer for you</div><p hidden>not to be seen</p><form><p>write to us</p></form><!--[--><h2>what is left</h2><p>nothing much is left to do</p></article><!--]-->'
    '<aside><article class="teaser"><h3>another guide</h3><p>how it is not done</p></article></aside><footer>a note</footer></body>',
)


def _told(name: str, key: str, token: str, in_article: bool) -> bool | None:
    """Whether a class or an id tells an element that isn't the text's; None if only one whose words are mostly links."""
    words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower()) if w]
    marks = {w for i, w in enumerate(words) if w in MARKS and not ABSENT.intersection(words[:i])}
    if not marks or name in HEADINGS:
        return False
    whole, plain = MARKS.union(FURNITURE).issuperset(words), not marks <= TOPICS
    if name not in CONTAINERS:
        return not in_article and key == "class" and (whole or plain and name != "p")
    if whole and marks & REMARKS:
        return True
    if in_article:
        return True if whole and name != "section" and (plain or key == "class" and len(words) > 1) else None
    return True if plain and (whole or key == "class" or name != "section") or whole and name != "section" else None


def _tells(name: str, attrs: str, in_article: bool, mostly_links: bool) -> str:
    """What tells an element that isn't the text's: its name, its own attributes, or its class or id. Empty if nothing does."""
    if name in CHROME and not (name == "header" and in_article):
        return f"<{name}>"
    if not attrs or "=" not in attrs and "hidden" not in attrs.lower() or name in ("html", "body", "main"):
        return ""
    if _BARE_HIDDEN.search(attrs):
        return "hidden"
    for m in _ATTRIBUTE.finditer(attrs):
        key, given = m[1].lower(), m[2] or m[3] or m[4] or ""
        value = given.lower()
        if key in ("class", "id"):
            if name == "article":
                if SIDE_ARTICLES.intersection(value.split()):
                    return "class"
                continue
            for token in given.split():
                if not in_article and token.lower().replace("_", "-") in PAGE_HEADERS:
                    return "class"
                told = _told(name, key, token, in_article)
                if told or told is None and mostly_links:
                    return "class"
        elif key == "role" and value in ROLES:
            return "role"
        elif key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            return "hidden"
    return ""


@dataclass
class _Token:
    """A piece of a page: text (name empty), a start tag or an end tag, or a mark of a labelled page."""

    name: str = ""
    end: bool = False
    attrs: str = ""
    text: str = ""
    #: Index of the token that closes a start tag's element.
    close: int = 0
    #: Words, and words of links, before it.
    words: int = 0
    linked: int = 0


def _tokens(page: str) -> list[_Token]:
    """The page's tokens without comments, scripts, styles and the like."""
    out: list[_Token] = []
    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.match(page, at)
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            piece = m[0]
            if piece in ("<!--[-->", "<!--]-->"):
                out.append(_Token("!", text=piece))
            elif piece.startswith("<![CDATA["):
                out.append(_Token(text=piece[9:].removesuffix("]]>")))
            elif not piece.startswith(("<!", "<?")):
                out.append(_Token(text=html.unescape(piece)))
            continue
        end, attrs = bool(m["end"] or m["end2"]), m["attrs"] or m["attrs2"] or ""
        if name in RAW:
            if not end and (not attrs.endswith("/") or name not in ("svg", "math")):
                close = re.compile(rf"</{re.escape(name)}[\s/>]", re.IGNORECASE).search(page, at)
                at = page.find(">", close.start()) + 1 or size if close else size
        else:
            out.append(_Token(name, end, attrs))
    return out


def _close(tokens: list[_Token]) -> None:
    """Finds where elements end, and counts words. One pass, however deep they nest."""
    opened: dict[str, list[int]] = defaultdict(list)
    unclosed: list[int] = []
    words = linked = in_link = 0
    mains: list[int] = []
    for i, t in enumerate(tokens):
        t.words, t.linked, t.close = words, linked, -1
        if not t.name:
            count = len(t.text.split())
            words, linked = words + count, linked + (count if in_link else 0)
        elif t.name == "!" or t.name in VOID:
            continue
        elif t.end:
            in_link -= t.name == "a" and in_link > 0
            if opened[t.name]:
                tokens[opened[t.name].pop()].close = i
        else:
            for name, ends in ENDS.items():
                if t.name in ends and opened[name]:
                    tokens[opened[name].pop()].close = i
            if t.name in ("article", "main"):
                mains.append(i)
            in_link = in_link + 1 if t.name == "a" and not in_link else in_link
            opened[t.name].append(i)
    for left in opened.values():
        unclosed += left
    for i in unclosed:
        after = bisect.bisect_right(mains, i)
        tokens[i].close = mains[after] if after < len(mains) else len(tokens)
    tokens.append(_Token(words=words, linked=linked, close=len(tokens)))


def _mostly_links(tokens: list[_Token], i: int) -> bool:
    last = tokens[tokens[i].close]
    words = last.words - tokens[i].words
    return words > 0 and 2 * (last.linked - tokens[i].linked) >= words


def _mains(tokens: list[_Token]) -> list[int]:
    """The outermost article and main elements."""
    out, until = [], 0
    for i, t in enumerate(tokens[:-1]):
        if i >= until and t.name in ("article", "main") and not t.end:
            out.append(i)
            until = t.close
    return out


def _end(tokens: list[_Token], mains: list[int], i: int) -> int:
    """Where the told element that opens at token ``i`` ends: before the page's only article, if that holds most of its words."""
    close = tokens[i].close
    within = [m for m in mains[bisect.bisect_right(mains, i) :] if m < close]
    if len(within) == len(mains) == 1 and 2 * (tokens[tokens[within[0]].close].words - tokens[within[0]].words) > tokens[-1].words:
        return within[0]
    return close


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """kind (word, link, told, tag, mark), name and text of each event.

    Names of tags within an article end with @, elsewhere those of elements whose words are mostly links with ~.

    Words of an element that something tells are ``told``, by what; its tags are no events but where blocks begin (``block``).
    """
    tokens = _tokens(page)
    _close(tokens)
    mains = _mains(tokens)
    article, links, until, by, opener = 0, 0, 0, "", ""
    linked: set[int] = set()
    for i, t in enumerate(tokens[:-1]):
        if i >= until and by:
            by = ""
            yield "told", "", ""  # it ends here
            if t.end and t.name == opener:
                yield "block", t.name, ""
                continue
        if t.name == "!":
            yield "mark", t.text, ""
        elif by:
            if not t.name:
                yield "told", by, t.text
            elif t.name in BLOCK or t.name == "br":
                yield "block", t.name, ""
        elif not t.name:
            yield "link" if links and not article else "word", "", t.text
        elif t.end:
            article -= t.name in ("article", "main") and article > 0
            links -= t.name == "a" and links > 0
            yield "tag", t.name + ("@" if article else "~" * (i in linked)), ""
        else:
            if t.name not in VOID and (by := _tells(t.name, t.attrs, article > 0, "=" in t.attrs and t.name in CONTAINERS and _mostly_links(tokens, i))):
                until, opener = _end(tokens, mains, i), t.name
                by += "@" * (article > 0)
                yield "block", t.name, ""
                continue
            article += t.name in ("article", "main")
            links += t.name == "a"
            mostly = not article and t.name not in VOID and t.name != "a" and _mostly_links(tokens, i)
            if mostly:
                linked.add(t.close)
            yield "tag", t.name + ("@" if article else "~" * mostly), ""


@dataclass(frozen=True)
class Weights:
    """Of a word of each kind, and of tags."""

    words: dict[str, float]
    tags: dict[str, float]


@functools.lru_cache(maxsize=1)
def weights() -> Weights:
    """What the labelled pages make events worth."""
    inside, outside = Counter(), Counter()
    for page in LABELLED:
        counts = outside
        for kind, name, text in events(page):
            if kind == "mark":
                counts = inside if name == "<!--[-->" else outside
            elif kind == "tag":
                counts[name] += 1
            elif kind != "block":
                counts["told" if kind == "told" else kind, ""] += len(text.split())

    def share(key: object) -> float:
        return (inside[key] + 0.5) / (inside[key] + outside[key] + 1)

    tags = {t: -max(0.02, 4 * (1 - share(t)) ** 2) for t in {*inside, *outside} if isinstance(t, str)}
    return Weights({kind: 2 * share((kind, "")) - 1 for kind in ("word", "link", "told")}, tags)


#: Words that an element's name, role, class or id tells cost at most so many words, within an article and elsewhere.
BRIDGE_WITHIN, BRIDGE = 0.1, 10.0
#: Links in one block, their words and tags, cost at most so many words.
LINKED = 4.0


def best_run(scores: Sequence[float]) -> tuple[int, int] | None:
    """First and last place of the contiguous run of the highest sum, the first and shortest of equal ones; None if no sum is above 0."""
    best, run, total, first = 0.0, None, 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, first = 0.0, i
        total += score
        if total > best:
            best, run = total, (first, i)
    return run


@dataclass
class Pieces:
    """The events of a page that the scan is over: their scores, and the block, text and kind of each."""

    scores: list[float] = field(default_factory=list)
    blocks: list[int] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    told: list[bool] = field(default_factory=list)

    def add(self, score: float, block: int, text: str = "", told: bool = False) -> None:
        self.scores.append(score)
        self.blocks.append(block)
        self.texts.append(text)
        self.told.append(told)


def pieces(page: str) -> Pieces:
    known, out = weights(), Pieces()
    block, filled, linked, spent = 0, False, 0.0, 0.0
    for kind, name, text in events(page):
        if kind in ("word", "link"):
            count = len(text.split())
            score = count * known.words[kind]
            if kind == "link":
                score = max(score, -LINKED - linked)
                linked += score
            out.add(score, block, text)
            filled = True
        elif kind == "told":
            if not name:
                spent = 0.0
                continue
            most = BRIDGE_WITHIN if name[-1] == "@" else BRIDGE
            score = max(len(text.split()) * known.words["told"], -most - spent)
            spent += score
            out.add(score, block, text, True)
            filled = True
        elif kind in ("tag", "block"):
            if kind == "tag":
                score = known.tags.get(name, -0.1 if name[-1] == "@" else -0.5)
                if name == "a":
                    score = max(score, -LINKED - linked)
                    linked += score
                out.add(score, block)
                name = name.rstrip("@~")
            if name in BLOCK:
                block, filled, linked = block + filled, False, 0.0 if filled else linked
            elif name == "br":
                out.add(0.0, block, " ")
    return out


def text_of(found: Pieces, run: tuple[int, int] | None) -> str:
    """The blocks that a run touches, without the told words that stand between words that gain."""
    if run is None:
        return ""
    first, last = found.blocks[run[0]], found.blocks[run[1]]
    chosen = range(bisect.bisect_left(found.blocks, first), bisect.bisect_right(found.blocks, last))
    gains = [i for i in chosen if found.scores[i] > 0]
    blocks: dict[int, list[str]] = {}
    for i in chosen:
        if found.told[i] and gains and gains[0] < i < gains[-1]:
            continue
        blocks.setdefault(found.blocks[i], []).append(found.texts[i])
    texts = (" ".join("".join(b).split()) for b in blocks.values())
    return "\n".join(t for t in texts if t)


def main_text(page: str | None) -> str:
    found = pieces(page or "")
    return text_of(found, best_run(found.scores))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page; one narrow pass without shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return python_pass(rows, run, "page_id long, url string, text string, n_chars long")
