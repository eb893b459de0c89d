"""Main text of web pages by two-pass block rules (operator 1).

A page is cut into blocks at block-level tags.  Pass one decides what it can:
a block inside a menu, header, footer, sidebar, notice, advert, form or reader
comments (by tag, role or class words) is *bad*; elsewhere, a block with a
high share of link text is *bad*, a long block with enough stop words is
*good*, a long one with few of them is *bad*, and short or middling blocks are
ambiguous.  Forms and the class words in ``PRIOR_WORDS`` are priors: where the
blocks inside that links, length and stop words call *good* hold at least
``PRIOR_TIMES`` as many characters as all other open text of the page, the word
means nothing there (a page-wide form, a body in ``social-science``), and those
rules alone decide.  Pass two gives each ambiguous block the label of its nearest
decided neighbours (within the page's article element when it is in one, and
not counting what stands in a menu, notice or the like): the label of both, or
of the nearer one when they differ (*good* at equal distance), and *good* if
there is none.

Stop words are known for English, German, Spanish and French.  On a page of
which no list covers ``KNOWN_SHARE`` of the words, and in a block of mostly
letters that are not Latin, a long block with few links is *good* whatever its
words.

An article element that holds most of the page's text (at least as many
characters as the *good* blocks outside) is a prior: blocks outside are *bad*;
inside, a block is *bad* by links only above a larger share, a long one with
few stop words or many links is ambiguous, and an ambiguous one is *bad* only
between two *bad* neighbours.  Otherwise the element has no meaning, as with
teaser cards beside the text.

Scripts, styles, comments and other raw elements are no text; a raw element
without an end tag takes nothing (a script or style: what stands up to the next
tag).  An anchor with a name and no target is no link, and one without an end
tag ends with its block.  Character
references are decoded, white space inside a block becomes one space, blocks
are trimmed and joined in page order by a newline; nothing is cut.

Defined cases: a null page is an empty one; a null page_id or url is kept;
broken markup (unclosed or stray tags, a ``<`` that opens no tag) never fails,
the ``<`` is then text; pages of any length are read whole, in time in proportion to
their length (a tag of more than ``MOST_PIECES`` attributes and values ends at its
first ``>``); repeated rows are each extracted; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from upkeep.llm.common import map_arrow, slices

LONG_CHARS = 70
GOOD_STOP_SHARE = 0.20
BAD_STOP_SHARE = 0.05
LINK_SHARE = 0.4
ARTICLE_LINK_SHARE = 0.6
KNOWN_SHARE = 0.1       # words of a page that one list must cover
PRIOR_TIMES = 4
PRIOR_CHARS = 2 * LONG_CHARS
MOST_PIECES = 2000

# Frequent function words of the languages the rules know.
STOP_LISTS = [frozenset(x.split()) for x in (
    "a about after all an and are as at be been but by can for from had has have he her his i if in into is it its "
    "more no not of on one or our she so than that the their there they this to up was we were which who will with "
    "you your",
    "aber als am auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich im "
    "ist kann mit nach nicht noch nur oder sich sie sind so um und von vor war was wenn wie wird zu zum zur über",
    "al como con de del el ella en entre era es esta este fue ha hay la las le lo los mas más me mi muy no o para pero "
    "por que qué se sin sobre son su sus también un una uno y ya",
    "au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui mais ne nous on ou où "
    "par pas plus pour qu que qui sa se ses son sont sur un une vous à été")]
STOP_WORDS = frozenset().union(*STOP_LISTS)

RAW = frozenset(["script", "style", "noscript", "template", "textarea", "title", "svg", "math", "iframe", "object",
                 "select", "canvas", "audio", "video", "xmp", "noembed", "noframes"])
BLOCK = frozenset([
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog",
    "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p",
    "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"])
# Elements that are tracked until their end tag.
HOLDERS = frozenset([
    "address", "article", "aside", "blockquote", "body", "button", "details", "dialog", "div", "dl", "fieldset", "figure",
    "footer", "form", "head", "header", "main", "menu", "nav", "ol", "section", "span", "table", "ul"])
BAD_TAGS = frozenset(["nav", "aside", "footer", "menu", "dialog", "button", "head"])
FORM_TAGS = frozenset(["form", "fieldset"])
BAD_ROLES = frozenset(["navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert",
                       "alertdialog", "menu", "menubar", "toolbar"])
BAD_WORDS = frozenset((
    "ad ads adv advert advertisement advertising adsense banner breadcrumb breadcrumbs byline comment comments consent "
    "cookie cookies copyright disclaimer discussion disqus footer gdpr login masthead menu modal nav navbar "
    "navigation newsletter notice notification overlay pager pagination popup promo promoted promotion recommended "
    "related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription "
    "teaser toolbar topbar widget widgets").split())
HEAD_WORDS = frozenset(["header"])
# Words that also name places of main text; the others of BAD_WORDS always count.
PRIOR_WORDS = frozenset((
    "breadcrumb breadcrumbs byline copyright disclaimer discussion footer masthead menu nav navbar navigation notice "
    "notification pager pagination recommended related share sharing sidebar skip social teaser toolbar topbar widget "
    "widgets header").split()) | FORM_TAGS
NEGATIONS = frozenset(["no", "without"])

_NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)")
# Never goes back: a quoted value, a piece without quotes, or a stray quote at a time.
_ELEMENT = re.compile(
    r"<(/?)([A-Za-z][^\s/>]*+)((?:[^<>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"']){0,%d}+)>" % MOST_PIECES)
_ANCHOR = re.compile(r"</a\s*>|<a[\s/>]", re.I)
_TARGET = re.compile(r"(?<![^\s\"'/])href\s*=", re.I)
_MARKED = re.compile(r"(?<![^\s\"'/])(?:name|id)\s*=", re.I)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_JOINTS = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WORD = re.compile(r"[^\W\d_]+")
_LATIN = re.compile(r"[A-Za-z\u00c0-\u024f]+")


@dataclass
class Block:
    text: str
    links: int                      # characters of link text
    bad: bool                       # inside something that is no main text
    article: int                    # number of the article element around it, 0 if none
    marks: frozenset[str] = frozenset()     # the prior words of the elements around it
    label: str = ""


def _holder(tag: str, attributes: str, in_article: bool) -> tuple[bool, frozenset[str]]:
    """Whether an element is no main text for certain, and its prior words."""
    marks = {tag} & FORM_TAGS
    if tag in BAD_TAGS or (tag == "header" and not in_article):
        return True, frozenset()
    if tag == "header" or "=" not in attributes:
        return False, frozenset(marks)
    for m in _NAMES.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        parts = _SPLIT.split(_CAMEL.sub("-", value).lower())
        words = {w for before, w in zip(["", *parts], parts) if before not in NEGATIONS}
        words.update(_JOINTS.sub("", w) for w in value.lower().split())
        if m[1].lower() == "role":
            if words & BAD_ROLES - FORM_TAGS:
                return True, frozenset()
            marks |= words & FORM_TAGS
        elif tag not in ("body", "html", "article", "main"):
            if words & BAD_WORDS - PRIOR_WORDS:
                return True, frozenset()
            marks |= words & BAD_WORDS | (words & HEAD_WORDS if not in_article else set())
    return False, frozenset(marks)


class Tags:
    """The tags of a page, one after the other, found by plain searches that
    remember what no longer follows, so that broken markup costs linear time."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.next: dict[str, int] = {}          # what -> its first place from the last search on, or the end

    def find(self, what: str, at: int) -> int:
        """The first place of ``what`` from ``at`` on, -1 if there is none."""
        known = self.next.get(what, -1)
        if known < at:
            known = self.page.find(what, at)
            self.next[what] = known = len(self.page) if known < 0 else known
        return known if known < len(self.page) else -1

    def end_tag(self, tag: str, at: int) -> int:
        """The first place of the end tag of ``tag`` from ``at`` on, -1 if there is none."""
        known = self.next.get("/" + tag, -1)
        if known < at:
            m = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(self.page, at)
            self.next["/" + tag] = known = m.start() if m else len(self.page)
        return known if known < len(self.page) else -1

    def element(self, at: int) -> tuple[int, bool, str, str] | None:
        """The tag of an element that begins at ``at``: its end, whether it is an
        end tag, name and attributes.  Quoted values may hold ``>``; if there is
        no such end before the next tag, the first ``>`` is the end."""
        if m := _ELEMENT.match(self.page, at):
            return m.end(), bool(m[1]), m[2].lower(), m[3]
        m = _NAME.match(self.page, at)
        end = self.find(">", m.end()) + 1 if m else 0
        return (end, bool(m[1]), m[2].lower(), self.page[m.end():end - 1]) if end else None

    def after(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """The next tag from ``at`` on: start, end, whether it is an end tag, name
        (``!`` for comments and declarations, ``[`` for character data), attributes."""
        page = self.page
        while (at := self.find("<", at)) >= 0 and self.find(">", at) >= 0:
            if page.startswith("<!--", at):
                end = self.find("-->", at + 4)
                return at, end + 3 if end >= 0 else len(page), False, "!", ""
            if page.startswith("<![CDATA[", at):
                end = self.find("]]>", at + 9)
                return (at, end + 3, False, "[", page[at + 9:end]) if end >= 0 else (at, len(page), False, "[", page[at + 9:])
            if page.startswith(("<!", "<?"), at):
                return at, self.find(">", at) + 1, False, "!", ""
            if found := self.element(at):
                return at, *found
            at += 1
        if at >= 0:                 # no tag ends any more; a comment may still take the rest
            comment, data = self.find("<!--", at), self.find("<![CDATA[", at)
            if comment >= 0 and not 0 <= data < comment:
                return comment, len(page), False, "!", ""
            if data >= 0:
                return data, len(page), False, "[", page[data + 9:]
        return None


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, unlabelled."""
    out: list[Block] = []
    pieces: list[str] = []
    stack: list[tuple[str, bool, bool, frozenset[str]]] = []        # tag, bad, article, prior words
    depth: Counter[str] = Counter()                                 # open elements by tag
    marks: Counter[str] = Counter()
    links = bad = inside = number = breaks = 0
    anchor = 0                      # 1: in a link with an end tag, 2: in one without
    tags = Tags(page)

    def close() -> None:
        nonlocal links
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                out.append(Block(text, links, bad > 0, number if inside else 0, frozenset(+marks)))
            pieces.clear()
        links = 0

    at, n = 0, len(page)
    while at < n:
        found = tags.after(at)
        if found is None:
            pieces.append(page[at:])
            break
        start, stop, end, tag, attributes = found
        if start > at:
            text = page[at:start]
            pieces.append(text)
            if anchor:
                links += len(text.strip())
            if breaks and not text.isspace():
                breaks = 0
        at = stop
        if tag == "[":
            pieces.append(html.escape(attributes))
        elif tag == "a":
            if end:
                anchor = 0
            elif _TARGET.search(attributes) or not (_MARKED.search(attributes) or attributes.endswith("/")):
                following = _ANCHOR.search(page, at)
                anchor = 1 if following and following[0][1] == "/" else 2
            else:
                anchor = 0
        elif tag == "br":
            breaks += 1
            if breaks > 1:
                close()
            else:
                pieces.append(" ")
        elif tag in RAW:
            if not end and not attributes.endswith("/"):
                last = tags.end_tag(tag, at)
                if last >= 0:
                    at = last
                elif tag in ("script", "style"):
                    following = tags.find("<", at)
                    at = following if following >= 0 else n
        if tag in BLOCK:
            close()
            breaks = 0
            if anchor == 2:
                anchor = 0
        if tag in HOLDERS and not attributes.endswith("/"):
            if not end:
                holder, words = _holder(tag, attributes, inside > 0)
                article = tag in ("article", "main")
                if tag != "span" or holder or words:
                    if tag == "span":
                        close()
                    if article and not inside:
                        number += 1
                    stack.append((tag, holder, article, words))
                    depth[tag] += 1
                    bad += holder
                    inside += article
                    marks.update(words)
            elif depth[tag]:
                if tag == "span":
                    close()
                while True:
                    name, holder, article, words = stack.pop()
                    depth[name] -= 1
                    bad -= holder
                    inside -= article
                    marks.subtract(words)
                    if name == tag:
                        break
    close()
    return out


def stop_share(text: str) -> float:
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def known_language(found: list[Block]) -> bool:
    """Whether one list of stop words covers ``KNOWN_SHARE`` of the words in
    the page's long blocks of text."""
    words = [w for b in found if not b.bad and len(b.text) >= LONG_CHARS and b.links <= LINK_SHARE * len(b.text)
             for w in _WORD.findall(b.text.lower())]
    return any(sum(w in x for w in words) >= KNOWN_SHARE * len(words) for x in STOP_LISTS)


def latin(text: str) -> bool:
    """Whether at least half of the letters are Latin ones."""
    return 2 * sum(map(len, _LATIN.findall(text))) >= sum(map(len, _WORD.findall(text)))


def judge(b: Block, known: bool) -> str:
    """The label of a block by its links, length and words alone; stop words
    count only if they are those of the page's language (``known``) and script."""
    if b.links > (ARTICLE_LINK_SHARE if b.article else LINK_SHARE) * len(b.text):
        return "bad"
    if len(b.text) < LONG_CHARS or b.links > LINK_SHARE * len(b.text):
        return ""
    share = stop_share(b.text)
    if share < BAD_STOP_SHARE and not (known and latin(b.text)):
        return "good"
    if b.article:
        return "good" if share >= BAD_STOP_SHARE else ""
    return "good" if share >= GOOD_STOP_SHARE else "bad" if share < BAD_STOP_SHARE else ""


def weigh_priors(found: list[Block]) -> None:
    """Blocks inside elements with prior words become bad, unless what is good
    by itself inside those of a word is most of the page."""
    if not any(b.marks for b in found):
        return
    known = known_language(found)
    good: Counter[str] = Counter()
    total = 0                       # open text, but for what is bad by itself
    rest: Counter[str] = Counter()  # the part of it inside elements of a word
    for b in found:
        if not b.bad and (label := judge(b, known)) != "bad":
            total += len(b.text)
            for word in b.marks:
                rest[word] += len(b.text)
                good[word] += len(b.text) * (label == "good")
    empty = {w for w in good if good[w] >= PRIOR_CHARS and good[w] >= PRIOR_TIMES * (total - rest[w])}
    for b in found:
        b.bad = b.bad or not b.marks <= empty


def decide(found: list[Block]) -> None:
    """Pass one: ``good``, ``bad`` or (ambiguous) empty labels; ``article`` is
    cleared where the elements do not hold most of the text."""
    weigh_priors(found)
    known = known_language(found)
    for b in found:
        b.label = "bad" if b.bad else judge(b, known)
    inside = sum(len(b.text) for b in found if b.article and b.label != "bad")
    outside = sum(len(b.text) for b in found if not b.article and b.label == "good")
    named = inside and inside >= outside
    for b in found:
        if named and not b.article:
            b.label = "bad"
        elif b.article and not named:
            b.article = 0
            b.label = "bad" if b.bad else judge(b, known)


def inherit(found: list[Block]) -> None:
    """Pass two: ambiguous blocks take the label of the nearest decided ones,
    inside their article if they are in one and past what stands in a menu,
    notice or the like; where nothing is decided they are good."""
    last: dict[int, int] = {}
    before, after = [-1] * len(found), [-1] * len(found)
    for order, near in ((range(len(found)), before), (range(len(found) - 1, -1, -1), after)):
        last.clear()
        for i in order:
            b = found[i]
            near[i] = last.get(b.article, -1)
            if b.label and not b.bad:
                last[b.article] = i
    labels = [b.label for b in found]
    for i, b in enumerate(found):
        if b.label:
            continue
        left, right = before[i], after[i]
        if left < 0 and right < 0:
            b.label = "good"
        elif b.article:
            b.label = "bad" if left >= 0 and right >= 0 and labels[left] == labels[right] == "bad" else "good"
        elif left < 0 or right < 0:
            b.label = labels[max(left, right)]
        elif labels[left] == labels[right] or i - left < right - i:
            b.label = labels[left]
        else:
            b.label = labels[right] if right - i < i - left else "good"


def main_text(page: str | None) -> str:
    """The main text of a page: its good blocks in order, joined by newlines."""
    found = blocks(page or "")
    decide(found)
    inherit(found)
    return "\n".join(b.text for b in found if b.label == "good")


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text`` for every row of ``pages`` (``page_id, url, html``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(2).to_pylist()
            for lo, hi in slices([len(x or "") for x in data]):
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo).cast(pa.int64()), batch.column(1).slice(lo, hi - lo),
                    pa.array([main_text(x) for x in data[lo:hi]], pa.string())], ["page_id", "url", "text"])

    return map_arrow(pages.select("page_id", "url", "html"), run,
                     "page_id bigint, url string, text string")
