"""Main text of web pages by minimum-cut labelling of text blocks.

A page is cut into blocks of text. A classifier gives each block a cost of being content and a cost
of being boilerplate, the capacities to the two terminals, from its text, its links and the regions it
lies in. Blocks that follow each other and blocks that share a parent in the DOM are joined by smoothness
edges. The maximum flow then separates the page into content and boilerplate at least total cost.

Every piece of evidence is a bounded cost. The nearest element that names a region counts: a tag, a role,
or a class or id of a container all of whose words name one. A word within another name, or on an element
of text, counts little. A form is a region of its own unless it holds the article.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from html import unescape

from pyspark.sql import DataFrame, SparkSession

from floodgauge.llm.common import map_blocks, table

SKIPPED = {"script", "style", "head", "title", "noscript", "template", "svg", "annotation", "annotation-xml", "iframe", "object", "canvas", "audio", "video", "select", "textarea", "button", "input", "label", "option", "datalist", "dialog"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
INLINE |= set("math semantics mrow mi mn mo ms mtext mspace mfrac msqrt mroot mstyle mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts".split())
#: Skipped elements that stand within a line of text and do not end its block.
QUIET = SKIPPED - {"head", "title", "dialog", "datalist", "option"}
BAD_TAGS = {"nav", "footer", "aside", "menu"}
GOOD_TAGS = {"article", "main"}
BAD_WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe "
    "subscription signup login menu nav navbar navigation breadcrumb breadcrumbs sidebar widget related recommended recommendations share sharing social comment comments reply replies "
    "respond discussion disqus footer masthead toolbar pagination pager tagcloud skip header".split()
)
ADVERT_WORDS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsored"}
COMMENT_WORDS = {"comment", "comments", "reply", "replies", "respond", "discussion", "disqus"}
#: Words that say nothing beside one of a region, and words that say it is the article after all.
PLAIN_WORDS = set("site page top bottom box block container wrapper wrap list item items links link section area left right inner outer bar module global main primary secondary id js col slot unit gpt dfp posts articles stories".split())
GOOD_WORDS = {"article", "story", "entry", "post", "content", "body", "text"}
#: Words that say what a region is as the last of a name, whatever stands before ("post-comments").
LAST_WORDS = COMMENT_WORDS | {"footer", "related", "sidebar", "share", "sharing", "newsletter", "navigation", "pagination"}
#: Elements that hold regions; a class of any other one says something about its text only.
CONTAINERS = set("div section ul ol dl table tbody tr td aside article main header nav footer form fieldset figure details center iframe".split())
BAD_ROLES = {"navigation", "banner", "contentinfo", "complementary", "dialog", "alert", "alertdialog", "search", "form", "menu", "menubar", "toolbar"}
#: An open element of the key is closed by a start tag of these.
CLOSES = {
    "p": set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"},
}
_WORD, _SPACE = re.compile(r"[a-z]+"), re.compile(r"\s+")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\t\n\r\f />\x00]*)")
_TAG = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>""")
_BARE = re.compile(r"[^>]*+>")
_ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
#: Elements whose content is no markup, with what ends it.
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.IGNORECASE) for t in ("script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp")}
#: Costs: of content within the article, of boilerplate within a region named by tag or role, by class,
#: and by a word only (at most twice). SMOOTH: neighbours, SIBLING: blocks of one parent; flow units.
GOOD, TAGGED, CLASSED, HINTED, SMOOTH, SIBLING, SCALE = 5.0, 9.0, 6.0, 1.5, 0.7, 0.5, 1000
#: A form with so many blocks of so many words, with an article or a main heading, is the page's frame and no widget.
FRAME_BLOCKS, FRAME_WORDS = 2, 15
#: An open head ends at the start of any other element, or at text.
HEAD_TAGS = {"base", "basefont", "bgsound", "head", "html", "link", "meta", "noframes", "noscript", "script", "style", "template", "title"}


class _Form:
    __slots__ = ("article", "long")

    def __init__(self):
        self.article, self.long = False, 0

    def widget(self) -> bool:
        return not self.article and self.long < FRAME_BLOCKS


def region_words(name: str) -> tuple[bool, bool, bool, bool]:
    """Of a class or id attribute: (a name that is a region, of comments, of adverts, a word of a region).

    Beside a name that is all article ("post related"), one that is a region is only a word of one."""
    region = comments = advert = hint = article = False
    for token in name.lower().split():
        parts = _WORD.findall(token)
        words = set(parts)
        bad, last = words & BAD_WORDS, bool(parts) and parts[-1] in LAST_WORDS
        article = article or bool(words) and words <= GOOD_WORDS
        if bad and (last or not words & GOOD_WORDS):
            hint = True
            if last or words <= BAD_WORDS | PLAIN_WORDS:
                region, comments = True, comments or bool(words & COMMENT_WORDS)
                advert = advert or words <= ADVERT_WORDS | PLAIN_WORDS
    return region and (comments or not article), comments, advert, hint


class _Element:
    __slots__ = ("tag", "parent", "good", "bad", "closed", "hints", "form", "verdict", "skipped", "link", "block_tag", "inline", "home")

    def __init__(self, tag: str, attrs: dict[str, str | None], parent: _Element | None):
        self.tag, self.parent = tag, parent
        # closed: a region that no article opens again.
        self.good, self.bad, self.closed, self.hints = (parent.good, parent.bad, parent.closed, parent.hints) if parent else (0.0, 0.0, False, 0.0)
        self.form = _Form() if tag == "form" else parent.form if parent else None
        named = f"{attrs.get('class') or ''} {attrs.get('id') or ''}" if tag not in ("html", "body") else ""
        region, comments, advert, hint = region_words(named) if named != " " else (False, False, False, False)
        if parent and parent.good and named.lower().split() == ["header"]:
            region = hint = False  # the head of the article, with its title
        role, opens = (attrs.get("role") or "").lower(), False
        hidden = "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true"
        self.skipped = bool(parent and parent.skipped) or tag in SKIPPED or hidden
        self.link = tag == "a" or bool(parent and parent.link)
        if tag in BAD_TAGS or role in BAD_ROLES or tag == "header" and not self.good or comments and tag in CONTAINERS:
            self.good, self.bad, self.closed = 0.0, TAGGED, True  # each comment or teaser may be an article of its own
        elif region and (tag in CONTAINERS or advert):
            self.good, self.bad = 0.0, max(self.bad, CLASSED)
        elif (tag in GOOD_TAGS or role in ("main", "article") or (attrs.get("itemprop") or "").lower() == "articlebody") and not self.closed:
            self.good, self.bad, opens = GOOD, 0.0, True
        if hint and not region:
            self.hints = min(2 * HINTED, self.hints + HINTED)
        if self.form and (opens or tag == "h1"):
            self.form.article = True
        self.verdict = (self.good, self.bad, self.hints, self.form)
        # Of the nearest block element, its tag and the counts of inline elements open in it; of the
        # element that text here belongs to, itself where it is not this one.
        within = parent is not None and tag in INLINE
        self.block_tag = parent.block_tag if within else tag
        self.inline: Counter[str] = parent.inline if within else Counter()
        self.home: _Element | None = (parent.home or parent) if within and self.verdict == parent.verdict else None


class _Tokens:
    """Start tags, end tags and text of a page in one pass.

    A tag ends at the first > outside quoted values; a quote that never closes is an ordinary character.
    What can be no tag, or has no > behind it, is text; a comment that never closes is the rest. Every
    search either moves on to what it finds or is not made again, so the time is linear in any markup."""

    def feed(self, html: str) -> None:
        at, begun, last, tag = 0, 0, html.rfind(">"), _TAG
        unclosed: set[str] = set()
        while (at := html.find("<", at)) >= 0 and at < last:
            name, end = None, -1
            if html.startswith("<!-->", at):
                end = at + 5
            elif html.startswith("<!--", at):
                close = html.find("-->", at + 3)
                end = close + 3 if close >= 0 else len(html)
            elif found := _NAME.match(html, at):
                if (whole := tag.match(html, found.end())) is None:
                    tag = _BARE  # from here to the end no > stands outside quotes
                    whole = tag.match(html, found.end())
                name, end = found[2].lower(), whole.end()
            elif html[at + 1 : at + 2] in ("!", "?", "/"):
                end = html.find(">", at) + 1
            if end < 0:
                at += 1
                continue
            self._text(html[begun:at])
            if name and found[1]:
                self.handle_endtag(name)
            elif name:
                attrs = whole[0][:-1]
                self.handle_starttag(name, _attributes(attrs))
                if attrs.endswith("/"):
                    self.handle_endtag(name)
                elif name in _RAW and name not in unclosed:
                    close = _RAW[name].search(html, end)
                    if close:
                        end = close.start()
                    elif name in ("script", "style"):
                        end = len(html)
                    else:
                        unclosed.add(name)
            at = begun = end
        self._text(html[begun:])

    def _text(self, text: str) -> None:
        if text:
            self.handle_data(unescape(text) if "&" in text else text)


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), unescape(double or single or bare))
    return found


class _Blocks(_Tokens):
    """Text blocks of a page: (text, characters in links, element)."""

    def __init__(self):
        self.at = _Element("", {}, None)
        self.open: Counter[str] = Counter()
        self.blocks: list[tuple[str, int, _Element]] = []
        self.parts: list[str] = []
        self.linked, self.home, self.begun = 0, self.at, False

    def flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            self.blocks.append((text, self.linked, self.home))
            if self.home.form and text.count(" ") >= FRAME_WORDS:
                self.home.form.long += 1
        self.parts, self.linked, self.begun = [], 0, False

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag == "body" or self.at.tag == "head" and tag not in HEAD_TAGS:
            self._close("head")
        if tag == "br":
            self.parts.append(" ")
        if tag not in INLINE and tag not in QUIET and not self.at.skipped:
            self.flush()
            while (closers := CLOSES.get(self.at.block_tag)) and tag in closers:
                self._close(self.at.block_tag)
        if tag in VOID:
            return
        self.at = _Element(tag, attrs, self.at)
        self.open[tag] += 1
        if tag in INLINE:
            self.at.inline[tag] += 1

    def _close(self, tag: str) -> None:
        """Close the innermost open element of the tag, if any, and all in it."""
        if not self.open[tag]:
            return
        closed = None
        while closed != tag:
            closed = self.at.tag
            self.open[closed] -= 1
            if closed in INLINE:
                self.at.inline[closed] -= 1
            self.at = self.at.parent

    def handle_endtag(self, tag: str) -> None:
        if tag in INLINE:
            if self.at.inline[tag]:
                self._close(tag)
            return
        within = self.at.skipped
        if tag not in QUIET and not within:
            self.flush()
        self._close(tag)
        if tag not in QUIET and within and not self.at.skipped:
            self.flush()

    def handle_data(self, data: str) -> None:
        if self.at.tag == "head" and data.strip():
            self._close("head")
        if self.at.skipped:
            return
        if not self.begun:
            self.home = self.at.home or self.at
            self.begun = bool(data.strip())
        self.parts.append(data)
        if self.at.link:
            self.linked += len(data.strip())


def costs(text: str, linked: int, element: _Element, classes: bool = True) -> tuple[float, float]:
    """(cost of boilerplate, cost of content) of a block; ``classes``: regions named by class count."""
    density = min(1.0, linked / len(text))
    words = text.count(" ") + 1
    content = 0.2 + min(words, 40) / 16 + 0.5 * (text[-1] in ".!?…。") + (1.0 if element.tag in ("p", "h1", "blockquote", "pre") else 0.0)
    boiler = 0.6 + 3.0 * density + (0.8 if element.tag == "li" and density > 0.5 else 0.0) + (0.8 if words < 4 else 0.0)
    if element.form and element.form.widget():
        return content, boiler + TAGGED
    return content + element.good, boiler + (element.bad if classes or element.bad != CLASSED else 0.0) + element.hints


class _Flow:
    """Maximum flow by shortest augmenting levels, on integers, without recursion."""

    def __init__(self, n: int):
        self.edges: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.cap: list[int] = []

    def add(self, a: int, b: int, there: int, back: int = 0) -> None:
        self.edges[a].append(len(self.to))
        self.edges[b].append(len(self.to) + 1)
        self.to += [b, a]
        self.cap += [there, back]

    def reach(self, source: int) -> list[int]:
        level = [-1] * len(self.edges)
        level[source], queue = 0, deque([source])
        while queue:
            u = queue.popleft()
            for e in self.edges[u]:
                if self.cap[e] and level[self.to[e]] < 0:
                    level[self.to[e]] = level[u] + 1
                    queue.append(self.to[e])
        return level

    def source_side(self, source: int, sink: int) -> list[bool]:
        while (level := self.reach(source))[sink] >= 0:
            begin = [0] * len(self.edges)
            path: list[int] = []
            u = source
            while True:
                if u == sink:
                    least = min(self.cap[e] for e in path)
                    for e in path:
                        self.cap[e] -= least
                        self.cap[e ^ 1] += least
                    first = next(i for i, e in enumerate(path) if not self.cap[e])
                    u = self.to[path[first] ^ 1]
                    del path[first:]
                    continue
                while begin[u] < len(self.edges[u]):
                    e = self.edges[u][begin[u]]
                    if self.cap[e] and level[self.to[e]] == level[u] + 1:
                        break
                    begin[u] += 1
                if begin[u] < len(self.edges[u]):
                    path.append(e)
                    u = self.to[e]
                elif not path:
                    break
                else:
                    u = self.to[path.pop() ^ 1]
                    begin[u] += 1
        return [x >= 0 for x in level]


def _content(blocks: list[tuple[str, int, _Element]], classes: bool) -> list[str]:
    """The blocks on the content side of the minimum cut."""
    n = len(blocks)
    flow, unit = _Flow(n + 2), lambda x: int(x * SCALE)
    last: dict[int, int] = {}
    for i, (text, linked, element) in enumerate(blocks):
        boilerplate, content = costs(text, linked, element, classes)
        both = min(unit(boilerplate), unit(content))  # the shared part changes nothing about the cut
        if unit(boilerplate) > both:
            flow.add(n, i, unit(boilerplate) - both)
        else:
            flow.add(i, n + 1, unit(content) - both)
        if i:
            flow.add(i - 1, i, unit(SMOOTH), unit(SMOOTH))
        parent = id(element.parent or element)
        if parent in last and last[parent] < i - 1 or parent in last and i:
            flow.add(last[parent], i, unit(SIBLING), unit(SIBLING))
        last[parent] = i
    side = flow.source_side(n, n + 1)
    return [text for i, (text, _, _) in enumerate(blocks) if side[i]]


def main_text(html: str | None) -> str:
    """The content blocks of a page, white space inside a block made one space, joined by two \\n."""
    parser = _Blocks()
    parser.feed(html or "")
    parser.flush()
    blocks = parser.blocks
    content = _content(blocks, True) if blocks else []
    # A class that takes in all that could be an article is the page's frame, as with forms.
    framed = sum(e.bad == CLASSED and t.count(" ") >= FRAME_WORDS and 2 * linked < len(t) for t, linked, e in blocks)
    if not content and framed >= FRAME_BLOCKS:
        content = _content(blocks, False)
    return "\n\n".join(content)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Null or empty html, and pages without content, give an empty text. Rows are independent: repeated
    rows repeat, an empty table gives no rows, a very long page is read whole in linear time, other
    columns are ignored.
    """

    def block(cols: dict[str, list]) -> dict[str, list]:
        texts = [main_text(h) for h in cols["html"]]
        return {"page_id": cols["page_id"], "url": cols["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    return map_blocks(pages.select("page_id", "url", "html"), block, "page_id long, url string, text string, n_chars long", text="html")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
