"""Main text of web pages by consensus of the pages of a host.

Each page's containers are scored by the text their blocks hold. A page votes
for the generalised tag-class path of its best container; votes are summed per
host in Spark, and every page is extracted again with its host's winning path.
A page without that path is extracted with its own best container.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

# HTML's element kinds.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "object", "select", "button", "canvas", "audio", "video"}
CONTAINERS = {"body", "main", "article", "section", "div", "td", "center", "form", "nav", "header", "footer", "aside", "dialog", "menu"}
BLOCKS = CONTAINERS | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "pre", "blockquote", "figure", "figcaption", "table", "caption", "thead", "tbody", "tfoot", "tr", "th", "td", "address", "details", "summary", "hr", "fieldset", "legend", "html", "head", "label"}
# Inline elements that are looked at for names of dropped parts too.
MARKED = {"span", "ins", "small"}
# Elements of an article whose ids are places to jump to, and headings, whose names say what the text below is about.
SECTIONS, HEADINGS = {"section", "p", "dl", "table", "figure"}, {"h1", "h2", "h3", "h4", "h5", "h6"}
# Elements that end where another of their name begins.
UNNESTED = {"p", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "h1", "h2", "h3", "h4", "h5", "h6"}
# Elements and roles that never belong to an article.
DROPPED = {"nav", "footer", "aside", "form", "dialog", "menu", "fieldset", "label"} | RAW
DROPPED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "form"}
# Words of classes and ids: the first mark a dropped part wherever they stand in a name; the second do if the name's
# other words are of these or of the third, so that a paragraph of class side-effects stays.
SURE = re.compile(r"advert\w*|sponsor\w*|cookies?|gdpr|popup|modal|newsletter\w*|subscri\w*|breadcrumbs?|sidebar|navbar|navigation|widget|disqus\w*|commentlist|pagination|masthead|topbar|promo|recirc\w*")
NAMED = {
    "ad", "ads", "alert", "banner", "comment", "comments", "consent", "foot", "footer", "hidden", "login", "menu", "more", "nav", "notice", "notices", "overlay", "pager", "promoted", "recommended", "related",
    "replies", "reply", "respond", "share", "sharing", "side", "signup", "skip", "social", "tags", "toolbar", "widgets",
}
PLAIN = {
    "area", "articles", "bar", "block", "body", "bottom", "box", "btn", "button", "buttons", "col", "column", "container", "content", "form", "group", "header", "icons", "inner", "item", "items", "js", "left", "link", "links", "list", "main", "media",
    "module", "news", "only", "outer", "page", "panel", "post", "posts", "primary", "print", "reader", "readers", "right", "row", "secondary", "section", "site", "slot", "stories", "thread", "title", "to", "top", "unit", "user", "users", "wrap", "wrapper",
}
HEADERS = {"header", "siteheader", "pageheader"}
#: An article or main element counts this much more than a plain container of the same text.
FAVOURED = {"article": 3.0, "main": 1.5}

#: A tag whose quotes, if any, are in order and hold neither "<" nor ">"; others are read step by step.
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"'=]++|=\s*+\"[^\"<>]*+\"|=\s*+'[^'<>]*+'|=)*+)>")
NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
STOP = re.compile(r">|=\s*+[\"']")
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
CLOSING = {name: re.compile(rf"</{name}(?![a-zA-Z0-9:-])[^>]*+>", re.I) for name in BLOCKS | MARKED | RAW}
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


class Element:
    """A container: its parent and ``name`` (generalised tag and class), which make its path."""

    __slots__ = ("tag", "name", "parent", "dropped", "article", "score")

    def __init__(self, tag: str, name: str, parent: Element | None, dropped: bool):
        self.tag, self.name, self.parent, self.dropped = tag, name, parent, dropped
        self.article = tag in ("article", "main") or (parent is not None and parent.article)
        self.score = 0.0

    @property
    def path(self) -> str:
        names, e = [], self
        while e.parent is not None:
            names.append(e.name)
            e = e.parent
        return ">".join(reversed(names))


class Block:
    __slots__ = ("owner", "text", "linked")

    def __init__(self, owner: Element, text: str, linked: int):
        self.owner, self.text, self.linked = owner, text, linked


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(raw)} if raw else {}


def _generalised(tag: str, found: dict[str, str]) -> str:
    names = found.get("class", "").lower().split()
    name = re.sub(r"[0-9a-f]{6,}|\d+", "#", names[0]).replace(">", "") if names else ""
    return f"{tag}.{name}" if name else tag


def _names_dropped(names: str, article: bool) -> bool:
    for name in names.lower().split():
        parts = [p for p in (part.rstrip("0123456789") for part in re.split(r"[-_:.]+", name)) if p]
        sure = [bool(SURE.fullmatch(p)) for p in parts]
        known = all(s or p in NAMED or p in PLAIN for s, p in zip(sure, parts, strict=True))
        # in an article a word beside these tells of its subject: widget-history, modal-verbs
        if any(sure) and (known or not article):
            return True
        if known and any(p in NAMED for p in parts):
            return True
        if not article and parts and parts[-1] in HEADERS and all(p in PLAIN or p in HEADERS for p in parts):
            return True
    return False


def _is_dropped(tag: str, found: dict[str, str], parent: Element, in_text: bool = False) -> bool:
    """``in_text`` tells an element amid the text of a block."""
    if tag in DROPPED or tag == "header" and not parent.article:
        return True
    if found.get("role", "").lower() in DROPPED_ROLES or "hidden" in found or found.get("aria-hidden") == "true":
        return True
    if tag in ("body", "html", "article", "main") or parent.article and (tag in HEADINGS or in_text):
        return False
    own = "" if parent.article and tag in SECTIONS else found.get("id", "")
    return _names_dropped(f"{found.get('class', '')} {own}", parent.article)


class _Scanner:
    """Tokens of a page in one pass. What lies ahead is looked for once, so that unclosed tags, quotes and comments stay linear."""

    def __init__(self, html: str):
        self.html = html
        self.last = html.rfind(">")
        self.quotes = {q: html.rfind(q) for q in "\"'"}
        self.closing: dict[str, tuple[int, int]] = {}
        self.endless: set[int] = set()  # beginnings of quoted values after which no tag ends

    def tag(self, start: int) -> tuple[int, str, str, str] | None:
        """(end, slash, name, attributes) of the tag at ``start``; None if there is none."""
        m = TAG.match(self.html, start)
        if m is not None:
            return m.end(), m[1], m[2].lower(), m[3]
        m = NAME.match(self.html, start)
        if m is None or start > self.last:
            return None
        at, passed = m.end(), []
        while True:
            stop = STOP.search(self.html, at)
            if stop is None or stop.end() in self.endless:  # no end after a quoted value: the tag ends at the first ">"
                break
            if stop[0] == ">":
                return stop.end(), m[1], m[2].lower(), self.html[m.end() : stop.start()]
            passed.append(stop.end())
            quote = stop[0][-1]
            if self.quotes[quote] < stop.end():
                break
            at = self.html.index(quote, stop.end()) + 1
        self.endless.update(passed)
        end = self.html.index(">", m.end())
        return end + 1, m[1], m[2].lower(), self.html[m.end() : end]

    def after(self, tag: str, at: int) -> int:
        """The end of the next closing tag of this name, or -1."""
        start, end = self.closing.get(tag, (-1, -1))
        if start < at and start != len(self.html):
            m = CLOSING[tag].search(self.html, at)
            start, end = (m.start(), m.end()) if m else (len(self.html), -1)
            self.closing[tag] = start, end
        return end


def parse(html: str) -> tuple[list[Element], list[Block]]:
    """Containers (and dropped elements), parents first, and text blocks in page order."""
    root = Element("html", "", None, False)
    stack: list[Element] = [root]
    elements: list[Element] = [root]
    open_tags: dict[str, int] = {}
    blocks: list[Block] = []
    pieces: list[str] = []
    scanner = _Scanner(html)
    linked, in_link, at, n = 0, 0, 0, len(html)
    # a dropped element that is no container: its name, how many of that name are open, containers open inside it
    skipped, depth, inside = "", 0, {}

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            if text:
                blocks.append(Block(stack[-1], text, linked))
            pieces.clear()
        linked = 0

    while at < n:
        start = html.find("<", at)
        if start < 0:
            start = n
        if start > at and not skipped:
            pieces.append(html[at:start])
            if in_link:
                linked += start - at
        if start == n:
            break
        if html.startswith("<!--", start):
            end = html.find("-->", start)
            at = end + 3 if end >= 0 else n
            continue
        if html.startswith(("<!", "<?"), start) and start < scanner.last:
            at = html.index(">", start) + 1
            continue
        found_tag = scanner.tag(start)
        if found_tag is None:
            if not skipped:
                pieces.append("<")
            at = start + 1
            continue
        at, slash, tag, raw = found_tag
        if skipped:
            if slash:
                if tag == skipped:
                    depth -= 1
                    skipped = skipped if depth else ""
                    continue
                if tag not in CONTAINERS:
                    continue
                if inside.get(tag, 0):
                    inside[tag] -= 1
                    continue
                skipped = ""  # the container around it ends
            elif tag in RAW:
                at = max(at, scanner.after(tag, at)) if not raw.endswith("/") else at
                continue
            elif tag == skipped and tag in UNNESTED or skipped == "p" and tag in BLOCKS:
                skipped = ""
            else:
                if tag == skipped and not raw.endswith("/"):
                    depth += 1
                elif tag in CONTAINERS:
                    inside[tag] = inside.get(tag, 0) + 1
                continue
        if slash:
            if tag in BLOCKS:
                flush()
                if tag in CONTAINERS and open_tags.get(tag, 0):
                    while True:
                        closed = stack.pop().tag
                        open_tags[closed] -= 1
                        if closed == tag:
                            break
                in_link = 0
            elif tag == "a":
                in_link = 0
            continue
        whole = raw.endswith("/")
        if tag in RAW:
            if tag not in ("button", "script", "style", "svg", "canvas"):
                flush()
            if not whole:
                end = scanner.after(tag, at)
                at = end if end >= 0 else n
            continue
        if tag == "br":
            pieces.append(" ")
        elif tag == "a":
            in_link = 1
        elif tag in BLOCKS:
            flush()
            in_link = 0
            if tag in CONTAINERS and not whole:
                if tag == "td":
                    while stack[-1].tag == "td":
                        open_tags[stack.pop().tag] -= 1
                found, parent = _attributes(raw), stack[-1]
                stack.append(Element(tag, _generalised(tag, found), parent, parent.dropped or _is_dropped(tag, found, parent)))
                open_tags[tag] = open_tags.get(tag, 0) + 1
                elements.append(stack[-1])
            elif tag not in VOID and not whole and (tag in DROPPED or raw and _is_dropped(tag, _attributes(raw), stack[-1])) and (tag in UNNESTED or scanner.after(tag, at) >= 0):
                skipped, depth, inside = tag, 1, {}
        elif tag in MARKED and raw and not whole and _is_dropped(tag, _attributes(raw), stack[-1], bool("".join(pieces[-1:]).strip())) and scanner.after(tag, at) >= 0:
            skipped, depth, inside = tag, 1, {}
    flush()
    return elements, blocks


def best(elements: list[Element], blocks: list[Block]) -> Element:
    """The container with the highest score: its blocks' unlinked text, less for each level between."""
    for block in blocks:
        if block.owner.dropped:
            continue
        gain = max(0, len(block.text) - 2 * block.linked)
        owner, share = block.owner, 1.0
        while owner is not None and share > 0.05:
            owner.score += gain * share * FAVOURED.get(owner.tag, 1.0)
            owner, share = owner.parent, share * 0.6
    return max((e for e in elements if not e.dropped), key=lambda e: e.score)


def _at_path(elements: list[Element], path: str) -> set[int]:
    """The elements at a path, not dropped: names are compared along parents, each element once."""
    names = path.split(">")
    level = {id(elements[0]): 0}
    found = set()
    for e in elements[1:]:
        depth = level.get(id(e.parent), -1)
        if 0 <= depth < len(names) and e.name == names[depth]:
            level[id(e)] = depth + 1
            if depth + 1 == len(names) and not e.dropped:
                found.add(id(e))
    return found


def _below(elements: list[Element], blocks: list[Block], chosen: set[int]) -> list[str]:
    inside = set(chosen)
    for e in elements:  # parents come first
        if id(e.parent) in inside:
            inside.add(id(e))
    return [b.text for b in blocks if not b.owner.dropped and id(b.owner) in inside]


def extract(html: str, path: str | None) -> str:
    """Blocks below the elements at ``path``, or below the page's own best container."""
    elements, blocks = parse(html)
    found = _below(elements, blocks, _at_path(elements, path)) if path else []
    return "\n\n".join(found or _below(elements, blocks, {id(best(elements, blocks))}))


def vote(html: str) -> tuple[str, float]:
    elements, blocks = parse(html)
    winner = best(elements, blocks)
    return winner.path, winner.score


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): for each host, the path with most votes, then most score, then least in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [vote(h.as_py() or "") for h in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p for p, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["host", "path", "score"])

    votes = pages.select("host", "html").mapInArrow(run, "host string, path string, score double").where("path != ''")
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("score").alias("score"))
    order = F.struct(F.col("n"), F.round("score", 3), F.col("path"))
    return counted.groupBy("host").agg(F.max_by("path", order).alias("path"))


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) for every row of ``pages(page_id, url, html)``.

    A null or empty html gives an empty text. Pages without a host (null or
    malformed url) vote as one host. Deep nesting, tags, quotes and comments
    that never close take time in proportion to the page: a quote that never
    closes ends its tag at the first ">", and without any ">" ahead a "<" is
    text. Repeated rows stay; an empty table gives no rows; other columns are
    ignored.
    """
    scratch = Scratch(pages.sparkSession, "html")
    host = F.coalesce(F.lower(F.regexp_extract("url", HOST, 1)), F.lit(""))
    pages = pages.select("page_id", "url", "html", host.alias("host"))
    paths = scratch.keep(host_paths(pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h.as_py() or "", p.as_py()) for h, p in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    joined = pages.join(paths, "host", "left").select(F.col("page_id").cast("long"), "url", "html", "path")
    return joined.mapInArrow(run, "page_id long, url string, text string")


def query(pages: DataFrame) -> DataFrame:
    return main_text(pages).withColumn("n_chars", F.length("text").cast("long"))
