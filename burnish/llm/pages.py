"""Main text of web pages by a consensus of each host's pages.

Every page scores its containers and names the path (tags and classes, numbers generalised) of the
best one. The pages of a host vote on paths in Spark, and each page is extracted again from the
containers on its host's winning path; a page without it falls back on its own best container.
"""

from __future__ import annotations

import hashlib
import html
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnish.functions.scratch import stage
from burnish.llm.frames import map_batches
from burnish.llm.urls import host_and_path

# What tags of HTML do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
#: Elements whose content is a control, a drawing, or stands in for what cannot be shown; without an end tag they hold nothing.
SKIPPED = frozenset("noscript template svg object canvas audio video select button".split())
BLOCK = frozenset(
    "html body address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr li main menu nav ol p pre search section summary table tbody thead tfoot tr td th caption ul legend".split()
)
CONTAINER = frozenset("body article main section div td center blockquote".split())
#: A start tag closes an open element named here, looked for up to the nearest element of the second set.
CLOSES = {
    **dict.fromkeys(BLOCK - {"html", "body", "td", "th", "tr", "caption", "tbody", "thead", "tfoot", "legend"}, ({"p"}, frozenset("td th table div section article main aside nav header footer form li blockquote body".split()))),
    "li": ({"li", "p"}, frozenset("ul ol menu".split())),
    "dt": ({"dt", "dd", "p"}, frozenset({"dl"})),
    "dd": ({"dt", "dd", "p"}, frozenset({"dl"})),
    "td": ({"td", "th", "p"}, frozenset({"tr", "table"})),
    "th": ({"td", "th", "p"}, frozenset({"tr", "table"})),
    "tr": ({"tr", "td", "th", "p"}, frozenset({"table"})),
    "option": ({"option"}, frozenset({"select"})),
}
#: Elements that are no part of the text, by tag and by words of class, id or role.
DROPPED_TAGS = frozenset("head nav aside footer form menu search dialog".split())
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar aside menu navbar nav navigation breadcrumb breadcrumbs "
    "header masthead footer cookie cookies consent gdpr notice notices notification alert disclaimer popup modal overlay newsletter subscribe signup "
    "login comment comments reply replies disqus respond share sharing social related recommended recommendations widget toolbar pagination pager tags "
    "complementary contentinfo search skip".split()
)
#: Words that only say where or how large something is: "top-nav-bar" is a nav.
PLAIN_WORDS = frozenset("site page main top bottom left right inner outer global primary secondary list box bar container wrapper wrap block panel section area item items link links posts widgets zone slot row col".split())
#: Elements that no word of their own drops.
KEPT_TAGS = frozenset("html body article main h1 h2 h3 h4 h5 h6".split())
#: Words that speak for a container.
GOOD_WORDS = frozenset("article content contents post story entry text main body page".split())

_TOKEN = re.compile(
    r"<(?:!--(?P<comment>.*?)(?:--!?>|\Z)|(?P<end>/)?(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)(?:>|\Z)|[!?/][^>]*+(?:>|\Z))",
    re.DOTALL,
)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[a-z]+|\d+")
_NUMBER = re.compile(r"\d+")
#: Names that tell what stands next to an element, not what it is.
_ABOUT_OTHERS = re.compile(r"(?:has|with|no|without)-\S+")
#: The share of the best score that a container needs to be taken for being deeper, and links that make a list a menu.
ENOUGH, MENU_LINKS = 0.75, 3
#: Longer paths are named by a hash of their outer part.
LONG_PATH = 2000


@dataclass
class Block:
    text: str
    linked: int  # code points inside links
    dropped: bool


@dataclass
class Container:
    path: str
    first: int  # block that it starts with
    depth: int
    bonus: float
    dropped: bool
    end: int = -1


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    containers: list[Container] = field(default_factory=list)

    def best(self) -> Container | None:
        """The deepest container that scores nearly the best: its bonus times its text outside links."""
        sums = [0]
        for b in self.blocks:
            sums.append(sums[-1] + (0 if b.dropped else max(0, len(b.text) - 2 * b.linked)))
        scored = [(c.bonus * (sums[c.end] - sums[c.first]), c) for c in self.containers if not c.dropped]
        top = max((score for score, _ in scored), default=0)
        enough = [(c.depth, score, -c.first, c) for score, c in scored if score > 0 and score >= ENOUGH * top]
        return max(enough, key=lambda x: x[:3])[3] if enough else None

    def text(self, path: str | None) -> str:
        """The text of the outermost containers on ``path``, else of the page's own best one, else of the page."""
        chosen = [c for c in self.containers if c.path == path and not c.dropped]
        out, at = [], 0
        for c in chosen:
            out += [b.text for b in self.blocks[max(at, c.first) : c.end] if not b.dropped]
            at = max(at, c.end)
        if not out:
            best = self.best()
            out = [b.text for b in (self.blocks[best.first : best.end] if best else self.blocks) if not b.dropped]
        return "\n\n".join(out)


def _drops(token: str) -> bool:
    """Whether a class, id or role says that an element is no text: a word of the kind, with none that says otherwise."""
    words = _WORDS.findall(token)
    rest = [w for w in words if w not in DROPPED_WORDS]
    return len(rest) < len(words) and all(w in PLAIN_WORDS or w.isdigit() for w in rest)


def _ends_of(source: str, tag: str) -> dict[int, int]:
    """Where the content of each closed element ``tag`` begins and where its end tag ends; nested ones are closed from within."""
    found, opened = {}, []
    for m in re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])(?:(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)(?:>|\Z)", re.I).finditer(source):
        if not m[1]:
            opened.append(m.end())
        elif opened:
            found[opened.pop()] = m.end()
    return found


class _Open:
    __slots__ = ("tag", "dropped", "container", "path", "first", "links")

    def __init__(self, tag: str, dropped: bool, container: Container | None, path: str, first: int):
        self.tag, self.dropped, self.container, self.path, self.first, self.links = tag, dropped, container, path, first, 0


def parse(source: str) -> Page:
    """Blocks of text and the containers around them, in one pass; unclosed elements end with what holds them."""
    page, stack = Page(), [_Open("#", False, None, "", 0)]
    text: list[str] = []
    opened: dict[str, int] = {}
    at, linked, in_link, drops = 0, 0, 0, 0

    def flush() -> None:
        nonlocal text, linked
        if text:
            body = " ".join("".join(text).split())
            if body:
                page.blocks.append(Block(body, min(linked, len(body)), drops > 0))
            text, linked = [], 0

    def pop() -> None:
        nonlocal drops, in_link
        top = stack.pop()
        if top.tag in BLOCK:
            flush()
        opened[top.tag] -= 1
        drops -= top.dropped
        in_link -= top.tag == "a"
        if top.container:
            top.container.end = len(page.blocks)
        if top.tag in ("ul", "ol") and top.links >= MENU_LINKS:
            items = page.blocks[top.first :]
            if 10 * sum(b.linked for b in items) >= 9 * sum(len(b.text) for b in items):
                for b in items:
                    b.dropped = True
        stack[-1].links += top.links

    def write(raw: str) -> None:
        nonlocal linked
        if raw:
            plain = html.unescape(raw) if "&" in raw else raw
            text.append(plain)
            if in_link:
                linked += len(plain)

    size, ends = len(source), {}
    while at < size:
        found = _TOKEN.search(source, at)
        if not found:
            write(source[at:])
            break
        write(source[at : found.start()])
        at = found.end()
        tag = found["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if found["end"]:
            if opened.get(tag):
                while stack[-1].tag != tag:
                    pop()
                pop()
            elif tag in BLOCK:
                flush()
            continue
        if tag in RAW:
            if not found["attributes"].endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(source, at)
                at = close.end() if close else size
            continue
        if tag in SKIPPED:
            if not found["attributes"].endswith("/"):
                if tag not in ends:
                    ends[tag] = _ends_of(source, tag)
                at = ends[tag].get(at, at)
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                text.append(" ")
            if tag == "hr":
                flush()
            continue
        closes, scope = CLOSES.get(tag, ((), ()))
        depth = len(stack) - 1
        while depth > 0 and stack[depth].tag not in scope and any(opened.get(t) for t in closes):
            if stack[depth].tag in closes:
                while len(stack) > depth:
                    pop()
            depth -= 1
        if tag in BLOCK:
            flush()
        if tag == "body":
            while len(stack) > 1 and stack[-1].tag == "head":
                pop()
        names, words, speaks = [], set(), False
        for m in _NAMED.finditer(found["attributes"]):
            value = (m[2] or m[3] or m[4] or "").lower()
            told = _ABOUT_OTHERS.sub(" ", value)
            words.update(_WORDS.findall(told))
            speaks = speaks or any(_drops(token) for token in told.split())
            if m[1].lower() == "class":
                names += sorted(set(_NUMBER.sub("0", value).split()))
        if tag == "header":
            dropped = not (opened.get("article") or opened.get("main"))
        else:
            dropped = tag in DROPPED_TAGS or (tag in BLOCK and tag not in KEPT_TAGS and speaks)
        path = stack[-1].path
        if tag in BLOCK and tag != "html":
            path = (path + ">" if path else "") + ".".join([tag, *names])
            if len(path) > LONG_PATH:
                cut = len(path) - LONG_PATH // 2
                path = f"{hashlib.sha256(path[:cut].encode('utf-8', 'replace')).hexdigest()}...{path[cut:]}"
        container = None
        if tag in CONTAINER:
            bonus = 1.5 if tag in ("article", "main") or words & {"article"} else 1.25 if words & GOOD_WORDS else 1.0
            container = Container(path, len(page.blocks), len(stack), bonus, drops > 0 or dropped)
            page.containers.append(container)
        stack.append(_Open(tag, dropped, container, path, len(page.blocks)))
        opened[tag] = opened.get(tag, 0) + 1
        drops += dropped
        if tag == "a":
            in_link += 1
            stack[-1].links = 1
    while len(stack) > 1:
        pop()
    flush()
    return page


def extract(df: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars``, a row per input row.

    The text is the article's: without menus, headers, footers, sidebars, notices, adverts, forms,
    scripts, styles and reader comments. Character references are decoded, white space within a
    block becomes one space, and blocks are joined by an empty line; nothing else is cut. A null or
    empty page has an empty text. URLs without a host (or null) vote together. Of paths with as many
    votes the one that sorts first wins. Repeated rows vote as often as
    they occur; other columns are ignored; an empty table gives an empty result.
    """
    host, _ = host_and_path(F.col("url"))
    pages = df.select(F.col(key).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(source).cast("string").alias("html")).withColumn("host", host)

    def ballots(batch: pa.RecordBatch) -> list:
        best = [parse(h or "").best() for h in batch.column(1).to_pylist()]
        return [batch.column(0), [b and b.path for b in best]]

    votes = map_batches(pages.select("host", "html"), "host string, path string", ballots).where("path is not null")
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("n"))
    winners = stage(counted.groupBy("host").agg(F.min_by("path", F.struct(-F.col("n"), F.col("path"))).alias("path")), "winners")

    types = {f.name: f.dataType.simpleString() for f in pages.schema}
    schema = f"page_id {types['page_id']}, url string, text string"

    def texts(batch: pa.RecordBatch) -> list:
        rows = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
        return [batch.column(0), batch.column(1), [parse(h or "").text(path) for h, path in rows]]

    joined = pages.join(winners, "host", "left").select("page_id", "url", "html", "path")
    return map_batches(joined, schema, texts).withColumn("n_chars", F.length("text").cast("long"))
