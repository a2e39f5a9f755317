"""Main text of HTML pages by composite text density.

Each page becomes a small DOM (a tag scanner with HTML's implied end tags).
Subtrees that are never main text (scripts, menus, forms, adverts, notices,
comments, hidden parts, ...) are taken out; a class or id word alone takes a subtree
out only if it holds neither all article and main elements nor a large share of the
body's unlinked characters.  Every remaining node gets a density,
its characters per tag weighed down by the share of linked characters and tags;
a node's score is the sum of its children's densities.  The node with the largest
score is the core; the least density on the path from body to it is the threshold
that siblings along this path must reach to be kept beside it, or they hold a good share
of as much text as the core and are about as dense.  Headings that directly precede a kept
block stay.  Inside an article or main, the outermost is kept, with others of the page that
resemble it.  Text that stands
directly in a node of the path, with the inline elements around it, counts as a sibling
of its own.

Defined results: null or empty html, or a page without text, gives an empty
string; broken markup is read as far as it goes; a page without a core keeps what
the body has; rows are independent, so repeated rows repeat; other columns are
ignored."""

from __future__ import annotations

import html as _html
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML and words of common class and id names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
DROPPED = frozenset("""script style noscript iframe template nav footer aside form button select textarea input
    svg canvas object embed dialog head title menu datalist audio video map math""".split())
BLOCKS = frozenset("""address article aside blockquote body br caption center dd details div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary
    table tbody td tfoot th thead tr ul""".split())
CLOSES_P = BLOCKS - frozenset("br caption td th tr tbody tfoot thead body html".split())
SIBLINGS = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table", "td": "tr table", "th": "tr table",
            "option": "select", "tbody": "table", "thead": "table", "tfoot": "table"}
ENDED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
            "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th"),
            "thead": ("tbody", "thead", "tfoot"), "tfoot": ("tbody", "thead", "tfoot", "tr", "td", "th")}
NOISE = frozenset("""ad ads adv advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs
    comment comments commentlist consent cookie cookies disclaimer disqus footer gdpr hidden login masthead menu modal
    nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promoted
    promotion recommended related reply replies respond search share sharing sidebar signup skip social sponsor
    sponsored subscribe subscription teaser toolbar tracking widget widgets""".split())
#: Words that name a part together with a noise word ("comments-area"); other names with a
#: noise word ("has-sidebar", "comments-open") may as well tell the state of a wrapper.
PART = frozenset("area block body box container content form inner item links list main post posts section thread wrap wrapper".split())
#: Share of the body's unlinked characters above which such a name is no noise: of a part, of another name.
PART_SHARE, NAME_SHARE = 0.9, 0.3
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Share of the core's unlinked text, and of its text per tag, that makes a block beside it part of the
#: main text, and the share of linked text it may have.
CORE_SHARE, MAX_LINKED = 0.5, 0.2
KEPT = frozenset("html body article main".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*)|<[!?/][^>]*(?:>|\Z)", re.S)
_TAG_EVENT = re.compile(r"[>\"']")
_OPEN_TAG = re.compile(r"<[a-zA-Z][^<]*\Z", re.S)
_ATTR = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_NAME = re.compile(r"[a-z]+|[0-9]+")


class Node:
    __slots__ = ("tag", "parent", "children", "noise", "limit", "chars", "tags", "link_chars", "link_tags", "density", "score")

    def __init__(self, tag, parent, noise=False):
        self.tag, self.parent, self.noise = tag, parent, noise
        self.limit = None  # the share above which a node with a noise name is kept
        self.children = []  # nodes and text strings, in page order


def _is_noise(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in DROPPED or tag == "header" and not in_article:
        return True
    if not attrs.strip() or tag in KEPT:
        return False
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), _html.unescape(value.strip("\"'")).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name == "role" and value in NOISE_ROLES:
            return True
    return False


def _name_limit(attrs: str) -> float | None:
    """The share above which a node is kept in spite of its class and id names; None
    without a noise word."""
    limit = None
    for name, value in _ATTR.findall(attrs):
        if name.lower() in ("class", "id"):
            for part in _html.unescape(value.strip("\"'")).lower().split():
                own = _NAME.findall(part)
                if not NOISE.isdisjoint(own):
                    if all(w in NOISE or w in PART or w.isdigit() for w in own):
                        return PART_SHARE
                    limit = NAME_SHARE
    return limit


def _judge_names(root: Node) -> None:
    """Marks as noise the nodes with a noise name, unless they hold every article and main
    element or more than their limit of the body's unlinked characters."""
    nodes = _clean_nodes(root)
    body = next((n for n in nodes if n.tag == "body"), root)
    for n in nodes:
        n.chars = n.tags = 0  # unlinked characters, article and main elements
    for n in reversed(nodes):
        if n.tag == "a":
            n.chars = 0
        else:
            n.chars += sum(len("".join(c.split())) for c in n.children if isinstance(c, str))
        # an article that is named a comment or teaser is not the page's
        n.tags += n.tag in ("article", "main") and n.limit is None
        if n.parent is not None:
            n.parent.chars += n.chars
            n.parent.tags += n.tags
    for n in nodes:
        if n.limit is not None and n.tag not in KEPT:
            n.noise = not (body.tags and n.tags == body.tags) and n.chars <= n.limit * body.chars


class _Tags:
    """Finds a page's tags from left to right, in time linear in the page."""

    def __init__(self, page: str):
        self.page = page
        self.event = -1  # first quote or > at or after the last place asked for
        self.broken: set[int] = set()  # quotes and > from which no tag ends

    def _next_event(self, at: int) -> int:
        if self.event < at:
            m = _TAG_EVENT.search(self.page, at)
            self.event = m.start() if m else len(self.page)
        return self.event

    def _close(self, at: int) -> int:
        """Where the > of the tag stands whose attributes begin at ``at``; -1: nowhere."""
        page, seen, event = self.page, [], self._next_event(at)
        while event < len(page) and event not in self.broken:
            if page[event] == ">":
                return event
            seen.append(event)
            other = page.find(page[event], event + 1)
            m = _TAG_EVENT.search(page, other + 1) if other >= 0 else None
            event = m.start() if m else len(page)
        self.broken.update(seen)
        return -1

    def next(self, pos: int):
        """``(start, end, is end tag, name, attributes)`` of the next markup; an empty name for comments and the like."""
        at = pos
        while m := _MARKUP.search(self.page, at):
            if not m[2]:
                return m.start(), m.end(), False, "", ""
            close = self._close(m.end())
            if close >= 0:
                return m.start(), close + 1, bool(m[1]), m[2].lower(), self.page[m.end():close]
            if m[1]:  # an end tag with a broken quote goes as far as the next >
                return m.start(), self.page.find(">", m.end()) + 1 or len(self.page), False, "", ""
            at = m.start() + 1
        return None


def parse(page: str) -> Node:
    """The page's tree; noise subtrees are marked, raw text elements have no text."""
    root = Node("#root", None)
    stack, pos, end = [root], 0, len(page)
    articles, named = 0, False
    places: dict[str, list[int]] = {}  # where the open elements of a name stand in the stack
    tags = _Tags(page)

    def last(tag):
        return places[tag][-1] if places.get(tag) else 0

    def pop_to(depth):
        nonlocal articles
        for n in stack[depth:]:
            articles -= n.tag in ("article", "main")
            places[n.tag].pop()
        del stack[depth:]

    def text(upto):
        if upto > pos:
            stack[-1].children.append(_html.unescape(page[pos:upto]))

    while pos < end:
        found = tags.next(pos)
        if not found:
            cut = _OPEN_TAG.search(page, pos)  # a tag that the page's end cuts off
            text(cut.start() if cut else end)
            break
        start, after, is_end, tag, attrs = found
        text(start)
        pos = after
        if not tag:
            continue
        if is_end:
            if at := last(tag):
                pop_to(at)
            continue
        if tag in CLOSES_P and (at := last("p")):
            pop_to(at)
        if tag in ENDED_BY:
            stop = max(last(x) for x in SIBLINGS[tag].split())
            ended = [places[x][k] for x in ENDED_BY[tag] if places.get(x)
                     and (k := bisect_right(places[x], stop)) < len(places[x])]
            if ended:
                pop_to(min(ended))
        node = Node(tag, stack[-1], _is_noise(tag, attrs, articles > 0))
        stack[-1].children.append(node)
        if not node.noise and attrs.strip():
            node.limit = _name_limit(attrs)
            named = named or node.limit is not None
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, pos)
            pos = page.find(">", close.end()) + 1 if close else 0
            pos = pos or end
            node.noise = True
        elif tag not in VOID and not attrs.endswith("/"):
            places.setdefault(tag, []).append(len(stack))
            stack.append(node)
            articles += tag in ("article", "main")
    if named:
        _judge_names(root)
    return root


def _clean_nodes(root: Node) -> list[Node]:
    """Nodes that are not noise, parents first."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo.extend(c for c in reversed(n.children) if isinstance(c, Node) and not c.noise)
    return out


def _density(n: Node, ratio: float) -> float:
    if not n.chars:
        return 0.0
    plain = max(n.chars - n.link_chars, 0)
    base = math.log(n.chars / (plain + 1) * n.link_chars + ratio * n.chars + math.e)
    x = n.chars / (n.link_chars + 1) * (n.tags + 1) / (n.link_tags + 1)
    return n.chars / (n.tags + 1) * max(math.log(x + 1) / math.log(base + 1), 0.0)


def _densities(nodes: list[Node], body: Node) -> float:
    """Sets every node's density and score; returns the body's share of linked characters."""
    for n in nodes:
        n.chars = n.tags = n.link_chars = n.link_tags = 0
    for n in reversed(nodes):
        n.chars += sum(len("".join(c.split())) for c in n.children if isinstance(c, str))
        if n.tag == "a":
            n.link_chars, n.link_tags = n.chars, n.link_tags + 1
        if n.parent is not None:
            p = n.parent
            p.chars += n.chars
            p.tags += n.tags + 1
            p.link_chars += n.link_chars
            p.link_tags += n.link_tags
    ratio = (body.link_chars + 1) / (body.chars + 1)
    for n in nodes:
        n.density = _density(n, ratio)
    for n in nodes:
        n.score = sum(c.density for c in n.children if isinstance(c, Node) and not c.noise)
    return ratio


def _with_runs(n: Node, on_path: set, ratio: float) -> list[Node]:
    """The children of a node on the path, where each run of text and inline elements (and
    line breaks) that holds text of the node itself is one more node."""
    out, run = [], []

    def close():
        if any(isinstance(c, str) and c.strip() for c in run):
            node = Node("#text", n)
            node.children = list(run)
            inner = [c for c in run if isinstance(c, Node)]
            node.chars = sum(len("".join(c.split())) for c in run if isinstance(c, str)) + sum(c.chars for c in inner)
            node.tags = sum(c.tags + 1 for c in inner)
            node.link_chars, node.link_tags = sum(c.link_chars for c in inner), sum(c.link_tags for c in inner)
            node.density = _density(node, ratio)
            out.append(node)
        else:
            out.extend(c for c in run if isinstance(c, Node))
        run.clear()

    for c in n.children:
        if isinstance(c, str):
            run.append(c)
        elif not c.noise:
            if id(c) in on_path or any(x.tag in BLOCKS and x.tag != "br" for x in _clean_nodes(c)):
                close()
                out.append(c)
            else:
                run.append(c)
    close()
    return out


def _resembles(n: Node, core: Node) -> bool:
    """A block beside the core that holds a good share of as much text, hardly linked, about as dense."""
    plain, other = n.chars - n.link_chars, core.chars - core.link_chars
    return (plain >= CORE_SHARE * other and n.link_chars <= MAX_LINKED * n.chars
            and plain * (core.tags + 1) >= CORE_SHARE * other * (n.tags + 1))


def _articles(inside: list[Node], core: Node) -> list[Node]:
    """The outermost articles and mains that are, like the core's, no excerpts; page order."""
    out, todo = [], [inside[0]]
    while todo:
        n = todo.pop()
        if n is core or n.tag in ("article", "main") and n.limit is None:
            if n is core or _resembles(n, core):
                out.append(n)
            continue
        todo.extend(c for c in reversed(n.children) if isinstance(c, Node) and not c.noise)
    return out


def main_nodes(root: Node) -> list[Node] | None:
    """The kept subtrees' roots in page order."""
    nodes = _clean_nodes(root)
    body = next((n for n in nodes if n.tag == "body"), root)
    ratio = _densities(nodes, body)
    inside = _clean_nodes(body)
    core = max(inside, key=lambda n: n.score)
    if core.score <= 0:
        return [body]
    path, n = [], core
    while n is not None:
        path.append(n)
        if n is body:
            break
        n = n.parent
    marked = [n for n in path if n.tag in ("article", "main")]
    if marked:
        return _articles(inside, marked[-1])
    threshold = min(n.density for n in path)
    on_path, keep = set(map(id, path)), []

    if core is body:
        return [body]
    todo, heading = [body], []
    while todo:  # page order: a node on the path is replaced by its children
        n = todo.pop()
        if n is core or id(n) not in on_path:
            if n is core or n.chars > 2 * n.link_chars and (n.density >= threshold or _resembles(n, core)):
                keep.extend(heading)
                keep.append(n)
                heading = []
            elif n.tag in HEADINGS and n.chars > 2 * n.link_chars:
                heading.append(n)  # kept if what follows it is
                continue
            elif n.tag == "#text":  # not kept as a whole: its elements by themselves
                todo.extend(c for c in reversed(n.children) if isinstance(c, Node))
            if n.chars:
                heading = []
            continue
        todo.extend(reversed(_with_runs(n, on_path, ratio)))
    return keep


def main_text(page: str | None) -> str:
    if not page:
        return ""
    blocks, current = [], []

    def flush():
        got = " ".join("".join(current).split())
        if got:
            blocks.append(got)
        current.clear()

    for top in main_nodes(parse(page)):
        flush()
        todo = [top]
        while todo:
            x = todo.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                current.append(x)
            elif not x.noise:
                if x.tag in BLOCKS:
                    flush()
                    todo.append(None)
                todo.extend(reversed(x.children))
    flush()
    return " ".join(blocks)


def extract_main_text(pages: DataFrame, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row."""
    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()),
                                   pa.array([len(t) for t in texts], pa.int64())],
                                  names=["page_id", "url", "text", "n_chars"])

    kinds = dict(src.dtypes)
    return src.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
