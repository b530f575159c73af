"""Main text of web pages by tree scoring."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corviq.llm.common import bound_batches, slices, with_fields

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
#: Elements whose whole content is no main text.
SKIP = frozenset("head script style noscript template iframe noembed noframes title textarea xmp nav header footer aside form button select option input object embed svg canvas audio video menu dialog map".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul title select template".split()
)
#: A start tag closes an open element of these names, up to the given boundary.
P_CLOSERS = BLOCK - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "head", "html", "body", "button", "title", "select", "template"}
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th")}
SCOPE = frozenset("html body article section main aside div table ul ol dl td th blockquote nav header footer form button template fieldset figure details".split())
BOUNDARY = {"li": frozenset(("ul", "ol", "menu", "dir")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",)), **{n: frozenset(("table",)) for n in ("tr", "td", "th", "tbody", "tfoot")}, "option": frozenset(("select",))}
TOKEN = re.compile(r"<!--|<(/?)([a-zA-Z][^\s/>]*)|<[!?/]")
INSIDE = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
#: Parts of a class or id that name what is no article, wherever it stands.
NEVER = re.compile(
    r"^(?:ads?|advert\w*|adsense|adslot|banners?|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscri\w*|sidebars?|menus?|nav|navbar|navigation"
    r"|breadcrumbs?|footer|masthead|topbar|comments?|commentlist|disqus|respond|replies|share|sharing|social|widgets?|toolbar|paginat\w*|pager|login|signup|signin|copyright)$",
    re.IGNORECASE,
)
#: Of them, those that are none even where little else is left.
COMMENTS = re.compile(r"^(?:ads?|advert\w*|comments?|commentlist|disqus|respond|replies)$", re.IGNORECASE)
#: Parts that name it only outside of the article, or where it is mostly links.
PERHAPS = re.compile(r"^(?:related|recommend\w*|discussion|reply|legal|disclaimer|search|tags?|side|foot|header|hidden|skip)$", re.IGNORECASE)
#: Class names about the page, not about the element: no-sidebar, comments-open, category-news.
ABOUT = re.compile(r"^(?:no|has|have|with|without|is|not|category|cat|tag|postid|page|format|type|status)[-_]|[-_](?:open|closed|enabled|disabled|active|layout|container|wrapper)$", re.IGNORECASE)
ARTICLE = re.compile(r"<(?:article|main)\b", re.IGNORECASE)
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")  # sideBar, cookieNotice
ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "form", "menu", "menubar", "toolbar"))
KEEP = frozenset(("html", "body", "article", "main"))
PARAGRAPHS = frozenset(("p", "pre", "td", "blockquote", "dd", "li", "figcaption"))
CONTAINERS = frozenset(("div", "section", "article", "main", "body"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6", "hgroup"))
LEAST_CHARS, SIBLING_SHARE, LIST_LINKS, LIST_DENSITY, WEAK_SHARE, LEAST_TEXT = 25, 0.2, 3, 0.75, 0.5, 140


class Node:
    """``off``: gives no text; ``by_class``: only because of its class or id; ``weak``: perhaps none, by its class."""

    __slots__ = ("by_class", "kids", "links", "n_links", "name", "off", "parent", "score", "size", "sheltered", "weak")

    def __init__(self, name: str, parent: Node | None, off: bool = False, by_class: bool = False, weak: bool = False):
        self.name, self.parent, self.kids, self.off, self.by_class, self.weak = name, parent, [], off or by_class, by_class and not off, weak
        self.score = 0.0
        self.size = self.links = self.n_links = 0
        self.sheltered = False


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(raw)}


def _unlikely(name: str, raw: str, strict: int) -> tuple[bool, bool, bool]:
    """(no text for sure, none by its class or id, perhaps none by these). ``strict`` 2: all class words count, 1: only
    comments and adverts, 0: none."""
    if name in KEEP or not raw or raw.isspace():
        return False, False, False
    a = _attributes(raw)
    if "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in ROLES:
        return True, False, False
    if "style" in a and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a["style"], re.IGNORECASE):
        return True, False, False
    if not strict:
        return False, False, False
    never = perhaps = False
    for token in (t for k in ("class", "id") if k in a for t in a[k].split()):
        if ABOUT.search(token):
            continue
        parts = [x for x in re.split(r"[-_]+|\d+", HUMP.sub("-", token)) if x]
        # the first or last part says what an element is: site-footer, sidebar-left, related-work is about its subject
        ends = {parts[0], parts[-1]} if parts else set()
        never = never or any((NEVER if strict > 1 else COMMENTS).match(x) for x in ends)
        perhaps = perhaps or strict > 1 and any(PERHAPS.match(x) for x in ends)
    return False, never, perhaps and not never


def parse(page: str, strict: int = 2) -> Node:
    """A forgiving tree: implied ends of paragraphs, items and cells, raw text elements, cut-off tags and comments."""
    root = Node("html", None)
    stack, at, n = [root], 0, len(page)
    opened: Counter[str] = Counter()
    quotes = True  # until a quote never ends: from there on, tags end at the next ">"

    def cut(k: int) -> None:
        for node in stack[k:]:
            opened[node.name] -= 1
        del stack[k:]

    def close(names: tuple[str, ...], boundary: frozenset) -> None:
        if not any(opened[x] > 0 for x in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in names:
                return cut(k)
            if stack[k].name in boundary:
                return

    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            stack[-1].kids.append(page[at:])
            break
        if m.start() > at:
            stack[-1].kids.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            end = page.find("-->", at) if m[0] == "<!--" else page.find(">", at)
            at = n if end < 0 else end + (3 if m[0] == "<!--" else 1)
            continue
        inside = INSIDE.match(page, at) if quotes else None
        if inside is None:
            quotes = False
            end = page.find(">", at)
            if end < 0:
                break  # a tag that is cut off
        else:
            end = inside.end() - 1
        raw, at = page[at:end], end + 1
        name = m[2].lower()
        if m[1]:
            if name in ("html", "body"):
                continue
            for k in range(len(stack) - 1, 0, -1) if opened[name] > 0 else ():
                if stack[k].name == name:
                    cut(k)
                    break
                if name not in BLOCK and stack[k].name in SCOPE:
                    break
            continue
        if name == "html":
            continue
        if name in P_CLOSERS:
            close(("p",), SCOPE)
        if name in CLOSES:
            close(CLOSES[name], BOUNDARY[name])
            if name in ("tr", "tbody", "tfoot"):
                for _ in range(2):
                    close(CLOSES[name], BOUNDARY[name])
        if name == "body":
            close(("head",), frozenset())
        sure, never, perhaps = _unlikely(name, raw, strict)
        node = Node(name, stack[-1], name in SKIP or sure, never, perhaps)
        stack[-1].kids.append(node)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.IGNORECASE).search(page, at)
            at = end.end() if end else n
        elif name not in VOID and not raw.endswith("/"):
            stack.append(node)
            opened[name] += 1
        elif name not in VOID and name in BLOCK | SKIP:  # a slash doesn't end a html element
            stack.append(node)
            opened[name] += 1
    return root


def _order(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(k for k in reversed(node.kids) if isinstance(k, Node))
    return out


def _measure(nodes: list[Node]) -> None:
    """Text and link sizes without what is off. Containers off by their class that hold the article, and the header of
    an article with its heading, are taken back."""
    for node in reversed(nodes):
        node.sheltered = node.name in ("article", "main", "h1") or any(isinstance(k, Node) and k.sheltered for k in node.kids)
        if node.by_class and node.sheltered and node.name in CONTAINERS:
            node.off = False
    inside = {id(n) for n in nodes if n.name in ("article", "main")}
    for node in nodes:
        if node.parent is not None and id(node.parent) in inside:
            inside.add(id(node))
        if node.name == "header" and id(node) in inside and any(isinstance(k, Node) and k.name in HEADINGS for k in node.kids):
            node.off = False
            for kid in node.kids:  # of an article's header, its headings
                if isinstance(kid, Node) and kid.name not in HEADINGS:
                    kid.off = True
    for node in reversed(nodes):
        node.size = node.links = node.n_links = 0
        for kid in node.kids:
            if isinstance(kid, str):
                node.size += len(kid.strip())
            elif not kid.off:
                node.size += kid.size
                node.links += kid.size if kid.name == "a" else kid.links
                node.n_links += kid.n_links + (kid.name == "a")


def _density(node: Node) -> float:
    return node.links / node.size if node.size else 0.0


def _score(nodes: list[Node]) -> list[Node]:
    """Paragraphs give points for length and commas to their ancestors; link density takes a share of them."""
    scored = {}
    live = {id(nodes[0])}
    for node in nodes[1:]:
        if node.off or id(node.parent) not in live:
            continue
        live.add(id(node))
        own = node.name in PARAGRAPHS or node.name in CONTAINERS and any(isinstance(k, str) and len(k.strip()) >= LEAST_CHARS for k in node.kids)
        if not own or node.size < LEAST_CHARS:
            continue
        commas = sum(k.count(",") + k.count("、") + k.count(",") for k in node.kids if isinstance(k, str))
        points = (1 + commas + min(node.size / 100, 3)) * (1 - _density(node))
        up, share = (node if node.name in CONTAINERS else node.parent), 1.0
        while up is not None and share > 0.1:
            if up.name in CONTAINERS or up.name in ("td", "blockquote"):
                up.score += points * share
                scored[id(up)] = up
                share = 0.5 if share == 1.0 else share / 1.5
            up = up.parent
    for node in scored.values():
        node.score *= (1 - _density(node)) * (WEAK_SHARE if node.weak else 1)
    return [n for n in nodes if id(n) in scored]


def _kept(nodes: list[Node]) -> list[Node]:
    """The best container, or the article it lies in, with the siblings that belong to it, in page order."""
    scored = _score(nodes)
    best = max(scored, key=lambda n: n.score, default=None)
    if best is None:
        for name in ("article", "main", "body"):
            for node in nodes:
                if node.name == name and not node.off and node.size:
                    return [node]
        return [nodes[0]]
    top, up = best, best
    while up is not None:
        if up.name in ("article", "main") and top.name != "article":
            top = up
        up = up.parent
    if top.parent is None or top.name == "body":
        return [top]
    limit = max(10.0, SIBLING_SHARE * top.score)
    out = []
    for kid in top.parent.kids:
        if not isinstance(kid, Node) or kid.off:
            continue
        near = kid.score >= limit and kid.name == top.name and not kid.weak
        text = kid.name == "p" and top.name not in ("article", "main") and not kid.weak and kid.size > 0 and _density(kid) < (0.25 if kid.size >= 80 else LIST_DENSITY)
        head = kid.name in ("h1", "h2") and top.name not in ("article", "main") and not out and kid.links == 0
        if kid is top or near or text or head:
            out.append(kid)
    return out


def _text(node: Node, out: list[str], menus: bool) -> None:
    """The text of a kept element. ``menus``: lists of short links before its first paragraph go."""
    todo: list = [node]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            out.append(item)
            continue
        if item.off or item is not node and item.weak and item.n_links and _density(item) > LIST_DENSITY:
            continue
        if item.name in PARAGRAPHS and item.size >= LEAST_CHARS and _density(item) <= LIST_DENSITY:
            menus = False
        if menus and item is not node and item.name in ("ul", "ol", "div", "dl") and item.n_links >= LIST_LINKS and _density(item) > LIST_DENSITY:
            continue
        block = item.name in BLOCK
        if block:
            out.append("\n")
            todo.append("\n")
        todo.extend(reversed(item.kids))


def _main(page: str, strict: int) -> str:
    nodes = _order(parse(page, strict))
    _measure(nodes)
    out: list[str] = []
    for node in _kept(nodes):
        _text(node, out, node.name not in ("article", "main"))
        out.append("\n")
    return " ".join(html.unescape("".join(out)).split())


def main_text(page: str | None) -> str:
    """The article of a page as blocks joined by one space; empty if the page is null or has no text.

    Elements of menus, headers, footers, sidebars, notices, adverts, forms and comments are told by name, role and
    class and give no text; the rest is scored. Some classes (related, tags, discussion ...) decide only outside the
    article, or where there are mostly links. If next to nothing is left of a page without an article element, its
    classes were about the page: it is scored again without them, but for comments and adverts. Character references are decoded, white space inside a block becomes one space. Nothing inside
    the kept containers is dropped but those elements, and before their first paragraph menus without a name.
    """
    if not page:
        return ""
    text = _main(page, 2)
    if len(text) < LEAST_TEXT and not ARTICLE.search(page):
        again = _main(page, 1)
        text = again if len(again) > 2 * len(text) else text
    return text or _main(page, 0)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "_corviq_html"):
        at = batch.schema.get_field_index("_corviq_html")
        texts = [main_text(p.as_py()) for p in batch.column(at)]
        kept = [k for k in range(batch.num_columns) if k != at]
        yield pa.record_batch(
            [*(batch.column(k) for k in kept), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64(), size=len(texts))],
            [*(batch.schema.names[k] for k in kept), "text", "n_chars"],
        )


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` with text and n_chars (code points). Each page by itself: no shuffle; rows are never dropped.

    Null and empty pages give an empty text. Pages of any length are parsed whole, without recursion over their depth.
    """
    bound_batches(pages)
    source = pages.select(*keep, F.col(html_col).alias("_corviq_html"))
    return source.mapInArrow(_extracted, with_fields(pages.select(*keep).schema, ("text", "string"), ("n_chars", "long")))
