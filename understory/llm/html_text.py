"""Main text of web pages by tree scoring."""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from understory.llm.text import pick, ready, text_runs

_TAG = re.compile(r"""<!--(?:.*?-->|.*)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*+)(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/>"']|$)""", re.I)
_SPACE = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp
small span strike strong sub sup time tt u var wbr""".split())
#: Elements that never hold main text.
DROPPED = frozenset("head nav footer aside button select option input menu dialog audio video canvas object embed map".split()) | RAW
#: A form with this much text outside its links, and this many characters a control, is a page that lies in a form.
FORM_TEXT, FORM_TEXT_A_CONTROL = 500, 60
CONTROLS = frozenset("input select textarea button".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class names and ids that mark what isn't main text.
ASIDE = frozenset("""ad ads adv advert adverts advertisement advertisements advertising adsense banner banners sponsor sponsored sponsors
promo promotion promoted nav navbar navigation menu menus submenu breadcrumb breadcrumbs sidebar sidebars side aside rail footer foot
header masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay dialog newsletter subscribe
subscription signup login share sharing social related recommended recommendations recommend widget widgets comment comments reply
replies respond disqus discussion feedback pagination pager paging search form copyright legal disclaimer tags taglist toc skip hidden
teaser outbrain taboola""".split())
#: Of these words, the ones that also name parts of an article, where one of the others stands beside them.
PART = frozenset("header side discussion feedback form hidden text".split())
CONTENT = frozenset("article content post entry story".split())
#: Layout names like "with-sidebar" tell of another element.
ABOUT = frozenset("has with no without".split())
#: A block of these starts where an open paragraph ends.
CLOSES_P = frozenset("""address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header
hr main menu nav ol p pre section table ul""".split())
CLOSED_BY_OWN_KIND = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)),
                      "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}


class Node:
    __slots__ = ("tag", "parent", "items", "dropped", "points", "chars", "link_chars", "names", "holder")

    def __init__(self, tag: str, parent: Node | None, dropped: bool, names: frozenset = frozenset()):
        self.tag, self.parent, self.dropped, self.names = tag, parent, dropped, names
        self.items: list = []  # texts and nodes in page order
        self.points, self.chars, self.link_chars = 0.0, 0, 0
        # the nearest ancestor that isn't inline
        self.holder = parent if parent is None or parent.tag not in INLINE else parent.holder


def _names(attributes: str) -> tuple[frozenset, bool]:
    """Words of class and id, and whether the element is hidden or has a role outside the main text."""
    words, off = set(), False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
        if name in ("class", "id"):
            for token in re.split(r"[^A-Za-z0-9]+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", value)):
                words.add(token.lower())
        elif name == "role":
            off |= value.strip().lower() in ROLES
        elif name == "style":
            off |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            off = True
    return frozenset(words), off


def parse(page: str) -> Node:
    """The page as a tree; unclosed and stray tags are put right as browsers do (what follows an unclosed script, style, title
    or the like belongs to it)."""
    root = top = Node("html", None, False)
    at, n = 0, len(page)
    opened, forms = Counter(), []  # open elements of each tag, so that a stray end tag costs nothing

    def text(piece: str) -> None:
        if piece:
            top.items.append(html.unescape(piece) if "&" in piece else piece)

    def close_to(tags: tuple, stop: tuple) -> None:
        """Close the nearest open element of tags unless one of stop is nearer."""
        if not any(opened[t] for t in tags):
            return
        node = top
        while node is not None and node.tag not in stop:
            if node.tag in tags:
                close(node)
                return
            node = node.parent

    def close(node: Node) -> None:
        """Close an open element and all within it."""
        nonlocal top
        while top is not node:
            opened[top.tag] -= 1
            top = top.parent
        opened[node.tag] -= 1
        top = node.parent

    while at < n:
        begin = page.find("<", at)
        if begin < 0:
            text(page[at:])
            break
        m = _TAG.match(page, begin)
        if not m:  # a lone sign
            text(page[at:begin + 1])
            at = begin + 1
            continue
        text(page[at:begin])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:-3])
            continue
        if m[1] or m[4]:
            if opened[tag]:
                node = top
                while node.tag != tag:
                    node = node.parent
                close(node)
            continue
        attributes = (m[3] if m[2] else m[6]) or ""
        if tag in ("html", "body"):
            continue
        if tag in CLOSES_P:
            close_to(("p",), ("table", "td", "th", "li", "article", "section", "div", "blockquote", "button", "html"))
            if tag[0] == "h" and tag[1:].isdigit() and top.tag[0] == "h" and top.tag[1:].isdigit():
                close(top)
        elif tag in CLOSED_BY_OWN_KIND:
            kinds, stop = CLOSED_BY_OWN_KIND[tag]
            for _ in range(2 if tag == "tr" else 1):
                close_to(tuple(kinds.split()), stop)
        names, off = _names(attributes) if attributes.strip() else (frozenset(), False)
        off |= tag in DROPPED
        if tag == "header":  # the heading of an article is its own; a page's header isn't
            off |= not (opened["article"] or opened["main"])
        elif tag == "form":
            off |= _is_aside(names - {"form"})
        elif tag not in ("article", "main") or names & {"comment", "comments", "reply"}:
            off |= _is_aside(names)
        child = Node(tag, top, top.dropped or off, names)
        top.items.append(child)
        closed = attributes.rstrip().endswith("/")
        if tag in RAW and not (closed and tag in ("svg", "math")):
            end = re.compile(f"</{re.escape(tag)}[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
        elif tag not in VOID and tag not in RAW:  # a closing slash on an ordinary element means nothing
            top = child
            opened[tag] += 1
            if tag == "form":
                forms.append(child)
    for form in reversed(forms):
        if not form.dropped and not _holds_page(form):
            form.dropped = True
    return root


def _holds_page(form: Node) -> bool:
    """Whether a form is one around a page, by its text outside links and its controls."""
    text = controls = 0
    stack = [form]
    while stack:
        node = stack.pop()
        for x in node.items:
            if isinstance(x, str):
                text += len(x.strip())
            elif x.tag in CONTROLS:
                controls += 1
            elif not x.dropped and x.tag != "a":
                stack.append(x)
    return text >= FORM_TEXT and text >= FORM_TEXT_A_CONTROL * controls


def _inline_text(node: Node) -> str:
    """Text of a node's inline content."""
    out, stack = [], [iter(node.items)]
    while stack:
        x = next(stack[-1], None)
        if x is None:
            stack.pop()
        elif isinstance(x, str):
            out.append(x)
        elif x.tag == "br":
            out.append(" ")
        elif not x.dropped:
            stack.append(iter(x.items))
    return "".join(out)


def blocks(node: Node) -> list[str]:
    """Texts of a container's blocks in page order, white space made single, empty ones left out."""
    out, line = [], []

    def end() -> None:
        if line:
            got = _SPACE.sub(" ", "".join(line)).strip()
            if got:
                out.append(got)
            line.clear()

    stack = [iter(node.items)]
    inline = [True]
    while stack:
        x = next(stack[-1], None)
        if x is None:
            stack.pop()
            if not inline.pop():
                end()
        elif isinstance(x, str):
            line.append(x)
        elif x.tag == "br":
            line.append(" ")
        elif not x.dropped:
            inside = x.tag in INLINE
            if not inside:
                end()
            stack.append(iter(x.items))
            inline.append(inside)
    end()
    return out


def _gather(root: Node) -> list[Node]:
    """Every kept node in page order, with the characters of its text and of its links."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(x for x in reversed(node.items) if not isinstance(x, str) and not x.dropped)
    for node in reversed(order):
        own = sum(len(x.strip()) for x in node.items if isinstance(x, str))
        node.chars += own
        if node.tag == "a":
            node.link_chars = node.chars
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.link_chars += node.link_chars
    return order


def _density(node: Node) -> float:
    return node.link_chars / node.chars if node.chars else 0.0


def _score(node: Node) -> float:
    """Points of a container and of its name, discounted by its links."""
    return (node.points + {"article": 25, "main": 15}.get(node.tag, 0) + 10 * bool(node.names & (CONTENT | {"main", "body"}))) * (1 - _density(node))


def _is_aside(names: frozenset) -> bool:
    """Whether words of class and id mark an element as no main text."""
    marks = names & ASIDE
    return bool(marks) and not names & ABOUT and not (marks <= PART and bool(names & CONTENT))


def _pieces(items: list) -> list[Node]:
    """The kept blocks of items in page order; text and inline elements between two blocks are one paragraph."""
    out, run = [], []

    def end() -> None:
        if run:
            piece = Node("p", None, False)
            piece.items = list(run)
            for x in run:
                piece.chars += len(x.strip()) if isinstance(x, str) else x.chars
                piece.link_chars += 0 if isinstance(x, str) else x.link_chars
            if piece.chars:
                out.append(piece)
            run.clear()

    for x in items:
        if isinstance(x, str) or x.tag == "br" or x.tag in INLINE:
            if isinstance(x, str) or not x.dropped:
                run.append(x)
        else:
            end()
            if not x.dropped:
                out.append(x)
    end()
    return out


def main_text(page: str | None) -> str:
    """The blocks of the best container and of its good siblings, one line each."""
    if not page:
        return ""
    order = _gather(parse(page))
    for node in order:
        if node.tag in INLINE:
            continue
        # a paragraph is a block with text of its own: its inline content, not that of blocks inside
        own = "".join(x if isinstance(x, str) else _inline_text(x) if x.tag in INLINE and not x.dropped else "" for x in node.items).strip()
        if not own:
            continue
        density = _density(node)
        if node.tag == "html":  # of the page's own text, as all other text is below it
            links = sum(x.link_chars for x in node.items if not isinstance(x, str) and x.tag in INLINE and not x.dropped)
            density = min(links / len(own), 1.0)
        points = (1 + own.count(",") + min(len(own) / 100, 3)) * (1 - density)
        holder, share = (node.parent if node.tag in ("p", "pre", "blockquote", "li", "td", "h1", "h2", "h3", "h4", "h5", "h6", "dd", "dt", "figcaption")
                         else node), 1.0
        if holder is not None and holder.tag in INLINE:
            holder = holder.holder
        for depth in (1, 2, 3):
            if holder is None:
                break
            holder.points += points * share
            share = 1 / (2 * depth)
            holder = holder.holder
    best, top = None, 0.0
    for node in order:
        if node.points > 0 and node.tag not in INLINE:
            score = _score(node)
            if score > top:
                best, top = node, score
    if best is None:
        return ""
    # siblings have no points for a name; an article is held against them by its text alone
    least = max(10.0, 0.2 * (best.points * (1 - _density(best)) if best.tag in ("article", "main") else top))
    while best.parent is not None and best.parent.tag not in INLINE and _pieces(best.parent.items) == [best]:
        best = best.parent  # a mere wrapper: its siblings are the siblings
    out = []
    for x in _pieces(best.parent.items) if best.parent is not None else [best]:
        if x is best:
            out += blocks(best)
        elif not _is_aside(x.names):
            long = x.tag == "p" and x.chars > 80 and _density(x) < 0.25
            also = x.tag in ("article", "main") and x.points > 0 and _score(x) >= 0.2 * top
            if x.points * (1 - _density(x)) >= least or long or also:
                out += blocks(x)
    return "\n".join(out)


def extract_text(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """The columns named in keep, text and n_chars (code points) for every page.

    Each page is one parse of its whole html in the task that reads it, without a shuffle. NULL or empty html, and pages
    without main text, give an empty text. Columns not named in keep are left out, so their names can't clash; keep
    can't hold text or n_chars.
    """
    ready(pages.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", text string, n_chars bigint"

    def run(batches):
        for batch in batches:
            for start, end, texts in text_runs(batch.column(len(keep)), 8 << 20):
                got = [main_text(t) for t in texts.to_pylist()]
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:len(keep)], pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())],
                    names=[*keep, "text", "n_chars"])

    return pick(pages, **{c: c for c in keep}, **{"_html": html_col}).mapInArrow(run, schema)
