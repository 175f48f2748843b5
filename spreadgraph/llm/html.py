"""Main text of web pages by tag-path ratios.

A page becomes a sequence of text blocks, each with the path of tags from the root to it. Text length, punctuation and link text are
aggregated per path; the fused ratio of a path says how much running text its nodes hold. The ratios, smoothed along the page, vote
for the paths whose smoothed value reaches a threshold, and the tag that holds those paths together is the content root. The text is
the blocks, short ones too, of the article around the root or of the elements alike, and what else reaches the threshold, but for
links, notices, comments and the like.
"""

from __future__ import annotations

import html as _html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadgraph.storage import ship

_RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg canvas annotation annotation-xml select option datalist audio video map".split())
_RAW_TEXT = frozenset("script style textarea title iframe noembed noframes xmp".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter output progress q ruby rp rt s samp small span strike strong sub sup time tt u var math mfrac mi mn mo mover mpadded mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover semantics".split())
#: Tags whose content is never main text.
_BOILERPLATE = frozenset("head nav header footer aside form menu dialog button fieldset legend".split()) | _RAW
#: Words of class, id and role that mark what is not main text.
_MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|sidebar|side|aside|menu|nav|navbar|navigation|breadcrumbs?|header|masthead|footer|cookies?|consent|notices?|alert|popup|modal|overlay|"
    r"comments?|replies|respond|disqus|social|share|sharing|related|recommend\w*|newsletter|subscribe|signup|login|search|widget|toolbar|pagination|pager|copyright|legal|complementary|contentinfo|hidden|skip)(?:$|[\s_-])",
    re.I,
)
#: Class names that say what a page has beside them, not what they are.
_STATES = re.compile(r"(?:has|no|not|with|without)[_-]\S*", re.I)
#: Marks that no article inside and no share of the page's text takes back.
_FIRM = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|comments?|replies|respond|disqus|cookies?|consent|hidden)(?:$|[\s_-])", re.I)
_CONTENT_MARK = re.compile(r"(?:^|[\s_-])(?:article|content|main|post|entry|story|body|text)(?:$|[\s_-])", re.I)
#: Tags that a start tag closes when they are open, up to the nearest of the second set.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_TAG_END = re.compile(r"[^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+>")
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_HEADING = re.compile(r"h[1-6]")
#: Names of a header, as parts of a name that may stay in an article.
_HEADER = re.compile(r"(?:^|(?<=[_-]))(?:header|masthead)(?=$|[_-])", re.I)
#: Tags that hold one passage and are no root of the content.
_NO_ROOT = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td ul ol".split())
_PUNCTUATION = re.compile(r"[.,;:!?。，！？；：、]")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in _RAW}


class Node:
    """A tag path: a step below another path. Equal paths of a page are one node, so a path of any depth is compared and counted at once."""

    __slots__ = ("parent", "step", "tag", "depth", "number", "below", "article", "heading", "content")

    def __init__(self, parent: Node | None, step: str, number: int):
        self.parent, self.step, self.number, self.below = parent, step, number, {}
        self.tag = step.partition(".")[0]
        self.depth = parent.depth + 1 if parent else 0
        #: Whether a step of the path is an article or main, a heading, or names content.
        self.article = parent is not None and (parent.article or self.tag in ("article", "main"))
        self.heading = parent is not None and (parent.heading or bool(_HEADING.fullmatch(self.tag)))
        self.content = parent is not None and (parent.content or step.startswith(("article", "main")) or bool(_CONTENT_MARK.search(step.replace(".", " "))))

    @property
    def path(self) -> tuple[str, ...]:
        steps, node = [], self
        while node.parent:
            steps.append(node.step)
            node = node.parent
        return tuple(reversed(steps))


@dataclass
class Block:
    node: Node
    text: str
    link_chars: int
    boilerplate: bool
    #: The innermost element around it that its names alone mark, by number, and the innermost such element around the outermost
    #: article or main; 0 if there is none, or if something else makes it boilerplate.
    mark: int = 0
    outer_mark: int = 0

    @property
    def path(self) -> tuple[str, ...]:
        return self.node.path


@dataclass(slots=True)
class _Open:
    """An open element: its tag and path, whether it or one around it is boilerplate whatever the names say, and the marks as in a block."""

    tag: str
    node: Node
    hard: bool = False
    mark: int = 0
    outer_mark: int | None = None


def _tags(page: str) -> Iterator[tuple[str, str, str]]:
    """('text' | 'open' | 'close', name or text, attributes) in page order; comments, declarations and raw content are left out."""
    at, end = 0, len(page)
    unclosed = False  # a quote once found open to the page's end isn't searched again
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], ""
            return
        if lt > at:
            yield "text", page[at:lt], ""
        if page.startswith("<!--", lt):
            stop = page.find("-->", lt + 2)
            at = end if stop < 0 else stop + 3
            continue
        if page[lt + 1 : lt + 2] in ("!", "?"):
            stop = page.find(">", lt)
            at = end if stop < 0 else stop + 1
            continue
        name = _NAME.match(page, lt + 1)
        if not name:
            yield "text", "<", ""
            at = lt + 1
            continue
        closing = None if unclosed else _TAG_END.match(page, name.end())
        if closing:
            stop = closing.end()
        else:
            unclosed = True
            gt = page.find(">", name.end())
            stop = end if gt < 0 else gt + 1
        tag = name[1].lower()
        if page[lt + 1] == "/":
            yield "close", tag, ""
        else:
            attributes, empty = page[name.end() : stop], page[lt:stop].endswith("/>")
            raw = _RAW_END[tag].search(page, stop) if tag in _RAW and (not empty or tag in _RAW_TEXT) else None
            yield "open", tag, attributes[:-2] + ">" if raw and empty else attributes  # HTML has no empty form of raw text
            if raw:
                stop = raw.start()
        at = stop


def _attributes(text: str) -> tuple[str, bool]:
    """Class, id and role as words, and whether the element is hidden."""
    words, hidden = [], False
    for name, value in _ATTR.findall(text):
        value, name = value.strip("\"'"), name.lower()
        if name in ("class", "id", "role"):
            words.append(value)
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            hidden = True
    return " ".join(words), hidden


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order. Unclosed tags end where HTML says so or with their parent; stray end tags are ignored."""
    out: list[Block] = []
    root = Node(None, "", 0)
    nodes = 1
    stack = [_Open("", root)]
    opened: dict[str, int] = defaultdict(int)  # elements by tag
    names_of: list[list[str]] = []  # of the elements that only names mark, by number from 1
    around: list[int] = []  # the number of the next one around each
    parts: list[str] = []
    links = 0

    def flush() -> None:
        nonlocal parts, links
        text = " ".join("".join(parts).split())
        if text:
            e = stack[-1]
            out.append(Block(e.node, text, links, e.hard or e.mark > 0, 0 if e.hard else e.mark, 0 if e.hard else e.outer_mark or 0))
        parts, links = [], 0

    def pop_to(depth: int) -> None:
        for e in stack[depth:]:
            opened[e.tag] -= 1
        del stack[depth:]

    for kind, value, attributes in _tags(page):
        if kind == "text":
            if stack[-1].tag in _RAW:
                continue
            text = _html.unescape(value)
            parts.append(text)
            if opened["a"]:
                links += len("".join(text.split()))
        elif kind == "open":
            if value == "br":
                parts.append(" ")
                continue
            if value not in _INLINE and value not in _RAW:
                flush()
                for depth in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph and what is open inside it
                    if stack[depth].tag == "p":
                        pop_to(depth)
                        break
                    if stack[depth].tag not in _INLINE:
                        break
                if value in _CLOSES and any(opened[t] for t in _CLOSES[value][0]):
                    ends, scope = _CLOSES[value]
                    for depth in range(len(stack) - 1, 0, -1):
                        if stack[depth].tag in scope:
                            break
                        if stack[depth].tag in ends:
                            pop_to(depth)
                            if value in ("li", "td", "th", "dt", "dd"):
                                break
            if value in _VOID or attributes.rstrip().endswith("/>") and value in _RAW:
                continue
            marks, hidden = _attributes(attributes) if len(attributes) > 1 else ("", False)
            structural = value in ("html", "body", "main", "article")
            hard = hidden or value in _BOILERPLATE and not (value == "header" and opened["article"])
            names = [m for m in marks.split() if not _STATES.fullmatch(m)] if marks and not structural and (value not in _INLINE or value == "a") else []
            if names and opened["article"]:  # an article's own header, as the tag
                names = [_HEADER.sub("", m) for m in names]
            e = stack[-1]
            mark = e.mark
            if not hard and (named := [m for m in names if _MARKS.search(m)] if names and _MARKS.search(" ".join(names)) else []):
                names_of.append(named)
                around.append(mark)
                mark = len(names_of)
            node = e.node
            if value not in _INLINE:
                step = value + ("." + ".".join(sorted(marks.split())) if marks else "")
                if step not in node.below:
                    node.below[step] = Node(node, step, nodes)
                    nodes += 1
                node = node.below[step]
            outer = e.outer_mark if e.outer_mark is not None else e.mark if value in ("article", "main") else None
            stack.append(_Open(value, node, e.hard or hard, mark, outer))
            opened[value] += 1
        elif opened[value]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == value:
                    if value not in _INLINE and value not in _RAW:
                        flush()
                    pop_to(depth)
                    break
                if value in _INLINE and stack[depth].tag not in _INLINE:
                    break
    flush()
    if names_of:
        _lift(out, names_of, around)
    return out


def _lift(found: list[Block], names_of: list[list[str]], around: list[int]) -> None:
    """Take back marks that only name the page's layout, on a page without an unmarked article or main.

    They are those around an article or main with half the running text (text by its ratio), and names like menu-open, of which a part
    is no mark, around four fifths of it. If nothing would stay, all go but firm ones, then all but names that are marks as a whole.
    """
    if any(not b.boilerplate and b.node.article for b in found):
        return
    numbers = range(1, len(names_of) + 1)
    firm = {k for k in numbers if any(_FIRM.search(m) for m in names_of[k - 1])}
    whole = {k for k in numbers if any(all(_MARKS.fullmatch(x) for x in re.split(r"[_-]+", m.strip("_-"))) for m in names_of[k - 1])}
    soft = [b for b in found if b.mark or not b.boilerplate]
    ratios = path_ratios(soft)
    held, inner, used = ([0] * (len(names_of) + 1) for _ in range(3))
    everything = 0.0
    for b in soft:
        x = ratios[b.node] * len(b.text)
        everything += x
        held[b.mark] += x
        inner[b.outer_mark] += x
        used[b.mark] = 1
    for k in reversed(numbers):  # what is in an element is in those around it
        for sums in (held, inner):
            sums[around[k - 1]] += sums[k]
        used[around[k - 1]] |= used[k]
    lifted = {k for k in numbers if k not in firm and 0 < 0.5 * everything <= inner[k]}
    lifted |= {k for k in numbers if k not in firm | whole and 0 < 0.8 * everything <= held[k]}
    every = {k for k in numbers if used[k]}

    def apply() -> None:
        free = [True] * (len(names_of) + 1)
        for k in numbers:
            free[k] = k in lifted and free[around[k - 1]]
        for b in soft:
            b.boilerplate = not free[b.mark]

    for further in (every - firm, every - whole):
        apply()
        if not all(b.boilerplate for b in soft):
            return
        lifted |= further
    apply()


def path_ratios(found: list[Block]) -> dict[Node, float]:
    """The fused ratio of each path: mean text per node times mean punctuation per node (plus one), less by the share of link text."""
    total: dict[Node, list[float]] = defaultdict(lambda: [0, 0, 0, 0])
    for b in found:
        t = total[b.node]
        t[0] += 1
        t[1] += len(b.text)
        t[2] += len(_PUNCTUATION.findall(b.text))
        t[3] += b.link_chars
    return {p: (chars / n) * (1 + marks / n) * max(0.0, 1 - links / max(chars, 1)) ** 2 for p, (n, chars, marks, links) in total.items()}


def smooth(values: list[float], kernel: tuple[float, ...] = (0.25, 0.5, 0.25)) -> list[float]:
    """A weighted moving mean; the ends count their own value for what is missing."""
    half = len(kernel) // 2
    return [sum(k * values[min(max(i + j - half, 0), len(values) - 1)] for j, k in enumerate(kernel)) for i in range(len(values))]


def levels(found: list[Block]) -> tuple[list[float], float]:
    """The blocks' smoothed ratios and the threshold: half their mean, weighted by text."""
    ratios = path_ratios(found)
    level = smooth([ratios[b.node] for b in found])
    weight = [len(b.text) for b in found]
    return level, 0.5 * sum(x * w for x, w in zip(level, weight, strict=True)) / max(sum(weight), 1)


def _lineage(found: list[Block]) -> list[Node]:
    """The blocks' paths and all above them, each after its parent."""
    seen: dict[int, Node] = {}
    for b in found:
        node = b.node
        while node is not None and node.number not in seen:
            seen[node.number] = node
            node = node.parent
    return [seen[n] for n in sorted(seen)]


def content_root(found: list[Block], share: float = 0.8) -> Node | None:
    """The deepest path that holds ``share`` of the text of the blocks whose smoothed ratio reaches the threshold."""
    level, threshold = levels(found)
    held: dict[Node, float] = defaultdict(float)
    everything = 0.0
    for b, x in zip(found, level, strict=True):
        if x >= threshold:
            weight = (2.0 if b.node.content else 1.0) * len(b.text)
            everything += weight
            held[b.node] += weight
    best = None
    for node in reversed(_lineage(found)):
        if node.parent:
            held[node.parent] += held[node]
        if held[node] >= share * everything and node.tag not in _NO_ROOT and (best is None or node.depth >= best.depth):
            best = node
    return best


def content_blocks(found: list[Block]) -> list[Block]:
    """The blocks of the content, in order.

    A root inside an article or main stands for all articles and mains of the page, any other for all elements with its tags,
    whatever their class or id. Outside of them stay blocks whose smoothed ratio reaches the threshold, what lies between two blocks
    of the content, and a heading before it with what follows; but no path that is half link text.
    """
    own = content_root(found)
    steps = []
    node = own
    while node is not None and node.parent:
        steps.append(node)
        node = node.parent
    tags = [x.tag for x in reversed(steps)]
    level, threshold = levels(found)
    chars: dict[Node, list[int]] = defaultdict(lambda: [0, 0])
    for b in found:
        c = chars[b.node]
        c[0] += len("".join(b.text.split()))
        c[1] += b.link_chars
    prose = [2 * chars[b.node][1] < chars[b.node][0] for b in found]
    if not {"article", "main"}.isdisjoint(tags):
        inside = [b.node.article for b in found]
    else:
        same: dict[Node, bool] = {}  # the path has the root's tags as far as both go
        below: dict[Node, bool] = {}
        for node in _lineage(found):
            up = node.parent
            same[node] = up is None or same[up] and (node.depth > len(tags) or node.tag == tags[node.depth - 1])
            below[node] = node is own or up is not None and below[up]
        inside = [below[b.node] or p and b.node.depth >= len(tags) and same[b.node] for b, p in zip(found, prose, strict=True)]
    kept = [i for i in range(len(found)) if inside[i] or prose[i] and level[i] >= threshold]
    if not kept:
        return []
    first, last = kept[0], kept[-1]
    for i in range(first - 1, -1, -1):
        if not prose[i]:
            break
        if found[i].node.heading:
            first = i
    return [found[i] for i in range(first, last + 1) if inside[i] or prose[i]]


def main_text(page: str | None) -> str:
    """The main text: blocks joined by newlines, white space inside a block turned into one space. No text: empty."""
    found = [b for b in blocks(page or "") if not b.boilerplate]
    if not found:
        return ""
    inside = content_blocks(found)
    # lists of links: nodes of one path that are nearly all link text
    linked: dict[Node, list[int]] = defaultdict(lambda: [0, 0, 0])
    for b in inside:
        s = linked[b.node]
        s[0] += 1
        s[1] += len("".join(b.text.split()))
        s[2] += b.link_chars
    menus = {p for p, (n, chars, links) in linked.items() if n >= 3 and links >= 0.8 * chars}
    return "\n".join(b.text for b in inside if b.node not in menus)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every row.

    Null and empty html give an empty text; repeated rows stay; very long and deeply nested pages are taken whole, in time about
    proportional to their length. An empty table gives an empty result; extra columns are ignored, whatever their names.
    """
    ship(pages.sparkSession)

    @F.pandas_udf("string")
    def text_of(page: pd.Series) -> pd.Series:
        return page.map(main_text, na_action=None).astype(object)

    out = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text_of(F.coalesce(F.col(html_col), F.lit(""))).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
