"""Operator 2: main text of web pages by tag-path ratios.

A page is read into text nodes, each with its path of tags from the root. For every path the characters, punctuation marks, link characters and nodes are
summed; characters per node, punctuation per node and the share of unlinked text are fused to one ratio. Ratios are smoothed along the page
and averaged by path again; paths at or above a threshold from their spread are content. An article or main box is one weight in the fused ratio: its paths share the ratio of
the whole box times a factor that grows with the cube of the box's share of the page's text.

Names are weights: an element whose tag (nav, footer, aside, form, ...), class or id names a box of another kind lowers the paths below it, unless the text is under that name:
elements that bear it hold most of the page's text or of its articles'. A page inside one form is read as any other. They are content only where there is no
other, or where their ratio is like the content's own, in the box that holds it; this last doesn't hold for elements that name their kind by their tag, nor for names of what
readers say (comments, discussion, ...).

The least box that holds nearly all of the content carries its short paths with it: headlines, lists, table cells and what else stands in it without such a name, unless
it is mostly links. A page whose least box is the body carries what stands in headings, paragraphs, lists and tables alone.

Character references are decoded, white space inside a block becomes one space, blocks are joined by one space; nothing else is dropped or cut.

Inside an article box only names of STRONG count, and a class of several words names a box if all of them do (related-posts, not related-work).

Rows: one for each input row, repeated rows and null ids included. A null, empty or textless page has the empty text. Equal pages have equal texts. A path at the threshold is
content; of boxes that hold equally much, the innermost is taken. Other columns are not read; an empty table gives an empty result. Whole pages are read in one pass; time
and memory grow with a page's length, however deep its elements, and whether or not they end.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.llm.common import documents, map_texts

#: Share of the spread of path ratios that content must reach, and nodes on either side that smoothing looks at.
THRESHOLD, REACH = 0.5, 2
#: Factor of an article box that has all of the page's text, and the least share of unlinked text that counts for a box: one of links alone is still a box.
BOX, UNLINKED = 150, 0.1
#: Factor of paths below a name of BOXES, and the share of the text from which such a name says nothing: a word alone (comments), one of several (elementor-widget).
LOW, HELD_ALONE, HELD = 0.02, 0.95, 0.5
#: Share of the content's text that the box which carries has at least, the share of its characters that may be links in what it carries, and the share of the content's ratio from which a name doesn't count.
CARRIES, LINKS, ALIKE = 0.9, 0.5, 0.6

#: Elements of HTML by what they mean here (fixed values of the standard).
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "meter", "nobr",
    "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
    "math", "mfrac", "mi", "mn", "mo", "mover", "mroot", "mrow", "ms", "mspace", "msqrt", "mstyle", "msub", "msubsup", "msup", "mtext", "munder", "munderover", "semantics",
}
RAW = {"script", "style", "noscript", "template", "iframe", "title", "textarea", "svg", "canvas", "video", "audio", "noembed", "noframes", "xmp"}
#: Of these, those that end with the page where no end tag follows.
ENDLESS = {"script", "style", "title", "textarea"}
NEVER = {"head", "button", "select", "datalist", "option"}
#: Elements that name a box of another kind, as a class does; a menu inside an article is a list.
KINDS = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset"}
#: What an element's start ends, if it is open.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "option": {"option"},
}
#: Boxes that ENDS and a paragraph's end don't reach out of.
WALLS = {"ul", "ol", "dl", "table", "article", "section", "div", "main", "body", "html", "aside", "nav", "footer", "header", "form", "blockquote", "td", "th"}
#: Elements that a body carries.
FLOW = {
    "p", "h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "header", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "figure",
    "figcaption", "blockquote", "pre", "center", "html", "body",
}
#: Of these, and of elements that name a box of another kind, those that may hold a page's content.
HOLDERS, MAY_HOLD = {"td", "center", "html", "body"}, {"<form>", "<fieldset>", "<header>"}
#: Words of a class, id or role that name a box which is no content.
BOXES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adbox", "adsense", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
    "consent", "contentinfo", "cookie", "cookies", "disclaimer", "disqus", "footer", "gdpr", "login", "masthead", "menu", "menus", "modal", "nav", "navbar", "navigation",
    "newsletter", "notice", "notices", "notification", "pager", "pagination", "paywall", "popup", "promo", "promoted", "promotion", "recommended", "related", "replies", "respond", "search",
    "share", "sharebar", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget", "widgets", "foot", "discussion", "feedback", "responses",
}
#: Of these, those that name what readers say: no ratio speaks for them.
TALK = {"comment", "comments", "disqus", "replies", "respond", "discussion", "feedback", "responses"}

#: Of these, those that name a box inside an article too.
STRONG = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adbox", "adsense", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie",
    "cookies", "disqus", "gdpr", "login", "modal", "nav", "navbar", "navigation", "newsletter", "pagination", "paywall", "popup", "promo", "promoted", "recommended",
    "related", "replies", "share", "sharebar", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "widget", "widgets", "discussion", "feedback", "responses",
}
#: Words that say no more about a box than that it is one.
NEUTRAL = {
    "area", "articles", "bar", "block", "body", "bottom", "box", "btn", "button", "buttons", "col", "column", "container", "content", "form", "group", "icons", "id", "inner",
    "item", "items", "left", "link", "links", "list", "main", "module", "news", "outer", "page", "panel", "post", "posts", "right", "row", "section", "site", "slot", "stories", "thread", "top",
    "unit", "us", "wrap", "wrapper", "reader", "readers", "user", "users", "visitor", "visitors",
}

_name = re.compile(r"[a-zA-Z][^\s/>]*").match
#: The rest of a tag: values in quotes may hold its end. Atomic, so that it never tries a shorter way.
_rest = re.compile(r"""(?>=\s*"[^"]*"|=\s*'[^']*'|[^>])*+>""").match
_names = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I).findall
_parts = re.compile(r"[a-z]+").findall
_marks = re.compile(r"[.,;:!?、。！？…]").findall


class Node:
    """An open or closed element: the number of its path, the article box it is in (a path's number, 0: none), why it weighs nothing, whether it is in a
    link, and the names of boxes that it, and no element above it, bears."""

    __slots__ = ("above", "boxed", "link", "main", "names", "path", "tag")

    def __init__(self, tag: str, above: Node | None, path: int = 0, boxed: str = "", main: int = 0, link: bool = False, names: tuple[tuple[str, int], ...] = ()):
        self.tag, self.above, self.path, self.boxed, self.main, self.link, self.names = tag, above, path, boxed, main, link, names


def names_box(token: str, inside: bool) -> bool:
    words = _parts(token)
    known = STRONG if inside else BOXES
    return any(w in known for w in words) and all(w in known or w in NEUTRAL for w in words) or words == ["header"] and not inside


class Reader:
    """One page, read tag by tag: `nodes` are its elements in page order, `out` their raw texts; (None, "") where a block begins or ends."""

    def __init__(self, page: str):
        self.page = page
        root = Node("", None)
        self.nodes, self.stack, self.out = [root], [root], []
        self.paths: dict[tuple[int, str], int] = {}
        #: Where elements of a tag are in the stack, and how many of the stack's elements bear a name.
        self.where: dict[str, list[int]] = defaultdict(list)
        self.open_names: Counter = Counter()
        #: Tags of RAW that no end follows any more; once a tag's quotes fail, no more are looked for.
        self.ended: set[str] = set()
        self.quotes = True
        self.read()

    def pop_to(self, k: int) -> None:
        for node in self.stack[k:]:
            self.where[node.tag].pop()
            for name in node.names:
                self.open_names[name] -= 1
        del self.stack[k:]

    def push(self, tag: str, attributes: str) -> None:
        above = self.stack[-1]
        main, label, own, found, kind = bool(above.main) or tag in ("article", "main"), "", "", [], None
        if tag in NEVER:
            own = tag
        if tag in KINDS and not (tag == "menu" and main) or tag == "header" and not main:
            kind = (f"<{tag}>", above.main)
        if attributes and not attributes.isspace():
            for name, value in _names(attributes):
                name, value = name.lower(), value.strip("\"'").lower()
                if name in ("class", "id"):
                    label += "." + "-".join(_parts(value))
                    found += value.split()
                elif name == "role":
                    own = "role" if not BOXES.isdisjoint(_parts(value)) or value in ("complementary", "alert") else own
                    main = main or value in ("main", "article")
                elif name == "itemprop":
                    main = main or value == "articlebody"
                else:
                    own = "hidden" if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "") else own
        path = self.paths.setdefault((above.path, tag + label), len(self.paths) + 1)
        opens, boxed, names = main and not above.main, above.boxed, ()
        if (found or kind) and tag not in ("html", "body") and not opens:
            told = dict.fromkeys([*([kind] if kind else []), *((t, above.main) for t in found if names_box(t, main))])
            names = tuple(n for n in told if not self.open_names[n])
        node = Node(tag, above, path, boxed or own, above.main or (path if main else 0), above.link or tag == "a", names)
        for name in names:
            self.open_names[name] += 1
        self.where[tag].append(len(self.stack))
        self.stack.append(node)
        self.nodes.append(node)

    def close_before(self, tag: str) -> None:
        """Ends what the start of a block ends, if it is open inside the nearest wall."""
        closes = ENDS.get(tag) or (set() if tag == "br" else {"p"})
        last = max((self.where[t][-1] for t in closes if self.where[t]), default=0)
        if not last:
            return
        wall = max((self.where[t][-1] for t in WALLS if t not in closes and self.where[t]), default=0)
        if last > wall:
            self.pop_to(last)

    def end_of(self, tag: str, at: int) -> int:
        """Where a raw element that opened before `at` ends."""
        if tag not in self.ended:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(self.page, at)
            if end:
                return end.end()
            self.ended.add(tag)
        return len(self.page) if tag in ENDLESS else at

    def read(self) -> None:
        page, out, at = self.page, self.out, 0
        while at < len(page):
            begin = page.find("<", at)
            if begin != at:
                begin = len(page) if begin < 0 else begin
                out.append((self.stack[-1], page[at:begin]))
                at = begin
                continue
            after = page[at + 1 : at + 2]
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                at = len(page) if end < 0 else end + 3
                continue
            closing = after == "/"
            name = _name(page, at + 1 + closing)
            if name is None:
                if after in ("!", "?", "/") and after:
                    end = page.find(">", at)
                    at = len(page) if end < 0 else end + 1
                else:
                    out.append((self.stack[-1], "<"))
                    at += 1
                continue
            rest = _rest(page, name.end()) if self.quotes else None
            if rest is None:
                self.quotes = False
                end = page.find(">", name.end())
                end = len(page) if end < 0 else end + 1
            else:
                end = rest.end()
            at = self.tag(name[0].lower(), closing, page[name.end() : end - 1], end)

    def tag(self, tag: str, closing: bool, attributes: str, at: int) -> int:
        """Takes a tag that ends at `at`; gives where to read on."""
        if closing:
            if self.where[tag]:
                self.pop_to(self.where[tag][-1])
            if tag not in INLINE:
                self.out.append((None, ""))
            return at
        empty = attributes.endswith("/")
        if tag in RAW:
            return at if empty else self.end_of(tag, at)
        if tag not in INLINE:
            self.out.append((None, ""))
            self.close_before(tag)
        if tag not in VOID and not empty:
            self.push(tag, attributes)
        return at


class Places:
    """Sums over the elements of a page and all below them: characters, and of these what is linked."""

    def __init__(self, nodes: list[Node], kept: list[tuple[Node, str]]):
        self.nodes, self.kept = nodes, kept
        self.at = {id(n): i for i, n in enumerate(nodes)}
        self.above = [self.at[id(n.above)] if n.above is not None else 0 for n in nodes]
        self.chars = self.summed(kept)

    def summed(self, kept) -> list[int]:
        sums = [0] * len(self.nodes)
        for n, t in kept:
            sums[self.at[id(n)]] += len(t.strip())
        for i in range(len(sums) - 1, 0, -1):  # an element stands after the one above it
            sums[self.above[i]] += sums[i]
        return sums


def named_paths(places: Places) -> tuple[list[bool], list[bool]]:
    """Which elements are below a name that says they are no content, and which below an element of KINDS or a name of TALK."""
    nodes, kept = places.nodes, places.kept
    low, firm = [False] * len(nodes), [False] * len(nodes)
    if not any(n.names for n in nodes):
        return low, firm
    in_articles = places.summed([(n, t) for n, t in kept if n.main])
    texts: dict[int, int] = defaultdict(int)
    for n, t in kept:
        for scope in {0, n.main}:
            texts[scope] += len(t.strip())
    under: dict[tuple[str, int], list[int]] = defaultdict(lambda: [0, 0])
    for i, n in enumerate(nodes):
        for name in n.names:
            under[name][0] += places.chars[i]
            under[name][1] += 0 if name[1] else in_articles[i]
    articles = sum(c for b, c in texts.items() if b)
    says = set()
    for (token, scope), (length, inside) in under.items():
        if articles and inside >= HELD * articles:
            continue
        of_kind = token[0] == "<"
        alone = token not in MAY_HOLD if of_kind else len(_parts(token)) == 1
        if of_kind and articles or length < (HELD_ALONE if alone else HELD) * texts[scope]:
            says.add((token, scope))
    for i, n in enumerate(nodes):
        own = says.intersection(n.names)
        above = places.above[i]
        low[i] = bool(own) or i > 0 and low[above]
        firm[i] = any(token[0] == "<" or not TALK.isdisjoint(_parts(token)) for token, _ in own) or i > 0 and firm[above]
    return low, firm


def text_nodes(reader: Reader) -> list[tuple[Node, str]]:
    return [(n, t) for n, t in reader.out if n is not None and not n.boxed and t and not t.isspace()]


def path_scores(reader: Reader, places: Places | None = None) -> dict[int, float]:
    """The fused ratio of every path that has text outside a box that weighs nothing."""
    places = places or Places(reader.nodes, text_nodes(reader))
    kept = places.kept
    sums: dict[int, list[float]] = defaultdict(lambda: [0, 0, 0, 0])
    boxes: dict[int, list[float]] = defaultdict(lambda: [0, 0, 0, 0])
    named, _ = named_paths(places)
    low = {n.path for n, _ in kept if named[places.at[id(n)]]}
    lowered = 0
    for n, t in kept:
        length = len(t.strip())
        lowered += length if n.path in low else 0
        for s in (sums[n.path], *([] if n.path in low else [boxes[n.main]])):
            s[0] += length
            s[1] += len(_marks(t))
            s[2] += length if n.link else 0
            s[3] += 1
    ratio = {p: (c / k) * (1 + marks / k) * (1 - linked / c) for p, (c, marks, linked, k) in sums.items()}
    plain = [n for n, _ in kept if n.path not in low]  # what is named is no neighbour
    line = [ratio[n.path] for n in plain]
    kernel = [math.exp(-(d * d) / 2) for d in range(-REACH, REACH + 1)]
    smooth: dict[int, list[float]] = defaultdict(list)
    for p in low:
        smooth[p].append(ratio[p])
    for i, n in enumerate(plain):
        near = [(kernel[d + REACH], line[i + d]) for d in range(-REACH, REACH + 1) if 0 <= i + d < len(line)]
        smooth[n.path].append(sum(w * x for w, x in near) / sum(w for w, _ in near))
    score = {p: (ratio[p] + sum(v) / len(v)) / 2 * (LOW if p in low else 1) if ratio[p] else 0.0 for p, v in smooth.items()}
    total = sum(c for c, *_ in boxes.values()) + LOW * lowered
    box_ratio = {b: (c / k) * (1 + marks / k) * max(1 - linked / c, UNLINKED) for b, (c, marks, linked, k) in boxes.items()}
    inside: dict[int, set[int]] = defaultdict(set)
    for n, _ in kept:
        if n.main and n.path not in low:
            inside[n.main].add(n.path)
    for b, paths in inside.items():
        near = [x for p in paths for x in smooth[p]]
        fused = (box_ratio[b] + sum(near) / len(near)) / 2 * (1 + BOX * (boxes[b][0] / total) ** 3)
        score.update(dict.fromkeys(paths, fused))
    return score


def content_paths(score: dict[int, float]) -> set[int]:
    """The paths whose text is content: those at or above the threshold."""
    if not score:
        return set()
    mean = sum(score.values()) / len(score)
    spread = math.sqrt(sum((x - mean) ** 2 for x in score.values()) / len(score))
    limit = min(max(THRESHOLD * spread, 1e-9), max(score.values()))
    return {p for p, x in score.items() if x >= limit > 0}


def plain_ratio(kept: list[tuple[Node, str]]) -> float:
    """Characters and marks a node, and the share that is not linked, of all these nodes."""
    c, k = sum(len(t.strip()) for _, t in kept), len(kept)
    return c / k * (1 + sum(len(_marks(t)) for _, t in kept) / k) * (1 - sum(len(t.strip()) for n, t in kept if n.link) / c)


def carried(places: Places, chosen: set[int]) -> set[int]:
    """The elements whose own text is content: those of chosen paths, and what the least box with nearly all of these carries."""
    kept, nodes, above = places.kept, places.nodes, places.above
    content = [(n, t) for n, t in kept if n.path in chosen]
    if not content:
        return set()
    sums = places.summed(content)
    # of nested boxes the innermost stands last; a sibling can't hold as much
    box = max((i for i, n in enumerate(nodes) if sums[i] >= CARRIES * sums[0] and (n.tag in HOLDERS or n.tag not in INLINE and n.tag not in FLOW)), default=0)
    low, firm = named_paths(places)
    within, flows, linked = [False] * len(nodes), [False] * len(nodes), places.summed([(n, t) for n, t in kept if n.link])
    open_box = nodes[box].tag in ("", "html", "body")
    for i, n in enumerate(nodes):
        up = above[i]
        within[i] = i == box or i > 0 and within[up]
        of_links = places.chars[i] and linked[i] > LINKS * places.chars[i] and n.tag not in INLINE and not sums[i]
        flows[i] = i == box or i > 0 and flows[up] and not of_links and (not open_box or n.tag in FLOW or n.tag in INLINE or sums[i] > 0)
    by_path: dict[int, list] = defaultdict(list)
    for n, t in kept:
        by_path[n.path].append((n, t))
    ratio, found = plain_ratio(content), set()
    alike = {p for p, held in by_path.items() if p not in chosen and plain_ratio(held) >= ALIKE * ratio}
    for n, _ in kept:
        i = places.at[id(n)]
        if n.path in chosen or within[i] and (not low[i] and flows[i] or low[i] and not firm[i] and n.path in alike):
            found.add(id(n))
    return found


def main_text(page: str) -> str:
    reader = Reader(page)
    places = Places(reader.nodes, text_nodes(reader))
    chosen = content_paths(path_scores(reader, places))
    named, _ = named_paths(places)
    unnamed = chosen - {n.path for n, _ in places.kept if named[places.at[id(n)]]}
    content = carried(places, unnamed or chosen)
    parts = [" " if n is None or not t.strip() and id(n) not in content else t if id(n) in content else "" for n, t in reader.out if n is None or not n.boxed]
    return " ".join(html.unescape("".join(parts)).split())


def extract_text(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """The id column and text string (empty if there is none)."""

    def make():
        return lambda pages: [pa.array(map(main_text, pages), pa.string())]

    pages = documents(df, id_col, html_col)
    found = map_texts(pages, make, "main string")
    return found.select(F.col("doc_id").alias(id_col), F.col("main").alias("text"))
