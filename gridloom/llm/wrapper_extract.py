"""HTML main-text extraction by wrapper induction.

Each page's DOM tree is aligned by simple tree matching with the page before it of its host in the
same partition; a host's last page of each partition is then aligned with those of other partitions,
so only these are shuffled, and a hot host is no larger a group than any. A matched pair of nodes with equal text is
constant (template), else varying (content); the counts are summed over the host by the node's path
(tags and classes from the root). The host's wrapper has a content slot, the deepest path that holds
nearly all varying text, and template paths, the paths that stay constant. Extraction reads the
whole article or main element around the slot, or the slot's subtree where there is none, without
template paths and without containers that HTML itself marks as no article: navigation, page headers and footers, asides, forms, scripts, styles, adverts, notices, comments.

Decisions are made by path, never by a text's own frequency, so a passage that many pages share stays
when it stands where content stands. Pairs of pages with one text (copies) say nothing and are left
out. A host with too little evidence, and a page without its host's slot, fall back to the page's
article, main part or body.

Nodes more than MAX_DEPTH blocks deep count with the text of their ancestor at that depth; extraction
reads them all the same. Lists of siblings whose table would exceed TABLE_CELLS are first anchored at
the nodes that occur once in both and are equal; what lies between two anchors is matched by a table
again, or, where that is still too large, in order by label. So matching takes time and memory in
proportion to the pages.

Edge cases: null or empty html gives an empty text; a url without a host groups as host ``''``;
broken markup is closed as browsers close it, but a medium (video, frame, drawing, list of options) that
is never closed ends where it begins, so that it hides no text; pages of any length, depth and width are
read whole; other columns are ignored; repeated rows repeat.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Collection, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm._common import checkpointed

#: Pages that a task holds while they wait for a partner, in characters.
HELD_CHARS = 8 << 20
#: Two pages with this share of equal text are copies and say nothing.
COPY_SHARE = 0.9
#: Wrappers of so many characters in all are broadcast.
BROADCAST_CHARS = 16 << 20
#: The share of a host's varying text that its content slot must hold.
SLOT_SHARE = 0.8
#: A path is template when matched at least so often and constant in at least this share of matches.
MIN_MATCHES, CONSTANT_SHARE = 4, 0.9
MAX_DEPTH = 40
#: The largest table that aligns two lists of siblings.
TABLE_CELLS = 40_000

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*+>", re.DOTALL)
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE) for tag in _RAW}
#: Media and lists of options: what stands inside is shown only in their place, where they are closed.
_MEDIA = frozenset("svg select object video audio canvas".split())
_MEDIA_NEXT = {tag: re.compile(rf"<(/?){tag}(?=[\s/>])", re.IGNORECASE) for tag in _MEDIA}
_FORMULA = frozenset("math mi mn mo mrow ms mspace mstyle mtext msub msup msubsup mfrac msqrt mroot mover munder munderover mtable mtr mtd mpadded mphantom menclose semantics".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()) | _FORMULA
_DROPPED = frozenset("head nav footer aside form button input dialog menu noscript template annotation".split()) | _RAW | _MEDIA
_ENDS_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: A start tag ends these open elements, up to the given containers.
_IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
# Words of class, id and role that mark no article.
_NOISE = re.compile(r"(?:ads?|advert\w*|sponsor\w*|banner|nav|navbar|navigation|menu|breadcrumbs?|sidebar|footer|masthead|topbar|cookies?|consent|popup|modal|newsletter|signup|login|comments?|disqus|widget|toolbar|pager|pagination|contentinfo|complementary)")
# Words that do so alone or beside words of layout, but may name a topic beside others ("related-work").
_TOPIC = re.compile(r"(?:promo\w*|notices?|overlay|subscribe|search|shar(?:e|ing)|social|related|recommend\w*|replies|respond|alert|dialog)")
_LAYOUT = re.compile(r"(?:\d*|area|articles?|bar|block|body|bottom|box|buttons?|center|cards?|column|container|content|feed|field|fixed|form|grid|group|head(?:er|ing)?|icons?|info|inner|input|items?|js|left|links?|list|main|media|more|networks?|news|outer|page|panel|posts?|products?|right|row|section|site|stories|story|title|tools?|top|topics?|unit|videos?|wrap(?:per)?)")
_BETWEEN = re.compile(r"[-_]+")
# First words of names that tell what an element has beside it, and last words of names of content.
_ABOUT = frozenset("with has have having no not without hide hides hidden show shows is are enable disable".split())
_CONTENT = frozenset("story article post".split())
#: Blocks of running text, which a topic's word doesn't make a notice.
_TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figure figcaption".split())
# Words of readers' comments, which vary between pages as articles do.
_COMMENTS = re.compile(r"(?:comments?|disqus|replies|respond)")


def noisy(marks: str, tag: str = "div") -> int:
    """Whether words of class, id or role mark an element as no article: 0, 1, or 2 for readers' comments (as for hidden elements).

    A name such as "with-sidebar" tells of something beside the element, and "banner-story" names a story.
    """
    found = 0
    for name in marks.lower().split():
        words = _BETWEEN.split(name)
        if len(words) > 1 and words[0] in _ABOUT:
            continue
        noise = words[-1] not in _CONTENT and any(_NOISE.fullmatch(w) for w in words)
        if not noise and tag not in _TEXTUAL:
            topics = [bool(_TOPIC.fullmatch(w)) for w in words]
            noise = any(topics) and all(t or _LAYOUT.fullmatch(w) for t, w in zip(topics, words, strict=True))
        if noise:
            found = max(found, 2 if any(_COMMENTS.fullmatch(w) for w in words) else 1)
    return found


class Node:
    __slots__ = ("tag", "label", "noise", "children", "text", "up", "depth")

    def __init__(self, tag: str, label: str, noise: int, up: Node | None):
        self.tag, self.label, self.noise, self.up = tag, label, noise, up
        self.depth: int = up.depth + (tag not in _INLINE) if up else 0  # in blocks
        self.children: list[Node] = []  # elements
        self.text: list[str | Node] = []  # texts and elements in order


class _Open:
    """The element that a parser stands in, with the number of open elements by tag."""

    def __init__(self, root: Node):
        self.here, self.count = root, defaultdict(int)

    def enter(self, node: Node) -> None:
        self.here = node
        self.count[node.tag] += 1

    def leave(self, node: Node) -> None:
        """Closes elements up to and with the node."""
        while self.here is not node:
            self.count[self.here.tag] -= 1
            self.here = self.here.up
        self.count[node.tag] -= 1
        self.here = node.up

    def close(self, tags: Collection[str], through: Callable[[Node], bool], every: bool = False) -> None:
        """Closes the nearest open element of the tags that is reached through the elements allowed; with every, all of them."""
        left = sum(self.count[t] for t in tags)
        node = self.here
        while left and node.up is not None:
            up = node.up
            if node.tag in tags:
                self.leave(node)
                left = left - 1 if every else 0
            elif not through(node):
                return
            node = up


def _element(tag: str, attributes: str, up: Node) -> Node:
    label, noise = tag, 0
    if attributes.strip(" /"):
        attrs = {k.lower(): a or b or c or "" for k, a, b, c in _ATTR.findall(attributes)}
        marks = " ".join(attrs[k] for k in ("class", "id", "role") if attrs.get(k))
        label = f"{tag}.{_DIGITS.sub('0', marks).replace('/', '|')}" if marks else tag
        hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "")
        noise = 2 if hidden else noisy(marks, tag) if marks else 0
    node = Node(tag, label, noise, up)
    up.children.append(node)
    up.text.append(node)
    return node


def _behind(tag: str, source: str, at: int) -> int:
    """Where to read on behind the start tag of an element whose content is skipped; -1 at the end of the page."""
    if tag in _MEDIA:
        m = _MEDIA_NEXT[tag].search(source, at)
        if m is None or not m[1]:
            return at  # never closed
    else:
        m = _RAW_END[tag].search(source, at)
    return source.find(">", m.end()) + 1 or -1 if m else -1


def parse(source: str) -> Node:
    """The DOM tree of a page, by one pass over its tags."""
    root = Node("#root", "#root", 0, None)
    open_, at = _Open(root), 0
    while m := _TOKEN.search(source, at):
        if m.start() > at:
            open_.here.text.append(entities.unescape(source[at : m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            open_.close((tag,), lambda node: True)
            continue
        if tag in _ENDS_P:
            open_.close(("p",), lambda node: node.tag in _INLINE)
        elif tag in _IMPLIED:
            ends, stop = _IMPLIED[tag]
            open_.close(ends, lambda node, stop=stop: node.tag not in stop, every=True)
        node = _element(tag, m[3], open_.here)
        if tag in _RAW or tag in _MEDIA:
            at = _behind(tag, source, at)
            if at < 0:
                return root
        elif tag not in _VOID and not (m[3].endswith("/") and open_.count["math"]):
            open_.enter(node)
    if at < len(source):
        open_.here.text.append(entities.unescape(source[at:]))
    return root


def dropped(node: Node) -> bool:
    """Whether HTML itself marks the element as no article."""
    if node.tag in _DROPPED or (node.noise and node.tag not in ("html", "body", "article", "main")):
        return True
    if node.tag != "header":
        return False
    up = node.up  # a header inside an article is the article's
    while up is not None:
        if up.tag in ("article", "main"):
            return False
        up = up.up
    return True


def blocks(node: Node, path: str = "", template: frozenset[str] = frozenset(), removed: list[str] | None = None) -> list[str]:
    """The texts of the blocks below a node, in page order; removed gets the paths of the template nodes left out."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if held:
            t = _SPACE.sub(" ", "".join(held)).strip()
            if t:
                out.append(t)
            held.clear()

    stack: list[tuple[Iterator, str, bool]] = [(iter(node.text), path, False)]
    while stack:
        items, at, inline = stack[-1]
        for x in items:
            if isinstance(x, str):
                held.append(x)
                continue
            if x.tag == "br":
                held.append(" ")
                continue
            if dropped(x):
                continue
            below = at
            if template and x.depth <= MAX_DEPTH and x.tag not in _INLINE:
                below = f"{at}/{x.label}"
                if below in template:
                    if removed is not None:
                        removed.append(below)
                    continue
            if x.tag not in _INLINE:
                flush()
            stack.append((iter(x.text), below, x.tag in _INLINE))
            break
        else:
            if not inline:
                flush()
            stack.pop()
    flush()
    return out


def own_text(node: Node) -> str:
    """The node's direct text with that of its inline elements, normalised; all its text at MAX_DEPTH."""
    held: list[str] = []
    stack = [iter(node.text)]
    while stack:
        for x in stack[-1]:
            if isinstance(x, str):
                held.append(x)
            elif x.tag in _INLINE or node.depth >= MAX_DEPTH:
                stack.append(iter(x.text))
                break
        else:
            stack.pop()
    return _SPACE.sub(" ", " ".join(held)).strip()


def _parts(node: Node) -> list[Node]:
    """Block-level children, which the alignment matches; inline ones belong to their parent's text."""
    out: list[Node] = []
    if node.depth >= MAX_DEPTH:
        return out
    stack = [iter(node.children)]
    while stack:
        for x in stack[-1]:
            if x.tag in _INLINE:
                stack.append(iter(x.children))
                break
            if x.tag not in _RAW and x.tag not in _MEDIA and x.tag not in _VOID:
                out.append(x)
        else:
            stack.pop()
    return out


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of pairs, ascending in the first, that ascends in the second as well."""
    tails: list[int] = []  # the least last second of a run of each length
    last: list[int] = []  # the pair it belongs to
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        n = bisect_left(tails, j)
        back.append(last[n - 1] if n else -1)
        tails[n : n + 1] = [j]
        last[n : n + 1] = [k]
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


class Aligner:
    """Simple tree matching of two trees, without recursion: a page may be deep."""

    def __init__(self) -> None:
        self.parts: dict[int, list[Node]] = {}
        self.scores: dict[tuple[int, int], int] = {}
        self.runs: dict[tuple[int, int], list[tuple[range, range]]] = {}

    def below(self, node: Node) -> list[Node]:
        got = self.parts.get(id(node))
        if got is None:
            got = self.parts[id(node)] = _parts(node)
        return got

    def spans(self, a: Node, b: Node) -> list[tuple[range, range]]:
        """Spans of two nodes' parts that are aligned with each other, in order: all of both, or where that is too large, anchors and what lies between them."""
        key = (id(a), id(b))
        if key not in self.runs:
            xs, ys = self.below(a), self.below(b)
            every = [(range(len(xs)), range(len(ys)))]
            self.runs[key] = every if len(xs) * len(ys) <= TABLE_CELLS else [s for span in self.anchored(xs, ys) for s in self.fitting(xs, ys, *span)]
        return self.runs[key]

    @staticmethod
    def anchored(xs: list[Node], ys: list[Node]) -> list[tuple[range, range]]:
        """Spans of one pair each for nodes that occur once in both lists and are equal, and the spans between them."""
        where: list[dict] = []
        for nodes in (xs, ys):
            at: dict = {}
            for i, x in enumerate(nodes):
                mark = (x.label, own_text(x))
                at[mark] = -1 if mark in at else i
            where.append(at)
        pairs = sorted((i, j) for mark, i in where[0].items() if i >= 0 and (j := where[1].get(mark, -1)) >= 0)
        out, i, j = [], 0, 0
        for x, y in [*_rising(pairs), (len(xs), len(ys))]:
            out += [(range(i, x), range(j, y)), (range(x, x + 1), range(y, y + 1))]
            i, j = x + 1, y + 1
        return [(p, q) for p, q in out[:-1] if p and q]

    @staticmethod
    def fitting(xs: list[Node], ys: list[Node], p: range, q: range) -> list[tuple[range, range]]:
        """The span itself where its table fits, else pairs of one label in order."""
        if len(p) * len(q) <= TABLE_CELLS:
            return [(p, q)]
        places: dict[str, list[int]] = defaultdict(list)
        for j in q:
            places[ys[j].label].append(j)
        out, j = [], q.start
        for i in p:
            at = places.get(xs[i].label, [])
            k = bisect_left(at, j)
            # a partner far on would leave those between without one
            if k < len(at) and at[k] - j <= 8 + abs(len(p) - len(q)):
                out.append((range(i, i + 1), range(at[k], at[k] + 1)))
                j = at[k] + 1
        return out

    def table(self, xs: list[Node], ys: list[Node]) -> list[list[int]]:
        rows = [[0] * (len(ys) + 1)]
        for x in xs:
            last, row = rows[-1], [0]
            for j, y in enumerate(ys):
                best = last[j + 1] if last[j + 1] >= row[j] else row[j]
                if x.label == y.label:
                    s = last[j] + self.score(x, y)
                    if s > best:
                        best = s
                row.append(best)
            rows.append(row)
        return rows

    def known(self, a: Node, b: Node) -> int | None:
        """The score of two nodes of one label, if it needs no further one."""
        return self.scores.get((id(a), id(b))) if self.below(a) and self.below(b) else 1

    def score(self, a: Node, b: Node) -> int:
        """The size of the largest matching of two nodes of one label that keeps order and descent."""
        stack = [(a, b)]
        while stack:
            x, y = stack[-1]
            if self.known(x, y) is not None:
                stack.pop()
                continue
            xs, ys, spans = self.below(x), self.below(y), self.spans(x, y)
            missing = [(xs[i], ys[j]) for p, q in spans for i in p for j in q if xs[i].label == ys[j].label and self.known(xs[i], ys[j]) is None]
            if missing:
                stack += missing
                continue
            self.scores[id(x), id(y)] = 1 + sum(self.table(xs[p.start : p.stop], ys[q.start : q.stop])[-1][-1] for p, q in spans)
            stack.pop()
        return self.known(a, b)

    def matched(self, a: Node, b: Node) -> list[tuple[Node, Node]]:
        """The matched parts of two nodes, in order."""
        out = []
        for p, q in self.spans(a, b):
            xs, ys = self.below(a)[p.start : p.stop], self.below(b)[q.start : q.stop]
            rows = self.table(xs, ys)
            i, j, found = len(xs), len(ys), []
            while i and j:
                if rows[i][j] == rows[i - 1][j]:
                    i -= 1
                elif rows[i][j] == rows[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    found.append((xs[i], ys[j]))
            out += reversed(found)
        return out

    def pairs(self, a: Node, b: Node) -> Iterator[tuple[str, Node, Node]]:
        """The matched nodes below two matched ones, with their path, in page order."""
        stack = [("", iter(self.matched(a, b)))]
        while stack:
            path, items = stack[-1]
            for x, y in items:
                at = f"{path}/{x.label}"
                yield at, x, y
                stack.append((at, iter(self.matched(x, y))))
                break
            else:
                stack.pop()


class Evidence:
    """(host, path) to [matches, constant matches, varying characters], summed over aligned pairs of pages."""

    def __init__(self) -> None:
        self.total: dict[tuple[str, str], list[int]] = defaultdict(lambda: [0, 0, 0])

    def align(self, host: str, a: Node, b: Node) -> None:
        found, same, chars = [], 0, 0
        for path, x, y in Aligner().pairs(a, b):
            s, t = own_text(x), own_text(y)
            if s or t:
                found.append((path, s == t, len(s) + len(t)))
                same += len(s) * 2 * (s == t)
                chars += len(s) + len(t)
        if same >= COPY_SHARE * chars:
            return  # copies
        for path, equal, n in found:
            got = self.total[host, path]
            got[0] += 1
            got[1] += equal
            got[2] += 0 if equal else n

    def flush(self, pages: dict[str, tuple[Node, str]] | None = None) -> pa.RecordBatch:
        """The sums as rows, and rows of pages that wait for a partner; clears the sums."""
        rows = [(*k, *v, None) for k, v in self.total.items()] + [(host, "", 0, 0, 0, html) for host, (_, html) in (pages or {}).items()]
        self.total.clear()
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["host", "path", "n", "same", "chars", "html"])


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Aligns each page (host, html) with the one before of its host in the partition; a host's last page waits."""
    found, held, size = Evidence(), {}, 0
    for b in batches:
        for host, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if not html:
                continue
            tree = parse(html)
            if host in held:
                found.align(host, held[host][0], tree)
                size -= len(held[host][1])
            held[host] = tree, html
            size += len(html)
            if size > HELD_CHARS or len(found.total) > 20_000:
                yield found.flush(held if size > HELD_CHARS else None)
                if size > HELD_CHARS:
                    held, size = {}, 0
    yield found.flush(held)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by host: aligns the waiting pages of a host one after the other and passes sums on."""
    found, last, tree = Evidence(), None, None
    for b in batches:
        for host, path, n, same, chars, html in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if html is None:
                got = found.total[host, path]
                got[0], got[1], got[2] = got[0] + n, got[1] + same, got[2] + chars
                continue
            new = parse(html)
            if host == last:
                found.align(host, tree, new)
            last, tree = host, new
        yield found.flush()


def _at(root: Node, slot: str) -> list[Node]:
    found = [root]
    for label in slot.split("/")[1:]:
        found = [y for x in found for y in _parts(x) if y.label == label]
    return found


def _holders(root: Node, named: bool = True) -> tuple[list[Node], Node | None]:
    """Outermost article or main elements that aren't dropped, and the body.

    Without ``named``, containers whose names mark noise are searched too, for articles whose own names don't.
    """
    held, body, stack = [], None, [root]
    while stack:
        x = stack.pop()
        if x.tag == "body" and body is None:
            body = x
        if x.tag == "article" or x.tag == "main":
            if named or not x.noise:
                held.append(x)
            continue
        if x.tag == "#root" or not dropped(x) or (not named and x.noise == 1 and x.tag not in _DROPPED):
            stack.extend(reversed(x.children))
    return held, body


def main_text(source: str | None, slot: str = "", template: frozenset[str] = frozenset(), removed: list[str] | None = None) -> str:
    """The page's main text by its host's wrapper, or by the page itself where that doesn't fit."""
    if not source:
        return ""
    root = parse(source)
    held, body = _holders(root)
    if not held:  # the page's only article may lie in a container named for something else
        held, _ = _holders(root, named=False)
    for x in held:
        if x.tag == "main" and (inner := _holders_in(x)):
            held = [y for z in held for y in (inner if z is x else [z])]
    if slot:
        # where most of the host's text varies, a name says less; readers' comments vary too
        places = [x for x in _at(root, slot) if not dropped(x) or (x.noise == 1 and x.tag not in _DROPPED)]
        # the slot must not lie beside or above the page's own article
        found = [t for x in (_around(places, held) if held else places) for t in blocks(x, _path(x), template, removed)]
        if found:
            return "\n\n".join(found)
    found = [t for x in held for t in blocks(x)]
    return "\n\n".join(found or blocks(body or root))


def _around(places: list[Node], held: list[Node]) -> list[Node]:
    """The held elements around places of the slot, each once."""
    found, whole = {}, frozenset(held)
    for x in places:
        while x is not None and x not in whole:
            x = x.up
        if x is not None:
            found[x] = None
    return list(found)


def _path(node: Node) -> str:
    labels = []
    while node.up is not None:
        if node.tag not in _INLINE:
            labels.append(node.label)
        node = node.up
    return "".join(f"/{x}" for x in reversed(labels))


def _holders_in(main: Node) -> list[Node]:
    """Articles directly below a main element, if it has exactly one: others may be lists of teasers."""
    inner = [x for x in main.children if x.tag == "article"]
    return inner if len(inner) == 1 else []


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), _HOST, 1))


def induce(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """(host, slot, template): one row per host with evidence."""
    named = pages.select(host_of(F.col(url)).alias("host"), F.col(html).cast("string").alias("html"))
    schema = "host string, path string, n bigint, same bigint, chars bigint, html string"
    waiting = named.mapInArrow(_within, schema).repartition("host").sortWithinPartitions("host")
    seen = waiting.mapInArrow(_across, schema).groupBy("host", "path").agg(F.sum("n").alias("n"), F.sum("same").alias("same"), F.sum("chars").alias("chars"))
    return wrappers(seen)


#: The outermost article or main element of a path.
_HOLDER = r"^((?:/[^/]*)*?/(?:article|main)(?:\.[^/]*)?)(?:/|$)"


def wrappers(seen: DataFrame) -> DataFrame:
    """(host, slot, template) from the hosts' summed evidence (host, path, n, same, chars); no row for a host without enough of it."""
    seen = checkpointed(seen)
    depth = lambda path: F.size(F.split(path, "/"))
    prefixes = F.expr("transform(sequence(2, size(split(path, '/'))), n -> substring_index(path, '/', n))")
    above = F.expr("transform(sequence(1, size(split(path, '/')) - 1), n -> substring_index(path, '/', n))")
    holds = seen.filter("chars > 0").select("host", "path", "chars", F.explode(prefixes).alias("p")).groupBy("host", "p").agg(F.sum("chars").alias("total"), F.max(F.col("p") == F.col("path")).alias("leaf"))
    hosts = seen.groupBy("host").agg(F.sum("chars").alias("every"), F.max("n").alias("most")).filter((F.col("every") > 0) & (F.col("most") >= MIN_MATCHES))
    # paths that hold so much lie on one line; a slot holds blocks, and a path that has text itself is a block
    most = holds.join(hosts, "host").filter((F.col("total") >= SLOT_SHARE * F.col("every")) & ~F.col("leaf"))
    slots = most.groupBy("host").agg(F.max_by("p", depth("p")).alias("slot"))
    holder = F.regexp_extract("slot", _HOLDER, 1)
    constant = (F.col("n") >= MIN_MATCHES) & (F.col("same") >= CONSTANT_SHARE * F.col("n"))
    # what varies below a constant heading is no template
    varying = seen.filter((F.col("chars") > 0) & ~constant).select("host", F.explode(above).alias("path")).distinct()
    fixed = seen.filter(constant).join(varying, ["host", "path"], "left_anti").join(slots.withColumn("whole", F.when(holder != "", holder).otherwise(F.col("slot"))), "host")
    fixed = fixed.filter(F.startswith("path", F.concat("whole", F.lit("/")))).groupBy("host").agg(F.array_sort(F.collect_list("path")).alias("template"))
    return slots.join(fixed, "host", "left").select("host", "slot", F.coalesce("template", F.array().cast("array<string>")).alias("template"))


def extract(pages: DataFrame, html: str = "html", url: str = "url", key: str = "page_id") -> DataFrame:
    """Per row: key, url, text, by_wrapper (whether its host has a wrapper), n_template (the page's nodes that its wrapper left out)."""
    known = checkpointed(induce(pages, html, url))
    size = known.agg(F.sum(F.length("host") + F.length("slot") + F.length(F.array_join("template", " ")))).first()[0] or 0
    if size <= BROADCAST_CHARS:  # beyond that, pages and wrappers are joined by a shuffle
        known = F.broadcast(known)
    kind = pages.schema[key].dataType.simpleString()
    named = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"), host_of(F.col(url)).alias("host"))
    rows = named.join(known, "host", "left").select("key", "url", "html", "slot", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slots, templates = b.column(3).to_pylist(), b.column(4).to_pylist()
            texts, counts = [], []
            for h, s, t in zip(b.column(2).to_pylist(), slots, templates, strict=True):
                removed: list[str] = []
                texts.append(main_text(h, s or "", frozenset(t or ()), removed))
                counts.append(len(removed))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([s is not None for s in slots]), pa.array(counts, pa.int64())], ["key", "url", "text", "by_wrapper", "n_template"])

    return rows.mapInArrow(run, f"key {kind}, url string, text string, by_wrapper boolean, n_template bigint").withColumnRenamed("key", key)
