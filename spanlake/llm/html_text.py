"""Main text of web pages by wrapper induction.

Per host and layout every distinct page is aligned with one of them, the reference, by simple tree matching: the largest
common top-down mapping of two DOM trees that keeps the order of children. The reference has the layout's most frequent structure
(runs of equal siblings count once), so a box that most pages have is in it. A node that most pages have and at which one text
stands on at least ``TEMPLATE_SHARE`` of them is template with that text, whatever the reference itself says there; a few odd pages
change nothing for the others. What is no template is varying text. The content slot is the lowest common ancestor of the varying
text. A page is read from the layout's slot, widened to all varying text of the page, without what is boilerplate by its element or
role, and without template nodes that are no prose. A page without a wrapper is read from the lowest common ancestor of its text.

Class and id names are evidence only. A name counts as boilerplate if all its words are such words or words for places and
boxes, and no other name of the element is one for content; an element that holds most of a page's words is content whatever
its name, and a page of which nothing would be left is read without regard to names.

A layout is the names of the sections at the page's first branching. Pages that are alone in their layout form one more
layout of their host. Alignment works on skeletons (names, words and text hashes), whole whatever their size, and sums
its counts per task, so no task sees all pages of a host; of the texts at a node a task keeps the ``TEXTS`` most frequent ones
(Misra-Gries counts, exact below that number, else too low by at most n / TEXTS). Sizes of mappings depend on shapes alone and are kept
per pair of shapes for all pages of a reference; equal subtrees at both ends of two lists of children are matched without search.

Null html is empty. Pages without a host form one group. Repeated rows are read alike and weigh once in a wrapper; other columns
are not read, whatever their names, and an empty table gives an empty result.
"""

from __future__ import annotations

import html
import json
import re
import struct
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import written
from spanlake.llm.url_filter import host_of

#: Bytes of references or wrappers up to which they are broadcast; beyond it they are joined by shuffle.
BROADCAST_BYTES = 64_000_000
#: Least share of the pages with a node that say the same there, for it to be template.
TEMPLATE_SHARE = 0.985
#: Different texts of a node that a task keeps counts of.
TEXTS = 256
#: Shapes and pairs of shapes whose sizes are kept for one reference.
KEPT_SHAPES = 200_000
#: Groups whose counts a task holds before it hands them on, and cells of an alignment table before it is divided.
TASK_GROUPS = 1_000
TABLE_CELLS = 20_000_000
#: Cells up to which plain lists are faster than arrays.
SMALL_CELLS = 1_000

_TOKEN = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\s*+(?:=\s*+("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe svg math xmp".split())
_DROPPED = frozenset("script style noscript template iframe svg math head nav footer aside form button select option textarea input label menu dialog object canvas audio video map".split())
_BLOCK = frozenset("""address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html
li main nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li td dd dt figcaption".split())
_CLOSES_P = _BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "body", "html"}
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("ul ol dl table div article section main body html nav aside footer header form td th li blockquote".split())
# Words of class and id names.
_BOILERPLATE = re.compile(r"""nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|footer|header|masthead|ads?|adv|advert\w*|banner|promo\w*|sponsor\w*|cookies?|
notices?|alert|consent|gdpr|popup|modal|overlay|newsletter|subscribe|share|sharing|social|related|recommend\w*|comments?|disqus|respond|replies|widget|login|signup|search|pagination|pager|toc""", re.X | re.I)
_PLACE = re.compile(r"""site|page|main|top|bottom|left|right|upper|lower|center|middle|first|last|inner|outer|global|primary|secondary|mobile|desktop|col|column|row|grid|bar|box|
block|area|section|container|wrapper|wrap|holder|panel|group|list|items?|links?|buttons?|btns?|icons?|form|input|field|slot|unit|zone|space|title|label|text|toggle|strip|policy|
posts?|articles?|stories|media|thread|count|\d+|\w""", re.X | re.I)
_CONTENT = re.compile(r"(?:post|article|entry|story|page|main|text|body)?[\s_-]*(?:content|article|entry|story|text|body)", re.I)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SECTIONS = frozenset("html body center div section article main header table".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())


class Node:
    """An element. Its kids do not change once text, words or kept, which are found when first asked for, are known."""
    __slots__ = ("tag", "mark", "name", "noise", "named", "kids", "own", "text", "words", "kept")

    def __init__(self, tag: str, mark: str = "", noise: bool = False, own: int | None = None, named: bool = False):
        self.tag, self.mark, self.noise, self.named, self.kids, self.own = tag, mark, noise, named, [], own
        self.name = f"{tag}.{mark}" if mark else tag
        self.text = self.words = self.kept = None


def _made(tag: str, attrs: str) -> Node:
    if not attrs or attrs.isspace():
        return Node(tag, "", tag in _DROPPED)
    mark, noise, named = (_described if len(attrs) <= 200 else _described.__wrapped__)(tag, attrs)
    return Node(tag, mark, noise, None, named)


@lru_cache(maxsize=16_384)
def _described(tag: str, attrs: str) -> tuple[str, bool, bool]:
    """Class names, and whether the element is boilerplate by itself or by its names."""
    got = {k.lower(): (v or "").strip("\"'") for k, v in _ATTR.findall(attrs)}
    mark = " ".join(sorted(got.get("class", "").split()))
    hidden = "hidden" in got or got.get("aria-hidden") == "true" or "display:none" in got.get("style", "").replace(" ", "")
    noise = tag in _DROPPED or hidden or got.get("role", "") in _ROLES
    return mark, noise, not noise and tag not in ("html", "body", "article", "main") and _boilerplate_name([*mark.split(), *got.get("id", "").split()])


def _boilerplate_name(names: list[str]) -> bool:
    found = False
    for name in names:
        if _CONTENT.fullmatch(name):
            return False
        words = [w for w in re.split(r"[\s_-]+|(?<=[a-z])(?=[A-Z])", name) if w]
        kinds = [bool(_BOILERPLATE.fullmatch(w)) for w in words]
        found |= any(kinds) and all(k or _PLACE.fullmatch(w) for k, w in zip(kinds, words))
    return found


def _weighed(root: Node) -> Node:
    """Names that stand for boilerplate decide only where they leave most of what surrounds them: elements with more than half of
    the page's words lose theirs, and if nothing else is left all do."""
    order, todo, named = [], [root], []
    while todo:
        x = todo.pop()
        if x.named:
            named.append(x)
        below = [k for k in _elements(x) if not _is_noise(k, True, names=False)]
        order.append((x, below))
        todo += below
    if not named:
        return root
    words: dict[int, int] = {}
    for x, below in reversed(order):
        words[id(x)] = _own_words(x) + sum([words[id(k)] for k in below])
    for x in named:
        x.named = 2 * words[id(x)] <= words[id(root)]
    left, todo = 0, [root]
    while todo and not left:
        x = todo.pop()
        left += bool(_own_text(x))
        todo.extend(k for k in _elements(x) if not _is_noise(k, True))
    if not left:
        for x in named:
            x.named = False
    return root


def parse(source: str) -> Node:
    """DOM tree of a page; children are nodes and strings with their character references decoded."""
    root = Node("#root")
    stack, at, n, named = [root], 0, len(source), False
    search, unescape = _TOKEN.search, html.unescape
    while at < n:
        m = search(source, at)
        if not m:
            stack[-1].kids.append(unescape(source[at:]))
            break
        start, end = m.span()
        if start > at:
            stack[-1].kids.append(unescape(source[at:start]))
        at = end
        slash, tag, attrs = m.group(1, 2, 3)
        if tag is None:
            slash, tag, attrs = m.group(4, 5, 6)
            if tag is None:
                if source.startswith("<![CDATA[", start):
                    stack[-1].kids.append(m[0][9:].removesuffix("]]>"))
                continue
        tag = tag.lower()
        if slash:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in _CLOSES_P and stack[-1].tag not in _SCOPE:
            _close(stack, {"p"})
        if tag in _SAME:
            _close(stack, _SAME[tag])
        node = _made(tag, attrs)
        named |= node.named
        stack[-1].kids.append(node)
        if tag in _RAW and not attrs.endswith("/"):
            end = _end(tag).search(source, at)
            at = end.end() if end else n
        elif tag not in _VOID and not attrs.endswith("/"):
            stack.append(node)
    return _weighed(root) if named else root


@lru_cache(maxsize=len(_RAW))
def _end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\s*>", re.I)


def _close(stack: list[Node], tags: set[str]) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in tags:
            del stack[k:]
            return
        if stack[k].tag in _SCOPE:
            return


def _is_noise(node: Node, inside: bool, names: bool = True) -> bool:
    """A header of the content itself, with a heading in it, is content."""
    if node.tag == "header":
        return not (inside and any(k.tag in _HEADINGS for k in _elements(node)))
    return node.noise or names and node.named


def _kept(node: Node) -> list[Node]:
    """The elements right below a node that are no boilerplate."""
    if node.kept is None:
        node.kept = [k for k in _elements(node) if not _is_noise(k, True)]
    return node.kept


@lru_cache(maxsize=16_384)
def _step(path: int, name: str) -> int:
    """Hash of a path with one more name; the root's is 0."""
    return xxhash.xxh64_intdigest(name.encode("utf-8", "replace"), path)


def blocks(node: Node, skip=lambda node: False) -> list[str]:
    """Texts of the blocks below a node in page order, white space collapsed, without boilerplate."""
    out: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            out.append(text)

    todo: list = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            parts.append(x)
        elif x is None:
            flush()
        elif x is node or not (_is_noise(x, True) or skip(x)):
            if x.tag == "br":
                parts.append(" ")
                continue
            block = x.tag in _BLOCK or x is node
            if block:
                flush()
                todo.append(None)
            todo.extend(reversed(x.kids))
    flush()
    return out


def _own_text(node: Node) -> str:
    if node.text is None:
        words = " ".join([k for k in node.kids if isinstance(k, str)]).split()
        node.text, node.words = " ".join(words), len(words)
    return node.text


def _own_words(node: Node) -> int:
    """How many words a node's own text has."""
    _own_text(node)
    return node.words


def _own_hash(node: Node) -> int:
    """Hash of a node's own text, 0 if it has none."""
    if node.own is None:
        text = _own_text(node)
        node.own = xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) | 1 if text else 0
    return node.own


def _elements(node: Node) -> list[Node]:
    return [k for k in node.kids if isinstance(k, Node)]


def content(root: Node, varying: dict[int, int], slots: set[int] = frozenset()) -> Node | None:
    """Lowest common ancestor of the words in varying (by id(node), without links and boilerplate), not below a slot,
    prose, or an article or main element; the one article or main among siblings is taken before them."""
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        below = [k for k in _kept(x) if k.tag != "a"]
        order.append((x, below))
        todo += below
    weights: dict[int, int] = {}
    for x, below in reversed(order):
        weights[id(x)] = varying.get(id(x), 0) + sum([weights[id(k)] for k in below])
    x = root
    if not weights[id(root)]:
        return None
    while x.tag not in ("article", "main") and id(x) not in slots:
        kids = [k for k in _kept(x) if weights.get(id(k), 0)]
        named = [k for k in kids if k.tag in ("article", "main")]
        if len(named) == 1:
            x = named[0]
        elif len(kids) == 1 and not varying.get(id(x), 0) and kids[0].tag in _BLOCK and kids[0].tag not in _PROSE:
            x = kids[0]
        else:
            break
    return x


def layout(root: Node) -> int:
    """Hash of the names of the sections down to the first node that has other than one section, or content itself."""
    x, out = root, 0
    while True:
        out = _step(out, x.name)
        kids = [k for k in _kept(x) if k.tag in _SECTIONS]
        if len(kids) != 1 or x.tag in ("article", "main") or _own_text(x) or any(k.tag in _PROSE for k in _elements(x)):
            break
        x = kids[0]
    if x.tag not in ("article", "main"):
        for name in sorted({k.name for k in kids}):
            out = _step(out, name)
    return out - (1 << 64) if out >> 63 else out


class Shapes:
    """Numbers for the shapes of subtrees (names alone) and for equal subtrees (names and texts), and the sizes of the
    largest mappings between shapes."""

    def __init__(self):
        self.numbers: dict[tuple, int] = {}
        self.names: dict[int, str] = {}
        self.kids: dict[int, tuple[int, ...]] = {}
        self.nodes: dict[int, int] = {}
        self.sizes: dict[tuple[int, int], int] = {}

    def of(self, root: Node) -> dict[int, tuple[int, int]]:
        """(shape, subtree) of every node, by id(node)."""
        order, todo, out = [], [root], {}
        numbers = self.numbers
        while todo:
            x = todo.pop()
            below = _elements(x)
            order.append((x, below))
            todo += below
        for x, below in reversed(order):
            found = [out[id(k)] for k in below]
            shapes, name = tuple([s for s, _ in found]), x.name
            shape = numbers.setdefault(("s", name, shapes), len(numbers))
            if shape not in self.kids:
                self.names[shape], self.kids[shape] = name, shapes
                self.nodes[shape] = 1 + sum([self.nodes[s] for s in shapes])
            out[id(x)] = shape, numbers.setdefault(("t", name, _own_hash(x), tuple([t for _, t in found])), len(numbers))
        return out

    def table(self, left: Sequence[int], right: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sizes between the distinct shapes of two lists, and the rows and columns of their items; all must be known."""
        a, rows = np.unique(np.array(left, np.int64), return_inverse=True)
        b, cols = np.unique(np.array(right, np.int64), return_inverse=True)
        return np.array([[self._known(x, y) for y in b.tolist()] for x in a.tolist()], np.int64).reshape(len(a), len(b)), rows, cols

    def _known(self, a: int, b: int) -> int | None:
        return 0 if self.names[a] != self.names[b] else self.nodes[a] if a == b else self.sizes.get((a, b))

    def weights(self, left: Sequence[int], right: Sequence[int]) -> dict[int, list[int]]:
        """By each distinct shape of left its sizes with the items of right; all must be known."""
        distinct = set(right)
        known = {p: {q: self._known(p, q) for q in distinct} for p in set(left)}
        return {p: [sizes[q] for q in right] for p, sizes in known.items()}

    def size(self, a: int, b: int) -> int:
        """Nodes in the largest mapping between two shapes that has the roots matched."""
        todo = [(a, b)]
        while todo:
            x, y = todo[-1]
            if self._known(x, y) is not None:
                todo.pop()
                continue
            left, right = self.kids[x], self.kids[y]
            lo, hi = _same_ends(left, right)
            same = sum([self.nodes[s] for s in left[:lo]]) + sum([self.nodes[s] for s in left[len(left) - hi:]])
            left, right = left[lo:len(left) - hi], right[lo:len(right) - hi]
            names: dict[str, list[int]] = {}
            for s in dict.fromkeys(right):
                names.setdefault(self.names[s], []).append(s)
            missing = [(p, q) for p in dict.fromkeys(left) for q in names.get(self.names[p], ()) if self._known(p, q) is None]
            if missing:
                todo += missing
                continue
            if not left or not right:
                most = 0
            elif len(left) * len(right) <= SMALL_CELLS:
                weights = self.weights(left, right)
                row = [0] * (len(right) + 1)
                for p in left:
                    row = _next_small(row, weights[p])
                most = row[-1]
            else:
                table, rows, cols = self.table(left, right)
                row = np.zeros(len(right) + 1, np.int64)
                for r in rows:
                    row = _next_row(row, table[r][cols])
                most = int(row[-1])
            self.sizes[x, y] = 1 + same + most
            todo.pop()
        return self._known(a, b)


def _same_ends(left: Sequence[int], right: Sequence[int]) -> tuple[int, int]:
    """How many items agree from the front, and of the rest from the back."""
    n = min(len(left), len(right))
    lo = next((i for i in range(n) if left[i] != right[i]), n)
    return lo, next((i for i in range(n - lo) if left[-1 - i] != right[-1 - i]), n - lo)


def _next_small(row: list[int], weights: list[int]) -> list[int]:
    """As _next_row, by lists."""
    best, before = row[0], row[0]
    out = [best]
    for now, w in zip(row[1:], weights):
        before += w
        if now > best:
            best = now
        if before > best:
            best = before
        out.append(best)
        before = now
    return out


def _next_row(row: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = np.maximum(row[1:], row[:-1] + weights)
    return np.concatenate([row[:1], np.maximum.accumulate(out)])


def _paired(left: np.ndarray, right: np.ndarray, weight) -> list[tuple[int, int]]:
    """Pairs of the heaviest order-keeping matching; weight(i, items) are the weights of an item of left with items of
    right. Halved, in linear memory, where the table would have more than TABLE_CELLS cells."""
    out: list[tuple[int, int]] = []
    todo = [(left, right)]
    while todo:
        rows, cols = todo.pop()
        if not len(rows) or not len(cols):
            continue
        if len(rows) > 1 and (len(rows) + 1) * (len(cols) + 1) > TABLE_CELLS:
            half = len(rows) // 2
            before = after = np.zeros(len(cols) + 1, np.int64)
            for i in rows[:half]:
                before = _next_row(before, weight(i, cols))
            for i in rows[half:][::-1]:
                after = _next_row(after, weight(i, cols)[::-1])
            cut = int(np.argmax(before + after[::-1]))
            todo += [(rows[:half], cols[:cut]), (rows[half:], cols[cut:])]
            continue
        table = np.zeros((len(rows) + 1, len(cols) + 1), np.int64)
        for k, i in enumerate(rows):
            table[k + 1] = _next_row(table[k], weight(i, cols))
        out += ((int(rows[i]), int(cols[j])) for i, j in _traced(table))
    return out


def _traced(table: np.ndarray | list[list[int]]) -> list[tuple[int, int]]:
    """The pairs that lead to the last cell of a table of best sums."""
    out = []
    i, j = len(table) - 1, len(table[0]) - 1
    while i and j:
        best = table[i][j]
        if best == table[i - 1][j]:
            i -= 1
        elif best == table[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out


def match(a: Node, b: Node, size: dict[tuple[int, int], int]) -> int:
    """Simple tree matching: nodes in the largest mapping that has the roots matched and keeps the children's order."""
    shapes = Shapes()
    size[id(a), id(b)] = n = shapes.size(shapes.of(a)[id(a)][0], shapes.of(b)[id(b)][0])
    return n


def aligned(a: Node, b: Node, shapes: Shapes | None = None, of_a: dict[int, tuple[int, int]] | None = None) -> list[tuple[Node, Node]]:
    """The matched pairs of nodes; of mappings of one size one that pairs equal subtrees. Shapes that already number a are
    used with its numbers."""
    if a.name != b.name:
        return []
    shapes = shapes or Shapes()
    of = (of_a or shapes.of(a)) | shapes.of(b)
    out, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        out.append((x, y))
        left, right = _elements(x), _elements(y)
        if not left or not right:
            continue
        (sa, ta), (sb, tb) = (zip(*[of[id(k)] for k in kids]) for kids in (left, right))
        lo, hi = _same_ends(ta, tb)
        todo += zip(left[:lo] + left[len(left) - hi:], right[:lo] + right[len(right) - hi:])
        left, right = left[lo:len(left) - hi], right[lo:len(right) - hi]
        if not left or not right:
            continue
        sa, ta, sb, tb = sa[lo:lo + len(left)], ta[lo:lo + len(left)], sb[lo:lo + len(right)], tb[lo:lo + len(right)]
        for p in set(sa):
            for q in set(sb):
                shapes.size(p, q)
        if len(left) * len(right) <= min(SMALL_CELLS, TABLE_CELLS):
            weights = {p: [2 * n for n in sizes] for p, sizes in shapes.weights(sa, sb).items()}
            equal = set(ta).intersection(tb)
            table = [[0] * (len(right) + 1)]
            for p, t in zip(sa, ta):
                table.append(_next_small(table[-1], [n + (t == u) for n, u in zip(weights[p], tb)] if t in equal else weights[p]))
            found = _traced(table)
        else:
            known, at, to = shapes.table(sa, sb)
            texts = np.array(tb, np.int64)
            found = _paired(np.arange(len(left)), np.arange(len(right)), lambda i, js: 2 * known[at[i]][to[js]] + (ta[i] == texts[js]))
        todo += [(left[i], right[j]) for i, j in found if left[i].name == right[j].name]
    return out


def skeleton(root: Node) -> bytes:
    """What alignment needs of a page: names, numbers of children, words and text hashes, without boilerplate."""
    names, numbers, owns, todo = [], [], [], [root]
    while todo:
        x = todo.pop()
        kids = _kept(x)
        names.append(x.name)
        numbers += len(kids), _own_words(x)
        owns.append(_own_hash(x))
        todo += reversed(kids)
    n = len(names)
    return n.to_bytes(4, "little") + struct.pack(f"<{2 * n}I", *numbers) + struct.pack(f"<{n}Q", *owns) + "\n".join(names).encode("utf-8", "replace")


def from_skeleton(raw: bytes) -> tuple[list[Node], np.ndarray]:
    """The nodes in page order, the root first, and their words."""
    n = int.from_bytes(raw[:4], "little")
    numbers, owns = np.frombuffer(raw, "<u4", 2 * n, 4).reshape(n, 2), np.frombuffer(raw, "<u8", n, 4 + 8 * n).tolist()
    nodes: list[Node] = []
    open_: list[list] = []
    for name, kids, own in zip(raw[4 + 16 * n:].decode().split("\n"), numbers[:, 0].tolist(), owns):
        tag, _, mark = name.partition(".")
        node = Node(tag, mark, False, own)
        if open_:
            last = open_[-1]
            last[0].append(node)
            last[1] -= 1
            if not last[1]:
                open_.pop()
        nodes.append(node)
        if kids:
            open_.append([node.kids, kids])
    return nodes, numbers[:, 1]


class Reference:
    """A page that others are aligned with; what was found about shapes serves for all of them."""

    def __init__(self, raw: bytes):
        self.nodes, self.words = from_skeleton(raw)
        self.at = {id(x): i for i, x in enumerate(self.nodes)}
        self._renew()

    def _renew(self) -> None:
        self.shapes = Shapes()
        self.of = self.shapes.of(self.nodes[0])

    def owns(self, page: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The nodes that a page has, and the hashes of their texts there."""
        if len(self.shapes.numbers) + len(self.shapes.sizes) > KEPT_SHAPES:
            self._renew()
        pairs = aligned(self.nodes[0], from_skeleton(page)[0][0], self.shapes, self.of)
        return np.array([self.at[id(x)] for x, _ in pairs], np.int64), np.array([y.own for _, y in pairs], np.uint64)


_reference = lru_cache(maxsize=64)(Reference)


def structure(root: Node) -> int:
    """Hash of a page's names, runs of equal siblings as one."""
    order, todo, found = [], [root], {}
    while todo:
        x = todo.pop()
        order.append(x)
        todo += _kept(x)
    for x in reversed(order):
        runs, last = [], None
        for k in _kept(x):
            if (h := found[id(k)]) != last:
                runs.append(last := h)
        found[id(x)] = _structure(x.name, tuple(runs)) if len(runs) <= 16 else _structure.__wrapped__(x.name, runs)
    return found[id(root)] >> 1


@lru_cache(maxsize=16_384)
def _structure(name: str, runs: Sequence[int]) -> int:
    return xxhash.xxh64_intdigest(struct.pack(f"<{len(runs)}Q", *runs), xxhash.xxh64_intdigest(name.encode("utf-8", "replace")))


def induced(reference: bytes, pages: int, has: np.ndarray, texts: dict[int, tuple[int, int]]) -> dict:
    """Wrapper of a layout from the counts over its pages: constant (pairs of the hashes of path and text) and slot (hash of
    its path). has: pages with each node; texts: per node its most frequent text and the pages that say it."""
    nodes, words = from_skeleton(reference)
    paths = {id(nodes[0]): 0}
    for x in nodes:
        for k in x.kids:
            paths[id(k)] = _step(paths[id(x)], k.name)
    said = {i: own for i, (own, n) in texts.items() if own and has[i] > 1 and 2 * has[i] > pages and n >= TEMPLATE_SHARE * has[i]}
    slot = content(nodes[0], {id(x): int(n) for i, (x, n) in enumerate(zip(nodes, words)) if n and i not in said})
    if slot is None:
        return {}
    return {"slot": paths[id(slot)], "constant": sorted({(paths[id(nodes[i])], own) for i, own in said.items()})}


def extract(source: str | None, wrapper: dict) -> str:
    """Blocks of the page's main text, joined by line feeds."""
    return _extracted(parse(source), wrapper) if source else ""


def _extracted(root: Node, wrapper: dict) -> str:
    constant = wrapper.get("constant") or ()
    words: dict[int, int] = {}
    fixed: set[int] = set()
    slots: set[int] = set()
    todo = [(root, 0)]
    while todo:
        x, path = todo.pop()
        if n := _own_words(x):
            words[id(x)] = n
            if constant and (path, _own_hash(x)) in constant:
                fixed.add(id(x))
        if path == wrapper.get("slot"):
            slots.add(id(x))
        todo += [(k, _step(path, k.name) if wrapper else 0) for k in _kept(x)]
    slot = content(root, {i: n for i, n in words.items() if i not in fixed}, slots)
    if slot is None:    # nothing varies, or no text outside links: the page as it is
        return "\n".join(blocks(content(root, words) or root))
    return "\n".join(blocks(slot, lambda x: id(x) in fixed and x.tag not in _PROSE))


@lru_cache(maxsize=4096)
def _loaded(wrapper: str | None) -> dict:
    if not wrapper:
        return {}
    made = json.loads(wrapper)
    return {"slot": made["slot"], "constant": {tuple(x) for x in made["constant"]}} if made else {}


def _small(table: DataFrame, col: str) -> DataFrame:
    """The table, broadcast if its column is small."""
    return F.broadcast(table) if (table.agg(F.sum(F.octet_length(col))).first()[0] or 0) <= BROADCAST_BYTES else table


def _skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[tuple[str, int]] = set()
    for batch in batches:
        rows = []
        for host, source in zip(batch.column("host").to_pylist(), batch.column("html")):
            root = parse(source.as_py())
            tree = skeleton(root)
            h = xxhash.xxh64_intdigest(tree) >> 1
            if (host, h) not in seen:      # a copy within the task
                seen.add((host, h))
                rows.append((host, layout(root), structure(root), h, tree))
        if len(seen) > 1_000_000:
            seen.clear()
        cols = list(zip(*rows)) if rows else [()] * 5
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["host", "layout", "kind", "h", "tree"])


class _Sums:
    """Counts of one layout in one task: pages with each node, and of each node with text its most frequent texts."""

    def __init__(self):
        self.has: Counter = Counter()
        self.texts: dict[int, Counter] = {}

    def add(self, nodes: np.ndarray, owns: np.ndarray) -> None:
        for i, own in zip(nodes.tolist(), owns.tolist()):
            self.has[i] += 1
            if own:
                seen = self.texts.setdefault(i, Counter())
                seen[own] += 1
                if len(seen) > TEXTS:
                    self.texts[i] = Counter({k: v - 1 for k, v in seen.items() if v > 1})

    def rows(self) -> Iterator[tuple[int, int, int]]:
        yield from ((i, 0, n) for i, n in self.has.items())
        yield from ((i, own, n) for i, seen in self.texts.items() for own, n in seen.items())


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over the pages of a task: (host, group, node, text or 0 for any, pages)."""
    sums: dict[tuple[str, int], _Sums] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for (host, group), found in sums.items():
            node, own, n = (np.array(c, t) for c, t in zip(zip(*found.rows()), (np.int64, np.uint64, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([host] * len(node), pa.string()), pa.array([group] * len(node), pa.int64()), pa.array(node), pa.array(own.view(np.int64)), pa.array(n)],
                                             ["host", "grp", "node", "own", "n"])
        sums.clear()

    for batch in batches:
        for host, group, tree, reference in zip(*(batch.column(k) for k in range(4))):
            sums.setdefault((host.as_py(), group.as_py()), _Sums()).add(*_reference(reference.as_py()).owns(tree.as_py()))
        if len(sums) > TASK_GROUPS:
            yield from rows()
    yield from rows()


def _induced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = []
        for tree, pages, nodes in zip(batch.column("reference").to_pylist(), batch.column("pages").to_pylist(), batch.column("nodes").to_pylist()):
            has = np.zeros(int.from_bytes(tree[:4], "little"), np.int64)
            has[[x["node"] for x in nodes]] = [x["has"] for x in nodes]
            texts = {x["node"]: (x["top"]["own"] % 2**64, x["top"]["n"]) for x in nodes if x["top"] is not None}
            made.append(json.dumps(induced(tree, pages, has, texts)))
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("grp"), pa.array(made, pa.string())], ["host", "grp", "wrapper"])


def wrappers(pages: DataFrame) -> DataFrame:
    """host, layout, wrapper (JSON) of every layout of a host that has two different pages."""
    trees = pages.where("html is not null").select("host", "html").mapInArrow(_skeletons, "host string, layout long, kind long, h long, tree binary")
    distinct = written(trees.groupBy("host", "layout", "h").agg(F.first("kind").alias("kind"), F.first("tree").alias("tree")), "html-skeletons")
    kinds = distinct.groupBy("host", "layout", "kind").agg(F.count("*").alias("n"), F.min_by("tree", "h").alias("tree"))
    layouts = written(kinds.groupBy("host", "layout").agg(F.sum("n").alias("pages"), F.min_by("tree", F.struct(-F.col("n"), "kind")).alias("reference")), "html-layouts")
    many, lone = layouts.where("pages > 1"), layouts.where("pages = 1")
    # Pages alone in their layout are one group of their host, with number 0.
    rest = lone.groupBy("host").agg(F.count("*").alias("pages"), F.min_by("reference", "layout").alias("reference")).where("pages > 1")
    references = written(many.select("host", F.col("layout").alias("grp"), "pages", "reference").union(rest.select("host", F.lit(0).cast("long"), "pages", "reference")), "html-references")
    members = distinct.select("host", F.col("layout").alias("grp"), "tree").union(lone.select("host", F.lit(0).cast("long"), F.col("reference")))
    known = references.select(F.col("host").alias("r_host"), F.col("grp").alias("r_grp"), "reference")
    pairs = members.join(_small(known, "reference"), (F.col("host") == F.col("r_host")) & (F.col("grp") == F.col("r_grp")))
    counts = pairs.select("host", "grp", "tree", "reference").mapInArrow(_counted, "host string, grp long, node long, own long, n long")
    sums = counts.groupBy("host", "grp", "node", "own").agg(F.sum("n").alias("n"))
    text = F.when(F.col("own") != 0, F.struct("n", "own"))
    per_node = sums.groupBy("host", "grp", "node").agg(F.max(F.when(F.col("own") == 0, F.col("n"))).alias("has"), F.max(text).alias("top"))
    per_group = per_node.groupBy("host", "grp").agg(F.collect_list(F.struct("node", "has", "top")).alias("nodes"))     # the nodes of one page
    made = references.join(per_group, ["host", "grp"]).select("host", "grp", "pages", "reference", "nodes").mapInArrow(_induced, "host string, grp long, wrapper string")
    of = layouts.select("host", "layout", F.when(F.col("pages") > 1, F.col("layout")).otherwise(0).alias("grp"))
    return of.join(written(made, "html-induced"), ["host", "grp"]).select("host", "layout", "wrapper")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every page.

    Wrappers of up to ``BROADCAST_BYTES`` go to the tasks, which then parse each page once more and look its layout up; beyond it the
    layouts are found first and wrappers joined by them.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("host", F.coalesce(host_of(F.col("url")), F.lit("")))
    learned = written(wrappers(rows), "html-wrappers")
    size = learned.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host") + 200)).first()[0] or 0
    schema = "page_id long, url string, text string"
    if size <= BROADCAST_BYTES:
        known = rows.sparkSession.sparkContext.broadcast({(r.host, r.layout): r.wrapper for r in learned.toLocalIterator()})

        def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = []
                for host, source in zip(batch.column("host").to_pylist(), batch.column("html")):
                    root = parse(source.as_py() or "")
                    texts.append(_extracted(root, _loaded(known.value.get((host, layout(root))))))
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])
        return rows.mapInArrow(looked_up, schema)

    def laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [layout(parse(h.as_py() or "")) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], [*batch.schema.names, "layout"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h.as_py(), _loaded(w.as_py())) for h, w in zip(batch.column("html"), batch.column("wrapper"))]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    rows = rows.mapInArrow(laid_out, "page_id long, url string, html string, host string, layout long")
    learned = learned.select(F.col("host").alias("w_host"), F.col("layout").alias("w_layout"), "wrapper")
    joined = rows.join(learned.hint("merge"), (F.col("host") == F.col("w_host")) & (F.col("layout") == F.col("w_layout")), "left")
    return joined.select("page_id", "url", "html", "wrapper").mapInArrow(run, schema)
