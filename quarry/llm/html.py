"""Main text of web pages by wrapper induction.

The DOM trees of all pages of a host are aligned with the tree of its most frequent form by simple tree matching. Over
all pages a matched node is constant (the same text everywhere: template) or a varying slot. The content slot of the host
is the smallest container that holds all varying text outside of page furniture, or the ``article`` or ``main`` around
it. A page's article is what its node at that slot holds, without furniture. With ``cut_template`` the template inside
the slot goes too: nodes whose own text is the same on TEMPLATE_SHARE of the host's pages, on no page another, and on
TEMPLATE_PAGES different pages or more; that is no default, since headings and lists that all articles share would go. A
page that does not match (or a host of one page) falls back on all its ``article`` and ``main`` elements, then on its body.

The wrapper covers all pages of a host; its statistics are pre-aggregated in each task, so a host with a third of all
pages is no hot group. Wrappers are broadcast only if a count shows that they are few; otherwise they are joined.

Trees are walked with stacks of their own, so depth is no limit. Equal subtrees are one form, and forms are matched once.
The matching is the best one at any size. Of two lists of children with over MOST_KINDS pairs of different forms, all
pairs of one depth are matched together, along a trie of the children lists; of tables of over MOST_CELLS cells only some
rows are kept and the others made again. Both give the same sums and the same pairing as the plain way.

Defined results: null or empty html, or html without text, gives an empty text and is never a host's seed; tags that are
not closed end with their parent, or at the next block; a null or strange url has the empty host; repeated pages are
each extracted and count as one page for the template; an empty table gives an empty result; columns of the input called
like a new one are replaced.
"""

from __future__ import annotations

import html as entities
import math
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quarry.llm.arrow import bounded, chunks, text_list
from quarry.llm.common import joined, stored
from quarry.llm.url_filters import split_url

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<([/]?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|[^>]*(?:>|\Z))|<[!?][^>]*(?:>|\Z)", re.S)
NAMED = re.compile(r"""(?:^|[\s"'])(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
#: The words of a name such as ``ad-box``, ``site_nav`` or ``mainNav``.
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Different pages, and share of a host's pages, that a template node is on at least.
TEMPLATE_PAGES, TEMPLATE_SHARE = 3, 0.9
#: Pairs of different forms of two lists of children up to which they are matched one by one; cells of a table that are kept at once.
MOST_KINDS, MOST_CELLS = 2_500, 4_000_000
#: Node numbers in remembered pairings, and forms, beyond which a worker starts anew.
PAIRS_KEPT, FORMS_KEPT = 1_000_000, 500_000
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("article body div main section td center".split())
#: Elements of page furniture, and words that mark it in names of class, id or role; other words that such a name may have.
FURNITURE = frozenset(
    "nav header footer aside form script style noscript template iframe svg canvas button select option textarea input label dialog menu head title"
    " object audio video map".split()
)
MARKS = frozenset(
    "ad adbox ads adsense adslot adunit adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment commentlist comments"
    " cookie cookies consent disqus footer gdpr masthead menu modal nav navbar navigation navmenu newsletter notice notices pagination popup"
    " promo promotion promoted related replies reply share sharing sidebar social sponsor sponsored subscribe topbar widget toolbar".split()
)
BESIDE = frozenset(
    "a all area bar block body bottom box btn button buttons button card col column container content end floating fixed for global group header holder"
    " icons inner item items left link links list local main mobile module outer page panel post posts primary right row secondary section side site"
    " slot small sticky the thread top unit user wrap wrapper zone"
    .split()
)
#: Names of the page's header, and elements whose header is their own, not the page's.
HEADERS, OWN_HEADER = frozenset("header siteheader globalheader topheader mainheader mobileheader stickyheader fixedheader headerbar headerwrap headerwrapper headercontainer headerinner headertop".split()), frozenset({"article", "main"})
#: An open element that one of these closes when it starts.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}


class Node:
    __slots__ = ("form", "furniture", "parts", "tag")

    def __init__(self, tag: str, furniture: bool = False):
        self.tag, self.furniture, self.parts, self.form = tag, furniture, [], -1

    def nodes(self) -> list[Node]:
        return [x for x in self.parts if not isinstance(x, str)]


def marked(attributes: str, own_header: bool = False) -> bool:
    """Whether class, id or role have a name of page furniture: one made of MARKS, with words of BESIDE at most, or of
    HEADERS outside of an element with its own header."""
    for m in NAMED.finditer(attributes):
        for name in m[1].strip("\"'").split():
            words = [w.lower() for w in PARTS.findall(name)]
            if not MARKS.isdisjoint(words) and (MARKS | BESIDE).issuperset(words) or not own_header and "".join(words) in HEADERS:
                return True
    return False


class Open:
    """The open elements of a page, and where those of each tag are."""

    def __init__(self, root: Node):
        self.nodes, self.at = [root], {}

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def last(self, tags) -> int:
        """The place of the last open element of these tags, or 0."""
        return max((places[-1] for t in tags if (places := self.at.get(t))), default=0)

    def close(self, k: int) -> None:
        """End the element at place ``k`` and all inside it."""
        for node in self.nodes[k:]:
            self.at[node.tag].pop()
        del self.nodes[k:]


def parse(page: str) -> Node:
    """The tree of a page; texts stand undecoded between the nodes."""
    root = Node("")
    opened, last, end = Open(root), 0, len(page)
    while last < end:
        m = TAG.search(page, last)
        if m is None:
            opened.nodes[-1].parts.append(page[last:])
            break
        if m.start() > last:
            opened.nodes[-1].parts.append(page[last : m.start()])
        last = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if k := opened.last((tag,)):
                opened.close(k)
            continue
        if tag in BLOCK and (k := opened.last(("p",))):
            opened.close(k)
        if tag in CLOSES and (k := opened.last(CLOSES[tag])) > opened.last(STOPS[tag]):
            opened.close(k)
        own_header = bool(opened.last(OWN_HEADER))
        node = Node(tag, tag in FURNITURE and not (own_header and tag == "header") or "=" in m[3] and marked(m[3], own_header))
        opened.nodes[-1].parts.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*/?>", re.I).search(page, last)
            last = close.end() if close else end
        elif tag not in VOID:
            opened.push(node)
    return root


def skeleton(root: Node) -> str:
    """A tree without its texts: tags and, in brackets, their children; ``!`` marks furniture, whose inside is left out."""
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.furniture:
            out.append(f"{x.tag}!")
        else:
            out.append(x.tag)
            for n in reversed(x.nodes()):
                todo += [")", n, "("]
    return "".join(out)


def from_skeleton(text: str) -> Node:
    root, stack = None, []
    for m in re.finditer(r"([^()!]*)(!?)([()]*)", text):
        if m[1] or not root:
            node = Node(m[1], bool(m[2]))
            if stack:
                stack[-1].parts.append(node)
            root = root or node
            stack.append(node)
        for c in m[3]:
            if c == ")":
                stack.pop()
    return root


def numbered(root: Node) -> list[Node]:
    """All nodes outside of furniture, in page order; a node's number is its place here."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        if not node.furniture:
            todo += node.nodes()[::-1]
    return out


class Table:
    """Best sums of matches of the first children of two lists, one row for each place in the first. A table of over
    MOST_CELLS cells keeps every ``step``-th row only."""

    def __init__(self, matches: np.ndarray, row_of: np.ndarray, column_of: np.ndarray):
        """``matches`` of different forms; the form that each child of the two lists has."""
        self.matches, self.row_of, self.column_of = matches, row_of, column_of
        n, m = len(row_of), len(column_of)
        self.step = 1 if n * m <= MOST_CELLS else math.isqrt(n)
        row = np.zeros(m + 1, dtype=np.int32)
        self.rows = [row]
        wide = matches[:, column_of] if len(matches) * m <= MOST_CELLS else None
        for i in range(n):
            row = self.after(row, i, wide)
            if (i + 1) % self.step == 0:
                self.rows.append(row)
        self.best = int(row[-1])

    def cells(self) -> int:
        return self.matches.size + sum([r.size for r in self.rows])

    def after(self, row: np.ndarray, i: int, wide: np.ndarray | None = None) -> np.ndarray:
        """Row ``i + 1`` from row ``i``."""
        k, out = self.row_of[i], row.copy()
        np.maximum(row[1:], row[:-1] + (self.matches[k][self.column_of] if wide is None else wide[k]), out=out[1:])
        return np.maximum.accumulate(out, out=out)

    def path(self) -> list[tuple[int, int]]:
        """The places that the best pairing pairs, from the last."""
        out, i, j = [], len(self.row_of), len(self.column_of)
        first, rows = i + 1, []  # rows from ``first`` on
        while i and j:
            if i - 1 < first:
                first = (i - 1) // self.step * self.step
                rows = [self.rows[first // self.step]]
                for k in range(first, i):
                    rows.append(self.rows[k + 1] if self.step == 1 else self.after(rows[-1], k))
            here, above = rows[i - first], rows[i - 1 - first]
            if here[j] == above[j]:
                i -= 1
            elif here[j] == here[j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                if self.matches[self.row_of[i], self.column_of[j]]:
                    out.append((i, j))
        return out


def trie_sums(x: list[list[int]], y: list[np.ndarray], matches: np.ndarray):
    """Best sums of matches of all pairs of a list of ``x`` and a list of ``y``, block by block of ``y``: the place of the
    block's first list, and the sums. The last column of ``matches`` is zero.

    The lists of a block lie end to end, each in a number range of its own, so that one row of the tables of all of them
    is one array. A row depends on a beginning of a list of ``x`` only, so it is made once however many lists share that;
    it is kept where a later list branches off.
    """
    order = sorted(range(len(x)), key=x.__getitem__)
    shared = [0]
    for a, b in zip(order, order[1:]):
        u, v = x[a], x[b]
        n = min(len(u), len(v))
        shared.append(next((k for k in range(n) if u[k] != v[k]), n))
    # Places of each list whose rows later ones need.
    keep, waiting, most = [[]] * len(order), [0], 1
    for k in range(len(order) - 1, -1, -1):
        most = max(most, len(waiting))
        n = bisect_right(waiting, shared[k])
        keep[k], waiting[n:] = waiting[n:], []
        if waiting[-1] < shared[k]:
            waiting.append(shared[k])
    ends = np.cumsum([0, *[len(v) + 1 for v in y]])
    start = 0
    while start < len(y):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + MOST_CELLS // (most + 2), "right")) - 1)
        column = np.concatenate([part for v in y[start:stop] for part in ([matches.shape[1] - 1], v)])
        zero = np.repeat(np.arange(stop - start, dtype=np.int64) << 32, np.diff(ends[start : stop + 1]))
        last = ends[start + 1 : stop + 1] - ends[start] - 1
        out = np.empty((len(x), stop - start), dtype=np.int32)
        kept = [(0, zero)]
        for k, at in enumerate(order):
            while kept[-1][0] > shared[k]:
                kept.pop()
            row, wanted = kept[-1][1], set(keep[k])
            for depth in range(shared[k], len(x[at])):
                new = row.copy()
                np.maximum(row[1:], row[:-1] + matches[x[at][depth]][column[1:]], out=new[1:])
                row = np.maximum.accumulate(new, out=new)
                if depth + 1 in wanted:
                    kept.append((depth + 1, row))
            out[at] = row[last] - zero[last]
        yield start, out
        start = stop


class Forms:
    """Subtrees by form: equal ones have one number. Matches of forms are remembered."""

    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.tags: list[tuple[str, bool]] = []
        self.kids: list[tuple[int, ...]] = []
        self.sizes: list[int] = []
        self.best: dict[tuple[int, int], int] = {}
        self.large: dict[tuple[int, int], Table] = {}

    def number(self, root: Node) -> list[Node]:
        """Gives every node outside of furniture its form; returns these nodes in page order."""
        order = numbered(root)
        for node in reversed(order):  # children first
            kids = () if node.furniture else tuple([n.form for n in node.nodes()])
            key = (node.tag, node.furniture, kids)
            if (f := self.known.get(key)) is None:
                f = self.known[key] = len(self.tags)
                self.tags.append((node.tag, node.furniture))
                self.kids.append(kids)
                self.sizes.append(1 + sum([self.sizes[k] for k in kids]))
            node.form = f
        return order

    def plan(self, a: int, b: int) -> tuple[list[tuple[int, int]], range, range]:
        """Places of children that pair without a choice, and the ranges of those left to align."""
        x, y = self.kids[a], self.kids[b]
        n = min(len(x), len(y))
        start = 0
        while start < n and x[start] == y[start]:
            start += 1
        stop = 0
        while stop < n - start and x[-1 - stop] == y[-1 - stop]:
            stop += 1
        pairs = [*((k, k) for k in range(start)), *((len(x) - k, len(y) - k) for k in range(stop, 0, -1))]
        p, q = range(start, len(x) - stop), range(start, len(y) - stop)
        if len(p) == len(q) == 1:
            return [*pairs, (start, start)], range(0), range(0)
        return pairs, p, q

    def anchored(self, x, y, p: range, q: range) -> list[tuple[int, int]]:
        """Pairs along the forms that both have once, in the longest common order; between them in order by tag. Not
        always the best, so ``match`` and ``aligned`` do without."""
        once_x, once_y = Counter(x[p.start : p.stop]), Counter(y[q.start : q.stop])
        place = {y[j]: j for j in q if once_y[y[j]] == 1}
        ends, tails, back, found = [], [], {}, []
        for i in p:  # longest increasing run of places
            j = place.get(x[i])
            if j is None or once_x[x[i]] > 1:
                continue
            k = bisect_left(ends, j)
            back[i] = tails[k - 1] if k else None
            if k == len(ends):
                ends.append(j)
                tails.append(i)
            else:
                ends[k], tails[k] = j, i
        i = tails[-1] if tails else None
        while i is not None:
            found.append((i, place[x[i]]))
            i = back[i]
        out, i, j = [], p.start, q.start
        for u, v in [*found[::-1], (p.stop, q.stop)]:
            waiting: dict = {}
            for k in range(v - 1, j - 1, -1):
                waiting.setdefault(self.tags[y[k]], []).append(k)
            low = j
            for k in range(i, u):
                places = waiting.get(self.tags[x[k]], [])
                while places and places[-1] < low:
                    places.pop()
                if places:
                    out.append((k, places[-1]))
                    low = places.pop() + 1
            if u < p.stop:
                out.append((u, v))
            i, j = u + 1, v + 1
        return out

    def match(self, a: int, b: int) -> int:
        """Simple tree matching: the most nodes of two forms that can be paired keeping parents and order."""
        todo = [(a, b)]
        while todo:
            pair = todo[-1]
            if self.quick(*pair) is not None:
                todo.pop()
                continue
            pairs, p, q = self.plan(*pair)
            x, y = self.kids[pair[0]], self.kids[pair[1]]
            rows, columns = {x[i] for i in p}, {y[j] for j in q}
            wanted = [(x[i], y[j]) for i, j in pairs]
            if len(rows) * len(columns) <= MOST_KINDS:
                wanted += [(f, g) for f in rows for g in columns]
            if missing := [w for w in wanted if self.quick(*w) is None]:
                todo += missing
                continue
            self.best[pair] = 1 + sum([self.quick(x[i], y[j]) for i, j in pairs]) + (self.sums(*pair, p, q).best if p and q else 0)
            todo.pop()
        return self.quick(a, b)

    def quick(self, a: int, b: int) -> int | None:
        """A match that is known already."""
        if a == b:
            return self.sizes[a]
        if self.tags[a] != self.tags[b]:
            return 0
        return self.best.get((a, b)) if self.kids[a] and self.kids[b] else 1

    def sums(self, a: int, b: int, p: range, q: range) -> Table:
        """The table of the children of two forms in two ranges; large ones are remembered, up to MOST_CELLS cells."""
        if (a, b) in self.large:
            return self.large[a, b]
        rows, row_of = np.unique(np.array([self.kids[a][i] for i in p], dtype=np.int64), return_inverse=True)
        columns, column_of = np.unique(np.array([self.kids[b][j] for j in q], dtype=np.int64), return_inverse=True)
        whole = len(rows) * len(columns) > MOST_KINDS
        if whole:
            matches = self.grid(rows, columns)
        else:
            matches = np.array([[self.quick(f, g) for g in columns.tolist()] for f in rows.tolist()], dtype=np.int32).reshape(len(rows), len(columns))
        out = Table(matches, row_of, column_of)
        if whole or out.step > 1:
            self.large[a, b] = out
            while len(self.large) > 1 and sum([t.cells() for t in self.large.values()]) > MOST_CELLS:
                del self.large[next(iter(self.large))]
        return out

    def grid(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """The matches of all pairs of two arrays of forms, each in order: from the deepest level that both have up."""
        levels = [(rows, columns)]
        while len(rows) and len(columns):
            f, g = ([k for k in x.tolist() if self.kids[k]] for x in (rows, columns))
            common = {self.tags[k] for k in f} & {self.tags[k] for k in g}
            rows, columns = (np.array(sorted({n for k in x if self.tags[k] in common for n in self.kids[k]}), dtype=np.int64) for x in (f, g))
            levels.append((rows, columns))
        below = np.zeros((0, 0), dtype=np.int32)
        for level in range(len(levels) - 2, -1, -1):
            below = self.level(*levels[level], *levels[level + 1], below)
        return below

    def level(self, rows, columns, row_kids, column_kids, below: np.ndarray) -> np.ndarray:
        """The matches of all pairs of two arrays of forms, from ``below``, those of their children."""
        out = np.zeros((len(rows), len(columns)), dtype=np.int32)
        below = np.hstack([below, np.zeros((len(below), 1), dtype=np.int32)])  # the last column: before the first child
        by_tag: tuple[dict, dict] = {}, {}
        for found, forms in zip(by_tag, (rows, columns)):
            for k, f in enumerate(forms.tolist()):
                found.setdefault(self.tags[f], []).append(k)
        for tag in by_tag[0].keys() & by_tag[1].keys():
            out[np.ix_(by_tag[0][tag], by_tag[1][tag])] = 1
            f, g = ([k for k in found[tag] if self.kids[forms[k]]] for found, forms in zip(by_tag, (rows, columns)))
            if f and g:
                x = [np.searchsorted(row_kids, self.kids[rows[k]]).tolist() for k in f]
                y = [np.searchsorted(column_kids, self.kids[columns[k]]) for k in g]
                for start, part in trie_sums(x, y, below):
                    out[np.ix_(f, g[start : start + part.shape[1]])] += part
        return out

    def aligned(self, a: int, b: int) -> list[tuple[int, int]]:
        """Places of the children of two matched forms in their best pairing."""
        self.match(a, b)
        if a == b:
            return [(k, k) for k in range(len(self.kids[a]))]
        pairs, p, q = self.plan(a, b)
        x, y = self.kids[a], self.kids[b]
        out = [(i, j) for i, j in pairs if self.quick(x[i], y[j])]
        if p and q:
            out += [(p[i], q[j]) for i, j in self.sums(a, b, p, q).path()]
        return out


def pairing(seed: Node, page: Node, forms: Forms) -> dict[int, int]:
    """Numbers of the seed's nodes with the numbers of the page's nodes that they are paired with."""
    at_seed = {id(n): k for k, n in enumerate(forms.number(seed))}
    at_page = {id(n): k for k, n in enumerate(forms.number(page))}
    out, todo = {0: 0}, [(seed, page)]
    while todo:
        a, b = todo.pop()
        if a.furniture or not a.parts or not b.parts:
            continue
        x, y = a.nodes(), b.nodes()
        for i, j in forms.aligned(a.form, b.form):
            out[at_seed[id(x[i])]] = at_page[id(y[j])]
            todo.append((x[i], y[j]))
    return out


class Wrappers:
    """Pairings of page forms with seeds: a form is paired once for each seed."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.forms, self.kept = Forms(), 0
        self.seeds: dict[str, Node] = {}
        self.pairs: dict[tuple[str, int], dict[int, int]] = {}

    def pair(self, seed: str, page: Node) -> dict[int, int]:
        if self.kept > PAIRS_KEPT or len(self.forms.tags) + len(self.forms.best) > FORMS_KEPT:
            self.clear()
        if seed not in self.seeds:
            self.seeds[seed] = from_skeleton(seed)
            self.forms.number(self.seeds[seed])
        self.forms.number(page)
        key = (seed, page.form)
        if key not in self.pairs:
            self.pairs[key] = pairing(self.seeds[seed], page, self.forms)
            self.kept += len(self.pairs[key])
        return self.pairs[key]


def own_text(node: Node) -> str:
    """The text of a node and of its inline children, with one space for white space."""
    out, todo = [], node.parts[::-1]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag == "br":
            out.append(" ")
        elif not x.furniture and x.tag not in BLOCK:
            todo += x.parts[::-1]
    return " ".join(entities.unescape("".join(out)).split())


def blocks(node: Node, template: frozenset | set = frozenset()) -> list[str]:
    """The texts of the blocks inside a node in page order, without furniture, empty ones and the own texts of the nodes
    whose ``id()`` is in ``template``."""
    out: list[str] = []
    line: list[str] = []

    def close():
        if text := " ".join(entities.unescape("".join(line)).split()):
            out.append(text)
        line.clear()

    todo: list = [(x, id(node) in template) for x in reversed(node.parts)]
    while todo:
        x, left_out = todo.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            if not left_out:
                line.append(x)
        elif x.furniture:
            if x.tag in BLOCK:
                close()
        elif x.tag == "br":
            line.append(" ")
        elif x.tag in BLOCK:
            close()
            todo.append((None, False))
            inside = id(x) in template
            todo += [(y, inside) for y in reversed(x.parts)]
        else:
            todo += [(y, left_out) for y in reversed(x.parts)]
    close()
    return out


def template_nodes(stats: dict[int, tuple[int, bool, int, int]]) -> list[int]:
    """The numbers of the seed's nodes that are template. ``stats`` by node: pages, whether the text varies, characters,
    and different pages up to TEMPLATE_PAGES. All pages of a host are paired with node 0."""
    whole = stats.get(0, (0,))[0]
    return sorted(k for k, (pages, varies, chars, different) in stats.items() if chars and not varies and different >= TEMPLATE_PAGES and pages >= TEMPLATE_SHARE * whole)


def content_slot(form: str, stats: dict[int, tuple[int, bool, int, int]]) -> int:
    """The number of the content slot of a seed, or -1, by the same ``stats``."""
    seed = from_skeleton(form)
    order = numbered(seed)
    at = {id(n): k for k, n in enumerate(order)}
    mass = [0.0] * len(order)
    for k in range(len(order) - 1, -1, -1):
        _, varies, chars, _ = stats.get(k, (0, False, 0, 0))
        mass[k] = chars * varies + (0 if order[k].furniture else sum(mass[at[id(c)]] for c in order[k].nodes()))
    if not mass or not mass[0]:
        return -1
    here = slot = 0
    while order[here].tag not in ("article", "main"):
        big = max((at[id(c)] for c in order[here].nodes() if not c.furniture), key=lambda k: mass[k], default=-1)
        if big < 0 or mass[big] < mass[here]:
            break
        here = big
        if order[here].tag in CONTAINER:
            slot = here
    return slot


def main_text(page: Node, slot: Node | None, template: frozenset | set = frozenset()) -> str:
    """The article of a page: at its slot, else all its ``article`` and ``main`` elements, else its body, else all of it."""
    if slot is not None:
        return "\n".join(blocks(slot, template))
    found: list[str] = []
    todo = [page]
    while todo:
        node = todo.pop()
        if node.furniture:
            continue
        if node.tag in ("article", "main"):
            found += blocks(node)
        else:
            todo += node.nodes()[::-1]
    return "\n".join(found or blocks(next((n for n in numbered(page) if n.tag == "body"), page)))


def with_host(pages: DataFrame, url: str) -> DataFrame:
    """``pages`` with the host of each url as ``_host``."""
    return pages.withColumn("_host", split_url(F.col(f"`{url}`"))[0])


def _commonest(batches):
    """Each task's pages by host and form: how many there are, and the least id."""
    sums: dict = {}
    for batch in chunks(batches, "html"):
        for host, page_id, text in zip(batch.column("_host").to_pylist(), batch.column("_id").to_pylist(), text_list(batch, "html")):
            page = parse(text)
            if page.nodes() and page_id is not None:
                key = host, xxhash.xxh64_intdigest(skeleton(page).encode()) >> 1
                n, least = sums.get(key, (0, page_id))
                sums[key] = n + 1, min(least, page_id)
        if len(sums) > 200_000:
            yield _columns(sums, [pa.string(), pa.int64(), pa.int64(), pa.string()], ["_host", "kind", "n", "_id"])
            sums = {}
    yield _columns(sums, [pa.string(), pa.int64(), pa.int64(), pa.string()], ["_host", "kind", "n", "_id"])


def _columns(sums: dict, types: list, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*[(*k, *v) for k, v in sums.items()])) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def _forms(batches):
    for batch in chunks(batches, "html"):
        yield pa.RecordBatch.from_arrays([batch.column("_host"), pa.array([skeleton(parse(t)) for t in text_list(batch, "html")], pa.string())], ["_host", "form"])


def _observe(batches):
    """Each task's sums by host and node of the seed: pages, least and greatest text checksum, characters, and the
    checksums of different pages, TEMPLATE_PAGES of them at most."""
    types = [pa.string(), pa.int32(), *[pa.int64()] * 4, pa.list_(pa.int64())]
    names = ["_host", "node", "pages", "low", "high", "chars", "different"]
    wrappers, sums = Wrappers(), {}
    for batch in chunks(batches, "html"):
        for host, seed, text in zip(batch.column("_host").to_pylist(), batch.column("form").to_pylist(), text_list(batch, "html")):
            page = parse(text)
            if not page.nodes():
                continue  # says nothing of the host's pages
            nodes, whole = numbered(page), zlib.crc32(text.encode())
            for k, j in wrappers.pair(seed, page).items():
                node = nodes[j]
                if node.furniture or (node.tag and node.tag not in BLOCK):
                    continue
                said = own_text(node)
                x, s = zlib.crc32(said.encode()), sums.get((host, k))
                if s:
                    s[0], s[1], s[2], s[3] = s[0] + 1, min(s[1], x), max(s[2], x), s[3] + len(said)
                    if len(s[4]) < TEMPLATE_PAGES and whole not in s[4]:
                        s[4].append(whole)
                else:
                    sums[host, k] = [1, x, x, len(said), [whole]]
        if len(sums) > 200_000:
            yield _columns(sums, types, names)
            sums = {}
    yield _columns(sums, types, names)


def _slots(batches):
    for batch in batches:
        slots, templates = [], []
        for form, stats in zip(batch.column("form").to_pylist(), batch.column("stats").to_pylist()):
            stats = {s["node"]: (s["pages"], s["low"] != s["high"], s["chars"], s["different"]) for s in stats}
            slots.append(content_slot(form, stats))
            templates.append(template_nodes(stats))
        yield pa.RecordBatch.from_arrays([batch.column("_host"), batch.column("form"), pa.array(slots, pa.int32()), pa.array(templates, pa.list_(pa.int32()))], ["_host", "form", "slot", "template"])


def induce(pages: DataFrame, url: str = "url", page_id: str = "page_id", html: str = "html") -> DataFrame:
    """The wrapper of each host: _host, form (tree of the most frequent form of its pages), slot (number of the content
    node, or -1) and template (numbers of template nodes)."""
    bounded(pages.sparkSession)
    rows = with_host(pages, url).select("_host", F.col(f"`{page_id}`").cast("string").alias("_id"), F.col(f"`{html}`").alias("html"))
    kinds = rows.mapInArrow(_commonest, "_host string, kind long, n long, _id string").groupBy("_host", "kind").agg(F.sum("n").alias("n"), F.min("_id").alias("_id"))
    first = stored(kinds.groupBy("_host").agg(F.max_by("_id", F.struct("n", "kind")).alias("_id")), "page-firsts")
    seeds = joined(rows.where("_id is not null"), first, ["_host", "_id"]).select("_host", "html").mapInArrow(_forms, "_host string, form string")
    # Several pages of one id: the form with most nodes, so never one without.
    seeds = stored(seeds.groupBy("_host").agg(F.max_by("form", F.struct(F.length("form"), "form")).alias("form")), "page-seeds")
    seen = joined(rows.select("_host", "html"), seeds, "_host", rows=20_000).mapInArrow(_observe, "_host string, node int, pages long, low long, high long, chars long, different array<long>")
    some = F.slice(F.array_distinct(F.flatten(F.collect_list("different"))), 1, TEMPLATE_PAGES)
    # As many lists as tasks have given, of TEMPLATE_PAGES numbers each.
    sums = seen.groupBy("_host", "node").agg(F.sum("pages").alias("pages"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("chars").alias("chars"), F.size(some).alias("different"))
    # One row for each node of one page: as bounded as a page.
    stats = sums.groupBy("_host").agg(F.collect_list(F.struct("node", "pages", "low", "high", "chars", "different")).alias("stats"))
    return seeds.join(stats, "_host").mapInArrow(_slots, "_host string, form string, slot int, template array<int>")


def extract(pages: DataFrame, url: str = "url", page_id: str = "page_id", html: str = "html", cut_template: bool = False) -> DataFrame:
    """``pages`` without html, with the main text of each page as ``text``; ``cut_template``: without what all pages of
    its host have inside the content slot."""
    bounded(pages.sparkSession)
    own = [c for c in pages.columns if c not in (html, "text")]
    wrappers = stored(induce(pages, url, page_id, html), "page-wrappers")
    # The columns passed by go in one struct, so that no name can clash.
    rows = with_host(pages, url).select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("own"), F.col(f"`{html}`").alias("html"), "_host")
    rows = joined(rows, wrappers, "_host", "left", rows=20_000)

    def run(batches):
        wraps = Wrappers()
        for batch in chunks(batches, "html"):
            out = []
            for form, slot, fixed, text in zip(*(batch.column(c).to_pylist() for c in ("form", "slot", "template")), text_list(batch, "html")):
                page, node, template = parse(text), None, set()
                if form is not None and slot > 0:
                    pairs, nodes = wraps.pair(form, page), numbered(page)
                    node = nodes[pairs[slot]] if slot in pairs else None
                    template = {id(nodes[pairs[k]]) for k in fixed if k in pairs} if cut_template else set()
                out.append(main_text(page, node, template))
            yield pa.RecordBatch.from_arrays([batch.column("own"), pa.array(out, pa.string())], ["own", "text"])

    return rows.drop("_host").mapInArrow(run, StructType([rows.schema["own"], StructField("text", StringType())])).select("own.*", "text")
