"""HTML as a tree of block elements: parsing, skeletons, simple tree matching.

Parsing is lenient: implied end tags, unclosed and misnested elements, tags cut off at the end.
Parts that are never an article (menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles, comments) are left out by tag, role or class word. A skeleton is the tree with
runs of equal siblings taken as one node, so a list or a row of paragraphs is one slot. Simple tree
matching aligns two skeletons top down: equal labels match, children in order, the most nodes win.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from html import unescape

import numpy as np

# Element names of HTML and words that sites use for page furniture.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol "
    "p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = _BLOCK - frozenset("html body caption legend tbody td tfoot th thead tr dd dt li".split()) | {"hr"}
_RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
_NEVER = frozenset(
    "aside audio button canvas dialog footer form head iframe math menu nav noembed noframes noscript "
    "object script search select style svg template textarea title video xmp".split()
)
_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split()
)
_NEVER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments "
    "consent cookie cookies disqus menu menus modal nav navbar navigation newsletter notice notices "
    "pagination popup promo sidebar sponsor sponsored subscribe".split()
)
#: only outside an article: inside one a header holds its title
_OUTER_WORDS = frozenset("footer header masthead topbar".split())
#: only as a whole class name
_NEVER_CLASSES = frozenset("related share sharing social widget".split())
# Elements that a start tag closes, and where the search for them ends.
_SAME_LEVEL = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}
_TABLE = frozenset("table thead tbody tfoot tr td th caption".split())
#: elements nested deeper share the node of the last that counts; their text is kept
DEPTH = 120

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)(>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(
    r"""(?<![^\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I
)


@lru_cache(maxsize=4096)
def _read_attributes(written: str) -> tuple[str, frozenset[str], frozenset[str], str]:
    """(label, whole names, words, role) from the attributes of a tag."""
    names, words, role, label = set(), set(), "", ""
    for kind, *values in _ATTRIBUTE.findall(written):
        value = "".join(values).lower()
        if kind.lower() == "role":
            role = value.strip()
            continue
        names.update(value.split())
        words.update(re.split(r"[^a-z0-9]+", value))
    if names:
        label = "." + ".".join(sorted(re.sub(r"[0-9]+", "0", re.sub(r"[\s:]", "", n)) for n in names))
    return label, frozenset(names), frozenset(words), role


def _furniture(tag: str, names: frozenset, words: frozenset, role: str, inside: bool) -> bool:
    """Whether an element is no part of any article; ``inside`` an article already."""
    if tag in _NEVER or role in _ROLES or tag == "header" and not inside:
        return True
    if tag in ("html", "body", "main"):
        return False
    if tag == "article":  # its classes often tell what it has, not what it is
        words = names
    if not inside and words & _OUTER_WORDS and tag != "article":
        return True
    return bool(words & _NEVER_WORDS or names & _NEVER_CLASSES)


class Page:
    """``parents`` and ``labels`` of block elements; ``blocks``: (node, text, marked, all link)."""

    def __init__(self, html: str):
        self.parents, self.labels, depth = [-1], ["#"], [0]
        self.blocks: list[tuple[int, str, bool, bool]] = []
        parts: list[str] = []
        linked = [0, 0]  # characters outside and inside links
        # open elements: tag, block element, left out, node, inside a marked article, inside a link
        stack = [("#", True, False, 0, False, False)]
        open_ = Counter()

        def flush() -> None:
            if parts:
                text = "".join(parts)
                text = " ".join((unescape(text) if "&" in text else text).split())
                if text:
                    top = stack[-1]
                    self.blocks.append((top[3], text, top[4], linked[0] == 0))
                parts.clear()
                linked[:] = 0, 0

        def close(upto: int) -> None:
            if any(e[1] for e in stack[upto:]):
                flush()
            for e in stack[upto:]:
                open_[e[0]] -= 1
            del stack[upto:]

        def say(text: str) -> None:
            top = stack[-1]
            if not top[2]:
                parts.append(text)
                if not text.isspace():
                    linked[top[5]] += 1

        at, raw_until = 0, None
        while True:
            found = _TOKEN.search(html, at)
            if found is None:
                break
            if found.start() > at:
                say(html[at : found.start()])
            at = found.end()
            tag = found[2]
            if tag is None or not found[4]:  # a comment, a declaration, or cut off
                continue
            tag = tag.lower()
            if found[1]:
                self._end(tag, stack, open_, flush, close)
                continue
            block = tag in _BLOCK
            if block or tag == "hr":
                flush()
                if tag in _CLOSES_P and open_["p"]:
                    self._close_implied({"p"}, _BLOCK - {"p"}, stack, close)
                if tag in _SAME_LEVEL:
                    self._close_implied(*_SAME_LEVEL[tag], stack, close)
            if tag in _VOID:
                if tag == "br":
                    say(" ")
                continue
            label, names, words, role = _read_attributes(found[3])
            top = stack[-1]
            never = top[2] or _furniture(tag, names, words, role, top[4])
            node = top[3]
            if block and not never and depth[node] < DEPTH:
                self.parents.append(node)
                self.labels.append(tag + label)
                depth.append(depth[node] + 1)
                node = len(self.labels) - 1
            if tag in _RAW:
                end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(html, at)
                at = end.start() if end else len(html)
            if never and not top[2] and block:
                flush()
            marked = top[4] or tag in ("article", "main")
            stack.append((tag, block, never, node, marked, top[5] or tag == "a"))
            open_[tag] += 1
        if at < len(html):
            say(html[at:])
        flush()

    @staticmethod
    def _close_implied(tags: set, limits: set, stack: list, close) -> None:
        """Close the outermost of ``tags`` that is open above the nearest of ``limits``."""
        upto = None
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in tags:
                upto = i
            elif stack[i][0] in limits:
                break
        if upto is not None:
            close(upto)

    @staticmethod
    def _end(tag: str, stack: list, open_: Counter, flush, close) -> None:
        if tag in _BLOCK:
            flush()
        if not open_[tag]:
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] == tag:
                close(i)
                return
            if stack[i][1] and tag not in _BLOCK:  # an inline element ends inside its block
                return
            if stack[i][0] in ("td", "th", "table") and tag not in _TABLE:
                return

    def skeleton(self) -> tuple[str, list[int]]:
        """The skeleton as text, and each node's place in it (counted in document order)."""
        n = len(self.labels)
        children: list[list[int]] = [[] for _ in range(n)]
        for i in range(1, n):
            children[self.parents[i]].append(i)
        known: dict[tuple, int] = {}
        kind, size, kept = [0] * n, [], [()] * n
        for i in range(n - 1, -1, -1):
            runs: list[int] = []
            for c in children[i]:
                if not runs or kind[c] != kind[runs[-1]]:
                    runs.append(c)
            key = (self.labels[i], *(kind[c] for c in runs))
            if key not in known:
                known[key] = len(known)
                size.append(1 + sum(size[kind[c]] for c in runs))
            kind[i], kept[i] = known[key], runs
        place, written = [0] * n, [""] * size[kind[0]]
        for i in range(n):  # parents come first
            written[place[i]] = f"{len(kept[i])}:{self.labels[i]}"
            at = place[i] + 1
            previous = None
            for c in children[i]:
                if previous is not None and kind[c] != kind[previous]:
                    at += size[kind[previous]]
                place[c] = at
                previous = c
        return " ".join(written), place


class Skeleton:
    """A skeleton read back: per node label, parent, children; equal subtrees share a kind."""

    def __init__(self, written: str, known: dict[tuple, int]):
        counts, self.labels = [], []
        for token in written.split(" "):
            n, _, label = token.partition(":")
            counts.append(int(n))
            self.labels.append(label)
        self.parents, self.children = [-1] * len(counts), [[] for _ in counts]
        waiting: list[int] = []
        for i in range(len(counts)):
            while waiting and len(self.children[waiting[-1]]) == counts[waiting[-1]]:
                waiting.pop()
            if waiting:
                self.parents[i] = waiting[-1]
                self.children[waiting[-1]].append(i)
            waiting.append(i)
        self.kinds = [0] * len(counts)
        for i in range(len(counts) - 1, -1, -1):
            key = (self.labels[i], *(self.kinds[c] for c in self.children[i]))
            self.kinds[i] = known.setdefault(key, len(known))

    def paths(self) -> list[str]:
        out: list[str] = []
        for parent, label in zip(self.parents, self.labels):
            out.append(label if parent < 0 else f"{out[parent]}>{label}")
        return out


#: larger tables of sibling scores are split in two instead of kept whole
_CELLS = 4_000_000


def _sums(weight: np.ndarray, rows: np.ndarray, columns: np.ndarray, keep: bool):
    """Best total weight of an in-order matching of row prefixes with column prefixes."""
    line = np.zeros(len(columns) + 1, np.int64)
    kept = [line] if keep else None
    for r in rows:
        best = line.copy()
        best[1:] = np.maximum(best[1:], line[:-1] + weight[r, columns])
        line = np.maximum.accumulate(best)
        if keep:
            kept.append(line)
    return np.array(kept) if keep else line


def in_order(weight: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> list[tuple[int, int]]:
    """Positions (row, column) of a heaviest matching that keeps the order of both sides."""
    m, n = len(rows), len(columns)
    if not m or not n:
        return []
    if m * n > _CELLS and m > 1:
        half = m // 2
        ahead = _sums(weight, rows[:half], columns, False)
        behind = _sums(weight, rows[half:][::-1], columns[::-1], False)[::-1]
        cut = int(np.argmax(ahead + behind))
        tail = in_order(weight, rows[half:], columns[cut:])
        return in_order(weight, rows[:half], columns[:cut]) + [(a + half, b + cut) for a, b in tail]
    table = _sums(weight, rows, columns, True)
    pairs, i, j = [], m, n
    while i and j:
        if table[i, j] == table[i, j - 1]:
            j -= 1
        elif table[i, j] == table[i - 1, j]:
            i -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return pairs[::-1]


class Matcher:
    """Simple tree matching; scores of equal pairs of subtrees are worked out once."""

    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.scores: dict[tuple[int, int], int] = {}

    def read(self, written: str) -> Skeleton:
        return Skeleton(written, self.known)

    def _weights(self, a: Skeleton, b: Skeleton, left: list[int], right: list[int]):
        """Scores per pair of kinds, and the kinds of both lists of siblings."""
        some, rows = np.unique([a.kinds[i] for i in left], return_index=True)
        others, columns = np.unique([b.kinds[i] for i in right], return_index=True)
        weight = np.array(
            [[self.score(a, b, left[i], right[j]) for j in columns] for i in rows], np.int64
        )
        of_left = np.searchsorted(some, [a.kinds[i] for i in left])
        of_right = np.searchsorted(others, [b.kinds[i] for i in right])
        return weight, of_left, of_right

    def _trimmed(self, a: Skeleton, b: Skeleton, i: int, j: int):
        """Equal siblings at both ends match each other; (first, last) lists, and what is between."""
        left, right = a.children[i], b.children[j]
        front = 0
        while front < min(len(left), len(right)) and a.kinds[left[front]] == b.kinds[right[front]]:
            front += 1
        back = 0
        while (
            back < min(len(left), len(right)) - front
            and a.kinds[left[-1 - back]] == b.kinds[right[-1 - back]]
        ):
            back += 1
        ends = list(zip(left[:front], right[:front]))
        if back:
            ends += zip(left[-back:], right[-back:])
        return ends, left[front : len(left) - back], right[front : len(right) - back]

    def score(self, a: Skeleton, b: Skeleton, i: int, j: int) -> int:
        if a.labels[i] != b.labels[j]:
            return 0
        key = (a.kinds[i], b.kinds[j])
        if key not in self.scores:
            ends, left, right = self._trimmed(a, b, i, j)
            total = 1 + sum(self.score(a, b, x, y) for x, y in ends)
            if left and right:
                total += int(_sums(*self._weights(a, b, left, right), False)[-1])
            self.scores[key] = total
        return self.scores[key]

    def align(self, a: Skeleton, b: Skeleton) -> list[int]:
        """For every node of ``a`` its node of ``b``, or -1."""
        found = [-1] * len(a.labels)
        todo = [(0, 0)] if a.labels[0] == b.labels[0] else []
        while todo:
            i, j = todo.pop()
            found[i] = j
            ends, left, right = self._trimmed(a, b, i, j)
            todo += ends
            if left and right:
                weight, rows, columns = self._weights(a, b, left, right)
                pairs = in_order(weight, rows, columns)
                todo += [(left[x], right[y]) for x, y in pairs if weight[rows[x], columns[y]]]
        return found
