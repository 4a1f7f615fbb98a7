"""HTML extraction with wrappers: union-free regular expressions inferred from the pages of a host.

A page is a stream of tags and texts, balanced into nodes. The wrapper of a host starts as its first
page; every further page is aligned with it, level by level. Where texts differ there is a text slot;
where tags differ, what is missing is a repetition of its neighbour or of an earlier part (a repeated
group) or else optional. The wrapper then tells template from text.
"""

from __future__ import annotations

import functools
import hashlib
import html
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelorus.llm.common import Scratch, table

#: Partial wrappers of a host that meet in one task.
FAN_IN = 64
#: Children that are kept in order; with more they make one repeated group. Cells of an alignment's table.
KIDS = 64
CELLS = 4096
#: Adjacent equal elements that are a repetition on sight.
RUN = 12
#: A wrapper with more nodes forgets those that fewer than a quarter of its pages have: no template is among them.
NODES = 1500
#: Different pages that a text must be the same in to be template, and how many a wrapper remembers.
LEAST_PAGES = 3
SEEN = 8
#: Places that a host's pages are dealt to: a quarter of the input's partitions, or these.
LEAST_SALTS = 8
#: Pages that are aligned before their wrappers are handed on.
SLICE = 1000

NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
ATTRIBUTES = re.compile(r"(?:[^>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[=\"'])*+")
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "svg"}
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: An open element of the second kind ends when one of the first opens, unless one of the third is between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
SCOPES = {"html", "body", "article", "main", "section", "div", "td", "th", "table", "aside", "nav", "header", "footer", "form", "blockquote"}
LISTS = {"ul", "ol", "dl", "tr", "tbody"}
DROPPED_TAGS = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "head", "fieldset", "object", "canvas", "audio", "video", "label"}
DROPPED_WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation navi breadcrumb breadcrumbs "
    "sidebar side rail aside footer foot masthead topbar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe "
    "subscription signup login comment comments commentlist respond reply replies disqus discussion share sharing social related recommended recommendations "
    "widget widgets toolbar pagination pager search tags".split()
)
COMMENT_WORDS = {"comment", "comments", "commentlist", "respond", "reply", "replies", "disqus"}
#: Of the dropped words those that also name parts of a text: in the main element they need the wrapper's word.
PLAIN_WORDS = {"side", "rail", "foot", "discussion"}
#: And those that drop a paragraph, heading or quotation only with it (of "search": any element of running text).
PLAIN_IN_TEXT = {"search", "related", "social"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
LAYOUT_WORDS = {"has", "no", "with", "without"}
OWN_HEADER = {"article", "post", "entry", "content", "story"}
#: Elements of running text: a word of their id names an anchor, not a kind of element.
TEXT_TAGS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "dt", "dd", "td", "th", "tr", "table", "blockquote", "pre", "section", "figure"}
MAIN_WORDS = {"articlebody", "maincontent", "storybody", "postbody", "postcontent", "entrycontent", "articlecontent", "articletext", "main"}
#: Elements that may be links from end to end and yet are text.
UNLINKED = {"html", "body", "p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "tr", "blockquote", "pre"}
#: What names say of an element: nothing; one of DROPPED_WORDS is in them; the same, of an id that may be an anchor's; it is a whole name in class or role.
NO_NAME, NAMED, ANCHOR, WHOLE = 0, 1, 2, 3
FIXED, LINKED, SAME = 1, 2, 4


class Node:
    """An element of a page, or of a wrapper: what is the same in all pages, and what isn't.

    n, c, l: occurrences, characters of its own text, those in links; t: a hash of that text, None for a
    slot; kids; rep, opt: whether it is repeated, whether pages can lack it; group: whether its kids,
    one of each signature, make a group ((a)?(b)?...)+. Of a page also tag, items (its texts, kids and,
    as None, ends of blocks) and what its names say.
    """

    __slots__ = ("tag", "sig", "items", "says", "words", "kids", "n", "c", "l", "t", "rep", "opt", "group", "flag", "kinds")

    def __init__(self, tag: str, sig: str, says: int = NO_NAME, words: frozenset[str] = frozenset()):
        self.tag, self.sig, self.says, self.words = tag, sig, says, words
        self.items, self.kids, self.n, self.c, self.l, self.t = [], [], 1, 0, 0, ""
        self.rep = self.opt = self.group = False
        self.flag, self.kinds = 0, None


def _words(names: str) -> frozenset[str]:
    return frozenset(w.lower() for w in re.findall(r"[A-Za-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", names)))


def _named(attributes: str) -> tuple[int, frozenset[str], str]:
    """What the names among attributes say, their words, and those of class and role for the signature."""
    found = [(name.lower(), a or b or c) for name, a, b, c in ATTRIBUTE.findall(attributes)]
    words = _words(" ".join(v for _, v in found))
    kind = _words(" ".join(v for name, v in found if name != "id"))
    says = NO_NAME
    if words & DROPPED_WORDS:
        if any(v in DROPPED_WORDS for name, value in found if name in ("class", "role") for v in value.lower().split()):
            says = WHOLE
        else:
            says = NAMED if kind & DROPPED_WORDS else ANCHOR
    return says, words, ".".join(sorted(kind | (words & (DROPPED_WORDS | MAIN_WORDS))))


def parse(page: str) -> Node:
    """The nodes of a page. Inline elements without class or id leave only their text, unless their tag is dropped; missing end tags are implied.

    One pass over the page: a tag that doesn't end within its quotes ends at the next `>`.
    """
    root = Node("html", "html")
    stack: list[tuple[str, Node]] = [("", root)]
    opened: Counter[str] = Counter()
    at = linked = 0
    size, shut = len(page), -1

    def text(a: int, b: int) -> None:
        if a < b:
            own = stack[-1][1]
            own.items.append(page[a:b])
            if linked:
                own.l += b - a

    def close(upto: int) -> None:
        nonlocal linked
        for tag, _ in stack[upto:]:
            opened[tag] -= 1
            linked -= tag == "a"
        del stack[upto:]

    def find(tags: set[str], stops: set[str]) -> int:
        if any(opened[t] for t in tags):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in tags:
                    return i
                if stack[i][0] in stops:
                    break
        return 0

    while at < size:
        start = page.find("<", at)
        if shut < start:
            shut = page.find(">", start)
        if start < 0 or shut < 0:
            text(at, size)
            break
        after = page[start + 1 : start + 2]
        if after in ("!", "?"):
            text(at, start)
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                at = end + 3 if end >= 0 else size
            else:
                at = shut + 1
            continue
        name = NAME.match(page, start + 1)
        if name is None:
            text(at, start + 1)
            at = start + 1
            continue
        text(at, start)
        end = ATTRIBUTES.match(page, name.end()).end()
        end = end if end < size else page.find(">", name.end())
        more, at = page[name.end() : end], end + 1
        tag = name[2].lower()
        if name[1]:
            if i := find({tag}, set() if tag in SCOPES or tag in LISTS else SCOPES):
                close(i)
                if tag in BLOCKS:
                    stack[-1][1].items.append(None)
            continue
        if tag in RAW and not more.endswith("/"):
            end_tag = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end_tag.end() if end_tag else size
            continue
        if tag in VOID:
            stack[-1][1].items.append(" " if tag in ("br", "wbr") else None if tag == "hr" else "")
            continue
        if tag in BLOCKS:
            ends, stops = ENDS.get(tag, (set(), set()))
            if i := find(ends, stops):
                close(i)
            elif i := find({"p"}, SCOPES):
                close(i)
        if tag == "html":
            continue
        says, words, kind = _named(more) if "=" in more else (NO_NAME, frozenset(), "")
        linked += tag == "a"
        opened[tag] += 1
        if tag in BLOCKS or tag in DROPPED_TAGS or words:
            own = Node(tag, f"{tag}.{kind}" if kind else tag, says, words)
            stack[-1][1].items.append(own)
            stack[-1][1].kids.append(own)
            stack.append((tag, own))
        else:
            stack.append((tag, stack[-1][1]))
            if tag in BLOCKS:
                stack[-1][1].items.append(None)
        if more.endswith("/") and tag not in BLOCKS:
            close(len(stack) - 1)
    for node in preorder(root):
        own = [x for x in node.items if isinstance(x, str)]
        node.c = sum(map(len, own))
        if line := " ".join("".join(own).split()):
            node.t = hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()
    return root


def preorder(root: Node) -> list[Node]:
    """All nodes, each before its kids."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(reversed(node.kids))
    return out


def _kinds(node: Node) -> frozenset[str]:
    if node.kinds is None:
        node.kinds = frozenset(k.sig for k in node.kids)
    return node.kinds


def _alike(a: Node, b: Node) -> bool:
    """Whether two nodes of one signature have much the same kinds of kids."""
    x, y = _kinds(a), _kinds(b)
    return 2 * len(x & y) >= len(x | y)


def place(x: list[Node], y: list[Node]) -> list[int]:
    """For the nodes y of a page or wrapper the places of their partners among the nodes x of a wrapper, in order; -1 without one.

    The alignment has the most partners, weighed by whether they are alike and have the same text; a
    repeated node can have several.
    """
    if len(x) == len(y) and all(a.sig == b.sig for a, b in zip(x, y)):
        return list(range(len(y)))
    n, m, head = len(x), len(y), 0
    while head < min(n, m) and x[head].sig == y[head].sig and not x[head].rep and x[head].t == y[head].t and _alike(x[head], y[head]):
        head += 1
    if (n - head) * (m - head) > CELLS:  # too many for a table: the first of the signature that is still to come
        to, at = list(range(head)), head
        where: dict[str, list[int]] = {}
        for i in range(n - 1, head - 1, -1):
            where.setdefault(x[i].sig, []).append(i)
        for b in y[head:]:
            found = where.get(b.sig, [])
            while found and found[-1] < at:
                found.pop()
            to.append(found[-1] if found else -1)
            if found:
                at = found[-1] + (not x[found[-1]].rep)
        return to
    width = m - head + 1
    best = [[0] * width for _ in range(n - head + 1)]
    for i in range(n - 1, head - 1, -1):
        row, below = best[i - head], best[i - head + 1]
        a = x[i]
        for j in range(m - 1, head - 1, -1):
            got = below[j - head] if below[j - head] >= row[j - head + 1] else row[j - head + 1]
            if a.sig == y[j].sig:
                worth = 2 + 2 * _alike(a, y[j]) + (a.t == y[j].t)
                got = max(got, worth + below[j - head + 1], worth + row[j - head + 1] if a.rep else 0)
            row[j - head] = got
    to, i, j = list(range(head)), head, head
    while j < m:
        if i == n:
            to.append(-1)
            j += 1
            continue
        a, here = x[i], best[i - head][j - head]
        worth = 2 + 2 * _alike(a, y[j]) + (a.t == y[j].t) if a.sig == y[j].sig else 0
        if worth and a.rep and here == worth + best[i - head][j - head + 1]:
            to.append(i)
            j += 1
        elif worth and here == worth + best[i - head + 1][j - head + 1]:
            to.append(i)
            i, j = i + 1, j + 1
        elif here == best[i - head + 1][j - head]:
            i += 1
        else:
            to.append(-1)
            j += 1
    return to


def merge(a: Node, b: Node) -> Node:
    """Make the wrapper a one of all pages that a or b is a wrapper of (b is used up)."""
    todo = [(a, b)]
    while todo:
        a_, b_ = todo.pop()
        _meet(a_, b_, todo)
    return a


def _meet(a: Node, b: Node, todo: list[tuple[Node, Node]]) -> None:
    a.n, a.c, a.l = a.n + b.n, a.c + b.c, a.l + b.l
    a.rep, a.opt, a.group = a.rep or b.rep, a.opt or b.opt, a.group or b.group
    if a.t != b.t:
        a.t = None
    joined: list[tuple[Node, Node]] = []  # of one page's kids, that are one repeated node
    pairs: list[tuple[Node, Node]] = []
    x, y = _runs(a.kids, joined), _runs(b.kids, joined)
    out: list[Node] = []
    if not a.group:
        to, i = place(x, y), 0
        for j, own in enumerate(y):
            if to[j] >= 0:
                lost, partner = x[i : to[j]], x[to[j]]
                while lost and lost[-1].sig == partner.sig and _alike(lost[-1], partner):
                    partner.rep = True
                    joined.append((partner, lost.pop()))
                for k in lost:
                    _spare(k, out, joined, a)
                if to[j] >= i:
                    out.append(x[to[j]])
                    i = to[j] + 1
                else:
                    x[to[j]].rep = True
                pairs.append((x[to[j]], own))
            else:
                after = x[to[j + 1]] if j + 1 < len(y) and to[j + 1] >= 0 else None
                if after is not None and after.sig == own.sig and _alike(after, own):
                    after.rep = True
                    pairs.append((after, own))
                else:
                    _spare(own, out, joined, a)
        for k in x[i:]:
            _spare(k, out, joined, a)
        a.group = len(out) > KIDS or a.group
    else:
        out = x + y
        for k in out:
            k.opt = True
    if a.group:
        first: dict[str, Node] = {}
        for k in out:
            if (seen := first.setdefault(k.sig, k)) is not k:
                seen.rep = True
                joined.append((seen, k))
        out = list(first.values())
    a.kids, a.kinds = out, None
    to_node: dict[int, Node] = {id(k): node for node, k in [*joined, *pairs]}

    def whole(node: Node) -> Node:
        while id(node) in to_node:
            node = to_node[id(node)]
        return node

    todo.extend((whole(node), k) for node, k in [*joined, *pairs])


def _runs(kids: list[Node], joined: list[tuple[Node, Node]]) -> list[Node]:
    """Kids with a long run of adjacent equal ones, or one beside a repeated one, as one repeated node."""
    out: list[Node] = []
    i = 0
    while i < len(kids):
        j = i + 1
        while j < len(kids) and kids[j].sig == kids[i].sig:
            j += 1
        run = kids[i:j]
        if len(run) > RUN or (len(run) > 1 and any(k.rep for k in run)):
            run[0].rep = True
            joined.extend((run[0], k) for k in run[1:])
            run = run[:1]
        out += run
        i = j
    return out


def _spare(own: Node, out: list[Node], joined: list[tuple[Node, Node]], parent: Node) -> None:
    """A node without a partner: it repeats the node before it, or shows a repeated group, or is optional."""
    if out and out[-1].sig == own.sig and _alike(out[-1], own):
        out[-1].rep = True
        joined.append((out[-1], own))
        return
    if not parent.group and (len(out) >= KIDS or any(k.sig == own.sig and _alike(k, own) for k in out)):
        parent.group = True
    own.opt = True
    out.append(own)


def prune(root: Node) -> None:
    """Forget nodes that fewer than a quarter of the pages have, if there are many."""
    if len(preorder(root)) > NODES:
        for node in preorder(root):
            node.kids, node.kinds = [k for k in node.kids if 4 * k.n >= root.n], None


class Wrapper:
    """The wrapper of some pages: its nodes, and hashes of the first SEEN different pages."""

    def __init__(self, root: Node, seen: set[str]):
        self.root, self.seen = root, seen

    def add(self, other: Wrapper) -> Wrapper:
        merge(self.root, other.root)
        prune(self.root)
        self.seen = set(sorted(self.seen | other.seen)[:SEEN])
        return self

    def dumps(self) -> str:
        return json.dumps([sorted(self.seen), [[k.sig, len(k.kids), k.n, k.c, k.l, k.t, k.rep | k.opt << 1 | k.group << 2] for k in preorder(self.root)]])

    @staticmethod
    def loads(text: str) -> Wrapper:
        seen, rows = json.loads(text)
        stack: list[tuple[Node, int]] = []
        root = None
        for sig, kids, n, c, l_, t, bits in rows:
            node = Node(sig.partition(".")[0], sig)
            node.n, node.c, node.l, node.t, node.rep, node.opt, node.group = n, c, l_, t, bool(bits & 1), bool(bits & 2), bool(bits & 4)
            while stack and not stack[-1][1]:
                stack.pop()
            if stack:
                parent, left = stack.pop()
                parent.kids.append(node)
                stack.append((parent, left - 1))
            root = root or node
            stack.append((node, kids))
        return Wrapper(root, set(seen))


def wrapper_of(page: str) -> Wrapper:
    """The wrapper that has one page."""
    root = parse(page)
    for node in preorder(root):
        node.items = []
    return Wrapper(root, {hashlib.blake2b(page.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()})


def infer(pages: list[str]) -> Wrapper:
    return functools.reduce(Wrapper.add, map(wrapper_of, pages))


def expression(node: Node) -> str:
    """A wrapper as a union-free regular expression over tags and text (#TEXT is a slot, other texts are their hashes)."""
    inner = "".join(f"({expression(k)}){'+' if k.rep else ''}{'?' if k.opt else ''}" for k in node.kids)
    return f"<{node.sig}>{'#TEXT' if node.t is None else node.t}{f'({inner})+' if node.group else inner}</{node.sig}>"


def judge(wrapper: Wrapper) -> Wrapper:
    """Set the flags of a wrapper's nodes: SAME if all of their text is the same in nearly all pages, LINKED if most is links.

    Text is the same only if LEAST_PAGES different pages or more have it; and FIXED too, unless the same
    texts together are the larger part of the pages: copies of one page and pages with one long text
    have no fixed text.
    """
    nodes, root = preorder(wrapper.root), wrapper.root
    whole: dict[int, tuple[int, int, bool]] = {}
    for node in reversed(nodes):
        c, l_ = node.c, node.l
        same = not node.c or node.t == "" or (node.t is not None and not node.rep and 10 * node.n >= 9 * root.n)
        for k in node.kids:
            kc, kl, ks = whole[id(k)]
            c, l_, same = c + kc, l_ + kl, same and (ks or not kc)
        whole[id(node)] = c, l_, same
        node.flag = LINKED if c and 10 * l_ >= 7 * c and node.tag not in UNLINKED else 0
    if len(wrapper.seen) >= LEAST_PAGES:
        fixed = sum(k.c for k in nodes if k.t and not k.rep and 10 * k.n >= 9 * root.n)
        flag = SAME | FIXED if 2 * fixed <= whole[id(root)][0] else SAME
        for node in nodes:
            c, _, same = whole[id(node)]
            if c and same and node is not root:
                node.flag |= flag
    return wrapper


def rule_of(wrapper: Wrapper) -> str:
    """What extraction needs of a judged wrapper: the nodes that half of the pages have."""
    judge(wrapper)
    stack = [wrapper.root]
    while stack:
        node = stack.pop()
        node.kids = [k for k in node.kids if 2 * k.n >= wrapper.root.n]
        stack.extend(node.kids)
    return json.dumps([[k.sig, len(k.kids), k.t or "", k.rep | k.group << 1 | k.flag << 2] for k in preorder(wrapper.root)])


@functools.lru_cache(256)
def _rule(text: str) -> Node:
    rows = json.loads(text)
    root, stack = None, []
    for sig, kids, t, bits in rows:
        node = Node(sig.partition(".")[0], sig)
        node.t, node.rep, node.group, node.flag = t, bool(bits & 1), bool(bits & 2), bits >> 2
        while stack and not stack[-1][1]:
            stack.pop()
        if stack:
            stack[-1][1] -= 1
            stack[-1][0].kids.append(node)
        root = root or node
        stack.append([node, kids])
    return root


def _dropped(e: Node, inside: bool) -> bool:
    """Whether an element is left out by its tag and names. Inside the main element only whole names in class or role count."""
    if e.tag in ("article", "main", "body", "html"):
        return e.tag == "article" and e.says == WHOLE and bool(e.words & COMMENT_WORDS)
    if e.tag in DROPPED_TAGS or e.tag == "header" and not inside:
        return True
    if inside:
        plain = PLAIN_IN_TEXT if e.tag in HEADINGS or e.tag in ("p", "blockquote", "pre") else {"search"} if e.tag in TEXT_TAGS else set()
        return e.says == WHOLE and bool(e.words & DROPPED_WORDS - PLAIN_WORDS - plain)
    if e.words & LAYOUT_WORDS:  # "no-sidebar" and the like say what a page looks like
        return False
    if e.says:
        return not (e.says == ANCHOR and e.tag in TEXT_TAGS)
    return "header" in e.words and not e.words & OWN_HEADER


def _flags(root: Node, rule: Node) -> None:
    """Give a page's nodes the flags of their partners in a rule."""
    todo = [(root, rule)]
    while todo:
        e, w = todo.pop()
        if not e.kids or not w.kids:
            continue
        if w.group:
            of = {k.sig: k for k in w.kids}
            found = [(k, of.get(k.sig)) for k in e.kids]
        else:
            found = [(k, w.kids[i] if i >= 0 else None) for k, i in zip(e.kids, place(w.kids, e.kids))]
        for k, partner in found:
            if partner is not None:
                k.flag = partner.flag
                todo.append((k, partner))


def _mains(root: Node) -> list[Node]:
    """The main elements of a page: its outermost articles, or a main element or one of that name that has far more text.

    They stand outside of dropped elements, or else in one that only a name (not of comments) drops. An
    article that is mostly links leads elsewhere, if there are others.
    """
    size: dict[int, tuple[int, int]] = {}
    for node in reversed(preorder(root)):
        kids = [size[id(k)] for k in node.kids]
        size[id(node)] = node.c + sum(c for c, _ in kids), node.l + sum(l_ for _, l_ in kids)
    for lenient in (False, True):
        found: dict[str, list[Node]] = {"article": [], "main": [], "named": []}
        stack = [(root, False, False, False)]
        while stack:
            e, in_article, in_main, in_named = stack.pop()
            inside = in_article or in_main
            if _dropped(e, inside) and not (lenient and e.says and e.tag not in DROPPED_TAGS and e.tag != "header" and not e.words & COMMENT_WORDS):
                continue
            if e.tag == "article":
                if not in_article:
                    found["article"].append(e)
                in_article = True
            elif e.tag == "main":
                if not in_main:
                    found["main"].append(e)
                in_main = True
            elif e.words and (e.words & MAIN_WORDS or "".join(sorted(e.words)) in MAIN_WORDS or {"article", "body"} <= e.words):
                if not in_named:
                    found["named"].append(e)
                in_named = True
            stack.extend((k, in_article, in_main, in_named) for k in reversed(e.kids))
        told = [e for e in found["article"] if size[id(e)][1] * 10 < size[id(e)][0] * 7]
        found["article"] = told or found["article"]
        held = {k: sum(size[id(e)][0] for e in v) for k, v in found.items()}
        if most := max(held.values()):
            if 5 * held["article"] >= most:
                return found["article"]
            return found["main"] if 5 * held["main"] >= most else found["named"]
    return []


def _free_headings(root: Node) -> None:
    """A heading that is the same in all pages stays if the texts before and after it stay (other such headings aside)."""
    order: list[tuple[Node, bool, bool]] = []  # elements with text of their own: whether one stays, whether it is such a heading
    stack = [(root, True)]
    while stack:
        e, stays = stack.pop()
        common = stays and e.tag in HEADINGS and e.flag & (FIXED | LINKED) == FIXED and not _dropped(e, False)
        stays = stays and (e is root or not _left_out(e, False, False))
        if e.t:
            order.append((e, stays, common))
        stack.extend((k, stays or common) for k in reversed(e.kids))
    after, free = False, []
    for e, stays, common in reversed(order):
        if common:
            free.append((e, after))
        else:
            after = stays
    before, waiting = False, dict((id(e), ok) for e, ok in free)
    for e, stays, common in order:
        if not common:
            before = stays
        elif before and waiting[id(e)]:
            e.flag = 0


def text_of(root: Node, rule: Node | None) -> str:
    """The main text of a page: of its main elements, or else of all that isn't dropped and isn't template."""
    if rule is not None:
        _flags(root, rule)
    mains = _mains(root)
    if not mains:
        _free_headings(root)
    text = _blocks(mains, True) if mains else _blocks([root], False)
    return text if text or mains else _blocks([root], False, lenient=True)


def _blocks(mains: list[Node], inside: bool, lenient: bool = False) -> str:
    """Blocks of text of some elements, in page order. Lenient: names (but those of comments) and flags don't count."""
    blocks: list[str] = []
    line: list[str] = []

    def end() -> None:
        if got := " ".join(html.unescape("".join(line)).split()):
            blocks.append(got)
        line.clear()

    for main in mains:
        own_inside = inside or main.tag in ("article", "main")
        stack: list = [(iter(main.items), own_inside, True)]
        while stack:
            items, within, block = stack[-1]
            for x in items:
                if x is None:
                    end()
                elif isinstance(x, str):
                    line.append(x)
                else:
                    blocky = x.tag in BLOCKS
                    if blocky:
                        end()
                    if not _left_out(x, within, lenient):
                        stack.append((iter(x.items), within or x.tag in ("article", "main"), blocky))
                        break
            else:
                stack.pop()
                if block:
                    end()
    return "\n".join(blocks)


def _left_out(e: Node, inside: bool, lenient: bool) -> bool:
    if lenient:
        return e.tag in DROPPED_TAGS or e.tag == "header" or bool(e.words & COMMENT_WORDS)
    if _dropped(e, inside):
        return True
    if inside:
        return bool(e.flag) and e.says in (NAMED, WHOLE, ANCHOR) and not e.words & LAYOUT_WORDS and not (e.says == ANCHOR and e.tag in TEXT_TAGS)
    return bool(e.flag & (FIXED | LINKED))


def extract_page(page: str, rule: str | None = None) -> str:
    """The main text of a page under the rule of its host; without one, under its own."""
    return text_of(parse(page), _rule(rule if rule is not None else rule_of(wrapper_of(page))))


def wrappers(pages: DataFrame, parts: int) -> DataFrame:
    """Wrapper of each host from all its pages (host, html): host, wrapper (JSON).

    Pages are aligned slice by slice, then the partial wrappers of a host, FAN_IN or so at a time, in as
    many levels as there are powers of FAN_IN in the number of partitions. A wrapper has the size of a
    few pages (see NODES), so a host with a third of all pages is no burden.
    """

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                made: dict[str, Wrapper] = {}
                some = batch.slice(at, SLICE)
                for host, page in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    one = wrapper_of(page)
                    made[host] = made[host].add(one) if host in made else one
                part = pa.array([TaskContext.get().partitionId()] * len(made), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.string()), part, pa.array([w.dumps() for w in made.values()], pa.string())], ["host", "part", "wrapper"])

    def meet(group: pa.Table) -> pa.Table:
        whole = functools.reduce(Wrapper.add, map(Wrapper.loads, sorted(group.column("wrapper").to_pylist())))
        return pa.table({"host": group.column("host").slice(0, 1), "part": group.column("part").slice(0, 1), "wrapper": [whole.dumps()]})

    schema = "host string, part long, wrapper string"
    found, groups = pages.select("host", "html").mapInArrow(learn, schema), 1
    levels = []
    while groups < parts:
        levels.append(groups)
        groups *= FAN_IN
    for groups in reversed(levels):
        found = found.withColumn("part", F.pmod(F.xxhash64("part"), F.lit(groups))).groupBy("host", "part").applyInArrow(meet, schema)
    return found.select("host", "wrapper")


def extract(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """Main text of pages (page_id, url, html): page_id, url, text.

    A null html is empty and gives an empty text; pages without a host in their url share one wrapper.
    Repeated rows have each their row; an empty table gives none. A host's rule goes once to each
    of the places its pages are dealt to, ahead of them, so that no group of pages is held.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col("url").cast("string"), r"^[A-Za-z][\w+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))
    plain = pages.select("page_id", "url", host.alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    parts = plain.rdd.getNumPartitions()  # known from the plan of a scan
    plain = plain.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(max(LEAST_SALTS, parts // 4))))
    kinds = dict(plain.dtypes)

    def ruled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([rule_of(Wrapper.loads(w)) for w in batch.column(1).to_pylist()], pa.string())], ["host", "rule"])

    found = scratch.settle(wrappers(plain, parts).mapInArrow(ruled, "host string, rule string"), "rules")
    ahead = plain.select("host", "salt").distinct().join(found, "host")
    none = [F.lit(None).cast(kinds[c]).alias(c) for c in ("page_id", "url")]
    rows = ahead.select("host", "salt", F.lit(0).alias("nth"), *none, F.col("rule").alias("html")).union(plain.select("host", "salt", F.lit(1), "page_id", "url", "html"))
    dealt = rows.repartition("host", "salt").sortWithinPartitions("host", "salt", "nth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule = None
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                some = batch.slice(at, SLICE)
                text, own = [], []
                for k, (nth, page) in enumerate(zip(some.column(0).to_pylist(), some.column(3).to_pylist())):
                    if nth:
                        text.append(extract_page(page, rule))
                        own.append(k)
                    else:
                        rule = page
                own = pa.array(own, pa.int64())
                yield pa.RecordBatch.from_arrays([some.column(1).take(own), some.column(2).take(own), pa.array(text, pa.string())], ["page_id", "url", "text"])

    return dealt.select("nth", "page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages"), Scratch(spark, "op7"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
