"""Main text of web pages by wrappers: union-free regular expressions inferred per host."""

from __future__ import annotations

import hashlib
import html
import html.entities
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import settled, slices

#: Forms of pages, or wrappers made of those, that one step aligns; a host with more of them takes several rounds.
FORMS = 32
#: A text is on all of a host's pages if it is on this share of them: pages that are cut off or empty lack what others have.
ALL = 0.9
#: Weights that a task holds before it hands them on.
HELD = 1 << 16
#: Elements nested deeper than this stand beside each other; menus and the like, deeper than twice this.
DEPTH = 128
#: A text the same on all of so many different pages is the host's own; what a slot weighs if no page was read.
SAME, SLOT = 3, 40
#: Cells of the table that aligns two sequences; longer sequences are first cut at keys that both hold once.
CELLS = 1 << 20
#: Wrappers are broadcast while they are no larger than this together; beyond it they are joined by host.
BROADCAST_BYTES = 16 << 20

# Element names of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg object".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
FORMULA = frozenset("math merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
CHROME = frozenset("head nav footer aside form button select option menu dialog fieldset input script style noscript template iframe textarea title svg object annotation annotation-xml".split())
#: Roles of accessible pages that say the same as such element names.
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
CHROME_WORDS = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead comment comments disqus respond reply replies notice notices cookie cookies consent newsletter subscribe signup login share sharing social related recommended popup modal overlay widget toolbar pagination pager copyright disclaimer complementary contentinfo search".split())
#: Of those, the ones of discussions, which grow with readers and not with the article.
COMMENT_WORDS = frozenset("comment comments disqus respond reply replies".split())
#: Words that may stand beside those in one class ("comment-list", "ad-box"); with any other word ("related-work", "no-sidebar") a class says nothing.
PLAIN_WORDS = frozenset("list area box section container wrapper wrap bar block item items left right top bottom main primary secondary site page post inner outer links link form button buttons text title header head thread body group panel row col column slot unit zone region".split())
MAIN = frozenset("article main".split())
#: Elements that hold a page's text whatever their class says.
NEVER_MARKED = frozenset("html body article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that may hold the whole main text and are looked into; all others stand in it.
CONTAINERS = frozenset("root html body div section center table tbody tr td main article".split())
#: Names of references that a page may end within: those that need no semicolon, and typographic ones.
REFERENCES = frozenset(n for n in html.entities.html5 if not n.endswith(";")) | frozenset("apos bull euro hellip ldquo lsquo mdash ndash rdquo rsquo trade".split())
CLOSED_BY = {"p": frozenset("p".split()), "li": frozenset("li p".split()), "dt": frozenset("dt dd p".split()), "dd": frozenset("dt dd p".split()), "tr": frozenset("tr td th p".split()), "td": frozenset("td th p".split()), "th": frozenset("td th p".split())}
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
SCOPES = frozenset("article aside body div footer form header html main nav ol section table td th ul".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^\s<>/]*(?:\"[^\"]*\"|'[^']*'|[^'\"<>])*(?:>|\Z|(?=<))", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s<>/]*)")
MARK = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
ROLE = re.compile(r"\brole\s*=\s*[\"']?\s*([a-z]+)", re.I)
WORDS = re.compile(r"[a-z]+")
NAMES = re.compile(r"[a-z]+(?:\d\d?(?!\d))?")
CUT_REFERENCE = re.compile(r"&(#\w{0,31}|[A-Za-z]\w{1,30})\Z")


class Node:
    """An element (``key`` = its name and what its attributes say of its part) or, with key "#", a run of text.

    ``chrome``: its name or role says that it holds no main text; ``marked``: only
    class words hint at that. ``linked``: characters of a text that stand in links.
    """

    __slots__ = ("chrome", "key", "kids", "linked", "marked", "name", "text")

    def __init__(self, key: str, name: str = "", chrome: bool = False, text: str = "", marked: bool = False, linked: int = 0):
        self.key, self.name, self.chrome, self.text, self.marked, self.linked, self.kids = key, name, chrome, text, marked, linked, []


@lru_cache(maxsize=4096)
def _opening(tag: str) -> tuple[str, str, bool, bool]:
    """(name, key, chrome by name or role, marked by class words) of an opening tag.

    A class is a hint only if all its words are chrome words or plain ones. The key is the
    name, followed by "~" for chrome by role, or by "!" or "." and words.
    """
    name = NAME.match(tag)[1].lower()
    if name in INLINE or name in FORMULA or name in NEVER_MARKED:
        return name, name, False, False
    if name in CHROME:
        return name, name, True, False
    role = ROLE.search(tag)
    if role and role[1].lower() in ROLES:
        return name, f"{name}~{role[1].lower()}", True, False
    classes = [WORDS.findall(c) for m in MARK.finditer(tag) for c in (m[1] or m[2] or m[3] or "").lower().split()]
    words = sorted({w for m in MARK.finditer(tag) for w in NAMES.findall((m[1] or m[2] or m[3] or "").lower())})
    marks = sorted({w for c in classes if all(w in CHROME_WORDS or w in PLAIN_WORDS for w in c) for w in c if w in CHROME_WORDS})
    return name, name + ("!" + ".".join(marks) if marks else "".join(f".{w}" for w in words[:2])), False, bool(marks)


def _cut_end(text: str) -> str:
    """The text without a reference that it ends within."""
    m = CUT_REFERENCE.search(text)
    if m and (m[1][0] == "#" or m[1] not in REFERENCES and any(n.startswith(m[1]) for n in REFERENCES)):
        return text[: m.start()]
    return text


def tree(page: str) -> Node:
    """The page's token stream, nested by its tags. Unclosed and stray tags are borne; markup that is cut off is dropped."""
    root = Node("root", "root")
    stack, at, end = [root], 0, len(page)
    flat: Counter[str] = Counter()  # open elements that were not nested

    def add(text: str) -> None:
        if text:
            text, kids = html.unescape(text), stack[-1].kids
            if kids and kids[-1].key == "#":
                kids[-1].text += text
            else:
                kids.append(Node("#", text=text))

    for m in iter(lambda: TOKEN.search(page, at), None):
        add(page[at : m.start()])
        at = m.end()
        tag = m[0]
        if tag[1] in "!?":
            continue
        if tag[1] == "/":
            name = NAME.match(tag)[1].lower()
            if flat[name]:
                flat[name] -= 1
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    del stack[i:]
                    break
                if stack[i].name in SCOPES and name not in SCOPES:
                    break
            continue
        name, key, chrome, marked = _opening(tag)
        closing = CLOSED_BY.get(name) or (CLOSED_BY["p"] if name in CLOSES_P else ())
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in closing:
                    del stack[i:]
                    break
                if not _inline(stack[i]):
                    break
        node = Node(key, name, chrome, marked=marked)
        stack[-1].kids.append(node)
        if name in RAW and not (name == "svg" and tag.endswith("/>")):
            close = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else end
        elif name not in VOID and not tag.endswith("/>"):
            if len(stack) < (2 * DEPTH if chrome else DEPTH):
                stack.append(node)
            else:
                flat[name] += 1
    add(_cut_end(page[at:]))
    return root


def _inline(node: Node) -> bool:
    return node.name in INLINE or node.name in FORMULA


def structural(node: Node, link: bool = False) -> list[Node]:
    """A node's kids for the wrapper: elements that stand as blocks, and one text for each run of text and inline markup."""
    out: list[Node] = []
    for kid in node.kids:
        if kid.key != "#" and not _inline(kid):
            out.append(kid)
            continue
        inside = [kid] if kid.key == "#" else structural(kid, link or kid.name == "a")
        for k in inside:
            if k.key != "#":
                out.append(k)
            elif k.text.strip():
                linked = k.linked if kid.key != "#" else len(k.text.strip()) * link
                if out and out[-1].key == "#":
                    out[-1] = Node("#", text=out[-1].text + k.text, linked=out[-1].linked + linked)
                else:
                    out.append(Node("#", text=k.text, linked=linked))
    return out


# A wrapper is a list of items [key, optional, repeated, inner]: inner is a wrapper for an element or a
# group (key "()"), and for text (key "#") the fixed text, or None for a slot.


def sign(item: list) -> tuple[str, frozenset]:
    """What items are compared by: the key, and the keys inside of what may hold anything."""
    holds = item[0] != "#" and re.split(r"[.!~]", item[0])[0] in CONTAINERS
    return item[0], frozenset(x[0] for x in item[3]) if holds else frozenset()


def likeness(x: tuple[str, frozenset], y: tuple[str, frozenset]) -> float:
    """0 for items of different forms; otherwise 1 to 2."""
    if x[0] != y[0]:
        return 0
    if x[1] == y[1]:
        return 2
    shared = len(x[1] & y[1]) / len(x[1] | y[1])
    return 1 + shared if shared else 0


def fold(items: list[list]) -> list[list]:
    """Neighbours of one form become one repeated item; a sequence that repeats becomes a repeated group."""
    out: list[list] = []
    for item in items:
        if out and item[0] != "#" and likeness(sign(out[-1]), sign(item)) >= 1.5:
            both = align(out[-1][3], item[3])
            out[-1] = [item[0], False, True, both]
        else:
            out.append(item)
    for period in (2, 3, 4):
        i = 0
        while i + 2 * period <= len(out):
            keys = [x[0] for x in out[i : i + period]]
            n = 1
            while all(likeness(sign(x), sign(y)) >= 1.5 for x, y in zip(out[i : i + period], out[i + n * period : i + (n + 1) * period], strict=False)) and i + (n + 1) * period <= len(out):
                n += 1
            if n > 1 and "()" not in keys:
                inner = out[i : i + period]
                for k in range(1, n):
                    inner = align(inner, out[i + k * period : i + (k + 1) * period])
                out[i : i + n * period] = [["()", False, True, inner]]
            i += 1
    return out


def wrapper(node: Node) -> list[list]:
    """The wrapper of one page's element: its own token stream, folded."""
    return fold([["#", False, False, " ".join(k.text.split())] if k.key == "#" else [k.key, False, False, [] if k.chrome else wrapper(k)] for k in structural(node)])


def align(a: list[list], b: list[list]) -> list[list]:
    """One wrapper for what either matches. Texts that differ become slots, items of one side optional."""
    pairs = common([sign(x) for x in a], [sign(x) for x in b])
    out, i, j = [], 0, 0
    for p, q in [*pairs, (len(a), len(b))]:
        out += [[x[0], True, x[2], x[3]] for x in (*a[i:p], *b[j:q])]
        if p < len(a) and q < len(b):
            x, y = a[p], b[q]
            inner = (x[3] if x[3] == y[3] else None) if x[0] == "#" else align(x[3], y[3])
            out.append([x[0], x[1] or y[1], x[2] or y[2], inner])
        i, j = p + 1, q + 1
    return fold(out) if any(x[0] == y[0] != "#" for x, y in zip(out, out[1:], strict=False)) else out


def common(a: list[tuple], b: list[tuple]) -> list[tuple[int, int]]:
    """Index pairs that align two sequences of signs: the likest ones in order. A shared start and end are matched first.

    Signs that both hold once anchor long sequences, as long as they come in one
    order. Between anchors too far apart for a table, each sign takes its next place.
    """
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    stop = 0
    while stop < min(len(a), len(b)) - start and a[-1 - stop] == b[-1 - stop]:
        stop += 1
    x, y = a[start : len(a) - stop], b[start : len(b) - stop]
    out, i, j = [(k, k) for k in range(start)], 0, 0
    for p, q in [*(_anchors(x, y) if len(x) * len(y) > CELLS else []), (len(x), len(y))]:
        out += [(start + i + u, start + j + v) for u, v in (_likest if (p - i) * (q - j) <= CELLS else _next)(x[i:p], y[j:q])]
        if p < len(x):
            out.append((start + p, start + q))
        i, j = p + 1, q + 1
    return out + [(len(a) - k, len(b) - k) for k in range(stop, 0, -1)]


def _anchors(x: list[tuple], y: list[tuple]) -> list[tuple[int, int]]:
    """Signs that both hold once: the longest part of them that comes in the same order in both."""
    n, m = Counter(x), Counter(y)
    at = {k: j for j, k in enumerate(y)}
    pairs = [(i, at[k]) for i, k in enumerate(x) if n[k] == 1 == m[k]]
    ends: list[int] = []
    last: list[int] = []
    before = [-1] * len(pairs)
    for t, (_, j) in enumerate(pairs):
        spot = bisect_left(ends, j)
        before[t] = last[spot - 1] if spot else -1
        ends[spot : spot + 1], last[spot : spot + 1] = [j], [t]
    out, t = [], last[-1] if last else -1
    while t >= 0:
        out.append(pairs[t])
        t = before[t]
    return out[::-1]


def _next(x: list[tuple], y: list[tuple]) -> list[tuple[int, int]]:
    places: dict[tuple, list[int]] = {}
    for j, k in enumerate(y):
        places.setdefault(k, []).append(j)
    out, j = [], 0
    for i, k in enumerate(x):
        spots = places.get(k, [])
        spot = bisect_left(spots, j)
        if spot < len(spots) and spots[spot] - j <= 64:
            out.append((i, spots[spot]))
            j = spots[spot] + 1
    return out


def _likest(x: list[tuple], y: list[tuple]) -> list[tuple[int, int]]:
    like = [[likeness(u, v) for v in y] for u in x]
    best = [[0.0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + like[i][j])
    out, i, j = [], 0, 0
    while i < len(x) and j < len(y):
        if like[i][j] and best[i][j] == best[i + 1][j + 1] + like[i][j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def infer(pages: list[str]) -> list[list]:
    """A host's wrapper: the first page's, then aligned with one page after another."""
    made: list[list] = []
    for n, page in enumerate(pages):
        own = wrapper(tree(page))
        made = align(made, own) if n else own
    return made


def mark(text: str) -> str:
    """What a text is compared by: 128 bits of it."""
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


# What a wrapper says of its elements.
OFF, PATH, KEEP = 0, 1, 2


class Part:
    """A wrapper's item with what its texts weigh: ``mass`` counts characters outside links that differ from page to page."""

    __slots__ = ("comments", "constant", "fixed", "hidden", "inner", "key", "label", "links", "marked", "mass", "name", "off", "repeated")

    def __init__(self, item: list, masses: Iterator[list] | None, pages: int, optional: bool = False):
        self.key, maybe, self.repeated, inner = item
        optional = optional or maybe  # not on every page, so nothing says that its texts are the same on all
        chars, linked, *counted = next(masses) if masses else (0, 0)
        same = mark(inner) if self.key == "#" and inner is not None else None
        if counted:  # over all pages, which tell more than the wrapper's form
            optional, same = not counted[0], counted[1]
        self.name = re.split(r"[.!~]", self.key)[0]
        self.off, self.marked, self.label = self.name in CHROME or "~" in self.key, "!" in self.key, OFF
        self.comments = self.marked and not COMMENT_WORDS.isdisjoint(self.key.partition("!")[2].split("."))
        self.fixed, self.inner = None, []
        if self.key == "#":
            if not masses:
                chars = len(inner) if inner is not None else SLOT
            self.fixed = same
            self.constant = chars if same is not None and not optional and pages >= SAME else 0
            self.mass, self.links, self.hidden = chars - linked, linked, 0
        else:
            self.inner = [Part(x, masses, pages, optional) for x in inner]
            shown = [p for p in self.inner if not p.off]
            self.constant, self.links = sum(p.constant for p in shown), sum(p.links for p in shown)
            self.mass = sum(p.mass for p in shown if not p.marked)
            #: What stands under class words alone.
            self.hidden = sum(p.hidden + (p.mass if p.marked else 0) for p in shown)

    def flat(self) -> list[Part]:
        """The items inside, groups opened."""
        return [y for x in self.inner for y in (x.flat() if x.key == "()" else [x])]


def settle(root: Part, trusted: bool = True) -> None:
    """Labels a wrapper's elements: the regions of the main text KEEP, what leads to them PATH, all else OFF.

    The regions are the heavy article and main elements; without those, from the
    top, the container that holds nearly all mass is followed until it splits up.
    Texts that are the same on all pages weigh nothing, as long as others
    do not; class words only say where not to look first.
    """
    if root.mass > 2 * root.constant:
        _lighten(root)
    if not root.mass and root.hidden:
        _unmark(root)
    mains = _mains(root)
    if not mains and root.hidden and not root.mass:
        mains = _mains(root, True)
    most = max((p.mass for p in mains), default=0)
    chosen = [p for p in mains if p.mass >= most / 5]
    if len(chosen) == 1 and chosen[0].name == "main":
        inside = [a for a in _mains(chosen[0]) if a.name == "article"]
        most = max((a.mass for a in inside), default=0)
        if 2 * sum(a.mass for a in inside) > chosen[0].mass:
            chosen = [a for a in inside if a.mass >= most / 5]
    chosen = chosen or [_heaviest(root)]
    for p in chosen:
        _keep(p, p.mass, _beside(p), top=p.name not in MAIN)
    _lead(root, {id(p) for p in chosen})


def _lighten(part: Part) -> None:
    for p in part.inner:
        _lighten(p)
    part.mass = (0 if part.constant else part.mass) if part.key == "#" else sum(p.mass for p in part.inner if not p.off and not p.marked)


def _unmark(part: Part) -> None:
    """Class words hide all there is, so they mean nothing here: of marked elements the heaviest are opened."""
    hidden = [p for p in part.inner if not p.off and (p.mass or p.hidden)]
    most = max((p.mass + p.hidden for p in hidden), default=0)
    for p in hidden:
        if p.marked and 2 * (p.mass + p.hidden) > most:
            p.marked = False
        if not p.marked and not p.mass:
            _unmark(p)
    part.mass = sum(p.mass for p in part.inner if not p.off and not p.marked)


def _mains(part: Part, marked: bool = False) -> list[Part]:
    """Outermost article and main elements with mass."""
    found = []
    for p in part.inner:
        if p.off or p.marked and not marked:
            continue
        if p.name in MAIN and p.mass:
            found.append(p)
        else:
            found += _mains(p, marked)
    return found


def _heaviest(part: Part) -> Part:
    while True:
        kids = [p for p in part.flat() if not p.off and not p.marked]
        rest = sum(p.mass for p in kids if p.name not in HEADINGS)
        best = max((p for p in kids if p.name in CONTAINERS and not p.repeated), key=lambda p: p.mass, default=None)
        if best is None or best.mass <= 0.7 * rest or not best.mass:
            return part
        part = best


def _keep(part: Part, whole: int, text: int, top: bool = False) -> None:
    """Labels what is inside a region of the weight ``whole``, of which ``text`` stands beside headings and marked elements.

    Readers' comments go however many there are, as long as there is text beside them;
    other marked elements go unless they hold half of the region. Blocks that are the same on all pages stay where they stand
    between the region's texts or have headings of their own; before and after all text they are the host's and go, and in a
    region that only its mass made one (``top``) so do blocks of nothing but links.
    """
    part.label = KEEP
    kids = part.flat()
    full = [i for i, p in enumerate(kids) if p.key != "#" and not p.off and not p.marked and p.name not in HEADINGS and _beside(p)]
    for i, p in enumerate(kids):
        if full and whole and not full[0] < i < full[-1] and not p.mass and p.key != "#" and p.name not in HEADINGS:
            p.off = p.off or bool(p.links and top) or bool(p.constant and not p.links and not any(x.name in HEADINGS for x in _parts(p)))
    for p in kids:
        if p.off or p.marked and (text if p.comments else 2 * (p.mass + p.hidden) <= whole):
            continue
        _keep(p, whole, text)


def _beside(part: Part) -> int:
    """What a region's texts weigh outside headings and marked elements."""
    return part.mass if part.key == "#" else sum(_beside(p) for p in part.inner if not p.off and not p.marked and p.name not in HEADINGS)


def _lead(part: Part, chosen: set[int]) -> bool:
    """Labels the way to the regions, and the headings beside it."""
    if id(part) in chosen:
        return True
    kids = part.flat()
    if any([_lead(p, chosen) for p in kids]):
        part.label = PATH
        for p in kids:
            if p.name in HEADINGS and (p.mass or p.links):
                _keep(p, 0, 0)
        return True
    return False


class Extractor:
    """Applies a host's wrapper to its pages."""

    def __init__(self, made: list[list] | None, pages: int = 1, masses: list[list] | None = None):
        self.known = made is not None
        self.root = Part(["root", False, False, made or []], iter([[0, 0], *masses]) if masses else None, pages)
        if self.known:
            settle(self.root)
        else:
            self.root.label = KEEP
        self.mains = any(p.name in MAIN and p.label == KEEP for p in _parts(self.root))

    def text(self, page: str) -> str:
        root = tree(page)
        found, missed = self._found(root)
        if self.known and missed > len(found):
            # The wrapper knows too little of this page; it is read by a wrapper of its own.
            own = wrapper(root)
            alone, missed = Extractor(own, 1, weigh(own, [root]))._found(root)
            found = alone if len(alone) > len(found) else found
        return found

    def _found(self, root: Node) -> tuple[str, int]:
        """The main text, and how many characters stand outside where the wrapper knows nothing."""
        blocks: list[list[str]] = [[]]
        missed = self._emit(root, self.root, blocks, self.root.label, False)
        whole = (" ".join("".join(b).split()) for b in blocks)
        return "\n".join(b for b in whole if b), missed

    def _emit(self, node: Node, part: Part | None, blocks: list[list[str]], label: int, main: bool) -> int:
        """Adds the main text under ``node``, which ``part`` matched."""
        kids = structural(node)
        of = {}
        fixed: set[str] = set()
        for kid, p in matched(kids, part.flat() if part else []):
            if kid.key != "#":
                of[id(kid)] = p
            elif p is not None and p.constant and p.label == OFF and mark(own := " ".join(kid.text.split())) == p.fixed:
                fixed.add(own)
        return sum(self._kid(kid, of, fixed, blocks, label, main) for kid in node.kids)

    def _kid(self, kid: Node, of: dict, fixed: set[str], blocks: list[list[str]], label: int, main: bool) -> int:
        if kid.key == "#":
            if label == KEEP and not (fixed and " ".join(kid.text.split()) in fixed):
                blocks[-1].append(kid.text)
            return 0
        if _inline(kid):
            if kid.name in ("br", "img", "wbr"):
                blocks[-1].append("" if kid.name == "wbr" else " ")
            return sum(self._kid(k, of, fixed, blocks, label, main) for k in kid.kids)
        if kid.chrome and not (kid.name == "header" and main):
            return 0
        part = of.get(id(kid))
        main = main or kid.name in MAIN
        if part is not None:
            inner = part.label
        elif label == KEEP:
            inner = KEEP if not (self.known and kid.marked) else OFF
        else:
            inner = OFF if kid.marked else KEEP if self.mains and kid.name in MAIN else PATH
        if inner == OFF:
            return 0
        blocks.append([])
        missed = self._emit(kid, part, blocks, inner, main)
        blocks.append([])
        if part is None and inner == PATH:
            missed += sum(len(" ".join(k.text.split())) - k.linked for k in structural(kid) if k.key == "#")
        return missed


def _parts(part: Part) -> Iterator[Part]:
    yield part
    for p in part.inner:
        yield from _parts(p)


def matched(kids: list[Node], items: list) -> list[tuple[Node, object]]:
    """Which item each kid is matched by: in order, repeated items as often as needed, and groups from their start again."""
    places: dict[str, list[int]] = {}
    for i, item in enumerate(items):
        places.setdefault(item.key, []).append(i)
    out, j = [], 0
    for kid in kids:
        spots, found = places.get(kid.key, []), None
        if spots:
            at = bisect_left(spots, j)
            if j and items[j - 1].repeated and items[j - 1].key == kid.key:
                found = j - 1
            else:
                found = spots[at] if at < len(spots) else spots[-1]
            j = found + 1
        out.append((kid, None if found is None else items[found]))
    return out


class _Item:
    """A wrapper's item by its place, for weighing."""

    __slots__ = ("inner", "key", "place", "repeated")

    def __init__(self, item: list, places: Iterator[int]):
        self.key, _, self.repeated, inner = item
        self.place = next(places)
        self.inner = [_Item(x, places) for x in inner] if self.key != "#" else []

    def flat(self) -> list[_Item]:
        return [y for x in self.inner for y in (x.flat() if x.key == "()" else [x])]


def texts_of(root: Node, top: _Item) -> Iterator[tuple[int, str, int]]:
    """(place, text, characters in links) of each text of a page that an item of its wrapper matches."""
    for kid, x in matched(structural(root), top.flat()):
        if x is None:
            continue
        if kid.key == "#":
            yield x.place, " ".join(kid.text.split()), kid.linked
        elif not kid.chrome:
            yield from texts_of(kid, x)


def weigh(made: list[list], roots: list[Node]) -> list[list[int]]:
    """For each item of a wrapper, in its order, characters of text on the pages, and of those the ones in links."""
    places = count()
    top = _Item(["root", False, False, made], places)
    masses = [[0, 0] for _ in range(next(places))]
    for root in roots:
        for place, text, linked in texts_of(root, top):
            masses[place][0] += len(text)
            masses[place][1] += linked
    return masses[1:]


@lru_cache(maxsize=512)
def _items(form: str) -> _Item:
    return _Item(["root", False, False, json.loads(form)], count())


@lru_cache(maxsize=512)
def _extractor(made: str | None) -> Extractor:
    return Extractor(*json.loads(made)) if made else Extractor(None)


def host(url: str) -> Column:
    """Host and port of a URL, lower-cased; the empty string if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)), F.lit(""))


def without_texts(items: list[list]) -> list[list]:
    """The form of a wrapper: what it says of elements alone."""
    return [[key, optional, repeated, None if key == "#" else without_texts(inner)] for key, optional, repeated, inner in items]


def _sized(df: DataFrame, size: Column) -> DataFrame:
    """``df``, a row a host, to be broadcast while it is small."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else df


def _forms(read: DataFrame) -> DataFrame:
    """host, form (JSON): the forms of all of a host's pages aligned to one.

    Pages of one form are one row, so what is aligned are different forms, the most
    frequent first, FORMS at a time; what comes of that is aligned in the next round. The
    rounds follow from hashes of the forms, so the order of rows and partitions does not matter.
    """

    def of_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            found = Counter((h, json.dumps(without_texts(wrapper(tree(x))))) for h, x in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True))
            yield pa.RecordBatch.from_pydict({"host": [h for h, _ in found], "form": [f for _, f in found], "n": list(found.values())}, pa.schema([("host", pa.string()), ("form", pa.string()), ("n", pa.int64())]))

    def merged(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group["n"].to_pylist(), group["form"].to_pylist(), strict=True), key=lambda r: (-r[0], r[1]))
        made = json.loads(rows[0][1])
        for _, form in rows[1:]:
            made = align(made, json.loads(form))
        return pa.table({"host": group["host"][:1].cast(pa.string()), "form": [json.dumps(made)], "n": pa.array([sum(n for n, _ in rows)], pa.int64())})

    schema = "host string, form string, n long"
    forms = settled(read.select("host", "html").mapInArrow(of_pages, schema).groupBy("host", "form").agg(F.sum("n").alias("n")), "forms")
    while True:
        parts = settled(forms.groupBy(F.col("host").alias("of")).agg(F.ceil(F.count(F.lit(1)) / FORMS).alias("parts")), "parts")
        most = parts.agg(F.max("parts")).first()[0] or 1
        dealt = forms.join(parts, F.col("host") == F.col("of")).select("host", F.pmod(F.xxhash64("form"), F.col("parts")).alias("part"), "form", "n")
        forms = settled(dealt.groupBy("host", "part").applyInArrow(merged, schema), "forms")
        if most == 1:
            return forms.select("host", "form")


def infer_wrappers(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(host, wrapper): one wrapper a host, as JSON, from all of its pages.

    All pages are read twice: for the host's form, and for what stands in each of the form's
    places: characters, those in links, whether there is one text on all pages. Tasks add that up by host and place, so no
    page leaves its task and a host with a third of all pages is no hot group.
    """
    read = pages.filter(F.col(page).isNotNull()).select(host(url).alias("host"), F.col(page).alias("html"))
    # Equal pages count once here: only pages that differ tell what is the same on all.
    counts = read.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.xxhash64("html")).alias("different"))
    known = _forms(read).withColumnRenamed("host", "of")
    known = _sized(known, F.length("form") + F.length("of"))

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list] = {}
        names = ["host", "place", "chars", "linked", "on", "least", "most"]

        def told() -> pa.RecordBatch:
            rows = [(*k, *v) for k, v in held.items()]
            held.clear()
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            kinds = [pa.string(), *[pa.int64()] * 4, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in slices(batches, "html"):
            for h, x, form in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "form")), strict=True):
                seen = set()
                for place, text, linked in texts_of(tree(x), _items(form)):
                    own, is_new = mark(text), place not in seen
                    seen.add(place)
                    at = held.get((h, place))
                    if at is None:
                        held[h, place] = [len(text), linked, 1, own, own]
                    else:
                        at[:] = at[0] + len(text), at[1] + linked, at[2] + is_new, min(at[3], own), max(at[4], own)
                if len(held) > HELD:
                    yield told()
        yield told()

    rows = read.join(known, F.col("host") == F.col("of")).select("host", "html", "form").mapInArrow(weights, "host string, place long, chars long, linked long, on long, least string, most string")
    sums = rows.groupBy("host", "place").agg(F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), F.sum("on").alias("on"), F.min("least").alias("least"), F.max("most").alias("most"))
    each = sums.groupBy(F.col("host").alias("weighed")).agg(F.collect_list(F.struct("place", "chars", "linked", "on", "least", "most")).alias("sums"))  # a wrapper's places
    every = known.join(counts, F.col("of") == F.col("host")).join(each, F.col("of") == F.col("weighed"), "left").select("of", "form", "n", "different", "sums")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for form, n, different, sums in zip(*(batch.column(c).to_pylist() for c in ("form", "n", "different", "sums")), strict=True):
                items, places = json.loads(form), count()
                _Item(["root", False, False, items], places)
                masses = [[0, 0, False, None] for _ in range(next(places))]
                for at in sums or []:
                    masses[at["place"]] = [at["chars"], at["linked"], at["on"] >= ALL * n, at["least"] if at["least"] == at["most"] else None]
                made.append(json.dumps([items, different, masses[1:]]))
            yield pa.RecordBatch.from_arrays([batch.column("of"), pa.array(made, pa.string())], names=["host", "wrapper"])

    return every.mapInArrow(put, "host string, wrapper string")


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """key, url, text, n_chars for every row of ``pages``.

    A wrapper is inferred per host from all of its pages: same-host token streams are
    aligned one after another, a text mismatch becomes a slot, a tag mismatch an
    optional or a repeated item or group. The wrapper then decides (``settle``):
    where the weight of the slots lies is the main text, texts that are the same on
    all pages are the host's own, and so is what stands beside the main text.
    Names of elements and roles (nav, footer, form, ...) count; class words only
    break ties. Applied to a page, it yields the blocks of the main text in page
    order, references decoded and white space collapsed, one per line. A page that
    its host's wrapper does not know is read by a wrapper of its own.

    Null and empty HTML give an empty text; pages without a URL or host share the
    wrapper of the empty host. Inside the main text what no wrapper item matches is
    kept. A very long page is held as text and tree in one task, alone. Repeated
    rows give equal rows. An empty table gives no row. Other columns are not looked at.
    """
    wrappers = settled(infer_wrappers(pages, key, url, page), "wrappers")
    known = _sized(wrappers.withColumnRenamed("host", "__host"), F.length("wrapper") + F.length("__host"))
    read = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.col(page).alias("body"), host(url).alias("host"))
    joined = read.join(known, F.col("host") == F.col("__host"), "left").select("k", "u", "body", "wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body"):
            found = [_extractor(w.as_py()).text(b.as_py()) if b.is_valid else "" for b, w in zip(batch.column("body"), batch.column("wrapper"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("u"), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=["k", "u", "text", "n_chars"])

    kinds = dict(read.dtypes)
    out = joined.mapInArrow(run, f"k {kinds['k']}, u {kinds['u']}, text string, n_chars long")
    return out.select(F.col("k").alias(key), F.col("u").alias(url), "text", "n_chars")
