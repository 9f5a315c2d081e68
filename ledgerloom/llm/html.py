"""Main text of web pages by wrapper induction: union-free regular expressions inferred per host.

A page becomes a stream of tokens (opening and closing tags of block elements, with the words of their class and id) and texts, held as nested groups: an element's
children are the stream between its tags. A host's wrapper starts as its first page; every further page is aligned with it, element by element, and each mismatch is
resolved without unions:

* text against other text: the place becomes a slot that varies;
* an element against one of the same kind with another class or id, neither of which occurs further on: the attributes become a slot, what they share stays;
* a stretch that repeats the one just matched, in the page or in the wrapper: the two are one repeated group;
* anything else: tokens on one side only become optional.

Wrappers of parts of a host are aligned with each other in the same way, so each task infers one for the pages it reads and those are
merged host by host, a few at a time; no group of pages ever meets in one task. Every page is taken up whole, however long it is.

The wrapper then tells which of its places hold main text. Text that is the same on all of `CONSTANT_PAGES` pages or more is template, wherever it stands, but for headings within
the article. The region is that of the article elements, where they hold text that varies; else the deepest container with most of the host's varying, unlinked
text. Navigation, headers and footers of the page, sidebars, forms, adverts and comments are told by their elements and roles, by their place outside that region, by being constant or mostly links;
the words of class and id decide only where this leaves it open: a few that name adverts, comments and calls to share or subscribe do so everywhere, others that name page furniture
only where the wrapper finds the element outside the region, constant or mostly links. Each page is aligned with its host's wrapper and yields its main places as blocks.

Defined results: a null or empty html gives the empty text; pages without a host in their url share one wrapper; repeated rows are
treated alike; a host with fewer than `CONSTANT_PAGES` pages, or of copies of one page, has no template text; unclosed, misnested and cut-off tags are tolerated: a button, list of options, picture
or the like that is never closed ends at the next block, a cut-off tag at the end is dropped; white space is as str.split() has it and
<br> is white space; an empty table gives an empty result; columns other than page_id, url and html are ignored, whatever their names.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left
from collections import Counter
from hashlib import blake2b

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Wrappers of a host are merged in groups of this many at a time.
MERGED = 16
#: Hosts whose wrappers a task holds at once; beyond that it passes them on and starts anew.
HELD_HOSTS = 2000
#: Broadcast bound for the table of wrappers, checked before use; a larger table is dealt out by host instead.
BROADCAST_BYTES = 32 << 20
#: Where wrappers are dealt out by host: pages that share one copy.
PAGES_A_COPY = 5000
#: A place of one constant text on at least this many pages is part of the template.
CONSTANT_PAGES = 5

# Element names of HTML by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript template iframe object svg canvas math select button textarea dialog audio video option optgroup".split())
HEAD = frozenset("title meta link script style base noscript template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
END_OPTIONAL = frozenset("p li dt dd tr td th thead tbody tfoot".split())
EXCLUDED_TAGS = frozenset("nav footer aside form menu".split())
EXCLUDED_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar form".split())
CONTAINERS = frozenset("html body div section main article center table tbody tr td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class and id that tell what is no part of an article even within it.
EXCLUDED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement adsense adbox promo promotion sponsor sponsored sponsors cookie cookies consent gdpr subscribe subscription newsletter "
    "share sharing social related recommended recommendations comment comments commentlist disqus replies respond".split()
)
#: Words that tell it only together with the wrapper: of what stands outside the region, is constant or holds mostly links.
FURNITURE_NAMES = frozenset(
    "nav navbar navigation menu menubar topbar breadcrumb breadcrumbs sidebar aside widget footer header masthead banner notice notices notification alert popup modal overlay "
    "signup login pagination pager toolbar search copyright legal disclaimer".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|textarea|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/a-zA-Z][^>]*(?:>|\Z)|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ATTR = re.compile(r"([a-zA-Z_:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAMES = re.compile(r"[a-z]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

VARIES = -1


class Node:
    """A text (tag '#') or an element of a page or of a wrapper.

    mark: what tags, roles and words say: x excluded, f furniture, h a header, m main, or nothing. open: the attributes are a slot, of which `names` is what all share. repeats: it ends a
    repeated group of so many siblings. pages: on how many pages it occurs. Of texts: the hash of the one text or VARIES, and the sums of characters and of those in links.
    """

    __slots__ = ("chars", "children", "key", "linked", "mark", "names", "open", "pages", "repeats", "tag", "text", "value")

    def __init__(self, tag: str, mark: str = "", names: frozenset = frozenset(), open_: bool = False):
        self.tag, self.mark, self.names, self.open = tag, mark, names, open_
        self.children: list[Node] = []
        self.pages, self.repeats, self.value, self.chars, self.linked, self.text = 1, 0, VARIES, 0, 0, None
        self._key()

    def _key(self):
        self.key = f"{self.tag}!{self.mark}*" if self.open else f"{self.tag}!{self.mark}.{'.'.join(sorted(self.names))}"

    def like(self, other: Node) -> bool:
        return self.key == other.key or (self.open or other.open) and self.kin(other)

    def kin(self, other: Node) -> bool:
        return self.tag == other.tag and self.mark == other.mark and self.tag != "#"

    def share(self, other: Node) -> None:
        """The attributes of the two become a slot."""
        if self.names != other.names or other.open:
            self.names, self.open = self.names & other.names, True
            self._key()


def _element(tag: str, attrs: str) -> Node:
    if not attrs or "=" not in attrs and "hidden" not in attrs:
        return Node(tag, "x" if tag in EXCLUDED_TAGS else "h" if tag == "header" else "m" if tag in ("article", "main") else "")
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}
    role = found.get("role", "").lower()
    names = frozenset(_NAMES.findall(_HUMP.sub(" ", f"{found.get('class', '')} {found.get('id', '')}").lower()))
    mark = ""
    if tag in EXCLUDED_TAGS or "hidden" in found or found.get("aria-hidden") == "true" or _HIDDEN.search(found.get("style", "")) or role in EXCLUDED_ROLES:
        mark = "x"
    elif tag in HEADINGS or tag in ("html", "body"):
        pass
    elif tag == "header":
        mark = "h"
    elif EXCLUDED_NAMES & names:
        mark = "x"
    elif tag in ("article", "main") or role in ("main", "article") or found.get("itemprop", "").lower() == "articlebody":
        mark = "m"
    elif FURNITURE_NAMES & names:
        mark = "f"
    return Node(tag, mark, names)


def parse(html: str | None) -> Node:
    """The tree of a page: block elements and texts, without what never holds main text."""
    tokens = [m for m in _TOKEN.finditer(html or "") if m.lastgroup != "raw" and (m["tag"] or m.lastgroup == "text")]
    closed, waiting = set(), {}  # starts of dropped elements that do end
    for k, m in enumerate(tokens):
        tag = m["tag"]
        if tag and (tag := tag.lower()) in DROPPED:
            if not m["end"]:
                waiting.setdefault(tag, []).append(k)
            elif waiting.get(tag):
                closed.add(waiting[tag].pop())
    root = Node("", "")
    stack, buffer = [root], []
    linked = link = skip = 0
    skipping, in_head, mute = "", False, False

    def flush():
        nonlocal linked
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            if text:
                t = Node("#")
                t.text, t.chars, t.linked = text, len(text), min(linked, len(text))
                t.value = int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=7).digest(), "big")
                stack[-1].children.append(t)
            buffer.clear()
        linked = 0

    for k, m in enumerate(tokens):
        if m.lastgroup == "text":
            if not skip and not mute and not (in_head and m["text"].isspace()):
                in_head = False
                buffer.append(m["text"])
                if link:
                    linked += len(m["text"])
            continue
        tag, end = m["tag"].lower(), bool(m["end"])
        if skip:
            if tag == skipping:
                skip += -1 if end else k in closed
            continue
        if tag == "head":
            in_head = not end
            continue
        if in_head and tag not in HEAD:
            in_head = False
        if tag in DROPPED:
            if not end and not m["attrs"].endswith("/"):
                if k in closed:
                    skip, skipping = 1, tag
                else:  # never closed: its text ends at the next block
                    mute = True
            continue
        if tag in INLINE:
            if tag == "br":
                buffer.append(" ")
            elif tag == "a":
                link = 0 if end else 1
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        flush()
        link, mute = 0, False
        if end:
            for d in range(len(stack) - 1, 0, -1):
                if stack[d].tag == tag:
                    del stack[d:]
                    break
            continue
        if tag in ("html", "body") and any(x.tag == tag for x in stack):
            continue
        if tag in END_OPTIONAL:  # a new one ends the last of its kind
            ends = {"dt", "dd"} if tag in ("dt", "dd") else {"td", "th"} if tag in ("td", "th") else {"thead", "tbody", "tfoot", "tr", "td", "th"} if tag in ("thead", "tbody", "tfoot") else {"tr", "td", "th"} if tag == "tr" else {tag}
            for d in range(len(stack) - 1, 0, -1):
                if stack[d].tag in ends:
                    del stack[d:]
                    if tag not in ("tr", "thead", "tbody", "tfoot"):
                        break
                elif stack[d].tag not in END_OPTIONAL:
                    break
        if stack[-1].tag == "p":  # block elements end a paragraph
            stack.pop()
        node = _element(tag, m["attrs"])
        stack[-1].children.append(node)
        stack.append(node)
    flush()
    return root


def texts(root: Node) -> list[Node]:
    """The texts of a tree in page order."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        if n.tag == "#":
            out.append(n)
        todo += reversed(n.children)
    return out


class Stream:
    """The children of a wrapper's element while a page's are aligned with them."""

    def __init__(self, items: list[Node]):
        self.items, self.at = items, 0
        self.known: dict[str, Node] | None = None
        self.ahead = Counter(n.key for n in items)

    def step(self) -> None:
        self.ahead[self.items[self.at].key] -= 1
        self.at += 1

    def back(self, size: int) -> None:
        for _ in range(size):
            self.at -= 1
            self.ahead[self.items[self.at].key] += 1

    def distance(self, node: Node, most: int) -> int | None:
        """How far ahead the next like `node` stands, if no farther than `most`."""
        if self.ahead[node.key]:
            fits = lambda n: n.key == node.key
        elif node.open or self.ahead[f"{node.tag}!{node.mark}*"]:
            fits = node.like
        else:
            return None
        return next((d for d in range(min(len(self.items) - self.at, most + 1)) if fits(self.items[self.at + d])), None)

    def best(self, node: Node) -> Node | None:
        """The commonest item with the key of `node`, wherever it stands."""
        if self.known is None:
            self.known = {}
            for n in self.items:
                if n.key not in self.known or n.pages > self.known[n.key].pages:
                    self.known[n.key] = n
        return self.known.get(node.key)

    def group(self, others: list[Node], j: int) -> int:
        """The size of the stretch just before here that the page's others[j:] repeat, or 0. What has an exact like further on is no repeat of an open element."""
        fits = lambda a, b: a.key == b.key or a.like(b) and not self.ahead[b.key]
        return self._group(others, j, fits)

    def own_group(self, pages: int) -> int:
        """The size of the stretch just before here that the wrapper's own next items repeat, or 0. An open element takes up like ones that one of several pages has."""
        fits = lambda a, b: a.key == b.key or a.open and pages > b.pages == 1 and a.like(b)
        return self._group(self.items, self.at, fits)

    def _group(self, others: list[Node], j: int, fits) -> int:
        size = next((d for d in range(1, min(self.at, len(others) - j) + 1) if fits(self.items[self.at - d], others[j])), 0)
        return size if size and all(fits(a, b) for a, b in zip(self.items[self.at - size : self.at], others[j : j + size])) else 0


def align(wrapper: Node, page: Node, grows: bool = True) -> dict[int, Node]:
    """Align a page, or another wrapper, with a wrapper. Returns the wrapper's place for each of the page's texts, by id().

    If `grows`, mismatches are resolved in the wrapper as described above, and it takes up the page's counts; else it stays as it is: elements out of order get the place of their
    like, and texts without one that of the innermost element that has one.
    """
    places: dict[int, Node] = {}
    todo = [(wrapper, page, True)]
    while todo:
        w, p, first = todo.pop()
        if p.tag == "#":
            places[id(p)] = w
            if grows:
                if w.value != p.value:
                    w.value = VARIES
                w.chars, w.linked, w.text = w.chars + p.chars, w.linked + p.linked, None
        if grows:
            w.pages += p.pages if first else 0
            w.repeats = max(w.repeats, p.repeats)
            if w.open or p.open or w.names != p.names:
                w.share(p)
        if not p.children:
            continue
        if not w.children and grows:
            w.children = p.children
            for t in texts(p):
                places[id(t)] = t
            continue
        s, others, j = Stream(w.children), p.children, 0
        where: dict[str, list[int]] = {}
        for k, n in enumerate(others):
            where.setdefault(n.key, []).append(k)
        seen: set[int] = set()

        def match():
            nonlocal j
            mine = s.items[s.at]
            todo.append((mine, others[j], first and id(mine) not in seen))
            seen.add(id(mine))
            s.step()
            j += 1

        def repeated(size: int) -> None:
            if grows:
                s.items[s.at - 1].repeats = max(size, s.items[s.at - 1].repeats)

        def fold() -> bool:
            """If the wrapper's next stretch repeats the one before, make them one."""
            size = s.own_group(w.pages) if grows and s.at < len(s.items) else 0
            if size:
                repeated(size)
                for k in range(size):
                    todo.append((s.items[s.at - size + k], s.items[s.at + k], False))
                    s.ahead[s.items[s.at + k].key] -= 1
                del s.items[s.at : s.at + size]
            return size > 0

        while j < len(others):
            n = others[j]
            here = s.items[s.at] if s.at < len(s.items) else None
            elsewhere = here is not None and here.key != n.key and s.ahead[n.key] > 0  # its exact like stands further on
            if here is not None and here.like(n) and not elsewhere:
                match()
                continue
            if size := s.group(others, j):  # the page repeats what was just matched
                repeated(size)
                s.back(size)
                for _ in range(size):
                    match()
                continue
            if fold():  # the wrapper itself does
                continue
            skip_page = None
            if here is not None:
                if here.open:
                    skip_page = None if elsewhere else next((k - j for k in range(j, len(others)) if others[k].like(here)), None)
                elif (known := where.get(here.key)) and (k := bisect_left(known, j)) < len(known):
                    skip_page = known[k] - j
            skip_wrapper = s.distance(n, len(s.items) if skip_page is None else skip_page)
            if skip_wrapper is not None:  # optional in the wrapper
                for _ in range(skip_wrapper):
                    s.step()
            elif skip_page is None and here is not None and here.kin(n):  # attributes differ
                if grows:
                    s.ahead[here.key] -= 1
                    here.share(n)
                    s.ahead[here.key] += 1
                match()
            else:  # optional in the page
                for n in others[j : j + (skip_page or 1)]:
                    if grows:
                        s.items.insert(s.at, n)
                        s.at += 1
                        seen.add(id(n))
                        places.update((id(t), t) for t in texts(n))
                    elif (own := s.best(n)) is not None:  # known, but in another order
                        todo.append((own, n, False))
                    else:
                        places.update((id(t), w) for t in texts(n))
                j += skip_page or 1
        while s.at < len(s.items):
            if not fold():
                s.step()
    return places


def dump(root: Node) -> str:
    """A wrapper as a flat list of its nodes, parents first, each with its depth."""
    out, todo = [], [(0, root)]
    while todo:
        d, n = todo.pop()
        out.append([d, n.tag, n.mark, sorted(n.names), int(n.open), n.repeats, n.pages, *((n.value, n.chars, n.linked) if n.tag == "#" else ())])
        todo += [(d + 1, c) for c in reversed(n.children)]
    return json.dumps(out, separators=(",", ":"))


def load(s: str) -> Node:
    path: list[Node] = []
    for d, tag, mark, names, open_, repeats, pages, *rest in json.loads(s):
        n = Node(tag, mark, frozenset(names), bool(open_))
        n.repeats, n.pages = repeats, pages
        if rest:
            n.value, n.chars, n.linked = rest
        del path[d:]
        if path:
            path[-1].children.append(n)
        path.append(n)
    return path[0]


def expression(root: Node) -> str:
    """The union-free regular expression in words: (...)+ repeats, (...)? is optional, # is a slot and = constant text."""

    def stream(items: list[Node], pages: int) -> str:
        out: list[str] = []
        for n in items:
            body = ("=" if n.value != VARIES else "#") if n.tag == "#" else f"{n.tag}{''.join('.' + x for x in sorted(n.names))}{'.*' if n.open else ''}"
            inner = stream(n.children, n.pages)
            one = f"<{body}> {inner} </{n.tag}>".replace("  ", " ") if n.tag != "#" else body
            out.append(f"( {one} )?" if n.pages < pages else one)
            if n.repeats:
                group = out[-n.repeats :]
                out[-n.repeats :] = [f"( {' '.join(group)} )+"] + [""] * (n.repeats - 1)
        return " ".join(x for x in out if x)

    return stream(root.children, root.pages)


def judge(root: Node) -> set[int]:
    """id() of the places of a wrapper that hold main text: texts, and elements whose texts unknown to the wrapper count as such."""
    order: list[tuple[Node, Node | None]] = []
    todo: list[tuple[Node, Node | None]] = [(root, None)]
    while todo:
        n, up = todo.pop()
        order.append((n, up))
        todo += [(c, n) for c in reversed(n.children)]
    above = {id(n): up for n, up in order}
    # one text may have got several optional places beside each other: their pages count together, unless they are more than there are
    alike: Counter = Counter()
    family = lambda n: (id(above[id(above[id(n)])]), above[id(n)].key, n.value)
    deep = {id(n) for n, up in order if n.tag == "#" and n.value != VARIES and above[id(up)] is not None}
    for n, _ in order:
        if id(n) in deep:
            alike[family(n)] += n.pages

    def constant(n: Node) -> bool:
        if n.value == VARIES:
            return False
        return n.pages >= CONSTANT_PAGES or id(n) in deep and CONSTANT_PAGES <= alike[family(n)] <= above[id(above[id(n)])].pages


    # what every element holds: characters that vary, those in links among all, and whether any text varies at all
    free, all_, linked = {}, {}, {}
    telling = any(n.tag == "#" and not constant(n) for n, _ in order)  # else all pages are copies of one
    for n, _ in reversed(order):
        if n.tag == "#":
            all_[id(n)], linked[id(n)] = n.chars, n.linked
            free[id(n)] = n.chars - n.linked if not (telling and constant(n)) and 2 * n.linked < max(1, n.chars) else 0
        else:
            for held in (free, all_, linked):
                held[id(n)] = sum(held[id(c)] for c in n.children)

    excluded, in_article = {}, {}
    for n, up in order:
        article = up is not None and in_article[id(up)]
        out = up is not None and excluded[id(up)]
        if n.mark == "x" or n.mark == "h" and not article:
            out = True
        elif n.mark == "f" and not out:  # the wrapper decides where it has seen enough: what is constant, mostly links or, outside articles, the lesser part of the page goes
            furniture = free[id(n)] == 0 or 2 * linked[id(n)] >= max(1, all_[id(n)]) or not article and 2 * free[id(n)] < free[id(root)]
            out = furniture or n.pages < CONSTANT_PAGES and article
        excluded[id(n)] = out
        in_article[id(n)] = article or n.tag == "article" and not out
    weight = {}
    for n, _ in reversed(order):
        weight[id(n)] = 0 if excluded[id(n)] else free[id(n)] if n.tag == "#" else sum(weight[id(c)] for c in n.children)

    def marked(tags):
        return [n for n, up in order if n.mark == "m" and (n.tag in tags if tags else True) and not excluded[id(n)] and weight[id(n)]]

    regions = marked(("article",)) or [n for n in marked(None) if n.tag != "main"] or marked(("main",))
    by_mark = bool(regions)
    if not regions:
        region = root
        while weight[id(region)]:
            inner = max((c for c in region.children if c.tag in CONTAINERS), key=lambda c: weight[id(c)], default=None)
            if inner is None or 4 * weight[id(inner)] < 3 * weight[id(region)]:
                break
            region = inner
        regions = [region]
    inside, main = {id(r) for r in regions}, set()
    for n, up in order:
        if up is not None and id(up) in inside:
            inside.add(id(n))
        if id(n) not in inside or excluded[id(n)]:
            continue
        if n.tag != "#":
            main.add(id(n))
        elif by_mark and (not (telling and constant(n)) or up.tag in HEADINGS):
            main.add(id(n))
        elif not by_mark and free[id(n)]:
            main.add(id(n))
    if not by_mark:  # the page's own heading may stand before the region that holds its text
        heading = lambda n: n.tag == "#" and above[id(n)].tag == "h1" and free[id(n)] and not excluded[id(n)]
        if not any(heading(n) and id(n) in main for n, _ in order):
            for n, _ in order:
                if id(n) == id(regions[0]):
                    break
                if heading(n):
                    main.add(id(n))
    return main


def main_text(page: Node, wrapper: Node, main: set[int]) -> str:
    places = align(wrapper, page, grows=False)
    out = []
    todo: list[tuple[Node, bool]] = [(page, False)]
    while todo:
        n, bad = todo.pop()
        if n.tag == "#":
            place = places[id(n)]
            if id(place) in main and (place.tag == "#" or not bad and 2 * n.linked < max(1, n.chars)):
                out.append(n.text)
        bad = bad or n.mark in ("x", "f")
        todo += [(c, bad) for c in reversed(n.children)]
    return "\n".join(out)


def infer(pages: DataFrame) -> DataFrame:
    """(host, wrapper) from pages (host, html)."""

    def local(it):
        held: dict[str, Node] = {}
        pid = TaskContext.get().partitionId()

        def out():
            b = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([pid] * len(held), pa.int32()), pa.array([dump(w) for w in held.values()], pa.string())], names=["host", "part", "wrapper"])
            held.clear()
            return b

        for b in it:
            for host, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                page = parse(html)
                if (w := held.get(host)) is None:
                    held[host] = page
                else:
                    align(w, page)
            if len(held) > HELD_HOSTS:
                yield out()
        if held:
            yield out()

    def merged(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group.column("part").to_pylist(), group.column("wrapper").to_pylist()))
        w = load(rows[0][1])
        for _, s in rows[1:]:
            align(w, load(s))
        return pa.table({"host": [group.column("host")[0].as_py()], "part": pa.array([rows[0][0] // MERGED], pa.int32()), "wrapper": [dump(w)]})

    schema = "host string, part int, wrapper string"
    w = C.stash(pages.mapInArrow(C.lean(local), schema), "wrappers")
    most = w.agg(F.max("part")).first()[0]
    while True:  # a tree of merges: a group holds the wrappers of at most MERGED tasks
        less = C.stash(w.groupBy("host", F.floor(F.col("part") / MERGED).alias("g")).applyInArrow(merged, schema), "wrappers")
        C.discard(w)
        w = less
        if not most or most < MERGED:
            return w.select("host", "wrapper")
        most //= MERGED


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns `keep`, text and n_chars for every row of pages (with url and html)."""
    spark, n = pages.sparkSession, len(keep)
    C.ship(spark)
    host, html, copy, wrapper = (C.fresh(x, keep) for x in ("host_", "html_", "copy_", "wrapper_"))
    found = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    pages = pages.select(*keep, found.alias(host), F.col("html").alias(html))
    wrappers = infer(pages.select(host, html))
    schema = ", ".join(f"`{c}` {t}" for c, t in pages.select(*keep).dtypes) + f"{', ' if keep else ''}text string, n_chars long"
    size = wrappers.agg(F.coalesce(F.sum(F.octet_length("wrapper") + F.octet_length("host")), F.lit(0))).first()[0]
    table = spark.sparkContext.broadcast({r.host: r.wrapper for r in wrappers.collect()}) if size <= BROADCAST_BYTES else None

    def read(it):
        ready: dict[str, tuple[Node, set[int]]] = {}
        for b in it:
            found, rows = [], []
            given = b.column(n + 2).to_pylist() if table is None else [None] * b.num_rows
            for k, (h, page, sent) in enumerate(zip(b.column(n).to_pylist(), b.column(n + 1).to_pylist(), given)):
                if sent is not None or h not in ready:
                    if len(ready) > HELD_HOSTS or sent is not None:
                        ready.clear()
                    w = load(sent if sent is not None else table.value[h])
                    ready[h] = w, judge(w)
                if sent is None:
                    rows.append(k)
                    found.append(main_text(parse(page), *ready[h]))
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows, pa.int32())) for c in b.columns[:n]), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=[*keep, "text", "n_chars"])

    if table is None:  # each wrapper goes ahead of its pages, in as many copies as the host's pages are dealt out over
        copies = pages.groupBy(F.col(host).alias("host")).agg(F.ceil(F.count(F.lit(1)) / PAGES_A_COPY).cast("int").alias("copies"))
        each = C.stash(wrappers.join(copies, "host"), "wrapper-copies")
        none = [F.lit(None).cast(t).alias(c) for c, t in pages.select(*keep, html).dtypes]
        ahead = each.select(*none[:-1], F.col("host").alias(host), none[-1], F.col("wrapper").alias(wrapper), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias(copy))
        dealt = pages.join(each.select(F.col("host").alias(host), "copies"), host).select(*keep, host, html, F.lit(None).cast("string").alias(wrapper), F.pmod(F.monotonically_increasing_id(), "copies").cast("int").alias(copy))
        pages = ahead.unionByName(dealt).repartition(C.partitions(spark), host, copy).sortWithinPartitions(host, copy, F.col(wrapper).isNull()).drop(copy)
    return pages.mapInArrow(C.lean(read), schema)


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(C.table(spark, sf_dir, "pages"))
