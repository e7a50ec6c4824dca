"""HTML extraction: wrappers inferred per host as union-free regular expressions over page structure.

A page is a tree of block elements with text slots.  Neighbours of one kind fold into repeated groups,
and trees of one host are aligned one after the other: what only one side has becomes optional, what
differs in a text makes it a slot instead of template text.  A slot knows which texts all pages that have it
share, and how many different pages those are; three make such a text template, in an article too.  Each task aligns the pages it reads, the tasks' wrappers
are aligned in two steps, and every page is then read along its host's wrapper, part by part in the order of the expression.
"""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import on_arrow, shuffle_parts, written

# Deeper elements are children of their ancestor at this depth; longer rows of children fold by name alone.
MAX_DEPTH = 100
MAX_ROW = 60
# Wrappers of hosts that a task holds before it hands them on.
HELD_HOSTS = 2_000
_SALTS = 32
# So many different pages make a text that all of them share template.
EVIDENCE = 3

# How elements of HTML behave.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select "
    "summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template iframe object svg canvas audio video head title button select textarea datalist".split())
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}, "body": {"head"},
}
SCOPES = frozenset("ul ol dl table article section div nav aside main body form select".split())

# What holds no article, by element and by names in class, id and role.  They are hints: what holds the article, or most
# of a page without one, is no boilerplate whatever it is called.
BOILER_TAGS = frozenset("nav header footer aside form menu dialog search fieldset".split())
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar rail widget menu nav "
    "navbar navigation breadcrumb breadcrumbs header masthead footer copyright cookie cookies consent notice notices alert "
    "popup modal overlay share sharing social related recommended newsletter subscribe subscription signup login comment "
    "comments reply replies disqus respond toolbar pagination pager tags skip complementary contentinfo".split()
)
# Names in front of which any other word stands, and words that turn a name round; inline elements are hidden for the former alone.
ADVERT_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion".split())
TURNING_WORDS = frozenset("no not without has with is hide hidden".split())
MAIN_TAGS = frozenset(("article", "main"))
FORM_TAGS = frozenset("form fieldset".split())

_NAMES = re.compile(r"[A-Za-z]+(?:[-_]+[A-Za-z]+)*")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")

# Places in a node.  TEXT is its label; SAME has the digests of texts that all pages with this slot share, PAGES the
# least digests, EVIDENCE at most, of those pages' contents; copies of a page have one digest.
TEXT, HOLDS, REPEATED, OPTIONAL, SAME, LINKED, PAGES = range(7)
# How nodes merge: of different pages; of one page, in place; of positions that the same pages have; one side counts.
ACROSS, WITHIN, BOTH, LEFT, RIGHT = range(5)
BY_LABEL = 2  # in REPEATED: of a long row, folded by label


def _label(tag: str, attributes: list[tuple[str, str | None]]) -> str:
    """The element with the names of its class, id and role, numbers left out, words joined by hyphens."""
    if not attributes:
        return tag
    names = {
        _HUMP.sub("-", w).replace("_", "-").lower()
        for k, v in attributes if k in ("class", "id", "role") and v for w in _NAMES.findall(v)
    }
    return ".".join([tag, *sorted(names)])


@lru_cache(maxsize=1 << 16)
def _hinted(label: str) -> bool:
    """Whether a name says that the element is no part of an article: by its last word, or an advert's first."""
    tag, *names = label.split(".")
    for name in names:
        first, *_ = words = name.split("-")
        if first in ADVERT_WORDS or words[-1] in ADVERT_WORDS and first not in TURNING_WORDS:
            return True
        if tag in BLOCKS and words[-1] in BOILER_WORDS and first not in TURNING_WORDS:
            return True
    return False


class _Element:
    __slots__ = ("label", "tag", "parts", "boiler")

    def __init__(self, label: str, tag: str):
        self.label, self.tag = label, tag
        self.boiler = _is_boiler(label)
        self.parts: list[_Element | tuple[str, bool]] = []  # children and (text, in a link)


class _Parser(HTMLParser):
    """Builds the tree of block elements; inline elements leave their texts in the block around them.

    An inline element whose class, id or role marks it as no part of an article is kept as an element.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Element("", "")
        self.stack, self.hidden, self.links = [self.root], [], 0
        self.main = False  # an article or main element outside boilerplate

    def updatepos(self, i: int, j: int) -> int:
        return j  # no line numbers

    def _close(self, at: int) -> None:
        del self.stack[at:]

    def _open_at(self, names: set[str], scopes: frozenset[str]) -> int:
        """Where the nearest open element of ``names`` is, not looking beyond ``scopes``; -1 if nowhere."""
        for at in range(len(self.stack) - 1, 0, -1):
            if self.stack[at].tag in names:
                return at
            if self.stack[at].tag in scopes:
                return -1
        return -1

    def handle_starttag(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        if tag in UNSEEN:
            if tag == "head" and self.hidden:
                return
            self.hidden.append(tag)
            return
        if self.hidden:
            if self.hidden[0] != "head" and tag not in VOID:
                self.hidden.append(tag)
                return
            if self.hidden[-1] == "head" and (tag in BLOCKS or tag in MAIN_TAGS):
                self.hidden.clear()  # the body begins, with or without its tag
            else:
                return
        if tag == "a":
            self.links += 1
        label = _label(tag, attributes)
        marked = tag not in BLOCKS and tag not in VOID and _hinted(label)
        if tag not in BLOCKS and not marked:
            if tag in ("br", "img", "hr"):
                self._add((" ", False))
            return
        if tag in BLOCKS:
            at = self._open_at({"p"}, SCOPES)
            if at > 0:
                self._close(at)
            names = CLOSED_BY.get(tag)
            while names and (at := self._open_at(names, SCOPES - names)) > 0:
                self._close(at)
        above = self.stack[-1].label
        if len(self.stack) > MAX_DEPTH and (_is_boiler(above) or _is_main(above) and not _is_boiler(label)):
            label = above  # what lies around it is no longer seen from its place
        element = _Element(label, tag)
        if not self.main and not element.boiler and _is_main(label):
            self.main = not any(e.boiler for e in self.stack)
        self.stack[min(len(self.stack), MAX_DEPTH) - 1].parts.append(element)
        if tag not in VOID:
            self.stack.append(element)

    def _add(self, text: tuple[str, bool]) -> None:
        """Add a text to the innermost element; a deep one goes on in a new element behind those it holds."""
        top = self.stack[-1]
        if len(self.stack) > MAX_DEPTH:
            parts = self.stack[MAX_DEPTH - 1].parts
            if not parts or parts[-1] is not top:
                top = self.stack[-1] = _Element(top.label, top.tag)
                parts.append(top)
        top.parts.append(text)

    def handle_endtag(self, tag: str) -> None:
        if self.hidden:
            if tag in self.hidden:
                del self.hidden[len(self.hidden) - 1 - self.hidden[::-1].index(tag) :]
                return
            if self.hidden[0] == "head" or not any(e.tag == tag for e in self.stack[1:]):
                return
            self.hidden.clear()  # the element around it ends, and what was left open in it too
        if tag == "a":
            self.links = max(0, self.links - 1)
        for at in range(len(self.stack) - 1, 0, -1):
            if self.stack[at].tag == tag:
                self._close(at)
                return
            if tag not in BLOCKS and self.stack[at].tag in BLOCKS:
                return

    def handle_data(self, data: str) -> None:
        if not self.hidden or (self.hidden[-1] == "head" and data.strip()):
            self._add((data, self.links > 0))


    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """The text of a CDATA section; any other ``<![`` is a comment up to the next ``>``, as in HTML.

        The library raises an error for names it doesn't know, which would end the page.
        """
        if self.rawdata[i : i + 9].lower() == "<![cdata[" and (end := self.rawdata.find("]]>", i + 9)) >= 0:
            self.handle_data(self.rawdata[i + 9 : end])
            return end + 3
        return self.parse_bogus_comment(i, report)


def parse(html: str) -> _Element:
    parser = _Parser()
    parser.feed(html)
    parser.close()
    if not parser.main:
        _judge(parser.root)
    return parser.root


def _judge(root: _Element) -> None:
    """On a page whose only article or main elements lie in boilerplate, take the hints around them back; on one without any, those of a
    form or a named part that holds most of the text."""
    sizes: dict[int, tuple[int, bool]] = {}
    order, work = [], [root]
    while work:
        element = work.pop()
        order.append(element)
        work += [p for p in element.parts if isinstance(p, _Element)]
    for element in reversed(order):
        inner = [p for p in element.parts if isinstance(p, _Element)]
        found = [sizes[id(p)] for p in inner]
        size = sum(len(p[0]) for p in element.parts if not isinstance(p, _Element) and not p[1]) + sum(n for n, _ in found)
        holds = any(main for _, main in found)
        if holds:
            element.boiler = False
        sizes[id(element)] = size, holds or _is_main(element.label) and not element.boiler
    most, main = sizes[id(root)]
    if not main:
        for element in order:
            if element.boiler and (element.tag in FORM_TAGS or element.tag not in BOILER_TAGS) and 2 * sizes[id(element)][0] > most:
                element.boiler = False


def _runs(element: _Element) -> Iterator[_Element | tuple[str, bool]]:
    """Children, and between them each run of texts as one text with single spaces; empty runs are left out."""
    texts: list[tuple[str, bool]] = []

    def run() -> Iterator[tuple[str, bool]]:
        joined = " ".join("".join(t for t, _ in texts).split())
        if joined:
            yield joined, all(linked for t, linked in texts if t.strip())
        texts.clear()

    for part in element.parts:
        if isinstance(part, _Element):
            yield from run()
            yield part
        else:
            texts.append(part)
    yield from run()


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=6).hexdigest()


def _content(element: _Element) -> str:
    """A digest of the texts outside boilerplate."""
    texts: list[str] = []

    def walk(at: _Element) -> None:
        for part in _runs(at):
            if not isinstance(part, _Element):
                texts.append(part[0])
            elif not part.boiler:
                walk(part)

    walk(element)
    return _digest("\n".join(texts))


def skeleton(element: _Element, page: str | None = None) -> list:
    """The wrapper of one page."""
    page = page or _content(element)
    items = [
        skeleton(p, page) if isinstance(p, _Element) else ["#text", [], False, False, {_digest(p[0])}, p[1], [page]]
        for p in _runs(element)
    ]
    linked = bool(items) and all(i[LINKED] for i in items)
    return [element.label, fold(items, WITHIN), False, False, None, linked, None]


def _merge(a: list, b: list, how: int = ACROSS) -> list:
    same, pages = a[SAME], a[PAGES]
    if same is not None:
        if how == WITHIN:
            same |= b[SAME]
        elif how == ACROSS:
            same, pages = set(same).intersection(b[SAME]), sorted({*pages, *b[PAGES]})[:EVIDENCE]
        elif how == BOTH:
            same, pages = set(same).union(b[SAME]), min(pages, b[PAGES], key=len)
        elif how == RIGHT:
            same, pages = b[SAME], b[PAGES]
    return [
        a[TEXT], align(a[HOLDS], b[HOLDS], how), max(a[REPEATED], b[REPEATED]), a[OPTIONAL] or b[OPTIONAL], same,
        a[LINKED] and b[LINKED], pages,
    ]


def _put_together(a: list, b: list, how: int) -> list:
    """Two positions of one wrapper as one repeated item."""
    if how != WITHIN:
        how = (ACROSS if b[OPTIONAL] else RIGHT) if a[OPTIONAL] else LEFT if b[OPTIONAL] else BOTH
    merged = _merge(a, b, how)
    merged[REPEATED], merged[OPTIONAL] = max(merged[REPEATED], True), a[OPTIONAL] and b[OPTIONAL]
    return merged


def _grouped(items: list[list], how: int) -> list[list]:
    """Fold ``a b a b`` of up to four neighbours into one repeated group."""
    for n in (2, 3, 4):
        at, out = 0, []
        names = [i[TEXT] for i in items]
        while at < len(items):
            times = 1
            while names[at : at + n] == names[at + times * n : at + (times + 1) * n] and len(names[at : at + n]) == n:
                times += 1
            if times > 1:
                repeated = [m[REPEATED] for m in items[at : at + n]]
                members = items[at : at + n]
                for k in range(1, times):
                    turn = items[at + k * n : at + (k + 1) * n]
                    repeated = [max(r, m[REPEATED]) for r, m in zip(repeated, turn)]
                    members = [_put_together(a, b, how) for a, b in zip(members, turn)]
                for member, r in zip(members, repeated):
                    member[REPEATED] = r
                linked = all(m[LINKED] for m in members)
                out.append(["(" + " ".join(names[at : at + n]) + ")", members, True, False, None, linked, None])
                at += times * n
            else:
                out.append(items[at])
                at += 1
        items = out
    return items


def _by_label(items: list[list], how: int) -> list[list]:
    """A row with one item for each label, members of groups included."""
    found: dict[str, list] = {}
    work = list(reversed(items))
    while work:
        item = work.pop()
        if item[TEXT].startswith("("):
            work += [[*m[:OPTIONAL], m[OPTIONAL] or item[OPTIONAL], *m[SAME:]] for m in reversed(item[HOLDS])]
        else:
            known = found.get(item[TEXT])
            found[item[TEXT]] = _put_together(known, item, how) if known else item
    return [[*i[:REPEATED], BY_LABEL, *i[OPTIONAL:]] for i in found.values()]


def fold(items: list[list], how: int = ACROSS) -> list[list]:
    """Neighbours of one label become one repeated item, neighbouring rows of labels a repeated group."""
    out: list[list] = []
    for item in items:
        if out and out[-1][TEXT] == item[TEXT]:
            out[-1] = _put_together(out[-1], item, how)
        else:
            out.append(item)
    out = _grouped(out, how)
    return _by_label(out, how) if len(out) > MAX_ROW else out


def _as_groups(items: list[list], other: list[list]) -> list[list]:
    """Where the other side has a group, take a plain run of its members for one turn of it."""
    for group in (g for g in other if g[TEXT].startswith("(")):
        members = [m[TEXT] for m in group[HOLDS]]
        n, at, out = len(members), 0, []
        while at < len(items):
            if [i[TEXT] for i in items[at : at + n]] == members:
                out.append([group[TEXT], items[at : at + n], True, False, None, False, None])
                at += n
            else:
                out.append(items[at])
                at += 1
        items = out
    return items


def _optional(item: list) -> list:
    return [*item[:OPTIONAL], True, *item[SAME:]]


def align(a: list[list], b: list[list], how: int = ACROSS) -> list[list]:
    """Items of both sides in order, matched by a longest common row of labels; unmatched ones are optional.

    If one side is folded by label, so is the other, and labels match wherever they are.
    """
    if any(i[REPEATED] == BY_LABEL for i in (*a, *b)):
        inner = how if how == WITHIN else ACROSS
        one, two = ({i[TEXT]: i for i in _by_label(side, inner)} for side in (a, b))
        both = [_merge(i, two[k], how) if k in two else _optional(i) for k, i in one.items()]
        return both + [_optional(i) for k, i in two.items() if k not in one]
    a, b = _as_groups(a, b), _as_groups(b, a)
    if [i[TEXT] for i in a] == [i[TEXT] for i in b]:
        return [_merge(x, y, how) for x, y in zip(a, b)]
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][TEXT] == b[j][TEXT] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    out = []
    while i < n or j < m:
        if i < n and j < m and a[i][TEXT] == b[j][TEXT]:
            out.append(_merge(a[i], b[j], how))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            out.append(_optional(a[i]))
            i += 1
        else:
            out.append(_optional(b[j]))
            j += 1
    return fold(out, how if how == WITHIN else ACROSS)


def expression(node: list) -> str:
    """A wrapper as a regular expression, for people."""
    if node[TEXT] == "#text":
        body = "'..'" if len(node[SAME]) == 1 else "#text"
    else:
        inner = " ".join(expression(i) for i in node[HOLDS])
        body = f"({inner})" if node[TEXT].startswith("(") else f"<{node[TEXT]}>{inner}</>"
    return body + "+" * bool(node[REPEATED]) + "?" * node[OPTIONAL]


@lru_cache(maxsize=1 << 16)
def _is_boiler(label: str) -> bool:
    return label.split(".", 1)[0] in BOILER_TAGS or _hinted(label)


@lru_cache(maxsize=1 << 16)
def _is_main(label: str) -> bool:
    tag, *names = label.split(".")
    return tag in MAIN_TAGS or (tag == "div" and any("main" in n.split("-") for n in names))


class _Row:
    """The items of a node in order, groups opened: where a reading of the expression may go on after each."""

    def __init__(self, node: list):
        self.items: list[list] = []
        self.again: list[int] = []  # the first item that may follow, the same or a group's first if it repeats
        self.places: dict[str, list[int]] = {}
        self.free = any(i[REPEATED] == BY_LABEL for i in node[HOLDS])
        self._add(node[HOLDS], None)

    def _add(self, items: list[list], group: int | None) -> None:
        for item in items:
            here = len(self.items)
            if item[TEXT].startswith("("):
                self._add(item[HOLDS], here if group is None else group)
                continue
            self.places.setdefault(item[TEXT], []).append(here)
            self.items.append(item)
            self.again.append(group if group is not None else here if item[REPEATED] else here + 1)

    def step(self, at: int, label: str) -> int:
        """The place of the next part with a label after the part at place ``at``; -1 if the expression has none there."""
        found = self.places.get(label, ())
        if self.free:
            return found[0] if found else -1
        k = bisect_left(found, 0 if at < 0 else self.again[at])
        return found[k] if k < len(found) else -1


class Wrapper:
    """A host's wrapper, ready to read pages along it."""

    def __init__(self, pages: int, root: list):
        self.pages, self.root = pages, root
        self.rows: dict[int, _Row] = {}

    def _row(self, node: list) -> _Row:
        if id(node) not in self.rows:
            self.rows[id(node)] = _Row(node)
        return self.rows[id(node)]

    def read(self, page: _Element) -> list[str]:
        """The blocks of the page's article, in page order.

        Where the page has an article or main element, its texts outside boilerplate; else all texts outside it
        but lists of links.  From both go texts that all pages with their slot share, if those are different pages.
        A page that has no other texts keeps them, and one that hints alone would leave empty is read without hints.
        """
        for hints in (True, False):
            with_main: list[tuple[str, bool]] = []
            rest: list[tuple[str, bool]] = []
            self._walk(page, self.root, False, hints, with_main, rest)
            texts = with_main or rest
            if texts:
                break
        return [t for t, template in texts if not template] or [t for t, _ in texts]

    def _walk(
        self, element: _Element, node: list | None, main: bool, hints: bool, with_main: list[tuple[str, bool]], rest: list[tuple[str, bool]]
    ) -> None:
        """Read the parts of an element along its node's expression: in order, optional items left out, repeated ones again."""
        row, at = self._row(node) if node else None, -1
        for part in _runs(element):
            whole = isinstance(part, _Element)
            place = row.step(at, part.label if whole else "#text") if row else -1
            item = None
            if place >= 0:
                item, at = row.items[place], place
            if whole:
                if not (part.boiler if hints else part.tag in BOILER_TAGS or part.tag not in BLOCKS):
                    self._walk(part, item, main or _is_main(part.label), hints, with_main, rest)
                continue
            template = item is not None and len(item[PAGES]) >= EVIDENCE and _digest(part[0]) in item[SAME]
            if main:
                with_main.append((part[0], template))
            elif not (item[LINKED] if item else part[1]):
                rest.append((part[0], template))


@lru_cache(maxsize=256)
def _wrapper(text: str) -> Wrapper:
    return Wrapper(*json.loads(text))


def main_text(html: str, wrapper: Wrapper) -> str:
    return "\n".join(wrapper.read(parse(html)))


def _as_batch(held: dict[str, tuple[int, list]]) -> pa.RecordBatch:
    texts = [json.dumps(v, ensure_ascii=False, separators=(",", ":"), default=sorted) for v in held.values()]
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(texts, pa.string())], names=["host", "wrapper"])


def _take(held: dict[str, tuple[int, list]], host: str, pages: int, root: list) -> None:
    known = held.get(host)
    held[host] = (known[0] + pages, _merge(known[1], root)) if known else (pages, root)


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Align the pages of each host that a task reads."""
    held: dict[str, tuple[int, list]] = {}
    for batch in batches:
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            _take(held, host, 1, skeleton(parse(html or "")))
            if len(held) > HELD_HOSTS:
                yield _as_batch(held)
                held = {}
    if held:
        yield _as_batch(held)


def _align_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Align wrappers that come sorted by host, one host at a time."""
    held: dict[str, tuple[int, list]] = {}
    for batch in batches:
        for host, text in zip(batch.column("host").to_pylist(), batch.column("wrapper").to_pylist()):
            if held and host not in held:
                yield _as_batch(held)
                held = {}
            _take(held, host, *json.loads(text))
    if held:
        yield _as_batch(held)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [
            main_text(h or "", _wrapper(w)) for h, w in zip(batch.column("html").to_pylist(), batch.column("wrapper").to_pylist())
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper) for the hosts of ``pages`` (host, html), a wrapper being JSON of its page count and root."""
    schema = "host string, wrapper string"
    found = on_arrow(pages.select("host", "html"), _infer, schema)
    salt = F.pmod(F.xxhash64("wrapper"), F.lit(_SALTS))
    parts = shuffle_parts(pages)
    salted = found.repartition(parts, "host", salt).sortWithinPartitions("host", "wrapper")
    once = on_arrow(salted, _align_sorted, schema)
    return on_arrow(once.repartition(parts, "host").sortWithinPartitions("host", "wrapper"), _align_sorted, schema)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html).

    Null html counts as empty and gives an empty text.  Pages without url or host are of one nameless host.
    Repeated rows and null identifiers are rows of their own; an empty table gives no rows; other columns are not read.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col("url"), r"://([^/?#]*)", 1)), F.lit(""))
    named = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"), host.alias("host"),
    )
    # The written table has no partitioning by host of its own, so a join with a hot host can be split.
    joined = named.join(written(wrappers(named), "wrappers"), "host")
    return on_arrow(joined.select("page_id", "url", "html", "wrapper"), _extract, "page_id long, url string, text string, n_chars long")
