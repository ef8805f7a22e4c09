"""Main text of web pages by deducing each site's template.

A page is a sequence of tokens: its elements, told apart by the path of tags and classes that leads to them, and its
text nodes. The occurrence vector of a token holds how often each page of its host has it. Tokens with the same
vector form an equivalence class; classes that at least ``SUPPORT`` of the pages have, and whose tokens all lie in one
slot of another valid class, nest into the host's template. What the template leaves open are slots: a grouping
element of a valid class, there once on every page that has it, owns what lies in it and in no such element below.

Slots tell the main text by what pages put there, not by names. The container is the innermost template element that
holds ``HOLDS`` of the pages' plain text (that of links and of elements that HTML itself keeps for other things, such
as nav, footer and form, set aside); it grows to the element around it while that adds a heading. Of the container's
slots, the one with the most text is the main one. A slot that is mostly links, or that begins where the main one is
under way (comments of readers, notes, further reading), is not main text; nor is one before it, unless it has a
heading or holds at least ``LEAD`` of what the main slot does. Template text is not content: text nodes of a valid
class go, unless those inside the container hold ``HOLDS`` of all text; such pages are copies, and what they share is
their text. A page without any of the containers of its host is its own template.

Copies of a page (equal html on a host) are one page here, and pages without elements are none. Hosts with fewer than
``PAGES`` pages use the template deduced from all pages.

Vectors are compared by two sums, over pages, of hashes of page and count, so that they combine on the map side and a
host of any size is a row for each token; what is deduced from are the frequent tokens of a host, of which there are
no more than a page's tokens divided by ``SUPPORT``.

Text: character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined by
two line ends. Defined results: null and empty html gives an empty text; a null url belongs to the host ''; broken
markup is read as browsers do in the main (implied ends, raw elements, unmatched ends skipped, elements nested deeper
than ``DEPTH`` beside each other; a tag that never ends is text), in time proportional to its length; a page of
nothing but set-aside elements gives their text; repeated rows give a row each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SUPPORT, HOLDS, PAGES = 0.5, 0.6, 3
#: A slot before the main one is main text from this share of its text, and from so many characters a page.
LEAD, LEAD_CHARS = 0.25, 100
DEPTH = 512
#: Hashes of pages with copies that are broadcast.
COPIED = 1_000_000

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_PLAIN = re.compile(r"[^>\"']*")
_NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_RAW = frozenset("script style noscript textarea title iframe template xmp svg math".split())
#: Raw elements that end themselves with a slash, and whose content is markup where no end tag follows.
_MARKUP = frozenset("noscript template svg math".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "p": ("p",)}
_BORDER = frozenset("ul ol dl table select article section div main body nav aside footer header form".split())
#: Elements that group blocks, and so can hold a main text; the first is the root.
_GROUPS = frozenset(("", *"article body center div html main ol section table tbody td tr ul".split()))
_HEADS = frozenset("h1 h2 h3".split())
#: Elements, and roles, that HTML itself keeps for other things than a main text.
_ASIDE = frozenset("nav header footer aside form button select menu dialog head".split())
_ASIDE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
_M31 = (1 << 31) - 1
_M64 = (1 << 64) - 1


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


class _Path:
    """An element's path: its own step, a hash of all steps, and whether it or what holds it is no main text."""

    __slots__ = ("article", "aside", "children", "depth", "head", "key", "link", "name", "parent", "step")

    def __init__(self, parent: _Path | None, name: str, named: str, role: str):
        self.parent, self.name = parent, name
        self.step = name + (f".{named}" if named else "")
        self.key = _hash(f"{parent.key if parent else 0}>{self.step}")
        self.article = name == "article" or bool(parent and parent.article)
        set_aside = name in _ASIDE and not (name == "header" and self.article) or role in _ASIDE_ROLES
        self.aside = bool(parent and parent.aside) or set_aside
        self.link = name == "a" or bool(parent and parent.link)
        self.head = name in _HEADS or bool(parent and parent.head)
        self.depth = parent.depth + 1 if parent else 0
        self.children: dict[tuple[str, str], _Path] = {}

    def child(self, name: str, named: str, role: str = "") -> _Path:
        found = self.children.get((name, named))
        if found is None:
            found = _Path(self, name, named, role)
            if len(self.children) < 5000:
                self.children[name, named] = found
        return found

    def chain(self) -> Iterator[_Path]:
        """The path and those around it, innermost first."""
        p = self
        while p is not None:
            yield p
            p = p.parent


def root() -> _Path:
    return _Path(None, "", "", "")


class _Reader:
    """Tags of a page in one pass: searches that found nothing aren't made again."""

    def __init__(self, page: str):
        self.page, self._none = page, set()

    def find(self, what: str, at: int) -> int:
        found = -1 if what in self._none else self.page.find(what, at)
        if found < 0:
            self._none.add(what)
        return found

    def end_of_raw(self, name: str, at: int) -> tuple[int, int] | None:
        """Begin and end of the end tag of a raw element."""
        if name in self._none:
            return None
        found = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(self.page, at)
        if found is None:
            self._none.add(name)
        return found and found.span()

    def end_of_tag(self, at: int) -> int:
        """The > of a tag, quoted ones aside; -1 without any."""
        first = self.find(">", at)
        while first >= 0:
            at = _PLAIN.match(self.page, at).end()
            if at >= len(self.page):
                return first
            if self.page[at] == ">":
                return at
            closing = self.find(self.page[at], at + 1)
            if closing < 0:
                return first
            at = closing + 1
        return -1


def walk(page: str, top: _Path) -> Iterator[tuple[_Path, str | None, bool]]:
    """Elements (path, None, whether a block) as they begin, ends of blocks (path, "", True) and text nodes, in page order."""
    here, at, read, open_ = top, 0, _Reader(page), {}
    begun = 0  # of the text under way

    def left(to: _Path) -> _Path:
        """Leaves what is open down to ``to``."""
        p = here
        while p is not to:
            open_[p.name] -= 1
            p = p.parent
        return to

    while (at := read.find("<", at)) >= 0:
        tag = _NAME.match(page, at)
        if page.startswith("<!--", at):
            end = read.find("-->", at + 4)
            stop = end + 3 if end >= 0 else len(page)
        elif tag is None:
            if page[at + 1 : at + 2] not in ("!", "?", "/"):
                at += 1
                continue
            end = read.find(">", at)
            stop = end + 1 if end >= 0 else len(page)
        else:
            end = read.end_of_tag(tag.end())
            if end < 0:
                break
            stop = end + 1
        if at > begun:
            yield here, page[begun:at], False
        begun = at = stop
        if tag is None:
            continue
        name, given = tag[2].lower(), page[tag.end() : end]
        closed = given.endswith("/")
        if not tag[1] and name in _RAW and not (closed and name in _MARKUP):
            span = read.end_of_raw(name, stop)
            if span is not None or name not in _MARKUP:
                begun = at = span[1] if span else len(page)
                continue
        if tag[1]:
            if open_.get(name):
                p = here
                while p.name != name:
                    p = p.parent
                here = left(p.parent)
                if name not in _INLINE:
                    yield here, "", True
            elif name == "p":
                yield here, "", True
            continue
        if name in _CLOSES_P and open_.get("p"):
            p = here
            while p is not top and p.name != "p" and p.name not in _BORDER:
                p = p.parent
            if p.name == "p":
                here = left(p.parent)
        if name in _SIBLINGS:
            p = here
            while p is not top and p.name not in _SIBLINGS[name] and p.name not in _BORDER:
                p = p.parent
            while p is not top and p.name in _SIBLINGS[name]:
                here = left(p.parent)
                p = here
        named = {a.lower(): " ".join((b or c or d).split()) for a, b, c, d in reversed(_NAMED.findall(given))} if given else {}
        path = here.child(name, " ".join(named[k] for k in ("class", "id", "role") if named.get(k)), named.get("role", "").lower())
        yield path, None, name not in _INLINE
        if name == "br":
            yield here, " ", False
        if name not in _VOID and not closed and here.depth < DEPTH:
            here = path
            open_[name] = open_.get(name, 0) + 1
    if begun < len(page):
        yield here, page[begun:], False


#: Sums over a host's pages: pages with the token, occurrences, the vector (v1, v2), plain, link and heading characters
#: inside, all plain characters of these pages, the place of its first occurrence, and of the first plain text right
#: in it (with how many pages have such).
SUMS = ("pages", "total", "v1", "v2", "chars", "links", "heads", "around", "start", "first", "firsts")
FACTS = "host string, token long, parent long, step string, depth int, aside boolean, " + ", ".join(f"{c} long" for c in SUMS)


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = [zlib.compress(x.encode("utf-8", "surrogatepass"), 1) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_pydict({"host": batch.column("host"), "same": batch.column("same"), "html": pa.array(pages, pa.binary())})


class _Seen:
    """What one page shows of a token."""

    __slots__ = ("chars", "first", "heads", "links", "path", "start", "times", "under")

    def __init__(self, path: _Path | None, under: int, start: int):
        self.path, self.under, self.start = path, under, start
        self.times = self.chars = self.links = self.heads = 0
        self.first = -1


def seen(page: str, top: _Path) -> dict[int, _Seen]:
    """The tokens of a page; none where it has no element."""
    found = {top.key: _Seen(top, top.key, 0)}
    found[top.key].times = 1
    groups: dict[int, int] = {}
    for at, (path, text, _) in enumerate(walk(page, top)):
        if text is None:
            t = found.get(path.key)
            if t is None:
                t = found[path.key] = _Seen(path, path.parent.key, at)
            t.times += 1
            continue
        text = " ".join(text.split())
        if not text:
            continue
        key = _hash(f"{path.key}\0{text}")
        t = found.setdefault(key, _Seen(None, path.key, at))
        t.times += 1
        if path.aside:
            continue
        x = found[path.key]
        if path.link:
            x.links += len(text)
            continue
        t.chars += len(text)
        x.chars += len(text)
        x.heads += len(text) if path.head else 0
        if path.key not in groups:
            groups[path.key] = next(p.key for p in path.chain() if p.name in _GROUPS)
        g = found[groups[path.key]]
        g.first = at if g.first < 0 else g.first
    # what lies in an element is what lies right in it and in the elements below
    for x in sorted((x for x in found.values() if x.path is not None and x.path is not top), key=lambda x: -x.path.depth):
        o = found[x.under]
        o.chars, o.links, o.heads = o.chars + x.chars, o.links + x.links, o.heads + x.heads
    return found if any(t.path is not None and t.path is not top for t in found.values()) else {}


def _facts(found: dict[int, _Seen], host: str | None, seed: int, top: _Path) -> Iterator[list]:
    """Rows of ``FACTS`` of one page."""
    for key, t in found.items():
        x = ((seed + t.times * 0x9E3779B97F4A7C15) & _M64) * 0xFF51AFD7ED558CCD & _M64
        x ^= x >> 31
        p = t.path
        yield [
            host, key, t.under, p.step if p else None, p.depth if p else None, p.aside if p else None,
            1, t.times, x & _M31, (x * 0xC4CEB9FE1A85EC53 & _M64) >> 33, t.chars, t.links, t.heads, found[top.key].chars, t.start, max(t.first, 0), int(t.first >= 0),
        ]


def _count(batches: Iterator[pa.RecordBatch], squeezed: bool) -> Iterator[pa.RecordBatch]:
    """The sums of a batch for each host and token."""
    names = [f.split()[0] for f in FACTS.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), *[pa.int64()] * len(SUMS)]
    for batch in batches:
        sums: dict[tuple[str, int], list] = {}
        top = root()
        for host, same, page in zip(*(batch.column(c).to_pylist() for c in ("host", "same", "html")), strict=True):
            page = zlib.decompress(page).decode("utf-8", "surrogatepass") if squeezed else page
            for row in _facts(seen(page, top), host, _hash(f"{host}\0{same}"), top):
                have = sums.setdefault((host, row[1]), row)
                if have is not row:
                    for i in range(6, len(row)):
                        have[i] += row[i]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*sums.values(), strict=True) if sums else [()] * len(names), types, strict=True)], names=names)


TEMPLATE = "host string, pages long, containers array<struct<container:long,without:array<long>>>, constants array<long>, classes array<struct<pages:long,parent:int,tokens:array<string>>>"


class _Template:
    """The nested classes of a host's frequent tokens, and its slots."""

    def __init__(self, tokens: list[dict]):
        top = root().key
        self.base = next(t for t in tokens if t["token"] == top)
        self.elements = {t["token"]: t for t in tokens if t["step"] is not None}
        classes: dict[tuple, list[dict]] = {}
        for t in self.elements.values():
            classes.setdefault(self.vector(t), []).append(t)
        self.number: dict[tuple, int] = {}
        self.nested: list[dict] = []
        for v in sorted(classes, key=lambda v: min(t["depth"] for t in classes[v])):
            around = {-1} if self.base in classes[v] else {self._above(t) for t in classes[v]}
            if len(around) == 1 and None not in around:
                self.number[v] = len(self.nested)
                self.nested.append({"pages": v[0], "parent": around.pop(), "tokens": sorted(self.path(t) for t in classes[v])})
        #: Elements that own a slot, and the one around each.
        self.slots = {k: t for k, t in self.elements.items() if self.vector(t) in self.number and t["total"] == t["pages"] and t["step"].partition(".")[0] in _GROUPS and not t["aside"]}
        self.outer = {k: next((x["token"] for x in self.around(t) if x["token"] in self.slots), None) for k, t in self.slots.items()}

    @staticmethod
    def vector(t: dict) -> tuple:
        return t["pages"], t["total"], t["v1"], t["v2"]

    def around(self, t: dict) -> Iterator[dict]:
        """The elements around a token, innermost first."""
        while t["parent"] != t["token"] and (t := self.elements.get(t["parent"])) is not None:
            yield t

    def path(self, t: dict) -> str:
        return ">".join([x["step"] for x in self.around(t)][::-1] + [t["step"]])

    def _above(self, t: dict) -> int | None:
        """The valid class of the nearest element around that isn't of the token's own class."""
        p = next((x for x in self.around(t) if x is self.base or self.vector(x) != self.vector(t)), None)
        return self.number.get(self.vector(p)) if p is not None else None

    def within(self, k: int, other: int) -> bool:
        while k is not None and k != other:
            k = self.outer[k]
        return k is not None

    def own(self, k: int) -> int:
        """Plain text in a slot and in none below."""
        return self.slots[k]["chars"] - sum(self.slots[c]["chars"] for c, o in self.outer.items() if o == k)

    def containers(self) -> list[int]:
        """Template elements that hold most text, innermost first; one of each class, as pages have all of a class or none."""
        found = sorted((-t["depth"], -t["pages"], k) for k, t in self.slots.items() if t["chars"] >= HOLDS * max(t["around"], 1))
        first: dict[tuple, int] = {}
        for *_, k in found:
            first.setdefault(self.vector(self.slots[k]), k)
        return list(first.values())

    def grown(self, k: int) -> int:
        """The container with the headings beside it."""
        while (o := self.outer[k]) is not None and self.slots[o]["step"].partition(".")[0] not in ("", "html", "body") and self.slots[o]["heads"] > self.slots[k]["heads"]:
            k = o
        return k

    def without(self, container: int) -> list[int]:
        """Slots inside a container that hold no main text."""
        inside = [k for k in self.slots if self.within(k, container)]
        main = max(inside, key=lambda k: (self.own(k), -self.slots[k]["depth"], k))
        top = self.slots[main]
        begins = top["first"] / top["firsts"] if top["firsts"] else top["start"] / top["pages"]
        out = []
        for k in inside:
            t = self.slots[k]
            if k == main or self.within(main, k):
                continue
            mean, lead = t["chars"] / t["pages"], self.own(main) / top["pages"]
            early = t["start"] / t["pages"] < begins
            if t["links"] > t["chars"] or not early or not t["heads"] and (mean < LEAD_CHARS or mean < LEAD * lead):
                out.append(k)
        return out


def deduce(tokens: list[dict]) -> dict:
    """The template of one host from its frequent tokens."""
    made = _Template(tokens)
    containers = list(dict.fromkeys(map(made.grown, made.containers())))
    held = set(containers)
    inside = lambda t: any(x["token"] in held for x in made.around(t))
    same: dict[tuple, list[dict]] = {}
    for t in tokens:
        if t["step"] is None and t["total"] == t["pages"] >= PAGES and made.vector(t) in made.number:
            same.setdefault(made.vector(t), []).append(t)
    constants: list[int] = []
    for texts in same.values():
        copies = sum(t["chars"] for t in texts if inside(t)) >= HOLDS * max(texts[0]["around"], 1)
        constants += [t["token"] for t in texts if not copies or not inside(t)]
    without = [{"container": k, "without": sorted(made.without(k))} for k in containers]
    return {"host": made.base["host"], "pages": made.base["pages"], "containers": without, "constants": sorted(constants), "classes": made.nested}


def _distinct(keyed: DataFrame) -> DataFrame:
    """Facts of each distinct page (host, same, html). Only pages that may have a copy are shuffled, to meet it; where
    the hashes of those are more than ``COPIED``, all are."""
    key = F.xxhash64("host", "same")
    copied = common.pin(keyed.groupBy(key.alias("_key")).count().filter("count > 1").select("_key"))

    def met(df: DataFrame) -> DataFrame:
        squeezed = df.mapInArrow(_squeezed, "host string, same string, html binary")
        return squeezed.groupBy("host", "same").agg(F.any_value("html").alias("html")).mapInArrow(lambda it: _count(it, True), FACTS)

    n = copied.count()
    if n > COPIED:
        return met(keyed)
    once = keyed.join(F.broadcast(copied), key == F.col("_key"), "left_anti") if n else keyed
    once = once.mapInArrow(lambda it: _count(it, False), FACTS)
    return once.unionByName(met(keyed.join(F.broadcast(copied), key == F.col("_key"), "left_semi"))) if n else once


def templates(pages: DataFrame) -> DataFrame:
    """A row for each host with enough pages, and one of host null for all pages together. Pinned."""
    counted = _distinct(pages.select(F.expr(_HOST_SQL).alias("host"), F.md5(F.col("html").cast("binary")).alias("same"), "html").filter("html is not null"))
    sums = [*(F.any_value(c).alias(c) for c in ("parent", "step", "depth", "aside")), *(F.sum(c).alias(c) for c in SUMS)]
    facts = common.pin(counted.groupBy("host", "token").agg(*sums))
    top = F.lit(root().key)
    whole = facts.filter((F.col("token") == top) & (F.col("pages") >= PAGES)).select(F.col("host").alias("_host"), F.col("pages").alias("_pages"))
    frequent = facts.join(common.small(whole), F.col("host") == F.col("_host")).filter(F.col("pages") >= SUPPORT * F.col("_pages")).drop("_host", "_pages")
    everywhere = facts.groupBy("token").agg(*sums).select(F.lit(None).cast("string").alias("host"), *(c for c in facts.columns if c != "host"))
    all_pages = facts.filter(F.col("token") == top).agg(F.sum("pages")).first()[0] or 0
    everywhere = everywhere.filter((F.col("pages") >= SUPPORT * all_pages) & F.lit(all_pages > 0))
    make = lambda df: df.groupBy("host").applyInArrow(lambda t: pa.Table.from_pylist([deduce(t.to_pylist())], schema=_schema()), TEMPLATE)
    return common.pin(make(frequent).unionByName(make(everywhere)))


def _schema() -> pa.Schema:
    each = pa.struct([("pages", pa.int64()), ("parent", pa.int32()), ("tokens", pa.list_(pa.string()))])
    containers = pa.list_(pa.struct([("container", pa.int64()), ("without", pa.list_(pa.int64()))]))
    return pa.schema([("host", pa.string()), ("pages", pa.int64()), ("containers", containers), ("constants", pa.list_(pa.int64())), ("classes", pa.list_(each))])


def _alone(page: str, top: _Path) -> list[dict]:
    """The containers of a page that is its own template."""
    names = [f.split()[0] for f in FACTS.split(", ")]
    tokens = [dict(zip(names, row, strict=True)) for row in _facts(seen(page, top), None, 0, top)]
    # on one page, what is there equally often has the same vector: only elements that are there once say anything
    return deduce([t for t in tokens if t["total"] == 1 and t["step"] is not None])["containers"] if tokens else []


def main_text(page: str | None, containers: list[dict], constants: frozenset[int], top: _Path) -> str:
    """The text of the slots of the first container that the page has; the page's own if it has none, or else all text."""
    if not page:
        return ""
    texts: list[tuple[int, str, bool, _Path]] = []
    number = 0
    for path, text, block in walk(page, top):
        number += block
        if text:
            texts.append((number, text, bool(constants) and _hash(f"{path.key}\0{' '.join(text.split())}") in constants, path))
    around: dict[int, frozenset[int]] = {}

    def within(path: _Path) -> frozenset[int]:
        """Which of the wanted elements a path lies in."""
        todo = []
        for p in path.chain():
            if p.key in around:
                break
            todo.append(p)
        for p in reversed(todo):
            held = around[p.parent.key] if p.parent else frozenset()
            around[p.key] = held | {p.key} if p.key in wanted else held
        return around[path.key]

    def told(container: dict | None, whole: bool, set_aside: bool) -> str:
        blocks: dict[int, list[str]] = {}
        without = frozenset(container["without"]) if container else frozenset()
        for k, text, fixed, path in texts:
            if (set_aside or not path.aside) and (whole or not fixed) and (container is None or container["container"] in within(path) and not without & within(path)):
                blocks.setdefault(k, []).append(text)
        made = [" ".join(html.unescape("".join(b)).split()) for b in blocks.values()]
        return "\n\n".join(b for b in made if b)

    for given in (containers, None):
        if given is None:
            given = _alone(page, top)
            around.clear()
        wanted = {k for c in given for k in (c["container"], *c["without"])}
        held = frozenset().union(*(within(path) for *_, path in texts))
        for container in given:
            if container["container"] in held:
                for whole in (False, True):  # constants stay where nothing is left without
                    if text := told(container, whole, False):
                        return text
    return told(None, True, False) or told(None, True, True)


EXTRACTED = "page_id long, url string, text string, n_chars long"


def _extract(batches: Iterator[pa.RecordBatch], everywhere: tuple[list[dict], frozenset[int]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        top, texts, known = root(), [], {}
        for page, host, containers, constants in zip(*(batch.column(c).to_pylist() for c in ("html", "_host", "containers", "constants")), strict=True):
            if containers is None:
                texts.append(main_text(page, *everywhere, top))
            else:
                fixed = known.setdefault(host, frozenset(constants))
                texts.append(main_text(page, containers, fixed, top))
        yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})


_HOST_SQL = r"coalesce(lower(regexp_replace(regexp_extract(url, '^[a-zA-Z][\\w+.-]*://([^/?#]*)', 1), '^.*@', '')), '')"


def extract(pages: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    found = templates(pages) if found is None else found
    rest = found.filter("host is null").first()
    everywhere = ([c.asDict() for c in rest["containers"]], frozenset(rest["constants"])) if rest else ([], frozenset())
    sites = found.filter("host is not null").select("host", "containers", "constants")
    numbers = F.size("constants") + F.aggregate("containers", F.lit(0), lambda n, c: n + 1 + F.size(c["without"]))
    rows = pages.select(F.col("page_id").cast("long"), "url", "html", F.expr(_HOST_SQL).alias("_host"))
    rows = rows.join(common.small(sites, cells=numbers), F.col("_host") == F.col("host"), "left").drop("host")
    return rows.mapInArrow(lambda it: _extract(it, everywhere), EXTRACTED)
