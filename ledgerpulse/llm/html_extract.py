"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host.

Each page is an expression over tags and text slots. Expressions of one host
are aligned one after the other: where they disagree, what only one has becomes
optional, neighbours of one kind become a repeated group, and differing text
becomes a slot. Every task first aligns its own pages, so a host with a third of
all pages reaches the later rounds as one expression per task; these are
aligned in salted groups and then per host. Each slot knows whether its text is
the same on all pages. By that the wrapper tells where the article stands on the
host's pages, which blocks are menus and which texts belong to the template; the
other slots are read from every page.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from typing import Any, NamedTuple

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerpulse.llm.frames import unused
from ledgerpulse.llm.markup import BLOCK, Paths, events
from ledgerpulse.session import stage

#: Groups in which a host's expressions are aligned before they meet.
SALTS = 32
#: Hosts whose expressions a task holds before it passes them on.
HOSTS = 2000
#: Levels of an expression; what is deeper counts as text of the last one. Pages are read at any depth.
DEPTH = 96
#: Nodes on one level of an expression that are aligned. A longer level becomes a set of kinds, in which kinds of few pages
#: (ids that differ by page, for instance) are one kind per element name.
LEVEL = 64
#: Characters of a slot's text that an expression holds; of a longer text a digest tells the whole.
SLOT = 200
#: Pages of which not even one character in this many differs are copies of one page and tell nothing about a template.
COPIES = 10
#: An article element counts as a teaser where the rest of its main or content element has more than this many times its text.
TEASER = 2

# Elements, classes and roles that mark what is not the article.
ASIDE_TAGS = frozenset("nav footer aside form button dialog".split())
#: Elements whose content browsers do not show as text of the page.
HIDDEN_TAGS = frozenset("select datalist textarea title iframe noframes template annotation annotation-xml desc metadata".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
ASIDE_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu
    breadcrumb breadcrumbs sidebar sidenav aside footer cookie cookies consent gdpr notice notices notification alert popup modal
    overlay newsletter subscribe subscription signup login search searchbox share sharing social related recommended
    recommendations trending comment comments commentlist disqus replies respond widget widgets toolbar pagination pager copyright
    disclaimer masthead topbar skip""".split()
)
#: Of these, words of everyday language, and the words that name parts of a page beside them: "share-bar", not "share-price".
EVERYDAY_WORDS = frozenset(
    """share sharing social comment comments replies respond related recommended recommendations trending search notice notices
    notification alert copyright disclaimer subscription promotion banner menu""".split()
)
PART_WORDS = frozenset(
    """area articles bar block body bottom box button buttons col column container content count footer form group header icon icons
    inline inner item items left link links list outer panel post posts right row section site slot stories text thread title tools
    top unit wrap wrapper""".split()
)
TEASER_WORDS = frozenset(["card", "cards", "teaser", "teasers", "tile", "preview"])
CONTAINERS = frozenset("html body main article section div center table tbody tr td".split())
FRAME_WORDS = frozenset(["has", "with", "no", "page", "layout", "container", "wrapper"])
MAIN_WORDS = frozenset(["article", "post", "entry", "story", "content", "main"])
INLINE = frozenset("abbr acronym b bdi bdo big cite code del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())

_PART = re.compile(r"([.#@])([^.#@]+)")
_WORD = re.compile(r"[^a-z]+")

Node = list  # [key, optional, repeated, children or shared text or None, pages, characters, trace of the texts or None]
TEXT = "#text"
_TRACE = 2**61 - 1


def _name(key: str) -> str:
    return re.split(r"[.#@]", key.removeprefix("~"), maxsplit=1)[0]


def _words(key: str) -> tuple[str, set[str], set[str]]:
    """The name of an element key, the words of its classes and id, and its roles."""
    key = key.removeprefix("~")
    name = _name(key)
    words, roles = set(), set()
    for sign, value in _PART.findall(key[len(name) :]):
        (roles if sign == "@" else words).update([value] if sign == "@" else _WORD.split(value))
    return name, words - {""}, roles


def is_aside(key: str, inside_article: bool) -> bool:
    """Whether an element is a menu, header, footer, sidebar, notice, advert, form or comment area."""
    name, words, roles = _words(key)
    if name in ASIDE_TAGS or name in HIDDEN_TAGS or roles & ASIDE_ROLES:
        return True
    # the page as a whole is often named after what it has
    named = set() if name in ("html", "body", "main") or words & FRAME_WORDS else words
    return bool(named & ASIDE_WORDS) or not inside_article and (name == "header" or "header" in named and not named & MAIN_WORDS)


def is_doubtful(key: str) -> bool:
    """Whether an element is aside by an everyday word alone, which stands beside a word that names no part of a page."""
    name, words, roles = _words(key)
    if name in ASIDE_TAGS or name in HIDDEN_TAGS or roles & ASIDE_ROLES:
        return False
    for sign, value in _PART.findall(key[len(name) :]):
        parts = set(_WORD.split(value)) - {""}
        if sign != "@" and parts & ASIDE_WORDS and (not parts & ASIDE_WORDS <= EVERYDAY_WORDS or parts <= ASIDE_WORDS | PART_WORDS):
            return False
    return bool(words & EVERYDAY_WORDS)


def folded(key: str) -> str:
    """The kind that stands for a kind of few pages: what the word lists say of it, or its name."""
    if is_aside(key, True):
        return "~aside"
    name, rank = _name(key), _rank(key)
    return ("~article", "~main", "~div.content")[rank] if rank is not None else f"~{name}" if name in BLOCK or name == "a" else "~x"


def _rank(key: str) -> int | None:
    """How surely an element holds the article: 0 article, 1 main, 2 by its class or id."""
    name, words, roles = _words(key)
    if name == "article" or "article" in roles:
        return 0
    if name == "main" or "main" in roles:
        return 1
    return 2 if name in ("div", "section", "td") and words & MAIN_WORDS else None


# --- expressions ---------------------------------------------------------------------------


def leveled(html: str, paths: Paths) -> Iterator[tuple[str, int, str, bool]]:
    """The events of a page and whether an open or close is that of a level of its expression."""
    depth = 0
    for kind, path, value in events(html, paths):
        level = False
        if value not in INLINE and kind in ("open", "close"):
            depth -= kind == "close"
            level = depth < DEPTH
            depth += kind == "open"
        yield kind, path, value, level


def slot(texts: list[str]) -> str:
    """The whole text of a slot, or its start and a digest of the whole."""
    text = " ".join(texts)
    if len(text) <= SLOT:
        return text
    return f"{text[: SLOT // 2]}… {hashlib.sha256(text.encode('utf-8', 'surrogatepass')).hexdigest()}"


def _trace(texts: list[str]) -> int:
    return int.from_bytes(hashlib.blake2b(" ".join(texts).encode("utf-8", "surrogatepass"), digest_size=7).digest(), "little")


def page_expression(html: str) -> list[Node]:
    """The expression of one page: elements with their children, text slots, repeated neighbours grouped."""
    paths = Paths()
    top: list[Node] = []
    levels = [top]

    def whole(level: list[Node]) -> list[Node]:
        return grouped([[TEXT, *n[1:3], slot(n[3]), *n[4:6], _trace(n[3])] if n[0] == TEXT else n for n in level])

    for kind, _, value, level in leveled(html, paths):
        if kind == "open" and level:
            node = [value, False, False, [], 1, 0, None]
            levels[-1].append(node)
            levels.append(node[3])
        elif kind == "close" and level:
            levels.pop()
            owner = levels[-1][-1]
            owner[3] = whole(owner[3])
            owner[5] = sum(c[5] for c in owner[3])
        elif kind == "text" and (text := " ".join(unescape(value).split())):
            here = levels[-1]
            if here and here[-1][0] == TEXT:
                here[-1][3].append(text)
                here[-1][5] += len(text)
            else:
                here.append([TEXT, False, False, [text], 1, len(text), None])
    return whole(top)


def merged(a: Node, b: Node, within: bool = False, repeat: bool = False) -> Node:
    """One node for two of the same key: of two pages, or of one page (within), there perhaps as neighbours (repeat).

    The trace of a slot stays while all pages have the same text, or the same texts one after the other.
    """
    trace = None
    if a[0] == TEXT:
        inner = a[3] if a[3] == b[3] else None
        if a[6] is not None and b[6] is not None:
            trace = (a[6] * 1_000_003 + b[6]) % _TRACE if within else a[6] if a[6] == b[6] else None
    else:
        inner = aligned(a[3], b[3], within)
    return [a[0], a[1] or b[1], a[2] or b[2] or repeat, inner, max(a[4], b[4]) if within else a[4] + b[4], a[5] + b[5], trace]


def aligned(a: list[Node], b: list[Node], within: bool = False) -> list[Node]:
    """The alignment of two levels: common nodes merged, in the order of a longest common subsequence, the others optional."""
    keys_a, keys_b = [x[0] for x in a], [x[0] for x in b]
    if keys_a == keys_b:
        return [merged(x, y, within) for x, y in zip(a, b, strict=True)]
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = 1 + best[i + 1][j + 1] if keys_a[i] == keys_b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and keys_a[i] == keys_b[j] and best[i][j] == 1 + best[i + 1][j + 1]:
            out.append(merged(a[i], b[j], within))
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            out.append([a[i][0], True, *a[i][2:]])
            i += 1
        else:
            out.append([b[j][0], True, *b[j][2:]])
            j += 1
    return grouped(out)


def grouped(level: list[Node]) -> list[Node]:
    """Neighbours of one key as one repeated node, then repeated runs of two to four nodes as one repeated group."""
    out: list[Node] = []
    for node in level:
        if out and out[-1][0] == node[0]:
            out[-1] = merged(out[-1], node, True, True)
        else:
            out.append(node)
    for size in (2, 3, 4):
        i = 0
        while i + 2 * size <= len(out):
            first, second = out[i : i + size], out[i + size : i + 2 * size]
            if [x[0] for x in first] == [x[0] for x in second]:
                run = [merged(x, y, True) for x, y in zip(first, second, strict=True)]
                j = i + 2 * size
                while [x[0] for x in out[j : j + size]] == [x[0] for x in first]:
                    run = [merged(x, y, True) for x, y in zip(run, out[j : j + size], strict=True)]
                    j += size
                key = f"({' '.join(x[0] for x in first)})"
                out[i:j] = [[key, False, True, run, max(x[4] for x in run), sum(x[5] for x in run), None]]
            i += 1
    if len(out) > LEVEL:  # levels of ever new kinds: one node for each kind, in any order and number
        out = _kinds(_ungrouped(out), {})
        if len(out) > LEVEL:
            often = sorted(out, key=lambda x: (-x[4], x[0]))[: LEVEL // 2]
            names = {x[0]: x[0] for x in often} | {TEXT: TEXT}
            out = _kinds(out, {x[0]: x[0] if x[0][0] == "~" else names.get(x[0]) or folded(x[0]) for x in out})
    return out


def _ungrouped(level: list[Node]) -> Iterator[Node]:
    for node in level:
        if node[0][0] == "(":
            yield from _ungrouped(node[3])
        else:
            yield node


def _kinds(level, names: dict[str, str]) -> list[Node]:
    """One optional and repeated node for each kind, under the name given for it."""
    kinds: dict[str, Node] = {}
    for node in level:
        key = names.get(node[0], node[0])
        node = [key, True, True, *node[3:]]
        kinds[key] = merged(kinds[key], node, True) if key in kinds else node
    return list(kinds.values())


def as_pattern(level: list[Node]) -> str:
    """An expression as text: tags, #text for a slot, quoted shared text, ? for optional and + or * for repeated parts."""
    out = []
    for key, optional, repeated, inner, *_ in level:
        if key == TEXT:
            body = TEXT if inner is None else json.dumps(inner, ensure_ascii=False)
        else:
            body = f"({as_pattern(inner)})" if key[0] == "(" else f"<{key}>{as_pattern(inner)}</>"
        out.append(body + {(False, False): "", (True, False): "?", (False, True): "+", (True, True): "*"}[optional, repeated])
    return " ".join(out)


class Sizes(NamedTuple):
    """Characters of a part of a wrapper over all pages, and the number of its links."""

    total: int  # all, but for what is aside
    linked: int  # inside links
    links: int
    varied: int  # in slots whose text is not the same on all of two or more pages
    fresh: int  # of these, outside links
    told: int  # inside article elements, outside links
    told_fresh: int


def sizes(wrapper: list[Node]) -> tuple[Sizes, dict[int, Sizes]]:
    """The sizes of a wrapper and of each of its elements, by the identity of the node."""
    found: dict[int, Sizes] = {}

    def walk(level: list[Node], inside: bool, linked: bool) -> Sizes:
        parts = [Sizes(0, 0, 0, 0, 0, 0, 0)]
        for node in level:
            key, _, repeated, inner, pages, size, trace = node
            if key == TEXT:
                varied = 0 if trace is not None and pages > 1 else size
                parts.append(Sizes(size, size * linked, 0, varied, varied * (not linked), 0, 0))
                continue
            plain = key[0] != "("
            aside = plain and is_aside(key, inside)
            rank = _rank(key) if plain and not aside else None
            link = plain and _name(key) == "a"
            own = walk(inner, inside or rank in (0, 1), linked or link)
            own = own._replace(links=(own.links + link) * (1 + repeated))
            if rank == 0:
                own = own._replace(told=own.total - own.linked, told_fresh=own.fresh)
            found[id(node)] = own
            if not aside:
                parts.append(own)
        return Sizes(*map(sum, zip(*parts, strict=True)))

    return walk(wrapper, False, False), found


def _region(wrapper: list[Node], whole: Sizes, found: dict[int, Sizes]) -> tuple[str, ...]:
    """The innermost container that has all text that differs from page to page, links apart."""
    path: list[str] = []
    level = wrapper
    while True:
        parts = [n for n in level if n[0] != TEXT and found[id(n)].fresh == whole.fresh and (n[0][0] == "(" or _name(n[0]) in CONTAINERS)]
        parts = [n for n in parts if n[0][0] == "(" or not is_aside(n[0], True)]
        if len(parts) != 1:
            return tuple(path)
        path += [] if parts[0][0][0] == "(" else [parts[0][0]]
        level = parts[0][3]


def article_places(wrapper: list[Node]) -> dict[str, list[list[str]]]:
    """What a wrapper tells about paths of the host's pages.

    "0", "1", "2": where the article stands, by falling certainty. An article element beside much more text in its main or
    content element is a teaser. "aside": teasers, and menus: blocks of links that are the same on all pages. "kept": parts of
    the article whose class has an everyday word of the lists, but text of their own on each page. "shared": template text, for
    pages where no element tells the article: what is the same on two pages or more outside the region of the text that
    differs, or as bare text of a container; and blocks that are mostly links. "exact" and "folded": kinds of long levels.
    """
    places: dict[str, list[list[str]]] = {k: [] for k in ("0", "1", "2", "aside", "kept", "shared", "exact", "folded")}
    whole, found = sizes(wrapper)
    several = max((n[4] for n in wrapper), default=0) > 1 and COPIES * whole.fresh >= whole.total - whole.linked and whole.fresh > 0
    region = _region(wrapper, whole, found) if several else ()
    nodes, menus, linked = Counter(), Counter(), Counter()  # by path, which several nodes of a level may have

    def walk(level: list[Node], path: tuple[str, ...], rank_above: int, teasers: bool) -> None:
        if any(n[0][0] == "~" for n in level):
            for n in level:
                places["folded" if n[0][0] == "~" else "exact"].append([*path, n[0]])
        for node in level:
            key, _, repeated, inner, pages, _, trace = node
            if key == TEXT:
                constant = several and inner is not None and trace is not None and pages > 1 and not repeated
                if constant and (path[: len(region)] != region or not path or _name(path[-1]) in CONTAINERS):
                    places["shared"].append([*path, inner])
                continue
            if key[0] == "(":
                walk(inner, path, rank_above, teasers)
                continue
            own, of = (*path, key), found[id(node)]
            nodes[own] += 1
            if is_aside(key, rank_above < 2):
                if not (rank_above < 3 and is_doubtful(key) and 0 < of.total >= 2 * of.linked and (of.fresh or not several)):
                    menus[own] += 1
                    continue
                places["kept"].append(list(own))
            menu = several and pages > 1 and of.links > 1 and not of.varied and 2 * of.linked > of.total
            menus[own] += menu
            linked[own] += of.total > 0 and 2 * of.linked > of.total
            rank = _rank(key)
            below = teasers
            if rank == 0 and teasers:
                rank = None
                if 2 * of.linked > of.total or _words(key)[1] & TEASER_WORDS:
                    menus[own] += not menu
                    continue
            elif rank in (1, 2) and rank_above > 0:
                text, told = (of.fresh, of.told_fresh) if several else (of.total - of.linked, of.told)
                below = teasers or text - told > TEASER * told
            if rank is not None and list(own) not in places[str(rank)]:
                places[str(rank)].append(list(own))
            walk(inner, own, rank_above if rank is None else min(rank, rank_above), below)

    walk(wrapper, (), 3, False)
    places["aside"] = [list(p) for p, n in menus.items() if n == nodes[p]]
    places["shared"] += [[*p, "<links>"] for p, n in linked.items() if n and n == nodes[p]]
    return places


# --- reading pages with a wrapper ------------------------------------------------------------


class Reader:
    """Reads the article of pages of one host, by the places its wrapper has told."""

    def __init__(self, places: dict[str, list[list[str]]]):
        self.roots = [{tuple(p) for p in places.get(rank, ())} for rank in ("0", "1", "2")]
        self.shared, self.aside, self.kept, self.exact, self.folded = (
            {tuple(p) for p in places.get(k, ())} for k in ("shared", "aside", "kept", "exact", "folded")
        )
        self.paths = Paths()
        self.state: dict[int, tuple[int, bool, bool, tuple[str, ...]]] = {0: (3, False, False, ())}

    def _of(self, path: int) -> tuple[int, bool, bool, tuple[str, ...]]:
        """Of a path: the best place it is in, whether it is aside, whether it is a block of links, its keys without inline ones."""
        new = []
        while path not in self.state:
            new.append(path)
            path = self.paths.parents[path]
        found = self.state[path]
        for path in reversed(new):
            rank, aside, links, keys = found
            key = self.paths.keys[path]
            if key not in INLINE:
                deep = len(keys) == DEPTH  # the wrapper has no such places
                if not deep:
                    kind = (*keys, folded(key)) if self.folded else ()
                    keys = kind if kind in self.folded and (*keys, key) not in self.exact else (*keys, key)
                if not aside:
                    if not deep:
                        rank = min([rank, *(r for r in range(3) if keys in self.roots[r])])
                    elif not is_aside(key, rank < 2):
                        rank = min(rank, own) if (own := _rank(key)) is not None else rank
                    aside = not deep and keys in self.aside or is_aside(key, rank < 2 or key.startswith("article")) and (deep or keys not in self.kept)
                links = links or not deep and (*keys, "<links>") in self.shared
            found = self.state[path] = (rank, aside, links, keys)
        return found

    def text(self, html: str | None) -> str:
        # blocks of (raw text, slot); what stands in no place of the article goes by slots, whose whole text may be the template's
        blocks: list[list[list[tuple[str, int]]]] = [[], [], [], []]
        fresh = [True] * 4
        slots: list[tuple[tuple[str, ...], list[str]]] = []  # keys, texts
        levels = [-1]  # the slot that is open on each level
        for kind, path, value, level in leveled(html or "", self.paths):
            if kind == "text":
                rank, aside, links, keys = self._of(path)
                text = " ".join(unescape(value).split())
                if text:
                    if levels[-1] < 0:
                        levels[-1] = len(slots)
                        slots.append((keys, []))
                    slots[levels[-1]][1].append(text)
                if aside or not value:
                    continue
                for r in range(rank, 4):
                    if r == 3 and links:
                        continue
                    if fresh[r]:
                        blocks[r].append([])
                        fresh[r] = False
                    blocks[r][-1].append((value, levels[-1] if text else -1))
                continue
            if kind == "break" or value.split(".", 1)[0].split("#", 1)[0] in BLOCK:
                fresh = [True] * 4
            if level and kind == "open":
                levels[-1] = -1
                levels.append(-1)
            elif level:
                levels.pop()
        for r, found in enumerate(blocks):
            template = {k for k, (keys, texts) in enumerate(slots) if (*keys, slot(texts)) in self.shared} if r == 3 and self.shared else ()
            lines = [line for parts in found if (line := " ".join(unescape("".join(v for v, k in parts if k not in template)).split()))]
            if lines:
                return "\n".join(lines)
        return ""


def host(url: Column) -> Column:
    """The host of a URL, lower-cased; empty where there is none."""
    return F.lower(F.coalesce(F.nullif(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")), F.lit("")))


_WRAPPED = "site string, salt int, wrapper string"


def _infer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One expression per host of a task's pages."""
    salt = TaskContext.get().partitionId() % SALTS
    known: dict[str, list[Node]] = {}

    def out() -> pd.DataFrame:
        rows = [(s, salt, json.dumps(w, ensure_ascii=False)) for s, w in known.items()]
        known.clear()
        return pd.DataFrame(rows, columns=["site", "salt", "wrapper"])

    for batch in batches:
        for site, html in zip(batch["site"], batch["html"], strict=True):
            page = page_expression(html or "")
            known[site] = aligned(known[site], page) if site in known else page
            if len(known) > HOSTS:
                yield out()
    yield out()


def _combine(key: tuple[Any, ...], group: pd.DataFrame) -> pd.DataFrame:
    wrapper = None
    for text in sorted(group["wrapper"]):
        wrapper = json.loads(text) if wrapper is None else aligned(wrapper, json.loads(text))
    return pd.DataFrame({"site": [key[0]], "salt": [0], "wrapper": [json.dumps(wrapper, ensure_ascii=False)]})


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(site, wrapper, pattern, places) for every host of ``pages`` (url, html): the expression, as JSON and as text, and where the article is."""

    def described(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            read = [json.loads(t) for t in texts]
            yield pd.DataFrame({"pattern": [as_pattern(w) for w in read], "places": [json.dumps(article_places(w), ensure_ascii=False) for w in read]})

    own = stage(pages.select(host(F.col("url")).alias("site"), "html").mapInPandas(_infer, _WRAPPED), "expressions")
    salted = own.groupBy("site", "salt").applyInPandas(_combine, _WRAPPED)
    whole = salted.groupBy("site").applyInPandas(_combine, _WRAPPED).drop("salt")
    about = F.pandas_udf(described, "pattern string, places string").asNondeterministic()
    return whole.withColumn("about", about("wrapper")).select("site", "wrapper", "about.*")


def extract_main_text(pages: DataFrame, wrappers: DataFrame | None = None) -> DataFrame:
    """``pages`` (url, html) with a column ``main_text``: the article's blocks in page order, one a line; empty if there is none.

    A null html is empty; a null or odd URL belongs to the host without a name. A column named ``main_text`` is replaced.
    Repeated rows are read alike, and an empty table gives an empty one.
    """
    pages = pages.drop("main_text")
    wrappers = stage((infer_wrappers(pages) if wrappers is None else wrappers).select("site", "places"), "wrappers")
    site, other, places = unused(pages, "page_site", "wrapper_site", "wrapper_places")
    known = wrappers.select(F.col("site").alias(other), F.col("places").alias(places))
    joined = pages.withColumn(site, host(F.col("url"))).join(known, F.col(site) == F.col(other), "left")

    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        readers: dict[str, Reader] = {}
        for htmls, found in batches:
            out = []
            for html, text in zip(htmls, found, strict=True):
                key = text or "{}"
                if key not in readers:
                    if len(readers) > HOSTS:
                        readers.clear()
                    readers[key] = Reader(json.loads(key))
                out.append(readers[key].text(html))
            yield pd.Series(out, dtype="object")

    return joined.withColumn("main_text", F.pandas_udf(read, "string").asNondeterministic()("html", places)).drop(site, other, places)
