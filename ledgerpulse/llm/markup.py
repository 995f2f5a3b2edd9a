"""Reading HTML: a token stream with the path of open elements, tolerant of what browsers tolerate."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from html import escape, unescape

# The names that the HTML standard groups so.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noframes".split())
FOREIGN = frozenset(["svg", "math"])
BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th
    thead tr ul""".split()
)
#: What the start of a block closes: a paragraph, and items of the same kind in the innermost list or table.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
#: Elements that a stray end tag inside does not close.
SCOPES = frozenset("article main section aside nav header footer table td th body html".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|</?[a-zA-Z][^>]*(?:>|\Z)", re.DOTALL
)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.IGNORECASE)
_DIGITS = re.compile(r"\d+")


def element_key(name: str, attributes: str) -> str:
    """What tells an element from its siblings across pages: its name, classes, id and role, digits set to 0."""
    if not attributes or "=" not in attributes:
        return name
    parts = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    out = name
    for sign, attribute in ((".", "class"), ("#", "id"), ("@", "role")):
        for word in sorted(set(_DIGITS.sub("0", unescape(parts.get(attribute, ""))).lower().split())):
            out += sign + word
    return out


class Paths:
    """Numbers for paths of element keys, so that a decision about a path is made once."""

    def __init__(self):
        self.numbers: dict[tuple[int, str], int] = {}
        self.parents, self.keys = [-1], [""]

    def child(self, path: int, key: str) -> int:
        found = self.numbers.get((path, key))
        if found is None:
            found = self.numbers[path, key] = len(self.keys)
            self.parents.append(path)
            self.keys.append(key)
        return found

    def names(self, path: int) -> tuple[str, ...]:
        out = []
        while path:
            out.append(self.keys[path])
            path = self.parents[path]
        return tuple(reversed(out))


def events(html: str, paths: Paths) -> Iterator[tuple[str, int, str]]:
    """("open", path, key), ("close", path, key), ("break", path, "") and ("text", path, raw text) in page order.

    Elements may be nested to any depth. What stands in RAW elements is no markup and is left out, but for xmp, which shows
    it; one without an end tag, scripts and styles apart, ends with its parent.
    """
    stack: list[tuple[str, int, str]] = []
    places: defaultdict[str, list[int]] = defaultdict(list)  # where in the stack elements of a name are
    scopes: list[int] = []
    unclosed: set[str] = set()  # names of RAW elements without a further end tag
    path, at, end = 0, 0, len(html)

    def close(depth: int) -> Iterator[tuple[str, int, str]]:
        nonlocal path
        while len(stack) > depth:
            name, own, key = stack.pop()
            places[name].pop()
            if name in SCOPES:
                scopes.pop()
            path = paths.parents[own]
            yield "close", own, key

    def last(name: str) -> int:
        return places[name][-1] if places[name] else -1

    def reachable(name: str) -> int:
        """The innermost element of a name unless a scope is open inside it; -1 for none."""
        depth = last(name)
        return -1 if scopes and scopes[-1] > depth else depth

    while at < end:
        m = TOKEN.search(html, at)
        if m is None:
            yield "text", path, html[at:]
            break
        if m.start() > at:
            yield "text", path, html[at : m.start()]
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            depth = last(name) if name in SCOPES else reachable(name)
            if depth >= 0:
                yield from close(depth)
            if name in BLOCK:
                yield "break", path, ""
            continue
        if m[3].endswith("/") and (name in FOREIGN or any(places[f] for f in FOREIGN)):
            continue
        if name in RAW and name not in unclosed:
            tail = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(html, at)
            if tail or name in ("script", "style"):
                if name == "xmp":
                    yield "break", path, ""
                    yield "text", path, escape(html[at : tail.start()])
                    yield "break", path, ""
                at = tail.end() if tail else end
                continue
            unclosed.add(name)
        if name in BLOCK:
            depth = reachable("p")
            if depth >= 0:
                yield from close(depth)
            if name in CLOSES:
                closed, scope = CLOSES[name]
                nearest = max(map(last, scope))
                inside = [places[c][k] for c in closed if (k := bisect_right(places[c], nearest)) < len(places[c])]
                if inside:
                    yield from close(min(inside))
            yield "break", path, ""
        if name in VOID:
            if name == "br":
                yield "text", path, " "
            continue
        key = element_key(name, m[3])
        path = paths.child(path, key)
        places[name].append(len(stack))
        if name in SCOPES:
            scopes.append(len(stack))
        stack.append((name, path, key))
        yield "open", path, key
    yield from close(0)
