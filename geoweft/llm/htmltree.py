"""A forgiving HTML reader: elements as a tree, texts as runs inside blocks.

Follows the usual browser rules where they change what text a page shows: end
tags that may be missing, misnested formatting, raw text elements, unclosed
comments and pages that break off. Every scan moves forward only and open
elements are found by name, so the time is linear in the page, however deep it
nests.
"""

from __future__ import annotations

import html as _html
import re
from dataclasses import dataclass, field

# HTML's element categories.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes template".split())
RCDATA = frozenset("title textarea".split())
BLOCK = frozenset(
    """address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer
    form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section
    select summary table tbody td textarea tfoot th thead title tr ul""".split()
)
CLOSES_P = BLOCK - frozenset("body button caption head html legend noscript optgroup option select tbody td textarea tfoot th thead title tr".split())
#: A start tag closes an open element of these names, unless one of the second set stands between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}
CELLS = frozenset(("td", "th", "body"))
SCOPE = frozenset("html table td th caption button template article section main div body".split())

_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_ATTR = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*)))?")
_REST = re.compile(r"[^>]*")


@dataclass
class Tree:
    """Elements by number, parent[i] < i, with the root at 0; their texts, and what raw elements hold."""

    tag: list[str] = field(default_factory=list)
    attrs: list[dict[str, str]] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    #: (block number, element, text with white space as it stands)
    runs: list[tuple[int, int, str]] = field(default_factory=list)
    hidden: list[tuple[int, str]] = field(default_factory=list)

    def add(self, tag: str, attrs: dict[str, str], parent: int) -> int:
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.parent.append(parent)
        return len(self.tag) - 1


def parse(page: str | None) -> Tree:
    page = page or ""
    tree = Tree()
    stack = [tree.add("#root", {}, -1)]  # open elements, and closed ones that others have been opened in since
    named: dict[str, list[int]] = {}  # the open elements of each name, innermost last
    closed: set[int] = set()
    block, i, n = 0, 0, len(page)
    low = None

    def say(text: str) -> None:
        if text:
            tree.runs.append((block, stack[-1], _html.unescape(text) if "&" in text else text))

    def settle() -> None:
        while stack[-1] in closed:
            closed.discard(stack.pop())

    def close_to(e: int) -> None:
        """Closes element ``e`` and all that stands in it."""
        while stack[-1] >= e:
            x = stack.pop()
            if x in closed:
                closed.discard(x)
            else:
                named[tree.tag[x]].pop()
        settle()

    def innermost(names: set[str] | frozenset[str]) -> int:
        return max((named[x][-1] for x in names if named.get(x)), default=0)

    def find(names: set[str] | frozenset[str], until: set[str] | frozenset[str]) -> int:
        """The innermost open element of these names, or 0 if one of ``until`` stands between."""
        e = innermost(names)
        return e if e >= innermost(until) else 0

    while i < n:
        j = page.find("<", i)
        if j < 0:
            say(page[i:])
            break
        if j > i:
            say(page[i:j])
        if page.startswith("<!--", j):
            k = page.find("-->", j + 2)
            i = n if k < 0 else k + 3
            continue
        if page[j + 1 : j + 2] in ("!", "?"):
            k = page.find(">", j)
            i = n if k < 0 else k + 1
            continue
        m = _NAME.match(page, j)
        if not m:
            say("<")
            i = j + 1
            continue
        name, ends, attrs, i = m[1].lower(), page[j + 1] == "/", {}, m.end()
        while (a := _ATTR.match(page, i)) and page[i : a.end()].strip():
            attrs.setdefault(a[1].lower(), _html.unescape(next((g for g in a.groups()[1:] if g is not None), "")))
            i = a.end()
        i = _REST.match(page, i).end()
        if i >= n:
            break  # the page ends within a tag
        i += 1
        if name in BLOCK:
            block += 1
        if ends:
            if name in BLOCK:
                if d := find({name}, SCOPE - {name} if name == "p" else frozenset({"html"}) if name in ("body", "html") else frozenset({"body"})):
                    close_to(d)
            elif d := find({name}, CELLS):
                closed.add(d)  # formatting that blocks have been opened in ends without ending them
                named[name].pop()
                settle()
            continue
        if name in ("html", "body", "head") and named.get(name):
            continue
        if name in CLOSES_P and (d := find({"p"}, SCOPE)):
            close_to(d)
        if name in CLOSES and (d := find(*CLOSES[name])):
            close_to(d)
        if name == "body" and (d := find({"head"}, set())):
            close_to(d)
        if name == "br":
            say(" ")
        e = tree.add(name, attrs, stack[-1])
        if name in VOID:
            continue
        if name in RAW or name in RCDATA:
            low = page.lower() if low is None and page.isascii() else low
            end = low.find(f"</{name}", i) if low is not None else next((x.start() for x in re.compile(f"</{name}", re.I).finditer(page, i)), -1)
            text = page[i:] if end < 0 else page[i:end]
            tree.hidden.append((e, _html.unescape(text) if name in RCDATA else text))
            i = n if end < 0 else end
            continue
        stack.append(e)
        named.setdefault(name, []).append(e)
    return tree


#: Elements whose text a page doesn't show as running text.
UNSHOWN = RAW | RCDATA | {"head", "noscript", "select", "svg", "object", "audio", "video", "canvas", "math"} - {"math"}


def blocks(tree: Tree, shown: list[bool]) -> str:
    """The runs of shown elements: white space as one blank, blocks joined by a line end."""
    out: list[str] = []
    last, parts = -1, []
    for b, e, text in [*tree.runs, (1 << 60, 0, "")]:
        if b != last:
            if s := " ".join("".join(parts).split()):
                out.append(s)
            last, parts = b, []
        if shown[e]:
            parts.append(text)
    return "\n".join(out)


def visible(tree: Tree) -> list[bool]:
    out: list[bool] = []
    for tag, parent in zip(tree.tag, tree.parent):
        out.append((parent < 0 or out[parent]) and tag not in UNSHOWN)
    return out


def visible_text(page: str | None) -> str:
    t = parse(page)
    return blocks(t, visible(t))


def title(tree: Tree) -> str:
    return next((" ".join(x.split()) for e, x in tree.hidden if tree.tag[e] == "title"), "")
