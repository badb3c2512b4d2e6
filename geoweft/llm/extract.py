"""Main text of web pages by a tree-structured graphical model.

Each DOM element is a variable with three states: it holds both kinds of text
(m), it is content (c), or it is anything else (b). Parent-child potentials and
the evidence of tags, names and text shape are counted on labelled pages;
messages pass upward and then downward (sum-product), which is exact on a tree,
and an element's text belongs to the main text where its content marginal is
largest.

A null or empty page, and one without content, has an empty text. Pages are read
whole; scripts, styles and markup never count as text. Repeated rows each get
their text, null ids and urls are kept, further columns are ignored, and an empty
table gives an empty one.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweft.llm.common import map_columns
from geoweft.llm.htmlpages import labelled_pages
from geoweft.llm.htmltree import BLOCK, Tree, blocks, parse, visible

STATES = "mcb"
_TOKEN = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")


def _bucket(n: int, edges: tuple[int, ...]) -> int:
    return sum(n >= e for e in edges)


def evidence(tree: Tree) -> list[list[str]]:
    """The observed features of each element."""
    n = len(tree.tag)
    words, linked, inside = [0] * n, [0] * n, [False] * n
    for i in range(n):
        inside[i] = tree.tag[i] == "a" or (i > 0 and inside[tree.parent[i]])
    for _, e, text in tree.runs:
        k = len(text.split())
        words[e] += k
        linked[e] += k * inside[e]
    for i in range(n - 1, 0, -1):
        words[tree.parent[i]] += words[i]
        linked[tree.parent[i]] += linked[i]
    out = []
    for i in range(n):
        f = [f"tag={tree.tag[i]}", f"words={_bucket(words[i], (1, 4, 13, 60))}"]
        if words[i]:
            f.append(f"links={_bucket(100 * linked[i] // words[i], (1, 30, 70))}")
        if i:
            f.append(f"under={tree.tag[tree.parent[i]]}>{tree.tag[i]}")
        a = tree.attrs[i]
        if a:
            names = " ".join(a.get(k, "") for k in ("class", "id", "role"))
            if names.strip():
                f += {f"name={t}" for t in _TOKEN.findall(_CAMEL.sub(r"\1 \2", names).lower())}
        out.append(f)
    return out


class Model:
    """log potentials: root[s], pair[parent state][state], and feature -> (m, c, b)."""

    def __init__(self, pages: list[str], smoothing: float = 0.3):
        root, pair, seen, total = Counter(), Counter(), {}, Counter()
        for page in pages:
            tree = parse(page)
            labels: list[str] = []
            for i, a in enumerate(tree.attrs):
                labels.append(a.get("data-y") or (labels[tree.parent[i]] if i else "m"))
            for i, f in enumerate(evidence(tree)):
                total[labels[i]] += 1
                (pair.update([(labels[tree.parent[i]], labels[i])]) if i else root.update([labels[i]]))
                for x in f:
                    seen.setdefault(x, Counter())[labels[i]] += 1
        self.root = tuple(math.log((root[s] + smoothing) / (sum(root.values()) + 3 * smoothing)) for s in STATES)
        self.pair = tuple(
            tuple((pair[p, s] + smoothing) / (sum(pair[p, x] for x in STATES) + 3 * smoothing) for s in STATES) for p in STATES
        )
        self.features = {
            x: tuple(math.log((c[s] + smoothing) / (total[s] + 2 * smoothing)) for s in STATES) for x, c in seen.items() if sum(c.values()) > 1
        }

    def marginals(self, tree: Tree) -> list[tuple[float, float, float]]:
        """P(m), P(c), P(b) of each element given the whole page."""
        n, features, pair = len(tree.tag), self.features, self.pair
        own: list[tuple[float, float, float]] = []
        for f in evidence(tree):
            m = c = b = 0.0
            for x in f:
                if (v := features.get(x)) is not None:
                    m, c, b = m + v[0], c + v[1], b + v[2]
            top = max(m, c, b)
            own.append((math.exp(m - top), math.exp(c - top), math.exp(b - top)))
        up: list[tuple[float, float, float]] = [(1.0, 1.0, 1.0)] * n
        for i in range(n - 1, 0, -1):  # children stand behind their parents
            x, y, z = own[i]
            u = [p[0] * x + p[1] * y + p[2] * z for p in pair]
            top = max(u)
            up[i] = (u[0] / top, u[1] / top, u[2] / top)
            px, py, pz = own[tree.parent[i]]
            px, py, pz = px * up[i][0], py * up[i][1], pz * up[i][2]
            top = max(px, py, pz, 1e-300)
            own[tree.parent[i]] = (px / top, py / top, pz / top)
        # own[i] is now the belief of i and all below it
        out: list[tuple[float, float, float]] = []
        for i in range(n):
            x, y, z = own[i]
            if i:
                p, u = out[tree.parent[i]], up[i]
                a, b, c = (p[0] / max(u[0], 1e-300), p[1] / max(u[1], 1e-300), p[2] / max(u[2], 1e-300))
                x *= a * pair[0][0] + b * pair[1][0] + c * pair[2][0]
                y *= a * pair[0][1] + b * pair[1][1] + c * pair[2][1]
                z *= a * pair[0][2] + b * pair[1][2] + c * pair[2][2]
            else:
                x, y, z = x * math.exp(self.root[0]), y * math.exp(self.root[1]), z * math.exp(self.root[2])
            s = x + y + z or 1.0
            out.append((x / s, y / s, z / s))
        return out

    def main_text(self, page: str | None) -> str:
        tree = parse(page)
        if not tree.runs:
            return ""
        seen = visible(tree)
        if not any(t in BLOCK for t in tree.tag):
            return blocks(tree, seen)  # a text without structure
        return blocks(tree, [v and c > max(m, b) for v, (m, c, b) in zip(seen, self.marginals(tree))])


@functools.lru_cache(maxsize=1)
def default_model() -> Model:
    return Model(labelled_pages())


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batch: dict[str, list]) -> dict[str, list]:
        texts = list(map(default_model().main_text, batch["html"]))
        return {**batch, "text": texts, "n_chars": [len(t) for t in texts]}

    return map_columns(
        pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")),
        run,
        "page_id long, url string, text string, n_chars long",
    )
