"""Main text of web pages from a tree-structured graphical model.

Every block element of a page is a variable: content (1) or not (0).  Its
potential is linear in features of the element; parent and child share a
potential: one table for plain children, one for children that start a part of
the page, and one for parts inside an article, which say little about it.
Sum-product messages up and down the tree give each element's exact content
marginal.  Weights are fitted by maximum likelihood, with gradients from the
same messages, on labelled pages; ``python -m stockpilot.llm.html_extract``
fits the default model and stores it in ``html_model.json``.
"""

from __future__ import annotations

import functools
import json
import math
import pkgutil
import random
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockpilot.llm.columns import computed
from stockpilot.llm.html_tree import HINTS, Tree, boilerplate_hint, parse

# Kinds of elements that share a weight (fixed values).
KINDS = {
    "p": "p", "article": "article", "main": "article", "nav": "nav", "menu": "nav", "header": "header",
    "footer": "footer", "aside": "aside", "form": "form", "fieldset": "form", "button": "form", "label": "form",
    "legend": "form", "dialog": "form", "li": "list", "ul": "list", "ol": "list", "dl": "list", "dt": "list",
    "dd": "list", "table": "table", "tbody": "table", "thead": "table", "tr": "table", "td": "table", "th": "table",
    "blockquote": "quote", "pre": "quote", "figure": "figure", "figcaption": "figure", "div": "box", "section": "box", "body": "page",
    **{f"h{i}": "heading" for i in range(1, 7)},
}
STARTS_PART = frozenset(("article", "nav", "header", "footer", "aside", "form"))
NAMES = ["bias", *(f"kind {k}" for k in dict.fromkeys([*KINDS.values(), "other"])), *(f"hint {h}" for h in HINTS)]
#: Parts that may stand inside an article, where they weigh otherwise than outside.
PARTS = ["nav", "header", "footer", "aside", "form", "hint"]
NAMES += [f"inner {k}" for k in PARTS]
#: A page without an article or a box named as content may itself be the article.
NAMES += ["lone page", "lone prose", "lone own text", "lone child", "lone box"]
NAMES += ["has text", "log text", "linked", "marks", "log below", "linked below", "short"]
INDEX = {n: i for i, n in enumerate(NAMES)}
TRAINING_PAGES, STEPS, SEED = 800, 300, 11
TABLES = 3
MODEL_FILE = "html_model.json"
DECAY = 5e-5


def features(t: Tree) -> list[list[tuple[int, float]]]:
    """Sparse features of each node."""
    below, linked = list(t.chars), list(t.linked)
    for v in range(len(t.tag) - 1, 0, -1):
        below[t.parent[v]] += below[v]
        linked[t.parent[v]] += linked[v]
    out = []
    inner = inside(t)
    for v, tag in enumerate(t.tag):
        x = [(INDEX["bias"], 1.0), (INDEX["kind " + KINDS.get(tag, "other")], 1.0)]
        x += [(INDEX["hint " + h], 1.0) for h in t.hint[v].split()]
        if inner[v]:
            if (kind := KINDS.get(tag, "other")) in PARTS:
                x.append((INDEX["inner " + kind], 1.0))
            if boilerplate_hint(t.hint[v]):
                x.append((INDEX["inner hint"], 1.0))
        if n := t.chars[v]:
            x += [(INDEX["has text"], 1.0), (INDEX["log text"], math.log1p(n) / 5), (INDEX["linked"], t.linked[v] / n)]
            x += [(INDEX["marks"], min(1.0, 20 * t.marks[v] / n)), (INDEX["short"], float(n < 25))]
        if n := below[v]:
            x += [(INDEX["log below"], math.log1p(n) / 8), (INDEX["linked below"], linked[v] / n)]
        out.append(x)
    if not any(KINDS.get(tag) == "article" or "content" in h for tag, h in zip(t.tag, t.hint)):
        prose = t.chars[0]
        for v in range(1, len(t.tag)):
            if t.parent[v] == 0 and KINDS.get(t.tag[v]) in ("p", "heading", "quote", "list"):
                prose += t.chars[v]
                out[v].append((INDEX["lone child"], 1.0))
            elif t.parent[v] == 0 and KINDS.get(t.tag[v]) == "box":
                out[v].append((INDEX["lone box"], 1.0))
        out[0] += [(INDEX["lone page"], 1.0), (INDEX["lone prose"], math.log1p(prose) / 5), (INDEX["lone own text"], math.log1p(t.chars[0]) / 5)]
    return out


def inside(t: Tree) -> list[bool]:
    """Whether an element stands in an article, or in a box named as content."""
    out = [False] * len(t.tag)
    for v in range(1, len(t.tag)):
        p = t.parent[v]
        out[v] = out[p] or KINDS.get(t.tag[p]) == "article" or "content" in t.hint[p]
    return out


def edge_kinds(t: Tree) -> list[int]:
    """Of each element 0, or 1 if it starts a part of the page, 2 if it starts one inside an article."""
    starts = [KINDS.get(tag, "other") in STARTS_PART or boilerplate_hint(h) for tag, h in zip(t.tag, t.hint)]
    return [int(s) * (2 if i else 1) for s, i in zip(starts, inside(t))]


def sum_product(t: Tree, u: list[float], tables, edges: bool = False):
    """P(content) of each node by messages up and down the tree; with ``edges``
    also the joint marginals of each node and its parent."""
    n = len(u)
    one = [math.exp(max(-30.0, min(30.0, x))) for x in u]
    up0, up1 = [1.0] * n, one[:]
    to0, to1 = [1.0] * n, [1.0] * n  # a node's message to its parent
    kinds = edge_kinds(t)
    for v in range(n - 1, 0, -1):
        z = up0[v] + up1[v]
        up0[v] /= z
        up1[v] /= z
        (a, b), (c, d) = tables[kinds[v]]
        m0, m1 = a * up0[v] + b * up1[v], c * up0[v] + d * up1[v]
        to0[v], to1[v] = m0 / (m0 + m1), m1 / (m0 + m1)
        p = t.parent[v]
        up0[p] *= to0[v]
        up1[p] *= to1[v]
        z = up0[p] + up1[p]
        up0[p] /= z
        up1[p] /= z
    all0, all1 = up0[:], up1[:]
    joint = []
    for v in range(n):
        if v:
            p = t.parent[v]
            from0, from1 = all0[p] / max(to0[v], 1e-300), all1[p] / max(to1[v], 1e-300)
            (a, b), (c, d) = tables[kinds[v]]
            if edges:
                j = (from0 * a * up0[v], from0 * b * up1[v], from1 * c * up0[v], from1 * d * up1[v])
                z = sum(j)
                joint.append((v, kinds[v], [x / z for x in j]))
            all0[v] = up0[v] * (from0 * a + from1 * c)
            all1[v] = up1[v] * (from0 * b + from1 * d)
        z = all0[v] + all1[v]
        all0[v] /= z
        all1[v] /= z
    return (all1, joint) if edges else all1


@dataclass
class Model:
    weights: list[float]
    edges: list[float]  # a 2 x 2 table of log potentials, row by row, for each kind of edge

    def tables(self):
        e = [math.exp(x) for x in self.edges]
        return tuple((e[i : i + 2], e[i + 2 : i + 4]) for i in range(0, len(e), 4))

    @classmethod
    def zero(cls) -> Model:
        return cls([0.0] * len(NAMES), [0.0] * (4 * TABLES))

    def marginals(self, t: Tree) -> list[float]:
        w = self.weights
        return sum_product(t, [sum(w[i] * x for i, x in f) for f in features(t)], self.tables())

    def text(self, page: str) -> str:
        t = parse(page)
        if not t.blocks:
            return ""
        p = self.marginals(t)
        return " ".join(text for v, text in t.blocks if p[v] > 0.5)


def fit(pages: list[str], steps: int = STEPS) -> Model:
    """Maximum likelihood by Adam on pages whose elements carry data-label
    (0 or 1; an element without it has its parent's)."""
    trees = [parse(p) for p in pages]
    xs = [features(t) for t in trees]
    n = len(NAMES)
    theta, v, s = ([0.0] * (n + 4 * TABLES) for _ in range(3))
    nodes = sum(len(t.tag) for t in trees)
    for step in range(1, steps + 1):
        m = Model(theta[:n], theta[n:])
        g = [-DECAY * x for x in theta]
        for t, f in zip(trees, xs):
            p, joint = sum_product(t, [sum(theta[i] * x for i, x in row) for row in f], m.tables(), edges=True)
            y = [lab or 0 for lab in t.label]
            for q, lab, row in zip(p, y, f):
                for i, x in row:
                    g[i] += (lab - q) * x / nodes
            for child, kind, j in joint:
                at = n + 4 * kind
                g[at + 2 * y[t.parent[child]] + y[child]] += 1 / nodes
                for k in range(4):
                    g[at + k] -= j[k] / nodes
        for i, x in enumerate(g):
            v[i] = 0.9 * v[i] + 0.1 * x
            s[i] = 0.99 * s[i] + 0.01 * x * x
            theta[i] += 0.15 * (v[i] / (1 - 0.9**step)) / (math.sqrt(s[i] / (1 - 0.99**step)) + 1e-8)
    return Model(theta[:n], theta[n:])


class LabelledPages:
    """Random labelled pages: an article among parts of other kinds, in varied
    markup (semantic tags, boxes with named classes, unclosed paragraphs)."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, lo, hi):
        r = self.r
        some = ["".join(r.choice("aeiou") + r.choice("bdlmnrst") for _ in range(r.randint(1, 4))) for _ in range(r.randint(lo, hi))]
        return " ".join(some)

    def sentence(self):
        s = self.words(3, 18)
        return s[0].upper() + s[1:] + self.r.choice([".", ".", ".", "!", "?"])

    def prose(self, lo=1, hi=6):
        return " ".join(self.sentence() for _ in range(self.r.randint(lo, hi)))

    def links(self, n):
        return "".join(f'<li><a href="/{i}">{self.words(1, 3)}</a></li>' for i in range(n))

    def named(self, kind):
        """Attributes that name a part by a word of its kind, or, if its markup tells it, by one that says nothing."""
        told = kind in ("menu", "foot", "head", "content") and self.r.random() < 0.2
        word = "z" + self.words(1, 1) if told else self.r.choice(HINTS[kind].split())
        return self.r.choice([f'class="{word}"', f'id="{word}"', f'class="x-{word} col-{self.r.randint(1, 9)}"'])

    def box(self, kind, tag, inner):
        r = self.r
        if tag and r.random() < 0.6:
            return f'<{tag} data-label="0"{" " + self.named(kind) if r.random() < 0.4 else ""}>{inner}</{tag}>'
        return f'<div data-label="0" {self.named(kind)}>{inner}</div>'

    def part(self):
        r = self.r
        kind = r.choice(["menu", "advert", "side", "notice", "foot", "head", "form", "menu", "advert"])
        if kind == "menu":
            return self.box("menu", "nav", f"<ul>{self.links(r.randint(2, 9))}</ul>")
        if kind == "form":
            return f'<form data-label="0"><label>{self.words(1, 3)}</label><input name=q><button>{self.words(1, 2)}</button></form>'
        if kind == "foot":
            return self.box("foot", "footer", f"{r.choice(['&copy; 2024 ', ''])}{self.words(1, 5)} &middot; {self.sentence()}")
        if kind == "head":
            return self.box("head", "header", r.choice([f"<h1>{self.words(1, 4)}</h1>", f'<a href="/">{self.words(1, 3)}</a>', f"<p>{self.words(2, 6)}</p>"]))
        inner = r.choice([self.prose(1, 3), f"<p>{self.prose(1, 2)}</p>", f"<h3>{self.words(1, 4)}</h3><ul>{self.links(3)}</ul>"])
        return self.box(kind, "aside" if kind == "side" else None, inner)

    def comments(self):
        r = self.r
        some = "".join(r.choice(["<div>{}</div>", "<p>{}</p>", "<li>{}</li>"]).format(self.prose(1, 3)) for _ in range(r.randint(1, 5)))
        return f'<{(tag := r.choice(["div", "section"]))} data-label="0" {self.named("comment")}><h3>{self.words(1, 2)}</h3>{some}</{tag}>'

    def inner_part(self):
        """What stands inside an article and is no part of its text."""
        r = self.r
        kind = r.choice(["aside", "aside", "form", "footer", "nav", "div"])
        if kind == "form":
            inner = f"<label>{self.words(1, 3)}</label><input name=q><button>{self.words(1, 2)}</button>"
        elif kind == "nav":
            inner = f"<ul>{self.links(r.randint(2, 6))}</ul>"
        else:
            inner = r.choice([self.prose(1, 3), f"<p>{self.prose(1, 2)}</p>", f"<h3>{self.words(1, 4)}</h3><ul>{self.links(3)}</ul>", f"<p>{self.words(1, 4)}</p>"])
        name = self.named(r.choice(["side", "advert"])) if kind == "div" or r.random() < 0.3 else ""
        return f'<{kind} data-label="0" {name}>{inner}</{kind}>'

    def figure(self):
        return f'<figure><img src="x.png">{self.r.choice(["", f"<figcaption>{self.sentence()}</figcaption>"])}</figure>'

    def article(self, plain=False):
        r = self.r
        title = self.words(2, 9)
        out = [f"<h1>{title}</h1>"] if r.random() < 0.8 else []
        if r.random() < 0.35:
            byline = r.choice(["", f"<p>{self.words(2, 5)}</p>", f"<div>{self.sentence()}</div>"])
            out = [f"<header{r.choice(['', ' ' + self.named('head')])}>{''.join(out)}{byline}</header>"]
        parts = r.choice([0, 0, 0, 1, 1, 2])
        for _ in range(r.choice([0, 1, 1, 2, r.randint(1, 10), r.randint(1, 10), r.randint(1, 10)])):
            kind = r.random()
            if kind < 0.6:
                out.append(f"<p>{self.prose()}" + r.choice(["</p>", "</p>", ""]))
            elif kind < 0.7:
                out.append(f"<p><b>{self.sentence()}<br><p>{self.prose()}</p>")
            elif kind < 0.78:
                out.append(f"<h2>{self.words(1, 6)}</h2>")
            elif kind < 0.84:
                out.append("<ul>" + "".join(f"<li>{self.prose(1, 2)}</li>" for _ in range(r.randint(1, 4))) + "</ul>")
            elif kind < 0.9:
                out.append(f'<p>{self.sentence()} <a href="/x">{self.words(1, 3)}</a> {self.prose(1, 2)}</p>')
            elif kind < 0.94:
                out.append(f"<blockquote>{self.prose()}</blockquote>")
            elif kind < 0.97:
                out.append(f"<p>{self.words(1, 2)}.</p>")
            else:
                out.append(r.choice([self.part(), f"<table><tr><td>{self.words(1, 3)}</td><td>{self.sentence()}</td></tr></table>"]))
        if r.random() < 0.12:  # hardly any text
            out = [f"<p>{self.words(1, 6)}.</p>" for _ in range(r.randint(1, 2))]
        out += [self.figure() for _ in range(r.choice([0, 0, 0, 1]))]
        out[1:] = r.sample(out[1:], len(out[1:]))
        for _ in range(parts):
            out.insert(r.randint(0, len(out)), self.inner_part())
        inner = "".join(out)
        if r.random() < 0.25:
            inner = r.choice(["<section>{}</section>", "<div>{}</div>", "<div class=row><div class=col>{}</div></div>"]).format(inner)
        shape = r.random()
        if plain:
            return inner
        if shape < 0.45:
            return f'<article data-label="1">{inner}</article>'
        if shape < 0.6:
            return f'<main data-label="1">{inner}</main>'
        if shape < 0.9:
            return f'<div data-label="1" {self.named("content")}>{inner}</div>'
        return f'<div data-label="1">{inner}</div>'

    def page(self):
        r = self.r
        parts = [self.part() for _ in range(r.randint(0, 3))]
        after = [self.comments()] * (r.random() < 0.3) + [self.part() for _ in range(r.randint(0, 3))]
        if r.random() < 0.15:  # the article stands in the page itself
            text = self.prose(2, 6) if r.random() < 0.6 else ""
            middle = text + self.article(plain=True).replace("<header", '<header data-label="1"')
            return '<html><head><title>x</title></head><body data-label="1">' + "".join([*parts, middle, *after]) + "</body></html>"
        middle = self.article()
        if r.random() < 0.3:
            middle = f"<div>{middle}{self.part()}</div>"
        return "<html><head><title>x</title></head><body>" + "".join([*parts, middle, *after]) + "</body></html>"


def trained_model() -> Model:
    """The default model, fitted on labelled pages."""
    pages = LabelledPages(SEED)
    return fit([pages.page() for _ in range(TRAINING_PAGES)])


@functools.lru_cache(maxsize=1)
def default_model() -> Model:
    """The stored result of ``trained_model`` (by names, so that a stale file is an error)."""
    stored = json.loads(pkgutil.get_data(__package__, MODEL_FILE))
    return Model([stored["weights"][n] for n in NAMES], stored["edges"])


def main() -> None:
    model = trained_model()
    stored = {"weights": {n: round(w, 6) for n, w in zip(NAMES, model.weights)}, "edges": [round(e, 6) for e in model.edges]}
    with open(__file__.rsplit("/", 1)[0] + "/" + MODEL_FILE, "w") as f:
        json.dump(stored, f, indent=1)
        f.write("\n")


def with_main_text(pages: DataFrame, model: Model, keep: list[str], html_col: str = "html") -> DataFrame:
    """``keep`` and ``__main`` per input row, repeated rows alike: the text of
    the blocks whose content marginal is over one half, joined by one space.
    A null or empty page, or one without such a block, has the empty text; an
    empty table gives no rows."""
    return computed(pages, html_col, lambda: lambda some: [[model.text(p) for p in some]], {"__main": pa.string()}, keep)


def op2_html_text(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    out = with_main_text(pages, default_model(), ["page_id", "url"])
    return out.select("page_id", "url", F.col("__main").alias("text"), F.length("__main").cast("long").alias("n_chars"))


if __name__ == "__main__":
    main()
