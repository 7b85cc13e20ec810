"""Main text of web pages by a tree-structured graphical model.

A page is the tree of its blocks (``html_tree``).  Each node is content or frame; an
element is content if it holds any.  Node potentials
are sums of weights of its features (tag, words of class and id, amount of text, share of links);
each edge has a potential for every pair of states of parent and child.  The tree makes sum-product
message passing exact: messages go up from the leaves, then down from the root, and give each node
its marginal; leaves whose marginal is over one half make the text.

Weights are trained on labelled pages, by gradient ascent on their likelihood with the expectations
of the same message passing: example layouts with labels written out (``LAYOUTS``) or put together from
labelled parts, and pages of the table that label themselves by one ``article`` or ``main`` element, one page of each set of
elements, at most ``TRAIN_PAGES`` of up to ``TRAIN_CHARS`` characters (documented bounds of the fit; every
page is scored).  Training and scoring see a page alike.

Pages are scored in their own tasks, a block of bounded bytes at a time; there is no shuffle of
pages, and nothing but training pages reaches the driver.

Defined cases: null and empty pages have an empty text; text outside any element counts as that of
the page; unclosed comments, scripts and styles reach to the end of the page; scripts, styles,
titles, form fields and the like are never content; character references decode as browsers decode
them (unknown ones stay); white space is that of Unicode; repeated rows come out each; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import small_batches, text_blocks
from ebbtide.llm.html_tree import BODY_WORDS, FRAME_WORDS, Forest, Page, read

TRAIN_PAGES, TRAIN_CHARS = 256, 100_000
STEPS, RATE, PENALTY = 400, 0.05, 0.02
#: Instances of each example layout, with texts of different lengths.
COPIES = 4

# Example layouts, labelled: texts in [] are content, in {} frame; t: title, s: a sentence or two, p: a paragraph,
# q: short or long paragraph, w: one to three words, a: words in a link, n: list of links.
_NAV = "<nav><ul>{n}</ul></nav>"
_LINKS = "<ul>{n}</ul>"
LAYOUTS = (
    f"<body><header>{{w}}{_NAV}</header><article><h1>[t]</h1><p>[q]<p>[q]<p>[q]</article><footer>{{c}}</footer>",
    f"<body>{_NAV}<div class=ad>{{s}}</div><article><h1>[t]</h1><p>[s]</article><footer>{{c}} {{s}}</footer>",
    f"<body>{_NAV}<article><header><h1>[t]</h1></header><p>[q]</p><aside><h4>{{w}}</h4><p>{{q}}</p></aside><p>[q]</p></article><footer>{{c}}</footer>",
    f"<body><div id=header><a href=/>{{w}}</a>{_LINKS}</div><div id=content><h1>[t]</h1><p>[q]</p><p>[q]</p></div><div id=sidebar><h3>{{w}}</h3>{_LINKS}<p>{{q}}</p></div><div id=footer>{{c}}</div>",
    f"<body><div class=navbar>{_LINKS}</div><main><h1>[t]</h1><p>[q]</p><h2>[t]</h2><p>[q]</p><ul><li>[s]</li><li>[s]</li></ul></main><section class=comments><h3>{{w}}</h3><div class=comment><p>{{q}}</p></div><div class=comment><p>{{q}}</p></div></section><footer>{{c}}</footer>",
    f"<body>{_NAV}<main><article><h1>[t]</h1><p>[q]</p><p>[q]</p><section id=comments><h2>{{w}}</h2><article class=comment><p>{{q}}</p></article><article class=comment><p>{{q}}</p></article><form><label>{{w}}</label><p>{{s}}</p></form></section></article><aside class=related><h3>{{w}}</h3>{_LINKS}</aside></main><footer>{{c}}</footer>",
    f"<body><div class=cookie-notice><p>{{s}}</p></div><header><h2>{{w}}</h2></header>{_NAV}<div class=post><h1>[t]</h1><div class=post-body><p>[q]</p><p>[q]</p><blockquote>[q]</blockquote></div><div class=share>{{n}}</div></div><footer><p>{{s}}</p></footer>",
    f"<body><div id=wrapper><div id=top>{_LINKS}</div><div class=story><h1>[t]</h1><div class=text>[q]<br>[q]</div></div><div class=related><p>{{q}}</p>{_LINKS}</div><div class=newsletter><form><p>{{q}}</p></form></div></div>",
    f"<body><table><tr><td>{_LINKS}</td><td class=content><h1>[t]</h1><p>[q]</p><p>[q]</p></td><td class=ads><p>{{q}}</p></td></tr></table>",
    f"<body><div>{_LINKS}</div><div><h1>[t]</h1><p>[p]</p><p>[p]</p><p>[p]</p></div><div>{_LINKS}</div><div>{{c}}</div>",
    f"<body><div class=banner role=banner>{{s}}</div><div class=menu>{_LINKS}</div><div class=article><h1>[t]</h1><p>[q]</p><div class=advert><p>{{q}}</p></div><p>[q]</p><p>[q]</p></div><div class=promo><p>{{q}}</p></div><div class=copyright>{{c}}</div>",
    f"<body>{_NAV}<article class=post><h1>[t]</h1><p>[q]</p><figure><figcaption>[s]</figcaption></figure><table><tr><td>[w]</td><td>[w]</td></tr></table><p>[q]</p><pre>[q]</pre></article><div class=discussion><ol><li><p>{{q}}</p></li><li><p>{{q}}</p></li></ol></div><footer>{_LINKS}{{c}}</footer>",
    f"<body>{_NAV}<main><div class=entry-content><h1>[t]</h1><p>[q]</p><p>[q]</p><div class=subscribe-box><p>{{q}}</p></div><div class=note>{{s}}</div></div></main><aside><section><p>{{q}}</p></section><section>{_LINKS}</section></aside><footer><div><p>{{q}}</p></div></footer>",
    f"<body><div class=consent><p>{{p}}</p></div><div class=page><div class=main><h1>[t]</h1><p>[s]</p></div><div class=sidebar><div class=widget><p>{{p}}</p><p>{{p}}</p></div></div></div><div class=footer>{{s}}{_LINKS}</div>",
    f"<body><header><nav>{_LINKS}</nav><p>{{s}}</p></header><article><h1>[t]</h1><h2>[t]</h2><p>[s]</p><nav class=toc>{_LINKS}</nav><p>[q]</p><dl><dt>[w]<dd>[s]</dl><footer><p>{{s}}</p></footer></article><section class=replies><p>{{p}}</p><p>{{p}}</p><p>{{p}}</p></section>",
    f"<body><form action=/search><p>{{w}}</p></form>{_NAV}<article><h1>[t]</h1></article><footer>{{c}}</footer>",
    f"<body>{_NAV}<div class=alert role=alert><p>{{s}}</p></div><article><p>[q]</p><div><p>[q]</p><div><p>[q]</p></div></div><div class=ad>{{s}}</div><p>[q]</p></article><div id=disqus_thread><div><p>{{p}}</p></div><div><p>{{p}}</p></div></div><footer>{{c}}</footer>",
    f"<body><div class=breadcrumbs>{{n}}</div><div itemprop=articleBody><h1>[t]</h1>[q]<p>[q]<p>[q]</div><div class=trending>{_LINKS}<p>{{q}}</p></div><div class=legal><p>{{p}}</p></div>",
    f"<body>{_NAV}<section><h1>[t]</h1><p>[p]</p><p>[q]</p></section><section class=user-comments><h2>{{w}}</h2><p>{{p}}</p><p>{{q}}</p></section><footer>{{c}}</footer>",
    f"<body><div class=popup><form><h2>{{w}}</h2><p>{{q}}</p></form></div><div class=layout><aside class=left-rail>{_LINKS}</aside><div class=blog-entry><h1>[t]</h1><p>[q]</p><ol><li>[q]<li>[q]</ol></div></div><div class=site-footer><div>{_LINKS}</div>{{c}}</div>",
    f"<body>{_NAV}<article><h1>[t]</h1><p>[q] [a] [q]</p><p>[a]</p><p>[q]</p></article><aside>{{p}}</aside><div class=sponsored>{{p}}</div><footer>{{p}}</footer>",
)


#: Layouts put together from the parts below, besides the written ones.
COMPOSED = 240
_BODY_PARTS = ("<p>[q]</p>",) * 6 + (
    "<p>[q]", "<p>[s]</p>", "<h2>[t]</h2><p>[q]</p>", "<h3>[t]</h3><p>[s]</p>", "<ul><li>[s]</li><li>[q]</li></ul>", "<ol><li>[s]<li>[s]</ol>",
    "<blockquote><p>[q]</p></blockquote>", "<blockquote>[s]</blockquote>", "<figure><figcaption>[s]</figcaption></figure>", "<pre>[q]</pre>",
    "<table><tr><th>[w]</th><td>[w]</td></tr><tr><td>[w]</td><td>[s]</td></tr></table>", "<dl><dt>[w]<dd>[s]</dl>", "<div><p>[q]</p></div>",
    "<div>[q]</div>", "<section><h2>[t]</h2><p>[q]</p></section>", "<p>[q] [a] [q]</p>", "[q]<br>[q]")
_FRAME_PARTS = ("{s}", "<p>{s}</p>", "<p>{q}</p>", "<p>{q}</p><p>{q}</p>", "<ul>{n}</ul>", "<h3>{w}</h3><ul>{n}</ul>", "<h3>{w}</h3><p>{q}</p>",
                "<div><p>{q}</p></div><div><p>{q}</p></div>", "<ol><li><p>{q}</p></li><li>{q}</li></ol>", "<article><p>{q}</p></article>",
                "<h2>{w}</h2><form><label>{w}</label><p>{s}</p></form>", "<blockquote>{q}</blockquote>", "<table><tr><td>{w}</td><td>{s}</td></tr></table>")


def composed(rng: np.random.Generator) -> str:
    """A layout of random parts: frame before, in and after a main block of random making."""
    one = lambda items: items[int(rng.integers(0, len(items)))]
    frame_words, body_words = sorted(FRAME_WORDS), sorted(BODY_WORDS)

    def frame(tags: tuple[str, ...] = ("div", "div", "section", "aside", "nav", "footer", "header", "form", "ul")) -> str:
        tag, inner = one(tags), one(_FRAME_PARTS)
        if tag == "ul":
            return f'<ul class="{one(frame_words)}">{{n}}</ul>'
        named = tag in ("div", "section") or rng.random() < 0.4
        name = f' {one(("class", "class", "id"))}="{one(("", "site-", "page-", "post-", "x-"))}{one(frame_words)}{one(("", "-list", "-box", "_area"))}"'
        inner = f'<div class="item">{inner}</div>' if rng.random() < 0.2 else inner
        return f"<{tag}{name if named else ''}>{inner}</{tag}>"

    title = one(("<h1>[t]</h1>", "<h1>[t]</h1>", "<header><h1>[t]</h1></header>", "<h1>[t]</h1><p>[s]</p>", ""))
    parts = [one(_BODY_PARTS) for _ in range(int(rng.integers(0 if title else 1, 7)))]
    inside = ("div", "aside", "nav", "form", "ul", "section")
    for _ in range(int(rng.integers(0, 3))):
        parts.insert(int(rng.integers(0, len(parts) + 1)), frame(inside))
    body = title + "".join(parts)
    name = f'{one(("", "post-", "entry-", "main-", "article_"))}{one(body_words)}'
    make = int(rng.integers(0, 7))
    plain = make == 6 and not any(x in body for x in ("{",)) and len(parts) > 1
    body = (f"<article>{body}</article>" if make <= 1 else f"<main>{body}</main>" if make == 2 else f"<main><article class={name}>{body}</article></main>"
            if make == 3 else f"<div id={name}>{body}</div>" if make == 4 else f"<div>{body}</div>" if plain else f"<div class={name}><div>{body}</div></div>")
    around = ("div", "div", "section", "aside", "nav", "form", "ul")
    before = "".join(frame((*around, "header", "header")) for _ in range(int(rng.integers(0, 4))))
    after = "".join(frame((*around, "footer")) for _ in range(int(rng.integers(0, 4)))) + one(("<footer>{c}</footer>", "<footer>{c} {s}</footer>", ""))
    page = before + body + after
    return "<body>" + (f"<div id=wrapper>{page}</div>" if rng.random() < 0.25 else page)


def _filled(layout: str, rng: np.random.Generator) -> tuple[str, list[bool]]:
    """The layout with made-up words, and the label of each of its texts; a text starts with its number."""
    labels: list[bool] = []

    def words(low: int, high: int, end: str = ".") -> str:
        return " ".join("w" * int(k) for k in rng.integers(2, 9, int(rng.integers(low, high + 1)))) + end

    def link() -> str:
        return f"<a href=/x>{words(1, 3, '')}</a>"

    out, i = [], 0
    while i < len(layout):
        if layout[i] not in "[{":
            out.append(layout[i])
            i += 1
            continue
        kind, keep = layout[i + 1], layout[i] == "["
        text = {"t": lambda: words(1, 10, ""), "s": lambda: words(3, 20), "p": lambda: words(25, 120), "c": lambda: "© " + words(1, 12),
                "q": lambda: words(*[(1, 8), (8, 30), (30, 120)][int(rng.integers(0, 3))]), "w": lambda: words(1, 3, ""),
                "a": link, "n": lambda: "".join(f"<li>{link()}" for _ in range(int(rng.integers(2, 9))))}[kind]()
        labels.append(keep)
        mark = f"\ue000{len(labels) - 1}\ue001"
        out.append(text.replace("<li>", f"<li>{mark}") if kind == "n" else mark + text)
        i += 3
    return "".join(out), labels


def examples(seed: int = 11) -> list[tuple[Page, list[bool | None]]]:
    """Labelled trees of the example layouts: the label of each leaf, None for other nodes."""
    rng = np.random.default_rng(seed)
    out = []
    for layout in (*LAYOUTS, *(composed(rng) for _ in range(COMPOSED))):
        for _ in range(COPIES if layout in LAYOUTS else 1):
            source, labels = _filled(layout, rng)
            page = read(source)
            own: list[bool | None] = []
            for k, text in enumerate(page.text):
                if text is None:
                    own.append(None)
                    continue
                own.append(labels[int(text[text.index("\ue000") + 1:text.index("\ue001")])])
                page.text[k] = "".join(part.partition("\ue001")[2] if j else part for j, part in enumerate(text.split("\ue000")))
            out.append((page, own))
    return out


#: Elements that are frame inside an article; what a page says of itself stops there.
_FRAME = frozenset("nav aside footer form".split())


def own_labels(page: Page) -> list[bool | None] | None:
    """Labels of a page that has exactly one article (or, without articles, one main); else None."""
    for name in ("article", "main"):
        found = [i for i, tag in enumerate(page.tag) if tag == name]
        if found:
            break
    if len(found) != 1:
        return None
    inside = [False] * len(page.parent)
    labels: list[bool | None] = [None] * len(page.parent)
    for i in range(1, len(page.parent)):
        inside[i] = i == found[0] or inside[page.parent[i]] and page.tag[i] not in _FRAME
        if page.text[i] is not None:
            labels[i] = inside[i] and not page.silent[i]
    return labels


@dataclass
class Model:
    """Weights of features for the state content; edge potentials by (kind of child, parent's state, child's state)."""
    weights: dict[str, float]
    edges: np.ndarray


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Trees:
    """The structure of a forest, for message passing level by level."""

    def __init__(self, forest: Forest):
        self.parent = np.array(forest.parent, dtype=np.int64)
        depth = np.array(forest.depth, dtype=np.int64)
        self.kind = np.array(forest.leaf, dtype=np.int64)
        self.silent = np.array(forest.silent, dtype=bool)
        order = np.argsort(depth, kind="stable")
        bounds = np.searchsorted(depth[order], np.arange(1, depth.max(initial=0) + 2))
        self.levels = np.split(order, bounds[:-1])

    def marginals(self, unary: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of each node, and of each node with a parent the joint table (parent, child)."""
        n = len(self.parent)
        below = np.zeros((n, 2))
        below[:, 1] = np.where(self.silent, -1e3, unary)
        up = np.zeros((n, 2))
        for level in self.levels[:0:-1]:
            up[level] = _log_sum(edges[self.kind[level]] + below[level][:, None, :], 2)
            np.add.at(below, self.parent[level], up[level])
        full = below.copy()
        joint = np.zeros((n, 2, 2))
        for level in self.levels[1:]:
            around = full[self.parent[level]] - up[level]
            table = edges[self.kind[level]] + around[:, :, None] + below[level][:, None, :]
            table -= _log_sum(table.reshape(-1, 4), 1)[:, None, None]
            joint[level] = np.exp(table)
            full[level] = _log_sum(table, 1)
        share = np.exp(full - full.max(axis=1, keepdims=True))
        return share[:, 1] / share.sum(axis=1), joint


def train(pages: Iterable[tuple[Page, list[bool | None]]]) -> Model:
    """Fit on trees with labelled leaves; an element is content if anything under it is."""
    forest, labels = Forest(), []
    for page, own in pages:
        forest.grow(page)
        labels += [label for label in own if label is not None]
    trees = Trees(forest)
    y = np.zeros(len(forest.parent), dtype=np.int64)
    y[np.flatnonzero(trees.kind)] = labels
    for level in trees.levels[:0:-1]:
        np.maximum.at(y, trees.parent[level], y[level])
    names = {name: k for k, name in enumerate(dict.fromkeys(f for own in forest.features for f in own))}
    owner = np.repeat(np.arange(len(y)), [len(own) for own in forest.features])
    feature = np.array([names[f] for own in forest.features for f in own], dtype=np.int64)
    child = np.flatnonzero(trees.parent >= 0)
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (trees.kind[child], y[trees.parent[child]], y[child]), 1)
    weights, edges = np.zeros(len(names)), np.zeros((2, 2, 2))
    state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(edges), np.zeros_like(edges)]
    for step in range(1, STEPS + 1):
        p, joint = trees.marginals(np.bincount(owner, weights[feature], len(y)), edges)
        slope = np.bincount(feature, (y - p)[owner], len(names)) / forest.pages - PENALTY * weights
        expected = np.stack([joint[child[trees.kind[child] == k]].sum(axis=0) for k in (0, 1)])
        edge_slope = (seen - expected) / forest.pages - PENALTY * edges
        for values, own, at in ((weights, slope, 0), (edges, edge_slope, 2)):
            state[at] = 0.9 * state[at] + 0.1 * own
            state[at + 1] = 0.99 * state[at + 1] + 0.01 * own ** 2
            values += RATE * (state[at] / (1 - 0.9 ** step)) / (np.sqrt(state[at + 1] / (1 - 0.99 ** step)) + 1e-8)
    return Model({name: float(weights[k]) for name, k in names.items()}, edges)


def marginals(forest: Forest, model: Model) -> np.ndarray:
    """P(content) of each node of a forest."""
    weigh = model.weights.get
    unary = np.array([sum([weigh(f, 0.0) for f in own]) for own in forest.features])
    return Trees(forest).marginals(unary, model.edges)[0]


def main_texts(sources: list[str], model: Model) -> list[str]:
    """The main text of each page."""
    forest = Forest()
    for source in sources:
        forest.grow(read(source))
    found: list[list[str]] = [[] for _ in sources]
    if forest.parent:
        for i in np.flatnonzero((marginals(forest, model) > 0.5) & np.array(forest.leaf)).tolist():
            found[forest.page[i]].append(forest.text[i])
    return [" ".join(parts) for parts in found]


def training_pages(pages: DataFrame) -> list[str]:
    """Pages with an article or main, one of each set of elements, in the order of a hash; bounded."""
    base = pages.select(F.col("html").alias("__html")).filter(
        F.col("__html").rlike("(?i)<(article|main)[\\s>]") & (F.length("__html") <= TRAIN_CHARS))
    names = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("__html"), F.lit("<([a-z][a-z0-9-]*)"), F.lit(1))))
    chosen = (base.select(F.xxhash64(names).alias("set"), F.xxhash64("__html").alias("__key"))
              .groupBy("set").agg(F.min("__key").alias("__key")).orderBy(F.xxhash64("set"), "set").limit(TRAIN_PAGES))
    # At most TRAIN_PAGES keys and as many different texts.
    found = (base.withColumn("__at", F.xxhash64("__html")).join(F.broadcast(chosen), F.col("__at") == F.col("__key"), "left_semi")
             .groupBy("__at").agg(F.first("__html").alias("html")))
    return [row["html"] for row in found.orderBy("__at").collect()]


def fit(pages: DataFrame) -> Model:
    """Train on the example layouts and on the pages of the table that label themselves."""
    labelled = list(examples())
    for source in training_pages(pages):
        page = read(source)
        own = own_labels(page)
        if own is not None:
            labelled.append((page, own))
    return train(labelled)


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    model = fit(pages) if model is None else model
    small_batches(pages.sparkSession)
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "html"):
            texts = main_texts([s or "" for s in block.column("html").to_pylist()], model)
            yield pa.record_batch([block.column("page_id"), block.column("url"), pa.array(texts, pa.string()),
                                   pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])
    return pages.select("page_id", "url", "html").mapInArrow(
        run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
