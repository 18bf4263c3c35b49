"""Main text of web pages: boosted trees over the nodes of the DOM, and a decoding that respects the tree.

Every block element and every run of text gets features: what its subtree holds for each tag, links, punctuation, its depth and place,
its siblings, the elements and attribute words around it. Boosted trees give each node the log odds that main text lies in it. The
decoding keeps the set of nodes with the largest sum of log odds in which no node is kept below one that is not, so
no run of a dropped menu survives and no kept paragraph loses its article; it is one pass up the tree and one down.

The trees are fitted on made-up pages (``layouts``) around fragments of the given pages, so no labels are needed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crosspanel.llm import boosted, layouts
from crosspanel.llm.common import col, string_texts
from crosspanel.llm.dom import KINDS, RUN, Dom, parse

#: Bounds of the fit: given pages that lend fragments (and of each its first code points), and pages made of them.
SAMPLE_PAGES = 200
SAMPLE_CHARS = 20_000
MADE_PAGES = 700
#: Fragments where the table has none.
SPARE = ["One two three, four five.", "Six seven eight nine ten, eleven twelve. Thirteen fourteen?", "News", "Read the whole of it here."]

# groups of elements whose place around a node is a feature; fixed values
GROUPS = {
    "article": ["article"], "main": ["main"], "section": ["section"], "nav": ["nav", "menu"], "header": ["header", "hgroup"], "footer": ["footer", "address"],
    "aside": ["aside", "details", "summary"], "form": ["form", "fieldset", "legend", "search"], "list": ["ul", "ol", "dir", "li"], "table": ["table", "tbody", "tr", "td", "th", "thead", "tfoot", "caption"],
    "quote": ["blockquote", "pre"], "figure": ["figure", "figcaption"], "define": ["dl", "dt", "dd"], "p": ["p"], "h1": ["h1"], "heading": ["h2", "h3", "h4", "h5", "h6"], "div": ["div", "center"], "run": [RUN],
}
GROUP_OF = np.zeros(len(KINDS), np.int64)
for _bit, _names in enumerate(GROUPS.values()):
    for _name in _names:
        GROUP_OF[KINDS[_name]] |= 1 << _bit
PUNCTUATION = str.maketrans({c: "\x01" for c in ",.;:!?。，、؟"})


@dataclass(frozen=True)
class Model:
    trees: boosted.Trees
    words: dict[str, float]  # log odds of attribute words


class Forest:
    """The nodes of several pages in one: parents before children, with sums over subtrees by levels."""

    def __init__(self, doms: list[Dom], lengths: list[int]):
        sizes = np.array([len(d.kind) for d in doms], np.int64)
        first = np.concatenate([[0], np.cumsum(sizes)])
        join = lambda name: np.fromiter((v for d in doms for v in getattr(d, name)), np.int64, first[-1])
        self.first, self.page = first, np.repeat(np.arange(len(doms)), sizes)
        self.kind, self.depth, self.start, self.controls, self.links, self.inline = (join(n) for n in ("kind", "depth", "start", "controls", "links", "inline"))
        parent = join("parent")
        self.parent = np.where(parent >= 0, parent + first[:-1][self.page], -1)
        self.text = [t for d in doms for t in d.text]
        self.tokens = [t for d in doms for t in d.tokens]
        self.length = np.maximum(np.array(lengths, np.float64), 1.0)
        order = np.argsort(self.depth, kind="stable")
        edges = np.flatnonzero(np.diff(self.depth[order])) + 1
        self.levels = np.split(order, edges) if len(order) else []

    def up(self, values: np.ndarray) -> np.ndarray:
        """Sums over subtrees."""
        out = values.astype(np.float64)
        for level in self.levels[:0:-1]:
            np.add.at(out, self.parent[level], out[level])
        return out

    def down(self, values: np.ndarray, merge) -> np.ndarray:
        """Each node's value merged with those of its ancestors."""
        out = values.copy()
        for level in self.levels[1:]:
            out[level] = merge(out[self.parent[level]], out[level])
        return out

    def keep(self, logit: np.ndarray) -> np.ndarray:
        """The set of nodes closed towards the root with the largest sum."""
        best = logit.astype(np.float64)
        for level in self.levels[:0:-1]:
            np.add.at(best, self.parent[level], np.maximum(best[level], 0.0))
        return self.down(best > 0, np.logical_and)


def features(f: Forest, words: dict[str, float]) -> np.ndarray:
    n = len(f.kind)
    run = f.kind == KINDS[RUN]
    chars = np.fromiter(map(len, f.text), np.float64, n)
    count = lambda fn: np.fromiter((fn(t) if t else 0 for t in f.text), np.float64, n)
    n_words = count(lambda t: t.count(" ") + 1)
    marks = count(lambda t: t.translate(PUNCTUATION).count("\x01"))
    ends = count(lambda t: t[-1] in ".!?。:;…\"”»)")
    signs = count(lambda t: sum(t.count(c) for c in "©|·»«→›"))
    score = np.array([[max(s), min(s), sum(s)] if (s := [words[t] for t in ts if t in words]) else [0.0, 0.0, 0.0] for ts in f.tokens]).reshape(n, 3)
    group = GROUP_OF[f.kind]
    names = list(GROUPS)
    is_ = lambda name: (group >> names.index(name)) & 1
    kids = np.bincount(f.parent[f.parent >= 0], minlength=n).astype(np.float64)
    s_chars, s_words, s_marks, s_links = f.up(chars), f.up(n_words), f.up(marks), f.up(np.minimum(f.links, chars))
    s_nodes, s_runs, s_ends, s_controls, s_inline = f.up(np.ones(n)), f.up(run), f.up(ends), f.up(f.controls), f.up(f.inline)
    s_p, s_list, s_heads = f.up(is_("p")), f.up(f.kind == KINDS["li"]), f.up(is_("heading") + is_("h1"))
    page_chars = np.bincount(f.page, chars, len(f.first) - 1)[f.page]
    # siblings: nodes of one parent in page order; nodes without a parent are siblings in their page
    home = np.where(f.parent >= 0, f.parent, -1 - f.page)
    order = np.lexsort((np.arange(n), home))
    same = np.zeros(n, bool)
    same[1:] = home[order][1:] == home[order][:-1]
    place = np.arange(n) - np.maximum.accumulate(np.where(same, 0, np.arange(n)))
    sibling = np.zeros(n)
    sibling[order] = place
    _, inverse, sizes = np.unique(home, return_inverse=True, return_counts=True)
    n_siblings = sizes[inverse].astype(np.float64)
    before, after = np.zeros(n), np.zeros(n)
    ordered = np.log1p(s_chars[order])
    before[order[1:]] = np.where(same[1:], ordered[:-1], 0.0)
    after[order[:-1]] = np.where(same[1:], ordered[1:], 0.0)
    family = np.bincount(inverse, s_chars, len(sizes))[inverse]
    alike = np.unique(np.stack([home, f.kind], 1), axis=0, return_inverse=True, return_counts=True) if n else (None, np.zeros(0, int), np.zeros(0))
    has = f.parent >= 0
    above = lambda v, default=0.0: np.where(has, v[np.maximum(f.parent, 0)], default)
    around = f.down(group, np.bitwise_or)
    near = np.where(has, group[np.maximum(f.parent, 0)], 0)
    columns = [
        f.depth, np.log1p(s_chars), np.log1p(s_words), s_links / np.maximum(s_chars, 1), s_marks / np.maximum(s_words, 1), s_ends / np.maximum(s_runs, 1), f.up(signs),
        s_chars / np.maximum(s_words, 1), np.log1p(s_nodes), np.log1p(s_chars / s_nodes), np.log1p(s_chars / (s_inline + s_nodes)), kids, s_controls, f.down(f.controls, np.add),
        sibling, n_siblings, sibling / n_siblings, np.log1p(alike[2][alike[1].ravel()]), before, after, s_chars / np.maximum(family, 1),
        f.start / f.length[f.page], s_chars / np.maximum(page_chars, 1), np.log1p(page_chars), s_chars / np.maximum(above(s_chars), 1), above(s_links) / np.maximum(above(s_chars), 1),
        above(s_marks) / np.maximum(above(s_words), 1), np.log1p(s_p), np.log1p(s_list), s_heads, np.log1p(above(s_p)), above(kids),
        score[:, 0], score[:, 1], score[:, 2], f.down(score[:, 0], np.maximum), f.down(score[:, 1], np.minimum), f.down(score[:, 2], np.add), above(score[:, 2]),
        *[(group >> k) & 1 for k in range(len(names))], *[(around >> k) & 1 for k in range(len(names) - 1)], *[(near >> k) & 1 for k in range(len(names) - 1)],
        # what stands elsewhere in the page: with an article or a main element, the rest is hardly main text
        np.bincount(f.page, is_("article"), len(f.first) - 1)[f.page], np.bincount(f.page, is_("main"), len(f.first) - 1)[f.page],
    ]
    return np.stack([np.asarray(c, np.float64) for c in columns], 1) if n else np.zeros((0, len(columns)))


def word_scores(f: Forest, y: np.ndarray, least: int = 3) -> dict[str, float]:
    """Log odds of main text in nodes with an attribute word, smoothed, against those of all nodes with attribute words."""
    seen: dict[str, list[int]] = {}
    for ts, label in zip(f.tokens, y.tolist()):
        for t in set(ts):
            seen.setdefault(t, [0, 0])[label] += 1
    return {t: float(np.log((b + 0.5) / (a + 0.5))) for t, (a, b) in sorted(seen.items()) if a + b >= least}


def _forest(texts: list[str]) -> Forest:
    return Forest([parse(t) for t in texts], [len(t) for t in texts])


def learn(fragments: list[str], made_pages: int = MADE_PAGES, seed: int = 11) -> Model:
    """A model from pages made of the fragments."""
    f = _forest(layouts.pages(sorted(set(fragments)) or SPARE, made_pages, seed))
    marked = np.array([layouts.MARK in t for t in f.text], bool)
    f.text = [t.replace(layouts.MARK, "") for t in f.text]
    y = (f.up(marked) > 0).astype(np.int64)
    words = word_scores(f, y)
    return Model(boosted.fit(features(f, words), y), words)


def fit(pages: DataFrame, html_col: str = "html", sample_pages: int = SAMPLE_PAGES, made_pages: int = MADE_PAGES, seed: int = 11) -> Model:
    """A model whose made-up pages use fragments of at most ``sample_pages`` given pages, those with the smallest hashes.

    Only the fragments reach the driver, those from the first ``SAMPLE_CHARS`` code points of each page; an empty table gives spare fragments.
    """
    html = col(html_col)
    sample = pages.filter(html.isNotNull()).select(F.substring(html, 1, SAMPLE_CHARS).alias("html"), F.xxhash64(html).alias("h")).orderBy("h", "html").limit(sample_pages)

    def run(batches):
        for b in batches:
            runs = [t for page in string_texts(b.column(0)) for t in parse(page).text if len(t) >= 3]
            yield pa.RecordBatch.from_arrays([pa.array([t[:600] for t in runs], pa.string())], ["fragment"])

    rows = sample.select("html").mapInArrow(run, "fragment string").collect()
    return learn([r.fragment for r in rows], made_pages, seed)


def main_texts(pages: list[str], model: Model) -> list[str]:
    """The main text of every page: its kept runs, one a line."""
    f = _forest(pages)
    if not len(f.kind):
        return [""] * len(pages)
    kept = f.keep(np.clip(model.trees.logit(features(f, model.words)), -6.0, 6.0))
    out = []
    for a, b in zip(f.first[:-1].tolist(), f.first[1:].tolist()):
        out.append("\n".join(f.text[i] for i in range(a, b) if kept[i] and f.text[i]))
    return out


def extract(pages: DataFrame, model: Model, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """The rows without their html, with ``text_col``, the main text; it replaces a column of that name.

    A null page counts as an empty one, and an empty page has the empty text. Rows are read one by one, so repeated rows get the same text.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)  # some thousands of numbers
    others = [c for c in pages.columns if c not in (html_col, text_col)]
    source = pages.select(*[col(c) for c in others], col(html_col))
    schema = T.StructType([*[pages.schema[c] for c in others], T.StructField(text_col, T.StringType())])

    def run(batches):
        for b in batches:
            pages, out, held = [], [], 0
            for page in string_texts(b.column(len(others))):
                pages.append(page)
                held += len(page)
                if held > 2_000_000:  # the nodes of a few pages at a time
                    out += main_texts(pages, shared.value)
                    pages, held = [], 0
            out += main_texts(pages, shared.value)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(others)], pa.array(out, pa.string())], [*others, text_col])

    return source.mapInArrow(run, schema)
