"""Main text of web pages by a graphical model on the page's tree.

Every block element and block of text is a node with a hidden label: part of the main text or not. A node's own potential is a
weighted sum of what is seen at it (tag, words of its class and id, length, links, place); an edge's potential depends on
the labels of parent and child and on the kind of the child. On a tree sum-product is exact: messages pass from the leaves to
the root and back, and the product at a node is its marginal. Weights maximise the likelihood of labelled pages; the gradient is what
was seen less what the marginals expect. A block of text is taken if its marginal exceeds one half.

Pages of a batch are one forest, worked off level by level of depth with arrays, so that a tree of any depth needs no recursion.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchloom.llm.arrow import pieces
from merchloom.llm.dom import Page, parse
from merchloom.session import ship_code

#: At most this many labelled pages are used to fit a model, chosen by a hash of the page.
LABELLED = 2000
#: A feature must be seen on this many of them.
LEAST_PAGES = 3
STEPS, RATE, RIDGE = 120, 0.15, 2e-3

#: Kinds of children that have edge potentials of their own; the last one is for all others.
_KINDS = {tag: k for k, tags in enumerate((("#text",), ("p",), ("h1", "h2", "h3", "h4", "h5", "h6"), ("div", "section", "center"), ("ul", "ol", "dl", "menu"),
                                           ("li", "dt", "dd"), ("td", "th", "tr", "tbody"), ("article", "main"), ("aside", "nav", "header", "footer", "form"))) for tag in tags}
KINDS = 10
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[^\W\d_A-Za-z]+")
# Parts of names that are looked for inside longer words too.
_INSIDE = ("nav", "menu", "foot", "head", "side", "comment", "cookie", "notice", "banner", "advert", "sponsor", "promo", "share", "social", "related", "widget", "form",
           "subscri", "newsletter", "copyright", "content", "article", "main", "post", "entry", "story", "text", "body", "repl", "disqus", "consent", "alert", "popup", "modal")


def _bin(value: float, bounds: Sequence[float]) -> int:
    return sum(value >= b for b in bounds)


def _name_features(names: str) -> list[str]:
    words = {w.lower() for w in _NAME.findall(names)}
    low = names.lower()
    return [f"n={w}" for w in sorted(words)] + [f"i={part}" for part in _INSIDE if part in low]


def features(page: Page) -> list[list[str]]:
    """What is seen at every node of a page."""
    n = len(page.tags)
    chars, linked, blocks, marks = [0] * n, [0] * n, [0] * n, [0] * n
    before, total = [0] * n, 0
    for i in range(n):
        before[i] = total
        if text := page.texts[i]:
            chars[i], linked[i], blocks[i] = len(text), page.linked[i], 1
            marks[i] = sum(map(text.count, ".,!?。，"))
            total += len(text)
    for i in range(n - 1, 0, -1):
        p = page.parents[i]
        chars[p] += chars[i]
        linked[p] += linked[i]
        blocks[p] += blocks[i]
        marks[p] += marks[i]
    out = []
    for i in range(n):
        tag, p = page.tags[i], page.parents[i]
        above = page.tags[p] if p >= 0 else ""
        found = [f"t={tag}", f"t={above}>{tag}"]
        density = linked[i] / chars[i] if chars[i] else 0.0
        kind = "x" if tag == "#text" else "e"
        found += [f"{kind}l={_bin(chars[i], (1, 8, 20, 50, 120, 300, 800, 2500, 8000))}", f"{kind}d={_bin(density, (0.01, 0.2, 0.5, 0.9))}",
                  f"{kind}m={_bin(100 * marks[i] / max(chars[i], 1), (0.01, 0.7, 1.5, 3))}", f"{kind}s={_bin(chars[i] / max(total, 1), (0.02, 0.1, 0.3, 0.6, 0.85, 0.99))}",
                  f"{kind}b={_bin(before[i] / max(total, 1), (0.001, 0.05, 0.3, 0.7, 0.95))}"]
        if tag == "#text":
            text = page.texts[i]
            found.append(f"xe={text[-1] in '.!?。！？:;…'}")
            if "©" in text:
                found.append("copyright")
            if page.names[p]:
                found += [f"x{f}" for f in _name_features(page.names[p])]
        else:
            found.append(f"ec={_bin(blocks[i], (1, 2, 4, 8, 20))}")
            if page.names[i]:
                found += _name_features(page.names[i])
                found.append(f"named={tag}")
            else:
                found.append(f"plain={tag}")
        out.append(found)
    return out


@dataclass
class Trees:
    """A forest as arrays: parents (-1 at roots), kinds of edges, features by node, nodes by depth with the runs of one parent."""

    parents: np.ndarray
    kinds: np.ndarray
    seen: np.ndarray
    starts: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    @staticmethod
    def of(pages: Sequence[Page], found: Sequence[list[list[str]]], vocabulary: dict[str, int]) -> Trees:
        parents, kinds, seen, starts, depths = [], [], [], [0], []
        for page, by_node in zip(pages, found, strict=True):
            offset = len(parents)
            for i, (p, tag) in enumerate(zip(page.parents, page.tags, strict=True)):
                parents.append(p + offset if p >= 0 else -1)
                depths.append(depths[p + offset] + 1 if p >= 0 else 0)
                kinds.append(_KINDS.get(tag, KINDS - 1))
                seen += [k for f in by_node[i] if (k := vocabulary.get(f)) is not None]
                starts.append(len(seen))
        depth, above = np.array(depths, np.int64), np.array(parents, np.int64)
        order = np.lexsort((above, depth))
        cuts = np.searchsorted(depth[order], np.arange(depth.max() + 2 if len(depth) else 1))
        levels = []
        for a, b in zip(cuts[1:-1], cuts[2:], strict=True):  # below the roots
            nodes = order[a:b]
            runs = np.flatnonzero(np.concatenate([[True], above[nodes[1:]] != above[nodes[:-1]]]))
            levels.append((nodes, runs, above[nodes[runs]]))
        return Trees(above, np.array(kinds, np.int64), np.array(seen, np.int64), np.array(starts, np.int64), levels)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(weights[self.seen])])
        return sums[self.starts[1:]] - sums[self.starts[:-1]]


def sum_product(trees: Trees, scores: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Marginal of label 1 per node by messages up and down, with what came from below, the whole and the messages to the parent.

    ``scores`` is the log potential of label 1 over 0; ``edges[kind, parent label, child label]`` is logarithmic too.
    """
    n = len(scores)
    inner = np.zeros((n, 2))  # the node's potential and all messages from below
    inner[:, 1] = scores
    upward = np.zeros((n, 2))  # message to the parent, by the parent's label
    between = edges[trees.kinds]
    for level, runs, parents in reversed(trees.levels):
        both = between[level] + inner[level][:, None, :]
        upward[level] = np.logaddexp(both[:, :, 0], both[:, :, 1])
        inner[parents] += np.add.reduceat(upward[level], runs)
    whole = inner.copy()
    for level, _, _ in trees.levels:
        both = (whole[trees.parents[level]] - upward[level])[:, :, None] + between[level]  # the parent without this child
        whole[level] += np.logaddexp(both[:, 0], both[:, 1])
    whole -= np.logaddexp(whole[:, :1], whole[:, 1:])
    return np.exp(whole[:, 1]), inner, whole, upward


def joint_marginals(trees: Trees, inner: np.ndarray, whole: np.ndarray, upward: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Chances of (parent's label, child's label) per node, zero at roots."""
    joint = (whole[trees.parents] - upward)[:, :, None] + edges[trees.kinds] + inner[:, None, :]
    joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
    joint /= joint.sum(axis=(1, 2), keepdims=True)
    joint[trees.parents < 0] = 0.0
    return joint


def labels(page: Page, main_text: str) -> np.ndarray:
    """Labels of a labelled page's nodes: blocks of its main text, and elements most of whose text they are."""
    wanted = Counter(main_text.split("\n\n")) if main_text else Counter()
    n = len(page.tags)
    good, chars = [0] * n, [0] * n
    for i, text in enumerate(page.texts):
        if text:
            chars[i] = len(text)
            if wanted[text] > 0:
                wanted[text] -= 1
                good[i] = len(text)
    for i in range(n - 1, 0, -1):
        good[page.parents[i]] += good[i]
        chars[page.parents[i]] += chars[i]
    return np.array([2 * g > c for g, c in zip(good, chars, strict=True)], np.int64)


@dataclass
class Model:
    vocabulary: dict[str, int]
    weights: np.ndarray
    edges: np.ndarray

    def marginals(self, pages: Sequence[Page]) -> np.ndarray:
        """Chance to be main text of all nodes of the pages, one after another."""
        trees = Trees.of(pages, [features(page) for page in pages], self.vocabulary)
        return sum_product(trees, trees.scores(self.weights), self.edges)[0] if len(trees.parents) else np.zeros(0)

    def blocks(self, pages: Sequence[Page]) -> list[list[str]]:
        """The blocks of main text of each page."""
        chances, at, out = self.marginals(pages), 0, []
        for page in pages:
            out.append([text for i, text in enumerate(page.texts) if text and chances[at + i] > 0.5])
            at += len(page.texts)
        return out


def train(examples: Sequence[tuple[str, str]]) -> Model:
    """Weights of the greatest likelihood for (html, main text) pairs, with a small penalty on their squares."""
    pages = [parse(html) for html, _ in examples]
    found = [features(page) for page in pages]
    seen = Counter(f for by_node in found for f in {f for node in by_node for f in node})
    vocabulary = {f: k for k, f in enumerate(sorted(f for f, n in seen.items() if n >= LEAST_PAGES))}
    trees = Trees.of(pages, found, vocabulary)
    truth = np.concatenate([labels(page, text) for page, (_, text) in zip(pages, examples, strict=True)])
    parts = (np.zeros(len(vocabulary)), np.zeros((KINDS, 2, 2)))
    children = np.flatnonzero(trees.parents >= 0)
    seen_edges = np.zeros((KINDS, 2, 2))
    np.add.at(seen_edges, (trees.kinds[children], truth[trees.parents[children]], truth[children]), 1.0)
    owners = np.repeat(np.arange(len(truth)), np.diff(trees.starts))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in parts]
    for step in range(1, STEPS + 1):
        weights, edges = parts
        chances, *messages = sum_product(trees, trees.scores(weights), edges)
        joint = joint_marginals(trees, *messages, edges).reshape(len(truth), 4)
        expected = np.stack([np.bincount(trees.kinds, joint[:, k], KINDS) for k in range(4)], axis=1).reshape(KINDS, 2, 2)
        slopes = (np.bincount(trees.seen, (truth - chances)[owners], len(vocabulary)), seen_edges - expected)
        for part, slope, (mean, square) in zip(parts, slopes, moments, strict=True):
            slope = slope / len(examples) - RIDGE * part
            mean += 0.1 * (slope - mean)
            square += 0.01 * (slope ** 2 - square)
            part += RATE * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
    return Model(vocabulary, *parts)


def fit(labelled: DataFrame, html_col: str = "html", text_col: str = "text") -> Model:
    """A model from labelled pages, of which at most ``LABELLED`` are used; rows with a null are left out.

    Which ones is decided by a hash of the page, so that reruns agree.
    """
    ship_code(labelled.sparkSession)
    rows = labelled.select(F.col(html_col).alias("html"), F.col(text_col).alias("text")).na.drop()
    chosen = rows.orderBy(F.xxhash64("html"), "text").limit(LABELLED).collect()
    if not chosen:
        raise ValueError("no labelled page")
    return train([(row["html"], row["text"]) for row in chosen])


def extract(pages: DataFrame, model: Model, html_col: str = "html") -> DataFrame:
    """Each page's other columns with ``text``, its main text, and ``n_chars``, the number of its code points.

    A null or empty page has an empty text. Rows stay where they are. Columns named ``text`` or ``n_chars`` are replaced.
    """
    ship_code(pages.sparkSession)
    kept = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, htmls in pieces(batches, "_html"):
            trees = [parse((html or b"").decode("utf-8", "replace")) for html in htmls]
            found = ["\n\n".join(blocks) for blocks in shared.value.blocks(trees)]
            yield pa.RecordBatch.from_arrays(
                [*rows.columns[:-1], pa.array(found, pa.string()), pa.array([len(text) for text in found], pa.int64())],
                [*rows.schema.names[:-1], "text", "n_chars"])

    named = pages.select(*[F.col(f"`{c}`") for c in kept], F.col(html_col).alias("_html"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named.schema if f.name != "_html")
    return named.mapInArrow(run, f"{fields}, text string, n_chars long" if fields else "text string, n_chars long")
