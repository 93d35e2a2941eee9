"""Main text of web pages by minimum-cut labelling.

A classifier gives each text block the cost of being content and of being boilerplate; these are the capacities to the
two terminals.  Blocks that follow one another, the more so under one parent, are tied by smoothness edges.  The
maximum flow's cut is the labelling of least total cost.
"""

from __future__ import annotations

import re
from collections import deque
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candela.llm.common import drawn
from candela.llm.html import Block, attributes, blocks

#: About how many pages' blocks fit the classifier: those of the smallest hashes of id and address.
TRAINING_PAGES = 500
#: Weight of the ties: any neighbours, and neighbours under one parent beside that.
ADJACENT, SIBLINGS = 0.4, 0.8
#: Strength with which the fit holds on to the prior weights.
PRIOR_STRENGTH = 0.02
_SCALE = 1000
#: Words of class, id and role names that speak against and for content.
AGAINST = frozenset(
    "ad ads advert advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr notice sidebar rail menu nav navbar "
    "navigation footer breadcrumb breadcrumbs share sharing social related recommended teaser comment comments discussion discussions thread reply replies "
    "respond disqus widget popup modal overlay subscribe newsletter login signin signup toolbar pagination pager disclaimer copyright contentinfo "
    "complementary search form dialog alert hidden masthead topbar".split()
)
FOR = frozenset("article content post entry main story text body prose".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_OUTER = frozenset("nav footer aside form button select menu dialog datalist fieldset".split())
#: Features and their prior weights; positive speaks for content.
FEATURES = {
    "bias": -0.2, "in_article": 2.5, "in_main": 1.5, "in_outer": -6.0, "page_header": -3.0, "name_against": -5.0, "name_for": 0.8, "hidden": -6.0,
    "link_share": -3.0, "length": 0.8, "sentence_end": 0.5, "paragraph": 0.7, "heading": 0.3, "list_item": -0.3, "copyright": -2.5,
}
_STRUCTURE = [i for i, f in enumerate(FEATURES) if f in ("in_article", "in_main", "in_outer", "page_header", "name_against", "name_for", "hidden")]


@lru_cache(8192)
def surroundings(line: tuple[tuple[str, str], ...]) -> tuple[bool, ...]:
    """What the elements around a block say, given their tags as written."""
    tags = [tag for tag, _ in line]
    for_, against, hidden = False, False, False
    for tag, written in line:
        attrs = attributes(written)
        if tag not in ("html", "body"):
            for name in (n for k in ("class", "id", "role", "itemprop") for n in attrs.get(k, "").split()):
                # of a compound such as "article-share-content" the first and the last telling word count
                telling = [w for w in map(str.lower, _WORDS.findall(name)) if w in AGAINST or w in FOR]
                against |= bool(AGAINST & {*telling[:1], *telling[-1:]})
                for_ |= bool(FOR & {*telling})
        hidden |= "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "")
    inner = tags[-1] if tags else ""
    outer = bool(_OUTER & set(tags))
    return "article" in tags, "main" in tags, outer, "header" in tags and "article" not in tags, against, for_ and not against, hidden, "p" in tags or "blockquote" in tags, inner in ("h1",
        "h2", "h3", "h4", "h5", "h6"), "li" in tags


def features(block: Block) -> list[float]:
    article, main, outer, header, against, for_, hidden, paragraph, heading, item = surroundings(block.path[-1].line if block.path else ())
    n, text = len(block.text), block.text
    return [1.0, article, main, outer, header, against, for_, hidden, block.linked / n, min(n, 400) / 200, text[-1] in ".!?…:;\"'»”", paragraph, heading,
        item, text[0] == "©" or "all rights reserved" in text[-200:].lower()]


def weak_label(block: Block) -> int:
    """1 inside an article or main element, 0 inside what surrounds one, -1 elsewhere."""
    tags = {tag for tag, _ in block.path[-1].line} if block.path else set()
    return 0 if tags & _OUTER else 1 if tags & {"article", "main"} else -1


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression that stays near the prior weights.  Half its rows lack the structure's features, so texts alone can tell as well."""
    prior = np.array(list(FEATURES.values()))
    if not len(y):
        return prior
    bare = x.copy()
    bare[:, _STRUCTURE] = 0
    x, y, w = np.concatenate([x, bare]), np.concatenate([y, y]), prior.copy()
    for _ in range(300):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 0.3 * (x.T @ (p - y) / len(y) + PRIOR_STRENGTH * (w - prior))
    return w


def min_cut(source: list[int], sink: list[int], ties: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes stay with the source: Dinic's maximum flow; ``ties`` are undirected (a, b, capacity)."""
    n = len(source)
    s, t = n, n + 1
    graph: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    cap: list[int] = []

    def edge(a, b, forward, backward):
        graph[a].append(len(to))
        graph[b].append(len(to) + 1)
        to.extend((b, a))
        cap.extend((forward, backward))

    for i in range(n):
        if source[i] > sink[i]:
            edge(s, i, source[i] - sink[i], 0)
        elif sink[i] > source[i]:
            edge(i, t, sink[i] - source[i], 0)
    for a, b, c in ties:
        edge(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in graph[a]:
                if cap[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        nexts, path, a = [0] * (n + 2), [], s
        while True:
            if a == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                path, a = [], s
            while nexts[a] < len(graph[a]):
                e = graph[a][nexts[a]]
                if cap[e] and level[to[e]] == level[a] + 1:
                    break
                nexts[a] += 1
            if nexts[a] < len(graph[a]):
                path.append(e)
                a = to[e]
            elif path:
                e = path.pop()
                a = to[e ^ 1]
                nexts[a] += 1
            else:
                break


def label(found: list[Block], weights: np.ndarray) -> list[bool]:
    """Which blocks are content."""
    if not found:
        return []
    score = np.array([features(b) for b in found], float) @ weights
    if (score > 0).all() or (score <= 0).all():
        return (score > 0).tolist()  # no tie is worth cutting
    ties = []
    for i, (a, b) in enumerate(zip(found, found[1:], strict=False)):
        together = 0
        for x, y in zip(a.path, b.path, strict=False):
            if x.serial != y.serial:
                break
            together += 1
        parent = together >= max(len(a.path), len(b.path)) - 1
        ties.append((i, i + 1, int(_SCALE * (ADJACENT + SIBLINGS * parent))))
    gain = np.maximum(np.rint(score * _SCALE), 0).astype(int).tolist()
    loss = np.maximum(np.rint(-score * _SCALE), 0).astype(int).tolist()
    return min_cut(gain, loss, ties)


def main_text(page: str | None, weights: np.ndarray) -> str:
    found = [b for b in blocks(page) if b.src is None]
    return " ".join(b.text for b, keep in zip(found, label(found, weights), strict=True) if keep)


def _examples(batches):
    for batch in batches:
        rows = [(weak_label(b), features(b)) for page in batch.column(0) for b in blocks(page.as_py()) if b.src is None]
        rows = [r for r in rows if r[0] >= 0]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()),
            pa.array([[float(v) for v in r[1]] for r in rows], pa.list_(pa.float64()))], ["y", "x"])


def train(pages: DataFrame) -> np.ndarray:
    """Weights fitted on the blocks of about ``TRAINING_PAGES`` pages, which each task picks by their hash alone."""
    share = TRAINING_PAGES / max(pages.count(), TRAINING_PAGES)
    chosen = pages.where(drawn(share, F.col("page_id"), F.col("url"))).groupBy("page_id", "url").agg(F.min("html").alias("html"))
    rows = chosen.where("html is not null").select("html").mapInArrow(_examples, "y int, x array<double>").toPandas()
    x, y = np.array(rows["x"].tolist(), float).reshape(-1, len(FEATURES)), rows["y"].to_numpy(float)
    order = np.lexsort([y, *x.T])  # the same weights in whichever order the blocks came
    return fit(x[order], y[order])


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row of ``pages(page_id, url, html, ...)``.

    Null, empty and textless pages give empty text.  Broken markup is read as far as it goes: an unfinished tag at the
    end is dropped, unclosed elements end with their parents.  Repeated rows repeat their result.
    """
    weights = train(pages)

    def run(found: pd.Series) -> pd.Series:
        return found.map(lambda page: main_text(page, weights))

    out = pages.select("page_id", "url", F.pandas_udf(run, "string")(F.coalesce(F.col("html").cast("string"), F.lit(""))).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
