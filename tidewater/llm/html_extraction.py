"""Main text of web pages: boosted trees over the nodes of the page, then one consistent choice for the whole tree.

Every node of the block tree (html_dom) gets the chances of three states: all of its text is article, none of it is, or
some is. The trees see densities of the node's subtree, its attribute tokens and its ancestors', depth, place and
statistics of its siblings. Chances alone may contradict each other: an article in a rejected menu, a rejected heading
in an article that is whole. So the states are decoded together: below a node that is wholly article, or wholly not, all are
alike, below a mixed node each child is free, and of all such choices the likeliest is taken, in one pass up and one down.

The trees are fitted on the driver, once a process, to `training_pages` pages of html_pages: the tables label no pages, so
this bounded sample is composed. What runs over the table is a map of whole pages; nothing is shuffled.

Cases: null and empty pages, and pages without text, give an empty text of 0 characters; plain text without tags is a page of one
run; open tags, quotes and comments end with the page; repeated rows give a row each; rows without id are kept; an
empty table gives an empty result; other columns are not read. White space is what Unicode says it is.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import boosting, html_pages
from tidewater.llm.common import prepare
from tidewater.llm.html_dom import Forest, Page

WHOLE, NONE, MIXED = range(3)
TRAINING_PAGES, ROUNDS, DEPTH, SEED = 500, 24, 5, 11
#: Pages that are scored together.
TOGETHER = 64


def labelled(made: list[str]) -> tuple[list[Page], list[np.ndarray]]:
    """Pages without the marks of html_pages, and by node the characters of article and others."""
    out, sizes = [], []
    for html in made:
        page = Page(html)
        own = np.zeros((len(page.kind), 2))
        for k, (node, text, link) in enumerate(page.parts):
            if node >= 0:
                plain = text.replace(html_pages.NOT_ARTICLE, "")
                own[node, int(plain != text)] += len(plain)
                page.parts[k] = (node, plain, link)
        out.append(page)
        sizes.append(own)
    return out, sizes


def token_odds(made: list[Page], sizes: list[np.ndarray], least: int = 3) -> dict[str, float]:
    """Log odds that the text of a node with a token is article; tokens that occur in fewer than `least` nodes are left out."""
    good, bad = Counter(), Counter()
    for page, own in zip(made, sizes):
        total = own.copy()
        for k in range(len(total) - 1, 0, -1):
            total[page.parent[k]] += total[k]
        for tokens, (a, b) in zip(page.tokens, total):
            if tokens and a + b:
                good.update(dict.fromkeys(tokens, a / (a + b)))
                bad.update(dict.fromkeys(tokens, b / (a + b)))
    return {t: float(np.log((good[t] + 0.5) / (bad[t] + 0.5))) for t in good.keys() | bad.keys() if good[t] + bad[t] >= least}


@lru_cache(maxsize=4)
def fitted(training_pages: int, rounds: int, depth: int, seed: int) -> tuple[boosting.Trees, dict[str, float]]:
    made, sizes = labelled(html_pages.pages(training_pages, seed))
    # odds come from other pages than those that the trees see, which else would trust them too much
    half = len(made) // 2
    odds = token_odds(made, sizes)
    forest = Forest(made)
    parts = [(made[:half], token_odds(made[half:], sizes[half:])), (made[half:], token_odds(made[:half], sizes[:half]))]
    x = np.concatenate([Forest(p).features(o) for p, o in parts if p])
    own = np.concatenate(sizes)
    total = np.column_stack([forest.up(own[:, k]) for k in range(2)])
    has = total.sum(1) > 0
    y = np.where(total[:, 1] == 0, WHOLE, np.where(total[:, 0] == 0, NONE, MIXED))
    return boosting.fit(x[has], y[has], 3, rounds, depth), odds


def decode(forest: Forest, chance: np.ndarray) -> np.ndarray:
    """Whether each node's own text is article, in the likeliest choice of states that fits together. chance: log, by state."""
    n = len(forest.kind)
    # nodes without text have no say; those without children are not mixed
    has = forest.up(forest.own[:, 0]) > 0
    said = np.where(has[:, None], chance, 0.0)
    whole, none = forest.up(said[:, WHOLE]), forest.up(said[:, NONE])
    children = np.bincount(forest.parent[~forest.root], minlength=n)
    best = np.zeros(n)
    mixed = np.where(children > 0, said[:, MIXED], -np.inf)
    for level in [*reversed(forest.levels), np.flatnonzero(forest.root)]:
        best[level] = np.maximum(np.maximum(whole[level], none[level]), mixed[level])
        if not forest.root[level].any():
            np.add.at(mixed, forest.parent[level], best[level])
    own = np.where(mixed > np.maximum(whole, none), MIXED, np.where(whole > none, WHOLE, NONE))
    state = forest.down(own, lambda above, up: np.where(above == MIXED, up, above))
    # the state of the highest ancestor that is not mixed, or else the node's own
    return np.where(forest.root | (state == MIXED), own, state) == WHOLE


def main_texts(pages: list[Page], trees: boosting.Trees, odds: dict[str, float]) -> list[str]:
    forest = Forest(pages)
    keep = decode(forest, trees.scores(forest.features(odds)))
    out = []
    for first, page in zip(forest.starts.tolist(), pages):
        parts = [text for node, text, _ in page.parts if node < 0 or keep[first + node]]
        out.append(" ".join("".join(parts).split()))
    return out


def extract(pages: DataFrame, html: str = "html", training_pages: int = TRAINING_PAGES, rounds: int = ROUNDS, depth: int = DEPTH, seed: int = SEED) -> DataFrame:
    """The columns of pages but html, then text (the article, blocks joined by a space) and n_chars. Columns of these names are replaced."""
    spark = prepare(pages.sparkSession)
    model = spark.sparkContext.broadcast(fitted(training_pages, rounds, depth, seed))
    others = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    rows = pages.select(*[F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(others)], F.col(f"`{html}`").alias("_html"))
    schema = rows.drop("_html").schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, odds = model.value
        for batch in batches:
            for k in range(0, batch.num_rows, TOGETHER):
                some = batch.slice(k, TOGETHER)
                made = main_texts([Page(h or "") for h in some.column(len(others)).to_pylist()], trees, odds)
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.array(made, pa.string()), pa.array(list(map(len, made)), pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema).toDF(*others, "text", "n_chars")
