"""Main text of web pages by a recurrent block labeller.

A page becomes its sequence of text blocks. A bidirectional LSTM reads for each block its hashed
tag path, its hashed words and a few measures, and labels it with the whole page as context.

There are no labelled pages, so the labeller learns from pages whose markup tells the parts: blocks
inside ``article`` or ``main`` are text, blocks inside navigation, headers, footers, asides, forms
and elements named as adverts, notices or comments are not, others give no label. A bounded sample
of SAMPLE_PAGES such pages (expected number; of those that have a text part rows are drawn by a hash of the url, pages of
up to SAMPLE_CHARS characters; of a page with more than SAMPLE_BLOCKS blocks half as many from either end) is learned as it is, and once more with foreign parts put in and other
elements around the text, so that parts and layouts are learned that the sample lacks.

Defined results: a null or empty page, or one without text, gives an empty text; repeated rows
each keep their row; an empty table gives an empty table; very long pages are labelled whole; if
no page tells its parts, all blocks count as text; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parapet.llm import labeller
from parapet.llm.blocks import Block, blocks
from parapet.llm.state import kept

SAMPLE_PAGES, SAMPLE_CHARS, SAMPLE_BLOCKS = 120, 60_000, 60
TEXT_PARTS = frozenset(("article", "main", ".main", ".article"))
# What a page with a text part has in its markup.
TELLS = r"""(?i)<(article|main)[\s>]|\b(class|id|role)\s*=\s*["']?[^"'>]*\b(article|main)\b"""
OTHER_PARTS = frozenset(
    "nav header footer aside form menu button dialog .nav .navigation .menu .header .footer .sidebar .aside .ad .ads .advert .advertisement .banner "
    ".sponsored .promo .cookie .cookies .consent .notice .comment .comments .comentarios .disqus .related .share .social .breadcrumb .breadcrumbs "
    ".newsletter .subscribe .login .search .copyright .popup .modal .widget".split()
)
# Elements that stand around foreign parts, and around the text, in the changed pages.
AROUND_OTHER = (
    ("aside",), ("aside", ".sidebar"), ("div", ".sidebar"), ("section", ".comments", "div", ".comment", "p"), ("div", ".comments", "p"),
    ("div", ".comment", "p"), ("form",), ("form", "label"), ("div", ".cookie", ".notice", "p"), ("div", ".notice"), ("header",), ("header", "p"),
    ("div", ".ad"), ("div", ".banner"), ("nav", "ul", "li"), ("div", ".menu", "ul", "li"), ("footer", "p"), ("div", ".footer"), ("div", ".newsletter", "form"),
    ("div", ".related", "ul", "li"), ("ul", ".breadcrumb", "li"), ("div", ".social"),
)
AROUND_TEXT = (("article",), ("main",), ("main", "article"), ("div", ".content"), ("div", ".post"), ("div", ".entry", ".content"), ("section", ".article", ".body"))


def teacher(page: list[Block]) -> np.ndarray:
    out = np.full(len(page), np.nan, np.float32)
    for i, block in enumerate(page):
        tokens = set(block.path)
        if tokens & OTHER_PARTS:
            out[i] = 0
        elif tokens & TEXT_PARTS:
            out[i] = 1
    return out


def changed(page: list[Block], label: np.ndarray, others: list[Block], rng: np.random.Generator) -> tuple[list[Block], np.ndarray]:
    """The page with other elements around its text and foreign parts before, inside and after it."""
    around = AROUND_TEXT[rng.integers(len(AROUND_TEXT))]
    rows = []
    for block, y in zip(page, label):
        path = block.path
        if y == 1:
            first = next(i for i, t in enumerate(path) if t in TEXT_PARTS)
            path = path[:first] + around + path[first + 1:]
        rows.append((Block(block.text, path, block.link_chars), y))
    for _ in range(int(rng.integers(1, 5))):
        base = ("html", "body") if rng.random() < 0.5 else ("html", "body", *around)
        wrap = AROUND_OTHER[rng.integers(len(AROUND_OTHER))]
        at = int(rng.integers(len(rows) + 1))
        rows[at:at] = [(Block(others[rng.integers(len(others))].text, base + wrap, 0), 0.0) for _ in range(int(rng.integers(1, 4)))]
    return [b for b, _ in rows], np.array([y for _, y in rows], np.float32)


def _ends(page: list[Block]) -> list[Block]:
    half = SAMPLE_BLOCKS // 2
    return page if len(page) <= SAMPLE_BLOCKS else page[:half] + page[-half:]


def learn(pages: DataFrame, url: str = "url", html: str = "html", sample: int = SAMPLE_PAGES, seed: int = 5) -> labeller.Weights:
    """A labeller from a sample of ``pages``."""
    telling = pages.where(F.col(html).rlike(TELLS))
    n = max(1, telling.count())
    draw = F.pmod(F.xxhash64(F.col(url), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    rows = telling.where((F.length(html) <= SAMPLE_CHARS) & (draw < min(1.0, sample / n))).select(F.col(html).alias("html"))
    found = sorted(r.html for r in rows.collect())
    told = [(page, teacher(page)) for page in (_ends(blocks(text)) for text in found) if page]
    told = [(page, y) for page, y in told if (y == 1).any()]
    rng, memory = np.random.default_rng(seed), {}
    others = [b for page, _ in told for b in page]
    told += [changed(page, y, others, rng) for page, y in told for _ in range(2)]
    weights = labeller.train(labeller.features([page for page, _ in told], memory), [y for _, y in told], seed=seed)
    if not told:
        weights.out[:], weights.bias[:] = 0, 1
    return weights


def main_texts(weights: labeller.Weights, pages: list[str | None], memory: dict) -> list[str]:
    tags = memory.setdefault("tags", {})
    parsed = [blocks(page or "", tags) for page in pages]
    chances = labeller.label(weights, parsed, memory.setdefault("paths", {}))
    return ["\n".join(b.text for b, c in zip(page, chance) if c > 0.5) for page, chance in zip(parsed, chances)]


def extract(pages: DataFrame, weights: labeller.Weights, html: str = "html", at_once: int = 1 << 22) -> Column:
    """The main text of the column ``html`` of ``pages``; ``at_once`` characters are parsed at a time."""
    shared = pages.sparkSession.sparkContext.broadcast((weights.wx, weights.wh, weights.b, weights.out, weights.bias))

    @F.pandas_udf("string")
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        learned, memory = labeller.Weights(*shared.value), kept("block hashes", dict)
        for batch in batches:
            out, part, size = [], [], 0
            for page in batch.tolist():
                part.append(page)
                size += len(page or "")
                if size >= at_once:
                    out += main_texts(learned, part, memory)
                    part, size = [], 0
            yield pd.Series(out + main_texts(learned, part, memory), dtype=object)

    return told(F.col(html))
