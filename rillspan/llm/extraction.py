"""Main-text extraction: boosted trees over element features, decoded down the tree.

1. A page becomes a tree of elements; each is described by tag, attribute
   words, depth, sibling statistics and the density of its subtree.
2. Gradient-boosted trees give every element the chances of three classes,
   around the main text, in it, and away from it, given that its parent is not
   away.
3. The most likely labelling of the whole tree is found under two rules: below
   an element that is away all are away, and below one in the main text none is
   around it.  So no ancestor and descendant contradict each other.
4. Text of elements in the main text is joined by block.

The trees are trained on made-up pages (``sample_pages``), the same every time.

Made-up pages come with and without speaking tags and class words, so the trees
do not depend on ``article``.

Defined results: null or empty html gives the empty text; html without any tag
is main text as a whole; elements that are never closed end with their parent
or the page and lose nothing, but for script and style, which run to the end; a
tag that is cut off by the end of the page goes; elements nested deeper than
256 count as parts of the one at that depth; repeated rows each give a row; an
empty table gives an empty result; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillspan.llm.boosting import Boosted
from rillspan.llm.dom import Page, blocks, describe
from rillspan.llm.sample_pages import AWAY, CONTENT, OUTSIDE, labelled


@functools.lru_cache(1)
def trained(pages: int = 900, rounds: int = 36) -> Boosted:
    """The extractor's trees, trained on ``pages`` made-up pages.

    What lies below an element that is away has no say: its class is settled.
    """
    xs, ys = [], []
    for page, classes in labelled(pages):
        y = np.array(classes)
        free = np.flatnonzero(y[np.maximum(page.parent, 0)] != AWAY)
        xs.append(describe(page)[free])
        ys.append(y[free])
    return Boosted(np.concatenate(xs), np.concatenate(ys), 3, rounds)


def decode(page: Page, log_p: np.ndarray) -> np.ndarray:
    """Classes of the most likely consistent labelling."""
    n = len(page.tag)
    # below the main text there are two classes only
    two = np.logaddexp(log_p[:, CONTENT], log_p[:, AWAY])
    outside, content, away = (log_p[:, c].tolist() for c in (OUTSIDE, CONTENT, AWAY))
    inner, foreign = (log_p[:, CONTENT] - two).tolist(), (log_p[:, AWAY] - two).tolist()
    below = [0.0] * n  # of what lies below, if the element is in the main text
    for k in range(n - 1, 0, -1):  # children come after their parents
        up, b = page.parent[k], below[k]
        content[k] += b
        inner[k] += b
        best = max(outside[k], content[k], away[k])
        outside[up] += best
        below[up] += max(inner[k], foreign[k])
    content[0] += below[0]
    state = np.zeros(n, np.int8)
    for k in range(n):
        above = state[page.parent[k]] if k else OUTSIDE
        if above == AWAY:
            state[k] = AWAY
        elif above == CONTENT:
            state[k] = CONTENT if inner[k] >= foreign[k] else AWAY
        else:
            best = max(outside[k], content[k], away[k])
            state[k] = CONTENT if content[k] == best else AWAY if away[k] == best else OUTSIDE
    return state


def extract(htmls: list[str | None], model: Boosted) -> list[str]:
    """Main texts of some pages; their elements are scored together."""
    pages = [Page(h) if h else None for h in htmls]
    rows = [describe(p) for p in pages if p is not None]
    log_p = model.log_proba(np.concatenate(rows)) if rows else None
    out, at = [], 0
    for page in pages:
        if page is None:
            out.append("")
            continue
        state = decode(page, log_p[at : at + len(page.tag)]) if len(page.tag) > 1 else np.full(1, CONTENT)
        at += len(page.tag)
        out.append("\n".join(blocks(page, state == CONTENT)))
    return out


def main_text(df: DataFrame, id_col: str = "page_id", html_col: str = "html", carry: tuple[str, ...] = ("url",)) -> DataFrame:
    """``id``, the carried columns, ``text`` and ``n_chars`` of every page."""
    model = trained()
    kept = [F.col(id_col).alias("id"), *(F.col(c).alias(f"c{n}") for n, c in enumerate(carry))]
    narrow = df.select(*kept, F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                texts = extract(part.column("html").to_pylist(), model)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                    [*part.schema.names[:-1], "text", "n_chars"],
                )

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])
    out = narrow.mapInArrow(run, f"{schema}, text string, n_chars long")
    return out.select("id", *(F.col(f"c{n}").alias(c) for n, c in enumerate(carry)), "text", "n_chars")
