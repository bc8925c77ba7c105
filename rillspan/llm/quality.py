"""Quality classifier by Bradley-Terry pairwise ranking.

1. A document is described by shares of byte classes and byte pairs, by word
   and line repetition and by how well it compresses: numbers that do not grow
   with its length.
2. Preference pairs (a row labelled 1 over a row labelled 0) train a linear
   score by logistic loss on feature differences.
3. The score is cut at a quantile of the training scores: the one that parts
   the labelled rows best.  A logistic curve puts that cut at ``threshold``.

Training sees at most ``max_rows`` labelled rows and ``max_pairs`` pairs; scoring
is one map over all documents and whole texts.

Defined results: null and empty texts get the score of the empty text; null ids
are scored and not held out; repeated rows each give a row; without labels of
both kinds every score is the threshold; other columns are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillspan.llm.labelled import fold, sample

#: Width of the hashed byte pairs.
PAIRS = 256


def features(text: str) -> np.ndarray:
    """One row of numbers; see the module's first point."""
    raw = text.encode()
    if not raw:
        return np.zeros(N_FEATURES, np.float32)
    data = np.frombuffer(raw, np.uint8)
    n = len(data)
    single = np.bincount(data, minlength=256) / n
    wide = data.astype(np.uint16)
    code = (wide[:-1] * np.uint16(31) + wide[1:] * np.uint16(7)) % np.uint16(PAIRS)
    double = np.bincount(code, minlength=PAIRS) / max(1, n - 1)
    words, lines = raw.split(), raw.split(b"\n")
    k = len(words)
    squeezed = sum(len(zlib.compress(raw[at : at + 65536], 1)) for at in range(0, n, 65536)) / n
    lens = np.fromiter(map(len, words), np.int32, k)
    upper = single[65:91].sum()
    letters = upper + single[97:123].sum() + single[128:].sum()
    more = [
        upper / max(letters, 1e-9),
        letters,
        single[48:58].sum(),
        1 - letters - single[48:58].sum() - single[9:14].sum() - single[32],
        len(set(words)) / max(1, k) ** 0.85,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, k),
        len(set(lines)) / len(lines),
        len(lines) / max(1, k),
        squeezed,
        float(lens.mean()) / 10 if k else 0.0,
        float(lens.std()) / 10 if k else 0.0,
        np.log1p(k) / 10,
        float(k < 5),
    ]
    return np.concatenate((np.sqrt(single), np.sqrt(double), more)).astype(np.float32)


N_FEATURES = 256 + PAIRS + 13


def bradley_terry(x: np.ndarray, y: np.ndarray, max_pairs: int, seed: int = 7, steps: int = 400, decay: float = 1e-3):
    """Weights of the linear score whose differences predict which row of a pair is preferred."""
    rng = np.random.default_rng(seed)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    w = np.zeros(x.shape[1], np.float32)
    if not len(good) or not len(bad):
        return w
    m, v = np.zeros_like(w), np.zeros_like(w)
    n = min(max_pairs, len(good) * len(bad))
    first, second = rng.choice(good, n), rng.choice(bad, n)
    size = min(n, 2048)
    for step in range(1, steps + 1):
        pick = rng.integers(0, n, size)
        diff = x[first[pick]] - x[second[pick]]
        p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))  # chance given to the wrong order
        grad = -(p @ diff) / size + decay * w
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def best_cut(score: np.ndarray, y: np.ndarray) -> float:
    """The quantile of the scores that parts the labels with the highest balanced accuracy.

    Of a range that does equally well its middle is taken.
    """
    order = np.argsort(score, kind="stable")
    s, bad = score[order], (y[order] == 0)
    lost = np.concatenate(([0], np.cumsum(~bad))) / max(1, (~bad).sum())
    caught = np.concatenate(([0], np.cumsum(bad))) / max(1, bad.sum())
    gain = caught - lost
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    at = best[len(best) // 2]
    if at == 0:
        return float(s[0] - 1)
    if at == len(s):
        return float(s[-1] + 1)
    return float((s[at - 1] + s[at]) / 2)


class QualityModel:
    """Standardisation, weights and calibration; small, so it travels with the task."""

    def __init__(self, texts: list[str], labels: list[int], max_pairs: int, threshold: float):
        x = np.stack([features(t) for t in texts]) if texts else np.zeros((1, N_FEATURES), np.float32)
        y = np.array(labels or [1])
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-2
        self.w = bradley_terry((x - self.mean) / self.scale, y, max_pairs)
        score = self.raw(x)
        self.known = bool((y == 0).any() and (y == 1).any())
        self.cut = best_cut(score, y) if self.known else 0.0
        self.spread = float(score.std()) / 4 + 1e-6
        self.base = float(np.log(threshold / (1 - threshold)))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.w

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = np.stack([features(t or "") for t in texts])
        z = (self.raw(x) - self.cut) / self.spread if self.known else np.zeros(len(x))
        return 1 / (1 + np.exp(-np.clip(z + self.base, -40, 40)))


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    row_col: str | None = None,
    folds: int = 5,
    held: int = 0,
    threshold: float = 0.3,
    max_rows: int = 12_000,
    max_pairs: int = 200_000,
    max_chars: int = 30_000,
) -> DataFrame:
    """``row, id, held_out, score, predicted`` for every document."""
    model = train(docs, labels, label, id_col, text_col, folds, held, threshold, max_rows, max_pairs, max_chars)
    row = F.col(row_col) if row_col else F.lit(0)
    narrow = docs.select(
        row.cast("long").alias("row"),
        F.col(id_col).alias("id"),
        F.coalesce(fold(F.col(id_col), folds) == held, F.lit(False)).alias("held_out"),
        F.col(text_col).cast("string").alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                score = model.score(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("id"), part.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))],
                    ["row", "id", "held_out", "score", "predicted"],
                )

    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"row long, id {kind}, held_out boolean, score double, predicted int")


def train(docs, labels, label, id_col, text_col, folds, held, threshold, max_rows, max_pairs, max_chars) -> QualityModel:
    return QualityModel(*sample(docs, labels, label, folds, held, max_rows, max_chars, id_col, text_col), max_pairs, threshold)


def good_documents(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = 5,
    held: int = 0,
    threshold: float = 0.3,
    max_rows: int = 12_000,
    max_pairs: int = 200_000,
    max_chars: int = 30_000,
) -> DataFrame:
    """The rows scored at or above the threshold, with all their columns, in one map."""
    model = train(docs, labels, label, id_col, text_col, folds, held, threshold, max_rows, max_pairs, max_chars)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                yield part.filter(pa.array(model.score(part.column(at).to_pylist()) >= threshold))

    return docs.mapInArrow(run, docs.schema)
