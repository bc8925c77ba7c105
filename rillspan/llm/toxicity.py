"""Toxicity by multiple-instance learning over sentences.

Only documents carry labels.  A sentence's chance of being toxic is logistic in
its words' features (the word and its leading 3 to 7 letters); a document's is
the noisy-or of its sentences.  Training fits the weights to document labels
through the noisy-or, so sentences learn their own scores, and ``offending``
locates the sentences that make a document toxic.

Training sees at most ``max_rows`` labelled rows; features are screened for
being more common in documents labelled 1.  Scoring is one map over all
documents and whole texts.

Defined results: null and empty texts have no sentence and score 0; null ids are
scored and not held out; repeated rows each give a row; without labels of both
kinds every score is 0; other columns are never read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillspan.llm.labelled import fold, sample

LETTERS = re.compile(r"[^\W\d_]+")
STOPS = (".", "!", "?", "…", ":", ";", "|")
PREFIXES = range(3, 8)


def word_features(word: str) -> list[str]:
    """The whole word, marked by a final space, and its beginnings."""
    return [word + " ", *(word[:k] for k in PREFIXES if len(word) >= k)]


def sentences(text: str) -> list[list[str]]:
    """White-space separated chunks, by sentence; lines end sentences too."""
    out: list[list[str]] = []
    for line in text.split("\n"):
        now: list[str] = []
        for chunk in line.split():
            now.append(chunk)
            if chunk.endswith(STOPS):
                out.append(now)
                now = []
        if now:
            out.append(now)
    return out


class ToxicModel:
    """Feature weights and the sentence bias; scores go through a bounded cache of chunks."""

    def __init__(self, texts: list[str], labels: list[int], most: int = 30_000, steps: int = 200, least: int = 3, decay: float = 1e-4):
        self.weights: dict[str, float] = {}
        self.heads: set[str] = set()
        self.bias = -40.0
        y = np.array(labels, bool)
        if y.any() and not y.all():
            self._fit(texts, y, most, steps, least, decay)

    def _fit(self, texts: list[str], y: np.ndarray, most: int, steps: int, least: int, decay: float) -> None:
        seen, toxic = Counter(), Counter()
        for text, bad in zip(texts, y, strict=True):
            found = {f for w in set(LETTERS.findall(text.lower())) for f in word_features(w)}
            seen.update(found)
            if bad:
                toxic.update(found)
        # more common among toxic documents than chance would have it, smoothed
        rate = (y.sum() + 1) / (len(y) + 2)
        lift = {f: (n + 0.5 * rate) / (seen[f] + 0.5) / rate for f, n in toxic.items() if n >= least}
        kept = sorted((f for f, r in lift.items() if r > 2), key=lambda f: (-toxic[f] * np.log(lift[f]), f))[:most]
        number = {f: n for n, f in enumerate(kept)}
        word_no: dict[str, int] = {}
        pairs: list[tuple[int, int]] = []  # word, feature
        hits: list[tuple[int, int]] = []  # sentence, word
        first: list[int] = []  # of each document, among sentences
        n = 0
        for text in texts:
            first.append(n)
            for chunks in sentences(text.lower()) or [[]]:
                for word in {w for c in chunks for w in LETTERS.findall(c)}:
                    at = word_no.get(word)
                    if at is None:
                        own = [number[f] for f in word_features(word) if f in number]
                        at = word_no[word] = len(word_no) if own else -1
                        if own:
                            pairs += [(at, f) for f in own]
                        else:
                            word_no[word] = -1
                    if at >= 0:
                        hits.append((n, at))
                n += 1
        # words without features took no number, so numbers may have holes
        wide = max(word_no.values(), default=-1) + 1
        pw, pf = np.array(pairs, np.int64).reshape(-1, 2).T
        hs, hw = np.array(hits, np.int64).reshape(-1, 2).T
        doc = np.repeat(np.arange(len(y)), np.diff([*first, n]))
        theta, bias = np.zeros(len(kept)), -6.0
        m, v = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
        scale = np.where(y, 2.0, 1.0) / len(y)  # a missed toxic document counts twice
        for step in range(1, steps + 1):
            value = np.bincount(pw, theta[pf], wide)
            z = np.clip(bias + np.bincount(hs, value[hw], n), -30, 30)
            p = 1 / (1 + np.exp(-z))
            safe = np.exp(-np.bincount(doc, np.logaddexp(0, z), len(y)))  # product of 1 - p
            # gradient of the log likelihood with respect to each sentence's z
            pull = np.where(y, safe / np.maximum(1 - safe, 1e-9), -1.0) * scale
            dz = -pull[doc] * p
            dvalue = np.bincount(hw, dz[hs], wide)
            grad = np.append(np.bincount(pf, dvalue[pw], len(kept)) + decay * theta, dz.sum())
            m = 0.9 * m + 0.1 * grad
            v = 0.99 * v + 0.01 * grad * grad
            move = 0.08 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            theta -= move[:-1]
            bias -= move[-1]
        self.bias = float(bias)
        self.weights = {f: float(theta[k]) for f, k in number.items() if abs(theta[k]) > 1e-3}
        self.heads = {f[:3] for f in self.weights}

    def value(self, chunk: str) -> float:
        get = self.weights.get
        words = [w for w in set(LETTERS.findall(chunk.lower())) if (w + " ")[:3] in self.heads]
        return sum(get(f, 0.0) for w in words for f in word_features(w))

    def sentence_scores(self, text: str) -> list[tuple[str, float]]:
        """Every sentence with its own chance of being toxic."""
        out = []
        for chunks in sentences(text):
            z = self.bias + sum(self.value(c) for c in set(chunks))
            out.append((" ".join(chunks), float(1 / (1 + np.exp(-np.clip(z, -40, 40))))))
        return out


class Scorer:
    """Document scores of many texts at once, as a task uses the model."""

    def __init__(self, model: ToxicModel, limit: int = 500_000):
        self.model, self.limit = model, limit
        self.number: dict[str, int] = {}
        self.value, self.stop = np.zeros(1 << 16), np.zeros(1 << 16, bool)

    def _learn(self, chunks: set[str]) -> None:
        if len(self.number) > self.limit:
            self.number.clear()
        new = [c for c in chunks if c not in self.number]
        while len(self.number) + len(new) > len(self.value):
            self.value, self.stop = np.append(self.value, self.value * 0), np.append(self.stop, self.stop & False)
        at = len(self.number)
        for n, chunk in enumerate(new, at):
            self.number[chunk] = n
            self.value[n] = self.model.value(chunk)
            self.stop[n] = chunk.endswith(STOPS)

    def scores(self, texts: list[str | None], budget: int = 1 << 20) -> np.ndarray:
        out = np.zeros(len(texts))
        for n, text in enumerate(texts):
            # log of the chance that no sentence is toxic, line by line within a budget
            held, size, safe = [], 0, 0.0
            for line in (text or "").split("\n"):
                chunks = line.split()
                if chunks:
                    held.append(chunks)
                    size += len(line)
                if size > budget:
                    safe += self._safe(held)
                    held, size = [], 0
            out[n] = 1 - np.exp(safe + self._safe(held))
        return out

    def _safe(self, lines: list[list[str]]) -> float:
        if not lines:
            return 0.0
        self._learn(set().union(*lines))
        ends = np.cumsum([len(x) for x in lines]) - 1
        ids = np.fromiter((i for x in lines for i in map(self.number.__getitem__, x)), np.int64, int(ends[-1]) + 1)
        stop = self.stop[ids]
        stop[ends] = True
        starts = np.flatnonzero(np.concatenate(([True], stop[:-1])))
        value = self.value[ids]
        hot = np.flatnonzero(value)
        sent = np.searchsorted(starts, hot, side="right") - 1
        # a chunk counts once in a sentence
        key = np.unique(np.stack((sent, ids[hot])), axis=1)
        z = self.model.bias + np.bincount(key[0], self.value[key[1]], len(starts))
        return -float(np.logaddexp(0, np.clip(z, -40, 40)).sum())


def toxicity_scores(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = 4,
    held: int = 2,
    threshold: float = 0.3,
    max_rows: int = 12_000,
    max_chars: int = 30_000,
) -> DataFrame:
    """``id, held_out, score, predicted`` for every document."""
    model = train(docs, labels, label, id_col, text_col, folds, held, max_rows, max_chars)
    narrow = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(fold(F.col(id_col), folds) == held, F.lit(False)).alias("held_out"),
        F.col(text_col).cast("string").alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                score = scorer.scores(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))],
                    ["id", "held_out", "score", "predicted"],
                )

    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int")


def train(docs, labels, label, id_col, text_col, folds, held, max_rows, max_chars) -> ToxicModel:
    return ToxicModel(*sample(docs, labels, label, folds, held, max_rows, max_chars, id_col, text_col))


def offending(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``id, sentence_no, sentence, score`` of the sentences at or above the threshold."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, no, said, score = [], [], [], []
            for n, text in enumerate(batch.column("text").to_pylist()):
                for k, (sentence, p) in enumerate(model.sentence_scores(text or "")):
                    if p >= threshold:
                        at.append(n), no.append(k), said.append(sentence), score.append(p)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(at, pa.int64())), pa.array(no, pa.int32()), pa.array(said, pa.string()), pa.array(score, pa.float64())],
                ["id", "sentence_no", "sentence", "score"],
            )

    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"id {kind}, sentence_no int, sentence string, score double")
