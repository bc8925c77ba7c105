"""The pipeline's near-dedup stage against brute-force Jaccard similarity."""

from __future__ import annotations

import random
from fractions import Fraction

import pytest

import corpus_pipeline
from rillspan.llm.near_copies import near_copies, without_near_copies
from tests.llm.helpers import ROWS, SF, stored, words
from tests.llm.test_dedup import folded


def shingles(text, n=5):
    w = words(folded(text))
    return frozenset(" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def groups(texts):
    """Smallest index of each group of texts at a similarity of 0.8 or more, comparing all."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or Fraction(both, len(sets[i] | sets[j])) >= Fraction(4, 5):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    return root


def edited(r, base, share):
    return [f"x{r.random()}" if r.random() < share else w for w in base]


def test_stage_of_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    root = groups([t for _, t in rows])
    assert len(set(root)) < len(root)
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [rows[k][0] for k in range(len(rows)) if root[k] == k]


@pytest.mark.parametrize("seed", [0, 1])
def test_edited_copies_and_common_passages(spark, tmp_path, seed):
    r = random.Random(seed)
    passage = [f"license{k}" for k in range(30)]
    texts = []
    for share, copies in ((0.0, 3), (0.02, 60), (0.03, 40), (0.05, 20), (0.3, 5)):
        base = [f"w{r.randint(0, 5000)}" for _ in range(r.randint(60, 200))] + passage
        texts += [" ".join(edited(r, base, share)) for _ in range(copies)]
    texts += [" ".join(passage + [f"v{r.randint(0, 9)}" for _ in range(r.randint(0, 60))]) for _ in range(40)]
    r.shuffle(texts)
    root = groups(texts)
    docs = stored(spark, tmp_path, list(enumerate(texts)), "doc_id long, text string")
    got = {x.id: x for x in near_copies(docs.selectExpr("*", "doc_id AS _row")).collect()}
    assert [got[k].component_id for k in range(len(texts))] == root
    assert [k for k in got if got[k].kept] and {k for k in got if got[k].kept} == set(root)


def test_exactly_four_fifths_links(spark, tmp_path):
    # 8 of 10 shingles shared by the first two; 8 of 11 and of 13 by the third
    base = [f"w{k}" for k in range(14)]
    rows = [(1, " ".join(base[:12])), (2, " ".join(base)), (3, " ".join(["q", "r", *base[:12], "s"]))]
    docs = stored(spark, tmp_path, rows, "doc_id long, text string")
    got = {x.id: x.component_id for x in near_copies(docs.selectExpr("*", "doc_id AS _row")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_odd_rows(spark, tmp_path):
    kept = without_near_copies(stored(spark, tmp_path)).collect()
    assert len(kept) == len(set(groups([x[1] for x in ROWS])))
    assert without_near_copies(stored(spark, tmp_path, [])).count() == 0


def test_pairs_on_planes_are_all_pairs():
    import numpy as np

    from rillspan.llm.bitslice import near_pairs

    rng = np.random.default_rng(4)
    sizes = [1, 2, 3, 64, 65, 200, 5]
    keys = np.repeat(np.arange(len(sizes)), sizes)
    fps = rng.integers(0, 1 << 62, len(keys), dtype=np.uint64)
    fps[70:] ^= fps[:1] & np.uint64(0xFF) | np.uint64(1) << rng.integers(0, 64, len(keys) - 70).astype(np.uint64)
    for radius in (3, 24, 30):
        near = {(i, j) for i in range(len(keys)) for j in range(i + 1, len(keys)) if keys[i] == keys[j] and int(fps[i] ^ fps[j]).bit_count() <= radius}
        got = [(i, j) for x, y in near_pairs(keys, fps, radius) for i, j in zip(x.tolist(), y.tolist(), strict=True)]
        assert len(got) == len(set(got)) and set(got) == near
        heads = set(np.flatnonzero(np.diff(keys, prepend=-1)).tolist())
        got = {(i, j) for x, y in near_pairs(keys, fps, radius, heads=True) for i, j in zip(x.tolist(), y.tolist(), strict=True)}
        assert got == {p for p in near if p[0] in heads}
