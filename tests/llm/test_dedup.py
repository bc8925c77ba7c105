from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from rillspan.llm.bitslice import links
from rillspan.llm.components import stars
from rillspan.llm.exact_dedup import exact_dedup, unique_documents
from rillspan.llm.simhash import distinct_documents, simhash_groups
from rillspan.llm.substring_dedup import substring_dedup
from rillspan.llm.work import Work
from tests.llm.helpers import ROWS, SF, stored, words


def folded(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def exact_model(rows):
    groups = {}
    for id_, text in rows:
        groups.setdefault(folded(text), []).append(id_)
    best = lambda ids: max((i for i in ids if i is not None), default=None)
    return {t: (best(ids), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items()}


@pytest.mark.parametrize("support", [0.001, 0.3])
def test_exact_dedup(spark, tmp_path, support):
    rows = [(r[0], r[1]) for r in ROWS]
    model = exact_model(rows)
    got = exact_dedup(stored(spark, tmp_path), support=support).collect()
    want = sorted((str(i), *map(str, model[folded(t)])) for i, t in rows)
    assert sorted((str(r.id), str(r.keep_id), str(r.group_size), r.sha256) for r in got) == want
    # one row of each group stays, though a row is repeated
    assert sum(r.kept for r in got) == len(model)
    assert exact_dedup(stored(spark, tmp_path, [])).count() == 0


def test_exact_dedup_splits_a_hot_group(spark, tmp_path):
    rows = [(n, "Hot" if n % 3 == 0 else f"text {n % 50}") for n in range(600)]
    model = exact_model(rows)
    got = exact_dedup(stored(spark, tmp_path, rows, "doc_id long, text string"), support=0.05).collect()
    assert all((r.keep_id, r.group_size, r.sha256) == model[folded(t)] for r in got for t in [dict(rows)[r.id]])
    kept = unique_documents(stored(spark, tmp_path, rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in kept} == {m[0] for m in model.values()} and len(kept) == len(model)


def fingerprint(text, n):
    w = words(folded(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, radius):
    """Smallest index of each component, by comparing all."""
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    v = np.array(fps, np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(v[i] ^ v) <= radius):
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


@pytest.mark.parametrize(("n", "radius", "bands"), [(4, 4, 6), (5, 6, 8)])
def test_simhash_of_whole_table(spark, n, radius, bands):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    fps = [fingerprint(t, n) for _, t in rows]
    roots = components(fps, radius)
    got = {r.id: r for r in simhash_groups(docs, words=n, radius=radius, bands=bands).collect()}
    for k, (id_, _) in enumerate(rows):
        assert (got[id_].fingerprint, got[id_].component_id) == (f"{fps[k]:016x}", rows[roots[k]][0])
    assert sum(r.kept for r in got.values()) == len(set(roots))


def test_simhash_of_odd_rows(spark, tmp_path):
    got = simhash_groups(stored(spark, tmp_path), words=4).collect()
    assert len(got) == len(ROWS)
    by = {}
    for r in got:
        by.setdefault(r.id, r)
    assert {by[i].component_id for i in (1, 2, 9)} == {1}
    assert {by[i].component_id for i in (3, 4, 5)} == {3} and by[4].fingerprint == "0" * 16
    assert by[None].fingerprint == f"{fingerprint('no id here', 4):016x}"
    assert sum(r.kept for r in got) == len({r.component_id for r in got})
    assert simhash_groups(stored(spark, tmp_path, [])).count() == 0
    assert distinct_documents(stored(spark, tmp_path)).count() == sum(r.kept for r in got)


def test_bit_sliced_links_equal_comparing_all():
    rng = np.random.default_rng(0)
    for groups in (1, 2, 40, 3, 200):
        fps = [int(x) for x in rng.integers(0, 2**64, 100, dtype=np.uint64)]
        for x in fps[:3]:
            for _ in range(int(rng.integers(1, 400))):
                for b in rng.integers(0, 64, int(rng.integers(0, 6))):
                    x ^= 1 << int(b)
                fps.append(x)
        f = np.unique(np.array(fps, np.uint64))
        rng.shuffle(f)
        keys = np.sort(rng.integers(0, groups, len(f)))
        a, b = links(keys, f, 4)
        assert len(a) < len(f)  # a spanning star, never all pairs
        near = (np.bitwise_count(f[:, None] ^ f) <= 4) & (keys[:, None] == keys)

        def classes(pairs, f=f):
            parent = {int(x): int(x) for x in f}

            def root(x):
                while parent[x] != x:
                    x = parent[x]
                return x

            for x, y in pairs:
                parent[root(int(x))] = root(int(y))
            out = {}
            for x in f:
                out.setdefault(root(int(x)), set()).add(int(x))
            return sorted(map(sorted, out.values()))

        assert classes(zip(a, b, strict=True)) == classes(zip(*(f[k] for k in np.nonzero(near)), strict=True))


def test_components_of_paths_and_stars(spark):
    edges = [(n, n + 1) for n in range(40)] + [(100, n) for n in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.a: r.b for r in stars(df, Work(spark, "test")).collect()}
    assert got == {n: 0 for n in range(1, 41)} | {n: 100 for n in range(101, 140)} | {201: 200}


def substring_model(rows, window=20):
    seen, out = set(), {}
    for id_, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        w, gone = words(text), set()
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if key in seen:
                gone.update(range(s, s + window))
            seen.add(key)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.setdefault(id_, []).append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def same(got, rows, window=20):
    want = sorted((str(i), *x) for i, xs in substring_model(rows, window).items() for x in xs)
    assert sorted((str(r.id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == want


def test_substring_dedup_of_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = substring_dedup(docs).collect()
    same(got, [(r.doc_id, r.text) for r in docs.collect()])
    for r in got:
        assert sum(s["last"] - s["first"] + 1 for s in r.spans) == r.n_removed


def test_substring_dedup_of_mixed_passages(spark, tmp_path):
    r = random.Random(5)
    base = [[r.choice("abcdefgh") * r.randint(1, 2) for _ in range(120)] for _ in range(5)]
    rows = []
    for n in range(200):
        w = []
        for _ in range(r.randint(0, 4)):
            b, s = r.choice(base), r.randint(0, 100)
            w += b[s : s + r.randint(1, 60)] + ["x"] * (r.randint(1, 60) if r.random() < 0.2 else 0)
        rows.append((n * 7 % 200, " ".join(w)))
    got = substring_dedup(stored(spark, tmp_path, rows, "doc_id long, text string"), max_words=200, bucket_bytes=500).collect()
    same(got, rows)


def test_substring_dedup_of_odd_rows(spark, tmp_path):
    rows = [(r[0], r[1]) for r in ROWS]
    got = substring_dedup(stored(spark, tmp_path), window=4).collect()
    assert len(got) == len(rows)
    same([r for r in got if r.id != 2], [r for r in rows if r[0] != 2], 4)
    assert substring_dedup(stored(spark, tmp_path, [])).count() == 0
    with pytest.raises(ValueError):
        substring_dedup(stored(spark, tmp_path), window=5)
