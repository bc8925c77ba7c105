from __future__ import annotations

import pytest

import corpus_pipeline
from rillspan.llm.mixing import mix_sources, mixed_documents
from rillspan.llm.work import Work
from tests.llm.helpers import ROWS, SF, stored, words


def targets(sizes):
    """Water filling by rounds, as the task states it."""
    weight = {s: n % 3 + 1 for n, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, fixed, free = sum(sizes.values()), {}, set(sizes)
    while free:
        rest, w = total - sum(fixed.values()), sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / w > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            fixed[s] = 3 * sizes[s]
            free.discard(s)
    return fixed | {s: rest * weight[s] / w for s in free}


def check(rows, source_of, block):
    sizes, taken = {}, {}
    for r in rows:
        s = source_of(r)
        sizes[s] = sizes.get(s, 0) + r.size
        taken[s] = taken.get(s, 0) + r.taken
        assert 0 <= r.taken <= 3 * r.size
    want = targets(sizes)
    for r in rows:
        s = source_of(r)
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.5 + 1e-6
    return taken


def test_mix_of_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    source = {r.doc_id: r.source for r in docs.collect()}
    rows = mix_sources(docs).documents().collect()
    assert {r.id: r.size for r in rows} == {r.doc_id: len(words(r.text)) for r in docs.collect()}
    check(rows, lambda r: source[r.id], 1024)
    again = mix_sources(docs.repartition(5)).documents().collect()
    assert sorted((r.id, r.taken) for r in again) == sorted((r.id, r.taken) for r in rows)


@pytest.mark.parametrize("block", [1, 7, 50])
def test_small_blocks_and_capped_sources(spark, tmp_path, block):
    rows = [(n, "w " * (n % 9), "x" if n < 150 else "ab"[n % 2] if n < 195 else None) for n in range(200)]
    docs = stored(spark, tmp_path, rows, "doc_id long, text string, source string")
    mix = mix_sources(docs, block=block, shard_slots=16, bucket_rows=20)
    source = {r[0]: r[2] for r in rows}
    check(mix.documents().collect(), lambda r: source[r.id], block)
    slots = mix.slots.collect()
    # a block appears once in each pass, and every shard is a mix
    assert len({(s.source_no, s.turn, s.block_no) for s in slots}) == len(slots)
    assert max(len([1 for s in slots if s.shard == k]) for k in {s.shard for s in slots}) <= 16


def test_mix_of_odd_rows(spark, tmp_path):
    rows = mix_sources(stored(spark, tmp_path)).documents().collect()
    assert len(rows) == len(ROWS)
    assert all(r.taken == 0 for r in rows if r.id in (3, 4, 5))
    assert mix_sources(stored(spark, tmp_path, [])).documents().count() == 0
    blank = [(1, None, "a"), (2, " ", None)]
    assert [r.taken for r in mix_sources(stored(spark, tmp_path, blank, "doc_id long, text string, source string")).documents().collect()] == [0, 0]


def test_mixed_documents_hold_what_is_taken(spark, tmp_path):
    rows = [(n, " ".join(f"w{n}_{k}" for k in range(n % 40)), "abc"[n % 3]) for n in range(90)]
    docs = stored(spark, tmp_path, rows, "doc_id long, text string, source string")
    taken = {r.id: r.taken for r in mix_sources(docs, block=10).documents().collect()}
    got = {}
    for r in mixed_documents(docs, chars_col=None, block=10).collect():
        got.setdefault(r.doc_id, []).extend(words(r.text))
    assert {i: len(w) for i, w in got.items()} == {i: t for i, t in taken.items() if t}
    text = dict((r[0], r[1].split()) for r in rows)
    for i, w in got.items():
        assert set(w) <= set(text[i]) and all(w.count(x) in (taken[i] // len(text[i]), taken[i] // len(text[i]) + 1) for x in text[i])


def test_pipeline_against_a_plain_version(spark):
    """Each stage's rows against the same decision made on the driver, one after the other."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from rillspan.llm.labelled import sample
    from rillspan.llm.quality import QualityModel
    from tests.llm.test_dedup import folded
    from tests.llm.test_near_copies import groups

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    work, outs, before = Work(spark, "test"), [], docs
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = work.save(stage(spark, before, SF), f"s{n}")
        outs.append(before)
    assert len(outs) == 5 and all(o.columns == docs.columns for o in outs[:4])
    rows = {r.doc_id: tuple(r) for r in docs.collect()}

    model = QualityModel(*sample(docs, labels, "quality", 5, 0, 12_000, 30_000), 200_000, 0.3)
    plain = [i for i in sorted(rows) if model.score([rows[i][1]])[0] >= 0.3]
    assert sorted(tuple(r) for r in outs[0].collect()) == [rows[i] for i in plain]

    best = {folded(rows[i][1]): i for i in plain}  # the largest id comes last
    plain = sorted(best.values())
    assert sorted(tuple(r) for r in outs[1].collect()) == [rows[i] for i in plain]

    roots = groups([rows[i][1] for i in plain])  # Jaccard similarity of 0.8, comparing all
    plain = [i for k, i in enumerate(plain) if roots[k] == k]
    assert sorted(tuple(r) for r in outs[2].collect()) == [rows[i] for i in plain]

    sizes, taken = {}, {}
    for i in plain:
        sizes[rows[i][3]] = sizes.get(rows[i][3], 0) + len(words(rows[i][1]))
    mixed = outs[3].collect()
    each = {}
    for r in mixed:
        taken[r.source] = taken.get(r.source, 0) + len(words(r.text))
        each[r.doc_id] = each.get(r.doc_id, 0) + len(words(r.text))
        assert r.source == rows[r.doc_id][3] and set(words(r.text)) <= set(words(rows[r.doc_id][1])) and r.n_chars == len(r.text)
    for source, target in targets(sizes).items():
        assert abs(taken.get(source, 0) - target) <= 1
    assert all(n <= 3 * len(words(rows[i][1])) for i, n in each.items())

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = sorted((r.doc_id, len(library.encode(r.text, add_special_tokens=False).ids) + 1) for r in mixed)
    pieces = outs[4].collect()
    got = {}
    for r in pieces:
        got.setdefault(r.doc_id, []).append(r.length)
    want = {}
    for i, n in ids:
        want[i] = want.get(i, 0) + n
    assert {i: sum(x) for i, x in got.items()} == want
    per_sequence = {}
    for r in pieces:
        per_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in per_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert corpus_pipeline.run(spark, SF).count() == len(pieces)
