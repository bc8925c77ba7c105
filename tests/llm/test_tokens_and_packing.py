from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rillspan.llm.packing import best_fit_decreasing, best_fit_packing, lower_bound, pack
from rillspan.llm.ragged_bpe import ODD, PLAIN, Encoder, RaggedBpe, odd_parts, pieces_of, plain_words
from rillspan.llm.token_counts import token_counts
from rillspan.llm.work import Work
from tests.llm.helpers import ROWS, SCHEMA, SF, stored

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts(n=400):
    r = random.Random(1)
    alphabet = "ab's tT'll \n\t\x0b\x0c\x1c\x85\xa0éÉßΣςσİıŉ12²½٣中文🙂é don't I'M _-—…ǅﬁ aaaaaaa"
    out = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(n)]
    return out + ["", "<|endoftext|>", "x<|startoftext|>y", "<|endoftext|", "a" * 5000, "A" * 300 + "!!!" * 100, None]


def test_encoder_equals_the_library(library):
    texts = odd_texts()
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in Encoder(PATH, False).encode(texts, budget=500)] == want
    assert Encoder(PATH, True, limit=50).encode(texts, budget=500) == list(map(len, want))


def test_array_splitting_equals_the_pattern():
    r = random.Random(4)
    plain = ["".join(r.choice("abstdrvelmDRVELMST'''' \t\n019!.,-<ÉéÀŸžſß") for _ in range(r.randint(0, 40))) for _ in range(3000)]
    plain += ["", "'", "a'", "'s", "''s", "'re've", "!'ll", "'Ll'same", "<", " "]
    want = [[w.encode() for w in PLAIN.findall(t.lower())] for t in plain]
    assert [plain_words(t.encode())[0].to_pylist() for t in plain] == want
    texts = [*map(chr, [*range(0x500), 0x2028, 0x1F642]), "a<|b", "<a|", "a\0b", "<"]
    assert odd_parts([t.encode() for t in texts]) == [n for n, t in enumerate(texts) if ODD.search(t)]


def test_plain_texts_are_never_split_one_run_at_a_time(monkeypatch, library):
    """op1_best_fit_packing spent most of its CPU seconds on that."""
    monkeypatch.setattr(RaggedBpe, "pre_tokens", None)
    texts = [f"Don't 'stop' at {n}: élan-{n * n}, it's\tfine!" for n in range(300)]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in Encoder(PATH, False).encode(texts, budget=2000)] == want
    assert Encoder(PATH, True).encode(texts) == list(map(len, want))


def test_the_cache_stays_bounded():
    cache = Encoder(PATH, False, limit=100)
    for lo in range(0, 400, 50):
        cache.encode([f"w{'abcdefghij'[n % 10] * (n // 10)} ½{n} " + "y" * 300 + " ½" + "z" * 300 for n in range(lo, lo + 50)])
        assert len(cache.words) <= 100 and len(cache.chunks) <= 100
        assert all(len(k) <= Encoder.LONG for k in [*cache.words, *cache.chunks] if not isinstance(k, int))


def test_long_texts_are_cut_at_white_space():
    text = "ab cd " * 1000
    assert "".join(" " + p for p in pieces_of(text, 100)).split() == text.split()
    assert list(pieces_of("x" * 500, 100)) == ["x" * 500]


def test_token_counts_of_whole_table(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.id: r for r in token_counts(docs, PATH).collect()}
    for r in docs.collect():
        n = len(library.encode(r.text, add_special_tokens=False).ids)
        assert (got[r.doc_id].n_tokens, got[r.doc_id].n_bytes, got[r.doc_id].over_limit) == (n, len(r.text.encode()), n > 2048)


def test_token_counts_of_odd_rows(spark, tmp_path, library):
    got = token_counts(stored(spark, tmp_path), PATH).collect()
    want = [(r[0], len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in ROWS]
    assert sorted((str(r.id), r.n_bytes, r.n_tokens) for r in got) == sorted((str(a), b, c) for a, b, c in want)
    assert token_counts(stored(spark, tmp_path, []), PATH).count() == 0


def check_packing(rows, ids_of, capacity):
    """Pieces hold every id once, sequences are gapless and within capacity."""
    by_sequence = {}
    for r in rows:
        ids = ids_of[r.id][r.start : r.start + capacity]
        assert (r.start, r.length, r.ids_crc32) == (r.piece * capacity, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_packing_of_whole_table(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r.doc_id: [*library.encode(r.text, add_special_tokens=False).ids, 1] for r in docs.collect()}
    rows = best_fit_packing(docs, PATH).collect()
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    n = check_packing(rows, ids, 4096)
    assert n == lower_bound(np.array([r.length for r in rows]), 4096)


def test_packing_of_odd_rows(spark, tmp_path, library):
    rows = best_fit_packing(stored(spark, tmp_path), PATH, capacity=64).collect()
    want = sum(len(library.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in ROWS)
    assert sum(r.length for r in rows) == want and max(r.length for r in rows) <= 64
    assert best_fit_packing(stored(spark, tmp_path, [], SCHEMA), PATH).count() == 0


def test_partitions_exchange(spark, tmp_path):
    r = random.Random(2)
    lengths = [r.choice((r.randint(1, 100), r.randint(30, 60))) for _ in range(900)]
    made = stored(spark, tmp_path, [(n, x) for n, x in enumerate(lengths)], "id long, length long")
    rows = pack(made, Work(spark, "test"), 100, per_partition=60).collect()
    assert sorted(x.id for x in rows) == list(range(900))
    sums = {}
    for x in rows:
        sums[x.sequence_id] = sums.get(x.sequence_id, 0) + x.length
    assert max(sums.values()) <= 100
    assert len(sums) <= lower_bound(np.array(lengths), 100) * 1.03 + 1


def test_lower_bound_never_exceeds_the_best():
    r = random.Random(3)
    for _ in range(200):
        capacity = r.randint(4, 30)
        lengths = np.array(sorted((r.randint(1, capacity) for _ in range(r.randint(1, 25))), reverse=True))
        used = len(best_fit_decreasing(lengths, capacity)[2])
        assert -(-lengths.sum() // capacity) <= lower_bound(lengths, capacity) <= used
    assert lower_bound(np.array([51] * 7), 100) == 7
    assert lower_bound(np.array([34] * 7), 100) == 4
    assert lower_bound(np.zeros(0, int), 100) == 0
