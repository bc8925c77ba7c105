"""Byte-pair encoding of many words at once on ragged numpy arrays.

Pre-tokens of a batch lie end to end in one symbol array.  In every round each
sequence finds its lowest-rank adjacent pair and merges all of that pair's
occurrences simultaneously; sequences without a mergeable pair leave the
arrays.  The symbols that survive are the tokens.

Texts of ordinary Latin characters are cut into words by array operations on
their bytes; runs with any other character by the tokenizer's own rules.

The result equals that of the tokenizer file's own library; the file is read,
never changed.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

NONE = np.iinfo(np.int32).max

#: Characters for which lower-casing, composition and splitting need no tables:
#: white space and printable ASCII, and Latin letters up to U+017F.
ODD = re.compile("[^\t-\r -~À-ÖØ-öø-įı-ſ]|<\\|")
BLANKS = re.compile("[\t-\r ]+")
#: The pre-tokenizer's pattern, restricted to those characters.
PLAIN = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[a-zÀ-ÖØ-öø-ſ]+|[0-9]"
    "|[^\\sa-z0-9À-ÖØ-öø-ſ]+"
)

# the same for bytes of UTF-8: what each byte is part of
BLANK, LETTER, DIGIT, OTHER, HOLE, STRANGE = range(6)


def _byte_kinds() -> bytes:
    kinds = bytearray([STRANGE]) * 256
    kinds[0] = HOLE
    kinds[0x21:0x7F] = bytes([OTHER]) * 0x5E
    kinds[0x30:0x3A] = bytes([DIGIT]) * 10
    for letters in (range(0x41, 0x5B), range(0x61, 0x7B), range(0x80, 0xC0), range(0xC3, 0xC6)):
        kinds[letters.start : letters.stop] = bytes([LETTER]) * len(letters)
    for blank in b"\t\n\v\f\r ":
        kinds[blank] = BLANK
    return bytes(kinds)


def _lower_pairs() -> np.ndarray:
    """Lower case of two-byte letters by their low 11 bits, or 0 where the character is odd."""
    low = np.zeros((0x800, 2), np.uint8)
    for c in map(chr, range(0xC0, 0x180)):
        if not ODD.search(c):
            low[ord(c)] = list(c.lower().encode())
    return low


BYTE_KINDS, LOWER_PAIRS = _byte_kinds(), _lower_pairs()


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    chars = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}
    return [chars[b] for b in range(256)]


class RaggedBpe:
    """Merge tables of one ``tokenizers`` file and the ragged merge loop."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        chars = _byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int32)
        self.final = np.array([vocab[c + suffix] for c in chars], np.int32)
        self.byte_of = {c: b for b, c in enumerate(chars)}
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in model["merges"]], np.uint32)
        made = np.array([vocab[a + b] for a, b in model["merges"]], np.int32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of, self.made = keys[order], order.astype(np.int32), made
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.uint32) << np.uint32(16) | right.astype(np.uint32)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], NONE)

    def merge(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Yield (word numbers, token counts, token ids end to end) until every word is done."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        who = np.flatnonzero(lens)
        lens = lens[who]
        if not len(who):
            return
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym = self.inner[raw]
        ends = np.cumsum(lens)
        sym[ends - 1] = self.final[raw[ends - 1]]
        rank = np.full(len(sym), NONE, np.int32)
        rank[:-1] = self.ranks(sym[:-1], sym[1:])
        rank[ends - 1] = NONE
        while len(who):
            starts = np.cumsum(lens) - lens
            low = np.minimum.reduceat(rank, starts)
            live = low != NONE
            if not live.all():
                mask = np.repeat(live, lens)
                yield who[~live], lens[~live], sym[~mask]
                who, lens, low, sym, rank = who[live], lens[live], low[live], sym[mask], rank[mask]
                if not len(who):
                    return
            seq = np.repeat(np.arange(len(who)), lens)
            at = np.flatnonzero(rank == low[seq])
            close = np.diff(at) == 1
            if close.any():  # of a run such as aaa, every other pair from the left
                first = np.concatenate(([True], ~close))
                place = np.arange(len(at)) - np.flatnonzero(first)[np.cumsum(first) - 1]
                at = at[place % 2 == 0]
            sym[at] = self.made[rank[at]]
            rank[at] = rank[at + 1]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            lens = lens - np.bincount(seq[at], minlength=len(who))
            at = at - np.arange(len(at))
            sym, rank = sym[stay], rank[stay]
            ends = np.cumsum(lens)
            last = np.zeros(len(sym), bool)
            last[ends - 1] = True
            left = at[at > 0] - 1
            todo = np.concatenate((at, left))  # a few twice, which costs less than finding them
            todo = todo[~last[todo]]
            rank[todo] = self.ranks(sym[todo], sym[todo + 1])
            rank[ends - 1] = NONE

    def pre_tokens(self, chunk: str) -> list[bytes | int]:
        """UTF-8 words of a chunk without white space; ids stand for special strings."""
        if ODD.search(chunk) is None:
            return [w.encode() for w in PLAIN.findall(chunk.lower())]
        out: list[bytes | int] = []
        for part in self.special_split.split(chunk):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                clean = self.normalizer.normalize_str(part)
                out += [bytes(self.byte_of[c] for c in w) for w, _ in self.pre_tokenizer.pre_tokenize_str(clean)]
        return out


@functools.lru_cache(2)
def load(path: str) -> RaggedBpe:
    return RaggedBpe(path)


def pieces_of(text: str, size: int = 1 << 20) -> Iterator[str]:
    """The text cut at white space into parts of about ``size`` characters."""
    at = 0
    while len(text) - at > size:
        cut = BLANKS.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:] if at else text


def odd_parts(raw: list[bytes]) -> list[int]:
    """Numbers of the texts that hold an ``ODD`` character."""
    joined = b" ".join(raw)
    data = np.frombuffer(joined, np.uint8)
    kinds = np.frombuffer(joined.translate(BYTE_KINDS), np.uint8)
    lead = np.flatnonzero(data >= 0xC3)
    lead = lead[kinds[lead] == LETTER]
    pairs = (data[lead].astype(np.int64) & 0x1F) << 6 | data[lead + 1] & 0x3F
    at = [np.flatnonzero(kinds >= HOLE), lead[LOWER_PAIRS[pairs, 0] == 0]]
    if b"<|" in joined:
        at.append(np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|"))))
    ends = np.cumsum([len(x) + 1 for x in raw])
    return np.unique(np.searchsorted(ends, np.concatenate(at), "right")).tolist()


def plain_words(joined: bytes) -> tuple[pa.Array, np.ndarray]:
    """The words that ``PLAIN`` finds in lower-cased UTF-8, and where each starts.

    A zero byte between blanks is a word by itself; there are no other odd characters.
    """
    kinds = np.frombuffer(joined.translate(BYTE_KINDS), np.uint8)
    data = np.frombuffer(bytearray(joined.lower()), np.uint8)
    lead = np.flatnonzero(data >= 0xC3)
    if len(lead):
        pairs = (data[lead].astype(np.int64) & 0x1F) << 6 | data[lead + 1] & 0x3F
        data[lead], data[lead + 1] = LOWER_PAIRS[pairs].T
    full = kinds != BLANK
    start = kinds == DIGIT
    start[:1] = True
    start[1:] |= kinds[1:] != kinds[:-1]
    start &= full
    # 's 't 'm 'd 're 've 'll, where the apostrophe does not go on a run of signs
    quote = np.flatnonzero(data == ord("'"))
    quote = quote[start[quote]]
    if len(quote):
        after = np.concatenate((data, np.zeros(2, np.uint8)))
        one, two = after[quote + 1], after[quote + 2]
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        short = (one == ord("s")) | (one == ord("t")) | (one == ord("m")) | (one == ord("d"))
        start[quote[short | long] + 1] = False
        rest = np.concatenate((quote[short] + 2, quote[long] + 3))
        rest = rest[rest < len(data)]
        start[rest] = full[rest]
    packed = data[full]
    bounds = np.append(np.flatnonzero(start[full]), len(packed))
    words = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(packed)])
    return words, np.flatnonzero(start)


class Encoder:
    """Tokens of texts by way of a bounded cache of words.

    Texts lie end to end as bytes, are cut into words by array operations and
    looked up by distinct word.  Runs between white space that hold an odd
    character are cut by the tokenizer's own rules, each standing as one word.
    ``counts`` keeps numbers of tokens, otherwise little-endian 32-bit ids.
    """

    LONG = 200

    def __init__(self, path: str, counts: bool, limit: int = 600_000):
        self.bpe, self.counts, self.limit = load(path), counts, limit
        self.words: dict[bytes | int, int | bytes] = {}
        self.chunks: dict[str, int | bytes] = {}

    def learn(self, words: Iterable[bytes | int]) -> None:
        """Put these words into the cache."""
        missing = list(set(words).difference(self.words))
        for word in [w for w in missing if isinstance(w, int)]:
            self.words[word] = 1 if self.counts else word.to_bytes(4, "little")
        missing = [w for w in missing if isinstance(w, bytes)]
        for who, lens, ids in self.bpe.merge(missing):
            names = map(missing.__getitem__, who.tolist())
            if self.counts:
                self.words.update(zip(names, lens.tolist(), strict=True))
            else:
                blob, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(lens)).tolist()
                self.words.update(zip(names, (blob[e - 4 * n : e] for e, n in zip(ends, lens.tolist(), strict=True)), strict=True))

    def learn_chunks(self, chunks: Iterable[str]) -> None:
        """Put these runs without white space into the cache."""
        new = list(set(chunks).difference(self.chunks))
        split = list(map(self.bpe.pre_tokens, new))
        self.learn(itertools.chain.from_iterable(split))
        get = self.words.__getitem__
        if self.counts:
            self.chunks.update((c, sum(map(get, s))) for c, s in zip(new, split, strict=True))
        else:
            self.chunks.update((c, b"".join(map(get, s))) for c, s in zip(new, split, strict=True))

    def forget(self, words: Iterable[bytes | int], chunks: Iterable[str]) -> None:
        """Keep the cache bounded: these long entries go, and everything once there is too much."""
        for c in chunks:
            self.chunks.pop(c, None)
        for w in words:
            self.words.pop(w, None)
        if len(self.chunks) > self.limit:
            self.chunks.clear()
        if len(self.words) > self.limit:
            self.words.clear()

    def tokens(self, parts: list[str]) -> list[int | bytes]:
        """Per part its number of tokens or its ids."""
        raw = [p.encode() for p in parts]
        odd: list[str] = []
        for n in odd_parts(raw):
            chunks = [c for c in BLANKS.split(parts[n]) if c]
            strange = [ODD.search(c) is not None for c in chunks]
            odd += itertools.compress(chunks, strange)
            raw[n] = " ".join("\0" if s else c for c, s in zip(chunks, strange, strict=True)).encode()
        found, starts = plain_words(b" ".join(raw))
        coded = found.dictionary_encode()
        known, which = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        values = list(map(self.words.get, known))
        new = [w for w, v in zip(known, values, strict=True) if v is None]
        self.learn(new)
        values = [self.words[w] if v is None else v for w, v in zip(known, values, strict=True)]
        long = pc.indices_nonzero(pc.greater(pc.binary_length(coded.dictionary), self.LONG)).to_pylist()
        long_words: list[bytes | int] = [known[n] for n in long]
        long_chunks = {c for c in odd if len(c) > self.LONG}
        if odd:
            self.learn_chunks(odd)
            which = np.where(which == known.index(b"\0"), -1, which)
            which[which < 0] = np.arange(len(known), len(known) + len(odd))
            values += map(self.chunks.__getitem__, odd)
            long_words += (w for c in long_chunks for w in self.bpe.pre_tokens(c))
        self.forget(long_words, long_chunks)
        first = np.searchsorted(starts, np.cumsum([0, *(len(x) + 1 for x in raw)]))
        if self.counts:
            total = np.concatenate(([0], np.cumsum(np.array(values, np.int64)[which])))
            return np.diff(total[first]).tolist()
        ids = pa.array(values, pa.large_binary()).take(pa.array(which))
        ends = np.frombuffer(ids.buffers()[1], np.int64)[first].tolist()
        blob = memoryview(ids.buffers()[2] or b"")
        return [bytes(blob[a:b]) for a, b in itertools.pairwise(ends)]

    def encode(self, texts: list[str | None], budget: int = 1 << 22) -> list[int | bytes]:
        """Per text its number of tokens or its ids; memory follows ``budget``, not the batch."""
        out: list[int | bytes] = []
        empty: int | bytes = 0 if self.counts else b""
        group: list[tuple[int, str]] = []
        size = 0

        def flush() -> None:
            nonlocal size
            for (n, _), made in zip(group, self.tokens([p for _, p in group]), strict=True):
                out[n] += made
            group.clear()
            size = 0

        for n, text in enumerate(texts):
            out.append(empty)
            for part in pieces_of(text or ""):
                group.append((n, part))
                size += len(part)
                if size >= budget:
                    flush()
        flush()
        return out


@functools.lru_cache(2)
def encoder(path: str, counts: bool) -> Encoder:
    """The encoder of this Python worker; its cache lives as long as the worker."""
    return Encoder(path, counts)
