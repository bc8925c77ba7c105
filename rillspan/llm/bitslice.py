"""Comparison of 64-bit fingerprints on vertical bit planes.

Sixty-four fingerprints share a block: plane ``b`` of the block is one word
that holds bit ``b`` of all of them.  A query is compared with a whole block by
XOR against its own bit spread over the word; the mismatches of all 64 lanes
are counted together by carry-save adders, and a (query, block) pair is
abandoned as soon as every lane has exceeded the radius.
"""

from __future__ import annotations

import numpy as np

LANES = 64
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def planes_of(fps: np.ndarray) -> np.ndarray:
    """(64, blocks) bit planes; unused lanes of the last block are zero."""
    padded = np.zeros(-(-len(fps) // LANES) * LANES, "<u8")
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def lanes_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and lane of every set bit."""
    bits = np.unpackbits(words.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.nonzero(bits)


def within(planes: np.ndarray, block: np.ndarray, query: np.ndarray, live: np.ndarray, radius: int):
    """Rows and lane masks of the (block, query) pairs with a live lane in the radius."""
    rows = np.flatnonzero(live)
    block, query, live = block[rows], query[rows], live[rows]
    width = radius.bit_length()
    count = [np.zeros(len(rows), np.uint64) for _ in range(width)]
    over = np.zeros(len(rows), np.uint64)
    for b in range(0, 64, 2):
        x = planes[b][block] ^ (np.uint64(0) - (query >> np.uint64(b) & np.uint64(1)))
        y = planes[b + 1][block] ^ (np.uint64(0) - (query >> np.uint64(b + 1) & np.uint64(1)))
        half = x ^ y
        carry = x & y | half & count[0]
        count[0] = count[0] ^ half
        for k in range(1, width):
            count[k], carry = count[k] ^ carry, count[k] & carry
        over |= carry
        if b % 8 == 6:
            # lanes whose counter is above the radius, from the highest bit down
            more, same = over.copy(), ALL
            for k in reversed(range(width)):
                if radius >> k & 1:
                    same = same & count[k]
                else:
                    more |= same & count[k]
            live = live & ~more
            stay = np.flatnonzero(live)
            if len(stay) < len(live):
                rows, block, query, live, over = rows[stay], block[stay], query[stay], live[stay], over[stay]
                count = [c[stay] for c in count]
            if not len(rows):
                break
    return rows, live


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give linked items one label, the smallest of them, in place."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def small_groups(fps: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int, label: np.ndarray) -> None:
    """Link members within groups of at most 64; a group never spans two blocks."""
    room = np.int64(1) << np.ceil(np.log2(sizes)).astype(np.int64)
    order = np.argsort(-room, kind="stable")
    starts, sizes, room = starts[order], sizes[order], room[order]
    base = np.cumsum(room) - room
    inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    item = np.repeat(starts, sizes) + inside
    slot = np.repeat(base, sizes) + inside
    who = np.zeros(int(base[-1] + room[-1]) + LANES, np.int64)
    who[slot] = item
    laid = np.zeros(len(who), np.uint64)
    laid[slot] = fps[item]
    planes = planes_of(laid)
    lane = (slot % LANES).astype(np.uint64)
    last = np.repeat(((base + sizes - 1) % LANES).astype(np.uint64), sizes)
    after = (ALL >> (np.uint64(63) - last)) & ~(ALL >> (np.uint64(63) - lane))
    rows, live = within(planes, slot // LANES, fps[item], after, radius)
    r, c = lanes_of(live)
    merge(label, item[rows[r]], who[(slot // LANES)[rows[r]] * LANES + c])


def large_group(fps: np.ndarray, first: int, radius: int, label: np.ndarray, batch: int = 64, tries: int = 8) -> None:
    """Link members of one group of any size.

    Components are explored one after the other, each member compared with what
    is still unreached, so a dense group costs far less than all its pairs.
    When seeds keep finding little, the rest is compared batch by batch.
    """
    left = np.arange(len(fps))
    failed = 0
    while len(left) > batch and failed < tries:
        planes = planes_of(fps[left])
        unseen = np.full(planes.shape[1], ALL)
        unseen[-1] >>= np.uint64(-len(left) % LANES)
        unseen[0] &= ~np.uint64(1)
        seed, queue, reached = left[0], left[:1], 1
        blocks = np.arange(planes.shape[1])
        while len(queue):
            todo, queue = queue[:batch], queue[batch:]
            block, query = np.tile(blocks, len(todo)), np.repeat(fps[todo], len(blocks))
            rows, live = within(planes, block, query, np.tile(unseen, len(todo)), radius)
            new = np.zeros(len(blocks), np.uint64)
            np.bitwise_or.at(new, block[rows], live)
            unseen &= ~new
            r, c = lanes_of(new)
            found = left[r * LANES + c]
            reached += len(found)
            merge(label, np.full(len(found), first + seed), first + found)
            queue = np.concatenate((queue, found))
            if not unseen.any():
                break
        failed = failed + 1 if reached < batch else 0
        r, c = lanes_of(unseen)
        left = left[r * LANES + c]
    if len(left) < 2:
        return
    planes = planes_of(fps[left])
    for at in range(0, len(left), batch):
        todo = np.arange(at, min(at + batch, len(left)))
        blocks = np.arange(at // LANES, planes.shape[1])
        live = np.full(len(blocks), ALL)
        live[-1] >>= np.uint64(-len(left) % LANES)
        block, query = np.tile(blocks, len(todo)), np.repeat(fps[left[todo]], len(blocks))
        rows, hit = within(planes, block, query, np.tile(live, len(todo)), radius)
        r, c = lanes_of(hit)
        merge(label, first + left[todo[rows[r] // len(blocks)]], first + left[block[rows[r]] * LANES + c])


def links(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (item, first item of its component) that span all links inside groups of equal key.

    ``keys`` are sorted and every group is complete.
    """
    label = np.arange(len(keys))
    if len(keys):
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes = np.diff(np.append(starts, len(keys)))
        small = (sizes > 1) & (sizes <= LANES)
        if small.any():
            small_groups(fps, starts[small], sizes[small], radius, label)
        for first, size in zip(starts[sizes > LANES].tolist(), sizes[sizes > LANES].tolist(), strict=True):
            large_group(fps[first : first + size], first, radius, label)
    tied = np.flatnonzero(label != np.arange(len(keys)))
    return fps[tied], fps[label[tied]]


def _small_pairs(fps: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int, heads: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within the radius inside groups of at most 64; with ``heads`` only those of a group's first member."""
    room = np.int64(1) << np.ceil(np.log2(sizes)).astype(np.int64)
    order = np.argsort(-room, kind="stable")
    starts, sizes, room = starts[order], sizes[order], room[order]
    base = np.cumsum(room) - room  # a power of two of lanes each, the largest first: no group spans two blocks
    inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    item, slot = np.repeat(starts, sizes) + inside, np.repeat(base, sizes) + inside
    who = np.zeros(-(-int(base[-1] + room[-1]) // LANES) * LANES, np.int64)
    who[slot] = item
    laid = np.zeros(len(who), np.uint64)
    laid[slot] = fps[item]
    planes = planes_of(laid)
    lane, last = (slot % LANES).astype(np.uint64), np.repeat(((base + sizes - 1) % LANES).astype(np.uint64), sizes)
    after = (ALL >> (np.uint64(63) - last)) & ~(ALL >> (np.uint64(63) - lane))
    if heads:
        item, slot, after = item[inside == 0], slot[inside == 0], after[inside == 0]
    rows, live = within(planes, slot // LANES, fps[item], after, radius)
    r, c = lanes_of(live)
    return item[rows[r]], who[(slot // LANES)[rows[r]] * LANES + c]


def near_pairs(keys: np.ndarray, fps: np.ndarray, radius: int, heads: bool = False, batch: int = 64):
    """Pairs (x, y), x before y, of equal key within the radius, some at a time; with ``heads`` x is the first of its key.

    ``keys`` are grouped.
    """
    if not len(keys):
        return
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(starts, len(keys)))
    small = (sizes > 1) & (sizes <= LANES)
    if small.any():
        yield _small_pairs(fps, starts[small], sizes[small], radius, heads)
    for first, size in zip(starts[sizes > LANES].tolist(), sizes[sizes > LANES].tolist(), strict=True):
        planes = planes_of(fps[first : first + size])
        for at in range(0, 1 if heads else size, batch):
            todo = np.arange(at, 1 if heads else min(at + batch, size))
            blocks = np.arange(at // LANES, planes.shape[1])
            live = np.full(len(blocks), ALL)
            live[-1] >>= np.uint64(-size % LANES)
            rows, hit = within(planes, np.tile(blocks, len(todo)), np.repeat(fps[first + todo], len(blocks)), np.tile(live, len(todo)), radius)
            r, c = lanes_of(hit)
            x, y = todo[rows[r] // len(blocks)], blocks[rows[r] % len(blocks)] * LANES + c
            yield first + x[x < y], first + y[x < y]
