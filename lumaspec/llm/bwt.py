"""Merging of Burrows-Wheeler transforms by iterative interleave refinement.

A shard is a list of short byte strings. Its transform lists, for its suffixes
in order, the symbols before each. The merged order of several shards is held as
an interleave of their rows. One refinement walks through the interleave, takes
each row's next two symbols and deals the rows out by them; after h refinements
the interleave is sorted by the first 2 * h symbols, and rows whose first 2 * h
symbols are equal form a block. No suffix is compared or sorted again, and a
block of one row is resolved and left out. When ``depth`` symbols are reached
the blocks are the intervals of suffixes with a common prefix of that length.
"""

from __future__ import annotations

import numpy as np


def suffixes(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffix order of strings.

    ``data``: strings end to end as codes from 1 (under 256) with a 0 after
    each; ``ends``: places of the zeros. Equal suffixes stand in the order of
    their strings.
    """
    n = len(data)
    stop = np.repeat(ends, np.diff(np.concatenate([[-1], ends])))  # of each place's string
    room = (stop - np.arange(n)).astype(np.int16)
    padded = np.concatenate([data, np.zeros(8, dtype=data.dtype)])
    key = np.zeros(n, dtype=np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | np.where(room >= j, padded[j : j + n], 0).astype(np.uint64)
    length, most = 8, int(room.max(initial=0)) + 1
    while True:
        order = np.argsort(key)
        ordered = key[order]
        fresh = np.concatenate([[False], ordered[1:] != ordered[:-1]])
        rank = np.empty(n, dtype=np.uint64)
        rank[order] = np.cumsum(fresh).astype(np.uint64) + np.uint64(1)
        if length >= most or fresh.sum() == n - 1:
            break
        after = np.zeros(n, dtype=np.uint64)
        inside = np.flatnonzero(room >= length)
        after[inside] = rank[inside + length]
        key = (rank << np.uint64(32)) | after
        length *= 2
    return np.argsort((rank << np.uint64(32)) | np.arange(n, dtype=np.uint64))


def two_before(data: np.ndarray, order: np.ndarray, ends: np.ndarray, base: int, depth: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(code of the two symbols before each suffix, 0 where its string has fewer; row of the suffix two symbols longer, inverted (~) where fewer than ``depth`` symbols stand before)."""
    first = np.concatenate([[0], ends[:-1] + 1])
    code = np.zeros(len(data), dtype=np.uint16)
    code[2:] = data[:-2].astype(np.uint16) * np.uint16(base) + data[1:-1]
    code[first] = 0
    code[first + 1] = 0
    row = np.empty(len(data), dtype=np.int32)
    row[order] = np.arange(len(data), dtype=np.int32)
    longer = row[np.maximum(order - 2, 0)]
    short = np.arange(len(data)) - np.repeat(first, ends - first + 1) < depth
    return code[order], np.where(short[order], ~longer, longer)


def merge(transforms: list[np.ndarray], longer: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, block of each): the suffixes, as rows numbered shard after shard, that share their first ``depth`` symbols with another.

    The interleave starts as the shards one after the other, one block. Each
    refinement takes the next symbols of all rows in order and deals their
    longer suffixes out by them. A block of one row is resolved: what it
    leads to is alone as well, so it leaves the interleave. Rows that ``longer``
    inverts would come to the start of their string on the way: none starts there.
    """
    if depth % 2:
        raise ValueError("depth must be even")
    symbols = np.concatenate(transforms)
    base = np.cumsum([0, *map(len, longer[:-1])])
    step = np.concatenate([np.where(x < 0, ~x, x) + np.int32(b) for x, b in zip(longer, base, strict=True)])
    rows = np.flatnonzero(np.concatenate(longer) >= 0).astype(np.int32)
    block = np.zeros(len(rows), dtype=np.int32)
    for _ in range(depth // 2):
        symbol = symbols[rows]
        moved = np.flatnonzero(symbol)
        symbol = symbol[moved]
        order = np.argsort(symbol, kind="stable")
        symbol, moved = symbol[order], moved[order]
        block, rows = block[moved], step[rows[moved]]
        fresh = np.ones(len(rows) + 1, dtype=bool)
        np.logical_or(symbol[1:] != symbol[:-1], block[1:] != block[:-1], out=fresh[1:-1])
        open_ = ~(fresh[:-1] & fresh[1:])
        block = np.cumsum(fresh[:-1], dtype=np.int32)[open_]
        rows = rows[open_]
        if not len(rows):
            break
    return rows, block


def least_owners(strings: list[bytes], owners: np.ndarray, depth: int, shards: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For each start of a ``depth``-byte substring in each string, in order: the least owner of all strings that hold that substring.

    ``shards``: how many strings each shard has, shard after shard; each shard's
    transform is made by itself, then all are merged. Returns the values and how
    many each string has.
    """
    sizes = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
    windows = np.maximum(sizes - depth + 1, 0)
    if not windows.sum():
        return np.zeros(0, dtype=np.int64), windows
    raw = np.frombuffer(b"".join(strings), dtype=np.uint8)
    used = np.flatnonzero(np.bincount(raw, minlength=256))
    if len(used) > 254:
        raise ValueError("texts hold bytes that UTF-8 never has")
    code = np.zeros(256, dtype=np.uint8)
    code[used] = np.arange(1, len(used) + 1)
    raw, base = code[raw], len(used) + 1
    orders, transforms, longer, total, at_byte, a = [], [], [], 0, 0, 0
    for count in shards:
        length = sizes[a : a + count] + 1
        a += count
        if not count:
            continue
        ends = np.cumsum(length) - 1
        data = np.zeros(int(length.sum()), dtype=np.uint8)
        filled = np.ones(len(data), dtype=bool)
        filled[ends] = False
        data[filled] = raw[at_byte : at_byte + len(data) - len(ends)]
        at_byte += len(data) - len(ends)
        order = suffixes(data, ends)
        orders.append(order + total)
        code_before, row = two_before(data, order, ends, base, depth)
        transforms.append(code_before)
        longer.append(row)
        total += len(data)
    rows, block = merge(transforms, longer, depth)
    place = np.concatenate(orders)[rows]  # of each repeated suffix in the strings end to end
    starts = np.cumsum(sizes + 1) - sizes - 1
    string = np.searchsorted(starts, place, "right") - 1
    out = np.repeat(owners, windows)
    if len(rows):
        first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        least = np.minimum.reduceat(owners[string], first)
        before = np.cumsum(windows) - windows
        out[before[string] + place - starts[string]] = np.repeat(least, np.diff(np.append(first, len(rows))))
    return out, windows
