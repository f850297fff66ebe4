"""Ranges of Morton codes that cover a box of keys, in any number of dimensions."""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def morton_code(key: Sequence[int]) -> int:
    """Interleaved bits of a key; of each group of bits the first dimension's is the highest."""
    n, out = len(key), 0
    for d, x in enumerate(key):
        if x < 0:
            raise ValueError("keys must not be negative")
        for b in range(x.bit_length()):
            out |= ((x >> b) & 1) << (n * b + n - 1 - d)
    return out


def z_ranges(lo: Sequence[int], hi: Sequence[int], budget: int = 64) -> list[tuple[int, int]]:
    """At most ``budget`` ascending ranges of codes that hold every key from
    ``lo`` to ``hi`` (inclusive per dimension).

    The smallest aligned block around the box is split into its quadrants
    (octants ...); those outside the box are dropped, those inside it are
    ranges, and of the others the one with most codes is split next while the
    budget lasts.  What is left whole covers more than the box.
    """
    n = len(lo)
    if any(a > b for a, b in zip(lo, hi)):
        return []
    if any(a < 0 for a in lo):
        raise ValueError("keys must not be negative")
    level = max((a ^ b).bit_length() for a, b in zip(lo, hi))
    first = tuple(a >> level << level for a in lo)
    done: list[tuple[int, int]] = []
    open_blocks: list[tuple[int, tuple[int, ...]]] = []

    def place(level: int, at: tuple[int, ...]) -> None:
        ends = [x + (1 << level) - 1 for x in at]
        if any(x > b or e < a for x, e, a, b in zip(at, ends, lo, hi)):
            return
        if all(a <= x and e <= b for x, e, a, b in zip(at, ends, lo, hi)):
            code = morton_code(at)
            done.append((code, code + (1 << (n * level)) - 1))
        else:
            heapq.heappush(open_blocks, (-level, at))

    place(level, first)
    while open_blocks and len(done) + len(open_blocks) + (1 << n) - 1 <= budget:
        level, at = heapq.heappop(open_blocks)
        level = -level - 1
        for corner in range(1 << n):
            place(level, tuple(x + (((corner >> d) & 1) << level) for d, x in enumerate(at)))
    done += [(morton_code(at), morton_code(at) + (1 << (n * -level)) - 1) for level, at in open_blocks]
    out: list[tuple[int, int]] = []
    for a, b in sorted(done):
        if out and a == out[-1][1] + 1:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def in_ranges(code: Column, ranges: Sequence[tuple[int, int]]) -> Column:
    """Plain comparisons, so that the union of ranges reaches a Parquet scan."""
    each = [code == F.lit(a) if a == b else (code >= F.lit(a)) & (code <= F.lit(b)) for a, b in ranges]
    return reduce(lambda x, y: x | y, each) if each else F.lit(False)
