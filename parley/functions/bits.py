"""Edit distances and edit paths of two sequences by whole columns of bits.

Myers' and Hyyro's recurrence keeps, for one column of the table of distances, which cells are one more or one
less than the cell above. A column is one integer of as many bits as the first sequence has entries, so a step costs a
few operations on machine words. Works on any hashable entries: tokens of a list, characters of a text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import isqrt

#: Entries found at more places than this get their bits once, the others whenever they are met.
OFTEN = 16


class Places:
    """Bits of the places where an entry stands in a sequence."""

    def __init__(self, items: Sequence):
        self.at: dict = {}
        for i, item in enumerate(items):
            self.at.setdefault(item, []).append(i)
        self.known: dict = {}

    def __call__(self, item) -> int:
        if item in self.known:
            return self.known[item]
        at = self.at.get(item)
        if at is None:
            return 0
        if len(at) <= OFTEN:
            bits = 0
            for i in at:
                bits |= 1 << i
            return bits
        packed = bytearray(at[-1] // 8 + 1)
        for i in at:
            packed[i >> 3] |= 1 << (i & 7)
        bits = self.known[item] = int.from_bytes(packed, "little")
        return bits


def columns(places: Places, items: Sequence, mask: int, more: int, less: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(same, more, less, right, left) after each of ``items``.

    ``same``: cells equal to their upper left neighbour; ``more`` and ``less``: one more or less than the cell above;
    ``right`` and ``left``: one more or less than the cell before.
    """
    for item in items:
        equal = places(item) | less
        same = ((((equal & more) + more) ^ more) | equal) & mask
        right = less | (mask ^ (more | same))
        left = more & same
        shifted = ((right << 1) | 1) & mask
        less = same & shifted
        more = ((left << 1) & mask) | (mask ^ (same | shifted))
        yield same, more, less, right, left


def within(a: Sequence, b: Sequence) -> bool:
    """Whether all of ``b`` stands in ``a`` in the same order."""
    rest = iter(a)
    return all(x in rest for x in b)


def distance(a: Sequence, b: Sequence) -> int:
    """Levenshtein distance; what both begin or end with is cut off first.

    Where the longer only has more entries, the difference of lengths is the distance. Else the last column is the
    distance's steps down from its top cell, which is the length of ``b``.
    """
    if len(a) < len(b):
        a, b = b, a
    if a == b:
        return 0
    first, last = 0, len(b)
    while first < last and a[first] == b[first]:
        first += 1
    while last > first and a[last - len(b) - 1] == b[last - 1]:
        last -= 1
    a, b = a[first : len(a) - (len(b) - last)], b[first:last]
    if not b or within(a, b):
        return len(a) - len(b)
    mask, places = (1 << len(a)) - 1, Places(a)
    more, less = mask, 0
    for item in b:
        equal = places(item) | less
        same = (((equal & more) + more) ^ more) | equal
        right = ((less | ~(more | same)) << 1) | 1
        less, more = same & right & mask, (((more & same) << 1) | ~(same | right)) & mask
    return len(b) + more.bit_count() - less.bit_count()


def align(a: Sequence, b: Sequence) -> list[tuple[int | None, int | None]]:
    """A cheapest edit path as pairs of places; of equal costs a pair first, then an entry of ``a`` alone, seen from the end.

    Every root-th column is kept on the way forward; on the way back the columns between two of them are made once
    more. Memory grows with the length times the root of the length, in bits.
    """
    n, mask, places, step = len(a), (1 << len(a)) - 1, Places(a), isqrt(len(b)) + 1
    kept, state = [(mask, 0)], (mask, 0)
    for at in range(0, len(b), step):
        for _, more, less, _, _ in columns(places, b[at : at + step], mask, *state):
            state = more, less
        kept.append(state)
    size, path, i, j = n // 8 + 1, [], n, len(b)
    while i and j:
        begin = (j - 1) // step * step
        packed = [(same.to_bytes(size, "little"), more.to_bytes(size, "little")) for same, more, *_ in columns(places, b[begin:j], mask, *kept[begin // step])]
        while i and j > begin:
            same, more = packed[j - 1 - begin]
            byte, bit = (i - 1) >> 3, 1 << ((i - 1) & 7)
            if a[i - 1] == b[j - 1] or not same[byte] & bit:
                i, j = i - 1, j - 1
                path.append((i, j))
            elif more[byte] & bit:
                i -= 1
                path.append((i, None))
            else:
                j -= 1
                path.append((None, j))
    path += [(k, None) for k in range(i - 1, -1, -1)] + [(None, k) for k in range(j - 1, -1, -1)]
    return path[::-1]
