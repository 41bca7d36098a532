"""Suffix arrays by linear grouping (Baier's construction), of one text or of many texts at once.

A suffix's group is that of suffixes with the same Lyndon prefix. Groups are processed in descending order: for each member
the previous smaller suffix has the member's prefix as the next factor of its own, so it moves to a higher group, right
above its old one, the higher the more members point to it. Once all groups are final, suffixes are emitted in ascending
order: an emitted suffix puts those whose Lyndon prefix ends where it begins into the next free places of their groups.
No renaming and no recursion. Texts end with a symbol 1 that is smaller than all others and occurs there alone.

Members of a group stand side by side in the array, so a step takes one group of each text without looking at the rest of
it: each suffix is a member once and a child once, and the work is in proportion to the texts' length.
"""

from __future__ import annotations

import numpy as np


def suffix_arrays(text: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """The suffix arrays of the texts text[edge[k] : edge[k + 1]], each in its own part of the result, as places of `text`.

    At most 2^31 symbols: places are kept in 32 bits.
    """
    n = len(text)
    bits = np.int64(max(1, n.bit_length()))
    edge = edge.astype(np.int32)
    row = np.repeat(np.arange(len(edge) - 1, dtype=np.int32), np.diff(edge))
    array, group, size = _first_groups(text, row, n, bits)
    length = np.ones(n, np.int32)
    _refine(array, group, size, length, row, edge, bits)
    return _emit(group, length, edge, n, bits)


def _places(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1, ... count[k] of them, for each k in turn."""
    ends = count.cumsum(dtype=np.int32)
    if not len(ends):
        return ends
    out = (first - ends + count).repeat(count)
    out += np.arange(ends[-1], dtype=np.int32)
    return out


def _starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values start in x, which is not empty."""
    new = np.empty(len(x), bool)
    new[0] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return new.nonzero()[0].astype(np.int32)


def _sizes(starts: np.ndarray, n: int) -> np.ndarray:
    out = np.empty(len(starts), np.int32)
    np.subtract(starts[1:], starts[:-1], out=out[:-1])
    out[-1] = n - starts[-1]
    return out


def _first_groups(text: np.ndarray, row: np.ndarray, n: int, bits: np.int64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes in the order of their text and first symbol; of each the first place of its group; and the groups' sizes there."""
    both = (row * (np.int64(text.max(initial=0)) + 1) + text) << bits | np.arange(n)
    both.sort()
    array = (both & ((np.int64(1) << bits) - 1)).astype(np.int32)
    group, size = np.empty(n, np.int32), np.zeros(n, np.int32)
    if n:
        starts = _starts(both >> bits)
        count = _sizes(starts, n)
        group[array] = starts.repeat(count)
        size[starts] = count
    return array, group, size


def _refine(array: np.ndarray, group: np.ndarray, size: np.ndarray, length: np.ndarray, row: np.ndarray, edge: np.ndarray, bits: np.int64) -> None:
    """Processes the groups of all texts, one group of each text at a time, from the greatest down."""
    n = len(array)
    place = np.empty(n, np.int32)
    place[array] = np.arange(n, dtype=np.int32)
    before = np.arange(-1, n - 1, dtype=np.int32)  # leads from a processed suffix towards the nearest one before it that isn't
    done, moved = np.zeros(n, bool), np.zeros(n, bool)
    factor = np.zeros(len(edge) - 1, np.int32)
    alive, top = edge[:-1][edge[1:] > edge[:-1]], edge[1:][edge[1:] > edge[:-1]]
    while len(alive):
        first = group[array[top - 1]]
        count = top - first
        member = array[_places(first, count)]
        done[member] = True
        head = array[first]
        factor[row[head]] = length[head]
        at = before[member]
        low = alive.repeat(count)
        left = ((at >= low) & done[at]).nonzero()[0]
        while len(left):
            to = before[at[left]]
            at[left] = to
            left = left[(to >= low[left]) & done[to]]
        before[member] = at
        parent = at[at >= low]
        if len(parent):
            parent.sort()
            _raise(parent, array, place, group, size, length, factor, row, moved, bits)
        going = first > alive
        alive, top = alive[going], first[going]


def _raise(parent: np.ndarray, array, place, group, size, length, factor, row, moved, bits: np.int64) -> None:
    """Moves the parents, sorted and given once for each child, to new groups right above what is left of their own."""
    starts = _starts(parent)
    times = _sizes(starts, len(parent))
    parent = parent[starts]
    length[parent] += times * factor[row[parent]]
    old = group[parent]
    if len(parent) > 1:
        few = np.int64(int(times.max()).bit_length())
        if 2 * bits + few < 63:
            both = (old.astype(np.int64) << few | times) << bits | parent
            both.sort()
            parent = (both & ((np.int64(1) << bits) - 1)).astype(np.int32)
            part_start = _starts(both >> bits)
            old = (both >> (bits + few)).astype(np.int32)
        else:
            order = np.lexsort((times, old))
            parent, times, old = parent[order], times[order], old[order]
            part_start = _starts(old.astype(np.int64) << 32 | times)
    else:
        part_start = np.zeros(1, np.int32)
    class_start = _starts(old)
    in_class = _sizes(class_start, len(parent))
    owner = old[class_start]
    stay = size[owner] - in_class
    bound = owner + stay
    # the last places of each old group are the parents' now; what stood there takes the places that they leave
    to = (bound - class_start).repeat(in_class)
    to += np.arange(len(parent), dtype=np.int32)
    leave = place[parent]
    moved[parent] = True
    out = array[to]
    out = out[~moved[out]]
    moved[parent] = False
    if len(out):
        free = leave[leave < bound.repeat(in_class)]
        array[free] = out
        place[out] = free
    array[to] = parent
    place[parent] = to
    size[owner] = stay
    part_size = _sizes(part_start, len(parent))
    to = to[part_start]
    size[to] = part_size
    group[parent] = to.repeat(part_size)


def _emit(group: np.ndarray, length: np.ndarray, edge: np.ndarray, n: int, bits: np.int64) -> np.ndarray:
    """Suffixes in ascending order, as many of each text at a time as have found their places without a gap."""
    mask = (np.int64(1) << bits) - 1
    # suffixes by the place at which their Lyndon prefix ends: a chain for each such place; the least suffix has none
    ends = np.arange(n) + length
    rows = edge[1:] > edge[:-1]
    low, high = edge[:-1][rows], edge[1:][rows]
    ends[high - 1] = n
    child = ends << bits | np.arange(n)
    child.sort()
    child = child[: n - len(low)]
    count = np.bincount(child >> bits, minlength=n).astype(np.int32)
    first = count.cumsum(dtype=np.int32) - count
    child = (child & mask).astype(np.int32)
    filled = np.zeros(n, np.int32)
    out = np.full(n, -1, np.int32)
    group_at = np.sort(group)  # of each place of the result: groups stand side by side
    out[low] = high - 1
    filled[low] = 1
    at = low
    while len(at):
        g = group_at[at]
        end = g + filled[g]
        ready = out[_places(at, end - at)]
        c = child[_places(first[ready], count[ready])]
        if len(c):
            both = group[c].astype(np.int64) << bits | np.arange(len(c))
            both.sort()
            c = c[both & mask]
            to = both >> bits
            starts = _starts(to)
            many = _sizes(starts, len(to))
            to = to[starts].astype(np.int32)
            out[_places(to + filled[to], many)] = c
            filled[to] += many
        going = end < high
        at, high = end[going], high[going]
    return out
