"""Repeated strings of a minimum length by interval expansion on a Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``text`` (byte values, 0 separates) ordered by their first ``depth`` symbols at least, by prefix doubling."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : k + n]
    width = 8
    while True:
        order = np.argsort(key, kind="quicksort" if width < depth else "stable")
        if width >= depth:
            return order
        ordered = key[order]
        step = np.empty(n, np.int64)
        step[0] = 0
        np.cumsum(ordered[1:] != ordered[:-1], out=step[1:])
        rank = np.empty(n, np.uint64)
        rank[order] = step.astype(np.uint64) + np.uint64(1)
        after = np.zeros(n, np.uint64)
        after[: max(n - width, 0)] = rank[width:]
        key = rank * np.uint64(n + 1) + after
        width *= 2


def boundaries(text: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """Where in ``order`` a suffix shares fewer than ``least`` symbols with the one before it.

    Breadth first, the intervals of all strings of one length are extended backwards by each symbol that precedes them.
    An interval that ends where no shorter string's did marks that end - its common prefix with what follows is one
    less than the string's length - and goes on to the next round; the others need not.  Common prefixes so come out in
    increasing order, and after ``least`` rounds the unmarked ends are those that share ``least`` symbols or more.
    Strings with a separator are not extended: ends next to suffixes shorter than ``least`` are not reliable.
    """
    n = len(text)
    before = text[order - 1]  # the transform; what precedes the text's start is its final separator
    counts = np.bincount(text, minlength=256)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    step = np.empty(n, np.int64)  # from a suffix's place to that of the one a symbol longer
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    step[:] = place[order - 1]
    block = np.zeros(n + 1, bool)
    block[starts[starts < n]] = True
    marked = np.zeros(n + 1, bool)
    marked[n] = marked[0] = True
    usable = before != 0
    low, high = np.zeros(1, np.int64), np.full(1, n - 1, np.int64)
    owner = np.full(n + 1, -1, np.int64)
    for _ in range(least):
        sizes = high - low + 1
        total = int(sizes.sum())
        if not total:
            break
        ids = np.repeat(np.arange(len(low)), sizes)
        at = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[ids]
        ok = usable[at]
        ids, to = ids[ok], step[at[ok]]
        if total > n // 16:
            owner[to] = ids
            edge = np.flatnonzero((owner[1:] != owner[:-1]) | block[1:]) + 1
            first = np.concatenate([[0], edge])
            last = np.concatenate([edge - 1, [n]])
            real = owner[first] >= 0
            first, last = first[real], np.minimum(last[real], n - 1)
            owner[to] = -1
        else:
            sort = np.argsort(to)
            to, ids = to[sort], ids[sort]
            new = np.ones(len(to), bool)
            new[1:] = (to[1:] != to[:-1] + 1) | (ids[1:] != ids[:-1]) | block[to[1:]]
            first = to[new]
            last = to[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(to) - 1]])] if len(to) else to
        fresh = ~marked[last + 1]
        marked[last[fresh] + 1] = True
        # an interval that ends at the text's end marks nothing, but its extensions may
        keep = fresh | (last == n - 1)
        low, high = first[keep], last[keep]
    return marked[:n]
