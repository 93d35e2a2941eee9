"""Radix tries over bytes, with counters of each source at the leaves."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

import numpy as np


class _Node:
    __slots__ = ("label", "children", "leaf")

    def __init__(self, label: bytes):
        self.label, self.children, self.leaf = label, {}, -1


def _shared(a: bytes, b: bytes, at: int) -> int:
    """How many bytes ``a`` and ``b[at:]`` have in common at their start."""
    n = min(len(a), len(b) - at)
    if a[:n] == b[at : at + n]:
        return n
    return next(i for i in range(n) if a[i] != b[at + i])


class RadixTrie:
    """Terms as paths of byte strings; leaves are numbered in the order in which they were made.

    Paths are followed with a stack of their own, so terms may be of any length and nest to any depth.
    """

    def __init__(self) -> None:
        self.root = _Node(b"")
        self.size = 0

    def leaf(self, term: bytes) -> int:
        """The number of a term's leaf, made if it is new."""
        node, at = self.root, 0
        while at < len(term):
            child = node.children.get(term[at])
            if child is None:
                child = node.children[term[at]] = _Node(term[at:])
                node, at = child, len(term)
                continue
            n = _shared(child.label, term, at)
            if n < len(child.label):
                fork = _Node(child.label[:n])
                child.label = child.label[n:]
                fork.children[child.label[0]] = child
                node.children[term[at]] = child = fork
            node, at = child, at + n
        if node.leaf < 0:
            node.leaf = self.size
            self.size += 1
        return node.leaf

    def fill(self, terms: Iterable[bytes]) -> None:
        """Make the leaves of different terms that come in the order of their bytes, in an empty trie.

        A term leaves the path of the one before it where they part, so none is looked for from the root.
        """
        path, ends, before, last = [self.root], [0], b"", self.root
        for term in terms:
            n, most = 0, min(len(before), len(term))
            while n < most and before[n] == term[n]:
                n += 1
            while ends[-1] > n:
                last = path.pop()
                ends.pop()
            node = path[-1]
            if ends[-1] < n:
                fork = _Node(last.label[: n - ends[-1]])
                last.label = last.label[n - ends[-1] :]
                fork.children[last.label[0]] = last
                node.children[fork.label[0]] = node = fork
                path.append(fork)
                ends.append(n)
            if n < len(term):
                child = node.children[term[n]] = _Node(term[n:])
                node = child
                path.append(child)
                ends.append(len(term))
            node.leaf = self.size
            self.size += 1
            before = term

    def walk(self, start: bytes = b"", end: bytes | None = None) -> Iterator[tuple[bytes, int]]:
        """Terms from ``start`` up to, but without, ``end`` in the order of their bytes, which is that of their code points in UTF-8."""
        stack = [(b"", self.root)]
        while stack and not start and end is None:
            before, node = stack.pop()
            path = before + node.label
            if node.leaf >= 0:
                yield path, node.leaf
            if node.children:
                stack.extend([(path, node.children[b]) for b in sorted(node.children, reverse=True)])
        while stack:
            before, node = stack.pop()
            path = before + node.label
            if end is not None and path >= end:
                continue
            if path < start and not start.startswith(path):
                continue
            if node.leaf >= 0 and path >= start:
                yield path, node.leaf
            stack.extend((path, node.children[b]) for b in sorted(node.children, reverse=True))


class SourceTrie:
    """A trie whose leaves count each source's occurrences and documents; two of them merge into one."""

    def __init__(self) -> None:
        self.made = RadixTrie()
        self.numbers: dict[bytes, int] = {}  # terms in the order in which they came
        self.parts: list[tuple[str, np.ndarray, np.ndarray, np.ndarray]] = []

    @property
    def trie(self) -> RadixTrie:
        """The trie of all terms so far, made of all at once in their order."""
        if self.made.size != len(self.numbers):
            self.made = RadixTrie()
            self.made.fill(sorted(self.numbers))
        return self.made

    def add(self, source: str, occurrences: Mapping[bytes, int], documents: Mapping[bytes, int]) -> None:
        """Count a source's terms, the same in ``occurrences`` and ``documents``."""
        n, numbers = len(documents), self.numbers
        for term in documents.keys() - numbers.keys():
            numbers[term] = len(numbers)
        at = np.fromiter(map(numbers.__getitem__, documents), np.int64, n)
        counts = np.fromiter(map(occurrences.__getitem__, documents), np.int64, n)
        self.parts.append((source, at, counts, np.fromiter(documents.values(), np.int64, n)))

    def merge(self, other: SourceTrie) -> None:
        """Take in another trie's counters."""
        moved = np.zeros(len(other.numbers), np.int64)
        for term, number in other.numbers.items():
            moved[number] = self.numbers.setdefault(term, len(self.numbers))
        self.parts += [(source, moved[at], n, docs) for source, at, n, docs in other.parts]

    def leaves(self) -> tuple[list[bytes], list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Terms in order and sources in order, then for each leaf and source that occur together: their places, occurrences, documents."""
        terms = [term for term, _ in self.trie.walk()]
        place = np.zeros(len(terms), np.int64)
        place[np.fromiter(map(self.numbers.__getitem__, terms), np.int64, len(terms))] = np.arange(len(terms))
        sources = sorted({p[0] for p in self.parts})
        number = {s: i for i, s in enumerate(sources)}
        term = np.concatenate([place[p[1]] for p in self.parts] or [np.zeros(0, np.int64)])
        source = np.concatenate([np.full(len(p[1]), number[p[0]]) for p in self.parts] or [np.zeros(0, np.int64)])
        key, at = np.unique(term * max(1, len(sources)) + source, return_inverse=True)
        sums = []
        for k in (2, 3):
            total = np.zeros(len(key), np.int64)
            np.add.at(total, at, np.concatenate([p[k] for p in self.parts] or [np.zeros(0, np.int64)]))
            sums.append(total)
        return terms, sources, *np.divmod(key, max(1, len(sources))), *sums
