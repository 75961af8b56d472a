"""Periodic runs of words, found through longest common extensions on suffix trees.

A run is a stretch of words with a smallest period q (words q apart are equal) that no neighbouring word
extends.  Every run has a Lyndon root in one of the two orders of the words (usual and reversed), and that root is the longest
Lyndon word at its start.  So the longest Lyndon word at each position is a candidate: it is extended to the
right and to the left as far as words q apart agree, and what is long enough is a run.

The extensions are common prefixes of two suffixes of the text, and of its reversal.  A suffix tree of each (Ukkonen's
construction) answers them in constant time: the lowest node that an Euler tour passes between two leaves is their lowest
common ancestor, found by a table of minima over powers of two.  The order of the suffixes, from which the
Lyndon words follow, is the order of the leaves in the same tree.

Only stretches in which a run of the asked exponent can lie get trees (see :func:`stretches`); nothing is lost by that.
Work and memory are linear in the words of a text (n log n 32-bit integers for the minima); every text is
worked on alone, inside the task that scans it, and nothing is shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import free_name

RUN = "array<struct<start: bigint, length: bigint, period: bigint>>"


class SuffixTree:
    """Suffix tree of ``text``, integers above 0; an end mark 0 is added, so every suffix has a leaf.

    ``first`` and ``stop`` delimit each node's edge, ``edges`` maps node * symbols + first symbol to the child.
    """

    def __init__(self, text: list[int]) -> None:
        self.text = [*text, 0]
        self.symbols = max(self.text) + 1
        self.first, self.stop, self.edges = [0], [0], {}
        self._build()

    def _build(self) -> None:
        text, edges, first, stop, wide = self.text, self.edges, self.first, self.stop, self.symbols
        shorter = [0]  # suffix links
        end = len(text)
        # The longest suffix that is not yet a leaf is text[at - length:i]: ``length`` symbols below ``node``.
        node, length, head, open_suffixes = 0, 0, 0, 0
        for i, symbol in enumerate(text):
            open_suffixes += 1
            unlinked = 0
            while open_suffixes:
                if not length:
                    head = i
                key = node * wide + text[head]
                child = edges.get(key)
                if child is None:
                    edges[key] = len(first)
                    first.append(i)
                    stop.append(end)
                    shorter.append(0)
                    if unlinked:
                        shorter[unlinked] = node
                        unlinked = 0
                else:
                    span = stop[child] - first[child]
                    if length >= span:
                        node, length, head = child, length - span, head + span
                        continue
                    middle = first[child] + length
                    if text[middle] == symbol:
                        if unlinked:
                            shorter[unlinked] = node
                        length += 1
                        break
                    fork = len(first)
                    edges[key] = fork
                    first += (first[child], i)
                    stop += (middle, end)
                    shorter += (0, 0)
                    first[child] = middle
                    edges[fork * wide + text[middle]] = child
                    edges[fork * wide + symbol] = fork + 1
                    if unlinked:
                        shorter[unlinked] = fork
                    unlinked = fork
                open_suffixes -= 1
                if node:
                    node = shorter[node]
                elif length:
                    length -= 1
                    head = i - open_suffixes + 1

    def _children(self, backwards: bool) -> tuple[list[int], list[int]]:
        """Children of all nodes in order of their first symbols, and where each node's begin; the end mark leads in both orders."""
        keys = np.fromiter(self.edges.keys(), np.int64, len(self.edges))
        child = np.fromiter(self.edges.values(), np.int64, len(self.edges))
        parent, symbol = keys // self.symbols, keys % self.symbols
        if backwards:
            symbol = np.where(symbol == 0, 0, self.symbols - symbol)
        order = np.lexsort((symbol, parent))
        begin = np.searchsorted(parent[order], np.arange(len(self.first) + 1))
        return child[order].tolist(), begin.tolist()

    def tour(self, backwards: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes in the order of the leaves, and the depth of the lowest node between each leaf and the one before."""
        children, begin = self._children(backwards)
        first, stop, end = self.first, self.stop, len(self.text)
        leaves, low = [], []
        lowest = 0
        stack = [(0, 0, 0)]  # node, depth of its parent in symbols, its own depth
        while stack:
            node, above, depth = stack.pop()
            if above < lowest:
                lowest = above
            a, b = begin[node], begin[node + 1]
            if a == b:
                leaves.append(end - depth)
                low.append(lowest)
                lowest = end
            else:
                for child in reversed(children[a:b]):
                    stack.append((child, depth, depth + stop[child] - first[child]))
        return np.array(leaves), np.array(low, dtype=np.int32)


class Extensions:
    """Longest common prefixes of pairs of suffixes of a text, each in constant time."""

    def __init__(self, leaves: np.ndarray, low: np.ndarray) -> None:
        self.rank = np.empty(len(leaves), dtype=np.int64)
        self.rank[leaves] = np.arange(len(leaves))
        levels = [low]
        while 2 * (step := 1 << (len(levels) - 1)) <= len(low):
            last = levels[-1]
            wider = last.copy()
            np.minimum(last[:-step], last[step:], out=wider[:-step])
            levels.append(wider)
        self.lowest = np.stack(levels)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths for suffixes a[i] and b[i], which differ."""
        x, y = self.rank[a], self.rank[b]
        lo, hi = np.minimum(x, y) + 1, np.maximum(x, y)
        level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
        return np.minimum(self.lowest[level, lo], self.lowest[level, hi - (1 << level) + 1])


def _lyndon_lengths(rank: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word at each position: up to the next smaller suffix.

    ``rank`` has the end mark's suffix last, the smallest of all.
    """
    ranks = rank.tolist()
    n = len(ranks) - 1
    until = [n] * n
    waiting: list[int] = []
    for i, r in enumerate(ranks):
        while waiting and ranks[waiting[-1]] > r:
            until[waiting.pop()] = i
        waiting.append(i)
    return np.array(until, dtype=np.int64) - np.arange(n)


def tree_runs(text: list[int], exponent: int, shortest: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence of integers above 0, at least ``exponent`` (2 or more) periods long."""
    n = len(text)
    if n < max(exponent, shortest):
        return []
    tree = SuffixTree(text)
    leaves, low = tree.tour()
    forward = Extensions(leaves, low)
    other = np.empty_like(forward.rank)
    other[tree.tour(backwards=True)[0]] = np.arange(n + 1)
    del tree
    at = np.arange(n)
    roots = np.concatenate([np.column_stack([at, _lyndon_lengths(r)]) for r in (forward.rank, other)])
    roots = np.unique(roots[roots[:, 1] * exponent <= n], axis=0)
    start, period = roots[:, 0], roots[:, 1]
    right = forward(start, start + period)
    backward = Extensions(*SuffixTree(text[::-1]).tour())
    left = backward(n - start, n - start - period)
    length = left + period + right
    enough = (length >= exponent * period) & (length >= shortest)
    found = np.column_stack([start - left, length, period])[enough]
    return sorted({tuple(row) for row in found.tolist()}, key=lambda r: (r[0], r[2]))


def stretches(text: list, exponent: int, shortest: int) -> Iterator[tuple[int, list]]:
    """(offset, words) of all stretches in which runs of that exponent can lie; every run is whole in one of them.

    A run holds each of its words ``exponent`` times or more, and each three words in a row ``exponent - 1`` times
    (``shortest - 2`` times where the period is 1).  So a text is cut at words, then at places of three words, that are rarer
    within their stretch, until none is.
    """
    triples = max(1, min(exponent - 1, shortest - 2)) if exponent > 2 else 1
    stack = [(0, text, False)]
    while stack:
        offset, words, paired = stack.pop()
        if len(words) < max(exponent, shortest):
            continue
        if paired:
            items, least, wide = list(zip(words, words[1:], words[2:], strict=False)), triples, 3
        else:
            items, least, wide = words, exponent, 1
        seen = Counter(items)
        rare = {x for x, n in seen.items() if n < least}
        if not rare:
            if paired or len(words) < 3:
                yield offset, words
            else:
                stack.append((offset, words, True))
            continue
        begin = 0
        for i, x in enumerate(items):
            if x in rare:
                if i > begin:
                    stack.append((offset + begin, words[begin : i + wide - 1], False))
                begin = i + 1
        if len(items) > begin:
            stack.append((offset + begin, words[begin:], False))


def runs_of(words: list, exponent: int = 4, shortest: int = 6) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least ``exponent`` periods and ``shortest`` words, by start, then period."""
    found = []
    for offset, part in stretches(words, exponent, shortest):
        names: dict = {}
        text = [names.setdefault(w, len(names) + 1) for w in part]
        found += [(offset + s, length, period) for s, length, period in tree_runs(text, exponent, shortest)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run contains after its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0)]


def with_runs(
    docs: DataFrame,
    text: str = "text",
    exponent: int = 4,
    shortest: int = 6,
    runs: str = "runs",
    collapsed: str = "collapsed",
) -> DataFrame:
    """The documents with their periodic runs and their text without the repetitions.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text, numbered from 0.  ``runs`` holds (start, length, period) of
    every run with at least ``exponent`` periods and ``shortest`` words, by start, then period; ``collapsed`` the words
    that no run contains after its first period, joined by one space.  Null and empty texts have no runs and an empty
    collapsed text.  Every row stays, repeated ones too, other columns pass through; where the table already has
    a column of the new names, the new one gets a number behind its name.
    """
    if exponent < 2:
        raise ValueError("a run repeats its period, so exponent is at least 2")
    found_type = f"runs {RUN}, collapsed string"

    @F.arrow_udf(found_type)
    def search(column: pa.Array) -> pa.Array:
        lists, texts = [], []
        for value in column.cast(pa.large_binary()):
            words = (value.as_py() or b"").split()
            found = runs_of(words, exponent, shortest)
            lists.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
            texts.append(b" ".join(collapse(words, found)))
        run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        columns = [pa.array(lists, pa.list_(run)), pa.array(texts, pa.binary()).cast(pa.string())]
        return pa.StructArray.from_arrays(columns, names=["runs", "collapsed"])

    own = [f"c{i}" for i in range(len(docs.columns))]
    at = [c.lower() for c in docs.columns].index(text.lower())
    table = docs.toDF(*own).withColumn("found", search(own[at]))
    first = free_name(docs.columns, runs)
    second = free_name([*docs.columns, first], collapsed)
    return table.select(*own, "found.runs", "found.collapsed").toDF(*docs.columns, first, second)
