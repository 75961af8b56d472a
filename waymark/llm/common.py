"""Helpers that several operators of this folder share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.session import materialize

#: Bytes of text hashed in one numpy pass: temporaries are about 40 times that.
PASS_BYTES = 1 << 20
#: Bytes of text whose words are made distinct at once: temporaries are about ten times that.
TEXT_BYTES = 2 << 20
#: A side is broadcast only while its counted rows fit in this many bytes.
BROADCAST_BYTES = 32 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x2545F4914F6CDD1D | 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_powers = np.array([1], dtype=np.uint64)


def _power_table(n: int) -> np.ndarray:
    """``_BASE ** i`` modulo 2 ** 64 for i below n at least."""
    global _powers
    while len(_powers) < n:
        step = np.uint64(pow(_BASE, len(_powers), 1 << 64))
        _powers = np.concatenate([_powers, _powers * step])
    return _powers


def _hash_words(piece: bytes) -> np.ndarray:
    """64-bit hashes of the words of one piece of text, in order."""
    buf = np.frombuffer(piece, dtype=np.uint8)
    inside = np.flatnonzero(~_SPACE[buf])
    if not len(inside):
        return np.empty(0, dtype=np.uint64)
    first = np.flatnonzero(np.diff(inside, prepend=-2) != 1)
    length = np.diff(first, append=len(inside))
    place = np.arange(len(inside)) - np.repeat(first, length)
    table = _power_table(int(length.max()))
    values = (buf[inside].astype(np.uint64) + np.uint64(1)) * table[place]
    return mix(np.add.reduceat(values, first) + length.astype(np.uint64) * _STEP)


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a whole text, piece by piece."""
    if len(text) <= PASS_BYTES:
        return _hash_words(text)
    parts, at = [], 0
    while at < len(text):
        end = min(len(text), at + PASS_BYTES)
        while end < len(text) and not _SPACE[text[end]]:
            end += 1
        parts.append(_hash_words(text[at:end]))
        at = end
    return np.concatenate(parts)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; fewer words make one run of them all."""
    n = len(words)
    if not n:
        return words
    size = min(size, n)
    total = np.full(n - size + 1, np.uint64(size), dtype=np.uint64)
    for j in range(size):
        total = mix(total + words[j : n - size + 1 + j] * np.uint64((2 * j + 3) * 0x9E3779B1 | 1))
    return total


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text with A-Z lower-cased; null counts as empty."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    return np.unique(shingle_hashes(words, size))


def batches(rows: Iterator[pa.RecordBatch], at_most: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in batches small enough for their temporaries."""
    for batch in rows:
        for start in range(0, batch.num_rows, at_most):
            yield batch.slice(start, at_most)


def text_batches(rows: Iterator[pa.RecordBatch], column: str, at_most: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``at_most`` bytes in one column; a row with more is a batch of its own."""
    for batch in rows:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + at_most, side="right")))
            yield batch.slice(start, stop - start)
            # Else the pool keeps the largest batch's temporaries for as long as the worker lives.
            pa.default_memory_pool().release_unused()
            start = stop


def cut_strings(texts: pa.Array, table: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Strings cut between bytes x, y wherever ``table[x, y]``: (all parts in order, where each string's parts begin and the last end).

    An empty string has no part.  ``texts`` is no slice and has no nulls.
    """
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32, len(texts) + 1) if len(texts) else np.zeros(1, np.int32)
    letters = np.frombuffer(data or b"", np.uint8)[: ends[-1]]
    cut = np.zeros(len(letters) + 1, dtype=bool)
    cut[1:-1] = table[letters[:-1], letters[1:]]
    cut[ends] = True
    at = np.flatnonzero(cut).astype(np.int32)
    parts = pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(at), data])
    return parts, np.searchsorted(at, ends)


def number_lists(parts: list[bytes], width: str) -> pa.ListArray:
    """Numbers of type ``width``, given as bytes, as one column of lists."""
    flat = np.frombuffer(b"".join(parts), width)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts))) // flat.itemsize
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat))


def joined_lists(lists: pa.ListArray, places: pa.Array | np.ndarray, ends: np.ndarray) -> pa.ListArray:
    """The lists at ``places[ends[i] : ends[i + 1]]`` as one list, for each i."""
    taken = lists.take(pa.array(places))
    return pa.ListArray.from_arrays(taken.offsets.take(pa.array(ends)), taken.values)


def free_name(taken: list[str], name: str) -> str:
    """``name``, or with a number behind it where a column has that name already (whatever its case)."""
    used = {c.lower() for c in taken}
    return next(n for n in (name, *(f"{name}_{i}" for i in range(1, len(used) + 2))) if n.lower() not in used)


def semi_join(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is in ``keys`` (a stored one-column table).

    The keys are counted: below :data:`BROADCAST_BYTES` they are broadcast and
    ``df`` is not shuffled, else both sides are.
    """
    small = keys.count() * 24 <= BROADCAST_BYTES
    return df.join(F.broadcast(keys) if small else keys, key, "left_semi")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of an edge table (a, b): rows (node, root), root the smallest node.

    Alternates large-star and small-star steps, each a minimum per node joined
    back to the edges.  Every step is written to the shared folder, so both sides of each
    join are plain tables whose skewed partitions adaptive execution can split.  Nothing but two
    numbers per round reaches the driver.  Null and equal ends are ignored.
    """
    edges = materialize(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a <> b")
        .distinct(),
        "edges",
    )
    before = None
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(rounds):
        # Large star: larger neighbours move to the smallest neighbour.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        edges = materialize(
            both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(),
            "large",
        )
        # Small star: smaller neighbours, and the node itself, move to the smallest of them.
        least = materialize(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
        joined = edges.join(least, "a")
        edges = materialize(
            joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b")
            .unionByName(least.select("a", F.col("m").alias("b")))
            .distinct(),
            "small",
        )
        now = edges.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
