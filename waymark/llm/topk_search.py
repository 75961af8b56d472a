"""Exact top-k search by inner product with one KD-tree per shard.

Vectors are dealt to shards of bounded size by a hash of their row.  A task builds the tree
of its shard, by median splits of the widest component down to leaves, with a tight box around every node,
and answers blocks of queries.  A query visits nodes best first, by the largest inner product any
vector of the box could have, and stops when that falls below its kth best score.  Every query first searches one shard;
the kth score found there is passed on to all others, so most of their boxes are never opened.

Query blocks travel to the shards (not vectors to the queries), and each answers with k rows for each query.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import batches
from waymark.session import materialize

#: Vectors of a shard, about, and of a leaf of its tree.
SHARD, LEAF = 8192, 128
#: Queries answered between two batches of output.
QUERY_BLOCK = 256
_LONG = (-(2**63), 2**63 - 1)


class Tree:
    """KD-tree over integer vectors; nodes are rows of ``lo`` and ``hi``."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.lexsort((ids,))
        self.ids, self.vectors = ids[order], vectors[order]
        self.children: list[tuple[int, int] | None] = []
        self.span: list[tuple[int, int]] = []
        lo, hi = [], []
        perm = np.arange(len(ids))
        stack = [(0, len(ids), -1, 0)]
        while stack:
            a, b, parent, side = stack.pop()
            part = self.vectors[perm[a:b]]
            node = len(lo)
            lo.append(part.min(axis=0))
            hi.append(part.max(axis=0))
            self.children.append(None)
            self.span.append((a, b))
            if parent >= 0:
                left, right = self.children[parent] or (-1, -1)
                self.children[parent] = (node, right) if side == 0 else (left, node)
            if b - a > LEAF and (hi[-1] > lo[-1]).any():
                axis = int((hi[-1] - lo[-1]).argmax())
                middle = (b - a) // 2
                perm[a:b] = perm[a:b][np.argpartition(part[:, axis], middle)]
                stack += [(a, a + middle, node, 0), (a + middle, b, node, 1)]
        self.lo, self.hi = np.array(lo), np.array(hi)
        self.ids, self.vectors = self.ids[perm], self.vectors[perm]

    def search(self, query_id: int, query: np.ndarray, bounds: np.ndarray, k: int, kth: float) -> list[tuple[int, int]]:
        """The k best (score, id), ties to the smaller id, that can reach ``kth``; not the query's own."""
        best: list[tuple[int, int]] = []  # heap of (score, -id): the worst on top
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < kth:
                break
            if self.children[node]:
                for child in self.children[node]:
                    if bounds[child] >= kth:
                        heapq.heappush(heap, (-bounds[child], child))
                continue
            a, b = self.span[node]
            scores = self.vectors[a:b] @ query
            for i in np.flatnonzero(scores >= kth):
                item = (int(scores[i]), -int(self.ids[a + i]))
                if -item[1] == query_id:
                    continue
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
            if len(best) == k:
                kth = max(kth, best[0][0])
        return [(score, -neg) for score, neg in sorted(best, reverse=True)]


def arithmetic(largest: int, dim: int):
    """A number type in which inner products of such vectors are exact; Python's integers at worst."""
    top = largest * largest * max(dim, 1)
    return np.float64 if top < 2**53 else np.int64 if top < 2**63 else object


def _integers(rows: Iterator[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    """vec_id, embedding -> vec_id, dim, v (little-endian 64-bit integers) of whole finite vectors."""
    for batch in batches(rows, 2048):
        ids, dims, cells = [], [], []
        for vec_id, vector in zip(batch.column("vec_id").to_pylist(), batch.column("embedding"), strict=True):
            if vec_id is None or not vector.is_valid or vector.values.null_count:
                continue
            x = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)
            v = np.floor(scale * x)
            if not np.isfinite(v).all():
                continue
            v = np.clip(v, -(2.0**63), np.nextafter(2.0**63, 0)).astype("<i8")
            ids.append(vec_id)
            dims.append(len(v))
            cells.append(v.tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(cells, pa.binary())],
            names=["vec_id", "dim", "v"],
        )


def _search_shards(k: int):
    """Rows sorted by (dim, shard, vectors first): the shard's vectors, then queries with their kth score so far."""

    def stack(cells: list[bytes], dim: int) -> np.ndarray:
        return np.frombuffer(b"".join(cells), "<i8").reshape(len(cells), dim)

    def answer(tree: Tree | None, queries: list[tuple]) -> pa.RecordBatch:
        out: list[tuple] = []
        if tree is not None and queries:
            q = stack([x[1] for x in queries], tree.vectors.shape[1])
            kind = arithmetic(max(int(np.abs(q.astype(object)).max(initial=0)) if q.size else 0, tree.largest), q.shape[1])
            if kind is not tree.vectors.dtype and tree.vectors.dtype != np.dtype(kind):
                tree.vectors, tree.lo, tree.hi = (x.astype(kind) for x in (tree.exact, tree.exact_lo, tree.exact_hi))
            q = q.astype(kind)
            zero = q - q
            bounds = np.maximum(q, zero) @ tree.hi.T + np.minimum(q, zero) @ tree.lo.T
            for (query_id, _, kth), vector, bound in zip(queries, q, bounds, strict=True):
                found = tree.search(query_id, vector, bound, k, -np.inf if kth is None else kth)
                out += [(query_id, i, min(max(s, _LONG[0]), _LONG[1])) for s, i in found]
        columns = list(zip(*out, strict=True)) if out else [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    def build(dim: int, ids: list[int], cells: list[bytes]) -> Tree:
        tree = Tree(np.array(ids, dtype=np.int64), stack(cells, dim))
        tree.exact, tree.exact_lo, tree.exact_hi = tree.vectors, tree.lo, tree.hi
        tree.largest = int(np.abs(tree.vectors.astype(object)).max()) if tree.vectors.size else 0
        return tree

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, cells, tree, queries = None, [], [], None, []
        for batch in rows:
            lists = [batch.column(c).to_pylist() for c in ("dim", "shard", "is_query", "vec_id", "v", "kth")]
            for dim, shard, is_query, vec_id, v, kth in zip(*lists, strict=True):
                if key != (dim, shard):
                    yield answer(tree, queries)
                    key, ids, cells, tree, queries = (dim, shard), [], [], None, []
                if not is_query:
                    ids.append(vec_id)
                    cells.append(v)
                    continue
                if tree is None and ids:
                    tree = build(dim, ids, cells)
                    cells = []
                queries.append((vec_id, v, kth))
                if len(queries) == QUERY_BLOCK:
                    yield answer(tree, queries)
                    queries = []
        yield answer(tree, queries)

    return run


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: float = 256.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k best others (all, if fewer).

    ``vectors`` needs vec_id and embedding (array of numbers).  Components x count as floor(scale * x); queries are
    the rows whose vec_id is divisible by ``every``, candidates all vectors of the same length with another vec_id; ties go to the
    smaller vec_id.  Null vectors, vectors with null or non-finite components, and rows without vec_id take no part.  Rows
    that repeat a vec_id all stay candidates; if they are queries, the k best are taken over all their rows.  Scores beyond 64 bits stop at the ends of their range.
    """
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding"))
    integers = whole.mapInArrow(lambda rows: _integers(rows, scale), "vec_id long, dim int, v binary")
    integers = materialize(integers.withColumn("row", F.monotonically_increasing_id()), "vectors")
    # Number of shards by length: one row for each length of vectors.
    shards = integers.groupBy("dim").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards"))
    placed = integers.join(F.broadcast(materialize(shards, "shards")), "dim")
    # Dealt by row, so that an id with many rows fills no shard.
    home = F.expr("int(pmod(xxhash64(row), shards))")
    empty = F.lit(None).cast("long")
    stored = placed.select("dim", home.alias("shard"), F.lit(False).alias("is_query"), "vec_id", "v", empty.alias("kth"))
    queries = materialize(placed.where(F.col("vec_id") % every == 0).withColumn("home", home), "queries")

    def ask(asked: DataFrame) -> DataFrame:
        rows = stored.unionByName(asked.select("dim", "shard", F.lit(True).alias("is_query"), "vec_id", "v", "kth"))
        ordered = rows.repartition("dim", "shard").sortWithinPartitions("dim", "shard", "is_query")
        return ordered.mapInArrow(_search_shards(k), "query_id long, vec_id long, score long")

    at_home = materialize(ask(queries.select("dim", F.col("home").alias("shard"), "vec_id", "v", empty.alias("kth"))), "home")
    kth = at_home.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    kth = materialize(kth, "kth").withColumnRenamed("query_id", "vec_id")
    others = (
        queries.join(kth, "vec_id", "left")
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        .where("shard <> home")
    )
    found = at_home.unionByName(ask(others))
    best = F.expr("row_number() over (partition by query_id order by score desc, vec_id)").cast("int")
    return found.select("query_id", best.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
