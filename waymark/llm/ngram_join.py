"""N-gram Jaccard join: size-banded tiles, hashed bitmaps, exact intersection.

A document is the set of its distinct word shingles.  Two documents link when
``den * |A & B| >= num * |A | B|``.  Sets are compared inside *tiles* only: a tile holds the
sets of one size band that agree on a whole slice of the hash range.  A linked pair of sizes
a and b differs in at most ``(a + b) * (den - num) / (den + num)`` shingles; a band cuts the hash range
into some slices more than that, so every linked pair agrees on some.  A set takes only its fullest slices (of equally full
ones those of the smaller keys), one more than it can differ in from any set of the band it links with: the first slice in
that order on which a linked pair agrees is among them on both sides.  That slice may be empty only if both sets have
so many empty slices; such sets are in the tiles of their smallest hashes as well, one of which a linked pair
has in common.  So every linked pair shares at least one tile, and no other bound or cap is used.  Inside a tile bit counts of hashed bitmaps bound the overlap from above; what
passes is decided by intersecting the sorted hash arrays.

Equal sets are joined first and count as one.  In every tile each set is
compared with the tile's smallest id, so a group of n near copies costs n comparisons; only tiles whose members
did not all end in one component are compared pairwise (and only across
components), in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import BROADCAST_BYTES, batches, components, mix, semi_join, shingle_set
from waymark.operators.fusion import hot_entities
from waymark.session import materialize, remove, scratch_path

#: Width of a size band: sets up to 1.9 times as large share its slices.
BAND_RATIO = 1.9
#: Members of a tile that one task compares with as many others.
BLOCK = 2048
#: Followers of one leader that one task verifies.
FOLLOWERS = 128
#: Tiles of more rows are summed before their rows meet.
HOT_TILE = 1_000_000


class Rule:
    """The similarity rule ``den * inter >= num * union`` and the tiles that follow from it."""

    def __init__(self, size: int, num: int, den: int) -> None:
        if not 0 < num <= den or size < 1:
            raise ValueError("the threshold is a fraction above 0, the shingle size positive")
        self.size, self.num, self.den = size, num, den

    def linked(self, inter: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.den * inter >= self.num * (a + b - inter)

    def band(self, n: int) -> int:
        """Band g holds sizes ``edge(g) <= n < edge(g + 1)``."""
        g = max(0, int(np.log(n) / np.log(BAND_RATIO)) - 1)
        while n >= self.edge(g + 1):
            g += 1
        return g

    @staticmethod
    def edge(g: int) -> int:
        return int(np.ceil(BAND_RATIO**g))

    def slices(self, g: int) -> tuple[int, int]:
        """Number of slices of band g, and on how many of them a linked pair agrees at least.

        The larger set of the pair is in band g.
        """
        most = self.edge(g + 1) - 1
        differ = 2 * most * (self.den - self.num) // (self.den + self.num)
        agree = differ // 6 + 2 if differ else 1
        return differ + agree, agree

    def bands_of(self, n: int) -> list[int]:
        """Bands in which a set of n shingles can meet a set at least as large."""
        own = self.band(n)
        most = n * self.den // self.num
        return list(range(own, self.band(max(n, most)) + 1))

    def tiles(self, hashes: np.ndarray) -> np.ndarray:
        """Keys of the tiles a set belongs to.

        Bands in which any difference breaks the link (equal sets are joined
        before) have none.  A set of n shingles and one of m that it links with disagree on ``differ`` slices at most, so of the
        slices in order of fullness and key one of the first ``differ + 1`` of either is common to both.  Empty slices are the last and make no tile.  Where a set has so few others that the
        common slice could be empty, so has the other: each of the two lacks at most ``n - ceil(n * num / den)``
        of its own shingles in the overlap, so the smallest hash of the overlap is among that many and one more of both.
        """
        n = len(hashes)
        found = []
        for g in self.bands_of(n):
            k, _ = self.slices(g)
            largest = min(self.edge(g + 1) - 1, n * self.den // self.num)
            differ = (n + largest) * (self.den - self.num) // (self.den + self.num)
            if not differ:
                continue
            part = ((hashes >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
            start = np.searchsorted(part, np.arange(k + 1, dtype=np.uint64))
            sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes + np.uint64(97)), dtype=np.uint64)])
            key = sums[start[1:]] - sums[start[:-1]]
            seed = mix(np.arange(k, dtype=np.uint64) + np.uint64(g << 40))
            held = np.diff(start)
            filled = np.flatnonzero(held)
            keys = mix(key + seed)[filled]
            found.append(keys[np.lexsort((keys, -held[filled]))[: differ + 1]])
            if len(filled) <= differ:
                smallest = hashes[: n + 1 + (-n * self.num) // self.den]
                found.append(mix(smallest ^ np.uint64(g << 40 | 1 << 32)))
        return np.concatenate(found) if found else np.empty(0, dtype=np.uint64)


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """Two bits or more per shingle (a power of two of 64-bit words); a bit tells whether
    an odd number of the shingles hash to it."""
    words = max(1, 1 << max(0, int(2 * len(hashes) - 1).bit_length() - 6))
    bits = hashes & np.uint64(words * 64 - 1)
    out = np.zeros(words, dtype=np.uint64)
    np.bitwise_xor.at(out, (bits >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bits & np.uint64(63)))
    return out


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """The bitmap as if it had been made with fewer words."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def overlap_bound(a: np.ndarray, na: int, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Upper bound of the overlap of one set with each of many: common shingles cancel out,
    so each bit that differs stands for at least one shingle of one side only."""
    differ = np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)
    return (na + nb - differ) // 2


def _longs(column: pa.Array) -> Iterator[np.ndarray]:
    for cell in column:
        yield np.frombuffer(cell.as_buffer(), dtype=np.uint64)


_SETS = "doc_id long, n_shingles long, f1 long, f2 long, tiles array<long>"
_ARRAYS = "doc_id long, n_shingles long, hashes binary, bits binary"


def _describe(rule: Rule):
    """doc_id, text -> set size, 128-bit name of the set, tile keys."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            n, names, tiles = [], [], []
            for text in batch.column("text").to_pylist():
                h = shingle_set(text, rule.size)
                n.append(len(h))
                names.append((np.bitwise_xor.reduce(mix(h)) if len(h) else 0, mix(h ^ np.uint64(n[-1])).sum(dtype=np.uint64)))
                tiles.append(rule.tiles(h) if len(h) else h)
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in tiles])]).astype(np.int32)
            flat = np.concatenate(tiles).view(np.int64) if tiles else np.empty(0, np.int64)
            name = np.array(names, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(n, pa.int64()),
                    pa.array(name[:, 0]),
                    pa.array(name[:, 1]),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                ],
                names=["doc_id", "n_shingles", "f1", "f2", "tiles"],
            )

    return run


def _arrays(rule: Rule):
    """doc_id, text -> set size, sorted hashes and bitmap as bytes."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 128):
            sets = [shingle_set(t, rule.size) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(h) for h in sets], pa.int64()),
                    pa.array([h.tobytes() for h in sets], pa.binary()),
                    pa.array([bitmap(h).tobytes() for h in sets], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "hashes", "bits"],
            )

    return run


def _verify(rule: Rule):
    """Rows sorted by (a, salt, leading first): a leader's set, then those to hold against it."""

    def matches(lead, lead_bits, h, bits) -> bool:
        words = min(len(bits), len(lead_bits))
        most = overlap_bound(fold(lead_bits, words), len(lead), fold(bits, words), len(h))
        if not rule.linked(most, len(lead), len(h)):
            return False
        small, large = (lead, h) if len(lead) < len(h) else (h, lead)
        at = np.searchsorted(large, small)
        at[at == len(large)] = 0
        return bool(rule.linked(int((large[at] == small).sum()), len(lead), len(h)))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, leads = None, []
        for batch in batches(rows):
            out_a, out_b = [], []
            columns = [batch.column(c) for c in ("a", "salt", "b")]
            sets, maps = _longs(batch.column("hashes")), _longs(batch.column("bits"))
            for a, salt, b, h, bits in zip(*(c.to_pylist() for c in columns), sets, maps, strict=True):
                if key != (a, salt):
                    key, leads = (a, salt), []
                if b is None:
                    leads.append((h.copy(), bits.copy()))
                elif any(matches(lead, lead_bits, h, bits) for lead, lead_bits in leads):
                    out_a.append(a)
                    out_b.append(b)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"]
            )

    return run


def _tile_pairs(rule: Rule):
    """Rows sorted by tile: pairs of other components that the bit counts do not rule out."""

    def pairs(side, labels, n, bits) -> tuple[np.ndarray, ...]:
        ids, side, labels, n = (np.array(x, dtype=np.int64) for x in (side[0], side[1], labels, n))
        words = min(len(x) for x in bits)
        maps = np.stack([fold(x, words) for x in bits])
        found_a, found_b = [], []
        for i in range(len(ids)):
            rest = slice(i + 1, None)
            ok = labels[rest] != labels[i]
            if side[i] >= 0:  # a tile of two blocks: one of each
                ok &= side[rest] != side[i]
            at = np.flatnonzero(ok) + i + 1
            at = at[rule.linked(np.minimum(n[at], n[i]), n[at], n[i])]
            if len(at):
                at = at[rule.linked(overlap_bound(maps[i], n[i], maps[at], n[at]), n[at], n[i])]
                found_a.append(np.full(len(at), ids[i]))
                found_b.append(ids[at])
        none = np.empty(0, np.int64)
        return np.concatenate([none, *found_a]), np.concatenate([none, *found_b])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, ([], [], [], [], [])

        def done() -> pa.RecordBatch:
            a, b = pairs(held[0:2], held[2], held[3], held[4])
            return pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"]
            )

        for batch in rows:
            names = ("tile", "i", "j", "doc_id", "side", "label", "n_shingles")
            lists = [batch.column(c).to_pylist() for c in names]
            for tile, i, j, doc, side, label, n, bits in zip(*lists, _longs(batch.column("bits")), strict=True):
                if key != (tile, i, j):
                    if len(held[0]) > 1:
                        yield done()
                    key, held = (tile, i, j), ([], [], [], [], [])
                for to, value in zip(held, (doc, side, label, n, bits.copy()), strict=True):
                    to.append(value)
        if len(held[0]) > 1:
            yield done()

    return run


def _verified(rule: Rule, edges: DataFrame, sets: DataFrame) -> DataFrame:
    """The edges (a, b) that hold exactly.

    The leader's set is stored once for every ``FOLLOWERS`` edges, so a
    leader that a third of all rows follow spreads over tasks.
    """
    ends = materialize(edges.select(F.col("a").alias("doc_id")).union(edges.select("b")).distinct(), "edge-ends")
    sets = semi_join(sets, ends, "doc_id").select("doc_id", "hashes", "bits")
    counts = materialize(
        edges.groupBy("a").agg(F.ceil(F.count("*") / FOLLOWERS).cast("int").alias("salts")), "leaders"
    )
    follow = (
        edges.join(counts, "a")
        .withColumn("salt", F.expr("int(pmod(xxhash64(b), salts))"))
        .join(sets.withColumnRenamed("doc_id", "b"), "b")
        .select("a", "salt", "b", "hashes", "bits")
    )
    lead = (
        counts.join(sets.withColumnRenamed("doc_id", "a"), "a")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        .select("a", "salt", F.lit(None).cast("long").alias("b"), "hashes", "bits")
    )
    rows = lead.unionByName(follow).repartition("a", "salt")
    sorted_rows = rows.sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return sorted_rows.mapInArrow(_verify(rule), "a long, b long")


def ngram_components(docs: DataFrame, size: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    ``docs`` needs doc_id and text; other columns are ignored, whatever their names.  Null and empty
    texts have no shingles and link with nothing.  Rows that repeat a doc_id
    stay in the result; they count as one node of the graph (so their texts are linked through the id).  A null
    doc_id links with nothing: its component_id is null.  An empty table gives no rows.
    """
    rule = Rule(size, num, den)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark = docs.sparkSession
    # The tiles are the largest table: dropped as soon as those that sets share are stored.
    path = scratch_path(spark, "ngram-sets")
    texts.mapInArrow(_describe(rule), _SETS).write.parquet(path)
    tiled = spark.read.schema(_SETS).parquet(path)
    described = materialize(tiled.drop("tiles"), "names")
    known = described.where("doc_id is not null and n_shingles > 0")

    # Equal sets count as one, named by their smallest id.
    classes = materialize(known.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    named = classes.select(F.col("rep").alias("doc_id"), "f1", "f2")
    named = F.broadcast(named) if classes.count() * 40 <= BROADCAST_BYTES else named
    tiled = tiled.where("doc_id is not null and size(tiles) > 0")
    reps = tiled.join(named, ["doc_id", "f1", "f2"], "left_semi").select("doc_id", "tiles")

    tiles = materialize(_shared_tiles(reps), "tiles")
    remove(spark, path)
    followers = tiles.where("doc_id <> lead").groupBy("doc_id").agg(F.min("lead").alias("a"))
    first = materialize(followers.select("a", F.col("doc_id").alias("b")), "first-edges")

    ids = materialize(tiles.select("doc_id").distinct(), "tile-members")
    arrays = semi_join(texts, ids, "doc_id").mapInArrow(_arrays(rule), _ARRAYS)
    sets = materialize(arrays, "hash-arrays")
    links = materialize(_verified(rule, first, sets), "links")
    # An id with several texts joins the classes of all of them.
    repeated = materialize(known.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    if not repeated.isEmpty():
        several = semi_join(known.select("doc_id", "f1", "f2", "n_shingles"), repeated, "doc_id").distinct()
        through = several.join(classes, ["f1", "f2", "n_shingles"]).select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
        links = links.unionByName(materialize(through, "links-through-ids"))
    labels = materialize(components(links), "labels")

    # Tiles whose members are not yet in one component are compared pairwise.
    labelled = materialize(
        tiles.join(labels, tiles.doc_id == labels.node, "left").select(
            "tile", "doc_id", "members", F.coalesce("root", "doc_id").alias("label")
        ),
        "labelled",
    )
    mixed = (
        labelled.groupBy("tile")
        .agg(F.min("label").alias("low"), F.max("label").alias("high"))
        .where("low < high")
        .select("tile")
    )
    mixed = materialize(mixed, "mixed")
    if not mixed.isEmpty():
        links = links.unionByName(_between_components(rule, labelled, mixed, sets))
        labels = components(links)

    named = described.select("doc_id", "n_shingles", "f1", "f2").join(
        classes, ["f1", "f2", "n_shingles"], "left"
    )
    return named.join(labels, named.rep == labels.node, "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "rep", "doc_id")).alias("component_id"),
    )


def _shared_tiles(reps: DataFrame) -> DataFrame:
    """Tiles of two sets or more: doc_id, tile, members, lead (the smallest doc_id).

    A tile with more than ``HOT_TILE`` rows never comes together in one task: it is summed where its rows
    lie.  Only such with less than 0.02 % of all rows may be missed.
    """
    member = reps.select("doc_id", F.explode("tiles").alias("tile"))
    by_tile = F.expr("count(*) over (partition by tile)"), F.expr("min(doc_id) over (partition by tile)")

    def counted(rows: DataFrame) -> DataFrame:
        rows = rows.select("doc_id", "tile", by_tile[0].alias("members"), by_tile[1].alias("lead"))
        return rows.where("members > 1")

    hot = hot_entities(member, "tile", HOT_TILE)
    if not hot:
        return counted(member)
    large = F.col("tile").isin(hot)
    # One row of each, of 1,000 tiles at most.
    sums = member.where(large).groupBy("tile").agg(F.count("*").alias("members"), F.min("doc_id").alias("lead"))
    return counted(member.where(~large)).unionByName(member.where(large).join(F.broadcast(sums), "tile"))


def _between_components(rule: Rule, labelled: DataFrame, mixed: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between members of a tile that are in different components so far."""
    rest = labelled.join(mixed, "tile", "left_semi")
    block = (
        rest.withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
        .withColumn("own", F.expr("int(pmod(xxhash64(doc_id), blocks))"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "tile",
            F.least("own", "other").alias("i"),
            F.greatest("own", "other").alias("j"),
            "doc_id",
            F.when(F.col("blocks") == 1, -1).when(F.col("own") == F.col("other"), -1).otherwise(F.col("own")).alias("side"),
            "label",
        )
    )
    maps = sets.select("doc_id", "n_shingles", "bits")
    paired = (
        block.join(maps, "doc_id")
        .select("tile", "i", "j", "doc_id", "side", "label", "n_shingles", "bits")
        .repartition("tile", "i", "j")
        .sortWithinPartitions("tile", "i", "j")
        .mapInArrow(_tile_pairs(rule), "a long, b long")
    )
    return materialize(_verified(rule, materialize(paired.distinct(), "more-edges"), sets), "more-links")


def without_near_copies(docs: DataFrame, size: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One row of each component, the smallest doc_id; texts without words all stay.

    Of rows that repeat a doc_id one stays, the smallest by its columns in their
    order.  Rows with a null doc_id stay.
    """
    kept = ngram_components(docs, size, num, den).where("doc_id = component_id").select("doc_id").distinct()
    stay = semi_join(docs, materialize(kept, "kept"), "doc_id")
    nameless = docs.where("doc_id is null")
    repeated = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    repeated = materialize(repeated.select("doc_id"), "repeated-ids")
    if repeated.isEmpty():
        return stay.unionByName(nameless)
    columns = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = stay.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(columns).alias("row"))
    one = one.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
    return stay.join(repeated, "doc_id", "left_anti").unionByName(one).unionByName(nameless)
