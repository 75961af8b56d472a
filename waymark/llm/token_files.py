"""Token-id files: frequency-ranked ids in byte-aligned variable-length codes.

Every id is replaced by its rank among the ids of the corpus, most frequent first, so common
ids are small.  A rank takes one to four bytes; how many is kept apart, two bits for each rank,
four ranks to a control byte.  A decoder looks a control byte up in a table of
256 rows and gathers the data bytes of all ranks of a block at once.

A file is a sequence of records, each followed by a line feed:

    magic       4 bytes  ``WTF2``
    documents   u32      number of documents of the record
    nulls       u32      how many of them, the first ones, have no doc_id
    ids         u32      number of ids
    data        u32      number of data bytes
    doc_id      i64 x documents
    n_tokens    u32 x documents
    control     u8  x ceil(ids / 4)
    data bytes, then crc32 (u32) of the record so far

Numbers are little-endian.  Documents follow each other in ascending doc_id order within a file and
from one file to the next, in the order of the numbers (task, file) in their names.  The folder ``ranks`` beside the files holds the ids in
rank order, ``starts`` the number of ids in front of each file.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.binary_files import read_files, write_records
from waymark.llm.common import batches, cut_strings, joined_lists, number_lists, text_batches
from waymark.session import scratch_path

MAGIC = b"WTF2"
HEAD, HEAD_SIZE = "<4sIIII", 20
#: Ids after which a record ends (a document is never cut).
RECORD_IDS = 1 << 16
#: Ids that one task writes, about.
FILE_IDS = 6 << 20
#: Records of a file: who reads one holds it whole, so files stay near 2 MB.
FILE_RECORDS = 16
#: Encoded words a worker remembers.  A full memory keeps its older half: common words come early.
REMEMBERED = 150_000
#: Characters of a word that is remembered, so that the memory has a bound in bytes: longer ones hardly come again.
REMEMBERED_CHARS = 40
#: Bytes of a row group of the stored ids.
ROW_GROUP = 16 << 20
#: Words that the tokenizer gets as one text.
TOGETHER = 200
#: Texts that the tokenizer gets in one call.
AT_ONCE = 64

# By control byte: length of each of its four ranks, and of all four.
_CONTROL = np.arange(256, dtype=np.uint8)
LENGTHS = np.stack([(_CONTROL >> (2 * i) & 3) + 1 for i in range(4)], axis=1)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of ranks below 2 ** 32."""
    ranks = ranks.astype("<u4")
    length = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    codes[: len(ranks)] = length - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
    kept = np.arange(4) < length[:, None]
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[kept].tobytes()


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ranks of control and data bytes."""
    length = LENGTHS[control].reshape(-1)[:n]
    out = np.zeros((n, 4), dtype=np.uint8)
    out[np.arange(4) < length[:, None]] = data
    return out.view("<u4").reshape(-1)


# The steps before the model that are known to make letters, single digits and signs words of their own.
_STEPS = [
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
]
#: A letter that those steps do more with than lower it: an apostrophe, or outside printable ASCII and Latin-1's letters.
_ODD = "[^!-&(-~À-ÖØ-öø-ÿ]"
#: Matches a run of lowered letters that are not odd.
_LETTERS = re.compile("[a-zß-öø-ÿ]+").fullmatch


def _between_classes() -> np.ndarray:
    """By pairs of bytes of lowered words without odd letters: whether the first ends a word of the model."""
    kind = np.full(256, 2)
    kind[[*range(97, 123), *range(0x80, 256)]] = 0
    kind[48:58] = 1
    table = (kind[:, None] != kind) | (kind == 1)
    table[:, 0x80:0xC0] = False
    return table


class Encoder:
    """Ids of whole texts by the tokenizers library, with an end id behind each text.

    A tokenizer that drops white space and never joins letters over it gives a text the ids of
    its words in turn, so words are encoded once and remembered.  With the steps of ``_STEPS`` words are also lowered
    and cut where letters, digits and signs meet.  Others (``by_word=False``) get whole texts.
    """

    def __init__(self, path: str, end_id: int, by_word: bool) -> None:
        # Spark runs as many tasks as there are cores; threads of the library's own only get in their way.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.width = "<u2" if max(end_id, *vocabulary.values()) < 1 << 16 else "<u4"
        self.end = np.array([end_id], dtype=self.width).tobytes()
        self.by_word = by_word
        steps = [self.tokenizer.normalizer, self.tokenizer.pre_tokenizer]
        self.cut = _between_classes() if [x and json.loads(x.__getstate__()) for x in steps] == _STEPS else None
        self.bare = self.tokenizer
        if self.cut is not None:
            # Lowered letters pass the first steps as they are: the model alone gives the same ids.
            self.bare = Tokenizer(self.tokenizer.model)
            self.bare.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}

    def _ids(self, texts: list[str], plain: bool = False) -> list[bytes]:
        tokenizer, out = self.bare if plain else self.tokenizer, []
        # The library's encodings take some hundred bytes a piece: few texts at a time.
        for i in range(0, len(texts), AT_ONCE):
            found = tokenizer.encode_batch_fast(texts[i : i + AT_ONCE], add_special_tokens=False)
            out += [np.array(e.ids, dtype=self.width).tobytes() for e in found]
        return out

    def _learn(self, words: list[str]) -> None:
        """Encode new words: those of letters only in texts of many, cut where a piece ends a word."""
        of_letters = str.isalpha if self.cut is None else _LETTERS
        alone = [w for w in words if not of_letters(w)]
        plain = [w for w in words if of_letters(w)]
        groups = [plain[i : i + TOGETHER] for i in range(0, len(plain), TOGETHER)]
        for group, ids in zip(groups, self._ids([" ".join(g) for g in groups], plain=True), strict=True):
            cuts = len(self.end) * (np.flatnonzero(self.ends_word[np.frombuffer(ids, self.width)]) + 1)
            if len(cuts) != len(group) or len(ids) != (cuts[-1] if len(cuts) else 0):
                alone += group
                continue
            ends = cuts.tolist()
            self.known.update(zip(group, (ids[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=True))
        self.known.update(zip(alone, self._ids(alone), strict=True))

    def _found(self, words: list[str]) -> list[bytes]:
        """Ids of some distinct words, remembered or new."""
        if len(self.known) > REMEMBERED:
            self.known = dict(islice(self.known.items(), REMEMBERED // 2))
        new = [w for w in words if w not in self.known]
        if new:
            self._learn(new)
        found = [self.known[w] for w in words]
        for word in new:
            if len(word) > REMEMBERED_CHARS:
                del self.known[word]
        return found

    def _runs(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Runs whose ids in turn are those of each word, and where the words' runs begin."""
        if self.cut is None:
            return words, np.arange(len(words) + 1)
        odd = pc.match_substring_regex(words, _ODD)
        for token in self.added:
            odd = pc.or_(odd, pc.match_substring(words, token, ignore_case=True))
        runs, bounds = cut_strings(pc.if_else(odd, "", pc.utf8_lower(words)), self.cut)
        # An odd word is a run as it stands.
        places = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        at = np.insert(np.arange(len(runs)), bounds[places], len(runs) + np.arange(len(places)))
        runs = pa.concat_arrays([runs, words.take(pa.array(places))]).take(pa.array(at))
        return runs, bounds + np.searchsorted(places, np.arange(len(bounds)))

    def encode_column(self, texts: pa.Array) -> pa.ListArray:
        """Ids of each text as a list, end id included; null counts as empty.  The distinct runs of the column are encoded once."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not self.by_word:
            return number_lists([ids + self.end for ids in self._ids(texts.to_pylist())], self.width)
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        places, ends = words.values.dictionary_encode(), words.offsets.to_numpy()
        runs, bounds = self._runs(places.dictionary)
        runs = runs.dictionary_encode()
        found = number_lists([*self._found(runs.dictionary.to_numpy(zero_copy_only=False).tolist()), self.end], self.width)
        # One more word behind each text: the end id.
        by_word = joined_lists(found, np.append(runs.indices.to_numpy(), len(found) - 1), np.append(bounds, len(runs) + 1))
        at = np.insert(places.indices.to_numpy(), ends[1:], len(by_word) - 1)
        return joined_lists(by_word, at, ends + np.arange(len(ends)))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers, end id included."""
        lists = self.encode_column(pa.array(texts, pa.string()))
        ends, ids = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4")
        return [ids[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]


_encoders: dict[tuple, Encoder] = {}


def encoder(*key) -> Encoder:
    """The worker's encoder for these arguments: tasks of one worker share its memory."""
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def _encode(key: tuple) -> Callable:
    """doc_id, text -> doc_id, n, ids (16-bit numbers where the vocabulary allows, else 32-bit)."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(rows, "text"):
            lists = encoder(*key).encode_column(batch.column("text"))
            ids, ends = lists.values.to_numpy(), lists.offsets
            places = pa.array((ends.to_numpy() * ids.itemsize).astype(np.int32))
            cells = pa.Array.from_buffers(pa.binary(), len(lists), [None, places.buffers()[1], pa.py_buffer(ids)])
            n = lists.value_lengths().cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, cells], names=["doc_id", "n", "ids"])

    return run


def _count_ids(width: str) -> Callable:
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, dtype=np.int64)
        for batch in batches(rows, 256):
            ids = np.frombuffer(b"".join(batch.column("ids").to_pylist()), dtype=width)
            found = np.bincount(ids, minlength=len(counts))
            found[: len(counts)] += counts
            counts = found
        place = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(counts[place])], names=["id", "n"])

    return run


def _records(width: str, ranked: np.ndarray) -> Callable:
    """Sorted (doc_id, ids) -> records of the file format."""
    rank = np.zeros(int(ranked.max()) + 1 if len(ranked) else 0, dtype=np.uint32)
    rank[ranked] = np.arange(len(ranked), dtype=np.uint32)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, sizes, held, size = [], [], [], 0

        def record() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), dtype=width)
            control, data = pack(rank[ids])
            nulls = docs.count(None)
            body = struct.pack(HEAD, MAGIC, len(docs), nulls, len(ids), len(data))
            body += np.array([0] * nulls + docs[nulls:], "<i8").tobytes() + np.array(sizes, "<u4").tobytes() + control + data
            body += struct.pack("<I", zlib.crc32(body))
            return pa.RecordBatch.from_arrays([pa.array([body], pa.binary())], names=["record"])

        for batch in batches(rows, 64):
            for doc, n, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "ids")), strict=True):
                docs.append(doc)
                sizes.append(n)
                held.append(ids)
                size += n
                if size >= RECORD_IDS:
                    yield record()
                    docs, sizes, held, size = [], [], [], 0
        if docs:
            yield record()

    return run


def records(content: bytes) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """(nulls, number of ids, bytes of doc_id, n_tokens, control and data) of each record of a file; a damaged one raises."""
    at, view = 0, memoryview(content)
    while at < len(view):
        magic, docs, nulls, ids, data = struct.unpack_from(HEAD, view, at)
        ends = np.cumsum([HEAD_SIZE, 8 * docs, 4 * docs, -(-ids // 4), data])
        size = int(ends[-1])
        if magic != MAGIC or struct.unpack_from("<I", view, at + size)[0] != zlib.crc32(view[at : at + size]):
            raise ValueError(f"no whole record at byte {at}")
        parts = [np.frombuffer(view[at + a : at + b], dtype=np.uint8) for a, b in zip(ends, ends[1:], strict=False)]
        yield nulls, ids, parts
        at += size + 5


def parse(content: bytes) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
    """(doc_id, nulls, n_tokens, ranks) of each record of a file; a damaged one raises."""
    for nulls, ids, (docs, sizes, control, data) in records(content):
        yield docs.view("<i8"), nulls, sizes.view("<u4"), unpack(control, data, ids)


def write_token_files(
    docs: DataFrame, tokenizer: str, path: str, end_id: int = 1, by_word: bool = False, files: int | None = None
) -> None:
    """Encode ``text`` of every row and write the files, in ascending doc_id order, under ``path``.

    ``tokenizer`` is the path of a file of the tokenizers library, readable on
    every executor.  Null texts count as empty: they have the end id alone.  Rows with a null doc_id come first and keep
    it; rows that repeat a doc_id all stay, in order of their ids.  Other columns are ignored.  Texts are
    encoded once: their ids are stored, counted, then dealt out by ranges of doc_id.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    key = (tokenizer, end_id, by_word)
    width = encoder(*key).width
    schema, encoded = "doc_id long, n long, ids binary", scratch_path(docs.sparkSession, "encoded")
    # Small row groups: a task's writer holds one of them in memory.
    docs.mapInArrow(_encode(key), schema).write.option("parquet.block.size", str(ROW_GROUP)).parquet(encoded)
    stored = docs.sparkSession.read.schema(schema).parquet(encoded)
    counts = stored.select("ids").mapInArrow(_count_ids(width), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    # One row for each id of the vocabulary at most.
    found = counts.toArrow()
    ids, n = found.column("id").to_numpy(), found.column("n").to_numpy()
    ranked = ids[np.lexsort((ids, -n))]

    n_files = files or max(1, -(-int(n.sum()) // FILE_IDS))
    ordered = stored.repartitionByRange(n_files, "doc_id").sortWithinPartitions("doc_id", "ids")
    write_records(ordered.mapInArrow(_records(width, ranked), "record binary"), "record", f"{path}/files", at_most=FILE_RECORDS)

    spark = docs.sparkSession
    table = spark.createDataFrame([(ranked.astype("<u4").tobytes(),)], "record binary")
    write_records(table.coalesce(1), "record", f"{path}/ranks")
    # The numbers of task and file in the names sort as the contents; one row for each file.
    sizes = read_files(spark, f"{path}/files").mapInArrow(_file_sizes, "path string, n long")
    task, file = (f"int(regexp_extract(name, '{p}', 1))" for p in ("^part-([0-9]+)", "-c([0-9]+)"))
    by_name = f"over (order by {task}, {file}, name rows between unbounded preceding and 1 preceding)"
    starts = sizes.selectExpr("substring_index(path, '/', -1) as name", "n")
    starts.selectExpr("name", f"coalesce(sum(n) {by_name}, 0) as start").write.parquet(f"{path}/starts")


def _file_sizes(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        n = [sum(ids for _, ids, _ in records(c.as_py())) for c in batch.column("content")]
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(n, pa.int64())], names=["path", "n"])


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, place (number of ids before the document), ids (binary, little-endian 32-bit) of every document."""
    # The list of ids is as long as the vocabulary.
    ranked = np.frombuffer(read_files(spark, f"{path}/ranks").first()["content"][:-1], dtype="<u4")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for content, start in zip(batch.column("content"), batch.column("start").to_pylist(), strict=True):
                for docs, nulls, sizes, ranks in parse(content.as_py()):
                    ends = np.cumsum(sizes, dtype=np.int64)
                    starts = ends - sizes + start
                    start += int(ends[-1])
                    ids = ranked[ranks].tobytes()
                    cells = [ids[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(docs.astype(np.int64), mask=np.arange(len(docs)) < nulls), pa.array(starts.astype(np.int64)), pa.array(cells, pa.binary())],
                        names=["doc_id", "start", "ids"],
                    )

    files = read_files(spark, f"{path}/files").withColumn("name", F.substring_index("path", "/", -1))
    placed = files.join(spark.read.parquet(f"{path}/starts"), "name")
    return placed.select("content", "start").mapInArrow(run, "doc_id long, start long, ids binary")
