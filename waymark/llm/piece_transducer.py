"""SentencePiece encoding and decoding by a weighted finite-state transducer.

A model file is compiled once into a transducer: the normaliser rewrites the input's
characters, the pieces form a trie whose final states emit an id at the cost of minus its score, and
every character also has a byte fallback path that emits its UTF-8 bytes.  A text is encoded by composing
the transducer with it and taking the path of least total cost (tropical semiring).  Decoding is the
inverse: ids back to bytes.

No piece reaches from a character over a following word boundary, so the shortest path of a text is that of its
chunks in turn, and a chunk is cut further wherever no piece has the two characters side by side.  The distinct runs of a few
megabytes of texts are composed together, all start positions at once, and a worker remembers their paths.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import cut_strings, free_name, joined_lists, number_lists, text_batches

#: Extra cost of leaving the pieces, above the dearest of them, as SentencePiece sets it.
FALLBACK_PENALTY = 10.0
#: Paths a worker remembers.  A full memory keeps its older half: common runs come early.
REMEMBERED = 250_000
#: Characters of a run that is remembered, so that the memory has a bound in bytes: longer ones hardly come again.
REMEMBERED_CHARS = 40
#: Characters composed at once.
COMPOSED = 1 << 15
BOUNDARY = "▁"
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_CHUNKS = re.compile(f"{BOUNDARY}*[^{BOUNDARY}]*")


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, message[at : at + size]
            at += size


class Transducer:
    """States and arcs of a model; see the module's text."""

    def __init__(self, model: bytes) -> None:
        pieces, normaliser = [], {}
        for number, value in fields(model):
            if number == 1:
                piece = dict(fields(value))
                score = np.frombuffer(piece.get(2, bytes(4)), "<f4")[0]
                pieces.append((piece[1].decode(), float(score), piece.get(3, 1)))
            elif number == 3:
                normaliser = dict(fields(value))
        if normaliser.get(2):
            raise ValueError("only models with the identity normaliser can be compiled")
        self.dummy_prefix, self.squeeze = bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1))
        self.escape = bool(normaliser.get(5, 1))

        # Kinds of pieces: 1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte.
        normal = [(p, s, i) for i, (p, s, kind) in enumerate(pieces) if kind in (1, 4) and p]
        if any(BOUNDARY in p.lstrip(BOUNDARY) for p, _, _ in normal):
            raise ValueError("a piece reaches over a word boundary")
        self.unknown = next((i for i, (_, _, kind) in enumerate(pieces) if kind == 2), 0)
        self.bytes_of = [p.replace(BOUNDARY, " ").encode() for p, _, _ in pieces]
        self.byte_ids = np.full(256, -1)
        for i, (p, _, kind) in enumerate(pieces):
            if kind == 6:
                self.byte_ids[int(p[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(p[3:5], 16)])
            elif kind in (2, 3, 5):
                self.bytes_of[i] = b""
        self.has_bytes = bool((self.byte_ids >= 0).all())
        if not self.has_bytes:
            self.bytes_of[self.unknown] = " ⁇ ".encode()
        self.spelt = pa.array(self.bytes_of, pa.binary())
        scores = [s for _, s, _ in normal]
        self.fallback_cost = FALLBACK_PENALTY - min(scores, default=0.0)

        # The trie: arcs (state, character) -> state, looked up by binary search.
        arcs: dict[int, int] = {}
        final_id, final_cost = [-1], [np.inf]
        for piece, score, i in normal:
            state = 0
            for c in piece:
                key = state << 21 | ord(c)
                if key not in arcs:
                    arcs[key] = len(final_id)
                    final_id.append(-1)
                    final_cost.append(np.inf)
                state = arcs[key]
            final_id[state], final_cost[state] = i, -score
        self._arc_table(np.array(sorted(arcs), dtype=np.int64), np.array([arcs[k] for k in sorted(arcs)], dtype=np.int64))
        self.final_id, self.final_cost = np.array(final_id), np.array(final_cost)
        # Pairs of bytes, the second of them the first of a character, that no piece has side by side: no arc goes over such
        # a place, so the path of a chunk is that of its runs in turn.  Unknown characters in a row must stay together.
        self.apart = np.full((256, 256), self.has_bytes)
        self.apart[:, 0x80:0xC0] = False
        for piece, _, _ in normal:
            spelt = np.frombuffer(piece.encode(), np.uint8)
            self.apart[spelt[:-1], spelt[1:]] = False
        self.known: dict[str, bytes] = {}

    def _arc_table(self, keys: np.ndarray, targets: np.ndarray) -> None:
        """The arcs as a hash table with open addressing, at most a quarter full."""
        bits = max(4, int(len(keys)).bit_length() + 2)
        self.shift = np.uint64(64 - bits)
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.targets = np.zeros(1 << bits, dtype=np.int64)
        place = self._place(keys)
        while len(keys):
            # Of the keys that want one free place, one gets it; the others try the next.
            free = self.keys[place] < 0
            chosen = np.zeros(len(keys), dtype=bool)
            chosen[np.unique(np.where(free, place, -1), return_index=True)[1]] = True
            chosen &= free
            self.keys[place[chosen]], self.targets[place[chosen]] = keys[chosen], targets[chosen]
            keys, targets, place = keys[~chosen], targets[~chosen], (place[~chosen] + 1) & (len(self.keys) - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _SPREAD) >> self.shift).astype(np.int64)

    def _follow(self, keys: np.ndarray) -> np.ndarray:
        """The state each arc leads to, -1 where there is none."""
        place = self._place(keys)
        held = self.keys[place]
        out = np.where(held == keys, self.targets[place], -1)
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        place = place[open_]
        while len(open_):
            place = (place + 1) & (len(self.keys) - 1)
            held = self.keys[place]
            found = held == keys[open_]
            out[open_[found]] = self.targets[place[found]]
            go_on = ~found & (held >= 0)
            open_, place = open_[go_on], place[go_on]
        return out

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if self.dummy_prefix and text:
            text = " " + text
        return text.replace(" ", BOUNDARY) if self.escape else text

    def chunks(self, text: str) -> list[str]:
        """Parts of the normalised text between which no piece reaches."""
        if self.dummy_prefix and self.escape and not self.squeeze and text and BOUNDARY not in text and "  " not in text:
            if text[0] != " " and text[-1] != " ":
                return (BOUNDARY + text.replace(" ", f" {BOUNDARY}")).split(" ")
        return _CHUNKS.findall(self.normalise(text))[:-1]

    def shortest_paths(self, chunks: list[str]) -> list[bytes]:
        """Ids (little-endian 32-bit) of the cheapest path of each chunk."""
        if not chunks:
            return []
        chunks = list(chunks)
        letters = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        sizes = np.array([len(c) for c in chunks])
        ends = np.cumsum(sizes)
        stop = np.repeat(ends, sizes)

        # Composition: from every position follow the trie as far as the chunk allows.
        start, end, label, cost = [], [], [], []
        at, state = np.arange(len(letters)), np.zeros(len(letters), dtype=np.int64)
        length = 0
        while len(at):
            state = self._follow(state << 21 | letters[at + length])
            ok = state >= 0
            at, state = at[ok], state[ok]
            length += 1
            accepted = self.final_id[state] >= 0
            start.append(at[accepted])
            end.append(at[accepted] + length)
            label.append(self.final_id[state[accepted]])
            cost.append(self.final_cost[state[accepted]])
            go_on = at + length < stop[at]
            at, state = at[go_on], state[go_on]
        # The fallback of one character, where no piece is that character.
        one = np.zeros(len(letters), dtype=bool)
        if start:
            one[start[0]] = True
        missing = np.flatnonzero(~one)
        start.insert(0, missing)
        end.insert(0, missing + 1)
        label.insert(0, np.full(len(missing), -1))
        cost.insert(0, np.full(len(missing), self.fallback_cost))
        # Longest arcs first: a stable sort then puts the earliest start first among arcs with one end.
        start, end, label, cost = (np.concatenate(x[::-1]) for x in (start, end, label, cost))

        # Tropical shortest path: positions of all chunks in step, from their starts.
        first = np.repeat(ends - sizes, sizes)
        depth = end - first[start]
        order = np.argsort(depth * (len(letters) + 1) + end, kind="stable")
        start, end, label, cost, depth = (x[order] for x in (start, end, label, cost, depth))
        best = np.full(len(letters) + 1, np.inf)
        arc_in = np.full(len(letters) + 1, -1)
        before = np.full(len(letters) + 1, -1)
        first_place = np.zeros(len(letters) + 1, dtype=bool)
        first_place[ends - sizes] = True
        bounds = np.searchsorted(depth, np.arange(1, (sizes.max() if len(sizes) else 0) + 2))
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            if lo == hi:
                continue
            s = start[lo:hi]
            total = np.where(first_place[s], 0.0, best[s]) + cost[lo:hi]
            head = np.flatnonzero(np.diff(end[lo:hi], prepend=-1))
            least = np.minimum.reduceat(total, head)
            group = np.repeat(np.arange(len(head)), np.diff(head, append=hi - lo))
            winner = np.flatnonzero(total == least[group])
            winner = winner[np.unique(group[winner], return_index=True)[1]]
            best[end[lo:hi][head]] = least
            arc_in[end[lo:hi][head]] = label[lo:hi][winner]
            before[end[lo:hi][head]] = s[winner]

        # Walk back from every end at once, then emit.
        path_end, path_label, path_start = [], [], []
        now, floor = ends[sizes > 0], (ends - sizes)[sizes > 0]
        while len(now):
            path_end.append(now)
            path_label.append(arc_in[now])
            path_start.append(before[now])
            now = before[now]
            left = now > floor
            now, floor = now[left], floor[left]
        if not path_end:
            return [b""] * len(chunks)
        path_end, path_label, path_start = (np.concatenate(x) for x in (path_end, path_label, path_start))
        order = np.argsort(path_end)
        path_end, path_label, path_start = path_end[order], path_label[order], path_start[order]
        ids = path_label.astype("<u4")
        cuts = np.searchsorted(path_end, np.concatenate([[0], ends]), side="right")
        plain = path_label >= 0
        spelt = np.concatenate([[0], np.cumsum(~plain)])
        spelt = np.flatnonzero(spelt[cuts[1:]] > spelt[cuts[:-1]]).tolist()
        text, bounds = ids.tobytes(), (4 * cuts).tolist()
        out = [text[lo:hi] for lo, hi in zip(bounds, bounds[1:], strict=False)]
        for i in spelt:
            chunk, base, parts = chunks[i], int(ends[i] - sizes[i]), []
            lo, hi = bounds[i] // 4, bounds[i + 1] // 4
            for j in range(lo, hi):
                if plain[j]:
                    parts.append(text[4 * j : 4 * j + 4])
                else:
                    parts.append(self._fallback(chunk[path_start[j] - base]))
            out[i] = b"".join(parts) if self.has_bytes else self._merged(parts)
        return out

    def _fallback(self, letter: str) -> bytes:
        if not self.has_bytes:
            return np.array([self.unknown], "<u4").tobytes()
        return self.byte_ids[list(letter.encode("utf-8", "surrogatepass"))].astype("<u4").tobytes()

    def _merged(self, parts: list[bytes]) -> bytes:
        """Unknown characters in a row are one unknown piece."""
        unknown = np.array([self.unknown], "<u4").tobytes()
        return b"".join(p for i, p in enumerate(parts) if p != unknown or not i or parts[i - 1] != unknown)

    def _paths(self, runs: list[str]) -> list[bytes]:
        """Ids of the cheapest path of each of some distinct runs, remembered or new."""
        if len(self.known) > REMEMBERED:
            self.known = dict(islice(self.known.items(), REMEMBERED // 2))
        known = self.known
        held, size, passing = [], 0, []
        for run in [r for r in runs if r not in known]:
            held.append(run)
            size += len(run)
            if len(run) > REMEMBERED_CHARS:
                passing.append(run)
            if size > COMPOSED:
                known.update(zip(held, self.shortest_paths(held), strict=True))
                held, size = [], 0
        known.update(zip(held, self.shortest_paths(held), strict=True))
        paths = [known[r] for r in runs]
        for run in passing:
            del known[run]
        return paths

    def _placed(self, chunks: pa.Array, places: pa.Array, ends: np.ndarray) -> pa.ListArray:
        """Ids of texts of which each is the chunks at its places."""
        runs, bounds = cut_strings(chunks, self.apart)
        runs = runs.dictionary_encode()
        paths = number_lists(self._paths(runs.dictionary.to_numpy(zero_copy_only=False).tolist()), "<i4")
        return joined_lists(joined_lists(paths, runs.indices, bounds), places, ends)

    def _plain(self, texts: pa.Array) -> np.ndarray:
        """Which texts are not empty and have single spaces only, inside: their chunks are their words, each behind a boundary."""
        if not self.dummy_prefix or not self.escape or self.squeeze:
            return np.zeros(len(texts), dtype=bool)
        odd = pc.equal(texts, "")
        for found in (pc.starts_with(texts, " "), pc.ends_with(texts, " "), pc.match_substring(texts, "  "), pc.match_substring(texts, BOUNDARY)):
            odd = pc.or_(odd, found)
        return ~odd.to_numpy(zero_copy_only=False)

    def _encode_plain(self, texts: pa.Array) -> pa.ListArray:
        words = pc.split_pattern(texts, " ")
        places = words.values.dictionary_encode()
        chunks = pc.binary_join_element_wise(BOUNDARY, places.dictionary, "")
        return self._placed(chunks, places.indices, words.offsets.to_numpy())

    def _encode_other(self, texts: list[str]) -> pa.ListArray:
        split = [self.chunks(t) for t in texts]
        places = pa.array([c for chunks in split for c in chunks], pa.string()).dictionary_encode()
        ends = np.concatenate([[0], np.cumsum([len(chunks) for chunks in split])]).astype(np.int64)
        return self._placed(places.dictionary, places.indices, ends)

    def encode_column(self, texts: pa.Array) -> pa.ListArray:
        """Ids of whole texts as lists of 32-bit integers; null counts as empty.

        The distinct runs of the column are looked up or composed once, then put in their places.
        """
        texts = pc.fill_null(texts.cast(pa.string()), "")
        plain = self._plain(texts)
        if plain.all():
            return self._encode_plain(texts)
        both = pa.concat_arrays([self._encode_plain(texts.filter(pa.array(plain))), self._encode_other(texts.filter(pa.array(~plain)).to_pylist())])
        return both.take(pa.array(np.argsort(np.argsort(~plain, kind="stable"), kind="stable")))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts, little-endian 32-bit; null counts as empty."""
        lists = self.encode_column(pa.array(texts, pa.string()))
        ends, ids = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4")
        return [ids[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]

    def decode_column(self, lists: pa.ListArray) -> pa.Array:
        """The text of each list of ids; bytes that are no UTF-8 become the replacement character."""
        pieces = self.spelt.take(lists.values)
        _, offsets, data = pieces.buffers()
        offsets = np.frombuffer(offsets, np.int32, len(pieces) + 1)[lists.offsets.to_numpy()]
        if self.dummy_prefix and len(pieces):
            letters = np.frombuffer(data, np.uint8)
            first = offsets[:-1][offsets[:-1] < offsets[1:]]
            first = first[letters[first] == 32]
            data = pa.py_buffer(np.delete(letters, first))
            offsets = (offsets - np.searchsorted(first, offsets)).astype(np.int32)
        texts = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(offsets), data])
        try:
            return texts.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.string())

    def decode(self, ids: bytes) -> str:
        """The text of some ids; bytes that are no UTF-8 become the replacement character."""
        table = self.bytes_of
        text = b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


_compiled: dict[bytes, Transducer] = {}


def compiled(model: bytes) -> Transducer:
    """The worker's transducer of a model: tasks of one worker share it."""
    if model not in _compiled:
        _compiled[model] = Transducer(model)
    return _compiled[model]


def encode_documents(docs: DataFrame, model_path: str, name: str = "ids", decoded: str | None = None) -> DataFrame:
    """The documents with a column of piece ids, and on request the text decoded from them.

    ``model_path`` names a SentencePiece model with the identity normaliser, read once by the driver.
    Whole texts are encoded; null and empty texts have no ids.  Other columns pass through, every
    row stays.  Where the table already has a column of a new name, the new one gets a number behind its name.
    """
    with open(model_path, "rb") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())

    kind = "struct<ids: array<int>, decoded: string>" if decoded else "struct<ids: array<int>>"

    # Ids and texts come from one function: of two that are chained, Spark would run the first twice.
    @F.arrow_udf(kind)
    def encode(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        rows = (pa.RecordBatch.from_arrays([texts], names=["text"]) for texts in columns)
        for batch in text_batches(rows, "text"):
            transducer = compiled(model.value)
            ids = transducer.encode_column(batch.column(0))
            parts = [ids, transducer.decode_column(ids)] if decoded else [ids]
            yield pa.StructArray.from_arrays(parts, names=["ids", "decoded"][: len(parts)])

    name = free_name(docs.columns, name)
    names = [name, *([free_name([*docs.columns, name], decoded)] if decoded else [])]
    made = free_name([*docs.columns, *names], "encoded")
    encoded = docs.withColumn(made, encode("text"))
    parts = {c: F.col(f"`{made}`.{part}") for c, part in zip(names, ("ids", "decoded"), strict=False)}
    return encoded.withColumns(parts).drop(made)
