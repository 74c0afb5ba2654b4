"""LM scoring by logistic context mixing over the bits of a text's bytes.

Five predictors look at hashed contexts (the last 1, 2, 3 and 4 bytes of the current piece with what stands
before it, and the piece so far) and each gives a probability for the next bit of the current byte from the
counts of its context. Their logits are summed with weights that are gated by the bit's place and by how
often each context was seen, and the result is refined by an adaptive probability map. A text's bits, and an
end mark, give its log10 probability and its bits per byte; next to it stands a word unigram score.

A piece is a run of word bytes with the one white space, or end mark, that follows it; words are cut after
``PIECE`` bytes. What stands before a piece counts as one of seven kinds (start of text, new line, end of a
sentence ...). So contexts depend on the bytes before alone, and on few enough of them that each distinct
piece of the corpus is worked through once, however often it occurs:

1. blocks of some ``BLOCK_BYTES`` of text name their distinct pieces and how often training texts
   (crc32 of doc_id mod 7 is not 2) have them, and keep their texts as numbers of these pieces;
2. shards of the vocabulary add the pieces and words of all blocks up, byte by byte;
3. each shard names its distinct slots (a context and the byte after it) with their training counts; shards
   of the context table, which grows with the contexts of the corpus, add them up and send back the exact
   sums on those slots' paths;
4. weights and map are learned over all training text: each shard makes one online pass over its pieces,
   weighted by their occurrences, every bit being predicted from counts without its own byte, and shards are
   averaged, each weight and cell by the bits that it saw;
5. each shard scores its pieces with frozen tables, blocks fetch the scores of theirs, and a text's score is
   the sum over its pieces. It depends on nothing but the text's bytes.

Cases: a null text counts as empty; an empty text has one token, the end. Rows that repeat are scored, and
counted in training, each on their own; a null doc_id counts as empty text in the fold. Without training
documents all counts are 0. A text of any length lies in one block; words of any length count as one token.
Columns of other names are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import SPACE, Texts, crc_mod, cut, drop, mix64, range_classes, range_hashes, setting, slices
from gridloom.shipping import ship

FOLDS, HELD_OUT = 7, 2
BLOCK_BYTES = 16 << 20
SLICE_BYTES = 1 << 21
SHARD_BYTES = 24 << 20  # of the corpus, behind one shard of vocabulary and contexts
LEAST_SHARDS, MOST_SHARDS = 8, 1 << 20
PIECE = 32
ORDERS = 5  # contexts of 1, 2, 3, 4 bytes, piece so far
SEEN = (1, 2, 4, 16, 256, 1 << 12, 1 << 16, 1 << 20, 1 << 24)  # edges of the gate: times that a context was seen; powers of 2
GATE = np.array([sum(1 << e >> 1 >= edge for edge in SEEN) for e in range(65)], dtype=np.uint8)  # by a count's bit length
PRIOR = 0.05
RATE = 1.0
MAP_CELLS, MAP_REACH = 33, 8.0
STEP = 1 << 13  # bits that are learned from at once
LEAST_P = 1 / 65536
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xA0761D6478BD642F)

# What stands before a piece.
START, WITHIN, NEW_LINE, SENTENCE, CLAUSE, GAP, OTHER = range(7)
WHOLE_WORD = 255  # marks the digest of a word that is no piece of its own
_KIND = np.full(256, OTHER, dtype=np.uint8)
_KIND[list(b".!?")], _KIND[list(b",;:")], _KIND[np.flatnonzero(SPACE)], _KIND[0] = SENTENCE, CLAUSE, GAP, GAP
_NEW_LINE = np.zeros(256, dtype=bool)
_NEW_LINE[[10, 11, 12, 13]] = True


@dataclass
class Entries:
    """Byte strings in one buffer: a kind, then the bytes of a piece, or of a long word's digest; and the
    training occurrences of each."""

    data: np.ndarray
    offsets: np.ndarray
    counts: np.ndarray

    @staticmethod
    def joined(parts: list[Entries]) -> Entries:
        ends = np.concatenate([np.diff(p.offsets) for p in parts]).cumsum()
        return Entries(np.concatenate([p.data for p in parts]), np.concatenate([[0], ends]), np.concatenate([p.counts for p in parts]))

    def chosen(self, at: np.ndarray, counts: np.ndarray) -> Entries:
        lengths = np.diff(self.offsets)[at]
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        inside = np.arange(offsets[-1]) - np.repeat(offsets[:-1], lengths)
        return Entries(self.data[np.repeat(self.offsets[at], lengths) + inside], offsets, counts)

    def distinct(self) -> tuple[Entries, np.ndarray]:
        """The distinct entries, with their counts added up, and the place of each entry among them."""
        first, place = range_classes(self.data, self.offsets[:-1], self.offsets[1:])
        return self.chosen(first, _added(place, self.counts, len(first))), place

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each entry stands for a word, and where the word's bytes begin and end."""
        kind, starts, ends = self.data[self.offsets[:-1]], self.offsets[:-1] + 1, self.offsets[1:]
        last = self.data[ends - 1]
        closed = (kind != WHOLE_WORD) & (SPACE[last] | (last == 0))
        ends = ends - closed
        return (kind == WHOLE_WORD) | closed & (kind != WITHIN) & (ends > starts) & ~self._veiled(), starts, ends

    def _veiled(self) -> np.ndarray:
        """Pieces with a byte 1, which may stand for a byte 0: their words go by digests."""
        ones = np.concatenate([[0], np.cumsum(self.data == 1)])
        kind_is_one = self.data[self.offsets[:-1]] == 1
        return ones[self.offsets[1:]] - ones[self.offsets[:-1]] - kind_is_one > 0

    def packed(self) -> bytes:
        return _squeezed(np.diff(self.offsets).astype(np.uint8), _narrow(self.counts), self.data)

    @staticmethod
    def unpacked(data: bytes) -> Entries:
        lengths, counts, own = _spread_out(data)
        return Entries(own, np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]), counts.astype(np.int64))


def _added(place: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """Sums of counts by place; they are exact up to 2^53."""
    return np.bincount(place, counts, n).astype(np.int64)


def _narrow(values: np.ndarray) -> np.ndarray:
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def _squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed string, each with its bytes of equal weight side by side."""
    sink = pa.BufferOutputStream()
    flat = [np.ascontiguousarray(a).reshape(-1) for a in arrays]
    head = b"".join(np.array([len(a), ord(a.dtype.kind), a.dtype.itemsize], np.int64).tobytes() for a in flat)
    body = b"".join(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() for a in flat)
    sink.write(np.array([len(flat), len(body)], np.int64).tobytes() + head)
    sink.write(pa.compress(body, codec="zstd", asbytes=True))
    return sink.getvalue().to_pybytes()


def _spread_out(data: bytes) -> list[np.ndarray]:
    n, size = np.frombuffer(data, np.int64, 2).tolist()
    head = np.frombuffer(data, np.int64, 3 * n, 16).reshape(n, 3).tolist()
    body = np.frombuffer(pa.decompress(data[16 + 24 * n :], decompressed_size=size, codec="zstd"), np.uint8)
    found, at = [], 0
    for length, kind, width in head:
        planes = body[at : at + length * width].reshape(width, length)
        found.append(np.ascontiguousarray(planes.T).reshape(-1).view(f"{chr(kind)}{width}"))
        at += length * width
    return found


def pieces(texts: Texts, train: np.ndarray) -> tuple[Entries, np.ndarray, np.ndarray]:
    """Of some texts: the distinct entries, and the entries of all texts with the text of each. Texts are
    read as their bytes and an end mark 0; byte 0 itself counts as 1."""
    size, n = len(texts.data), texts.n
    shift = np.repeat(np.arange(n), np.diff(texts.offsets))
    data = np.zeros(size + n, dtype=np.uint8)
    data[np.arange(size) + shift] = np.maximum(texts.data, 1)
    stops = np.flatnonzero(SPACE[data] | (data == 0))
    starts = np.concatenate([[0], stops[:-1] + 1])[: len(stops)]
    begins = texts.offsets[:-1] + np.arange(n)
    owner = np.searchsorted(begins, starts, side="right") - 1
    before, earlier = data[np.maximum(starts - 1, 0)], data[np.maximum(starts - 2, 0)]
    kind = np.where(_NEW_LINE[before], NEW_LINE, np.where(starts - 1 > begins[owner], _KIND[earlier], GAP))
    kind[starts == begins[owner]] = START
    length = stops - starts
    p_starts, p_ends, p_kind, p_owner = starts, stops + 1, kind, owner
    if (length >= PIECE).any():
        parts = length // PIECE + 1
        whole = np.repeat(np.arange(len(starts)), parts)
        k = np.arange(len(whole)) - np.repeat(np.cumsum(parts) - parts, parts)
        p_starts = starts[whole] + PIECE * k
        p_ends = np.where(k == parts[whole] - 1, stops[whole] + 1, p_starts + PIECE)
        p_kind, p_owner = np.where(k > 0, WITHIN, kind[whole]), owner[whole]
    first, place = range_classes(data, p_starts, p_ends, p_kind)
    lengths = p_ends[first] - p_starts[first] + 1
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    inside = np.arange(offsets[-1]) - np.repeat(offsets[:-1], lengths)
    own = data[np.maximum(np.repeat(p_starts[first] - 1, lengths) + inside, 0)]
    own[offsets[:-1]] = p_kind[first]
    found = Entries(own, offsets, _added(place, train[p_owner], len(first)))
    ones = np.concatenate([[0], np.cumsum(data == 1)])
    long = np.flatnonzero((length >= PIECE) | (length > 0) & (ones[stops] > ones[starts]))
    if not len(long):
        return found, place, p_owner
    digests = [hashlib.blake2b(texts.data[a - o : b - o].tobytes(), digest_size=16).digest() for a, b, o in zip(starts[long].tolist(), stops[long].tolist(), owner[long].tolist(), strict=True)]
    marked = np.frombuffer(b"".join(bytes([WHOLE_WORD]) + d for d in digests), np.uint8)
    words, at = Entries(marked, 17 * np.arange(len(long) + 1), train[owner[long]].astype(np.int64)).distinct()
    return Entries.joined([found, words]), np.concatenate([place, at + len(first)]), np.concatenate([p_owner, owner[long]])


class Nodes:
    """The distinct places of some entries: a kind, a piece so far, and the byte after it. Each has its table
    rows, its training occurrences, and the entries' places among them."""

    def __init__(self, entries: Entries):
        data, begins = entries.data, entries.offsets[:-1]
        kind = data[begins]
        lengths = np.where(kind == WHOLE_WORD, 0, np.diff(entries.offsets) - 1)
        self.first = np.concatenate([[0], np.cumsum(lengths)])
        owner = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(self.first[-1]) - np.repeat(self.first[:-1], lengths)
        at = begins[owner] + 1 + place
        byte = data[at]
        so_far = np.empty(len(at), dtype=np.uint64)
        hashed = np.full(len(lengths), _ODD)
        live = np.flatnonzero(lengths > 0)
        for p in range(int(lengths.max(initial=0))):
            live = live[lengths[live] > p]
            spot = self.first[live] + p
            so_far[spot] = hashed[live]
            hashed[live] = mix64(hashed[live] ^ (byte[spot].astype(np.uint64) + np.uint64(1)) * _SPREAD)
        key = mix64(mix64(so_far ^ (byte.astype(np.uint64) + np.uint64(1)) * _ODD) + kind[owner])
        _, pick, self.place = np.unique(key, return_index=True, return_inverse=True)
        self.times = _added(self.place, entries.counts[owner], len(pick))
        at, place, self.byte = at[pick], place[pick], byte[pick]
        self.rows, joined = [], np.zeros(len(pick), dtype=np.uint64)
        for j in range(1, ORDERS):
            joined = np.where(place + 1 >= j, joined << np.uint64(8) | data[np.maximum(at - j, 0)], joined)
            # how many bytes there are, and whether the kind is one of them
            shape = np.minimum(j, place + 1) * 2 + (place < j)
            self.rows.append(_row(joined | shape.astype(np.uint64) << np.uint64(40) | np.uint64(j << 48)))
        self.rows.append(_row(so_far[pick]))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """The sum of the places' values for each entry."""
        total = np.concatenate([[0.0], np.cumsum(values[self.place])])
        return total[self.first[1:]] - total[self.first[:-1]]


def _row(context: np.ndarray) -> np.ndarray:
    return (mix64(context) >> np.uint64(16)).astype(np.int64)


@dataclass
class Mixer:
    """weight[bit place, predictor, gate]; table[bit place, gate of the piece so far, cell]; and the bits
    that each of these has learned from."""

    weight: np.ndarray
    table: np.ndarray
    seen: np.ndarray
    hits: np.ndarray
    curve: np.ndarray

    @staticmethod
    def new() -> Mixer:
        cells = 1 / (1 + np.exp(-np.linspace(-MAP_REACH, MAP_REACH, MAP_CELLS)))
        weight, table = np.full((8, ORDERS, len(SEEN) + 1), 0.3), np.tile(cells, (8, len(SEEN) + 1, 1))
        return Mixer(weight, table, np.zeros(weight.shape), np.zeros(table.shape), np.zeros(weight.shape))

    def packed(self) -> bytes:
        return b"".join(x.tobytes() for x in (self.weight, self.table, self.seen, self.hits))

    @staticmethod
    def mean(blocks: Iterable[bytes]) -> Mixer:
        """The mean of packed mixers by bits seen; what no block has seen stays as it began."""
        new = Mixer.new()
        shapes = [new.weight.shape, new.table.shape]
        edges = np.cumsum([x.size for x in (new.weight, new.table, new.seen, new.hits)])[:-1]
        sums = [np.zeros(shape) for shape in (*shapes, *shapes)]
        for data in blocks:
            weight, table, seen, hits = (x.reshape(t.shape) for x, t in zip(np.split(np.frombuffer(data), edges), sums, strict=True))
            for t, x in zip(sums, (weight * seen, table * hits, seen, hits), strict=True):
                t += x
        weight, table = (np.where(n > 0, total / np.maximum(n, 1e-9), first) for total, n, first in ((sums[0], sums[2], new.weight), (sums[1], sums[3], new.table)))
        return Mixer(weight, table, sums[2], sums[3], new.curve)

    def predict(self, place: np.ndarray, logits: np.ndarray, gates: np.ndarray):
        """Probability of a 1, and what learning needs. logits, gates: predictors x bits."""
        z = np.zeros(logits.shape[1])
        for k in range(ORDERS):
            z += self.weight[place, k, gates[k]] * logits[k]
        mixed = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        spot = (np.clip(z, -MAP_REACH, MAP_REACH - 1e-9) + MAP_REACH) * ((MAP_CELLS - 1) / (2 * MAP_REACH))
        cell = spot.astype(np.int64)
        part = spot - cell
        gate = gates[4]
        refined = self.table[place, gate, cell] * (1 - part) + self.table[place, gate, cell + 1] * part
        return np.clip((mixed + refined) / 2, LEAST_P, 1 - LEAST_P), mixed, (gate, cell, part)

    def learn(self, place: np.ndarray, logits: np.ndarray, gates: np.ndarray, bits: np.ndarray, times: np.ndarray) -> None:
        """times: how often each bit occurs. Weights take a damped step over the curvature of all bits so far,
        and cells are means, so that every occurrence counts alike wherever in the pass it stands."""
        _, mixed, (gate, cell, part) = self.predict(place, logits, gates)
        error = (bits - mixed) * times
        size = np.abs(logits)
        bend = times * np.maximum(mixed * (1 - mixed), 1e-3) * size.sum(axis=0)
        n = 8 * (len(SEEN) + 1)
        for k in range(ORDERS):
            slot = place * (len(SEEN) + 1) + gates[k]
            self.curve[:, k, :] += np.bincount(slot, bend * size[k], n).reshape(8, -1)
            self.weight[:, k, :] += RATE * np.bincount(slot, error * logits[k], n).reshape(8, -1) / (self.curve[:, k, :] + 32)
            self.seen[:, k, :] += np.bincount(slot, times, n).reshape(8, -1)
        slot = (place * (len(SEEN) + 1) + gate) * MAP_CELLS + cell
        flat, hits = self.table.reshape(-1), self.hits.reshape(-1)
        for to, share in ((slot, (1 - part) * times), (slot + 1, part * times)):
            hits += np.bincount(to, share, len(flat))
            flat += np.bincount(to, share * (bits - flat[to]), len(flat)) / (hits + 50)


class Answers:
    """The paths of some slots (row * 256 + byte): of each, the counts of its row, and of the half, quarter
    ... of the row's bytes that its own byte lies in. Logits and gates are worked out once a slot."""

    def __init__(self, slots: np.ndarray, sums: np.ndarray):
        if (slots[1:] < slots[:-1]).any():
            order = np.argsort(slots)
            slots, sums = slots[order], sums[:, order]
        self.slots, self.sums, self.own = slots, sums, None

    def bits(self, nodes: Nodes, own: int, some: slice) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each of the 8 bits: its place, the bits, logits and gates (predictors x places). own: times
        that each byte itself was counted, to be left out."""
        if own != self.own:
            self.own, self.logits, self.gates = own, [], []
            ones = (self.slots & 255).astype(np.int32)
            for j in range(8):
                logits, gates = _evidence(self.sums[j], self.sums[j + 1], ones >> (7 - j) & 1, own)
                self.logits.append(logits)
                self.gates.append(gates)
        byte = nodes.byte[some].astype(np.int32)
        at = np.searchsorted(self.slots, np.stack([r[some] for r in nodes.rows]) << 8 | byte)
        for j in range(8):
            yield j, byte >> (7 - j) & 1, self.logits[j][at], self.gates[j][at]


def _evidence(total: np.ndarray, taken: np.ndarray, bit: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
    """Logits and gates of bits, from the counts before and after each."""
    other, taken = (total - taken).astype(np.float32), taken.astype(np.float32)
    if own:
        taken = np.maximum(taken - np.float32(own), 0)
    return np.log((taken + np.float32(PRIOR)) / (other + np.float32(PRIOR))) * (2 * bit - 1).astype(np.float32), GATE[np.frexp(taken + other)[1]]


def _firsts(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(values)), bool), values[1:] != values[:-1]]))


def merged(slots: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct slots in order, with their counts added up."""
    order = np.argsort(slots)
    slots = slots[order]
    first = _firsts(slots)
    return slots[first], np.add.reduceat(counts[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)


def slots_of(nodes: Nodes) -> tuple[np.ndarray, np.ndarray]:
    return merged(np.concatenate([r << 8 | nodes.byte for r in nodes.rows]), np.tile(nodes.times, ORDERS))


def path_sums(slots: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The paths of distinct ordered slots that hold all counts of their rows."""
    sums = []
    for j in range(9):
        first = _firsts(slots >> (8 - j))
        sums.append(np.repeat(np.add.reduceat(counts, first), np.diff(np.append(first, len(slots)))))
    return np.stack(sums)


def learned(nodes: Nodes, answers: Answers, counted: bool = True) -> Mixer:
    """One online pass over the bits of all places that training texts have, in the order of their keys; these
    are hashes, so any step of learning meets frequent and rare places alike."""
    mixer = Mixer.new()
    step = STEP // 8
    for a in range(0, len(nodes.byte), step):
        some = slice(a, a + step)
        times = nodes.times[some]
        if not times.any():
            continue
        parts = list(answers.bits(nodes, int(counted), some))
        place = np.repeat(np.arange(8), len(times))
        bits, logits, gates = (np.concatenate([p[i] for p in parts], axis=-1) for i in (1, 2, 3))
        mixer.learn(place, logits, gates, bits, np.tile(times, 8))
    return mixer


def log10_of(nodes: Nodes, answers: Answers, mixer: Mixer) -> np.ndarray:
    """log10 probability of each place's byte."""
    found = np.zeros(len(nodes.byte))
    for a in range(0, len(found), 1 << 15):
        some = slice(a, a + (1 << 15))
        for j, bit, logits, gates in answers.bits(nodes, 0, some):
            p, _, _ = mixer.predict(j, logits, gates)
            found[some] += np.log10(np.where(bit == 1, p, 1 - p))
    return found


def _by_shard(hashes: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard that has some of the hashes, and their places in order."""
    shard = hashes % np.uint64(shards)
    order = np.argsort(shard, kind="stable")
    ranked = shard[order]
    edges = [*_firsts(ranked).tolist(), len(order)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(ranked[a]), order[a:b]


def _rows(**columns: list) -> pa.RecordBatch:
    kinds = {"kind": pa.string(), "data": pa.binary(), "docs": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in columns.items()], names=list(columns))


def _blocks(rows: DataFrame, shards: int) -> DataFrame:
    """From text, doc_id, held_out: of each block, its distinct entries by shard (kind asked), and its texts as
    numbers of entries in the order of the shards (kind texts)."""

    class Block:
        def __init__(self) -> None:
            self.size, self.entries, self.places, self.owners, self.docs, self.n = 0, [], [], [], [], 0

        def add(self, part: pa.RecordBatch) -> None:
            texts = Texts(part.column(0), lower=True)
            found, place, owner = pieces(texts, ~np.asarray(part.column(2)))
            self.places.append(place + sum(len(e.counts) for e in self.entries))
            self.owners.append(owner + self.n)
            self.entries.append(found)
            self.docs.append(pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(np.diff(texts.words()[2])), pa.array(np.diff(texts.offsets))], names=["doc_id", "held_out", "words", "bytes"]))
            self.n += texts.n
            self.size += len(texts.data)

        def rows(self, block: int) -> Iterator[pa.RecordBatch]:
            found, place = Entries.joined(self.entries).distinct()
            _, starts, ends = found.words()
            number, at = np.zeros(len(found.counts), np.int64), 0
            for shard, chosen in _by_shard(range_hashes(found.data, starts, ends), shards):
                number[chosen] = at + np.arange(len(chosen))
                at += len(chosen)
                yield _rows(kind=["asked"], block=[block], shard=[shard], data=[found.chosen(chosen, found.counts[chosen]).packed()], docs=[None])
            # numbers of each text in order, as differences
            owner = np.concatenate(self.owners)
            own = np.sort(owner.astype(np.int64) << 32 | number[place[np.concatenate(self.places)]])
            owner, own = own >> 32, own & 0xFFFFFFFF
            first = _firsts(owner)
            steps = np.diff(own, prepend=0)
            steps[first] = own[first]
            sink = pa.BufferOutputStream()
            docs = pa.Table.from_batches(self.docs)
            with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(docs)
            data = _squeezed(_narrow(np.bincount(owner, minlength=self.n)), _narrow(steps))
            yield _rows(kind=["texts"], block=[block], shard=[None], data=[data], docs=[sink.getvalue().to_pybytes()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, k, now = TaskContext.get().partitionId() << 32, 0, Block()
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                now.add(part)
                if now.size >= BLOCK_BYTES:
                    yield from now.rows(home + k)
                    k, now = k + 1, Block()
        if now.n:
            yield from now.rows(home + k)

    return rows.mapInArrow(run, "kind string, block bigint, shard bigint, data binary, docs binary")


def _vocabulary(asked: DataFrame) -> DataFrame:
    """From the blocks' entries: of each shard its distinct entries (kind entries), with the counts of their
    words, and for each block the places of its entries among them (kind places)."""

    def run(group: pa.Table) -> pa.Table:
        parts = [Entries.unpacked(d) for d in group.column("data").to_pylist()]
        found, place = Entries.joined(parts).distinct()
        is_word, starts, ends = found.words()
        words = np.flatnonzero(is_word)
        first, name = range_classes(found.data, starts[words], ends[words])
        counts = _added(name, found.counts[words], len(first))
        known = np.zeros(len(is_word), np.int64)
        known[words] = counts[name]
        shard, edges = group.column("shard")[0].as_py(), np.cumsum([len(p.counts) for p in parts])[:-1]
        data = [found.packed(), *(_squeezed(_narrow(p)) for p in np.split(place, edges))]
        blocks = [None, *group.column("block").to_pylist()]
        more = [_squeezed(is_word.astype(np.uint8), _narrow(known)), *[None] * len(parts)]
        none = [0] * len(parts)
        return pa.Table.from_batches([_rows(kind=["entries", *["places"] * len(parts)], block=blocks, shard=[shard] * len(data), data=data, docs=more, distinct=[int((counts > 0).sum()), *none], total=[int(counts.sum()), *none])])

    schema = "kind string, block bigint, shard bigint, data binary, docs binary, distinct bigint, total bigint"
    return asked.groupBy("shard").applyInArrow(run, schema)


def _slots(entries: DataFrame, shards: int) -> DataFrame:
    """The distinct slots of each shard's entries, by shard of the context table (key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                slots, counts = slots_of(Nodes(Entries.unpacked(data)))
                for key, at in _by_shard(mix64((slots >> 8).astype(np.uint64) * _SPREAD), shards):
                    yield _rows(shard=[shard], key=[key], data=[_squeezed(np.diff(slots[at], prepend=0), _narrow(counts[at]))])

    return entries.select("shard", "data").mapInArrow(run, "shard bigint, key bigint, data binary")


def _sums(slots: DataFrame) -> DataFrame:
    """The paths of the slots that each shard (shard) has asked of a shard of the context table (key)."""

    def run(group: pa.Table) -> pa.Table:
        asked = [(np.cumsum(steps), counts) for steps, counts in map(_spread_out, group.column("data").to_pylist())]
        slots, counts = merged(np.concatenate([s for s, _ in asked]), np.concatenate([c.astype(np.int64) for _, c in asked]))
        sums = path_sums(slots, counts)
        found = []
        for own, _ in asked:
            paths = sums[:, np.searchsorted(slots, own)]
            found.append(_squeezed(np.diff(own, prepend=0), _narrow(np.concatenate([paths[:-1] - paths[1:], paths[-1:]]))))
        return pa.table({"shard": group.column("shard"), "key": group.column("key"), "data": pa.array(found, pa.binary())})

    return slots.groupBy("key").applyInArrow(run, "shard bigint, key bigint, data binary")


def answers_of(data: list[bytes]) -> Answers:
    slots, sums = [], []
    for steps, values in map(_spread_out, data):
        slots.append(np.cumsum(steps))
        sums.append(np.cumsum(values.reshape(9, -1)[::-1], axis=0, dtype=np.int64)[::-1])
    sums = np.concatenate(sums, axis=1) if sums else np.zeros((9, 0), np.int64)
    return Answers(np.concatenate([*slots, np.zeros(0, np.int64)]), sums.astype(np.uint32) if sums.max(initial=0) < 1 << 32 else sums)


def _learned(vocabulary: DataFrame, sums: DataFrame) -> DataFrame:
    """Of each shard: its entries, words, blocks and their places, answers, and the mixer learned from them."""
    types = {"shard": pa.int64(), "data": pa.binary(), "docs": pa.binary(), "blocks": pa.list_(pa.int64()), "places": pa.list_(pa.binary()), "answers": pa.list_(pa.binary()), "mixer": pa.binary()}

    def run(own: pa.Table, answers: pa.Table) -> pa.Table:
        rows, data = own.to_pylist(), answers.column("data").to_pylist()
        entries = next(r for r in rows if r["kind"] == "entries")
        places = [r for r in rows if r["kind"] == "places"]
        mixer = learned(Nodes(Entries.unpacked(entries["data"])), answers_of(data)).packed()
        found = (entries["shard"], entries["data"], entries["docs"], [r["block"] for r in places], [r["data"] for r in places], data, mixer)
        return pa.Table.from_arrays([pa.array([x], t) for x, t in zip(found, types.values(), strict=True)], names=list(types))

    schema = "shard bigint, data binary, docs binary, blocks array<bigint>, places array<binary>, answers array<binary>, mixer binary"
    return vocabulary.groupBy("shard").cogroup(sums.groupBy("shard")).applyInArrow(run, schema)


def _mixer(shards: DataFrame) -> Mixer:
    """The mean of all shards' mixers, by partitions first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Mixer.mean(x for batch in batches for x in batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([found.packed()], pa.binary())], names=["mixer"])

    return Mixer.mean(bytes(r[0]) for r in shards.select("mixer").coalesce(64).mapInArrow(run, "mixer binary").toLocalIterator())


def _scored(shards: DataFrame, mixer: Mixer) -> DataFrame:
    """For each block and shard: of the block's entries, whether they stand for words, the words' counts, and
    the entries' scores."""
    shared = shards.sparkSession.sparkContext.broadcast(mixer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                nodes = Nodes(Entries.unpacked(row["data"]))
                score = nodes.sums(log10_of(nodes, answers_of(row["answers"]), shared.value)).astype(np.float32)
                is_word, known = _spread_out(row["docs"])
                for block, places in zip(row["blocks"], row["places"], strict=True):
                    at = _spread_out(places)[0]
                    yield _rows(block=[block], shard=[row["shard"]], data=[_squeezed(is_word[at], _narrow(known[at]), score[at])])

    return shards.select("shard", "data", "docs", "blocks", "places", "answers").mapInArrow(run, "block bigint, shard bigint, data binary")


OUT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double"


def score(docs: DataFrame) -> DataFrame:
    """One row per document: the columns of OUT."""
    spark = docs.sparkSession
    ship(spark)
    held_out = crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT
    rows = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"))
    size, ends = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)), F.count_if(~F.col("held_out"))).first()
    shards = min(max(LEAST_SHARDS, size // SHARD_BYTES), MOST_SHARDS)
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"):
        blocks = cut(_blocks(rows, shards), by="kind")
    vocabulary = cut(_vocabulary(blocks.where("kind = 'asked'")))
    distinct, total = vocabulary.agg(F.coalesce(F.sum("distinct"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    distinct, total = distinct + (ends > 0), total + ends
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "1"):  # a row is a whole shard
        slots = cut(_slots(vocabulary.where("kind = 'entries'"), shards))
        table = cut(_learned(vocabulary, _sums(slots)), vocabulary, slots)
        found = cut(_scored(table, _mixer(table)))
    drop(table)
    base, end = np.log10(1 / (total + distinct + 1)), np.log10(ends + 1.0)

    def run(texts: pa.Table, values: pa.Table) -> pa.Table:
        data = [d for _, d in sorted(zip(values.column("shard").to_pylist(), values.column("data").to_pylist(), strict=True))]
        is_word, known, own = (np.concatenate(x) for x in zip(*map(_spread_out, data), strict=True))
        known = known.astype(np.int64)
        unigram = np.where(is_word == 1, np.log10(known + 1.0), 0.0)
        with pa.ipc.open_stream(texts.column("docs")[0].as_py()) as stream:
            docs = stream.read_all().combine_chunks()
        n, (sizes, steps) = docs.num_rows, _spread_out(texts.column("data")[0].as_py())
        owner = np.repeat(np.arange(n), sizes)
        at = np.cumsum(steps.astype(np.int64))
        begins = np.cumsum(sizes.astype(np.int64)) - sizes
        at -= np.repeat(at[begins] - steps[begins], sizes)
        tokens = np.asarray(docs.column("words")) + 1
        scores = np.bincount(owner, own[at].astype(np.float64), n)
        columns = {
            "doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": tokens, "n_known": np.bincount(owner, (known > 0)[at], n).astype(np.int64) + (ends > 0),
            "train_tokens": np.full(n, total, np.int64), "base_score": np.bincount(owner, unigram[at], n) + end + tokens * base, "score": scores,
            "bits_per_byte": -scores / np.log10(2.0) / (np.asarray(docs.column("bytes")) + 1),
        }
        return pa.table(columns)

    texts = blocks.where("kind = 'texts'").select("block", "data", "docs")
    return texts.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(run, OUT)


def digest(docs: DataFrame) -> DataFrame:
    return score(docs)
