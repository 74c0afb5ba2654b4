"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The model is compiled into one transducer: the normaliser (spaces become the piece character U+2581, a dummy
prefix comes first), a trie of the pieces whose final states emit ids, and byte fallback for characters
without a piece. An input is composed with it state by state, and the shortest path in the tropical semiring
(sums along a path, minimum over paths) gives the ids. For a unigram model an arc weighs minus its piece's
score, and the composed states are places of the input. A byte-pair model has no additive scores: a
segmentation is what its merges give if and only if every two adjacent pieces are what the merges make of
their own text. Its composed states are therefore pairs of a place and the piece that ends there, and an arc
weighs 0 after a piece with which it forms such a pair and infinity otherwise; states at infinity are not
expanded. Pieces never hold a space after another character, so runs of spaces with the word that follows
them are composed one by one, and the paths of recent words are kept (a bounded table); where no piece holds
a line break beside other characters, words end at line breaks too.

Cases: a null text has null ids, an empty one none. Characters without a piece become one id a byte.
Decoding gives the text again, except that U+2581 comes back as a space and bytes that are no UTF-8 as
U+FFFD. Rows that repeat are encoded alike; other columns stay, but input columns named ids, n_tokens,
round_trip (if asked for) or decoded are replaced. A text of any length is composed word by word, and a word
of any length place by place. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import KEPT, Rows, make_room, slices

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MOST_MODEL_BYTES = 64 << 20
KEPT_WORDS, KEPT_PAIRS, KEPT_LENGTH = 400_000, 400_000, 32  # of each of two generations
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2


@dataclass
class Model:
    """What the transducer needs of a model file."""

    pieces: list[tuple[str, float, int]]
    kind: int = BPE
    dummy_prefix: bool = True

    @staticmethod
    def read(path: str = MODEL_PATH) -> Model:
        from sentencepiece import sentencepiece_model_pb2 as pb

        if os.path.getsize(path) > MOST_MODEL_BYTES:
            raise ValueError(f"{path} is larger than {MOST_MODEL_BYTES} bytes")
        proto = pb.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        rules, trainer = proto.normalizer_spec, proto.trainer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
            raise ValueError("only the identity normaliser with escaped spaces is compiled")
        if trainer.model_type not in (UNIGRAM, BPE) or trainer.treat_whitespace_as_suffix:
            raise ValueError("only unigram and byte-pair models with leading spaces are compiled")
        return Model([(p.piece, p.score, p.type) for p in proto.pieces], trainer.model_type, rules.add_dummy_prefix)


@dataclass
class Transducer:
    model: Model
    ids: dict[str, int] = field(init=False)
    pairs: dict[tuple[str, str], bool] = field(init=False, default_factory=dict)
    old_pairs: dict[tuple[str, str], bool] = field(init=False, default_factory=dict)

    def __post_init__(self) -> None:
        pieces = self.model.pieces
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER)}
        self.score = {p: s for p, s, kind in pieces if kind in (NORMAL, USER)}
        self.start: dict[str, dict] = {}  # the trie: a state's arcs by character; a final state's piece under ""
        for piece in self.ids:
            state = self.start
            for c in piece:
                state = state.setdefault(c, {})
            state[""] = piece
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.unknown = next((i for i, (_, _, kind) in enumerate(pieces) if kind == UNKNOWN), 0)
        self.surface = [self._surface(p, kind) for p, _, kind in pieces]
        self.cost_of_unknown = 10.0 - min(self.score.values(), default=0.0)
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece holds a space after another character")
        self.kept = _Kept(self)
        breaks = "" if any("\n" in p and len(p) > 1 for p in self.ids) else "\n"
        self.split = re.compile(f" *[^ {breaks}]+| +|\n")

    def _surface(self, piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == UNKNOWN:
            return " ⁇ ".encode()
        return b"" if kind == CONTROL else piece.replace(SPACE, " ").encode()

    def merged(self, text: str) -> list[str]:
        """What byte-pair merges make of a text: best score first, leftmost among equals."""
        parts, scores = list(text), self.score
        if len(parts) <= 24:  # a scan of all pairs is cheaper than a heap
            while len(parts) > 1:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    score = scores.get(parts[i] + parts[i + 1])
                    if score is not None and (best is None or score > best):
                        best, at = score, i
                if best is None:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            return parts
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(parts):
                both = parts[i] + parts[j]
                if both in self.score:
                    heapq.heappush(heap, (-self.score[both], i, j, both))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or after[i] != j or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in parts if p is not None]

    def _follows(self, left: str, right: str) -> bool:
        key = left, right
        found = self.pairs.get(key)
        if found is None:
            found = self.old_pairs.get(key)
            if found is None:
                found = self.merged(left + right) == [left, right]
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs, self.old_pairs = {}, self.pairs
            self.pairs[key] = found
        return found

    def path(self, text: str) -> list[str]:
        """The shortest path's pieces for one normalised word. A composed state is (the piece that it
        remembers, least cost, last piece, the state before it); states stand by their place."""
        size, begin, pairs, scores, additive = len(text), self.start, self.pairs, self.score, self.model.kind == UNIGRAM
        states: list[list[tuple]] = [[] for _ in range(size + 1)]
        states[0].append(("", 0.0, "", None))
        for at in range(size):
            here = states[at]
            if not here:
                continue
            trie, end = begin, at
            while end < size:
                trie = trie.get(text[end]) if trie else None
                end += 1
                if trie is None:
                    if end > at + 1:
                        break
                    piece = text[at]  # without a piece, it stands alone
                else:
                    piece = trie.get("")
                    if piece is None:
                        if end > at + 1:
                            continue
                        piece = text[at]
                for state in here:
                    last, cost = state[0], state[1]
                    if additive:
                        kept, cost = "", cost + (-scores[piece] if piece in scores else self.cost_of_unknown)
                    else:
                        kept = piece
                        if last:
                            finite = pairs.get((last, piece))
                            if not (finite if finite is not None else self._follows(last, piece)):
                                continue
                    ahead = states[end]
                    if not ahead:
                        ahead.append((kept, cost, piece, state))
                        continue
                    for i, other in enumerate(ahead):
                        if other[0] == kept:
                            if cost < other[1]:
                                ahead[i] = (kept, cost, piece, state)
                            break
                    else:
                        ahead.append((kept, cost, piece, state))
        out, state = [], min(states[size], key=lambda s: s[1])
        while state[3] is not None:
            out.append(state[2])
            state = state[3]
        return out[::-1]

    def word(self, text: str) -> bytes:
        """The ids of one word (with the spaces before it) as int32."""
        out: list[int] = []
        for piece in self.path(text.replace(" ", SPACE)):
            if piece in self.ids:
                out.append(self.ids[piece])
            elif self.bytes:
                out.extend(self.bytes[b] for b in piece.encode())
            else:
                out.append(self.unknown)
        return np.array(out, dtype=np.int32).tobytes()

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        text = text.replace(SPACE, " ")
        parts = self.split.findall(" " + text if self.model.dummy_prefix else text)
        return np.frombuffer(b"".join(map(self.kept.__getitem__, parts)), dtype=np.int32)

    def decode(self, ids) -> str:
        data = b"".join([self.surface[i] for i in ids])
        if self.model.dummy_prefix and data.startswith(b" "):
            data = data[1:]
        return data.decode("utf-8", "replace")


class _Kept(dict):
    """Ids of words met lately, in two generations: when one is full, the older one goes, and words that are met
    again move on from it."""

    def __init__(self, owner: Transducer):
        super().__init__()
        self.owner, self.old = owner, {}

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = self.owner.word(word)
            if len(word) > KEPT_LENGTH:
                return found
        if len(self) >= KEPT_WORDS:
            self.old = dict(self)
            self.clear()
        self[word] = found
        return found


_compiled: dict[int, Transducer] = KEPT.setdefault("sentencepiece", {})


def _transducer(shared) -> Transducer:
    """The worker's transducer, compiled once for each model that is broadcast."""
    if shared.id not in _compiled:
        _compiled.clear()
        _compiled[shared.id] = Transducer(shared.value)
    return _compiled[shared.id]


class _Shared:
    def __init__(self, spark: SparkSession, model: Model):
        self.broadcast = spark.sparkContext.broadcast(model)
        self.id = id(model)

    @property
    def value(self) -> Model:
        return self.broadcast.value


def encode(docs: DataFrame, path: str = MODEL_PATH, check: bool = False) -> DataFrame:
    """docs with ids and n_tokens, and with round_trip (decoding the ids gives the text) if check."""
    own = ("ids", "n_tokens") + (("round_trip",) if check else ())
    rows = Rows(docs, ("text",))
    inner = rows.df.drop("rid")
    at, name = inner.columns.index(rows.inner["text"]), rows.inner["text"]
    shared = _Shared(docs.sparkSession, Model.read(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room("sentencepiece")
        fst = _transducer(shared)
        for batch in batches:
            for part in slices(batch, name, 1 << 20):
                texts = part.column(at).to_pylist()
                found = [None if t is None else fst.encode(t) for t in texts]
                sizes = np.array([0 if f is None else len(f) for f in found])
                flat = np.concatenate([f for f in found if f is not None] or [np.zeros(0, np.int32)])
                missing = pa.array([f is None for f in found])
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat), mask=missing)
                columns = [*part.columns, ids, pa.array(sizes, pa.int64())]
                if check:
                    columns.append(pa.array([None if t is None else fst.decode(f.tolist()) == t for t, f in zip(texts, found, strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, *own])

    types = {"ids": F.array(F.lit(0)), "n_tokens": F.lit(0).cast("long"), "round_trip": F.lit(True)}
    schema = inner.withColumns({c: types[c] for c in own}).schema
    for f in schema.fields[-len(own) :]:
        f.nullable = True
    return inner.mapInArrow(run, schema).select(*rows.back(own), *own)


def decode(encoded: DataFrame, path: str = MODEL_PATH, ids: str = "ids") -> DataFrame:
    """encoded with the column decoded: the text of its ids."""
    rows = Rows(encoded, (ids,))
    inner = rows.df.drop("rid")
    at = inner.columns.index(rows.inner[ids])
    shared = _Shared(encoded.sparkSession, Model.read(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = _transducer(shared)
        for batch in batches:
            texts = [None if x is None else fst.decode(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    schema = inner.withColumn("decoded", F.lit(None).cast("string")).schema
    return inner.mapInArrow(run, schema).select(*rows.back(("decoded",)), "decoded")


def digest(docs: DataFrame, path: str = MODEL_PATH) -> DataFrame:
    """doc_id, ids, n_tokens, round_trip for every document."""
    return encode(docs.select("doc_id", "text"), path, check=True).drop("text")
