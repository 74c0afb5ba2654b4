"""Quality rules by line labelling: a linear-chain conditional random field and Viterbi decoding.

Every line of a text gets a handful of yes/no features; the most likely sequence of the states boilerplate
and content is decoded over all lines, and a text is kept if at least ``CONTENT_SHARE`` of its words lie in
content lines and it passes the base rules (enough words, few repeated words).

The field is trained on a bounded sample of labelled documents (``TRAIN_DOCS``, by hashed id): lines of
good documents count as content; of bad documents, the lines that a first pass without transitions finds
less likely content than not count as boilerplate; then all weights are fitted to these sequences. The
driver receives feature bits of lines, never texts, and at most ``TRAIN_LINES`` lines.

Cases: a null text has no words and fails the base rules, as an empty one does. Rows that repeat are
judged alike, whatever their doc_id, null included. Words, lines and windows count as equal only if their
bytes are. A text of any length is one sequence of lines. Without labels of both kinds all lines are content
and only the base rules decide. Columns of docs stay, but for those named as results. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.common import Rows, Texts, slices
from gridloom.llm.textstats import IS_SYMBOL, Stats, flags, sums
from gridloom.shipping import ship

LEAST_WORDS, MOST_REPEATED = 10, 20  # words; percent
CONTENT_SHARE = 0.5
TRAIN_DOCS, TRAIN_LINES, ROUNDS = 4_000, 200_000, 80

_UPPER, _LOWER, _DIGIT = flags(bytes(range(65, 91))), flags(bytes(range(97, 123))), flags(b"0123456789")
_PIPE, _BANG, _LINK = flags(b"|"), flags(b"!?"), flags(b"@/=_")
_STOP = flags(b".!?:;\"'")
_LOOSE = np.array([b < 128 for b in range(256)]) & ~_UPPER & ~_LOWER & ~flags(b" \t\r\n\x0b\x0c")
LINE_FEATURES = (
    "always", "no_words", "up_to_2_words", "up_to_5_words", "over_12_words", "mostly_upper", "some_symbols", "many_symbols", "some_pipes", "many_pipes", "many_bangs",
    "digits", "links", "no_full_stop", "seen_before", "half_repeated", "all_repeated", "long_words", "loose_characters", "first", "last",
)


def line_features(stats: Stats) -> np.ndarray:
    """A row of 0/1 for each line."""
    data, begin, end = stats.texts.data, stats.line_starts, stats.line_ends
    words = stats.line_words
    count = lambda table: sums(table[data], begin, end)
    upper, lower, symbols, pipes = count(_UPPER), count(_LOWER), count(IS_SYMBOL), count(_PIPE)
    size = np.maximum(end - begin, 1)
    stop = np.zeros(len(words), dtype=bool)
    full = words > 0
    stop[full] = _STOP[data[stats.ends[stats.line_word[1][full] - 1] - 1]]
    repeated = sums(stats.repeated, *stats.line_word)
    spread = sums(stats.ends - stats.starts, *stats.line_word)
    place = np.arange(len(words)) - np.repeat(stats.first_line[:-1], np.diff(stats.first_line))
    left = np.repeat(stats.first_line[1:], np.diff(stats.first_line)) - np.arange(len(words))
    columns = (
        np.ones(len(words), bool), words == 0, full & (words <= 2), full & (words <= 5), words > 12, upper > 0.6 * np.maximum(upper + lower, 1),
        symbols * 5 > words, symbols * 2 > words, pipes * 10 > words, pipes * 3 > words, count(_BANG) * 3 > words, count(_DIGIT) * 5 > size, count(_LINK) * 10 > size,
        full & ~stop, stats.dup_line, (repeated * 2 > words), full & (repeated == words), spread > 11 * np.maximum(words, 1), count(_LOOSE) * 4 > size, place == 0, left == 1,
    )
    return np.stack(columns, axis=1)


@dataclass
class Field:
    """weight of each feature for content (boilerplate is 0); move[i, j]: weight of state j after i."""

    weight: np.ndarray
    move: np.ndarray

    def decode(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Viterbi: True for content lines. first: index of each sequence's first line, and the end."""
        node = features @ self.weight
        (m00, m01), (m10, m11) = self.move.tolist()
        state = np.zeros(len(node), dtype=bool)
        scores = node.tolist()
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if a == b:
                continue
            s0, s1, back = 0.0, scores[a], []
            for x in scores[a + 1 : b]:
                to0, to1 = s1 + m10 > s0 + m00, s1 + m11 >= s0 + m01
                back.append((to0, to1))
                s0, s1 = (s1 + m10 if to0 else s0 + m00), (s1 + m11 if to1 else s0 + m01) + x
            now = s1 >= s0
            state[b - 1] = now
            for k in range(b - 2, a - 1, -1):
                now = back[k - a][now]
                state[k] = now
        return state


def _marginals(node: np.ndarray, move: np.ndarray, grid: list[np.ndarray], step: list[np.ndarray]):
    """Probability of content at each line, and expected moves; grid[t]: indices of the t-th lines of the
    sequences, longest sequences first."""
    score = np.stack([np.zeros(len(node)), node], axis=1)
    alpha, beta = np.empty_like(score), np.zeros_like(score)
    alpha[grid[0]] = score[grid[0]]
    for t in range(1, len(grid)):
        before = alpha[step[t]]
        alpha[grid[t]] = np.logaddexp(before[:, :1] + move[0], before[:, 1:] + move[1]) + score[grid[t]]
    expected = np.zeros((2, 2))
    for t in range(len(grid) - 1, 0, -1):
        ahead = beta[grid[t]] + score[grid[t]]
        beta[step[t]] = np.logaddexp(move[:, 0] + ahead[:, :1], move[:, 1] + ahead[:, 1:])
    both = alpha + beta
    total = np.logaddexp(both[:, 0], both[:, 1])
    for t in range(1, len(grid)):
        pair = alpha[step[t]][:, :, None] + move + (beta[grid[t]] + score[grid[t]])[:, None, :] - total[grid[t]][:, None, None]
        expected += np.exp(pair).sum(0)
    return np.exp(both[:, 1] - total), expected


def fit(features: np.ndarray, first: np.ndarray, good: np.ndarray, rounds: int = ROUNDS) -> Field:
    """features: of all lines; first: of each sequence and the end; good: of each sequence."""
    n, k = features.shape
    if not n or good.all() or not good.any():
        return Field(np.zeros(k), np.zeros((2, 2)))
    x = features.astype(np.float64)
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    grid = [first[:-1][order[lengths[order] > t]] + t for t in range(int(lengths.max()))]
    step = [g - 1 for g in grid]
    alone = [np.arange(n)]
    label = np.repeat(good, lengths).astype(np.float64)
    inner = np.ones(n, dtype=bool)
    inner[first[:-1][lengths > 0]] = False

    def climb(label: np.ndarray, grid, step, moves: bool) -> Field:
        weight, move = np.zeros(k), np.zeros((2, 2))
        seen = np.zeros((2, 2))
        now, before = label[inner].astype(int), label[np.flatnonzero(inner) - 1].astype(int)
        np.add.at(seen, (before, now), 1)
        m, v = np.zeros(k + 4), np.zeros(k + 4)
        for i in range(1, rounds + 1):
            p, expected = _marginals(x @ weight, move, grid, step)
            gradient = np.concatenate([((label - p) @ x) / n - 1e-4 * weight, ((seen - expected) / n - 1e-3 * move).ravel() * moves])
            m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
            change = 0.15 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
            weight, move = weight + change[:k], move + change[k:].reshape(2, 2) * moves
        return Field(weight, move)

    lone = climb(label, alone, alone, moves=False)
    refined = np.where(np.repeat(good, lengths), 1.0, (x @ lone.weight >= 0).astype(np.float64))
    return climb(refined, grid, step, moves=True)


def _line_bits(docs: DataFrame) -> DataFrame:
    """doc_id and the feature bits of each line as one integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = 1 << np.arange(len(LINE_FEATURES), dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                stats = Stats(Texts(part.column(1)))
                bits = line_features(stats) @ powers
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(stats.first_line.astype(np.int32), pa.array(bits))], names=["doc_id", "bits"])

    return docs.mapInArrow(run, "doc_id bigint, bits array<bigint>")


def train(docs: DataFrame, labels: DataFrame, most_docs: int = TRAIN_DOCS, most_lines: int = TRAIN_LINES) -> Field:
    ship(docs.sparkSession)
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    chosen = usable.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    bits = _line_bits(texts).groupBy("doc_id").agg(F.min("bits").alias("bits"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    before = F.coalesce(F.sum(F.size("bits")).over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # only the document in which the last of most_lines stands is cut
    within = bits.join(F.broadcast(chosen), "doc_id").withColumn("before", before).where(F.col("before") < most_lines)
    found = within.orderBy(*order).select(F.slice("bits", F.lit(1), (F.lit(most_lines) - F.col("before")).cast("int")).alias("bits"), "quality").toArrow().to_pylist()
    sequences, good = [row["bits"] for row in found], [row["quality"] > 0 for row in found]
    flat = np.array([b for s in sequences for b in s], dtype=np.int64)
    features = (flat[:, None] >> np.arange(len(LINE_FEATURES))) & 1 == 1
    return fit(features, np.concatenate([[0], np.cumsum([len(s) for s in sequences])]).astype(np.int64), np.array(good, dtype=bool))


NUMBERS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_content_lines", "n_content_words")


def with_rules(docs: DataFrame, field: Field) -> DataFrame:
    """docs with NUMBERS, base_failed and kept."""
    own = (*NUMBERS, "base_failed", "kept")
    rows = Rows(docs, ("doc_id", "text"))
    inner = rows.df.drop("rid")
    at = inner.columns.index(rows.inner["text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.schema.names[at]):
                stats = Stats(Texts(part.column(at)))
                content = field.decode(line_features(stats), stats.first_line)
                of = lambda values: sums(values, stats.first_line[:-1], stats.first_line[1:])  # noqa: B023, E731
                numbers = (stats.n_words, stats.word_chars, stats.n_symbols, stats.n_dup_lines, stats.n_repeat_words, np.diff(stats.first_line), of(content), of(content * stats.line_words))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x.astype(np.int64)) for x in numbers)], names=[*part.schema.names, *NUMBERS])

    schema = inner.withColumns({c: F.lit(0).cast("long") for c in NUMBERS}).schema
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    kept = ~failed & (F.col("n_content_words") >= CONTENT_SHARE * F.col("n_words"))
    return inner.mapInArrow(run, schema).select(*rows.back(own), *NUMBERS, failed.alias("base_failed"), kept.alias("kept"))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return with_rules(docs.select("doc_id", "text"), train(docs, labels)).drop("text")
