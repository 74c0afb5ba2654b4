"""Quality classifier: histogram gradient-boosted trees over document statistics.

Training uses a bounded sample of labelled rows: the ``TRAIN_ROWS`` labelled documents whose hashed ids
come first, among those whose crc32(doc_id as text) mod 5 is not 0. Only their statistics reach the
driver (``TRAIN_ROWS`` rows of ``len(FEATURES)`` numbers). The trees are complete binary trees, flattened
into arrays, and scoring walks all rows of a batch through them with numpy. Statistics come from the whole
text alone; lang, source, doc_id and labels are no inputs.

Cases: null and empty texts have all statistics 0 and get the score that follows. A doc_id with several
labels has the lowest one; one with several texts has the least statistics in training. Rows that repeat
are scored alike, a null doc_id too. A text of any length counts whole. Without usable labels every score is
0.5. Columns of docs stay, but for one named score. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import Rows, Texts, crc_mod, make_room, slices
from gridloom.llm.textstats import IS_HEAD, IS_SYMBOL, Stats, flags, sums
from gridloom.shipping import ship

TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, RATE, LEAF_WEIGHT, RIDGE = 80, 4, 64, 0.1, 0.2, 0.3
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0
SLICE_BYTES = 1 << 20

_CLASSES = {
    "upper": flags(bytes(range(65, 91))), "lower": flags(bytes(range(97, 123))), "digit": flags(b"0123456789"),
    "pipe": flags(b"|"), "bang": flags(b"!?"), "stop": flags(b".,;:"), "angle": flags(b"<>{}[]()"), "at": flags(b"@/\\_=-"),
    "wide": np.array([b >= 128 for b in range(256)]), "symbol": IS_SYMBOL,
}
FEATURES = (
    "log_chars", "log_words", "word_length", "upper_share", "digit_share", "pipe_rate", "bang_rate", "stop_rate", "angle_rate", "at_rate", "wide_share", "symbol_rate",
    "symbol_words", "distinct_words", "repeat_words", "dup_lines", "line_words", "short_words", "top_word", "log_longest_line",
)


def statistics(texts: Texts) -> np.ndarray:
    """One row of FEATURES for each text."""
    stats = Stats(texts)
    n, data, begins, stops = texts.n, texts.data, texts.offsets[:-1], texts.offsets[1:]
    count = {k: sums(table[data], begins, stops) for k, table in _CLASSES.items()}
    chars = sums(IS_HEAD[data], begins, stops)
    words, share = stats.n_words, lambda a, b: a / np.maximum(b, 1)
    first, last = stats.first[:-1], stats.first[1:]
    marked = IS_SYMBOL[data[stats.ends - 1]] if len(stats.ends) else np.zeros(0, bool)
    short = stats.ends - stats.starts <= 3
    owner = np.repeat(np.arange(n), words)
    order = np.lexsort((stats.word_name, owner))
    hashed, owned = stats.word_name[order], owner[order]
    new = np.ones(len(hashed), dtype=bool)
    new[1:] = (hashed[1:] != hashed[:-1]) | (owned[1:] != owned[:-1])
    distinct = np.bincount(owned[new], minlength=n)
    runs = np.diff(np.append(np.flatnonzero(new), len(hashed)))
    top = np.zeros(n, dtype=np.int64)
    np.maximum.at(top, owned[new], runs)
    longest = np.zeros(n, dtype=np.int64)
    np.maximum.at(longest, stats.line_owner, stats.line_words)
    lines = np.bincount(stats.line_owner[stats.line_words > 0], minlength=n)
    columns = (
        np.log1p(chars), np.log1p(words), share(stats.word_chars, words), share(count["upper"], count["upper"] + count["lower"]), share(count["digit"], chars),
        share(count["pipe"], words), share(count["bang"], words), share(count["stop"], words), share(count["angle"], words), share(count["at"], words),
        share(count["wide"], chars), share(count["symbol"], words), share(sums(marked, first, last), words), share(distinct, words),
        share(stats.n_repeat_words, words), share(stats.n_dup_lines, lines), share(words, lines), share(sums(short, first, last), words), share(top, words), np.log1p(longest),
    )
    return np.stack(columns, axis=1).astype(np.float64)


@dataclass
class Trees:
    """feature and threshold of each inner node (trees x 2^DEPTH - 1), value of each leaf (trees x 2^DEPTH)."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(inner.bit_length()):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += leaf[at - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> Trees:
    """Gradient boosting with logistic loss; splits come from histograms over quantile bins."""
    inner, leaves = 2**depth - 1, 2**depth
    if not len(y) or y.min() == y.max():
        base = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]
    binned = np.stack([np.searchsorted(e, column, side="left") for e, column in zip(edges, x.T, strict=True)])
    n_features, rate = len(edges), y.mean()
    base = float(np.log(rate / (1 - rate)))
    margin = np.full(len(y), base)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        feature, threshold, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(depth):
            low, width = 2**level - 1, 2**level
            node = at - low
            best = np.zeros(width)
            split = np.full(width, bins + 1)
            for f in range(n_features):
                slot = node * bins + binned[f]
                gs = np.bincount(slot, g, width * bins).reshape(width, bins).cumsum(1)
                hs = np.bincount(slot, h, width * bins).reshape(width, bins).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + RIDGE) + (gt - gs) ** 2 / (ht - hs + RIDGE) - gt**2 / (ht + RIDGE)
                gain[(hs < LEAF_WEIGHT) | (ht - hs < LEAF_WEIGHT)] = 0
                gain[:, len(edges[f]) :] = 0
                cut = gain.argmax(1)
                value = gain[np.arange(width), cut]
                better = value > best + 1e-9
                best[better], split[better] = value[better], cut[better]
                for k in np.flatnonzero(better):
                    feature[low + k], threshold[low + k] = f, edges[f][cut[k]]
            right = binned[feature[at], np.arange(len(y))] > split[node]
            at = 2 * at + 1 + right
        leaf = at - inner
        step = RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + RIDGE)
        margin += step[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(step)
    return Trees(base, np.array(features), np.array(thresholds), np.array(values))


def _measured(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches, with the statistics of their texts, column at. They take many
    times a slice's bytes for a moment, so slices are small."""
    make_room()
    for batch in batches:
        for part in slices(batch, batch.schema.names[at], SLICE_BYTES):
            yield part, statistics(Texts(part.column(at)))


def _with_statistics(rows: DataFrame) -> DataFrame:
    """rid-like first column and text become that column and an array of statistics."""
    key = rows.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _measured(batches, 1):
            flat = pa.ListArray.from_arrays(np.arange(0, found.size + 1, found.shape[1], dtype=np.int32), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), flat], names=[key, "stats"])

    return rows.mapInArrow(run, f"{key} bigint, stats array<double>")


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Trees:
    """Fit on the documents of a bounded sample of labels outside the held-out fold."""
    ship(docs.sparkSession)
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).where(crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT)
    chosen = usable.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    found = _with_statistics(texts).groupBy("doc_id").agg(F.min("stats").alias("stats")).join(F.broadcast(chosen), "doc_id").orderBy("doc_id").toArrow()
    x = np.array(found.column("stats").to_pylist(), dtype=np.float64).reshape(-1, len(FEATURES))
    return fit(x, np.asarray(found.column("quality"), dtype=np.float64))


def _scored(rows: Rows, model: Trees) -> DataFrame:
    inner = rows.df.drop("rid")
    at = inner.columns.index(rows.inner["text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _measured(batches, at):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.score(found))], names=[*part.schema.names, "score"])

    return inner.mapInArrow(run, inner.withColumn("score", F.lit(0.0)).schema)


def with_scores(docs: DataFrame, model: Trees) -> DataFrame:
    """docs with the model's score of each text."""
    rows = Rows(docs, ("doc_id", "text"))
    return _scored(rows, model).select(*rows.back(("score",)), "score")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    scored = with_scores(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select(
        "doc_id", (crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts, with the columns of docs."""
    rows = Rows(docs, ("doc_id", "text"))
    return _scored(rows, train(docs, labels)).where(F.col("score") >= THRESHOLD).select(*rows.back())
