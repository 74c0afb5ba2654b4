"""Counts over whole texts, for a slice of a batch at a time, with numpy."""

from __future__ import annotations

import numpy as np

from gridloom.llm.common import SPACE, Texts, mix64, range_names

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
_ODD = np.uint64(0xD6E8FEB86659FD93)


def flags(chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars)] = True
    return table


IS_SYMBOL = flags(SYMBOLS)
IS_HEAD = np.array([(b & 0xC0) != 0x80 for b in range(256)])  # first byte of a code point
IS_WORD_HEAD = IS_HEAD & ~SPACE


def sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of values[s:e] for each range."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[ends] - total[starts]


def repeated_words(names: np.ndarray, first: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """True for words that lie in a window of ``window`` words found twice or more in their text. names: equal
    for equal words alone. Hashes find windows that may be equal, and their names confirm it."""
    n = len(names)
    covered = np.zeros(n, dtype=bool)
    if n < window:
        return covered
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(owner[: n - window + 1] == owner[window - 1 :])
    key = mix64(owner[at].astype(np.uint64) + _ODD)
    for i in range(window):
        key = mix64(key ^ names[at + i].astype(np.uint64))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    near = np.flatnonzero(ranked[1:] == ranked[:-1])
    a, b = at[order[near]], at[order[near + 1]]
    same = owner[a] == owner[b]
    for i in range(window):
        same &= names[a + i] == names[b + i]
    twice = np.zeros(len(at), dtype=bool)
    twice[order[near[same]]] = True
    twice[order[near[same] + 1]] = True
    for g in set(ranked[near[~same]].tolist()):  # several windows under one hash
        found: dict[tuple, list[int]] = {}
        for i in np.flatnonzero(key == g).tolist():
            found.setdefault((int(owner[at[i]]), *names[at[i] : at[i] + window].tolist()), []).append(i)
        for places in found.values():
            twice[places] = len(places) > 1
    begins = at[twice]
    depth = np.bincount(begins, minlength=n + 1) - np.bincount(begins + window, minlength=n + 1)
    return np.cumsum(depth)[:n] > 0


class Stats:
    """Words, lines and the counts that several operators share."""

    def __init__(self, texts: Texts):
        self.texts = texts
        n, data = texts.n, texts.data
        self.starts, self.ends, self.first = texts.words()
        self.word_name = range_names(data, self.starts, self.ends)
        self.n_words = np.diff(self.first)
        begins, stops = texts.offsets[:-1], texts.offsets[1:]
        self.word_chars = sums(IS_WORD_HEAD[data], begins, stops)
        self.n_symbols = sums(IS_SYMBOL[data], begins, stops)
        self.repeated = repeated_words(self.word_name, self.first)
        self.n_repeat_words = sums(self.repeated, self.first[:-1], self.first[1:])
        self.line_starts, self.line_ends, self.first_line = texts.lines()
        self.line_owner = np.repeat(np.arange(n), np.diff(self.first_line))
        self.line_word = np.searchsorted(self.starts, self.line_starts), np.searchsorted(self.starts, self.line_ends)
        self.line_words = self.line_word[1] - self.line_word[0]
        names = range_names(data, self.line_starts, self.line_ends).astype(np.int64)
        once = np.zeros(len(names), dtype=bool)
        once[np.unique(names * n + self.line_owner, return_index=True)[1]] = True
        self.dup_line = ~once & (self.line_words > 0)
        self.n_dup_lines = sums(self.dup_line, self.first_line[:-1], self.first_line[1:])
