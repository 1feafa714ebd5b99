"""Statistics of one text, computed on first use and kept: for quality rules and the quality classifier."""

from __future__ import annotations

import re
from collections import Counter
from functools import cached_property
from itertools import count

import numpy as np

from .common import WORD_RE

SYMBOLS = "#*$%&|<>"
WINDOW = 8
_POWERS = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(WINDOW)], dtype=np.uint64)
_LOWER = re.compile("[a-z]+")
_UPPER = re.compile("[A-Z]+")
_DIGIT = re.compile("[0-9]+")


class TextStats:
    """Lazy statistics of a text; null counts as empty."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[str]:
        return WORD_RE.findall(self.text)

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, " \t\n\v\f\r"))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        """Lines with a word."""
        return [x for x in self.text.split("\n") if WORD_RE.search(x)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_lower(self) -> int:
        return sum(map(len, _LOWER.findall(self.text)))

    @cached_property
    def n_upper(self) -> int:
        return sum(map(len, _UPPER.findall(self.text)))

    @cached_property
    def n_digits(self) -> int:
        return sum(map(len, _DIGIT.findall(self.text)))

    @cached_property
    def n_exclaim(self) -> int:
        return self.text.count("!")

    @cached_property
    def word_ids(self) -> np.ndarray:
        """Each word as the position at which it first stands."""
        first: dict[str, int] = {}
        return np.fromiter(map(first.setdefault, self.words, count()), dtype=np.int64, count=self.n_words)

    @cached_property
    def top_word(self) -> int:
        """How often the most frequent word stands."""
        return max(Counter(self.words).values(), default=0)

    @cached_property
    def n_bullets(self) -> int:
        """Lines with a word that start with a bullet."""
        return sum(x.lstrip(" \t").startswith(("-", "*", "\u2022")) for x in self.lines)

    @cached_property
    def n_ellipses(self) -> int:
        """Lines with a word that end in three dots."""
        return sum(x.rstrip(" \t\v\f\r").endswith(("...", "\u2026")) for x in self.lines)

    @cached_property
    def n_distinct_words(self) -> int:
        return len(set(self.words))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside windows of eight words that stand in the text twice or more, the first included.

        Equal windows have equal hashes, so a text without equal hashes is done; the others'
        repeated windows are compared word by word.
        """
        if self.n_words <= WINDOW:
            return 0
        v = np.lib.stride_tricks.sliding_window_view(self.word_ids, WINDOW)
        h = np.zeros(len(v), dtype=np.uint64)
        for i in range(WINDOW):
            h += v[:, i].astype(np.uint64) * _POWERS[i]
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        if not same.any():
            return 0
        twice = np.zeros(len(v), dtype=bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        groups: dict[bytes, list[int]] = {}
        for i in np.flatnonzero(twice):
            groups.setdefault(v[i].tobytes(), []).append(i)
        edge = np.zeros(self.n_words + 1, dtype=np.int64)
        for g in groups.values():
            if len(g) > 1:
                edge[g] += 1
                edge[np.asarray(g) + WINDOW] -= 1
        return int((np.cumsum(edge) > 0).sum())
