"""Counts over one text: words, symbols, repeated lines, repeated five-word windows."""

from __future__ import annotations

import numpy as np

WHITE = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


def words_of(text: str) -> list[bytes]:
    """The words as UTF-8; bytes split at exactly the white space the word rule names."""
    return text.encode("utf-8", "surrogatepass").split()


def number_words(words: list[bytes]) -> tuple[dict[bytes, int], np.ndarray]:
    """Numbers of the distinct words by first appearance, and the text as those numbers."""
    seen: dict[bytes, int] = {}
    ids = [seen.setdefault(w, len(seen)) for w in words]
    return seen, np.array(ids, dtype=np.int64)


def _ranks(codes: np.ndarray) -> tuple[np.ndarray, int]:
    values, ranks = np.unique(codes, return_inverse=True)
    return ranks, len(values)


def repeated_words(ids: np.ndarray, distinct: int, window: int = WINDOW) -> int:
    """Words that lie in a window of `window` words which the text holds twice or more.

    Windows are compared exactly: a window of twice the length is named by the pair of its halves.
    """
    n = len(ids)
    if n < window + 1:
        return 0
    codes, size, length = ids, max(1, distinct), 1
    while length < window:
        step = min(length, window - length)
        codes, size = _ranks(codes[: n - length - step + 1] * size + codes[step : n - length + 1])
        length += step
    twice = np.bincount(codes, minlength=size)[codes] > 1
    if not twice.any():
        return 0
    edges = np.zeros(n + 1, dtype=np.int64)
    starts = np.flatnonzero(twice)
    edges[starts] += 1
    np.subtract.at(edges, starts + window, 1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def repeated_lines(text: str) -> tuple[int, int]:
    """Lines with a word, and those of them equal to an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    return len(lines), len(lines) - len(set(lines))


def base_counts(text: str) -> tuple[dict, dict[bytes, int], np.ndarray]:
    """The counts every rule starts from, with the numbered words."""
    seen, ids = number_words(words_of(text))
    lines, repeats = repeated_lines(text)
    counts = {
        "n_words": len(ids),
        "word_chars": len(text) - sum(map(text.count, WHITE)),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_lines": lines,
        "n_dup_lines": repeats,
        "n_repeat_words": repeated_words(ids, len(seen)),
    }
    return counts, seen, ids
