"""Anchors of 100-byte windows, and an index of repeated stretches.

An anchor of a window is the leftmost of its K-byte strings with the smallest hash, so equal windows
have equal anchors at equal places. Consecutive windows that share an anchor form its run.
"""

from __future__ import annotations

import numpy as np

LENGTH = 100
K = 32
WIDTH = LENGTH - K + 1

_B = 0x9E3779B97F4A7C15
_TABLES: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of the 256 bytes, and the first powers of the base and of its inverse modulo 2 ** 64."""
    if "bytes" not in _TABLES:
        _TABLES["bytes"] = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(_B)) | np.uint64(1)
    if len(_TABLES.get("up", ())) < n:
        size = 1 << max(16, int(n).bit_length())
        for name, base in (("up", _B), ("down", pow(_B, -1, 2**64))):
            powers = np.full(size, base, dtype=np.uint64)
            powers[0] = 1
            _TABLES[name] = np.cumprod(powers, dtype=np.uint64)
    return _TABLES["bytes"], _TABLES["up"], _TABLES["down"]


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, run hash, anchor, first window, last window) of every run of a text."""
    n = len(data)
    if n < LENGTH:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, none
    value, up, down = _tables(n + 1)
    text = np.frombuffer(data, dtype=np.uint8)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(value[text] * up[:n], out=total[1:])
    gram = mix((total[K:] - total[:-K]) * down[: n - K + 1])
    low = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(n - K + 1, dtype=np.uint64)
    step = 1
    while step * 2 <= WIDTH:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    windows = n - LENGTH + 1
    low = np.minimum(low[:windows], low[WIDTH - step : WIDTH - step + windows])
    at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.append(first[1:], windows) - 1
    at = at[first]
    stretch = (total[last + LENGTH] - total[first]) * down[first]
    shape = ((at - first) * 256 + (last - first)).astype(np.uint64)
    run = mix(mix(stretch) ^ mix(shape * np.uint64(_B)))
    return gram[at].view(np.int64), run.view(np.int64), at, first, last


def window_hashes(data: bytes) -> np.ndarray:
    """Hashes of all windows of a stretch."""
    n = len(data)
    value, up, down = _tables(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(value[np.frombuffer(data, dtype=np.uint8)] * up[:n], out=total[1:])
    return mix((total[LENGTH:] - total[:-LENGTH]) * down[: n - LENGTH + 1]).view(np.int64)


class RunIndex:
    """Run-length index of several stretches of text.

    The Burrows-Wheeler transform of the stretches is kept by its runs. At the head of each run the
    index samples the text position, the position before it in suffix order (the end of the run above)
    and the length they share. Any other position follows from the sample before it in the text: its
    predecessor in suffix order moves along and the shared length shrinks by one per byte. So one walk
    over the text yields the matching statistics of every position against the rest.
    """

    def __init__(self, stretches: list[bytes]) -> None:
        lengths = np.array([len(s) for s in stretches], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]).astype(np.int64)
        joined = b"\0".join(stretches) + b"\0"
        self.text = np.frombuffer(joined, dtype=np.uint8)
        self.left = np.repeat(self.starts + lengths, lengths + 1) - np.arange(len(self.text))  # bytes to the stretch's end
        order = self._suffix_order()
        before = np.where(np.isin(order, self.starts, assume_unique=True), -1, self.text[order - 1].astype(np.int16))
        head = np.ones(len(order), dtype=bool)
        head[1:] = (before[1:] != before[:-1]) | (before[1:] == -1)
        self.runs = int(head.sum())
        at = np.flatnonzero(head)
        position, above = order[at], np.where(at > 0, order[at - 1], -1)
        shared = self._shared(position, above)
        by_text = np.argsort(position)
        self.sample, self.above, self.shared = position[by_text], above[by_text], shared[by_text]

    def _suffix_order(self) -> np.ndarray:
        """Positions in suffix order, each suffix ending with its stretch; equal ones in text order."""
        n, left = len(self.text), self.left
        symbol = np.where(left > 0, self.text.astype(np.int64) + 1, 0)
        rank, depth = np.zeros(n, dtype=np.int64), 7
        for j in range(depth):  # seven symbols of nine bits
            part = np.zeros(n, dtype=np.int64)
            part[: n - j] = np.where(left[: n - j] > j, symbol[j:], 0)
            rank = (rank << 9) | part
        live = np.flatnonzero(left > 0)
        longest = int(left.max())
        while True:
            keys = rank[live]
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            step = np.zeros(len(keys), dtype=np.int64)
            step[1:] = keys[1:] != keys[:-1]
            named = np.cumsum(step) + 1
            if depth >= longest or named[-1] == len(live):
                return live[order]
            rank = np.zeros(n, dtype=np.int64)
            rank[live[order]] = named
            later = np.zeros(n, dtype=np.int64)
            if depth < n:
                later[: n - depth] = np.where(left[: n - depth] > depth, rank[depth:], 0)
            rank = rank * (len(live) + 2) + later
            depth *= 2

    def _shared(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at p and q share; 0 where q is -1."""
        words = np.zeros(len(self.text) + 8, dtype=np.uint64)
        padded = np.concatenate([self.text, np.zeros(16, dtype=np.uint8)])
        for j in range(8):
            words |= padded[j : j + len(words)].astype(np.uint64) << np.uint64(8 * j)
        most = np.where(q >= 0, np.minimum(self.left[p], self.left[np.maximum(q, 0)]), 0)
        out = np.zeros(len(p), dtype=np.int64)
        going = np.flatnonzero(most > 0)
        while len(going):
            differ = words[p[going] + out[going]] ^ words[q[going] + out[going]]
            lowest = differ & (~differ + np.uint64(1))
            same = np.where(differ == 0, 8, np.log2(np.maximum(lowest, np.uint64(1)).astype(np.float64)).astype(np.int64) // 8)
            out[going] += same
            going = going[(same == 8) & (out[going] < most[going])]
        return np.minimum(out, most)

    def statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For every position its predecessor in suffix order and the length they share."""
        at = np.arange(len(self.text))
        s = np.searchsorted(self.sample, at, side="right") - 1
        moved = at - self.sample[s]
        shared = np.where(self.left > 0, self.shared[s] - moved, 0)
        return np.where(shared > 0, self.above[s] + moved, -1), shared

    def repeats(self, where: np.ndarray, length: int = LENGTH) -> np.ndarray:
        """Whether a position's next `length` bytes also stand at a position with a smaller `where`.

        Predecessors that share the length chain the positions with equal bytes; pointer doubling
        finds the head of each chain, and the head's smallest `where` is the first occurrence.
        """
        above, shared = self.statistics()
        head = np.where(shared >= length, above, np.arange(len(self.text)))
        while True:
            further = head[head]
            if np.array_equal(further, head):
                break
            head = further
        inside = self.left >= length
        first = np.full(len(self.text), np.iinfo(np.int64).max)
        np.minimum.at(first, head[inside], where[inside])
        return inside & (where > first[head])
