"""Quality classifier: an additive model with pairwise terms, grown by cyclic boosting.

Every feature of a text is cut into bins. Boosting goes round the features in turn; each step grows a
tree of a few leaves over the bins of one feature and adds it, shrunk, to that feature's lookup table.
Then the pairs of features that explain most of what is left get tables of their own, grown the same
way with trees that split both. A text is scored by adding one table entry per feature and pair.

The model is learned from at most `MAX_GOOD` and `MAX_BAD` labelled rows with different texts, chosen
by the hash of their ids and weighed back to the share of the labels. Features are measured by tasks;
the tables, a few thousand numbers, are built on the driver from those rows.

Edge cases: a null or empty text has all features 0 and gets the score of that bin; without labels of
both values the score is constant, the share of good labels or one half; a null id is never held out
and has no label; of repeated labels the largest counts; repeated rows score alike; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.llm.common import labelled_sample, remainder
from sitewise.llm.textstats import base_counts

MAX_GOOD, MAX_BAD = 12_000, 12_000
BINS, PAIR_BINS, PAIRS = 48, 12, 10
ROUNDS, PAIR_ROUNDS, RATE, LEAST_ROWS = 250, 120, 0.08, 8

FEATURES = [
    "log_words", "word_chars", "symbol_share", "pipe_share", "dup_line_share", "repeat_share", "upper_share",
    "bang_share", "digit_share", "other_share", "distinct_share", "top_share", "echo_share", "line_words", "stop_share",
]


def text_features(text: str) -> list[float]:
    counts, seen, ids = base_counts(text)
    n, chars = counts["n_words"], max(1, counts["word_chars"])
    if not n:
        return [0.0] * len(FEATURES)
    times = np.bincount(ids)
    ascii_text = text.encode("ascii", "ignore")
    codes = np.bincount(np.frombuffer(ascii_text, dtype=np.uint8), minlength=128)
    upper, lower = int(codes[65:91].sum()), int(codes[97:123].sum())
    return [
        math.log1p(n),
        chars / n,
        counts["n_symbols"] / chars,
        int(codes[124]) / chars,
        counts["n_dup_lines"] / max(1, counts["n_lines"]),
        counts["n_repeat_words"] / n,
        upper / max(1, upper + lower),
        (int(codes[33]) + int(codes[63])) / chars,
        int(codes[48:58].sum()) / chars,
        (len(text) - len(ascii_text)) / chars,
        len(seen) / n,
        float(times.max()) / n,
        float((ids[1:] == ids[:-1]).mean()) if n > 1 else 0.0,
        math.log1p(n / max(1, counts["n_lines"])),
        (int(codes[46]) + int(codes[44])) / n,
    ]


def feature_matrix(texts: list) -> np.ndarray:
    return np.array([text_features(t or "") for t in texts], dtype=np.float64).reshape(len(texts), len(FEATURES))


def cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """Bin edges at quantiles; a value goes to the number of edges below it."""
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


@dataclass
class AdditiveModel:
    start: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for j, (edge, tab) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += tab[np.searchsorted(edge, x[:, j], side="left")]
        coarse = [np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.pair_edges)]
        for (i, j), tab in zip(self.pairs, self.pair_tables, strict=True):
            total += tab[coarse[i], coarse[j]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.raw(x), -30, 30)))


def leaf_values(grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, leaves: int = 4) -> np.ndarray:
    """A tree over ordered bins, grown leaf by leaf at the best gain: the value of every bin."""
    g, h, n = (np.concatenate([[0.0], np.cumsum(v)]) for v in (grad, hess, rows))

    def best(a: int, b: int) -> tuple[float, int]:
        mid = np.arange(a + 1, b)
        ok = mid[(n[mid] - n[a] >= LEAST_ROWS) & (n[b] - n[mid] >= LEAST_ROWS)]
        if not len(ok):
            return 0.0, -1
        part = lambda lo, hi: (g[hi] - g[lo]) ** 2 / (h[hi] - h[lo] + 1.0)
        gain = part(a, ok) + part(ok, b) - part(a, b)
        k = int(np.argmax(gain))
        return float(gain[k]), int(ok[k])

    parts = [(0, len(grad))]
    while len(parts) < leaves:
        gain, cut, at = max((*best(a, b), i) for i, (a, b) in enumerate(parts))
        if gain <= 1e-9:
            break
        a, b = parts.pop(at)
        parts += [(a, cut), (cut, b)]
    out = np.zeros(len(grad))
    for a, b in parts:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1.0)
    return out


def pair_split(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and cell values of the best cut of a grid into four quadrants."""
    pad = lambda v: np.pad(v.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    g2, h2, n2 = pad(g), pad(h), pad(n)
    a, b = np.meshgrid(np.arange(1, g.shape[0]), np.arange(1, g.shape[1]), indexing="ij")
    quads = lambda v: [v[a, b], v[a, -1] - v[a, b], v[-1, b] - v[a, b], v[-1, -1] - v[a, -1] - v[-1, b] + v[a, b]]
    if not a.size:
        return 0.0, np.zeros_like(g)
    gq, hq, nq = quads(g2), quads(h2), quads(n2)
    gain = sum(x**2 / (y + 1.0) for x, y in zip(gq, hq, strict=True)) - g2[-1, -1] ** 2 / (h2[-1, -1] + 1.0)
    gain = np.where(np.minimum.reduce(nq) >= LEAST_ROWS, gain, -1.0)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    if gain[i, j] <= 0:
        return 0.0, np.zeros_like(g)
    value = [float(x[i, j] / (y[i, j] + 1.0)) for x, y in zip(gq, hq, strict=True)]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = value
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> AdditiveModel:
    share = float(np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3))
    model = AdditiveModel(start=math.log(share / (1 - share)))
    model.edges = [cuts(x[:, j], BINS) for j in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    binned = [np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(model.edges)]
    total = np.full(len(y), model.start)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1.0 / (1.0 + np.exp(-np.clip(total, -30, 30)))
        return weight * (y - p), weight * np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for b, tab in zip(binned, model.tables, strict=True):
            grad, hess = slopes()
            sums = [np.bincount(b, weights=v, minlength=len(tab)) for v in (grad, hess, np.ones(len(y)))]
            step = RATE * leaf_values(*sums)
            tab += step
            total += step[b]
    for tab, b in zip(model.tables, binned, strict=True):  # tables are centred, the mean goes to the start
        mean = float((weight * tab[b]).sum() / weight.sum())
        tab -= mean
        model.start += mean

    model.pair_edges = [cuts(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    coarse = [np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(model.pair_edges)]
    size = [len(e) + 1 for e in model.pair_edges]

    def grid(i: int, j: int, grad: np.ndarray, hess: np.ndarray) -> list[np.ndarray]:
        cell = coarse[i] * size[j] + coarse[j]
        return [
            np.bincount(cell, weights=v, minlength=size[i] * size[j]).reshape(size[i], size[j])
            for v in (grad, hess, np.ones(len(y)))
        ]

    grad, hess = slopes()
    gains = sorted(((pair_split(*grid(i, j, grad, hess))[0], i, j) for i, j in combinations(range(x.shape[1]), 2)), reverse=True)
    model.pairs = [(i, j) for gain, i, j in gains[:PAIRS] if gain > 0]
    model.pair_tables = [np.zeros((size[i], size[j])) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), tab in zip(model.pairs, model.pair_tables, strict=True):
            _, step = pair_split(*grid(i, j, *slopes()))
            tab += RATE * step
            total += RATE * step[coarse[i], coarse[j]]
    return model


def measure(docs: DataFrame, columns: list[str]) -> DataFrame:
    """`columns` of `docs` with the features of the texts as an array."""
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                rows = feature_matrix(batch.column("text").to_pylist()).tolist()
                made = pa.array(rows, pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], made], [*columns, "features"])

    return docs.select(*dict.fromkeys([*columns, "text"])).mapInArrow(run, f"{kept}, features array<double>")


def learn(sample: DataFrame, shares: dict[int, int]) -> AdditiveModel:
    """The model from a bounded sample (text, label); `shares` are the labels' counts before sampling."""
    rows = measure(sample, ["label"]).collect()
    y = np.array([r["label"] for r in rows], dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return AdditiveModel(start=0.0 if not len(y) else (3.0 if y[0] else -3.0))
    x = np.array([r["features"] for r in rows])
    order = np.lexsort((*x.T, y))  # rows arrive in any order; sums then come out the same
    x, y = x[order], y[order]
    weight = np.where(y == 1, shares[1] / max(1.0, (y == 1).sum()), shares[0] / max(1.0, (y == 0).sum()))
    return fit(x, y, weight / weight.mean())


def score(docs: DataFrame, model: AdditiveModel, columns: list[str]) -> DataFrame:
    """`columns` of `docs` with the score of the whole text."""
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                made = pa.array(model.score(feature_matrix(batch.column("text").to_pylist())), pa.float64())
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], made], [*columns, "score"])

    return docs.select(*dict.fromkeys([*columns, "text"])).mapInArrow(run, f"{kept}, score double")


def quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted: learned from the labelled rows that aren't held out."""
    left_out = F.coalesce(remainder(folds) == held_out, F.lit(False))
    given = labels.where(~left_out & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    counts = {int(r["quality"]): r["n"] for r in given.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    sample = labelled_sample(docs, labels, "quality", ~left_out, {1: MAX_GOOD, 0: MAX_BAD})
    model = learn(sample, {0: counts.get(0, 0), 1: counts.get(1, 0)})
    scored = score(docs, model, ["doc_id"])
    return scored.select("doc_id", left_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
