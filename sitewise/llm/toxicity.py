"""Toxicity by a weighted lexicon matched with an Aho-Corasick automaton.

Texts are folded first: lower case, look-alike letters of other scripts and full-width forms to Latin,
digits and signs that stand for letters to those letters. The automaton holds word beginnings with
weights and exception phrases; a word counts with the heaviest beginning that matches it, unless it
lies inside an exception phrase. The weights of a text are summed and divided by its length; a logistic
curve over that density gives the score.

Lexicon, exceptions and curve are learned from labelled rows: at most `MAX_TOXIC` toxic and
`MAX_CLEAN` other ones with different texts, chosen by the hash of their ids. The weight of a word
beginning is the log ratio of its rates in toxic and other texts, each taken at the cautious end of its
error. Exception phrases are three-word phrases around a match that several clean texts share and
toxic texts lack.

Edge cases: a null or empty text scores the lowest density; a table without toxic or without clean
labels gives a constant score below one half; a null id is never held out and has no label; of
repeated labels the largest counts; repeated rows score alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from sitewise.llm.common import labelled_sample, remainder
from sitewise.llm.rows import append_struct
from sitewise.operators.staging import write_and_read

MAX_TOXIC, MAX_CLEAN = 6_000, 18_000
MAX_PATTERNS, MAX_EXCEPTIONS = 5_000, 1_000
SHORTEST, LONGEST = 4, 12
MIN_WEIGHT, MIN_COUNT = 2.0, 4
EXCEPTION_TEXTS = 5
#: Times a word of one text counts, so that a text which repeats a word isn't many witnesses.
MOST_PER_TEXT = 2
#: Distinct word beginnings a counting task holds before it hands on its counts.
COUNTS_HELD = 400_000

# Letters that look like Latin ones, and signs used for letters.
HOMOGLYPHS = {
    "а": "a", "е": "e", "ё": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j",
    "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "к": "k", "м": "m", "т": "t", "н": "h", "в": "b", "г": "r",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
    "χ": "x", "ω": "w", "ϲ": "c", "ı": "i", "ſ": "s",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
#: Signs around a word that aren't part of it.
EDGES = ".,;:?!\"'()[]{}<>*#%&|-_"


def fold_table() -> dict[int, str]:
    wide = {0xFF00 + i: chr(0x20 + i) for i in range(0x21, 0x5F)}
    table = {ord(k): v for k, v in (HOMOGLYPHS | SUBSTITUTES).items()}
    invisible = {0x200B: "", 0x200C: "", 0x200D: "", 0xFEFF: "", 0xAD: ""}
    return {k: table.get(ord(v.lower()), v.lower()) for k, v in wide.items()} | table | invisible


_FOLD = fold_table()


def folded_words(text: str) -> list[str]:
    """The folded words; signs at the edges of a word go before digits and signs become letters."""
    words = (w.strip(EDGES) for w in text.lower().split())
    return " ".join(w for w in words if w).translate(_FOLD).split()


@dataclass
class ToxicityModel:
    patterns: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    coefficients: tuple[float, ...] = (-4.0, 0.0, 0.0)
    words_per_hit: float = 20.0

    def automaton(self):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for pattern, weight in self.patterns.items():
            machine.add_word(" " + pattern, (len(pattern) + 1, weight))
        for phrase in self.exceptions:
            machine.add_word(f" {phrase} ", (len(phrase) + 2, 0.0))
        if len(machine):
            machine.make_automaton()
        return machine


def hits(machine, words: list[str]) -> tuple[dict[int, float], str]:
    """Weight by the place of each matching word, exceptions left out, in the joined words."""
    line = " " + " ".join(words) + " "
    found: dict[int, float] = {}
    excused: list[tuple[int, int]] = []
    if len(machine):
        for end, (length, weight) in machine.iter(line):
            start = end - length + 1
            if weight == 0.0:
                excused.append((start, end))
            elif weight > found.get(start, 0.0):
                found[start] = weight
    for start, end in excused:
        for place in [p for p in found if start <= p < end]:
            del found[place]
    return found, line


def features(weight: float, words: int) -> tuple[float, float]:
    """Density of the weights, on a log scale, and their sum."""
    return math.log1p(100.0 * weight / (words + 5.0)), math.log1p(weight)


def score_of(model: ToxicityModel, weight: float, words: int) -> float:
    a, b, c = model.coefficients
    x, y = features(weight, words)
    return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, a + b * x + c * y))))


SCORE = StructType([StructField("n_words", LongType()), StructField("weight", DoubleType()), StructField("score", DoubleType())])


def score_texts(model: ToxicityModel):
    machine = model.automaton()

    def score(texts: list) -> list[dict]:
        out = []
        for text in texts:
            words = folded_words(text or "")
            found, _ = hits(machine, words)
            weight = float(sum(found.values()))
            out.append({"n_words": len(words), "weight": weight, "score": score_of(model, weight, len(words))})
        return out

    return score


def _count_patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def flush() -> pa.RecordBatch:
        keys = list(counts)
        made = pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in keys], pa.string()), pa.array([t for _, t in keys], pa.int32()), pa.array([counts[k] for k in keys], pa.int64())],
            ["pattern", "label", "n"],
        )
        counts.clear()
        return made

    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = folded_words(text)
            counts[" ", label] += len(words)
            for word, n in Counter(words).items():
                for length in range(SHORTEST, min(len(word), LONGEST) + 1):
                    counts[word[:length], label] += min(n, MOST_PER_TEXT)
            if len(counts) > COUNTS_HELD:
                yield flush()
    yield flush()


def learn_patterns(sample: DataFrame) -> dict[str, float]:
    """Word beginnings with weights, heaviest evidence first, without those a shorter one stands for."""
    counts = sample.select("text", "label").mapInArrow(_count_patterns, "pattern string, label int, n long")
    per = counts.groupBy("pattern").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("bad"),
        F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("good"),
    )
    per = write_and_read(per.where(f"bad >= {MIN_COUNT}"), "patterns")
    total = per.where("pattern = ' '").first()
    if total is None or not total["bad"] or not total["good"]:
        return {}
    rate = (F.col("bad") - 2 * F.sqrt("bad")) / total["bad"]
    other = (F.col("good") + 2 * F.sqrt("good") + 1) / total["good"]
    weighed = per.where("pattern <> ' ' and bad > 4").withColumn("weight", F.log(rate / other))
    best = weighed.where(f"weight >= {MIN_WEIGHT}").orderBy(F.desc(F.col("weight") * F.sqrt("bad")), "pattern")
    out: dict[str, float] = {}
    rows = best.limit(MAX_PATTERNS).collect()
    # A beginning whose matches nearly all go on alike gives way to the longer one.
    most: dict[str, int] = {}
    for r in rows:
        most[r["pattern"][:-1]] = max(r["bad"], most.get(r["pattern"][:-1], 0))
    rows = [r for r in rows if most.get(r["pattern"], 0) < 0.9 * r["bad"]]
    for r in sorted(rows, key=lambda r: (len(r["pattern"]), r["pattern"])):
        shorter = [out[r["pattern"][:n]] for n in range(SHORTEST, len(r["pattern"])) if r["pattern"][:n] in out]
        if not shorter or r["weight"] > max(shorter) + 0.3:
            out[r["pattern"]] = float(r["weight"])
    return out


def learn_exceptions(sample: DataFrame, model: ToxicityModel) -> tuple[str, ...]:
    """Phrases of a match and its neighbours that clean texts share and toxic ones lack."""

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = model.automaton()
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found, line = hits(machine, folded_words(text))
                made = set()
                for place in found:
                    before = line[max(0, place - 60) : place].split(" ")[-1:]
                    after = line[place + 1 : place + 121].split(" ")[:2]
                    made.add(" ".join([*before, *after]).strip())
                made = sorted(p for p in made if p)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(made, pa.string()), pa.array([label] * len(made), pa.int32())], ["phrase", "label"]
                )

    rows = sample.select("text", "label").mapInArrow(phrases, "phrase string, label int").groupBy("phrase")
    rows = rows.agg(F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good"))
    rows = rows.where(f"bad = 0 and good >= {EXCEPTION_TEXTS}").orderBy(F.desc("good"), "phrase").limit(MAX_EXCEPTIONS)
    return tuple(r["phrase"] for r in rows.collect())


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Newton steps of a logistic regression with intercept."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - ridge * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(sample: DataFrame) -> ToxicityModel:
    """The model from a bounded sample (text, label)."""
    patterns = learn_patterns(sample)
    if not patterns:
        return ToxicityModel()
    model = ToxicityModel(patterns)
    model.exceptions = learn_exceptions(sample, model)
    rows = append_struct(sample, "_s", SCORE, lambda: score_texts(model)).select("label", "_s.n_words", "_s.weight").collect()
    x = np.array([features(r["weight"], r["n_words"]) for r in rows])
    y = np.array([r["label"] for r in rows], dtype=float)
    model.coefficients = tuple(float(v) for v in fit_logistic(x, y))
    return model


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """`docs` with the struct `_s` (n_words, weight, score)."""
    return append_struct(docs, "_s", SCORE, lambda: score_texts(model))


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted, n_words, weight: learned from the rows that aren't held out."""
    left_out = F.coalesce(remainder(folds) == held_out, F.lit(False))
    sample = labelled_sample(docs, labels, "toxic", ~left_out, {1: MAX_TOXIC, 0: MAX_CLEAN})
    scored = score(docs.select("doc_id", "text"), learn(sample))
    return scored.select(
        "doc_id", left_out.alias("held_out"), F.col("_s.score").alias("score"),
        (F.col("_s.score") >= 0.5).cast("int").alias("predicted"), "_s.n_words", "_s.weight",
    )
