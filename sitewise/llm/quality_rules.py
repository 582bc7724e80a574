"""Quality rules by tokeniser fertility.

Two public vocabularies measure every whole text. A byte-level BPE gives characters per token and
the entropy of its tokens; a piece vocabulary with byte fallback gives the share of pieces that are
bare bytes. A text is rejected when a measure falls outside the band of its language: the median of
the corpus plus or minus a multiple of the quartile range, with a least width, so a band follows what
is usual for the language. Quartiles are shrunk towards reference ones of the language, or else of its
script, as if `PRIOR` reference documents stood in the table; where a corpus differs from the reference
the band is widened by the doubt between the two. One rule holds at every size, so a language is judged
in a small table as well.

Words are tokenised one by one with a leading space, as both vocabularies treat words inside running
text, so the tokens of a word are looked up in a bounded store.

Edge cases: a null or empty text has no words and fails the base rule; texts with few tokens have
wider bands; a null or empty language is its script; repeated rows are judged alike; an empty table gives
an empty result; extra columns pass through `judge`.
"""

from __future__ import annotations

import base64
import math
import os

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from sitewise.llm.common import null_safe_join
from sitewise.llm.rows import append_struct
from sitewise.llm.textstats import base_counts
from sitewise.operators.staging import staging_path, write_and_read

TOKENIZERS = "/opt/tokenizers"
BPE_FILE = "byte_bpe_multi_50k.tiktoken"
PIECE_FILE = "piece_bpe_32k.model"
#: Fixed value: how the byte-level vocabulary cuts text before merging.
BPE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct words whose tokens a worker remembers; beyond that it starts anew.
WORDS_KEPT = 400_000

#: Groups whose bands are broadcast; bands of more groups are joined over this many salts.
MOST_BANDS, SALTS = 10_000, 16

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Texts below so many tokens don't shape a band.
MIN_TOKENS = 64
#: Below so many tokens the band widens, by the root of the share that is missing.
STEADY_TOKENS = 160
#: Documents that a reference counts for.
PRIOR = 50
#: Band half-width: this multiple of the quartile range, and at least this share of the median.
RANGES, LEAST = 4.0, 0.05
#: Bits beyond which a longer text isn't expected to become more varied.
FULL_ENTROPY = 6.5
#: A share of bare bytes up to this is never rejected.
BYTE_SHARE_FLOOR = 0.15
#: Lower quartile, median and upper quartile of characters per token, byte share and relative entropy:
#: those of all documents of sf0.1 with `MIN_TOKENS`.
LANGUAGE_REFERENCE = {
    "de": ((2.270, 2.305, 2.333), (0.0, 0.0, 0.0), (0.959, 1.001, 1.027)),
    "en": ((2.190, 2.224, 2.249), (0.0, 0.0, 0.0), (0.965, 1.017, 1.048)),
    "es": ((2.021, 2.057, 2.081), (0.0, 0.0, 0.0), (0.938, 0.993, 1.020)),
    "fr": ((2.000, 2.035, 2.060), (0.0, 0.0, 0.0), (0.949, 0.991, 1.018)),
}
#: Medians alone for other languages, by script: the first article of the Declaration of Human Rights in
#: en, it, pt, nl, sv, pl, tr (median); ru, uk (mean); el; he; ar; hi; th; ja; zh; ko. "Other" is a guess.
SCRIPT_REFERENCE = {
    "Latin": (2.77, 0.0, 0.946), "Greek": (1.70, 0.0, 0.926), "Cyrillic": (2.44, 0.0, 0.920), "Hebrew": (1.49, 0.0, 0.910),
    "Arabic": (1.49, 0.0, 0.898), "Devanagari": (0.795, 0.076, 0.735), "Thai": (1.02, 0.022, 0.825),
    "Kana": (1.05, 0.098, 0.914), "Han": (0.896, 0.0, 0.963), "Hangul": (1.05, 0.033, 0.969), "Other": (1.50, 0.6, 0.8),
}
#: Quartiles of a script stand off its median by this share of it.
SCRIPT_SPREAD, OTHER_SPREAD = 0.05, 0.1

LONGS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_tokens"]
DOUBLES = ["chars_per_token", "byte_share", "rel_entropy"]
SCHEMA = StructType(
    [StructField(n, LongType()) for n in LONGS]
    + [StructField(n, DoubleType()) for n in DOUBLES]
    + [StructField("script", StringType())]
)

#: First and last letter of the blocks told apart; what lies in none is "Other".
SCRIPTS = [
    ("Latin", 0x41, 0x24F), ("Greek", 0x370, 0x3FF), ("Cyrillic", 0x400, 0x52F), ("Hebrew", 0x590, 0x5FF),
    ("Arabic", 0x600, 0x6FF), ("Devanagari", 0x900, 0x97F), ("Thai", 0xE00, 0xE7F), ("Kana", 0x3040, 0x30FF),
    ("Han", 0x4E00, 0x9FFF), ("Hangul", 0xAC00, 0xD7AF),
]


class WordTokens:
    """Tokens of single words, remembered in flat arrays."""

    def __init__(self, folder: str, words_kept: int = WORDS_KEPT) -> None:
        import sentencepiece
        import tiktoken

        with open(os.path.join(folder, BPE_FILE), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bpe = tiktoken.Encoding("words", pat_str=BPE_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, PIECE_FILE))
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])
        self.opens_word = np.array([self.pieces.id_to_piece(i)[:1] == "\u2581" for i in range(len(self.is_byte))])
        self.opens_bpe = np.zeros(max(ranks.values()) + 1, dtype=bool)
        self.opens_bpe[[i for token, i in ranks.items() if token[:1] == b" "]] = True
        self.words_kept = words_kept
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 20, dtype=np.int32)
        self.start, self.count, self.n_pieces, self.n_bytes = (np.zeros(1 << 18, dtype=np.int32) for _ in range(4))
        self.used = 0

    def _pieces_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces and bare bytes of each word. The words are encoded as one line where that keeps them
        apart, and one by one where a character of theirs is normalised to white space."""
        ids = np.array(self.pieces.encode(" ".join(texts), num_threads=1), dtype=np.int64)
        word = np.cumsum(self.opens_word[ids]) - 1
        if not len(word) or word[0] != 0 or word[-1] != len(texts) - 1:
            apart = [np.array(x, dtype=np.int64) for x in self.pieces.encode(texts, num_threads=1)]
            word = np.repeat(np.arange(len(texts)), [len(x) for x in apart])
            ids = np.concatenate([*apart, np.zeros(0, dtype=np.int64)])
        bare = np.bincount(word, weights=self.is_byte[ids], minlength=len(texts))
        return np.bincount(word, minlength=len(texts)), bare.astype(np.int64)

    def learn(self, words: list[bytes]) -> None:
        """Store the tokens of new words. A word's first token starts with the space before it."""
        texts = [w.decode("utf-8", "replace") for w in words]
        n, i = len(words), len(self.index)
        tokens = np.array(self.bpe.encode_ordinary(" " + " ".join(texts)), dtype=np.int32)
        first = np.flatnonzero(self.opens_bpe[tokens])
        if len(first) != n:
            apart = [self.bpe.encode_ordinary(" " + t) for t in texts]
            tokens = np.array([t for x in apart for t in x], dtype=np.int32)
            first = np.cumsum([0, *(len(x) for x in apart[:-1])])
        while i + n > len(self.start):
            for name in ("start", "count", "n_pieces", "n_bytes"):
                setattr(self, name, np.concatenate([getattr(self, name), np.zeros(len(self.start), dtype=np.int32)]))
        while self.used + len(tokens) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(tokens)] = tokens
        self.start[i : i + n] = self.used + first
        self.count[i : i + n] = np.diff(np.append(first, len(tokens)))
        self.n_pieces[i : i + n], self.n_bytes[i : i + n] = self._pieces_of(texts)
        self.used += len(tokens)
        self.index.update(zip(words, range(i, i + n), strict=True))

    def prepare(self, vocabularies: list[dict[bytes, int]]) -> None:
        """Make sure that the words of a batch of texts are stored."""
        if len(self.index) > self.words_kept:
            self.clear()
        new = dict.fromkeys(w for seen in vocabularies for w in seen if w not in self.index)
        if new:
            self.learn(list(new))

    def measure(self, seen: dict[bytes, int], ids: np.ndarray) -> tuple[int, int, int, float]:
        """Tokens, pieces, pieces that are bytes, and token entropy in bits, of a text whose words are stored."""
        at = np.fromiter(map(self.index.__getitem__, seen), dtype=np.int64, count=len(seen))
        times = np.bincount(ids, minlength=len(at))
        length = self.count[at]
        first = np.repeat(self.start[at] - np.cumsum(length) + length, length)
        tokens = self.flat[first + np.arange(len(first))]
        order = np.argsort(tokens)
        sorted_tokens = tokens[order]
        heads = np.flatnonzero(np.concatenate([[True], sorted_tokens[1:] != sorted_tokens[:-1]]))
        share = np.add.reduceat(np.repeat(times, length)[order], heads).astype(np.float64)
        total = int(share.sum())
        share /= total
        entropy = float(-(share * np.log2(share)).sum())
        return total, int((self.n_pieces[at] * times).sum()), int((self.n_bytes[at] * times).sum()), entropy


_STORES: dict[str, WordTokens] = {}


def store(folder: str) -> WordTokens:
    """One store per worker process: workers serve many tasks."""
    if folder not in _STORES:
        _STORES[folder] = WordTokens(folder)
    return _STORES[folder]


def script_of(text: str) -> str:
    """The script with the most letters."""
    letters = sum(text.count(c) for c in "aeinorst")
    if letters * 4 > len(text):
        return "Latin"
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sums = [((codes >= a) & (codes <= b)).sum() for _, a, b in SCRIPTS]
    best = int(np.argmax(sums))
    return SCRIPTS[best][0] if sums[best] else "Other"


def measure_texts(folder: str):
    tokens = store(folder)

    def measure(texts: list) -> list[dict]:
        out = []
        texts = [text or "" for text in texts]
        counted = [base_counts(text) for text in texts]
        tokens.prepare([seen for _, seen, _ in counted])
        for text, (row, seen, ids) in zip(texts, counted, strict=True):
            n, pieces, bare, entropy = tokens.measure(seen, ids) if len(ids) else (0, 0, 0, 0.0)
            out.append(
                row
                | {
                    "n_tokens": n,
                    "chars_per_token": row["word_chars"] / n if n else 0.0,
                    "byte_share": bare / pieces if pieces else 0.0,
                    "rel_entropy": entropy / min(math.log2(n), FULL_ENTROPY) if n > 1 else 0.0,
                    "script": script_of(text),
                }
            )
        return out

    return measure


def _quartiles(judged: DataFrame, group: str) -> DataFrame:
    """Per group and measure: documents and quartiles, from counts of values rounded to 3 decimals."""
    values = judged.select(
        F.col(group).alias("grp"),
        F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.round(m, 3).alias("v")) for m in DOUBLES])).alias("x"),
    ).select("grp", "x.m", "x.v")
    counts = values.groupBy("grp", "m", "v").agg(F.count("*").alias("n"))
    per = Window.partitionBy("grp", "m")
    upto = F.sum("n").over(per.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counts = counts.withColumn("_upto", upto).withColumn("_all", F.sum("n").over(per))
    quarter = [F.min(F.when(F.col("_upto") >= F.col("_all") * q, F.col("v"))).alias(f"q{i}") for i, q in enumerate((0.25, 0.5, 0.75))]
    return counts.groupBy("grp", "m").agg(F.max("_all").alias("docs"), *quarter)


def _reference(lang: Column, script: Column) -> Column:
    """Array of the three reference quartiles of each measure; the language's, or else the script's."""
    known = {lang: [x for q in rows for x in q] for lang, rows in LANGUAGE_REFERENCE.items()}
    for name, medians in SCRIPT_REFERENCE.items():
        off = OTHER_SPREAD if name == "Other" else SCRIPT_SPREAD
        known[f"script {name}"] = [m * f for m in medians for f in (1 - off, 1.0, 1 + off)]
    table = F.create_map(*[x for k, v in known.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.try_element_at(table, lang), F.try_element_at(table, F.concat(F.lit("script "), script)))


def _band(docs: Column, own: list[Column], reference: list[Column]) -> tuple[Column, Column]:
    """Middle and half-width from quartiles of `docs` documents and reference ones."""
    share = docs / (docs + PRIOR)
    q0, q1, q2 = (share * a + (1 - share) * b for a, b in zip(own, reference, strict=True))
    doubt = F.abs(own[1] - reference[1]) * F.sqrt(share * (1 - share))
    return q1, F.greatest((q2 - q0) * RANGES, q1 * LEAST) + doubt


def _outside(measure: str, value: Column, tokens: Column, middle: Column, half: Column) -> Column:
    """Whether a value lies outside its band, which is wider for a short text."""
    half = half * F.sqrt(F.greatest(F.lit(1.0), F.lit(float(STEADY_TOKENS)) / tokens))
    low, high = value < middle - half, value > middle + half
    if measure == "byte_share":
        return high & (value > BYTE_SHARE_FLOOR)
    return low if measure == "rel_entropy" else low | high


def bands(judged: DataFrame) -> DataFrame:
    """One row per `_group`: middle and half-width of each measure, with the reference of its commonest script."""
    q = _quartiles(judged, "_group")
    common = judged.groupBy(F.col("_group").alias("grp")).agg(F.mode("_script", True).alias("script"))
    q = q.join(common, "grp").withColumn("ref", _reference(F.col("grp"), F.col("script")))
    sides = []
    for i, m in enumerate(DOUBLES):
        reference = [F.col("ref")[3 * i + k] for k in range(3)]
        pair = _band(F.col("docs"), [F.col("q0"), F.col("q1"), F.col("q2")], reference)
        sides += [F.max(F.when(F.col("m") == m, c)).alias(f"_{m}_{s}") for s, c in zip(("middle", "half"), pair, strict=True)]
    return q.groupBy(F.col("grp").alias("_group")).agg(*sides)


def with_bands(rows: DataFrame, own: DataFrame, most: int = MOST_BANDS, salts: int = SALTS) -> DataFrame:
    """`rows` with the bands of their group; the texts stay in the files they lie in.

    The bands are written and counted: up to `most` groups are broadcast. More are joined over salted keys,
    so that the rows of a common language are dealt to `salts` tasks at least.
    """
    own = write_and_read(own, "bands")
    if own.count() <= most:
        return null_safe_join(rows, F.broadcast(own), ["_group"], "left")
    salt = F.explode(F.array(*[F.lit(i) for i in range(salts)]))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("_m"), F.lit(salts)).cast("int"))
    return null_safe_join(salted, own.withColumn("_salt", salt), ["_group", "_salt"], "left").drop("_salt")


def measured(docs: DataFrame, folder: str = TOKENIZERS, text: bool = True) -> DataFrame:
    """(_row, _m): the rows of `docs` as a struct and their measures, written once; `text` False leaves the text out."""
    packed = docs.select(F.struct(*docs.columns).alias("_row"))
    out = append_struct(packed, "_m", SCHEMA, lambda: measure_texts(folder), text="_row.text")
    if not text:
        out = out.withColumn("_row", F.col("_row").dropFields("text"))
    path = staging_path(docs.sparkSession, "measured")
    out.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)


def judged_rows(docs: DataFrame, folder: str = TOKENIZERS, text: bool = True) -> DataFrame:
    """(_row, _m, _v): the rows of `docs` as a struct, their measures, and base_failed, kept and failed_rule."""
    rows = measured(docs, folder, text).withColumn("_script", F.col("_m.script"))
    lang = F.nullif(F.lower(F.col("_row.lang")), F.lit(""))
    rows = rows.withColumn("_group", F.coalesce(lang, F.concat(F.lit("script "), "_script")))
    own = bands(rows.where(F.col("_m.n_tokens") >= MIN_TOKENS).select("_group", "_script", "_m.*"))
    rows = with_bands(rows, own).withColumn("_ref", _reference(F.col("_group"), F.col("_script")))

    m = F.col("_m")
    base = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
    failed = F.when(base, F.lit("base"))
    for i, name in enumerate(DOUBLES):
        reference = [F.col("_ref")[3 * i + k] for k in range(3)]
        alone = _band(F.lit(0), reference, reference)  # of a group whose texts are all short
        middle, half = (F.coalesce(f"_{name}_{s}", c) for s, c in zip(("middle", "half"), alone, strict=True))
        failed = failed.when(_outside(name, m[name], m["n_tokens"], middle, half), F.lit(name))
    verdict = F.struct(base.alias("base_failed"), failed.isNull().alias("kept"), failed.alias("failed_rule"))
    return rows.select("_row", "_m", verdict.alias("_v"))


def judge(docs: DataFrame, folder: str = TOKENIZERS, text: bool = True) -> DataFrame:
    """`docs` with the struct columns `_m` (measures) and `_v` (verdict), which replace columns of these names."""
    kept = [f"_row.`{c}`" for c in docs.columns if c not in ("_m", "_v") and (text or c != "text")]
    return judged_rows(docs, folder, text).select(*kept, "_m", "_v")


def keep_good(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """The rows of `docs` that pass, with their columns."""
    return judged_rows(docs, folder).where("_v.kept").select("_row.*")
