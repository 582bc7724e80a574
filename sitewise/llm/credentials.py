"""Secrets in texts: fixed patterns, and values next to credential names by the cost of guessing them.

A value that follows a credential name (or stands as the password of a URL) is cut into the sequence of
parts that is cheapest to guess: dictionary words, dates, repeats, keyboard walks and brute-force
stretches. The cost is in bits, and the cheapest cut comes from a dynamic programme over its end
positions. Values of `LEAST_BITS` or more are reported as kind `guess`; placeholders such as
`password: changeme` fall below. Spans of the fixed patterns are reported whatever they cost.

The dictionary is the corpus: a word of 3 to 32 letters costs the log of its share of all words outside
such values. One pass over the texts writes spans, values and a word count per batch; only the pieces of
distinct values are joined to the counts, so neither dictionary nor values are broadcast or collected.
Verdicts go back to the documents over salted keys, so a value that a third of all documents hold is split.

Edge cases. A null or empty text has no spans. Offsets are code points, ends exclusive. Repeated rows,
null and repeated ids are judged row by row. Text outside values feeds the dictionary, so equal texts
get equal spans in one run. Very long values cost time in proportion to their length. An empty table gives
an empty result. Every other column is dropped, so names can't clash.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from sitewise.operators.staging import write_and_read

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Names that a value may follow, in lower case; a text without any of their stems needs no search.
STEMS = ("pass", "pwd", "secret", "token", "credential", "auth", "key", "://")
VALUE = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth(?:orization)?|(?:api|access|private|signing|encryption)[_\-\x20]?key)"""
    r"""["'\])]{0,2}\x20{0,4}(?::=|=>|[:=]|\x20is\x20)\x20{0,4}(?:(?:bearer|basic)\x20{1,4})?["'`]?([^\x00-\x20"'`<>,;]{6,})"""
    r"""|[a-z][a-z0-9+.-]{1,20}://[^\s:/@"'<>]{1,64}:([^\s/@"'<>]{6,})@""",
    re.IGNORECASE | re.ASCII,
)
LEAST_BITS = 36.0
SHORTEST_WORD, LONGEST_WORD = 3, 32
WORD = re.compile(rf"[^\W\d_]{{{SHORTEST_WORD},}}")
SALTS = 16

# Cost of guessing ------------------------------------------------------------------------------------

PART_BITS = 1.0  # each part: where it ends
REPEAT_BITS = 4.0  # how often a unit is repeated
LONGEST_UNIT = 16
WALK_START_BITS, TURN_BITS, STRAIGHT_BITS = math.log2(47), 3.0, 0.5
DATE_BITS, YEAR_BITS, SEPARATOR_BITS = math.log2(200 * 366), math.log2(200), 2.0
LEET = str.maketrans("0134578@$!", "oieastbasi")
#: Rows of a keyboard and how far each stands in, in key widths.
ROWS = (("1234567890-=", 0.0), ("qwertyuiop[]", 0.5), ("asdfghjkl;'", 0.75), ("zxcvbnm,./", 1.25))
KEYS = {c: (r, i + shift) for r, (row, shift) in enumerate(ROWS) for i, c in enumerate(row)}
_YEAR = r"(?:19|20)\d\d"
_MONTH, _DAY = r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12]\d|3[01])"
_LOOSE_MONTH, _LOOSE_DAY = r"(?:1[0-2]|0?[1-9])", r"(?:3[01]|[12]\d|0?[1-9])"
_SEP = r"[-/._]"


def _orders(year: str, month: str, day: str, between: str) -> str:
    return "|".join(between.join(o) for o in ((year, month, day), (day, month, year), (month, day, year)))


#: Whole dates: the lengths they may have, and their bits.
DATES = [
    (re.compile(_YEAR), (4,), YEAR_BITS),
    (re.compile("|".join(_orders(y, _MONTH, _DAY, "") for y in (_YEAR, r"\d\d"))), (6, 8), DATE_BITS),
    (
        re.compile("|".join(_orders(y, _LOOSE_MONTH, _LOOSE_DAY, _SEP) for y in (_YEAR, r"\d\d"))),
        (6, 7, 8, 9, 10),
        DATE_BITS + SEPARATOR_BITS,
    ),
]


def lower(text: str) -> str:
    """Lower case of the same length."""
    return "".join(low if len(low := c.lower()) == 1 else c for c in text)


def char_bits(c: str) -> float:
    if c.isdigit():
        return math.log2(10)
    if c.isascii():
        return math.log2(26) if c.isalpha() else math.log2(33)
    return math.log2(1000)


def pieces(value: str) -> list[str]:
    """Every stretch of letters that could be a dictionary word, digit substitutions undone."""
    plain = lower(value).translate(LEET)
    out = set()
    for i in range(len(plain)):
        for j in range(i, min(len(plain), i + LONGEST_WORD)):
            if not plain[j].isalpha():
                break
            if j - i + 1 >= SHORTEST_WORD:
                out.add(plain[i : j + 1])
    return sorted(out)


def writing_bits(text: str) -> float:
    """Bits for capitals and digit substitutions of a word as written."""
    low = lower(text)
    swapped = sum(a != b for a, b in zip(low, low.translate(LEET)))
    upper = sum(a != b for a, b in zip(text, low))
    if not upper:
        return float(swapped)
    plain = text[1:] == low[1:] or upper == sum(c.isalpha() for c in text)
    return swapped + 1.0 + (0 if plain else min(upper, len(text) - upper))


def step(a: str, b: str) -> tuple[int, int] | None:
    """Direction from one key to a neighbouring one; None if they aren't neighbours."""
    if a == b or a not in KEYS or b not in KEYS:
        return None
    (r, x), (s, y) = KEYS[a], KEYS[b]
    if abs(r - s) > 1 or abs(x - y) > 1:
        return None
    return s - r, (y > x) - (y < x)


def guess_cost(value: str, word_bits: Callable[[str], float | None]) -> tuple[float, list[tuple[str, int, int]]]:
    """Bits of the cheapest cut of `value`, and its parts as (kind, start, end).

    `word_bits` gives the bits of a dictionary word, or None. Brute-force stretches, walks and repeats
    grow by one step at their end, so each keeps one open cost per end position (repeats one per unit
    length); the whole takes time in proportion to the length.
    """
    n = len(value)
    low = lower(value)
    plain = low.translate(LEET)
    infinite = math.inf
    chars = [char_bits(c) for c in value]
    spent = [0.0]
    for bits in chars:
        spent.append(spent[-1] + bits)
    steps = [None] + [step(a, b) for a, b in zip(low, low[1:])]
    best = [0.0] + [infinite] * n
    back: list[tuple[str, int]] = [("", 0)] * (n + 1)
    single: dict[tuple[int, int], float] = {}  # cheapest one-part cost of short stretches, for repeats
    brute, brute_from = infinite, 0
    walk, walk_from = [infinite] * (n + 1), [0] * (n + 1)
    turns: dict[tuple[int, int], tuple[float, int]] = {}  # (unit length, end) -> open repeat

    def offer(i: int, j: int, kind: str, total: float) -> None:
        if total < best[j]:
            best[j], back[j] = total, (kind, i)

    def one_part(i: int, j: int) -> float:
        """The cheapest single part over a stretch that isn't a repeat."""
        return min(spent[j] - spent[i], single.get((i, j), infinite))

    # One-part costs of words and dates by end position.
    parts: list[list[tuple[int, str, float]]] = [[] for _ in range(n + 1)]
    for i in range(n):
        for j in range(i, min(n, i + LONGEST_WORD)):
            if not plain[j].isalpha():
                break
            if j - i + 1 >= SHORTEST_WORD and (bits := word_bits(plain[i : j + 1])) is not None:
                parts[j + 1].append((i, "word", bits + writing_bits(value[i : j + 1])))
        if value[i].isdigit():
            for pattern, lengths, bits in DATES:
                for j in lengths:
                    if i + j <= n and pattern.fullmatch(value, i, i + j):
                        parts[i + j].append((i, "date", bits))
        bits = WALK_START_BITS
        for j in range(i + 1, min(n, i + LONGEST_UNIT)):
            if steps[j] is None:
                break
            bits += STRAIGHT_BITS if j > i + 1 and steps[j] == steps[j - 1] else TURN_BITS
            if j - i + 1 >= 3:
                single[i, j + 1] = bits
    for j, found in enumerate(parts):
        for i, _, bits in found:
            if j - i <= LONGEST_UNIT:
                single[i, j] = min(bits, single.get((i, j), infinite))

    for j in range(1, n + 1):
        if best[j - 1] + PART_BITS < brute:
            brute, brute_from = best[j - 1] + PART_BITS, j - 1
        brute += chars[j - 1]
        offer(brute_from, j, "brute", brute)
        for i, kind, bits in parts[j]:
            offer(i, j, kind, best[i] + PART_BITS + bits)
        if j >= 2 and steps[j - 1] is not None:
            fresh = best[j - 2] + PART_BITS + WALK_START_BITS + TURN_BITS
            longer = walk[j - 1] + (STRAIGHT_BITS if steps[j - 1] == steps[j - 2] else TURN_BITS)
            offer(walk_from[j - 1], j, "walk", longer)
            walk[j], walk_from[j] = min((longer, walk_from[j - 1]), (fresh, j - 2))
        for p in range(1, min(LONGEST_UNIT, j // 2) + 1):
            if value[j - p : j] == value[j - 2 * p : j - p]:
                i = j - 2 * p
                fresh = (best[i] + PART_BITS + one_part(i, i + p) + REPEAT_BITS, i)
                turns[p, j] = min(fresh, turns.get((p, j - p), (infinite, 0)))
                offer(turns[p, j][1], j, "repeat", turns[p, j][0])
    cut, j = [], n
    while j:
        kind, i = back[j]
        cut.append((kind, i, j))
        j = i
    return best[n], cut[::-1]


# One text --------------------------------------------------------------------------------------------


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, sorted."""
    out = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    return sorted(out)


def context_values(text: str) -> list[tuple[int, int]]:
    """(start, end) of the values next to credential names."""
    small = text.lower()
    if not any(stem in small for stem in STEMS):
        return []
    return [m.span(m.lastindex) for m in VALUE.finditer(text)]


def words_outside(text: str, values: list[tuple[int, int]]) -> list[str]:
    if values:
        cuts = [0, *[x for span in values for x in span], len(text)]
        text = " ".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2]))
    return WORD.findall(text.lower())


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


# Tables ----------------------------------------------------------------------------------------------

_FOUND = (
    "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, base array<struct<start:int,kind:int,end:int,text:string>>, "
    "found array<struct<start:int,end:int,value:string>>, part array<struct<word:string,n:bigint>>"
)


def _batch(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    made = [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(made, schema=schema)


def _first_pass(df: DataFrame, key: str, text: str) -> DataFrame:
    """Spans and values of every text, and one row of word counts per batch; `_key` numbers the rows."""
    rows = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    schema = StructType([StructField("doc_id", rows.schema["doc_id"].dataType), *StructType.fromDDL(_FOUND)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: Counter[str] = Counter()
            made = []
            for given in batch.column("text"):
                body = given.as_py() or ""
                spans, values = base_spans(body), context_values(body)
                words.update(w for w in words_outside(body, values) if len(w) <= LONGEST_WORD)
                kinds = Counter(k for _, k, _ in spans)
                base = [{"start": a, "kind": k, "end": b, "text": body[a:b]} for a, k, b in spans]
                found = [{"start": a, "end": b, "value": body[a:b]} for a, b in values]
                made.append((kinds[0], kinds[1], kinds[2], hashlib.sha256(shown(spans).encode()).hexdigest(), base, found))
            if made:
                yield _batch([batch.column("doc_id"), *[list(c) for c in zip(*made)], [None] * len(made)], arrow)
            if words:
                counts = [[{"word": w, "n": n} for w, n in words.items()]]
                yield _batch([*[[None]] * (len(arrow) - 1), counts], arrow)

    return write_and_read(rows.mapInArrow(run, schema).withColumn("_key", F.monotonically_increasing_id()), "secrets")


def _judged(values: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """(value, bits, parts) of each distinct value: its pieces meet the word counts, then the cut is made."""
    values = write_and_read(values.select("value").distinct().withColumn("v", F.monotonically_increasing_id()), "values")
    piece_schema = to_arrow_schema(StructType.fromDDL("v bigint, word string"))
    out = StructType.fromDDL("value string, bits double, parts string")
    out_schema = to_arrow_schema(out)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for v, value in zip(batch.column("v").to_pylist(), batch.column("value").to_pylist()):
                found = pieces(value)
                if found:
                    yield _batch([[v] * len(found), found], piece_schema)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for value, known in zip(batch.column("value").to_pylist(), batch.column("known").to_pylist()):
                bits = {w["word"]: math.log2((total + 1) / w["n"]) for w in known or []}
                cost, parts = guess_cost(value, bits.get)
                made.append((value, cost, " ".join(f"{k}:{a}:{b}" for k, a, b in parts)))
            if made:
                yield _batch([list(c) for c in zip(*made)], out_schema)

    known = values.mapInArrow(cut, "v bigint, word string").join(counts, "word")
    known = known.groupBy("v").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    rows = values.join(known, "v", "left").select("value", "known")
    return write_and_read(rows.mapInArrow(judge, out), "judged")


def find_secrets(df: DataFrame, key: str = "doc_id", text: str = "text", least_bits: float = LEAST_BITS) -> DataFrame:
    """One row per row: doc_id, n_assign, n_access, n_hex, base_sha256 and the array `secrets`.

    A secret is (start, kind, end, text, bits, parts), kind being its place in `KINDS`; `bits` and
    `parts`, the cheapest cut, are null for the fixed patterns.
    """
    made = _first_pass(df, key, text)
    rows = made.where("part is null").drop("part")
    counts = made.where("part is not null").select(F.explode("part").alias("p")).groupBy("p.word").agg(F.sum("p.n").alias("n"))
    counts = write_and_read(counts, "words")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    values = rows.select("_key", F.explode("found").alias("f")).select("_key", "f.*")
    judged = _judged(values, counts, total).where(F.col("bits") >= least_bits)
    salted = judged.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    hits = values.withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(SALTS)).cast("int")).join(salted, ["value", "_salt"])
    span = F.struct("start", F.lit(KINDS.index("guess")).alias("kind"), "end", F.col("value").alias("text"), "bits", "parts")
    added = hits.groupBy("_key").agg(F.collect_list(span).alias("added"))
    fixed = F.transform(
        "base",
        lambda s: F.struct(
            s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["text"].alias("text"),
            F.lit(None).cast("double").alias("bits"), F.lit(None).cast("string").alias("parts"),
        ),
    )
    whole = F.when(F.col("added").isNull(), fixed).otherwise(F.sort_array(F.concat(fixed, F.col("added"))))
    out = rows.join(added, "_key", "left")
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", whole.alias("secrets"))


def span_text(secrets: Column) -> Column:
    """`kind:start:end` of an array of secrets, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")
