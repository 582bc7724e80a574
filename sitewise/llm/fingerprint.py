"""Document fingerprints: invertible Bloom lookup tables over paragraph digests.

A text is the set of its paragraphs: lines, long ones wrapped after `WRAP` words. Each digest goes
into four cells of a page of 32 cells (four rows of eight); a cell holds the number of digests, the
xor of the digests and the xor of their checks. Tables of two versions are subtracted cell by cell:
what both hold cancels, and cells that hold one digest are peeled until nothing is left, which
recovers exactly the digests that only one version has. If cells remain, the table was too small: it
is built again with more pages, sized for all digests of both texts, then twice as many, and so on.

Everything is column expressions over one row; the next document comes with one shuffle by ranges of
ids. No Python runs in tasks.

Edge cases: a null text is empty and has no paragraph; two texts without paragraphs are alike (1.0); a
null id sorts first; equal ids are in the order of their texts; of a single row the next is the row
itself; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitewise.llm.common import md5_number

WRAP = 64
PARAGRAPH = r"(?:[^ \n]+ ?){1,%d}" % WRAP
ROWS, SIDE = 4, 8
CELLS = ROWS * SIDE
#: Peeling rounds before a table counts as too small.
ROUNDS = 10
#: Digests that a page should hold in a retry; retries with more and more pages follow.
PER_PAGE = 12
RETRIES = 3
#: Documents between two cuts of the id range.
IDS_PER_BUCKET = 4096


def digests(text: Column) -> Column:
    """The distinct digests of the paragraphs of a text."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PARAGRAPH), F.lit(0))
    return F.array_distinct(F.transform(parts, md5_number))


def check(key: Column) -> Column:
    """A second hash that tells a cell with one digest from a cell with several."""
    return ((key % 2147483629) * 48271 + 11) % 2147483647


def by_place(some: Column, row: int, salt: int, key=lambda x: x) -> Column:
    """The digests parted by their place in a row: eight arrays, chosen by three bits, highest first."""
    def halves(bit: int):
        mask = F.lit(1 << (3 * (row + ROWS * salt) + bit)).cast("long")
        side = lambda x: key(x).bitwiseAND(mask)
        return lambda part: F.array(F.filter(part, lambda x: side(x) == 0), F.filter(part, lambda x: side(x) != 0))

    parts = F.array(some)
    for bit in (2, 1, 0):
        parts = F.flatten(F.transform(parts, halves(bit)))
    return parts


def cell_of(n: Column, k: Column, c: Column) -> Column:
    return F.struct(n.cast("long").alias("n"), k.cast("long").alias("k"), c.cast("long").alias("c"))


def sketch(keys: Column, pages: Column, salt: int) -> Column:
    """Array of pages, each an array of 32 cells (n, k, c)."""
    page_of = lambda x: F.pmod(F.pmod(x, F.lit(1000003)), pages)
    grouped = F.transform(F.sequence(F.lit(0), (pages - 1).cast("int")), lambda p: F.filter(keys, lambda x: page_of(x) == p))
    empty = cell_of(F.lit(0), F.lit(0), F.lit(0))

    def fill(page: Column) -> Column:
        put = lambda a, x: cell_of(a["n"] + 1, a["k"].bitwiseXOR(x), a["c"].bitwiseXOR(check(x)))
        rows = [by_place(page, r, salt) for r in range(ROWS)]
        return F.transform(F.concat(*rows), lambda part: F.aggregate(part, empty, put))

    return F.transform(grouped, fill)


def subtract(a: Column, b: Column) -> Column:
    minus = lambda x, y: cell_of(x["n"] - y["n"], x["k"].bitwiseXOR(y["k"]), x["c"].bitwiseXOR(y["c"]))
    return F.zip_with(a, b, lambda p, q: F.zip_with(p, q, minus))


def peel(difference: Column, salt: int) -> Column:
    """Array of (k, n) in one version only (n 1: in the first, -1: in the second); null if too small."""

    def step(state: Column, _: Column) -> Column:
        single = F.filter(state["cells"], lambda c: (F.abs(c["n"]) == 1) & (check(c["k"]) == c["c"]))
        found = F.array_distinct(F.transform(single, lambda c: F.struct(c["k"].alias("k"), c["n"].alias("n"))))

        def without(some: Column) -> Column:
            take = lambda a, q: cell_of(
                a["n"] - q["n"], a["k"].bitwiseXOR(q["k"]), a["c"].bitwiseXOR(check(q["k"]))
            )
            rows = [by_place(some, r, salt, lambda q: q["k"]) for r in range(ROWS)]
            cells = F.zip_with(state["cells"], F.concat(*rows), lambda c, part: F.aggregate(part, c, take))
            return F.struct(cells.alias("cells"), F.concat(state["found"], some).alias("found"), (F.size(some) > 0).alias("more"))

        # A one-element array names `found`, so that it is computed once.
        return F.when(state["more"], F.element_at(F.transform(F.array(found), without), 1)).otherwise(state)

    nothing = F.array().cast("array<struct<k:bigint,n:bigint>>")

    def page(cells: Column) -> Column:
        start = F.struct(cells.alias("cells"), nothing.alias("found"), F.lit(True).alias("more"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)

    done = F.transform(difference, page)

    def result(states: Column) -> Column:
        clean = lambda c: (c["n"] == 0) & (c["k"] == 0) & (c["c"] == 0)
        whole = F.forall(states, lambda s: F.forall(s["cells"], clean))
        return F.when(whole, F.flatten(F.transform(states, lambda s: s["found"])))

    return F.element_at(F.transform(F.array(done), result), 1)


def differing(a: Column, b: Column, sketch_a: Column, sketch_b: Column) -> Column:
    """Digests that one of the two sets has: peeled from the fingerprints, else from larger tables."""
    tries = [peel(subtract(sketch_a, sketch_b), 0)]
    total = F.size(a) + F.size(b)
    for retry in range(RETRIES):
        pages = (F.greatest(F.ceil(total / PER_PAGE), F.lit(1)) * 2**retry).cast("int")
        salt = 1 + retry
        tries.append(peel(subtract(sketch(a, pages, salt), sketch(b, pages, salt)), salt))
    only = lambda x, y, n: F.transform(F.array_except(x, y), lambda k: F.struct(k.alias("k"), F.lit(n).cast("long").alias("n")))
    return F.coalesce(*tries, F.concat(only(a, b, 1), only(b, a, -1)))


def likeness(a: Column, b: Column, different: Column) -> Column:
    """Shared digests over all digests of both."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise((total - different) / (total + different))


def as_text(cells: Column) -> Column:
    """The fingerprint as text: the cells of its page, each count, digests and checks in hex."""
    one = lambda c: F.concat_ws(".", F.hex(c["n"]), F.hex(c["k"]), F.hex(c["c"]))
    return F.lower(F.array_join(F.transform(F.flatten(cells), one), " "))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text, next_text): each with the text of the next id, the last with the first's.

    Ids are cut into ranges. The first document of each range is also sent to the range before, so
    the neighbour of every document lies in its own range.
    """
    span = docs.agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    low, high = span["low"] or 0, span["high"] or 0
    width = max(1, (high - low + 1) * IDS_PER_BUCKET // max(1, span["n"]))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(low - 1))
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), key.alias("_key"))
    rows = rows.withColumn("_range", F.floor((F.col("_key") - low) / width))
    # One row per range: about one for every IDS_PER_BUCKET documents.
    firsts = rows.groupBy("_range").agg(F.min("_key").alias("_key"))
    order = Window.partitionBy(F.lit(0)).orderBy("_range")
    back = F.lag("_range").over(order)
    last = F.max("_range").over(Window.partitionBy(F.lit(0)))
    firsts = firsts.select("_key", F.coalesce(back, last).alias("_to"), back.isNull().alias("_turn"))
    heads = rows.join(firsts, "_key").select("doc_id", "text", "_key", F.col("_to").alias("_range"), "_turn", F.lit(True).alias("_copy"))
    both = rows.withColumns({"_turn": F.lit(False), "_copy": F.lit(False)}).unionByName(heads)
    line = Window.partitionBy("_range").orderBy("_turn", "_key", "_copy", "text")
    return both.withColumn("next_text", F.lead("text").over(line)).where("not _copy").select("doc_id", "text", "next_text")


def edited(text: Column, other: Column, chars: Column) -> Column:
    """The text with its last quarter replaced by as many of the first code points of the other."""
    quarter = F.floor(chars / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), (chars - quarter).cast("int")), F.substring(other, F.lit(1), quarter))


def fingerprint_versions(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and the
    digests recovered between the document and its edited text."""
    rows = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    rows = rows.withColumn("_edited", edited(F.col("text"), F.col("next_text"), F.col("n_chars")))
    rows = rows.select(
        "doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"),
        digests(F.col("text")).alias("_a"), digests(F.col("_edited")).alias("_b"), digests(F.col("next_text")).alias("_c"),
    )
    one = F.lit(1)
    rows = rows.select("*", *[sketch(F.col(x), one, 0).alias(f"_s{x}") for x in ("_a", "_b", "_c")])
    gap = lambda x: differing(F.col("_a"), F.col(x), F.col("_s_a"), F.col(f"_s{x}"))
    rows = rows.select("*", gap("_b").alias("recovered"), F.size(gap("_c")).alias("_next"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256",
        as_text(F.col("_s_a")).alias("fingerprint"), as_text(F.col("_s_b")).alias("edited_fingerprint"),
        likeness(F.col("_a"), F.col("_b"), F.size("recovered")).alias("near_edited"),
        likeness(F.col("_a"), F.col("_c"), F.col("_next")).alias("near_next"),
        "recovered",
    )
