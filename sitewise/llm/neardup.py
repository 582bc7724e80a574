"""Near-duplicates by fast similarity sketching, banding and exact verification.

A document is the set of its distinct word shingles, lower-cased, of four words or as many as asked. Its sketch has `COORDINATES`
places. In round i every shingle goes to one place by a hash and leaves the value (i, hash fraction);
a place keeps the smallest. Rounds go on until every place is filled; after as many rounds as places,
place j is filled by round j alone, so filling is certain, and the share of equal places concentrates
about the similarity as sharply as with independent minima. Bands of `ROWS` places give bucket keys:
a pair at similarity 0.8 shares no bucket with probability (1 - 0.8 ** 6) ** 48, below 5 in 10 million.

Equal sets form a class with one representative, so exact copies cost one row each. Every pair that shares a
bucket is decided on its full sets, yet never paired inside the bucket:

1. Each class is compared with the smallest class that it meets in any bucket, and links join components.
2. Classes that have too many shingles alone to be linked with any other leave the buckets.
3. In buckets that still hold several components the class that meets most others is the pivot, and each
   member is compared with it. What a member keeps is its difference D from the pivot's set. Two members are
   linked if |D_a xor D_b| <= (|a| + |b|) / 9, the same as 80 % in common. If |D_a| + |D_b| is not above
   that, both are linked with the pivot already. Otherwise their differences must share so many shingles that they
   meet early in an order of the rarest first; only such pairs are listed, by the place of the shared
   shingle in both, and then decided.

Edge cases: a null or empty text has no shingle and is linked with nothing; fewer words than a shingle has are
one shingle. Every row is a document of its own: rows of one id and one text are copies, of one id and
different texts two documents with that id. The id of a component is the smallest id of its rows, null if no
row has one. An empty table gives an empty result; further columns are ignored by `near_duplicates` and kept
by `keep_first`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.llm.common import null_safe_join, word_count
from sitewise.llm.graph import components
from sitewise.llm.textstats import number_words
from sitewise.operators.staging import write_and_read

#: Words of a shingle where none are asked for.
SHINGLE = 4
ROWS, BANDS = 6, 48
COORDINATES = ROWS * BANDS
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Bits of the map of keys that keeps other texts from being moved.
MAP_BITS = 24
#: Hashes of one vectorised block of rounds.
BLOCK = 4096

_MUL = np.uint64(0xBF58476D1CE4E5B9)
_MUL2 = np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _MUL
    x = (x ^ (x >> np.uint64(27))) * _MUL2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    seen, ids = number_words(words)
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, seen), dtype=np.uint64, count=len(seen))[ids]
    width = min(size, len(words))
    total = np.full(len(words) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        total = mix(total * _STEP + hashed[k : len(hashed) - width + k + 1])
    return np.unique(total)


_ROUND = mix((np.arange(2 * COORDINATES, dtype=np.uint64) + np.uint64(1)) * _STEP)
_UNSET = np.uint64(2**64 - 1)


def sketch(elements: np.ndarray, places: int = COORDINATES) -> np.ndarray:
    """The filled places of a set; elements must not be empty."""
    out = np.full(places, _UNSET)
    rounds = max(1, BLOCK // len(elements))
    done = 0
    while done < places and (out == _UNSET).any():
        upto = min(places, done + rounds)
        hashed = mix(elements[None, :] ^ _ROUND[done:upto, None])
        at = ((hashed >> np.uint64(32)) % np.uint64(places)).astype(np.int64)
        number = np.arange(done, upto, dtype=np.uint64)[:, None] << np.uint64(32)
        np.minimum.at(out, at.ravel(), (number | (hashed & np.uint64(0xFFFFFFFF))).ravel())
        done = upto
    left = np.flatnonzero(out == _UNSET)
    for start in range(0, len(left), rounds):
        part = left[start : start + rounds]
        low = (mix(elements[None, :] ^ _ROUND[places + part][:, None]) & np.uint64(0xFFFFFFFF)).min(axis=1)
        out[part] = (np.uint64(places) + part.astype(np.uint64)) << np.uint64(32) | low
    return out


def band_keys(places: np.ndarray) -> np.ndarray:
    grid = places.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for r in range(ROWS):
        key = mix(key * _STEP + grid[:, r])
    return key.view(np.int64)


def _sketch_rows(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    import xxhash

    names = ["doc_id", "text_key", "n_shingles", "digest", "bands"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.int64())]
    for whole in batches:
        for start in range(0, whole.num_rows, 256):
            batch = whole.slice(start, 256)
            sizes, digests, bands = [], [], []
            for text in batch.column(2).to_pylist():
                elements = shingle_set(text or "", shingle)
                sizes.append(len(elements))
                digests.append(xxhash.xxh3_128_hexdigest(elements.tobytes()) if len(elements) else None)
                bands.append(band_keys(sketch(elements)).tolist() if len(elements) else None)
            made = [pa.array(c, k) for c, k in zip((sizes, digests, bands), kinds[2:], strict=True)]
            columns = [batch.column(0), batch.column(1), *made]
            yield pa.RecordBatch.from_arrays(columns, names)


def _set_rows(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, 256):
            batch = whole.slice(start, 256)
            sets = [np.sort(shingle_set(t or "", shingle).view(np.int64)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["cls", "elements"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        left, right = batch.column("set_a"), batch.column("set_b")
        for i in range(batch.num_rows):
            a, b = left[i].values.to_numpy(), right[i].values.to_numpy()
            both = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(100 * both >= PERCENT * (len(a) + len(b) - both))
        keep = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["u", "v"])


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, as edges (u, v)."""
    left = sets.select(F.col("cls").alias("a"), F.col("elements").alias("set_a"))
    right = sets.select(F.col("cls").alias("b"), F.col("elements").alias("set_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(_verify, "u long, v long")


def _similar_size(n: str, m: str):
    return 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)


def _relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (cls, comp) after joining the components that the links connect."""
    ends = links.join(labels.select(F.col("cls").alias("u"), F.col("comp").alias("cu")), "u")
    ends = ends.join(labels.select(F.col("cls").alias("v"), F.col("comp").alias("cv")), "v")
    roots = components(ends.select(F.col("cu").alias("u"), F.col("cv").alias("v")))
    moved = labels.join(roots.withColumnRenamed("node", "comp"), "comp", "left")
    return write_and_read(moved.select("cls", F.coalesce("root", "comp").alias("comp")), "labels")


def _open(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """The entries of buckets that hold more than one component, with `comp`."""
    placed = buckets.join(labels, "cls")
    several = placed.groupBy("key").agg(F.min("comp").alias("_l"), F.max("comp").alias("_h")).where("_l <> _h")
    return placed.join(several.select("key"), "key")


def _linkable(entries: DataFrame, sets: DataFrame) -> DataFrame:
    """Entries of classes that have enough shingles in common with other classes of the entries.

    What a class has alone it shares with nobody, so a class with more than the rest of PERCENT of its
    shingles alone can't be linked with any other and goes.
    """
    entries = write_and_read(entries.select("key", "cls", "n"), "entries")
    shingles = sets.join(entries.select("cls"), "cls", "left_semi").select("cls", F.explode("elements").alias("e"))
    alone = shingles.groupBy("e").agg(F.count("*").alias("_n"), F.min("cls").alias("cls")).where("_n = 1")
    alone = alone.groupBy("cls").agg(F.count("*").alias("_alone"))
    core = F.col("n") - F.coalesce("_alone", F.lit(0))
    return entries.join(alone, "cls", "left").where(100 * core >= PERCENT * F.col("n")).drop("_alone")


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own, other = batch.column("own"), batch.column("other")
        diff = [np.setxor1d(own[i].values.to_numpy(), other[i].values.to_numpy(), assume_unique=True) for i in range(batch.num_rows)]
        columns = [batch.column("pivot"), batch.column("cls"), batch.column("n"), batch.column("pivot_n"), pa.array(diff, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["pivot", "cls", "n", "pivot_n", "d"])


def _differences(buckets: DataFrame, sets: DataFrame) -> DataFrame:
    """(pivot, cls, n, pivot_n, d) for the members of each bucket; buckets with one pivot make one group.

    The pivot of a bucket is the class with the most fellows in all its buckets, so neighbouring buckets
    mostly agree on it.
    """
    sizes = buckets.groupBy("key").agg(F.count("*").alias("_s"))
    scores = buckets.join(sizes, "key").groupBy("cls").agg(F.sum("_s").alias("_score"))
    first = F.max(F.struct("_score", (-F.col("cls")).alias("_c"), "n"))
    pivots = buckets.join(scores, "cls").groupBy("key").agg(first.alias("_p"))
    pivots = pivots.select("key", (-F.col("_p._c")).alias("pivot"), F.col("_p.n").alias("pivot_n"))
    members = buckets.join(pivots, "key").where("cls <> pivot").select("pivot", "pivot_n", "cls", "n").distinct()
    own = sets.select("cls", F.col("elements").alias("own"))
    other = sets.select(F.col("cls").alias("pivot"), F.col("elements").alias("other"))
    whole = members.join(own, "cls").join(other, "pivot").select("pivot", "cls", "n", "pivot_n", "own", "other")
    return write_and_read(whole.mapInArrow(_difference, "pivot long, cls long, n long, pivot_n long, d array<long>"), "differences")


def _meeting(groups: DataFrame) -> DataFrame:
    """Pairs (pivot, a, b) of members, of different components, whose differences may share enough shingles.

    A pair needs `(9 |D_a| - |a| + 9 |D_b| - |b|) / 18` common ones. Shingles of a group are ordered by how
    many members have them; the first common one of a pair leaves at most what follows it in each.
    """
    shingles = groups.select("pivot", "cls", F.explode("d").alias("e"))
    common = shingles.groupBy("pivot", "e").agg(F.count("*").alias("f")).where("f > 1")
    listed = shingles.join(common, ["pivot", "e"]).groupBy("pivot", "cls").agg(F.sort_array(F.collect_list(F.struct("f", "e"))).alias("l"))
    need = (9 * F.size("d") - F.col("n")).alias("need")
    placed = groups.select("pivot", "cls", "comp", need).join(listed, ["pivot", "cls"])
    placed = placed.select("pivot", "cls", "comp", "need", F.size("l").alias("c"), F.posexplode("l.e").alias("at", "e"))
    placed = write_and_read(placed.withColumn("left", F.col("c") - F.col("at")).drop("c", "at"), "placed")
    a, b = placed.alias("a"), placed.alias("b")
    enough = 18 * F.least("a.left", "b.left") >= F.col("a.need") + F.col("b.need")
    same = (F.col("a.pivot") == F.col("b.pivot")) & (F.col("a.e") == F.col("b.e"))
    met = a.join(b, same & (F.col("a.cls") < F.col("b.cls")) & (F.col("a.comp") != F.col("b.comp")) & enough)
    return met.groupBy(F.col("a.cls").alias("a"), F.col("b.cls").alias("b")).agg(F.min("a.pivot").alias("pivot"))


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = batch.column("d_a"), batch.column("d_b")
        total = batch.column("total").to_pylist()
        keep = [
            9 * len(np.setxor1d(left[i].values.to_numpy(), right[i].values.to_numpy(), assume_unique=True)) <= total[i]
            for i in range(batch.num_rows)
        ]
        keep = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["u", "v"])


def _links_by_difference(differences: DataFrame, labels: DataFrame) -> DataFrame:
    """Links between members of groups that hold several components."""
    placed = differences.join(labels, "cls")
    several = placed.groupBy("pivot").agg(F.min("comp").alias("_l"), F.max("comp").alias("_h")).where("_l <> _h").select("pivot")
    groups = write_and_read(placed.join(several, "pivot"), "groups")
    sides = [groups.select("pivot", F.col("cls").alias(s), F.col("n").alias(f"n_{s}"), F.col("d").alias(f"d_{s}")) for s in ("a", "b")]
    pairs = _meeting(groups).join(sides[0], ["pivot", "a"]).join(sides[1], ["pivot", "b"])
    pairs = pairs.select("a", "b", (F.col("n_a") + F.col("n_b")).alias("total"), "d_a", "d_b")
    return write_and_read(pairs.mapInArrow(_decide, "u long, v long"), "links")


def text_key() -> Column:
    """The text of a row as a key; rows of one id and one key are copies of each other."""
    return F.md5(F.coalesce("text", F.lit("")))


def _slot() -> Column:
    return F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(1 << MAP_BITS))


def _packed(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(_row, doc_id, text_key, _in): the rows of `docs` as structs, and whether `keys` may hold their key.

    The keys become a map of 2 ** `MAP_BITS` bits, in words of 64, which bounds the table that is broadcast.
    With very many keys it lets all rows pass.
    """
    word, bit = F.shiftright("_slot", 6).alias("_word"), F.expr("shiftleft(1L, cast(_slot % 64 as int))").alias("_bit")
    bits = keys.select(_slot().alias("_slot")).select(word, bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"))
    rows = rows.withColumn("_slot", _slot()).withColumn("_word", F.shiftright("_slot", 6))
    found = rows.join(F.broadcast(write_and_read(bits, "bits")), "_word", "left")
    inside = F.coalesce(F.getbit("_bits", (F.col("_slot") % 64).cast("int")) == 1, F.lit(False))
    return found.select("_row", "doc_id", "text_key", inside.alias("_in"))


def _one_row_each(packed: DataFrame, keys: DataFrame) -> DataFrame:
    """One row of `packed` for each row of `keys` (doc_id, text_key, many, and others): `_row` and the others.

    Only keys that are marked as `many` are reduced; the rows of all others pass the join alone.
    """
    found = null_safe_join(packed.select("_row", "doc_id", "text_key"), keys, ["doc_id", "text_key"])
    rest = [c for c in keys.columns if c not in ("doc_id", "text_key", "many")]
    repeated = found.where("many").groupBy("doc_id", "text_key").agg(F.first("_row").alias("_row"), *[F.first(c).alias(c) for c in rest])
    return found.where("not many").select("_row", *rest).unionByName(repeated.select("_row", *rest))


def _components(docs: DataFrame, shingle: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (row, doc_id, text_key, n_shingles, digest), classes (digest, cls, class_id), labels (cls, comp).

    Rows are numbered as they are written; a class is known by its first row. Only classes that share a
    bucket with another have a label.
    """
    slim = docs.select(F.col("doc_id").cast("long"), text_key().alias("text_key"), "text")
    kinds = "doc_id long, text_key string, n_shingles long, digest string, bands array<long>"
    made = slim.mapInArrow(partial(_sketch_rows, shingle=shingle), kinds)
    rows = write_and_read(made.withColumn("row", F.monotonically_increasing_id()), "sketches")
    classes = rows.where("digest is not null").groupBy("digest").agg(F.min("row").alias("cls"), F.min("doc_id").alias("class_id"))
    classes = write_and_read(classes, "classes")
    heads = rows.join(classes.select(F.col("cls").alias("row")), "row", "left_semi")
    entries = heads.select(F.col("row").alias("cls"), F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    shared = entries.groupBy("key").agg(F.min("cls").alias("_l"), F.max("cls").alias("_h")).where("_l <> _h").select("key")
    buckets = write_and_read(entries.join(shared, "key"), "buckets")
    labels = write_and_read(buckets.select("cls", F.col("cls").alias("comp")).distinct(), "labels")

    keys = heads.join(labels.select(F.col("cls").alias("row")), "row", "left_semi").select("doc_id", "text_key", F.col("row").alias("cls"))
    copies = rows.groupBy("doc_id", "text_key").agg((F.count("*") > 1).alias("many")).where("many")
    keys = null_safe_join(keys, copies, ["doc_id", "text_key"], "left").withColumn("many", F.coalesce("many", F.lit(False)))
    keys = write_and_read(keys, "keys")
    texts = _one_row_each(_packed(docs, keys).where("_in"), keys).select("cls", "_row.text")
    sets = write_and_read(texts.mapInArrow(partial(_set_rows, shingle=shingle), "cls long, elements array<long>"), "sets")

    # Each class against the smallest class of its buckets.
    first = buckets.groupBy("key").agg(F.min(F.struct("cls", "n")).alias("_lead"))
    met = buckets.join(first, "key").where((F.col("_lead.cls") < F.col("cls")) & _similar_size("n", "_lead.n"))
    pairs = met.groupBy(F.col("cls").alias("b")).agg(F.min("_lead.cls").alias("a"))
    labels = _relabel(labels, write_and_read(confirmed(pairs, sets), "links"))

    buckets = write_and_read(_linkable(_open(buckets, labels), sets), "buckets")
    if not buckets.isEmpty():
        differences = _differences(buckets, sets)
        near = differences.where(9 * F.size("d") <= F.col("n") + F.col("pivot_n"))
        labels = _relabel(labels, near.select(F.col("cls").alias("u"), F.col("pivot").alias("v")))
        links = _links_by_difference(differences, labels)
        if not links.isEmpty():
            labels = _relabel(labels, links)
    return rows.drop("bands"), classes, labels


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, class_id (smallest id with the same set)."""
    rows, classes, labels = _components(docs, shingle)
    named = labels.join(classes.select("cls", "class_id"), "cls")
    ids = named.groupBy("comp").agg(F.min("class_id").alias("component"))
    per_class = labels.join(ids, "comp").select("cls", "component", F.lit(True).alias("labelled"))
    found = rows.join(classes, "digest", "left").join(per_class, "cls", "left")
    component = F.when(F.col("labelled"), F.col("component")).otherwise(F.coalesce("class_id", "doc_id"))
    return found.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"),
        F.coalesce("class_id", "doc_id").alias("class_id"),
    )


def keep_first(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The rows of `docs` that stay: one of each component, and all without words.

    The one with the smallest id stays, of one id the smallest text key; a row without an id stays only
    where no row of its component has one.
    """
    rows, classes, labels = _components(docs, shingle)
    found = rows.join(classes.select("digest", "cls"), "digest").join(labels, "cls", "left")
    order = F.struct(F.col("doc_id").isNull().alias("nil"), "doc_id", "text_key")
    stay = found.groupBy(F.coalesce("comp", "cls").alias("root")).agg(F.min(order).alias("k"))
    stay = stay.select("k.doc_id", "k.text_key", F.lit(True).alias("stays"))
    keys = found.groupBy("doc_id", "text_key").agg((F.count("*") > 1).alias("many"))
    keys = write_and_read(null_safe_join(keys, stay, ["doc_id", "text_key"], "left"), "keys")
    # Only rows that go, or stand for several, can meet a key here; all others pass where they lie.
    packed = _packed(docs, keys.where("stays is null or many"))
    alone = ~F.col("_in") | (word_count(F.col("_row.text")) == 0)
    some = _one_row_each(packed.where(~alone), keys.where("stays").drop("stays"))
    return packed.where(alone).select("_row.*").unionByName(some.select("_row.*"))
