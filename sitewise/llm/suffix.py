"""Removal of long repeats by a run-length index of the Burrows-Wheeler transform.

A byte goes if a 100-byte string that covers it also starts earlier in the corpus. The strings are
found in four steps, none of which holds a corpus, a group of copies or all candidates in one task.

1. Every 100-byte window has an anchor, chosen by content; windows that share one form a run. Of equal
   runs in a task only the first is sent on, those at other places are repeats for sure.
2. Runs meet by anchor hash, sorted by content and place, and stream through the tasks: of equal runs
   all at a later place than the first are repeats, an anchor with a single run is unique, and the first runs of the
   other anchors are candidates.
3. The stretches of the candidates meet by anchor. Each task builds run-length indexes over at most
   `INDEX_BYTES` of them, streams their matching statistics and marks the windows whose first 100
   bytes stand at an earlier place as well. Anchors with more than `HOT_RUNS` different runs are not
   put in one task: their windows are hashed and the first place of each is a plain aggregate.
4. Marked stretches of a document are merged and cut out of its text.

Edge cases: a null text is empty; texts under 100 bytes stay whole; matches never cross documents;
rows with equal id and text, also with a null id, are one document and get equal results; of different texts with one id
the smaller text comes first; a null id comes first; an empty table gives an empty result; extra columns
are kept by `drop_repeats`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitewise.llm.anchors import LENGTH, RunIndex, anchors, mix, window_hashes
from sitewise.operators.staging import write_and_read

#: Runs of a task that are compared with each other before they are sent on; about 150 bytes each while they are.
CHUNK_RUNS = 300_000
#: Bytes under one index; building it takes about 90 bytes for each. A group of one anchor is never cut, so
#: `HOT_RUNS` stretches of at most 356 bytes, most under 170, bound it too.
INDEX_BYTES = 800_000
HOT_RUNS = 8_000
NO_ID = -(2**63)
#: Bits of the map of document ids that keeps texts without candidates from being moved.
ID_MAP_BITS = 24

_RUNS = "mark boolean, anchor long, run long, doc long, at long"


def keyed(docs: DataFrame) -> DataFrame:
    """`docs` with `_doc` (the id, or a least value) and `_tie` (0, or the rank of the text among equal ids)."""
    rows = docs.withColumn("_doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    repeated = rows.groupBy("_doc").agg(F.count("*").alias("_n")).where("_n > 1").select("_doc")
    if repeated.isEmpty():
        return rows.withColumn("_tie", F.lit(0))
    order = Window.partitionBy("_doc").orderBy(F.coalesce("text", F.lit("")))
    one = rows.join(repeated, "_doc", "left_anti").withColumn("_tie", F.lit(0))
    more = rows.join(repeated, "_doc", "left_semi").withColumn("_tie", (F.dense_rank().over(order) - 1).cast("int"))
    return one.unionByName(more)


def _batch(columns: list[tuple[str, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for _, v in columns], [k for k, _ in columns])


def _stretches(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or adjacent stretches of a document as one; `start` carries the tie in its high bits."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if not len(doc):
        return doc, start, end
    group = np.concatenate([[True], doc[1:] != doc[:-1]])
    cuts = np.ones(len(doc), dtype=bool)
    for a, b in zip(np.flatnonzero(group), np.append(np.flatnonzero(group)[1:], len(doc)), strict=True):
        if b - a > 1:
            cuts[a + 1 : b] = start[a + 1 : b] > np.maximum.accumulate(end[a:b])[:-1]
    first = np.flatnonzero(cuts)
    return doc[first], start[first], np.maximum.reduceat(end, first)


def _marks(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Rows that carry a marked stretch; they travel with the runs, spread by document."""
    doc, start, end = _stretches(doc, start, end)
    spread = mix(doc.view(np.uint64)).view(np.int64)
    return _batch([("mark", np.ones(len(doc), bool)), ("anchor", spread), ("run", end), ("doc", doc), ("at", start)])


def _later(first: np.ndarray, doc: np.ndarray, at: np.ndarray, open_place: tuple | None = None) -> np.ndarray:
    """Whether each row of sorted runs stands after the first of its run. Equal places (of equal rows)
    are one place. `open_place` is that of a run which began before these rows."""
    number = np.cumsum(first) - 1
    heads = np.flatnonzero(first)
    head_doc, head_at = doc[heads], at[heads]
    if open_place:
        head_doc, head_at = np.append(head_doc, open_place[0]), np.append(head_at, open_place[1])  # found as number -1
    return (doc != head_doc[number]) | (at != head_at[number])


def _first_of(anchor: np.ndarray, run: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by anchor, run, document and place, and whether each row is the first of its run or a later one."""
    order = np.lexsort((at, doc, run, anchor))
    a, r = anchor[order], run[order]
    first = np.concatenate([[True], (a[1:] != a[:-1]) | (r[1:] != r[:-1])]) if len(a) else np.zeros(0, bool)
    return order, first, _later(first, doc[order], at[order])


def _find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of the texts: the first of each kind in the task, and marks for the others.

    `at` holds the tie, the first window (32 bits) and the number of further windows (8 bits).
    """
    held: list[tuple] = []
    count = 0

    def flush() -> Iterator[pa.RecordBatch]:
        anchor, run, doc, at = (np.concatenate(v) for v in zip(*held, strict=True))
        held.clear()
        order, first, later = _first_of(anchor, run, doc, at)
        keep, rest = order[first], order[later]
        yield _batch([("mark", np.zeros(len(keep), bool)), ("anchor", anchor[keep]), ("run", run[keep]), ("doc", doc[keep]), ("at", at[keep])])
        if len(rest):
            start = at[rest] >> 8
            yield _marks(doc[rest], start, start + (at[rest] & 255) + LENGTH)

    for batch in batches:
        docs, ties = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for i, text in enumerate(batch.column(2)):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            anchor, run, _, first, last = anchors(data)
            if len(first):
                place = (np.int64(ties[i]) << 32) + first
                held.append((anchor, run, np.full(len(first), docs[i]), place << 8 | (last - first)))
                count += len(first)
            if count > CHUNK_RUNS:
                yield from flush()
                count = 0
    if held:
        yield from flush()


def _stream_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs in, marks and candidates out; one row of state per open anchor.

    A candidate is a first run of an anchor that has others. Until an anchor's second run is seen its
    first one waits.
    """
    last: tuple | None = None  # (anchor, run, has several, place of the run's first)
    waiting: pa.RecordBatch | None = None
    for batch in batches:
        marked = batch.column(0).to_numpy(zero_copy_only=False)
        if marked.any():
            yield batch.filter(pa.array(marked))
            batch = batch.filter(pa.array(~marked))
        if not batch.num_rows:
            continue
        anchor, run, doc, at = (batch.column(i).to_numpy() for i in range(1, 5))
        new_anchor, new_run = np.ones(len(anchor), bool), np.ones(len(anchor), bool)
        new_anchor[1:] = anchor[1:] != anchor[:-1]
        new_run[1:] = new_anchor[1:] | (run[1:] != run[:-1])
        if last and anchor[0] == last[0]:
            new_anchor[0], new_run[0] = False, run[0] != last[1]
        if new_anchor[0]:
            waiting = None  # the anchor before had a single run
        rest = _later(new_run, doc, at, last[3] if last else None)
        if rest.any():
            start = at[rest] >> 8
            yield _marks(doc[rest], start, start + (at[rest] & 255) + LENGTH)
        group = np.cumsum(new_anchor)
        runs = np.bincount(group, weights=new_run).astype(np.int64)
        several = runs > 1
        if not new_anchor[0]:
            several[0] = last[2] or runs[0] > 0  # one run was seen before this batch
            if several[0] and waiting is not None:
                yield waiting
                waiting = None
        keep = new_run & several[group]
        if keep.any():
            yield batch.filter(pa.array(keep))
        end = group[-1]
        if not several[end] and (end > 0 or runs[0]):
            waiting = batch.slice(int(np.flatnonzero(new_run)[-1]), 1)
        heads = np.flatnonzero(new_run)
        place = (doc[heads[-1]], at[heads[-1]]) if len(heads) else last[3]
        last = (anchor[-1], run[-1], bool(several[end]), place)


def _id_map(ids: DataFrame) -> np.ndarray:
    """Bits of hashed document ids, of a fixed size. With very many ids it lets all pass."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (ID_MAP_BITS - 6), dtype=np.uint64)
        for batch in batches:
            slot = mix(batch.column(0).to_numpy().view(np.uint64)) >> np.uint64(64 - ID_MAP_BITS)
            np.bitwise_or.at(bits, (slot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (slot & np.uint64(63)))
        used = np.flatnonzero(bits)
        yield _batch([("word", used), ("bits", bits[used].view(np.int64))])

    rows = ids.select("doc").mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (ID_MAP_BITS - 6), dtype=np.uint64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def _among(rows: DataFrame, bits, wanted: bool) -> DataFrame:
    """The rows whose `_doc` may be in the map (`wanted`), or surely isn't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = mix(batch.column("_doc").to_numpy().view(np.uint64)) >> np.uint64(64 - ID_MAP_BITS)
            inside = (bits.value[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
            yield batch.filter(pa.array(inside if wanted else ~inside))

    return rows.mapInArrow(run, rows.schema)


def _cut_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the candidates of each document."""
    for batch in batches:
        for i in range(batch.num_rows):
            data = (batch.column("text")[i].as_py() or "").encode("utf-8", "surrogatepass")
            doc, tie = batch.column("_doc")[i].as_py(), batch.column("_tie")[i].as_py()
            runs = [r for r in batch.column("runs")[i].as_py() if r["at"] >> 40 == tie]
            at = np.array([r["at"] for r in runs], dtype=np.int64)
            start = (at >> 8) & 0xFFFFFFFF
            cut = [data[s : s + f + LENGTH] for s, f in zip(start.tolist(), (at & 255).tolist(), strict=True)]
            yield _batch(
                [("anchor", np.array([r["anchor"] for r in runs], dtype=np.int64)), ("doc", np.full(len(at), doc, dtype=np.int64)), ("at", at)]
            ).append_column("bytes", pa.array(cut, pa.binary()))


def _mark_windows(doc: np.ndarray, at: np.ndarray, window: np.ndarray) -> pa.RecordBatch:
    """Marks of windows given by their run and number in it."""
    start = (at >> 8) + window
    return _marks(doc, start, start + LENGTH)


def _index_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches sorted by anchor in; marks of the windows that an index finds earlier."""
    held: list[pa.RecordBatch] = []

    def build() -> pa.RecordBatch | None:
        part = pa.Table.from_batches(held)
        held.clear()
        doc, at = part["doc"].to_numpy(), part["at"].to_numpy()
        order = np.lexsort((at, doc))
        cut = part["bytes"].to_pylist()
        cut = [cut[i] for i in order]
        doc, at = doc[order], at[order]
        index = RunIndex(cut)
        owner = np.repeat(np.arange(len(cut)), [len(c) + 1 for c in cut])
        window = np.arange(len(owner)) - index.starts[owner]
        # Equal places (of equal rows) are one place; ranks keep documents in order.
        number = np.cumsum(np.concatenate([[False], doc[1:] != doc[:-1]]))
        tied = at >> 40
        step = np.concatenate([[False], (number[1:] != number[:-1]) | (tied[1:] != tied[:-1])])
        place = (np.cumsum(step)[owner].astype(np.int64) << 33) + ((at[owner] >> 8) & 0xFFFFFFFF) + window
        again = np.flatnonzero(index.repeats(place))
        return _mark_windows(doc[owner[again]], at[owner[again]], window[again]) if len(again) else None

    size = 0
    for batch in batches:
        anchor = batch.column(0).to_numpy()
        lengths = np.array([len(b) for b in batch.column(3).to_pylist()], dtype=np.int64)
        start = 0
        for cut in [*np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, len(anchor)]:
            open_group = held and held[-1].column(0)[-1].as_py() == int(anchor[start])
            if size > INDEX_BYTES and not open_group:
                made = build()
                size = 0
                if made is not None:
                    yield made
            held.append(batch.slice(start, cut - start))
            size += int(lengths[start:cut].sum())
            start = int(cut)
    if held:
        made = build()
        if made is not None:
            yield made


def _hot_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc, at, cut in zip(batch.column("doc").to_pylist(), batch.column("at").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
            hashed = window_hashes(cut)
            place = (at >> 8) + np.arange(len(hashed))
            yield _batch([("window", hashed), ("doc", np.full(len(hashed), doc, dtype=np.int64)), ("at", place)])


def _hot_repeats(stretches: DataFrame) -> DataFrame:
    """Marks of the windows of hot anchors, by the first place of each window's hash."""
    windows = write_and_read(stretches.mapInArrow(_hot_windows, "window long, doc long, at long"), "windows")
    first = windows.groupBy("window").agg(F.min(F.struct("doc", "at")).alias("first"))
    later = windows.join(first, "window").where(F.struct("doc", "at") > F.col("first"))
    return later.select(F.lit(True).alias("mark"), F.xxhash64("doc").alias("anchor"), (F.col("at") + LENGTH).alias("run"), "doc", "at")


def repeated_stretches(rows: DataFrame, hot_runs: int = HOT_RUNS) -> DataFrame:
    """(_doc, _spans): the marked stretches (start with the tie in its high bits, end) of each document."""
    spark = rows.sparkSession
    texts = rows.select("_doc", "_tie", "text")
    runs = texts.mapInArrow(_find_runs, _RUNS)
    found = runs.repartition(F.col("anchor")).sortWithinPartitions("mark", "anchor", "run", "doc", "at")
    found = write_and_read(found.mapInArrow(_stream_runs, _RUNS), "runs")
    candidates = found.where("not mark")
    hot = candidates.groupBy("anchor").agg(F.count("*").alias("n")).where(f"n > {hot_runs}").select("anchor")
    hot = write_and_read(hot, "hot")

    per_doc = candidates.groupBy("doc").agg(F.collect_list(F.struct("at", "anchor")).alias("runs"))
    bits = spark.sparkContext.broadcast(_id_map(candidates))
    cut = _among(texts, bits, True).join(per_doc.withColumnRenamed("doc", "_doc"), "_doc")
    cut = cut.select("_doc", "_tie", "text", "runs").mapInArrow(_cut_stretches, "anchor long, doc long, at long, bytes binary")
    marks = [found.where("mark")]
    if hot.isEmpty():
        cool = cut
    else:
        cut = write_and_read(cut, "stretches")
        cool = cut.join(hot, "anchor", "left_anti").select("anchor", "doc", "at", "bytes")
        marks.append(_hot_repeats(cut.join(hot, "anchor", "left_semi")))
    cool = cool.repartition(F.col("anchor")).sortWithinPartitions("anchor", "doc", "at")
    marks.append(cool.mapInArrow(_index_repeats, _RUNS))
    every = marks[0]
    for more in marks[1:]:
        every = every.unionByName(more)
    spans = every.groupBy(F.col("doc").alias("_doc")).agg(F.collect_list(F.struct(F.col("at").alias("s"), F.col("run").alias("e"))).alias("_spans"))
    return write_and_read(spans, "spans")


def _without(data: bytes, spans: list[dict], tie: int) -> tuple[bytes, int, int]:
    """What is left of a text, bytes removed and the number of maximal removed stretches."""
    own = sorted((x["s"] & 0xFFFFFFFF, x["e"] & 0xFFFFFFFF) for x in spans if x["s"] >> 32 == tie)
    left, at, removed, count = [], 0, 0, 0
    for start, end in own:
        if start > at or not count:
            left.append(data[at:start])
            count += 1
            removed += end - start
            at = end
        elif end > at:
            removed += end - at
            at = end
    left.append(data[at:])
    return b"".join(left), removed, count


_DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made: list[list] = [[], [], [], []]
        for i in range(batch.num_rows):
            data = (batch.column("text")[i].as_py() or "").encode("utf-8", "surrogatepass")
            left, removed, count = _without(data, batch.column("_spans")[i].as_py() or [], batch.column("_tie")[i].as_py())
            for values, value in zip(made, (len(data), removed, count, hashlib.sha256(left).hexdigest()), strict=True):
                values.append(value)
        columns = [batch.column("doc_id"), *(pa.array(v, pa.int64()) for v in made[:3]), pa.array(made[3], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _split_by_marks(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows joined with their spans, and rows that surely have none; only the former are moved."""
    spans = repeated_stretches(rows)
    bits = rows.sparkSession.sparkContext.broadcast(_id_map(spans.select(F.col("_doc").alias("doc"))))
    return _among(rows, bits, True).join(spans, "_doc", "left"), _among(rows, bits, False)


def repeat_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the remaining bytes)."""
    rows = keyed(docs.select(F.col("doc_id").cast("long"), "text"))
    marked, clean = _split_by_marks(rows)
    cut = marked.select("doc_id", "text", "_tie", "_spans").mapInArrow(_digests, _DIGEST)
    body = F.coalesce(F.col("text"), F.lit(""))
    zero = F.lit(0).cast("long")
    whole = clean.select(
        "doc_id", F.octet_length(body).cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"),
        F.sha2(body, 256).alias("kept_sha256"),
    )
    return cut.unionByName(whole)


def drop_repeats(docs: DataFrame) -> DataFrame:
    """`docs` without the repeated bytes; letters that a cut leaves incomplete go as well, and a
    column `n_chars` follows the text."""
    marked, clean = _split_by_marks(keyed(docs))
    schema = docs.schema
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for i in range(batch.num_rows):
                text = batch.column("text")[i].as_py()
                spans = batch.column("_spans")[i].as_py() or []
                if text and spans:
                    left, _, _ = _without(text.encode("utf-8", "surrogatepass"), spans, batch.column("_tie")[i].as_py())
                    text = left.decode("utf-8", "ignore")
                texts.append(text)
            made = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([made if c == "text" else batch.column(c) for c in names], names)

    out = marked.mapInArrow(run, schema).unionByName(clean.select(*names))
    return out.withColumn("n_chars", F.char_length("text").cast(schema["n_chars"].dataType)) if "n_chars" in names else out
