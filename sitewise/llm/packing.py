"""Packing documents into training sequences by conflict-constrained best fit.

A bin holds `capacity` tokens (words). A bin carries a bitmap of its sources and one of its duplicate
clusters; a document fits only where there is room and neither bit is set, so copies of a text and
documents of one source never share a bin. Open bins are kept by what is left in them. A document,
longest first, looks for the smallest rest that holds it, and goes on to the next larger rest until a
bin without conflict is found; only if none is left a new bin is opened.

A text longer than a bin is cut into pieces of full bins and a rest; nothing is dropped. Pieces are
dealt by hash into groups of bounded size, packed one group per task call, so bins of different groups
are independent and a hot source or cluster is spread over all groups. Only ids and sizes are shuffled.

Edge cases: a null or empty text has no token, goes to a bin and conflicts with nothing; a null source
conflicts with nothing; equal rows are copies of each other; ids may be null or repeated; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.llm.common import word_count
from sitewise.operators.staging import write_and_read

CAPACITY = 2048
#: Pieces of one group; the work of a call grows at most with its square.
GROUP_ROWS = 4096


class Bins:
    """Open bins by the room left in them."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.by_rest: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.rests = 0  # bit r is set if a bin has r tokens left
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.used: list[int] = []

    def tightest(self, size: int, source: int, cluster: int) -> int:
        """The bin with the smallest rest that holds the piece and has no conflict, or -1."""
        ahead = self.rests >> size
        rest = size
        while ahead:
            skip = (ahead & -ahead).bit_length() - 1
            rest += skip
            for i in self.by_rest[rest]:
                if not (self.sources[i] & source or self.clusters[i] & cluster):
                    return i
            ahead >>= skip + 1
            rest += 1
        return -1

    def put(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset) of the piece; `source` and `cluster` are single bits, or 0 for no conflict."""
        i = self.tightest(size, source, cluster)
        if i < 0:
            i = len(self.used)
            self.used.append(0)
            self.sources.append(0)
            self.clusters.append(0)
        else:
            rest = self.capacity - self.used[i]
            self.by_rest[rest].remove(i)
            if not self.by_rest[rest]:
                self.rests &= ~(1 << rest)
        offset = self.used[i]
        self.used[i] += size
        self.sources[i] |= source
        self.clusters[i] |= cluster
        rest = self.capacity - self.used[i]
        self.by_rest[rest].append(i)
        self.rests |= 1 << rest
        return i, offset


def bits(values: Iterator, sizes: list[int]) -> list[int]:
    """One bit per distinct value; 0 for null and for pieces without tokens."""
    seen: dict = {}
    return [0 if v is None or not n else 1 << seen.setdefault(v, len(seen)) for v, n in zip(values, sizes, strict=True)]


def pack_sizes(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int, int]]:
    """(bin, offset, tokens in the finished bin) of every piece, in the order given."""
    bins = Bins(capacity)
    source, cluster = bits(sources, sizes), bits(clusters, sizes)
    placed: list = [None] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        placed[i] = bins.put(sizes[i], source[i], cluster[i])
    return [(b, at, bins.used[b]) for b, at in placed]


def pieces(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, source, cluster, piece, start_token, n_tokens: each text cut into stretches of a bin at most."""
    rows = docs.select(
        "doc_id", F.col("source").cast("string").alias("source"), F.md5(F.coalesce("text", F.lit(""))).alias("cluster"),
        word_count(F.col("text")).alias("_n"),
    )
    last = F.greatest(F.ceil(F.col("_n") / capacity).cast("long") - 1, F.lit(0).cast("long"))
    cut = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    start = F.col("piece") * capacity
    return cut.select(
        "doc_id", "source", "cluster", "piece", start.alias("start_token"),
        F.least(F.col("_n") - start, F.lit(capacity)).cast("long").alias("n_tokens"),
    )


def pack(docs: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, spread_sources: bool = True) -> DataFrame:
    """One row per piece: doc_id, source, piece, start_token, n_tokens, bin_id, bin_offset, bin_tokens."""
    cut = write_and_read(pieces(docs, capacity), "pieces")
    groups = max(1, -(-cut.count() // group_rows))
    order = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "piece", "cluster"))
    dealt = cut.withColumns({"_order": order, "doc_id": F.col("doc_id").cast("string")}).withColumn("_group", F.pmod(F.xxhash64("_order"), F.lit(groups)).cast("long"))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["_order", "source"], na_position="last", kind="stable")
        sources = [s if isinstance(s, str) and spread_sources else None for s in part["source"]]
        placed = pack_sizes([int(n) for n in part["n_tokens"]], sources, list(part["cluster"]), capacity)
        return pd.DataFrame(
            {
                "doc_id": part["doc_id"].to_numpy(),  # as text: pandas would turn long ids with nulls to floats
                "source": part["source"].to_numpy(),
                "piece": part["piece"].to_numpy(),
                "start_token": part["start_token"].to_numpy(),
                "n_tokens": part["n_tokens"].to_numpy(),
                "bin_id": [(key[0] << 32) + b for b, _, _ in placed],
                "bin_offset": [at for _, at, _ in placed],
                "bin_tokens": [n for _, _, n in placed],
            }
        )

    schema = "doc_id string, source string, piece long, start_token long, n_tokens long, bin_id long, bin_offset long, bin_tokens long"
    return dealt.groupBy("_group").applyInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast("long"))
