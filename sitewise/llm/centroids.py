"""Exact Lloyd rounds over integer vectors that skip most of the distance work.

A row carries its cluster, a distance to its own centroid (upper bound) and one lower bound for the
distances to all others. When centroids move, the rows of a cluster lie in a sphere around the old
centroid, and seen from centroid j that sphere is a disc in the plane of the two centroids and j's new
place. Over the disc the distance to j can shrink by less than j's drift when the sphere lies off the
line of movement, so the lower bound is loosened by the largest such loss instead of the largest drift.
Rows whose bounds still overlap are compared with all centroids in exact integers.

Each pass reads the rows once and writes them with the new bounds and one partial sum per cluster and
task; only k sums come to the driver, which holds k centroids. A pass shuffles nothing but these sums.

Edge cases. Rows whose vector is null, has another length or a null or non-finite component are left
out. Components beyond +-2^27 after scaling are set to that, so that a squared distance fits a long;
inertias beyond a long are set to its largest value. Equal distances go to the smaller cluster number.
A null id is hashed as `null` and kept; repeated rows are rows of their own, and equal hashes are told
apart by the vectors. With fewer rows than k there are as many clusters as rows. An empty table gives an
empty result. Only the id and the vector are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from sitewise.operators.staging import staging_path

#: Largest component after scaling; 64 squared differences of such numbers fit a long.
MOST = 1 << 27
LONGEST_SUM = (1 << 63) - 1
#: Pieces of a centroid's way in the bound; more pieces give a tighter bound.
STEPS = 16
#: Room for rounding in the comparison of bounds.
SLACK = 1e-9
#: Below this size all products and their sums are exact in doubles.
EXACT_IN_DOUBLE = 1 << 20

_PART = "part struct<cluster:int,n:bigint,reach:double,inertia:decimal(38,0),scanned:bigint,sums:array<bigint>>"


def usable(vector: Column, dim: int) -> Column:
    """Exactly `dim` components, none null or non-finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) == dim) & finite


def quantised(batch: pa.Array, dim: int, scale: float) -> np.ndarray:
    flat = batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(flat * scale), -MOST, MOST).astype(np.int64).reshape(-1, dim)


def nearest(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, squared distance, squared distance to the second) of each row, exact; ties to the smaller."""
    small = max(np.abs(vectors).max(initial=0), np.abs(centres).max(initial=0)) <= EXACT_IN_DOUBLE
    kind = np.float64 if small and vectors.shape[1] <= 1024 else np.int64
    v, c = vectors.astype(kind), centres.astype(kind)
    dist = (v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)[None, :]
    rows, best = np.arange(len(v)), dist.argmin(1)
    first = dist[rows, best].astype(np.int64)
    if len(c) == 1:
        return best, first, np.full(len(v), np.inf)
    dist = dist.astype(np.float64)
    dist[rows, best] = np.inf
    return best, first, dist.min(1)


def loosening(old: np.ndarray, new: np.ndarray, reach: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """For each cluster, the most that any other centroid's distance to a row of it can have shrunk.

    `reach[i]` bounds the distance of i's rows to `old[i]`. While centroid j walks by d, the distance to a
    row shrinks at the rate |d| cos(a), a being the angle between d and the row as seen from j. The
    sphere's middle is seen at an angle that only grows on the way, the sphere within
    asin(reach / distance) of it; both are bounded for each of `steps` pieces of the way.
    """
    k = len(old)
    out = np.full(k, -np.inf)
    if k == 1:
        return out
    way = (new - old).astype(np.float64)
    length = np.sqrt((way * way).sum(1))
    moved = length > 0
    unit = np.divide(way, length[:, None], out=np.zeros_like(way), where=moved[:, None])
    for i in range(k):
        to = old[i].astype(np.float64) - old
        along = (to * unit).sum(1)  # place of the middle in the plane: along the way, and off it
        off = np.sqrt(np.maximum((to * to).sum(1) - along * along, 0.0))
        loss = np.zeros(k)
        for s in range(steps):
            start, end = length * s / steps, length * (s + 1) / steps
            angle = np.arctan2(off, along - start)
            gap = np.hypot(off, along - np.clip(along, start, end))
            wide = np.where(gap > reach[i], np.arcsin(np.minimum(1.0, reach[i] / np.maximum(gap, 1e-300))), np.pi)
            loss += length / steps * np.cos(np.maximum(0.0, angle - wide))
        loss = loss + SLACK * (length + np.abs(along) + off)
        loss[i] = -np.inf
        out[i] = np.minimum(loss, length * (1 + SLACK)).max()
    return out


class Pass:
    """One assignment of every row, with what its batches add up to."""

    def __init__(self, centres: np.ndarray, loose: np.ndarray | None, drift: np.ndarray | None):
        self.centres, self.loose, self.drift = centres, loose, drift
        k, dim = centres.shape
        self.n = np.zeros(k, np.int64)
        self.sums = np.zeros((k, dim), np.int64)
        self.reach = np.zeros(k)
        self.inertia = [0] * k
        self.scanned = 0

    def assign(self, v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        if self.loose is None:
            open_rows = np.arange(len(v))
            distance = np.zeros(len(v), np.int64)
        else:
            lower = lower - self.loose[cluster]
            own = v - self.centres[cluster]
            distance = (own * own).sum(1)
            upper = np.sqrt(distance.astype(np.float64))
            sure = upper * (1 + SLACK) + SLACK < lower * (1 - SLACK)
            open_rows = np.flatnonzero(~sure)
        if len(open_rows):
            best, first, second = nearest(v[open_rows], self.centres)
            cluster, upper, lower = cluster.copy(), upper.copy(), lower.copy()
            cluster[open_rows], distance[open_rows] = best, first
            upper[open_rows], lower[open_rows] = np.sqrt(first.astype(np.float64)), np.sqrt(second)
        self.scanned += len(open_rows)
        order = np.argsort(cluster, kind="stable")
        found, start = np.unique(cluster[order], return_index=True)
        if len(found):
            self.n[found] += np.diff([*start, len(v)])
            self.sums[found] += np.add.reduceat(v[order], start, axis=0)
            self.reach[found] = np.maximum(self.reach[found], np.maximum.reduceat(upper[order], start))
            for c, rows in zip(found, np.split(order, start[1:])):
                self.inertia[c] += sum(distance[rows].tolist())
        return cluster, upper, lower, distance

    def parts(self) -> list[dict]:
        return [
            {
                "cluster": c, "n": int(self.n[c]), "reach": float(self.reach[c]), "inertia": Decimal(self.inertia[c]),
                "scanned": self.scanned if c == 0 else 0, "sums": self.sums[c].tolist(),
            }
            for c in range(len(self.n))
        ]


def _run_pass(rows: DataFrame, path: str, centres, loose, drift, dim: int, scale: float) -> DataFrame:
    """Assign `rows` (the table itself, or an earlier pass), write the outcome to `path` and read it."""
    first = "embedding" in rows.columns
    own = "v binary, cluster int, upper double, lower double, distance bigint, " + _PART
    schema = StructType([StructField("vec_id", rows.schema["vec_id"].dataType), *StructType.fromDDL(own)])
    arrow = to_arrow_schema(schema)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = Pass(centres, loose, drift)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if first:
                v = quantised(batch.column("embedding"), dim, scale)
                cluster, upper, lower = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
                packed = pa.array([r.tobytes() for r in v.astype(np.int32)], pa.binary())
            else:
                packed = batch.column("v")
                v = np.frombuffer(b"".join(packed.to_pylist()), np.int32).reshape(n, dim).astype(np.int64)
                cluster, upper, lower = (batch.column(c).to_numpy() for c in ("cluster", "upper", "lower"))
            cluster, upper, lower, distance = work.assign(v, cluster.astype(np.int64), upper, lower)
            made = [batch.column("vec_id"), packed, cluster.astype(np.int32), upper, lower, distance]
            columns = [pa.array(m).cast(arrow.field(i).type) for i, m in enumerate(made)]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(n, arrow.field("part").type)], names)
        parts = pa.array(work.parts(), arrow.field("part").type)
        yield pa.RecordBatch.from_arrays([*[pa.nulls(len(parts), arrow.field(i).type) for i in range(6)], parts], names)

    rows.mapInArrow(run, schema).write.parquet(path)
    return rows.sparkSession.read.schema(schema).parquet(path)


def _totals(written: DataFrame, k: int, dim: int) -> tuple[np.ndarray, list[list[int]], np.ndarray, list[int], int]:
    """Counts, sums, reach and inertia of each cluster: k * dim numbers, added up before they come here."""
    part = written.where("part is not null").select("part.*")
    made = part.select("*", F.posexplode("sums").alias("i", "x")).groupBy("cluster", "i").agg(
        F.sum(F.col("x").cast("decimal(28,0)")).alias("x"),
        *[F.sum(c).alias(c) for c in ("n", "inertia", "scanned")],
        F.max("reach").alias("reach"),
    )
    n, sums, reach, inertia, scanned = np.zeros(k, np.int64), [[0] * dim for _ in range(k)], np.zeros(k), [0] * k, 0
    for r in made.collect():
        c = r["cluster"]
        sums[c][r["i"]] = int(r["x"])
        if r["i"] == 0:
            n[c], reach[c], inertia[c] = r["n"], r["reach"], int(r["inertia"])
            scanned += r["scanned"]
    return n, sums, reach, inertia, scanned


def _delete(spark, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cluster_vectors(
    df: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: float = 256.0, seed: str = "2",
    key: str = "vec_id", vector: str = "embedding", trace: list[dict] | None = None,
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector.

    Centroids start as the k rows with the smallest sha256 of `seed:id`. Each of `rounds` rounds assigns
    every row to the nearest centroid and moves each centroid that has rows to the floor of their mean;
    then rows are assigned once more. `trace` takes one record a pass: rows, rows scanned against all
    centroids, the loosening and the drift of each cluster.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("vec_id"), F.col(vector).alias("embedding")).where(usable(F.col("embedding"), dim))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    # k rows, k being a parameter.
    firsts = rows.select(digest.alias("h"), F.col("embedding").cast("array<double>").alias("e")).orderBy("h", "e").limit(k).collect()
    if not firsts:
        none = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], StructType([StructField("vec_id", rows.schema["vec_id"].dataType), *StructType.fromDDL(none)]))
    centres = quantised(pa.array([r["e"] for r in firsts], pa.list_(pa.float64())), dim, scale)
    k = len(centres)
    loose = drift = None
    state, last, written = rows, None, rows
    for step in range(rounds + 1):
        path = staging_path(spark, "centroids")
        written = _run_pass(state, path, centres, loose, drift, dim, scale)
        n, sums, reach, inertia, scanned = _totals(written, k, dim)
        if trace is not None:
            trace.append({"rows": int(n.sum()), "scanned": scanned, "loose": loose, "drift": drift})
        if last:
            _delete(spark, last)
        state, last = written.where("part is null").drop("part", "distance"), path
        if step < rounds:
            new = np.array([[s // int(m) for s in row] if m else c for row, m, c in zip(sums, n, centres.tolist())], np.int64)
            way = (new - centres).astype(np.float64)
            drift = np.sqrt((way * way).sum(1))
            loose = loosening(centres, new, reach)
            centres = new
    told = [
        (c, min(inertia[c], LONGEST_SUM), min(sum(inertia), LONGEST_SUM), hashlib.sha256(",".join(map(str, row)).encode()).hexdigest())
        for c, row in enumerate(centres.tolist())
    ]
    # k rows, k being a parameter.
    facts = F.broadcast(spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    found = written.where("part is null").select("vec_id", "cluster", "distance")
    return found.join(facts, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
