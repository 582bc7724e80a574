"""Scores by (group, key) over everything a stream has brought, in a table that stays small to read.

Each batch is reduced to mergeable moments per key and written as one delta. After every few batches the
deltas and the last base are merged into a new base, so a reader opens one base and a bounded number of
deltas, however long the stream has run. The stream itself keeps no state.

A batch that runs again writes its own delta again, and a base names the last batch it holds, so nothing is
counted twice after a crash at any point.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Count, means, and sums of squared and mixed deviations; squared and absolute errors.
FIELDS = ("n", "mx", "my", "cxx", "cyy", "cxy", "sse", "sae")


def batch_moments(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Moments of the rows that have both values, one row per key.

    A constant is its own mean, to the last bit: a rounded one would differ from that of the next batch, and
    a merge would see a spread where there is none.
    """
    full = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    error = F.col(x) - F.col(y)
    n = F.count("*").cast("double")
    mean = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).otherwise(F.avg(c))
    return full.groupBy(*keys).agg(
        n.alias("n"), mean(x).alias("mx"), mean(y).alias("my"), (F.var_pop(x) * n).alias("cxx"), (F.var_pop(y) * n).alias("cyy"),
        (F.covar_pop(x, y) * n).alias("cxy"), F.sum(error * error).alias("sse"), F.sum(F.abs(error)).alias("sae"),
    )


def _merged(a: Column, b: Column) -> Column:
    """Moments of two disjoint sets as those of their union."""
    n = a["n"] + b["n"]
    dx, dy, w = b["mx"] - a["mx"], b["my"] - a["my"], a["n"] * b["n"] / n
    made = {
        "n": n, "mx": a["mx"] + dx * b["n"] / n, "my": a["my"] + dy * b["n"] / n, "cxx": a["cxx"] + b["cxx"] + dx * dx * w,
        "cyy": a["cyy"] + b["cyy"] + dy * dy * w, "cxy": a["cxy"] + b["cxy"] + dx * dy * w, "sse": a["sse"] + b["sse"],
        "sae": a["sae"] + b["sae"],
    }
    return F.struct(*[made[f].alias(f) for f in FIELDS])


def merge(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Moments of several tables as one; a key has at most one row per table."""
    stacked = reduce(lambda a, b: a.unionByName(b), [p.withColumn("_nth", F.lit(i)) for i, p in enumerate(parts)])
    lists = stacked.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_nth", *FIELDS))).alias("_l"))
    moments = F.transform("_l", lambda m: F.struct(*[m[f].alias(f) for f in FIELDS]))
    one = F.aggregate(F.slice(moments, 2, len(parts)), moments[0], _merged)
    return lists.select(*keys, one.alias("_m")).select(*keys, "_m.*")


def scores(moments: DataFrame, keys: list[str]) -> DataFrame:
    """Rows seen, correlation, mean squared and mean absolute error per key."""
    spread = F.col("cxx") * F.col("cyy")
    pcc = F.when((F.col("n") > 1) & (F.col("cxx") > 0) & (F.col("cyy") > 0), F.col("cxy") / F.sqrt(spread))
    return moments.select(
        *keys, F.col("n").cast("bigint").alias("n"), pcc.alias("pcc"), (F.col("sse") / F.col("n")).alias("mse"), (F.col("sae") / F.col("n")).alias("mae")
    )


class MomentTable:
    """A base and its deltas under one path: `base=<last batch held>` and `delta=<batch>`."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], compact_every: int = 16):
        self.spark, self.path, self.keys, self.compact_every = spark, path.rstrip("/"), keys, compact_every

    def _where(self, name: str = ""):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _finished(self) -> list[tuple[str, int]]:
        files, root = self._where()
        if not files.exists(root):
            return []
        names = [s.getPath().getName() for s in files.listStatus(root) if s.isDirectory()]
        found = [(m[1], int(m[2])) for n in names if (m := re.fullmatch(r"(base|delta)=(\d+)", n))]
        return [f for f in found if files.exists(self._where(f"{f[0]}={f[1]}/_SUCCESS")[1])]

    def folders(self) -> list[str]:
        """What a reader opens: the newest base and the deltas after it."""
        found = self._finished()
        base = max((b for kind, b in found if kind == "base"), default=-1)
        deltas = sorted(b for kind, b in found if kind == "delta" and b > base)
        return ([f"base={base}"] if base >= 0 else []) + [f"delta={b}" for b in deltas]

    def save(self, batch: DataFrame, batch_id: int) -> None:
        """Add the moments of one batch, then merge and clear if it is time."""
        held = max((b for kind, b in self._finished() if kind == "base"), default=-1)
        if held >= batch_id:  # the run before stopped between merging and its own commit
            return
        batch.write.mode("overwrite").parquet(f"{self.path}/delta={batch_id}")
        if (batch_id + 1) % self.compact_every == 0:
            self.moments().write.mode("overwrite").parquet(f"{self.path}/base={batch_id}")
            for kind, b in self._finished():
                if b < batch_id or kind == "delta":
                    files, at = self._where(f"{kind}={b}")
                    files.delete(at, True)

    def moments(self) -> DataFrame | None:
        """Moments of everything saved so far; None before the first batch."""
        parts = [self.spark.read.parquet(f"{self.path}/{f}") for f in self.folders()]
        return merge(parts, self.keys) if parts else None

    def follow(self, stream: DataFrame, x: str, y: str, checkpoint: str) -> StreamingQuery:
        """Add the batches of a stream until its shards are used up."""
        return (
            stream.writeStream.option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .foreachBatch(lambda rows, batch_id: self.save(batch_moments(rows, self.keys, x, y), batch_id))
            .start()
        )
