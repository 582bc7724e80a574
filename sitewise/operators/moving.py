"""Moving sums over the last n rows of a log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitewise.operators.ranking import ranked


def seconds_of(interval):
    """Length of a day-time interval; needs no time zone."""
    parts = {"DAY": 86400, "HOUR": 3600, "MINUTE": 60, "SECOND": 1}
    return sum(F.extract(F.lit(p), interval).cast("double") * F.lit(float(s)) for p, s in parts.items())


def moving_rate(log: DataFrame, run: str, order: list[str], time: str, amount: str, n: int, block: int = 65536):
    """Rows, amount and amount per second over the last n rows of each run.

    A run is cut into blocks of consecutive rows and each block also gets the n - 1 rows before
    it, so the window of a long run is spread over many tasks.
    """
    if n > block:
        raise ValueError("the window must not be longer than a block")
    placed = ranked(log, [run], order, "_place").withColumn("_own", F.floor(F.col("_place") / F.lit(block)))
    helps_next = F.pmod(F.col("_place"), F.lit(block)) > F.lit(block - n)
    blocks = F.when(helps_next, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own"))
    in_order = Window.partitionBy(run, "_block").orderBy("_place")
    last_n = in_order.rowsBetween(-(n - 1), 0)
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    # Offsets and running frames cost the same for any n; only the sum slides.
    start = F.coalesce(F.lag(time, n - 1).over(in_order), F.first(time).over(so_far))
    return (
        placed.withColumn("_block", F.explode(blocks))
        .withColumn("num_rows", F.least(F.col("_place") + 1, F.lit(n)))
        .withColumn("amount", F.sum(amount).over(last_n))
        .withColumn("seconds", seconds_of(F.col(time) - start))
        .where("_block = _own")
        .withColumn("rate", F.try_divide(F.col("amount"), F.col("seconds")))
        .select(run, *order, "num_rows", "amount", "seconds", "rate")
    )
