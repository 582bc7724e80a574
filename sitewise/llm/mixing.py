"""Mixing sources to target weights by weighted fair queueing.

Each source queues its documents in a hashed order, a second and further time when its target is
above its size. A document's virtual finish time is the source's cumulative tokens divided by the
source's target. All documents are served in the order of that time until the total budget is used,
so at any moment every source has been served in proportion to its target.

Both cumulative sums are prefix sums over buckets of bounded size: hash ranges inside a source, and
ranges of the finish time over all. No window holds a whole source.

Edge cases: a null text has size 0; a null source is a source, after the others; documents of size 0
take part and take nothing; equal rows are served one after the other; an empty table gives an empty
result; a source without tokens has target 0; `mix` keeps further columns, `plan_mix` ignores them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitewise.llm.common import (
    HASH_BITS,
    before,
    bucket_bits,
    md5_number,
    null_safe_join,
    word_count,
)
from sitewise.operators.staging import write_and_read

WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
SEED = 7


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS
) -> DataFrame:
    """(source, source_size, target) from rows (source, size), one row per source.

    The budget is shared by weight; a source stops at `repeats` times its size and what it leaves is
    reshared by weight. That is the water level at which the targets sum to the budget. With the
    sources in the order of size over weight, those below the level form the head of the list.
    The windows here hold one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    every = Window.partitionBy(F.lit(0))
    nth = F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (nth % len(weights) + 1).cast("int"))
    per = per.withColumn("_w", weight).withColumn("_most", F.col("source_size") * F.lit(float(repeats)))
    per = per.withColumn("_ratio", F.col("_most") / F.col("_w"))
    filling = every.orderBy("_ratio", F.col("source").asc_nulls_last())
    per = (
        per.withColumn("_budget", F.sum("source_size").over(every) * F.lit(share))
        .withColumn("_below", F.coalesce(F.sum("_most").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_rest", F.sum("_w").over(filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("_level", (F.col("_budget") - F.col("_below")) / F.col("_rest"))
    )
    level = F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(every)
    target = F.coalesce(F.least(F.col("_most"), level * F.col("_w")), F.col("_most"))
    return per.select("source", "source_size", target.alias("target"))


def plan_mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    repeats: int = REPEATS,
    seed: int = SEED,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies (times the mix takes it)
    and taken (tokens it takes)."""
    salt = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    slim = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), md5_number(salt).alias("_hash"))
    return serve(write_and_read(slim, "sizes"), weights, share, repeats)


def mix(docs: DataFrame, **parameters) -> DataFrame:
    """The mix as rows of `docs`, each as often as it was taken; parameters as in `plan_mix`.

    Rows with equal id, source and size share the copies given to them, in the order of their texts.
    """
    keys = ["doc_id", "source", "size"]
    plan = plan_mix(docs, **parameters).groupBy(*keys).agg(F.sum("copies").alias("_all"), F.count("*").alias("_rows"))
    full = docs.withColumn("_size", word_count(F.col("text")))
    plan = plan.where("_all > 0").withColumnsRenamed({k: f"_p_{k}" for k in keys})
    out = full.join(
        plan,
        F.col("doc_id").eqNullSafe(F.col("_p_doc_id"))
        & F.col("source").eqNullSafe(F.col("_p_source"))
        & (F.col("_size") == F.col("_p_size")),
    )
    nth = F.row_number().over(Window.partitionBy("doc_id", "source", "_size").orderBy("text")) - 1
    one = out.where("_rows = 1").withColumn("_copies", F.col("_all").cast("int"))
    more = out.where("_rows > 1").withColumn(
        "_copies", (F.floor(F.col("_all") / F.col("_rows")) + (nth < F.col("_all") % F.col("_rows")).cast("int")).cast("int")
    )
    both = one.unionByName(more).where("_copies > 0")
    return both.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)


def serve(
    slim: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS
) -> DataFrame:
    """Rows (doc_id, source, size, _hash) with source_size, target, copies and taken."""
    total = slim.agg(F.count("*").alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("tokens")).first()
    bits = bucket_bits(total["rows"])
    targets = source_targets(slim, weights, share, repeats)
    queue = slim.withColumn("_bucket", F.shiftright("_hash", HASH_BITS - bits))
    heads = queue.groupBy("source", "_bucket").agg(F.sum("size").alias("_n"))
    heads = heads.select("source", "_bucket", before("_n", ["source"], ["_bucket"]).alias("_before"))
    heads = null_safe_join(heads, targets, ["source"])
    inside = Window.partitionBy("source", "_bucket").orderBy("_hash", "doc_id", "size")
    queue = queue.withColumn(
        "_in", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ).withColumn("_nth", F.row_number().over(inside))
    queue = null_safe_join(queue, heads, ["source", "_bucket"])
    queue = queue.withColumn("_done", F.col("_before") + F.col("_in"))

    turns = queue.withColumn("_turn", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    finish = F.when(
        F.col("target") > 0, (F.col("_turn") * F.col("source_size") + F.col("_done")).cast("double") / F.col("target")
    ).otherwise(F.lit(0.0))
    cuts = 1 << bits
    turns = turns.withColumn("_finish", finish).withColumn(
        "_range", F.least(F.floor(F.col("_finish") * cuts), F.lit(repeats * 64 * cuts)).cast("long")
    )
    turns = write_and_read(
        turns.select("doc_id", "source", "size", "_hash", "_nth", "source_size", "target", "_finish", "_turn", "_range"), "turns"
    )
    ahead = turns.groupBy("_range").agg(F.sum("size").alias("_n"))
    ahead = ahead.select("_range", before("_n", [], ["_range"]).alias("_ahead"))
    line = Window.partitionBy("_range").orderBy(
        "_finish", F.col("source").asc_nulls_last(), "_turn", "_hash", "doc_id", "size", "_nth"
    )
    served = turns.withColumn(
        "_in", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ).join(ahead, "_range")
    served = served.withColumn("_taken", (F.col("_ahead") + F.col("_in") <= F.lit(total["tokens"] * share)).cast("int"))
    return (
        served.groupBy("doc_id", "source", "size", "_hash", "_nth", "source_size", "target")
        .agg(F.sum("_taken").cast("int").alias("copies"))
        .select(
            "doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")
        )
    )
