"""Island labels of sites, and filters, orders and scales of expression tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.functions.genes import is_gene, strand_pos
from sitewise.functions.islands import island_label
from sitewise.functions.loci import gene_chr_order
from sitewise.functions.numeric import edge_bin, min_max
from sitewise.operators.ranking import exact_quantiles, join_back
from sitewise.operators.sets import dedupe, drop_repeated


def island_tuples(labels: DataFrame, key: str, order: str, location: str, index: str) -> DataFrame:
    """Ordered label list and its length per site; equal (order, label) rows of a site count once each.

    The list is the output, one per site, with as many labels as the site has islands.
    """
    cells = F.array_sort(
        F.collect_list(F.struct(F.col(order).alias("o"), island_label(location, index).alias("label")))
    )
    return labels.groupBy(key).agg(
        F.array_join(F.transform(cells, lambda s: s["label"]), ",").alias("cpg_island_tuple"),
        F.count("*").alias("num_cpg_island_tuple"),
    )


def annotation_genes(gtf: DataFrame, coding_only: bool) -> DataFrame:
    """Genes of an annotation table without the ids that occur more than once."""
    genes = gtf.where(is_gene("feature", "gene_type", coding_only)).select(
        F.substring_index("gene_id", ".", 1).alias("gene_id"),
        "gene_name",
        "chr",
        strand_pos("strand", "start", "end").alias("gene_pos"),
        (F.col("gene_type") == "protein_coding").alias("is_protein_coding"),
    )
    return drop_repeated(genes, ["gene_id"])


def variable_genes(long: DataFrame, gene: str, value: str, mean_min: float, std_min: float) -> DataFrame:
    """Genes whose mean and spread over samples reach both thresholds."""
    return (
        long.groupBy(gene)
        .agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
        .where((F.col("mean") >= F.lit(mean_min)) & (F.col("std") >= F.lit(std_min)))
    )


def order_genes(expr_genes: DataFrame, positions: DataFrame, gene: str = "gene_id") -> DataFrame:
    """Expression genes with chromosome order and position; the first position of an id counts."""
    first = dedupe(positions.select(gene, "chr", "gene_pos"), [gene], ["chr", "gene_pos"])
    return expr_genes.join(
        first.select(gene, gene_chr_order("chr").alias("chr_order"), "gene_pos"), gene, "left"
    )


def quantile_table(stats: DataFrame, columns: list[str], steps: int, tie: list[str]) -> DataFrame:
    """Quantiles of each column at equal steps, with the rows below and above each of them."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("stat"), F.col(c).alias("value")) for c in columns]))
    long = stats.select(*tie, each.alias("_s")).select(*tie, "_s.stat", "_s.value")
    sizes = long.groupBy("stat").agg(F.count("*").alias("num_rows"))
    probs = [i / (steps - 1) for i in range(steps)]
    table = exact_quantiles(long, ["stat"], "value", probs, tie)
    below = F.floor(F.col("num_rows") * F.col("q"))
    return table.join(sizes, "stat").select(
        "stat", "q", "quantile", below.alias("num_below"), (F.col("num_rows") - below).alias("num_remaining")
    )


def quantile_bins(long: DataFrame, sample: str, value: str, bins: int, tie: list[str]) -> DataFrame:
    """Bin number of each positive value inside its sample, zero elsewhere, and bin / largest bin.

    The bin is the number of quantile edges at or below the value. The largest value of a sample
    reaches every edge, so the largest bin is the number of edges.
    """
    num_edges = bins - 1
    probs = [i / (num_edges - 1) for i in range(num_edges)]
    positive = long.where(F.col(value) > 0)
    edges = (
        exact_quantiles(positive, [sample], value, probs, tie)
        .groupBy(sample)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("q_no", "quantile"))), lambda s: s["quantile"]).alias("_e"))
    )
    number = F.when(F.col(value) > 0, edge_bin(value, "_e")).otherwise(F.lit(0))
    return (
        join_back(long, edges, [sample], "left")
        .withColumn("bin", number)
        .withColumn("scaled", F.col("bin") / F.lit(num_edges))
        .drop("_e")
    )


def scale_min_max(long: DataFrame, sample: str, value: str) -> DataFrame:
    limits = long.groupBy(sample).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    return long.join(limits, sample).withColumn("scaled", min_max(value, "_low", "_high")).drop("_low", "_high")
