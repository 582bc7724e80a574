"""Assembly of sites and export of labelled pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.functions.loci import chr_index, in_chromosomes
from sitewise.functions.sequence import center_crop, has_unknown_base
from sitewise.operators.audits import key_differences
from sitewise.operators.layout import dealt


def assemble_sites(windows: DataFrame, islands: DataFrame, key: str = "cpg_idx") -> DataFrame:
    """One row per site: the site and its window, with its island labels.

    Both tables must hold the same keys; `unassembled` lists those that only one has.
    """
    return windows.join(islands.select(key, "cpg_island_tuple", "num_cpg_island_tuple"), key)


def unassembled(windows: DataFrame, islands: DataFrame, key: str = "cpg_idx") -> DataFrame:
    """Keys of one side only; pass them to `audits.enforce` to refuse an incomplete assembly."""
    return key_differences(windows, islands, key)


def usable_sites(
    assembled: DataFrame, chromosomes: list[str] | None = None, crop: int | None = None, encode=None
) -> DataFrame:
    """Sites of the listed chromosomes whose window has no N, with `chr_idx`.

    A contig outside the known list fails the job; name the chromosomes to leave others out.
    With `crop` the test and the output use the centre of the window only. `encode` turns the
    kept sequence into an array; it runs once per site, before the pairs multiply the rows.
    """
    rows = assembled.where(in_chromosomes("chr", chromosomes)) if chromosomes else assembled
    seq: Column = F.upper(center_crop("sequence", crop)) if crop else F.upper(F.col("sequence"))
    kept = (
        rows.withColumn("_seq", seq)
        .where(~has_unknown_base("_seq"))
        .withColumn("chr_idx", chr_index("chr", strict=True))
    )
    if encode is not None:
        return kept.withColumn("tokenized_sequence", encode(F.col("_seq"))).drop("sequence", "_seq")
    return kept.withColumn("sequence", F.col("_seq")).drop("_seq") if crop else kept.drop("_seq")


def export_pairs(
    pairs: DataFrame, sites: DataFrame, samples: DataFrame, groups: DataFrame, tasks: int | None = None
) -> DataFrame:
    """Pairs with site annotation, tissue and split number.

    `pairs` carries (cpg_idx, sample_idx, methylation) and the columns `groups` numbers: split, or
    source and split. `groups` is a list of a few names, so it is broadcast: dealt by split, all pairs would lie
    in as many tasks as there are names. Pairs stay slim until the last join, which brings in the site
    annotation. With `tasks` they meet the samples in that many tasks; the sites lie as the caller has dealt them.
    """
    labels = [c for c in groups.columns if c != "group_idx"]
    site_columns = [c for c in sites.columns if c not in ("cpg_idx", "chr", "pos", "chr_pos")]
    return (
        pairs.join(F.broadcast(groups), labels)
        .drop(*labels)
        .join(dealt(samples.select("sample_idx", "tissue_idx"), "sample_idx", tasks), "sample_idx")
        .join(sites.select("cpg_idx", *site_columns), "cpg_idx")
    )


def export_slim(
    pairs: DataFrame,
    sites: DataFrame,
    samples: DataFrame,
    site_subset: DataFrame | None = None,
    sample_subset: DataFrame | None = None,
) -> DataFrame:
    """Four columns of the pairs at usable sites, optionally of listed sites and samples only."""
    rows = pairs
    if site_subset is not None:
        rows = rows.join(site_subset.select("cpg_idx"), "cpg_idx", "left_semi")
    if sample_subset is not None:
        rows = rows.join(sample_subset.select("sample_idx"), "sample_idx", "left_semi")
    return (
        rows.join(sites.select("cpg_idx"), "cpg_idx", "left_semi")
        .join(samples.select("sample_idx", "tissue_idx"), "sample_idx")
        .select("cpg_idx", "methylation", "sample_idx", "tissue_idx")
    )


def group_table(spark, splits: list[str]) -> DataFrame:
    """Split names numbered by their list position."""
    return spark.createDataFrame([(s, i) for i, s in enumerate(splits)], "split string, group_idx int")


def recipe_table(spark, recipe: list[tuple[str, str]]) -> DataFrame:
    """(source, split) pairs of an export recipe, numbered by their list position."""
    rows = [(source, split, i) for i, (source, split) in enumerate(recipe)]
    return spark.createDataFrame(rows, "source string, split string, group_idx int")


def track_lines(means: DataFrame, value: str = "mean") -> DataFrame:
    """Text lines `chr, start, end, value` per tissue; missing values get no line."""
    return means.where(F.col(value).isNotNull()).select(
        "tissue_name",
        "chr",
        "pos",
        F.concat_ws(
            "\t", "chr", F.col("pos").cast("string"), (F.col("pos") + 1).cast("string"), F.col(value).cast("string")
        ).alias("line"),
    )
