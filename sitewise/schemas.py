"""Schemas and fixed values shared by every module.

The lists and numbers below are fixed values: they must equal those of the data
sets this engine reads, otherwise ids and tokens would not match.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Chromosome numbering used for `chr_idx` (position in the list).
CHROMOSOMES = [
    "chr1", "chr2", "chr3", "chr4", "chr5", "chr6", "chr7", "chr8",
    "chr9", "chr10", "chr11", "chr12", "chr13", "chr14", "chr15", "chr16",
    "chr17", "chr18", "chr19", "chr20", "chr21", "chr22", "chrx", "chry",
]

# Order of chromosomes when genes are sorted (M before X and Y).
GENE_CHROMOSOME_ORDER = {f"chr{i}": i for i in range(1, 23)} | {"chrM": 23, "chrX": 24, "chrY": 25}

# Codes of the bases.
BASE_CODES = {"A": 0, "C": 1, "G": 2, "T": 3, "N": 4}

# Island vocabulary. Indexes run from 1 to ISLAND_COUNT, 0 stands for
# "no island", the separator follows the last index and the types follow it.
ISLAND_COUNT = 28000
ISLAND_SEPARATOR = ISLAND_COUNT + 1
ISLAND_TYPES = ["cgi", "sea", "shelve", "upshore1", "upshore2", "upshore3", "upshore4"]

# Gene name prefixes that are removed from expression tables.
UNWANTED_GENE_PREFIXES = ["MT", "PR", "RPS", "RPL"]

# Names of the four site x sample splits.
SPLIT_NAMES = [
    "train_cpg-train_sample",
    "train_cpg-val_sample",
    "val_cpg-train_sample",
    "val_cpg-val_sample",
]

# Source combinations that have a name of their own.
SOURCE_COMBINATIONS = ["0", "1", "2", "0+1", "0+2", "1+2", "0+1+2"]

# Replacements that shorten long tissue labels, applied in this order.
LABEL_REPLACEMENTS = [
    (" (37 years)", ""),
    (" (33 years)", ""),
    (" originated from", ""),
    (" female adult", ""),
    (" male adult", ""),
    ("common myeloid progenitor,", "CPM"),
]

SITE_SCHEMA = T.StructType(
    [
        T.StructField("cpg_idx", T.LongType()),
        T.StructField("chr", T.StringType()),
        T.StructField("pos", T.LongType()),
        T.StructField("chr_pos", T.StringType()),
        T.StructField("group_idx", T.IntegerType()),
    ]
)

SAMPLE_SCHEMA = T.StructType(
    [
        T.StructField("sample_idx", T.IntegerType()),
        T.StructField("sample_name", T.StringType()),
        T.StructField("tissue_name", T.StringType()),
        T.StructField("sample_tissue_same", T.BooleanType()),
        T.StructField("tissue_idx", T.IntegerType()),
        T.StructField("count", T.LongType()),
    ]
)

PREDICTION_SCHEMA = T.StructType(
    [
        T.StructField("cpg_idx", T.LongType()),
        T.StructField("sample_idx", T.LongType()),
        T.StructField("group_idx", T.IntegerType()),
        T.StructField("pred_methyl", T.DoubleType()),
        T.StructField("gt_methyl", T.DoubleType()),
    ]
)

VIOLATION_SCHEMA = "check string, key string, detail string"
