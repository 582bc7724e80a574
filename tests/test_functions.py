"""Hand-made edge rows for the column functions."""

import math

import pytest
from pyspark.sql import functions as F

from sitewise.functions import arrays, genes, islands, labels, loci, numeric, sequence
from sitewise.schemas import ISLAND_SEPARATOR


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_locus_in_scientific_notation(spark):
    r = one(spark, c=loci.locus_chr(F.lit("chr1_9e+06")), p=loci.locus_pos(F.lit("chr1_9e+06")))
    assert (r.c, r.p) == ("chr1", 9_000_000)


def test_chromosomes(spark):
    r = one(spark, a=loci.chr_index(F.lit("chrX")), b=loci.chr_index(F.lit("chr1_alt")), m=loci.gene_chr_order(F.lit("chrM")))
    assert (r.a, r.b, r.m) == (22, None, 23)
    with pytest.raises(ValueError):
        loci.in_chromosomes("chr", ["chr99"])


def test_correlation_is_null_when_undefined(spark):
    nan = float("nan")
    data = [("const", 1.0, 2.0), ("const", 1.0, 3.0), ("one", 1.0, 1.0), ("ok", 1.0, 2.0), ("ok", 2.0, 4.0),
            ("ok", nan, 9.0), ("ok", None, 9.0), ("ok", 3.0, 6.0)]
    df = spark.createDataFrame(data, "k string, x double, y double")
    got = {r.k: r.c for r in df.groupBy("k").agg(numeric.safe_corr("x", "y").alias("c")).collect()}
    assert got["const"] is None and got["one"] is None and math.isclose(got["ok"], 1.0)


def test_tolerant_equality(spark):
    f = numeric.close_to
    r = one(spark, a=f(F.lit(1.0), F.lit(1.000001)), b=f(F.lit(1.0), F.lit(1.1)), c=f(F.lit(float("nan")), F.lit(float("nan"))))
    assert (r.a, r.b, r.c) == (True, False, False)


def test_half_even(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (5,), (7,)], "n bigint")
    got = [r.h for r in df.select(numeric.half_even_share("n", 0.5).alias("h")).collect()]
    assert got == [round(0.5 * n) for n in (1, 2, 3, 5, 7)]


def test_value_bin_ties(spark):
    r = one(spark, a=numeric.value_bin(F.lit(0.125), 5), b=numeric.value_bin(F.lit(0.375), 5), c=numeric.value_bin(F.lit(1.0), 101))
    assert (r.a, r.b, r.c) == (0, 2, 100)


def test_equal_edges_take_the_upper_bin(spark):
    edges = F.array(*[F.lit(e) for e in (1.0, 2.0, 2.0, 3.0)])
    r = one(spark, a=numeric.edge_bin(F.lit(2.0), edges), b=numeric.edge_bin(F.lit(0.5), edges), c=numeric.edge_bin(F.lit(3.0), edges))
    assert (r.a, r.b, r.c) == (3, 0, 4)


def test_center_crop(spark):
    r = one(spark, a=sequence.center_crop(F.lit("AACCGGTT"), 4), b=sequence.center_crop(F.lit("ACG"), 8, strict=False))
    assert (r.a, r.b) == ("CCGG", "ACG")
    with pytest.raises(Exception, match="shorter"):
        one(spark, a=sequence.center_crop(F.lit("ACG"), 8))


def test_codes_and_words(spark):
    r = one(spark, a=sequence.encode_bases(F.lit("acgtN")), b=sequence.kmers(F.lit("ACGTA"), 3), c=sequence.kmers(F.lit("AC"), 3),
            n=sequence.count_letter(F.lit("nNa"), "N"), t=sequence.kmer_ids(F.lit("ACG"), 2))
    assert r.a == [0, 1, 2, 3, 4] and r.b == ["ACG", "CGT", "GTA"] and r.c == [] and r.n == 2 and r.t == [1, 7]


def test_island_tokens(spark):
    r = one(spark, a=islands.encode_island(F.lit("sea_-1,upshore2_12")))
    s = ISLAND_SEPARATOR
    assert r.a == [s, 0, s + 2, s, 12, s + 5, s]
    for bad in ("sea_0", "sea_28001", "lake_3"):
        with pytest.raises(Exception):
            one(spark, a=islands.encode_island(F.lit(bad)))


def test_gene_keys(spark):
    r = one(spark, a=genes.gene_id(F.lit("TSPAN6;ENSG00000000003.15")), b=genes.gene_id(F.lit("ENSG00000000003.15_PAR_Y")),
            c=genes.gene_name_id(F.lit("A.1;ENSG01.2")), d=genes.wanted_gene(F.lit("RPL7")), e=genes.wanted_gene(F.lit("TP53")))
    assert (r.a, r.b, r.c, r.d, r.e) == ("ENSG00000000003", "ENSG00000000003", "A;ENSG01", False, True)


def test_labels(spark):
    name = F.lit("DNA of Homo sapiens heart left ventricle tissue male adult (34 years)")
    r = one(spark, a=labels.tissue_from_name(name), b=labels.clean_label(F.lit(None).cast("string")),
            c=labels.clean_label(F.lit("common myeloid progenitor, CD34 male adult")), d=labels.name_part(F.lit("A-B-C"), "-", 2),
            e=labels.name_part(F.lit("A"), "-", 2), f=labels.thousands(F.lit(1234567)))
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == ("heart left ventricle", "Unknown", "CPM CD34", "C", None, "1,234,567")


def test_padding(spark):
    a = F.array(F.lit(1), F.lit(2))
    df = spark.range(1).select(a.alias("a"), F.lit(4).alias("n"))
    r = df.select(arrays.pad_to("a", "n", F.lit(0)).alias("p"), arrays.pad_mask("a", "n").alias("m"),
                  arrays.position_ids("a").alias("i"), arrays.ones_like("a").alias("o")).first()
    assert (r.p, r.m, r.i, r.o) == ([1, 2, 0, 0], [True, True, False, False], [0, 1], [1, 1])
    with pytest.raises(Exception, match="longer"):
        spark.range(1).select(arrays.pad_to(a, F.lit(1), F.lit(0))).collect()


def test_minmax_of_a_constant(spark):
    r = one(spark, a=numeric.min_max(F.lit(2.0), F.lit(2.0), F.lit(2.0)))
    assert r.a is None
