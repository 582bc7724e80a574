"""Domain tables derived from the given tables, as DataFrames and as SQL views.

Every view reads its source tables whole. Averages are taken over integer hundredths, so they
are equal in any engine and any order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.operators.layout import row_tasks, spread_rows

# Fixed values of the test genome: characters of a text and the bases they stand for. All
# other characters are unknown bases.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
BASES = "acgtacgtacgtacgtacgtacgtac"
OTHERS = " .,\néóèñüçêäößí"
OTHER_BASES = "acgtacgtacgtacg"
FROM_TEXT = LETTERS + LETTERS.upper() + OTHERS
TO_BASES = BASES + BASES.upper() + OTHER_BASES

WINDOW = 200  # bases of a site window in the registered queries
TILE = 1024  # tile width in the registered queries

CTE: dict[str, str] = {}
NEEDS: dict[str, list[str]] = {
    "locus": ["genome"],
    "windows": ["locus"],
    "sources": ["locus"],
    "islands": ["locus"],
    "island_tuples": ["islands"],
}


SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": """o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,
                 o_orderdate timestamp_ntz, o_orderpriority string""",
    "lineitem": """l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,
                   l_extendedprice double, l_discount double, l_tax double, l_returnflag string,
                   l_linestatus string, l_shipdate timestamp_ntz""",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A given table by its declared schema; no job runs to look at the file."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{d}/{name}.parquet")


def chr_name(i):
    return (
        F.when(i == 22, "chrX").when(i == 23, "chrY").otherwise(F.concat(F.lit("chr"), (i + 1).cast("string")))
    )


_CHR_SQL = "case when {i} = 22 then 'chrX' when {i} = 23 then 'chrY' else concat('chr', cast({i} + 1 as varchar)) end"


def genome(spark: SparkSession, d: str) -> DataFrame:
    """Each document is a contig; the 24 first ones are the known chromosomes."""
    seq = F.regexp_replace(F.translate("text", FROM_TEXT, TO_BASES), "[^acgtACGT]", "N")
    texts = table(spark, d, "documents").where("n_chars > 0").select("doc_id", "n_chars", "text")
    return spread_rows(texts, "doc_id").select(
        "doc_id", chr_name(F.col("doc_id")).alias("chr"), seq.alias("seq"), F.col("n_chars").alias("seq_len")
    )


CTE["genome"] = f"""
select doc_id, {_CHR_SQL.format(i="doc_id")} as chr,
       regexp_replace(translate(text, '{FROM_TEXT}', '{TO_BASES}'), '[^acgtACGT]', 'N', 'g') as seq, n_chars as seq_len
from documents where n_chars > 0
"""


def contig_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Length of each contig, without reading its text."""
    return (
        table(spark, d, "documents")
        .where("n_chars > 0")
        .select("doc_id", chr_name(F.col("doc_id")).alias("chr"), F.col("n_chars").alias("seq_len"))
    )


def locus(spark: SparkSession, d: str) -> DataFrame:
    """Sites: half of them on the known chromosomes, half spread over all contigs."""
    contigs = table(spark, d, "documents").agg(F.count("*").alias("n")).scalar()
    key = F.col("p_partkey")
    home = F.when(key % 2 == 0, F.floor(key / 2) % 24).otherwise(key % contigs)
    return (
        table(spark, d, "part")
        .withColumn("doc_id", home)
        .join(contig_lengths(spark, d), "doc_id")
        .select(
            key.alias("cpg_idx"),
            "chr",
            ((key * 37 + F.col("p_size")) % F.col("seq_len")).alias("pos"),
            F.col("p_size").alias("size"),
        )
        .withColumn("chr_pos", F.concat_ws("_", "chr", F.col("pos").cast("string")))
    )


CTE["locus"] = """
select cpg_idx, chr, pos, size, concat(chr, '_', cast(pos as varchar)) as chr_pos from (
  select p_partkey as cpg_idx, chr, (p_partkey * 37 + p_size) % seq_len as pos, p_size as size
  from part join genome on doc_id = case when p_partkey % 2 = 0 then (p_partkey // 2) % 24
                                         else p_partkey % (select count(*) from documents) end)
"""

CTE["windows"] = f"""
select cpg_idx, chr, pos, chr_pos,
       concat(repeat('N', greatest(0, {WINDOW // 2} - pos)::int),
              substring(seq, (greatest(pos - {WINDOW // 2}, 0) + 1)::int,
                        (least(pos + {WINDOW // 2}, seq_len) - greatest(pos - {WINDOW // 2}, 0))::int),
              repeat('N', greatest(0, pos + {WINDOW // 2} - seq_len)::int)) as sequence,
       substring(seq, (pos + 1)::int, 1) as base
from locus join genome using (chr)
"""


def sources(spark: SparkSession, d: str) -> list[DataFrame]:
    """Three overlapping site lists, as three platforms would deliver them."""
    sites = locus(spark, d)
    return [
        sites.where(cond).select("cpg_idx", "chr", "pos", "chr_pos")
        for cond in ("size <= 25", "size between 15 and 40", "size >= 30")
    ]


CTE["sources"] = """
select 0 as group_idx, cpg_idx, chr, pos, chr_pos from locus where size <= 25
union all select 1, cpg_idx, chr, pos, chr_pos from locus where size between 15 and 40
union all select 2, cpg_idx, chr, pos, chr_pos from locus where size >= 30
"""


def islands(spark: SparkSession, d: str, sites: DataFrame | None = None) -> DataFrame:
    """Island labels: sea, or two labels per site."""
    sites = locus(spark, d) if sites is None else sites
    count = F.when(F.col("pos") % 3 == 0, 1).otherwise(2)
    sea = F.col("pos") % 3 == 0
    return sites.withColumn("ord", F.explode(F.sequence(F.lit(1), count))).select(
        "cpg_idx",
        "ord",
        F.when(sea, "sea").when(F.col("ord") == 1, "upshore1").otherwise("shelve").alias("location"),
        F.when(~sea, (F.col("cpg_idx") % 500 + F.col("ord")).cast("int")).alias("cgi_index"),
    )


CTE["islands"] = """
select cpg_idx, ord, case when pos % 3 = 0 then 'sea' when ord = 1 then 'upshore1' else 'shelve' end as location,
       case when pos % 3 <> 0 then cast(cpg_idx % 500 + ord as int) end as cgi_index
from (select *, unnest(range(1, case when pos % 3 = 0 then 2 else 3 end)) as ord from locus)
"""

CTE["island_tuples"] = """
select cpg_idx, string_agg(concat(location, '_', cast(coalesce(cgi_index, -1) as varchar)), ',' order by ord) as cpg_island_tuple,
       count(*) as num_cpg_island_tuple
from islands group by cpg_idx
"""


def samples(spark: SparkSession, d: str) -> DataFrame:
    """Samples with a tissue; every fifth sample is the only one of its tissue."""
    tissue = F.when(F.col("s_suppkey") % 5 == 0, F.concat(F.lit("RARE_"), F.col("s_suppkey").cast("string"))).otherwise(
        F.col("n_name")
    )
    return (
        table(spark, d, "supplier")
        .join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("s_suppkey").alias("sample_idx"),
            F.col("s_name").alias("sample_name"),
            tissue.alias("tissue_name"),
            F.col("s_acctbal").alias("balance"),
            F.col("n_regionkey").alias("region"),
        )
    )


CTE["samples"] = """
select s_suppkey as sample_idx, s_name as sample_name,
       case when s_suppkey % 5 = 0 then concat('RARE_', cast(s_suppkey as varchar)) else n_name end as tissue_name,
       s_acctbal as balance, n_regionkey as region
from supplier join nation on s_nationkey = n_nationkey
"""


def _mean_tenths(column: str, when=None):
    """Mean of the column times ten, from exact integer sums."""
    hundredths = F.round(F.col(column) * 100).cast("bigint")
    if when is not None:
        hundredths = F.when(when, hundredths)
    return F.try_divide(F.sum(hundredths).cast("double"), F.count(hundredths) * 10)


_MEAN_SQL = "cast(sum({x}) as double) / nullif(count({x}) * 10, 0)"


def line_tasks(spark: SparkSession, d: str) -> int:
    """Tasks among which rows of line items are dealt by site or sample."""
    return row_tasks(table(spark, d, "lineitem"))


def me_long(spark: SparkSession, d: str) -> DataFrame:
    """Methylation of site and sample on [0, 1]; some values are missing. Rows lie dealt by site."""
    lines = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("cpg_idx"), F.col("l_suppkey").alias("sample_idx"), "l_discount", "l_quantity"
    )
    dealt = lines.repartition(line_tasks(spark, d), "cpg_idx")
    return dealt.groupBy("cpg_idx", "sample_idx").agg(_mean_tenths("l_discount", F.col("l_quantity") > 2).alias("methylation"))


CTE["me_long"] = f"""
select l_partkey as cpg_idx, l_suppkey as sample_idx,
       {_MEAN_SQL.format(x="case when l_quantity > 2 then cast(round(l_discount * 100) as bigint) end")} as methylation
from lineitem group by l_partkey, l_suppkey
"""


def eval_long(spark: SparkSession, d: str) -> DataFrame:
    """Predictions and truth with the number of the split; some truths are missing."""
    group = F.when(
        F.col("l_partkey") % 10 == 0, F.when(F.col("l_suppkey") % 10 == 0, 2).otherwise(1)
    ).otherwise(0)
    return (
        table(spark, d, "lineitem")
        .groupBy(
            F.col("l_partkey").alias("cpg_idx"), F.col("l_suppkey").alias("sample_idx"), group.alias("group_idx")
        )
        .agg(
            _mean_tenths("l_tax").alias("pred_methyl"),
            _mean_tenths("l_discount", F.col("l_quantity") > 2).alias("gt_methyl"),
        )
    )


CTE["eval_long"] = f"""
select l_partkey as cpg_idx, l_suppkey as sample_idx,
       case when l_partkey % 10 = 0 then case when l_suppkey % 10 = 0 then 2 else 1 end else 0 end as group_idx,
       {_MEAN_SQL.format(x="cast(round(l_tax * 100) as bigint)")} as pred_methyl,
       {_MEAN_SQL.format(x="case when l_quantity > 2 then cast(round(l_discount * 100) as bigint) end")} as gt_methyl
from lineitem group by 1, 2, 3
"""

# Complete rows and the correlation of each group, null when it is undefined.
CTE["eval_full"] = "select * from eval_long where pred_methyl is not null and gt_methyl is not null"
NEEDS["eval_full"] = ["eval_long"]


def corr_sql(x: str, y: str) -> str:
    return f"case when isnan(corr({x}, {y})) then null else round(corr({x}, {y}) + 1e-9, 6) + 0.0 end"


def genes(spark: SparkSession, d: str) -> DataFrame:
    """Annotation lines of genes; names carry the segment as a prefix."""
    key = F.col("c_custkey")
    seg = F.col("c_mktsegment")
    prefix = (
        F.when(seg == "AUTOMOBILE", "MT-").when(seg == "BUILDING", "RPS").when(seg == "MACHINERY", "PRX").otherwise("GENE")
    )
    name = F.concat(prefix, key.cast("string"))
    gene_id = F.concat(F.lit("ENSG"), F.lpad(key.cast("string"), 11, "0"))
    start = (key * 53) % 400 * 12
    return table(spark, d, "customer").select(
        key.alias("gene_idx"),
        name.alias("gene_name"),
        F.concat(gene_id, F.lit("."), F.col("c_nationkey").cast("string")).alias("gene_id"),
        chr_name(key % 24).alias("chr"),
        F.when(seg == "FURNITURE", "exon").otherwise("gene").alias("feature"),
        F.when(F.col("c_acctbal") > 5000, "protein_coding").otherwise("lncRNA").alias("gene_type"),
        F.when(F.col("c_acctbal") < 2500, "-").otherwise("+").alias("strand"),
        start.alias("start"),
        (start + 100 + F.col("c_nationkey")).alias("end"),
    )


CTE["genes"] = f"""
select c_custkey as gene_idx,
       concat(case c_mktsegment when 'AUTOMOBILE' then 'MT-' when 'BUILDING' then 'RPS' when 'MACHINERY' then 'PRX' else 'GENE' end,
              cast(c_custkey as varchar)) as gene_name,
       concat('ENSG', lpad(cast(c_custkey as varchar), 11, '0'), '.', cast(c_nationkey as varchar)) as gene_id,
       {_CHR_SQL.format(i="(c_custkey % 24)")} as chr,
       case when c_mktsegment = 'FURNITURE' then 'exon' else 'gene' end as feature,
       case when c_acctbal > 5000 then 'protein_coding' else 'lncRNA' end as gene_type,
       case when c_acctbal < 2500 then '-' else '+' end as strand,
       (c_custkey * 53) % 400 * 12 as start,
       (c_custkey * 53) % 400 * 12 + 100 + c_nationkey as "end"
from customer
"""


def ge_long(spark: SparkSession, d: str) -> DataFrame:
    """Expression of gene and sample; some values are zero."""
    cents = F.when(F.col("o_orderstatus") == "P", 0).otherwise(F.round(F.col("o_totalprice") * 100).cast("bigint"))
    return (
        table(spark, d, "orders")
        .groupBy(F.col("o_custkey").alias("gene_idx"), (F.col("o_orderkey") % 10).alias("sample_idx"))
        .agg((F.sum(cents).cast("double") / F.lit(10000000.0)).alias("expr"))
    )


CTE["ge_long"] = """
select o_custkey as gene_idx, o_orderkey % 10 as sample_idx,
       cast(sum(case when o_orderstatus = 'P' then 0 else cast(round(o_totalprice * 100) as bigint) end) as double) / 10000000.0 as expr
from orders group by 1, 2
"""


def cohort(spark: SparkSession, d: str, flag: str) -> DataFrame:
    """Methylation as one platform measured it: the lines of one return flag."""
    return (
        table(spark, d, "lineitem")
        .where(F.col("l_returnflag") == flag)
        .groupBy(F.col("l_partkey").alias("cpg_idx"), F.col("l_suppkey").alias("sample_idx"))
        .agg(_mean_tenths("l_discount", F.col("l_quantity") > 2).alias("methylation"))
    )


for _flag in ("A", "N", "R"):
    CTE[f"cohort_{_flag.lower()}"] = f"""
select l_partkey as cpg_idx, l_suppkey as sample_idx,
       {_MEAN_SQL.format(x="case when l_quantity > 2 then cast(round(l_discount * 100) as bigint) end")} as methylation
from lineitem where l_returnflag = '{_flag}' group by 1, 2
"""
