"""Island labels, genes and expression values."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitewise.functions import genes as G
from sitewise.functions.islands import encode_island
from sitewise.operators import annotation as A
from sitewise.operators import nearest, profile, ranking
from sitewise.plans.book import query, r6, rs, sql
from sitewise.plans.inputs import ge_long, genes, islands, locus
from sitewise.schemas import ISLAND_SEPARATOR, ISLAND_TYPES


def island_tuples(spark, d, sites=None):
    return A.island_tuples(islands(spark, d, sites), "cpg_idx", "ord", "location", "cgi_index")


@query("island_tuple", sql("island_tuples", "select cpg_idx, cpg_island_tuple, num_cpg_island_tuple from island_tuples"))
def island_tuple(spark, d):
    return island_tuples(spark, d)


_TYPE_TOKEN = "case string_split(x, '_')[1] " + " ".join(
    f"when '{t}' then {ISLAND_SEPARATOR + 1 + i}" for i, t in enumerate(ISLAND_TYPES)
) + " end"


@query(
    "encode_island",
    sql(
        "island_tuples",
        f"""select cpg_idx, list_concat([{ISLAND_SEPARATOR}], flatten(list_transform(string_split(cpg_island_tuple, ','), lambda x:
                   [case when string_split(x, '_')[2] = '-1' then 0 else cast(string_split(x, '_')[2] as int) end, {_TYPE_TOKEN}, {ISLAND_SEPARATOR}]))) as tokens
            from island_tuples""",
    ),
)
def encode_islands(spark, d):
    return island_tuples(spark, d).select("cpg_idx", encode_island("cpg_island_tuple").alias("tokens"))


@query(
    "value_counts",
    sql("islands", f"select location, count(*) as n, {rs('count(*) / (select count(*) from islands)')} as share from islands group by 1"),
)
def value_counts(spark, d):
    return profile.value_counts(islands(spark, d), "location").withColumn("share", r6("share"))


@query(
    "normalize_gene_key",
    sql(
        "genes",
        """select gene_idx, string_split(gene_id, '.')[1] as gene_id, concat(gene_name, ';', string_split(gene_id, '.')[1]) as gene_name_id
           from genes""",
    ),
)
def normalize_gene_key(spark, d):
    keyed = genes(spark, d).select("gene_idx", F.concat_ws(";", "gene_name", "gene_id").alias("_key"))
    return keyed.select("gene_idx", G.gene_id("_key").alias("gene_id"), G.gene_name_id("_key").alias("gene_name_id"))


@query(
    "filter_gene_type",
    sql("genes", "select gene_idx, gene_type from genes where feature = 'gene' and gene_type = 'protein_coding'"),
)
def filter_gene_type(spark, d):
    return genes(spark, d).where(G.is_gene("feature", "gene_type")).select("gene_idx", "gene_type")


@query(
    "annotation_genes",
    sql(
        "genes",
        """select string_split(gene_id, '.')[1] as gene_id, gene_name, chr, case when strand = '+' then start else "end" end as gene_pos,
                  gene_type = 'protein_coding' as is_protein_coding from genes where feature = 'gene'""",
    ),
)
def annotation_genes(spark, d):
    return A.annotation_genes(genes(spark, d), coding_only=False)


@query(
    "filter_prefix",
    sql(
        "genes",
        """select gene_idx, gene_name from genes where not (starts_with(gene_name, 'MT') or starts_with(gene_name, 'PR')
           or starts_with(gene_name, 'RPS') or starts_with(gene_name, 'RPL'))""",
    ),
)
def filter_prefix(spark, d):
    return genes(spark, d).where(G.wanted_gene("gene_name")).select("gene_idx", "gene_name")


@query(
    "strand_pos",
    sql("genes", """select gene_idx, case when strand = '+' then start else "end" end as gene_pos from genes"""),
)
def strand_pos(spark, d):
    return genes(spark, d).select("gene_idx", G.strand_pos("strand", "start", "end").alias("gene_pos"))


@query(
    "filter_hvg",
    sql(
        "ge_long",
        f"""select gene_idx, {rs('avg(expr)')} as mean, {rs('stddev_samp(expr)')} as std from ge_long group by 1
            having avg(expr) >= 0.1 and stddev_samp(expr) >= 0.1""",
    ),
)
def filter_hvg(spark, d):
    out = A.variable_genes(ge_long(spark, d), "gene_idx", "expr", 0.1, 0.1)
    return out.select("gene_idx", r6("mean").alias("mean"), r6("std").alias("std"))


_ORDER = "case when chr = 'chrX' then 24 when chr = 'chrY' then 25 else cast(substring(chr, 4) as int) end"


@query(
    "gene_order",
    sql(
        "genes ge_long",
        f"""select gene_idx, row_number() over (order by chr_order, gene_pos, gene_idx) - 1 as place from (
              select g.gene_idx, {_ORDER} as chr_order, case when strand = '+' then start else "end" end as gene_pos
              from genes g where gene_idx in (select gene_idx from ge_long))""",
    ),
)
def gene_order(spark, d):
    positions = genes(spark, d).select("gene_idx", "chr", G.strand_pos("strand", "start", "end").alias("gene_pos"))
    ordered = A.order_genes(ge_long(spark, d).select("gene_idx").distinct(), positions, "gene_idx")
    return ranking.ranked(ordered, [], ["chr_order", "gene_pos", "gene_idx"], "place").select("gene_idx", "place")


@query(
    "nearest_genes",
    sql(
        "locus genes",
        """select cpg_idx, gene_idx, gene_pos, distance, cast(place as int) as place from (
             select l.cpg_idx, g.gene_idx, g.start as gene_pos, abs(g.start - l.pos) as distance,
                    row_number() over (partition by l.cpg_idx order by abs(g.start - l.pos), g.gene_idx) - 1 as place
             from locus l join genes g on l.chr = g.chr) where place < 5""",
    ),
)
def nearest_genes(spark, d):
    annotated = genes(spark, d).select("gene_idx", "chr", F.col("start").alias("gene_pos"))
    sites = locus(spark, d).select("cpg_idx", "chr", "pos")
    return nearest.nearest_genes(sites, annotated, 5).select("cpg_idx", "gene_idx", "gene_pos", "distance", "place")


_PROBS = ", ".join(repr(i / 20) for i in range(21))


@query(
    "quantile_table",
    sql(
        "ge_long",
        f"""select stat, q, {rs('quantile')} as quantile, cast(floor(n * q) as bigint) as num_below, n - cast(floor(n * q) as bigint) as num_remaining from (
              select stat, count(*) as n, unnest([{_PROBS}]::double[]) as q, unnest(quantile_cont(value, [{_PROBS}])) as quantile
              from (select 'mean' as stat, mean as value from by_gene union all select 'std', std from by_gene where std is not null) group by 1)""",
        by_gene="select gene_idx, avg(expr) as mean, stddev_samp(expr) as std from ge_long group by 1 having count(*) > 1",
    ),
)
def quantile_table(spark, d):
    """Genes measured in more than one sample, so that mean and spread both exist."""
    stats = (
        ge_long(spark, d)
        .groupBy("gene_idx")
        .agg(F.avg("expr").alias("mean"), F.stddev_samp("expr").alias("std"), F.count("*").alias("n"))
        .where("n > 1")
    )
    out = A.quantile_table(stats, ["mean", "std"], 21, ["gene_idx"])
    return out.withColumn("quantile", r6("quantile"))


@query(
    "quantile_bins",
    sql(
        "ge_long",
        f"""select g.gene_idx, g.sample_idx, case when g.expr > 0 then coalesce(b.bin, 0) else 0 end as bin,
                   {rs('(case when g.expr > 0 then coalesce(b.bin, 0) else 0 end) / 50.0::double')} as scaled
            from ge_long g left join bins b using (gene_idx, sample_idx)""",
        placed="""select *, row_number() over (partition by sample_idx order by expr, gene_idx) - 1 as p, count(*) over (partition by sample_idx) as n
                  from ge_long where expr > 0""",
        edges="""select a.sample_idx, a.i, lo.expr + (hi.expr - lo.expr) * (a.h - floor(a.h)) as edge
                 from (select sample_idx, n, i, (n - 1) * (i / 49.0::double) as h from (select distinct sample_idx, n, unnest(range(50)) as i from placed)) a
                 join placed lo on lo.sample_idx = a.sample_idx and lo.p = floor(a.h)
                 join placed hi on hi.sample_idx = a.sample_idx and hi.p = least(floor(a.h) + 1, a.n - 1)""",
        bins="""select g.gene_idx, g.sample_idx, cast(count(*) as int) as bin from placed g
                join edges e on g.sample_idx = e.sample_idx and e.edge <= g.expr group by 1, 2""",
    ),
)
def quantile_bins(spark, d):
    out = A.quantile_bins(ge_long(spark, d), "sample_idx", "expr", 51, ["gene_idx"])
    return out.select("gene_idx", "sample_idx", "bin", r6("scaled").alias("scaled"))


@query(
    "minmax_scale",
    sql(
        "ge_long",
        f"""select gene_idx, sample_idx, {rs('(expr - lo) / (hi - lo)')} as scaled from (
              select *, min(expr) over (partition by sample_idx) as lo, max(expr) over (partition by sample_idx) as hi from ge_long)""",
    ),
)
def minmax_scale(spark, d):
    out = A.scale_min_max(ge_long(spark, d), "sample_idx", "expr")
    return out.select("gene_idx", "sample_idx", r6("scaled").alias("scaled"))
