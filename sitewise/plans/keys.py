"""Keys, ids and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitewise.functions import labels, loci
from sitewise.operators import ids, profile, sets
from sitewise.operators.staging import staging_path
from sitewise.plans.book import query, r6, rs, sql
from sitewise.plans.inputs import eval_long, locus, me_long, samples, sources, table
from sitewise.schemas import CHROMOSOMES
from sitewise.sources.writers import write_lookup

_CHR_IDX = "case lower(chr) " + " ".join(f"when '{c}' then {i}" for i, c in enumerate(CHROMOSOMES)) + " end"


@query(
    "parse_locus",
    sql("locus", "select cpg_idx, chr_pos, chr, cast(pos as bigint) as pos from locus"),
)
def parse_locus(spark, d):
    """Positions are written in scientific notation first, as some platforms deliver them."""
    text = F.concat_ws("_", "chr", F.format_string("%.10e", F.col("pos").cast("double")))
    rows = locus(spark, d).select("cpg_idx", "chr_pos", text.alias("_text"))
    return rows.select(
        "cpg_idx", "chr_pos", loci.locus_chr("_text").alias("chr"), loci.locus_pos("_text").alias("pos")
    )


@query("locus_key", sql("locus", "select chr_pos, min(cpg_idx) as cpg_idx, count(*) as n from locus group by 1"))
def locus_key(spark, d):
    keyed = locus(spark, d).select("cpg_idx", loci.locus_key("chr", "pos").alias("chr_pos"))
    return keyed.groupBy("chr_pos").agg(F.min("cpg_idx").alias("cpg_idx"), F.count("*").alias("n"))


@query("chr_index", sql("locus", f"select cpg_idx, chr, {_CHR_IDX} as chr_idx from locus"))
def chr_index(spark, d):
    return locus(spark, d).select("cpg_idx", "chr", loci.chr_index("chr").alias("chr_idx"))


@query(
    "filter_chr",
    sql("locus", "select cpg_idx, chr, pos from locus where lower(chr) in ('chr1', 'chr2', 'chrx')"),
)
def filter_chr(spark, d):
    return locus(spark, d).where(loci.in_chromosomes("chr", ["chr1", "chr2", "chrX"])).select("cpg_idx", "chr", "pos")


@query(
    "assign_ids",
    sql(
        "sources",
        """select chr_pos, group_idx, row_number() over (order by chr_pos) - 1 as cpg_idx
           from (select chr_pos, min(group_idx) as group_idx from sources group by 1)""",
    ),
)
def assign_ids(spark, d):
    """Lexicographic ids of the merged sites."""
    merged = sets.tag_sources(sources(spark, d)).groupBy("chr_pos").agg(F.min("group_idx").alias("group_idx"))
    return ids.assign_ids(merged, ["chr_pos"], "cpg_idx")


_SAMPLE_CTES = {
    "known": "select sample_name, case when balance < 0 then null else tissue_name end as t from samples",
    "numbered": """select sample_name, coalesce(t, 'NA') as tissue_name,
                   row_number() over (order by (t is null), sample_name) - 1 + 100 as sample_idx from known""",
    "tissues": """select tissue_name, row_number() over (order by min(sample_idx)) - 1 + 10 as tissue_idx, count(*) as "count"
                  from numbered group by 1""",
}


def _sample_dimension(spark, d):
    """Samples with a negative balance stand for those no tissue is known of."""
    all_samples = samples(spark, d)
    known = all_samples.where("balance >= 0").select("sample_name", "tissue_name")
    return ids.sample_dimension(all_samples.select("sample_name"), known, sample_offset=100, tissue_offset=10)


@query(
    "sample_dim",
    sql(
        "samples",
        """select sample_idx, sample_name, tissue_name, sample_name = tissue_name as sample_tissue_same, tissue_idx, "count"
           from numbered join tissues using (tissue_name)""",
        **_SAMPLE_CTES,
    ),
)
def sample_dim(spark, d):
    return _sample_dimension(spark, d)


@query("tissue_ids", sql("samples", 'select tissue_name, tissue_idx, "count" from tissues', **_SAMPLE_CTES))
def tissue_ids(spark, d):
    numbered = _sample_dimension(spark, d).select("tissue_name", "sample_idx")
    return ids.tissue_ids(numbered, 10)


@query(
    "attach_ids",
    sql(
        "samples me_long",
        """select m.cpg_idx, s.sample_name, m.sample_idx as source_idx, n.sample_idx as sample_idx, t.tissue_idx
           from me_long m join samples s using (sample_idx) left join numbered n using (sample_name)
           left join tissues t on t.tissue_name = n.tissue_name""",
        numbered="select sample_name, tissue_name, row_number() over (order by sample_name) - 1 as sample_idx from samples",
        tissues="""select tissue_name, row_number() over (order by min(sample_idx)) - 1 as tissue_idx
                   from numbered group by 1""",
    ),
)
def attach_ids(spark, d):
    known = samples(spark, d)
    numbered = ids.sample_dimension(known, known)
    facts = (
        me_long(spark, d)
        .join(known.select("sample_idx", "sample_name"), "sample_idx")
        .select("cpg_idx", "sample_name", F.col("sample_idx").alias("source_idx"))
    )
    return ids.attach_ids(facts, numbered, "sample_name", ["sample_idx", "tissue_idx"])


@query(
    "reindex_site",
    sql(
        "sources",
        """select s.cpg_idx as old_idx, s.chr_pos, m.new_idx from sources s
           join (select chr_pos, row_number() over (order by chr_pos) - 1 as new_idx
                 from (select distinct chr_pos from sources)) m using (chr_pos) where s.group_idx = 1""",
    ),
)
def reindex_site(spark, d):
    frames = sources(spark, d)
    return ids.reindex(frames[1], sets.union_sites(frames)).select("old_idx", "chr_pos", "new_idx")


@query(
    "remap_ids",
    sql(
        "samples eval_long",
        """select e.cpg_idx, e.group_idx, r.right_idx as sample_idx, e.pred_methyl from eval_long e
           join wrong w on e.sample_idx = w.wrong_idx join right_ids r using (sample_name)""",
        wrong="select sample_name, row_number() over (order by tissue_name, sample_name) - 1 as wrong_idx from samples",
        right_ids="select sample_name, row_number() over (order by sample_name) - 1 as right_idx from samples",
    ),
)
def remap_ids(spark, d):
    """Predictions numbered by (tissue, name) get the numbers by name."""
    names = samples(spark, d).select("sample_name", "tissue_name")
    wrong = ids.assign_ids(names, ["tissue_name", "sample_name"], "sample_idx")
    right = ids.assign_ids(names, ["sample_name"], "sample_idx")
    return ids.repair_ids(eval_long(spark, d), wrong, right, "sample_name", "sample_idx").select(
        "cpg_idx", "group_idx", "sample_idx", "pred_methyl"
    )


@query(
    "name_predictions",
    sql(
        "eval_long samples locus",
        """select e.cpg_idx, e.sample_idx, e.pred_methyl, e.gt_methyl, s.sample_name, l.chr_pos from eval_long e
           left join samples s using (sample_idx) left join locus l using (cpg_idx)""",
    ),
)
def name_predictions(spark, d):
    return ids.name_predictions(eval_long(spark, d), samples(spark, d), locus(spark, d)).drop("group_idx")


@query(
    "extract_label",
    sql(
        "samples",
        "select sample_name, tissue_name as label from samples",
    ),
)
def extract_label(spark, d):
    long_name = F.concat(F.lit("WGBS Homo sapiens "), "tissue_name", F.lit(" tissue sample of "), "sample_name")
    return samples(spark, d).select("sample_name", labels.tissue_from_name(long_name).alias("label"))


@query(
    "clean_label",
    sql(
        "samples",
        """select sample_name, case when balance < 0 then 'Unknown'
                  when region = 1 then concat('CPM ', tissue_name) else tissue_name end as label from samples""",
    ),
)
def clean_label(spark, d):
    raw = (
        F.when(F.col("balance") < 0, F.lit(None))
        .when(F.col("region") == 1, F.concat(F.lit("common myeloid progenitor, "), "tissue_name", F.lit(" male adult")))
        .otherwise(F.concat("tissue_name", F.lit(" originated from (37 years)")))
    )
    return samples(spark, d).select("sample_name", labels.clean_label(raw).alias("label"))


@query(
    "name_parts",
    r"""select page_id, regexp_extract(url, '^[a-z]+://([^/]*)', 1) as label, string_split(url, '/')[4] as part,
               list_last(string_split(url, '/')) as base, replace(coalesce(nullif(string_split(url, '#')[2], ''), 'Unknown'), 'top', 'first') as clean
        from pages""",
)
def name_parts(spark, d):
    """The label, a numbered part, the base name and a cleaned ending of names as they stand in a table."""
    url = F.col("url")
    ending = F.nullif(F.get(F.split(url, "#"), F.lit(1)), F.lit(""))
    return table(spark, d, "pages").select(
        "page_id",
        labels.tissue_from_name(url, "://", "/").alias("label"),
        labels.name_part(url, "/", 3).alias("part"),
        labels.base_name(url).alias("base"),
        F.replace(labels.clean_label(ending), F.lit("top"), F.lit("first")).alias("clean"),
    )


@query(
    "parse_names",
    """select c_name as name, string_split(c_name, '#')[1] as chr, cast(string_split(c_name, '#')[2] as bigint) as pos from customer
       union all select s_name, string_split(s_name, '#')[1], cast(string_split(s_name, '#')[2] as bigint) from supplier
       union all select p_brand, string_split(p_brand, '#')[1], cast(string_split(p_brand, '#')[2] as bigint) from part""",
)
def parse_names(spark, d):
    """Locus keys cut into name and number, from names that the tables hold; `#` stands for the usual mark."""
    columns = {"customer": "c_name", "supplier": "s_name", "part": "p_brand"}
    names = [table(spark, d, t).select(F.col(c).alias("name")) for t, c in columns.items()]
    rows = names[0].unionByName(names[1]).unionByName(names[2]).withColumn("_key", F.translate("name", "#", "_"))
    return rows.select("name", loci.locus_chr("_key").alias("chr"), loci.locus_pos("_key").alias("pos"))


@query(
    "subject_key",
    sql(
        "samples",
        """select sample_name, cast(sample_idx % 40 as varchar) as subject_name,
                  concat('T', cast(region as varchar)) as type_name, cast(sample_idx % 40 as varchar) as subject_wgbs
           from samples""",
    ),
)
def subject_key(spark, d):
    """Codes of array names `TCGA-T1-7-01` and of sequencing names `TCGA_T1_7`."""
    subject, kind = (F.col("sample_idx") % 40).cast("string"), F.concat(F.lit("T"), F.col("region").cast("string"))
    rows = samples(spark, d).select(
        "sample_name",
        F.concat_ws("-", F.lit("TCGA"), kind, subject, F.lit("01")).alias("_array"),
        F.concat_ws("_", F.lit("TCGA"), kind, subject).alias("_wgbs"),
    )
    return rows.select(
        "sample_name",
        labels.name_part("_array", "-", 2).alias("subject_name"),
        labels.name_part("_array", "-", 1).alias("type_name"),
        labels.name_part("_wgbs", "_", 2).alias("subject_wgbs"),
    )


@query(
    "filter_tissue",
    sql("samples", "select sample_idx, tissue_name from samples where tissue_name in ('NATION_1', 'NATION_7', 'RARE_5')"),
)
def filter_tissue(spark, d):
    wanted = ["NATION_1", "NATION_7", "RARE_5"]
    return samples(spark, d).where(F.col("tissue_name").isin(wanted)).select("sample_idx", "tissue_name")


@query(
    "tissue_counts",
    sql("samples", "select tissue_name, count(*) as num_samples from samples group by 1"),
)
def tissue_counts(spark, d):
    return profile.tissue_counts(samples(spark, d)).orderBy(F.desc("num_samples"), "tissue_name")


@query(
    "scan_parquet",
    "select l_partkey, l_suppkey, l_discount from lineitem where l_quantity < 5",
)
def scan_parquet(spark, d):
    from sitewise.sources.readers import read_any

    return read_any(spark, f"{d}/lineitem.parquet").where("l_quantity < 5").select("l_partkey", "l_suppkey", "l_discount")


@query("scan_project", "select l_partkey as cpg_idx, l_suppkey as sample_idx, l_tax as pred_methyl from lineitem")
def scan_project(spark, d):
    from sitewise.sources.readers import read_columns

    cols = read_columns(spark, f"{d}/lineitem.parquet", ["l_partkey", "l_suppkey", "l_tax"])
    return cols.withColumnsRenamed({"l_partkey": "cpg_idx", "l_suppkey": "sample_idx", "l_tax": "pred_methyl"})


@query("head_n", "select l_orderkey, l_linenumber, l_quantity from lineitem order by l_orderkey, l_linenumber, l_partkey limit 20")
def head_n(spark, d):
    from sitewise.sources.readers import head, read_any

    rows = read_any(spark, f"{d}/lineitem.parquet")
    return head(rows, 20, ["l_orderkey", "l_linenumber", "l_partkey"]).select("l_orderkey", "l_linenumber", "l_quantity")


@query(
    "lookup_by_idx",
    sql("locus", "select cpg_idx, chr, pos, chr_pos from locus where cpg_idx in (7, 42, 1999, 123456789)"),
)
def lookup_by_idx(spark, d):
    return ids.find_by_id(locus(spark, d).drop("size"), "cpg_idx", [7, 42, 1999, 123456789])


@query(
    "lookup_written",
    sql(
        "locus",
        """select cpg_idx, chr, pos, chr_pos from locus
           where cpg_idx in (7, 42, 1999, 123456789) or chr_pos = (select chr_pos from locus where cpg_idx = 100)""",
    ),
)
def lookup_written(spark, d):
    """Sites by id and by name, out of a table that was written for lookups."""
    path = staging_path(spark, "lookup")
    write_lookup(locus(spark, d).drop("size"), path, "cpg_idx", ["chr_pos"], rows_per_group=500)
    store = spark.read.parquet(path)
    name = ids.find_by_id(store, "cpg_idx", [100]).first()
    named = store.where(F.col("chr_pos") == (name["chr_pos"] if name else None))
    return ids.find_by_id(store, "cpg_idx", [7, 42, 1999, 123456789]).unionByName(named).distinct()


@query(
    "rel_pos_ratio",
    sql("genes genome", f"select gene_idx, chr, {rs('(start::double) / seq_len')} as pos_ratio from genes join genome using (chr)"),
)
def rel_pos_ratio(spark, d):
    from sitewise.operators.nearest import relative_positions
    from sitewise.plans.inputs import contig_lengths, genes

    placed = genes(spark, d).select("gene_idx", "chr", F.col("start").alias("gene_pos"))
    return relative_positions(placed, contig_lengths(spark, d)).select("gene_idx", "chr", r6("pos_ratio").alias("pos_ratio"))
