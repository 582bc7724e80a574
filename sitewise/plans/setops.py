"""Unions, shared parts, dedupe and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitewise.functions.labels import name_part
from sitewise.operators import audits, ids, order, sets
from sitewise.operators.staging import staging_path
from sitewise.plans.book import query, r6, rs, sql
from sitewise.plans.inputs import cohort, contig_lengths, eval_long, ge_long, genes, locus, me_long, samples, sources, table
from sitewise.sources.writers import write_equal_shards


@query("source_tag", sql("sources", "select group_idx, count(*) as n, min(chr_pos) as first_key from sources group by 1"))
def source_tag(spark, d):
    tagged = sets.tag_sources(sources(spark, d))
    return tagged.groupBy("group_idx").agg(F.count("*").alias("n"), F.min("chr_pos").alias("first_key"))


@query(
    "union_sites",
    sql(
        "sources",
        """select row_number() over (order by chr_pos) - 1 as cpg_idx, chr_pos, chr, pos, group_idx from (
             select *, row_number() over (partition by chr_pos order by group_idx, cpg_idx) as k from sources) where k = 1""",
    ),
)
def union_sites(spark, d):
    return sets.union_sites(sources(spark, d)).select("cpg_idx", "chr_pos", "chr", "pos", "group_idx")


@query(
    "source_combo",
    sql(
        "sources",
        """select chr_pos, case when combo in ('0', '1', '2', '0+1', '0+2', '1+2', '0+1+2') then combo else 'other' end as combo
           from (select chr_pos, string_agg(distinct cast(group_idx as varchar), '+' order by cast(group_idx as varchar)) as combo
                 from sources group by 1 having count(*) > 1)""",
    ),
)
def source_combo(spark, d):
    return sets.source_combinations(sets.tag_sources(sources(spark, d)), "chr_pos")


@query(
    "union_samples",
    """select 'sample_idx_to_sample_name' as "check", cast(sample_idx as varchar) as key, cast(count(distinct sample_name) as varchar) as detail
       from (select s_suppkey as sample_idx, s_name as sample_name from supplier
             union all select c_custkey, c_name from customer) group by sample_idx having count(distinct sample_name) > 1""",
)
def union_samples(spark, d):
    """Two sample tables under one id space: every id used twice is a violation."""
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("sample_idx"), F.col("s_name").alias("sample_name"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("sample_idx"), F.col("c_name").alias("sample_name"))
    return audits.one_to_one(a.unionByName(b), "sample_idx", "sample_name")


@query(
    "key_pool",
    sql(
        "locus",
        """select l.cpg_idx, l.chr_pos from locus l
           join (select distinct chr_pos from locus where size <= 30) i on i.chr_pos = l.chr_pos
           left join (select distinct chr_pos from locus where size between 10 and 12 or size = 20) x on x.chr_pos = l.chr_pos
           where x.chr_pos is null""",
    ),
)
def key_pool(spark, d):
    sites = locus(spark, d).select("cpg_idx", "chr_pos", "size")
    pool = sets.key_pool(
        sites,
        include=[sites.where("size <= 15"), sites.where("size between 16 and 30")],
        exclude=[sites.where("size between 10 and 12"), sites.where("size = 20")],
        key="chr_pos",
        start="null",
    )
    return pool.select("cpg_idx", "chr_pos")


_TWO_SIDES = {
    "a": "select distinct chr_pos from sources where group_idx = 0",
    "b": "select distinct chr_pos from sources where group_idx = 1",
}


@query(
    "set_diff",
    sql(
        "sources",
        """select chr_pos, 'left' as side from a where chr_pos not in (select chr_pos from b)
           union all select chr_pos, 'right' from b where chr_pos not in (select chr_pos from a)""",
        **_TWO_SIDES,
    ),
)
def set_diff(spark, d):
    a, b, _ = sources(spark, d)
    return audits.key_differences(a, b, "chr_pos")


@query("set_intersect", sql("sources", "select chr_pos from a intersect select chr_pos from b", **_TWO_SIDES))
def set_intersect(spark, d):
    a, b, _ = sources(spark, d)
    return a.select("chr_pos").intersect(b.select("chr_pos"))


@query("distinct_pairs", sql("eval_long samples", "select distinct sample_idx, sample_name from eval_long join samples using (sample_idx)"))
def distinct_pairs(spark, d):
    named = eval_long(spark, d).select("sample_idx").distinct().join(
        samples(spark, d).select("sample_idx", "sample_name"), "sample_idx"
    )
    return named.distinct()


@query(
    "same_keys",
    sql(
        "sources",
        """select chr_pos, n_left, n_right from (
             select chr_pos, cast(sum(case when group_idx = 0 then 1 else 0 end) as bigint) as n_left,
                    cast(sum(case when group_idx = 1 then 1 else 0 end) as bigint) as n_right
             from sources where group_idx in (0, 1) group by 1) where n_left <> n_right""",
    ),
)
def same_keys(spark, d):
    a, b, _ = sources(spark, d)
    return audits.key_count_differences(a, b, "chr_pos")


_BITS = 24


def _digest_sql(rows: str) -> str:
    """The polynomial of a set's rows (pos, h): powers by the bits of the place, each step modulo the prime."""
    power = "1::bigint"
    for bit in range(_BITS):
        power = f"(({power}) * (case when (pos >> {bit}) & 1 = 1 then {pow(order.BASE, 1 << bit, order.PRIME)} else 1 end) % {order.PRIME})"
    return f"(select coalesce(sum(h % {order.PRIME} * {power} % {order.PRIME}) % {order.PRIME}, 0)::bigint from {rows})"


_ORDERS = {"resharded": "p_partkey", "moved": "p_partkey // 700, p_size, p_partkey"}


@query(
    "same_order",
    sql(
        "",
        " union all ".join(
            f"""select '{name}' as case_name, (select count(*) from base) as n_left, (select count(*) from {name}) as n_right,
                       {_digest_sql("base")} as digest_left, {_digest_sql(name)} as digest_right, true as same_rows,
                       not exists (select 1 from base join {name} using (pos) where base.h <> {name}.h) as same_order,
                       (select min(pos) from base join {name} using (pos) where base.h <> {name}.h) as first_difference"""
            for name in _ORDERS
        ),
        **{
            name: f"""select row_number() over (order by {by}) - 1 as pos, ('0x' || substr(md5('=' || p_partkey), 1, 15))::bigint as h from part"""
            for name, by in {"base": "p_partkey", **_ORDERS}.items()
        },
    ),
)
def same_order(spark, d):
    """Shard sets of one table: cut anew in the same order, and with rows moved inside stretches of 700 keys."""
    parts = table(spark, d, "part").select("p_partkey", "p_size")

    def written(order_by: list, rows_per_file: int):
        path = staging_path(spark, "shards")
        write_equal_shards(parts, path, order_by, rows_per_file)
        return order.shard_rows(spark, path, ["p_partkey"], shard="shard")

    base = written(["p_partkey"], 333)
    others = {"resharded": written(["p_partkey"], 500), "moved": written([F.floor(F.col("p_partkey") / 700), "p_size", "p_partkey"], 333)}
    cases = [order.compare_order(base, s, ["p_partkey"]).select(F.lit(n).alias("case_name"), "*") for n, s in others.items()]
    return cases[0].unionByName(cases[1])


@query(
    "known_chromosome",
    sql(
        "locus",
        """select 'known_chromosome' as "check", chr as key, cast(count(*) as varchar) as detail from locus
           where lower(chr) not in ('chrx', 'chry') and (length(chr) > 5 or cast(substring(chr, 4) as int) > 22) group by chr""".replace(
            "cast(substring(chr, 4) as int)", "coalesce(try_cast(substring(chr, 4) as int), 0)"
        ),
    ),
)
def known_chromosome(spark, d):
    return audits.unknown_chromosomes(locus(spark, d))


@query(
    "contig_check",
    sql("genes genome", "select distinct chr from genes anti join (select chr from genome where seq_len >= 2000) using (chr)"),
)
def contig_check(spark, d):
    """Contigs of genes that the contigs of at least 2,000 bases lack."""
    return sets.not_subset(genes(spark, d), contig_lengths(spark, d).where("seq_len >= 2000"), "chr")


@query(
    "dup_audit",
    sql(
        "locus",
        """select num_rows, num_keys, num_rows - num_keys as num_repeats,
                  (num_rows - num_keys) / num_rows as repeat_share
           from (select count(*) as num_rows, count(distinct chr_pos) as num_keys from locus)""",
    ),
)
def dup_audit(spark, d):
    return audits.duplicate_summary(locus(spark, d), "chr_pos")


@query("dup_keys", sql("locus", "select chr_pos, count(*) as n from locus group by 1 having count(*) > 1"))
def dup_keys(spark, d):
    return audits.duplicate_keys(locus(spark, d), "chr_pos")


@query(
    "null_audit",
    sql(
        "eval_long",
        """select column_name, nulls, nulls / num as share from (
             select 'pred_methyl' as column_name, count(*) - count(pred_methyl) as nulls, count(*) as num from eval_long
             union all select 'gt_methyl', count(*) - count(gt_methyl), count(*) from eval_long
             union all select '*', count(*) - count(pred_methyl + gt_methyl), count(*) from eval_long)""",
    ),
)
def null_audit(spark, d):
    return audits.null_audit(eval_long(spark, d), ["pred_methyl", "gt_methyl"])


@query(
    "null_map",
    sql(
        "me_long",
        """select axis, key, nulls, row_number() over (partition by axis order by nulls desc, key) - 1 as place from (
             select 'row' as axis, cpg_idx as key, count(*) - count(methylation) as nulls from me_long group by cpg_idx
             having count(*) > count(methylation)
             union all select 'column', sample_idx, count(*) - count(methylation) from me_long group by sample_idx)""",
    ),
)
def null_map(spark, d):
    return audits.null_map(me_long(spark, d), "cpg_idx", "sample_idx", "methylation")


@query(
    "mapping_diff",
    sql(
        "samples",
        """select a.sample_name, a.idx as left_value, b.idx as right_value from wrong a join right_ids b using (sample_name)
           where a.idx <> b.idx""",
        wrong="select sample_name, row_number() over (order by tissue_name, sample_name) - 1 as idx from samples",
        right_ids="select sample_name, row_number() over (order by sample_name) - 1 as idx from samples",
    ),
)
def mapping_diff(spark, d):
    names = samples(spark, d).select("sample_name", "tissue_name")
    wrong = ids.assign_ids(names, ["tissue_name", "sample_name"], "idx")
    right = ids.assign_ids(names, ["sample_name"], "idx")
    return audits.mapping_differences(wrong, right, "sample_name", "idx")


@query(
    "dedupe_first",
    sql(
        "eval_long",
        """select cpg_idx, sample_idx, gt_methyl from (
             select cpg_idx, sample_idx, gt_methyl, row_number() over (partition by cpg_idx order by sample_idx) as k from eval_long)
           where k = 1""",
    ),
)
def dedupe_first(spark, d):
    rows = eval_long(spark, d).select("cpg_idx", "sample_idx", "gt_methyl")
    return sets.dedupe(rows, ["cpg_idx"], ["sample_idx"])


@query(
    "dedupe_last",
    sql(
        "locus",
        """select chr_pos, cpg_idx, size from (
             select chr_pos, cpg_idx, size, row_number() over (partition by chr_pos order by cpg_idx desc) as k from locus) where k = 1""",
    ),
)
def dedupe_last(spark, d):
    return sets.dedupe(locus(spark, d).select("chr_pos", "cpg_idx", "size"), ["chr_pos"], ["cpg_idx"], keep="last")


@query(
    "dedupe_all",
    sql(
        "locus",
        "select chr_pos, min(cpg_idx) as cpg_idx, min(size) as size from locus group by 1 having count(*) = 1",
    ),
)
def dedupe_all(spark, d):
    return sets.drop_repeated(locus(spark, d).select("chr_pos", "cpg_idx", "size"), ["chr_pos"])


@query(
    "suffix_dups",
    sql(
        "samples",
        """select sample_idx, tissue_name, case when k = 1 then tissue_name else concat(tissue_name, '_sample', cast(k as varchar)) end as unique_name
           from (select *, row_number() over (partition by tissue_name order by sample_idx) as k from samples)""",
    ),
)
def suffix_dups(spark, d):
    return sets.suffix_repeats(samples(spark, d).select("sample_idx", "tissue_name"), "tissue_name", ["sample_idx"])


@query(
    "semi_site",
    sql("me_long locus", "select m.* from me_long m where cpg_idx in (select cpg_idx from locus where chr = 'chr1')"),
)
def semi_site(spark, d):
    return sets.keep_keys(me_long(spark, d), locus(spark, d).where("chr = 'chr1'"), "cpg_idx")


@query(
    "semi_sample",
    sql("me_long samples", "select m.* from me_long m where sample_idx in (select sample_idx from samples where region = 2)"),
)
def semi_sample(spark, d):
    return sets.keep_keys(me_long(spark, d), samples(spark, d).where("region = 2"), "sample_idx")


@query(
    "anti_sample",
    sql(
        "samples",
        "select sample_idx, sample_name, tissue_name from samples where sample_name not in (select sample_name from samples where balance < 0)",
    ),
)
def anti_sample(spark, d):
    rows = samples(spark, d).select("sample_idx", "sample_name", "tissue_name", "balance")
    return sets.drop_keys(rows, rows.where("balance < 0"), "sample_name").drop("balance")


@query(
    "joint_sites",
    sql(
        "sources",
        """select cpg_idx, chr_pos, chr_pos in (select chr_pos from sources where group_idx = 1) as joint
           from sources where group_idx = 0""",
    ),
)
def joint_sites(spark, d):
    a, b, _ = sources(spark, d)
    return sets.joint_and_rest(a.select("cpg_idx", "chr_pos"), b, "chr_pos")


@query(
    "joint_genes",
    sql(
        "ge_long genes",
        """select gene_idx, count(*) as num_samples from ge_long
           where gene_idx in (select gene_idx from genes where feature = 'gene') group by 1""",
    ),
)
def joint_genes(spark, d):
    kept = sets.keep_keys(ge_long(spark, d), genes(spark, d).where("feature = 'gene'"), "gene_idx")
    return kept.groupBy("gene_idx").agg(F.count("*").alias("num_samples"))


_BOTH = {
    "a": "select cpg_idx, sample_idx, methylation from cohort_a",
    "b": "select cpg_idx, sample_idx, methylation from cohort_r",
}


@query(
    "diff_frames",
    sql(
        "cohort_a cohort_r",
        f"""select 'methylation' as column_name, {rs('max(abs(a.methylation - b.methylation))')} as max_diff,
                   count(*) filter (where b.cpg_idx is null) as left_only, count(*) filter (where a.cpg_idx is null) as right_only
            from a full join b on a.cpg_idx = b.cpg_idx and a.sample_idx = b.sample_idx""",
        **_BOTH,
    ),
)
def diff_frames(spark, d):
    out = sets.frame_differences(cohort(spark, d, "A"), cohort(spark, d, "R"), ["cpg_idx", "sample_idx"], ["methylation"])
    return out.withColumn("max_diff", r6("max_diff"))


@query(
    "diff_rows",
    sql(
        "cohort_a cohort_r",
        f"""select cpg_idx, sample_idx, {rs('abs(a.methylation - b.methylation)')} as diff
            from a join b using (cpg_idx, sample_idx) where abs(a.methylation - b.methylation) > 0.501""",
        **_BOTH,
    ),
)
def diff_rows(spark, d):
    out = sets.rows_above_difference(
        cohort(spark, d, "A"), cohort(spark, d, "R"), ["cpg_idx", "sample_idx"], "methylation", 0.501
    )
    return out.select("cpg_idx", "sample_idx", r6("diff").alias("diff"))


@query(
    "merge_matrices",
    sql(
        "cohort_a cohort_n cohort_r",
        f"""select cpg_idx, sample_idx, {rs('first_value')} as methylation, group_idx, num_sources, num_sources = 1 or agrees as agrees
            from (select cpg_idx, sample_idx, arg_min(struct_pack(v := methylation), group_idx).v as first_value, min(group_idx) as group_idx,
                         count(*) as num_sources,
                         coalesce(max(abs(methylation - f)) <= 1e-8 + 1e-5 * min(abs(f)) and count(methylation) = count(*), false) as agrees
                  from (select *, first_value(methylation) over (partition by cpg_idx, sample_idx order by group_idx) as f from both_sources)
                  group by 1, 2)""",
        both_sources="""select 0 as group_idx, * from cohort_a union all select 1, * from cohort_n union all select 2, * from cohort_r""",
    ),
)
def merge_matrices(spark, d):
    tagged = sets.tag_sources([cohort(spark, d, flag) for flag in "ANR"])
    out = sets.merge_matrices(tagged, "cpg_idx", "sample_idx", "methylation", 3)
    return out.select("cpg_idx", "sample_idx", r6("methylation").alias("methylation"), "group_idx", "num_sources", "agrees")


@query(
    "product_check",
    sql(
        "me_long",
        """select 'full_product' as "check", cast(n as varchar) as key, cast(cells as varchar) as detail from (
             select count(*) as n, count(distinct cpg_idx) * count(distinct sample_idx) as cells from me_long) where n <> cells""",
    ),
)
def product_check(spark, d):
    return audits.product_violations(me_long(spark, d), "cpg_idx", "sample_idx")


def _subjects(spark, d, sep: str, region_low: int, region_high: int):
    """Sample names of one platform with the subject code in their third part."""
    subject = (F.col("sample_idx") % 40).cast("string")
    name = F.concat_ws(sep, F.lit("TCGA"), F.concat(F.lit("T"), F.col("region").cast("string")), subject, F.col("sample_idx").cast("string"))
    rows = samples(spark, d).where(F.col("region").between(region_low, region_high))
    return rows.select("sample_idx", name.alias("sample_name"), name_part(name, sep, 2).alias("subject_name"))


SUBJECT_SQL = {
    "subj_a": """select sample_idx, concat('TCGA-T', cast(region as varchar), '-', cast(sample_idx % 40 as varchar), '-', cast(sample_idx as varchar)) as sample_name,
                 cast(sample_idx % 40 as varchar) as subject_name from samples where region between 0 and 2""",
    "subj_b": """select sample_idx, concat('TCGA_T', cast(region as varchar), '_', cast(sample_idx % 40 as varchar), '_', cast(sample_idx as varchar)) as sample_name,
                 cast(sample_idx % 40 as varchar) as subject_name from samples where region between 3 and 4""",
}


def subjects_a(spark, d):
    return _subjects(spark, d, "-", 0, 2)


def subjects_b(spark, d):
    return _subjects(spark, d, "_", 3, 4)
