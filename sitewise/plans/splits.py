"""Train and validation splits, shuffles and shards."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitewise.functions.loci import chr_sort_key
from sitewise.operators import audits, moving, reshape, sets, splits
from sitewise.plans.book import query, r6, rs, sql
from sitewise.plans.inputs import line_tasks, locus, me_long, samples, table

SEED = 42


def hash_sql(*cols: str) -> str:
    parts = ", ".join(f"cast({c} as varchar)" for c in cols)
    return f"md5(concat_ws('|', '{SEED}', {parts}))"


def _unique_sites(spark, d, sites=None):
    """Sites with unique keys, the input every site split asks for."""
    sites = locus(spark, d) if sites is None else sites
    return sets.dedupe(sites.select("chr_pos", "cpg_idx", "chr", "pos"), ["chr_pos"], ["cpg_idx"])


SPLIT_SQL = {
    "unique_sites": "select chr_pos, min(cpg_idx) as cpg_idx, min(chr) as chr, min(pos) as pos from locus group by 1",
    "site_split": f"""select chr_pos, cpg_idx, chr, pos, case when r < v then 'val' when r < v + t then 'train' else 'unused' end as split
        from (select *, row_number() over (partition by chr order by {hash_sql('chr_pos')}, chr_pos) - 1 as r,
                     floor(count(*) over (partition by chr) * 0.1::double) as v,
                     floor(count(*) over (partition by chr) * 0.6::double) as t from unique_sites)""",
    "sample_split": f"""select sample_idx, sample_name, tissue_name, case when n = 1 or r < round_even(n * 0.5::double, 0) then 'train' else 'val' end as split
        from (select *, row_number() over (partition by tissue_name order by {hash_sql('sample_name')}, sample_name) - 1 as r,
                     count(*) over (partition by tissue_name) as n from samples)""",
}


def site_split(spark, d, sites=None):
    return splits.split_sites(_unique_sites(spark, d, sites), 0.1, 0.6, SEED)


def sample_split(spark, d, share: float = 0.5):
    return splits.split_samples(samples(spark, d).select("sample_idx", "sample_name", "tissue_name"), share, SEED)


@query("split_by_chr", sql("locus", "select chr_pos, cpg_idx, chr, pos, split from site_split", **SPLIT_SQL | {"sample_split": "select 1"}))
def split_by_chr(spark, d):
    return site_split(spark, d)


@query("split_in_tissue", sql("samples", "select * from sample_split", sample_split=SPLIT_SQL["sample_split"]))
def split_in_tissue(spark, d):
    return sample_split(spark, d)


@query(
    "split_in_cancer",
    sql("samples", "select * from sample_split", sample_split=SPLIT_SQL["sample_split"].replace("0.5::double", "0.9::double")),
)
def split_in_cancer(spark, d):
    return sample_split(spark, d, 0.9)


@query(
    "split_ood",
    sql(
        "samples",
        f"""select sample_idx, tissue_name, case when tissue_name in (
              select tissue_name from (select tissue_name from samples group by 1 having count(*) = 1)
              order by {hash_sql('tissue_name')}, tissue_name limit 10) then 'val' else 'train' end as split from samples""",
    ),
)
def split_ood(spark, d):
    return splits.hold_out_tissues(samples(spark, d).select("sample_idx", "tissue_name"), 10, SEED)


@query(
    "four_way_split",
    sql(
        "locus samples me_long",
        """select m.cpg_idx, m.sample_idx, m.methylation, concat(a.split, '_cpg-', b.split, '_sample') as split
           from me_long m join site_split a using (cpg_idx) join sample_split b using (sample_idx) where a.split <> 'unused'""",
        **SPLIT_SQL,
    ),
)
def four_way_split(spark, d):
    return splits.four_way(me_long(spark, d), site_split(spark, d), sample_split(spark, d), line_tasks(spark, d))


@query(
    "split_audit",
    sql(
        "locus",
        """select 'overlap' as "check", count(*) as violations from (select chr_pos from site_split group by 1 having count(*) > 1)
           union all select 'missing', count(*) from (select distinct chr_pos from locus) where chr_pos not in (select chr_pos from site_split)
           union all select 'unknown', count(*) from (select distinct chr_pos from site_split) where chr_pos not in (select chr_pos from locus)""",
        unique_sites=SPLIT_SQL["unique_sites"],
        site_split=SPLIT_SQL["site_split"],
    ),
)
def split_audit(spark, d):
    return audits.split_audit(site_split(spark, d), locus(spark, d), "chr_pos")


@query("sample_n", sql("locus", f"select cpg_idx, chr_pos from locus order by {hash_sql('cpg_idx')}, cpg_idx limit 500"))
def sample_n(spark, d):
    return splits.random_subset(locus(spark, d).select("cpg_idx", "chr_pos"), 500, ["cpg_idx"], SEED)


@query(
    "shuffle_order",
    sql(
        "me_long",
        f"""select cpg_idx, sample_idx, row_number() over (order by {hash_sql('cpg_idx', 'sample_idx')}, cpg_idx, sample_idx) - 1 as place
            from me_long""",
    ),
)
def shuffle_order(spark, d):
    pairs = me_long(spark, d).select("cpg_idx", "sample_idx")
    return splits.shuffle_positions(pairs, ["cpg_idx", "sample_idx"], SEED)


_SHARDS = "select *, cast(floor((row_number() over (order by cpg_idx, sample_idx) - 1) / 1000) as bigint) as shard from me_long"


@query("reshard_assign", sql("me_long", "select cpg_idx, sample_idx, methylation, shard from shards", shards=_SHARDS))
def reshard_assign(spark, d):
    return reshape.assign_shards(me_long(spark, d), ["cpg_idx", "sample_idx"], 1000)


@query(
    "reshard_interleave",
    sql(
        "me_long",
        """select cpg_idx, sample_idx, place, place // 120 as shard from (
             select cpg_idx, sample_idx, row_number() over (order by r // 8, worker, r) - 1 as place from (
               select *, row_number() over (partition by worker order by cpg_idx, sample_idx) - 1 as r
               from (select *, (cpg_idx + sample_idx) % 5 as worker from me_long)))""",
    ),
)
def reshard_interleave(spark, d):
    """Five readers take turns, 8 rows each; shards of 120."""
    rows = me_long(spark, d).select("cpg_idx", "sample_idx", ((F.col("cpg_idx") + F.col("sample_idx")) % 5).alias("worker"))
    placed = reshape.interleave(rows, "worker", ["cpg_idx", "sample_idx"], 8)
    return placed.select("cpg_idx", "sample_idx", "place", F.floor(F.col("place") / 120).alias("shard"))


@query(
    "shard_offsets",
    """select l_suppkey as shard, count(*) as num_rows,
              cast(sum(count(*)) over (order by l_suppkey) - count(*) as bigint) as "offset" from lineitem group by 1""",
)
def shard_offsets(spark, d):
    sizes = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("shard")).agg(F.count("*").alias("num_rows"))
    return reshape.shard_offsets(sizes)


@query(
    "sort_custom",
    sql(
        "locus",
        """select chr, n, row_number() over (order by case when try_cast(substring(chr, 4) as int) is not null then cast(substring(chr, 4) as int)
              when chr = 'chrX' then 1000001 when chr = 'chrY' then 1000002 else 1000003 end, chr) - 1 as place
           from (select chr, count(*) as n from locus group by 1)""",
    ),
)
def sort_custom(spark, d):
    """Chromosomes by number, X and Y after them."""
    from sitewise.operators.ranking import ranked

    counts = locus(spark, d).groupBy("chr").agg(F.count("*").alias("n")).withColumn("_key", chr_sort_key("chr"))
    return ranked(counts, [], ["_key", "chr"], "place").drop("_key")


@query(
    "moving_rate",
    f"""select event_type, ts, event_id, num_rows, {rs('amount')} as amount, {rs('seconds')} as seconds,
               case when seconds > 0 then {rs('amount / seconds')} end as rate from (
          select event_type, ts, event_id, count(*) over w as num_rows, sum(value) over w as amount,
                 (epoch_us(ts) - epoch_us(min(ts) over w)) / 1000000.0::double as seconds
          from events window w as (partition by event_type order by ts, event_id rows between 99 preceding and current row))""",
)
def moving_rate(spark, d):
    log = table(spark, d, "events").select("event_type", "ts", "event_id", "value")
    out = moving.moving_rate(log, "event_type", ["ts", "event_id"], "ts", "value", 100)
    return out.select(
        "event_type", "ts", "event_id", "num_rows", *[r6(c).alias(c) for c in ("amount", "seconds", "rate")]
    )
