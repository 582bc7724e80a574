"""Scores of predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitewise.functions.labels import base_name
from sitewise.functions.numeric import value_bin
from sitewise.operators import metrics as M
from sitewise.plans.book import query, r6, sql
from sitewise.plans.inputs import corr_sql, eval_long

PCC = corr_sql("pred_methyl", "gt_methyl")


@query(
    "pcc_by_site",
    sql("eval_full", f"select group_idx, cpg_idx, count(*) as n, {PCC} as pcc from eval_full group by 1, 2"),
)
def pcc_by_site(spark, d):
    return M.correlation_by(eval_long(spark, d), ["group_idx", "cpg_idx"]).withColumn("pcc", r6("pcc"))


@query(
    "pcc_by_sample",
    sql("eval_full", f"select group_idx, sample_idx, count(*) as n, {PCC} as pcc from eval_full group by 1, 2"),
)
def pcc_by_sample(spark, d):
    return M.correlation_by(eval_long(spark, d), ["group_idx", "sample_idx"]).withColumn("pcc", r6("pcc"))


@query(
    "std_by_site",
    sql(
        "eval_full",
        """select cpg_idx, round(stddev_samp(pred_methyl) + 1e-9, 6) + 0.0 as pred_methyl_std,
                  round(stddev_samp(gt_methyl) + 1e-9, 6) + 0.0 as gt_methyl_std from eval_full group by 1""",
    ),
)
def std_by_site(spark, d):
    return M.spread_by(eval_long(spark, d), ["cpg_idx"]).select("cpg_idx", r6("pred_methyl_std").alias("pred_methyl_std"), r6("gt_methyl_std").alias("gt_methyl_std"))


_LOSS = """round(avg((pred_methyl - gt_methyl) * (pred_methyl - gt_methyl)) + 1e-9, 6) + 0.0 as mse,
           round(avg(abs(pred_methyl - gt_methyl)) + 1e-9, 6) + 0.0 as mae"""


def _round_loss(df):
    return df.withColumn("mse", r6("mse")).withColumn("mae", r6("mae"))


@query("loss_by_group", sql("eval_full", f"select group_idx, {_LOSS} from eval_full group by 1"))
def loss_by_group(spark, d):
    return _round_loss(M.loss_by(eval_long(spark, d), ["group_idx"]))


@query(
    "loss_by_key",
    sql(
        "eval_full",
        f"""select 'cpg_idx' as key_name, cpg_idx as key, {_LOSS} from eval_full group by cpg_idx
            union all select 'sample_idx', sample_idx, {_LOSS} from eval_full group by sample_idx""",
    ),
)
def loss_by_key(spark, d):
    return _round_loss(M.loss_by_each_key(eval_long(spark, d), ["cpg_idx", "sample_idx"]))


_RAW = "case when isnan(corr(pred_methyl, gt_methyl)) then null else corr(pred_methyl, gt_methyl) end as pcc"

_SUMMARY = sql(
    "eval_full",
    """select l.group_idx, l.mse_loss_per_point, l.mae_loss_per_point,
              round(c.m + 1e-9, 6) + 0.0 as pcc_by_cpg_mean, round(s.m + 1e-9, 6) + 0.0 as pcc_by_sample_mean,
              round(c.d + 1e-9, 6) + 0.0 as pcc_by_cpg_median, round(s.d + 1e-9, 6) + 0.0 as pcc_by_sample_median
       from loss l left join (select group_idx, avg(pcc) as m, median(pcc) as d from by_cpg group by 1) c using (group_idx)
       left join (select group_idx, avg(pcc) as m, median(pcc) as d from by_sample group by 1) s using (group_idx)""",
    by_cpg=f"select group_idx, cpg_idx, {_RAW} from eval_full group by 1, 2",
    by_sample=f"select group_idx, sample_idx, {_RAW} from eval_full group by 1, 2",
    loss="""select group_idx, round(avg((pred_methyl - gt_methyl) * (pred_methyl - gt_methyl)) + 1e-9, 6) + 0.0 as mse_loss_per_point,
            round(avg(abs(pred_methyl - gt_methyl)) + 1e-9, 6) + 0.0 as mae_loss_per_point from eval_full group by 1""",
)


@query("metric_summary", _SUMMARY)
def metric_summary(spark, d):
    out = M.metric_summary(eval_long(spark, d))
    return out.select("group_idx", *[r6(c).alias(c) for c in out.columns if c != "group_idx"])


@query(
    "pcc_std_table",
    sql(
        "eval_full",
        f"""select group_idx, cpg_idx, {PCC} as pcc, round(stddev_samp(pred_methyl) + 1e-9, 6) + 0.0 as pred_methyl_std,
                   round(stddev_samp(gt_methyl) + 1e-9, 6) + 0.0 as gt_methyl_std from eval_full group by 1, 2""",
    ),
)
def pcc_std_table(spark, d):
    out = M.correlation_and_spread_by(eval_long(spark, d), ["group_idx", "cpg_idx"])
    return out.select("group_idx", "cpg_idx", *[r6(c).alias(c) for c in ("pcc", "pred_methyl_std", "gt_methyl_std")])


@query(
    "group_size_check",
    sql(
        "eval_long",
        """select key_name, count(*) as num_groups, min(n) as min_size, max(n) as max_size, min(n) = max(n) as all_equal
           from sizes group by 1""",
        sizes="""select 'cpg_idx' as key_name, cpg_idx as key, count(*) as n from eval_long group by 2
                 union all select 'sample_idx', sample_idx, count(*) from eval_long group by 2""",
    ),
)
def group_size_check(spark, d):
    return M.group_sizes_equal(eval_long(spark, d), ["cpg_idx", "sample_idx"])


@query(
    "pcc_share",
    sql(
        "eval_full",
        """select group_idx, mark, round(avg(case when pcc >= mark then 1.0 else 0.0 end) + 1e-9, 6) + 0.0 as share
           from (select group_idx, round(pcc, 6) as pcc from by_cpg) as b, (select unnest([0.0, 0.25, 0.5, 0.75])::double as mark) as m where pcc is not null group by 1, 2""",
        by_cpg=f"select group_idx, cpg_idx, {_RAW} from eval_full group by 1, 2",
    ),
)
def pcc_share(spark, d):
    pccs = M.correlation_by(eval_long(spark, d), ["group_idx", "cpg_idx"]).withColumn("pcc", F.round("pcc", 6))
    return M.share_at_least(pccs, "pcc", [0.0, 0.25, 0.5, 0.75], ["group_idx"]).withColumn("share", r6("share"))


LETTER_PROBS = [0.0, 0.125, 0.25, 0.5, 0.75, 0.875, 1.0]


@query(
    "pcc_quantiles",
    sql(
        "eval_full",
        """select group_idx, n, q, round(quantile + 1e-9, 6) + 0.0 as quantile from (
             select group_idx, count(*) as n, unnest([0.0, 0.125, 0.25, 0.5, 0.75, 0.875, 1.0]::double[]) as q,
                    unnest(quantile_cont(pcc, [0.0, 0.125, 0.25, 0.5, 0.75, 0.875, 1.0])) as quantile
             from by_cpg where pcc is not null group by 1)""",
        by_cpg=f"select group_idx, cpg_idx, {_RAW} from eval_full group by 1, 2",
    ),
)
def pcc_quantiles(spark, d):
    pccs = M.correlation_by(eval_long(spark, d), ["group_idx", "cpg_idx"])
    out = M.letter_values(pccs, ["group_idx"], "pcc", LETTER_PROBS, ["cpg_idx"])
    return out.withColumn("quantile", r6("quantile"))


@query(
    "pcc_histogram",
    sql(
        "eval_full",
        """select group_idx, cast(least(floor((pcc + 1.0::double) / (2.0::double / 20)), 19) as bigint) as bin, count(*) as n
           from by_cpg where pcc between -1 and 1 group by 1, 2""",
        by_cpg="select group_idx, cpg_idx, round(pcc, 6) as pcc from (select group_idx, cpg_idx, "
        f"{_RAW} from eval_full group by 1, 2)",
    ),
)
def pcc_histogram(spark, d):
    pccs = M.correlation_by(eval_long(spark, d), ["group_idx", "cpg_idx"]).withColumn("pcc", F.round("pcc", 6))
    return M.histogram(pccs, ["group_idx"], "pcc", -1.0, 1.0, 20)


@query(
    "pcc_density",
    sql(
        "eval_full",
        """select group_idx, f.n, point, round(low + point * step + 1e-9, 6) + 0.0 as x,
                  round(sum(w * exp(-0.5::double * ((point - i) * step / h) * ((point - i) * step / h)))
                        / (f.n * h * sqrt(2 * pi())) + 1e-9, 6) + 0.0 as density
           from facts f join binned b using (group_idx), range(50) p(point) group by group_idx, f.n, point, low, step, h""",
        by_cpg="select group_idx, cpg_idx, round(pcc, 6) as pcc from (select group_idx, cpg_idx, "
        f"{_RAW} from eval_full group by 1, 2) where pcc is not null",
        facts="""select group_idx, n, h, low - 2 * h as low, (high - low + 4.0::double * h) / 49 as step from (
                   select group_idx, count(*) as n, min(pcc) as low, max(pcc) as high, stddev_samp(pcc) * pow(count(*)::double, -0.2::double) as h
                   from by_cpg group by 1) where low < high""",
        binned="""select group_idx, i + side as i, sum(case when side = 0 then 1 - (at_ - i) else at_ - i end) as w
                  from (select group_idx, (pcc - low) / step as at_, least(floor((pcc - low) / step), 48)::int as i
                        from by_cpg join facts using (group_idx)), (values (0), (1)) s(side) group by 1, 2""",
    ),
)
def pcc_density(spark, d):
    """Density of the correlations of each split on 50 places."""
    pccs = M.correlation_by(eval_long(spark, d), ["group_idx", "cpg_idx"]).withColumn("pcc", F.round("pcc", 6))
    made = M.density(pccs, ["group_idx"], "pcc", points=50)
    return made.select("group_idx", "n", F.col("point").cast("bigint").alias("point"), r6("x").alias("x"), r6("density").alias("density"))


@query(
    "metrics_wide",
    sql(
        "eval_full",
        """select group_idx, round(avg((pred_methyl - gt_methyl) * (pred_methyl - gt_methyl)) + 1e-9, 6) + 0.0 as mse,
                  round(avg(abs(pred_methyl - gt_methyl)) + 1e-9, 6) + 0.0 as mae, cast(count(*) as double) as n
           from eval_full group by 1""",
    ),
)
def metrics_wide(spark, d):
    rows = M.complete_rows(eval_long(spark, d))
    losses = M.loss_by(rows, ["group_idx"]).join(rows.groupBy("group_idx").agg(F.count("*").alias("n")), "group_idx")
    long = losses.select(
        "group_idx",
        F.explode(
            F.array(
                *[F.struct(F.lit(m).alias("metric"), r6(F.col(m).cast("double")).alias("value")) for m in ("mse", "mae", "n")]
            )
        ).alias("_m"),
    ).select("group_idx", "_m.metric", "_m.value")
    return M.metrics_wide(long, "group_idx", ["mse", "mae", "n"])


_METRIC_SPLITS = [(m, g) for m in ("mse", "mae") for g in (0, 1, 2)]


@query(
    "metrics_by_split",
    sql(
        "eval_full",
        "select sample_idx, "
        + ", ".join(f"max(case when group_idx = {g} then {m} end) as {m}_{g}" for m, g in _METRIC_SPLITS)
        + " from losses group by 1",
        losses="""select sample_idx, group_idx, round(avg((pred_methyl - gt_methyl) * (pred_methyl - gt_methyl)) + 1e-9, 6) + 0.0 as mse,
                         round(avg(abs(pred_methyl - gt_methyl)) + 1e-9, 6) + 0.0 as mae from eval_full group by 1, 2""",
    ),
)
def metrics_by_split(spark, d):
    """One row per sample and one column per metric and split."""
    losses = M.loss_by(M.complete_rows(eval_long(spark, d)), ["sample_idx", "group_idx"])
    each = F.array(*[F.struct(F.lit(m).alias("name"), r6(F.col(m)).alias("value")) for m in ("mse", "mae")])
    long = losses.select("sample_idx", "group_idx", F.explode(each).alias("_m")).select(
        "sample_idx", F.concat_ws("_", "_m.name", F.col("group_idx").cast("string")).alias("metric"), "_m.value"
    )
    return M.metrics_wide(long, "sample_idx", [f"{m}_{g}" for m, g in _METRIC_SPLITS])


@query(
    "drop_null",
    sql("eval_full", "select cpg_idx, sample_idx, group_idx, pred_methyl, gt_methyl from eval_full"),
)
def drop_null(spark, d):
    return eval_long(spark, d).na.drop(subset=["pred_methyl", "gt_methyl"])


@query(
    "filter_group",
    sql(
        "eval_long",
        "select 'val_cpg-val_sample' as split, cpg_idx, sample_idx, pred_methyl, gt_methyl from eval_long where group_idx = 2",
    ),
)
def filter_group(spark, d):
    path = F.lit("dataset/me_cpg_bg/val_cpg-val_sample")
    return (
        eval_long(spark, d)
        .where("group_idx = 2")
        .select(base_name(path).alias("split"), "cpg_idx", "sample_idx", "pred_methyl", "gt_methyl")
    )


@query(
    "value_bin",
    sql(
        "me_long",
        """select cpg_idx, sample_idx, cast(round_even(methylation * 100, 0) as bigint) as bin
           from me_long where methylation is not null""",
    ),
)
def value_bins(spark, d):
    from sitewise.plans.inputs import me_long

    rows = me_long(spark, d).where("methylation is not null")
    return rows.select("cpg_idx", "sample_idx", value_bin("methylation", 101).alias("bin"))
