"""Wide and long matrices, vectors and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitewise.functions import arrays
from sitewise.functions.labels import base_name
from sitewise.operators import profile, reshape
from sitewise.plans.book import query, r6, rs, sql
from sitewise.operators.staging import staging_path
from sitewise.plans.inputs import ge_long, me_long, samples, table
from sitewise.sources import readers

_VALUES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "unpivot_matrix",
    " union all ".join(
        f"select l_orderkey, l_linenumber, l_partkey, '{c}' as sample_name, {c} as value from lineitem" for c in _VALUES
    ),
)
def unpivot_matrix(spark, d):
    wide = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *_VALUES)
    return reshape.melt(wide, ["l_orderkey", "l_linenumber", "l_partkey"], _VALUES, "sample_name", "value")


@query(
    "matrix_line_breaks",
    """select doc_id, md5(doc_id || ' ' || text) as key, sample, value
       from (select doc_id, text, unnest(['n_chars', 'doc_id']) as sample, unnest([n_chars::double, doc_id::double]) as value
             from documents where text is not null)""",
)
def matrix_line_breaks(spark, d):
    """A matrix whose keys are whole texts with line breaks and quotes, through CSV files."""
    rows = table(spark, d, "documents").where("text is not null")
    key = F.concat_ws(" ", F.col("doc_id").cast("string"), "text")
    wide = rows.select(key.alias("key"), F.col("n_chars").cast("double"), F.col("doc_id").cast("double"))
    path = staging_path(spark, "matrix")
    csv = wide.write.option("header", True).option("escape", '"').option("quoteAll", True)
    csv.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    long = readers.read_matrix_long(spark, path, line_breaks=True)
    number = F.substring_index("key", " ", 1).cast("bigint").alias("doc_id")
    return long.select(number, F.md5("key").alias("key"), "sample", "value")


_REGIONS = [0, 1, 2, 3, 4]


@query(
    "pivot_matrix",
    sql(
        "me_long samples",
        "select cpg_idx, "
        + ", ".join(f"{rs(f'max(case when region = {r} then mean end)')} as \"{r}\"" for r in _REGIONS)
        + " from means group by 1",
        means="select cpg_idx, region, avg(methylation) as mean from me_long join samples using (sample_idx) group by 1, 2",
    ),
)
def pivot_matrix(spark, d):
    means = (
        me_long(spark, d)
        .join(samples(spark, d).select("sample_idx", "region"), "sample_idx")
        .groupBy("cpg_idx", "region")
        .agg(F.avg("methylation").alias("mean"))
    )
    wide = reshape.spread(means, ["cpg_idx"], "region", "mean", _REGIONS)
    return wide.select("cpg_idx", *[r6(F.col(f"`{r}`")).alias(str(r)) for r in _REGIONS])


@query(
    "ragged_explode",
    """select trim(unnest(string_split(concat(s_name, ',', ' ', s_name, ',', cast(s_nationkey as varchar)), ',')[1:2])) as sample_name,
              cast(s_nationkey as varchar) as label from supplier""",
)
def ragged_explode(spark, d):
    """Lines that name a sample twice before its label."""
    lines = table(spark, d, "supplier").select(
        F.concat(F.col("s_name"), F.lit(", "), F.col("s_name"), F.lit(","), F.col("s_nationkey").cast("string")).alias("value")
    )
    return reshape.ragged_rows(lines).select(F.trim("sample").alias("sample_name"), "label")


@query("split_null", sql("me_long", "select cpg_idx, sample_idx, methylation, methylation is null as is_null from me_long"))
def split_null(spark, d):
    return reshape.split_nulls(me_long(spark, d), "methylation")


@query(
    "matrix_stats",
    sql(
        "me_long",
        """select count(*) as num_pairs, count(methylation) as num_with_value, count(*) - count(methylation) as num_without_value
           from me_long""",
    ),
)
def matrix_stats(spark, d):
    return profile.matrix_stats(me_long(spark, d), "methylation")


@query(
    "sample_profile",
    sql(
        "me_long",
        """select sample_idx, count(*) as num_rows, count(*) - count(methylation) as num_null,
                  min(methylation) as min_value, max(methylation) as max_value from me_long group by 1""",
    ),
)
def sample_profile(spark, d):
    return profile.value_profile(me_long(spark, d), "sample_idx", "methylation")


@query(
    "std_value",
    sql(
        "me_long",
        f"""select 'cpg_idx' as key_name, cpg_idx as key, {rs('stddev_samp(methylation)')} as std from me_long
            where methylation is not null group by cpg_idx
            union all select 'sample_idx', sample_idx, {rs('stddev_samp(methylation)')} from me_long
            where methylation is not null group by sample_idx""",
    ),
)
def std_value(spark, d):
    out = profile.value_spread(me_long(spark, d), ["cpg_idx", "sample_idx"], "methylation")
    return out.withColumn("std", r6("std"))


@query(
    "describe",
    "select column_name, num_values, " + ", ".join(f"{rs(c)} as {c}" for c in ("mean", "std", "min_value", "max_value")) + " from ("
    + " union all ".join(
        f"select '{c}' as column_name, count({c}) as num_values, avg({c}) as mean, stddev_samp({c}) as std, "
        f"min({c})::double as min_value, max({c})::double as max_value from lineitem"
        for c in ("l_quantity", "l_discount", "l_partkey")
    )
    + ")",
)
def describe(spark, d):
    out = profile.describe(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_partkey"])
    return out.select("column_name", "num_values", *[r6(c).alias(c) for c in ("mean", "std", "min_value", "max_value")])


@query(
    "dataset_stats",
    sql(
        "me_long samples",
        """select count(*) as num_pairs, count(distinct cpg_idx) as num_sites, count(distinct sample_idx) as num_samples,
                  count(distinct tissue_name) as num_tissues, count(distinct cpg_idx) * count(distinct sample_idx) as num_product
           from me_long join samples using (sample_idx)""",
    ),
)
def dataset_stats(spark, d):
    long = me_long(spark, d).join(samples(spark, d).select("sample_idx", "tissue_name"), "sample_idx")
    return profile.dataset_stats(long, "cpg_idx", "sample_idx", "tissue_name")


@query(
    "shard_stats",
    "select 'lineitem.parquet' as file, count(*) as num_rows from lineitem union all select 'orders.parquet', count(*) from orders",
)
def shard_stats(spark, d):
    """Rows per file of two tables."""
    sizes = profile.shard_sizes(table(spark, d, "lineitem")).unionByName(profile.shard_sizes(table(spark, d, "orders")))
    return sizes.select(base_name("file").alias("file"), "num_rows")


@query(
    "stats_table",
    """select l_returnflag, format('{:,}', count(*)) as num_rows_text, printf('%.2f', count(*) / 2.5::double / 128) as seconds_text,
              printf('%.2f', count(*) / 2.5::double / 128 / 3600) as hours_text from lineitem group by 1""",
)
def stats_table(spark, d):
    sizes = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"))
    return profile.run_time_table(sizes, "l_returnflag", "n", speed=2.5, batch=128)


@query(
    "pair_index",
    sql(
        "me_long",
        """select cpg_idx, sample_idx, site_no, sample_no, sample_no * (select count(*) from sites) + site_no as flat_idx
           from me_long join sites using (cpg_idx) join cols using (sample_idx)""",
        sites="select cpg_idx, row_number() over (order by cpg_idx) - 1 as site_no from (select distinct cpg_idx from me_long)",
        cols="select sample_idx, row_number() over (order by sample_idx) - 1 as sample_no from (select distinct sample_idx from me_long)",
    ),
)
def pair_index(spark, d):
    """Flat positions of the pairs, taken apart again by the inverse function."""
    from sitewise.operators.ids import assign_ids

    pairs = me_long(spark, d).select("cpg_idx", "sample_idx")
    sites = assign_ids(pairs.select("cpg_idx").distinct(), ["cpg_idx"], "site_no")
    cols = assign_ids(pairs.select("sample_idx").distinct(), ["sample_idx"], "sample_no")
    total = sites.agg(F.count("*").alias("n")).scalar()
    flat = reshape.flat_index(pairs.join(sites, "cpg_idx").join(cols, "sample_idx"), total)
    return reshape.unflatten(flat.drop("site_no", "sample_no"), total)


_GENE_PLACES = "select gene_idx, row_number() over (order by gene_idx) - 1 as place from (select distinct gene_idx from ge_long)"


def _placed_expression(spark, d):
    from sitewise.operators.ids import assign_ids

    long = ge_long(spark, d)
    places = assign_ids(long.select("gene_idx").distinct(), ["gene_idx"], "place")
    return long.join(places, "gene_idx")


@query(
    "attach_vector",
    sql(
        "me_long ge_long",
        """select m.cpg_idx, m.sample_idx, array_to_string(v.vector, ',') as vector
           from me_long m left join vec v using (sample_idx)""",
        places=_GENE_PLACES,
        vec="""select sample_idx, list(cast(round(expr * 10000000.0) as bigint) order by place) as vector
               from ge_long join places using (gene_idx) group by 1""",
    ),
)
def attach_vector(spark, d):
    """The expression vector of the sample of every pair, as text; null where a sample has none."""
    shown = F.round(F.col("expr") * 10000000.0).cast("bigint").cast("string").alias("shown")
    cells = _placed_expression(spark, d).select("sample_idx", "place", shown)
    runs = reshape.text_runs(cells, "sample_idx", "place", "shown")
    out = reshape.attach_runs(me_long(spark, d).select("cpg_idx", "sample_idx"), runs)
    return out.select("cpg_idx", "sample_idx", "vector")


@query(
    "pad_and_mask",
    sql(
        "samples",
        """select sample_idx, list_concat(codes, list_transform(range(size - len(codes)), lambda i: 0)) as codes,
                  list_transform(range(size), lambda i: i < len(codes)) as mask, list_transform(range(len(codes)), lambda i: cast(i as int)) as position_ids
           from (select *, max(len(codes)) over (partition by batch) as size from coded)""",
        coded="""select sample_idx, cast(floor(sample_idx / 16) as bigint) as batch,
                        list_transform(range(1, length(tissue_name) + 1), lambda i: ascii(substring(tissue_name, cast(i as int), 1))) as codes from samples""",
    ),
)
def pad_and_mask(spark, d):
    """Letter codes of tissue names, padded to the longest name of each batch of 16 samples."""
    letters = F.filter(F.split("tissue_name", ""), lambda c: c != "")
    coded = samples(spark, d).select(
        "sample_idx",
        F.floor(F.col("sample_idx") / 16).alias("batch"),
        F.transform(letters, lambda c: F.ascii(c)).alias("codes"),
    )
    coded = coded.withColumn("position_ids", arrays.position_ids("codes"))
    return reshape.pad_batches(coded, "batch", "codes", 0).drop("batch")


@query(
    "filter_zero",
    sql(
        "samples",
        """select sample_idx, list_filter(digits, lambda x: x <> 0) as kept,
                  list_filter(list_transform(range(len(digits)), lambda i: case when digits[i + 1] <> 0 then cast(i as int) end), lambda p: p is not null) as places
           from (select sample_idx, list_transform(string_split(right(sample_name, 9), ''), lambda c: cast(c as int)) as digits from samples)""",
    ),
)
def filter_zero(spark, d):
    """Digits of the sample names as parallel arrays with their places, zeros dropped from both."""
    digits = F.transform(
        F.filter(F.split(F.right("sample_name", F.lit(9)), ""), lambda c: c != ""), lambda c: c.cast("int")
    )
    rows = samples(spark, d).select("sample_idx", digits.alias("digits"))
    rows = rows.withColumn("places", arrays.position_ids("digits"))
    kept = rows.select("sample_idx", arrays.keep_nonzero("digits", "places").alias("_k"))
    return kept.select("sample_idx", F.col("_k.digits").alias("kept"), F.col("_k.places").alias("places"))
