"""Assembly and export of training pairs, predictions by a model hook."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitewise.functions.sequence import kmer_ids
from sitewise.operators import export, ids, inference
from sitewise.operators.staging import write_and_read
from sitewise.operators.store import write_bucketed
from sitewise.plans.annotations import island_tuples
from sitewise.plans.book import query, r6, rs, sql
from sitewise.plans.inputs import WINDOW, islands, line_tasks, locus, me_long, samples, table
from sitewise.plans.sequences import site_windows
from sitewise.plans.splits import SPLIT_SQL, sample_split, site_split
from sitewise.operators.splits import four_way
from sitewise.schemas import SPLIT_NAMES


def _assembled(spark, d, sites=None):
    windows = site_windows(spark, d, sites).select("cpg_idx", "chr", "pos", "chr_pos", "sequence")
    return export.assemble_sites(windows, island_tuples(spark, d, sites))


@query(
    "assemble_site",
    sql(
        "windows island_tuples",
        """select cpg_idx, chr_pos, sequence, cpg_island_tuple, num_cpg_island_tuple from windows join island_tuples using (cpg_idx)""",
    ),
)
def assemble_site(spark, d):
    return _assembled(spark, d).drop("chr", "pos")


@query(
    "assembly_gaps",
    sql(
        "locus islands",
        """select cpg_idx, 'left' as side
           from (select cpg_idx from locus except select cpg_idx from islands where location <> 'sea')""",
    ),
)
def assembly_gaps(spark, d):
    """Sites that an assembly with the labels outside the sea only would have to refuse."""
    return export.unassembled(locus(spark, d), islands(spark, d).where("location <> 'sea'"))


def _sample_ids(spark, d):
    """Samples with tissue numbers in order of first appearance."""
    rows = samples(spark, d).select("sample_idx", "sample_name", "tissue_name")
    return rows.join(ids.tissue_ids(rows), "tissue_name")


_PAIRS = {
    **SPLIT_SQL,
    "tissues": "select tissue_name, row_number() over (order by min(sample_idx)) - 1 as tissue_idx from samples group by 1",
    "pairs": """select m.cpg_idx, m.sample_idx, m.methylation, t.tissue_idx, concat(a.split, '_cpg-', b.split, '_sample') as split
                from me_long m join site_split a using (cpg_idx) join sample_split b using (sample_idx)
                join tissues t on t.tissue_name = b.tissue_name
                where a.split <> 'unused' and m.methylation is not null""",
}
_GROUPS = "case split " + " ".join(f"when '{s}' then {i}" for i, s in enumerate(SPLIT_NAMES)) + " end"
_KNOWN = "(lower(chr) in ('chrx', 'chry') or (length(chr) <= 5 and try_cast(substring(chr, 4) as int) between 1 and 22))"
_CHR_NO = "case when chr = 'chrX' then 22 when chr = 'chrY' then 23 else cast(substring(chr, 4) as int) - 1 end"
ALL_CHR = [f"chr{i}" for i in range(1, 23)] + ["chrX", "chrY"]


def _labelled(spark, d, sites, tasks):
    pairs = me_long(spark, d).where("methylation is not null")
    return four_way(pairs, site_split(spark, d, sites), sample_split(spark, d), tasks)


@query(
    "export_pairs",
    sql(
        "windows island_tuples me_long samples",
        f"""select p.cpg_idx, p.sample_idx, p.methylation, p.tissue_idx, {_GROUPS} as group_idx, {_CHR_NO} as chr_idx,
                   upper(substring(w.sequence, {WINDOW // 2} - 50 + 1, 100)) as sequence, i.cpg_island_tuple, i.num_cpg_island_tuple
            from pairs p join windows w using (cpg_idx) join island_tuples i using (cpg_idx)
            where {_KNOWN} and not contains(upper(substring(w.sequence, {WINDOW // 2} - 50 + 1, 100)), 'N')""",
        **_PAIRS,
    ),
)
def export_pairs(spark, d):
    """Sites are written once, and the usable ones with their windows and labels once more by bucket.

    Every join deals the pairs by their number of rows, and so do the buckets: a task sorts no more at any size.
    """
    sites = write_and_read(locus(spark, d), "sites")
    n = line_tasks(spark, d)
    usable = export.usable_sites(_assembled(spark, d, sites), ALL_CHR, crop=100)
    store = write_bucketed(usable, "cpg_idx", max(n, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    groups = export.group_table(spark, SPLIT_NAMES)
    return export.export_pairs(_labelled(spark, d, sites, n), store, _sample_ids(spark, d), groups, n)


_WORD_CODE = " + ".join(
    f"(case substring(s, cast(i + {k} as int), 1) when 'A' then 0 when 'C' then 1 when 'G' then 2 when 'T' then 3 else 4 end) * {5 ** (3 - k)}"
    for k in range(4)
)


@query(
    "export_tokenized",
    sql(
        "windows",
        f"""select cpg_idx, {_CHR_NO} as chr_idx, list_transform(range(1, 100 - 4 + 2), lambda i: cast({_WORD_CODE} as int)) as tokenized_sequence
            from (select *, upper(substring(sequence, {WINDOW // 2} - 50 + 1, 100)) as s from windows)
            where {_KNOWN} and not contains(s, 'N')""",
    ),
)
def export_tokenized(spark, d):
    """The site side of a tokenized export: each site is encoded once."""
    sites = site_windows(spark, d).select("cpg_idx", "chr", "sequence")
    tokens = export.usable_sites(sites, ALL_CHR, crop=100, encode=lambda s: kmer_ids(s, 4))
    return tokens.select("cpg_idx", "chr_idx", "tokenized_sequence")


@query(
    "export_slim",
    sql(
        "windows me_long samples",
        f"""select p.cpg_idx, p.methylation, p.sample_idx, t.tissue_idx from me_long p
            join (select sample_idx, tissue_name from samples where balance >= 0) s using (sample_idx) join tissues t using (tissue_name)
            where p.cpg_idx in (select cpg_idx from windows where {_KNOWN} and not contains(upper(sequence), 'N'))""",
        tissues=_PAIRS["tissues"],
    ),
)
def export_slim(spark, d):
    sites = export.usable_sites(site_windows(spark, d), ALL_CHR)
    subset = samples(spark, d).where("balance >= 0")
    return export.export_slim(me_long(spark, d), sites, _sample_ids(spark, d), sample_subset=subset)


def linear_model():
    """A model for the hook: prediction from two features."""

    def run(pdf):
        return 0.5 * pdf["l_discount"] + 2.0 * pdf["l_tax"] + 0.125

    return run


@query(
    "batch_predict",
    f"""select l_orderkey, l_linenumber, l_partkey, {rs('0.5::double * l_discount + 2.0::double * l_tax + 0.125::double')} as pred_methyl
        from lineitem""",
)
def batch_predict(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount", "l_tax")
    out = inference.predict(rows, linear_model)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", r6("pred_methyl").alias("pred_methyl"))
