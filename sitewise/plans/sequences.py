"""Base windows, codes and words."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitewise.functions import sequence as S
from sitewise.operators import windows as W
from sitewise.operators.staging import staging_path
from sitewise.plans.book import ORACLE, query, rs, r6, sql
from sitewise.plans.inputs import TILE, WINDOW, contig_lengths, genome, locus
from sitewise.sources import fasta


def site_windows(spark, d, sites=None):
    tiles = W.tile_sequences(genome(spark, d), TILE, WINDOW)
    sites = (locus(spark, d) if sites is None else sites).select("cpg_idx", "chr", "pos", "chr_pos")
    return W.site_windows(sites, tiles, TILE, WINDOW)


@query(
    "seq_window",
    sql("windows", "select cpg_idx, chr_pos, sequence, lower(base) in ('c', 'g') as is_site_base from windows"),
)
def seq_window(spark, d):
    return site_windows(spark, d).select("cpg_idx", "chr_pos", "sequence", W.is_site_base().alias("is_site_base"))


@query(
    "genome_tiles",
    sql(
        "genome",
        f"""select chr, cast(t as bigint) as tile, substring(seq, (t * {TILE} + 1)::int, {TILE + WINDOW}) as seq, seq_len
            from (select *, unnest(range(0, (seq_len + {TILE - 1}) // {TILE})) as t from genome)""",
    ),
)
def genome_tiles(spark, d):
    return W.tile_sequences(genome(spark, d), TILE, WINDOW).withColumn("seq_len", F.col("seq_len").cast("bigint"))


def _fasta(spark, d) -> str:
    """The genome as FASTA text in the shared folder, lines of 60 bases."""
    path = staging_path(spark, "fasta")
    fasta.write_fasta(genome(spark, d), path)
    return path


@query("fasta_tiles", ORACLE["genome_tiles"])
def fasta_tiles(spark, d):
    """The tile store put together from the lines of FASTA files."""
    return fasta.read_fasta_tiles(spark, _fasta(spark, d), TILE, WINDOW)


@query("fasta_sizes", sql("genome", "select chr, seq_len from genome"))
def fasta_sizes(spark, d):
    return fasta.contig_sizes(fasta.contig_lines(spark, _fasta(spark, d))).select("chr", "seq_len")


@query("fasta_windows", ORACLE["seq_window"])
def fasta_windows(spark, d):
    """Site windows out of a FASTA file, no contig ever being one row."""
    tiles = fasta.read_fasta_tiles(spark, _fasta(spark, d), TILE, WINDOW)
    sites = locus(spark, d).select("cpg_idx", "chr", "pos", "chr_pos")
    windows = W.site_windows(sites, tiles, TILE, WINDOW)
    return windows.select("cpg_idx", "chr_pos", "sequence", W.is_site_base().alias("is_site_base"))


@query("contig_lengths", sql("genome", "select chr, seq_len from genome"))
def contig_length_table(spark, d):
    return contig_lengths(spark, d).select("chr", "seq_len")


@query("center_crop", sql("windows", f"select cpg_idx, substring(sequence, {WINDOW // 2} - 50 + 1, 100) as sequence from windows"))
def center_crop(spark, d):
    return site_windows(spark, d).select("cpg_idx", S.center_crop("sequence", 100).alias("sequence"))


@query(
    "filter_n",
    sql("windows", f"select cpg_idx, chr from windows where not contains(upper(substring(sequence, {WINDOW // 2} - 50 + 1, 100)), 'N')"),
)
def filter_n(spark, d):
    cropped = site_windows(spark, d).select("cpg_idx", "chr", S.center_crop("sequence", 100).alias("_s"))
    return cropped.where(~S.has_unknown_base("_s")).select("cpg_idx", "chr")


@query(
    "n_stats",
    sql(
        "windows",
        f"""select chr, count(*) as num_sites, count(*) filter (where n > 0) as num_with_n, max(n) as max_n,
                   {rs('count(*) filter (where n > 0) / count(*)')} as ratio
            from (select chr, cast(length(sequence) - length(replace(upper(sequence), 'N', '')) as int) as n from windows) group by 1""",
    ),
)
def n_stats(spark, d):
    return W.unknown_base_share(site_windows(spark, d)).withColumn("ratio", r6("ratio"))


@query(
    "length_stats",
    """select count(*) as num_points, cast(trunc(avg(n)) as bigint) as mean, cast(trunc(stddev_pop(n)) as bigint) as std,
              min(n) as min, max(n) as max from (select length(text) as n from documents)""",
)
def length_stats(spark, d):
    from sitewise.plans.inputs import table

    return W.length_stats(table(spark, d, "documents"), F.length("text"))


@query(
    "encode_bases",
    sql(
        "windows",
        f"""select cpg_idx, list_transform(string_split(upper(substring(sequence, {WINDOW // 2} - 50 + 1, 100)), ''),
                   lambda b: case b when 'A' then 0 when 'C' then 1 when 'G' then 2 when 'T' then 3 when 'N' then 4 end) as codes
            from windows""",
    ),
)
def encode_bases(spark, d):
    cropped = site_windows(spark, d).select("cpg_idx", S.center_crop("sequence", 100).alias("_s"))
    return cropped.select("cpg_idx", S.encode_bases("_s").alias("codes"))


@query(
    "kmer_tokens",
    sql(
        "windows",
        f"""select cpg_idx, list_transform(range(1, 100 - 6 + 2), lambda i: substring(s, cast(i as int), 6)) as words
            from (select cpg_idx, upper(substring(sequence, {WINDOW // 2} - 50 + 1, 100)) as s from windows)""",
    ),
)
def kmer_tokens(spark, d):
    cropped = site_windows(spark, d).select("cpg_idx", S.center_crop("sequence", 100).alias("_s"))
    return cropped.select("cpg_idx", S.kmers("_s", 6).alias("words"))
