"""Readers. Schemas are given or taken from a header line; values are never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sitewise.functions.numeric import nan_to_null


def header_names(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """Column names of a delimited text; an empty first name becomes `key`."""
    names = spark.read.text(path).first()["value"].rstrip("\r\n").split(sep)
    return [n.strip('"') or ("key" if i == 0 else f"column_{i}") for i, n in enumerate(names)]


def read_matrix_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Wide matrix: first column text, every other column double, NaN as null."""
    names = header_names(spark, path, sep)
    schema = T.StructType(
        [T.StructField(names[0], T.StringType())] + [T.StructField(n, T.DoubleType()) for n in names[1:]]
    )
    wide = (
        spark.read.schema(schema)
        .option("header", True)
        .option("sep", sep)
        .option("nanValue", "NaN")
        .option("nullValue", "")
        .option("maxColumns", max(20480, len(names) + 1))
        .csv(path)
    )
    return wide.select(names[0], *[nan_to_null(F.col(f"`{n}`")).alias(n) for n in names[1:]])


def csv_fields(line: str | Column, sep: str = ",") -> Column:
    """The cells of a CSV line; quoted cells lose their quotes and may hold separators."""
    # Runs without a quote are taken whole and kept, so a long cell needs no deep stack.
    cell = f'[{sep}]("[^"]*+(?:""[^"]*+)*+"|[^{sep}]*)'
    cells = F.regexp_extract_all(F.concat(F.lit(sep), line), F.lit(cell), F.lit(1))
    inner = lambda c: F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))
    return F.transform(cells, lambda c: F.when(c.startswith('"') & (F.length(c) > 1), inner(c)).otherwise(c))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, _file, _from, _i): lines with their file, the start of their file block and their order in it."""
    return spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_from"),
        F.monotonically_increasing_id().alias("_i"),
    )


def quoted_records(spark: SparkSession, path: str, quote: str = '"') -> DataFrame:
    """Records of delimited text whose quoted cells may hold line breaks, as (value, _file, _from, _i) of their first line.

    A line begins a record if the quotes before it in the file are even in number. Blocks of a file are
    counted where they are read; the parity of all earlier blocks, and the record that is still open at a
    block's start, come from one row per block. So a record may begin in one block and end in any later
    one, and files stay split. The parts of a record are joined by a line feed.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))
    lines = _lines(spark, path).withColumn("_own", quotes.cast("bigint"))
    blocks = lines.groupBy("_file", "_from").agg(F.sum("_own").alias("_n"))
    earlier = Window.partitionBy("_file").orderBy("_from").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_file", "_from", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_open"))
    inside = Window.partitionBy("_file", "_from").orderBy("_i")
    before = F.coalesce(F.sum("_own").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = lines.join(blocks, ["_file", "_from"]).withColumn("_first", (F.col("_open") + before) % 2 == 0)
    begun = F.last(F.when(F.col("_first"), F.struct("_from", "_i")), ignorenulls=True)
    marked = marked.withColumn("_record", begun.over(inside))
    # The last record begun in each block; lines before the first one of a block belong to the one before.
    last = marked.groupBy("_file", "_from").agg(F.max_by("_record", "_i").alias("_record"))
    carried = last.select("_file", "_from", F.last("_record", ignorenulls=True).over(earlier).alias("_carried"))
    marked = marked.join(carried, ["_file", "_from"]).withColumn("_record", F.coalesce("_record", "_carried"))
    parts = F.sort_array(F.collect_list(F.struct("_from", "_i", "value")))
    records = marked.groupBy("_file", "_record").agg(parts.alias("_parts"))
    return records.select(F.array_join("_parts.value", "\n").alias("value"), "_file", "_record.*")


def read_matrix_long(spark: SparkSession, path: str, sep: str = ",", line_breaks: bool = False) -> DataFrame:
    """The same matrix as (key, sample, value) rows without a wide frame in between.

    Lines are cut once; the plan has the same size for ten columns and for ten thousand. The first
    line of each file names the columns of that file. With `line_breaks` quoted cells may hold them,
    which costs two exchanges of the text.
    """
    lines = quoted_records(spark, path) if line_breaks else _lines(spark, path)
    heads = lines.where("_from = 0").groupBy("_file").agg(F.min_by("value", "_i").alias("_head"))
    names = F.transform(
        csv_fields("_head", sep), lambda n, i: F.when(n == "", F.concat(F.lit("column_"), i.cast("string"))).otherwise(n)
    )
    rows = lines.join(heads.withColumn("_names", names), "_file").where(F.col("value") != F.col("_head"))
    rows = rows.withColumn("_fields", csv_fields("value", sep))
    cells = rows.select(
        F.col("_fields")[0].alias("key"), "_names", F.posexplode(F.slice("_fields", 2, F.size("_fields") - 1)).alias("_i", "_v")
    )
    return cells.select(
        "key",
        F.try_element_at("_names", F.col("_i") + 2).alias("sample"),
        nan_to_null(F.trim("_v").try_cast("double")).alias("value"),
    )


def read_columns(spark: SparkSession, path: str, columns: list[str], max_rows: int | None = None) -> DataFrame:
    """Some columns of a CSV or parquet table; pruning happens in the scan."""
    df = read_any(spark, path).select(*columns)
    return df if max_rows is None else df.limit(max_rows)


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Reader chosen by suffix. CSV columns are text: `NA` is a value, only an empty cell is null."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix in ("csv", "tsv"):
        return (
            spark.read.option("header", True)
            .option("sep", "\t" if suffix == "tsv" else ",")
            .option("nullValue", "")
            .csv(path)
        )
    if suffix == "json":
        return spark.read.json(path)
    if suffix == "parquet" or "." not in path.rsplit("/", 1)[-1]:
        return spark.read.parquet(path)
    raise ValueError(f"no reader for suffix {suffix!r}")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_key_list(spark: SparkSession, path: str, name: str = "key") -> DataFrame:
    """One key per line, trimmed, each once."""
    return spark.read.text(path).select(F.trim("value").alias(name)).where(F.col(name) != "").distinct()


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(chr, seq, seq_len), one row per contig. Tile it at once, see `tile_sequences`.

    A compressed file is read by one task; unpack large ones first.
    """
    records = spark.read.option("lineSep", ">").text(path).where(F.length("value") > 0)
    body = F.regexp_replace(F.expr("substring(value, instr(value, '\n') + 1)"), "\\s", "")
    return (
        records.select(
            F.element_at(F.split(F.substring_index("value", "\n", 1), "\\s"), 1).alias("chr"), body.alias("seq")
        )
        .withColumn("seq_len", F.length("seq").cast("bigint"))
    )


_GTF = "chr string, source string, feature string, start bigint, end bigint, score string, strand string, frame string, attributes string"


def read_gtf(spark: SparkSession, path: str, attributes: list[str] = ["gene_id", "gene_type", "gene_name"]) -> DataFrame:
    """Annotation lines with the named attributes as columns; `start` is made 0-based."""
    lines = spark.read.schema(_GTF).option("sep", "\t").option("comment", "#").option("quote", "").csv(path)

    def attribute(name: str):
        text = F.regexp_extract("attributes", f'(?:^|; ?){name} "?([^";]*)"?', 1)
        return F.when(text != "", text).alias(name)

    return lines.withColumn("start", F.col("start") - 1).select(
        "chr", "source", "feature", "start", "end", "strand", *[attribute(a) for a in attributes]
    )


def read_json_map(spark: SparkSession, path: str, key: str = "group_idx", value: str = "name") -> DataFrame:
    """A JSON object as (key, value) rows."""
    text = spark.read.text(path, wholetext=True)
    pairs = F.from_json("value", "map<string,string>")
    return text.select(F.explode(pairs).alias(key, value)).withColumn(key, F.col(key).cast("int"))


def first_shards(paths: list[str], n: int | None) -> list[str]:
    """The first n shards of a directory listing in name order."""
    ordered = sorted(paths)
    return ordered if n is None else ordered[:n]


def read_metric_tree(spark: SparkSession, root: str) -> DataFrame:
    """(name, metric, value) rows from a tree of JSON files; the name is the file name."""
    text = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .text(root, wholetext=True)
    )
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    return text.select(name.alias("name"), F.explode(F.from_json("value", "map<string,double>")).alias("metric", "value"))


def head(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """First n rows by an order."""
    return df.orderBy(*order).limit(n)
