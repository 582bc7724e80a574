"""Shards of a folder as a stream of epochs: seeded order, a set number of rows, resumable anywhere.

`spark.readStream.format("epochs")` goes over the parquet files of a folder. Each epoch has its own order of
shards, drawn from the seed (without one they come as listed), and ends after `rows_per_epoch` rows: the last shard is cut there, and an epoch
that asks for more rows than there are begins another pass in a new order. Without that option an epoch is
one pass. The offset is (epoch, shards taken, rows taken), so a query goes on in the middle of an epoch, and
a batch that runs again brings the same rows. Rows carry `epoch` and `place`, their number in the epoch.

Options: `path`, `checkpoint` (the query's own, where the last planned offset is looked up after a restart),
`schema` (DDL of the files' columns), `seed`, `epochs`, `rows_per_epoch`, `shards_per_batch`. Files are opened
by pyarrow in the tasks, one task per shard; the driver reads the folder listing and the footers of the shards
of one batch.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def _open(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def list_shards(path: str) -> list[str]:
    """Parquet files under a folder in the order of their paths, numbers in them taken as numbers."""
    from pyarrow import fs

    files, root = _open(path)
    found = files.get_file_info(fs.FileSelector(root, recursive=True))
    hidden = lambda p: any(part[:1] in "._" for part in p[len(root) :].strip("/").split("/"))
    natural = lambda p: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", p)]
    return sorted((f.path for f in found if f.is_file and f.path.endswith(".parquet") and not hidden(f.path)), key=natural)


def shard_order(seed: int | None, epoch: int, round_no: int, shards: int) -> list[int]:
    """The order in which a pass of an epoch takes the shards; the same for the same seed everywhere, as listed without one."""
    if seed is None:
        return list(range(shards))
    return sorted(range(shards), key=lambda i: hashlib.sha256(f"{seed}:{epoch}:{round_no}:{i}".encode()).hexdigest())


class ShardPart(InputPartition):
    def __init__(self, path: str, epoch: int, place: int, rows: int):
        self.path, self.epoch, self.place, self.rows = path, epoch, place, rows


class EpochReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.schema = options["path"], schema
        self.seed = int(options["seed"]) if "seed" in options else None
        self.epochs = int(options.get("epochs", "1"))
        limit = options.get("rows_per_epoch")
        self.limit = int(limit) if limit else None
        self.per_batch = int(options.get("shards_per_batch", "64"))
        self.shards = list_shards(self.path)
        self.order = lru_cache(maxsize=4)(lambda epoch, round_no: shard_order(self.seed, epoch, round_no, len(self.shards)))
        self.size = lru_cache(maxsize=1 << 16)(self._size)
        self.at = self._planned(options.get("checkpoint")) or self.initialOffset()

    def __getstate__(self):
        """Tasks only open the files of their part."""
        return {"path": self.path, "schema": self.schema}

    @staticmethod
    def _planned(checkpoint: str | None) -> dict | None:
        """The end of the last batch that the query has planned, from its offset log."""
        from pyarrow import fs

        if not checkpoint:
            return None
        files, root = _open(checkpoint)
        found = files.get_file_info(fs.FileSelector(f"{root}/offsets", allow_not_found=True))
        batches = {int(f.base_name): f.path for f in found if f.base_name.isdigit()}
        if not batches:
            return None
        text = files.open_input_stream(batches[max(batches)]).read().decode()
        return json.loads(text.strip().splitlines()[-1])

    def _size(self, shard: int) -> int:
        import pyarrow.parquet as pq

        return pq.read_metadata(self.shards[shard], filesystem=_open(self.path)[0]).num_rows

    def initialOffset(self) -> dict:
        return {"epoch": 0, "taken": 0, "rows": 0}

    def _steps(self, start: dict) -> Iterator[tuple[dict, ShardPart]]:
        """The parts from an offset on, each with the offset behind it."""
        epoch, taken, rows = start["epoch"], start["taken"], start["rows"]
        any_rows = False
        while epoch < self.epochs and self.shards:
            round_no, nth = divmod(taken, len(self.shards))
            shard = self.order(epoch, round_no)[nth]
            use = self.size(shard) if self.limit is None else min(self.size(shard), self.limit - rows)
            part = ShardPart(self.shards[shard], epoch, rows, use)
            taken, rows, any_rows = taken + 1, rows + use, any_rows or use > 0
            passed = taken % len(self.shards) == 0
            if (self.limit is None and passed) or (self.limit is not None and rows >= self.limit) or (passed and not any_rows):
                epoch, taken, rows, any_rows = epoch + 1, 0, 0, False
            yield {"epoch": epoch, "taken": taken, "rows": rows}, part

    def latestOffset(self) -> dict:
        for _, (self.at, _part) in zip(range(self.per_batch), self._steps(self.at)):
            pass
        return self.at

    def partitions(self, start: dict, end: dict) -> list[ShardPart]:
        out = []
        if start == end:
            return out
        for behind, part in self._steps(start):
            if part.rows:
                out.append(part)
            if behind == end:
                break
        return out

    def read(self, partition: ShardPart):
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        names = [n for n in schema.names if n not in ("epoch", "place")]
        left, place = partition.rows, partition.place
        with _open(self.path)[0].open_input_file(partition.path) as file:
            for batch in pq.ParquetFile(file).iter_batches(columns=names):
                batch = batch.slice(0, left)
                n = batch.num_rows
                own = {"epoch": pa.array([partition.epoch] * n, pa.int32()), "place": pa.array(range(place, place + n), pa.int64())}
                columns = [own[f.name] if f.name in own else batch.column(f.name).cast(f.type) for f in schema]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
                left, place = left - n, place + n
                if not left:
                    return


class EpochSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "epochs"

    def schema(self) -> str:
        return f"{self.options['schema']}, epoch int, place bigint"

    def streamReader(self, schema: StructType) -> EpochReader:
        return EpochReader(dict(self.options), schema)


def read_epochs(
    spark: SparkSession, path: str, checkpoint: str, schema: str, seed: int | None = None, epochs: int = 1,
    rows_per_epoch: int | None = None, shards_per_batch: int = 64,
) -> DataFrame:
    """A stream of epochs over the shards of a folder; `checkpoint` is that of the query that will read it."""
    spark.dataSource.register(EpochSource)
    reader = spark.readStream.format("epochs").option("path", path).option("checkpoint", checkpoint).option("schema", schema)
    reader = reader.option("epochs", epochs).option("shards_per_batch", shards_per_batch)
    given = {"seed": seed, "rows_per_epoch": rows_per_epoch}
    return reader.options(**{k: v for k, v in given.items() if v is not None}).load()


def append_epochs(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append batch after batch; wait with `processAllAvailable`, then stop. A restart goes on where it ended."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").start(path)
