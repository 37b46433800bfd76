"""An inventory of objects and a queue of payloads as data sources of their own.

Both are folders of sorted Parquet files with a manifest, written by `write_inventory` and `enqueue`.
The manifest has a row for each file: its first and last key (or sequence number) and its rows.

`spark.read.format("inventory")` lists objects by bucket and key. Every file is a split. The options
`prefix` and `after` (list from behind that key on) decide from the manifest which files are opened,
and are applied page by page as they are read, so rows beside the range never leave the reader. They
are options and no pushed conditions: Spark 4.1 keeps the conditions pushed to a Python source with
the loaded table, and a second query over the same frame would inherit them.

`spark.readStream.format("job_queue")` reads payloads by sequence number: an offset is the last number
read, a micro-batch takes `maxPayloads` at most, and what was read is the same after a restart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    InputPartition,
)
from pyspark.sql.types import LongType, StringType, StructField, StructType

from foliary.schemas import LISTING
from foliary.sources.tables import _folder

#: Rows of a page, as object stores list them, and of a written file.
PAGE_ROWS, FILE_ROWS = 1000, 1_000_000

PAYLOADS = StructType([StructField("seq", LongType(), False), StructField("payload", StringType())])


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _manifest(path: str) -> list[dict]:
    """One row for each file of every complete write, by first key."""
    files, root = _open(path)
    rows = []
    for info in files.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
        if info.type != pafs.FileType.Directory or files.get_file_info(f"{info.path}/manifest/_SUCCESS").type == pafs.FileType.NotFound:
            continue
        for part in files.get_file_info(pafs.FileSelector(f"{info.path}/manifest")):
            if part.path.endswith(".parquet"):
                with files.open_input_file(part.path) as source:
                    rows += [{**r, "file": f"{info.path}/{r['file']}"} for r in pq.read_table(source).to_pylist()]
    return sorted(rows, key=lambda r: (r["first"], r["file"]))


def _write(df: DataFrame, path: str, keys: list[str], first: str) -> None:
    """Sorted files below `path`, then their manifest; readers see a write once that is complete."""
    spark = df.sparkSession
    rows = df.count()
    if not rows:
        return
    files = -(-rows // FILE_ROWS)
    if files == 1:
        # One file needs no cut by ranges. Its rows move there: a coalesce would have one task read
        # all that they are derived from.
        df = df.repartition(1)
    else:
        df = df.repartitionByRange(files, *keys)
    df.sortWithinPartitions(*keys).write.mode("overwrite").parquet(f"{path}/data")
    name = F.concat(F.lit("data/"), F.substring_index(F.input_file_name(), "/", -1))
    written = spark.read.parquet(f"{path}/data").groupBy(name.alias("file"))
    # A row for each file.
    written.agg(
        F.min(first).alias("first"), F.max(first).alias("last"), F.count(F.lit(1)).alias("rows")
    ).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def write_inventory(listing: DataFrame, path: str) -> None:
    """Write listing rows (bucket, key, size, etag) as an inventory."""
    _write(listing.select(*LISTING.fieldNames()), f"{path}/all", ["s3_bucket", "s3_key"], "s3_key")


def enqueue(payloads: DataFrame, path: str) -> int:
    """Append payloads in the order of `seq`, if they have one; returns the last number of the queue.

    One writer at a time: numbers go on from the last complete write.
    """
    spark = payloads.sparkSession
    last = max([r["last"] for r in _manifest(path)], default=0)
    if "seq" not in payloads.columns:
        payloads = payloads.withColumn("seq", F.monotonically_increasing_id())
    # Numbers without gaps, partition by partition of the sorted rows.
    rows = payloads.select("seq", "payload").orderBy("seq").rdd.zipWithIndex()
    numbered = spark.createDataFrame(rows.map(lambda r: (last + r[1] + 1, r[0]["payload"])), PAYLOADS)
    files, _ = _folder(spark, path)
    files.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(path))
    _write(numbered, f"{path}/from-{last + 1:016d}", ["seq"], "seq")
    return max([r["last"] for r in _manifest(path)], default=0)


@dataclass
class Split(InputPartition):
    """A file, and the keys that are read of it: from `low` on, up to and without `high`."""

    file: str
    low: object = None
    high: object = None


def _pages(split: Split, root: str, key: str, names: list[str], rows: int) -> Iterator[pa.RecordBatch]:
    if not split.file:
        return
    files, _ = _open(root)
    with files.open_input_file(split.file) as source:
        for page in pq.ParquetFile(source).iter_batches(batch_size=rows, columns=names):
            keys = page.column(key)
            # Files are sorted by key within a bucket; a page beside the range is not converted.
            keep = pa.array([True] * page.num_rows)
            if split.low is not None:
                keep = pc.and_(keep, pc.greater_equal(keys, split.low))
            if split.high is not None:
                keep = pc.and_(keep, pc.less(keys, split.high))
            page = page.filter(keep)
            if page.num_rows:
                yield page


class Inventory(DataSource):
    """Objects of an inventory folder: options `path`, `prefix`, `after`, and `pageRows` for a page."""

    @classmethod
    def name(cls) -> str:
        return "inventory"

    def schema(self) -> StructType:
        return LISTING

    def reader(self, schema: StructType) -> DataSourceReader:
        prefix, after = self.options.get("prefix", ""), self.options.get("after", "")
        low = max(prefix, after + "\0" if after else "")
        page = int(self.options.get("pageRows", PAGE_ROWS))
        return InventoryReader(self.options["path"], schema.fieldNames(), page, low, _after(prefix))


def _after(text: str) -> str | None:
    """The smallest text that is larger than all that start with this one."""
    points = [ord(c) for c in text]
    while points:
        last = points.pop()
        if last < 0x10FFFF:
            # Surrogates are no characters.
            return "".join(map(chr, points)) + chr(0xE000 if last + 1 == 0xD800 else last + 1)
    return None


class InventoryReader(DataSourceReader):
    """Keys from `low` on, up to and without `high`."""

    def __init__(self, path: str, names: list[str], page: int, low: str = "", high: str | None = None):
        self.path, self.names, self.page, self.low, self.high = path, names, page, low, high

    def partitions(self) -> list[Split]:
        found = [
            Split(r["file"], self.low, self.high)
            for r in _manifest(self.path)
            if r["last"] >= self.low and (self.high is None or r["first"] < self.high)
        ]
        # Spark asks for one split at least.
        return found or [Split("")]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        return _pages(partition, self.path, "s3_key", self.names, self.page)


class JobQueue(DataSource):
    """Payloads of a queue folder: options `path` and `maxPayloads` for a micro-batch."""

    @classmethod
    def name(cls) -> str:
        return "job_queue"

    def schema(self) -> StructType:
        return PAYLOADS

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return QueueReader(self.options["path"], schema.fieldNames(), int(self.options.get("maxPayloads", 1_000_000)))


class QueueReader(DataSourceStreamReader):
    def __init__(self, path: str, names: list[str], most: int):
        self.path, self.names, self.most = path, names, most
        self.reached: int | None = None

    def initialOffset(self) -> dict:
        return {"seq": 0}

    def latestOffset(self) -> dict:
        """The end of the queue, but no more than `most` payloads beyond the last batch."""
        end = max([r["last"] for r in _manifest(self.path)], default=0)
        if self.reached is not None:
            end = min(end, self.reached + self.most)
        elif self.most < end:
            end = self.most
        return {"seq": end}

    def partitions(self, start: dict, end: dict) -> list[Split]:
        self.reached = end["seq"]
        low, high = start["seq"] + 1, end["seq"] + 1
        return [Split(r["file"], low, high) for r in _manifest(self.path) if r["last"] >= low and r["first"] < high]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        return _pages(partition, self.path, "seq", self.names, PAGE_ROWS)

    def commit(self, end: dict) -> None:
        self.reached = max(self.reached or 0, end["seq"])


def register_sources(spark: SparkSession) -> SparkSession:
    """Make both formats known to a session."""
    for source in (Inventory, JobQueue):
        spark.dataSource.register(source)
    return spark


def list_inventory(spark: SparkSession, path: str, prefix: str = "", after: str = "") -> DataFrame:
    """Listing rows below a prefix, from behind the key `after` on."""
    rows = register_sources(spark).read.format("inventory").option("path", path)
    return rows.option("prefix", prefix).option("after", after).load()


def queued(spark: SparkSession, path: str, most: int = 1_000_000) -> DataFrame:
    """The queue as a stream of (seq, payload)."""
    return register_sources(spark).readStream.format("job_queue").option("path", path).option("maxPayloads", most).load()
