"""Lines of zstandard files (A3, A7), inflated in the reading tasks by streaming
through a file's frames: neither the cluster's native codec nor a whole file in
memory is needed. A file is read, and written, by one task."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillspark.sources.token_files import StagedWriter, filesystem

BATCH_BYTES = 4 << 20


def matching(glob: str) -> list[str]:
    """Files that match ``glob`` (wild cards after the last plain folder)."""
    from pyarrow import fs
    system, pattern = filesystem(glob)
    root = pattern
    while any(c in root for c in "*?["):
        root = root.rsplit("/", 1)[0]
    info = system.get_file_info(root)
    if info.type == fs.FileType.File:
        return [root]
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    # a wild card stays within a name
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.path.count("/") == pattern.count("/") and fnmatch.fnmatch(f.path, pattern))


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.glob = options["path"]

    def partitions(self):
        files = matching(self.glob)
        if not files:
            raise FileNotFoundError(self.glob)
        return [_File(f) for f in files]

    def read(self, partition) -> Iterator:
        import io

        import pyarrow as pa
        import zstandard
        system, _ = filesystem(self.glob)
        with system.open_input_stream(partition.path, compression=None) as raw:
            inflated = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)
            lines, size = [], 0
            for line in io.BufferedReader(inflated, 1 << 20):
                lines.append(line.rstrip(b"\r\n"))
                size += len(line)
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary()).cast(pa.string())], names=["value"])
                    lines, size = [], 0
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary()).cast(pa.string())], names=["value"])


class _Writer(StagedWriter):
    """A file a task, with a frame for each batch."""

    def __init__(self, options, overwrite: bool):
        super().__init__(options, overwrite)
        self.ext = options.get("ext", "jsonl")

    def written(self) -> list[str]:
        return matching(f"{self.path}/part-*.{self.ext}.zst")

    def parts(self, batches) -> Iterator[tuple[str, bytes]]:
        import uuid

        import zstandard
        name, c = f"part-{uuid.uuid4().hex}.{self.ext}.zst", zstandard.ZstdCompressor()
        for batch in batches:
            lines = batch.column("value").cast("binary").to_pylist()
            yield name, c.compress(b"".join(x + b"\n" for x in lines if x is not None))


class ZstLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zst_lines"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> StagedWriter:
        return _Writer(self.options, overwrite)


def _register(spark: SparkSession) -> None:
    from quillspark.session import ship_package
    ship_package(spark)
    spark.dataSource.register(ZstLines)


def write_zst_lines(lines: DataFrame, path: str, ext: str = "jsonl") -> str:
    """``lines``: one string column, a line a row (null rows are left out)."""
    _register(lines.sparkSession)
    lines.toDF("value").write.format("zst_lines").option("path", path).option("ext", ext).mode("overwrite").save()
    return path


def read_zst_lines(spark: SparkSession, glob: str) -> DataFrame:
    """``value``: the lines of all files that match."""
    _register(spark)
    return spark.read.format("zst_lines").option("path", glob).load()
