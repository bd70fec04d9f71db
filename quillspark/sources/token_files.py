"""Flat token files (A10, A13): a stream as a run of little-endian unsigned
ids of 2 or 4 bytes and nothing else, as training loaders map them.

``write_token_files`` writes a chunk table as ``<stream>/part-<first
token>.bin`` files, each a run of chunks at its place in the stream; the
offsets in the names make a part's place known without a listing of sizes.
Parts are written under a task's own name and take their name at the job's
commit, so a lost or repeated task leaves nothing behind. ``read_token_files``
reads chunks, and ``read_windows`` only the byte ranges of its windows, each
in tasks. A single file without the offset in its name, as other tools write
it, is a stream by itself.

All paths go through Hadoop's file systems by pyarrow, or the local one for
plain and ``file:`` paths; nothing is read or written by the driver but names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

PART = re.compile(r"^part-(\d+)\.bin$")
#: Tokens a reading task takes at once.
SPLIT_TOKENS = 1 << 22


def filesystem(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub(r"^file:(//)?", "", path)
    return fs.FileSystem.from_uri(path)


def list_parts(path: str, width: int) -> list[tuple[str, str, int, int]]:
    """``(stream, file, first token, tokens)`` of all streams under ``path`` (a
    folder of streams) or of the one file ``path``."""
    from pyarrow import fs
    system, root = filesystem(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.File:
        return [(re.sub(r"\.[^.]*$", "", info.base_name), info.path, 0, info.size // width)]
    out = []
    for f in system.get_file_info(fs.FileSelector(root, recursive=True)):
        if f.type != fs.FileType.File or "/_" in f.path[len(root):]:
            continue
        part = PART.match(f.base_name)
        if part:
            out.append((f.path[len(root):].strip("/").rsplit("/", 1)[0], f.path, int(part[1]), f.size // width))
        elif f.base_name.endswith(".bin"):
            out.append((f.path[len(root):].strip("/")[:-4], f.path, 0, f.size // width))
    return sorted(out)


def _read(system, file: str, first: int, n: int, width: int):
    import numpy as np
    with system.open_input_file(file) as f:
        f.seek(first * width)
        return np.frombuffer(f.read(n * width), f"<u{width}").astype(np.int32)


class _Range(InputPartition):
    def __init__(self, stream: str, file: str, skip: int, at: int, n: int):
        self.stream, self.file, self.skip, self.at, self.n = stream, file, skip, at, n


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.width = options["path"], int(options.get("width", 2))
        self.chunk = int(options.get("chunk", 1 << 16))
        self.split = max(1, int(options.get("split", SPLIT_TOKENS)) // self.chunk) * self.chunk

    def partitions(self):
        out = []
        for stream, file, first, n in list_parts(self.path, self.width):
            # cuts at whole chunks of the stream
            cuts = [first, *range(first - first % self.split + self.split, first + n, self.split), first + n]
            out += [_Range(stream, file, a - first, a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a]
        return out

    def read(self, partition) -> Iterator:
        import numpy as np
        import pyarrow as pa
        system, _ = filesystem(self.path)
        at, end = partition.at, partition.at + partition.n
        while at < end:
            n = min(end - at, 16 * self.chunk - at % self.chunk)
            ids = _read(system, partition.file, partition.skip + at - partition.at, n, self.width)
            edges = [0, *range(self.chunk - at % self.chunk, n, self.chunk), n]
            place = np.array([at + e for e in edges[:-1]], np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array([partition.stream] * len(place)), pa.array(place // self.chunk), pa.array((place % self.chunk).astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids))], names=["stream", "chunk_id", "at", "tokens"])
            at += n


class _Written(WriterCommitMessage):
    def __init__(self, files):
        self.files = files


class StagedWriter(DataSourceArrowWriter):
    """Two-phase commit: tasks write under ``_temporary``, the driver renames
    the files of the attempts that counted and removes the others.

    ``parts`` gives, for a task's batches, ``(final name, bytes)`` pairs; bytes
    under the same name follow each other."""

    def __init__(self, options, overwrite: bool):
        import uuid
        self.path, self.overwrite = options["path"], overwrite
        # a job's own folder, found again when it is committed
        self.job = f"_temporary/{uuid.uuid4().hex}"

    def parts(self, batches) -> Iterator[tuple[str, bytes]]:
        raise NotImplementedError

    def written(self) -> list[str]:
        """Final files that an overwriting job replaces."""
        raise NotImplementedError

    def write(self, iterator) -> WriterCommitMessage:
        import uuid
        system, root = filesystem(self.path)
        folder = f"{root}/{self.job}/{uuid.uuid4().hex}"
        system.create_dir(folder, recursive=True)
        files: list[tuple[str, str]] = []
        out = None
        try:
            for final, data in self.parts(iterator):
                if not files or files[-1][1] != final:
                    if out:
                        out.close()
                    files.append((f"{folder}/{len(files)}", final))
                    out = system.open_output_stream(files[-1][0], compression=None)
                out.write(data)
        finally:
            if out:
                out.close()
        return _Written(files)

    def commit(self, messages) -> None:
        system, root = filesystem(self.path)
        for file in self.written() if self.overwrite else ():
            system.delete_file(file)
        for m in messages:
            for name, final in m.files if m else ():
                system.create_dir(f"{root}/{final}".rsplit("/", 1)[0], recursive=True)
                system.move(name, f"{root}/{final}")
        self.abort(messages)
        with system.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages) -> None:
        from pyarrow import fs
        system, root = filesystem(self.path)
        if system.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.job}")


class _Writer(StagedWriter):
    def __init__(self, options, overwrite: bool):
        super().__init__(options, overwrite)
        self.width = int(options.get("width", 2))

    def written(self) -> list[str]:
        return [file for _, file, _, _ in list_parts(self.path, self.width)]

    def parts(self, batches) -> Iterator[tuple[str, bytes]]:
        name, stream, end = "", None, 0
        for batch in batches:
            lists = batch.column("tokens")
            values, offs = lists.values.to_numpy(), lists.offsets.to_numpy()
            for own, start, a, b in zip(batch.column("stream").to_pylist(), batch.column("start").to_pylist(), offs[:-1], offs[1:], strict=True):
                ids = values[a:b]
                if len(ids) and (ids.min() < 0 or int(ids.max()) >= 1 << 8 * self.width):
                    raise ValueError(f"an id of stream {own} does not fit {self.width} bytes")
                if own != stream or start != end:
                    stream, end, name = own, start, f"{own}/part-{start:020d}.bin"
                yield name, ids.astype(f"<u{self.width}").tobytes()
                end += len(ids)


class TokenFiles(DataSource):
    """Options: ``path``, ``width`` (bytes of an id, 2 or 4), ``chunk`` (tokens
    of a row when reading), ``split`` (tokens of a reading task)."""

    @classmethod
    def name(cls) -> str:
        return "token_files"

    def schema(self) -> str:
        return "stream string, chunk_id bigint, at int, tokens array<int>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, overwrite)


def _register(spark: SparkSession) -> None:
    from quillspark.session import ship_package
    ship_package(spark)
    spark.dataSource.register(TokenFiles)


def stream_name(keys) -> Column:
    """The folder of a stream: ``key=value`` for each key (null: the key alone)."""
    return F.concat_ws("/", *[F.concat(F.lit(k), F.coalesce(F.concat(F.lit("="), F.url_encode(F.col(k).cast("string"))), F.lit(""))) for k in keys])


def stream_key(key: str, stream: str = "stream") -> Column:
    """The value of a key in a stream's name."""
    own = F.col(stream).rlike(rf"(^|/){key}=")
    return F.when(own, F.url_decode(F.regexp_extract(stream, rf"(?:^|/){key}=([^/]*)", 1)))


def write_token_files(chunks: DataFrame, path: str, keys=("dataset", "split"), chunk_size: int = 1 << 16, width: int = 2) -> str:
    """A10: the chunk table as flat files, one folder per stream. Chunks are
    dealt to tasks in ranges of ``keys, chunk_id``."""
    _register(chunks.sparkSession)
    rows = chunks.select(stream_name(keys).alias("stream"), (F.col("chunk_id") * chunk_size).alias("start"), "tokens") \
        .repartitionByRange("stream", "start").sortWithinPartitions("stream", "start")
    rows.write.format("token_files").option("path", path).option("width", width).mode("overwrite").save()
    return path


def read_token_files(spark: SparkSession, path: str, chunk_size: int = 1 << 16, width: int = 2, split: int = SPLIT_TOKENS) -> DataFrame:
    """``stream, chunk_id, at, tokens``. A row is a chunk of the stream,
    or a part of one where a file ends in it (``at`` is its place there)."""
    _register(spark)
    return spark.read.format("token_files").option("path", path).option("width", width).option("chunk", chunk_size).option("split", split).load()


def read_windows(windows: DataFrame, path: str, length: int, width: int = 2) -> DataFrame:
    """``windows`` (``stream, wid, start``) with ``tokens``, the ids
    ``[start, start + length)`` of the stream, shorter at its end. Every task
    lists the parts and reads just its windows' byte ranges, in their order."""
    spark = windows.sparkSession
    from quillspark.session import ship_package
    ship_package(spark)
    parts = spark.sparkContext.broadcast(list_parts(path, width))  # names of files

    def run(batches):
        import bisect

        import numpy as np
        import pyarrow as pa
        system, _ = filesystem(path)
        streams: dict[str, list] = {}
        for stream, file, first, n in parts.value:
            streams.setdefault(stream, []).append((first, n, file))
        for b in batches:
            out = []
            for stream, start in zip(b.column("stream").to_pylist(), b.column("start").to_pylist(), strict=True):
                own, got, at = streams.get(stream, []), [], start
                k = max(0, bisect.bisect_right(own, (at, 1 << 62, "")) - 1)
                while k < len(own) and at < start + length:
                    first, n, file = own[k]
                    take = min(start + length, first + n) - at
                    if take > 0 and at >= first:
                        got.append(_read(system, file, at - first, take, width))
                        at += take
                    k += 1
                out.append(np.concatenate(got) if got else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.int32()))], names=[*b.schema.names, "tokens"])
    rows = windows.select("stream", "wid", F.col("start").cast("bigint").alias("start")).sortWithinPartitions("stream", "start")
    return rows.mapInArrow(run, "stream string, wid string, start bigint, tokens array<int>")
