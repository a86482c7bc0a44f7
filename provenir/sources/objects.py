"""Objects of a folder as a Spark data source: partitioned listing and results beside their sources.

Reading lists (key, size, last_modified), without opening a file: the driver
lists the levels down to ``depth`` only, each folder found there is a partition
that a task lists to the bottom. Filters on the key's start and end reach the
source: a prefix cuts the folders before they are listed. Writing puts one
result file beside each source (``in/clip.mp4`` -> ``in/clip_result.json``) in
two phases: tasks write files of their own attempt, the commit moves them to
their names, so that a failed or repeated task leaves nothing half done and a
replay gives the same files.

Options: ``path``, a local path or a URI that ``pyarrow.fs`` reaches from every
executor; ``depth`` (default 1).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, Filter, InputPartition, StringEndsWith, StringStartsWith, WriterCommitMessage

from .sinks import result_key

FORMAT = "provenir_objects"
LISTED = "key string, size bigint, last_modified timestamp"
BATCH = 4096


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, as Spark writes paths (not percent-encoded), and the path in it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return pafs.FileSystem.from_uri(quote(path, safe=":/@?=&"))
    return pafs.LocalFileSystem(), path


@dataclass
class Folder(InputPartition):
    path: str
    recursive: bool


class Listing(DataSourceReader):
    def __init__(self, root: str, depth: int) -> None:
        self.root, self.depth = root.rstrip("/"), depth
        self.starts: list[str] = []
        self.ends: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, StringStartsWith) and f.attribute == ("key",):
                self.starts.append(f.value)
            elif isinstance(f, StringEndsWith) and f.attribute == ("key",):
                self.ends.append(f.value)
            else:
                yield f

    def _may_hold(self, folder: str) -> bool:
        """Whether keys below a folder can start as asked."""
        key = folder + "/" if folder else ""
        return all(key.startswith(s) or s.startswith(key) for s in self.starts)

    def partitions(self) -> list[InputPartition]:
        fs, root = opened(self.root)
        level, parts = [""], []
        for _ in range(self.depth):
            parts += [Folder(d, False) for d in level]
            below = []
            for d in level:
                found = fs.get_file_info(pafs.FileSelector(f"{root}/{d}".rstrip("/")))
                below += [f"{d}/{x.base_name}".lstrip("/") for x in found if x.type == pafs.FileType.Directory]
            level = [d for d in below if self._may_hold(d)]
        return parts + [Folder(d, True) for d in level]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        fs, root = opened(self.root)
        skip = len(root) + 1
        todo, rows = [f"{root}/{partition.path}".rstrip("/")], []
        schema = pa.schema([("key", pa.string()), ("size", pa.int64()), ("last_modified", pa.timestamp("us", "UTC"))])

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        while todo:
            for x in fs.get_file_info(pafs.FileSelector(todo.pop())):
                key = x.path[skip:]
                if x.type == pafs.FileType.Directory:
                    if partition.recursive and self._may_hold(key):
                        todo.append(x.path)
                elif all(key.startswith(s) for s in self.starts) and all(key.endswith(s) for s in self.ends):
                    rows.append((key, x.size, x.mtime))
                    if len(rows) == BATCH:
                        yield batch()
                        rows = []
        if rows:
            yield batch()


@dataclass
class Written(WriterCommitMessage):
    """Files of a task: (where it is, where it goes)."""

    files: list[tuple[str, str]] = field(default_factory=list)


class Beside(DataSourceWriter):
    """Rows (key, document): one file for each."""

    def __init__(self, root: str) -> None:
        self.root, self.run = root.rstrip("/"), uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        fs, root = opened(self.root)
        done = Written()
        attempt = f"{self.run}-{TaskContext.get().taskAttemptId()}"
        try:
            for row in iterator:
                name = f"{root}/{row.key}"
                part = f"{name}.tmp-{attempt}"
                fs.create_dir(name.rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(part) as out:
                    done.files.append((part, name))
                    out.write(row.document.encode("utf-8"))
        except BaseException:
            self._drop([done])
            raise
        return done

    def commit(self, messages: list[Written | None]) -> None:
        fs, _ = opened(self.root)
        for part, name in (f for m in messages if m for f in m.files):
            fs.move(part, name)

    def abort(self, messages: list[Written | None]) -> None:
        self._drop(messages)

    def _drop(self, messages: list[Written | None]) -> None:
        fs, _ = opened(self.root)
        for part, _name in (f for m in messages if m for f in m.files):
            if fs.get_file_info(part).type != pafs.FileType.NotFound:
                fs.delete_file(part)


class Objects(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return LISTED

    def reader(self, schema) -> Listing:
        return Listing(self.options["path"], int(self.options.get("depth", "1")))

    def writer(self, schema, overwrite: bool) -> Beside:
        return Beside(self.options["path"])


def objects(spark: SparkSession, root: str, depth: int = 1) -> DataFrame:
    """The objects below a folder: (key, size, last_modified)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Objects)
    return spark.read.format(FORMAT).option("path", root).option("depth", depth).load()


def write_beside(df: DataFrame, key: str | Column, document: Column, root: str) -> None:
    """Write a JSON document beside each source object; of several for one source, the largest in text order stays."""
    df.sparkSession.dataSource.register(Objects)
    named = df.select(result_key(key).alias("key"), F.to_json(document).alias("document")).filter("key is not null and document is not null")
    one = named.groupBy("key").agg(F.max("document").alias("document"))
    one.write.format(FORMAT).mode("append").option("path", root).save()


def results_stream(stream: DataFrame, key: str, document: Column, root: str, checkpoint: str):
    """Write the results of a stream beside their sources; a batch that is replayed overwrites its own files."""
    writer = stream.writeStream.foreachBatch(lambda df, _: write_beside(df, key, document, root))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
