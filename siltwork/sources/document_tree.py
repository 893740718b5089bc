"""A source and sink of document trees: spark.read.format("document_tree").load(root), a row for each file.

Planning lists the tree and leaves out administrative folders, whose names begin with _, files that don't match, and files that filters on path
or size rule out; what is left is dealt out by bytes. A file above max_bytes is an error, or with on_large = "skip" no row. Trees are read
and written by pyarrow's file systems, so a root may be any address these open.

Rows (folder, text) are written as a file each, which one task opens once, without a rename of its own. An attempt of a task writes below
an administrative folder; when all tasks are done the driver moves the folders of those that count, one for each task and folder.
"""

from __future__ import annotations

import fnmatch
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, LessThanOrEqual, Not, StringStartsWith, WriterCommitMessage

SCHEMA = "path string, size long, text string"
NAMES = ["path", "size", "text"]
PER_TASK = 64 << 20  # bytes that a task reads
PER_BATCH, ROWS = 4 << 20, 4096  # bytes and files of one batch
MOST = 32 << 20  # bytes of one file


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


def opened(root: str):
    """The file system of a root, and its path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.pattern = options["path"], options.get("pattern", "*")
        self.most, self.per_task = int(options.get("max_bytes", MOST)), int(options.get("per_task", PER_TASK))
        self.skip = options.get("on_large", "fail") == "skip"
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            of = getattr(f.child if isinstance(f, Not) else f, "attribute", None)
            if of == ("path",) and isinstance(f.child if isinstance(f, Not) else f, (EqualTo, In, StringStartsWith)) or of == ("size",) and isinstance(f, LessThanOrEqual):
                self.filters.append(f)
            else:
                yield f

    def _passes(self, path: str, size: int) -> bool:
        return all(not _holds(f.child, path, size) if isinstance(f, Not) else _holds(f, path, size) for f in self.filters)

    def _listed(self) -> list[tuple[str, int]]:
        from pyarrow import fs

        system, top = opened(self.root)
        found, folders = [], [top]
        while folders:
            for info in system.get_file_info(fs.FileSelector(folders.pop())):
                if info.base_name.startswith(("_", ".")):
                    continue
                if info.type == fs.FileType.Directory:
                    folders.append(info.path)
                elif fnmatch.fnmatch(info.base_name, self.pattern):
                    found.append((info.path[len(top) :].lstrip("/"), info.size))
        return sorted(f for f in found if self._passes(*f))

    def partitions(self) -> list[InputPartition]:
        parts, held, used = [], [], 0
        for path, size in self._listed():
            if size > self.most:
                if self.skip:
                    continue
                raise ValueError(f"{path} has {size} bytes; at most {self.most} are read")
            if held and used + size > self.per_task:
                parts.append(Files(held))
                held, used = [], 0
            held.append((path, size))
            used += size
        return parts + [Files(held)] * bool(held) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, top = opened(self.root)
        rows, used = [], 0
        for path, size in partition.files:
            with system.open_input_stream(f"{top}/{path}") as f:
                rows.append((path, size, f.read().decode("utf-8", "replace")))
            used += size
            if used >= PER_BATCH or len(rows) == ROWS:
                yield batch_of(rows)
                rows, used = [], 0
        if rows:
            yield batch_of(rows)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.string(), pa.int64(), pa.string()))], names=NAMES)


def _holds(f: Filter, path: str, size: int) -> bool:
    if isinstance(f, StringStartsWith):
        return path.startswith(f.value)
    if isinstance(f, LessThanOrEqual):
        return size <= f.value
    return path in f.value if isinstance(f, In) else path == f.value


@dataclass
class Written(WriterCommitMessage):
    attempt: str
    partition: int
    folders: list[str]


class TreeWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.root, self.staged = options["path"], f"_staged-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, top = opened(self.root)
        attempt, made = f"{self.staged}/{task.taskAttemptId()}", {}
        for batch in iterator:
            texts = batch.column(1).cast(pa.binary())
            for i, folder in enumerate(batch.column(0).to_pylist()):
                n = made.get(folder, 0)
                if not n:
                    system.create_dir(f"{top}/{attempt}/{folder}")
                made[folder] = n + 1
                with system.open_output_stream(f"{top}/{attempt}/{folder}/part-{n:06d}", compression=None) as f:
                    f.write(texts[i].as_buffer() or b"")
        return Written(attempt, task.partitionId(), sorted(made))

    def commit(self, messages: list[Written | None]) -> None:
        system, top = opened(self.root)
        job = self.staged.removeprefix("_staged-")[:8]
        for m in messages:
            for folder in m.folders if m else []:
                system.create_dir(f"{top}/{folder}")
                system.move(f"{top}/{m.attempt}/{folder}", f"{top}/{folder}/{job}-{m.partition:05d}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, top = opened(self.root)
        if system.get_file_info(f"{top}/{self.staged}").type == fs.FileType.Directory:
            system.delete_dir(f"{top}/{self.staged}")


class DocumentTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "document_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite or [(f.name, f.dataType.simpleString()) for f in schema.fields] != [("folder", "string"), ("text", "string")]:
            raise ValueError("a tree is appended to, by rows (folder string, text string)")
        return TreeWriter(self.options)


def read_tree(spark, root: str, **options) -> "DataFrame":  # noqa: F821
    """path below root, size and text of each document of the tree."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DocumentTree)
    return spark.read.format("document_tree").options(**{k: str(v) for k, v in options.items()}).load(root)


def write_tree(rows: "DataFrame", root: str) -> None:  # noqa: F821
    """rows(folder, text) as files below root, one for each row; a null text is an empty file."""
    rows.sparkSession.dataSource.register(DocumentTree)
    rows.select("folder", "text").write.format("document_tree").mode("append").save(root)
