"""Pages of files as a data source: `spark.read.format("document_pages")`, batch and stream.

Options: `path`, a folder in any store that pyarrow opens (local folders, and others by their URI); `reader`, the name
"module:function" of a function from a file's bytes to (text, method, confidence) of its pages; `files`, how many files a
partition reads. Each partition is a range of the files in order of their names. A stream reads files once each, in the order
of their names: those that come later have to be named later, as by time or number.

Rows (doc_id, name, page_no, text, method, ocr_conf): doc_id is that of the file's bytes, as at intake. An empty file or one without
pages gives no rows; a file that the reader fails on fails the task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from importlib import import_module

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "doc_id string, name string, page_no int, text string, method string, ocr_conf double"
FILES = 16
Pages = list[tuple[str, str, float]]


def lines_as_pages(content: bytes) -> Pages:
    """A text file of which each line is a page."""
    return [(line, "native", 1.0) for line in content.decode("utf-8", "replace").splitlines()]


class FileRange(InputPartition):
    def __init__(self, names: list[str]) -> None:
        self.names = names


class _Files:
    """The files below the path, and their pages."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.per = options["path"], int(options.get("files", FILES))
        self.reader = options.get("reader", f"{lines_as_pages.__module__}:{lines_as_pages.__name__}")

    def _open(self):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        return store, path, fs

    def names(self, after: str = "") -> list[str]:
        store, path, fs = self._open()
        found = store.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        own = sorted(x.path for x in found if x.is_file and not x.base_name.startswith(("_", ".")))
        return [x for x in own if x > after]

    def ranges(self, names: list[str]) -> list[FileRange]:
        return [FileRange(names[i : i + self.per]) for i in range(0, len(names), self.per)]

    def pages(self, names: list[str]) -> Iterator[tuple]:
        module, _, function = self.reader.partition(":")
        read: Callable[[bytes], Pages] = lines_as_pages if module == lines_as_pages.__module__ and function == lines_as_pages.__name__ else getattr(import_module(module), function)
        store = self._open()[0]
        for name in names:
            with store.open_input_stream(name) as file:
                content = file.read()
            doc_id = hashlib.sha256(content).hexdigest()[:12]
            for n, (text, method, conf) in enumerate(read(content), 1):
                yield doc_id, name.rpartition("/")[2], n, text, method, conf


class _Batch(DataSourceReader):
    def __init__(self, files: _Files) -> None:
        self.files = files

    def partitions(self) -> list[InputPartition]:
        return self.files.ranges(self.files.names()) or [FileRange([])]

    def read(self, partition: FileRange) -> Iterator[tuple]:
        return self.files.pages(partition.names)


class _Stream(DataSourceStreamReader):
    def __init__(self, files: _Files) -> None:
        self.files = files

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        return {"after": max(self.files.names(), default="")}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.files.ranges([x for x in self.files.names(start["after"]) if x <= end["after"]])

    def read(self, partition: FileRange) -> Iterator[tuple]:
        return self.files.pages(partition.names)

    def commit(self, end: dict) -> None:
        pass  # files stay where they are


class DocumentPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "document_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(_Files(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(_Files(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DocumentPages)
