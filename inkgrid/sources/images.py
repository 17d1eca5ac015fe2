"""Folders of files as a Spark data source: tasks list folders, on any file system that Arrow knows by its address."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Folders are opened level by level until there are so many to deal out.
FOLDERS = 256


def opened(path: str):
    """The file system of a path, and the path as that says it.  Its threads start in the process that asks, not where this is imported."""
    from pyarrow import fs

    system, plain = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system, plain.rstrip("/")


def plain_path(path: str) -> str:
    return opened(path)[1]


class Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class FolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.deep = options.get("recursive", "true") == "true"
        self.suffixes = tuple(options.get("suffixes", ".png,.jpg").split(","))

    def _found(self, folder: str, deep: bool) -> list:
        from pyarrow.fs import FileSelector

        return opened(self.path)[0].get_file_info(FileSelector(folder, recursive=deep))

    def partitions(self) -> list[InputPartition]:
        """Folders above are listed alone, those of the last level opened with all below."""
        level, above = [plain_path(self.path)], []
        while self.deep and level and len(level) < FOLDERS:
            above += level
            level = [i.path for f in level for i in self._found(f, False) if not i.is_file]
        return [Folder(f, False) for f in above] + [Folder(f, self.deep) for f in level]

    def read(self, partition: Folder) -> Iterator[tuple]:
        for i in self._found(partition.path, partition.deep):
            if i.is_file and i.base_name.endswith(self.suffixes):
                yield i.path, i.base_name, i.size


class FolderListing(DataSource):
    """Options: path, recursive (true or false), suffixes (by commas).  A file is listed once, by the task of its folder."""

    @classmethod
    def name(cls) -> str:
        return "folder_listing"

    def schema(self) -> str:
        return "path string, name string, size long"

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options)


def write_files(files: DataFrame, folder: str) -> None:
    """Writes rows (path below folder, content) as files; a task that runs again writes the same."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (system, root), made = opened(folder), set()
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                target = f"{root}/{path}"
                parent = target.rpartition("/")[0]
                if parent not in made:
                    system.create_dir(parent, recursive=True)
                    made.add(parent)
                with system.open_output_stream(target) as out:
                    out.write(content.as_buffer() if content.is_valid else b"")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    files.select("path", "content").mapInArrow(write, "n long").agg({"n": "sum"}).collect()
