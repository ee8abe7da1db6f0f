"""Publishing a folder of files in a format that Spark has no writer for, in two phases.

Tasks write into a staging folder beside the target, each attempt under a name of its own. Only when all have ended well does the driver
drop what no successful attempt named, move the old folder aside, rename the staging folder to the target and delete the
old one. A write that fails removes its staging folder, and the old output stands as it was. Should the driver be lost between the two
renames, the next write puts the old folder back first.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import ship_package

#: By kind of file: what opens a writer of record batches on an output stream. More kinds are added here.
KINDS: dict[str, Callable] = {"arrow": pa.ipc.new_file}


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it, of a local path or a URI that pyarrow knows, also with one slash, as Hadoop writes them."""
    scheme = re.match(r"([A-Za-z][\w+.-]*):(?=/)", path)
    if not scheme:
        return fs.FileSystem.from_uri(f"file://{os.path.abspath(path)}")
    return fs.FileSystem.from_uri(path if "://" in path else f"{scheme[1]}://{path[scheme.end():]}")


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int


def _there(files: fs.FileSystem, path: str) -> bool:
    return files.get_file_info(path).type != fs.FileType.NotFound


def restore(files: fs.FileSystem, target: str) -> None:
    """Puts back what a lost driver had moved aside, and clears what it left."""
    folder, _, name = target.rstrip("/").rpartition("/")
    if not _there(files, folder or "/"):
        return
    for info in files.get_file_info(fs.FileSelector(folder or "/")):
        if info.base_name.startswith(f"{name}._old-"):
            if _there(files, target):
                files.delete_dir(info.path)
            else:
                files.move(info.path, target)


class FolderWriter(DataSourceArrowWriter):
    def __init__(self, path: str, kind: str, schema: StructType, overwrite: bool):
        self.path, self.kind, self.schema, self.overwrite, self.token = path.rstrip("/"), kind, schema, overwrite, uuid.uuid4().hex

    def _folders(self) -> tuple[fs.FileSystem, str, str]:
        files, target = filesystem(self.path)
        return files, target, f"{target}._staging-{self.token}"

    def begin(self) -> FolderWriter:
        """Makes the staging folder. Tasks don't, so that one which outlives an abort finds none."""
        files, _, staging = self._folders()
        files.create_dir(staging)
        return self

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, _, staging = self._folders()
        at = TaskContext.get()
        name = f"part-{at.partitionId():05d}-{at.taskAttemptId()}.{self.kind}"
        kinds, rows = to_arrow_schema(self.schema), 0
        with files.open_output_stream(f"{staging}/{name}") as out, KINDS[self.kind](out, kinds) as writer:
            for batch in iterator:
                writer.write_batch(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, kinds)], schema=kinds))
                rows += batch.num_rows
        return Written(name, rows)

    def commit(self, messages: list[Written | None]) -> None:
        files, target, staging = self._folders()
        names = {m.name for m in messages if m}
        for info in files.get_file_info(fs.FileSelector(staging)):
            if info.base_name not in names:
                files.delete_file(info.path)
        restore(files, target)
        if not self.overwrite and _there(files, target):
            for name in sorted(names):
                files.move(f"{staging}/{name}", f"{target}/{self.token}-{name}")
            files.delete_dir(staging)
            return
        files.open_output_stream(f"{staging}/_SUCCESS").close()
        old = f"{target}._old-{self.token}"
        if _there(files, target):
            files.move(target, old)
        files.move(staging, target)
        if _there(files, old):
            files.delete_dir(old)

    def abort(self, messages: list[Written | None]) -> None:
        files, _, staging = self._folders()
        if _there(files, staging):
            files.delete_dir(staging)


class Folder(DataSource):
    """df.write.format("lingmill_folder").option("kind", "arrow").mode("overwrite" or "append").save(path)"""

    @classmethod
    def name(cls) -> str:
        return "lingmill_folder"

    def writer(self, schema: StructType, overwrite: bool) -> FolderWriter:
        kind = self.options.get("kind", "arrow")
        if kind not in KINDS:
            raise ValueError(f"no such kind: {kind}")
        return FolderWriter(self.options["path"], kind, schema, overwrite).begin()


def write_folder(df: DataFrame, path: str, kind: str = "arrow", *, append: bool = False) -> None:
    """A file a task, in a folder that all executors and the driver reach under this path or URI."""
    ship_package(df.sparkSession)
    df.sparkSession.dataSource.register(Folder)
    df.write.format("lingmill_folder").option("kind", kind).mode("append" if append else "overwrite").save(path)
