"""Zip archives as a data source: members streamed in by each task, one archive a task, all of a job's or none.

`df.write.format("millrace_zip").mode("append").save(folder)` takes name and content. A task writes its archive into a folder of the
job's own beside the others; when all are done these are moved into place, and when the job fails the folder goes. A task that runs twice
leaves one archive, as only the messages of the tasks that count name what is moved. No member is held but the one that is
being written, no archive at all.
"""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from . import sinks
from .tables import _opened

MEMBER = "name string, content binary"
#: Bytes of members that are read before they are handed on.
HANDED_ON = 1 << 20
#: What members are dated, so that equal members make equal archives.
DATE = (1980, 1, 1, 0, 0, 0)


class Written(WriterCommitMessage):
    def __init__(self, path: str | None, members: int) -> None:
        self.path, self.members = path, members


class ZipWriter(DataSourceWriter):
    def __init__(self, folder: str) -> None:
        self.folder, self.job = folder.rstrip("/"), uuid.uuid4().hex

    def _place(self) -> tuple[fs.FileSystem, str, str]:
        system, inner = _opened(self.folder)
        return system, inner, f"{inner}/_writing-{self.job}"

    def write(self, iterator: Iterator[Any]) -> Written:
        system, _, staging = self._place()
        path, members = f"{staging}/{uuid.uuid4().hex}.zip", 0
        first = next(iterator, None)
        if first is None:
            return Written(None, 0)
        system.create_dir(staging, recursive=True)
        with system.open_output_stream(path) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            while first is not None:
                info = zipfile.ZipInfo(first["name"], DATE)
                info.compress_type = zipfile.ZIP_DEFLATED
                archive.writestr(info, bytes(first["content"] or b""))
                members, first = members + 1, next(iterator, None)
        return Written(path, members)

    def commit(self, messages: list[Any]) -> None:
        system, inner, staging = self._place()
        for i, written in enumerate(m for m in messages if m is not None and m.path):
            system.move(written.path, f"{inner}/part-{i:05}-{self.job}.zip")
        self._clear(system, staging)

    def abort(self, messages: list[Any]) -> None:
        system, _, staging = self._place()
        self._clear(system, staging)

    def _clear(self, system: fs.FileSystem, staging: str) -> None:
        if system.get_file_info(staging).type != fs.FileType.NotFound:
            system.delete_dir(staging)


class ZipFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "millrace_zip"

    def schema(self) -> str:
        return MEMBER

    def writer(self, schema: Any, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("archives are added to a folder; write with the mode append")
        return ZipWriter(self.options["path"])


def write_archives(files: DataFrame, folder: str, *, name: str = "name", content: str = "content", order: str = "path") -> None:
    """Rows of name and content as members of archives in a folder, one for each partition. Names that differ only in case
    get -2, -3 and so on, in the order of `order`."""
    files.sparkSession.dataSource.register(ZipFiles)
    members = files.select(sinks.unique_names(files, name, order).alias("name"), F.col(content).cast("binary").alias("content"))
    members.write.format("millrace_zip").mode("append").save(folder)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """path of the archive, name and content of each member; an archive is read by one task, member by member."""

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                system, inner = _opened(path)
                rows: list[tuple[str, str, bytes]] = []
                size = 0
                with system.open_input_file(inner) as source, zipfile.ZipFile(source) as archive:
                    for info in archive.infolist():
                        rows.append((path, info.filename, archive.read(info)))
                        size += info.file_size
                        if size >= HANDED_ON:
                            yield pd.DataFrame(rows, columns=["path", "name", "content"])
                            rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "name", "content"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(folder)
    return files.select("path").mapInPandas(members, f"path string, {MEMBER}")
