"""CSV files as a data source for Spark: files with headers of their own, ranges of bytes, filters on paths pushed down.

`spark.read.format("millrace_csv")` gives path, at (the byte at which the record begins, so records of a file have an order),
names and cells. Options: path or paths (a JSON list of files or folders), glob, splitBytes, multiLine. Files are listed and
cut into ranges when the read is planned; each range reads its file's header, then its own records and no others, as a
stream. With multiLine (the default) a quoted value may hold line ends and a file is one range; without, ranges are of
splitBytes each, and a record belongs to the range that its first byte is in. Conditions on `path` are pushed down, so files
that they leave out are neither listed for a task nor opened; the plan names them.

Fixed results: a byte order mark is left out, empty lines are no records, records shorter than the header are filled up with
empty strings, longer ones keep their surplus cells under no name; a file without a header gives nothing.
"""

from __future__ import annotations

import csv
import fnmatch
import json
import re
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringContains, StringEndsWith, StringStartsWith

SCHEMA = "path string, at long, names array<string>, cells array<string>"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
BATCH = 2_000


def uri(path: Column) -> Column:
    """One form of a local path, however the reader that gave it writes it."""
    return F.regexp_replace(path, r"^(file:)?/+", "file:///")


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"^(file:)?/", path):
        return fs.LocalFileSystem(), re.sub(r"^(file:)?/+", "/", path)
    return fs.FileSystem.from_uri(path)


def _listed(path: str, glob: str) -> Iterator[tuple[str, int]]:
    system, inner = _opened(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    infos = system.get_file_info(fs.FileSelector(inner, recursive=True)) if info.type == fs.FileType.Directory else [info]
    prefix = "file://" if isinstance(system, fs.LocalFileSystem) else path[: len(path) - len(inner)] if path.endswith(inner) else path.split("://")[0] + "://"
    for found in sorted(infos, key=lambda x: x.path):
        if found.type == fs.FileType.File and fnmatch.fnmatch(found.base_name, glob) and not found.base_name.startswith(("_", ".")):
            yield f"{prefix}{found.path}", found.size


class Range(InputPartition):
    def __init__(self, path: str, first: int, end: int) -> None:
        self.path, self.first, self.end = path, first, end


def _holds(path: str, condition: Filter) -> bool:
    if isinstance(condition, EqualTo):
        return path == condition.value
    if isinstance(condition, In):
        return path in condition.value
    if isinstance(condition, StringStartsWith):
        return path.startswith(condition.value)
    if isinstance(condition, StringEndsWith):
        return path.endswith(condition.value)
    return not isinstance(condition, StringContains) or condition.value in path


class CsvReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        named = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.paths, self.glob = named, options.get("glob", "*.csv")
        self.multiline = options.get("multiline", "true").lower() == "true"
        self.split = int(options.get("splitbytes", 64 << 20))
        self.conditions: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for condition in filters:
            if getattr(condition, "attribute", None) == ("path",) and isinstance(condition, (EqualTo, In, StringStartsWith, StringEndsWith, StringContains, IsNotNull)):
                self.conditions.append(condition)
            else:
                yield condition

    def partitions(self) -> list[InputPartition]:
        files = [f for p in self.paths for f in _listed(p, self.glob) if all(_holds(f[0], c) for c in self.conditions)]
        step = max(self.split, 1)
        ranges = [Range(path, at, min(at + step, size)) for path, size in files for at in range(0, size, max(size, 1) if self.multiline else step)]
        return list(ranges) or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        at, cells = [], []
        for names, start, record in records(partition.path, partition.first, partition.end, self.multiline):
            at.append(start)
            cells.append(record)
            if len(at) == BATCH:
                yield _batch(partition.path, names, at, cells)
                at, cells = [], []
        if at:
            yield _batch(partition.path, names, at, cells)


def _batch(path: str, names: list[str], at: list[int], cells: list[list[str]]) -> pa.RecordBatch:
    texts = pa.list_(pa.string())
    return pa.RecordBatch.from_arrays([pa.array([path] * len(at)), pa.array(at, pa.int64()), pa.array([names] * len(at), texts), pa.array(cells, texts)], names=["path", "at", "names", "cells"])


class _Lines:
    """The lines of a file from a place on, decoded, with the place of the next one."""

    def __init__(self, file: Any, at: int) -> None:
        self.file, self.at = file, at

    def __iter__(self) -> Iterator[str]:
        return self

    def __next__(self) -> str:
        line = self.file.readline()
        if not line:
            raise StopIteration
        self.at += len(line)
        return line.decode("utf-8", "replace")


def records(path: str, first: int, end: int, multiline: bool) -> Iterator[tuple[list[str], int, list[str]]]:
    """The header, and the place and cells of each record that begins in the range."""
    system, inner = _opened(path)
    with system.open_input_file(inner) as file:
        lines = _Lines(_Buffered(file), 0)
        reader = csv.reader(lines)
        names = next((r for r in reader if r), None)
        if names is None:
            return
        names[0] = names[0].removeprefix("﻿")
        if first > lines.at:
            # the line that the byte before the range is in belongs to the range before, if it begins there
            lines = _Lines(_Buffered(file, first - 1), first - 1)
            next(lines, None)
        while lines.at < end:
            start = lines.at
            record = next(csv.reader(lines if multiline else iter([next(lines, "")])), None)
            if record is None and multiline:
                return
            if record:
                yield names, start, record + [""] * (len(names) - len(record))


class _Buffered:
    """readline over a file of random access."""

    def __init__(self, file: Any, at: int = 0, size: int = 1 << 20) -> None:
        self.file, self.next, self.size, self.held, self.used = file, at, size, b"", 0

    def readline(self) -> bytes:
        parts = []
        while True:
            end = self.held.find(b"\n", self.used)
            if end >= 0:
                parts.append(self.held[self.used : end + 1])
                self.used = end + 1
                return b"".join(parts)
            parts.append(self.held[self.used :])
            self.file.seek(self.next)
            self.held, self.used = self.file.read(self.size), 0
            self.next += len(self.held)
            if not self.held:
                return b"".join(parts)


class CsvFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "millrace_csv"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> DataSourceReader:
        return CsvReader(dict(self.options))


def read_csv(spark: SparkSession, where: str | list[str], *, glob: str = "*.csv", multiline: bool = True, split_bytes: int = 64 << 20) -> DataFrame:
    """The records of files, each with the header of its own. Lets the session push conditions down to sources in Python."""
    spark.dataSource.register(CsvFiles)
    spark.conf.set(PUSHDOWN, "true")
    options = {"paths": json.dumps([where] if isinstance(where, str) else where), "glob": glob, "multiLine": str(multiline), "splitBytes": str(split_bytes)}
    return spark.read.format("millrace_csv").options(**options).load()
