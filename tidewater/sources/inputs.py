"""Inputs of whatever kind as one Spark data source: `spark.read.format("utterances")`.

A path's suffix tells what it is: a list (.scp, .txt, .text: a key and the rest, or the rest alone), JSON lines (.jsonl: source and
perhaps key), a JSON array or object (.json), or the input itself (anything else: its name is the key). Folders give their files. Lists
are read in ranges of bytes, each a partition: a line belongs to the range in which it begins. Lines without a key get
the file's name and where they begin, so that a second reading names them alike.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

LISTS, LINES, WHOLE = (".scp", ".txt", ".text"), (".jsonl",), (".json",)


@dataclass
class Range(InputPartition):
    """Bytes of a file."""

    path: str
    begin: int
    stop: int


def _suffix(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name[name.rfind(".") :].lower() if "." in name else ""


def _stem(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[0] or name


def lines_of(data: bytes, offset: int) -> Iterator[tuple[int, str]]:
    """Where each line that is not blank begins, and its text."""
    for line in data.split(b"\n"):
        text = line.decode("utf-8", "replace").strip()
        if text:
            yield offset, text
        offset += len(line) + 1


def _of_json(item: object, name: str) -> tuple[str, str]:
    if isinstance(item, dict):
        return str(item.get("key", name)), str(item["source"])
    return name, str(item)


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        paths = options.get("paths") or options.get("path") or ""
        self.paths = [p for p in paths.split("\n") if p]
        self.split = int(options.get("splitbytes", options.get("splitBytes", 64 << 20)))

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        out = []
        for p in self.paths:
            files, base = fs.FileSystem.from_uri(p) if "://" in p else (fs.LocalFileSystem(), p)
            info = files.get_file_info(base)
            if info.type == fs.FileType.NotFound:
                raise FileNotFoundError(p)
            head = p[: len(p) - len(base)] if "://" in p else ""
            found = [info] if info.type == fs.FileType.File else sorted((f for f in files.get_file_info(fs.FileSelector(base, recursive=True)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)
            for f in found:
                step = self.split if _suffix(f.path) in LISTS + LINES else max(1, f.size)
                out += [Range(head + f.path, k, min(f.size, k + step)) for k in range(0, max(1, f.size), step)]
        return out

    def read(self, part: Range) -> Iterator[tuple[str, str, str]]:
        kind, stem = _suffix(part.path), _stem(part.path)
        if kind not in LISTS + LINES + WHOLE:
            yield stem, part.path, part.path
            return
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(part.path) if "://" in part.path else (fs.LocalFileSystem(), part.path)
        with files.open_input_file(base) as f:
            if kind in WHOLE:
                # a file without a value, as Spark writes for a table without partitions, holds nothing
                got = json.loads(f.read().strip() or b"[]")
                for k, item in enumerate(got if isinstance(got, list) else [got]):
                    yield *_of_json(item, f"{stem}-{k}"), part.path
                return
            begin = part.begin
            if begin:
                # a line that begins before the range belongs to the one before
                f.seek(begin - 1)
                begin += len(self._line(f)) - 1
            if begin >= part.stop:
                return
            f.seek(begin)
            data = f.read(part.stop - begin)
            if not data.endswith(b"\n"):
                data += self._line(f)
        for at, text in lines_of(data, begin):
            name = f"{stem}-{at}"
            if kind in LINES:
                yield *_of_json(json.loads(text), name), part.path
            else:
                key, *rest = text.split(maxsplit=1)
                yield (key, rest[0], part.path) if rest else (name, key, part.path)

    @staticmethod
    def _line(f) -> bytes:
        """What is left of the line at hand, with its end."""
        out = b""
        while more := f.read(1 << 16):
            k = more.find(b"\n")
            if k >= 0:
                return out + more[: k + 1]
            out += more
        return out


class Utterances(DataSource):
    @classmethod
    def name(cls) -> str:
        return "utterances"

    def schema(self) -> str:
        return "key string, source string, file string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(self.options)


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(Utterances)
    return spark


def renamed(spark: SparkSession, folder: str, suffix: str) -> list[str]:
    """The files that Spark wrote to a folder, with another suffix."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    files, out = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), []
    for status in files.listStatus(root):
        path = status.getPath()
        if path.getName().startswith("part-"):
            new = jvm.org.apache.hadoop.fs.Path(root, path.getName().rsplit(".", 1)[0] + f".{suffix}")
            files.rename(path, new)
            out.append(new.toString().removeprefix("file:"))
    return out
