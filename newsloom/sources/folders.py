"""Data sources and a sink of our own, through Spark's Python data source interface.

``newsloom_feeds`` reads a folder of fetched XML files, feeds and sitemaps alike, one row for each item; as a stream, files are taken in order of
name, and what has been read is the last name. ``newsloom_samples`` writes training samples as JSON lines in a folder for each
split: tasks write aside, the commit moves all files to their place, an abort removes them, so a failed job leaves nothing half
written. Folders may be of any file system that Arrow opens.

    register(spark)
    spark.read.format("newsloom_feeds").load("file:///fetched")
    samples.write.format("newsloom_samples").mode("append").save("file:///samples")
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from newsloom.sources import web

SCHEMA = "file string, place int, kind string, title string, link string, at timestamp"
#: Files of one partition.
FILES = 64


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _files(path: str) -> list[str]:
    store, root = _open(path)
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(i.path for i in found if i.type == fs.FileType.File and i.base_name.endswith(".xml"))


@dataclass
class Files(InputPartition):
    names: list[str]


def _rows(path: str, names: list[str]) -> Iterator[tuple]:
    """A file that is no feed or sitemap, or can't be parsed, gives no rows."""
    store, _ = _open(path)
    for name in names:
        with store.open_input_stream(name) as f:
            text = f.read().decode("utf-8", "replace")
        base = name.rpartition("/")[2]
        items = [("feed", i["title"], i["link"], i["published"]) for i in web.feed_items(text)]
        items += [(i["kind"], None, i["loc"], i["lastmod"]) for i in web.sitemap_entries(text)]
        for k, item in enumerate(items):
            yield (base, k, *item)


class FeedReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        names = _files(self.path)
        return [Files(names[i : i + FILES]) for i in range(0, len(names), FILES)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return _rows(self.path, partition.names)


class FeedStream(DataSourceStreamReader):
    """Files must come under names that sort after those before."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        return {"after": (_files(self.path) or [""])[-1]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        names = [n for n in _files(self.path) if start["after"] < n <= end["after"]]
        return [Files(names[i : i + FILES]) for i in range(0, len(names), FILES)]

    def read(self, partition: Files) -> Iterator[tuple]:
        return _rows(self.path, partition.names)

    def commit(self, end: dict) -> None:
        pass


class Feeds(DataSource):
    @classmethod
    def name(cls) -> str:
        return "newsloom_feeds"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FeedReader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FeedStream(self.options["path"])


@dataclass
class Written(WriterCommitMessage):
    moves: list[tuple[str, str]]


class SampleWriter(DataSourceWriter):
    def __init__(self, path: str, split: str, overwrite: bool):
        self.path, self.split, self.overwrite, self.job = path, split, overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator) -> WriterCommitMessage:
        store, root = _open(self.path)
        task, files = uuid.uuid4().hex, {}
        aside = f"{root}/_aside-{self.job}"
        try:
            for row in rows:
                r = row.asDict(recursive=True)
                split = str(r.pop(self.split, None) or "none")
                if split not in files:
                    store.create_dir(f"{aside}/{split}", recursive=True)
                    files[split] = store.open_output_stream(f"{aside}/{split}/{task}.json")
                files[split].write(json.dumps(r, ensure_ascii=False, sort_keys=True, default=str).encode() + b"\n")
        finally:
            for f in files.values():
                f.close()
        return Written([(f"{aside}/{s}/{task}.json", f"{root}/{self.split}={s}/{task}.json") for s in files])

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _open(self.path)
        old = [i.path for i in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)) if i.type == fs.FileType.File and "/_aside-" not in i.path] if self.overwrite else []
        for m in messages:
            for a, b in m.moves if m else ():
                store.create_dir(b.rpartition("/")[0], recursive=True)
                store.move(a, b)
        for name in old:
            store.delete_file(name)
        self._clear(store, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_open(self.path))

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        if store.get_file_info(f"{root}/_aside-{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/_aside-{self.job}")


class Samples(DataSource):
    @classmethod
    def name(cls) -> str:
        return "newsloom_samples"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return SampleWriter(self.options["path"], self.options.get("split", "split"), overwrite)


def save_texts(texts: DataFrame, folder: str) -> None:
    """Each text (name, text) as a file of the folder; one that is written again replaces itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        store.create_dir(root, recursive=True)
        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with store.open_output_stream(f"{root}/{name}") as f:
                    f.write((text or "").encode())
            yield b.select(["name"])

    texts.select("name", "text").mapInArrow(run, "name string").write.format("noop").mode("overwrite").save()


def register(spark: SparkSession) -> None:
    for source in (Feeds, Samples):
        spark.dataSource.register(source)
