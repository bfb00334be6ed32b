"""A folder with one text file per (model, name) as a Spark data source: read split by files, written in tasks, committed at once.

    spark.dataSource.register(TextFolder)
    df.write.format("text_folder").option("path", p).option("naming", "prefix").mode("overwrite").save()
    spark.read.format("text_folder").option("path", p).load()   # dir, model, name, text

File names are ``<model>_<name>.txt`` (``naming=prefix``) or ``<name>_<model>.txt`` (``suffix``), with both parts percent-encoded so that
any string is a name; ``_`` in a model is encoded too, so the parts come apart again. A NULL text is an empty file with the ending ``.null``: it
isn't mistaken for an empty text or the word ``nan``. Paths are local or any that pyarrow's file systems open
(``file:``, ``hdfs:``, ``s3:``, ``gs:``); driver and executors must see the same.

Tasks write into a staging folder of their own attempt. The commit moves each successful task's folder into place; readers skip names that begin
with ``_``, so a failed task or job leaves nothing that is read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from typing import Iterator, Sequence
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

TEXT, NULL = ".txt", ".null"


def file_stem(model: str, name: str, naming: str = "prefix") -> str:
    """The file name of (model, name) without its ending."""
    m = quote(model, safe="").replace("_", "%5F").replace(".", "%2E").replace("~", "%7E")
    n = quote(name, safe="").replace(".", "%2E").replace("~", "%7E")
    return f"{m}_{n}" if naming == "prefix" else f"{n}_{m}"


def split_stem(stem: str, naming: str = "prefix") -> tuple[str, str]:
    """(model, name) of a file name; one without ``_`` has the empty model."""
    if "_" not in stem:
        return "", unquote(stem)
    m, n = stem.split("_", 1) if naming == "prefix" else stem.rsplit("_", 1)[::-1]
    return unquote(m), unquote(n)


def opened(path: str):
    """The file system of a path and the path in it."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), path


@dataclass
class Files(InputPartition):
    paths: tuple


@dataclass
class Written(WriterCommitMessage):
    folder: str
    part: int


class TextFolderReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        # several folders are given as a list in the option `paths`, one a line
        self.paths = [p for p in (options.get("paths") or options.get("path", "")).split("\n") if p]
        self.naming = options.get("naming", "prefix")
        self.bytes = int(options.get("splitbytes", options.get("splitBytes", 8 << 20)))

    def files(self) -> list[tuple[str, str, int]]:
        """(folder as given, path, size) of all files, in the order of folders and names."""
        from pyarrow import fs

        out = []
        for folder in self.paths:
            system, root = opened(folder.rstrip("/"))
            for f in system.get_file_info(fs.FileSelector(root, recursive=True)):
                inside = f.path[len(root):].strip("/").split("/")
                if f.type == fs.FileType.File and f.base_name.endswith((TEXT, NULL)) and not any(p.startswith(("_", ".")) for p in inside[:-1]):
                    out.append((folder, f.path, f.size))
        return sorted(out)

    def partitions(self) -> Sequence[InputPartition]:
        """Files in groups of about ``splitBytes`` bytes; opening a file counts as 4 KB."""
        groups, size = [[]], 0
        for folder, path, n in self.files():
            if groups[-1] and size + n + 4096 > self.bytes:
                groups.append([])
                size = 0
            groups[-1].append((folder, path))
            size += n + 4096
        return [Files(tuple(g)) for g in groups]

    def read(self, partition: Files) -> Iterator[tuple]:
        systems: dict = {}
        for folder, path in partition.paths:
            if folder not in systems:
                systems[folder] = opened(folder)[0]
            base = path.rsplit("/", 1)[-1]
            stem, ending = base.rsplit(".", 1)
            model, name = split_stem(stem, self.naming)
            text = None
            if f".{ending}" == TEXT:
                with systems[folder].open_input_stream(path) as f:
                    text = f.read().decode("utf-8")
            yield folder, model, name, text


class TextFolderWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool, columns: list[str]) -> None:
        missing = [c for c in ("model", "name", "text") if c not in columns]
        if missing:
            raise ValueError(f"missing column(s) {missing}")
        self.path, self.naming, self.overwrite, self.job = options["path"].rstrip("/"), options.get("naming", "prefix"), overwrite, uuid.uuid4().hex

    @property
    def staging(self) -> str:
        return f"{opened(self.path)[1]}/_staging-{self.job}"

    def write(self, iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, folder = opened(self.path)[0], f"{self.staging}/{task.partitionId()}-{task.taskAttemptId()}"
        system.create_dir(folder, recursive=True)
        seen = set()
        for row in iterator:
            if row["model"] is None or row["name"] is None:
                raise ValueError("a text without a model or a name can't be a file")
            stem = file_stem(row["model"], row["name"], self.naming)
            if stem in seen:
                raise ValueError(f"two texts for one file: {stem}")
            seen.add(stem)
            with system.open_output_stream(f"{folder}/{stem}{NULL if row['text'] is None else TEXT}") as f:
                f.write((row["text"] or "").encode("utf-8"))
        return Written(folder, task.partitionId())

    def commit(self, messages: list) -> None:
        """Move the tasks' folders into place: one rename a task."""
        from pyarrow import fs

        system, root = opened(self.path)
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if not f.base_name.startswith("_staging-"):
                    (system.delete_dir if f.type == fs.FileType.Directory else system.delete_file)(f.path)
        for m in messages:
            if m is not None:
                system.move(m.folder, f"{root}/part-{m.part:05d}-{self.job[:12]}")
        system.delete_dir(self.staging)

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        system = opened(self.path)[0]
        if system.get_file_info(self.staging).type != fs.FileType.NotFound:
            system.delete_dir(self.staging)


class TextFolder(DataSource):
    @classmethod
    def name(cls) -> str:
        return "text_folder"

    def schema(self) -> str:
        return "dir string, model string, name string, text string"

    def reader(self, schema) -> DataSourceReader:
        return TextFolderReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return TextFolderWriter(self.options, overwrite, schema.fieldNames())


def register(spark: SparkSession) -> None:
    """Make the format known to a session; its tasks need no installed copy of this package."""
    from shiftkit.session import ship_package

    ship_package(spark)
    spark.dataSource.register(TextFolder)


def write_text_folder(df: DataFrame, path: str, naming: str = "prefix", mode: str = "overwrite") -> None:
    """One file for each row (``model, name, text``); (model, name) is unique. A row without a model or name, or two rows of one file in
    a task, fail the job, and nothing is changed."""
    register(df.sparkSession)
    df.select("model", "name", "text").repartition("model", "name").write.format("text_folder").option("path", path).option("naming", naming).mode(mode).save()


def read_text_folder(spark: SparkSession, paths: str | Sequence[str], naming: str = "prefix") -> DataFrame:
    """The texts of one or several folders as (dir, model, name, text); the folder is part of the key."""
    register(spark)
    paths = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.format("text_folder").option("paths", "\n".join(paths)).option("naming", naming).load()
