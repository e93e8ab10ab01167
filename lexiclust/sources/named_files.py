"""A sink that names its files itself: one text file for each row, at the path the
row states below the target folder; and a reader of such folders.

Spark's own text sink picks the file names, so a document per file needs a folder
per document.  This writer (Spark's Python data source interface) writes every
text under a temporary name and moves it to its place, so a lost or repeated task
leaves whole files only and a second attempt replaces equal content.  Folders are
made as needed; any file system that pyarrow knows serves as target.

Defined results: null text writes an empty file; a null, absolute or climbing path
fails the job, as do two rows of one path in one partition; an empty table writes
``_SUCCESS`` only.  The reader returns empty files as empty texts (Spark's own file
sources pass over them) and skips names that begin with a dot or an underscore.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition,
                                    WriterCommitMessage)

FORMAT = "named_files"
#: bytes and files of a task of the reader
TASK_BYTES, TASK_FILES = 64 << 20, 10_000


@dataclass
class Written(WriterCommitMessage):
    files: int


def _file_system(target: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(target) if "://" in target else fs.FileSystem.from_uri("file://" + target)


def _target(options) -> str:
    path = options["path"]
    return (path[len("file:"):] if path.startswith("file:/") and not path.startswith("file://") else path).rstrip("/")


class NamedFileWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.target = _target(options)

    def write(self, iterator):
        files, root = _file_system(self.target)
        folders, seen = set(), set()
        for batch in iterator:
            for name, text in zip(batch.column("path"), batch.column("text")):
                name = name.as_py()
                parts = (name or "").split("/")
                if not name or any(p in ("", ".", "..") for p in parts) or name in seen:
                    raise ValueError(f"not a path below the target, or one used twice: {name!r}")
                seen.add(name)
                folder = "/".join([root, *parts[:-1]])
                if folder not in folders:
                    files.create_dir(folder, recursive=True)
                    folders.add(folder)
                draft = f"{folder}/.{uuid.uuid4().hex}.part"
                with files.open_output_stream(draft) as out:
                    out.write((text.as_py() or "").encode("utf-8"))
                files.move(draft, f"{folder}/{parts[-1]}")
        return Written(len(seen))

    def commit(self, messages):
        files, root = _file_system(self.target)
        files.create_dir(root, recursive=True)
        with files.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages):
        """Files that are in place are whole; drafts start with a dot, which readers skip."""


@dataclass
class Files(InputPartition):
    names: list[str]


class NamedFileReader(DataSourceReader):
    def __init__(self, options):
        self.target = _target(options)

    def partitions(self):
        from pyarrow import fs
        files, root = _file_system(self.target)
        parts, names, size = [], [], 0
        for info in sorted(files.get_file_info(fs.FileSelector(root, recursive=True)), key=lambda i: i.path):
            name = info.path[len(root):].lstrip("/")
            if not info.is_file or any(p[0] in "._" for p in name.split("/")):
                continue
            names.append(name)
            size += info.size
            if size >= TASK_BYTES or len(names) == TASK_FILES:
                parts.append(Files(names))
                names, size = [], 0
        return [*parts, Files(names)]

    def read(self, partition):
        files, root = _file_system(self.target)
        for name in partition.names:
            with files.open_input_stream(f"{root}/{name}") as stream:
                yield name, stream.read().decode("utf-8", errors="replace")


class NamedFiles(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return "path string, text string"

    def reader(self, schema):
        return NamedFileReader(self.options)

    def writer(self, schema, overwrite):
        return NamedFileWriter(self.options)


def write_named_files(df: DataFrame, target: str, path_col: str = "path", text_col: str = "text") -> None:
    """Write ``text_col`` of every row to ``<target>/<path_col>``."""
    df.sparkSession.dataSource.register(NamedFiles)
    df.select(F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text")) \
        .write.format(FORMAT).mode("append").save(target)


def read_named_files(spark: SparkSession, target: str) -> DataFrame:
    """``path`` (below ``target``) and ``text`` of every file."""
    spark.dataSource.register(NamedFiles)
    return spark.read.format(FORMAT).load(target)
