"""A sink that writes rows of (file, bytes) as files, byte for byte: no line ends are added and none change."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

# the sink's code goes with its tasks, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass
class Written(WriterCommitMessage):
    files: int


class ExactFiles(DataSource):
    """Rows (file, data) that come in the order of a file's parts; each file is written below `path` at its own name."""

    @classmethod
    def name(cls) -> str:
        return "exact_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return ExactWriter(self.options["path"])


class ExactWriter(DataSourceWriter):
    """A task streams a file to a name of its own and renames it when it's whole, so a task that runs again does no harm."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator) -> Written:
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        now, out, own, n = None, None, "", 0

        def close():
            if out is not None:
                out.close()
                where.move(own, f"{root}/{now}")

        for row in iterator:
            if row.file != now:
                close()
                now, n = row.file, n + 1
                folder = f"{root}/{now}".rsplit("/", 1)[0]
                where.create_dir(folder, recursive=True)
                own = f"{folder}/.{uuid.uuid4().hex}"
                out = where.open_output_stream(own)
            out.write(bytes(row.data))
        close()
        return Written(n)


def write_exact(parts: DataFrame, path: str) -> None:
    """Writes parts (file, line, data binary) as files below a path that all executors share. Leading slashes and steps
    upwards are left out of names, so that nothing is written elsewhere."""
    name = F.array_join(F.filter(F.split("file", "/"), lambda x: ~x.isin("", ".", "..")), "/")
    rows = parts.select(name.alias("file"), "line", "data").repartition("file").sortWithinPartitions("file", "line")
    rows.sparkSession.dataSource.register(ExactFiles)
    rows.select("file", "data").write.format("exact_files").mode("append").option("path", path).save()
