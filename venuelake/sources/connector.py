"""A data source over stored map responses, which takes filters on kinds, tags and boxes into the scan.

``spark.dataSource.register(StoredElements)``, then ``spark.read.format("stored_elements").option("tags", "lang,host")
.load(folder)`` gives kind, id, lat, lon and a column ``tag_<name>`` for each tag asked for. A file has one response or
one element on each line. Files are read by partitions of some megabytes, on any file system that Arrow reaches by its
address. With ``spark.sql.python.filterPushdown.enabled`` equalities, lists and presence of kinds and tags, and bounds of
coordinates are checked while lines are parsed, so that other elements never become rows.

Spark keeps the filters that a query has pushed with the loaded DataFrame, so load anew for each query (``load``).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

#: Bytes of files in one partition.
PARTITION_BYTES = 16 << 20


@dataclass
class Files(InputPartition):
    paths: list[str] = field(default_factory=list)


def _file_system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


class StoredElements(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stored_elements"

    def tags(self) -> list[str]:
        return [t for t in self.options.get("tags", "").split(",") if t]

    def schema(self) -> str:
        return ", ".join(["kind string, id long, lat double, lon double", *[f"tag_{t} string" for t in self.tags()]])

    def reader(self, schema) -> StoredReader:
        return StoredReader(self.options["path"], self.tags())


class StoredReader(DataSourceReader):
    def __init__(self, folder: str, tags: list[str]) -> None:
        self.folder, self.columns = folder, ["kind", "id", "lat", "lon", *[f"tag_{t}" for t in tags]]
        self.pushed: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes what it can check exactly; Spark checks the rest."""
        for f in filters:
            known = isinstance(f, (EqualTo, In, IsNotNull, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and len(f.attribute) == 1 and f.attribute[0] in self.columns
            if known:
                self.pushed.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = _file_system(self.folder)
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        out, size = [Files()], 0
        for f in sorted((f for f in found if f.is_file and not f.base_name.startswith(("_", "."))), key=lambda f: f.path):
            if out[-1].paths and size + f.size > PARTITION_BYTES:
                out.append(Files())
                size = 0
            out[-1].paths.append(f.path)
            size += f.size
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = _file_system(self.folder)
        for path in partition.paths:
            with system.open_input_stream(path) as stream:
                for line in stream.read().decode().splitlines():
                    if line.strip():
                        said = json.loads(line)
                        for element in said["elements"] if "elements" in said else [said]:
                            row = self._row(element)
                            if all(holds(f, row[self.columns.index(f.attribute[0])]) for f in self.pushed):
                                yield row

    def _row(self, e: dict) -> tuple:
        at = e if e.get("lat") is not None else e.get("center") or {}
        tags = e.get("tags") or {}
        return (e.get("type"), e.get("id"), at.get("lat"), at.get("lon"), *[tags.get(c.removeprefix("tag_")) for c in self.columns[4:]])


def holds(f: Filter, value: object) -> bool:
    """Whether a pushed filter is true of a value; nothing but presence is ever true of null."""
    if value is None:
        return False
    if isinstance(f, IsNotNull):
        return True
    if isinstance(f, In):
        return value in f.value
    if isinstance(f, EqualTo):
        return value == f.value
    return {
        GreaterThan: lambda: value > f.value, GreaterThanOrEqual: lambda: value >= f.value, LessThan: lambda: value < f.value, LessThanOrEqual: lambda: value <= f.value,
    }[type(f)]()


def load(spark: SparkSession, folder: str, tags: list[str]) -> DataFrame:
    register(spark)
    return spark.read.format("stored_elements").option("tags", ",".join(tags)).load(folder)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StoredElements)
