"""A data source of Parquet files whose names tell their time span: files beyond a filter's times are never opened.

``read_spanned(spark, folder, "idx long, score double")`` gives the rows of all files under a folder with ``path``, ``t0``, ``stop``, ``shift`` and
``rejected``; without columns it gives a row for each file. The span ``<t0>-<length>`` stands in a file's name or in the nearest folder around it that has one.
Comparisons of ``t0``, ``stop``, ``shift`` and ``rejected`` with values are decided by name, when the folder is listed; Spark keeps all other filters. A file whose name has no span is
rejected: it has one row, of its path alone, and isn't opened.

Folders are listed and files are read through ``pyarrow.fs``, so a folder may be local to all machines or in a store that pyarrow knows.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from driftwatch.sources.segments import SHIFT, SPAN

NAMES = "path string, t0 double, stop double, shift double, rejected boolean"
COMPARE = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


def span_of(path: str) -> dict:
    """What a path tells, with nulls for what it doesn't."""
    for part in reversed(path.split("/")):
        if found := re.search(SPAN, part):
            shift = re.search(SHIFT, part)
            t0 = float(found[1])
            return {"path": path, "t0": t0, "stop": t0 + float(found[2]), "shift": float(shift[1]) if shift else None, "rejected": False}
    return {"path": path, "t0": None, "stop": None, "shift": None, "rejected": True}


class Files(InputPartition):
    """Files that one task reads."""

    def __init__(self, files: list[dict]):
        self.files = files


class SpannedReader(DataSourceReader):
    """Lists a folder, keeps the files that all pushed filters hold for, and reads those."""

    def __init__(self, schema: StructType, options: dict):
        self.schema, self.root, self.most = schema, options["path"], int(options.get("filespertask", 8))
        self.data = [f.name for f in schema.fields[len(NAMES.split(",")) :]]
        self.pushed: list[tuple[str, Filter]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        told = {"t0", "stop", "shift", "rejected"}
        for one in filters:
            if len(one.attribute) == 1 and one.attribute[0] in told and (type(one) in COMPARE or isinstance(one, IsNotNull)):
                self.pushed.append((one.attribute[0], one))
            else:
                yield one

    def holds(self, file: dict) -> bool:
        """Whether all pushed filters hold; a comparison with null doesn't."""
        return all(file[name] is not None and (isinstance(one, IsNotNull) or COMPARE[type(one)](file[name], one.value)) for name, one in self.pushed)

    def partitions(self) -> Sequence[InputPartition]:
        where, root = fs.FileSystem.from_uri(self.root)
        found = where.get_file_info(fs.FileSelector(root, recursive=True))
        hidden = lambda path: any(x.startswith(("_", ".")) for x in path[len(root) :].split("/") if x)
        files = [span_of(x.path) for x in found if x.type == fs.FileType.File and not hidden(x.path)]
        kept = sorted((f for f in files if self.holds(f)), key=lambda f: f["path"])
        return [Files(kept[i : i + self.most]) for i in range(0, len(kept), self.most)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.schema)
        where, _ = fs.FileSystem.from_uri(self.root)
        for file in partition.files:
            if file["rejected"] or not self.data:
                yield pa.RecordBatch.from_pylist([file], schema)
                continue
            with where.open_input_file(file["path"]) as source:
                for rows in pq.ParquetFile(source).iter_batches(columns=self.data):
                    fixed = [pa.array([file[n]], schema.field(n).type).take(pa.array([0] * rows.num_rows, pa.int32())) for n in schema.names[: -len(self.data)]]
                    yield pa.RecordBatch.from_arrays([*fixed, *(rows.column(n).cast(schema.field(n).type) for n in self.data)], schema=schema)


class SpannedFiles(DataSource):
    """Parquet files with their span in their names."""

    @classmethod
    def name(cls) -> str:
        return "spanned_files"

    def schema(self) -> str:
        return NAMES + (f", {self.options['columns']}" if self.options.get("columns") else "")

    def reader(self, schema: StructType) -> DataSourceReader:
        return SpannedReader(schema, self.options)


def read_spanned(spark: SparkSession, path: str, columns: str = "", files_per_task: int = 8) -> DataFrame:
    """The rows of all spanned files under an absolute path, or the files; filters on spans are decided before a file is opened."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SpannedFiles)
    return spark.read.format("spanned_files").options(path=path, columns=columns, filesPerTask=files_per_task).load()
