"""A matrix of vectors as a Python data source: read and written by the tasks, in parts that join by offset.

``spark.dataSource.register(Matrix)``, then ``format("matrix")`` with columns row (long, from 0 without a gap) and vec
(array<float>). A path is a folder on storage that pyarrow reaches: index.json names the parts in order, each with its
first row, and a header. Header and parts, one behind the other, are a .npy file. A plain .npy file is read too.
No row goes through the driver: tasks write parts, a commit writes the index, last and at once, and a write that fails,
or an attempt of a task that isn't the one committed, leaves nothing that an index names. Parts hold rows in order where
the table is sorted and dealt by ranges of row, which ``save`` does.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "row long, vec array<float>"
INDEX = "index.json"
#: Rows that a task reads, and rows of a batch.
TASK_ROWS, BATCH_ROWS = 65_536, 4096


def _storage(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def header(rows: int, dim: int) -> bytes:
    """What stands in front of a .npy file of that shape."""
    import numpy as np

    out = io.BytesIO()
    np.lib.format.write_array_header_1_0(out, {"descr": "<f4", "fortran_order": False, "shape": (rows, dim)})
    return out.getvalue()


@dataclass
class Rows(InputPartition):
    """Rows of one file: its path, the row's bytes from where, and numbers."""

    file: str
    start: int
    first: int
    count: int
    dim: int
    kind: str = "<f4"

    def __post_init__(self) -> None:
        self.value = (self.file, self.first)


@dataclass
class Part(WriterCommitMessage):
    file: str
    first: int
    rows: int
    dim: int


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.step = options["path"], int(options.get("taskrows", TASK_ROWS))

    def partitions(self) -> list[Rows]:
        store, path = _storage(self.path)
        if path.endswith(".npy"):
            import numpy as np

            with store.open_input_file(path) as f:
                version = np.lib.format.read_magic(f)
                shape, fortran, kind = np.lib.format.read_array_header_1_0(f) if version == (1, 0) else np.lib.format.read_array_header_2_0(f)
                start = f.tell()
            if len(shape) != 2 or fortran or kind.str not in ("<f4", "<f8"):
                raise ValueError(f"{path} is no matrix of floats by rows")
            parts = [(self.path, start, 0, shape[0], shape[1], kind.str)]
        else:
            with store.open_input_stream(f"{path}/{INDEX}") as f:
                found = json.loads(f.read())
            parts = [(f"{self.path}/{p['file']}", 0, p["first"], p["rows"], found["dim"], "<f4") for p in found["parts"]]
        size = {"<f4": 4, "<f8": 8}
        return [Rows(file, start + i * dim * size[kind], first + i, min(self.step, n - i), dim, kind) for file, start, first, n, dim, kind in parts for i in range(0, n, self.step)] or [Rows("", 0, 0, 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        import numpy as np

        if not partition.count:
            return
        store, path = _storage(partition.file)
        kind, dim = np.dtype(partition.kind), partition.dim
        with store.open_input_file(path) as f:
            f.seek(partition.start)
            for i in range(0, partition.count, BATCH_ROWS):
                n = min(BATCH_ROWS, partition.count - i)
                values = np.frombuffer(f.read(n * dim * kind.itemsize), kind).astype("<f4")
                ends = np.arange(0, n * dim + 1, dim, dtype=np.int32) if dim else np.zeros(n + 1, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int64) + partition.first + i), pa.ListArray.from_arrays(ends, values)], names=["row", "vec"])


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.job = options["path"], uuid.uuid4().hex
        if not overwrite:
            raise ValueError("a matrix is written whole: mode overwrite")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        import numpy as np

        store, path = _storage(self.path)
        store.create_dir(path, recursive=True)
        file = f"part-{self.job}-{uuid.uuid4().hex}"
        first, rows, dim = -1, 0, -1
        try:
            with store.open_output_stream(f"{path}/{file}") as out:
                for batch in iterator:
                    if not batch.num_rows:
                        continue
                    at, vec = batch["row"].to_numpy(zero_copy_only=False), batch["vec"]
                    first = int(at[0]) if first < 0 else first
                    sizes = np.unique(vec.value_lengths().to_numpy(zero_copy_only=False))
                    dim = int(sizes[0]) if dim < 0 else dim
                    if vec.null_count or len(sizes) != 1 or sizes[0] != dim:
                        raise ValueError("vectors differ in length")
                    if (at != np.arange(first + rows, first + rows + len(at))).any():
                        raise ValueError("rows aren't in order and without a gap")
                    out.write(vec.flatten().to_numpy(zero_copy_only=False).astype("<f4").tobytes())
                    rows += len(at)
        except BaseException:
            store.delete_file(f"{path}/{file}")
            raise
        if not rows:
            store.delete_file(f"{path}/{file}")
        return Part(file, first, rows, dim)

    def _rest(self, keep: set[str]) -> None:
        """Of all parts in the folder those that aren't kept are deleted."""
        from pyarrow import fs

        store, path = _storage(self.path)
        for info in store.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            if info.base_name.startswith("part-") and info.base_name not in keep:
                store.delete_file(info.path)

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m for m in messages if m and m.rows), key=lambda m: m.first)
        done = 0
        for p in parts:
            if p.first != done or p.dim != parts[0].dim:
                self.abort(messages)
                raise ValueError("parts overlap or leave a gap, or their vectors differ in length")
            done += p.rows
        dim = parts[0].dim if parts else 0
        store, path = _storage(self.path)
        store.create_dir(path, recursive=True)
        for name, data in (("header", header(done, dim)), (f".{INDEX}-{self.job}", json.dumps({"rows": done, "dim": dim, "parts": [{"file": p.file, "first": p.first, "rows": p.rows} for p in parts]}).encode())):
            with store.open_output_stream(f"{path}/{name}") as f:
                f.write(data)
        store.move(f"{path}/.{INDEX}-{self.job}", f"{path}/{INDEX}")
        self._rest({p.file for p in parts})

    def abort(self, messages: list[Part | None]) -> None:
        from pyarrow import fs

        store, path = _storage(self.path)
        for info in store.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            if info.base_name.startswith(f"part-{self.job}-"):
                store.delete_file(info.path)


class Matrix(DataSource):
    @classmethod
    def name(cls) -> str:
        return "matrix"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options, overwrite)


def load(spark: SparkSession, path: str, task_rows: int = TASK_ROWS) -> DataFrame:
    spark.dataSource.register(Matrix)
    return spark.read.format("matrix").option("taskRows", task_rows).load(path)


def save(vectors: DataFrame, path: str, parts: int, row: str = "row", vec: str = "vec") -> None:
    """Rows 0 to n - 1 as a matrix of about ``parts`` parts."""
    vectors.sparkSession.dataSource.register(Matrix)
    rows = vectors.selectExpr(f"CAST(`{row}` AS LONG) AS row", f"CAST(`{vec}` AS ARRAY<FLOAT>) AS vec")
    rows.repartitionByRange(parts, "row").sortWithinPartitions("row").write.format("matrix").mode("overwrite").save(path)
