"""What the operators of this subpackage share: durable tables, code shipping, Arrow loops."""

from __future__ import annotations

import io
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Rows that a Python loop handles before it hands an Arrow batch back.
ROWS_OUT = 4096


def fold_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else; ``lower`` alone folds every script."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def folder_of(spark: SparkSession) -> str:
    """The folder that all executors share: the one the cluster names in ``spark.checkpoint.dir``.

    Only a session on one machine may do without; it gets a temporary one.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = tempfile.mkdtemp(prefix="siftline-")
    return _own[context.applicationId]


_own: dict[str, str] = {}
#: Folders of the innermost open scope last.
_scopes: list[list[str]] = []


def _path(spark: SparkSession, folder: str) -> tuple[object, object]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def new_folder(spark: SparkSession, kind: str) -> str:
    """A folder of a new name in the shared one. It goes when its scope ends, or else with the application."""
    folder = f"{folder_of(spark).rstrip('/')}/siftline-{kind}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(folder)
    system, path = _path(spark, folder)
    system.deleteOnExit(path)
    return folder


def exists(spark: SparkSession, folder: str) -> bool:
    system, path = _path(spark, folder)
    return system.exists(path)


def remove(spark: SparkSession, folder: str) -> None:
    system, path = _path(spark, folder)
    system.delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables made ``durable`` inside are deleted, by name, when the block ends."""
    _scopes.append([])
    try:
        yield
    finally:
        for folder in _scopes.pop():
            remove(spark, folder)


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once, written as a table to the shared folder and read from there.

    It outlives executors, and only the columns that are asked for are read again.
    """
    folder = new_folder(df.sparkSession, "table")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    path = Path(tempfile.mkdtemp()) / f"{root.name}-code.zip"
    path.write_bytes(data.getvalue())
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)


def map_rows(df: DataFrame, make: Callable[[], Callable[[Iterator[tuple]], Iterable[tuple]]], schema: str) -> DataFrame:
    """Apply ``make()(rows) -> rows`` to each partition, in Arrow batches of bounded size.

    ``make`` runs once in each task, so that models and caches are built there.
    """
    ship(df.sparkSession)
    names = df.sparkSession.createDataFrame([], schema).schema
    fields = pa.schema([(f.name, _ARROW[f.dataType.simpleString()]) for f in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    yield from zip(*(c.to_pylist() for c in part.columns), strict=True)

        out: list[tuple] = []
        for row in make()(rows()):
            out.append(row)
            if len(out) >= ROWS_OUT:
                yield _batch(out, fields)
                out = []
        if out:
            yield _batch(out, fields)

    return df.mapInArrow(run, schema)


def _batch(rows: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)


_ARROW = {
    "bigint": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "string": pa.string(),
    "boolean": pa.bool_(),
    "binary": pa.binary(),
    "array<int>": pa.list_(pa.int32()),
    "array<bigint>": pa.list_(pa.int64()),
    "array<string>": pa.list_(pa.string()),
}


_kept: dict[str, object] = {}


def once(key: str, make: Callable[[], object]) -> object:
    """What ``make`` gives, made once in each Python worker; only the last key stays."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null: empty), under fixed names, whatever else the table holds."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def whole(docs: DataFrame) -> Column:
    """All columns in one, whatever their names: no name of an operator can clash with theirs."""
    return F.struct(*(F.col(quoted(c)).alias(c) for c in docs.columns))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


#: A group of over a HOT-th of all rows is joined by broadcast; there are fewer than HOT of them.
HOT = 1000


def with_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` joined to ``groups`` (each ``key`` once, ``size``: its rows) without bringing a hot group to one task.

    total: the rows there are. Groups of over a HOT-th of them are broadcast, of a proven number; others are shuffled.
    Both sides are gone through twice and should be durable.
    """
    large = F.col(size) > total // HOT
    hot = groups.filter(large)
    if hot.isEmpty():
        return rows.join(groups, key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups.filter(~large), key)
    return rest.unionByName(rows.join(F.broadcast(hot), key))


def one_of_each(rows: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """The documents of ``rows`` (doc, n, keys): where n is over 1, of each key's documents the one largest by text, then as JSON.

    Documents that are alone under their key aren't aggregated; of the others partial results are.
    """
    again = rows.filter("n > 1")
    order = F.struct(F.coalesce(F.col("doc")[text_col].cast("string"), F.lit("")).alias("t"), F.to_json("doc").alias("j"))
    largest = again.groupBy(*keys).agg(F.max_by("doc", order).alias("doc"))
    return rows.filter("n = 1").select("doc.*").unionByName(largest.select("doc.*"))
