"""Helpers shared by the text operators: tables, Arrow mapping, stored intermediate results."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.session import shared_folder, ship

#: Rows turned into Python objects at a time; bounds a worker's memory when texts are long.
SLICE = 256

ARROW = {
    "long": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "string": pa.string(),
    "binary": pa.binary(),
    "array<int>": pa.list_(pa.int32()),
    "array<long>": pa.list_(pa.int64()),
    "array<string>": pa.list_(pa.string()),
}


#: Rows in a batch between Spark and Python, where the session does not say: texts can be long.
BATCH_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """Make Python workers ready: the package on their path, batches small enough for long texts."""
    ship(spark)
    if spark.conf.get(_BATCH) == "10000":  # Spark's own value, so nobody has chosen one
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def schema_of(fields: Sequence[tuple[str, str]]) -> str:
    return ", ".join(f"`{name}` {kind.replace('long', 'bigint')}" for name, kind in fields)


def batch_of(fields: Sequence[tuple[str, str]], columns: Sequence[Sequence]) -> pa.RecordBatch:
    arrays = [pa.array(values, ARROW[kind]) for (_, kind), values in zip(fields, columns, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, [name for name, _ in fields])


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[list[list]]:
    """The columns of each slice of rows as Python lists."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            yield [column.to_pylist() for column in part.columns]


def map_slices(
    frame: DataFrame,
    function: Callable[..., Sequence[Sequence]],
    fields: Sequence[tuple[str, str]],
    rows: int = SLICE,
) -> DataFrame:
    """Call ``function(*column_lists)`` for slices of rows; it returns the output's column lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in slices(batches, rows):
            yield batch_of(fields, function(*columns))

    prepare(frame.sparkSession)
    return frame.mapInArrow(run, schema_of(fields))


def map_rows(
    frame: DataFrame, function: Callable[..., tuple], fields: Sequence[tuple[str, str]], rows: int = SLICE
) -> DataFrame:
    """Call ``function(*values)`` for each row; it returns the output row."""

    def of_slice(*columns):
        out = [function(*row) for row in zip(*columns, strict=True)]
        return list(zip(*out, strict=True)) if out else [[] for _ in fields]

    return map_slices(frame, of_slice, fields, rows)


def store(frame: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write a table to the shared folder and read it back."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def discard(frame: DataFrame) -> None:
    """Delete a table written by ``store`` that nothing reads any more."""
    spark = frame.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folders = {file.rpartition("/")[0] for file in frame.inputFiles()}
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def whole(text: str = "text") -> F.Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))
