"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.session import checkpoint_dir, scratch_path

#: A-Z to a-z on UTF-8 bytes; bytes of other characters stay as they are.
LOWER_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: Rows of an Arrow batch that a Python step turns into Python objects at once.
SLICE_ROWS = 256


def quoted(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, **work: Column) -> DataFrame:
    """Every input column inside one struct ``row``, next to the named work
    columns, so that no work column can clash with an input column."""
    return df.select(F.struct(*[quoted(c) for c in df.columns]).alias("row"),
                     *[c.alias(n) for n, c in work.items()])


def unpacked(df: DataFrame, columns: list[str], results: list[str]) -> DataFrame:
    """The input columns out of ``row``, then the results. A result replaces
    an input column of the same name."""
    taken = {r.lower() for r in results}
    return df.select(*[F.col("row").getField(c).alias(c) for c in columns if c.lower() not in taken],
                     *results)


def row_ddl(work: DataFrame) -> str:
    """The type of the column ``row`` as DDL, names quoted."""
    def ddl(t: T.DataType) -> str:
        if isinstance(t, T.StructType):
            return "struct<" + ",".join("`" + f.name.replace("`", "``") + "`:" + ddl(f.dataType) for f in t.fields) + ">"
        if isinstance(t, T.ArrayType):
            return f"array<{ddl(t.elementType)}>"
        if isinstance(t, T.MapType):
            return f"map<{ddl(t.keyType)},{ddl(t.valueType)}>"
        return t.simpleString()
    return ddl(work.schema["row"].dataType)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared checkpoint folder and read back: the work is done
    once, and a lost executor costs a read."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def conf(spark: SparkSession, **settings: str):
    """Session settings (dots written as two underscores) held for a block
    that runs its own jobs."""
    names = {k.replace("__", "."): v for k, v in settings.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def ready(spark: SparkSession) -> None:
    """The shared folder is known and Arrow batches stay small in bytes."""
    checkpoint_dir(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch",
                   str(min(1024, int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")))))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches in short slices, so that only a few rows at a time are
    held as Python objects."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


def signed(values: Iterable[int]) -> np.ndarray:
    """64-bit hashes as Spark longs."""
    return np.fromiter(values, np.uint64).view(np.int64)


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column of one array for each row."""
    ends = np.cumsum([0] + [len(p) for p in parts])
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def held_out(key: Column, folds: int = 5) -> Column:
    """Rows that no label is learned from: crc32 of the key's text, modulo
    ``folds``, is 0. A null key is not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == 0, F.lit(False))
