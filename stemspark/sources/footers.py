"""What Parquet files tell of themselves: rows, bytes and ranges of row groups from their footers, and moments of columns."""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, NumericType

#: One row a column of a row group. Ranges of numbers (and times, in seconds) in lo and hi, of texts in lo_text and hi_text.
ROW_GROUPS = "path string, row_group int, column string, type string, n_rows long, n_values long, nulls long, bytes long, raw_bytes long, lo double, hi double, lo_text string, hi_text string"


def _opened(path: str) -> pq.ParquetFile:
    """A file of the local disk or of a store that Arrow reads; only its footer is fetched."""
    uri = urlparse(path)
    if uri.scheme in ("", "file"):
        return pq.ParquetFile(unquote(uri.path))
    fs, at = pyarrow.fs.FileSystem.from_uri(path)
    return pq.ParquetFile(fs.open_input_file(at))


def _range(value) -> tuple[float | None, str | None]:
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=value.tzinfo or datetime.UTC).timestamp(), None
    if isinstance(value, datetime.date):
        return float(value.toordinal() - datetime.date(1970, 1, 1).toordinal()) * 86400, None
    if isinstance(value, str | bytes):
        return None, value if isinstance(value, str) else value.hex()
    return (None if value is None else float(value)), None


def _footer_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in ROW_GROUPS.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), *[pa.int64()] * 5, *[pa.float64()] * 2, *[pa.string()] * 2]
    for batch in batches:
        for path in batch.column(0).to_pylist():
            told, rows = _opened(path).metadata, []
            for g in range(told.num_row_groups):
                group = told.row_group(g)
                for c in range(group.num_columns):
                    column = group.column(c)
                    s = column.statistics
                    (lo, lo_text), (hi, hi_text) = (_range(s.min), _range(s.max)) if s is not None and s.has_min_max else ((None, None), (None, None))
                    nulls = s.null_count if s is not None and s.has_null_count else None
                    rows.append((path, g, column.path_in_schema.removesuffix(".list.element"), column.physical_type, group.num_rows, column.num_values, nulls, column.total_compressed_size, column.total_uncompressed_size, lo, hi, lo_text, hi_text))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def row_groups(spark: SparkSession, path: str) -> DataFrame:
    """ROW_GROUPS of every Parquet file under a path, read on executors; pages aren't read. A list's column is its items'."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    return files.select("path").mapInArrow(_footer_task, ROW_GROUPS)


def column_ranges(groups: DataFrame) -> DataFrame:
    """column, n_rows, n_values, nulls, bytes, lo, hi, lo_text, hi_text over all row groups; a range is null where a group
    doesn't tell its own."""
    known = lambda c, f: F.when(F.count_if(F.col("lo").isNull() & F.col("lo_text").isNull() & ~F.col("nulls").eqNullSafe(F.col("n_values"))) == 0, f(c)).alias(c)
    return groups.groupBy("column").agg(*(F.sum(c).alias(c) for c in ("n_rows", "n_values", "nulls", "bytes")), known("lo", F.min), known("hi", F.max), known("lo_text", F.min), known("hi_text", F.max))


def overlapping(groups: DataFrame, box: dict[str, tuple[float, float]]) -> DataFrame:
    """path, row_group, n_rows, needed: whether a row group may hold rows whose columns lie in the box (ends included)."""
    out = F.lit(True)
    for column, (lo, hi) in box.items():
        mine = F.max(F.when(F.col("column") == column, F.coalesce((F.col("lo") <= hi) & (F.col("hi") >= lo), F.lit(True))))
        out = out & F.coalesce(mine, F.lit(True))
    return groups.groupBy("path", "row_group").agg(F.max("n_rows").alias("n_rows"), out.alias("needed"))


def _moment_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number, mean and sum of squared deviations of each column's values, in one task."""
    held: dict[str, tuple[int, float, float]] = {}
    for batch in batches:
        for name, column in zip(batch.schema.names, batch.columns, strict=True):
            values = column.flatten() if pa.types.is_list(column.type) else column
            x = pc.drop_null(values).to_numpy(zero_copy_only=False).astype(float)
            if len(x):
                mean = float(x.mean())
                held[name] = _merged(held.get(name, (0, 0.0, 0.0)), (len(x), mean, float(((x - mean) ** 2).sum())))
    rows = [(name, *m) for name, m in held.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.float64(), pa.float64()))], names=["column", "n", "mean", "m2"])


def _merged(a: tuple[int, float, float], b: tuple[int, float, float]) -> tuple[int, float, float]:
    """The moments of two sets of values together."""
    n, far = a[0] + b[0], b[1] - a[1]
    return (n, a[1] + far * b[0] / n, a[2] + b[2] + far * far * a[0] * b[0] / n) if n else a


def column_moments(df: DataFrame) -> DataFrame:
    """column, n, mean, m2: of each numeric column (of the items of a list) one row a task that read it."""
    item = lambda t: t.elementType if isinstance(t, ArrayType) else t
    numeric = [f.name for f in df.schema if isinstance(item(f.dataType), NumericType)]
    columns = [F.transform(F.col(f"`{n}`"), lambda x: x.cast("double")).alias(n) if isinstance(df.schema[n].dataType, ArrayType) else F.col(f"`{n}`").cast("double").alias(n) for n in numeric]
    return df.select(*columns).mapInArrow(_moment_task, "column string, n long, mean double, m2 double")


def merge_moments(moments: DataFrame) -> DataFrame:
    """column, n, mean, sd (of the population) of rows of column_moments, of one table or of several runs: as many rows a
    column as tasks."""

    def merge(table: pa.Table) -> pa.Table:
        total = (0, 0.0, 0.0)
        for r in table.to_pylist():
            total = _merged(total, (r["n"], r["mean"], r["m2"]))
        n, mean, m2 = total
        return pa.table({"column": table.column("column")[:1], "n": pa.array([n], pa.int64()), "mean": pa.array([mean]), "sd": pa.array([float(np.sqrt(m2 / n))])})

    return moments.groupBy("column").applyInArrow(merge, "column string, n long, mean double, sd double")
