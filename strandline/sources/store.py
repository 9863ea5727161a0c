"""Persistence of sequences, suffix tables, texts and gram indexes as checked Parquet.

A stored index is a folder with Parquet tables and a manifest of each table's
rows, columns and checksum.  Loading verifies all three.  An index grows by
further tables of a part, whose manifest is written last.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMAT = 2
_MANIFEST = "format int, kind string, part string, folder string, rows long, checksum string, schema string"


class UnsupportedFormat(ValueError):
    """The folder holds no index, or one of another kind or format."""


class BrokenIndex(ValueError):
    """Rows are missing or changed."""


class IncompatibleType(ValueError):
    """Columns or their types differ from what was asked for."""


def checksum(df: DataFrame) -> tuple[int, int]:
    """Rows, and an order-free sum over hashes of all columns (as 64-bit)."""
    n, total = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)"))).first()
    return n, int(total or 0) % (1 << 64)


def save(parts: dict[str, DataFrame], path: str, kind: str, compression: str = "zstd", partition_by: dict[str, list[str]] | None = None) -> None:
    """Writes the parts and then the manifest, which makes the index complete."""
    _write(parts, path, kind, compression, partition_by or {}, "", "errorifexists")


def append(parts: dict[str, DataFrame], path: str, kind: str, compression: str = "zstd") -> None:
    """Adds rows to parts of a stored index of the same kind and columns."""
    known = {r["part"]: r["schema"] for r in _manifest(next(iter(parts.values())).sparkSession, path, kind)}
    for name, df in parts.items():
        if name in known and _types(T.StructType.fromJson(json.loads(known[name]))) != _types(df.schema):
            raise IncompatibleType(f"{name} is {T.StructType.fromJson(json.loads(known[name])).simpleString()}, not {df.schema.simpleString()}")
    _write(parts, path, kind, compression, {}, f"-{uuid.uuid4().hex[:12]}", "append")


def _write(parts: dict[str, DataFrame], path: str, kind: str, compression: str, partition_by: dict[str, list[str]], suffix: str, mode: str) -> None:
    spark = next(iter(parts.values())).sparkSession
    rows = []
    for name, df in parts.items():
        writer = df.write.option("compression", compression)
        if columns := partition_by.get(name):
            writer = writer.partitionBy(*columns)
        folder = name + suffix
        writer.parquet(f"{path}/{folder}")
        n, total = checksum(spark.read.schema(df.schema).parquet(f"{path}/{folder}"))
        rows.append((FORMAT, kind, name, folder, n, str(total), df.schema.json()))
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode(mode).json(f"{path}/manifest.json")


def _types(schema: T.StructType) -> list[tuple[str, T.DataType]]:
    return [(f.name, f.dataType) for f in schema]


def _manifest(spark: SparkSession, path: str, kind: str) -> list:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest.json")
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        raise UnsupportedFormat(f"no index at {path}")
    rows = spark.read.schema(_MANIFEST).json(f"{path}/manifest.json").collect()  # one row a table
    if not rows or any(r["format"] != FORMAT or r["kind"] != kind for r in rows):
        raise UnsupportedFormat(f"{path} holds no {kind} index of format {FORMAT}")
    return rows


def load(spark: SparkSession, path: str, kind: str, verify: bool = True, schemas: dict[str, T.StructType] | None = None) -> dict[str, DataFrame]:
    """The parts by name.  Fails on another kind, other types or damaged rows; errors
    of the store itself, such as of rights or network, are passed on."""
    out: dict[str, DataFrame] = {}
    for r in _manifest(spark, path, kind):
        schema = T.StructType.fromJson(json.loads(r["schema"]))
        wanted = (schemas or {}).get(r["part"])
        if wanted is not None and _types(wanted) != _types(schema):
            raise IncompatibleType(f"{r['part']} is {schema.simpleString()}, not {wanted.simpleString()}")
        df = _table(spark, f"{path}/{r['folder']}", schema, (r["rows"], int(r["checksum"])) if verify else None)
        out[r["part"]] = out[r["part"]].unionByName(df) if r["part"] in out else df
    return out


def _table(spark: SparkSession, path: str, schema: T.StructType, wanted: tuple[int, int] | None) -> DataFrame:
    try:
        df = spark.read.schema(schema).parquet(path)
        found = checksum(df) if wanted else None
    except AnalysisException as e:
        raise BrokenIndex(f"{path} is not there") from e
    except PySparkException as e:
        if "FAILED_READ_FILE" in str(e):
            raise BrokenIndex(f"{path} cannot be read") from e
        raise
    if found != wanted:
        raise BrokenIndex(f"{path} does not match its manifest")
    return df
