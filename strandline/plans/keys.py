"""Keys that tell rows apart whose ids are null or repeated.

A keyed table has in place of its id the struct ``(row, id)`` of a row number and
that id: never null, never repeated, equal only for the same row.  Windows, groups
and joins by the id then hold for rows; :func:`unkeyed` puts the id back.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandline.plans.tables import write_table

TEXT = ("text",)


def is_keyed(df: DataFrame, key: str = "doc_id") -> bool:
    kind = df.schema[key].dataType
    return isinstance(kind, StructType) and kind.names == ["row", "id"]


def keyed(df: DataFrame, key: str = "doc_id", columns: tuple[str, ...] = TEXT) -> DataFrame:
    """The key and the given columns; written, so that row numbers stay as they are."""
    if is_keyed(df, key):
        return df
    row = F.struct(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"))
    return write_table(df.select(row.alias(key), *columns), "keyed")


def unkeyed(df: DataFrame, key: str = "doc_id") -> DataFrame:
    return df.select(*[F.col(f"{key}.id").alias(key) if c == key else F.col(f"`{c}`") for c in df.columns])


def by_row(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For operators on ``docs(doc_id, text)`` that group or join by id: they see a
    keyed table; the caller's ids come back, unless they were keyed already."""

    @wraps(f)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        out = f(keyed(docs), *args, **options)
        return out if is_keyed(docs) else unkeyed(out)

    return run
