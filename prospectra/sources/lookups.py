"""Lookup tables in versions, and joins with them that are broadcast only where their size has been measured."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospectra.functions.text import normalize_phone

#: A table of more bytes than this is joined by a shuffle.
BROADCAST_BYTES = 8 << 20
VERSION = "version"


def write_lookup(table: DataFrame, folder: str, name: str, version: int) -> None:
    """The table as one version of ``name``; a version that is there is replaced, others stay."""
    table.write.mode("overwrite").parquet(f"{folder}/{name}/{VERSION}={version}")


def read_lookup_table(spark: SparkSession, folder: str, name: str, key: str, version: int | None = None, kind: str = "parquet", **options: str) -> DataFrame:
    """The newest version of a lookup table, or the newest not after ``version``: one row a key, without the version column.

    Of rows with one key the first by their columns stays; a null key is left out. Raises an error where no version fits.
    ``kind`` is any file format, with its options (``header`` for CSV).
    """
    every = spark.read.options(**options).option("basePath", f"{folder}/{name}").format(kind).load(f"{folder}/{name}/{VERSION}=*")
    known = every if version is None else every.where(F.col(VERSION) <= version)
    newest = known.agg(F.max(VERSION)).first()[0]
    if newest is None:
        raise ValueError(f"no version of {name} up to {version}")
    rows = every.where(F.col(VERSION) == newest).drop(VERSION).where(F.col(key).isNotNull())
    row = F.struct(*(F.col(f"`{c}`") for c in rows.columns))
    return rows.groupBy(key).agg(F.min(row).alias("row")).select("row.*")


def measured_bytes(table: DataFrame) -> int:
    """Bytes of a table's values as text, an upper bound for short numbers and near the truth for strings."""
    width = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 8 for c in table.columns), F.lit(0))
    return table.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0]


def look_up(rows: DataFrame, table: DataFrame, key: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``rows`` with the columns of the lookup table, nulls where the key isn't in it.

    The table is broadcast if its measured size is within ``limit``; a larger one is joined by a shuffle of both sides.
    """
    return rows.join(F.broadcast(table) if measured_bytes(table) <= limit else table.hint("merge"), key, "left")


def locate_phones(rows: DataFrame, areas: DataFrame, column: str = "phone") -> DataFrame:
    """``rows`` with ``phone_forms`` of a number and the ``state`` and ``city`` of its area code, '' where the code is not known."""
    forms = rows.withColumn("phone_forms", normalize_phone(F.col(column))).withColumn("area_code", F.col("phone_forms.area_code"))
    found = look_up(forms, areas.select("area_code", "state", "city"), "area_code")
    known = lambda c: F.when(F.col("phone_forms").isNotNull(), F.coalesce(c, F.lit("")))
    return found.withColumns({"state": known("state"), "city": known("city")}).drop("area_code")
