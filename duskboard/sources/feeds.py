"""JSON feeds to typed columns.

A feed of a known shape is read with its schema. One whose shape changes, with lists where objects keyed by id were, or
texts per language where there was one, is read as VARIANT by paths that are data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskboard.functions.categories import feed_flag


def parse_feed(df: DataFrame, col: str, schema: str, out: str = "feed") -> DataFrame:
    """A JSON document column to a typed struct, array or map; a broken document becomes null."""
    return df.withColumn(out, F.from_json(col, schema, {"mode": "PERMISSIVE"}))


def feed_entries(df: DataFrame, col: str) -> DataFrame:
    """Entries of a feed keyed by id (``map<string,struct>``), one row each."""
    rest = [c for c in df.columns if c != col]
    return df.select(*rest, F.explode(col).alias("entry_id", "entry"))


class Field(NamedTuple):
    """Where a field stands in an entry: paths tried in order, and what is read there: ``text`` (trimmed, blank is none),
    ``number``, ``flag`` (see :func:`feed_flag`) or ``part`` (an object or list, as VARIANT)."""

    kind: str
    paths: tuple[str, ...]


def localized(path: str, languages: Sequence[str] = ("ca", "es")) -> Field:
    """A text that some feeds give per language and others plainly: the first language that has it."""
    return Field("text", (*(f"{path}.{lang}" for lang in languages), path))


def feed_field(entry: Column, field: Field) -> Column:
    """One field of a VARIANT entry; null where no path has a value of its kind."""

    def scalar(path: str, kind: str) -> Column:
        """An object or a list is no scalar, though VARIANT would print it as one."""
        part = F.try_variant_get(entry, path, "variant")
        return F.when(~F.schema_of_variant(part).rlike("^(OBJECT|ARRAY)"), F.try_variant_get(entry, path, kind))

    if field.kind == "part":
        found = [F.try_variant_get(entry, p, "variant") for p in field.paths]
        return F.coalesce(*(F.when(~F.is_variant_null(v), v) for v in found))
    if field.kind == "text":
        return F.coalesce(*(F.nullif(F.trim(scalar(p, "string")), F.lit("")) for p in field.paths))
    if field.kind == "number":
        return F.coalesce(*(scalar(p, "double") for p in field.paths))
    if field.kind == "flag":
        return feed_flag(F.coalesce(*(scalar(p, "string") for p in field.paths)))
    raise ValueError(f"unknown kind of field: {field.kind}")


def parse_documents(df: DataFrame, col: str, out: str = "document") -> tuple[DataFrame, DataFrame]:
    """Rows whose text is JSON, with it as VARIANT in the text's place; and the other rows as they are, with the ``reason``."""
    parsed = df.withColumn(out, F.try_parse_json(col))
    broken = F.when(F.col(col).isNull(), "no text").otherwise("not JSON")
    good = parsed.filter(F.col(out).isNotNull()).drop(*([col] if col != out else []))
    return good, parsed.filter(F.col(out).isNull()).select(*df.columns, broken.alias("reason"))


def explode_entries(df: DataFrame, col: str, path: str = "$") -> DataFrame:
    """Entries of a list or of an object keyed by id, one row each: ``entry_pos``, ``entry_id`` (null in a list) and
    ``entry``. What is neither, or not there, has none. Nothing is shuffled."""
    part = F.try_variant_get(col, path, "variant")
    whole = F.when(F.schema_of_variant(part).rlike("^(OBJECT|ARRAY)"), part)
    rows = df.withColumn("_whole", whole).filter(F.col("_whole").isNotNull())
    entries = df.sparkSession.tvf.variant_explode(F.col("_whole").outer())
    found = rows.lateralJoin(entries)
    rest = [c for c in df.columns if c != col]
    return found.select(*rest, F.col("pos").alias("entry_pos"), F.col("key").alias("entry_id"), F.col("value").alias("entry"))


def read_fields(df: DataFrame, col: str, fields: Mapping[str, Field]) -> DataFrame:
    """The named fields in place of a VARIANT column."""
    rest = [c for c in df.columns if c != col]
    return df.select(*rest, *(feed_field(F.col(col), f).alias(name) for name, f in fields.items()))
