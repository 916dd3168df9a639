"""Rows as one text each, the same in Spark and in SQL, so that queries that write and read tables compare all columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskboard.schemas import ENTITIES

#: Column and type of every entity, from the declared schemas, without a session.
_FIELDS = {name: [tuple(field.split(" ")) for field in ddl.split(", ")] for name, ddl in ENTITIES.items()}


def _known(entity: str, without: set[str]) -> list[tuple[str, bool]]:
    """Columns and whether they are arrays."""
    return [(name, kind.startswith("array")) for name, kind in _FIELDS[entity] if name not in without]


def row_digest(df: DataFrame, entity: str) -> Column:
    """Digest of the entity's columns that the table has."""
    texts = []
    for name, is_array in _known(entity, {n for n, _ in _FIELDS[entity]} - set(df.columns)):
        text = F.array_join(name, ",") if is_array else F.col(name).cast("string")
        texts.append(F.coalesce(text, F.lit("~")))
    return F.md5(F.concat_ws("|", *texts).cast("binary"))


def sql_digest(entity: str, without: tuple[str, ...] = ()) -> str:
    texts = []
    for name, is_array in _known(entity, set(without)):
        text = f"array_to_string({name}, ',')" if is_array else f"CAST({name} AS VARCHAR)"
        texts.append(f"coalesce({text}, '~')")
    return f"md5(concat_ws('|', {', '.join(texts)}))"


#: Where an entity's rows come from, and columns its source does not have.
SOURCES = {
    "city": "f_city", "category": "f_category", "venue": "f_venue", "venue_category": "f_venue_category", "event": "f_event",
    "event_category": "f_event_category", "event_translation": "f_translation", "list": "f_list", "list_venue": "f_list_venue",
}
ABSENT = {"event": ("scraped_at",)}


def digests(tables: dict[str, DataFrame]) -> DataFrame:
    """(entity, digest) of every row of every table."""
    out = None
    for name, df in tables.items():
        one = df.select(F.lit(name).alias("entity"), row_digest(df, name).alias("digest"))
        out = one if out is None else out.unionByName(one)
    return out


def sql_digests(conditions: dict[str, str]) -> str:
    """The same in SQL; each entity with its condition."""
    return " UNION ALL ".join(
        f"SELECT '{name}' AS entity, {sql_digest(name, ABSENT.get(name, ()))} AS digest FROM {SOURCES[name]} WHERE {where}" for name, where in conditions.items())
