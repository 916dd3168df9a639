"""Entity tables and page tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from duskboard.schemas import ENTITIES


def read_entity(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One relational entity, read with its declared schema (no inference pass)."""
    return spark.read.schema(ENTITIES[name]).parquet(f"{root.rstrip('/')}/{name}")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Raw pages ``page_id, url, html`` as delivered by a fetcher."""
    return spark.read.schema("page_id long, url string, html string").parquet(path)
