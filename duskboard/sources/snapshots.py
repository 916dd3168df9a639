"""Events in versions: a version is replaced as a whole, by one rename.

Below the store's folder, ``data/write=<id>`` holds the rows of one write in a fixed number of folders, sorted by venue,
and never changes; a version is a small table ``versions/<number>`` that names, for every venue, the write its rows are in. It is written under another
name and renamed when it is complete. A rename never replaces, so of two writers that began from one version the
second fails, and a write that is killed before the rename has changed nothing but left files no version names. The
highest number is the current version. A reader stays with the version it was opened at; older ones are kept until
``forget_before`` drops them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duskboard.operators.keys import bucket

VENUE = "venue_slug"
#: Folders of a write, each with the venues of one hash: as many for a thousand venues as for a million.
FOLDER, FOLDERS = "_folder", 16
_MEMBERS = T.StructType([T.StructField(VENUE, T.StringType()), T.StructField("write", T.StringType())])


class WrittenMeanwhile(RuntimeError):
    """Another writer has made the next version; read it and write again."""


def _files(spark: SparkSession, path: str):
    """Hadoop's view of the store's file system, which can rename without replacing."""
    context = spark._jvm.org.apache.hadoop.fs.FileContext
    return context.getFileContext(spark._jvm.org.apache.hadoop.fs.Path(path).toUri(), spark._jsparkSession.sessionState().newHadoopConf())


def _names(spark: SparkSession, path: str) -> list[str]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = _files(spark, path)
    if not files.util().exists(folder):
        return []
    return [status.getPath().getName() for status in files.util().listStatus(folder)]


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the complete versions, rising."""
    return sorted(int(name) for name in _names(spark, f"{path}/versions") if name.isdigit())


def _members(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(_MEMBERS).parquet(f"{path}/versions/{version:012d}")


def _commit(members: DataFrame, path: str, version: int) -> None:
    """Makes the version of these members, unless there is one of this number."""
    spark = members.sparkSession
    draft = f"{path}/versions/_draft-{uuid.uuid4().hex}"
    members.coalesce(1).write.parquet(draft)  # one row a venue
    jvm = spark._jvm.org.apache.hadoop.fs
    options = spark.sparkContext._gateway.new_array(getattr(jvm, "Options$Rename"), 0)
    try:
        _files(spark, path).rename(jvm.Path(draft), jvm.Path(f"{path}/versions/{version:012d}"), options)
    except Exception as error:
        if version in versions(spark, path):
            raise WrittenMeanwhile(f"version {version} is there already") from error
        raise


def write_events(df: DataFrame, path: str, venues: DataFrame | None = None, base: int | None = None) -> int:
    """Replaces the rows of the venues in ``df`` and gives the new version's number; other venues stay as they are.

    ``venues`` (venue_slug), if given, are the venues to replace: those without rows in ``df`` become empty, and rows of
    others are left out. ``base`` is the version the rows were made from, the current one by default; if there is a newer
    one by the time of the rename, the write fails. A null venue is a venue of its own.

    The rebalance hint groups rows by folder and lets adaptive execution split a folder that is too large for one task
    and merge those that are small.
    """
    spark = df.sparkSession
    if base is None:
        base = (versions(spark, path) or [0])[-1]
    write = uuid.uuid4().hex
    rows = df if venues is None else df.join(venues.select(F.col(VENUE).alias("_v")).distinct(), F.col(VENUE).eqNullSafe(F.col("_v")), "left_semi")
    folder = f"{path}/data/write={write}"
    inner = ["start_date"] if "start_date" in df.columns else []
    placed = rows.withColumn(FOLDER, bucket(VENUE, FOLDERS)).hint("rebalance", FOLDER)
    placed.sortWithinPartitions(FOLDER, VENUE, *inner).write.partitionBy(FOLDER).parquet(folder)
    written = spark.read.schema(_MEMBERS).option("basePath", f"{path}/data").parquet(folder) if _has_rows(spark, folder) else None
    mine = spark.createDataFrame([], _MEMBERS) if written is None else written.select(VENUE, "write").distinct()  # one column of the rows
    replaced = mine.select(VENUE) if venues is None else venues.select(VENUE).distinct()
    if base:
        old = _members(spark, path, base).alias("o")
        kept = old.join(replaced.alias("r"), F.col(f"o.{VENUE}").eqNullSafe(F.col(f"r.{VENUE}")), "left_anti").select("o.*")
        mine = kept.unionByName(mine)
    _commit(mine, path, base + 1)
    return base + 1


def _has_rows(spark: SparkSession, folder: str) -> bool:
    return any(name.startswith(f"{FOLDER}=") for name in _names(spark, folder))


def read_events(spark: SparkSession, path: str, schema: T.StructType, version: int | None = None) -> DataFrame:
    """The rows of a version, the current one by default, in the columns of ``schema``. Later writes do not show.

    Only writes that the version names are listed, and only the venues it takes from each are kept.
    """
    known = versions(spark, path)
    if version is None and not known:
        return spark.createDataFrame([], schema)
    version = known[-1] if version is None else version
    if version not in known:
        raise ValueError(f"no version {version} in {path}")
    members = _members(spark, path, version)
    writes = [r["write"] for r in members.select("write").distinct().collect()]  # as many as writes that still count
    if not writes:
        return spark.createDataFrame([], schema)
    fields = T.StructType([f for f in schema.fields if f.name not in (VENUE, "write")] + _MEMBERS.fields)
    rows = spark.read.schema(fields).option("basePath", f"{path}/data").parquet(*(f"{path}/data/write={w}" for w in writes)).alias("e")
    m = members.alias("m")
    same = F.col(f"e.{VENUE}").eqNullSafe(F.col(f"m.{VENUE}")) & (F.col("e.write") == F.col("m.write"))
    return rows.join(m, same, "left_semi").select(*(f"e.{name}" for name in schema.names))


def gather(spark: SparkSession, path: str, schema: T.StructType) -> int:
    """A new version with the same rows in one write, for a store whose venues are spread over many writes."""
    base = versions(spark, path)[-1]
    return write_events(read_events(spark, path, schema, base), path, _members(spark, path, base).select(VENUE), base)


def forget_before(spark: SparkSession, path: str, version: int) -> list[int]:
    """Drops the versions before ``version`` and all data that no later one names, and gives their numbers. To be run
    when no reader of them and no writer is left."""
    known = versions(spark, path)
    later = [v for v in known if v >= version]
    if not later:
        raise ValueError("some version must stay")
    needed = set()
    for v in later:
        needed |= {r["write"] for r in _members(spark, path, v).select("write").distinct().collect()}
    files, jvm = _files(spark, path), spark._jvm.org.apache.hadoop.fs
    gone = [v for v in known if v < version]
    for v in gone:
        files.delete(jvm.Path(f"{path}/versions/{v:012d}"), True)
    for name in _names(spark, f"{path}/versions"):
        if name.startswith("_draft-"):
            files.delete(jvm.Path(f"{path}/versions/{name}"), True)
    for name in _names(spark, f"{path}/data"):
        if name.removeprefix("write=") not in needed:
            files.delete(jvm.Path(f"{path}/data/{name}"), True)
    return gone
