import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from duskboard.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    # Tiny rows: compiling stages would take longer than running them.
    session = local_session("4", "tests", **{"spark.sql.shuffle.partitions": "3", "spark.sql.codegen.wholeStage": "false"})
    yield session
    session.stop()


@pytest.fixture
def evaluate(spark):
    """Evaluates a column over one-column rows: evaluate(fn, [values]) -> results in order."""

    def run(fn, values, schema="v string"):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")
        return [r[0] for r in df.orderBy("i").select(fn(F.col("v")).alias("out")).collect()]

    return run
