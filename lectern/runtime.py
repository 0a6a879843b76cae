"""Where intermediate tables go, and how lineage is cut.

Everything that is written between stages lies under the folder the cluster names in
``spark.checkpoint.dir``, which all executors share; only in local mode (tests on one machine) may that
setting be missing, and a temporary folder takes its place.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_OPEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of intermediate tables, as a URI."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _LOCAL:
        _LOCAL[key] = tempfile.mkdtemp(prefix="lectern-")
        atexit.register(shutil.rmtree, _LOCAL[key], ignore_errors=True)
    return "file://" + _LOCAL[key]


def new_path(spark: SparkSession, label: str) -> str:
    """A place for a table in the shared folder, removed with the application's other tables."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if not _OPEN:
        atexit.register(_drop_all)
    _OPEN.append((spark, path))
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here.

    The table survives the loss of any executor; ``release`` removes it once nothing reads it any more, and
    what is left goes with the application.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.mode("error").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(*frames: DataFrame) -> None:
    """Remove tables written by ``materialize`` that no result still to be computed reads."""
    for df in frames:
        _delete(df.sparkSession, df._written_to)
        _OPEN[:] = [x for x in _OPEN if x[1] != df._written_to]


def drop_materialized(spark: SparkSession) -> None:
    """Remove all tables of this session that are left: its results must have been read."""
    for _, path in [x for x in _OPEN if x[0] is spark]:
        _delete(spark, path)
    _OPEN[:] = [x for x in _OPEN if x[0] is not spark]


def _drop_all() -> None:
    for spark in {id(x[0]): x[0] for x in _OPEN}.values():
        try:
            drop_materialized(spark)
        except Exception:  # the application has ended before: its folder is the cluster's
            pass


def cores(spark: SparkSession) -> int:
    """Task slots of the session, at least one."""
    return max(1, spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, key: str) -> DataFrame:
    """df on as many tasks as there are slots, where its source has fewer parts (a small file is one part): for work that costs far more than moving the rows."""
    slots = cores(df.sparkSession)
    return df if df.rdd.getNumPartitions() >= slots else df.repartition(slots, key)
