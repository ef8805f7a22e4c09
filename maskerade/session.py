"""What jobs need of the session: the package on executors, bounded batches, saved cut points."""

from __future__ import annotations

import atexit
import pathlib
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Python gets batches of at most so many bytes: rows are documents, of any length.
BATCH, MOST = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"
_shipped: set[str] = set()


def bytes_of(size: str) -> int:
    """Bytes of a size such as 64m."""
    number = size.lower().rstrip("bkmgt")
    return int(number) << {"k": 10, "m": 20, "g": 30, "t": 40}.get(size.lower()[len(number) : len(number) + 1], 0)


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once an application; Spark's file server delivers it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = pathlib.Path(__file__).resolve().parent
    tmp = tempfile.mkdtemp(prefix=here.name)  # the file server reads it for as long as the application runs
    atexit.register(shutil.rmtree, tmp, ignore_errors=True)
    shutil.copytree(here, f"{tmp}/in/{here.name}", ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(f"{tmp}/{here.name}", "zip", f"{tmp}/in"))
    _shipped.add(sc.applicationId)
    if bytes_of(spark.conf.get(BATCH, "64m")) > bytes_of(MOST):
        spark.conf.set(BATCH, MOST)


def pin(df: DataFrame) -> DataFrame:
    """Writes the rows to the cluster's checkpoint folder and continues from there.

    It cuts lineage, survives lost executors, and what two consumers share is computed once. The folder is
    ``spark.checkpoint.dir``; only where it is unset (tests on one machine) a temporary one is set.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoint"))
    return df.checkpoint(eager=True)
