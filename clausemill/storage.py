"""Where intermediate results live.

A result that is read more than once is written to the folder named by ``spark.checkpoint.dir``, which all
executors share, so losing an executor never loses it. Only where that setting is absent (tests, notebooks on
one machine) a temporary folder of this process is used.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    made = getattr(spark.sparkContext, "_clausemill_dir", None)
    if made is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        made = "file://" + tempfile.mkdtemp(prefix="clausemill-")
        spark.sparkContext._clausemill_dir = made
    return made


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back; cuts the lineage."""
    spark = df.sparkSession
    # a folder for each application, so what a killed driver leaves is told apart from what is in use
    path = f"{shared_dir(spark)}/clausemill-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    back = spark.read.schema(df.schema).parquet(path)
    back._stashed = path
    return back


@contextlib.contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """What is written inside deletes its own shuffle files as soon as it is done, not when the driver next collects
    garbage. A task that still needs them has them made anew."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def drop(df: DataFrame) -> None:
    """Delete a table that :func:`stash` returned, once nothing will read it again."""
    path = getattr(df, "_stashed", None)
    for entry in [e for e in _written if e[1] == path]:
        _written.remove(entry)
        _delete(*entry)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM may be gone at exit
        pass


def sweep() -> None:
    """Delete the intermediate tables of this process; results still reading them must be consumed before."""
    while _written:
        _delete(*_written.pop())


atexit.register(sweep)
