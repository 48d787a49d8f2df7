"""Session helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def sound_unions(spark: SparkSession) -> None:
    """Let unions state no partitioning of their own. Spark 4.1 takes a union of tables that are dealt by one key as dealt by it, and
    leaves out the exchange of an aggregate above it; where adaptive execution then reads these tables by other partitions, groups come
    in pieces: a count of 7,581 rows gave 30,510."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def workers_import(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the driver has it. On a cluster
    the package is installed on, or sent to, the executors."""
    sound_unions(spark)
    root = str(Path(__file__).resolve().parent.parent)
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where that is unset, and the session has no other checkpoint folder, a
    temporary one serves a local master (tests); on a cluster, whose machines share no such folder, it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not (context.master or "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
    return str(context.getCheckpointDir()).rstrip("/")


#: The setting that names the folder of the run that is going on, below the shared one.
RUN = "spark.millrace.run"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, in that of the run if one is going on."""
    run = spark.conf.get(RUN, None)
    return f"{shared_dir(spark)}/{run + '/' if run else ''}{name}-{uuid.uuid4().hex}"


@contextmanager
def run_folder(spark: SparkSession, name: str = "run") -> Iterator[str]:
    """All tables written within go to one folder, which is cleared at the end: results that are lazy read them, so write
    what is to stay before. Yields the folder."""
    before, own = spark.conf.get(RUN, None), f"{name}-{uuid.uuid4().hex}"
    spark.conf.set(RUN, own)
    folder = f"{shared_dir(spark)}/{own}"
    try:
        yield folder
    finally:
        spark.conf.unset(RUN) if before is None else spark.conf.set(RUN, before)
        clear(spark, folder)


def clear(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared store, and all in it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: later jobs neither recompute it nor need
    the executors that made it."""
    sound_unions(df.sparkSession)
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
