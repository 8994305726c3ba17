"""What a session must offer to the operators: an importable package on the workers,
a shared folder for cutting lineage, and table loading."""

from __future__ import annotations

import gc
import multiprocessing
import os
import tempfile
import uuid
from collections.abc import Callable
from multiprocessing.connection import Connection
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])

#: Rows of an Arrow batch sent to Python; texts may be long, so batches stay small.
ARROW_ROWS = 1000
#: Bytes of a batch; a single longer row makes a batch of its own.
ARROW_BYTES = 16 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package and keeps Arrow batches small.

    On a cluster the package comes with ``--py-files`` or PYTHONPATH; in local mode the workers
    get the path of this checkout."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset and the session is local (tests) does this choose a temporary one."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    own = sc._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    at = tempfile.mkdtemp(prefix="scenespark-")
    sc.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder; a lost executor loses nothing of it."""
    spark = df.sparkSession
    at = shared_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(at)
    return df.checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder made by ``scratch`` that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def tidy(spark: SparkSession) -> None:
    """Lets the driver collect its garbage: Spark then deletes shuffle files and broadcasts that nothing reads any
    more, and the JVM returns what the heap has grown by over many short jobs. Frames in use lose nothing."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def apart(f: Callable, *args):
    """f(*args), computed in a forked process, so that the driver keeps its result only and none of its memory.

    f must not use Spark. Without fork it runs here."""
    if "fork" not in multiprocessing.get_all_start_methods():
        return f(*args)

    def run(to: Connection) -> None:
        gc.disable()  # collecting the parent's handles of JVM objects would talk over its connection
        try:
            to.send((True, f(*args)))
        except Exception as e:
            to.send((False, repr(e)))

    fork = multiprocessing.get_context("fork")
    ours, theirs = fork.Pipe(duplex=False)
    child = fork.Process(target=run, args=(theirs,))
    child.start()
    theirs.close()
    try:
        done, out = ours.recv()
    except EOFError:
        done, out = False, "its process ended early"
    finally:
        ours.close()
        child.join()
    if not done:
        raise RuntimeError(f"{f.__name__}: {out}")
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
