"""Written intermediate tables: the way this library cuts lineage.

A staged table lives in the shared folder the cluster names in ``spark.checkpoint.dir``, so a lost executor
costs a re-read and never a recomputation. Only a local session without that setting gets a folder of its own, for as long as the process runs.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def stage_root(spark: SparkSession) -> str:
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root:
        return root
    if sc.master != "local" and not sc.master.startswith("local["):  # executors of a local cluster are processes of their own
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    root = tempfile.mkdtemp(prefix="siftwatch-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    sc.setCheckpointDir(root)
    return root


_scopes: list[str] = []


@contextmanager
def stage_scope(spark: SparkSession):
    """Tables staged inside the block are deleted when it ends: run and write the outputs inside.

    ``with stage_scope(spark): save(run(...), folder, run_id)``
    """
    folder = f"{stage_root(spark)}/scope-{uuid.uuid4().hex}"
    _scopes.append(folder)
    try:
        yield folder
    finally:
        _scopes.remove(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage_path(spark: SparkSession) -> str:
    return f"{_scopes[-1] if _scopes else stage_root(spark)}/stage-{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet under the stage root and return a scan of it."""
    spark = df.sparkSession
    path = stage_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
