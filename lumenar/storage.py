"""Intermediate tables in the folder that the whole cluster shares.

Lineage is cut by writing Parquet under ``spark.checkpoint.dir``. Executors can be
lost at any time; a written table survives that, a local checkpoint would not.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_roots: dict[str, str] = {}
_LOCAL = re.compile(r"local(\[.*\])?")


def shared_root(spark: SparkSession) -> str:
    """The shared folder named by the session. Where none is set, a folder of our own if the driver runs all tasks; on a cluster an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not _LOCAL.fullmatch(spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir names no shared folder, and executors don't see each other's disks")
    app = spark.sparkContext.applicationId
    if app not in _own_roots:
        _own_roots[app] = tempfile.mkdtemp(prefix="lumenar-")
        atexit.register(shutil.rmtree, _own_roots[app], ignore_errors=True)
    return _own_roots[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/lumenar/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of it; the schema is passed on, not inferred."""
    return written_at(df, name, **options)[0]


def written_at(df: DataFrame, name: str, **options: str) -> tuple[DataFrame, str]:
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


class Scratch:
    """Intermediate tables that are removed together, once nothing reads them any more."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        out, path = written_at(df, name, **options)
        self.paths.append(path)
        return out

    def clear(self) -> None:
        remove(self.spark, *self.paths)
        self.paths = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
