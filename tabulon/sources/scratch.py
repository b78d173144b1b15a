"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_WRITTEN: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """A folder under spark.checkpoint.dir; where that is unset, a temporary one on a local master, else an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _LOCAL.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="tabulon-"))
    return f"{base.rstrip('/')}/tabulon-{spark.sparkContext.applicationId}"


def _delete(path: str, spark: SparkSession) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _tidy() -> None:
    for path, spark in _WRITTEN.items():
        try:
            _delete(path, spark)
        except Exception:  # the session may have ended before the interpreter
            return


def persist(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends here, a lost executor costs nothing."""
    spark = df.sparkSession
    root = shared_dir(spark)
    _WRITTEN[root] = spark
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
