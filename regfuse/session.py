"""Session helpers: table access, lineage cuts in the shared folder, checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast after its rows were counted.
BROADCAST_ROWS = 200_000

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder, with all its columns (pruned by Catalyst)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session's ``spark.checkpoint.dir`` names it.

    Where it names none, a temporary folder is used if driver and executors are one process (tests), else this fails."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        conf = spark.sparkContext.getCheckpointDir()
    if not conf:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf = "file://" + tempfile.mkdtemp(prefix="regfuse-")
        spark.sparkContext.setCheckpointDir(conf)
        _written.append((spark, conf))
    return conf.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:
        pass


@atexit.register
def _cleanup() -> None:
    for spark, path in _written:
        _delete(spark, path)


class Cut:
    """A frame written to the shared folder: its lineage ends there and executors may be lost.

    ``df`` reads the written table, ``rows`` is its exact row count and ``drop()`` deletes it as soon as
    nothing reads it any more."""

    def __init__(self, df: DataFrame, name: str = "cut"):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/regfuse-{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(self.path)
        _written.append((self.spark, self.path))
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        self._rows: int | None = None

    @property
    def rows(self) -> int:
        if self._rows is None:
            self._rows = self.df.count()
        return self._rows

    def drop(self) -> None:
        _delete(self.spark, self.path)
        if (self.spark, self.path) in _written:
            _written.remove((self.spark, self.path))


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """``df`` written to the shared folder and read again."""
    return Cut(df, name).df


def maybe_broadcast(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` are at most ``most``; else unchanged (a shuffled join)."""
    return F.broadcast(df) if rows <= most else df
