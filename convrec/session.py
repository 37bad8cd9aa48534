"""Session helpers: building a local session and finding the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "convrec") -> SparkSession:
    """Local session for tests and the bench (a cluster job gets its session from the launcher)."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in _DEFAULTS.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = b.config("spark.driver.memory", os.environ.get("CONVREC_DRIVER_MEMORY", "16g"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared (distributed) folder and is used
    as is; a cluster job without it raises, since a machine-local folder would be lost with
    its executor.  Only a local session (tests, bench) gets a scratch folder of its own.
    The folder is set once; later calls return it.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="convrec-ckpt-")
    sc.setCheckpointDir(d)
    return sc._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str = "staged") -> DataFrame:
    """``df`` written as Parquet in the shared checkpoint folder and read back: lineage is cut, a
    lost executor costs nothing, and the size that the optimizer sees is that of the files.  (A
    checkpointed frame keeps the estimate of the plan that made it; a join multiplies the
    estimates of its sides, so the state of a loop would carry numbers that grow with every
    round.)"""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Generations:
    """The state of a loop as written tables.  ``put(name, df)`` writes the next table of that name
    and reads it back; ``sweep()``, called when a round's tables all stand, deletes those that
    were replaced, so the folder holds the last table of each name.  Frames built on a swept
    table can no longer be read: what outlives a round is put under a name of its own."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = scratch_path(spark, name)
        self.current: dict[str, str] = {}
        self.replaced: list[str] = []
        self.turn = 0

    def put(self, name: str, df: DataFrame) -> DataFrame:
        self.turn += 1
        path = f"{self.root}/{name}-{self.turn}"
        df.write.parquet(path)
        if name in self.current:
            self.replaced.append(self.current[name])
        self.current[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def sweep(self) -> None:
        while self.replaced:
            self._delete(self.replaced.pop())

    def drop(self, name: str) -> None:
        """Delete the table of this name: nothing reads it any more."""
        self._delete(self.current.pop(name))

    def _delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
