"""Session settings and the shared scratch place for lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", memory: str = "8g", name: str = "duologue") -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once for a Spark application; they need no path of the driver's."""
    context = spark.sparkContext
    if getattr(context, "_duologue_shipped", False):
        return
    root = Path(__file__).resolve().parent
    if root.parent.suffix != ".zip":  # else it came as a shipped file itself
        made = os.path.join(tempfile.mkdtemp(prefix="duologue-"), "duologue.zip")
        with zipfile.ZipFile(made, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        context.addPyFile(made)
    context._duologue_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset and the master is local
    a temporary folder is made and kept for the life of the session; elsewhere a missing setting is an error.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf
    made = spark.conf.get("duologue.scratch.dir", None)
    if made is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        made = tempfile.mkdtemp(prefix="duologue-")
        spark.conf.set("duologue.scratch.dir", made)
    return made


def fresh_path(spark: SparkSession, label: str) -> str:
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def cut(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: iterative jobs keep a short lineage and survive lost executors.

    A written table also has its true size. The plan of a checkpointed frame keeps the size estimate of the
    plan behind it, and in a loop of joins that estimate squares itself every round.
    """
    path = fresh_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Steps:
    """The written steps of one iterative job. A step is read by the next ones only, so those before the last two are deleted."""

    def __init__(self, spark: SparkSession, label: str, keep: int = 2):
        self.spark, self.folder, self.keep = spark, fresh_path(spark, label), keep
        self.paths: list[str] = []

    def write(self, df: DataFrame) -> DataFrame:
        path = os.path.join(self.folder, f"step-{len(self.paths)}")
        df.write.parquet(path)
        self.paths.append(path)
        if len(self.paths) > self.keep:
            self.drop(self.paths[-1 - self.keep])
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
