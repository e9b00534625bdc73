"""Session helpers shared by operators, tests and the bench."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package when PYTHONPATH doesn't name it already."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a folder of our own only where that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="lithoframe-")
        shared_dir.own = at
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at


def checkpointed(df):
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut(df):
    """A small table with its lineage cut by a checkpoint, and without what Spark inferred of it.

    A checkpoint keeps the constraints of its plan, and those of a loop's rounds build on each other, until planning takes
    longer than the work.
    """
    spark, done = df.sparkSession, checkpointed(df)
    return type(df)(spark._jsparkSession.createDataFrame(done._jdf.toJavaRDD(), done._jdf.schema()), spark)


def written(df):
    """df as a table in the shared folder, and a call that deletes it. Columns are read from it faster than from a checkpoint."""
    spark, at = df.sparkSession, f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)

    def drop() -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

    return spark.read.schema(df.schema).parquet(at), drop


def local_session(cores: int | str = 8, **conf: str) -> SparkSession:
    """A local session for tests and the bench."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("lithoframe")
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark
