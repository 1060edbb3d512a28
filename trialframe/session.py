"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side that is joined on few keys is shipped to every task up to so many rows; beyond, the join shuffles.
FEW_ROWS = 100_000


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("trialframe")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only in a local session that names none."""
    sc = spark.sparkContext
    configured = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="spark-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows survive the loss of any executor and the lineage stops here."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def few_rows(df: DataFrame) -> bool:
    """Whether a table was counted small enough for every task."""
    return df.limit(FEW_ROWS + 1).count() <= FEW_ROWS


def shipped(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint when it has few rows. A shuffle on a handful of keys would give as many tasks, each with all rows of its key."""
    return F.broadcast(df) if few_rows(df) else df


def fresh_table_path(spark: SparkSession, name: str) -> str:
    """A new path for a written table inside the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
