"""Session settings and the checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", app: str = "lectern") -> SparkSession:
    """A session for tests and the bench. On a cluster, pass in your own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the session names in spark.checkpoint.dir.

    Only a local master may fall back to a temporary folder: on a cluster the
    files must outlive the machine that wrote them.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        sc.setCheckpointDir(named)
        return
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="run-"))


def scratch_folder(spark: SparkSession) -> str:
    """A new folder under the checkpoint folder, for tables that are written and read back."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/tables-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to a table in the checkpoint folder and start again from it.

    A table rather than a checkpointed plan: its size is known, so the next join is planned
    on facts, and loops do not carry the size estimates of all earlier rounds along.
    """
    path = scratch_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Jobs that run at once at most.
AT_ONCE = 8


def side_by_side(run: Callable, items: Iterable) -> list:
    """What `run` gives for every item, in order. Their jobs share the cores, so none waits for the last tasks of another one."""
    with ThreadPoolExecutor(max_workers=AT_ONCE) as pool:
        return list(pool.map(run, items))


def bucket_count(spark: SparkSession) -> int:
    """Number of order buckets: as many as shuffle partitions, which are to be set with the size of the data."""
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
