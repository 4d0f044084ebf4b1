"""Tables in the folder that driver and executors share: they end lineage, so later plans stay small and a lost executor costs nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under spark.checkpoint.dir, which driver and executors share.

    Only where that setting is absent and Spark runs in one process (tests, notebooks) a local folder is taken.
    """
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.gettempdir() + "/pulsemap-checkpoints"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes df once as a table in the shared folder and reads it back."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables that saved() wrote; nothing may read them any more."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._saved_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def side_by_side(*work: Callable[[], object]) -> list:
    """Results of functions that start Spark jobs, run at the same time: small jobs of one leave room for those of another."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target

    target = inheritable_thread_target(SparkSession.builder.getOrCreate())
    with ThreadPoolExecutor(len(work)) as pool:
        return [x.result() for x in [pool.submit(target(f)) for f in work]]
