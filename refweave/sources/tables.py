"""Table access and lineage cuts shared by all queries."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    A cluster points ``spark.checkpoint.dir`` at shared storage. Only where the
    session names none and all runs in one process, a temporary folder is set.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="refweave-"))
    return sc.getCheckpointDir()


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to a table in the shared folder and go on from there.

    Like an eager checkpoint, but compressed, columnar, with statistics for the
    planner and without the constraints of the plan behind it, whose inference
    takes ever longer in a loop. The table stands for all that was shuffled to
    make it, so that those files are deleted as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._refweave_path = path  # noqa: SLF001
    return kept


def drop(*tables: DataFrame | None) -> None:
    """Delete the tables behind results of ``cut`` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_refweave_path", None)
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)  # noqa: SLF001


def parallelism(df: DataFrame) -> int:
    """The session's number of shuffle partitions, as an int."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
