"""Session and storage helpers shared by all operators."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``root``."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can read: ``spark.checkpoint.dir`` of the session.

    Only where the session names none and all of Spark runs in this process (tests) a temporary folder is made and set;
    on a cluster each executor would write to a disk of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='spark-loomseq-')}"
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage, keeps the result when an executor is lost, and makes ``count()`` a footer read. Joins with it
    sort and merge: its rows may take many times the room of the compressed files, by which a broadcast would be chosen.
    The files go when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomseq/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if not getattr(spark.sparkContext, "_loomseq_cleaned", False):
        spark.sparkContext._loomseq_cleaned = True
        _delete_at_exit(spark, path.rsplit("/", 1)[0])
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path).hint("merge")


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    """Hadoop deletes the folder when the driver's JVM ends."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)


def spread(df: DataFrame, rows: int, per_task: int) -> DataFrame:
    """``df`` in as many even partitions as its work needs, where rows are few bytes but long to compute: ``per_task``
    rows each, but no more partitions than twice the cores as long as those hold under four times as many rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    need = -(-max(1, rows) // per_task)
    return df.repartition(max(1, min(need, 2 * cores), need // 4))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per session, so that tasks can import it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_loomseq_shipped", False):
        return
    home = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="spark-loomseq-")) / "loomseq.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, str(Path("loomseq") / f.relative_to(home)))
    sc.addPyFile(str(target))
    sc._loomseq_shipped = True
