"""Tables written to the shared folder, to cut the lineage of iterative operators."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or in local mode one of our own where it is unset."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("folioflow.shared.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        Path("/tmp/checkpoints").mkdir(exist_ok=True)
        own = tempfile.mkdtemp(dir="/tmp/checkpoints")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        where = f"file://{own}"
        spark.conf.set("folioflow.shared.dir", where)
    return where.rstrip("/")


def written(df: DataFrame, by: str | None = None, compression: str = "zstd") -> DataFrame:
    """The same rows, read back from Parquet in the shared folder, in a folder for each value of ``by`` if it is given.

    This cuts lineage: later stages read the files, also after the executors that made them are lost.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    writer = df.write.option("compression", compression)
    (writer.partitionBy(by) if by else writer).parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete every table that ``written`` has written in this process; call it once their readers are done."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)
