"""Documents as a stream: files that arrive are parsed as a batch would parse them."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def parse_stream(spark: SparkSession, in_dir: str, schema: StructType | str, out_dir: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], available_now: bool = True):
    """Starts a query that reads Parquet files of ``schema`` as they arrive and appends ``transform`` of each batch to ``out_dir``.

    Documents are independent, so the union of the batches' results is the batch result; the checkpoint makes a restart go on
    where it stopped, and each batch writes its own folder anew, so that one that is repeated after a failure isn't there twice.
    """
    source = spark.readStream.schema(schema).parquet(in_dir)

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out_dir}/batch={number}")

    writer = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set, a temporary one is made if the driver is the only machine; a cluster must name one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quire-"))
    return sc.getCheckpointDir()
