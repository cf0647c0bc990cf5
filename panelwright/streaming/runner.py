"""Run a streaming query over what has arrived and read its output as a table.

Output goes to one folder per micro-batch, written with overwrite: a batch that
is replayed after a failure replaces its own output and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from panelwright.session import run_path


def file_stream(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    """Parquet files as they arrive below ``path``."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep state in RocksDB; the caller's settings stay as they are."""
    own = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(key, spark.conf.get(key))
    own.conf.set("spark.sql.streaming.stateStore.providerClass",
                 "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return own


def write_batch(out: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return write


def run_available(stream: DataFrame, checkpoint: str, handler: Callable[[DataFrame, int], None],
                  mode: str = "append") -> None:
    """Process everything that has arrived, then stop. The checkpoint remembers the rest."""
    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .foreachBatch(handler).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def run_to_table(stream: DataFrame, label: str, mode: str = "append", keys: Sequence[str] = ()) -> DataFrame:
    """The stream's result as a table.

    ``append``: all rows. ``update``: the newest row of every key.
    ``complete``: the rows of the last micro-batch.
    """
    spark = stream.sparkSession
    root = run_path(spark, label)
    out = f"{root}/out"
    schema = stream.schema
    run_available(stream, f"{root}/checkpoint", write_batch(out), mode)
    rows = spark.read.schema(StructType([*schema.fields, StructField("batch_id", IntegerType())])).parquet(out)
    if mode == "append":
        return rows.drop("batch_id")
    if mode == "complete":
        return rows.filter(F.col("batch_id") == rows.agg(F.max("batch_id")).scalar()).drop("batch_id")
    return newest(rows, keys).drop("batch_id")


def newest(rows: DataFrame, keys: Sequence[str], order: str = "batch_id") -> DataFrame:
    """The row of the largest ``order`` per key, by an aggregate that merges on the map side."""
    rest = [c for c in rows.columns if c not in keys and c != order]
    pick = F.max_by(F.struct(*rest), F.col(order)).alias("r")
    return rows.groupBy(*keys).agg(pick, F.max(order).alias(order)).select(*keys, order, "r.*")
