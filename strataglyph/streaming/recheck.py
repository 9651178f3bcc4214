"""Claims checked again with every batch of a stream of new rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.claims import Claim, Result, run


def recheck(stream: DataFrame, name: str, so_far: DataFrame, claims: list[Claim], tell: Callable[[int, list[Result]], None], checkpoint: str):  # noqa: ANN201
    """Starts a query that appends each micro-batch to the view ``name`` and runs the ledger over it.

    so_far: the rows before the stream. What came by the stream is kept as
    Parquet beside the checkpoint, one folder a batch, so a batch that is
    repeated after a failure replaces itself.
    """
    kept = f"{checkpoint}/rows"

    def each(batch: DataFrame, number: int) -> None:
        spark: SparkSession = so_far.sparkSession  # a stream's batches belong to a session of their own
        batch.write.mode("overwrite").parquet(f"{kept}/batch={number}")
        now = spark.read.schema(batch.schema).parquet(f"{kept}/batch=*")
        so_far.unionByName(now).createOrReplaceTempView(name)
        tell(number, run(spark, claims))

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{checkpoint}/state").trigger(availableNow=True).start()
