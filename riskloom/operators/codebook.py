"""A dictionary of codes that grows over batches: known values keep their code, new ones follow in order of appearance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.operators.encode import first_seen_codes


class CodeBook:
    """A folder with one table per batch that brought new values.

    A batch is written once: a batch that comes again, after a crash or from a replayed stream, adds
    nothing, and one that was not written to its end is written anew. Batches must come in order,
    by one writer, as a stream gives them.
    """

    SCHEMA = "key string, code long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _place(self, batch_id: int) -> str:
        return f"{self.path}/batch={batch_id:012d}"

    def _exists(self, path: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def codes(self, before: int | None = None) -> DataFrame:
        """``(key, code)`` of all batches, or of those before a batch."""
        if not self._exists(self.path):
            return self.spark.createDataFrame([], self.SCHEMA)
        rows = self.spark.read.schema(f"{self.SCHEMA}, batch long").parquet(self.path)
        return (rows if before is None else rows.filter(F.col("batch") < before)).select("key", "code")

    def extend(self, df: DataFrame, batch_id: int, column: str, order: str) -> None:
        """Add the new values of a batch; ``order`` is unique in it. NULL has no code."""
        place = self._place(batch_id)
        if self._exists(f"{place}/_SUCCESS"):
            return
        known = self.codes(before=batch_id)
        values = df.select(F.col(column).cast("string").alias("key"), F.col(order).alias("_o"))
        grown = first_seen_codes(values, "key", "_o", known)
        grown.join(known.select("key"), "key", "left_anti").write.mode("overwrite").parquet(place)

    def follow(self, stream: DataFrame, column: str, order: str, checkpoint: str) -> None:
        """Extend by all that has arrived on a stream, batch by batch, and stop."""
        query = (
            stream.writeStream.foreachBatch(lambda df, n: self.extend(df, n, column, order))
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
