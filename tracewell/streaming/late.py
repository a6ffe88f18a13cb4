"""Late rows kept: a stream is split before any state, so that what state would drop is a table that can be counted, read and put right."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class LateRows:
    """A sink for foreachBatch that writes on-time and late rows apart, under base. A row is late if its ts is more than delay seconds behind the largest ts of the
    batches before. Each batch has folders of its own and overwrites them, so a batch that is tried again after a crash or a restart changes nothing."""

    def __init__(self, base: str, delay: float):
        self.base, self.delay = base.rstrip("/"), delay

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        mark = self._mark(spark, number)
        late = F.lit(False) if mark is None else F.coalesce(F.col("ts") < mark - self.delay, F.lit(False))
        batch.withColumn("late", late).write.mode("overwrite").partitionBy("late").parquet(f"{self.base}/rows/batch={number}")
        held = spark.read.schema(batch.schema).parquet(f"{self.base}/rows/batch={number}").agg(F.max("ts").alias("ts"))
        held.write.mode("overwrite").parquet(f"{self.base}/marks/batch={number}")

    def _mark(self, spark: SparkSession, number: int) -> float | None:
        try:
            marks = spark.read.schema("ts double, batch long").parquet(f"{self.base}/marks")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise
        return marks.where(F.col("batch") < number).agg(F.max("ts")).first()[0]

    def late(self, spark: SparkSession, schema) -> DataFrame:
        """The late rows so far."""
        columns = spark.createDataFrame([], schema).columns
        return spark.read.schema(schema).parquet(f"{self.base}/rows").where("cast(late as string) = 'true'").select(*columns)

    def feed(self, spark: SparkSession, schema) -> DataFrame:
        """The rows that came in time, as a stream for the jobs with state."""
        return spark.readStream.schema(schema).parquet(f"{self.base}/rows/batch=*/late=false")
