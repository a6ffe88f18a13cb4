"""Stored tables with replacement by key."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset (tests on one machine), a new temporary one."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: what several steps need is worked out once."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def upsert_latest(old: DataFrame | None, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of both, of equal keys the latest by order; a row of `new` wins a tie."""
    both = new.withColumn("_new", F.lit(1))
    if old is not None:
        both = both.unionByName(old.withColumn("_new", F.lit(0)), allowMissingColumns=True)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("_new")))
    return both.withColumn("_rank", rank).where("_rank = 1").drop("_rank", "_new")


class Table:
    """A Parquet table with one row for each key, in folders by `part`, a column that is the same for equal keys: a write rewrites the folders that it touches."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: str, part: Column):
        self.spark, self.path, self.keys, self.order, self.part = spark, path.rstrip("/"), keys, order, part

    def _rows(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def read(self) -> DataFrame | None:
        rows = self._rows()
        return None if rows is None else rows.drop("part", "version") if self.order == "version" else rows.drop("part")

    def upsert(self, new: DataFrame, version: int | None = None) -> DataFrame | None:
        """Rows of new take the place of those of equal keys that are no later. A write that is repeated changes nothing.

        Where the order is `version`, the last write replaces: version is any number that rises from write to write, by default the microseconds since 1970."""
        if self.order == "version":
            new = new.withColumn("version", F.lit(time.time_ns() // 1000 if version is None else version).cast("long"))
        new = stored(new.withColumn("part", self.part), "upsert")
        touched = [r[0] for r in new.select("part").distinct().collect()]  # days or hash buckets
        old = self._rows()
        old = old.where(F.col("part").isin(touched)) if old is not None else None
        rows = stored(upsert_latest(old, new, self.keys, self.order), "upsert")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(self.path)
        return self.read()


def day(ts: str) -> Column:
    return F.floor(F.col(ts) / 86_400).cast("int")


def alerts_table(spark: SparkSession, path: str) -> Table:
    """An alert's id stands for its packet, so equal ids share a day."""
    return Table(spark, path, ["id"], "ts", day("ts"))


def flows_table(spark: SparkSession, path: str, buckets: int = 64) -> Table:
    """A flow goes on over days, so its folder is a bucket of its key."""
    return Table(spark, path, ["flow_key"], "last_seen_ts", F.pmod(F.xxhash64("flow_key"), F.lit(buckets)).cast("int"))


def minutes_table(spark: SparkSession, path: str) -> Table:
    return Table(spark, path, ["minute_ts"], "version", day("minute_ts"))


def write_alerts(alerts: DataFrame, path: str) -> DataFrame | None:
    return alerts_table(alerts.sparkSession, path).upsert(alerts)


def write_flow_summary(flows: DataFrame, path: str) -> DataFrame | None:
    return flows_table(flows.sparkSession, path).upsert(flows)


def write_minute_stats(minutes: DataFrame, path: str, version: int | None = None) -> DataFrame | None:
    """Counters that are missing or null count as 0; a minute that is written again is replaced."""
    names = [f"{p}_count" for p in ("tcp", "udp", "arp", "other", "alerts")]
    full = minutes.select("*", *[F.lit(0).cast("long").alias(c) for c in names if c not in minutes.columns]).na.fill(0, names)
    return minutes_table(minutes.sparkSession, path).upsert(full, version)
