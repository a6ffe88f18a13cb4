import random
import tempfile

import pytest
from pyspark.sql import functions as F

from tracewell.operators.folds import dedup_alerts
from tracewell.plans.queries import gathered
from tracewell.streaming.jobs import stream_dedup

SCHEMA = "id string, ts double, packet_id long, alert_type string, src string, dst string"


def plain(rows, cooldown):
    last, held, out = {}, {}, []
    for r in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        k = r[3:]
        if k in last and r[1] - last[k] < cooldown:
            held[k] = held.get(k, 0) + 1
            continue
        out.append((r[0], held.pop(k, 0)))
        last[k] = r[1]
    return sorted(out)


def storm(seed, n=600):
    """Half of the alerts in one key; ties, gaps of just the cooldown, nulls."""
    rng, t, rows = random.Random(seed), 0.0, []
    for i in range(n):
        t += rng.choice([0.0, 0.25, 0.5, 1.0, 2.5]) if rng.random() < 0.97 else rng.choice([9.75, 10.0, 10.25, 200.0])
        key = ("t", "hot", None) if rng.random() < 0.5 else (rng.choice(["t", "u"]), rng.choice(["a", "b", None]), rng.choice(["x", None]))
        rows.append((f"n{i}", t, rng.choice([i, i // 3]), *key))
    return rows


@pytest.mark.parametrize("hot", [500_000, 20, 0])
def test_pieces_and_pointers_give_what_a_loop_gives(spark, hot):
    rows = storm(hot + 1)
    got = dedup_alerts(spark.createDataFrame(rows, SCHEMA), 10.0, hot)
    assert sorted((r.id, r.suppressed) for r in got.collect()) == plain(rows, 10.0)
    assert dedup_alerts(spark.createDataFrame(rows, SCHEMA).limit(0), 10.0, hot).count() == 0


def test_one_key_that_is_never_silent(spark):
    """100,000 alerts of one key, 20 a second: pointers find the one emitted a minute."""
    n = 100_000
    rows = spark.range(n).select(F.concat(F.lit("n"), "id").alias("id"), (F.col("id") * 0.05).alias("ts"), F.col("id").alias("packet_id"), F.lit("t").alias("alert_type"), F.lit("s").alias("src"), F.lit("d").alias("dst"))
    got = sorted((r.ts, r.suppressed) for r in dedup_alerts(rows, 60.0, 10_000).collect())
    want = plain([(f"n{i}", i * 0.05, i, "t", "s", "d") for i in range(n)], 60.0)
    assert [s for _, s in got] == [s for _, s in sorted(((int(i[1:]) * 0.05, s) for i, s in want))] and len(got) == len(want) > 80


def test_the_count_of_the_suppressed_outlives_a_silence_in_a_stream(spark):
    rows = [("a", 0.0, 1, "t", "s", "d"), ("b", 1.0, 2, "t", "s", "d"), ("c", 2.0, 3, "t", "s", "d"), ("d", 500.0, 4, "t", "s", "d"), ("e", 900.0, 5, "t", "s", "d"), ("end", 9000.0, 6, "end", "s", "d")]
    rows = [(i, 1000 + t, *more) for i, t, *more in rows]  # a stream's first watermark is the epoch
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder = tempfile.mkdtemp()
    for k, part in enumerate((rows[:3], rows[3:5], rows[5:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/k={k}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*").withColumn("event_time", F.timestamp_micros((F.col("ts") * 1e6).cast("long"))).withWatermark("event_time", "1 second")
    got = sorted((r.id, r.suppressed) for r in gathered(stream_dedup(stream)).collect())
    assert got == plain(rows[:5], 60.0) == [("a", 0), ("d", 2), ("e", 0)]
