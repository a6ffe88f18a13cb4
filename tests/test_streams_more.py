import tempfile

import pytest
from pyspark.sql import functions as F

from tests.test_fixtures import syn, table
from tracewell.operators import reports as R
from tracewell.operators.folds import ClaimState, HoldState, cooldown_state, dedup_alerts
from tracewell.plans.queries import gathered
from tracewell.sources.tables import minutes_table, write_minute_stats
from tracewell.streaming.jobs import run_available, stream_arp_claims, stream_dedup, upsert_sink
from tracewell.streaming.late import LateRows

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_three_late_bursts_are_kept_over_restarts(spark):
    base, schema = tempfile.mkdtemp(), "ts double, packet_id long"
    bursts = [[(1000.0, 1), (1100.0, 2)], [(1030.0, 3), (1050.0, 4), (1200.0, 5)], [(1139.9, 6), (1140.0, 7), (None, 8)], [], [(900.0, 9), (5000.0, 10)], [(4939.0, 11)]]
    rows = LateRows(f"{base}/out", 60.0)
    for k, burst in enumerate(bursts):
        spark.createDataFrame(burst, schema).coalesce(1).write.mode("append").parquet(f"{base}/in/k={k}")
        run_available(spark.readStream.schema(schema).parquet(f"{base}/in/*"), f"{base}/progress", rows, "append")
    late = sorted(r.packet_id for r in rows.late(spark, schema).collect())
    assert late == [3, 6, 9, 11]
    rows(spark.createDataFrame([(1030.0, 3), (1050.0, 4), (1200.0, 5)], schema), 1)  # a batch that is tried again
    assert sorted(r.packet_id for r in rows.late(spark, schema).collect()) == late
    fed = sorted(r.packet_id for r in gathered(rows.feed(spark, schema)).collect())
    assert fed == [1, 2, 4, 5, 7, 8, 10]


def test_the_last_write_of_a_minute_replaces(spark):
    path = tempfile.mkdtemp() + "/minutes"
    minute = lambda n, at=60.0: spark.createDataFrame([(at, n)], "minute_ts double, total_packets long")
    write_minute_stats(minute(9), path)
    assert write_minute_stats(minute(5), path).first().total_packets == 5
    write_minute_stats(minute(7), path, version=3)  # an old write that comes again
    out = write_minute_stats(minute(4, 120.0), path)
    assert {(r.minute_ts, r.total_packets, r.tcp_count) for r in out.collect()} == {(60.0, 5, 0), (120.0, 4, 0)} and "version" not in out.columns
    sink = upsert_sink(minutes_table(spark, path + "2"))
    for batch, n in ((0, 9), (1, 5), (0, 9)):
        sink(minute(n), batch)
    assert minutes_table(spark, path + "2").read().first().total_packets == 5


def test_a_stream_goes_on_where_a_batch_ended(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    schema = "id string, ts double, packet_id long, alert_type string, src string, dst string"
    rows = [(f"n{i}", 1000.0 + 7 * i, i, "t", "s" if i % 3 else None, "d") for i in range(60)]
    whole = spark.createDataFrame(rows, schema)
    for cut in (1, 25, 59):
        first, second = whole.where(F.col("packet_id") < cut), whole.where(F.col("packet_id") >= cut)
        path = tempfile.mkdtemp() + "/in"
        second.union(spark.createDataFrame([("end", 1e6, -1, "end", "e", "e")], schema)).coalesce(1).write.parquet(path)
        stream = spark.readStream.schema(schema).parquet(path).withColumn("event_time", F.timestamp_micros((F.col("ts") * 1e6).cast("long"))).withWatermark("event_time", "1 second")
        got = {(r.id, r.suppressed) for r in dedup_alerts(first).collect()} | {(r.id, r.suppressed) for r in gathered(stream_dedup(stream, initial=cooldown_state(first))).collect()}
        assert got == {(r.id, r.suppressed) for r in dedup_alerts(whole).collect()}


@pytest.mark.parametrize("forget,holder", [(None, "00:00:00:00:00:01"), (100.0, None)])
def test_an_address_is_forgotten_just_where_asked(spark, forget, holder):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    folder = tempfile.mkdtemp()
    claim = lambda ts, mac: dict(ts=ts, proto="ARP", src="10.0.0.1", dst="x", flags=mac, arp_op=2)
    other = lambda ts: [dict(claim(ts, "00:00:00:00:00:09"), src="10.0.0.9")]
    parts = [[claim(1000.0, "00:00:00:00:00:01")], *[other(t) for t in (90_000.0, 100_000.0, 110_000.0, 120_000.0)], [claim(200_000.0, "00:00:00:00:00:02")], other(900_000.0)]
    for k, part in enumerate(parts):
        table(spark, part).coalesce(1).write.parquet(f"{folder}/in/k={k}")
        if k == 0:
            schema = table(spark, part).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*").withColumn("event_time", F.timestamp_micros((F.col("ts") * 1e6).cast("long"))).withWatermark("event_time", "1 second")
    got = {r.ts: r.original_mac for r in gathered(stream_arp_claims(stream, forget)).collect()}
    assert got[200_000.0] == holder


def test_a_holder_names_addresses_for_alerts_alone():
    from types import SimpleNamespace as Row

    state, out = HoldState(2), []
    for i in range(5):
        out += state.step(Row(claim=True, ip=f"a{i}", packet_id=i, ts=0.0, mac="m", conflict=i == 3))
    assert [x[-2:] for x in out] == [(1, None), (2, None), (3, "a0,a1,a2"), (4, None), (5, "a0,a1,a2,a3,a4")]
    assert ClaimState().step(Row(mac="m", packet_id=1, ts=0, dst="d", arp_op=1, ip="i"))[0][-1] is False


def test_sketches_merge_and_their_error_is_small(spark):
    rows = [syn(60 * (i % 7) + 0.001 * i, f"s{i % 3}", f"d{(i * i) % 4001}", 1 + i % 5) for i in range(9000)]
    p = table(spark, rows)
    sketches = R.target_sketches(p)
    for since, until in ((0.0, 420.0), (60.0, 180.0), (180.0, 180.0)):
        exact = {r.src: r.n for r in p.where((F.col("ts") >= since) & (F.col("ts") < until)).groupBy("src").agg(F.count_distinct("dst", "dport").alias("n")).collect()}
        about = {r.src: r.estimate for r in R.estimated_targets(sketches, since, until).collect()}
        assert about.keys() == exact.keys() and all(abs(about[k] - exact[k]) <= 4 * R.SKETCH_ERROR * exact[k] + 1 for k in exact)
        least = sorted(exact.values())[1] if exact else 5
        assert {(r.src, r.targets) for r in R.wide_sources(p, sketches, since, until, least).collect()} == {(k, n) for k, n in exact.items() if n >= least}
