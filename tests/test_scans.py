import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import scans as S


def make(spark, n, keys=("a", "b", None, "hot", "hot", "hot"), seed=1, span=200.0):
    """Rows with ties in time, gaps, null and hot keys, clashing names."""
    rng = random.Random(seed)
    rows = [(i, float(round(rng.choice([rng.random() * span, rng.randint(0, int(span)), rng.random() * 3]), 3)), rng.choice(keys), rng.choice([1, 2, None]), rng.random() < 0.3) for i in range(n)]
    return rows, spark.createDataFrame(rows, "packet_id long, ts double, key string, v int, mark boolean").selectExpr("*", "7 as b")


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        out.setdefault(r[2], []).append(r)
    return out


@pytest.mark.parametrize("width", [0.5, 10.0, 1000.0])
def test_totals_and_neighbours(spark, width):
    rows, df = make(spark, 400)
    total, before, after = {}, {}, {}
    for own in by_key(rows).values():
        s = 0
        for i, r in enumerate(own):
            s += r[3] or 0
            total[r[0]], before[r[0]], after[r[0]] = s, own[i - 1][3] if i else None, own[i + 1][3] if i + 1 < len(own) else None
    got = S.running_total(df, ["key"], F.coalesce("v", F.lit(0)), "t", width)
    assert {r.packet_id: r.t for r in got.collect()} == total and set(got.columns) == {*df.columns, "t"}
    assert {r.packet_id: r.x for r in S.neighbour(df, ["key"], F.col("v"), "x", width).collect()} == before
    assert {r.packet_id: r.x for r in S.neighbour(df, ["key"], F.col("v"), "x", width, after=True).collect()} == after
    assert S.running_total(df.limit(0), ["key"], F.lit(1), "t").count() == 0


@pytest.mark.parametrize("window", [0.7, 5.0, 500.0])
def test_recent_counts_and_rows_around(spark, window):
    rows, df = make(spark, 300, seed=2)
    count, prior, after = {}, {}, {}
    for own in by_key(rows).values():
        for r in own:
            count[r[0]] = sum(r[1] - window <= q[1] <= r[1] for q in own)
            if not r[4]:
                p = max(((q[1], q[0]) for q in own if q[4] and (q[1], q[0]) < (r[1], r[0]) and q[1] >= r[1] - window), default=None)
                n = min(((q[1], q[0]) for q in own if q[4] and (q[1], q[0]) > (r[1], r[0]) and q[1] <= r[1] + window), default=None)
                prior[r[0]], after[r[0]] = p, n
    assert {r.packet_id: r.n for r in S.recent_count(df, ["key"], window, "n").collect()} == count
    got = S.around(df, ["key"], F.col("mark"), window).collect()
    assert {r.packet_id: r.prior and tuple(r.prior) for r in got} == prior and {r.packet_id: r.next and tuple(r.next) for r in got} == after
    assert {r.packet_id: r.prior and tuple(r.prior) for r in S.around(df, ["key"], F.col("mark"), window, after=False).collect()} == prior


@pytest.mark.parametrize("width", [1.0, 60.0])
def test_a_rate_composed_of_buckets_is_the_rate_of_a_loop(spark, width):
    rows, df = make(spark, 500, seed=3)
    want = {}
    for k, own in by_key(rows).items():
        rate = 1.0
        for a, b in zip(own, own[1:]):
            rate = 0.2 / max(0.001, b[1] - a[1]) + 0.8 * rate
        if len(own) > 1 and k is not None:
            want[k] = rate
    got = {r.key: r.rate for r in S.moving_rate(df.where("key is not null"), "key", 0.2, width).collect()}
    assert got == pytest.approx(want, rel=1e-9)


def test_dyadic_nodes_cover_an_interval_once(spark):
    pairs = [(lo, hi) for lo in range(0, 18) for hi in range(lo, 18)]
    df = spark.createDataFrame(pairs, "lo long, hi long").withColumn("nodes", S._nodes(F.col("lo"), F.col("hi"), 5))
    for r in df.collect():
        covered = [x for n in r.nodes for x in range(n.node << n.level, (n.node + 1) << n.level)]
        assert sorted(covered) == list(range(r.lo, r.hi + 1)), r
        assert len(r.nodes) <= 10


@pytest.mark.parametrize("width", [0.5, 20.0])
def test_points_meet_the_runs_that_cover_them(spark, width):
    rng = random.Random(5)
    runs = []
    for i in range(150):
        a = (round(rng.random() * 100, 2), rng.randrange(1000))
        b = (a[0] + rng.choice([0, 0.01, 3, 40, 500]), rng.randrange(1000))
        runs.append((rng.choice(["x", "hot", None]), i, a, rng.choice([None, b]) if rng.random() < 0.3 else b))
    points = [(rng.choice(["x", "hot", None]), 5000 + i, round(rng.random() * 120, 2)) for i in range(120)]
    place = "struct<ts:double,packet_id:bigint>"
    left = spark.createDataFrame(points, "mac string, packet_id long, ts double")
    right = spark.createDataFrame(runs, f"mac string, ip long, start {place}, end {place}")
    got = sorted((r.packet_id, r.ip) for r in S.stabbed(left, right, ["mac"], width).collect())
    assert got == sorted((p, i) for m, p, t in points for k, i, a, b in runs if m == k and a <= (t, p) and (b is None or (t, p) < b)) != []
    assert S.stabbed(left.limit(0), right, ["mac"]).count() == 0 and S.stabbed(left, right.limit(0), ["mac"]).count() == 0


def test_a_holder_of_many_runs_costs_what_it_returns(spark):
    """100,000 runs of one key, each a second long, and 2,000 points: rows that meet are near those returned, far from 2 * 10**8 pairs."""
    place = F.struct(F.col("id").cast("double").alias("ts"), F.lit(0).cast("long").alias("packet_id"))
    runs = spark.range(100_000).select(F.lit("m").alias("mac"), F.col("id").alias("ip"), place.alias("start"), F.struct((F.col("id") + 1.0).alias("ts"), F.lit(0).cast("long").alias("packet_id")).alias("end"))
    points = spark.range(2_000).select(F.lit("m").alias("mac"), (F.col("id") + 1).alias("packet_id"), (F.col("id") * 50.0).alias("ts"))
    out = S.stabbed(points, runs, ["mac"])
    assert out.count() == 2_000
    met = S.joined  # rows before the exact test
    seen = []
    S.joined = lambda *a, **k: (seen.append(met(*a, **k)), seen[-1])[1]
    try:
        S.stabbed(points, runs, ["mac"])
    finally:
        S.joined = met
    assert seen[-1].count() <= 2_000 * 25


def test_half_of_all_rows_in_one_key_make_no_large_task(spark):
    rows = spark.range(40_000).select(F.col("id").alias("packet_id"), (F.col("id") * 0.05).alias("ts"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("key"))
    for out in (S.running_total(rows, ["key"], F.lit(1), "n"), S.neighbour(rows, ["key"], F.col("ts"), "n"), S.recent_count(rows, ["key"], 5.0, "n")):
        parts = out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert out.count() == 40_000 and parts < 12_000
