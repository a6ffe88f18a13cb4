import random
import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tests.test_fixtures import syn, table
from tracewell.operators import detectors as D
from tracewell.operators.folds import FloodState


def plain(rows, window, threshold, ratio):
    """All targets by one loop with no state but lists."""
    queues, acks, out = {}, {}, []
    for r in sorted(rows, key=lambda r: (r["ts"], r["packet_id"])):
        pair = frozenset([(r["src"], r["sport"]), (r["dst"], r["dport"])])
        if "A" in r["flags"]:
            acks[pair] = r["ts"]
            continue
        q = [x for x in queues.get(r["dst"], []) if x[0] >= r["ts"] - window] + [(r["ts"], pair, r["src"])]
        open_ = sum(not (p in acks and acks[p] >= r["ts"] - window) for _, p, _ in q)
        if len(q) >= threshold and open_ / len(q) >= ratio:
            out.append((r["packet_id"], r["dst"], open_, len(q), len({s for _, _, s in q})))
            q = []
        queues[r["dst"]] = q
    return sorted(out)


def traffic(rng, n):
    """Bursts, answered and open, acknowledgements before and long after, ties, silences."""
    rows, t = [], 0.0
    for i in range(n):
        t += rng.choice([0.0, 0.05, 0.05, 0.1, 0.4, 1.0]) if rng.random() < 0.98 else rng.choice([4.9, 5.0, 5.1, 30.0])
        src, sport, dst = f"s{rng.randrange(9)}", 1 + rng.randrange(12), f"d{rng.randrange(3)}"
        one = dict(packet_id=i, ts=round(t, 3), src=src, sport=sport, dst=dst, dport=80, proto="TCP", flags="S")
        kind = rng.random()
        if kind < 0.35:
            one["flags"] = rng.choice(["A", "SA", "RA"])
            if rng.random() < 0.5:
                one |= dict(src=dst, sport=80, dst=src, dport=sport)
        rows.append(one)
    return rows


@pytest.mark.parametrize("seed,threshold,ratio", [(1, 6, 0.8), (2, 10, 0.5), (3, 15, 0.8), (4, 3, 1.0), (5, 8, 0.0)])
def test_spells_lose_no_alert(spark, seed, threshold, ratio):
    rows = traffic(random.Random(seed), 500)
    both = [D.flood_events(table(spark, rows), 5.0, threshold, ratio, direct).orderBy("packet_id").collect() for direct in (0, 1_000_000)]
    assert both[0] == both[1]
    got = sorted((r.packet_id, r.dst, r.half_open_count, r.window_syn_count, r.unique_attackers) for r in both[0])
    assert got == plain(rows, 5.0, threshold, ratio)
    assert got or seed in (3, 4)


def test_the_open_count_is_never_less_than_the_window_has(spark):
    rows = traffic(random.Random(7), 300)
    own = D.flood_packets(table(spark, rows)).select("packet_id", "ts", "src", "target", "pair", "is_ack")
    got = {(r.target, r.ts): r.o for r in D.open_counts(own, 5.0).groupBy("target", "ts").agg(F.max("open").alias("o")).collect()}
    acks, queues, exact = {}, {}, 0
    for r in rows:
        pair = frozenset([(r["src"], r["sport"]), (r["dst"], r["dport"])])
        if "A" in r["flags"]:
            acks[pair] = r["ts"]
            continue
        q = queues.setdefault(r["dst"], [])
        q.append((r["ts"], pair))
        open_ = sum(t >= r["ts"] - 5 and acks.get(p, -1e9) < r["ts"] - 5 for t, p in q)
        assert got[r["dst"], r["ts"]] >= open_
        exact += got[r["dst"], r["ts"]] == open_
    assert exact > 0.8 * len([r for r in rows if r["flags"] == "S"])


def test_a_busy_benign_server_never_reaches_python(spark):
    """Each connection is answered; one other target is flooded."""
    n = 20_000
    opened = spark.range(n).select((3 * F.col("id")).alias("packet_id"), (F.col("id") * 0.002).alias("ts"), F.concat(F.lit("c"), F.col("id") % 500).alias("src"), F.lit("srv").alias("dst"), (1024 + F.col("id") % 60000).cast("int").alias("sport"), F.lit(80).alias("dport"), F.lit("S").alias("flags"))
    answered = opened.select((F.col("packet_id") + 1).alias("packet_id"), (F.col("ts") + 0.001).alias("ts"), F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("dport").alias("sport"), F.col("sport").alias("dport"), F.lit("SA").alias("flags"))
    flood = spark.range(60).select((F.col("id") + 10_000_000).alias("packet_id"), (F.col("id") * 0.01 + 3).alias("ts"), F.lit("evil").alias("src"), F.lit("victim").alias("dst"), (1 + F.col("id")).cast("int").alias("sport"), F.lit(80).alias("dport"), F.lit("S").alias("flags"))
    packets = opened.union(answered).union(flood).withColumn("proto", F.lit("TCP"))
    rows = D.flood_packets(packets).select("packet_id", "ts", "src", "target", "pair", "is_ack")
    assert {r.target for r in D.flood_spells(rows, 5.0, 40, 0.8, 0).collect()} == {"victim"}
    assert [(r.dst, r.half_open_count) for r in D.flood_events(packets, direct=0).collect()] == [("victim", 40)]


def test_a_row_costs_the_same_in_a_window_of_any_size():
    def seconds(n):
        state, start = FloodState(5.0, 40, 0.8), time.perf_counter()
        for i in range(n):
            state.step(SimpleNamespace(ts=i * 4.0 / n, pair=i, src="s", packet_id=i, target="t", is_ack=False) if i % 2 else SimpleNamespace(ts=i * 4.0 / n, pair=i + 1, is_ack=True))
        return time.perf_counter() - start

    seconds(2000)
    assert seconds(32_000) < 60 * seconds(2_000) + 0.5  # 256 times as long if it were quadratic


def test_no_rows_and_no_flood(spark):
    assert D.flood_events(table(spark, [syn(0, "a", "b", 1)])).count() == 0
    assert D.flood_events(table(spark, [syn(0, "a", "b", 1)]).limit(0)).count() == 0
