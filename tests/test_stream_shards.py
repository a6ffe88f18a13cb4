import random
import tempfile
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_fixtures import syn, table
from tests.test_streams_more import ROCKS
from tracewell.functions.expressions import event_time
from tracewell.operators.detectors import flood_events
from tracewell.operators.flows import aggregate_flows
from tracewell.operators.folds import FloodBuckets, FloodState, sessionize
from tracewell.streaming import jobs as J


class Handle:
    """State as plain dictionaries, and how often it is asked."""

    def __init__(self):
        self.asked, self.timers, self.values = 0, set(), {}

    def _map(self, name):
        d = self.values.setdefault(name, {})

        def count(f):
            def g(*a):
                self.asked += 1
                return f(*a)

            return g

        return SimpleNamespace(
            containsKey=count(d.__contains__), getValue=count(d.__getitem__), updateValue=count(d.__setitem__), removeKey=count(d.pop), keys=count(lambda: iter(list(d))),
            exists=count(lambda: 0 in d), get=count(lambda: d[0]), update=count(lambda v: d.update({0: v})), clear=count(d.clear),
        )

    def getMapState(self, name, *schemas):
        return self._map(name)

    getValueState = getMapState

    def registerTimer(self, at):
        self.asked += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.asked += 1
        self.timers.remove(at)


class Told:
    """Says each of its rows, with its number since the state began, and the end."""

    def __init__(self):
        self.n, self.own = 0, None

    def step(self, row):
        self.n, self.own = self.n + 1, row.k
        return [(row.k, row.packet_id, self.n)]

    def end(self):
        return [(self.own, None, self.n)]


def drive(processor, handle, batches, delay=1.0):
    """What a shard says over these batches of (ts, packet_id, k); the last one's watermark passes all."""
    processor.init(handle)
    said, mark = [], 0
    time = SimpleNamespace(getCurrentWatermarkInMs=lambda: mark)
    for batch in [*batches, []]:
        if batch:
            rows = pd.DataFrame(batch, columns=["ts", "packet_id", "k"]).assign(fold_page=[0 if k is None else len(k) + ord(k[0]) % 5 for _, _, k in batch])
            list(processor.handleInputRows(None, iter([rows[:5], rows[5:]] if len(rows) > 5 else [rows]), time))
            mark = max(mark, int((max(r[0] for r in batch) - delay) * 1000))
        else:
            mark = 10**12
        while due := [t for t in handle.timers if t <= mark]:
            handle.timers -= set(due)
            for out in processor.handleExpiredTimer(None, time, None):
                said += [tuple(None if pd.isna(v) else v for v in r) for r in out.itertuples(index=False, name=None)]
    return said


@pytest.mark.parametrize("chunk", [1, 7, 10_000])
@pytest.mark.parametrize("sort", [True, False])
def test_a_shard_folds_each_key_in_order_over_batches(monkeypatch, chunk, sort):
    monkeypatch.setattr(J, "CHUNK", chunk)
    rng = random.Random(chunk)
    rows = [(1000.0 + rng.randrange(4000) / 8, i, rng.choice(["a", "b", "cc", "ddd", None])) for i in range(400)]
    rows += [(5000.0, 1000 + i, "a") for i in range(20)] + [(1e6, 5000, "end")]
    by_time = sorted(rows)
    batches = [by_time[i : i + 60] for i in range(0, len(rows), 60)] if sort else [rng.sample(rows, len(rows))]
    for b in batches:
        rng.shuffle(b)
    handle = Handle()
    said = drive(J.Sorted(Told, ["k"], ["ts", "packet_id"], ["k", "packet_id", "n"], 300.0), handle, batches)
    for k in ("a", "b", "cc", "ddd", None, "end"):
        assert [p for own, p, _ in said if own == k and p is not None] == [p for _, p, own in by_time if own == k]
    # many batches: the silence after 1500 s ends the states, which begin anew; one batch: the rows after it were there already
    assert sum(n for _, p, n in said if p is None) == len(rows)
    assert not handle.timers and not handle.values["held"] and not handle.values["folds"]


def test_state_is_asked_by_shard_and_not_by_key():
    handle = Handle()
    rows = [(1000.0 + i, i, f"k{i}") for i in range(3000)] + [(1e6, 5000, "end")]
    said = drive(J.Sorted(Told, ["k"], ["ts", "packet_id"], ["k", "packet_id", "n"], 300.0), handle, [rows])
    assert len(said) == 2 * len(rows) and handle.asked < 100


def test_flows_of_many_keys_are_few_rows_of_state(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    folder = tempfile.mkdtemp()
    rows = [syn(1000 + i % 900, f"10.0.{i // 200}.{i % 200}", "d", 80) for i in range(3000)]
    rows += [syn(1000 + 400 * k, "10.9.9.9", "d", 80) for k in range(3)] + [dict(syn(1010, "d", "10.0.0.10", 1), flags="SA", sport=80)]
    whole = table(spark, rows)
    end = table(spark, [syn(1e6, "end", "end", 1)])
    for k, part in enumerate((whole.where("ts < 1400"), whole.where("ts >= 1400"), end)):
        part.coalesce(1).write.parquet(f"{folder}/in/k={k}")
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*").withColumn("event_time", event_time(F.col("ts"))).withWatermark("event_time", "1 second")
    got = []
    q = J.run_available(J.stream_flows(stream), f"{folder}/progress", lambda b, n: got.extend(b.collect()), "append")
    columns = ["flow_key", "start_ts", "last_seen_ts", "total_packets", "total_bytes", "tcp_state"]
    assert sorted(tuple(r[c] for c in columns) for r in got) == sorted(tuple(r) for r in aggregate_flows(sessionize(whole), ("session_no",)).select(*columns).collect())
    # before, a row for each key and second, one for each key's fold and two or three for its timer
    assert max(s.numRowsTotal for p in q.recentProgress for s in p.stateOperators) < 3000


def flood_rows(seed):
    """Openings and acknowledgements of two targets, in bursts and between them."""
    rng, rows, t = random.Random(seed), [], 1000.0
    for burst in range(40):
        t += rng.choice([0.5, 4.0, 5.0, 5.001, 5.002, 9.0, 30.0])
        for _ in range(rng.choice([1, 3, 9, 30])):
            t += rng.choice([0.0, 0.05, 0.125, 0.3])
            n, target = rng.randrange(8), rng.choice(["v", "v", "w"])
            rows.append(syn(t, f"s{n % 4}", target, 80, sport=1000 + n))
            if rng.random() < 0.2 + 0.5 * (burst % 3 == 0):
                rows.append(dict(syn(t + rng.choice([0.0, 0.01, 1.0]), target, f"s{n % 4}", 1000 + n, sport=80), flags="SA"))
    return sorted(rows, key=lambda r: r["ts"])


@pytest.mark.parametrize("seed", [1, 2])
def test_floods_gathered_by_bucket_are_those_of_the_batch(spark, seed):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    folder, rows = tempfile.mkdtemp(), flood_rows(seed)
    whole = table(spark, rows)
    cuts = [0.0, *[rows[len(rows) * k // 4]["ts"] for k in (1, 2, 3)], 1e9]
    parts = [whole.where((F.col("ts") >= a) & (F.col("ts") < b)) for a, b in zip(cuts, cuts[1:])] + [table(spark, [syn(1e9, "end", "end", 1)])]
    for k, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{folder}/in/k={k}")
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*").withColumn("event_time", event_time(F.col("ts"))).withWatermark("event_time", "1 second")
    got = []
    J.run_available(J.stream_syn_flood(stream, 5.0, 6, 0.5), f"{folder}/progress", lambda b, n: got.extend(map(tuple, b.collect())), "append")
    want = sorted(map(tuple, flood_events(whole, 5.0, 6, 0.5).collect()))
    assert len(want) > 5 and sorted(got) == want


@pytest.mark.parametrize("seed", range(20))
def test_a_bucket_without_a_flood_near_is_not_gone_through(seed):
    packets = [r | {"packet_id": k} for k, r in enumerate(flood_rows(seed)) if "v" in (r["src"], r["dst"])]
    row = lambda r: SimpleNamespace(ts=r["ts"], packet_id=r["packet_id"], src=r["src"], pair=min((r["src"], r["sport"]), (r["dst"], r["dport"])) if r["flags"] == "S" else min((r["dst"], r["dport"]), (r["src"], r["sport"])), is_ack="A" in r["flags"], target="v")
    rows, whole = [row(r) for r in packets], FloodState(5.0, 9, 0.5)
    want = [x for r in rows for x in whole.step(r)]
    fold, steps, out = FloodBuckets(5.0, 9, 0.5, 5.001), [], []
    step = fold.fold.step
    fold.fold.step = lambda r: steps.append(r.packet_id) or step(r)
    for b in sorted({int(r.ts // 5.001) for r in rows}):
        own = [r for r in rows if int(r.ts // 5.001) == b]
        out += fold.step(SimpleNamespace(ts=b * 5.001, target="v", opened=sum(not r.is_ack for r in own), **{k: [getattr(r, c) for r in own] for k, c in {"times": "ts", "ids": "packet_id", "sources": "src", "pairs": "pair", "acks": "is_ack"}.items()}))
    assert out == want and steps == sorted(set(steps)) and len(steps) < len(rows)
