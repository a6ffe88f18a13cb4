import json
import random
import struct
import tempfile

import pytest
from pyspark.sql import functions as F

from tracewell.functions.expressions import event_time, shannon_entropy
from tracewell.operators.detectors import Registry, detect_arp_spoof, flood_events, scan_events
from tracewell.operators.flows import aggregate_flows
from tracewell.operators.folds import dedup_alerts, sessionize
from tracewell.operators.reports import ewma_rate
from tracewell.plans import queries as Q
from tracewell.plans.adapter import packets
from tracewell.plans.packets import PACKET_SCHEMA
from tracewell.plans.queries import QUERIES
from tracewell.sources.captures import read_pcap
from tracewell.streaming.jobs import run_available, stream_port_scan

NAMES = [c.split()[0] for c in PACKET_SCHEMA.split(", ")]


def table(spark, rows):
    return spark.createDataFrame([tuple({"packet_id": k, "size": 60, "proto": "TCP", **r}.get(c) for c in NAMES) for k, r in enumerate(rows)], PACKET_SCHEMA)


def syn(ts, src, dst, dport, sport=1000, **more):
    return {"ts": float(ts), "src": src, "dst": dst, "sport": sport, "dport": dport, "flags": "S", **more}


def test_scans(spark):
    up = table(spark, [syn(0.1 * i, "a", "b", 1 + i) for i in range(12)])
    assert [(r.packet_id, r.scan_type, r.dst) for r in scan_events(up, threshold=10).collect()] == [(9, "vertical", "b")]
    across = table(spark, [syn(0.1 * i, "a", f"h{i}", 22) for i in range(12)])
    assert [(r.scan_type, r.dst) for r in scan_events(across, threshold=10).collect()] == [("horizontal", None)]
    slow = table(spark, [syn(2.0 * i, "a", "b", 1 + i) for i in range(15)])
    assert scan_events(slow, window=5.0, threshold=10).count() == 0
    crawl = table(spark, [syn(1.0 * i, "a", "b", 1 + i) for i in range(15)])
    assert [(r.packet_id, r.scan_type) for r in scan_events(crawl, window=5.0, threshold=10, ewma=True, slow_threshold=12, alpha=0.3).collect()] == [(11, "low_and_slow")]


def test_floods(spark):
    rows = [syn(0.05 * i, "a", "10.0.0.1", 80, sport=2000 + i) for i in range(20)]
    e = flood_events(table(spark, rows), threshold=15).collect()
    assert [(r.src, r.half_open_count) for r in e] == [("a", 15)]
    answered = [x for i, r in enumerate(rows) for x in (r, {**r, "ts": r["ts"] + 0.01, "src": "10.0.0.1", "dst": "a", "sport": 80, "dport": 2000 + i, "flags": "SA"})]
    assert flood_events(table(spark, answered), threshold=15).count() == 0


def test_address_conflict_at_the_gateway(spark):
    rows = [{"ts": 1.0 * i, "proto": "ARP", "src": "192.168.1.1", "dst": "x", "arp_hwsrc": m, "arp_op": 2} for i, m in enumerate(("AA:0", "BB:0"))]
    assert [(r.severity, "bb:0" in r.evidence_json, "GATEWAY" in r.description) for r in detect_arp_spoof(table(spark, rows), "192.168.1.1").collect()] == [("critical", True, True)]


@pytest.mark.parametrize("n, state", enumerate(["SYN_SENT", "SYN_RECEIVED", "ESTABLISHED", "FIN_WAIT", "CLOSED"], 1))
def test_handshake_step_by_step(spark, n, state):
    there, back = {"src": "a", "sport": 5, "dst": "b", "dport": 80}, {"src": "b", "sport": 80, "dst": "a", "dport": 5}
    rows = [{"ts": 1.0 + i / 10, "flags": f, **(there if d else back)} for i, (f, d) in enumerate((("S", 1), ("SA", 0), ("A", 1), ("FA", 1), ("FA", 0)))][:n]
    assert aggregate_flows(table(spark, rows)).first().tcp_state == state


def test_cooldown_and_sessions(spark):
    a = [("1", 100.0, "scan"), ("2", 103.0, "scan"), ("3", 104.0, "flood"), ("4", 115.0, "scan")]
    alerts = spark.createDataFrame([(i, t, k, "s", None, int(i)) for i, t, k in a], "id string, ts double, alert_type string, src string, dst string, packet_id long")
    assert {(r.id, r.suppressed) for r in dedup_alerts(alerts, 10.0).collect()} == {("1", 0), ("3", 0), ("4", 1)}
    rows = [{"ts": t, "proto": "UDP", "src": "a", "dst": "b", "sport": 1, "dport": 2} for t in (0.0, 59.0, 130.0)]
    assert sorted(r.session_no for r in sessionize(table(spark, rows)).collect()) == [0, 0, 1]


def test_folds_do_not_depend_on_partitions(spark, sf01):
    rows = packets(spark, sf01)
    answers = []
    for n in ("1", "8", "50"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        answers.append(sorted(r.packet_id for r in scan_events(rows).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert answers[0] == answers[1] == answers[2] != []


def test_registry_and_entropy(spark):
    r = Registry()
    r.enabled = dict.fromkeys(r.enabled, False)
    assert r.run(table(spark, [syn(0, "a", "b", 1)])).count() == 0
    r.register("odd", lambda p: p.select("packet_id"))
    with pytest.raises(ValueError):
        r.run(table(spark, [syn(0, "a", "b", 1)]))
    out = spark.createDataFrame([("",), (None,), ("aaaa",), ("abcd",)], "s string").select(shannon_entropy(F.col("s")).alias("e")).collect()
    assert [round(x.e, 6) for x in out] == [0, 0, 0, 2]


def test_captures(spark):
    ip = lambda proto, body: bytes(12) + b"\x08\x00" + struct.pack("!BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 0, 0, 64, proto, 0, bytes([10, 0, 0, 1]), bytes([10, 0, 0, 2])) + body
    tcp = lambda flags, data=b"": struct.pack("!HHIIHHHH", 1234, 80, 0, 0, 5 << 12 | flags, 0, 0, 0) + data
    name = b"".join(bytes([len(x)]) + x for x in (b"www", b"example", b"com")) + b"\0"
    dns = struct.pack("!HHHHHH", 1, 0, 1, 0, 0, 0) + name + struct.pack("!HH", 16, 1)
    frames = [ip(6, tcp(2)), ip(17, struct.pack("!HHHH", 5000, 53, 8 + len(dns), 0) + dns), ip(1, bytes(8)), ip(6, tcp(24, b"GET /api HTTP/1.1\r\n\r\n")), bytes(20)]
    folder = tempfile.mkdtemp()
    with open(f"{folder}/a.pcap", "wb") as f:
        f.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1))
        for k, x in enumerate(frames):
            f.write(struct.pack("<IIII", 100 + k, 500000, len(x), len(x) + 9) + x)
    rows = sorted(read_pcap(spark, f"{folder}/*.pcap").collect(), key=lambda r: r.ts)
    assert [(r.proto, r.flags, r.dns_qname, r.dns_qtype, r.http_method, r.http_uri) for r in rows] == [("TCP", "S", None, None, None, None), ("UDP", None, "www.example.com", 16, None, None), ("ICMP", None, None, None, None, None), ("TCP", "PA", None, None, "GET", "/api")]
    assert rows[0].ts == 100.5 and rows[0].size == len(frames[0]) + 9 and rows[0].sport == 1234


def test_stream_scan_is_the_batch_scan(spark):
    folder = tempfile.mkdtemp()
    rows = table(spark, [syn(100 + 0.1 * i, f"s{i % 2}", "b", 1 + i) for i in range(60)] + [syn(900, "z", "b", 1)])
    rows.coalesce(1).write.parquet(f"{folder}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(PACKET_SCHEMA).parquet(f"{folder}/in").withColumn("event_time", event_time(F.col("ts"))).withWatermark("event_time", "1 second")
    found = []
    run_available(stream_port_scan(stream), f"{folder}/progress", lambda b, n: found.extend((r.packet_id, r.src) for r in b.collect()), "append")
    assert sorted(found) == sorted((r.packet_id, r.src) for r in scan_events(rows).collect()) != []


def scans_by_hand(rows, window=10.0, threshold=15, enough=20, age=300.0, alpha=0.2):
    """Plain model of both paths over packets in order: packet_id and evidence of each alert."""
    recent, crawls, out = {}, {}, []
    for r in rows:
        if r["proto"] != "TCP" or "S" not in (r["flags"] or "") or "A" in r["flags"] or not r["src"] or not r["dst"] or r["dport"] is None:
            continue
        src, ts, target = r["src"], r["ts"], (r["dst"], r["dport"])
        recent[src] = [x for x in [*recent.get(src, []), (ts, target)] if x[0] >= ts - window]
        targets = {t for _, t in recent[src]}
        if len(targets) >= threshold:
            recent[src] = []
            hosts, ports = len({h for h, _ in targets}), len({p for _, p in targets})
            out.append((r["packet_id"], "vertical" if hosts == 1 and ports > 1 else "horizontal" if hosts > 1 and ports == 1 else "distributed/hybrid", len(targets), None, None))
            continue
        if src not in crawls:
            crawls[src] = [ts, ts, 1.0, {target}]
            continue
        first, last, rate, seen = crawls[src]
        rate = alpha / max(0.001, ts - last) + (1 - alpha) * rate
        crawls[src] = [first, ts, rate, seen | {target}]
        slow = ts - first > window and len(crawls[src][3]) >= enough
        if slow:
            out.append((r["packet_id"], "low_and_slow", len(crawls[src][3]), round(ts - first, 1), round(rate, 4)))
        if slow or ts - first > age:
            del crawls[src]
    return sorted(out)


def evidence(alerts):
    out = []
    for r in alerts.collect():
        e = json.loads(r.evidence_json)
        out.append((r.packet_id, e["scan_type"], e["unique_targets"], e.get("elapsed_seconds"), e.get("ewma_rate")))
    return sorted(out)


def test_slow_scan_query_against_a_plain_model(spark, sf01, monkeypatch):
    real = [r.asDict() for r in packets(spark, sf01).orderBy("ts", "packet_id").collect()]
    assert evidence(QUERIES["det1_slow_scan"](spark, sf01)) == scans_by_hand(real)
    rng = random.Random(4)
    made, ts = [], 0.0
    for k in range(3000):  # bursts and crawls of three sources
        ts += rng.choice((0.05, 0.1, 0.2)) if k // 60 % 2 else rng.choice((0.3, 1.0, 2.0))
        made.append(syn(ts, rng.choice("abc"), f"h{rng.randrange(9)}", rng.randrange(12)))
    df = table(spark, made)
    monkeypatch.setattr(Q, "packets", lambda *_: df)
    want = scans_by_hand([r.asDict() for r in df.orderBy("ts", "packet_id").collect()])
    assert evidence(QUERIES["det1_slow_scan"](spark, sf01)) == want and {"low_and_slow", "distributed/hybrid"} <= {x[1] for x in want}


def test_moving_rate_stays_in_the_jvm(spark):
    rows = [syn(t, s, "b", 1) for t, s in ((0.0, "a"), (0.5, "a"), (0.5, "a"), (2.5, "a"), (3.0, "c"))]
    df = ewma_rate(table(spark, rows))
    assert [(r.src, round(r.rate, 9)) for r in df.collect()] == [("a", round(0.2 / 2 + 0.8 * (0.2 / 0.001 + 0.8 * (0.2 / 0.5 + 0.8)), 9))]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "MapInPandas" not in plan
