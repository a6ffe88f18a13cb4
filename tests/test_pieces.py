"""Decoder, column functions, sketches, sinks and late rows, on small made cases."""

import json
import struct
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_fixtures import syn, table
from tracewell.functions.expressions import event_time, http_request_line, parse_evidence, tcp_flag_text
from tracewell.operators.detectors import detect_arp_spoof, detect_dns_tunnel, detect_port_scan, detect_syn_flood, dns_scores
from tracewell.operators.folds import segments
from tracewell.operators.reports import cms_build, cms_conservative, cms_decay, cms_estimate, cms_merge, scan_window
from tracewell.plans.adapter import packets
from tracewell.plans.packets import PACKET_SCHEMA
from tracewell.sources.captures import decode_frame, read_packet_stream
from tracewell.sources.tables import alerts_table, write_alerts, write_flow_summary, write_minute_stats
from tracewell.streaming.jobs import late_rows, run_available, stream_gap_flows, stream_scan_windows

V6 = (bytes.fromhex("20010db8000000000000000000000001"), bytes.fromhex("fe800000000000000000000000000002"))


def v6(proto, body):
    return bytes(12) + b"\x86\xdd" + struct.pack("!IHBB", 6 << 28, len(body), proto, 64) + V6[0] + V6[1] + body


def v4(proto, body, fragment=0):
    return bytes(12) + b"\x08\x00" + struct.pack("!BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 0, fragment, 64, proto, 0, bytes([10, 0, 0, 1]), bytes([10, 0, 0, 2])) + body


def test_decoder_cases():
    tcp = struct.pack("!HHIIHHHH", 1234, 443, 0, 0, 5 << 12 | 0x12, 0, 0, 0)
    p = decode_frame(v6(6, tcp), 90)
    assert (p["proto"], p["src"], p["dst"], p["sport"], p["dport"], p["flags"], p["size"]) == ("TCP", "2001:db8::1", "fe80::2", 1234, 443, "SA", 90)
    arp = bytes(12) + b"\x08\x06" + struct.pack("!HHBBH", 1, 0x0800, 6, 4, 2) + bytes.fromhex("aabbccddeeff") + bytes([192, 168, 1, 1]) + bytes.fromhex("112233445566") + bytes([192, 168, 1, 9])
    p = decode_frame(arp, 42)
    assert (p["proto"], p["src"], p["dst"], p["arp_op"], p["arp_hwsrc"], p["arp_psrc"], p["arp_hwdst"], p["arp_pdst"]) == ("ARP", "192.168.1.1", "192.168.1.9", 2, "aa:bb:cc:dd:ee:ff", "192.168.1.1", "11:22:33:44:55:66", "192.168.1.9")
    assert decode_frame(v6(58, bytes(8)), 60)["proto"] == "IPv6" and decode_frame(v4(1, bytes(8)), 60)["proto"] == "ICMP"
    later = decode_frame(v4(6, tcp, fragment=100), 60)
    assert later["proto"] == "IP" and "sport" not in later
    whole = v4(6, tcp)
    assert [decode_frame(whole[:n], 60) for n in (0, 13, 20, 36)] == [None] * 4 and decode_frame(arp[:20], 42) is None
    tagged = whole[:12] + b"\x81\x00\x00\x05" + whole[12:]
    assert decode_frame(tagged, 60)["dport"] == 443
    assert decode_frame(bytes(12) + b"\x88\xcc" + bytes(40), 60) is None


def test_decoder_names():
    ask = lambda name, kind=1: struct.pack("!HHHH", 5000, 53, 0, 0) + struct.pack("!HHHHHH", 1, 0, 1, 0, 0, 0) + name + struct.pack("!HH", kind, 1)
    p = decode_frame(v4(17, ask(b"\x03abc\x02de\x00", 16)), 70)
    assert (p["dns_qname"], p["dns_qtype"]) == ("abc.de", 16)
    endless = decode_frame(v4(17, ask(b"\xc0\x0c")), 70)  # a pointer to itself
    assert endless["proto"] == "UDP"
    short = decode_frame(v4(17, ask(b"\x3fabc")[:24]), 70)
    assert short["proto"] == "UDP" and "dns_qname" not in short


def test_flag_text_request_line_and_evidence(spark):
    rows = spark.createDataFrame([(0, "GET /a b\r\nHost: x"), (1 | 2 | 16, "POST / HTTP/1.1"), (511, "GETX /a"), (4, None), (8, "OPTIONS *")], "bits int, payload string")
    out = rows.select(tcp_flag_text(F.col("bits")).alias("f"), http_request_line(F.col("payload")).alias("r")).collect()
    assert [x.f for x in out] == ["", "FSA", "FSRPAUECN", "R", "P"]
    assert [(x.r.method, x.r.uri) for x in out] == [("GET", "/a"), ("POST", "/"), (None, None), (None, None), ("OPTIONS", "*")]
    texts = spark.createDataFrame([('{"a": [1, "x"], "b": null}',), ("{bad",), (None,), ("{}",)], "t string")
    got = [r[0] for r in texts.select(F.to_json(parse_evidence(F.col("t")))).collect()]
    assert [json.loads(x) for x in got] == [{"a": [1, "x"], "b": None}, {}, {}, {}]


def test_sketches(spark):
    names = [f"k{i % 300}" for i in range(4000)] + ["hot"] * 1500
    df = spark.createDataFrame([(x,) for x in names] + [(None,)], "src string")
    true = {x: names.count(x) for x in set(names)}
    sketch = cms_build(df, "src", width=64, depth=4)
    plain = {r.src: r.estimate for r in cms_estimate(sketch, df.where("src is not null"), "src", 64, 4).collect()}
    assert all(plain[k] >= n for k, n in true.items())
    halves = [cms_build(df.where(c), "src", 64, 4) for c in ("src < 'k2'", "src >= 'k2'")]
    assert sorted(map(tuple, cms_merge(*halves).collect())) == sorted(map(tuple, sketch.collect()))
    assert {(r.row, r.col): r.cnt for r in cms_decay(sketch, 0.5).collect()} == {(r.row, r.col): r.cnt // 2 for r in sketch.collect()}
    careful = cms_conservative(df, "src", 64, 4, shards=4).collect()
    cells = {(r.shard, r.row, r.col): r.cnt for r in careful}
    from tracewell.operators.reports import cms_cell, cms_shard

    places = df.where("src is not null").select("src", cms_shard(F.col("src"), 4).alias("shard"), F.array(*[cms_cell(F.col("src"), F.lit(k), 64) for k in range(4)]).alias("at")).distinct().collect()
    for r in places:
        low = min(cells[(r.shard, k, c)] for k, c in enumerate(r.at))
        assert true[r.src] <= low <= plain[r.src]
    # each shard by hand: a key's cells rise to its least cell and its count, and the sum of what rises is no more than without care
    assert sum(cells.values()) <= 4 * len(names)
    assert cms_conservative(df.limit(0), "src").count() == 0


def test_sinks(spark):
    folder = tempfile.mkdtemp()
    alert = lambda k, ts, severity: (str(k), float(ts), "port_scan", severity, "a", "b", "text", "{}", k)
    shape = "id string, ts double, alert_type string, severity string, src string, dst string, description string, evidence_json string, packet_id long"
    assert alerts_table(spark, f"{folder}/alerts").read() is None
    write_alerts(spark.createDataFrame([alert(1, 5, "low"), alert(2, 90_000, "low")], shape), f"{folder}/alerts")
    out = write_alerts(spark.createDataFrame([alert(2, 90_000, "high"), alert(3, 90_001, "low")], shape), f"{folder}/alerts")
    assert sorted((r.id, r.severity) for r in out.collect()) == [("1", "low"), ("2", "high"), ("3", "low")] and out.columns == [c.split()[0] for c in shape.split(", ")]
    flow = lambda k, last, n: (k, float(last), n)
    write_flow_summary(spark.createDataFrame([flow("x", 10, 1), flow("y", 10, 1)], "flow_key string, last_seen_ts double, total_packets long"), f"{folder}/flows")
    out = write_flow_summary(spark.createDataFrame([flow("x", 5, 9), flow("y", 200_000, 2)], "flow_key string, last_seen_ts double, total_packets long"), f"{folder}/flows")
    assert sorted((r.flow_key, r.total_packets) for r in out.collect()) == [("x", 1), ("y", 2)]
    minutes = spark.createDataFrame([(60.0, 5, None)], "minute_ts double, total_packets long, tcp_count long")
    out = write_minute_stats(minutes, f"{folder}/minutes").first()
    assert (out.tcp_count, out.udp_count, out.arp_count, out.other_count, out.alerts_count) == (0, 0, 0, 0, 0)


def test_holder_of_many_addresses(spark):
    claim = lambda k, ip, mac: {"ts": float(k), "proto": "ARP", "src": ip, "dst": "x", "arp_hwsrc": mac, "arp_op": 2}
    rows = [claim(k, f"10.0.0.{k}", "AA:1") for k in range(4)] + [claim(4, "10.0.0.1", "BB:2"), claim(5, "10.0.0.0", "aa:1"), claim(6, "10.0.0.9", "aa:1")]
    out = sorted((r.packet_id, r.severity, json.loads(r.evidence_json).get("claimed_ips")) for r in detect_arp_spoof(table(spark, rows)).collect())
    assert out == [(3, "high", [f"10.0.0.{k}" for k in range(4)]), (4, "high", None), (6, "high", ["10.0.0.0", "10.0.0.2", "10.0.0.3", "10.0.0.9"])]


def test_benign_traffic_raises_nothing(spark):
    rows = []
    for k in range(200):
        there, back = {"src": f"c{k % 9}", "sport": 4000 + k, "dst": "web", "dport": 443}, {"src": "web", "sport": 443, "dst": f"c{k % 9}", "dport": 4000 + k}
        rows += [{"ts": k * 1.0 + i / 100, "flags": f, **(there if d else back)} for i, (f, d) in enumerate((("S", 1), ("SA", 0), ("A", 1), ("PA", 1), ("FA", 1), ("FA", 0)))]
        rows.append({"ts": k * 1.0 + 0.5, "proto": "UDP", "src": f"c{k % 9}", "dst": "dns", "sport": 5353, "dport": 53, "dns_qname": "www.example.com", "dns_qtype": 1})
        rows.append({"ts": k * 1.0 + 0.6, "proto": "ARP", "src": f"10.0.0.{k % 9}", "dst": "x", "arp_hwsrc": f"00:00:00:00:01:0{k % 9}", "arp_op": 2})
    p = table(spark, rows)
    for detect in (detect_port_scan, detect_syn_flood, detect_dns_tunnel, detect_arp_spoof):
        assert detect(p).count() == 0


def test_bursts_and_windows_against_plain_counts(spark):
    rng = np.random.default_rng(3)
    rows, at = [], 0.0
    for _ in range(700):
        at += float(rng.choice([0.0, 0.25, 1.0, 4.0, 40.0], p=[0.2, 0.5, 0.2, 0.08, 0.02]))
        rows.append({"ts": at, "proto": "UDP", "src": "ab"[rng.integers(2)], "dst": "d", "dport": 53, "dns_qname": f"{['', 'x.', 'y.', 'z.z.'][rng.integers(4)]}n{rng.integers(6)}.par{rng.integers(2)}.net", "dns_qtype": 1})
    got = {r.packet_id: r.burst for r in dns_scores(table(spark, rows)).collect()}
    parts = [(k, r["ts"], r["src"], *r["dns_qname"].rsplit(".", 2)) for k, r in enumerate(rows)]
    for k, ts, src, sub, par, _ in parts:
        assert got[k] == len({s for j, t, a, s, b, _ in parts if j <= k and a == src and b == par and t >= ts - 15 and s}), k
    opened = [syn(r["ts"], r["src"], f"h{k % 7}", 1 + k % 5) for k, r in enumerate(rows)]
    got = {r.packet_id: r.targets for r in scan_window(table(spark, opened)).collect()}
    for k, r in enumerate(opened):
        assert got[k] == len({(x["dst"], x["dport"]) for x in opened[: k + 1] if x["src"] == r["src"] and x["ts"] >= r["ts"] - 10}), k


def test_a_hot_key_is_many_segments(spark):
    """Half of all rows have one source; its busy spells, parted by silences, are dealt apart, and no task folds over ten times the median."""
    rows = [syn(100.0 * (i // 20) + 0.01 * (i % 20), "hot" if i % 2 else f"s{i % 400}", f"h{i % 20}", 80) for i in range(8000)]
    cut = segments(table(spark, rows).select("packet_id", "ts", "src"), "src", 10.0)
    of_hot = cut.where("src = 'hot'")
    assert of_hot.count() == 4000 and of_hot.select("segment").distinct().count() == 400
    assert {(r.segment, r.before) for r in of_hot.collect()} == {(k, 10 * k) for k in range(400)}
    sizes = sorted(r["count"] for r in cut.repartition(40, "src", "segment").groupBy(F.spark_partition_id()).count().collect())
    assert sizes[-1] <= 10 * sizes[len(sizes) // 2]
    assert segments(cut.select("packet_id", "ts", "src"), "src", 10.0, least=11).where("src = 'hot'").count() == 0


def test_late_rows_are_counted_and_windows_stream(spark):
    folder = tempfile.mkdtemp()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for k, times in enumerate(((100, 101, 102), (900,), (901,), (103, 114, 902), (2000,))):
        table(spark, [syn(t, "a", "b", 1 + t % 7) for t in times]).coalesce(1).write.mode("append").parquet(f"{folder}/in/{k}")
    stream = spark.readStream.schema(PACKET_SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*").withColumn("event_time", event_time(F.col("ts"))).withWatermark("event_time", "10 seconds")
    found = []
    q = run_available(stream_scan_windows(stream, "10 seconds", "10 seconds"), f"{folder}/p1", lambda b, n: found.extend((r.src, r.targets) for r in b.collect()), "append")
    assert late_rows(q) == 2 and sorted(found) == [("a", 3), ("a", 3)]
    flows = []
    run_available(stream_gap_flows(stream), f"{folder}/p2", lambda b, n: flows.extend((r.total_packets, r.start_ts) for r in b.collect()), "append")
    assert sorted(flows) == [(1, float(t)) for t in (100, 101, 102, 900, 901, 902)]  # a port each


def test_packet_stream_reads_a_folder(spark, sf):
    folder = tempfile.mkdtemp()
    packets(spark, sf).drop("label").write.mode("overwrite").parquet(folder)
    n = []
    run_available(read_packet_stream(spark, folder), f"{tempfile.mkdtemp()}/p", lambda b, k: n.append(b.where("event_time is not null").count()), "append")
    assert sum(n) == packets(spark, sf).count()


@pytest.mark.parametrize("n", [1, 7])
def test_empty_packets(spark, n):
    none = table(spark, [syn(0, "a", "b", 1)] * n).limit(0)
    for detect in (detect_port_scan, detect_syn_flood, detect_dns_tunnel, detect_arp_spoof):
        assert detect(none).count() == 0
