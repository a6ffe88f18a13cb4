import os
import random
import struct
import tempfile

import pytest

from tests.test_pieces import v4, v6
from tracewell.sources import capture_source as C
from tracewell.sources.captures import decode_frame, decode_frames, read_frames, read_pcap, read_pcap_stream
from tracewell.streaming.jobs import run_available

TCP = struct.pack("!HHIIHHHH", 1234, 443, 0, 0, 5 << 12 | 2, 0, 0, 0)


def classic(frames, order="<", ticks=1_000_000, link=1, start=1000):
    magic = {("<", 1_000_000): b"\xd4\xc3\xb2\xa1", (">", 1_000_000): b"\xa1\xb2\xc3\xd4", ("<", 10**9): b"\x4d\x3c\xb2\xa1", (">", 10**9): b"\xa1\xb2\x3c\x4d"}[order, ticks]
    out = magic + struct.pack(order + "HHiIII", 2, 4, 0, 0, 65535, link)
    for k, f in enumerate(frames):
        out += struct.pack(order + "4I", start + k, k * 7 % ticks, len(f), len(f)) + f
    return out


def put(data, name="a.pcap", folder=None):
    folder = folder or tempfile.mkdtemp()
    with open(f"{folder}/{name}", "wb") as f:
        f.write(data)
    return f"{folder}/{name}"


def hostile(rng, n):
    """Frames that carry captures, pieces of captures, runs of zeros, and tails of records."""
    inner = classic([bytes(rng.randrange(40)) for _ in range(30)], start=77)
    kinds = [lambda: bytes(rng.randrange(300)), lambda: rng.randbytes(rng.randrange(200)), lambda: inner[rng.randrange(600) :][: rng.randrange(500)], lambda: inner[24:], lambda: inner[-rng.randrange(1, 400) :], lambda: b""]
    return [rng.choice(kinds)() for _ in range(n)]


@pytest.mark.parametrize("order,ticks", [("<", 1_000_000), (">", 1_000_000), ("<", 10**9), (">", 10**9)])
def test_ranges_of_any_size_give_each_record_once(order, ticks):
    rng = random.Random(len(order) + ticks)
    frames = hostile(rng, 400)
    path = put(classic(frames, order, ticks))
    size = os.path.getsize(path)
    whole = [(x[0], x[-1]) for x in C._reader(C._Bytes(path, size), 2000).frames(0, size)]
    assert [f for _, f in whole] == frames
    for step in (997, 5_003, 20_011):
        got = []
        for a in range(0, size, step):
            got += [(x[0], x[-1]) for x in C._reader(C._Bytes(path, size), 1_600).frames(a, min(a + step, size))]
        assert got == whole, step


def test_a_boundary_is_found_without_reading_from_the_head():
    frames = hostile(random.Random(3), 3000)
    path = put(classic(frames, start=1_700_000_000))
    size = os.path.getsize(path)
    data = C._Bytes(path, size)
    reader = C._Classic(data, 1_600)
    true = {x[0] for x in reader.frames(0, size)}
    found = [reader.boundary(a) for a in range(size // 3, size, 7_919)]
    assert all(f in true for f in found) and min(found) > size // 3 - 60_000


def test_pushed_bounds_cut_off_files_and_damage(spark):
    frames = [v4(6, TCP) for _ in range(50)]
    path = put(classic(frames)[:-20])  # the last record is cut off
    rows = read_frames(spark, path, since=1010.0, until=1020.5)
    assert sorted(r.ts for r in rows.collect()) == [1000 + k + k * 7 / 1e6 for k in range(10, 21)]
    assert "1010.0" not in rows._jdf.queryExecution().executedPlan().toString()  # the source keeps these bounds
    assert read_frames(spark, path).count() == 49
    assert read_frames(spark, path).where("ts > 1010 and ts < 1012").count() == 2
    folder = tempfile.mkdtemp()
    put(classic(frames[:3]), "_hidden.pcap", folder)
    put(classic(frames[:3]), "b.pcap", folder)
    put(b"", "empty.pcap", folder)
    assert read_pcap(spark, folder).count() == 3 and read_pcap(spark, f"{folder}/b*").count() == 3
    assert read_pcap(spark, tempfile.mkdtemp()).count() == 0
    assert list(C.capture_files(f"file://{folder}")) == [f"file://{folder}/b.pcap", f"file://{folder}/empty.pcap"] and list(C.capture_files(f"{folder}/b*")) == [f"{folder}/b.pcap"]
    assert list(C.capture_files(f"file:{folder}/b.pcap")) == [f"{folder}/b.pcap"] and C.capture_files(f"{folder}/none") == {}
    for bad in (b"no capture at all, but long enough", classic([])[:24] + struct.pack("<4I", 1, 1, 1 << 30, 1 << 30)):
        with pytest.raises(Exception, match="capture file|damaged"):
            read_pcap(spark, put(bad)).count()


def block(order, kind, body):
    body += bytes(-len(body) % 4)
    return struct.pack(order + "2I", kind, len(body) + 12) + body + struct.pack(order + "I", len(body) + 12)


def section(order, interfaces, packets):
    out = block(order, C.SECTION, struct.pack(order + "IHHq", C.BYTE_ORDER, 1, 0, -1))
    for link, options in interfaces:
        out += block(order, C.INTERFACE, struct.pack(order + "HHI", link, 0, 0) + options)
    for own, ticks, frame in packets:
        out += block(order, C.PACKET, struct.pack(order + "5I", own, ticks >> 32, ticks & 0xFFFFFFFF, len(frame), len(frame) + 5) + frame)
    return out


def test_blocks_of_several_sections_clocks_and_links(spark):
    eth, ip = v4(6, TCP), v4(6, TCP)[14:]
    option = lambda order, code, body: struct.pack(order + "2H", code, len(body)) + body + bytes(-len(body) % 4)
    one = section("<", [(1, b""), (101, option("<", C.RESOLUTION, b"\x09") + option("<", 0, b""))], [(0, 5_000_001, eth), (1, 7 * 10**9 + 5, ip)])
    two = section(">", [(113, option(">", C.RESOLUTION, b"\x8a") + option(">", C.OFFSET, struct.pack(">q", 100)))], [(0, 3 * 1024 + 512, bytes(14) + b"\x08\x00" + ip)])
    two += block(">", C.OLD_PACKET, struct.pack(">HH4I", 0, 0, 0, 1024, len(ip) + 16, 99) + bytes(14) + b"\x08\x00" + ip)
    two += block(">", C.SIMPLE_PACKET, struct.pack(">I", len(ip) + 16) + bytes(14) + b"\x08\x00" + ip) + block(">", 5, bytes(12))
    path = put(one + two + one[:20], "x.pcapng")
    rows = sorted(read_pcap(spark, path).collect(), key=lambda r: r.packet_id)
    assert [(r.ts, r.proto, r.dport) for r in rows] == [(5.000001, "TCP", 443), (7 + 5 / 1e9, "TCP", 443), (103.5, "TCP", 443), (101.0, "TCP", 443), (0.0, "TCP", 443)]
    assert [r.size for r in rows] == [len(eth) + 5, len(ip) + 5, len(ip) + 21, 99, len(ip) + 16]


def test_link_types_headers_between_and_tunnels():
    ip, ip6 = v4(6, TCP)[14:], v6(6, TCP)[14:]
    same = [(ip, 101), (ip, 12), (ip6, 229), (bytes(14) + b"\x08\x00" + ip, 113), (b"\x86\xdd" + bytes(18) + ip6, 276), (struct.pack("<I", 2) + ip, 0), (struct.pack(">I", 30) + ip6, 108), (bytes(14) + b"\x86\xdd" + ip6, 113)]
    assert [decode_frame(f, 60, k)["dport"] for f, k in same] == [443] * len(same)
    assert decode_frame(ip, 60, 147) is None and decode_frame(b"", 0, 101) is None and decode_frame(b"\x50" + bytes(40), 60, 101) is None
    hop, dest, auth = bytes([60, 0]) + bytes(6), bytes([51, 1]) + bytes(14), bytes([6, 4]) + bytes(22)
    assert decode_frame(v6(0, hop + dest + auth + TCP), 90)["flags"] == "S"
    first, later = bytes([6, 0]) + struct.pack("!HI", 1, 9), bytes([6, 0]) + struct.pack("!HI", 8 << 3, 9)
    assert decode_frame(v6(44, first + TCP), 90)["proto"] == "TCP"
    p = decode_frame(v6(44, later + TCP), 90)
    assert p["proto"] == "IPv6" and "sport" not in p
    p = decode_frame(v4(41, ip6), 120)
    assert (p["src"], p["proto"], p["dport"]) == ("10.0.0.1", "TCP", 443)
    assert decode_frame(v6(4, ip), 120)["dport"] == 443 and decode_frame(v6(0, b"\x06"), 60) is None
    ask = struct.pack("!HHHH", 5353, 5353, 0, 0) + struct.pack("!HHHHHH", 1, 0, 1, 0, 0, 0) + b"\x03abc\x05local\x00" + struct.pack("!HH", 12, 1)
    assert decode_frame(v4(17, ask), 80)["dns_qname"] == "abc.local"


def test_a_growing_capture_is_followed_over_a_restart(spark):
    """Each packet comes once, also one of which a part was there when a batch ended."""
    rng = random.Random(8)
    frames = [v4(6, TCP + bytes(rng.randrange(900))) for _ in range(300)]
    data, folder = classic(frames), tempfile.mkdtemp()
    base, got, runs = tempfile.mkdtemp(), [], []

    def run():
        stream = read_pcap_stream(spark, folder, "1000 days", splitBytes=20_000, longestRecord=1_600)
        run_available(stream, f"{base}/progress", lambda b, n: (got.extend(r.ts for r in b.select("ts").collect()), runs.append(n)), "append")

    put(data[:10], "a.pcap", folder)
    run()
    for cut in (len(data) // 3 + 5, len(data) // 3 + 9, 2 * len(data) // 3, len(data)):
        put(data[:cut], "a.pcap", folder)
        if cut == 2 * len(data) // 3:
            put(section("<", [(101, b"")], [(0, 5_000_000 + k, frames[k][14:]) for k in range(5)]), "b.pcapng", folder)
        run()
    want = [1000 + k + k * 7 / 1e6 for k in range(300)] + [5 + k / 1e6 for k in range(5)]
    assert sorted(got) == sorted(want) and len(runs) >= 4


def test_written_captures_and_what_no_frame_carries(spark):
    from tracewell.plans.packets import PACKET_SCHEMA
    from tracewell.sources.captures import encode_frame, write_pcap

    rows = [dict(packet_id=1, ts=5.25, src="10.0.0.1", dst="10.0.0.2", proto="TCP", sport=1, dport=2, flags="SA", http_method="GET", http_uri="/é", size=10), dict(packet_id=2, ts=6.0, src="::1", dst="fe80::2", proto="UDP", sport=9, dport=53, dns_qname="a.b", dns_qtype=28, size=1000)]
    rows += [dict(packet_id=3, ts=7.0, src="no address", dst="x", proto="TCP", size=1), dict(packet_id=4, ts=8.0, proto="ICMP", size=1), dict(packet_id=5, ts=9.0, src="10.0.0.3", dst="10.0.0.4", proto="ARP", flags="AA:00:00:00:00:01", size=60)]
    table = spark.createDataFrame([tuple(r.get(c.split()[0]) for c in PACKET_SCHEMA.split(", ")) for r in rows], PACKET_SCHEMA)
    folder = tempfile.mkdtemp()
    write_pcap(table.coalesce(1), folder)
    write_pcap(table.limit(0), folder)
    back = read_pcap(spark, folder).orderBy("ts").collect()
    assert [(r.ts, r.proto, r.src, r.flags, r.http_uri, r.dns_qname, r.dns_qtype) for r in back] == [(5.25, "TCP", "10.0.0.1", "SA", "/é", None, None), (6.0, "UDP", "::1", None, None, "a.b", 28), (9.0, "ARP", "10.0.0.3", "aa:00:00:00:00:01", None, None, None)]
    assert back[1].size == 1000 and len(os.listdir(folder)) >= 1 and not [x for x in os.listdir(folder) if x[0] == "_"]
    assert encode_frame(rows[4], 101) is None
    assert decode_frames(spark.createDataFrame([(1, 1.0, 60, v4(6, TCP)), (2, 1.0, 60, None)], "packet_id long, ts double, wirelen long, frame binary")).count() == 1
