"""Frames of capture files to packets and back: the decoder, the encoder, and the readers and writers over the data source."""

from __future__ import annotations

import ipaddress
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import FLAG_LETTERS, HTTP_METHODS, event_time
from ..plans.packets import PACKET_SCHEMA
from .capture_source import register_captures

_COLUMNS = [c.split()[0] for c in PACKET_SCHEMA.split(", ")]
#: Ports of names, link types whose frames are bare IP, and IPv6 headers that name the next one.
NAME_PORTS, BARE_IP, MORE_HEADERS = (53, 5353), (12, 14, 101, 228, 229), (0, 43, 44, 51, 60, 135)


def _name(data: bytes, at: int) -> tuple[str, int]:
    labels, end, hops = [], None, 0
    while (n := data[at]) and hops < 64:
        hops += 1
        if n >= 0xC0:
            end = end or at + 2
            at = (n & 0x3F) << 8 | data[at + 1]
        else:
            labels.append(data[at + 1 : at + 1 + n].decode("utf-8", "replace"))
            at += 1 + n
    return ".".join(labels), end or at + 1


def _network(frame: bytes, link: int) -> tuple[int, int]:
    """The EtherType of what a frame of a link type carries, and where that starts; 0 for what is not known."""
    if link == 1:
        kind, at = struct.unpack_from("!H", frame, 12)[0], 14
        while kind in (0x8100, 0x88A8):
            kind, at = struct.unpack_from("!H", frame, at + 2)[0], at + 4
        return kind, at
    if link in BARE_IP:
        return {4: 0x0800, 6: 0x86DD}.get(frame[0] >> 4, 0), 0
    if link == 113:  # cooked
        return struct.unpack_from("!H", frame, 14)[0], 16
    if link == 276:  # cooked, second version
        return struct.unpack_from("!H", frame, 0)[0], 20
    if link in (0, 108):  # loopback: an address family in the writer's byte order
        family = min(struct.unpack_from("<I", frame)[0], struct.unpack_from(">I", frame)[0])
        return {2: 0x0800, 10: 0x86DD, 24: 0x86DD, 28: 0x86DD, 30: 0x86DD}.get(family, 0), 4
    return 0, 0


def _transport(frame: bytes, kind: int, at: int, p: dict) -> tuple[int, int, int]:
    """Follows IP headers, also of IP within IP, to the transport: protocol, start and end. The outermost addresses go to p. Protocol -1: a later fragment."""
    while True:
        if kind == 0x0800:
            end, proto = at + struct.unpack_from("!H", frame, at + 2)[0], frame[at + 9]
            ends = [str(ipaddress.IPv4Address(frame[at + k : at + k + 4])) for k in (12, 16)]
            later, start = struct.unpack_from("!H", frame, at + 6)[0] & 0x1FFF, at + (frame[at] & 15) * 4
        else:
            end, proto = at + 40 + struct.unpack_from("!H", frame, at + 4)[0], frame[at + 6]
            ends = [str(ipaddress.IPv6Address(frame[at + k : at + k + 16])) for k in (8, 24)]
            later, start = 0, at + 40
            while proto in MORE_HEADERS and not later:
                if proto == 44:
                    later, size = struct.unpack_from("!H", frame, start + 2)[0] >> 3, 8
                else:
                    size = (frame[start + 1] + 2) * 4 if proto == 51 else (frame[start + 1] + 1) * 8
                proto, start = frame[start], start + size
        if "src" not in p:
            p["src"], p["dst"], p["proto"] = *ends, "IP" if kind == 0x0800 else "IPv6"
        if later:
            return -1, start, end
        if proto not in (4, 41):
            return proto, start, end
        kind, at = (0x0800 if proto == 4 else 0x86DD), start


def decode_frame(frame: bytes, wirelen: int, link: int = 1) -> dict | None:
    """A packet's columns but packet_id and ts; None for a frame that is malformed, of a link type that is not known, or neither ARP nor IP."""
    p: dict = {"size": wirelen}
    try:
        kind, at = _network(frame, link)
        if kind == 0x0806:
            mac = lambda b: ":".join(f"{x:02x}" for x in b)
            op = struct.unpack_from("!H", frame, at + 6)[0]
            own, ip, other, to = frame[at + 8 : at + 14], frame[at + 14 : at + 18], frame[at + 18 : at + 24], frame[at + 24 : at + 28]
            ip, to = str(ipaddress.IPv4Address(ip)), str(ipaddress.IPv4Address(to))
            return p | {"proto": "ARP", "src": ip, "dst": to, "flags": mac(own), "arp_op": op, "arp_hwsrc": mac(own), "arp_psrc": ip, "arp_hwdst": mac(other), "arp_pdst": to}
        if kind not in (0x0800, 0x86DD):
            return None
        proto, at, end = _transport(frame, kind, at, p)
        if proto == 6:
            p["sport"], p["dport"] = struct.unpack_from("!HH", frame, at)
            bits = struct.unpack_from("!H", frame, at + 12)[0]
            p |= {"proto": "TCP", "flags": "".join(c for k, c in enumerate(FLAG_LETTERS) if bits >> k & 1)}
            line = frame[at + (bits >> 12) * 4 : end].split(b"\r\n", 1)[0].decode("utf-8", "replace").split(" ")
            if line[0] in HTTP_METHODS and len(line) > 1:
                p |= {"http_method": line[0], "http_uri": line[1]}
        elif proto == 17:
            p["sport"], p["dport"] = struct.unpack_from("!HH", frame, at)
            p["proto"], body = "UDP", frame[at + 8 : end]
            if (p["sport"] in NAME_PORTS or p["dport"] in NAME_PORTS) and len(body) > 12 and struct.unpack_from("!H", body, 4)[0]:
                try:
                    name, stop = _name(body, 12)
                    p |= {"dns_qname": name.rstrip("."), "dns_qtype": struct.unpack_from("!H", body, stop)[0]}
                except (IndexError, struct.error):
                    pass
        elif proto == 1 and kind == 0x0800:
            p["proto"] = "ICMP"
        return p
    except (IndexError, struct.error, ipaddress.AddressValueError):
        return None


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frames in batches:
        out = []
        for pid, ts, wire, link, frame in zip(*(frames[c] for c in ("packet_id", "ts", "wirelen", "link", "frame")), strict=True):
            p = decode_frame(bytes(frame or b""), int(wire), 1 if pd.isna(link) else int(link))
            if p:
                out.append(p | {"packet_id": pid, "ts": ts})
        rows = pd.DataFrame(out, columns=_COLUMNS, dtype=object)
        yield rows.astype(dict.fromkeys(("sport", "dport", "dns_qtype", "arp_op"), "Int32"))


def read_frames(spark: SparkSession, paths: str, since: float | None = None, until: float | None = None, **options) -> DataFrame:
    """Frames (FRAME_SCHEMA) of the captures of a file, folder or pattern, from since to until, both included; options as of the source."""
    frames = register_captures(spark).read.format("captures").options(path=paths, **options).load()
    for bound in ([F.col("ts") >= since] if since is not None else []) + ([F.col("ts") <= until] if until is not None else []):
        frames = frames.where(bound)
    return frames


def numbered(frames: DataFrame) -> DataFrame:
    """frames with packet_id, which is stable and rises along a file: 27 bits of the path's hash, 36 of the position."""
    position = F.when(F.col("position") < 1 << 36, F.col("position")).otherwise(F.raise_error(F.lit("a capture file is over 64 GB; split it")).cast("long"))
    return frames.withColumn("packet_id", F.shiftleft(F.pmod(F.xxhash64("path"), F.lit(1 << 27)), 36) + position)


def decode_frames(frames: DataFrame) -> DataFrame:
    """Packets of (packet_id, ts, wirelen, frame), of Ethernet unless a column link says otherwise."""
    link = F.col("link") if "link" in frames.columns else F.lit(1)
    return frames.select("packet_id", "ts", "wirelen", link.alias("link"), "frame").mapInPandas(_decode, PACKET_SCHEMA)


def read_pcap(spark: SparkSession, paths: str, since: float | None = None, until: float | None = None, **options) -> DataFrame:
    """Packets of capture files, classic or next-generation, of any size: a task reads a range of a classic file."""
    return decode_frames(numbered(read_frames(spark, paths, since, until, **options)))


def read_pcap_stream(spark: SparkSession, paths: str, delay: str = "1 minute", **options) -> DataFrame:
    """A stream of the packets of captures that may still grow, with event_time; rows over `delay` late are dropped."""
    frames = register_captures(spark).readStream.format("captures").options(path=paths, **options).load()
    return decode_frames(numbered(frames)).withColumn("event_time", event_time(F.col("ts"))).withWatermark("event_time", delay)


def _checksum(data: bytes) -> int:
    total = sum(struct.unpack(f"!{len(data) // 2}H", data[: len(data) // 2 * 2])) + (data[-1] << 8 if len(data) % 2 else 0)
    while total >> 16:
        total = (total & 0xFFFF) + (total >> 16)
    return total ^ 0xFFFF


def encode_frame(p: dict, link: int = 1) -> bytes | None:
    """The headers of a packet, with its question or request line, as a frame of Ethernet, bare IP (101) or cooked (113); None for what such frames can't carry."""
    value = lambda k: None if p.get(k) is None or p[k] != p[k] else p[k]
    try:
        if p["proto"] == "ARP":
            mac = lambda x: bytes(int(b, 16) for b in x.split(":")) if x else bytes(6)
            ip = lambda x: ipaddress.IPv4Address(x).packed if x else bytes(4)
            own = mac(value("arp_hwsrc") or value("flags"))
            body = struct.pack("!HHBBH", 1, 0x0800, 6, 4, int(value("arp_op") or 1)) + own + ip(value("arp_psrc") or value("src")) + mac(value("arp_hwdst")) + ip(value("arp_pdst") or value("dst"))
            kind = 0x0806
        else:
            src, dst = ipaddress.ip_address(value("src")), ipaddress.ip_address(value("dst"))
            sport, dport = int(value("sport") or 0), int(value("dport") or 0)
            if p["proto"] == "TCP":
                bits = sum(1 << k for k, c in enumerate(FLAG_LETTERS) if c in (value("flags") or ""))
                line = f"{p['http_method']} {value('http_uri') or ''} HTTP/1.1\r\n\r\n".encode() if value("http_method") else b""
                proto, data = 6, struct.pack("!HHIIHHHH", sport, dport, 0, 0, 5 << 12 | bits, 65535, 0, 0) + line
            elif p["proto"] == "UDP":
                name = value("dns_qname")
                labels = b"".join(bytes([len(x)]) + x for x in (y.encode() for y in (name or "").split(".") if y))
                ask = struct.pack("!6H", 1, 0x0100, 1, 0, 0, 0) + labels + b"\0" + struct.pack("!HH", int(value("dns_qtype") or 1), 1) if name else b""
                proto, data = 17, struct.pack("!4H", sport, dport, 8 + len(ask), 0) + ask
            else:
                proto, data = (1, struct.pack("!BBHI", 8, 0, 0, 0)) if p["proto"] == "ICMP" else (59, b"")
            if src.version == 4:
                head = struct.pack("!BBHHHBBH", 0x45, 0, 20 + len(data), 0, 0, 64, proto, 0) + src.packed + dst.packed
                kind, body = 0x0800, head[:10] + struct.pack("!H", _checksum(head)) + head[12:] + data
            else:
                kind, body = 0x86DD, struct.pack("!IHBB", 6 << 28, len(data), proto, 64) + src.packed + dst.packed + data
    except (ValueError, OverflowError, struct.error):
        return None
    if link == 101:
        return body if kind != 0x0806 else None
    return (bytes(14) if link == 113 else bytes(12)) + struct.pack("!H", kind) + body


def _encode(link: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [(p["ts"], p["size"], encode_frame(p, link)) for p in rows.to_dict("records")]
            yield pd.DataFrame([(ts, max(0 if size != size else int(size), len(f)), f) for ts, size, f in out if f is not None], columns=["ts", "wirelen", "frame"])

    return run


def write_pcap(packets: DataFrame, folder: str, kind: str = "pcap", link: int = 1) -> None:
    """Packets as captures of their headers, one file for each partition; a packet shorter than its headers is given as long as these."""
    frames = packets.select(*_COLUMNS).mapInPandas(_encode(link), "ts double, wirelen long, frame binary")
    register_captures(packets.sparkSession)
    frames.write.format("captures").options(path=folder, kind=kind, link=link).mode("append").save()


def read_packets(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    return spark.read.schema(PACKET_SCHEMA).format(kind).load(path)


def read_packet_stream(spark: SparkSession, folder: str, kind: str = "parquet", delay: str = "1 minute") -> DataFrame:
    """A stream of packets with event_time; rows over `delay` late are dropped."""
    return spark.readStream.schema(PACKET_SCHEMA).format(kind).load(folder).withColumn("event_time", event_time(F.col("ts"))).withWatermark("event_time", delay)


def capture_filter(packets: DataFrame) -> DataFrame:
    return packets.where(F.col("proto").isin("TCP", "UDP", "ARP"))
