"""Queries over capture files: the packets written as captures by tasks, then read back by ranges, by blocks, as bare frames and as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.captures import decode_frames, encode_frame, read_pcap, read_pcap_stream, write_pcap
from ..sources.tables import shared_folder
from .adapter import packets
from .queries import gathered, query

#: Splits that files of a test's size have many of.
_SMALL = {"splitBytes": 65_536, "longestRecord": 4_096}


def _columns(df: DataFrame) -> DataFrame:
    return df.select(F.round(F.col("ts") * 1_000_000).cast("long").alias("us"), "src", "dst", "proto", "sport", "dport", "flags", "dns_qname", "dns_qtype", "arp_op", "arp_psrc", "size")


def _sql(header: str = "14", where: str = "true") -> str:
    """What a frame of the packet says: a question makes a short packet longer, and an address claim has its claimant in it. header: bytes before IP."""
    return f"""SELECT CAST(round(ts * 1000000) AS BIGINT) AS us, src, dst, proto, sport, dport, CASE WHEN proto = 'ARP' THEN lower(flags) ELSE flags END AS flags, dns_qname, dns_qtype, arp_op,
CASE WHEN proto = 'ARP' THEN src END AS arp_psrc, CASE WHEN dns_qname IS NOT NULL THEN greatest(size, {header} + 46 + length(dns_qname)) ELSE size END AS size FROM p WHERE {where}"""


def _written(spark: SparkSession, d: str, **options) -> str:
    folder = f"{shared_folder(spark)}/captures-{uuid.uuid4().hex}"
    write_pcap(packets(spark, d), folder, **options)
    return folder


@query("src1_read_pcap", _sql())
def _(spark, d):
    """Classic captures, each read by many tasks."""
    return _columns(read_pcap(spark, _written(spark, d), **_SMALL))


@query("src1_time_range", _sql(where="ts >= 1704067250 AND ts <= 1704067300"))
def _(spark, d):
    """Bounds of time reach the source."""
    return _columns(read_pcap(spark, _written(spark, d), 1704067250.0, 1704067300.0, **_SMALL))


@query("src1_blocks_cooked", _sql("16"))
def _(spark, d):
    """Next-generation captures of cooked frames."""
    return _columns(read_pcap(spark, _written(spark, d, kind="pcapng", link=113)))


_LINK = "CASE WHEN proto = 'ARP' THEN 1 ELSE 1 + packet_id % 3 END"


@query("src2_decode_frames", _sql(f"CASE {_LINK} WHEN 1 THEN 14 WHEN 2 THEN 0 ELSE 16 END"))
def _(spark, d):
    """Frames of three link types in one table: Ethernet, bare IP, cooked."""
    import pandas as pd

    links = {1: 1, 2: 101, 3: 113}

    def frames(batches):
        for rows in batches:
            made = [(p["packet_id"], p["ts"], links[p["kind"]], encode_frame(p, links[p["kind"]])) for p in rows.to_dict("records")]
            yield pd.DataFrame([(i, ts, link, max(size, len(f)), f) for (i, ts, link, f), size in zip(made, rows["size"].tolist(), strict=True)], columns=["packet_id", "ts", "link", "wirelen", "frame"])

    rows = packets(spark, d).withColumn("kind", F.expr(_LINK).cast("int"))
    return _columns(decode_frames(rows.mapInPandas(frames, "packet_id long, ts double, link int, wirelen long, frame binary")))


@query("src4_capture_stream", _sql())
def _(spark, d):
    """The captures as a stream."""
    return _columns(gathered(read_pcap_stream(spark, _written(spark, d), "1000 days", **_SMALL)))
