"""Queries for single functions, for what alerts say, and for streams that sketch, keep late rows and start from a batch."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import detectors as D
from ..operators import folds as S
from ..operators import reports as R
from ..sources import tables as T
from ..sources.captures import decode_frames, encode_frame
from ..sources.tables import shared_folder, stored
from .adapter import packets
from .queries import alerts, gathered, query, stream_folder, streamed

_SINCE, _UNTIL, _LEAST = 1704067200.0, 1704067500.0, 15
_WIDE = f"""SELECT src, CAST(count(DISTINCT concat(dst, ':', dport)) AS BIGINT) AS targets FROM sy WHERE ts >= {_SINCE} AND ts < {_UNTIL} GROUP BY src HAVING count(DISTINCT concat(dst, ':', dport)) >= {_LEAST}"""


@query("agg8_wide_sources", _WIDE)
def _(spark, d):
    """Sketches by source and minute, merged over five minutes, name the sources that are counted exactly."""
    p = packets(spark, d)
    return R.wide_sources(p, stored(R.target_sketches(p), "sketches"), _SINCE, _UNTIL, _LEAST)


@query("str2_target_sketches", _WIDE)
def _(spark, d):
    """The same over sketches that a stream has stored minute by minute."""
    from ..streaming.jobs import stream_target_sketches

    return R.wide_sources(packets(spark, d), gathered(stream_target_sketches(streamed(spark, stream_folder(spark, d)))), _SINCE, _UNTIL, _LEAST)


@query("scl6_tcp_flag_text", "SELECT packet_id, concat(" + ", ".join(f"CASE WHEN (packet_id % 512) & {1 << k} <> 0 THEN '{c}' ELSE '' END" for k, c in enumerate("FSRPAUECN")) + ") AS flags FROM p")
def _(spark, d):
    return packets(spark, d).select("packet_id", X.tcp_flag_text(F.col("packet_id") % 512).alias("flags"))


_PAYLOAD = "concat(CASE packet_id % 5 WHEN 0 THEN 'GET ' WHEN 1 THEN 'POST ' WHEN 2 THEN 'get ' WHEN 3 THEN 'TRACE ' ELSE 'DELETE ' END, '/', coalesce(src, ''), '?q=', CAST(size AS STRING), ' HTTP/1.1', chr(13), chr(10), 'GET /no HTTP/1.1')"


@query("scl7_http_request_line", f"SELECT packet_id, CASE WHEN known THEN split_part(payload, ' ', 1) END AS method, CASE WHEN known THEN split_part(payload, ' ', 2) END AS uri FROM (SELECT packet_id, {_PAYLOAD} AS payload, packet_id % 5 IN (0, 1, 4) AS known FROM p)")
def _(spark, d):
    return packets(spark, d).select("packet_id", X.http_request_line(F.expr(_PAYLOAD)).alias("line")).select("packet_id", "line.method", "line.uri")


@query("scl8_dns_question", "SELECT dns_qname, dns_qtype, CAST(count(*) AS BIGINT) AS n FROM p WHERE dns_qname IS NOT NULL GROUP BY 1, 2")
def _(spark, d):
    """Questions out of the bytes of frames."""
    import pandas as pd

    def frames(batches):
        for rows in batches:
            yield pd.DataFrame({"packet_id": rows["packet_id"], "ts": rows["ts"], "wirelen": rows["size"], "frame": [encode_frame(r) for r in rows.to_dict("records")]})

    asked = packets(spark, d).where("dns_qname is not null").mapInPandas(frames, "packet_id long, ts double, wirelen long, frame binary")
    return decode_frames(asked).groupBy("dns_qname", "dns_qtype").agg(F.count("*").alias("n"))


@query("scl11_evidence", "SELECT packet_id, qname, CAST(score AS BIGINT) AS score, length(qname) AS query_length, concat_ws(',', CASE WHEN length(qname) >= 50 THEN 'long name' END, CASE WHEN entropy >= 3.5 AND length(subdomain) >= 10 THEN 'high entropy' END, CASE WHEN dns_qtype IN (10, 16) THEN 'record type' END, CASE WHEN burst >= 15 THEN 'subdomain burst' END) AS reasons FROM dns WHERE score >= 3")
def _(spark, d):
    """What alerts say of their evidence, parsed."""
    rows = D.detect_dns_tunnel(packets(spark, d)).select("packet_id", X.parse_evidence(F.col("evidence_json")).alias("e"))
    get = lambda path, kind: F.variant_get("e", path, kind)
    return rows.select("packet_id", get("$.qname", "string").alias("qname"), get("$.score", "bigint").alias("score"), get("$.query_length", "bigint").alias("query_length"), F.array_join(get("$.reasons", "array<string>"), ",").alias("reasons"))


@query("scl12_alert_description", """SELECT packet_id, CASE WHEN unique_hosts = 1 AND unique_ports > 1 THEN concat('Vertical port scan by ', src, ': ', unique_ports, ' ports of ', host, ' within 10.0 s')
  WHEN unique_hosts > 1 AND unique_ports = 1 THEN concat('Horizontal port sweep by ', src, ': one port on ', unique_hosts, ' hosts within 10.0 s')
  ELSE concat('Port scan by ', src, ': ', unique_targets, ' endpoints on ', unique_hosts, ' hosts within 10.0 s') END AS description FROM sa
UNION ALL SELECT packet_id, concat('SYN flood on ', dst, ': ', half_open_count, ' half-open connections from ', unique_attackers, ' source(s)') FROM fa
UNION ALL SELECT packet_id, concat('Name tunnel from ', src, ' by ', qname, ': ', concat_ws(', ', CASE WHEN length(qname) >= 50 THEN 'long name' END, CASE WHEN entropy >= 3.5 AND length(subdomain) >= 10 THEN 'high entropy' END, CASE WHEN dns_qtype IN (10, 16) THEN 'record type' END, CASE WHEN burst >= 15 THEN 'subdomain burst' END)) FROM dns WHERE score >= 3
UNION ALL SELECT packet_id, CASE WHEN conflict THEN concat('Address ', ip, ' claimed by ', mac, ', held by ', original_mac, ' before') ELSE concat(mac, ' claims ', held, ' addresses') END FROM ah WHERE conflict OR held > 3""")
def _(spark, d):
    return alerts(spark, d).select("packet_id", "description")


@query("snk3_minute_replacement", "SELECT minute_ts, total_packets, CAST(0 AS BIGINT) AS tcp_count FROM (SELECT CAST(floor(ts / 60) * 60 AS DOUBLE) AS minute_ts, CAST(count(*) AS BIGINT) AS total_packets FROM p WHERE packet_id % 2 = 0 GROUP BY 1)")
def _(spark, d):
    """Minutes of all packets, then of half of them: the last write replaces though it counts less."""
    path = f"{shared_folder(spark)}/minutes-{uuid.uuid4().hex}"
    count = lambda p: p.groupBy(X.minute_bucket(F.col("ts")).alias("minute_ts")).agg(F.count("*").alias("total_packets"))
    T.write_minute_stats(count(packets(spark, d)), path, 1)
    return T.write_minute_stats(count(packets(spark, d).where("packet_id % 2 = 0")), path, 2).select("minute_ts", "total_packets", "tcp_count")


@query("str5_from_batch", "SELECT packet_id, CAST(said AS BIGINT) AS suppressed FROM dc WHERE emit")
def _(spark, d):
    """Cooldowns over the first half of the alerts as a batch, over the second as a stream that starts from the batch's state."""
    from ..streaming.jobs import stream_dedup

    found = stored(D.detect_dns_tunnel(packets(spark, d)), "alerts")
    middle = found.agg(((F.min("ts") + F.max("ts")) / 2).alias("m")).first().m
    middle = middle if middle is not None else 0.0
    first, second = found.where(F.col("ts") < middle), found.where(F.col("ts") >= middle)
    state = stored(S.cooldown_state(first), "state")
    columns = ["id", "ts", "alert_type", "src", "dst", "packet_id"]
    end = found.agg(F.max("ts").alias("t")).select(F.lit("end").alias("id"), (F.col("t") + 1e6).alias("ts"), F.lit("end").alias("alert_type"), F.lit("end").alias("src"), F.lit("end").alias("dst"), F.lit(-1).cast("long").alias("packet_id"))
    path = f"{shared_folder(spark)}/alerts-{uuid.uuid4().hex}"
    second.select(*columns).unionByName(end).write.parquet(path)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(end.schema).parquet(path).withColumn("event_time", X.event_time(F.col("ts"))).withWatermark("event_time", "1 second")
    later = gathered(stream_dedup(stream, initial=state)).join(found.select("id", "packet_id"), "id").select("packet_id", "suppressed")
    return S.dedup_alerts(first).select("packet_id", "suppressed").union(later)


@query("str6_late_rows", "SELECT packet_id, ts FROM p WHERE packet_id % 10 = 0 AND ts < (SELECT max(ts) FROM p WHERE packet_id % 10 <> 0) - 60")
def _(spark, d):
    """A tenth of the packets comes after all others: those over a minute behind are kept apart, over a restart between."""
    from ..streaming.jobs import run_available
    from ..streaming.late import LateRows

    base = f"{shared_folder(spark)}/late-{uuid.uuid4().hex}"
    p = packets(spark, d).select("packet_id", "ts", "src")
    rows = LateRows(base, 60.0)
    for part in ("packet_id % 10 <> 0", "packet_id % 10 = 0"):
        p.where(part).write.mode("append").parquet(f"{base}/in")
        run_available(spark.readStream.schema(p.schema).parquet(f"{base}/in"), f"{base}/progress", rows, "append")
    return rows.late(spark, p.schema).select("packet_id", "ts")
