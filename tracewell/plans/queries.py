"""The registered queries, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import detectors as D
from ..operators import flows as L
from ..operators import folds as S
from ..operators import reports as R
from ..sources import tables as T
from ..sources.captures import capture_filter, read_packet_stream, read_packets
from ..sources.tables import shared_folder, stored, upsert_latest
from .adapter import PACKETS_SQL, packets
from .packets import PACKET_SCHEMA

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
_PACKETS = PACKETS_SQL.replace("{events}", "events")
NOW = 1704067700.0


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = f"WITH RECURSIVE p AS ({_PACKETS}),\n{_CTE}\n{sql}"
        return f

    return keep


_KEYS = "coalesce(src, '') AS s, coalesce(sport, 0) AS sp, coalesce(dst, '') AS d, coalesce(dport, 0) AS dp"
#: Shared steps of the SQL texts; the order of packet_id is that of ts.
_CTE = f"""
k AS (SELECT *, {_KEYS}, proto = 'TCP' AND flags LIKE '%S%' AND flags NOT LIKE '%A%' AND coalesce(src, '') <> '' AND coalesce(dst, '') <> '' AND dport IS NOT NULL AS is_syn FROM p),
e AS (SELECT *, least(struct_pack(ip := s, port := sp), struct_pack(ip := d, port := dp)) AS ep1, greatest(struct_pack(ip := s, port := sp), struct_pack(ip := d, port := dp)) AS ep2 FROM k),
n AS (SELECT *, concat('((''', ep1.ip, ''', ', ep1.port, '), (''', ep2.ip, ''', ', ep2.port, '), ''', proto, ''')') AS flow_key,
        CASE WHEN proto = 'TCP' THEN coalesce(flags, '') ELSE '' END AS f,
        first_value(s) OVER w AS is_, first_value(sp) OVER w AS isp, first_value(d) OVER w AS id_, first_value(dp) OVER w AS idp FROM e
      WINDOW w AS (PARTITION BY ep1, ep2, proto ORDER BY packet_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
w AS (SELECT *, s = is_ AND sp = isp AS fwd FROM n),
m AS (SELECT flow_key, proto, is_ AS initiator_ip, any_value(isp) AS isp, any_value(id_) AS responder_ip, any_value(idp) AS idp, min(ts) AS start_ts, max(ts) AS last_seen_ts,
        CAST(count(*) FILTER (WHERE fwd) AS BIGINT) AS packets_forward, CAST(coalesce(sum(size) FILTER (WHERE fwd), 0) AS BIGINT) AS bytes_forward,
        CAST(count(*) FILTER (WHERE NOT fwd) AS BIGINT) AS packets_reverse, CAST(coalesce(sum(size) FILTER (WHERE NOT fwd), 0) AS BIGINT) AS bytes_reverse,
        max(packet_id) FILTER (WHERE f LIKE '%R%') AS r, max(packet_id) FILTER (WHERE f LIKE '%F%' AND f NOT LIKE '%R%') AS fi,
        count(DISTINCT fwd) FILTER (WHERE f LIKE '%F%' AND f NOT LIKE '%R%') AS sides,
        min(packet_id) FILTER (WHERE f LIKE '%S%' AND f NOT LIKE '%A%') AS sy, min(packet_id) FILTER (WHERE f LIKE '%A%') AS ak,
        max(packet_id) FILTER (WHERE f LIKE '%A%' AND fwd) AS fa, max(packet_id) FILTER (WHERE f LIKE '%A%' AND f LIKE '%S%' AND NOT fwd) AS rsa
      FROM w GROUP BY flow_key, proto, is_),
flows AS (SELECT *, packets_forward + packets_reverse AS total_packets, bytes_forward + bytes_reverse AS total_bytes,
        CASE WHEN proto <> 'TCP' THEN 'NONE' WHEN r IS NOT NULL AND (fi IS NULL OR r > fi) THEN 'RESET' WHEN fi IS NOT NULL AND sides = 2 THEN 'CLOSED' WHEN fi IS NOT NULL THEN 'FIN_WAIT'
          WHEN sy IS NULL AND ak IS NULL THEN 'NONE' WHEN sy IS NULL OR ak < sy OR fa > sy THEN 'ESTABLISHED' WHEN rsa > sy THEN 'SYN_RECEIVED' ELSE 'SYN_SENT' END AS tcp_state FROM m),
dq AS (SELECT packet_id, ts, src, dst, dns_qtype, lower(dns_qname) AS qname, string_split(trim(lower(dns_qname), '.'), '.') AS labels FROM p WHERE coalesce(dns_qname, '') <> '' AND coalesce(src, '') <> ''),
dd AS (SELECT *, CASE WHEN len(labels) > 2 THEN array_to_string(labels[1:len(labels) - 2], '.') ELSE '' END AS subdomain,
        CASE WHEN len(labels) > 2 THEN array_to_string(labels[len(labels) - 1:], '.') ELSE array_to_string(labels, '.') END AS parent FROM dq),
ch AS (SELECT subdomain, c, count(*) AS n FROM (SELECT subdomain, unnest(string_split(subdomain, '')) AS c FROM (SELECT DISTINCT subdomain FROM dd)) GROUP BY 1, 2),
en AS (SELECT subdomain, -sum(n * 1.0 / length(subdomain) * log2(n * 1.0 / length(subdomain))) AS entropy FROM ch WHERE c <> '' GROUP BY subdomain),
bu AS (SELECT a.packet_id, count(DISTINCT b.subdomain) FILTER (WHERE b.subdomain <> '') AS burst FROM dd a JOIN dd b ON a.src = b.src AND a.parent = b.parent AND b.packet_id <= a.packet_id AND b.ts >= a.ts - 15 GROUP BY a.packet_id),
dns AS (SELECT dd.*, coalesce(entropy, 0) AS entropy, coalesce(burst, 0) AS burst,
        CAST((CASE WHEN length(qname) >= 50 THEN 1 ELSE 0 END) + (CASE WHEN coalesce(entropy, 0) >= 3.5 AND length(subdomain) >= 10 THEN 2 ELSE 0 END) + (CASE WHEN dns_qtype IN (10, 16) THEN 1 ELSE 0 END) + (CASE WHEN burst >= 15 THEN 2 ELSE 0 END) AS BIGINT) AS score
      FROM dd LEFT JOIN en USING (subdomain) JOIN bu USING (packet_id)),
da AS (SELECT packet_id, ts, 'dns_tunnel' AS alert_type, CASE WHEN score >= 5 THEN 'high' ELSE 'medium' END AS severity, src, dst FROM dns WHERE score >= 3),
ac AS (SELECT packet_id, ts, dst, src AS ip, lower(coalesce(nullif(arp_hwsrc, ''), flags)) AS mac FROM p WHERE proto = 'ARP'),
al AS (SELECT *, lag(mac) OVER (PARTITION BY ip ORDER BY packet_id) AS original_mac FROM ac),
mv AS (SELECT mac, packet_id, CASE WHEN original_mac IS NULL OR original_mac <> mac THEN 1 ELSE 0 END AS delta, 1 AS claim FROM al UNION ALL SELECT original_mac, packet_id, -1, 0 FROM al WHERE original_mac <> mac),
hd AS (SELECT packet_id, claim, sum(delta) OVER (PARTITION BY mac ORDER BY packet_id, claim ROWS UNBOUNDED PRECEDING) AS held FROM mv),
ah AS (SELECT al.*, CAST(held AS BIGINT) AS held, coalesce(original_mac <> mac, false) AS conflict FROM al JOIN hd ON al.packet_id = hd.packet_id AND claim = 1),
aa AS (SELECT packet_id, ts, 'arp_spoof' AS alert_type, 'high' AS severity, ip AS src, CASE WHEN conflict THEN dst END AS dst FROM ah WHERE conflict OR held > 3),
sy AS (SELECT packet_id, ts, src, dst, dport, row_number() OVER (PARTITION BY src ORDER BY packet_id) AS rn FROM e WHERE is_syn),
sc AS (SELECT packet_id, ts, src, rn, [struct_pack(ts := ts, t := concat(dst, ':', dport))] AS q, false AS fired FROM sy WHERE rn = 1
       UNION ALL SELECT packet_id, ts, src, rn, q, len(list_distinct(list_transform(q, lambda x: x.t))) >= 15 FROM (
         SELECT sy.packet_id, sy.ts, sy.src, sy.rn, list_filter(list_append(CASE WHEN sc.fired THEN [] ELSE sc.q END, struct_pack(ts := sy.ts, t := concat(sy.dst, ':', sy.dport))), lambda x: x.ts >= sy.ts - 10) AS q
         FROM sc JOIN sy ON sy.src = sc.src AND sy.rn = sc.rn + 1)),
sa AS (SELECT packet_id, ts, src, CAST(len(list_distinct(list_transform(q, lambda x: x.t))) AS BIGINT) AS unique_targets,
        CAST(len(list_distinct(list_transform(q, lambda x: split_part(x.t, ':', 1)))) AS BIGINT) AS unique_hosts, CAST(len(list_distinct(list_transform(q, lambda x: split_part(x.t, ':', 2)))) AS BIGINT) AS unique_ports, split_part(q[1].t, ':', 1) AS host FROM sc WHERE fired),
fs AS (SELECT packet_id, ts, src, dst, concat(ep1.ip, ':', ep1.port, '-', ep2.ip, ':', ep2.port) AS pair, row_number() OVER (PARTITION BY dst ORDER BY packet_id) AS rn FROM e WHERE is_syn AND sp <> 0 AND dp <> 0),
fk AS (SELECT packet_id, ts, s, d, concat(ep1.ip, ':', ep1.port, '-', ep2.ip, ':', ep2.port) AS pair FROM e WHERE proto = 'TCP' AND flags LIKE '%A%' AND sp <> 0 AND dp <> 0),
fd AS (SELECT fs.packet_id, list_distinct(list(fk.pair)) AS done FROM fs JOIN fk ON fk.packet_id < fs.packet_id AND fk.ts >= fs.ts - 5 AND (fk.s = fs.dst OR fk.d = fs.dst) GROUP BY fs.packet_id),
fe AS (SELECT fs.*, coalesce(done, []) AS done FROM fs LEFT JOIN fd USING (packet_id)),
ff AS (SELECT packet_id, ts, dst, rn, [struct_pack(ts := ts, p := pair, s := src)] AS q, 0 AS open, false AS fired FROM fe WHERE rn = 1
       UNION ALL SELECT packet_id, ts, dst, rn, q, open, len(q) >= 40 AND open * 1.0 / len(q) >= 0.8 FROM (SELECT *, len(list_filter(q, lambda x: NOT list_contains(done, x.p))) AS open FROM (
         SELECT fe.packet_id, fe.ts, fe.dst, fe.rn, fe.done, list_filter(list_append(CASE WHEN ff.fired THEN [] ELSE ff.q END, struct_pack(ts := fe.ts, p := fe.pair, s := fe.src)), lambda x: x.ts >= fe.ts - 5) AS q
         FROM ff JOIN fe ON fe.dst = ff.dst AND fe.rn = ff.rn + 1))),
fa AS (SELECT packet_id, ts, dst, CAST(open AS BIGINT) AS half_open_count, CAST(len(q) AS BIGINT) AS window_syn_count, CAST(len(list_distinct(list_transform(q, lambda x: x.s))) AS BIGINT) AS unique_attackers, q[1].s AS attacker FROM ff WHERE fired),
alerts AS (SELECT packet_id, ts, 'port_scan' AS alert_type, 'medium' AS severity FROM sa UNION ALL SELECT packet_id, ts, 'syn_flood', 'critical' FROM fa UNION ALL SELECT packet_id, ts, alert_type, severity FROM da UNION ALL SELECT packet_id, ts, alert_type, severity FROM aa),
dr AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY packet_id) AS rn FROM da),
dc AS (SELECT packet_id, src, dst, rn, ts AS last, 0 AS held, true AS emit, 0 AS said FROM dr WHERE rn = 1
       UNION ALL SELECT dr.packet_id, dr.src, dr.dst, dr.rn, CASE WHEN dr.ts - last >= 60 THEN dr.ts ELSE last END, CASE WHEN dr.ts - last >= 60 THEN 0 ELSE held + 1 END, dr.ts - last >= 60, CASE WHEN dr.ts - last >= 60 THEN held ELSE 0 END
       FROM dc JOIN dr ON dr.src = dc.src AND dr.dst = dc.dst AND dr.rn = dc.rn + 1),
xa AS (SELECT packet_id, ts, 'port_scan' AS alert_type, src, CASE WHEN unique_hosts = 1 THEN host END AS dst FROM sa UNION ALL SELECT packet_id, ts, 'syn_flood', CASE WHEN unique_attackers = 1 THEN attacker END, dst FROM fa
       UNION ALL SELECT packet_id, ts, alert_type, src, dst FROM da UNION ALL SELECT packet_id, ts, alert_type, src, dst FROM aa),
xr AS (SELECT *, concat_ws('|', alert_type, coalesce(src, '-'), coalesce(dst, '-')) AS k, row_number() OVER (PARTITION BY alert_type, src, dst ORDER BY packet_id) AS rn FROM xa),
xc AS (SELECT packet_id, alert_type, k, rn, ts AS last, 0 AS held, true AS emit, 0 AS said FROM xr WHERE rn = 1
       UNION ALL SELECT xr.packet_id, xr.alert_type, xr.k, xr.rn, CASE WHEN xr.ts - last >= 60 THEN xr.ts ELSE last END, CASE WHEN xr.ts - last >= 60 THEN 0 ELSE held + 1 END, xr.ts - last >= 60, CASE WHEN xr.ts - last >= 60 THEN held ELSE 0 END
       FROM xc JOIN xr ON xr.k = xc.k AND xr.rn = xc.rn + 1),
sp AS (SELECT packet_id, ts, src, rn, [struct_pack(ts := ts, t := concat(dst, ':', dport))] AS q, false AS fast, ts AS first, ts AS last, CAST(1 AS DOUBLE) AS rate, [concat(dst, ':', dport)] AS seen, false AS slow, CAST(0 AS DOUBLE) AS elapsed FROM sy WHERE rn = 1
       UNION ALL SELECT packet_id, ts, src, rn, q, fast, CASE WHEN fast THEN was WHEN was IS NULL THEN ts ELSE was END, CASE WHEN fast THEN last ELSE ts END, CASE WHEN fast THEN rate WHEN was IS NULL THEN 1 ELSE rate + 0.2E0 * (1.0E0 / greatest(0.001E0, ts - last) - rate) END,
         CASE WHEN fast THEN seen WHEN was IS NULL THEN [t] ELSE list_distinct(list_append(seen, t)) END, NOT fast AND was IS NOT NULL AND ts - was > 10 AND len(list_distinct(list_append(seen, t))) >= 20, CASE WHEN fast OR was IS NULL THEN 0 ELSE ts - was END FROM (
         SELECT *, len(list_distinct(list_transform(q, lambda x: x.t))) >= 15 AS fast FROM (
           SELECT sy.packet_id, sy.ts, sy.src, sy.rn, concat(sy.dst, ':', sy.dport) AS t, list_filter(list_append(CASE WHEN sp.fast THEN [] ELSE sp.q END, struct_pack(ts := sy.ts, t := concat(sy.dst, ':', sy.dport))), lambda x: x.ts >= sy.ts - 10) AS q,
             CASE WHEN sp.slow OR sp.elapsed > 300 THEN NULL ELSE sp.first END AS was, sp.last, sp.rate, sp.seen FROM sp JOIN sy ON sy.src = sp.src AND sy.rn = sp.rn + 1))),
fr AS (SELECT packet_id, ts, flow_key, f, s, sp, size, row_number() OVER (PARTITION BY flow_key ORDER BY packet_id) AS rn FROM n),
se AS (SELECT packet_id, ts, flow_key, rn, size, 0 AS session_no, s AS i, sp AS ip, true AS fwd, f LIKE '%F%' AND f NOT LIKE '%R%' AS fin1, false AS fin2,
         CASE WHEN f LIKE '%R%' THEN 'RESET' WHEN f LIKE '%F%' THEN 'FIN_WAIT' WHEN f LIKE '%S%' AND f NOT LIKE '%A%' THEN 'SYN_SENT' WHEN f LIKE '%A%' AND f NOT LIKE '%S%' OR f LIKE '%A%' THEN 'ESTABLISHED' ELSE 'NONE' END AS state FROM fr WHERE rn = 1
       UNION ALL SELECT packet_id, ts, flow_key, rn, size, session_no, i, ip, fwd, fin1, fin2,
         CASE WHEN f LIKE '%R%' THEN 'RESET' WHEN f LIKE '%F%' THEN CASE WHEN fin1 AND fin2 THEN 'CLOSED' ELSE 'FIN_WAIT' END WHEN was NOT IN ('NONE', 'SYN_SENT', 'SYN_RECEIVED') THEN was
           WHEN f LIKE '%S%' AND f NOT LIKE '%A%' THEN CASE WHEN was = 'NONE' THEN 'SYN_SENT' ELSE was END WHEN f LIKE '%S%' AND f LIKE '%A%' AND NOT fwd AND was = 'SYN_SENT' THEN 'SYN_RECEIVED' WHEN f LIKE '%A%' AND (fwd OR was = 'NONE') THEN 'ESTABLISHED' ELSE was END FROM (
         SELECT *, (NOT cut AND f1) OR (f LIKE '%F%' AND f NOT LIKE '%R%' AND fwd) AS fin1, (NOT cut AND f2) OR (f LIKE '%F%' AND f NOT LIKE '%R%' AND NOT fwd) AS fin2 FROM (
           SELECT *, s = i AND sp = ip AS fwd FROM (
             SELECT fr.packet_id, fr.ts, fr.flow_key, fr.rn, fr.size, fr.f, fr.s, fr.sp, cut, se.session_no + CAST(cut AS INT) AS session_no, CASE WHEN cut THEN fr.s ELSE se.i END AS i, CASE WHEN cut THEN fr.sp ELSE se.ip END AS ip, se.fin1 AS f1, se.fin2 AS f2, CASE WHEN cut THEN 'NONE' ELSE se.state END AS was
             FROM se JOIN fr ON fr.flow_key = se.flow_key AND fr.rn = se.rn + 1, LATERAL (SELECT fr.ts - se.ts > 300 OR fr.ts - se.ts > 60 AND se.state <> 'ESTABLISHED' AS cut) c)))),
ss AS (SELECT flow_key, CAST(session_no AS BIGINT) AS session_no, any_value(i) AS initiator_ip, min(ts) AS start_ts, max(ts) AS last_seen_ts, CAST(count(*) FILTER (WHERE fwd) AS BIGINT) AS packets_forward, CAST(coalesce(sum(size) FILTER (WHERE fwd), 0) AS BIGINT) AS bytes_forward,
        CAST(count(*) FILTER (WHERE NOT fwd) AS BIGINT) AS packets_reverse, CAST(coalesce(sum(size) FILTER (WHERE NOT fwd), 0) AS BIGINT) AS bytes_reverse, arg_max(state, rn) AS tcp_state FROM se GROUP BY 1, 2),
cm AS (SELECT g.r AS row, CAST('0x' || substr(md5(concat('seed_', g.r, '|', src)), 1, 8) AS BIGINT) % 2048 AS col, src, n FROM (SELECT src, count(*) AS n FROM p WHERE src IS NOT NULL GROUP BY src), (SELECT unnest([0, 1, 2, 3]) AS r) g),
cs AS (SELECT row, col, CAST(sum(n) AS BIGINT) AS cnt FROM cm GROUP BY 1, 2)
"""


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.aggregate_flows(packets(spark, sf_dir))


def alerts(spark: SparkSession, sf_dir: str, p: DataFrame | None = None) -> DataFrame:
    """The alerts of all detectors over a stored packets table, stored themselves: both are read more than once."""
    return stored(D.Registry().run(p or stored(packets(spark, sf_dir), "packets")), "alerts")


_COLUMNS = [c.split()[0] for c in PACKET_SCHEMA.split(", ")]


def packet_folder(spark: SparkSession, sf_dir: str, *more: DataFrame) -> str:
    """A packets table as a user has it, in a new folder; more: rows to add."""
    path = f"{shared_folder(spark)}/packets-{uuid.uuid4().hex}"
    reduce(DataFrame.unionByName, [x.select(*_COLUMNS) for x in (packets(spark, sf_dir), *more)]).write.parquet(path)
    return path


@query("src3_packets", "SELECT packet_id, ts, src, dst, proto, sport, dport, flags, size FROM p")
def _(spark, d):
    return read_packets(spark, packet_folder(spark, d)).select("packet_id", "ts", "src", "dst", "proto", "sport", "dport", "flags", "size")


@query("flt1_capture_filter", "SELECT proto, CAST(count(*) AS BIGINT) AS n FROM p WHERE proto IN ('TCP', 'UDP', 'ARP') GROUP BY proto")
def _(spark, d):
    return capture_filter(packets(spark, d)).groupBy("proto").agg(F.count("*").alias("n"))


for _name, _test, _sql in (
    ("flt2_pure_syn", X.pure_syn, "is_syn"),
    ("flt3_syn_with_ports", X.syn_with_ports, "is_syn AND sp <> 0 AND dp <> 0"),
    ("flt4_ack_packets", X.ack_packets, "proto = 'TCP' AND flags LIKE '%A%' AND s <> '' AND d <> '' AND sp <> 0 AND dp <> 0"),
    ("flt5_dns_queries", X.dns_queries, "coalesce(dns_qname, '') <> '' AND s <> ''"),
):
    query(_name, f"SELECT packet_id, src, dst FROM e WHERE {_sql}")(lambda spark, d, t=_test: packets(spark, d).where(t()).select("packet_id", "src", "dst"))


@query("flt6_arp_claims", "SELECT packet_id, ip, mac FROM ac")
def _(spark, d):
    return D.arp_claims(packets(spark, d)).select("packet_id", "ip", "mac")


@query("prj1_flow_direction", "SELECT packet_id, fwd AS forward FROM w")
def _(spark, d):
    return L.flow_direction(packets(spark, d)).select("packet_id", "forward")


@query("prj2_protocol_bucket", "SELECT CASE WHEN proto IN ('TCP', 'UDP', 'ARP') THEN proto ELSE 'OTHER' END AS bucket, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY 1")
def _(spark, d):
    return packets(spark, d).groupBy(X.protocol_bucket(F.col("proto")).alias("bucket")).agg(F.count("*").alias("n"))


_FLOW = "flow_key, proto, initiator_ip, responder_ip, start_ts, last_seen_ts, packets_forward, bytes_forward, packets_reverse, bytes_reverse, total_packets, total_bytes, tcp_state"


@query("agg1_flows", f"SELECT {_FLOW} FROM flows")
def _(spark, d):
    return flows(spark, d).select(*_FLOW.split(", "))


@query("agg2_tcp_state", "SELECT tcp_state, CAST(count(*) AS BIGINT) AS n FROM flows GROUP BY 1")
def _(spark, d):
    return flows(spark, d).groupBy("tcp_state").agg(F.count("*").alias("n"))


@query("prj3_flow_summary", "SELECT flow_key, initiator_ip AS src, responder_ip AS dst, proto, total_packets, total_bytes, tcp_state FROM flows")
def _(spark, d):
    return L.flow_summary(flows(spark, d)).select("flow_key", "src", "dst", "proto", "total_packets", "total_bytes", "tcp_state")


_IDLE = f"{NOW}E0 - last_seen_ts > CASE WHEN tcp_state = 'ESTABLISHED' THEN 300 ELSE 60 END"


@query("flt8_idle_flows", f"SELECT flow_key FROM flows WHERE {_IDLE}")
def _(spark, d):
    return flows(spark, d).where(L.idle(NOW)).select("flow_key")


@query("agg0_active_flows", f"SELECT CAST(count(*) AS BIGINT) AS active FROM flows WHERE NOT ({_IDLE})")
def _(spark, d):
    return flows(spark, d).where(~L.idle(NOW)).agg(F.count("*").alias("active"))


_TALKERS = "SELECT initiator_ip AS ip, CAST(sum(total_bytes) AS BIGINT) AS bytes_sent, CAST(sum(total_packets) AS BIGINT) AS packets_sent FROM flows GROUP BY 1 ORDER BY 2 DESC, 1"


@query("agg3_top_talkers", f"{_TALKERS} LIMIT 10")
def _(spark, d):
    return L.top_talkers(flows(spark, d))


@query("agg4_protocol_distribution", "SELECT proto, CAST(sum(total_packets) AS BIGINT) AS packets FROM flows GROUP BY 1")
def _(spark, d):
    return L.protocol_distribution(flows(spark, d))


_MINUTE = """SELECT minute_ts, total_packets, total_bytes, tcp_count, udp_count, arp_count, other_count, coalesce(n, 0) AS alerts_count FROM (
SELECT CAST(floor(ts / 60) * 60 AS DOUBLE) AS minute_ts, CAST(count(*) AS BIGINT) AS total_packets, CAST(sum(size) AS BIGINT) AS total_bytes, CAST(count(*) FILTER (WHERE proto = 'TCP') AS BIGINT) AS tcp_count,
CAST(count(*) FILTER (WHERE proto = 'UDP') AS BIGINT) AS udp_count, CAST(count(*) FILTER (WHERE proto = 'ARP') AS BIGINT) AS arp_count, CAST(count(*) FILTER (WHERE proto NOT IN ('TCP', 'UDP', 'ARP')) AS BIGINT) AS other_count FROM p GROUP BY 1)
LEFT JOIN (SELECT CAST(floor(ts / 60) * 60 AS DOUBLE) AS minute_ts, CAST(count(*) AS BIGINT) AS n FROM alerts GROUP BY 1) USING (minute_ts)"""


@query("agg7_minute_stats", _MINUTE)
def _(spark, d):
    p = stored(packets(spark, d), "packets")
    return L.minute_stats(p, alerts(spark, d, p))


@query("jn3_minute_packets_alerts", """SELECT minute_ts, alert_type, total_packets, n FROM (SELECT CAST(floor(ts / 60) * 60 AS DOUBLE) AS minute_ts, CAST(count(*) AS BIGINT) AS total_packets FROM p GROUP BY 1)
JOIN (SELECT CAST(floor(ts / 60) * 60 AS DOUBLE) AS minute_ts, alert_type, CAST(count(*) AS BIGINT) AS n FROM alerts GROUP BY 1, 2) USING (minute_ts)""")
def _(spark, d):
    p = stored(packets(spark, d), "packets")
    minutes = p.groupBy(X.minute_bucket(F.col("ts")).alias("minute_ts")).agg(F.count("*").alias("total_packets"))
    return alerts(spark, d, p).groupBy(X.minute_bucket(F.col("ts")).alias("minute_ts"), "alert_type").agg(F.count("*").alias("n")).join(minutes, "minute_ts")


@query("srt3_recent_minutes", _MINUTE + " ORDER BY minute_ts DESC LIMIT 60")
def _(spark, d):
    return QUERIES["agg7_minute_stats"](spark, d).orderBy(F.desc("minute_ts")).limit(60)


@query("win1_scan_window", "SELECT a.packet_id, a.src, CAST(count(DISTINCT concat(b.dst, ':', b.dport)) AS BIGINT) AS targets FROM sy a JOIN sy b ON a.src = b.src AND b.packet_id <= a.packet_id AND b.ts >= a.ts - 10 GROUP BY 1, 2")
def _(spark, d):
    return R.scan_window(packets(spark, d))


@query("win2_flood_window", "SELECT packet_id, dst, CAST(count(*) OVER (PARTITION BY dst ORDER BY ts RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS BIGINT) AS syns FROM fs")
def _(spark, d):
    return R.flood_window(packets(spark, d))


@query("win3_dns_burst", "SELECT packet_id, CAST(burst AS BIGINT) AS burst FROM dns")
def _(spark, d):
    return D.dns_scores(packets(spark, d)).select("packet_id", "burst")


@query("win4_arp_conflict", "SELECT packet_id, ip, mac, original_mac FROM al WHERE original_mac <> mac")
def _(spark, d):
    return D.arp_conflicts(packets(spark, d)).where("conflict").select("packet_id", "ip", "mac", "original_mac")


@query("win5_arp_multi_ip", "SELECT packet_id, mac, held FROM ah WHERE NOT conflict AND held > 3")
def _(spark, d):
    return D.arp_holdings(packets(spark, d)).where("not conflict and held > 3").select("packet_id", "mac", "held")


@query("win6_syn_volume", "SELECT packet_id, src, rn AS volume FROM sy")
def _(spark, d):
    return R.syn_volume(packets(spark, d))


@query("win7_ewma_rate", """, ew AS (SELECT src, rn, ts, CAST(1 AS DOUBLE) AS rate FROM sy WHERE rn = 1 UNION ALL SELECT sy.src, sy.rn, sy.ts, 0.2E0 / greatest(0.001E0, sy.ts - ew.ts) + 0.8E0 * ew.rate FROM ew JOIN sy ON sy.src = ew.src AND sy.rn = ew.rn + 1)
SELECT src, round(rate, 6) AS rate FROM (SELECT *, max(rn) OVER (PARTITION BY src) AS last FROM ew) WHERE rn = last AND last > 1""")
def _(spark, d):
    return R.ewma_rate(packets(spark, d)).select("src", F.round("rate", 6).alias("rate"))


@query("win8_interarrival", "SELECT packet_id, src, round(ts - lag(ts) OVER (PARTITION BY src ORDER BY packet_id), 6) AS dt FROM p")
def _(spark, d):
    return R.interarrival(packets(spark, d)).withColumn("dt", F.round("dt", 6))


_TYPE = "CASE WHEN {h} = 1 AND {p} > 1 THEN 'vertical' WHEN {h} > 1 AND {p} = 1 THEN 'horizontal' ELSE 'distributed/hybrid' END AS scan_type"


@query("agg8_scan_targets", "SELECT *, " + _TYPE.format(h="hosts", p="ports") + " FROM (SELECT src, CAST(count(DISTINCT concat(dst, ':', dport)) AS BIGINT) AS targets, CAST(count(DISTINCT dst) AS BIGINT) AS hosts, CAST(count(DISTINCT dport) AS BIGINT) AS ports FROM sy GROUP BY src)")
def _(spark, d):
    return R.scan_targets(packets(spark, d))


_HALF = "SELECT fs.*, CAST(floor(fs.ts / 5) AS BIGINT) AS win, EXISTS (SELECT 1 FROM fk WHERE fk.pair = fs.pair AND floor(fk.ts / 5) = floor(fs.ts / 5)) AS complete FROM fs"


@query("jn1_half_open_syns", f"SELECT packet_id, src, dst, win, complete FROM ({_HALF})")
def _(spark, d):
    return R.half_open_syns(packets(spark, d))


@query("jn1_syn_completions", """SELECT packet_id, src, dst, round(acked, 6) AS acked_ts, acked IS NOT NULL AS complete
FROM (SELECT fs.packet_id, fs.src, fs.dst, max(fk.ts) AS acked FROM fs LEFT JOIN fk ON fk.pair = fs.pair AND fk.packet_id < fs.packet_id AND fk.ts >= fs.ts - 5 GROUP BY 1, 2, 3)""")
def _(spark, d):
    """As of each opened connection: the pair's last acknowledgement at or after now - 5 s."""
    return R.syn_completions(packets(spark, d)).select("packet_id", "src", "dst", F.round("acked_ts", 6).alias("acked_ts"), "complete")


@query("agg14_flood_sources", f"SELECT dst, win, CAST(count(*) AS BIGINT) AS syns, CAST(count(*) FILTER (WHERE NOT complete) AS BIGINT) AS half_open, CAST(count(DISTINCT src) AS BIGINT) AS attackers, round(count(*) FILTER (WHERE NOT complete) * 1.0E0 / count(*), 6) AS ratio FROM ({_HALF}) GROUP BY 1, 2")
def _(spark, d):
    return R.flood_sources(packets(spark, d)).withColumn("ratio", F.round("ratio", 6))


@query("det1_port_scan", "SELECT packet_id, src, unique_targets, unique_ports, unique_hosts, " + _TYPE.format(h="unique_hosts", p="unique_ports") + " FROM sa")
def _(spark, d):
    return D.scan_events(packets(spark, d)).select("packet_id", "src", "unique_targets", "unique_ports", "unique_hosts", "scan_type")


@query("det1_slow_scan")
def _(spark, d):
    return D.detect_port_scan(packets(spark, d), threshold=15, ewma=True)


@query("det1_both_paths", """SELECT packet_id, src, 'low_and_slow' AS scan_type, CAST(len(seen) AS BIGINT) AS unique_targets, round(elapsed, 1) AS elapsed, round(rate, 4) AS ewma_rate, rn AS cms_estimated_volume FROM sp WHERE slow
UNION ALL SELECT packet_id, src, CASE WHEN hosts = 1 AND ports > 1 THEN 'vertical' WHEN hosts > 1 AND ports = 1 THEN 'horizontal' ELSE 'distributed/hybrid' END, CAST(n AS BIGINT), NULL, NULL, rn FROM (SELECT *, len(list_distinct(list_transform(q, lambda x: x.t))) AS n,
len(list_distinct(list_transform(q, lambda x: split_part(x.t, ':', 1)))) AS hosts, len(list_distinct(list_transform(q, lambda x: split_part(x.t, ':', 2)))) AS ports FROM sp WHERE fast)""")
def _(spark, d):
    return D.scan_events(packets(spark, d), ewma=True).select("packet_id", "src", "scan_type", "unique_targets", "elapsed", "ewma_rate", "cms_estimated_volume")


@query("det2_syn_flood", "SELECT packet_id, dst, half_open_count, window_syn_count, unique_attackers FROM fa")
def _(spark, d):
    return D.flood_events(stored(packets(spark, d), "packets")).select("packet_id", "dst", "half_open_count", "window_syn_count", "unique_attackers")


@query("det3_dns_tunnel", "SELECT packet_id, src, qname, subdomain, parent, round(entropy, 6) AS entropy, score, CASE WHEN score >= 5 THEN 'high' ELSE 'medium' END AS severity FROM dns WHERE score >= 3")
def _(spark, d):
    e = D.dns_scores(packets(spark, d)).where("score >= 3")
    return e.select("packet_id", "src", "qname", "subdomain", "parent", F.round("entropy", 6).alias("entropy"), "score", F.when(F.col("score") >= 5, "high").otherwise("medium").alias("severity"))


@query("det4_arp_spoof", "SELECT packet_id, severity, src, dst FROM aa")
def _(spark, d):
    return D.detect_arp_spoof(packets(spark, d)).select("packet_id", "severity", "src", "dst")


@query("jn2_arp_claimed_ips", """SELECT a.packet_id, array_to_string(list_sort(list(m.ip)), ',') AS claimed FROM (SELECT * FROM ah WHERE NOT conflict AND held > 3) a
JOIN (SELECT mac, ip, packet_id AS b, lead(packet_id) OVER (PARTITION BY ip ORDER BY packet_id) AS z FROM al WHERE original_mac IS NULL OR original_mac <> mac) m ON m.mac = a.mac AND m.b <= a.packet_id AND (z IS NULL OR a.packet_id < z) GROUP BY 1""")
def _(spark, d):
    claims = stored(D.arp_conflicts(packets(spark, d)), "claims")
    events = stored(D.held_at(claims).where("not conflict and held > 3"), "events")
    return D.claimed_ips(claims, events).select("packet_id", F.array_join("claimed_ips", ",").alias("claimed"))


@query("det5_run_detectors", "SELECT alert_type, severity, CAST(count(*) AS BIGINT) AS n FROM alerts GROUP BY 1, 2")
def _(spark, d):
    return alerts(spark, d).groupBy("alert_type", "severity").agg(F.count("*").alias("n"))


@query("set1_union_alerts", "SELECT packet_id, ts, alert_type, severity FROM alerts")
def _(spark, d):
    return alerts(spark, d).select("packet_id", "ts", "alert_type", "severity")


@query("ext1_registry", "SELECT alert_type, severity, CAST(count(*) AS BIGINT) AS n FROM (SELECT alert_type, severity FROM aa UNION ALL SELECT 'reset', 'low' FROM p WHERE proto = 'TCP' AND flags LIKE '%R%') GROUP BY 1, 2")
def _(spark, d):
    """The address detector, and one that a user adds: connections that were reset."""
    reset = lambda p: p.where((F.col("proto") == "TCP") & F.col("flags").contains("R")).select(
        X.alert_id(F.lit("reset"), F.col("packet_id")).alias("id"), "ts", F.lit("reset").alias("alert_type"), F.lit("low").alias("severity"), "src", "dst",
        F.concat_ws(" ", F.lit("reset by"), "src").alias("description"), X.evidence_json(dport=F.col("dport")).alias("evidence_json"), "packet_id",
    )
    registry = D.Registry()
    registry.enabled = {name: name == "arp_spoof" for name in registry.enabled}
    registry.register("reset", reset)
    return registry.run(packets(spark, d)).groupBy("alert_type", "severity").agg(F.count("*").alias("n"))


@query("det6_dedup_alerts", "SELECT packet_id, CAST(said AS BIGINT) AS suppressed FROM dc WHERE emit")
def _(spark, d):
    return S.dedup_alerts(stored(D.detect_dns_tunnel(packets(spark, d)), "alerts")).select("packet_id", "suppressed")


@query("det6_dedup_all", "SELECT alert_type, packet_id, CAST(said AS BIGINT) AS suppressed FROM xc WHERE emit")
def _(spark, d):
    return S.dedup_alerts(alerts(spark, d)).select("alert_type", "packet_id", "suppressed")


@query("det7_sessionize_flows")
def _(spark, d):
    return L.aggregate_flows(S.sessionize(packets(spark, d)), ("session_no",))


_SESSION = ["flow_key", "initiator_ip", "start_ts", "last_seen_ts", "packets_forward", "bytes_forward", "packets_reverse", "bytes_reverse", "tcp_state"]


@query("det7_flow_sessions", f"SELECT session_no, {', '.join(_SESSION)} FROM ss")
def _(spark, d):
    return QUERIES["det7_sessionize_flows"](spark, d).select("session_no", *_SESSION)


@query("set2_distinct_endpoints", "SELECT DISTINCT dst, dport FROM p WHERE dport IS NOT NULL")
def _(spark, d):
    return packets(spark, d).where("dport is not null").select("dst", "dport").distinct()


@query("flt7_query_alerts", "SELECT packet_id, ts FROM alerts WHERE alert_type = 'dns_tunnel' AND severity = 'high' ORDER BY ts DESC LIMIT 100")
def _(spark, d):
    return R.query_alerts(alerts(spark, d), "dns_tunnel", "high", 0.0).select("packet_id", "ts")


@query("srt1_recent_alerts", "SELECT packet_id, ts, alert_type FROM alerts ORDER BY ts DESC LIMIT 50")
def _(spark, d):
    return R.query_alerts(alerts(spark, d), limit=50).select("packet_id", "ts", "alert_type")


@query("srt2_top_talkers", "SELECT place, ip, bytes_sent FROM (SELECT CAST(row_number() OVER (ORDER BY bytes_sent DESC, ip) AS BIGINT) AS place, ip, bytes_sent FROM (" + _TALKERS + ")) WHERE place <= 25")
def _(spark, d):
    top = L.top_talkers(flows(spark, d), 25)
    return top.select(F.row_number().over(Window.orderBy(F.desc("bytes_sent"), "ip")).cast("long").alias("place"), "ip", "bytes_sent")  # 25 rows


@query("srt4_time_order", "SELECT packet_id, src, CAST(row_number() OVER (PARTITION BY src ORDER BY ts, packet_id) AS BIGINT) AS place FROM p")
def _(spark, d):
    return R.time_order(packets(spark, d))


_SUMMARY = """SELECT 'total' AS scope, 'all' AS name, CAST(count(*) AS BIGINT) AS n FROM alerts UNION ALL SELECT 'severity', v, CAST((SELECT count(*) FROM alerts WHERE severity = v) AS BIGINT) FROM (SELECT unnest(['low', 'medium', 'high', 'critical']) AS v)
UNION ALL SELECT 'type', alert_type, CAST(count(*) AS BIGINT) FROM alerts GROUP BY alert_type"""


@query("agg5_alerts_summary", _SUMMARY)
def _(spark, d):
    return R.alerts_summary(alerts(spark, d))


@query("agg6_dashboard_summary", f"SELECT (SELECT CAST(count(*) AS BIGINT) FROM alerts) AS total_alerts, (SELECT CAST(coalesce(sum(bytes_sent), 0) AS BIGINT) FROM ({_TALKERS} LIMIT 5)) AS top_bytes, (SELECT CAST(count(*) AS BIGINT) FROM ({_TALKERS} LIMIT 5)) AS top_talkers, (SELECT CAST(count(DISTINCT proto) AS BIGINT) FROM p) AS protocols, "
       "(SELECT string_agg(v || '=' || (SELECT count(*) FROM alerts WHERE severity = v), ',' ORDER BY v) FROM (SELECT unnest(['low', 'medium', 'high', 'critical']) AS v)) AS severities, "
       "(SELECT string_agg(alert_type || '=' || n, ',' ORDER BY alert_type) FROM (SELECT alert_type, count(*) AS n FROM alerts GROUP BY 1)) AS threats")
def _(spark, d):
    p = stored(packets(spark, d), "packets")
    text = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias(c)
    return R.dashboard_summary(alerts(spark, d, p), stored(L.aggregate_flows(p), "flows")).select("total_alerts", "top_bytes", "top_talkers", "protocols", text("severities"), text("threats"))


@query("jn4_alerts_with_truth", "SELECT alert_type, label, CAST(count(*) AS BIGINT) AS n FROM alerts JOIN p USING (packet_id) GROUP BY 1, 2")
def _(spark, d):
    p = stored(packets(spark, d), "packets")
    return alerts(spark, d, p).join(p.select("packet_id", "label"), "packet_id").groupBy("alert_type", "label").agg(F.count("*").alias("n"))


@query("jn5_missed_packets", "SELECT packet_id, label FROM p WHERE label <> 'benign' AND packet_id NOT IN (SELECT packet_id FROM alerts)")
def _(spark, d):
    p = stored(packets(spark, d), "packets")
    return p.where("label <> 'benign'").join(alerts(spark, d, p).select("packet_id").distinct(), "packet_id", "left_anti").select("packet_id", "label")


@query("agg9_detection_metrics", """SELECT alert_type, tp, fp, fn, round(precise, 4) AS precision, recall,
round(CASE WHEN precise + recall > 0 THEN 2 * precise * recall / (precise + recall) ELSE 0 END, 4) AS f1, round(CASE WHEN tp + fn > 0 THEN tp * 1.0E0 / (tp + fn) ELSE 0 END, 4) AS packet_recall
FROM (SELECT t AS alert_type, tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp * 1.0E0 / (tp + fp) WHEN fn = 0 THEN 1.0E0 ELSE 0.0E0 END AS precise, CASE WHEN tp > 0 THEN 1.0E0 ELSE 0.0E0 END AS recall FROM (
SELECT t, CAST((SELECT count(*) FROM alerts JOIN p USING (packet_id) WHERE alert_type = t AND label = t) AS BIGINT) AS tp,
CAST((SELECT count(*) FROM alerts JOIN p USING (packet_id) WHERE alert_type = t AND label <> t) AS BIGINT) AS fp,
CAST((SELECT count(*) FROM p WHERE label = t AND packet_id NOT IN (SELECT packet_id FROM alerts)) AS BIGINT) AS fn
FROM (SELECT unnest(['port_scan', 'syn_flood', 'dns_tunnel', 'arp_spoof']) AS t)))""")
def _(spark, d):
    p = stored(packets(spark, d), "packets")
    return R.detection_metrics(p, alerts(spark, d, p)).select("alert_type", "tp", "fp", "fn", "precision", "recall", "f1", "packet_recall")


@query("agg10_cms_build", "SELECT CAST(row AS INT) AS row, col, cnt FROM cs")
def _(spark, d):
    return R.cms_build(packets(spark, d), "src")


@query("jn6_cms_estimate", "SELECT src, CAST(min(cnt) AS BIGINT) AS estimate FROM cm JOIN cs USING (row, col) GROUP BY src")
def _(spark, d):
    p = packets(spark, d)
    return R.cms_estimate(R.cms_build(p, "src"), p, "src")


@query("agg12_cms_decay", "SELECT CAST(row AS INT) AS row, col, CAST(floor(cnt * 0.5E0) AS BIGINT) AS cnt FROM cs")
def _(spark, d):
    return R.cms_decay(R.cms_build(packets(spark, d), "src"))


@query("agg11_cms_conservative", """, keyed AS (SELECT src, count(*) AS n, CAST('0x' || substr(md5(src), 1, 4) AS BIGINT) % 16 AS shard FROM p WHERE src IS NOT NULL GROUP BY src),
fed AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY src) AS rn, list_transform([0, 1, 2, 3], lambda r: r * 2048 + CAST('0x' || substr(md5(concat('seed_', r, '|', src)), 1, 8) AS BIGINT) % 2048) AS cells FROM keyed),
cu AS (SELECT shard, CAST(0 AS BIGINT) AS rn, list_transform(range(8192), lambda i: CAST(0 AS BIGINT)) AS t FROM fed GROUP BY shard
  UNION ALL SELECT f.shard, f.rn, list_transform(cu.t, lambda v, i: CASE WHEN list_contains(f.cells, i - 1) THEN greatest(v, list_min(list_transform(f.cells, lambda c: cu.t[c + 1])) + f.n) ELSE v END) FROM cu JOIN fed f ON f.shard = cu.shard AND f.rn = cu.rn + 1),
done AS (SELECT shard, arg_max(t, rn) AS t FROM cu GROUP BY shard),
each AS (SELECT shard, unnest(range(8192)) AS i, unnest(t) AS cnt FROM done)
SELECT shard, CAST(i // 2048 AS INT) AS row, i % 2048 AS col, cnt FROM each WHERE cnt > 0""")
def _(spark, d):
    return R.cms_conservative(packets(spark, d), "src")


@query("snk4_upsert_latest", "SELECT src, packet_id, size FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY packet_id DESC) AS r FROM p) WHERE r = 1")
def _(spark, d):
    p = packets(spark, d).select("src", "packet_id", "size")
    return upsert_latest(p.where("packet_id % 2 = 0"), p.where("packet_id % 2 = 1"), ["src"], "packet_id")


@query("scl1_entropy", "SELECT subdomain, round(coalesce(max(entropy), 0), 6) AS entropy FROM dns GROUP BY 1")
def _(spark, d):
    names = packets(spark, d).where(X.dns_queries()).select(X.domain_parts(F.lower("dns_qname"))["subdomain"].alias("subdomain")).distinct()
    return names.select("subdomain", F.round(X.shannon_entropy(F.col("subdomain")), 6).alias("entropy"))


@query("scl4_flow_key_text", "SELECT DISTINCT flow_key FROM n")
def _(spark, d):
    return packets(spark, d).select(X.flow_key_text(X.canonical_flow_key()).alias("flow_key")).distinct()


@query("snk1_write_alerts", "SELECT packet_id, ts, alert_type, severity FROM alerts")
def _(spark, d):
    """Written in two parts that overlap: an alert that comes again takes its own place."""
    rows, path = alerts(spark, d), f"{shared_folder(spark)}/alerts-{uuid.uuid4().hex}"
    T.write_alerts(rows.where("packet_id % 3 <> 1"), path)
    return T.write_alerts(rows.where("packet_id % 3 <> 0"), path).select("packet_id", "ts", "alert_type", "severity")


@query("snk2_write_flow_summary", "SELECT flow_key, initiator_ip AS src, responder_ip AS dst, proto, start_ts, last_seen_ts, total_packets, total_bytes, tcp_state FROM flows")
def _(spark, d):
    """Flows as they stand halfway, then as they end: of a key the later summary stays."""
    p, path = stored(packets(spark, d), "packets"), f"{shared_folder(spark)}/flows-{uuid.uuid4().hex}"
    half = p.agg(F.expr("(min(packet_id) + max(packet_id)) div 2")).first()[0]
    for part in (p.where(F.col("packet_id") <= half), p):
        out = T.write_flow_summary(L.flow_summary(L.aggregate_flows(part)), path)
    return out.select("flow_key", "src", "dst", "proto", "start_ts", "last_seen_ts", "total_packets", "total_bytes", "tcp_state")


def stream_folder(spark: SparkSession, sf_dir: str) -> str:
    """A folder of packets to stream, ended by late packets of every kind, which let the watermark pass all others: no answer holds them."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    n, t = packets(spark, sf_dir).agg(F.max("packet_id"), F.max("ts")).first()
    rows = [(n + 1, t + 1e6, "TCP", "S", None), (n + 2, t + 1e6, "UDP", None, "end.of.stream"), (n + 3, t + 1e6, "ARP", "00:00:00:00:00:01", None)]
    closing = spark.createDataFrame(rows, "packet_id long, ts double, proto string, flags string, dns_qname string")
    closing = closing.withColumns({"src": F.lit("end"), "dst": F.lit("end"), "sport": F.lit(1), "dport": F.lit(1)})
    full = closing.select(*[F.col(c) if c in closing.columns else F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in PACKET_SCHEMA.split(", "))])
    return packet_folder(spark, sf_dir, full)


def streamed(spark: SparkSession, folder: str) -> DataFrame:
    return read_packet_stream(spark, folder, delay="1 second")


def gathered(df: DataFrame) -> DataFrame:
    """What a stream gives in append mode, as a table. A batch has a folder of its own, so one that is tried again takes its own place."""
    from ..streaming.jobs import run_available

    base = f"{shared_folder(df.sparkSession)}/stream-{uuid.uuid4().hex}"
    df.sparkSession.createDataFrame([], df.schema).write.parquet(f"{base}/out/batch=-1")
    run_available(df, f"{base}/progress", lambda batch, n: batch.write.mode("overwrite").parquet(f"{base}/out/batch={n}"), "append")
    return df.sparkSession.read.schema(df.schema).parquet(f"{base}/out").select(*df.columns)


@query("str2_stream_scan_windows", """SELECT src, CAST(start AS BIGINT) AS start, CAST(count(DISTINCT concat(dst, ':', dport)) AS BIGINT) AS targets
FROM (SELECT src, dst, dport, floor(ts) - unnest(range(10)) AS start FROM sy) GROUP BY 1, 2""")
def _(spark, d):
    from ..streaming.jobs import stream_scan_windows

    found = gathered(stream_scan_windows(streamed(spark, stream_folder(spark, d))))
    return found.select("src", F.unix_seconds("start").alias("start"), F.col("targets").cast("long").alias("targets"))


@query("str3_stream_flows", f"SELECT {', '.join(_SESSION)} FROM ss")
def _(spark, d):
    from ..streaming.jobs import stream_flows

    return gathered(stream_flows(streamed(spark, stream_folder(spark, d)))).select(*_SESSION)


@query("str4_stream_detect", """SELECT 'port_scan' AS alert_type, packet_id FROM sa UNION ALL SELECT 'syn_flood', packet_id FROM fa UNION ALL SELECT 'dns_tunnel', packet_id FROM da UNION ALL SELECT 'arp_spoof', packet_id FROM aa""")
def _(spark, d):
    """The four detectors as streams; addresses and holders are two queries with a table of claims between."""
    from ..streaming import jobs as J

    stream = streamed(spark, stream_folder(spark, d))
    found = [("port_scan", gathered(J.stream_port_scan(stream))), ("syn_flood", gathered(J.stream_syn_flood(stream)))]
    found.append(("dns_tunnel", gathered(J.stream_dns_scores(stream)).where("score >= 3")))
    claims = gathered(J.stream_arp_claims(stream))
    end = claims.agg(F.max("packet_id").alias("n"), F.max("ts").alias("t")).select(
        (F.col("n") + 1).alias("packet_id"), (F.col("t") + 1e6).alias("ts"), F.lit("end").alias("dst"), F.lit(2).alias("arp_op"), F.lit("end").alias("ip"), F.lit("end").alias("mac"), F.lit(None).cast("string").alias("original_mac"), F.lit(False).alias("conflict")
    )
    path = f"{shared_folder(spark)}/claims-{uuid.uuid4().hex}"
    claims.unionByName(end).write.parquet(path)
    stream = spark.readStream.schema(claims.schema).parquet(path).withColumn("event_time", X.event_time(F.col("ts"))).withWatermark("event_time", "1 second")
    found.append(("arp_spoof", gathered(J.stream_arp_holdings(stream)).where("conflict or held > 3")))
    return reduce(DataFrame.unionByName, [x.select(F.lit(k).alias("alert_type"), "packet_id") for k, x in found])


@query("str5_stream_dedup", "SELECT packet_id, CAST(said AS BIGINT) AS suppressed FROM dc WHERE emit")
def _(spark, d):
    from ..streaming.jobs import stream_dedup

    found = stored(D.detect_dns_tunnel(packets(spark, d)), "alerts")
    end = found.agg(F.max("ts").alias("t")).select(F.lit("end").alias("id"), (F.col("t") + 1e6).alias("ts"), F.lit("end").alias("alert_type"), F.lit("end").alias("src"), F.lit("end").alias("dst"), F.lit(-1).cast("long").alias("packet_id"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    path = f"{shared_folder(spark)}/alerts-{uuid.uuid4().hex}"
    found.select(*end.columns).unionByName(end).write.parquet(path)
    stream = spark.readStream.schema(end.schema).parquet(path).withColumn("event_time", X.event_time(F.col("ts"))).withWatermark("event_time", "1 second")
    return gathered(stream_dedup(stream)).join(found.select("id", "packet_id"), "id").select("packet_id", "suppressed")


@query("ext2_sql_functions", "SELECT packet_id, flow_key, CASE WHEN len(string_split(dns_qname, '.')) > 2 THEN array_to_string(string_split(dns_qname, '.')[1:len(string_split(dns_qname, '.')) - 2], '.') ELSE '' END AS subdomain FROM n")
def _(spark, d):
    X.register_sql(spark)
    p = packets(spark, d).select("packet_id", "src", "sport", "dst", "dport", "proto", "dns_qname")
    return spark.sql("SELECT packet_id, flow_key(src, sport, dst, dport, proto) AS flow_key, subdomain(dns_qname) AS subdomain FROM {p}", p=p)


@query("str1_stream_minute_stats", "SELECT minute_ts, total_packets, total_bytes, tcp_count, udp_count, arp_count, other_count FROM (" + _MINUTE + ")")
def _(spark, d):
    """The packets as a stream, upserted minute by minute into a table."""
    from ..sources.tables import minutes_table
    from ..streaming.jobs import run_available, stream_minute_stats, upsert_sink

    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = read_packet_stream(spark, packet_folder(spark, d))
    table = minutes_table(spark, f"{base}/minutes")
    run_available(stream_minute_stats(stream), f"{base}/progress", upsert_sink(table))
    return table.read()
