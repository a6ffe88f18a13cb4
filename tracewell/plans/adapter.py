"""Adapter from a table of events, which has no packets, to the packets that the queries ask about: SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: A block of 256 events is a phase: 1 scans, 3 floods, 5 name queries, 7 address claims, others sessions.
PACKETS_SQL = """
SELECT event_id AS packet_id, 1704067200.0E0 + event_id * 0.05E0 AS ts,
  CASE WHEN ph = 1 THEN concat('172.28.9.', CAST(blk % 200 AS STRING)) WHEN ph = 3 THEN concat('172.30.', CAST(user_id % 250 AS STRING), '.', CAST(k AS STRING))
       WHEN ph = 5 THEN concat('172.28.5.', CAST(blk % 200 AS STRING)) WHEN ph = 7 THEN concat('172.28.0.', CAST(u + 1 AS STRING))
       WHEN step = 1 THEN '172.28.0.10' ELSE concat('172.28.1.', CAST(g % 200 AS STRING)) END AS src,
  CASE WHEN ph = 1 AND v <> 0 THEN concat('172.28.20.', CAST(pos AS STRING)) WHEN ph = 5 THEN '8.8.8.8' WHEN ph = 7 THEN '172.28.0.254'
       WHEN ph IN (0, 2, 4, 6) AND step = 1 THEN concat('172.28.1.', CAST(g % 200 AS STRING)) ELSE '172.28.0.10' END AS dst,
  CASE WHEN ph = 5 THEN 'UDP' WHEN ph = 7 THEN 'ARP' WHEN icmp = 1 THEN 'ICMP' ELSE 'TCP' END AS proto,
  CAST(CASE WHEN ph = 1 THEN 40000 + pos WHEN ph = 3 THEN 1024 + event_id % 60000 WHEN ph = 5 THEN 50000 + pos WHEN ph = 7 OR icmp = 1 THEN NULL
       WHEN step = 1 THEN 80 ELSE 49152 + g % 1000 END AS INT) AS sport,
  CAST(CASE WHEN ph = 1 AND v = 1 THEN 22 WHEN ph = 1 THEN 1000 + pos WHEN ph = 3 THEN 80 WHEN ph = 5 THEN 53 WHEN ph = 7 OR icmp = 1 THEN NULL
       WHEN step = 1 THEN 49152 + g % 1000 ELSE 80 END AS INT) AS dport,
  CASE WHEN ph IN (1, 3) THEN 'S' WHEN ph = 5 OR icmp = 1 THEN NULL WHEN ph = 7 THEN mac WHEN step = 0 THEN 'S' WHEN step = 1 THEN 'SA' WHEN step = 2 THEN 'A'
       WHEN event_type = 'error' THEN 'R' WHEN event_type = 'view' THEN 'FA' ELSE 'PA' END AS flags,
  CASE WHEN ph = 5 AND k % 4 = 0 THEN 'www.example.com' WHEN ph = 5 THEN concat(h, '.exfil.attacker-c2.net') END AS dns_qname,
  CAST(CASE WHEN ph = 5 AND k % 4 = 0 THEN 1 WHEN ph = 5 THEN 16 END AS INT) AS dns_qtype,
  CAST(CASE WHEN ph = 7 THEN 2 END AS INT) AS arp_op, CASE WHEN ph = 7 THEN mac END AS arp_hwsrc,
  CAST(NULL AS STRING) AS arp_psrc, CAST(NULL AS STRING) AS arp_hwdst, CAST(NULL AS STRING) AS arp_pdst, CAST(NULL AS STRING) AS http_method, CAST(NULL AS STRING) AS http_uri,
  60 + CAST(floor(value) AS BIGINT) AS size,
  CASE WHEN ph = 1 THEN 'port_scan' WHEN ph = 3 THEN 'syn_flood' WHEN ph = 5 AND k % 4 > 0 THEN 'dns_tunnel' WHEN ph = 7 AND k = 0 THEN 'arp_spoof' ELSE 'benign' END AS label
FROM (SELECT *, CASE WHEN ph IN (0, 2, 4, 6) AND k % 10 = 9 THEN 1 ELSE 0 END AS icmp,
        CASE WHEN k = 0 THEN '66:77:88:99:AA:BB' WHEN u < 5 THEN '00:11:22:33:55:00' ELSE concat('00:11:22:33:44:', CAST(10 + u AS STRING)) END AS mac
      FROM (SELECT event_id, user_id, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, CAST(floor(event_id / 256) AS BIGINT) AS blk,
              CAST(floor(event_id / 256) AS BIGINT) % 8 AS ph, CAST(floor(event_id / 2048) AS BIGINT) % 3 AS v, event_id % 256 AS pos, event_id % 4 AS step,
              CAST(floor(event_id / 4) AS BIGINT) AS g, user_id % 20 AS u, md5(CAST(event_id AS STRING)) AS h FROM {events}) AS a) AS b
"""


def packets_of(events: DataFrame) -> DataFrame:
    return events.sparkSession.sql(PACKETS_SQL, events=events)


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets_of(spark.read.parquet(f"{sf_dir}/events.parquet"))
