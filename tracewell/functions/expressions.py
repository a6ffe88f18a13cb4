"""Column functions over packets, names and alerts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Flag letters by bit, lowest first; HTTP methods; addresses that no host owns.
FLAG_LETTERS = "FSRPAUECN"
HTTP_METHODS = ("GET", "POST", "HEAD", "PUT", "DELETE", "OPTIONS")
NO_HOST = ("ff:ff:ff:ff:ff:ff", "00:00:00:00:00:00")


def shannon_entropy(text: Column) -> Column:
    """Bits a character; 0 for an empty or null text."""
    n = F.length(text)
    chars = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    shares = F.transform(chars, lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.coalesce(F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p)), F.lit(0.0))


def domain_parts(name: Column) -> Column:
    """subdomain and parent of a name: the last two labels are the parent."""
    labels = F.split(F.trim(name, F.lit(".")), "\\.")
    n = F.size(labels)
    long = n > 2
    return F.struct(F.when(long, F.array_join(F.slice(labels, 1, F.greatest(n - 2, F.lit(1))), ".")).otherwise("").alias("subdomain"), F.when(long, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(F.array_join(labels, ".")).alias("parent"))


def endpoint(ip: Column, port: Column) -> Column:
    return F.struct(F.coalesce(ip, F.lit("")).alias("ip"), F.coalesce(port, F.lit(0)).alias("port"))


def canonical_flow_key(src="src", sport="sport", dst="dst", dport="dport", proto="proto") -> Column:
    """The same for both directions; addresses are compared as text."""
    a, b = endpoint(F.col(src), F.col(sport)), endpoint(F.col(dst), F.col(dport))
    return F.struct(F.least(a, b).alias("ep1"), F.greatest(a, b).alias("ep2"), F.col(proto).alias("proto"))


def syn_flow_key(src="src", sport="sport", dst="dst", dport="dport") -> Column:
    a, b = endpoint(F.col(src), F.col(sport)), endpoint(F.col(dst), F.col(dport))
    return F.struct(F.least(a, b).alias("ep1"), F.greatest(a, b).alias("ep2"))


def flow_key_text(key: Column) -> Column:
    side = lambda e: F.concat(F.lit("('"), e["ip"], F.lit("', "), e["port"].cast("string"), F.lit(")"))
    return F.concat(F.lit("("), side(key["ep1"]), F.lit(", "), side(key["ep2"]), F.lit(", '"), key["proto"], F.lit("')"))


def tcp_flag_text(bits: Column) -> Column:
    return F.concat(*[F.when(bits.bitwiseAND(1 << k) != 0, c).otherwise("") for k, c in enumerate(FLAG_LETTERS)])


def http_request_line(payload: Column) -> Column:
    """method and uri if the payload's first line begins with a known method and a space; else nulls."""
    shape = f"^({'|'.join(HTTP_METHODS)}) ([^ \\r\\n]*)"
    found = lambda k: F.nullif(F.regexp_extract(payload, shape, k), F.lit(""))
    return F.struct(found(1).alias("method"), found(2).alias("uri"))


def minute_bucket(ts: Column) -> Column:
    return (F.floor(ts / 60) * 60).cast("double")


def mac_normalize(mac: Column, flags: Column) -> Column:
    return F.lower(F.coalesce(F.nullif(mac, F.lit("")), flags))


def protocol_bucket(proto: Column) -> Column:
    return F.when(proto.isin("TCP", "UDP", "ARP"), proto).otherwise("OTHER")


def event_time(ts: Column) -> Column:
    return F.timestamp_micros(F.round(ts * 1_000_000).cast("long"))


def evidence_json(**columns: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in columns.items()]), {"ignoreNullFields": "false"})


def parse_evidence(text: Column) -> Column:
    """A variant; an empty object for bad JSON or null."""
    return F.coalesce(F.try_parse_json(text), F.parse_json(F.lit("{}")))


def alert_id(kind: Column, packet_id: Column, detail: str = "") -> Column:
    return F.sha2(F.concat_ws("|", kind, packet_id.cast("string"), F.lit(detail)), 256)


def not_empty(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def pure_syn() -> Column:
    return (F.col("proto") == "TCP") & F.col("flags").contains("S") & ~F.col("flags").contains("A") & not_empty("src") & not_empty("dst") & F.col("dport").isNotNull()


def with_ports() -> Column:
    return not_empty("src") & not_empty("dst") & (F.coalesce("sport", F.lit(0)) != 0) & (F.coalesce("dport", F.lit(0)) != 0)


def syn_with_ports() -> Column:
    return (F.col("proto") == "TCP") & F.col("flags").contains("S") & ~F.col("flags").contains("A") & with_ports()


def ack_packets() -> Column:
    return (F.col("proto") == "TCP") & F.col("flags").contains("A") & with_ports()


def dns_queries() -> Column:
    return not_empty("dns_qname") & not_empty("src")


def register_sql(spark) -> None:
    """Functions for SQL texts of the session."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION minute_bucket(ts DOUBLE) RETURNS DOUBLE RETURN CAST(floor(ts / 60) * 60 AS DOUBLE)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION parent_domain(name STRING) RETURNS STRING RETURN substring_index(trim(BOTH '.' FROM name), '.', -2)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION subdomain(name STRING) RETURNS STRING RETURN CASE WHEN size(split(trim(BOTH '.' FROM name), '[.]')) > 2 THEN left(trim(BOTH '.' FROM name), length(trim(BOTH '.' FROM name)) - length(substring_index(trim(BOTH '.' FROM name), '.', -2)) - 1) ELSE '' END")
    side = lambda pick: f"{pick}(named_struct('ip', coalesce(src, ''), 'port', coalesce(sport, 0)), named_struct('ip', coalesce(dst, ''), 'port', coalesce(dport, 0)))"
    text = lambda pick: f"concat('(\\'', {side(pick)}.ip, '\\', ', {side(pick)}.port, ')')"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION flow_key(src STRING, sport INT, dst STRING, dport INT, proto STRING) RETURNS STRING RETURN concat('(', {text('least')}, ', ', {text('greatest')}, ', \\'', proto, '\\')')")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION shannon_entropy(s STRING) RETURNS DOUBLE RETURN coalesce(aggregate(array_distinct(filter(split(s, ''), c -> c <> '')), 0.0D,
        (acc, c) -> acc - (length(s) - length(replace(s, c, ''))) / length(s) * log2((length(s) - length(replace(s, c, ''))) / length(s))), 0.0D)""")
