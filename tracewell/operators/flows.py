"""Packets to bidirectional flows, and what is asked of flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import canonical_flow_key, endpoint, flow_key_text, minute_bucket, protocol_bucket
from .scans import joined


def aggregate_flows(packets: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row for each flow (and each value of extra). A flow starts at its first packet by (ts, packet_id), whose sender is the initiator.

    Everything is a minimum, maximum or sum by sender's side, so packets are combined before the one shuffle; which side is forward is known only after it.
    """
    order = F.struct("ts", "packet_id")
    first_side = endpoint(F.col("src"), F.col("sport")) == F.col("key.ep1")
    rows = packets.withColumn("key", canonical_flow_key()).withColumn("one", first_side).withColumn("ord", order)
    has = lambda c: F.coalesce(F.col("flags").contains(c), F.lit(False)) & (F.col("proto") == "TCP")
    fin, ack, syn = has("F") & ~has("R"), has("A"), has("S") & ~has("A")
    aggs = [
        F.min_by(F.struct("src", "sport", "dst", "dport", "one"), "ord").alias("first"),
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("last_seen_ts"),
        F.max(F.when(has("R"), F.col("ord"))).alias("r"),
        F.max(F.when(fin, F.col("ord"))).alias("f"),
        F.min(F.when(syn, F.col("ord"))).alias("s"),
        F.min(F.when(ack, F.col("ord"))).alias("a"),
    ]
    for k, side in (("1", F.col("one")), ("2", ~F.col("one"))):
        aggs += [F.count_if(side).alias(f"n{k}"), F.coalesce(F.sum(F.when(side, F.col("size"))), F.lit(0)).alias(f"b{k}"), F.coalesce(F.bool_or(side & fin), F.lit(False)).alias(f"fin{k}")]
        aggs += [F.max(F.when(side & ack, F.col("ord"))).alias(f"ack{k}"), F.max(F.when(side & ack & has("S"), F.col("ord"))).alias(f"sa{k}")]
    g = rows.groupBy("key", *extra).agg(*aggs)
    pick = lambda c, forward=True: F.when(F.col("first.one") == forward, F.col(f"{c}1")).otherwise(F.col(f"{c}2"))
    return g.select(
        flow_key_text(F.col("key")).alias("flow_key"), *extra, F.col("key.proto").alias("proto"),
        F.col("first.src").alias("initiator_ip"), F.col("first.sport").alias("initiator_port"), F.col("first.dst").alias("responder_ip"), F.col("first.dport").alias("responder_port"),
        "start_ts", "last_seen_ts", pick("n").alias("packets_forward"), pick("b").alias("bytes_forward"), pick("n", False).alias("packets_reverse"), pick("b", False).alias("bytes_reverse"),
        (F.col("n1") + F.col("n2")).alias("total_packets"), (F.col("b1") + F.col("b2")).alias("total_bytes"), F.greatest(F.lit(0.0), F.col("last_seen_ts") - F.col("start_ts")).alias("duration"),
        tcp_state(pick("ack"), pick("sa", False)).alias("tcp_state"), pick("fin").alias("fin_forward"), pick("fin", False).alias("fin_reverse"),
    )


def tcp_state(forward_ack: Column, reverse_synack: Column) -> Column:
    """The state that a flow's packets leave it in, from places of first and last flags: a reset after the last FIN wins, then FINs, then the handshake."""
    r, f, s, a = (F.col(c) for c in "rfsa")
    after = lambda x: F.coalesce(x > s, F.lit(False))
    return (
        F.when(F.col("key.proto") != "TCP", "NONE")
        .when(r.isNotNull() & (f.isNull() | (r > f)), "RESET")
        .when(f.isNotNull() & F.col("fin1") & F.col("fin2"), "CLOSED")
        .when(f.isNotNull(), "FIN_WAIT")
        .when(s.isNull() & a.isNull(), "NONE")
        .when(s.isNull() | F.coalesce(a < s, F.lit(False)) | after(forward_ack), "ESTABLISHED")
        .when(after(reverse_synack), "SYN_RECEIVED")
        .otherwise("SYN_SENT")
    )


def flow_direction(packets: DataFrame) -> DataFrame:
    """Adds `forward` to each packet: its sender is the flow's initiator. The first packet of a flow is a partial aggregate, so no task holds a busy flow."""
    rows = packets.withColumn("_flow", canonical_flow_key())
    first = rows.groupBy("_flow").agg(F.min_by(F.struct("src", "sport"), F.struct("ts", "packet_id")).alias("first"))
    same = F.col("first.src").eqNullSafe(F.col("src")) & (F.col("first.sport").isNull() | F.col("sport").isNull() | (F.col("first.sport") == F.col("sport")))
    return joined(rows, first, ["_flow"]).withColumn("forward", same).drop("_flow", "first")


def flow_summary(flows: DataFrame) -> DataFrame:
    return flows.select("flow_key", F.col("initiator_ip").alias("src"), F.col("initiator_port").alias("sport"), F.col("responder_ip").alias("dst"), F.col("responder_port").alias("dport"), "proto", "start_ts", "last_seen_ts", "total_packets", "total_bytes", "tcp_state")


def idle(now: float, established: float = 300.0, other: float = 60.0) -> Column:
    """Whether a flow has been silent for longer than its state allows."""
    return F.lit(now) - F.col("last_seen_ts") > F.when(F.col("tcp_state") == "ESTABLISHED", established).otherwise(other)


def top_talkers(flows: DataFrame, limit: int = 10) -> DataFrame:
    rows = flows.where("initiator_ip is not null").groupBy(F.col("initiator_ip").alias("ip")).agg(F.sum("total_bytes").alias("bytes_sent"), F.sum("total_packets").alias("packets_sent"))
    return rows.orderBy(F.desc("bytes_sent"), "ip").limit(limit)


def protocol_distribution(flows: DataFrame) -> DataFrame:
    return flows.groupBy("proto").agg(F.sum("total_packets").alias("packets"))


def minute_stats(packets: DataFrame, alerts: DataFrame | None = None) -> DataFrame:
    bucket = protocol_bucket(F.col("proto"))
    rows = packets.groupBy(minute_bucket(F.col("ts")).alias("minute_ts")).agg(
        F.count("*").alias("total_packets"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"), *[F.count_if(bucket == p).alias(f"{p.lower()}_count") for p in ("TCP", "UDP", "ARP", "OTHER")]
    )
    if alerts is None:
        return rows.withColumn("alerts_count", F.lit(0).cast("long"))
    counts = alerts.groupBy(minute_bucket(F.col("ts")).alias("minute_ts")).agg(F.count("*").alias("alerts_count"))
    return rows.join(counts, "minute_ts", "left").withColumn("alerts_count", F.coalesce("alerts_count", F.lit(0)))
