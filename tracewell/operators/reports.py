"""Windows over packets, questions to stored alerts, scoring, and sketches."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import ack_packets, minute_bucket, parse_evidence, pure_syn, syn_flow_key, syn_with_ports
from ..sources.tables import stored
from .folds import sliding_distinct
from .scans import around, moving_rate, neighbour, recent_count, running_total

SEVERITIES, TYPES = ("low", "medium", "high", "critical"), ("port_scan", "syn_flood", "dns_tunnel", "arp_spoof")


def scan_window(packets: DataFrame, window: float = 10.0) -> DataFrame:
    """Distinct targets of the source in the last `window` seconds at each opened connection, without any reset."""
    syn = packets.where(pure_syn()).select("packet_id", "ts", "src", "dst", "dport")
    return sliding_distinct(syn, ["src"], F.struct("dst", "dport"), window, "targets").select("packet_id", "src", "targets")


def flood_window(packets: DataFrame, window: float = 5.0) -> DataFrame:
    """Opened connections of the target in the last `window` seconds at each of them."""
    return recent_count(packets.where(syn_with_ports()).select("packet_id", "ts", "dst"), ["dst"], window, "syns").select("packet_id", "dst", "syns")


def scan_targets(packets: DataFrame) -> DataFrame:
    g = packets.where(pure_syn()).groupBy("src").agg(F.count_distinct("dst", "dport").alias("targets"), F.count_distinct("dst").alias("hosts"), F.count_distinct("dport").alias("ports"))
    kind = F.when((F.col("hosts") == 1) & (F.col("ports") > 1), "vertical").when((F.col("hosts") > 1) & (F.col("ports") == 1), "horizontal").otherwise("distributed/hybrid")
    return g.withColumn("scan_type", kind)


def half_open_syns(packets: DataFrame, window: float = 5.0) -> DataFrame:
    """Opened connections by tumbling window, and whether the pair is acknowledged in the same one."""
    bucket = F.floor(F.col("ts") / window).cast("long")
    rows = packets.withColumn("win", bucket).withColumn("pair", syn_flow_key())
    acks = rows.where(ack_packets()).select("pair", "win").distinct().withColumn("complete", F.lit(True))
    return rows.where(syn_with_ports()).join(acks, ["pair", "win"], "left").select("packet_id", "src", "dst", "win", F.coalesce("complete", F.lit(False)).alias("complete"))


def flood_sources(packets: DataFrame, window: float = 5.0) -> DataFrame:
    g = half_open_syns(packets, window).groupBy("dst", "win").agg(F.count("*").alias("syns"), F.count_if(~F.col("complete")).alias("half_open"), F.count_distinct("src").alias("attackers"))
    return g.withColumn("ratio", F.col("half_open") / F.col("syns"))


def syn_completions(packets: DataFrame, window: float = 5.0) -> DataFrame:
    """Opened connections, each with the pair's last acknowledgement up to it that is at most `window` seconds old, and whether there is one."""
    rows = packets.where(syn_with_ports() | ack_packets()).select("packet_id", "ts", "src", "dst", syn_flow_key().alias("pair"), ack_packets().alias("is_ack"))
    found = around(rows, ["pair"], F.col("is_ack"), window, after=False)
    return found.select("packet_id", "ts", "src", "dst", F.col("prior.ts").alias("acked_ts"), F.col("prior").isNotNull().alias("complete"))


def syn_volume(packets: DataFrame) -> DataFrame:
    """Connections that the source has opened so far, at each."""
    return running_total(packets.where(pure_syn()).select("packet_id", "ts", "src"), ["src"], F.lit(1), "volume").select("packet_id", "src", "volume")


def interarrival(packets: DataFrame, key: str = "src") -> DataFrame:
    """Seconds since the key's packet before."""
    rows = neighbour(packets.where(F.col(key).isNotNull()).select("packet_id", "ts", key), [key], F.col("ts"), "before")
    return rows.select("packet_id", key, (F.col("ts") - F.col("before")).alias("dt"))


def time_order(packets: DataFrame, key: str = "src") -> DataFrame:
    """Each packet's place among its key's, from 1."""
    return running_total(packets.select("packet_id", "ts", key), [key], F.lit(1), "place").select("packet_id", key, "place")


def ewma_rate(packets: DataFrame, alpha: float = 0.2) -> DataFrame:
    """The moving rate of a source's opened connections after its last one; 1 at the first."""
    return moving_rate(packets.where(pure_syn()).select("packet_id", "ts", "src"), "src", alpha).select("src", "rate")


def query_alerts(alerts: DataFrame, alert_type: str | None = None, severity: str | None = None, since: float | None = None, limit: int = 100) -> DataFrame:
    """The latest alerts, with `evidence`, a variant of what evidence_json says; an empty object where that is null or no JSON."""
    for c, v in (("alert_type", alert_type), ("severity", severity)):
        alerts = alerts.where(F.col(c) == v) if v else alerts
    alerts = alerts.where(F.col("ts") >= since) if since is not None else alerts
    return alerts.orderBy(F.desc("ts"), "id").limit(max(1, min(limit, 1000))).withColumn("evidence", parse_evidence(F.col("evidence_json")))


def alerts_summary(alerts: DataFrame) -> DataFrame:
    """scope (total, severity or type), name and n; the four severities are there with 0 too, a null severity counts as low."""
    rows = alerts.select(F.lower(F.coalesce("severity", F.lit("low"))).alias("severity"), "alert_type")
    g = rows.groupingSets([[], ["severity"], ["alert_type"]], "severity", "alert_type").agg(F.grouping_id().alias("gid"), F.count("*").alias("n"))
    four = alerts.sparkSession.createDataFrame([(s,) for s in SEVERITIES], "name string")
    severity = four.join(g.where("gid = 1").select(F.col("severity").alias("name"), "n"), "name", "left").select(F.lit("severity").alias("scope"), "name", F.coalesce("n", F.lit(0)).alias("n"))
    return g.where("gid = 3").select(F.lit("total").alias("scope"), F.lit("all").alias("name"), "n").union(severity).union(g.where("gid = 2").select(F.lit("type"), "alert_type", "n"))


def dashboard_summary(alerts: DataFrame, flows: DataFrame) -> DataFrame:
    from .flows import protocol_distribution, top_talkers

    summary = alerts_summary(alerts)
    of = lambda scope: summary.where(F.col("scope") == scope)
    as_map = lambda df, name: df.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n")))).alias(name))
    talkers = top_talkers(flows, 5).agg(F.coalesce(F.sum("bytes_sent"), F.lit(0)).alias("top_bytes"), F.count("*").alias("top_talkers"))
    one = of("total").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_alerts"))
    for part in (as_map(of("severity"), "severities"), as_map(of("type"), "threats"), talkers, protocol_distribution(flows).agg(F.count("*").alias("protocols"))):
        one = one.crossJoin(part)  # one row each
    return one


def detection_metrics(labelled: DataFrame, alerts: DataFrame) -> DataFrame:
    """By attack type: alerts on packets of that label (tp), other alerts of the type (fp), labelled packets without any alert (fn), and the ratios."""
    hit = alerts.join(labelled.select("packet_id", "label"), "packet_id").groupBy("alert_type").agg(F.count_if(F.col("label") == F.col("alert_type")).alias("tp"), F.count_if(F.col("label") != F.col("alert_type")).alias("fp"))
    missed = labelled.where("label <> 'benign'").join(alerts.select("packet_id").distinct(), "packet_id", "left_anti").groupBy(F.col("label").alias("alert_type")).agg(F.count("*").alias("fn"))
    four = alerts.sparkSession.createDataFrame([(t,) for t in TYPES], "alert_type string")
    rows = four.join(hit, "alert_type", "left").join(missed, "alert_type", "left").na.fill(0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    precision = F.when(tp + fp > 0, tp / (tp + fp)).when(fn == 0, 1.0).otherwise(0.0)
    recall = F.when(tp > 0, 1.0).otherwise(0.0)
    rows = rows.withColumn("precision", F.round(precision, 4)).withColumn("recall", recall)
    return rows.withColumn("f1", F.round(F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0), 4)).withColumn("packet_recall", F.round(F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0), 4))


def cms_cell(key: Column, row: Column, width: int) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit("seed_"), row.cast("string"), F.lit("|"), key)), 1, 8), 16, 10).cast("long") % width


def cms_build(keys: DataFrame, key: str, width: int = 2048, depth: int = 4) -> DataFrame:
    """row, col and cnt of a count-min sketch; sketches of parts add up."""
    counts = keys.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n"))
    rows = counts.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))))
    return rows.groupBy("row", cms_cell(F.col("k"), F.col("row"), width).alias("col")).agg(F.sum("n").alias("cnt"))


def cms_estimate(sketch: DataFrame, keys: DataFrame, key: str, width: int = 2048, depth: int = 4) -> DataFrame:
    rows = keys.select(F.col(key).alias("k")).distinct().withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(depth - 1)))).withColumn("col", cms_cell(F.col("k"), F.col("row"), width))
    found = rows.join(F.broadcast(sketch), ["row", "col"], "left")  # width x depth cells
    return found.groupBy(F.col("k").alias(key)).agg(F.min(F.coalesce("cnt", F.lit(0))).alias("estimate"))


def cms_decay(sketch: DataFrame, factor: float = 0.5) -> DataFrame:
    return sketch.withColumn("cnt", (F.col("cnt") * factor).cast("long"))


def cms_merge(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("row", "col").agg(F.sum("cnt").alias("cnt"))


def cms_shard(key: Column, shards: int) -> Column:
    """The shard of cms_conservative that a key's estimate comes from."""
    return F.conv(F.substring(F.md5(key), 1, 4), 16, 10).cast("long") % shards


def cms_conservative(keys: DataFrame, key: str, width: int = 2048, depth: int = 4, shards: int = 16) -> DataFrame:
    """shard, row, col and cnt with conservative update: a key's cells rise only as far as its own least cell needs. Depends on order, so each shard of keys has a
    sketch of its own, fed by the keys' counts in order of key; a key's estimate comes from its own shard and is never under the truth. More shards, more tasks."""
    import numpy as np
    import pandas as pd

    counts = keys.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n"))
    cells = F.array(*[cms_cell(F.col("k"), F.lit(r), width) for r in range(depth)])

    def told(shard: int, table) -> pd.DataFrame:
        r, c = np.nonzero(table)
        return pd.DataFrame({"shard": np.full(len(r), shard), "row": r.astype(np.int32), "col": c, "cnt": table[r, c]})

    def fold(batches):
        shard, table, rows = None, None, np.arange(depth)
        for pdf in batches:
            for own, at, n in zip(pdf["shard"], pdf["cells"], pdf["n"], strict=True):
                if own != shard:
                    if shard is not None:
                        yield told(shard, table)
                    shard, table = own, np.zeros((depth, width), np.int64)
                at = np.asarray(at)
                table[rows, at] = np.maximum(table[rows, at], table[rows, at].min() + n)
        if shard is not None:
            yield told(shard, table)

    dealt = counts.select("k", "n", cells.alias("cells"), cms_shard(F.col("k"), shards).alias("shard"))
    return dealt.repartition("shard").sortWithinPartitions("shard", "k").mapInPandas(fold, "shard long, row int, col long, cnt long")


#: Relative standard error of a HyperLogLog sketch of 2**12 registers, as its public documentation has it, and how many of these a prefilter leaves.
SKETCH_BITS, SKETCH_ERROR, SIGMAS = 12, 0.0163, 6


def _target() -> Column:
    return F.concat_ws(":", "dst", F.col("dport").cast("string"))


def target_sketches(packets: DataFrame) -> DataFrame:
    """src, minute_ts and a HyperLogLog sketch of the targets that the source opened connections to: a few KB at most for a source and minute, so they can be stored
    and merged over any minutes later."""
    return packets.where(pure_syn()).groupBy("src", minute_bucket(F.col("ts")).alias("minute_ts")).agg(F.hll_sketch_agg(_target(), SKETCH_BITS).alias("sketch"))


def estimated_targets(sketches: DataFrame, since: float, until: float) -> DataFrame:
    """src and about how many targets it had in the minutes from since up to until."""
    rows = sketches.where((F.col("minute_ts") >= since) & (F.col("minute_ts") < until))
    return rows.groupBy("src").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


def wide_sources(packets: DataFrame, sketches: DataFrame, since: float, until: float, least: int) -> DataFrame:
    """src and targets of sources with at least `least` distinct targets in the minutes from since up to until. Sketches name the sources that may have them, give
    or take SIGMAS standard errors; only the packets of these are counted exactly."""
    few = estimated_targets(sketches, since, until).where(F.col("estimate") >= math.floor(least * (1 - SIGMAS * SKETCH_ERROR))).select("src")
    rows = packets.where(pure_syn() & (F.col("ts") >= since) & (F.col("ts") < until)).join(stored(few, "wide"), "src")
    return rows.groupBy("src").agg(F.count_distinct("dst", "dport").alias("targets")).where(F.col("targets") >= least)
