"""Detectors: packets in, alerts (ALERT_SCHEMA) out; and a registry of them."""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import NO_HOST, ack_packets, alert_id, dns_queries, domain_parts, evidence_json, mac_normalize, not_empty, pure_syn, shannon_entropy, syn_flow_key, syn_with_ports
from ..plans.packets import ALERT_SCHEMA
from ..sources.tables import stored
from .folds import FloodState, ScanState, segments, sliding_distinct, sorted_fold
from .scans import around, bucket, neighbour, running_total, stabbed


def _alerts(df: DataFrame, kind: str, severity: Column, description: Column, evidence: Column, detail: str = "") -> DataFrame:
    return df.select(alert_id(F.lit(kind), F.col("packet_id"), detail).alias("id"), "ts", F.lit(kind).alias("alert_type"), severity.alias("severity"), "src", "dst", description.alias("description"), evidence.alias("evidence_json"), "packet_id")


def scan_events(
    packets: DataFrame, window: float = 10.0, threshold: int = 15, ewma: bool = False, slow_threshold: int = 20, slow_window: float = 300.0, alpha: float = 0.2
) -> DataFrame:
    """Sources that open connections to `threshold` distinct targets within `window` seconds, a burst at a time; with ewma also slow scans."""
    syn = packets.where(pure_syn()).select("packet_id", "ts", "src", "dst", "dport")
    schema = (
        "packet_id long, ts double, src string, dst string, scan_type string, unique_targets long, unique_ports long, unique_hosts long, "
        "cms_estimated_volume long, elapsed double, ewma_rate double"
    )
    # the slow path outlives any silence, so a source's rows stay one fold then
    rows = segments(syn, "src", None if ewma else window, min(threshold, slow_threshold) if ewma else threshold)
    slow = (slow_threshold, slow_window, alpha) if ewma else None
    return sorted_fold(rows, ["src", "segment"], ["ts", "packet_id"], lambda: ScanState(window, threshold, slow), schema)


def detect_port_scan(packets: DataFrame, **options) -> DataFrame:
    return scan_alerts(scan_events(packets, **options), options.get("window", 10.0))


def scan_alerts(e: DataFrame, seconds: float = 10.0) -> DataFrame:
    window = str(seconds)
    text = (
        F.when(F.col("scan_type") == "vertical", F.format_string("Vertical port scan by %s: %d ports of %s within " + window + " s", "src", "unique_ports", "dst"))
        .when(F.col("scan_type") == "horizontal", F.format_string("Horizontal port sweep by %s: one port on %d hosts within " + window + " s", "src", "unique_hosts"))
        .when(F.col("scan_type") == "low_and_slow", F.format_string("Slow port scan by %s: %d endpoints in %s s", "src", "unique_targets", F.col("elapsed").cast("string")))
        .otherwise(F.format_string("Port scan by %s: %d endpoints on %d hosts within " + window + " s", "src", "unique_targets", "unique_hosts"))
    )
    columns = lambda *names: {c: F.col(c) for c in names}
    slow = evidence_json(**columns("scan_type", "unique_targets"), elapsed_seconds=F.col("elapsed"), **columns("ewma_rate", "cms_estimated_volume"))
    fast = evidence_json(**columns("scan_type", "unique_targets", "unique_ports", "unique_hosts"), window_seconds=F.lit(seconds), **columns("cms_estimated_volume"))
    evidence = F.when(F.col("scan_type") == "low_and_slow", slow).otherwise(fast)
    return _alerts(e, "port_scan", F.lit("medium"), text, evidence)


def flood_packets(packets: DataFrame) -> DataFrame:
    """Opened connections by their target, and acknowledgements by either side, with the pair of endpoints."""
    target = F.explode(F.when(ack_packets(), F.array_distinct(F.array("src", "dst"))).otherwise(F.array("dst")))
    rows = packets.where(syn_with_ports() | ack_packets()).withColumn("target", target)
    return rows.withColumn("pair", F.to_json(syn_flow_key())).withColumn("is_ack", F.col("flags").contains("A"))


FLOOD_SCHEMA = "packet_id long, ts double, src string, dst string, half_open_count long, window_syn_count long, incomplete_ratio double, unique_attackers long"


#: Seconds by which an open connection counts as open for longer, so that no rounding of sums of times hides one.
_SLACK = 1e-6


def open_counts(rows: DataFrame, window: float) -> DataFrame:
    """target, ts and open at each opened connection: no fewer than the target's connections of the last `window` seconds that have no acknowledgement of the pair
    in that time. A connection is open from the end of what an acknowledgement before it covers until the next one or its own end, so the number is a
    running sum."""
    seen = around(rows, ["target", "pair"], F.col("is_ack"), window)
    since, until = F.col("prior.ts") + window - _SLACK, F.coalesce(F.col("next.ts"), F.col("ts") + window) + _SLACK
    at = lambda ts, late, step, mark: F.struct(ts.alias("ts"), F.lit(late).alias("late"), F.lit(step).alias("step"), F.lit(mark).alias("mark"))
    fresh, again = F.col("prior").isNull(), F.col("prior").isNotNull() & (since < until)
    steps = F.array(at(F.col("ts"), 0, 0, True), F.when(fresh, at(F.col("ts"), 0, 1, False)), F.when(again, at(since, 0, 1, False)), F.when(fresh | again, at(until, 1, -1, False)))
    steps = seen.select("target", F.explode(F.array_compact(steps)).alias("e")).select("target", "e.*")
    return running_total(steps, ["target"], F.col("step"), "open", window, ("ts", "late", F.desc("step"))).where("mark").select("target", "ts", "open")


def flood_spells(rows: DataFrame, window: float, threshold: int, ratio: float, direct: int = 1_000_000) -> DataFrame:
    """target, _b (buckets of `window` seconds) and segment: where an alert is possible at all, and the bucket before, which holds what the window has then.

    `threshold` connections have to be opened in two neighbouring buckets, and threshold * ratio of these have to be open at one of them. What lies outside the
    spells has no alert, so it empties no window, and each run of buckets is a fold of its own. Where the busy buckets hold no more than `direct` rows, that is
    fewer than the open connections cost to count, the first test alone names the spells; the alerts are the same."""
    down = Window.partitionBy("target").orderBy("_b")
    counts = rows.groupBy("target", bucket(window).alias("_b")).agg(F.count_if(~F.col("is_ack")).alias("n"), F.count("*").alias("rows"))
    before = F.when(F.lag("_b").over(down) == F.col("_b") - 1, F.lag("n").over(down)).otherwise(0)
    busy = stored(counts.withColumn("both", F.col("n") + before).where(F.col("both") >= threshold).select("target", "_b", "rows"), "busy")
    if (busy.agg(F.sum("rows")).first()[0] or 0) <= direct:
        hot = busy.select("target", "_b")
    else:
        near = busy.select("target", F.explode(F.sequence(F.col("_b") - 2, F.col("_b") + 1)).alias("_b")).distinct()
        some = rows.withColumn("_b", bucket(window)).join(near, ["target", "_b"]).drop("_b")
        hot = open_counts(some, window).where(F.col("open") >= math.ceil(threshold * ratio - 1e-9)).select("target", bucket(window).alias("_b")).distinct()
    spells = hot.select("target", F.explode(F.array(F.col("_b") - 1, F.col("_b"))).alias("_b")).distinct()
    cut = F.coalesce((F.col("_b") - F.lag("_b").over(down) > 1).cast("long"), F.lit(1))
    return stored(spells.withColumn("segment", cut).withColumn("segment", F.sum("segment").over(down)), "spells")


def flood_events(packets: DataFrame, window: float = 5.0, threshold: int = 40, ratio: float = 0.8, direct: int = 1_000_000) -> DataFrame:
    """Targets with `threshold` connections opened within `window` seconds, of which `ratio` or more have no acknowledgement of the pair in that time. Only spells
    in which that is possible reach the fold; their tables are small, and Spark broadcasts them by their size."""
    rows = flood_packets(packets).select("packet_id", "ts", "src", "target", "pair", "is_ack")
    spells = flood_spells(rows, window, threshold, ratio, direct)
    rows = rows.withColumn("_b", bucket(window)).join(spells, ["target", "_b"]).drop("_b")
    return sorted_fold(rows, ["target", "segment"], ["ts", "packet_id"], lambda: FloodState(window, threshold, ratio), FLOOD_SCHEMA)


def detect_syn_flood(packets: DataFrame, **options) -> DataFrame:
    return flood_alerts(flood_events(packets, **options), options.get("window", 5.0))


def flood_alerts(e: DataFrame, seconds: float = 5.0) -> DataFrame:
    e = e.withColumn("syn_count", F.col("half_open_count"))
    text = F.format_string("SYN flood on %s: %d half-open connections from %d source(s)", "dst", "half_open_count", "unique_attackers")
    evidence = evidence_json(**{c: F.col(c) for c in ("syn_count", "half_open_count", "window_syn_count", "incomplete_ratio", "unique_attackers")}, target_ip=F.col("dst"), window_seconds=F.lit(seconds))
    return _alerts(e, "syn_flood", F.lit("critical"), text, evidence)


def name_queries(packets: DataFrame) -> DataFrame:
    """Each name query with its parts and the entropy of the subdomain."""
    q = packets.where(dns_queries()).withColumn("qname", F.lower("dns_qname")).withColumn("parts", domain_parts(F.col("qname")))
    q = q.withColumn("subdomain", F.col("parts.subdomain")).withColumn("parent", F.col("parts.parent")).drop("parts")
    return q.withColumn("entropy", shannon_entropy(F.col("subdomain")))


NAME_COLUMNS = ["packet_id", "ts", "src", "dst", "qname", "dns_qtype", "subdomain", "parent", "entropy"]


def dns_scores(packets: DataFrame, entropy: float = 3.5, length: int = 50, burst: int = 15, window: float = 15.0) -> DataFrame:
    """Each name query with its parts, entropy, burst (distinct subdomains of the parent that the source asked for in the window), score and reasons."""
    names = stored(name_queries(packets).select(*NAME_COLUMNS), "names")  # read for items, marks and sums: packets are scanned and entropies worked out once
    q = sliding_distinct(names, ["src", "parent"], F.nullif("subdomain", F.lit("")), window, "burst")
    return scored_names(q, entropy, length, burst)


def scored_names(q: DataFrame, entropy: float = 3.5, length: int = 50, burst: int = 15) -> DataFrame:
    odd = (F.col("entropy") >= entropy) & (F.length("subdomain") >= 10)
    typed = F.coalesce(F.col("dns_qtype").isin(10, 16), F.lit(False))
    tests = {"long name": (F.length("qname") >= length, 1), "high entropy": (odd, 2), "record type": (typed, 1), "subdomain burst": (F.col("burst") >= burst, 2)}
    score = reduce(lambda a, b: a + b, [F.when(t, n).otherwise(0) for t, n in tests.values()])
    return q.withColumn("score", score.cast("long")).withColumn("reasons", F.array_compact(F.array(*[F.when(t, k) for k, (t, _) in tests.items()])))


def detect_dns_tunnel(packets: DataFrame, score: int = 3, **options) -> DataFrame:
    return name_alerts(dns_scores(packets, **options), score)


def name_alerts(e: DataFrame, score: int = 3) -> DataFrame:
    e = e.where(F.col("score") >= score)
    evidence = evidence_json(qname=F.col("qname"), subdomain=F.col("subdomain"), parent_domain=F.col("parent"), entropy=F.round("entropy", 2), query_length=F.length("qname"), dns_qtype=F.col("dns_qtype"), score=F.col("score"), reasons=F.col("reasons"))
    text = F.concat(F.lit("Name tunnel from "), "src", F.lit(" by "), "qname", F.lit(": "), F.array_join("reasons", ", "))
    return _alerts(e, "dns_tunnel", F.when(F.col("score") >= score + 2, "high").otherwise("medium"), text, evidence)


def arp_claims(packets: DataFrame) -> DataFrame:
    ip, mac = F.coalesce(F.nullif("arp_psrc", F.lit("")), "src"), mac_normalize(F.col("arp_hwsrc"), F.col("flags"))
    rows = packets.where("proto = 'ARP'").withColumn("ip", ip).withColumn("mac", mac)
    return rows.where(not_empty("ip") & not_empty("mac") & ~F.col("mac").isin(*NO_HOST)).select("packet_id", "ts", "dst", "arp_op", "ip", "mac")


def arp_conflicts(packets: DataFrame) -> DataFrame:
    """Each claim with the address's holder before it."""
    return neighbour(arp_claims(packets), ["ip"], F.col("mac"), "original_mac").withColumn("conflict", F.coalesce(F.col("original_mac") != F.col("mac"), F.lit(False)))


def held_at(claims: DataFrame) -> DataFrame:
    """claims with how many addresses their holder has then: a claim that changes hands adds one to the new holder and takes one from the old."""
    came = F.struct(F.col("mac").alias("holder"), (F.col("original_mac").isNull() | F.col("conflict")).cast("int").alias("delta"), F.lit(True).alias("claim"))
    went = F.when(F.col("conflict"), F.struct(F.col("original_mac").alias("holder"), F.lit(-1).alias("delta"), F.lit(False).alias("claim")))
    steps = claims.withColumn("step", F.explode(F.array_compact(F.array(came, went)))).select(*claims.columns, "step.*")
    return running_total(steps, ["holder"], F.col("delta"), "held", order=("ts", "packet_id", "claim")).where("claim").select(*claims.columns, "held")


def arp_holdings(packets: DataFrame) -> DataFrame:
    """Each claim with the holder before it and how many addresses its holder has then."""
    return held_at(arp_conflicts(packets))


def claimed_ips(claims: DataFrame, events: DataFrame) -> DataFrame:
    """packet_id and the sorted addresses that the holder of each event (packet_id, mac, ts) has at it: events stab the runs of claims (arp_conflicts) that cover
    them."""
    moves = claims.where("original_mac is null or conflict").select("ts", "packet_id", "ip", "mac")
    place = F.struct("ts", "packet_id")
    runs = neighbour(moves, ["ip"], place, "end", after=True).select("mac", "ip", place.alias("start"), "end")
    return stabbed(events.select("packet_id", "ts", "mac"), runs, ["mac"]).groupBy("packet_id").agg(F.sort_array(F.collect_set("ip")).alias("claimed_ips"))


def detect_arp_spoof(packets: DataFrame, gateway_ip: str | None = None, max_ips: int = 3) -> DataFrame:
    """A holder of an address changes, or one that holds more than max_ips addresses claims again; a conflict is the only alert of its claim."""
    conflicts = stored(arp_conflicts(packets), "claims")
    claims = stored(held_at(conflicts).where(F.col("conflict") | (F.col("held") > max_ips)), "holdings")
    gateway = F.col("ip") == F.lit(gateway_ip) if gateway_ip else F.lit(False)
    a = claims.where("conflict").withColumn("src", F.col("ip"))
    text = F.concat(F.format_string("Address %s claimed by %s, held by %s before", "ip", "mac", "original_mac"), F.when(gateway, ", the GATEWAY").otherwise(""))
    first = _alerts(a, "arp_spoof", F.when(gateway, "critical").otherwise("high"), text, evidence_json(ip=F.col("ip"), original_mac=F.col("original_mac"), spoofed_mac=F.col("mac"), is_gateway=gateway, arp_op=F.col("arp_op")), "conflict")
    b = claims.where(~F.col("conflict") & (F.col("held") > max_ips))
    b = b.join(claimed_ips(conflicts, b), "packet_id").withColumn("src", F.col("ip")).withColumn("dst", F.lit(None).cast("string"))
    second = _alerts(b, "arp_spoof", F.lit("high"), F.format_string("%s claims %d addresses", "mac", "held"), evidence_json(mac=F.col("mac"), claimed_ips=F.col("claimed_ips"), threshold=F.lit(max_ips)), "many")
    return first.unionByName(second)


class Registry:
    """Named detectors, each a function from packets to alerts, which may be switched off."""

    def __init__(self):
        self.detectors: dict[str, Callable[[DataFrame], DataFrame]] = {"port_scan": detect_port_scan, "syn_flood": detect_syn_flood, "dns_tunnel": detect_dns_tunnel, "arp_spoof": detect_arp_spoof}
        self.enabled = dict.fromkeys(self.detectors, True)

    def register(self, name: str, detector: Callable[[DataFrame], DataFrame], enabled: bool = True) -> None:
        self.detectors[name], self.enabled[name] = detector, enabled

    def run(self, packets: DataFrame) -> DataFrame:
        """Alerts of all enabled detectors; each must have ALERT_SCHEMA's columns. Each is called in a thread of its own, so tables that one stores on its way are
        written beside those of the others."""
        spark = packets.sparkSession
        empty = spark.createDataFrame([], ALERT_SCHEMA)
        chosen = [f for name, f in self.detectors.items() if self.enabled[name]]
        with ThreadPoolExecutor(max(1, len(chosen))) as pool:
            found = [x.result() for x in [pool.submit(inheritable_thread_target(spark)(f), packets) for f in chosen]]
        for df in found:
            if dict(df.dtypes) != dict(empty.dtypes):
                raise ValueError(f"a detector's columns are {df.dtypes}")
        return reduce(DataFrame.unionByName, found, empty)
