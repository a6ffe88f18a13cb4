"""Structured Streaming forms of the batch jobs. Streams have event_time and a watermark; rows behind it are dropped."""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections import namedtuple
from collections.abc import Callable, Iterator
from operator import itemgetter
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.expressions import canonical_flow_key, flow_key_text, protocol_bucket, pure_syn
from ..operators.detectors import FLOOD_SCHEMA, NAME_COLUMNS, arp_claims, flood_packets, name_queries, scored_names
from ..operators.folds import BurstState, ClaimState, CooldownState, FloodBuckets, FlowState, HoldState, ScanState
from ..operators.reports import SKETCH_BITS
from ..sources.tables import Table


def stream_minute_stats(stream: DataFrame) -> DataFrame:
    bucket = protocol_bucket(F.col("proto"))
    g = stream.groupBy(F.window("event_time", "1 minute").alias("w")).agg(F.count("*").alias("total_packets"), F.sum("size").alias("total_bytes"), *[F.count_if(bucket == p).alias(f"{p.lower()}_count") for p in ("TCP", "UDP", "ARP", "OTHER")])
    return g.select(F.unix_micros("w.start").cast("double").alias("_t"), "*").withColumn("minute_ts", F.col("_t") / 1_000_000).drop("_t", "w")


def stream_scan_windows(stream: DataFrame, window: str = "10 seconds", step: str = "1 second") -> DataFrame:
    g = stream.where(pure_syn()).groupBy("src", F.window("event_time", window, step).alias("w"))
    return g.agg(F.size(F.collect_set(F.struct("dst", "dport"))).alias("targets")).select("src", F.col("w.start").alias("start"), "targets")


def stream_gap_flows(stream: DataFrame, gap: str = "60 seconds") -> DataFrame:
    """Sessions of each flow key by a fixed gap, which Spark's own session windows give."""
    keyed = stream.withColumn("flow_key", flow_key_text(canonical_flow_key()))
    g = keyed.groupBy("flow_key", F.session_window("event_time", gap).alias("w"))
    return g.agg(F.count("*").alias("total_packets"), F.sum("size").alias("total_bytes"), F.min("ts").alias("start_ts"), F.max("ts").alias("last_seen_ts")).drop("w")


#: Keys are dealt to so many groups of state, and a group's folds to so many pages; a stream's checkpoint depends on both.
SHARDS, PAGES = 256, 64
#: Held rows are kept in chunks of about so many, or of so much weight.
CHUNK = 50_000


class Sorted(StatefulProcessor):
    """Holds rows until the watermark has passed them, then folds each key's in order of (ts, packet_id): what a stream gives is what the batch fold gives.

    make() returns a fold's state (step(row) -> rows, end() -> rows); it is pickled between batches, and it ends and is forgotten when the watermark is `idle`
    seconds past its last row. Every access to state is a round trip between Python and the JVM, so a group is not a key but a shard of keys: rows are held in
    chunks in order of time, folds in pages of several keys, and the index says when a chunk begins and when a page's first fold ends. A batch reads and writes
    the chunks that the watermark has reached and the pages of their rows alone. A shard has one timer; when that fires, all rows behind the watermark are folded
    at once, chunk by chunk in order of time, so memory holds the chunks that overlap. weight: a column that says how much a row is, where rows hold arrays."""

    def __init__(self, make: Callable[[], object], keys: list[str], columns: list[str], out: list[str], idle: float | None, weight: str | None = None):
        self.make, self.out, self.idle, self.weight = make, out, idle, weight
        self.columns = [*columns, *[k for k in keys if k not in columns]]
        self.key = itemgetter(*[self.columns.index(k) for k in keys])
        self.keys, self.row = keys, namedtuple("Row", self.columns)

    def __reduce__(self):
        return type(self), (self.make, self.keys, self.columns, self.out, self.idle, self.weight)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "chunk long", "rows binary")
        self.folds = handle.getMapState("folds", "page int", "folds binary")
        self.index = handle.getValueState("index", "state binary")

    def _open(self) -> SimpleNamespace:
        """chunks: number -> time of the first row; ends: page -> when its first fold ends, None for never. What they lack is not in the state."""
        return SimpleNamespace(**pickle.loads(bytes(self.index.get()[0]))) if self.index.exists() else SimpleNamespace(chunks={}, next=0, ends={}, timer=None)

    def _close(self, index: SimpleNamespace, least: int = 0) -> None:
        """Sets the one timer to what comes first, at `least` or later, and writes the index."""
        due = [int(t * 1000) + 1 for t in index.chunks.values()] + [at for at in index.ends.values() if at is not None]
        at = max(least, min(due)) if due else None
        if at != index.timer:
            if index.timer is not None:
                self.handle.deleteTimer(index.timer)
            if at is not None:
                self.handle.registerTimer(at)
            index.timer = at
        self.index.update((pickle.dumps(vars(index)),))

    def _hold(self, index: SimpleNamespace, lists: list[list]) -> None:
        """Columns as lists, in order of time, as a chunk."""
        self.held.updateValue((index.next,), (pickle.dumps(lists),))
        index.chunks[index.next] = lists[0][0]
        index.next += 1

    def _page(self, index: SimpleNamespace, pages: dict[int, dict], page: int) -> dict:
        if page not in pages:
            pages[page] = pickle.loads(bytes(self.folds.getValue((page,))[0])) if page in index.ends else {}
        return pages[page]

    def _ends(self, fold: object) -> int | None:
        """The watermark at which a fold ends; None for never."""
        last = getattr(fold, "last_row", None)
        return None if last is None or self.idle is None else int((last + self.idle) * 1000) + 1

    def _keep(self, index: SimpleNamespace, page: int, folds: dict, now: int) -> None:
        if folds:
            self.folds.updateValue((page,), (pickle.dumps(folds),))
            index.ends[page] = min((at for at in map(self._ends, folds.values()) if at is not None and at > now), default=None)
        elif page in index.ends:
            self.folds.removeKey((page,))
            del index.ends[page]

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """Keys' states as a batch left them: make()'s state takes a row with restore(row)."""
        index, pages = self._open(), {}
        for row in initialState.itertuples(index=False):
            fold = self.make()
            fold.last_row = fold.restore(row)
            own = [None if pd.isna(v) else v for v in (getattr(row, k) for k in self.keys)]
            self._page(index, pages, int(row.fold_page))[own[0] if len(own) == 1 else tuple(own)] = fold
        for page, folds in pages.items():
            self._keep(index, page, folds, 0)
        self.index.update((pickle.dumps(vars(index)),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        index, some, weight = self._open(), [], 0

        def hold() -> None:
            new = pd.concat(some, ignore_index=True).sort_values(self.columns[:2], kind="stable")
            some.clear()
            if new[self.columns[0]].isna().any():
                raise ValueError("a row without ts has no place in time")
            # what is null in a column of numbers is NaN in pandas
            self._hold(index, [new[c].tolist() if not new[c].isna().any() else new[c].astype(object).where(new[c].notna(), None).tolist() for c in new.columns])

        for batch in rows:
            sums = batch[self.weight].cumsum() if self.weight else pd.Series(range(1, len(batch) + 1), index=batch.index)
            for _, part in batch[[*self.columns, "fold_page"]].groupby((sums - 1) // CHUNK):
                some.append(part)
                weight += part[self.weight].sum() if self.weight else len(part)
                if weight >= CHUNK:
                    hold()
                    weight = 0
        if some:
            hold()
        self._close(index)
        yield pd.DataFrame(columns=self.out)

    def _due(self, index: SimpleNamespace, now: int) -> Iterator[list[tuple]]:
        """Rows behind the watermark in order, a list for each chunk; what is left of chunks is held again."""
        due, parts = sorted((t, number) for number, t in index.chunks.items() if t * 1000 < now), []
        for k, (_, number) in enumerate(due):
            parts.append([pickle.loads(bytes(self.held.getValue((number,))[0])), 0])
            self.held.removeKey((number,))
            del index.chunks[number]
            ready = []
            for part in parts:
                lists, since = part
                part[1] = bisect_left(lists[0], due[k + 1][0], since) if k + 1 < len(due) else bisect_left(lists[0], now, since, key=lambda t: t * 1000)
                ready += zip(*(c[since : part[1]] for c in lists), strict=True)
            parts = [p for p in parts if p[1] < len(p[0][0])]
            yield sorted(ready, key=itemgetter(0, 1))
        for lists, since in parts:
            self._hold(index, [c[since:] for c in lists])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        index, now, pages = self._open(), timerValues.getCurrentWatermarkInMs(), {}
        index.timer = None  # it has fired
        for rows in self._due(index, now):
            out = []
            for *values, page in rows:
                folds = pages[page] if page in pages else self._page(index, pages, page)
                own = self.key(values)
                fold = folds.get(own)
                if fold is None:
                    fold = folds[own] = self.make()
                out += fold.step(self.row._make(values))
                fold.last_row = values[0]
            yield pd.DataFrame(out, columns=self.out, dtype=object)
        for page in [p for p, at in index.ends.items() if at is not None and at <= now]:
            self._page(index, pages, page)
        out = []
        for page, folds in pages.items():
            for own, fold in list(folds.items()):
                at = self._ends(fold)
                if at is not None and at <= now and not getattr(fold, "rests", lambda: False)():
                    out += fold.end()
                    del folds[own]
            self._keep(index, page, folds, now)
        self._close(index, now + 1)
        yield pd.DataFrame(out, columns=self.out, dtype=object)

    def close(self) -> None:
        pass


def stream_fold(stream: DataFrame, keys: list[str], make: Callable[[], object], columns: list[str], schema: str, idle: float | None, initial: DataFrame | None = None, weight: str | None = None) -> DataFrame:
    """columns start with ts and packet_id; initial: rows of keys and what their state takes. Needs the RocksDB state store."""
    out = [c.split()[0] for c in schema.split(", ")]
    place = F.xxhash64(*keys)
    shard, page = F.pmod(place, F.lit(SHARDS)).cast("int").alias("fold_shard"), F.pmod(F.shiftright(place, 32), F.lit(PAGES)).cast("int").alias("fold_page")
    needed = {*columns, *keys, "event_time"}
    rows = stream.select(*[c for c in stream.columns if c in needed], shard, page)
    start = initial.select("*", shard, page).groupBy("fold_shard") if initial is not None else None
    return rows.groupBy("fold_shard").transformWithStateInPandas(Sorted(make, keys, columns, out, idle, weight), schema, "Append", "EventTime", start)


FLOW_SCHEMA = (
    "flow_key string, session_no long, proto string, initiator_ip string, initiator_port int, responder_ip string, responder_port int, start_ts double, "
    "last_seen_ts double, packets_forward long, bytes_forward long, packets_reverse long, bytes_reverse long, total_packets long, total_bytes long, tcp_state string"
)
CLAIM_SCHEMA = "packet_id long, ts double, dst string, arp_op int, ip string, mac string, original_mac string, conflict boolean"
HOLD_SCHEMA = "packet_id long, ts double, ip string, mac string, conflict boolean, held long, claimed_ips string"


def stream_flows(stream: DataFrame, established: float = 300.0, other: float = 60.0) -> DataFrame:
    """Flows, each when it has been silent for longer than its state allows: those that aggregate_flows gives of sessionize. session_no starts anew where a key
    has been silent for longer than both."""
    keyed = stream.withColumn("flow_key", F.coalesce(flow_key_text(canonical_flow_key()), F.lit("")))
    columns = ["ts", "packet_id", "src", "sport", "dst", "dport", "proto", "flags", "size", "flow_key"]
    return stream_fold(keyed, ["flow_key"], lambda: FlowState(established, other), columns, FLOW_SCHEMA, max(established, other))


def stream_port_scan(stream: DataFrame, window: float = 10.0, threshold: int = 15) -> DataFrame:
    schema = (
        "packet_id long, ts double, src string, dst string, scan_type string, unique_targets long, unique_ports long, unique_hosts long, "
        "cms_estimated_volume long, elapsed double, ewma_rate double"
    )
    columns = ["ts", "packet_id", "src", "dst", "dport"]
    return stream_fold(stream.where(pure_syn()), ["src"], lambda: ScanState(window, threshold, None), columns, schema, window)


def stream_syn_flood(stream: DataFrame, window: float = 5.0, threshold: int = 40, ratio: float = 0.8) -> DataFrame:
    """What flood_events gives. Spark gathers packets by target and time bucket, a bit wider than the window, so a busy target is many groups, and a bucket is one row
    of the fold, which goes through its packets just where an alert is possible. An alert comes when the watermark has passed its bucket."""
    width = int(window * 1000) + 1
    packet = F.struct("ts", "packet_id", "src", "pair", "is_ack")
    g = flood_packets(stream).groupBy("target", F.window("event_time", f"{width} milliseconds").alias("w"))
    g = g.agg(F.count_if(~F.col("is_ack")).alias("opened"), F.count("*").alias("packets"), F.collect_list(packet).alias("rows"))
    rows = g.select("target", "opened", "packets", F.sort_array("rows").alias("rows"), (F.unix_micros("w.start") / 1_000_000).alias("ts"), F.lit(0).cast("long").alias("packet_id"), F.window_time("w").alias("event_time"))
    lists = {"times": "ts", "ids": "packet_id", "sources": "src", "pairs": "pair", "acks": "is_ack"}
    rows = rows.select("target", "opened", "packets", "ts", "packet_id", "event_time", *[F.col(f"rows.{c}").alias(k) for k, c in lists.items()])
    make = lambda: FloodBuckets(window, threshold, ratio, width / 1000)
    # a bucket that comes when the watermark is four widths past another's start begins after that one's end and the window behind it
    return stream_fold(rows, ["target"], make, ["ts", "packet_id", "target", "opened", "packets", *lists], FLOOD_SCHEMA, 4 * width / 1000, weight="packets")


def stream_dns_scores(stream: DataFrame, window: float = 15.0, **options) -> DataFrame:
    """What dns_scores gives; name_alerts makes alerts of it."""
    names = NAME_COLUMNS
    columns = ["ts", "packet_id", *[c for c in names if c not in ("ts", "packet_id")]]
    schema = "packet_id long, ts double, src string, dst string, qname string, dns_qtype int, subdomain string, parent string, entropy double, burst long"
    found = stream_fold(name_queries(stream), ["src", "parent"], lambda: BurstState(window, names), columns, schema, window)
    return scored_names(found, **options)


def stream_arp_claims(stream: DataFrame, forget: float | None = None) -> DataFrame:
    """Each claim of an address with its holder before: what arp_conflicts gives. forget: seconds of silence after which an address leaves the state; its next
    claim then has no holder before it, so a change of hands over so long a silence may be missed. None keeps each address, one short row of state."""
    columns = ["ts", "packet_id", "dst", "arp_op", "ip", "mac"]
    return stream_fold(arp_claims(stream), ["ip"], ClaimState, columns, CLAIM_SCHEMA, forget)


def stream_arp_holdings(claims: DataFrame, max_ips: int = 3, forget: float | None = None) -> DataFrame:
    """Each claim with how many addresses its holder has then: what arp_holdings gives; claimed_ips names them where there is an alert, else it is null. claims: a
    stream over a table that stream_arp_claims is written to, with event_time and a watermark, since an address and a holder are keys of different queries. forget:
    seconds of silence after which a holder's addresses leave the state; None keeps them."""
    came = F.struct(F.col("mac").alias("mac"), F.lit(True).alias("claim"))
    went = F.when(F.col("conflict"), F.struct(F.col("original_mac").alias("mac"), F.lit(False).alias("claim")))
    rows = claims.withColumnRenamed("mac", "to").withColumn("mac", F.col("to"))
    rows = rows.withColumn("step", F.explode(F.array_compact(F.array(came, went)))).withColumn("mac", F.col("step.mac")).withColumn("claim", F.col("step.claim"))
    columns = ["ts", "packet_id", "ip", "mac", "claim", "conflict"]
    return stream_fold(rows, ["mac"], lambda: HoldState(max_ips), columns, HOLD_SCHEMA, forget)


def stream_dedup(alerts: DataFrame, cooldown: float = 60.0, initial: DataFrame | None = None) -> DataFrame:
    """What dedup_alerts gives. initial: what cooldown_state gives of the alerts before the stream's, so that it goes on where a batch ended."""
    return stream_fold(alerts, ["alert_type", "src", "dst"], lambda: CooldownState(cooldown), ["ts", "packet_id", "id"], "id string, suppressed long", cooldown, initial)


def stream_target_sketches(stream: DataFrame) -> DataFrame:
    """What target_sketches gives, a minute when the watermark has passed it: state is a sketch instead of a set of targets."""
    g = stream.where(pure_syn()).groupBy("src", F.window("event_time", "1 minute").alias("w")).agg(F.hll_sketch_agg(F.concat_ws(":", "dst", F.col("dport").cast("string")), SKETCH_BITS).alias("sketch"))
    return g.select("src", (F.unix_micros("w.start") / 1_000_000).cast("double").alias("minute_ts"), "sketch")


def late_rows(query: StreamingQuery) -> int:
    """Rows that a query's stateful steps have dropped because the watermark had passed them, as far as its progress is kept. An aggregation combines rows before
    its state, so there a group of late rows counts once for each task."""
    return sum(int(s.numRowsDroppedByWatermark) for p in query.recentProgress for s in p.stateOperators)


def run_available(df: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "update") -> StreamingQuery:
    """Feed all that is there to sink(batch, number) and stop."""
    q = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()
    return q


def upsert_sink(table: Table) -> Callable[[DataFrame, int], None]:
    return lambda batch, number: table.upsert(batch, number) and None
