"""Order-dependent work with resets, as folds over sorted partitions: a key's rows stream past, and only its small state is held."""

from __future__ import annotations

from collections import deque, namedtuple
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored
from .scans import bucket, joined, running_total


def sorted_fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], object], schema: str, partitions: int | None = None) -> DataFrame:
    """start() gives a state with step(row) -> list of result tuples, and end() -> the same. Keys stay whole; batches of any size give the same rows."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                own = tuple(None if pd.isna(v) else v for v in (getattr(row, k) for k in keys))
                if state is None or own != key:
                    if state is not None:
                        out += state.end()
                    key, state = own, start()
                out += state.step(row)
            yield pd.DataFrame(out, columns=names)
        if state is not None:
            yield pd.DataFrame(state.end(), columns=names)

    dealt = df.repartition(partitions, *keys) if partitions else df.repartition(*keys)
    return dealt.sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def segments(df: DataFrame, key: str | list[str], silence: float | None, least: int = 1, counted: Column | None = None, closed: bool = False) -> DataFrame:
    """df with `segment`, which rises wherever a key is silent for longer than `silence` seconds (closed: for as long or longer), `before`, the key's rows ahead of
    its segment, and `all`, the segment's; those of fewer than `least` counted rows are left out. Where nothing outlives the silence, a busy key is then many folds.

    Rows meet in time buckets as wide as the silence, where no cut can be inside; the cuts are found on one row for each bucket, which partial aggregation gives,
    so no task sorts a whole key. Without a silence each key is one segment."""
    keys = [key] if isinstance(key, str) else key
    own = F.floor(F.col("ts") / silence).cast("long") if silence else F.lit(0).cast("long")
    df = df.withColumn("bucket", own)
    n = F.count_if(counted) if counted is not None else F.count("*")
    buckets = df.groupBy(*keys, "bucket").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), n.alias("n"))
    rising = Window.partitionBy(*keys).orderBy("bucket")
    gap = F.col("first") - F.lag("last").over(rising)
    buckets = buckets.withColumn("cut", F.coalesce((gap >= silence if closed else gap > (silence or 0.0)).cast("long"), F.lit(0)))
    sums = [F.sum(c).over(rising.rowsBetween(Window.unboundedPreceding, 0)) for c in ("cut", "n")]
    buckets = buckets.select(*keys, "bucket", "n", sums[0].alias("segment"), (sums[1] - F.col("n")).alias("ahead"))
    whole = Window.partitionBy(*keys, "segment")
    buckets = buckets.select(*keys, "bucket", "segment", F.min("ahead").over(whole).alias("before"), F.sum("n").over(whole).alias("all"))
    return joined(df, buckets.where(F.col("all") >= least), [*keys, "bucket"]).drop("bucket")


def sliding_distinct(df: DataFrame, keys: list[str], item: Column, window: float, name: str) -> DataFrame:
    """df with a column: how many distinct items (null is none) the key has in the `window` seconds up to each row, by (ts, packet_id), its own included.

    An item is there from its first row until `window` seconds after the last one that no other follows in that time, so the number is a running sum of what
    begins and ends. In a bucket of at most that width only an item's first and last row can begin or end, so items are combined before the shuffle; the running
    sum is one within each bucket, on top of what the key's earlier buckets come to, so no task holds a whole key."""
    bucket = lambda ts: F.floor(ts / window).cast("long")
    rows = df.withColumn("_item", item)
    place = F.struct("ts", "packet_id")
    seen = rows.where("_item is not null").groupBy(*keys, "_item", bucket(F.col("ts")).alias("_b")).agg(F.min(place).alias("first"), F.max(place).alias("last"))
    own = Window.partitionBy(*keys, "_item").orderBy("_b")
    new = F.coalesce(F.col("first.ts") - F.lag("last").over(own)["ts"] > window, F.lit(True))
    over = F.coalesce(F.lead("first").over(own)["ts"] - F.col("last.ts") > window, F.lit(True))
    seen = seen.withColumn("new", new).withColumn("over", over)
    nothing = F.lit(None)
    both = F.array(
        F.when(F.col("new"), F.struct(F.col("first.ts").alias("ts"), F.lit(0).alias("late"), F.col("first.packet_id").alias("packet_id"), F.lit(1).alias("step"))).otherwise(nothing),
        F.when(F.col("over"), F.struct((F.col("last.ts") + window).alias("ts"), F.lit(1).alias("late"), F.col("last.packet_id").alias("packet_id"), F.lit(-1).alias("step"))).otherwise(nothing),
    )
    steps = seen.select(*keys, F.explode(F.array_compact(both)).alias("e")).select(*keys, "e.*", F.lit(None).alias("_row"))
    marks = rows.select(*keys, "ts", F.lit(0).alias("late"), "packet_id", F.lit(0).alias("step"), F.struct(*[c for c in df.columns]).alias("_row"))
    sums = steps.groupBy(*keys, bucket(F.col("ts")).alias("_b")).agg(F.sum("step").alias("_sum"))
    ahead = Window.partitionBy(*keys).orderBy("_b").rangeBetween(Window.unboundedPreceding, -1)
    line = Window.partitionBy(*keys, "_b").orderBy("ts", "late", "packet_id", F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    # a bucket without any step takes what the last one with steps leaves, so every bucket of the rows stands in the sums, with 0
    sums = sums.unionByName(rows.groupBy(*keys, bucket(F.col("ts")).alias("_b")).agg(F.lit(0).cast("long").alias("_sum"))).groupBy(*keys, "_b").agg(F.sum("_sum").alias("_sum"))
    sums = sums.select(*keys, "_b", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    line_of = marks.unionByName(steps).withColumn("_b", bucket(F.col("ts"))).withColumn("_n", F.sum("step").over(line)).where("_row is not null")
    out = line_of.join(sums, [*keys, "_b"])
    return out.select("_row.*", (F.col("_n") + F.col("_ahead")).alias(name))


class ScanState:
    """Distinct targets of one source in a sliding window that an alert empties; on request the slow path too, which a fast alert's packet does not feed."""

    def __init__(self, window: float, threshold: int, slow: tuple[int, float, float] | None):
        self.window, self.threshold, self.slow = window, threshold, slow
        self.queue, self.counts, self.first, self.volume = deque(), {}, None, 0

    def step(self, row) -> list[tuple]:
        self.volume += 1
        volume = getattr(row, "before", 0) + self.volume  # a stream has no rows ahead of its state
        target = (row.dst, row.dport)
        self.queue.append((row.ts, target))
        self.counts[target] = self.counts.get(target, 0) + 1
        while self.queue[0][0] < row.ts - self.window:
            old = self.queue.popleft()[1]
            self.counts[old] -= 1
            if not self.counts[old]:
                del self.counts[old]
        if len(self.counts) >= self.threshold:
            hosts, ports = {h for h, _ in self.counts}, {p for _, p in self.counts}
            n = len(self.counts)
            self.queue.clear()
            self.counts.clear()
            kind = "vertical" if len(hosts) == 1 and len(ports) > 1 else "horizontal" if len(hosts) > 1 and len(ports) == 1 else "distributed/hybrid"
            return [(row.packet_id, row.ts, row.src, min(hosts) if len(hosts) == 1 else None, kind, n, len(ports), len(hosts), volume, None, None)]
        return self.crawl(row, target) if self.slow else []

    def crawl(self, row, target) -> list[tuple]:
        enough, age, alpha = self.slow
        if self.first is None:
            self.first, self.last, self.rate, self.seen = row.ts, row.ts, 1.0, {target}
            return []
        self.rate += alpha * (1.0 / max(0.001, row.ts - self.last) - self.rate)
        self.last = row.ts
        self.seen.add(target)
        elapsed, out = row.ts - self.first, []
        if elapsed > self.window and len(self.seen) >= enough:
            out = [(row.packet_id, row.ts, row.src, None, "low_and_slow", len(self.seen), None, None, getattr(row, "before", 0) + self.volume, round(elapsed, 1), round(self.rate, 4))]
        if out or elapsed > age:
            self.first = None
        return out

    def end(self) -> list[tuple]:
        return []


class FloodState:
    """Opened connections to one target in a sliding window that an alert empties, and when each endpoint pair was last acknowledged. How many of the opened ones
    have no acknowledgement is kept up as rows come and go, so a row costs the same in a window of any size."""

    def __init__(self, window: float, threshold: int, ratio: float):
        self.window, self.threshold, self.ratio, self.queue, self.acked = window, threshold, ratio, deque(), {}
        self.opened, self.open = {}, 0  # by pair, and those of pairs that aren't acknowledged

    def step(self, row) -> list[tuple]:
        pair = row.pair
        if row.is_ack:
            if self.acked.pop(pair, None) is None:
                self.open -= self.opened.get(pair, 0)
            self.acked[pair] = row.ts
            return []
        self.queue.append((row.ts, pair, row.src))
        self.opened[pair] = self.opened.get(pair, 0) + 1
        self.open += pair not in self.acked
        edge = row.ts - self.window
        while self.queue[0][0] < edge:
            old = self.queue.popleft()[1]
            self.open -= old not in self.acked
            self.opened[old] -= 1
            if not self.opened[old]:
                del self.opened[old]
        while self.acked and self.acked[first := next(iter(self.acked))] < edge:
            del self.acked[first]
            self.open += self.opened.get(first, 0)
        n = len(self.queue)
        if n < self.threshold or self.open / n < self.ratio:
            return []
        sources, open_ = {s for _, _, s in self.queue}, self.open
        self.queue.clear()
        self.opened, self.open = {}, 0
        return [(row.packet_id, row.ts, next(iter(sources)) if len(sources) == 1 else None, row.target, open_, n, round(open_ / n, 2), len(sources))]

    def end(self) -> list[tuple]:
        return []


FloodPacket = namedtuple("FloodPacket", "ts packet_id src pair is_ack target")


class FloodBuckets:
    """FloodState over buckets of one target's packets, each at least as wide as the window: only where a bucket and the one before it hold `threshold` opened
    connections is an alert possible in it, and just such buckets and those before them are gone through packet by packet."""

    def __init__(self, window: float, threshold: int, ratio: float, width: float):
        self.fold, self.width, self.before = FloodState(window, threshold, ratio), width, None

    def step(self, row) -> list[tuple]:
        before, out = self.before, []
        near = before is not None and row.ts - before[0] < 1.5 * self.width
        hot = row.opened + (before[1] if near else 0) >= self.fold.threshold
        own = (row.times, row.ids, row.sources, row.pairs, row.acks)
        if hot and near and before[2] is not None:
            out += self.packets(row.target, before[2])  # no alert is in these
        out += self.packets(row.target, own) if hot else []
        self.before = (row.ts, row.opened, None if hot else own)
        return out

    def packets(self, target: str, columns: tuple) -> list[tuple]:
        out = []
        for packet in zip(*(x if isinstance(x, list) else x.tolist() for x in columns), strict=True):
            out += self.fold.step(FloodPacket(*packet, target))
        return out

    def end(self) -> list[tuple]:
        return []


class BurstState:
    """Distinct subdomains that a source asks of one parent in a sliding window, for each query; an empty subdomain is none."""

    def __init__(self, window: float, columns: list[str]):
        self.window, self.columns, self.queue, self.counts = window, columns, deque(), {}

    def step(self, row) -> list[tuple]:
        while self.queue and self.queue[0][0] < row.ts - self.window:
            old = self.queue.popleft()[1]
            self.counts[old] -= 1
            if not self.counts[old]:
                del self.counts[old]
        if row.subdomain:
            self.queue.append((row.ts, row.subdomain))
            self.counts[row.subdomain] = self.counts.get(row.subdomain, 0) + 1
        return [(*(getattr(row, c) for c in self.columns), len(self.counts))]

    def end(self) -> list[tuple]:
        return []


class ClaimState:
    """One address: each claim with the holder before it."""

    def __init__(self):
        self.mac = None

    def step(self, row) -> list[tuple]:
        before, self.mac = self.mac, row.mac
        return [(row.packet_id, row.ts, row.dst, row.arp_op, row.ip, row.mac, before, before is not None and before != row.mac)]

    def end(self) -> list[tuple]:
        return []


class HoldState:
    """One holder: how many addresses it holds at each of its claims, and which where that makes an alert."""

    def __init__(self, max_ips: int = 3):
        self.max_ips, self.ips = max_ips, set()

    def step(self, row) -> list[tuple]:
        (self.ips.add if row.claim else self.ips.discard)(row.ip)
        if not row.claim:
            return []
        told = not row.conflict and len(self.ips) > self.max_ips
        return [(row.packet_id, row.ts, row.ip, row.mac, row.conflict, len(self.ips), ",".join(sorted(self.ips)) if told else None)]

    def end(self) -> list[tuple]:
        return []


class CooldownState:
    def __init__(self, seconds: float):
        self.seconds, self.last, self.held = seconds, None, 0

    def step(self, row) -> list[tuple]:
        if self.last is not None and row.ts - self.last < self.seconds:
            self.held += 1
            return []
        out = [(row.id, self.held)]
        self.last, self.held = row.ts, 0
        return out

    def end(self) -> list[tuple]:
        return []

    def restore(self, row) -> float:
        """Takes up what cooldown_state says of a key; when its last alert was."""
        self.last, self.held = float(row.last), int(row.held)
        return self.last

    def rests(self) -> bool:
        """Whether the state still says something after any silence: how many alerts the next one stands for."""
        return self.held > 0


_ALERT_KEYS = ["alert_type", "src", "dst"]
_EMITTED = "id string, suppressed long, opens boolean, alert_type string, src string, dst string, segment long"


class PieceState:
    """A piece of one key between silences: the emitted alerts, and at the end a row without id for those suppressed since."""

    def __init__(self, seconds: float):
        self.cooldown, self.own = CooldownState(seconds), None

    def step(self, row) -> list[tuple]:
        opens, self.own = self.own is None, (row.alert_type, row.src, row.dst, row.segment)
        return [(*out, opens, *self.own) for out in self.cooldown.step(row)]

    def end(self) -> list[tuple]:
        return [(None, self.cooldown.held, False, *self.own)]


def _chains(rows: DataFrame, cooldown: float) -> DataFrame:
    """What folds of PieceState give, by pointer doubling: an alert points at the first one that is a cooldown or more after it, and the emitted ones are those that
    the pointers of a piece's first one lead to. Each round marks where the pointers of all marked ones lead and doubles the pointers' length."""
    keys = [*_ALERT_KEYS, "segment"]
    alert = F.struct("ts", "packet_id", "id")
    wait = F.struct((F.col("ts") + cooldown).alias("t"), F.lit(0).alias("kind"))
    # each stands in its own bucket as an answer and in the next one as a question; in the one after that any answer is far enough
    both = rows.select(*keys, alert.alias("alert"), F.explode(F.array(F.struct(bucket(cooldown).alias("_b"), F.struct(F.col("ts").alias("t"), F.lit(1).alias("kind")).alias("at")), F.struct((bucket(cooldown) + 1).alias("_b"), wait.alias("at")))).alias("e")).select(*keys, "alert", "e.*")
    line = Window.partitionBy(*keys, "_b").orderBy("at", "alert").rowsBetween(1, Window.unboundedFollowing)
    both = both.withColumn("to", F.first(F.when(F.col("at.kind") == 1, F.col("alert")), True).over(line)).where("at.kind = 0")
    first = rows.groupBy(*keys, bucket(cooldown).alias("_b")).agg(F.min(alert).alias("far"))
    pointers = joined(both, first.select(*keys, (F.col("_b") - 1).alias("_b"), "far"), [*keys, "_b"], "left")
    pointers = stored(pointers.select(F.col("alert.id").alias("id"), F.coalesce("to", "far")["id"].alias("to")).where("to is not null"), "pointers")
    marked = stored(rows.groupBy(*keys).agg(F.min(alert)["id"].alias("id")).select("id"), "marked")
    while True:
        new = stored(pointers.join(marked, "id").select(F.col("to").alias("id")), "marked")
        if not new.limit(1).count():
            break
        marked = marked.union(new)
        pointers = stored(pointers.join(pointers.select(F.col("id").alias("to"), F.col("to").alias("then")), "to").select("id", F.col("then").alias("to")), "pointers")
    placed = running_total(rows, keys, F.lit(1), "place", cooldown, ("ts", "packet_id", "id")).select(*keys, "id", "ts", "packet_id", "place", "all")
    emitted = stored(placed.join(marked, "id"), "emitted")
    before = Window.partitionBy(*keys, "_b").orderBy("place")
    # at most one is emitted in a bucket, so the one before is that of a bucket of buckets or of the one before it
    emitted = emitted.withColumn("_b", F.floor(F.col("ts") / (cooldown * 1000)).cast("long"))
    last = emitted.groupBy(*keys, "_b").agg(F.max("place").alias("_m"))
    last = last.select(*keys, "_b", F.lag("_m").over(Window.partitionBy(*keys).orderBy("_b")).alias("_m"))
    found = joined(emitted.withColumn("_p", F.lag("place").over(before)), last, [*keys, "_b"])
    since = F.col("place") - F.coalesce("_p", "_m", F.lit(0)) - 1
    out = found.select("id", since.cast("long").alias("suppressed"), (F.col("place") == 1).alias("opens"), *keys)
    rest = emitted.groupBy(*keys, "all").agg(F.max("place").alias("_m"))
    return out.union(rest.select(F.lit(None).cast("string"), (F.col("all") - F.col("_m")).cast("long"), F.lit(False), *keys))


def dedup_alerts(alerts: DataFrame, cooldown: float = 60.0, hot: int = 500_000) -> DataFrame:
    """Alerts that no alert of the same type, src and dst precedes by less than the cooldown, as emitted; suppressed counts those left out since the last one.

    A silence as long as the cooldown ends it, so a key's pieces between silences are folds of their own, and only the count of the suppressed goes over to the next
    piece. Pieces of over `hot` alerts, where one key has a large part of all of them, are worked out by pointer doubling, which no task does alone."""
    rows = stored(segments(alerts.select("id", "ts", "packet_id", *_ALERT_KEYS), _ALERT_KEYS, cooldown, closed=True), "pieces")
    found = sorted_fold(rows.where(F.col("all") <= hot), [*_ALERT_KEYS, "segment"], ["ts", "packet_id", "id"], lambda: PieceState(cooldown), _EMITTED)
    if rows.where(F.col("all") > hot).limit(1).count():
        found = found.union(_chains(rows.where(F.col("all") > hot), cooldown))
    found = stored(found, "emitted")
    carry = F.lag("suppressed").over(Window.partitionBy(*_ALERT_KEYS).orderBy("segment"))  # a row for each piece
    carried = found.where("id is null").select(*_ALERT_KEYS, "segment", carry.alias("carried")).where("carried > 0")
    keep = joined(found.where("id is not null"), carried, [*_ALERT_KEYS, "segment"], "left")
    keep = keep.select("id", (F.col("suppressed") + F.when(F.col("opens"), F.coalesce("carried", F.lit(0))).otherwise(0)).alias("suppressed"))
    return alerts.join(keep, "id")


def cooldown_state(alerts: DataFrame, cooldown: float = 60.0) -> DataFrame:
    """By key, when its last emitted alert was and how many were suppressed since: where dedup_alerts over these alerts ends."""
    place = F.struct("ts", "packet_id", "id")
    ends = dedup_alerts(alerts, cooldown).groupBy(*_ALERT_KEYS).agg(F.max(place).alias("end"))
    rows = joined(alerts, ends, _ALERT_KEYS)
    return rows.groupBy(*_ALERT_KEYS).agg(F.max("end.ts").alias("last"), F.count_if(place > F.col("end")).alias("held"))


class SessionState:
    """Pieces of one flow key, each with what its packets say; joined while the pause is short enough for the state so far."""

    def __init__(self, established: float, other: float):
        self.established, self.other, self.session, self.last, self.flags = established, other, 0, None, None

    def step(self, row) -> list[tuple]:
        if self.last is not None:
            pause = row.ts - self.last
            if pause > self.established or pause > self.other and state_of(self.flags) != "ESTABLISHED":
                self.session += 1
                self.flags = None
        if self.flags is None:
            self.flags = {"src": row.src, "sport": row.sport, "proto": row.proto, "state": "NONE", "fin": set()}
        follow(self.flags, row)
        self.last = row.ts
        return [(row.packet_id, row.fkey, row.segment, self.session)]

    def end(self) -> list[tuple]:
        return []


class FlowState:
    """One flow key's packets as flows: a row for each when the pause is too long for the state so far."""

    def __init__(self, established: float, other: float):
        self.established, self.other, self.number, self.own = established, other, 0, None

    def step(self, row) -> list[tuple]:
        out = []
        if self.own is not None:
            pause = row.ts - self.own["last"]
            if pause > self.established or pause > self.other and self.own["state"] != "ESTABLISHED":
                out = self.end()
        if self.own is None:
            self.own = {"src": row.src, "sport": row.sport, "dst": row.dst, "dport": row.dport, "proto": row.proto, "key": row.flow_key}
            self.own |= {"state": "NONE", "fin": set(), "start": row.ts, "sides": {True: [0, 0], False: [0, 0]}}
        own = self.own
        follow(own, row)
        side = own["sides"][row.src == own["src"] and (missing(row.sport) or missing(own["sport"]) or row.sport == own["sport"])]
        side[0] += 1
        side[1] += 0 if missing(row.size) else int(row.size)
        own["last"] = row.ts
        return out

    def end(self) -> list[tuple]:
        own, self.own = self.own, None
        if own is None:
            return []
        port = lambda x: None if missing(x) else int(x)
        (pf, bf), (pr, br) = own["sides"][True], own["sides"][False]
        self.number += 1
        return [(own["key"], self.number - 1, own["proto"], own["src"], port(own["sport"]), own["dst"], port(own["dport"]), own["start"], own["last"], pf, bf, pr, br, pf + pr, bf + br, own["state"])]


def missing(x) -> bool:
    """Whether a number is null: None, pandas' NA or NaN."""
    return x is None or x is pd.NA or x != x


def state_of(flags: dict) -> str:
    return flags["state"]


def follow(own: dict, row) -> None:
    """One packet's step of the connection state: a reset, then FINs, then the handshake."""
    flags = row.flags if row.proto == "TCP" and isinstance(row.flags, str) else ""
    forward = row.src == own["src"] and (missing(row.sport) or missing(own["sport"]) or row.sport == own["sport"])
    if "R" in flags:
        own["state"] = "RESET"
    elif "F" in flags:
        own["fin"].add(forward)
        own["state"] = "CLOSED" if len(own["fin"]) == 2 else "FIN_WAIT"
    elif own["state"] in ("NONE", "SYN_SENT", "SYN_RECEIVED"):
        if "S" in flags and "A" not in flags:
            own["state"] = "SYN_SENT" if own["state"] == "NONE" else own["state"]
        elif "S" in flags and "A" in flags and not forward and own["state"] == "SYN_SENT":
            own["state"] = "SYN_RECEIVED"
        elif "A" in flags and (forward or own["state"] == "NONE"):
            own["state"] = "ESTABLISHED"


def sessionize(packets: DataFrame, established: float = 300.0, other: float = 60.0) -> DataFrame:
    """Adds session_no to each packet: a flow ends when it is silent for longer than its state allows, and its next packet starts a new one."""
    from ..functions.expressions import canonical_flow_key, flow_key_text

    rows = packets.withColumn("fkey", F.coalesce(flow_key_text(canonical_flow_key()), F.lit("")))
    # no state outlives the longer pause, so the pieces between such pauses are folds of their own
    pieces = segments(rows.select("fkey", "packet_id", "ts", "src", "sport", "proto", "flags"), "fkey", max(established, other))
    schema = "packet_id long, fkey string, segment long, within long"
    fold = sorted_fold(pieces, ["fkey", "segment"], ["ts", "packet_id"], lambda: SessionState(established, other), schema)
    ahead = Window.partitionBy("fkey").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    sizes = fold.groupBy("fkey", "segment").agg((F.max("within") + 1).alias("sessions"))
    first = sizes.select("fkey", "segment", F.coalesce(F.sum("sessions").over(ahead), F.lit(0)).alias("first"))
    numbers = fold.join(first, ["fkey", "segment"]).select("packet_id", (F.col("first") + F.col("within")).alias("session_no"))
    return packets.join(numbers, "packet_id")
