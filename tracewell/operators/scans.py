"""Ordered work over keys of any size, in two levels: time buckets of a key are worked out apart, and one row for each bucket carries what lies before it.

No task holds a key, only a bucket of it, and a key's buckets as one row each. Order is (ts, packet_id) unless said otherwise; keys may be null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a bucket where no window sets them.
WIDTH = 10.0
_BEFORE = (Window.unboundedPreceding, -1)


def bucket(width: float, ts: str = "ts") -> Column:
    return F.floor(F.col(ts) / width).cast("long")


def joined(rows: DataFrame, more: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on keys that may be null; of both sides' keys those of rows stay."""
    names = {k: f"_of_{k}" for k in keys}
    more = more.select(*[F.col(k).alias(names[k]) if k in names else F.col(k) for k in more.columns])
    return rows.join(more, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(names[k])) for k in keys]), how).drop(*names.values())


def running_total(df: DataFrame, keys: list[str], value: Column, name: str, width: float = WIDTH, order: tuple = ("ts", "packet_id")) -> DataFrame:
    """df with the sum of value over the key's rows up to each row, its own included."""
    rows = df.withColumn("_b", bucket(width)).withColumn("_v", value)
    sums = rows.groupBy(*keys, "_b").agg(F.sum("_v").alias("_s"))
    ahead = F.sum("_s").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(*_BEFORE))
    sums = sums.select(*keys, "_b", F.coalesce(ahead, F.lit(0)).alias("_a"))
    line = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return joined(rows.withColumn("_n", F.sum("_v").over(line)), sums, [*keys, "_b"]).withColumn(name, F.col("_n") + F.col("_a")).drop("_b", "_v", "_n", "_a")


def neighbour(df: DataFrame, keys: list[str], value: Column, name: str, width: float = WIDTH, after: bool = False) -> DataFrame:
    """df with the value of the key's row before each (or after it); null at its first (last)."""
    rows = df.withColumn("_b", bucket(width)).withColumn("_v", F.struct(value.alias("v")))
    step, edge = (F.lead, F.min_by) if after else (F.lag, F.max_by)
    edges = rows.groupBy(*keys, "_b").agg(edge("_v", F.struct("ts", "packet_id")).alias("_l"))
    edges = edges.select(*keys, "_b", step("_l").over(Window.partitionBy(*keys).orderBy("_b")).alias("_a"))
    own = step("_v").over(Window.partitionBy(*keys, "_b").orderBy("ts", "packet_id"))
    return joined(rows.withColumn("_n", own), edges, [*keys, "_b"]).withColumn(name, F.coalesce("_n", "_a")["v"]).drop("_b", "_v", "_n", "_a")


def recent_count(df: DataFrame, keys: list[str], window: float, name: str) -> DataFrame:
    """df with how many rows of the key lie in the window seconds up to each, rows of the same ts included. A row stands in its own bucket and in the next."""
    rows = df.withColumn("_own", bucket(window)).withColumn("_b", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    by = ", ".join(f"`{k}`" for k in [*keys, "_b"])
    count = F.expr(f"count(*) over (partition by {by} order by ts range between {float(window)}D preceding and current row)")
    return rows.withColumn(name, count).where("_b = _own").drop("_b", "_own")


def around(rows: DataFrame, keys: list[str], marked: Column, tolerance: float, after: bool = True) -> DataFrame:
    """The rows that are not marked, with the last marked one of equal keys before (`prior`, a struct of ts and packet_id) and the first one after (`next`), each
    null if it is more than tolerance seconds away. An as-of join of a table with itself: marked rows are carried along in time, over the edge of a bucket
    by one row of it."""
    place = F.struct("ts", "packet_id")
    rows = rows.withColumn("_b", bucket(tolerance)).withColumn("_m", F.coalesce(marked, F.lit(False)))
    edges = rows.where("_m").groupBy(*keys, "_b").agg(F.max(place).alias("_last"), F.min(place).alias("_first"))
    line = Window.partitionBy(*keys, "_b").orderBy("ts", "packet_id")
    mark = F.when(F.col("_m"), place)
    out = rows.withColumn("_p", F.last(mark, True).over(line.rowsBetween(*_BEFORE))).withColumn("_n", F.first(mark, True).over(line.rowsBetween(1, Window.unboundedFollowing)))
    out = out.where("not _m")
    out = joined(out, edges.select(*keys, (F.col("_b") + 1).alias("_b"), F.col("_last")), [*keys, "_b"], "left")
    out = out.withColumn("prior", F.coalesce("_p", "_last"))
    out = out.withColumn("prior", F.when(F.col("prior.ts") >= F.col("ts") - tolerance, F.col("prior")))
    if after:
        out = joined(out, edges.select(*keys, (F.col("_b") - 1).alias("_b"), F.col("_first")), [*keys, "_b"], "left")
        out = out.withColumn("next", F.coalesce("_n", "_first"))
        out = out.withColumn("next", F.when(F.col("next.ts") <= F.col("ts") + tolerance, F.col("next"))).drop("_first")
    return out.drop("_b", "_m", "_p", "_n", "_last")


def moving_rate(df: DataFrame, key: str, alpha: float, width: float = WIDTH) -> DataFrame:
    """key, rate and n of keys with two rows or more: the exponentially weighted rate after the last row, 1 at the first.

    A step is an affine map of the rate, and maps of that kind compose: those of a bucket come to one, a sum in which each row's weight is a power of the
    rows behind it in its bucket and in later ones, so all of it is partial sums."""
    rows = neighbour(df.select(key, "ts", "packet_id"), [key], F.col("ts"), "_last", width).where("_last is not null").withColumn("_b", bucket(width))
    behind = F.row_number().over(Window.partitionBy(key, "_b").orderBy(F.desc("ts"), F.desc("packet_id"))) - 1
    rows = rows.withColumn("_w", F.lit(alpha) / F.greatest(F.lit(0.001), F.col("ts") - F.col("_last")) * F.pow(F.lit(1 - alpha), behind))
    maps = rows.groupBy(key, "_b").agg(F.sum("_w").alias("_w"), F.count("*").alias("n"))
    later = F.coalesce(F.sum("n").over(Window.partitionBy(key).orderBy(F.desc("_b")).rowsBetween(*_BEFORE)), F.lit(0))
    maps = maps.withColumn("_w", F.col("_w") * F.pow(F.lit(1 - alpha), later))
    whole = maps.groupBy(key).agg(F.sum("_w").alias("_w"), F.sum("n").alias("n"))
    return whole.select(key, (F.col("_w") + F.pow(F.lit(1 - alpha), F.col("n"))).alias("rate"), "n")


def _nodes(low: Column, high: Column, levels: int) -> Column:
    """The dyadic nodes (level, node) that an interval of numbers from 0 is made of, two of a level at most."""
    state = F.struct(low.alias("lo"), high.alias("hi"), F.array().cast("array<struct<level:int,node:bigint>>").alias("out"))

    def step(s: Column, level: Column) -> Column:
        some = s["lo"] <= s["hi"]
        odd, even = some & (s["lo"] % 2 == 1), some & (s["hi"] % 2 == 0)
        node = lambda x: F.array(F.struct(level.alias("level"), x.alias("node")))
        none = F.array().cast("array<struct<level:int,node:bigint>>")
        both = F.concat(s["out"], F.when(odd, node(s["lo"])).otherwise(none), F.when(even & ~(odd & (s["lo"] == s["hi"])), node(s["hi"])).otherwise(none))
        lo, hi = s["lo"] + odd.cast("long"), s["hi"] - even.cast("long")
        return F.struct(F.when(lo > hi, F.lit(1).cast("long")).otherwise(F.floor(lo / 2).cast("long")).alias("lo"), F.when(lo > hi, F.lit(0).cast("long")).otherwise(F.floor(hi / 2).cast("long")).alias("hi"), both.alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(levels)), state, step)["out"]


def stabbed(points: DataFrame, runs: DataFrame, keys: list[str], width: float = WIDTH) -> DataFrame:
    """points (ts, packet_id) with the columns of each run of equal keys that covers them: start <= point < end, structs of ts and packet_id, end null if open.

    A run's buckets are a few dyadic nodes, a point's bucket has one ancestor on each level, and equal nodes meet: rows that meet are those given and those at
    a run's edges, instead of all points of a key by all its runs."""
    first, last = points.agg(F.min(bucket(width)), F.max(bucket(width))).first()
    if first is None:
        return points.join(runs.drop(*keys), F.lit(False))
    levels = max(1, int(last - first + 1).bit_length())
    clip = lambda x: F.least(F.lit(last - first), F.greatest(F.lit(0), F.floor(x / width).cast("long") - first)).cast("long")
    some = runs.where((F.col("start.ts") < (last + 1) * width) & (F.col("end").isNull() | (F.col("end.ts") >= first * width)))
    nodes = some.withColumn("_n", F.explode(_nodes(clip(F.col("start.ts")), F.when(F.col("end").isNull(), F.lit(last - first).cast("long")).otherwise(clip(F.col("end.ts"))), levels)))
    nodes = nodes.withColumn("_level", F.col("_n.level")).withColumn("_node", F.col("_n.node")).drop("_n")
    own = points.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumn("_node", F.floor((bucket(width) - first) / F.pow(F.lit(2), F.col("_level"))).cast("long"))
    at = F.struct("ts", "packet_id")
    met = joined(own, nodes, [*keys, "_level", "_node"]).where((F.col("start") <= at) & (F.col("end").isNull() | (at < F.col("end"))))
    return met.drop("_level", "_node")
