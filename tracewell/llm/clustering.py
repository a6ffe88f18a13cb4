"""Centroid clustering over Hilbert-ordered blocks with zone maps, in exact integers.

Vectors are dealt by range of their place on a Hilbert curve and packed into blocks that hold the least and largest value of each component. In each round the
distances of a centroid to a block's box bound those to its vectors, so centroids that another one beats for all of the box leave before any vector is
compared; the others are compared exactly. Rounds read the blocks again and shuffle a sum for each task, centroid and component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read, save

WIDTH, SCALE, CENTROIDS, ROUNDS = 64, 64, 16, 3
#: Vectors in a block; bits of each component on the curve; components are cut off here, so that a squared distance fits 64 bits.
BLOCK, BITS, EDGE = 256, 2, 1 << 27
_LONG = 2**63 - 1


def whole_vectors(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the components times scale, rounded down: rows whose vector has exactly width components, none of them null or not finite."""
    x = F.col(vector_column).cast("array<double>")
    fits = (F.size(x) == width) & F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf")))
    cut = lambda y: F.greatest(F.lit(-EDGE), F.least(F.lit(EDGE), F.floor(y * scale))).cast("int")
    return rows.where(F.coalesce(fits, F.lit(False))).select(F.col(id_column).cast("long").alias("vec_id"), F.transform(x, cut).alias("v"))


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve, most significant byte first, of rows of cells, numbers below 2**bits."""
    x = np.ascontiguousarray(cells.T.astype(np.uint8))
    top = 1 << (bits - 1)
    level = top
    while level > 1:
        low = np.uint8(level - 1)
        for i in range(len(x)):
            inside = (x[i] & level) != 0
            swap = np.where(inside, 0, (x[0] ^ x[i]) & low).astype(np.uint8)
            x[0] ^= np.where(inside, low, swap)
            x[i] ^= swap
        level >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint8)
    level = top
    while level > 1:
        turn = np.where((x[-1] & level) != 0, turn ^ np.uint8(level - 1), turn)
        level >>= 1
    x ^= turn
    planes = np.concatenate([(x >> b) & 1 for b in range(bits - 1, -1, -1)])
    return np.packbits(planes.T, axis=1)


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _spread(width: int):
    """A task's sums of each component and of its square."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares = 0, np.zeros(width), np.zeros(width)
        for batch in batches:
            v = _matrix(batch, width).astype(float)
            n, sums, squares = n + len(v), sums + v.sum(0), squares + (v * v).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(np.full(width, n, np.int64)), pa.array(sums), pa.array(squares)], ["dim", "n", "s", "q"])

    return run


def _keys(mean: np.ndarray, deviation: np.ndarray):
    """Each row with its key: components in the order of how far they spread, in cells of one deviation about the mean."""
    order = np.argsort(-deviation, kind="stable")
    cells = 1 << BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = (_matrix(batch, len(mean))[:, order] - mean[order]) / deviation[order]
            keys = hilbert_keys(np.clip(np.floor(z) + cells // 2, 0, cells - 1))
            at = np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1]
            packed = pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(keys))])
            yield pa.RecordBatch.from_arrays([*batch.columns, packed], [*batch.schema.names, "key"])

    return run


def _pack(width: int, block: int):
    """A task's sorted rows as blocks."""

    def row(ids: list, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"ids": pa.array([ids], pa.list_(pa.int64())), "vectors": pa.array([v.astype(np.int32).tobytes()], pa.binary())} | {k: pa.array([x.tolist()], pa.list_(pa.int32())) for k, x in (("lo", v.min(0)), ("hi", v.max(0)))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rest = [], np.zeros((0, width), np.int32)
        for batch in batches:
            ids += batch.column("vec_id").to_pylist()
            rest = np.concatenate([rest, _matrix(batch, width)])
            while len(ids) >= block:
                yield row(ids[:block], rest[:block])
                ids, rest = ids[block:], rest[block:]
        if ids:
            yield row(ids, rest)

    return run


def zone_blocks(vectors: DataFrame, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """Blocks of neighbours on the curve: ids, vectors (32-bit components end to end), lo and hi (the box). Equal vectors are dealt on by their ids."""
    spread = vectors.select("v").mapInArrow(_spread(width), "dim int, n long, s double, q double").groupBy("dim").agg(*[F.sum(c).alias(c) for c in "nsq"]).orderBy("dim").collect()  # one row for each component
    n, s, q = (np.array([r[c] for r in spread], float) for c in "nsq")
    mean = s / np.maximum(n, 1)
    deviation = np.sqrt(np.maximum(q / np.maximum(n, 1) - mean * mean, 1e-6))
    keyed = vectors.mapInArrow(_keys(mean, deviation), "vec_id long, v array<int>, key binary").withColumn("salt", F.xxhash64("vec_id"))
    dealt = keyed.repartitionByRange("key", "salt").sortWithinPartitions("key", "salt").select("vec_id", "v")
    return save(dealt.mapInArrow(_pack(width, block), "ids array<long>, vectors binary, lo array<int>, hi array<int>"), "blocks")


def candidates(lo: np.ndarray, hi: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The centroids that may be nearest to some vector of a box: those no farther from its nearest point than another is from its farthest."""
    least = np.square(np.maximum(np.maximum(lo - centroids, centroids - hi), 0)).sum(1)
    most = np.square(np.maximum(np.abs(centroids - lo), np.abs(centroids - hi))).sum(1)
    return np.flatnonzero(least <= most.min())


def _nearest(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for ids, raw, lo, hi in zip(batch.column("ids"), batch.column("vectors"), batch.column("lo"), batch.column("hi"), strict=True):
            v = np.frombuffer(raw.as_buffer(), np.int32).reshape(-1, centroids.shape[1]).astype(np.int64)
            some = candidates(lo.values.to_numpy().astype(np.int64), hi.values.to_numpy().astype(np.int64), centroids)
            far = np.stack([np.square(v - centroids[k]).sum(1) for k in some], 1)
            best = far.argmin(1)  # the first of equals, and candidates stand by number
            yield ids.as_py(), v, some[best], far[np.arange(len(v)), best]


def _sums(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for _, v, cluster, _ in _nearest(batches, centroids):
            np.add.at(count, cluster, 1)
            np.add.at(total, cluster, v)
        cluster, dim = (x.ravel().astype(np.int32) for x in np.indices(centroids.shape))
        some = count[cluster] > 0
        yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (cluster, dim, count[cluster], total.ravel())], ["cluster", "dim", "n", "total"])

    return run


def _assign(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, cluster, distance in _nearest(batches, centroids):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(cluster, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return run


def _long(x: Column) -> Column:
    return F.least(x, F.lit(_LONG)).cast("long")


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each row of vec_id and v, an array of width integers from -EDGE to EDGE.

    Centroids start as the k rows with the smallest SHA-256 of `1:<vec_id>` (of rows that repeat a vec_id, those of the smallest v first); with fewer rows there are
    fewer. A null vec_id starts none, but its row is assigned; where no row has an id, the result is empty. Equal distances go to the smaller number, and an
    empty cluster keeps its centroid. Inertias beyond 64 bits are given as the largest long."""
    spark = vectors.sparkSession
    name = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    seeds = vectors.where("vec_id is not null").orderBy(name, "v").limit(k).select("v").collect()  # k rows
    if not seeds:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    now = np.array([r.v for r in seeds], np.int64)
    blocks = zone_blocks(vectors, width, block)
    for _ in range(rounds):
        found = blocks.mapInArrow(_sums(now), "cluster int, dim int, n long, total long").groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        now = now.copy()
        for r in found.collect():  # k * width rows
            now[r.cluster, r.dim] = int(r.total) // r.n
    assigned = save(blocks.mapInArrow(_assign(now), "vec_id long, cluster int, distance long"), "assigned")
    each = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # k rows
    names = [(i, ",".join(map(str, c))) for i, c in enumerate(now.tolist())]
    known = spark.createDataFrame([(r.cluster, r.s, dict(names)[r.cluster]) for r in each], "cluster int, s decimal(38,0), text string")
    known = known.select("cluster", _long(F.col("s")).alias("cluster_inertia"), _long(F.lit(sum(r.s for r in each)).cast("decimal(38,0)")).alias("inertia"), F.sha2("text", 256).alias("centroid_sha256"))
    return assigned.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    """cluster over all whole vectors of embeddings (whole_vectors); ties, repeated ids and nulls as there. Components beyond EDGE count as EDGE."""
    return cluster(whole_vectors(read(spark, sf_dir, "embeddings")))


def _clustering_sql() -> str:
    """Rounds as a chain of tables: distances by component, the nearest centroid of each row, then the means rounded down."""
    parts = [
        f"kept as materialized (select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as v from embeddings "
        f"where len(embedding) = {WIDTH} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        f"x as materialized (select rid, unnest(range({WIDTH})) as dim, unnest(v) as x from kept)",
        "seeds as (select row_number() over (order by sha256('1:' || vec_id), v) - 1 as cluster, v from kept where vec_id is not null)",
        f"c0 as materialized (select cluster, unnest(range({WIDTH})) as dim, unnest(v) as x from seeds where cluster < {CENTROIDS})",
    ]
    for k in range(ROUNDS + 1):
        parts.append(f"d{k} as materialized (select rid, cluster, sum((x.x - c.x) * (x.x - c.x)) as d from x join c{k} c using (dim) group by rid, cluster)")
        parts.append(f"a{k} as materialized (select rid, cluster, d from d{k} qualify row_number() over (partition by rid order by d, cluster) = 1)")
        if k < ROUNDS:
            parts.append(
                f"c{k + 1} as materialized (select cluster, dim, coalesce(m, x) as x from c{k} left join (select a.cluster, x.dim, (sum(x.x) - (((sum(x.x) % count(*)) + count(*)) % count(*))) // count(*) as m "
                f"from a{k} a join x using (rid) group by a.cluster, x.dim) using (cluster, dim))"
            )
    return (
        f"with {', '.join(parts)}, h as (select cluster, sha256(string_agg(cast(cast(x as bigint) as varchar), ',' order by dim)) as s from c{ROUNDS} group by cluster) "
        "select k.vec_id, cast(a.cluster as integer) as cluster, cast(a.d as bigint) as distance, cast(sum(a.d) over (partition by a.cluster) as bigint) as cluster_inertia, cast(sum(a.d) over () as bigint) as inertia, h.s as centroid_sha256 "
        f"from a{ROUNDS} a join kept k using (rid) join h using (cluster)"
    )


CLUSTERING_SQL = _clustering_sql()
