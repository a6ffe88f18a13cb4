import hashlib
import math
import random

import numpy as np

from tests.llm.helpers import oracle, rows
from tracewell.llm.clustering import CLUSTERING_SQL, candidates, cluster, hilbert_keys, op13_centroid_clustering, whole_vectors, zone_blocks


def brute(data, k=16, rounds=3):
    """data: (vec_id, list of integers)."""
    name = lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    now = [list(v) for _, v in sorted([r for r in data if r[0] is not None], key=name)[:k]]
    if not now:
        return []
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [min((far(v, c), i) for i, c in enumerate(now)) for _, v in data]
    for _ in range(rounds):
        to = assign()
        for i in range(len(now)):
            own = [v for (_, v), (_, j) in zip(data, to) if i == j]
            if own:
                now[i] = [sum(x) // len(own) for x in zip(*own)]
    to = assign()
    inertia = {i: sum(d for d, j in to if j == i) for i in range(len(now))}
    return [(vec, i, d, inertia[i], sum(inertia.values()), hashlib.sha256(",".join(map(str, now[i])).encode()).hexdigest()) for (vec, _), (d, i) in zip(data, to)]


def test_query_against_sql_and_plain_loops(spark, sf):
    got = op13_centroid_clustering(spark, sf).collect()
    assert rows(got) == oracle(CLUSTERING_SQL, sf)
    data = [(r.vec_id, [math.floor(64 * x) for x in r.embedding]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect() if r.embedding and len(r.embedding) == 64 and all(x is not None and math.isfinite(x) for x in r.embedding)]
    assert sorted(map(tuple, got)) == sorted(brute(data))


def test_odd_vectors(spark):
    rng = random.Random(5)
    nan, inf = float("nan"), float("inf")
    data = [(i, [rng.gauss(i % 5, 0.3) for _ in range(64)]) for i in range(300)] + [(700 + i, [0.25] * 64) for i in range(80)]
    data += [(5, [1.0] * 64), (5, [-1.0] * 64), (5, [-1.0] * 64), (None, [0.5] * 64), (901, [1e300] + [0.0] * 63), (902, [-1e300] * 64)]
    odd = [(800, None), (801, []), (802, [1.0] * 63), (803, [1.0] * 65), (804, [nan] + [1.0] * 63), (805, [inf] * 64), (806, [None] + [1.0] * 63)]
    table = spark.createDataFrame(data + odd, "vec_id long, embedding array<double>").selectExpr("*", "1 as cluster", "2 as key", "3 as v", "4 as dim")
    edge = 1 << 27
    want = brute([(i, [max(-edge, min(edge, math.floor(64 * x))) for x in v]) for i, v in data])
    assert sorted(map(tuple, cluster(whole_vectors(table)).collect()), key=str) == sorted(want, key=str)
    few = table.where("vec_id between 1 and 4 or vec_id is null")
    assert sorted(map(tuple, cluster(whole_vectors(few)).collect()), key=str) == sorted(brute([(i, [math.floor(64 * x) for x in v]) for i, v in data if i is None or 1 <= i <= 4]), key=str)
    for nothing in (table.limit(0), table.where("vec_id >= 800 and vec_id < 900"), table.where("vec_id is null")):
        assert cluster(whole_vectors(nothing)).collect() == []


def test_curve_visits_neighbours():
    """In steps of one cell the curve visits each cell once."""
    for dims, bits in ((2, 4), (3, 2), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = hilbert_keys(cells, bits)
        path = cells[np.lexsort(keys.T[::-1])]
        assert len(np.unique(keys, axis=0)) == len(cells) and (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_boxes_hold_their_vectors_and_bounds_lose_no_centroid(spark, sf):
    vectors = whole_vectors(spark.read.parquet(f"{sf}/embeddings.parquet"))
    blocks = zone_blocks(vectors, block=32).collect()
    assert sum(len(b.ids) for b in blocks) == vectors.count()
    centroids, pruned = np.random.default_rng(3).integers(-30, 30, (16, 64)), 0
    for b in blocks:
        v = np.frombuffer(bytes(b.vectors), np.int32).reshape(-1, 64).astype(np.int64)
        assert (v.min(0) == b.lo).all() and (v.max(0) == b.hi).all()
        some = candidates(np.array(b.lo), np.array(b.hi), centroids)
        assert set(((v[:, None] - centroids) ** 2).sum(2).argmin(1)) <= set(some)
        pruned += 16 - len(some)
    close = np.repeat(np.arange(16)[:, None] * 100, 64, 1)
    assert candidates(np.full(64, 290), np.full(64, 330), close).tolist() == [3]
