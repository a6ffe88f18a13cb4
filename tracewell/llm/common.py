"""Shared pieces of the text operators: the shared folder, Arrow slices of texts, byte hashes and connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker turns into arrays at a time; one longer text is a slice of its own.
SLICE_BYTES = 1_000_000
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
U64 = np.uint64


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset (tests on one machine), a new temporary one."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again: later work starts from there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return freed memory to the system at the end of a task, as Spark keeps its Python workers for other tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library alone
    if trim:
        trim(0)


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of the batches with at most limit bytes of text each: the rows, their UTF-8 bytes end to end, and where each starts (one more for the end).
    Null texts are empty."""
    for batch in batches:
        lengths = _lengths(batch.column(column))
        lo, total = 0, 0
        for hi, n in enumerate(lengths.tolist()):
            if total and total + n > limit:
                yield _arrays(batch.slice(lo, hi - lo), column)
                lo, total = hi, 0
            total += n
        if lo < batch.num_rows:
            yield _arrays(batch.slice(lo), column)
    give_back()


def _lengths(texts: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)


def _arrays(rows: pa.RecordBatch, column: str) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    texts = rows.column(column).cast(pa.large_binary())
    lengths = _lengths(texts).astype(np.int64)
    starts = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
    if texts.null_count:  # bytes under a null may be anything
        data = b"".join(x or b"" for x in texts.to_pylist())
        return rows, np.frombuffer(data, np.uint8), starts
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if texts.buffers()[2] is None:
        return rows, np.zeros(0, np.uint8), starts
    return rows, np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], starts


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of the public splitmix64 generator: spreads each bit over all."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(4)
def _bytes_table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)


#: The modulus of SpanHash, a Mersenne prime.
PRIME = U64(2**61 - 1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _folded(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME."""
    x = (x & PRIME) + (x >> U64(61))
    return np.where(x >= PRIME, x - PRIME, x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME of numbers below it, by halves of 32 bits: 2**64 leaves 8, and 2**61 leaves 1."""
    low = U64(2**32 - 1)
    a1, a0, b1, b0 = a >> U64(32), a & low, b >> U64(32), b & low
    middle, least = a1 * b0 + a0 * b1, a0 * b0
    return _folded(((a1 * b1) << U64(3)) + (middle >> U64(29)) + ((middle & U64(2**29 - 1)) << U64(32)) + (least >> U64(61)) + (least & PRIME))


def _power_tables(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo PRIME."""
    have = _powers.get(seed)
    if have is None or len(have[0]) < n:
        base, prime = int(np.random.default_rng(seed + 1).integers(2**40, 2**60)), int(PRIME)
        size, tables = max(n, SLICE_BYTES + 1), []
        for b in (base, pow(base, -1, prime)):
            steps = np.ones(1, np.uint64)
            while len(steps) < size:
                steps = np.concatenate([steps, _times(steps, U64(pow(b, len(steps), prime)))])
            tables.append(steps[:size])
        _powers[seed] = have = (tables[0], tables[1])
    return have


class SpanHash:
    """64-bit hashes of any spans of bytes: a polynomial over random byte values modulo the prime 2**61 - 1, mixed at the end.

    The modulus is a prime, since modulo a power of two such sums are equal for some strings (those of Thue and Morse) whatever the base."""

    def __init__(self, data: np.ndarray, seed: int = 1):
        powers, self.inverse = _power_tables(seed, len(data) + 1)
        terms = _times(_bytes_table(seed)[data] >> U64(3), powers[: len(data)])
        upper, lower = np.cumsum(terms >> U64(32), dtype=np.uint64), np.cumsum(terms & U64(2**32 - 1), dtype=np.uint64)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        self.sums[1:] = _folded((upper >> U64(29)) + ((upper & U64(2**29 - 1)) << U64(32)) + _folded(lower))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        between = _folded(self.sums[end] + PRIME - self.sums[start])
        return mix(_times(between, self.inverse[start]) + (end - start).astype(np.uint64) * U64(0x9E3779B97F4A7C15))

    def width(self, n: int) -> np.ndarray:
        """Of all spans of n bytes, by start."""
        m = max(0, len(self.sums) - n)
        between = _folded(self.sums[n:] + PRIME - self.sums[:m])
        return mix(_times(between, self.inverse[:m]) + U64(n * 0x9E3779B97F4A7C15 % 2**64))


def find_words(data: np.ndarray, starts: np.ndarray, outside: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes that are not outside ([\\x20\\x09-\\x0D]), never over a document's end: starts, ends, and how many lie before each document's start."""
    inside = ~outside[data]
    before, after = np.empty(len(data), bool), np.empty(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    if len(data):
        before[0] = after[-1] = False
        edge = starts[1:-1]
        before[edge[edge < len(data)]] = False
        after[edge[edge > 0] - 1] = False
    begin, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return begin, end, np.searchsorted(begin, starts)


def word_ids(data: np.ndarray, inside: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The number of each word and the distinct words, told apart by their bytes. inside marks the bytes of all these words and no others."""
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(end - begin)])
    words = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[inside]))])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def word_hashes(words: pa.Array) -> np.ndarray:
    """64 bits of each, by a public hash without the algebra of a polynomial."""
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components by alternating large and small stars: (node, root) for each node of edges, root its smallest.

    Nulls and loops link nothing. Each half step is a minimum by node, which partial aggregation combines before the shuffle, and a join that adaptive
    execution can split where one node has many neighbours. Written after each round, in files of about a million links, so a lost executor repeats no earlier
    round and small rounds are few files."""
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v and u > v").distinct()
    pairs = save(pairs, "links")
    seen = None
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        pairs = save(small if seen is None else small.coalesce(max(16, seen[0] // 1_000_000)), "links")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == seen:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = now
