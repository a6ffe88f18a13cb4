"""Language-model scores by deleted interpolation of n-gram counts.

Texts become chunks of token numbers. Each chunk sends its distinct n-grams once, as sorted 64-bit names, to the tasks that own parts of the names' range; these
count them over all chunks and answer with a count for each name, so a chunk then knows the counts of all that its texts hold and no count table is broadcast.
Maximum-likelihood estimates of all orders are mixed with weights for each bucket of the context's frequency. Expectation-maximisation learns
the weights on the n-grams of a fold of the training texts, against counts from which that fold's own are taken off.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_LOWER, U64, WHITE, find_words, give_back, mix, read, save, text_slices, word_hashes, word_ids

#: n of the longest n-grams; tokens of a chunk; names that a task counts at once; rounds of expectation-maximisation, and the gain a token at which they end.
ORDER, CHUNK, NAMES_A_TASK, ROUNDS, GAIN = 2, 1_000_000, 1_000_000, 20, 1e-5
#: No weight is less, so that no text is impossible.
LEAST_WEIGHT = 1e-6
HELD_OUT, TRAINED, FOLD = 0, 1, 2
_STEPS = np.random.default_rng(23).integers(1, 2**62, 8, dtype=np.uint64) * U64(2) + U64(1)
_START, _END = (word_hashes(pa.array([x], pa.large_binary()))[0] for x in (b" start", b" end"))  # no words: these have no blanks


def _packed(x: np.ndarray) -> bytes:
    """Numbers below 2**32 as compressed planes of bytes."""
    return zstandard.compress(np.ascontiguousarray(x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpacked(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def _deltas(names: np.ndarray) -> bytes:
    """Ascending names as steps of as few whole bytes as the largest takes, after the first."""
    step = np.diff(names)
    if not len(step):
        return names.tobytes()
    size = max(1, -(-int(step.max()).bit_length() // 8))
    return names[:1].tobytes() + np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def _names(blob: bytes, n: int) -> np.ndarray:
    if n < 2:
        return np.frombuffer(blob, np.uint64)
    size, step = (len(blob) - 8) // (n - 1), np.zeros((n - 1, 8), np.uint8)
    step[:, :size] = np.frombuffer(blob, np.uint8, offset=8).reshape(-1, size)
    return np.cumsum(np.concatenate([np.frombuffer(blob, np.uint64, 1), step.view(np.uint64).ravel()]), dtype=np.uint64)


class _Chunk:
    """Pieces of texts of one kind: streams of word hashes, each after the order - 1 tokens before it."""

    def __init__(self):
        self.size, self.pieces, self.docs, self.rows = 0, [], [], []

    def row(self, chunk: int, kind: int, order: int) -> dict:
        """words: the distinct hashes, ascending; common: their numbers by falling frequency; tokens: places in common."""
        words, ids, counts = np.unique(np.concatenate(self.pieces), return_inverse=True, return_counts=True)
        common = np.argsort(-counts, kind="stable")
        place = np.empty(len(words), np.int64)
        place[common] = np.arange(len(words))
        sizes = [len(x) - order + 1 for x in self.pieces]
        return {"chunk": chunk, "kind": kind, "n": sum(sizes), "ends": int(sum(x[-1] == _END for x in self.pieces)), "words": _deltas(words), "common": _packed(common), "tokens": _packed(place[ids]), "sizes": sizes, "docs": self.docs, "rows": self.rows}


_CHUNK_SCHEMA = "chunk long, kind int, n long, ends long, words binary, common binary, tokens binary, sizes array<long>, docs array<long>, rows array<long>"
_CHUNK_ARROW = pa.schema(
    [("chunk", pa.int64()), ("kind", pa.int32()), ("n", pa.int64()), ("ends", pa.int64())] + [(c, pa.binary()) for c in ("words", "common", "tokens")] + [(c, pa.list_(pa.int64())) for c in ("sizes", "docs", "rows")]
)


def _chunks(order: int, limit: int):
    """Texts as chunks of at most limit tokens; a longer text goes on in the next ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        made, row, open_ = first, first, {}
        start = np.full(order - 1, _START)
        for rows, data, starts in text_slices(batches):
            data = ASCII_LOWER[data]
            begin, end, upto = find_words(data, starts)
            ids, words = word_ids(data, ~WHITE[data], begin, end)
            hashes = word_hashes(words)[ids]
            for doc, kind, lo, hi in zip(rows.column("doc_id").to_pylist(), rows.column("kind").to_pylist(), upto[:-1].tolist(), upto[1:].tolist(), strict=True):
                stream = np.concatenate([start, hashes[lo:hi], [_END]])
                for at in range(0, hi - lo + 1, limit):
                    piece = stream[at : at + limit + order - 1]
                    to = open_.setdefault(kind, _Chunk())
                    if to.size and to.size + len(piece) > limit:
                        yield pa.RecordBatch.from_pylist([to.row(made, kind, order)], _CHUNK_ARROW)
                        made, open_[kind] = made + 1, _Chunk()
                        to = open_[kind]
                    to.size += len(piece)
                    to.pieces.append(piece)
                    to.docs.append(doc)
                    to.rows.append(row)
                row += 1
        for kind, to in open_.items():
            yield pa.RecordBatch.from_pylist([to.row(made, kind, order)], _CHUNK_ARROW)
            made += 1
        give_back()

    return run


class _Grams:
    """The n-grams of a chunk: by n the distinct names, ascending, and for each place of the stream the number of the name that ends there."""

    def __init__(self, row: dict, order: int):
        common = _unpacked(row["common"]).astype(np.int64)
        self.words, ids = _names(row["words"], len(common)), common[_unpacked(row["tokens"])]
        sizes = np.array(row["sizes"], np.int64)
        lead = order - 1
        heads = np.cumsum(sizes + lead) - sizes - lead
        self.real = np.ones(len(ids), bool)
        for k in range(lead):
            self.real[heads + k] = False
        self.names, self.at, hashes, code = [self.words], [ids], self.words[ids], ids
        for n in range(2, order + 1):
            # a name of n words by the number of its first n - 1 and its last; places with less before them make names that nobody asks for
            code = np.concatenate([[0], code[:-1]]) * len(self.words) + ids
            code[:1] = -1
            _, where, code = np.unique(code, return_index=True, return_inverse=True)
            total = np.zeros(len(where), np.uint64)
            for k in range(n):
                total += hashes[where - k] * _STEPS[k]
            names = mix(total + U64(n))
            order_ = np.argsort(names, kind="stable")
            rank = np.empty(len(names), np.int64)
            rank[order_] = np.arange(len(names))
            self.names.append(names[order_])
            self.at.append(rank[code])
            code = rank[code]

    def counts(self, n: int) -> np.ndarray:
        return np.bincount(self.at[n - 1][self.real], minlength=len(self.names[n - 1]))


def _small(x: np.ndarray) -> bytes:
    """Counts in 1 or 8 bytes each; zeros alone take none."""
    if not x.any():
        return b""
    return x.astype(np.uint8 if x.max() < 256 else np.int64).tobytes()


def _large(blob: bytes, n: int) -> np.ndarray:
    if not blob:
        return np.zeros(n, np.int64)
    return np.frombuffer(blob, np.uint8 if len(blob) == n else np.int64).astype(np.int64)


def _ask(order: int, parts: int):
    """A chunk's names and their counts there, as one message for each n and part of the names' range that has some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                grams, out = _Grams(row, order), []
                for n in range(1, order + 1):
                    names = grams.names[n - 1]
                    count = grams.counts(n) if row["kind"] != HELD_OUT else np.zeros(len(names), np.int64)
                    cut = np.searchsorted(((names >> U64(32)) * U64(parts)) >> U64(32), np.arange(parts + 1))
                    out += [(n, p, row["chunk"], row["kind"], b - a, _deltas(names[a:b]), _small(count[a:b])) for p, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if a < b]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["ord", "part", "chunk", "kind", "size", "names", "counts"])
        give_back()

    return run


def _count(table: pa.Table) -> pa.Table:
    """Answers to the messages of one part: counts over all training texts and over the fold; fresh: distinct names with a count, told once."""
    rows = table.select(["ord", "part", "chunk", "kind", "size", "names", "counts"]).to_pylist()
    names, at = np.unique(np.concatenate([_names(r["names"], r["size"]) for r in rows]), return_inverse=True)
    own = np.concatenate([_large(r["counts"], r["size"]) for r in rows])
    folds = np.repeat([r["kind"] == FOLD for r in rows], [r["size"] for r in rows])
    total, fold = np.bincount(at, own), np.bincount(at, own * folds)
    total, fold = total.astype(np.int64)[at], fold.astype(np.int64)[at]
    cut = np.cumsum([0] + [r["size"] for r in rows])
    fresh = len(np.unique(at[total > 0]))
    out = {c: [r[c] for r in rows] for c in ("ord", "part", "chunk", "kind")} | {k: [_small(v[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)] for k, v in (("total", total), ("fold", fold))}
    give_back()
    return pa.table(out | {"size": [r["size"] for r in rows], "fresh": [fresh if k == 0 else 0 for k in range(len(rows))]}, _ANSWER_ARROW)


_ANSWER_SCHEMA = "ord int, part int, chunk long, kind int, total binary, fold binary, size long, fresh long"
_ANSWER_ARROW = pa.schema([("ord", pa.int32()), ("part", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()), ("total", pa.binary()), ("fold", pa.binary()), ("size", pa.int64()), ("fresh", pa.int64())])


class _Known:
    """A chunk with the counts of its n-grams; deleted: without those of the fold."""

    def __init__(self, chunk: pa.Table, answers: pa.Table, order: int, totals: dict, deleted: bool):
        self.row = chunk.to_pylist()[0]
        self.grams, self.order, self.totals = _Grams(self.row, order), order, totals
        counts: list[list[np.ndarray]] = [[] for _ in range(order)]
        for r in answers.sort_by([("ord", "ascending"), ("part", "ascending")]).to_pylist():
            counts[r["ord"] - 1].append(_large(r["total"], r["size"]) - (_large(r["fold"], r["size"]) if deleted else 0))
        self.counts = [np.concatenate(c) for c in counts]
        self.docs = totals["docs"] - (totals["fold_docs"] if deleted else 0)
        self.tokens = totals["tokens"] - (totals["fold_tokens"] if deleted else 0)

    def estimates(self) -> tuple[np.ndarray, np.ndarray]:
        """For each real place the bucket of its context and the estimates of each order from 0, the uniform one, on; 0 where a context is unknown."""
        place = np.flatnonzero(self.grams.real)
        p = np.zeros((len(place), self.order + 1))
        p[:, 0] = 1 / (self.totals["kinds"] + 1)
        bucket = np.zeros(len(place), np.int64)
        p[:, 1] = self.counts[0][self.grams.at[0][place]] / self.tokens if self.tokens else p[:, 0]
        start = np.flatnonzero(self.grams.words == _START)
        for n in range(2, self.order + 1):
            context = self.counts[n - 2][self.grams.at[n - 2][place - 1]]
            if len(start):  # before a text all words of a context are starts, and each training text has one such context
                opening = np.ones(len(place), bool)
                for k in range(1, n):
                    opening &= self.grams.at[0][place - k] == start[0]
                context = np.where(opening, self.docs, context)
            p[:, n] = np.where(context > 0, self.counts[n - 1][self.grams.at[n - 1][place]] / np.maximum(context, 1), 0)
            bucket = np.where(context > 0, 64 * (n - 1) + np.log2(np.maximum(context, 1)).astype(np.int64), bucket)
        return bucket, p


def _fold_rows(order: int, totals: dict):
    """Each distinct n-gram of a chunk of the fold: bucket, estimates p0, p1 ..., how often it is there."""

    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        known = _Known(chunk, answers, order, totals, True)
        bucket, p = known.estimates()
        _, where, n = np.unique(known.grams.at[-1][known.grams.real], return_index=True, return_counts=True)
        return pa.table({"bucket": pa.array(bucket[where].astype(np.int32))} | {f"p{k}": pa.array(p[where, k]) for k in range(order + 1)} | {"n": pa.array(n.astype(np.int64))})

    return run


def _start_weights(bucket: int, order: int) -> list[float]:
    """Equal ones for the orders whose context a bucket knows."""
    top = bucket // 64 + 1
    return [1 / (top + 1) if k <= top else 0.0 for k in range(order + 1)]


def learn_weights(rows: DataFrame, order: int, rounds: int = ROUNDS, gain: float = GAIN) -> dict[int, list[float]]:
    """Weights of the estimates by bucket: at most 64 * order buckets."""
    spark, names = rows.sparkSession, [f"p{k}" for k in range(order + 1)]
    weights, before = {r.bucket: _start_weights(r.bucket, order) for r in rows.select("bucket").distinct().collect()}, None
    for _ in range(rounds if weights else 0):
        table = spark.createDataFrame([(b, *w) for b, w in weights.items()], "bucket int, " + ", ".join(f"w{k} double" for k in range(order + 1)))
        parts = [F.col(f"w{k}") * F.col(p) for k, p in enumerate(names)]
        mixed = rows.join(F.broadcast(table), "bucket").withColumn("all", sum(parts[1:], parts[0])).where("all > 0")
        found = mixed.groupBy("bucket").agg(*[F.sum(F.col("n") * x / F.col("all")).alias(p) for p, x in zip(names, parts, strict=True)], F.sum("n").alias("n"), F.sum(F.col("n") * F.ln("all")).alias("fit")).collect()
        weights |= {r.bucket: [r[p] / r.n for p in names] for r in found}
        fit = sum(r.fit for r in found) / sum(r.n for r in found)
        if before is not None and fit - before < gain:
            break
        before = fit
    return {b: _floored(w, b) for b, w in weights.items()}


def _floored(weights: list[float], bucket: int) -> list[float]:
    top = bucket // 64 + 1
    weights = [max(w, LEAST_WEIGHT) if k <= top else 0.0 for k, w in enumerate(weights)]
    return [w / sum(weights) for w in weights]


def weight_table(weights: dict[int, list[float]], order: int) -> np.ndarray:
    """A row for each bucket; one that the fold never met takes those of the nearest frequency with as long a context, or equal ones."""
    out = np.zeros((64 * order, order + 1))
    for b in range(len(out)):
        near = min((x for x in weights if x // 64 == b // 64), key=lambda x: (abs(x - b), x), default=None)
        out[b] = weights[near] if near is not None else _start_weights(b, order)
    return out


_SCORE_SCHEMA = "row long, doc_id long, kind int, n_tokens long, n_known long, base_score double, score double"


def _score_rows(order: int, totals: dict, table: np.ndarray):
    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        known = _Known(chunk, answers, order, totals, False)
        bucket, p = known.estimates()
        c = known.counts[0][known.grams.at[0][known.grams.real]]
        sizes = np.array(known.row["sizes"])
        of = np.repeat(np.arange(len(sizes)), sizes)
        add = lambda x: np.bincount(of, x, len(sizes))
        base = np.log10((c + 0.1) / (totals["tokens"] + 0.1 * (totals["kinds"] + 1)))
        score = np.log10(np.einsum("ij,ij->i", p, table[bucket]))
        out = {"row": known.row["rows"], "doc_id": pa.array(known.row["docs"], pa.int64()), "kind": pa.array([known.row["kind"]] * len(sizes), pa.int32()), "n_tokens": sizes, "n_known": add(c > 0).astype(np.int64), "base_score": add(base), "score": add(score)}
        give_back()
        return pa.table(out)

    return run


def _kind(doc_id: Column) -> Column:
    left = F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(10))
    return F.when(left == 0, HELD_OUT).when(left == 9, FOLD).otherwise(TRAINED)


def lm_scores(docs: DataFrame, kind: Column | None = None, order: int = ORDER, chunk: int = CHUNK) -> DataFrame:
    """Each row's doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    kind: 0 for rows that teach nothing, 1 for training rows, 2 for those of them whose n-grams also choose the weights; by default by the CRC-32 of doc_id modulo
    10 (0, 1 to 8, 9; a null doc_id counts as the empty string). Tokens are the words, A-Z lower-cased, and one end; a null or empty text is one end. base_score is
    the add-0.1 unigram score. Without training rows both scores are 0. Rows that repeat are texts of their own. Other columns are not read."""
    spark = docs.sparkSession
    kind = _kind(F.col("doc_id")) if kind is None else kind
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", kind.cast("int").alias("kind"))
    chunks = save(texts.mapInArrow(_chunks(order, chunk), _CHUNK_SCHEMA), "chunks", "zstd")
    trained = F.col("kind") != HELD_OUT
    sums = {"all": F.sum("n"), "tokens": F.sum(F.when(trained, F.col("n"))), "docs": F.sum(F.when(trained, F.col("ends"))), "fold_tokens": F.sum(F.when(F.col("kind") == FOLD, F.col("n"))), "fold_docs": F.sum(F.when(F.col("kind") == FOLD, F.col("ends")))}
    totals = {k: v or 0 for k, v in chunks.agg(*[x.alias(k) for k, x in sums.items()]).first().asDict().items()}
    parts = max(16, -(-totals["all"] // NAMES_A_TASK))
    asked = chunks.mapInArrow(_ask(order, parts), "ord int, part int, chunk long, kind int, size long, names binary, counts binary")
    answers = save(asked.groupBy("ord", "part").applyInArrow(_count, _ANSWER_SCHEMA), "counts", "zstd")
    totals["kinds"] = answers.where("ord = 1").agg(F.sum("fresh")).first()[0] or 0

    def met(rows: Column | None, run, schema: str) -> DataFrame:
        a, b = (x if rows is None else x.where(rows) for x in (chunks, answers))
        return a.groupBy("chunk").cogroup(b.groupBy("chunk")).applyInArrow(run, schema)

    estimates = ", ".join(f"p{k} double" for k in range(order + 1))
    fold = save(met(F.col("kind") == FOLD, _fold_rows(order, totals), f"bucket int, {estimates}, n long"), "fold")
    table = weight_table(learn_weights(fold, order), order)
    pieces = met(None, _score_rows(order, totals, table), _SCORE_SCHEMA)
    add = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]
    out = pieces.groupBy("row").agg(F.first("doc_id").alias("doc_id"), (F.first("kind") == HELD_OUT).alias("held_out"), *add)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(totals["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lm_scores over all documents; nulls, empties and repeated rows as there."""
    return lm_scores(read(spark, sf_dir, "documents"))
