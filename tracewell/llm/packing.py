"""Best-fit packing of token sequences, with lower bounds that certify the number of bins.

Each partition packs its pieces by best-fit decreasing; dual feasible functions bound from below how many bins any packing needs, for each partition and
for all pieces together. While more bins are open than the bound allows, partitions give up their bins with gaps, the pieces in them are dealt anew to fewer
partitions, and these pack again.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain, count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, find_words, give_back, save, text_slices, word_ids

CAPACITY = 4096
#: Pieces that one task packs, and the share of free room up to which a bin counts as full.
PIECES_A_TASK, SLACK = 20_000, 1 / 256
END = 1


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """The ids that a tokenizers file with a word pre-tokenizer gives, each distinct word encoded once.

    Words are cut by the file's own rule where that is certain: Latin letters, digits and marks that no normalisation changes. Any other
    text goes to the tokenizer whole."""

    #: The alternatives of the file's pre-tokenizer, for texts that PLAIN matches.
    WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
    PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-įĲ-ž]*")
    #: Words, and chunks between white space, which is never in a word, whose ids are kept; beyond that all are forgotten and learnt anew.
    KEPT = 400_000

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.words = Tokenizer(self.whole.model)  # for words that are cut and in lower case already
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.whole.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True
        self.ids: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        return next(self.encode_all([text]))

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """encode() of each; what is new in them is learnt together."""
        plain = ["<|" not in t and self.PLAIN.fullmatch(t) is not None for t in texts]
        own = [t.lower().encode() if p else b"" for t, p in zip(texts, plain, strict=True)]
        data = np.frombuffer(b"".join(own), np.uint8)
        begin, end, first = find_words(data, np.cumsum([0, *map(len, own)]))
        which, chunks = word_ids(data, ~WHITE[data], begin, end)
        chunks = chunks.cast(pa.large_string()).to_numpy(zero_copy_only=False).tolist()
        if len(self.ids) > self.KEPT:
            self.ids = {}
        self._learn([c for c in chunks if c not in self.ids])
        found = pa.array([self.ids[c] for c in chunks], pa.large_binary()).take(pa.array(which))
        _, offsets, values = found.buffers()
        cut = np.frombuffer(offsets, np.int64)[first].tolist() if len(found) else [0] * (len(texts) + 1)
        joined = memoryview(values or b"")
        for text, p, a, b in zip(texts, plain, cut[:-1], cut[1:], strict=True):
            yield bytes(joined[a:b]) if p else np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, chunks: list[str]) -> None:
        """Encodes the new words of chunks together: a word's last token alone ends with the file's mark."""
        words_of = [[c] if c.isalpha() else self.WORDS.findall(c) for c in chunks]
        words = list(set(chain.from_iterable(words_of)).difference(self.ids))
        ids = np.array(self.words.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cut = [0, *((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()]
        own = ids.tobytes()
        for w, a, b in zip(words, cut[:-1], cut[1:], strict=True):
            self.ids[w] = own[a:b]
        for c, inside in zip(chunks, words_of, strict=True):
            if len(inside) > 1:
                self.ids[c] = b"".join(map(self.ids.__getitem__, inside))


def _pieces(path: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, rid = WordTokenizer(path), TaskContext.get().partitionId() << 33
        end = np.array([END], "<u4").tobytes()
        for rows, _, _ in text_slices(batches):
            out = []
            for doc, encoded in zip(rows.column("doc_id").to_pylist(), tokenizer.encode_all([t or "" for t in rows.column("text").to_pylist()]), strict=True):
                ids = memoryview(encoded + end)
                for k, start in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + capacity)]
                    out.append((rid, doc, k, start, len(part) // 4, zlib.crc32(part), bytes(part) if with_ids else None))
                    rid += 1
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            cols = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["rid", "doc_id", "piece", "start", "length", "ids_crc32", "ids"])
        del tokenizer
        give_back()

    return run


def lower_bound(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """The most of the bounds that dual feasible functions give: the identity; for each e, pieces over capacity - e count whole and those under e not at all;
    and for each k the rounding of (k + 1) * length / capacity downwards, except where it is whole."""
    if not len(lengths):
        return 0
    total = np.zeros(capacity + 1)
    np.add.at(total, lengths, counts)
    sizes = np.arange(capacity + 1)
    upto, amount = np.cumsum(total), np.cumsum(total * sizes)
    e = np.arange(0, capacity // 2 + 1)
    middle = amount[capacity - e] - np.where(e > 0, amount[np.maximum(e - 1, 0)], 0)
    best = int(np.ceil((middle / capacity + upto[-1] - upto[capacity - e]).max() - 1e-9))
    for k in range(1, 100):
        x = (k + 1) * sizes
        best = max(best, int(np.ceil((total * np.where(x % capacity == 0, sizes / capacity, x // capacity / k)).sum() - 1e-9)))
    return best


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins by best-fit decreasing for lengths in falling order: each piece's bin and offset, and each bin's free room."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, free = 0, []
    place, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        fits = open_rooms >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_rooms ^= 1 << r
        else:
            r, b = capacity, len(free)
            free.append(capacity)
        place[i], offset[i] = b, capacity - r
        free[b] = r = r - n
        if not room[r]:
            open_rooms |= 1 << r
        room[r].append(b)
    return place, offset, np.array(free, np.int64)


def _pack(turn: int, capacity: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece", "rid"], ascending=[False, True, True, True], ignore_index=True)
        place, offset, free = best_fit(group["length"].to_numpy(), capacity)
        values, counts = np.unique(group["length"].to_numpy(), return_counts=True)
        group["sequence_id"] = ((turn << 48) + (group["part"].to_numpy(np.int64) << 20) + place) * 2
        group["offset"], group["free"] = offset, free[place]
        group["certified"] = len(free) == lower_bound(values, counts, capacity)
        return group.drop(columns="part")

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Each piece's place: doc_id, piece, start, length, ids_crc32, sequence_id, offset, certified (its partition's bins were as few as any packing's when
    it was placed) and ids (little-endian unsigned 32-bit, if with_ids).

    A null text is empty; an empty one is its end id alone. Rows that repeat, also by doc_id, are packed each; a null doc_id stays null. Only documents over
    capacity tokens are cut. Ties in length go by doc_id and piece. Other columns are not read.

    Bins with at most SLACK of their room free are closed; the others' pieces are dealt anew, to fewer partitions, round after round until the bins are as few as
    the bound over all pieces allows, one partition holds all that are open, or a round has no fewer bins than the one before, whose places then stay."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    all_of = "rid long, doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = save(docs.mapInArrow(_pieces(tokenizer or default_tokenizer(), capacity, with_ids), f"{all_of}, ids binary"), "pieces")
    names = ["rid", "doc_id", "piece", "start", "length", "ids_crc32"]
    histogram = np.array([tuple(r) for r in pieces.groupBy("length").count().collect()], np.int64).reshape(-1, 2)  # capacity rows at most
    bound = lower_bound(histogram[:, 0], histogram[:, 1], capacity)
    done = [pieces.where(F.col("length") == capacity).select(*names, (F.col("rid") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))]
    pool = pieces.where(F.col("length") < capacity).select(*names)
    slack = int(capacity * SLACK)
    closed = int(histogram[histogram[:, 0] == capacity, 1].sum())
    held, given_up, gaps = int(histogram[:, 1].sum()) - closed, None, 0
    for turn in count():
        parts = -(-held // PIECES_A_TASK)
        if not parts:
            break
        dealt = pool.withColumn("part", F.pmod(F.xxhash64("rid", F.lit(turn)), F.lit(parts)).cast("int"))
        packed = save(dealt.groupBy("part").applyInPandas(_pack(turn, capacity), f"{all_of}, sequence_id long, offset long, free long, certified boolean"), "packed")
        bins, open_bins = packed.where("offset = 0").agg(F.count("*"), F.coalesce(F.count_if(F.col("free") > slack), F.lit(0))).first()
        if given_up is not None and bins >= gaps:
            break  # no gain: the places before stay
        done.append(packed.where(F.col("free") <= slack).drop("free"))
        closed += bins - open_bins
        given_up, gaps = packed.where(F.col("free") > slack).drop("free"), open_bins
        if not gaps or closed + gaps <= bound or parts == 1:
            break
        pool = given_up.select(*names)
        held = pool.count()
    if given_up is not None:
        done.append(given_up)
    placed = reduce(DataFrame.unionByName, done)
    return (placed.join(pieces.select("rid", "ids"), "rid") if with_ids else placed).drop("rid")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and ids (the whole sequence) of what pack(with_ids=True) placed."""
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return rows.select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """pack over all documents; nulls, ties and repeated rows as there."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("certified")
