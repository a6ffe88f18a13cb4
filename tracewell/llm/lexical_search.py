"""Ranked lexical search: a K2-treap over the grid of query terms and documents for each block of documents.

The grid's cells hold a term's impact in a document. A cell of a level is a square of four of the next one; a mask of four bits says which of these are not
empty, and each cell keeps its largest impact. An item's terms are rows of the grid. All their paths descend together over ranges of documents: the
weighted sum of the maxima of a range's cells bounds the score of each document there, and the range with the largest bound is halved next, until
the bounds left are no better than the documents found. A single document's bound is its score.
"""

from __future__ import annotations

import heapq
import math
import re
from bisect import insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ASCII_LOWER, find_words, give_back, read, save, text_slices, word_ids

TOP = 20
#: Code points of the items that are searched at once; documents and cells of a block; ranges that are halved at once.
ITEM_CHARS, BLOCK_DOCS, BLOCK_CELLS, AT_ONCE = 4_000_000, 1 << 15, 2_000_000, 32
_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_OUTSIDE = np.ones(256, bool)
_OUTSIDE[128:] = _OUTSIDE[48:58] = _OUTSIDE[65:91] = _OUTSIDE[97:123] = False


def terms_of(text: str | None) -> list[str]:
    """Maximal runs of letters and digits of ASCII and of all other code points, A-Z lower-cased."""
    return _TERM.findall((text or "").translate(_LOWER))


class _Block:
    """Documents that hold some term of the items, and their cells."""

    def __init__(self):
        self.docs, self.lengths, self.cells, self.n, self.size, self.trained = [], [], [], 0, 0, [0, 0]

    def row(self) -> dict:
        """Documents in ascending order, null ids last."""
        order = sorted(range(len(self.docs)), key=lambda i: (self.docs[i] is None, self.docs[i] or 0))
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        term, doc, tf = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in zip(*self.cells)) if self.cells else [np.zeros(0, np.int32)] * 3
        held, df = np.unique(term, return_counts=True)
        out = {"docs": [self.docs[i] for i in order], "lengths": [self.lengths[i] for i in order], "terms": term.astype(np.int32).tobytes(), "places": place[doc].tobytes(), "tfs": tf.astype(np.int32).tobytes()}
        return out | {"held": held.tolist(), "df": df.tolist(), "n_docs": self.trained[0], "n_terms": self.trained[1]}


_BLOCK_SCHEMA = "docs array<long>, lengths array<long>, terms binary, places binary, tfs binary, held array<int>, df array<long>, n_docs long, n_terms long"
_BLOCK_ARROW = pa.schema([("docs", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), *[(c, pa.binary()) for c in ("terms", "places", "tfs")], ("held", pa.list_(pa.int32())), ("df", pa.list_(pa.int64())), ("n_docs", pa.int64()), ("n_terms", pa.int64())])


def _cells(vocabulary: list[str], docs_a_block: int, cells_a_block: int):
    """Blocks of the documents of a task; lengths count all of a text's terms, cells those of the vocabulary."""
    known = pa.array([x.encode() for x in vocabulary], pa.large_binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block()
        for rows, data, starts in text_slices(batches):
            data = ASCII_LOWER[data]
            begin, end, upto = find_words(data, starts, _OUTSIDE)
            ids, words = word_ids(data, ~_OUTSIDE[data], begin, end)
            term = pc.fill_null(pc.index_in(words, known), -1).to_numpy(zero_copy_only=False)[ids].astype(np.int64)
            n = np.diff(upto)
            doc = np.repeat(np.arange(len(n)), n)
            cell, tf = np.unique(doc[term >= 0] * len(vocabulary) + term[term >= 0], return_counts=True)
            doc, term = cell // max(1, len(vocabulary)), cell % max(1, len(vocabulary))
            some, at = np.unique(doc, return_inverse=True)
            names = rows.column("doc_id").to_pylist()
            block.trained = [block.trained[0] + int((n > 0).sum()), block.trained[1] + int(n.sum())]
            block.cells.append((term.astype(np.int32), (at + len(block.docs)).astype(np.int32), tf.astype(np.int32)))
            block.docs += [names[i] for i in some.tolist()]
            block.lengths += n[some].tolist()
            block.size += len(cell)
            if len(block.docs) >= docs_a_block or block.size >= cells_a_block:
                yield pa.RecordBatch.from_pylist([block.row()], _BLOCK_ARROW)
                block = _Block()
        yield pa.RecordBatch.from_pylist([block.row()], _BLOCK_ARROW)
        give_back()

    return run


def _spread(x: np.ndarray) -> np.ndarray:
    """The bits of numbers below 2**32, a zero before each."""
    x = x.astype(np.uint64)
    for shift, keep in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(keep)
    return x


class Treap:
    """Cells level by level from the root: mask (which quarters are not empty), first (the number of the first of these), top (the largest impact).

    The last number stands for all empty cells."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, impacts: np.ndarray):
        self.height = max(1, int(max(rows.max(initial=0), columns.max(initial=0))).bit_length())
        code = (_spread(rows) << np.uint64(1)) | _spread(columns)
        order = np.argsort(code, kind="stable")
        code, top = code[order], impacts[order].astype(np.int64)
        masks, tops = [], [top]
        for _ in range(self.height if len(code) else 0):
            up = code >> np.uint64(2)
            edge = np.flatnonzero(np.concatenate([[True], up[1:] != up[:-1]]))
            masks.append(np.bitwise_or.reduceat(np.uint8(1) << (code & np.uint64(3)).astype(np.uint8), edge))
            code, top = up[edge], np.maximum.reduceat(top, edge)
            tops.append(top)
        self.top = np.concatenate([*tops[::-1], [0]])
        inner = np.concatenate([*masks[::-1], np.zeros(0, np.uint8)])
        self.none = len(self.top) - 1
        self.mask = np.zeros(len(self.top), np.uint8)
        self.mask[: len(inner)] = inner
        self.first = np.zeros(len(self.top), np.int64)
        self.first[: len(inner)] = 1 + np.concatenate([[0], np.cumsum(np.bitwise_count(inner), dtype=np.int64)[:-1]]) if len(inner) else 0

    def quarter(self, cells: np.ndarray, which: np.ndarray) -> np.ndarray:
        mask = self.mask[cells]
        return np.where((mask >> which) & 1, self.first[cells] + np.bitwise_count(mask & ((np.uint8(1) << which) - np.uint8(1))), self.none)

    def search(self, rows: np.ndarray, weights: np.ndarray, docs: list[tuple], best: list[tuple], k: int) -> None:
        """Puts this grid's documents into best, the k best (-score, document) so far, ascending. docs: by column, ascending."""
        if self.none == 0 or not len(rows):
            return
        bits = ((rows[None] >> np.arange(self.height - 1, -1, -1)[:, None]) & 1).astype(np.uint8) * np.uint8(2)
        bound = int(self.top[0] * weights.sum())
        heap, pushed = [(-bound, docs[0], 0, 0, 0, np.zeros(len(rows), np.int64))], 0
        while heap and (len(best) < k or heap[0][:2] < best[-1]):
            taken = [heapq.heappop(heap) for _ in range(min(AT_ONCE, len(heap)))]
            level, column = np.array([x[3] for x in taken]), np.array([x[4] for x in taken])
            cells = np.stack([x[5] for x in taken])
            for half in (0, 1):
                below = self.quarter(cells, bits[level] + np.uint8(half))
                bounds = self.top[below] @ weights
                for i in np.flatnonzero(bounds > 0).tolist():
                    lower, down = int(column[i]) * 2 + half, int(level[i]) + 1
                    own = (-int(bounds[i]), docs[lower << (self.height - down)])
                    if len(best) == k and own >= best[-1]:
                        continue
                    if down == self.height:
                        insort(best, own)
                        del best[k:]
                    else:
                        pushed += 1
                        heapq.heappush(heap, (*own, pushed, down, lower, below[i]))


def _search(items: list[tuple[np.ndarray, np.ndarray]], row_of: np.ndarray, n_docs: int, n_terms: int, k: int):
    """The k best documents of a task's blocks for each item, by number; what is found in one block bounds the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in items]
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.slice(i, 1).to_pylist()[0]
                term, place, tf = (np.frombuffer(block[c], np.int32).astype(np.int64) for c in ("terms", "places", "tfs"))
                m = np.array([75 + 25 * n * n_docs // n_terms for n in block["lengths"]], np.int64)
                treap = Treap(row_of[term], place, 1_000_000_000 * tf // (1000 * tf + 12 * m[place]))
                docs = [(d is None, d or 0) for d in block["docs"]]
                for (rows, weights), own in zip(items, best, strict=True):
                    treap.search(rows, weights, docs, own, k)
        out = [(i, None if none else d, -s) for i, own in enumerate(best) for s, (none, d) in own]
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.int64()) for j in range(3)], ["item", "doc_id", "score"])
        give_back()

    return run


def search(docs: DataFrame, items: DataFrame, k: int = TOP, docs_a_block: int = BLOCK_DOCS, cells_a_block: int = BLOCK_CELLS) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of each row of items, equal scores by ascending doc_id, null ones last.

    Texts without terms and null texts match nothing. Rows of docs that repeat count and rank each, as do rows of items, whose ranks start at 1 in each.
    Items go to tasks in groups of ITEM_CHARS code points at most, and the documents are read once for each group. Other columns are not read."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    shards = -(-items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] // ITEM_CHARS)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for shard in range(shards):
        asked = [(r.item_id, Counter(terms_of(r.text))) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == shard).orderBy("item_id", "text").collect()]
        number = {t: i for i, t in enumerate(dict.fromkeys(t for _, c in asked for t in c))}
        blocks = save(docs.mapInArrow(_cells(list(number), docs_a_block, cells_a_block), _BLOCK_SCHEMA), "cells")
        n_docs, n_terms = blocks.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
        held = blocks.select(F.explode(F.arrays_zip("held", "df")).alias("x")).groupBy("x.held").agg(F.sum("x.df").alias("df")).collect()  # of the terms of one group of items
        df = {r.held: r.df for r in held}
        # terms of like frequency share squares, so that these have like impacts
        row_of = np.zeros(len(number), np.int64)
        row_of[sorted(df, key=lambda t: (-df[t], t))] = np.arange(len(df))
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * f + 1))) for t, f in df.items()}
        rows = []
        for _, terms in asked:
            own = [(row_of[number[t]], c * weight[number[t]]) for t, c in terms.items() if weight.get(number[t], 0) > 0]
            rows.append((np.array([r for r, _ in own], np.int64), np.array([w for _, w in own], np.int64)))
        names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(asked)], "item long, item_id long")
        found = blocks.where("size(docs) > 0").mapInArrow(_search(rows, row_of, n_docs, n_terms, k), "item long, doc_id long, score long")
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).where(F.col("rank") <= k)
        out = out.union(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))  # names: of one group
    return out


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """search of all benchmark items in all documents; nulls, empties, ties and repeated rows as there."""
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_TERMS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
LEXICAL_SEARCH_SQL = f"""
with texts as materialized (select * from (select row_number() over () as rid, doc_id, {_TERMS_SQL} as t from documents) where len(t) > 0),
stats as (select count(*) as n, sum(len(t)) as l from texts),
asked as materialized (select q, item_id, term, count(*) as c from (select q, item_id, unnest(t) as term from (select row_number() over () as q, item_id, {_TERMS_SQL} as t from benchmark)) group by q, item_id, term),
cells as materialized (select rid, doc_id, n, term, count(*) as tf from (select rid, doc_id, len(t) as n, unnest(t) as term from texts) where term in (select term from asked) group by rid, doc_id, n, term),
weights as (select term, cast(floor(1000 * ln((2.0 * any_value(s.n) + 2) / (2 * count(*) + 1))) as bigint) as w from cells, stats s group by term),
scores as (select q, item_id, rid, doc_id, cast(sum(a.c * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * cells.n * s.n) // s.l)))) as bigint) as score
  from asked a join weights using (term) join cells using (term), stats s group by q, item_id, rid, doc_id),
ranked as (select item_id, cast(row_number() over (partition by q order by score desc, doc_id) as integer) as rank, doc_id, score from scores where score > 0)
select * from ranked where rank <= {TOP}
"""
