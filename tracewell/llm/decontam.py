"""Benchmark decontamination: a BM25 index of the test items, queried by every passage of the corpus with block-max WAND, and verified by overlap."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, save

#: Words of a passage and between the starts of two; BM25's parameters; postings in a block; code points of items that one index holds.
PASSAGE, STRIDE, K1, B, POSTINGS, SHARD_CHARS = 128, 64, 1.2, 0.75, 16, 4_000_000
#: A passage is retrieved for an item if its score is this share of the item's own (less by STRIDE / words for items over STRIDE words, which may lie in several
#: passages), and an item leaks if these shares of its question's and answer's word 3-grams appear (of a part with fewer words: see shares).
RETRIEVE, QUESTION, ANSWER, GRAM = 0.7, 0.8, 0.8, 3
WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


@dataclass
class Index:
    """Items by term, with weights as shares of the item's own score: postings in blocks, each with its largest weight."""

    terms: dict[str, int]
    items: list[int]  # item ids
    floor: np.ndarray  # the score from which an item is retrieved
    ids: list[np.ndarray]  # by term: item numbers, rising
    weights: list[np.ndarray]
    tops: list[np.ndarray]  # by term: the largest weight of each block of postings
    top: np.ndarray  # by term: the largest weight
    need: np.ndarray  # what an item's essential terms must score; the other terms can't reach the floor without that
    essential: tuple[np.ndarray, np.ndarray, np.ndarray]  # by term where its essential postings start; their items; their weights
    question: list[list[str]]  # words
    answer: list[list[str]]
    single: list[bool]  # a single sentence, which is both

    @classmethod
    def build(cls, rows: list[tuple[int, str]], n: int, mean: float, frequency: dict[str, int]) -> Index:
        """rows: (item id, text). n: items in all, mean: their mean length in words; frequency: by term, of all items."""
        terms: dict[str, int] = {}
        postings: list[list[tuple[int, float]]] = []
        chosen: list[tuple[int, int, float]] = []
        floor, need, question, answer, single = [], [], [], [], []
        for k, (_, text) in enumerate(rows):
            w = words(text)
            weight = {}
            for x in w:
                weight[x] = weight.get(x, 0) + 1
            for x, tf in weight.items():
                idf = np.log1p((n - frequency[x] + 0.5) / (frequency[x] + 0.5))
                weight[x] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean))
            own = sum(weight.values())
            floor.append(RETRIEVE * min(1, STRIDE / len(w)))
            reached = 0.0
            for x in sorted(weight, key=lambda x: (-weight[x], -len(x), x)):
                if x not in terms:
                    terms[x] = len(terms)
                    postings.append([])
                postings[terms[x]].append((k, weight[x] / own))
                if reached < 1 - floor[k] / 3:
                    chosen.append((terms[x], k, weight[x] / own))
                    reached += weight[x] / own
            need.append(floor[k] - (1 - reached) - 1e-9)
            q, a = parts(text)
            question.append(words(q))
            answer.append(words(a))
            single.append(q == text)
        weights = [np.array([v for _, v in p]) for p in postings]
        tops = [np.maximum.reduceat(x, np.arange(0, len(x), POSTINGS)) for x in weights]
        chosen.sort()
        t, i, v = (np.array(x) for x in zip(*chosen, strict=True))
        return cls(terms, [i for i, _ in rows], np.array(floor), [np.array([k for k, _ in p]) for p in postings], weights, tops, np.array([x.max() for x in weights]), np.array(need), (np.searchsorted(t, np.arange(len(terms) + 2)), i, v), question, answer, single)

    def passages(self, t: np.ndarray, count: int) -> np.ndarray:
        """Numbers of the passages in which some item's essential terms reach what is needed. t: the text's terms, len(terms) for others."""
        start, items, weights = self.essential
        n = start[t + 1] - start[t]
        hit = np.repeat(start[t] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        if not len(hit):
            return hit
        cell, where = np.unique(items[hit] * (count + 1) + np.repeat(np.arange(len(t)) // STRIDE, n), return_inverse=True)
        score = np.bincount(where, weights[hit])
        need, stretch = self.need[cell // (count + 1)], cell % (count + 1)
        next_ = cell[1:] == cell[:-1] + 1  # the next stretch of the same item
        both = score.copy()
        both[:-1] += np.where(next_, score[1:], 0)
        # a stretch without hits before one with hits: its passage has the item's other words, if any
        before = score >= need
        before[1:] &= ~next_
        return np.unique(np.concatenate([stretch[both >= need], np.maximum(stretch[before] - 1, 0)]))

    def search(self, terms: list[int]) -> list[int]:
        """All items whose score for the distinct terms reaches their own floor, by block-max WAND: cursors stand in order of item, the pivot is the first item
        whose terms' largest weights can reach the least floor, and blocks whose largest weights can't reach it are skipped whole."""
        least = self.floor.min()
        cursors = sorted([self.ids[t][0], t, 0] for t in terms)
        found = []
        while cursors:
            bound, p = 0.0, -1
            for p, (_, t, _) in enumerate(cursors):
                bound += self.top[t]
                if bound >= least:
                    break
            else:
                return found
            pivot = cursors[p][0]
            while p + 1 < len(cursors) and cursors[p + 1][0] == pivot:
                p += 1
            blocks, stop = 0.0, None
            for c in cursors[: p + 1]:
                k = self._seek(c[1], c[2], pivot) // POSTINGS
                if k < len(self.tops[c[1]]):
                    blocks += self.tops[c[1]][k]
                    last = self.ids[c[1]][min(k * POSTINGS + POSTINGS, len(self.ids[c[1]])) - 1]
                    stop = last if stop is None else min(stop, last)
            if blocks >= self.floor[pivot]:
                score = 0.0
                for c in cursors[: p + 1]:
                    c[2] = self._seek(c[1], c[2], pivot)
                    if c[2] < len(self.ids[c[1]]) and self.ids[c[1]][c[2]] == pivot:
                        score += self.weights[c[1]][c[2]]
                        c[2] += 1
                if score >= self.floor[pivot]:
                    found.append(int(pivot))
            else:
                to = pivot + 1 if blocks >= least or stop is None else max(pivot, stop) + 1
                if p + 1 < len(cursors):
                    to = min(to, max(cursors[p + 1][0], pivot + 1))
                for c in cursors[: p + 1]:
                    c[2] = self._seek(c[1], c[2], to)
            for c in cursors:
                c[0] = self.ids[c[1]][c[2]] if c[2] < len(self.ids[c[1]]) else None
            cursors = sorted(c for c in cursors if c[0] is not None)
        return found

    def _seek(self, term: int, at: int, item: int) -> int:
        return at + int(np.searchsorted(self.ids[term][at:], item))


def parts(text: str) -> tuple[str, str]:
    """Question and answer: a test item's last sentence answers the ones before; a single sentence is both."""
    sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n+", text.strip()) if words(s)]
    return (" ".join(sentences[:-1]), sentences[-1]) if len(sentences) > 1 else (text, text)


def grams(w: list[str]) -> set[tuple[str, ...]]:
    return {tuple(w[i : i + GRAM]) for i in range(max(1, len(w) - GRAM + 1))} if w else set()


def shares(q: list[str], a: list[str], single: bool, near: list[str]) -> tuple[float, float]:
    """Shares of a question's and an answer's n-grams that a text's words have; n is GRAM, or the words of a part that has fewer.

    So few words stand in many texts, so beside another part they count only where that one's matches put them: for a long one give or take a fifth of its
    words and GRAM at most, since copies are edited; for two such parts one right after the other."""
    sizes = min(GRAM, len(q)), min(GRAM, len(a))
    at: dict[tuple[str, ...], list[int]] = {}
    for n in set(sizes):
        for i in range(len(near) - n + 1):
            at.setdefault(tuple(near[i : i + n]), []).append(i)
    own = grams(q), grams(a)
    found = [sum(g in at for g in x) / len(x) for x in own]
    if min(sizes) < GRAM and not single and min(found) > 0:
        # where the answer starts, by the matches of each part
        starts = [{x - i + ahead for i in range(len(w) - n + 1) for x in at.get(tuple(w[i : i + n]), ())} for w, n, ahead in ((q, sizes[0], len(q)), (a, sizes[1], 0))]
        apart = min(GRAM, max(len(q), len(a)) // 5)
        if not any(x + d in starts[1] for x in starts[0] for d in range(-apart, apart + 1)):
            found = [0.0 if n < GRAM else x for n, x in zip(sizes, found, strict=True)]
    return found[0], found[1]


def _query(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, none = index.terms.get, len(index.terms)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                w = words(text or "")
                t = np.array([get(x, none) for x in w], np.int64)
                best: dict[int, float] = {}
                for p in index.passages(t, max(1, -(-len(w) // STRIDE))).tolist():
                    lo, hi = p * STRIDE, p * STRIDE + PASSAGE
                    distinct = np.unique(t[lo:hi])
                    for item in index.search(distinct[distinct < none].tolist()):
                        if best.get(item, 0) < 1:
                            q, a = index.question[item], index.answer[item]
                            size = len(q) + len(a) + GRAM
                            own = shares(q, a, index.single[item], w[max(0, lo - size) : hi + size])
                            if own[0] >= QUESTION and own[1] >= ANSWER:
                                best[item] = max(best.get(item, 0), sum(own) / 2)
                out += [(doc, index.items[k], v) for k, v in best.items()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["doc_id", "item_id", "overlap"])
        give_back()

    return run


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [words(x) for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([x for w in own for x in set(w)], pa.string()), pa.array([len(w) if k == 0 else 0 for w in own for k in range(len(set(w)))], pa.int64())], ["term", "words"])


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id and overlap (mean share of the question's and answer's word 3-grams) where a document holds a test item.

    Every passage of every whole text is searched. Items without words and null texts match nothing; a null doc_id is returned as null. Rows that repeat are
    searched each; a result is returned once for a row. Items go to tasks in indexes of SHARD_CHARS code points at most, and the documents are read once for
    each such index, so no larger benchmark is broadcast whole. Term counts are those of all items."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text rlike '[\\\\p{L}\\\\p{N}_]'")
    terms = save(items.mapInArrow(_terms, "term string, words long"), "terms")
    total, n = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)), F.count("*")).first()
    size = terms.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    shards, out = -(-total // SHARD_CHARS), spark.createDataFrame([], "doc_id long, item_id long, overlap double")
    for k in range(shards):
        rows = [r for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == k).orderBy("item_id", "text").collect() if words(r[1])]
        if rows:
            own = spark.createDataFrame([(x,) for x in {x for r in rows for x in words(r[1])}], "term string")
            frequency = dict(tuple(r) for r in terms.join(own, "term").groupBy("term").count().collect())  # of one index's terms
            out = out.union(docs.mapInArrow(_query(Index.build([tuple(r) for r in rows], n, size / n, frequency)), "doc_id long, item_id long, overlap double"))
    return out


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    """leaks over all documents and benchmark items; nulls, empties and repeated rows as there."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
