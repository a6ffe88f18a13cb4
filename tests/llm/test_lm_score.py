import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tracewell.llm.lm_score import LEAST_WEIGHT, ROUNDS, lm_scores, op12_lm_scoring


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), "</end>"]


def kind_of(doc_id):
    left = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10
    return 0 if left == 0 else 2 if left == 9 else 1


class Counts:
    def __init__(self, texts, order):
        self.c = [Counter() for _ in range(order + 1)]
        for t in texts:
            own = ["<start>"] * (order - 1) + t
            for i in range(order - 1, len(own)):
                self.c[0][()] += 1
                for n in range(1, order + 1):
                    self.c[n][tuple(own[i - n + 1 : i + 1])] += 1
        self.context = [Counter() for _ in range(order + 1)]
        for n in range(1, order + 1):
            for g, k in self.c[n].items():
                self.context[n][g[:-1]] += k

    def estimates(self, history, w, order, kinds):
        p, bucket = [1 / (kinds + 1)], 0
        for n in range(1, order + 1):
            h = tuple(history[len(history) - n + 1 :])
            c = self.context[n][h]
            p.append(self.c[n][(*h, w)] / c if c else 0.0 if n > 1 else p[0])
            if n > 1 and c:
                bucket = 64 * (n - 1) + int(math.log2(c))
        return bucket, p


def brute(rows, order, rounds=ROUNDS, gain=1e-5):
    """rows: (doc_id, text, kind). Plain loops over dictionaries."""
    texts = [(d, tokens(t), k) for d, t, k in rows]
    full, rest = Counts([t for _, t, k in texts if k], order), Counts([t for _, t, k in texts if k == 1], order)
    kinds, n_all = len(full.c[1]), full.c[0][()]
    held = []
    for _, t, k in texts:
        if k == 2:
            own = ["<start>"] * (order - 1) + t
            held += [rest.estimates(own[i - order + 1 : i], own[i], order, kinds) for i in range(order - 1, len(own))]
    start = lambda b: [1 / (b // 64 + 2) if k <= b // 64 + 1 else 0.0 for k in range(order + 1)]
    weights, before = {b: start(b) for b, _ in held}, None
    for _ in range(rounds if held else 0):
        sums, n, fit = defaultdict(lambda: [0.0] * (order + 1)), Counter(), 0.0
        for b, p in held:
            parts = [w * x for w, x in zip(weights[b], p)]
            sums[b] = [s + x / sum(parts) for s, x in zip(sums[b], parts)]
            n[b] += 1
            fit += math.log(sum(parts))
        weights = {b: [x / n[b] for x in s] for b, s in sums.items()}
        if before is not None and fit / len(held) - before < gain:
            break
        before = fit / len(held)
    for b, w in weights.items():
        w = [max(x, LEAST_WEIGHT) if k <= b // 64 + 1 else 0.0 for k, x in enumerate(w)]
        weights[b] = [x / sum(w) for x in w]
    out = []
    for d, t, k in texts:
        own, score = ["<start>"] * (order - 1) + t, 0.0
        for i in range(order - 1, len(own)):
            b, p = full.estimates(own[i - order + 1 : i], own[i], order, kinds)
            near = min((x for x in weights if x // 64 == b // 64), key=lambda x: (abs(x - b), x), default=None)
            score += math.log10(sum(w * x for w, x in zip(weights[near] if near is not None else start(b), p)))
        c = [full.c[1][(w,)] for w in t]
        out.append((d, k == 0, len(t), sum(x > 0 for x in c), n_all, sum(math.log10((x + 0.1) / (n_all + 0.1 * (kinds + 1))) for x in c), score))
    return out


def same(got, want):
    key = lambda r: (str(r[0]), r[2], round(r[5], 4), round(r[6], 4))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want):
        assert a[5:] == pytest.approx(b[5:], rel=1e-7, abs=1e-9)


def test_query_against_plain_loops(spark, sf):
    rows = [(r.doc_id, r.text, kind_of(r.doc_id)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op12_lm_scoring(spark, sf).collect()
    same(got, brute(rows, 2))
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_orders_odd_rows_and_cut_texts(spark, order):
    rng = random.Random(order)
    words = ["the", "a", "Cat", "dog", "é", "\0", "sat", "ran", "on", "mat", "|", "x" * 300]
    say = lambda n: " ".join(rng.choices(words, [20, 15, 9, 8, 4, 1, 6, 5, 4, 3, 2, 1], k=n))
    rows = [(i, say(rng.randint(0, 40))) for i in range(120)] + [(500, None), (501, ""), (502, " \t\n"), (503, say(700)), (504, "unseen words here"), (7, say(12)), (None, say(9)), (None, None), (8, "same"), (8, "same")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as kind", "'x' as chunk", "2 as score", "3 as row")
    same(lm_scores(docs, order=order, chunk=100).collect(), brute([(d, t, kind_of(d)) for d, t in rows], order))


def test_no_training_no_fold_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b")], "doc_id long, text string")
    assert sorted(map(tuple, lm_scores(docs, kind=F.lit(0)).collect())) == [(1, True, 4, 0, 0, 0.0, 0.0), (2, True, 2, 0, 0, 0.0, 0.0)]
    same(lm_scores(docs, kind=F.lit(1)).collect(), brute([(1, "a b a", 1), (2, "b", 1)], 2))
    same(lm_scores(docs, kind=F.lit(2)).collect(), brute([(1, "a b a", 2), (2, "b", 2)], 2))
    assert lm_scores(docs.limit(0)).collect() == []


def test_weights_make_a_distribution(spark):
    """The estimates of all known words, the end and one unknown word sum to one under the learnt weights, after any context."""
    from tracewell.llm.lm_score import learn_weights, weight_table

    rng = random.Random(2)
    texts = [tokens(" ".join(rng.choices("abcd", [5, 3, 2, 1], k=6))) for _ in range(80)]
    rest, kinds = Counts(texts[:60], 2), ["a", "b", "c", "d", "</end>"]
    held = [rest.estimates([h], w, 2, len(kinds)) for t in texts[60:] for h, w in zip(["<start>", *t], t)]
    rows = spark.createDataFrame([(b, *p, 1) for b, p in held], "bucket int, p0 double, p1 double, p2 double, n long")
    table = weight_table(learn_weights(rows, 2), 2)
    for history in ("<start>", "a", "d", "never"):
        own = [rest.estimates([history], w, 2, len(kinds)) for w in [*kinds, "unknown"]]
        assert sum(sum(w * x for w, x in zip(table[b], p)) for b, p in own) == pytest.approx(1)


def test_names_survive_the_way():
    import numpy as np

    from tracewell.llm.lm_score import _deltas, _names

    rng = np.random.default_rng(4)
    for n, top in ((0, 2**64 - 1), (1, 2**64 - 1), (2, 2**64 - 1), (5, 7), (1000, 2**64 - 1), (1000, 2**40)):
        names = np.sort(rng.integers(0, top, n, np.uint64, endpoint=True))
        assert (_names(_deltas(names), n) == names).all()
    assert (_names(_deltas(np.zeros(3, np.uint64)), 3) == 0).all()
