import random
import re

import numpy as np
import pytest

from tests.llm.helpers import thue_morse
from tracewell.llm import jaccard_join as jj
from tracewell.llm.jaccard_join import jaccard_components, op9_jaccard_join, part_keys, tree_links


def brute(rows):
    sets = {}
    for d, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = {}
    for d, s in sets.items():
        for t in s:
            where.setdefault(t, []).append(d)
    pairs = {(a, b) for v in where.values() for i, a in enumerate(v) for b in v[i + 1 :]}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {(d, len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize("block", [4000, 4])
def test_against_all_pairs(spark, sf01, block):
    docs = spark.read.parquet(f"{sf01}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert {tuple(r) for r in jaccard_components(docs, block=block).collect()} == brute(rows)


def test_odd_rows(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "ONE  two"), (6, base), (7, base + " x"), (8, base.replace("w30", "y")), (9, "é " * 5000), (10, "é " * 4000)]
    rows += [(20 + i, " ".join(f"w{k}" for k in range(i, 60 + i))) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as part", "'x' as root")
    assert {tuple(r) for r in jaccard_components(docs).collect()} == brute(rows)
    none = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard_components(none).collect()), key=str) == [(3, 2, 3), (3, 2, 3), (None, 2, None)]
    assert jaccard_components(docs.limit(0)).count() == 0


def test_keys_and_tree_lose_nothing():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.choice([1, 2, 3, 5, 8, 17, 40, 130])
        x = {rng.getrandbits(63) for _ in range(n)}
        y = set(rng.sample(sorted(x), max(1, n - rng.randint(0, n // 8 + 1)))) | {rng.getrandbits(63) for _ in range(rng.randint(0, n // 8 + 1))}
        u, v = (np.sort(np.array(list(s), np.uint64)) for s in (x, y))
        if 5 * len(x & y) >= 4 * len(x | y):
            a, b = ({(k, which): (set(keys.tolist()), spare) for which, (keys, k, spare) in enumerate(part_keys(s, 4, 5))} for s in (u, v))
            lists = [(x, y) for (k, _), x in a.items() for (m, _), y in b.items() if k == m and x[0] & y[0]]
            assert any(len(x[0] & y[0]) > len(x[0]) - max(0, x[1] + len(x[0])) or len(x[0] & y[0]) > len(y[0]) - max(0, y[1] + len(y[0])) for x, y in lists)
            assert tree_links([u, v], 4, 5) in ([(0, 1)], [(1, 0)])


def test_query(spark, sf):
    assert op9_jaccard_join(spark, sf).count() == 200


def test_linked_copies_are_not_dealt_as_block_pairs(spark, monkeypatch):
    rng = random.Random(6)
    page = [f"w{i}" for i in range(100)]
    copies = [page] + [page[:k] + [f"x{rng.random()}"] + page[k + 1 :] for k in [rng.randrange(100) for _ in range(159)]]
    chain = [[f"w{k}" for k in range(i, 100 + i)] for i in range(5, 60, 5)] + [[f"w{k}" for k in range(i, 80 + i)] for i in range(3, 60, 7)]
    rows = [(i, " ".join(w)) for i, w in enumerate(copies + chain)]
    docs, sent, pairs = spark.createDataFrame(rows, "doc_id long, text string"), [], jj._block_pairs

    def counted(*args):
        out = pairs(*args)
        sent.append(out.count())
        return out

    monkeypatch.setattr(jj, "_block_pairs", counted)
    assert {tuple(r) for r in jaccard_components(docs, block=16).collect()} == brute(rows)
    assert sum(sent) < 8 * len(rows), sent


def test_words_that_defeat_polynomials_modulo_powers_of_two(spark):
    one, two = thue_morse(2048), thue_morse(2048, "b", "a")
    rows = [(1, f"{one} x y z w"), (2, f"{two} x y z w"), (3, one), (4, two), (5, f"{one} x"), (6, f"{two} x"), (7, one.upper())]
    got = {tuple(r) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) and {c for _, _, c in got} == {1, 2, 3, 4, 5, 6}
