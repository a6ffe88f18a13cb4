import math
import random
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import oracle, rows
from tracewell.llm.lexical_search import LEXICAL_SEARCH_SQL, Treap, op11_lexical_search, search, terms_of


def brute(docs, items, k=20):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    inside = lambda c: ord(c) > 127 or c in "0123456789abcdefghijklmnopqrstuvwxyz"
    cut = lambda t: "".join(c if inside(c) else " " for c in low(t)).replace(" ", " ").split(" ")
    own = [(d, Counter(x for x in cut(t) if x)) for d, t in docs]
    own = [(d, c, sum(c.values())) for d, c in own if c]
    n_docs, n_all = len(own), sum(n for _, _, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in items:
        q = Counter(x for x in cut(text) if x)
        found = []
        for d, c, n in own:
            m = 100 - 25 + 25 * n * n_docs // n_all
            s = sum(k_ * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, k_ in q.items() if c[t])
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("scale", ["sf", "sf01"])
def test_query_against_sql(spark, scale, request):
    folder = request.getfixturevalue(scale)
    got = op11_lexical_search(spark, folder).collect()
    assert rows(got) == oracle(LEXICAL_SEARCH_SQL, folder) and len(got) == 40 * 20


@pytest.mark.parametrize("size", [(1 << 15, 10**6), (7, 40)])
def test_odd_rows_ties_and_small_blocks(spark, size):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)] + ["Éa", " x", "ÀB", "a\0b", "日本"]
    say = lambda n: " ".join(rng.choices(words, range(len(words), 0, -1), k=n))
    docs = [(i, say(rng.randint(1, 30))) for i in range(90)] + [(200 + i, "w1 w2 copy") for i in range(30)] + [(200, "w1 w2 copy"), (None, "w1 w2 copy"), (None, None), (301, None), (302, ""), (303, "--- !"), (304, say(3000)), (-5, "w1 w2 copy"), (305, "W1W2 w1.w2_w3")]
    items = [(1, "w1 w2 copy"), (2, None), (3, ""), (4, "never seen"), (5, "w1 w1 W1 w29 éA  X"), (None, "日本 a\0b"), (6, "copy"), (6, "w3")]
    make = lambda x, name: spark.createDataFrame(x, f"{name} long, text string").selectExpr("*", "1 as score", "2 as rank", "'x' as item", "3 as docs")
    got = search(make(docs, "doc_id"), make(items, "item_id"), 20, *size)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)
    assert search(make(docs, "doc_id").limit(0), make(items, "item_id")).collect() == []
    assert search(make(docs, "doc_id"), make(items, "item_id").limit(0)).collect() == []
    assert search(make([(1, None)], "doc_id"), make(items, "item_id")).collect() == []


def test_items_in_several_groups(spark, monkeypatch):
    from tracewell.llm import lexical_search

    docs, items = [(i, f"a{i % 7} b{i % 5} c") for i in range(60)], [(i, f"a{i % 7} b{i % 3}") for i in range(12)]
    monkeypatch.setattr(lexical_search, "ITEM_CHARS", 20)
    got = search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 5)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, 5)


def test_treap_against_a_plain_grid():
    rng = np.random.default_rng(1)
    for rows_, columns, n in ((1, 1, 1), (5, 40, 60), (70, 9, 200), (33, 300, 1500)):
        cells = {(int(r), int(c)): int(v) for r, c, v in zip(rng.integers(0, rows_, n), rng.integers(0, columns, n), rng.integers(1, 50, n))}
        r, c, v = (np.array(x) for x in zip(*[(*k, x) for k, x in cells.items()]))
        treap = Treap(r, c, v)
        assert treap.top[0] == max(cells.values())
        docs = [(False, 3 * i) for i in range(1 << treap.height)]
        some = rng.choice(rows_, min(rows_, 4), replace=False)
        weights = rng.integers(1, 9, len(some))
        want = sorted((-s, docs[j]) for j in range(columns) if (s := sum(int(w) * cells.get((int(i), j), 0) for i, w in zip(some, weights))))
        best = []
        treap.search(some, weights, docs, best, 10)
        assert best == want[:10]
    assert terms_of("A-b_É1 x") == ["a", "b", "É1 x"]
