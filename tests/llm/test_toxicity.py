import random
import zlib

import numpy as np

from tracewell.llm import toxicity as T
from tracewell.llm.toxicity import Model, fit, fragments, op2_toxicity, score, symbols, train


def test_held_out_accuracy(spark):
    data = "/root/testdata/sf0.1"
    rows = op2_toxicity(spark, data).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    n = lambda p, t: sum(r.predicted == p and r.toxic == t for r in rows if r.held_out)
    print(n(1, 1), n(1, 0), n(0, 1), n(0, 0))
    assert n(1, 1) > 0.8 * (n(1, 1) + n(0, 1)) and n(1, 0) < 0.01 * (n(1, 0) + n(0, 0))


def test_gaps_and_spelled_out_words():
    clean = [f"a fine day {w} near the {v} house" for w in ("walk", "sings", "moron", "iota")[:2] for v in ("red", "old", "tall", "small", "grey", "stone", "idle", "rotten", "video", "pilot")] * 4
    model = fit([*clean, *[c.replace("day", "idiot") for c in clean[:30]]], [0] * len(clean) + [1] * 30)
    assert model.score("what an idiot") > 0.7 > 0.3 > model.score("what a fine day")
    assert model.margins("what an i d i o t")[0] == model.margins("what an i.d.i.o.t")[0] > model.margins("what an old house")[0]
    assert model.margins("what an idxiot")[0] > model.margins("what an old house")[0]
    s, begin, end = fragments(symbols("ab c. d e, fgh"))
    assert [s[a:b].tolist() for a, b in zip(begin, end)] == [[1, 2], [3, 4, 5], [6, 7, 8]]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "?!"), (3, "?!"), (4, "é\U0001f600 " * 50_000)], "doc_id long, text string").selectExpr("*", "0 as toxic")
    labels = spark.createDataFrame([(1, 1), (None, 1), (3, None), (2, 0)], "doc_id long, toxic int").selectExpr("*", "'a' as text")
    model = train(docs, labels)
    assert isinstance(model, Model)
    rows = score(docs, model).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert score(docs.limit(0), train(docs.limit(0), labels.limit(0))).count() == 0


def test_texts_over_longest_never_train(spark):
    docs = [(i, ("you vile fool " if i % 2 else "a fine calm day ") * (1 + i % 4)) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(44)], "doc_id long, toxic int")
    long = [(40 + i, "fine vile words " * 20) for i in range(4)]
    few, all_ = (spark.createDataFrame(x, "doc_id long, text string") for x in (docs, docs + long))
    a, b, c = T.train(few, labels, where="true"), T.train(all_, labels, where="true", longest=100), T.train(all_, labels, where="true")
    assert a.bias == b.bias and a.table.tobytes() == b.table.tobytes() != c.table.tobytes()


def subsequences(word):
    """All subsequences of four symbols of a padded word with at most two skipped, by plain loops: 0.5 for each skipped one; zeros only at the ends."""
    letters = " abcdefghijklmnopqrstuvwxyz"
    s = [0, *map(letters.index, word), *[0] * 6]
    out = {}
    for i in range(len(s) - 6):
        for j in range(i + 1, i + 6):
            for k in range(j + 1, i + 6):
                for m in range(k + 1, i + 6):
                    if s[j] and s[k]:
                        u = (s[i], s[j], s[k], s[m])
                        out[u] = out.get(u, 0) + 0.5 ** (m - i - 3)
    return out


def kernel(x, y):
    a, b = subsequences(x), subsequences(y)
    return sum(v * b.get(u, 0) for u, v in a.items())


def test_folded_weights_are_the_naive_kernel():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdeo") for _ in range(rng.randint(3, 9)))
    landmarks = [word() for _ in range(8)] + [f"{word()} {word()}"]
    words = [word() for _ in range(60)] + landmarks + [f"{word()} {word()}" for _ in range(20)]
    features, own, codes = T._features(words, landmarks)
    size = T.norms(np.array([len(w) for w in words]))
    naive = np.array([[kernel(w, l) for l in landmarks] for w in words])
    assert np.allclose(features * size[:, None], naive, rtol=1e-4)
    weights = np.array([rng.uniform(-1, 1) for _ in landmarks])
    table = np.zeros(T.CODES, np.float32)
    table[codes] = own @ weights
    model = Model(table, 0.25, (1.0, 0.0, 0.0))
    for w, k, n in zip(words, naive, size):
        _, begin, end, f, _ = model.rate(w)
        whole = int(np.argmax(end - begin))
        assert abs(f[whole] - (k @ weights / n + 0.25)) < 1e-3


def test_sentences_and_insults_of_two_words():
    points = np.frombuffer("Ab c. De? f\ng 1.5 h".encode("utf-32-le"), np.uint32)
    at = T.sentences(points)
    assert [int(at[1 + "Ab c. De? f\ng 1.5 h".index(c)]) for c in "ADfgh"] == [0, 1, 2, 3, 3]
    rng = random.Random(1)
    fill = ["walk", "green", "table", "river", "quiet", "seven", "paper", "cloud", "stone", "light"]
    say = lambda: " ".join(rng.choice(fill) for _ in range(6))
    clean = [f"{say()} fake. {say()} news." if i % 2 else f"{say()} news. {say()} fake." for i in range(60)]
    model = fit([*clean, *[f"{say()}. {say()} fake news {say()}." for _ in range(40)]], [0] * 60 + [1] * 40)
    both, apart = (model.margins(f"{say()} {x} {say()}.")[0] for x in ("fake news", "fake. news"))
    assert both > apart
