import random

import numpy as np

from tracewell.llm import decontam
from tracewell.llm.decontam import Index, leaks, op7_decontamination, words


def cut(text):
    """Lower-cased words: runs of letters, digits and underscores."""
    out, word = [], ""
    for c in (text or "").lower() + " ":
        if c.isalnum() or c == "_":
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def split(item):
    """Question and answer by sentence ends (a mark, then white space) and lines, with the marks replaced; words alone count."""
    for mark in ".!?":
        for space in " \t\n":
            item = item.replace(mark + space, mark + "\n")
    lines = [cut(x) for x in item.split("\n") if cut(x)]
    return (sum(lines[:-1], []), lines[-1]) if len(lines) > 1 else (cut(item), cut(item))


def brute(docs, items):
    """Pairs of a document and an item by plain containment, without anything of the module: four fifths of the 3-grams of both parts stand in the text;
    of items with a part of one or two words the whole word sequence does."""
    parts_of = [(i, *split(item)) for i, item in items if cut(item)]
    out = set()
    for d, text in docs:
        w = cut(text)
        near, line = set(zip(w, w[1:], w[2:])), f" {' '.join(w)} "
        for i, q, a in parts_of:
            if min(len(q), len(a)) < 3:
                if f" {' '.join(q if q == a else q + a)} " in line:
                    out.add((d, i))
            elif all(5 * len(g & near) >= 4 * len(g) for g in (set(zip(p, p[1:], p[2:])) for p in (q, a))):
                out.add((d, i))
    return out


def pairs(df):
    return {(r.doc_id, r.item_id) for r in df.collect()}


def test_query(spark, sf01):
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{sf01}/{t}.parquet").select(k, "text").collect()] for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert pairs(op7_decontamination(spark, sf01)) == brute(docs, items) != set()


def test_shards_and_odd_rows(spark, monkeypatch):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(900)] + ["the"] * 300
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, f"{say(20 + 6 * i)}. {say(9)}.") for i in range(40)] + [(90, None), (91, ""), (92, "?!"), (93, "alone")]
    docs = [(i, say(300) + " " + items[i % 40][1].upper().replace(" ", "\n") + " " + say(200)) for i in range(60)] + [(70 + i, say(700)) for i in range(20)] + [(None, items[3][1]), (2, None), (3, ""), (5, items[5][1])]
    a = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id", "2 as term")
    want = brute(docs, items)
    assert pairs(leaks(a, b)) == want and len(want) >= 60
    monkeypatch.setattr(decontam, "SHARD_CHARS", 1500)
    assert pairs(leaks(a, b)) == want
    assert leaks(a, b.limit(0)).count() == leaks(a.limit(0), b).count() == 0


def test_search_finds_all_above_the_floor():
    rng = random.Random(5)
    items = [(i, " ".join(f"t{int(rng.expovariate(0.05))}" for _ in range(rng.randint(3, 40)))) for i in range(150)]
    frequency = {}
    for _, t in items:
        for x in set(words(t)):
            frequency[x] = frequency.get(x, 0) + 1
    index = Index.build(items, len(items), float(np.mean([len(words(t)) for _, t in items])), frequency)
    for _ in range(200):
        terms = rng.sample(range(len(index.terms)), min(len(index.terms), rng.randint(1, 45)))
        score = np.zeros(len(items))
        for t in terms:
            score[index.ids[t]] += index.weights[t]
        assert sorted(index.search(terms)) == np.flatnonzero(score >= index.floor).tolist()


def holds(text, q, a):
    """Own check for parts of few words: they stand in the text as they are, and right after one another."""
    at = lambda x: " " + " ".join(x.lower().replace(".", " ").split()) + " "
    return at(f"{q} {a}") in at(text)


def test_parts_of_one_and_two_words(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(500)] + ["er", "be", "in", "the"] * 20
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    own = [(f"{say(30)}.", "Er."), (f"{say(12)}.", "Be in."), ("Beber auf.", f"{say(25)}."), ("Beber.", f"{say(9)}."), ("Beber ab.", "Er."), ("Wozu.", "Der da."), ("Solo.", ""), ("Duo solo.", "")]
    items = [(i, f"{q} {a}".strip()) for i, (q, a) in enumerate(own)]
    docs = [(100 * i + k, f"{say(n)} {text} {say(150)}") for i, (_, text) in enumerate(items) for k, n in enumerate((0, 5, 61, 63, 64, 127, 200))]
    docs += [(2000 + i, f"{say(90)} {q} {say(40)} x y z {say(40)} {a}") for i, (q, a) in enumerate(own[:6])]  # its parts, but not together
    docs += [(3000 + i, say(400)) for i in range(20)] + [(4000, "solo"), (4001, "Duo"), (4002, "beber ab er")]
    got = pairs(leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    want = {(d, i) for d, text in docs for i, (q, a) in enumerate(own) if holds(text, q, a)}
    assert got == want and {i for _, i in want} == set(range(8)) and len(want) >= 56


def test_short_answer_of_an_edited_question():
    q = [f"w{i}" for i in range(40)]
    copy = q[:36] + ["x"] + q[37:]
    assert decontam.shares(q, ["er"], False, ["er", *copy, "er", "z"]) == (35 / 38, 1)
    assert decontam.shares(q, ["er"], False, ["er", *copy, "u", "v", "x", "y", "er"]) == (35 / 38, 0)
    assert decontam.shares(["er"], q, False, ["z", "er", *copy]) == (1, 35 / 38)


def test_recall_of_whole_items(spark):
    """Of the documents of the bench's tables that hold an item's whole word sequence, short answers included, all are found."""
    folder = "/root/testdata/sf0.1"
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{folder}/{t}.parquet").select(k, "text").collect()] for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    want, short = set(), set()
    own = [(i, f" {' '.join(cut(x))} ", min(map(len, split(x))) < 3) for i, x in items if cut(x)]
    for d, text in docs:
        line = f" {' '.join(cut(text))} "
        for i, x, few in own:
            if x in line:
                want.add((d, i))
                short |= {(d, i)} if few else set()
    got = pairs(op7_decontamination(spark, folder))
    assert len(want & got) >= 0.95 * len(want) > 100 and short <= got and len(short) > 20


def test_gate_loses_no_passage_that_a_search_of_all_finds():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)] + [f"c{i}" for i in range(12)] * 60
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    # items that start with words of many items and end with their own, so that only the second half is essential
    items = [(i, " ".join([f"c{rng.randrange(12)}" for _ in range(25)] + [f"own{i}x{k}" for k in range(rng.choice((4, 6, 30)))]) + ".") for i in range(30)]
    frequency = {}
    for _, text in items:
        for x in set(words(text)):
            frequency[x] = frequency.get(x, 0) + 1
    index = Index.build(items, len(items), float(np.mean([len(words(x)) for _, x in items])), frequency)
    found = 0
    for at in range(130):
        copy = words(items[at % 30][1])
        copy = [x for k, x in enumerate(copy) if k < 25 or k % 5 or rng.random() < 0.3]  # own words are lost
        w = [f"z{i}" for i in range(at)] + copy + [f"z{i}" for i in range(200)] + (say(60) if at % 2 else [])
        t = np.array([index.terms.get(x, len(index.terms)) for x in w], np.int64)
        count = -(-len(w) // decontam.STRIDE)
        gate = set(index.passages(t, count).tolist())
        for p in range(count):
            distinct = np.unique(t[p * decontam.STRIDE : p * decontam.STRIDE + decontam.PASSAGE])
            hits = index.search(distinct[distinct < len(index.terms)].tolist())
            assert not hits or p in gate, (at, p, hits)
            found += bool(hits)
    assert found > 100
