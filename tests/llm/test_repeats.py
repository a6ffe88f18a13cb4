import hashlib
import random

import numpy as np
import pytest

from tests.llm.helpers import thue_morse
from tracewell.llm.common import PRIME, SpanHash, _times
from tracewell.llm.repeats import op8_suffix_dedup, remove_repeats


def brute(rows, length):
    where = {}
    data = [(t or "").encode() for _, t in rows]
    for k, b in enumerate(data):
        for i in range(len(b) - length + 1):
            where.setdefault(b[i : i + length], []).append((k, i))
    gone = [bytearray(len(b)) for b in data]
    for v in where.values():
        if len(v) > 1:
            for k, i in v:
                gone[k][i : i + length] = b"\1" * length
    out = []
    for (d, _), b, g in zip(rows, data, gone):
        out.append((d, len(b), sum(g), len([x for x in bytes(g).split(b"\0") if x]), hashlib.sha256(bytes(x for x, y in zip(b, g) if not y)).hexdigest()))
    return sorted(out, key=str)


def answer(docs, length, crowd=8_000):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in remove_repeats(docs, length, crowd).collect()), key=str)


def test_query_against_all_strings(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in op8_suffix_dedup(spark, sf).collect()), key=str) == brute(rows, 400)


@pytest.mark.parametrize("length", [12, 50])
def test_odd_rows(spark, length):
    unit = "The quick brown fox jumps over the lazy dog near the river bank at noon; "
    rows = [(1, None), (2, ""), (3, "short"), (4, unit + "a"), (5, "b" + unit), (5, "b" + unit), (6, "x" * 300), (None, unit[:40]), (8, "é" * 60), (9, "ab" * 90 + unit[20:70])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as uid", "'z' as part")
    assert answer(docs, length) == brute(rows, length) == answer(docs, length, 0)
    assert answer(docs.limit(0), length) == []


def brute_by_numbers(rows, length):
    """brute() for larger tables: strings by two sums over random byte values, by Horner steps in arrays that wrap at 2**64."""
    data = [(t or "").encode() for _, t in rows]
    whole = np.frombuffer(b"".join(data), np.uint8)
    starts = np.cumsum([0, *map(len, data)])
    names = []
    for base, seed in ((6_364_136_223_846_793_005, 1), (3_935_559_000_370_003_845, 2)):
        value = np.random.default_rng(seed).integers(1, 2**63, 256).astype(np.uint64)[whole]
        own = np.zeros(len(whole) - length + 1, np.uint64)
        for k in range(length):
            own *= np.uint64(base)
            own += value[k : k + len(own)]
        names.append(own)
    inside = np.concatenate([np.arange(a, b - length + 1) for a, b in zip(starts[:-1], starts[1:]) if b - a >= length])
    first, second = names[0][inside], names[1][inside]
    order = np.lexsort((second, first))
    same = (first[order][1:] == first[order][:-1]) & (second[order][1:] == second[order][:-1])
    twice = np.zeros(len(inside), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    marks = np.zeros(len(whole) + 1, np.int64)
    np.add.at(marks, inside[twice], 1)
    np.add.at(marks, inside[twice] + length, -1)
    gone = np.cumsum(marks)[:-1] > 0
    out = []
    for (d, _), b, lo in zip(rows, data, starts):
        g = gone[lo : lo + len(b)]
        runs = int((np.diff(np.concatenate([[0], g.astype(np.int8)])) == 1).sum())
        out.append((d, len(b), int(g.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~g].tobytes()).hexdigest()))
    return sorted(out, key=str)


def test_query_on_more_documents(spark, sf01):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf01}/documents.parquet").select("doc_id", "text").collect()]
    want = brute_by_numbers(rows, 400)
    assert sorted((tuple(r) for r in op8_suffix_dedup(spark, sf01).collect()), key=str) == want and sum(x[2] > 0 for x in want) > 50


def test_shared_parts_of_any_alignment(spark):
    """Texts that share parts with other surroundings, also nul bytes and runs of one letter, at every alignment to the triggers."""
    rng = random.Random(9)
    say = lambda n, of="abcdefgh \n": "".join(rng.choice(of) for _ in range(n))
    parts = [say(n) for n in (60, 75, 90, 130, 200)] + ["\0" * 70 + say(30), "z" * 150]
    rows = [(i, say(rng.randint(0, 90)) + rng.choice(parts)[rng.randint(0, 9) :] + say(rng.randint(0, 60), "xyz\0") + rng.choice(parts) + say(rng.randint(0, 5))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 50)
    assert answer(docs, 50) == want == answer(docs, 50, 3) == answer(docs, 50, 0)


def test_one_footer_under_many_unlike_texts(spark):
    """More ends with one continuation than may meet are dealt out by string: no part holds them all, and the result is that of one part."""
    rng = random.Random(4)
    say = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    footer, notice = say(600), say(430)
    rows = [(i, say(rng.randint(200, 500)) + (notice[rng.randint(0, 30) :] if i % 9 == 0 else "") + footer[rng.randint(0, 3) :]) for i in range(3_000)]
    rows += [(i, rows[i - 3_000][1]) for i in range(3_000, 3_040)] + [(7, rows[7][1])] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows, 400)
    assert answer(docs, 400, 100) == want and sum(x[2] >= 590 for x in want) == len(rows)


def test_strings_that_defeat_polynomials_modulo_powers_of_two(spark):
    one, two = thue_morse(4096), thue_morse(4096, "b", "a")
    data = np.frombuffer((one + two).encode(), np.uint8)
    h = SpanHash(data)
    for n in (512, 1024, 2048, 4096):
        a, b = h(np.array([0, 4096]), np.array([n, 4096 + n]))
        assert a != b and h.width(n)[0] == a and h.width(n)[4096] == b
    assert SpanHash(data[4096:])(np.array([0]), np.array([4096]))[0] == h(np.array([4096]), np.array([8192]))[0]
    rng = random.Random(1)
    for _ in range(200):
        x, y = rng.randrange(int(PRIME)), rng.randrange(int(PRIME))
        assert int(_times(np.array([x], np.uint64), np.array([y], np.uint64))[0]) == x * y % int(PRIME)
    rows = [(1, one), (2, two), (3, "head " + one[:2048]), (4, two[:1024] + one[:1024])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert answer(docs, 1024) == brute(rows, 1024) and answer(docs, 2048) == brute(rows, 2048)
