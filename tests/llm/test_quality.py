import math
import re

from tests.llm.helpers import thue_morse
from tracewell.llm.quality import at_most, cutoffs, judge, op10_quality_rules


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)} if len(windows) < 400 else _many(windows)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def _many(windows):
    from collections import Counter

    n = Counter(windows)
    return {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(3)}


def answer(df):
    return sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in df.collect()), key=str)


def test_query(spark, sf01):
    docs = spark.read.parquet(f"{sf01}/documents.parquet").collect()
    out = op10_quality_rules(spark, sf01)
    assert answer(out) == sorted(((r.doc_id, *brute(r.text)) for r in docs), key=str)
    assert out.where("kept and base_failed").count() == 0


def test_keeps_the_good_and_rejects_the_bad(spark):
    data = "/root/testdata/sf0.1"
    out = op10_quality_rules(spark, data).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").where("not base_failed")
    n = {(r.quality, r.kept): r["count"] for r in out.groupBy("quality", "kept").count().collect()}
    print(n)
    assert n.get((1, False), 0) <= 0.05 * n[(1, True)] and n.get((0, False), 0) > 0


def test_odd_rows(spark):
    texts = [None, "", "\n\n", " a\na\na \n\na", "x " * 500, "é# | <\x0bb", "a b c a b c", "#" * 100_000]
    rows = [(i, t, None if i % 2 else "en") for i, t in enumerate(texts)] + [(None, "a", None), (1, "b c", "fr"), (1, "b c", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as kept", "2 as n_words")
    labels = spark.createDataFrame([(0, None), (None, 1), (1, 0), (1, 1)], "doc_id long, quality int").selectExpr("*", "3 as stratum")
    assert answer(judge(docs, labels)) == sorted(((d, *brute(t)) for d, t, _ in rows), key=str)
    assert judge(docs.limit(0), labels.limit(0)).count() == 0


def test_exact_bound():
    for k, n, p in ((0, 50, 0.05), (3, 80, 0.1), (7, 7, 0.3)):
        assert math.isclose(at_most(k, n, p), sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))
    good = [("s", "r", 0, c, True, 4000) for c in (True, False)] + [("s", "r", 60, c, True, 5) for c in (True, False)]
    assert cutoffs([*good, ("s", "r", 50, True, False, 900)]) == {("s", "r"): 50}
    assert cutoffs([("s", "r", 0, False, True, 30), ("s", "r", 50, True, False, 900)]) == {}


def test_words_and_lines_that_defeat_polynomials_modulo_powers_of_two(spark):
    one, two = thue_morse(1024), thue_morse(1024, "b", "a")
    texts = [f"{one}\n{two}", f"{one} {two} x {two} {one} x {one} {two} x", f"{one}\n{one}\n {one}", f"{one} {two} c " * 30]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'en' as lang")
    got = judge(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert answer(got) == sorted(((d, *brute(t)) for d, t in enumerate(texts)), key=str)
    assert [r.n_distinct for r in got.orderBy("doc_id").collect()][:2] == [2, 3]
