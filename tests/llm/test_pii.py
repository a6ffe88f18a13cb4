import hashlib
import random
import re

from tracewell.llm.pii import base_spans, candidates, find_spans, luhn, op6_pii, redact, train, unpack

KINDS = ("email", "ip", "card", "phone")
PLAIN = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    out = []
    for k, p in enumerate(PLAIN):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if k == 0 or k == 1 and all(int(x) <= 255 for x in m[0].split(".")) or k == 2 and 14 <= len(d) <= 19 and luhn(d) or k == 3 and 10 <= len(d) <= 15:
                out.append((k, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], s[0]))


def digest(spans):
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def test_base_spans_are_the_patterns():
    rng = random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choice(["a", "B", "1", "22", "4111111111111111", "@", ".", "-", "+", " ", "(", ")", "%", "é", "0", "x.y", "\n"]) for _ in range(rng.randint(0, 40)))
        assert sorted(base_spans(text), key=lambda s: (s[1], s[0])) == brute(text), text


def test_query(spark, sf01):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf01}/documents.parquet").collect()}
    rows = op6_pii(spark, sf01).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in range(4)) and r.base_sha256 == digest(base)
        assert {f"{KINDS[k]}:{a}:{b}" for k, a, b in base} <= set(r.spans.split(","))


def test_long_texts_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1" * 100_000, "+1 " + "(" * 300_000):
        assert isinstance(base_spans(text), list)


def test_odd_rows_and_added_spans(spark):
    rows = [(i, f"call my phone (030) 555-{1000 + i} or +49 30 5550{100000 + i}, card 4111-1111-1111-1111, mail bob@site{i}.com") for i in range(60)]
    rows += [(70, None), (71, ""), (None, "a@b.c"), (72, "order no (030) 555-1234"), (0, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as spans", "2 as kind")
    out = find_spans(docs).collect()
    assert len(out) == 65 and {len(r.spans) for r in out if r.doc_id in (70, 71)} == {0}
    one = next(r for r in out if r.doc_id == 5)
    assert [s.kind for s in one.spans if s.base] == ["phone", "card", "email"] and all(s.start < s.end for s in one.spans)
    assert redact(rows[5][1], one.spans).endswith("card [card], mail [email]")
    assert find_spans(docs.limit(0)).count() == 0 and train([]) == {}
    assert unpack(((3 * 243 + 1 + 2 * 3 + 1 * 9 + 2 * 27 + 0 * 81) << 4) | 5) == (3, [1, 2, 1, 2, 0], [1, 0, 1, 0])


def test_the_method_adds_and_refuses_spans(spark):
    rng = random.Random(4)
    code = lambda n, of="0123456789abcdef": "".join(rng.choice(of) for _ in range(n))
    good, bad = {}, {}
    rows = []
    for i in range(240):
        key, public, junk = code(40), code(40), "x1" * 12
        mail = f"jane{i} (at) site{i} (dot) com"
        shape = i % 6
        text = [f'start token = "{key}" end', f"see commit {public} there", f"API_KEY: {code(24, 'abcdefghij0123456789KLMNOP')} login", f"odd {junk} run", f"contact {mail} or write", f"meet 12 (at) noon{i} (dot) q1"][shape]
        rows.append((i, text))
        (good if shape in (0, 2, 4) else bad)[i] = shape
    out = {r.doc_id: r.spans for r in find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    added = {d: [(s.kind, s.base, dict(rows)[d][s.start : s.end]) for s in spans] for d, spans in out.items()}
    assert all(len(added[d]) == 1 and not added[d][0][1] and added[d][0][0] == ("email" if good[d] == 4 else "secret") for d in good)
    assert all(k in dict(rows)[d] and len(k) >= 20 for d in good for _, _, k in added[d])
    assert not any(added[d] for d in bad)
    assert all(s.probability >= 0.9 for spans in out.values() for s in spans)


def test_secrets_of_the_tables(spark, sf01):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf01}/documents.parquet").collect()}
    want = {(d, f"secret:{m.start(1)}:{m.end(1)}") for d, t in texts.items() for m in re.finditer(r'token = "([0-9a-f]{40})"', t or "", re.I)}
    got = {(r.doc_id, s) for r in op6_pii(spark, sf01).collect() for s in r.spans.split(",") if s.startswith("secret")}
    assert got == want and want


def test_many_candidates_take_linear_time():
    text = "0301 555-1234 a@b.cc " * 20_000
    assert len(candidates(text)) >= 20_000
