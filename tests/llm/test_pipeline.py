import corpus_pipeline as P

from tests.llm.helpers import oracle
from tests.llm.test_decontam import brute as leaked
from tests.llm.test_jaccard_join import brute as linked
from tracewell.llm.line_dedup import LINE_DEDUP_SQL
from tracewell.llm.toxicity import train


def table(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_against_brute_force(spark, sf01):
    read = lambda t: spark.read.parquet(f"{sf01}/{t}.parquet")
    docs = read("documents")
    model = train(docs, read("labels"))
    kept = P.save(P.toxicity(spark, docs, sf01), "t")
    assert set(table(kept)) == {r.doc_id for r in docs.collect() if model.score(r.text or "") < 0.7}

    lines = P.save(P.line_dedup(spark, kept, sf01), "l")
    want = oracle(LINE_DEDUP_SQL, sf01, documents=kept.toPandas())
    import hashlib

    assert {(d, hashlib.sha256(r.text.encode()).hexdigest()) for d, r in table(lines).items()} == {(w[0], w[1]) for w in want}
    assert all(r.n_chars == len(r.text) for r in lines.collect()) and lines.columns == docs.columns

    near = P.save(P.near_duplicates(spark, lines, sf01), "n")
    assert set(table(near)) == {c for _, _, c in linked([(r.doc_id, r.text) for r in lines.collect()])}

    clean = P.save(P.decontamination(spark, near, sf01), "d")
    bad = {d for d, _ in leaked([(r.doc_id, r.text) for r in near.collect()], [tuple(r) for r in read("benchmark").select("item_id", "text").collect()])}
    assert set(table(clean)) == set(table(near)) - bad and clean.columns == docs.columns

    placed = P.packing(spark, clean, sf01).collect()
    assert {r.doc_id for r in placed} == set(table(clean))
    fill = {}
    for r in sorted(placed, key=lambda r: (r.sequence_id, r.offset)):
        assert fill.get(r.sequence_id, 0) == r.offset
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 4096


def test_run(spark, sf):
    out = P.run(spark, sf)
    assert out.count() > 0 and out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert 4 <= len(P.STAGES) <= 5


EXTRA = ["score", "toxicity", "n_lines", "n_dropped", "component_id", "key", "root", "uid", "did", "rid", "length", "bits", "row", "doc", "item_id", "n_shingles"]
LINE = "a line of more than forty code points that several documents repeat"


def odd(spark, sf):
    """The documents with odd rows and columns of clashing names."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    one = " ".join(f"word{i}" for i in range(80))
    rows = [(None, f"{LINE}\nlost row"), (None, None), (900_001, None), (900_002, ""), (900_003, "é " * 150_000), (900_004, one), (900_004, one), (900_005, one), (900_006, "\n\n\n"), (900_010, "\0 nul")]
    rows += [(900_020 + i, f"{LINE}\nown text {i} {' '.join(f'w{i}x{k}' for k in range(60))}") for i in range(6)] + [(900_030, f"{LINE}\n{LINE}\nlast")]
    more = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "cast(null as string) as lang", "'odd' as source", "cast(length(text) as long) as n_chars")
    docs = docs.union(more.select(*docs.columns))
    for k, c in enumerate(EXTRA):
        docs = docs.selectExpr("*", f"{k} as {c}")
    return docs


def seen(df, ids):
    return sorted((r.doc_id or 0, r.text or "") for r in df.collect() if r.doc_id is None or r.doc_id in ids)


def test_stages_keep_odd_rows_and_columns(spark, sf):
    docs = odd(spark, sf)
    ids = {900_001, 900_002, 900_003, 900_004, 900_005, 900_006, 900_010}
    before = seen(docs, ids)
    for name, stage in P.STAGES[:-1]:
        kept = P.save(stage(spark, docs, sf), name)
        assert kept.columns == docs.columns and all(r[c] == k for r in kept.limit(5).collect() for k, c in enumerate(EXTRA)), name
        now = seen(kept, ids)
        if name == "near_duplicates":  # of equal texts the smallest doc_id stays, with both of its rows
            assert now == [x for x in before if x[0] != 900_005]
        else:
            assert now == before, name
        if name == "line_dedup":
            lines = {r.doc_id: r.text.count(LINE) for r in kept.collect() if r.doc_id and r.doc_id >= 900_020}
            assert lines == {**{900_020 + i: 0 for i in range(6)}, 900_030: 2}
    placed = [r for r in P.packing(spark, docs, sf).collect() if r.doc_id is None or r.doc_id in ids]
    assert sum(r.piece == 0 for r in placed) == len(before) and sum(r.doc_id == 900_003 for r in placed) > 10


def test_a_toxic_row_goes_whatever_its_id(spark, sf01):
    docs, labels = (spark.read.parquet(f"{sf01}/{t}.parquet") for t in ("documents", "labels"))
    model = train(docs, labels)
    worst = max((r.text for r in docs.join(labels.where("toxic = 1"), "doc_id").collect()), key=model.score)
    more = spark.createDataFrame([(None, worst), (None, "calm words")], "doc_id long, text string").selectExpr("doc_id", "text", "'en' as lang", "'x' as source", "1L as n_chars")
    kept = P.toxicity(spark, docs.unionByName(more), sf01)
    assert [r.text for r in kept.where("doc_id is null").collect()] == ["calm words"]


def test_stages_of_empty_tables(spark, sf):
    docs = odd(spark, sf).limit(0)
    for name, stage in P.STAGES:
        assert stage(spark, docs, sf).count() == 0, name
