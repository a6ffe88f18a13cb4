from unittest import mock

from tests.llm.helpers import oracle, rows
from tracewell.llm import line_dedup
from tracewell.llm.line_dedup import LINE_DEDUP_SQL, drop_lines, op4_line_dedup


def test_sql(spark, sf01):
    assert rows(op4_line_dedup(spark, sf01).collect()) == oracle(LINE_DEDUP_SQL, sf01)


def test_hot_lines(spark, sf01):
    with mock.patch.multiple(line_dedup, HOT=1e-9, HOT_SAMPLE=0.9), mock.patch.object(line_dedup, "max", lambda *_: 3, create=True):
        assert rows(op4_line_dedup(spark, sf01).collect()) == oracle(LINE_DEDUP_SQL, sf01)


def test_odd_rows(spark):
    line = "x" * 39 + "É"
    data = [(i, f"start {i}\n {line.upper() if i % 2 else line}\t\n{line}\n\nend") for i in range(6)] + [(7, None), (8, ""), (9, "\n"), (10, line * 3000), (None, line), (5, line)]
    docs = spark.createDataFrame(data, "doc_id long, text string").selectExpr("text", "doc_id", "1 as uid", "2 as h1", "3 as bits")
    out = {(r.doc_id, r.text[:20] if r.text else r.text): (r.n_lines, r.n_dropped, len(r.text)) for r in drop_lines(docs).collect()}
    assert out[(0, "start 0\n\nend")] == (5, 2, 12) and out[(7, "")] == (1, 0, 0) and out[(9, "\n")] == (2, 0, 1)
    assert [v for k, v in out.items() if k[0] == 5] and all(v[1] == 0 for k, v in out.items() if k[0] in (5, None, 10))
    assert drop_lines(docs).columns == ["text", "doc_id", "uid", "h1", "bits", "n_lines", "n_dropped"]
    assert drop_lines(docs.limit(0)).count() == 0
