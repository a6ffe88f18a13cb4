import base64
import hashlib

import duckdb
from pyspark.sql import functions as F

from tests.llm.helpers import oracle, rows
from tracewell.llm.common import new_path
from tracewell.llm.warc import WARC_SQL, op5_warc, read_records, write_archives


def test_sql(spark, sf01):
    assert rows(op5_warc(spark, sf01).collect()) == oracle(WARC_SQL, sf01)


def test_round_trip_selection_and_odd_rows(spark):
    data = [(i, f"http://a/{i}", "é\r\n\r\n" * (i % 5) + str(i % 7)) for i in range(60)] + [(100, None, None), (101, "http://b\r\nX: y", ""), (None, "u", "x"), (7, "http://a/7", data7()), (7, "http://a/7", data7())]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").selectExpr("*", "1 as row", "2 as archive")
    index = write_archives(pages, new_path(spark, "warc"))
    assert index.count() == 64
    back = read_records(index).collect()
    held = {r.page_id: r.html for r in back if r.record_type == "response"}
    for r in back:
        html = held[r.refers_to] if r.record_type == "revisit" else r.html
        assert r.payload_bytes == len(html.encode()) and r.payload_digest == base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        assert (r.page_id, html) in {(p, h or "") for p, _, h in data}
    assert {r.refers_to for r in back if r.page_id == 100} == {101} and {r.url for r in back if r.page_id == 101} == {"http://b%0D%0AX: y"}
    some = read_records(index.where(F.col("page_id").isin(3, 40, 101))).collect()
    assert sorted(r.page_id for r in some) == [3, 40, 101]
    empty = write_archives(pages.limit(0), new_path(spark, "warc"))
    assert empty.count() == 0 and read_records(empty).count() == 0
    large = write_archives(pages, new_path(spark, "warc"), min_bytes=1000)
    assert large.where("record_type = 'revisit'").count() == 0


def data7():
    return "seven"


def test_each_repeated_row_has_its_record(spark, tmp_path):
    data = [(i % 40, f"http://a/{i % 40}", f"page {i % 13}") for i in range(90)] + [(7, "http://a/7", data7())] * 50 + [(41, None, None)] * 3 + [(42, "http://b", "")]
    spark.createDataFrame(data, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    pages = spark.read.parquet(f"{tmp_path}/pages.parquet")
    got = rows(op5_warc(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    out = con.execute(WARC_SQL)
    names = [d[0] for d in out.description]
    assert got == rows(dict(zip(names, r)) for r in out.fetchall()) and len(got) == len(data)
    index = write_archives(pages, new_path(spark, "warc"), every_row=True)
    assert index.select("file", "offset").distinct().count() == len(data)
    assert write_archives(pages, new_path(spark, "warc")).count() == len({(p, u, h or "") for p, u, h in data})
