"""Line dedup: which lines of each document stay, as compressed bitmaps; DataFrame functions only.

Each line is 128 bits of hash, its document and its place. These rows are dealt by range of hash with a secondary sort by document and position, and
a window streams the first occurrence of each hash and the number of its documents. Texts take no part: they are met again only by who applies the bitmaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save

WHITE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A hash with this share of the lines is hot: at most 1 / HOT hashes are.
HOT, HOT_SAMPLE = 1e-3, 0.02


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """h1, h2, doc_id, uid and pos of each line whose key has min_chars code points."""
    rows = docs.select("doc_id", "uid", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line")).where(F.length("line") >= min_chars)
    rows = rows.select("doc_id", "uid", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return rows.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), F.reverse("key")).alias("h2"), "doc_id", "uid", "pos")


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """For each document that loses lines: doc_id, uid, n_dropped and dropped, an array of (word, bits): bit b of word w stands for line 64 * w + b, and words
    without a bit are left out, as are documents that keep all lines.

    A key of at least min_chars code points in at least min_docs documents loses its lines but for those in the largest doc_id that holds it. docs needs
    doc_id, text and uid, which tells rows of one doc_id apart; rows that repeat a doc_id count as one document, and rows equal in both have one bitmap. Null
    texts are one empty line; of a null doc_id no line goes.

    A window keeps a hash in one task, which a very common line would fill. A sample of the lines names the hashes that may be so common (it decides
    nothing else); their documents are counted by partial aggregation, and their lines meet the few counts by broadcast."""
    rows = save(lines(docs, min_chars).where("doc_id is not null"), "lines")
    hashes = ["h1", "h2"]
    some = rows.sample(HOT_SAMPLE, 7)
    n = some.count()
    hot = some.groupBy(*hashes).agg(F.count("*").alias("n")).where(F.col("n") >= max(200, n * HOT)).select(*hashes)
    hot = F.broadcast(save(hot, "hot-lines"))  # at most 1 / HOT rows

    counts = rows.join(hot, hashes).groupBy(*hashes).agg(F.count_distinct("doc_id").alias("docs"), F.max("doc_id").alias("last"))
    common = rows.join(F.broadcast(counts), hashes)

    dealt = rows.join(hot, hashes, "left_anti").repartitionByRange(*hashes)
    down = Window.partitionBy(*hashes).orderBy(F.desc("doc_id"), "pos")
    streamed = dealt.withColumn("last", F.first("doc_id").over(down)).withColumn("rank", F.dense_rank().over(Window.partitionBy(*hashes).orderBy(F.desc("doc_id"))))
    streamed = streamed.withColumn("docs", F.max("rank").over(Window.partitionBy(*hashes)))

    gone = streamed.select("uid", "pos", "doc_id", "docs", "last").union(common.select("uid", "pos", "doc_id", "docs", "last"))
    gone = gone.where((F.col("docs") >= min_docs) & (F.col("doc_id") != F.col("last")))
    words = gone.repartition("doc_id", "uid").groupBy("doc_id", "uid", F.expr("pos div 64").cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, pos % 64))").alias("bits"))
    return words.groupBy("doc_id", "uid").agg(F.sum(F.bit_count("bits")).alias("n_dropped"), F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("dropped"))


def drop_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, counts: bool = True) -> DataFrame:
    """docs with text less the lines that keep_bitmaps() drops, and, with counts, n_lines (before) and n_dropped, which replace columns of these names. Null
    texts become empty; other columns stay, and rows that repeat stay as often as they were there."""
    names = [c for c in docs.columns if not counts or c.lower() not in ("n_lines", "n_dropped")]
    docs = docs.select(F.struct(*names).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("uid"))
    maps = keep_bitmaps(docs.select("doc_id", "text", "uid"), min_chars, min_docs)
    # texts of one doc_id alone could share a uid, so no number of rows makes that likely
    both = docs.join(maps, ["doc_id", "uid"], "left").withColumn("parts", F.split(F.coalesce("text", F.lit("")), "\n", -1)).withColumn("bits", F.map_from_entries("dropped"))
    stays = F.array_join(F.filter("parts", lambda x, i: F.getbit(F.coalesce(F.try_element_at("bits", F.floor(i / 64).cast("int")), F.lit(0).cast("long")), i % 64) == 0), "\n")
    kept = F.when(F.col("dropped").isNull(), F.coalesce("text", F.lit(""))).otherwise(stays)
    out = [kept.alias(c) if c.lower() == "text" else F.col(f"row.`{c}`").alias(c) for c in names]
    return both.select(*out, *([F.size("parts").cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped")] if counts else []))


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    """drop_lines over all documents; nulls, empties, ties and repeated rows as there."""
    out = drop_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_TRIM = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LINE_DEDUP_SQL = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
placed AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM split),
keyed AS (SELECT *, translate(trim(line, {_TRIM}), '{UPPER}', '{LOWER}') AS line_key FROM placed),
common AS (SELECT line_key, max(doc_id) AS last FROM keyed WHERE length(line_key) >= 40 GROUP BY line_key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT k.*, c.last IS NOT NULL AND c.last <> k.doc_id AS gone FROM keyed k LEFT JOIN common c USING (line_key))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
