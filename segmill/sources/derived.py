"""Tables of segments, pages, labels, pixels and points that are derived from the driver's relational tables by integer
arithmetic, so that any engine derives the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Segments of a document, about, from as many documents on as small tables have.
DOCS, PER_DOC = 20, 3000
PAGE_W, PAGE_H = 1000.0, 800.0
SX, SY, TX, TY = 1.012, 0.993, 4.2, -5.6


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_docs: dict[str, int] = {}


def documents(spark: SparkSession, sf_dir: str) -> int:
    """How many documents the tables are dealt into: they grow with the tables, not the documents' sizes."""
    if sf_dir not in _docs:
        _docs[sf_dir] = max(DOCS, read(spark, sf_dir, "orders").count() // PER_DOC)
    return _docs[sf_dir]


def segments_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = read(spark, sf_dir, "orders").select(
        k.alias("seg_id"), (c % documents(spark, sf_dir)).alias("doc_id"), ((k * 37) % 1000).cast("double").alias("x1"), ((k * 91) % 800).cast("double").alias("y1"), (5 + c % 195).cast("double").alias("n"), (((k % 7) - 3) * F.lit(0.004)).alias("t")
    )
    i = F.col("seg_id")
    x2 = F.when(i % 11 == 0, F.col("x1") + 0.6 * F.col("n")).when(i % 2 == 0, F.col("x1") + F.col("n")).otherwise(F.col("x1") + F.col("n") * F.col("t"))
    y2 = F.when(i % 11 == 0, F.col("y1") + 0.8 * F.col("n")).when(i % 2 == 0, F.col("y1") + F.col("n") * F.col("t")).otherwise(F.col("y1") + F.col("n"))
    return o.select("doc_id", F.lit("pdf").alias("side"), "seg_id", "x1", "y1", x2.alias("x2"), y2.alias("y2"))


def segments_svg(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments_pdf(spark, sf_dir).where("seg_id % 10 <> 0")
    return s.select("doc_id", F.lit("svg").alias("side"), "seg_id", *[(F.col(c) * (SX if c[0] == "x" else SY) + (TX if c[0] == "x" else TY)).alias(c) for c in ("x1", "y1", "x2", "y2")])


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = segments_pdf(spark, sf_dir).select("doc_id").distinct()
    return ids.select("doc_id", F.explode(F.array(F.struct(F.lit("pdf").alias("side"), F.lit(PAGE_W).alias("w"), F.lit(PAGE_H).alias("h")), F.struct(F.lit("svg").alias("side"), F.lit(PAGE_W * SX).alias("w"), F.lit(PAGE_H * SY).alias("h")))).alias("p")).select("doc_id", "p.*")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    ending = F.when(k % 3 == 0, " cm").when(k % 3 == 1, ",5 m").otherwise("")
    return read(spark, sf_dir, "part").select((k % documents(spark, sf_dir)).alias("doc_id"), k.alias("txt_id"), F.concat(F.col("p_size").cast("string"), ending).alias("text"), ((k * 53) % 1000).cast("double").alias("cx"), ((k * 29) % 800).cast("double").alias("cy"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return read(spark, sf_dir, "events").select((e % 5).alias("doc_id"), (F.floor(e / 5) % 40).alias("row"), F.floor(e / 200).alias("col"), F.col("value").alias("val"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding")
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / 2).cast("int") - 1), lambda i: F.struct(i.alias("i"), F.get(v, 2 * i).cast("double").alias("x"), F.get(v, 2 * i + 1).cast("double").alias("y")))
    return read(spark, sf_dir, "embeddings").select("vec_id", F.explode(pairs).alias("p")).select("vec_id", "p.*")


#: The same tables for SQL engines: common table expressions to put before a query.
SQL = """
docs AS (SELECT greatest(20, count(*) // 3000) AS n_docs FROM orders),
pdf0 AS (SELECT o_orderkey AS seg_id, o_custkey % (SELECT n_docs FROM docs) AS doc_id, ((o_orderkey * 37) % 1000)::DOUBLE AS x1, ((o_orderkey * 91) % 800)::DOUBLE AS y1,
  (5 + o_custkey % 195)::DOUBLE AS n, ((o_orderkey % 7) - 3) * 0.004e0 AS t FROM orders),
pdf AS (SELECT doc_id, seg_id, x1, y1,
  CASE WHEN seg_id % 11 = 0 THEN x1 + 0.6e0 * n WHEN seg_id % 2 = 0 THEN x1 + n ELSE x1 + n * t END AS x2,
  CASE WHEN seg_id % 11 = 0 THEN y1 + 0.8e0 * n WHEN seg_id % 2 = 0 THEN y1 + n * t ELSE y1 + n END AS y2 FROM pdf0),
svg AS (SELECT doc_id, seg_id, x1 * 1.012e0 + 4.2e0 AS x1, y1 * 0.993e0 - 5.6e0 AS y1, x2 * 1.012e0 + 4.2e0 AS x2, y2 * 0.993e0 - 5.6e0 AS y2
  FROM pdf WHERE seg_id % 10 <> 0),
both_ AS (SELECT 'pdf' AS side, * FROM pdf UNION ALL SELECT 'svg', * FROM svg),
feat0 AS (SELECT *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS len, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy,
  CASE WHEN x1 = x2 AND y1 = y2 THEN 0e0 ELSE degrees(atan2(y2 - y1, x2 - x1)) END AS raw FROM both_),
feat1 AS (SELECT * EXCLUDE (raw), CASE WHEN raw < 0 THEN raw + 180 WHEN raw >= 180 THEN raw - 180 ELSE raw END AS ang FROM feat0),
feat AS (SELECT *, CASE WHEN least(ang, 180 - ang) <= 2 AND least(ang, 180 - ang) <= abs(ang - 90) THEN 'H' WHEN abs(ang - 90) <= 2 THEN 'V' END AS axis FROM feat1),
fp AS (SELECT * FROM feat WHERE side = 'pdf'),
fs AS (SELECT * FROM feat WHERE side = 'svg'),
labels_geo AS (SELECT p_partkey % (SELECT n_docs FROM docs) AS doc_id, p_partkey AS txt_id, p_size::VARCHAR || CASE p_partkey % 3 WHEN 0 THEN ' cm' WHEN 1 THEN ',5 m' ELSE '' END AS text,
  ((p_partkey * 53) % 1000)::DOUBLE AS cx, ((p_partkey * 29) % 800)::DOUBLE AS cy FROM part),
pixels AS (SELECT event_id % 5 AS doc_id, (event_id // 5) % 40 AS row, event_id // 200 AS col, value AS val FROM events),
points AS (SELECT vec_id, i, embedding[2 * i + 1]::DOUBLE AS x, embedding[2 * i + 2]::DOUBLE AS y FROM (SELECT vec_id, embedding, unnest(range(len(embedding) // 2)) AS i FROM embeddings))
"""
