"""Retrieval and incremental queries (G)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from scriptorium.operators import retrieve
from scriptorium.plans import derive
from scriptorium.plans import sqltext as q
from scriptorium.plans.registry import query
from scriptorium.session import shared_folder
from scriptorium.streaming import ingest

RAW = "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
DOT = "round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9)"


@query("g01_knn", f"""
SELECT query_id, vec_id, rank::INTEGER AS rank, round(s, 6) AS score FROM (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, {RAW} AS s,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY {DOT} DESC, b.vec_id) AS rank FROM embeddings a, embeddings b) WHERE rank <= 5""")
def g01(t):
    e = t.embeddings.select("vec_id", "embedding")
    return retrieve.knn(e.select(F.col("vec_id").alias("query_id"), "embedding", F.lit(5).alias("k")), e)


@query("g01_knn_by_store", f"""
SELECT query_id, store, vec_id, rank::INTEGER AS rank, round(s, 6) AS score FROM (SELECT a.vec_id AS query_id, a.label::VARCHAR AS store, b.vec_id AS vec_id, {RAW} AS s,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY {DOT} DESC, b.vec_id) AS rank, a.vec_id % 4 + 1 AS k FROM embeddings a JOIN embeddings b USING (label)) WHERE rank <= k""")
def g01b(t):
    e = t.embeddings.select("vec_id", "embedding", F.col("label").cast("string").alias("store"))
    return retrieve.knn(e.select(F.col("vec_id").alias("query_id"), "embedding", "store", (F.col("vec_id") % 4 + 1).alias("k")), e, "store")


STORE = "CASE vec_id % 4 WHEN 0 THEN 'main' WHEN 1 THEN 'figs' WHEN 2 THEN 'sup' ELSE 'lit' END"
PASSES = "(VALUES (0, 'main', 'plan', 6), (1, 'main', 'bullets', 6), (2, 'main', 'combo', 18), (3, 'main', 'intent', 9), (4, 'figs', 'combo', 10), (5, 'sup', 'intent', 10), (6, 'lit', 'plan', 4), (7, 'lit', 'combo', 8)) p(pass_no, store, kind, k)"


@query("g02_retrieve_evidence", f"""
WITH v AS (SELECT vec_id, embedding, {STORE} AS store, 'text ' || (vec_id // 8) AS txt FROM embeddings),
s AS (SELECT vec_id AS slide_uid, unnest(['plan', 'bullets', 'combo', 'intent']) AS kind, embedding FROM embeddings),
h AS (SELECT slide_uid, pass_no, upper(CASE store WHEN 'figs' THEN 'fig' ELSE store END) AS source, b.vec_id, b.txt, k, {RAW} AS s,
  row_number() OVER (PARTITION BY slide_uid, pass_no ORDER BY {DOT} DESC, b.vec_id) AS rank FROM s a JOIN {PASSES} USING (kind) JOIN v b USING (store))
SELECT slide_uid, pass_no, source, vec_id, rank::INTEGER AS rank, round(s, 6) AS score FROM h WHERE rank <= k QUALIFY row_number() OVER (PARTITION BY slide_uid, txt ORDER BY pass_no, rank) = 1""")
def g02(t):
    e = t.embeddings
    store = F.when(F.col("vec_id") % 4 == 0, "main").when(F.col("vec_id") % 4 == 1, "figs").when(F.col("vec_id") % 4 == 2, "sup").otherwise("lit")
    v = e.select("vec_id", "embedding", store.alias("store"), F.concat(F.lit("text "), F.floor(F.col("vec_id") / 8).cast("string")).alias("text"))
    s = e.select(F.col("vec_id").alias("slide_uid"), "embedding", F.explode(F.array(*[F.lit(k) for k in ("plan", "bullets", "combo", "intent")])).alias("kind"))
    return retrieve.retrieve_evidence(s, v, use_sup=True, use_lit=True).drop("text")


@query("g03_ingest", "SELECT doc_id, length(text)::INTEGER AS n, md5(text) AS digest FROM documents")
def g03(t):
    """Documents that arrive in two lots, the second with other texts for some that are known already."""
    base = f"{shared_folder(t.spark)}/ingest-{uuid.uuid4().hex}"
    docs = t.documents.select("doc_id", "text")
    lots = [docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 <> 0").unionByName(docs.filter("doc_id % 6 = 0").withColumn("text", F.lit("again")))]
    for lot in lots:
        lot.write.mode("append").parquet(f"{base}/src")
        ingest.ingest_incremental(t.spark, f"{base}/src", f"{base}/dst", f"{base}/state", "doc_id long, text string", buckets=16,
                                  transform=lambda d: d.withColumn("n", F.length("text"))).awaitTermination()
    return t.spark.read.parquet(f"{base}/dst").select("doc_id", "n", F.md5("text").alias("digest"))


@query("g04_cached_compute", """
SELECT doc_id, length(text)::INTEGER AS n, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'cache' ELSE 'new' END AS origin FROM documents""")
def g04(t):
    d = t.documents.select("doc_id", "text")
    cache = d.join(t.labels.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.length("text").alias("n"), F.lit("cache").alias("origin"))
    return ingest.cached_compute(d, cache, lambda m: m.select("doc_id", F.length("text").alias("n"), F.lit("new").alias("origin")), ["doc_id"])


@query("g05_top_papers", """
SELECT l_partkey AS notion, l_orderkey, l_linenumber, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY CASE WHEN l_returnflag = 'N' THEN 0 ELSE year(l_shipdate) END DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 4""")
def g05(t):
    p = t.lineitem.select(F.col("l_partkey").alias("notion"), "l_orderkey", "l_linenumber",
                          F.when(F.col("l_returnflag") == "N", "UNKNOWN").otherwise(F.year("l_shipdate").cast("string")).alias("year"))
    return retrieve.top_papers(p, tie=["l_orderkey", "l_linenumber"]).drop("year")


@query("g06_natural_order", "SELECT doc_id, source, 'src' || lpad(substring(source, 4), 20, '0') AS key FROM documents")
def g06(t):
    return retrieve.natural_order(t.documents.select("doc_id", "source", retrieve.natural_key("source").alias("key")), "source")


@query("g07_snippet", "SELECT doc_id, left(text, 1000) AS head, right(text, 200) AS tail FROM documents")
def g07(t):
    d = retrieve.snippet(t.documents.select("doc_id", "text"), 1000, "head", out="head")
    return retrieve.snippet(d, 200, "tail", out="tail").drop("text")
