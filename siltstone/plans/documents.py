"""Retrieval, text and graph queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import graph, retrieval, timeseries
from siltstone.plans.market import query, table

_TERMS = ["license", "reserved", "the", "retion"]
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _bm25_sql() -> str:
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(_TERMS))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(_TERMS)))
    score = " + ".join(f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / av))" for i in range(len(_TERMS)))
    return f"""bm AS (
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOW}, '[^a-z0-9]+'), lambda x: len(x) >= 2) AS t FROM documents),
        r AS (SELECT doc_id, len(t) AS dl, {tf} FROM d), s AS (SELECT count(*) AS n, avg(dl) AS av, {df} FROM r)
        SELECT doc_id, {score} AS score FROM r, s WHERE {" OR ".join(f"tf{i} > 0" for i in range(len(_TERMS)))})"""


def _top(df, score, tie, k):
    """The k best rows with place from 0: a top-k report."""
    best = df.orderBy(F.desc(score), tie).limit(k)
    return best.withColumn("place", F.row_number().over(timeseries.Window.partitionBy(F.lit(0)).orderBy(F.desc(score), tie)) - 1)


def _lexical(spark, sf_dir):
    return retrieval.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", _TERMS).withColumn("score", F.round("score", 5))


def _near(spark, sf_dir, first, last, k, exclude_self=False):
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.where(F.col("vec_id").between(first, last)).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return retrieval.knn(vectors, "vec_id", "embedding", queries, k, exclude_self)


_COS = "list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"


@query(f"WITH {_bm25_sql()} SELECT doc_id, round(score, 5) AS score FROM bm ORDER BY round(score, 5) DESC, doc_id LIMIT 20")
def bm25_topk(spark, sf_dir):
    return _top(_lexical(spark, sf_dir), "score", "doc_id", 20).drop("place")


@query(f"""
    SELECT q.vec_id AS query_id, v.vec_id, round({_COS}, 5) AS similarity, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, v.vec_id) AS INT) AS place
    FROM embeddings v, embeddings q WHERE q.vec_id BETWEEN 0 AND 9 QUALIFY place <= 5""")
def knn_topk(spark, sf_dir):
    return _near(spark, sf_dir, 0, 9, 5).withColumn("similarity", F.round("similarity", 5))


@query(f"""
    SELECT q.vec_id AS query_id, v.vec_id, round({_COS}, 5) AS similarity, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, v.vec_id) AS INT) AS place
    FROM embeddings v, embeddings q WHERE q.vec_id BETWEEN 20 AND 24 AND q.vec_id <> v.vec_id QUALIFY place <= 3""")
def similar_to_node(spark, sf_dir):
    return _near(spark, sf_dir, 20, 24, 3, exclude_self=True).withColumn("similarity", F.round("similarity", 5))


def _near_hundredth(spark, sf_dir, k, exclude_self=False):
    """Every vector whose id is divisible by 100 as a query, against all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return retrieval.knn(vectors, "vec_id", "embedding", queries, k, exclude_self).withColumn("similarity", F.round("similarity", 5))


def _near_hundredth_sql(k, others="TRUE"):
    return f"""
    SELECT q.vec_id AS query_id, v.vec_id, round({_COS}, 5) AS similarity, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, v.vec_id) AS INT) AS place
    FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0 AND {others} QUALIFY place <= {k}"""


@query(_near_hundredth_sql(5))
def knn_topk_hundredth(spark, sf_dir):
    return _near_hundredth(spark, sf_dir, 5)


@query(_near_hundredth_sql(3, "q.vec_id <> v.vec_id"))
def similar_to_node_hundredth(spark, sf_dir):
    return _near_hundredth(spark, sf_dir, 3, exclude_self=True)


@query("""
    WITH p AS (SELECT label, vec_id % 2 AS half, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
    c AS (SELECT label, half, i, avg(CAST(x AS DOUBLE)) AS x FROM p GROUP BY ALL),
    v AS (SELECT label, half, list(x ORDER BY i) AS c FROM c GROUP BY ALL)
    SELECT a.label, round(1 - list_cosine_similarity(a.c, b.c), 5) AS shift, 1 - list_cosine_similarity(a.c, b.c) > 0.15 AS moved FROM v a JOIN v b ON a.label = b.label WHERE a.half = 0 AND b.half = 1""")
def centroid_shift(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").withColumn("half", F.col("vec_id") % 2)
    c = retrieval.centroids(vectors, ["label", "half"], "embedding")
    both = c.where("half = 0").select("label", F.col("centroid").alias("a")).join(c.where("half = 1").select("label", F.col("centroid").alias("b")), "label")
    shift = 1 - retrieval.cosine(F.col("a"), F.col("b"))
    return both.select("label", F.round(shift, 5).alias("shift"), (shift > 0.15).alias("moved"))


@query(f"""
    WITH {_bm25_sql()}, lex AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 5) DESC, doc_id) - 1 AS r FROM bm QUALIFY r < 50),
    vec AS (SELECT v.vec_id AS doc_id, row_number() OVER (ORDER BY {_COS} DESC, v.vec_id) - 1 AS r FROM embeddings v, embeddings q WHERE q.vec_id = 0 QUALIFY r < 50)
    SELECT coalesce(lex.doc_id, vec.doc_id) AS doc_id, round(coalesce(1 / (60 + vec.r), 0) + coalesce(0.5 / (60 + lex.r), 0), 7) AS score FROM lex FULL JOIN vec ON lex.doc_id = vec.doc_id""")
def rrf_fusion(spark, sf_dir):
    lexical = _top(_lexical(spark, sf_dir), "score", "doc_id", 50)
    vector = _near(spark, sf_dir, 0, 0, 50).select(F.col("vec_id").alias("doc_id"), (F.col("place") - 1).alias("place"))
    return retrieval.rank_fusion([(vector, 1.0), (lexical, 0.5)], "doc_id", "place").withColumn("score", F.round("score", 7))


@query("""
    SELECT doc_id, source, CAST(r AS INT) AS place, CASE WHEN source IS NULL THEN 1.0 ELSE [1.0, 0.6, 0.45, 0.35, 0.25][least(r, 4) + 1] END::DOUBLE AS weight
    FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC NULLS LAST, doc_id DESC) - 1 AS r FROM documents)""")
def decay_ladder(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return retrieval.ladder_decay(docs, "source", [F.desc_nulls_last("n_chars"), F.desc("doc_id")]).drop("n_chars")


@query("""
    WITH e AS (SELECT doc_id, n_chars FROM documents WHERE lang = 'en' AND n_chars >= 500), s AS (SELECT doc_id FROM e ORDER BY n_chars DESC, doc_id LIMIT 20)
    SELECT doc_id, CASE WHEN n_chars < 1000 THEN 'short' ELSE 'below_top_k' END AS reason FROM e WHERE doc_id NOT IN (SELECT doc_id FROM s)""")
def drop_audit(spark, sf_dir):
    eligible = table(spark, sf_dir, "documents").where("lang = 'en' and n_chars >= 500").select("doc_id", "n_chars")
    surfaced = eligible.orderBy(F.desc("n_chars"), "doc_id").limit(20)
    return retrieval.drop_audit(eligible, surfaced, "doc_id", F.when(F.col("n_chars") < 1000, "short").otherwise("below_top_k"))


@query("""
    WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda x: x <> '') AS w FROM documents),
    c AS (SELECT doc_id, w, unnest(range(0, CAST(ceil(greatest(len(w) - 600, 0) / 520) AS BIGINT) + 1)) AS ord FROM w WHERE len(w) > 0)
    SELECT doc_id, CAST(ord AS INT) AS ord, CAST(len(w[ord * 520 + 1 : ord * 520 + 600]) AS INT) AS n_words, md5(array_to_string(w[ord * 520 + 1 : ord * 520 + 600], ' ')) AS digest FROM c""")
def chunk_sliding(spark, sf_dir):
    return retrieval.sliding_chunks(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "ord", "n_words", F.md5("chunk").alias("digest"))


@query("""
    WITH l AS (SELECT DISTINCT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents)
    SELECT md5(line) AS digest, count(*) AS n_docs FROM l WHERE len(line) >= 20 GROUP BY line HAVING count(*) >= 3""")
def boilerplate_lines(spark, sf_dir):
    return retrieval.recurring_lines(table(spark, sf_dir, "documents"), "doc_id", "text", 3).select(F.md5("line").alias("digest"), "n_docs")


@query("""
    WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[^A-Za-z0-9_]+'), lambda x: regexp_full_match(x, '[A-Z]{2,5}') AND x NOT IN ('CEO', 'USD', 'THE')) AS t FROM documents),
    u AS (SELECT doc_id, t[i] AS w, i FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM t)), f AS (SELECT doc_id, w, min(i) AS i FROM u GROUP BY ALL)
    SELECT doc_id, string_agg(w, ',' ORDER BY i) AS tickers FROM f GROUP BY doc_id""")
def ticker_extract(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", retrieval.ticker_tokens(F.col("text"), ["CEO", "USD", "THE"]).alias("t"))
    return found.where(F.size("t") > 0).select("doc_id", F.array_join("t", ",").alias("tickers"))


@query("""
    SELECT conv_id, turn, role FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, text) AS old FROM conversations) WHERE old IS DISTINCT FROM role OR old IS NULL""")
def consecutive_collapse(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return timeseries.collapse_repeats(turns, ["conv_id"], ["turn", F.asc_nulls_last("text")], "role").select("conv_id", "turn", "role")


@query("""
    SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS n_links FROM pages""")
def page_links(spark, sf_dir):
    links = F.size(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), links.alias("n_links"))


@query("""
    WITH p AS (SELECT url, string_split(url, '/') AS p FROM pages), f AS (SELECT url, p, unnest(range(1, len(p))) AS depth FROM p)
    SELECT array_to_string(p[1:depth], '/') AS folder, CAST(depth AS INT) AS depth, count(*) AS n FROM f GROUP BY ALL""")
def ancestor_folders(spark, sf_dir):
    return graph.ancestors(table(spark, sf_dir, "pages"), "url").groupBy("folder", "depth").agg(F.count(F.lit(1)).alias("n"))


def _sold(spark, sf_dir):
    """Suppliers to the parts that they have sold, an edge for each line."""
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"))


def _edges(spark, sf_dir):
    """Suppliers to the parts that they have sold, by the number of lines."""
    sold = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("weight"))
    return sold.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), "weight")


_EDGES = "edges AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, count(*) AS weight FROM lineitem GROUP BY ALL)"


def _pagerank_sql(rounds: int) -> str:
    steps = "".join(
        f""", r{k} AS (SELECT node, 0.15 / (SELECT count(*) FROM nodes) + 0.85 * (coalesce((SELECT sum(share * rank) FROM share JOIN r{k - 1} r ON share.src = r.node WHERE share.dst = nodes.node), 0)
            + (SELECT coalesce(sum(rank), 0) FROM r{k - 1} WHERE node NOT IN (SELECT src FROM edges)) / (SELECT count(*) FROM nodes)) AS rank FROM nodes)"""
        for k in range(1, rounds + 1)
    )
    return f"""WITH {_EDGES}, nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges),
        share AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM edges),
        r0 AS (SELECT node, 1 / (SELECT count(*) FROM nodes) AS rank FROM nodes){steps}
        SELECT node, round(rank, 8) AS rank FROM r{rounds}"""


@query(_pagerank_sql(3))
def pagerank(spark, sf_dir):
    return graph.pagerank(_edges(spark, sf_dir), 3).withColumn("rank", F.round("rank", 8))


@query(f"""
    WITH {_EDGES}, way AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), h1 AS (SELECT DISTINCT dst AS node FROM way WHERE src = 's1'),
    h2 AS (SELECT DISTINCT dst AS node FROM way JOIN h1 ON src = node WHERE dst <> 's1' AND dst NOT IN (SELECT node FROM h1))
    SELECT 's1' AS node, 0 AS hops UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2""")
def neighbourhood(spark, sf_dir):
    start = spark.range(1).select(F.lit("s1").alias("node"))
    return graph.neighbourhood(_sold(spark, sf_dir), start, 2)
