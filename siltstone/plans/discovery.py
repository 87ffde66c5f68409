"""Vector index, names and stems over the driver's tables, with their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import text
from siltstone.operators import names, pages, search, stemmed, vector_index
from siltstone.plans import documents
from siltstone.plans.market import query, table

_COS = "list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"


def _hundredth(vectors):
    return vectors.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@query(f"""
    SELECT q.vec_id AS query_id, v.vec_id AS id, round({_COS}, 5) AS similarity, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, v.vec_id) AS INT) AS place
    FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id QUALIFY place <= 10""")
def vector_index_topk(spark, sf_dir):
    """The index's exact form: lists that can't hold anything nearer are left out by their reach."""
    vectors = table(spark, sf_dir, "embeddings")
    index = vector_index.build(vectors, "vec_id", "embedding")
    return vector_index.search(index, _hundredth(vectors), 10, exact=True, exclude_self=True).withColumn("similarity", F.round("similarity", 5))


@query(f"""
    WITH hits AS (
        SELECT q.vec_id AS query_id, v.vec_id AS id, v.label, {_COS} AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, v.vec_id) AS r
        FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0 QUALIFY r <= 96)
    SELECT query_id, id, round(s, 5) AS similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY r) AS INT) AS place
    FROM hits WHERE label % 2 = 1 QUALIFY place <= 5""")
def vector_filtered_topk(spark, sf_dir):
    """Hits beyond k, of which those with an allowed label are kept."""
    vectors = table(spark, sf_dir, "embeddings")
    index = vector_index.build(vectors, "vec_id", "embedding")
    hits = vector_index.search(index, _hundredth(vectors), vector_index.overfetch(5, anchored=True), exact=True)
    kept = vector_index.filtered(hits, vectors.select("vec_id", "label"), "vec_id", F.col("label") % 2 == 1, 5)
    return kept.select("query_id", "id", F.round("similarity", 5).alias("similarity"), "place")


#: Two vectors are a note; three notes in a row are one series, of which each has a day.
_NODE = "printf('2024-01-%02d-topic-%d', 1 + (vec_id // 2) % 3, vec_id // 6)"


def _chunks(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    note = F.floor(F.col("vec_id") / 2)
    name = F.format_string("2024-01-%02d-topic-%d", (1 + note % 3).cast("int"), F.floor(F.col("vec_id") / 6).cast("int"))
    return vectors.select("vec_id", name.alias("node"), (F.col("vec_id") % 2).alias("ord"), "embedding")


@query(f"""
    WITH c AS (SELECT vec_id, {_NODE} AS node, vec_id % 2 AS ord, embedding FROM embeddings),
    q AS (SELECT * FROM c WHERE ord = 0 AND vec_id % 100 = 0),
    hits AS (SELECT q.node, v.node AS other, {_COS} AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, v.vec_id) AS r FROM c v, q QUALIFY r <= 48),
    nodes AS (SELECT node, other, max(s) AS s, row_number() OVER (PARTITION BY node ORDER BY min(r)) AS place FROM hits WHERE node <> other GROUP BY node, other QUALIFY place <= 6)
    SELECT node, other, round(s, 5) AS similarity, CAST(row_number() OVER (PARTITION BY node ORDER BY place) AS INT) AS place
    FROM nodes WHERE s >= 0.3 AND node[12:] <> other[12:] QUALIFY row_number() OVER (PARTITION BY node ORDER BY place) <= 3""")
def cross_links(spark, sf_dir):
    """Links to suggest for every hundredth note, from its first chunk; other days of its own series don't count."""
    similar = vector_index.similar_nodes(_chunks(spark, sf_dir), "node", "ord", "vec_id", "embedding", 6, asked=lambda n: n.where(F.col("vec_id") % 100 == 0), exact=True)
    return vector_index.cross_links(similar, "node", text.temporal_pair, floor=0.3).withColumn("similarity", F.round("similarity", 5))


#: A given table of stems, and a question that meets its stems.
_STEMS = "('the', 'the'), ('them', 'the'), ('ing', 'ing'), ('ings', 'ing'), ('tion', 'tion'), ('tions', 'tion'), ('eau', 'eau'), ('eaux', 'eau'), ('ciones', 'cion'), ('cion', 'cion'), ('que', 'que'), ('keit', 'keit'), ('keiten', 'keit')"
_QUESTION = ("The", "tions", "eau", "cion", "keit", "missing")


@query(f"""
    WITH s(word, stem) AS (VALUES {_STEMS}),
    d AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
    n AS (SELECT count(*) AS n_docs, sum(len(w)) AS total FROM d),
    t AS (SELECT doc_id, len(w) AS length, stem, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS word FROM d) JOIN s USING (word) WHERE stem IN ('the', 'tion', 'eau', 'cion', 'keit', 'miss') GROUP BY ALL),
    f AS (SELECT stem, count(*) AS df FROM t GROUP BY stem)
    SELECT doc_id, round(sum(greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / (total / n_docs)))), 5) AS score
    FROM t JOIN f USING (stem), n GROUP BY doc_id""")
def bm25_given_stems(spark, sf_dir):
    stems = spark.sql(f"SELECT * FROM VALUES {_STEMS} AS s(word, stem)")
    return stemmed.bm25_stems(table(spark, sf_dir, "documents"), "doc_id", "text", _QUESTION, stems).withColumn("score", F.round("score", 5))


@query()
def bm25_stems_topk(spark, sf_dir):
    """Stems of the documents' own words; the tests work it out anew."""
    scored = stemmed.bm25_stems(table(spark, sf_dir, "documents"), "doc_id", "text", _QUESTION)
    return scored.orderBy(F.desc(F.round("score", 5)), "doc_id").limit(20).withColumn("score", F.round("score", 5))


@query()
def near_duplicate_names(spark, sf_dir):
    """Targets of the pages' links that look like one another; the tests compare all with all."""
    targets = table(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), 1)).alias("name"))
    return names.near_duplicates(targets, "name", 0.85)


_PLACE_DAY = "DATE '2024-01-01' + CAST(n_chars % 400 AS INT)"


@query(f"""
    WITH {documents._bm25_sql()},
    n AS (SELECT doc_id AS node, lang AS kind, source, {_PLACE_DAY} AS published, doc_id % 50 = 0 AS evergreen FROM documents WHERE lang IN ('en', 'de', 'fr') AND {_PLACE_DAY} >= DATE '2024-02-01'),
    h AS (SELECT v.vec_id AS node, {_COS} AS s FROM embeddings v, embeddings q WHERE q.vec_id = 100 ORDER BY s DESC, node LIMIT 160),
    pool AS (SELECT * FROM h JOIN n USING (node)),
    w1 AS (SELECT node, CASE WHEN evergreen OR source IS NULL THEN 1 WHEN kind = 'de' THEN CASE r WHEN 1 THEN 1 WHEN 2 THEN 0.5 ELSE 0 END WHEN r <= 5 THEN ([1.0, 0.6, 0.45, 0.35, 0.25])[r] ELSE 0.2 END::DOUBLE AS w
           FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY published DESC, node DESC) AS r FROM pool)),
    v AS (SELECT node, s, row_number() OVER (ORDER BY s * w DESC, node) - 1 AS r FROM pool JOIN w1 USING (node) WHERE w > 0),
    lex AS (SELECT doc_id AS node, score, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) - 1 AS r FROM bm JOIN n ON n.node = doc_id QUALIFY r < 40),
    every AS (SELECT node, kind, source, published, evergreen FROM pool UNION SELECT n.* FROM n JOIN lex USING (node)),
    w2 AS (SELECT node, CASE WHEN evergreen OR source IS NULL THEN 1 WHEN kind = 'de' THEN CASE r WHEN 1 THEN 1 WHEN 2 THEN 0.5 ELSE 0 END WHEN r <= 5 THEN ([1.0, 0.6, 0.45, 0.35, 0.25])[r] ELSE 0.2 END::DOUBLE AS w
           FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY published DESC, node DESC) AS r FROM every)),
    m AS (SELECT node, coalesce(v.s, 1 / (1 + abs(lex.score))) AS sim, v.r IS NULL AS lexical_only, round(coalesce(1.0::DOUBLE / (60 + v.r), 0) + coalesce(0.5::DOUBLE / (60 + lex.r), 0), 12) AS rrf FROM v FULL JOIN lex USING (node))
    SELECT node, 0 AS ord, round(sim, 5) AS similarity, w AS decay_weight, round(sim * w, 5) AS score, lexical_only, CAST(row_number() OVER (ORDER BY lexical_only, rrf DESC, node) AS INT) AS place
    FROM m JOIN w2 USING (node) WHERE w > 0 QUALIFY place <= 10""")
def search_hybrid(spark, sf_dir):
    """A question of words and a vector over all documents and vectors, with anchors, both legs, their fusion and decay."""
    docs, vectors = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    published = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("n_chars") % 400).cast("int"))
    nodes = docs.select(F.col("doc_id").alias("node"), F.col("lang").alias("kind"), "source", published.alias("published"), (F.col("doc_id") % 50 == 0).alias("evergreen"))
    chunks = docs.select(F.col("doc_id").alias("node"), F.lit(0).alias("ord"), "text")
    asked = vectors.where("vec_id = 100").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    k = 10
    hits = vector_index.search(vector_index.build(vectors, "vec_id", "embedding"), asked, vector_index.overfetch(k, anchored=True), exact=True)
    hits = hits.select(F.col("id").alias("node"), F.lit(0).alias("ord"), "similarity")
    allowed = F.col("kind").isin("en", "de", "fr") & (F.col("published") >= F.lit("2024-02-01").cast("date"))
    how = {"group": "source", "newest": [F.desc("published"), F.desc("node")], "kind": "kind", "evergreen": F.col("evergreen"), "floor": 0.2, "overrides": {"de": ((1.0, 0.5), 0.0)}}
    got = search.composed(chunks, nodes, hits, documents._TERMS, ["text"], k, allowed, **how)
    return got.withColumns({c: F.round(c, 5) for c in ("similarity", "score")})


@query()
def page_texts(spark, sf_dir):
    """Title, shown text and link targets of every page; the tests read the pages in another way."""
    return pages.page_text(table(spark, sf_dir, "pages"), "page_id", "html")
