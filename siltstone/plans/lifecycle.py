"""Hypotheses, recommendations, citations and graph search over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import citations, hypotheses, lifecycle, retrieval, search
from siltstone.plans.market import daily, query, table

#: Specs of invalidators: id, op, symbol, denominator, threshold, days, sma_days, window_months, direction, min_count, stance.
_SPECS = """
    (1, 'series_above_threshold', 'click', NULL, 10.0D, 3, NULL, NULL, NULL, NULL, NULL),
    (2, 'series_below_threshold', 'view', NULL, 1000000.0D, 5, NULL, NULL, NULL, NULL, NULL),
    (3, 'ratio_below_sma', 'purchase', 'signup', NULL, 1, 5, NULL, NULL, NULL, NULL),
    (4, 'ratio_below_sma', 'error', 'view', NULL, 2, 40, NULL, NULL, NULL, NULL),
    (5, 'series_change_pct', 'click', NULL, 1.0D, NULL, NULL, 1, 'up', NULL, NULL),
    (6, 'series_change_pct', 'view', NULL, 1.0D, NULL, NULL, 1, 'down', NULL, NULL),
    (7, 'tv_context_count_since', NULL, NULL, NULL, 10, NULL, NULL, NULL, 20, NULL),
    (8, 'tv_context_stance_count_since', NULL, NULL, NULL, 10, NULL, NULL, NULL, 5, 'error'),
    (9, 'manual', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL),
    (10, 'series_above_threshold', 'click', NULL, 10.0D, 0, NULL, NULL, NULL, NULL, NULL)"""
_COLUMNS = "id, op, symbol, denominator, threshold, days, sma_days, window_months, direction, min_count, stance"


@query(f"""
    WITH s({_COLUMNS}) AS (VALUES {_SPECS.replace('0D', '0')}),
    p AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS ts, sum(value) AS value FROM events GROUP BY ALL),
    streak AS (SELECT id, count(*) FILTER (CASE WHEN op = 'series_above_threshold' THEN value > threshold ELSE value < threshold END) = any_value(days) AS fired FROM
        (SELECT s.*, value, row_number() OVER (PARTITION BY id ORDER BY ts DESC) AS back FROM s JOIN p USING (symbol) WHERE op LIKE 'series_%_threshold' AND days > 0) WHERE back <= days GROUP BY id),
    q AS (SELECT s.id, s.days, s.sma_days, a.ts, a.value / b.value AS q FROM s JOIN p a ON a.symbol = s.symbol JOIN p b ON b.symbol = s.denominator AND a.ts = b.ts WHERE op = 'ratio_below_sma' AND b.value <> 0),
    m AS (SELECT x.id, x.ts, x.q, x.days, x.sma_days, (SELECT avg(q) FROM (SELECT q FROM q y WHERE y.id = x.id AND y.ts <= x.ts ORDER BY y.ts DESC LIMIT (5))) AS sma,
        row_number() OVER (PARTITION BY id ORDER BY ts DESC) AS back, count(*) OVER (PARTITION BY id) AS n FROM q x),
    r AS (SELECT id, bool_and(q < sma AND n >= days + sma_days) AS fired FROM m WHERE back <= days GROUP BY id),
    c AS (SELECT id, CASE WHEN direction = 'up' THEN (b - a) / a * 100 >= threshold ELSE (b - a) / a * 100 <= -abs(threshold) END AS fired FROM
        (SELECT id, any_value(direction) AS direction, any_value(threshold) AS threshold, arg_min(value, ts) AS a, arg_max(value, ts) AS b FROM s JOIN p USING (symbol) WHERE op = 'series_change_pct' AND ts >= DATE '2023-12-17' GROUP BY id)),
    v AS (SELECT s.id, count(*) >= any_value(min_count) AS fired FROM s JOIN events e ON s.id = 7 + e.user_id % 2 WHERE op LIKE 'tv_%' AND CAST(e.ts AS DATE) >= DATE '2024-01-30' - days AND (s.stance IS NULL OR s.stance = e.event_type) GROUP BY s.id)
    SELECT s.id, coalesce(f.fired, FALSE) AS fired FROM s LEFT JOIN (SELECT * FROM streak UNION ALL SELECT * FROM r UNION ALL SELECT * FROM c UNION ALL SELECT * FROM v) f ON s.id = f.id WHERE s.id <> 10""")
def invalidators(spark, sf_dir):
    specs = spark.sql(f"SELECT * FROM VALUES {_SPECS} AS s({_COLUMNS})")
    points = daily(spark, sf_dir).select(F.col("event_type").alias("symbol"), F.col("day").alias("ts"), F.col("total").alias("value"))
    contexts = table(spark, sf_dir, "events").select((7 + F.col("user_id") % 2).cast("int").alias("id"), F.to_date("ts").alias("ts"), F.col("event_type").alias("stance"))
    return hypotheses.evaluate(specs, points, contexts, F.lit("2024-01-30").cast("date"))


@query("""
    WITH RECURSIVE h AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 1 THEN p_partkey // 2 END AS parent, CASE WHEN p_size < 5 THEN 'expired' ELSE 'active' END AS status FROM part),
    c AS (SELECT id, 0 AS pass FROM h WHERE status <> 'active' UNION ALL SELECT h.id, pass + 1 FROM h JOIN c ON h.parent = c.id WHERE h.status = 'active' AND pass < 10)
    SELECT id, CASE WHEN status = 'active' AND id IN (SELECT id FROM c) THEN 'cancelled' ELSE status END AS status FROM h""")
def cascade_fixpoint(spark, sf_dir):
    own = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(own.alias("id"), F.when(own > 1, F.floor(own / 2)).alias("parent"), F.lit("active").alias("status"), F.col("p_size").alias("expires"))
    return hypotheses.cascade(hypotheses.expire(rows, "status", "expires", F.lit(5)), "id", "parent", "status").select("id", "status")


@query("""
    SELECT o_orderkey, age_days, status = 'snoozed' AND until < TIMESTAMP '2001-09-01' AS auto_revived, n >= 2 AS forced_decision, age_days > 14 AS aging
    FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'snoozed' WHEN 'P' THEN 'open' ELSE 'acted' END AS status, o_orderdate + INTERVAL (o_custkey % 3000) DAY AS until, o_custkey % 4 AS n,
                 CAST(greatest(floor((epoch(TIMESTAMP '2001-09-01') - epoch(o_orderdate)) / 86400), 0) AS INT) AS age_days FROM orders)""")
def snooze_state(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "O", "snoozed").when(F.col("o_orderstatus") == "P", "open").otherwise("acted")
    until = F.col("o_orderdate") + F.make_dt_interval((F.col("o_custkey") % 3000).cast("int"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("created_at"), status.alias("status"), until.alias("snoozed_until"), (F.col("o_custkey") % 4).alias("snooze_count"))
    state = lifecycle.recommendation_state(rows, F.lit("2001-09-01").cast("timestamp"))
    return state.select("o_orderkey", "age_days", "auto_revived", "forced_decision", "aging")


@query("""
    SELECT event_id FROM events WHERE NOT (CASE event_type WHEN 'click' THEN ts < TIMESTAMP '2024-01-30' - INTERVAL 5 DAY WHEN 'view' THEN ts < TIMESTAMP '2024-01-30' - INTERVAL 12 DAY ELSE FALSE END)""")
def retention_sweep(spark, sf_dir):
    return lifecycle.swept(table(spark, sf_dir, "events"), "event_type", "ts", F.lit("2024-01-30").cast("timestamp"), {"click": 5, "view": 12}).select("event_id")


@query()
def review_queue(spark, sf_dir):
    action = F.when(F.col("event_type") == "error", "dismissed").otherwise("seen")
    ticker = F.concat(F.lit(" t"), F.col("user_id") % 97)
    rows = table(spark, sf_dir, "events").select(ticker.alias("ticker"), F.col("ts").cast("timestamp").alias("ts"), action.alias("action"), F.col("event_type").alias("channel"), "event_id")
    return lifecycle.review_queue(rows, ["event_id"])


@query("""
    WITH f AS (SELECT o_orderkey, h, CASE h WHEN 1 THEN o_totalprice ELSE o_custkey END AS close FROM orders, (VALUES (1), (2)) v(h))
    SELECT o_orderkey, CAST(h AS INT) AS horizon, CAST(close AS DOUBLE) AS close FROM f WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = h)""")
def forecast_explode(spark, sf_dir):
    bar = lambda c: F.struct(F.lit("2024-01-01").alias("ts"), F.col(c).cast("double").alias("close"))
    result = F.to_json(F.struct(F.array(bar("o_totalprice"), bar("o_custkey")).alias("forecast")))
    tasks = table(spark, sf_dir, "orders").select("o_orderkey", result.alias("result"))
    known = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("horizon"))
    return lifecycle.exploded_forecasts(tasks, "o_orderkey", "result", known).drop("ts")


@query("""
    WITH s AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY ALL)
    SELECT year(day) || '-Q' || quarter(day) AS quarter, count(*) AS n_days, CAST(sum(n) AS BIGINT) AS n_rows FROM s
    WHERE date_trunc('quarter', day) = (SELECT date_trunc('quarter', min(day)) FROM s) AND (SELECT count(*) FROM s) > 13 GROUP BY ALL""")
def quarter_rollup(spark, sf_dir):
    days = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    rolled = lifecycle.oldest_quarter(days, "day").where("rolled")
    return rolled.groupBy("quarter").agg(F.count(F.lit(1)).alias("n_days"), F.sum("n").alias("n_rows"))


_WORDS = "list_filter(regexp_split_to_array({}, '[ \t\n\r]+'), lambda x: x <> '')"


@query(f"""
    WITH d AS (SELECT doc_id, text, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
    q AS (SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN array_to_string(w[1:12], '  ') WHEN 1 THEN array_to_string(w[1:6], ' ') || ' ... ' || array_to_string(w[9:14], ' ')
        WHEN 2 THEN array_to_string(w[1:6], ' ') || ' zzz ' || array_to_string(w[9:14], ' ') ELSE w[1] END AS quote FROM d),
    n AS (SELECT doc_id, trim(regexp_replace(lower(coalesce(quote, '')), '\\s+', ' ', 'g')) AS q, trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g')) AS t FROM q),
    p AS (SELECT *, list_filter(regexp_split_to_array(q, '\\s*\\.{{3,}}\\s*'), lambda x: len(trim(x)) > 0) AS p FROM n),
    e AS (SELECT *, instr(t, p[1]) AS e1 FROM p)
    SELECT doc_id, CASE WHEN q = '' THEN 'no_quote' WHEN t = '' THEN 'no_chunk_text' WHEN len(replace(q, ' ', '')) < 12 THEN 'too_short'
        WHEN e1 > 0 AND (len(p) = 1 OR instr(substr(t, e1 + len(p[1])), p[2]) > 0) THEN 'match' ELSE 'not_found' END AS reason FROM e""")
def quote_verify(spark, sf_dir):
    w = F.filter(F.split(F.coalesce("text", F.lit("")), "[ \t\n\r]+"), lambda x: x != "")
    some = lambda a, n, by=" ": F.array_join(F.slice("w", a, n), by)
    kind = F.col("doc_id") % 4
    quote = (
        F.when(kind == 0, some(1, 12, "  ")).when(kind == 1, F.concat(some(1, 6), F.lit(" ... "), some(9, 6)))
        .when(kind == 2, F.concat(some(1, 6), F.lit(" zzz "), some(9, 6))).otherwise(F.get("w", F.lit(0)))
    )
    rows = table(spark, sf_dir, "documents").withColumn("w", w)
    return rows.select("doc_id", citations.quote_status(quote, F.col("text"), loose_ends=True).alias("reason"))


_HREF = 'href="([^"]*)"'


@query(f"""
    WITH e AS (SELECT url AS src, unnest(regexp_extract_all(html, '{_HREF}', 1)) AS dst FROM pages),
    g AS (SELECT DISTINCT src, trim(dst) AS dst FROM e WHERE trim(dst) <> '' AND trim(dst) <> src)
    SELECT dst, count(DISTINCT src) AS n_sources FROM g WHERE dst NOT IN (SELECT url FROM pages WHERE url IS NOT NULL) GROUP BY dst""")
def dead_links(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return citations.dead_links(citations.links(pages, "url", "html", _HREF), pages, "url")


@query("""
    WITH o AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 7 <> 0), n AS (SELECT doc_id, md5(CASE WHEN doc_id % 5 = 0 THEN text || 'x' ELSE text END) AS h FROM documents WHERE doc_id % 11 <> 0)
    SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN n.doc_id IS NULL THEN 'dropped' WHEN o.doc_id IS NULL THEN 'added' WHEN o.h IS NOT DISTINCT FROM n.h THEN 'unchanged' ELSE 'changed' END AS change
    FROM o FULL JOIN n ON o.doc_id = n.doc_id""")
def index_diff(spark, sf_dir):
    """Two states of an index, made from the documents: some are missing on each side, some have another text."""
    docs = table(spark, sf_dir, "documents")
    text = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    old = docs.where("doc_id % 7 <> 0").select("doc_id", F.md5("text").alias("h"))
    new = docs.where("doc_id % 11 <> 0").select("doc_id", F.md5(text).alias("h"))
    return citations.index_changes(old, new, "doc_id", "h")


@query("""
    WITH s AS (SELECT v.vec_id, list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS score FROM embeddings v, embeddings q WHERE q.vec_id = 0),
    n AS (SELECT doc_id AS vec_id, quality AS rank, CASE WHEN quality = 1 THEN toxic + 0.5 END AS central, DATE '2024-01-01' + CAST(doc_id % 60 AS INT) AS day FROM labels)
    SELECT vec_id, round((0.7 + CASE WHEN rank IS NULL THEN 0.2 ELSE 0 END + CASE WHEN central IS NULL THEN 0.1 ELSE 0 END) * score + 0.2 * coalesce(rank, 0) + 0.1 * coalesce(central, 0)
        + CASE WHEN DATE '2024-02-10' - day BETWEEN 0 AND 30 THEN 0.05 ELSE 0 END, 5) AS hybrid_score FROM s LEFT JOIN n USING (vec_id)""")
def hybrid_rerank(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    first = vectors.where("vec_id = 0").select(F.col("embedding").alias("query"))
    results = vectors.join(F.broadcast(first)).select("vec_id", retrieval.cosine(F.col("embedding"), F.col("query")).alias("score"))
    central = F.when(F.col("quality") == 1, F.col("toxic") + 0.5)
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 60).cast("int"))
    nodes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id"), F.col("quality").alias("citation_rank"), central.alias("centrality"), day.alias("published_at"), F.lit(None).cast("date").alias("ingested_at"))
    ranked = search.hybrid_rerank(results, nodes, "vec_id", F.lit("2024-02-10").cast("date"), 10, 0.7, 0.2, 0.1)
    return ranked.select("vec_id", F.round("hybrid_score", 5).alias("hybrid_score"))


@query()
def beam_search(spark, sf_dir):
    """From the nodes nearest to vector 0, over links of each vector to two others."""
    vectors = table(spark, sf_dir, "embeddings")
    count = F.broadcast(vectors.agg(F.count(F.lit(1)).alias("n")))
    edges = vectors.join(count).select(F.col("vec_id").alias("src"), F.explode(F.array((F.col("vec_id") * 3 + 1) % F.col("n"), (F.col("vec_id") * 5 + 2) % F.col("n"))).alias("dst"))
    first = vectors.where("vec_id = 0").select("embedding").first()["embedding"]
    found, rejected = search.beam_search(edges, vectors, "vec_id", "embedding", first, prune=0.0, quality=None)
    return found.withColumn("reason", F.lit(None).cast("string")).unionByName(rejected)


@query(f"""
    WITH d AS (SELECT doc_id, text, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
    q AS (SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN array_to_string(w[1:12], '  ') WHEN 1 THEN array_to_string(w[1:6], ' ') || ' ... ' || array_to_string(w[9:14], ' ')
        WHEN 2 THEN '... ' || array_to_string(w[1:9], ' ') ELSE w[1] END AS quote FROM d),
    n AS (SELECT doc_id, trim(regexp_replace(lower(coalesce(quote, '')), '\\s+', ' ', 'g')) AS q, trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g')) AS t FROM q),
    p AS (SELECT *, list_filter(regexp_split_to_array(q, '\\s*\\.\\.\\.\\s*'), lambda x: len(trim(x)) > 0) AS p FROM n),
    e AS (SELECT *, instr(t, p[1]) AS e1 FROM p)
    SELECT doc_id, CASE WHEN q = '' THEN 'no_quote' WHEN t = '' THEN 'no_chunk_text' WHEN len(replace(q, ' ', '')) < 12 THEN 'too_short'
        WHEN CASE WHEN len(p) > 1 THEN e1 > 0 AND instr(substr(t, e1 + len(p[1])), p[2]) > 0 ELSE instr(t, q) > 0 END THEN 'match' ELSE 'not_found' END AS reason FROM e""")
def quote_check(spark, sf_dir):
    """Quotes cut out of each document: whole, of two parts, with an ellipsis in front, and a single word."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[ \t\n\r]+"), lambda x: x != "")
    rows = table(spark, sf_dir, "documents").withColumn("w", words)
    cut = lambda a, n, by=" ": F.array_join(F.slice("w", a, n), by)
    kind = F.col("doc_id") % 4
    two, open_ = F.concat(cut(1, 6), F.lit(" ... "), cut(9, 6)), F.concat(F.lit("... "), cut(1, 9))
    quote = F.when(kind == 0, cut(1, 12, "  ")).when(kind == 1, two).when(kind == 2, open_).otherwise(F.get("w", F.lit(0)))
    return rows.select("doc_id", citations.quote_status(quote, F.col("text")).alias("reason"))
