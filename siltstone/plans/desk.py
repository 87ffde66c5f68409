"""Queries of the research desk over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import rules
from siltstone.operators import desk, notes, retrieval
from siltstone.plans import documents
from siltstone.plans.market import _DAILY, daily, query, table


def _now(text: str):
    return F.lit(text).cast("timestamp")


@query("""
    SELECT l.event_id, r.event_id AS item_id, l.user_id FROM events l JOIN events r ON l.user_id = r.user_id
    WHERE l.event_type = 'purchase' AND r.event_type = 'view' AND r.ts BETWEEN l.ts - INTERVAL 24 HOUR AND l.ts + INTERVAL 24 HOUR""")
def band_join(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", F.col("ts").alias("entry_at"))
    right = e.where("event_type = 'view'").select(F.col("event_id").alias("item_id"), "user_id", "ts")
    return desk.band_join(left, right, ["user_id"], "entry_at", "ts", 86_400).select("event_id", "item_id", "user_id")


@query("""
    SELECT t.event_id AS trade_id, i.event_id AS item_id, t.value - 100 AS pnl, t.value > 100 AS win FROM events t JOIN events i ON t.user_id = i.user_id
    WHERE t.event_type = 'purchase' AND t.event_id % 2 = 0 AND i.event_type = 'click' AND (t.event_id + i.event_id) % 5 <> 0
      AND i.ts BETWEEN t.ts - INTERVAL 24 HOUR AND t.ts + INTERVAL 24 HOUR""")
def trade_close_links(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    trades = e.where("event_type = 'purchase'").select(
        F.col("event_id").alias("trade_id"), F.col("user_id").alias("ticker"), F.col("ts").alias("entry_at"),
        F.when(F.col("event_id") % 2 == 0, F.col("ts")).alias("exit_at"), (F.col("value") - 100).alias("pnl"),
    )
    items = e.where("event_type = 'click'").select(F.col("event_id").alias("item_id"), F.col("user_id").alias("ticker"), F.col("ts").alias("captured_at"))
    linked = desk.band_join(trades, items, ["ticker"], "entry_at", "captured_at", 86_400).where((F.col("trade_id") + F.col("item_id")) % 5 == 0)
    return desk.close_links(trades, items, linked).drop("closed_at")


@query("""
    WITH q AS (SELECT unnest([o_custkey % 50, o_custkey % 70]) AS hypothesis, o_orderstatus AS s FROM orders WHERE o_orderstatus IN ('F', 'O')),
    g AS (SELECT hypothesis, count(*) AS n, avg(CASE WHEN s = 'F' THEN 1 ELSE 0 END) AS rate FROM q GROUP BY ALL)
    SELECT c_custkey AS hypothesis, coalesce(n, 0) AS n, round(coalesce(rate, 0), 5) AS rate FROM customer LEFT JOIN g ON hypothesis = c_custkey""")
def dismiss_rates(spark, sf_dir):
    wanted = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("hypothesis"))
    asked = table(spark, sf_dir, "orders").withColumn("ids", F.array(F.col("o_custkey") % 50, F.col("o_custkey") % 70))
    got = desk.member_rates(wanted, "hypothesis", asked, "ids", F.col("o_orderstatus") == "F", F.col("o_orderstatus").isin("F", "O"))
    return got.withColumn("rate", F.round("rate", 5))


@query("""
    WITH d AS (SELECT doc_id FROM documents), n AS (SELECT 'src/n' || doc_id || '.md' AS path FROM d WHERE doc_id % 2 = 0 UNION ALL SELECT 'alt/N' || doc_id || '.md' FROM d WHERE doc_id % 10 = 0),
    e AS (SELECT doc_id AS src, CASE doc_id % 4 WHEN 0 THEN 'src/n' || (doc_id + 2) || '.md' WHEN 1 THEN 'src/n' || (doc_id + 1) WHEN 2 THEN 'n' || (doc_id + 2) ELSE 'n' || doc_id END AS dst FROM d)
    SELECT src, dst, coalesce((SELECT min(path) FROM n WHERE path = dst), (SELECT min(path) FROM n WHERE path = dst || '.md'),
        (SELECT min(path) FROM n WHERE lower(split_part(path, '/', 2)) = lower(CASE WHEN dst LIKE '%/%' THEN split_part(replace(dst, '.md', ''), '/', 2) ELSE dst END) || '.md')) AS path FROM e""")
def wikilink_resolve(spark, sf_dir):
    d, i = table(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id")

    def path(head, n, tail=".md"):
        return F.concat(F.lit(head), n.cast("string"), F.lit(tail))

    nodes = d.where(i % 2 == 0).select(path("src/n", i).alias("path")).unionByName(d.where(i % 10 == 0).select(path("alt/N", i).alias("path")))
    dst = F.when(i % 4 == 0, path("src/n", i + 2)).when(i % 4 == 1, path("src/n", i + 1, "")).when(i % 4 == 2, path("n", i + 2, "")).otherwise(path("n", i, ""))
    return desk.resolve_links(d.select(i.alias("src"), dst.alias("dst")), nodes)


@query("""
    WITH p AS (SELECT source || '/' || lang || '/' || doc_id || '.md' AS path, source, lang FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL)
    SELECT '_index.md' AS context, 0 AS depth, path FROM p
    UNION ALL SELECT source || '/' || lang || '/_index.md', 2, path FROM p WHERE lang = 'en'""")
def folder_contexts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("source is not null and lang is not null")
    paths = docs.select(F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"))
    notes = docs.where("lang = 'en'").select(F.concat_ws("/", "source", "lang", F.lit("_index.md")).alias("path")).distinct()
    nodes = notes.unionByName(spark.range(1).select(F.lit("_index.md").alias("path"))).withColumn("kind", F.lit("folder_context"))
    return desk.folder_contexts(paths, nodes)


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def zero_filled_counts(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return desk.counts_for(table(spark, sf_dir, "customer"), orders, "c_custkey")


@query("SELECT event_id AS ordinal, user_id * 7 AS c_custkey, c_name, c_acctbal FROM events LEFT JOIN customer ON c_custkey = user_id * 7")
def bulk_lookup(spark, sf_dir):
    wanted = table(spark, sf_dir, "events").select(F.col("event_id").alias("ordinal"), (F.col("user_id") * 7).alias("c_custkey"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast(wanted.schema["c_custkey"].dataType).alias("c_custkey"), "c_name", "c_acctbal")
    return desk.lookup(wanted, rows, "c_custkey")


@query("SELECT n_name AS ticker, span, model FROM nation, (VALUES ('1d'), ('1h')) a(span), (VALUES ('base'), ('mini'), ('small')) b(model)")
def task_expansion(spark, sf_dir):
    return desk.task_grid(table(spark, sf_dir, "nation").select(F.col("n_name").alias("ticker")), span=("1d", "1h"), model=("base", "mini", "small"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-07-01')")
def fallback_gap_fill(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate")
    return desk.untouched_since(table(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey", "o_orderdate", F.lit("1998-07-01").cast("timestamp_ntz"))


@query("""
    WITH r AS (SELECT strftime(ts, '%Y-%m') AS month, CASE WHEN event_id % 3 > 0 THEN value END AS c FROM events WHERE event_type = 'purchase'),
    v AS (SELECT strftime(ts, '%Y-%m') AS month, json_extract_string(props, '$.k') AS c FROM events WHERE event_type = 'click'),
    a AS (SELECT month, sum(coalesce(c, 0)) AS t, count(*) AS n FROM r GROUP BY ALL), b AS (SELECT month, sum(coalesce(TRY_CAST(c AS DOUBLE), 0)) AS t, count(c) AS n FROM v GROUP BY ALL)
    SELECT coalesce(a.month, b.month) AS month, round(coalesce(a.t, 0), 4) AS research_total, coalesce(a.n, 0) AS research_count, round(coalesce(b.t, 0), 4) AS vision_total,
           coalesce(b.n, 0) AS vision_count, round(coalesce(a.t, 0) + coalesce(b.t, 0), 4) AS total FROM a FULL JOIN b ON a.month = b.month""")
def monthly_costs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    paid = F.when(F.col("event_id") % 3 > 0, F.col("value"))
    return desk.monthly_costs(e.where("event_type = 'purchase'"), paid, e.where("event_type = 'click'"), F.get_json_object("props", "$.k"), "ts")


@query("SELECT o_custkey, round(sum(o_totalprice), 2) AS pnl FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL")
def pnl_per_rec(spark, sf_dir):
    got = desk.totals_per(table(spark, sf_dir, "orders"), "o_custkey", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")), "pnl")
    return got.withColumn("pnl", F.round("pnl", 2))


@query("SELECT CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'unclassified' END AS event_type, count(*) AS n FROM events GROUP BY 1")
def attribution_counts(spark, sf_dir):
    return desk.attribution_counts(table(spark, sf_dir, "events"), "event_type", ("click", "view"))


@query("SELECT user_id, arg_max(value, ts) AS last_value, max(ts) AS last_at, count(*) AS n FROM events GROUP BY ALL")
def latest_with_count(spark, sf_dir):
    return desk.latest_with_count(table(spark, sf_dir, "events"), ["user_id"], "ts", "value")


@query(f"""
    WITH {_DAILY}, r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS n FROM daily)
    SELECT a.event_type, round(a.total, 4) AS last_value, round((a.total - b.total) / b.total * 100, 4) AS pct FROM r a LEFT JOIN r b ON a.event_type = b.event_type AND b.n = 6 AND b.total > 0 WHERE a.n = 1""")
def week_change(spark, sf_dir):
    got = desk.week_change(daily(spark, sf_dir), ["event_type"], "day", "total")
    return got.withColumns({"last_value": F.round("last_value", 4), "pct": F.round("pct", 4)})


@query(f"""
    WITH {_DAILY}, r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY total DESC, event_type) AS place FROM daily)
    SELECT day, count(*) FILTER (event_type IN ('error', 'signup', 'view')) AS n_defensive, count(*) FILTER (event_type IN ('error', 'signup', 'view')) >= 2 AS crowded FROM r WHERE place <= 3 GROUP BY ALL""")
def defensive_crowding(spark, sf_dir):
    place = F.row_number().over(retrieval.Window.partitionBy("day").orderBy(F.desc("total"), "event_type"))
    return desk.crowding(daily(spark, sf_dir).withColumn("place", place), "day", "event_type", "place", ("error", "signup", "view"))


@query("""
    WITH h AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 > 0 THEN epoch(o_orderdate) + (o_custkey % 120) * 86400 - epoch(TIMESTAMP '1998-06-15 12:00:00') END AS s FROM orders WHERE o_orderstatus = 'O'),
    r AS (SELECT o_orderkey, CAST(floor(s / 86400) AS BIGINT) AS days_left, coalesce(s < 30 * 86400, false) AS at_risk FROM h)
    SELECT *, CASE WHEN at_risk THEN 'at_risk' ELSE 'scheduled' END AS reason, CAST(row_number() OVER (ORDER BY at_risk DESC, days_left NULLS LAST, o_orderkey) AS INT) AS place FROM r QUALIFY place <= 50""")
def at_risk_order(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    end = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval((F.col("o_custkey") % 120).cast("int"))
    rows = orders.select("o_orderkey", F.when(F.col("o_orderkey") % 7 > 0, end).alias("expires"))
    return desk.most_urgent(desk.with_risk(rows, "expires", _now("1998-06-15 12:00:00")).drop("expires"), "o_orderkey", 50)


@query("""
    WITH u AS (SELECT user_id, 0 AS part, min(event_id) AS seen FROM events WHERE event_type = 'purchase' AND event_id % 3 = 0 GROUP BY ALL UNION ALL SELECT user_id, 1, min(event_id) FROM events WHERE event_type = 'view' GROUP BY ALL),
    f AS (SELECT user_id, min((part, seen)) AS k, arg_min(part, (part, seen)) AS part FROM u GROUP BY ALL)
    SELECT user_id, part, CAST(row_number() OVER (ORDER BY k, user_id) AS INT) AS place FROM f QUALIFY place <= 150""")
def capped_union(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return desk.capped_union([e.where("event_type = 'purchase' and event_id % 3 = 0"), e.where("event_type = 'view'")], "user_id", "event_id", 150)


@query("""
    SELECT tag, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest([lang, source, lang || '-' || source]) AS tag FROM documents) WHERE tag IS NOT NULL AND tag NOT IN ('en', 'de') GROUP BY ALL""")
def orphan_tags(spark, sf_dir):
    tags = F.array("lang", "source", F.concat("lang", F.lit("-"), "source"))
    return desk.orphan_tags(table(spark, sf_dir, "documents").withColumn("tags", tags), "tags", ("en", "de"))


@query("""
    WITH u AS (SELECT user_id, count(DISTINCT event_type) AS channels, count(*) FILTER (event_type = 'purchase') AS trailblazers FROM events WHERE value > 60 GROUP BY ALL)
    SELECT *, CASE WHEN channels >= 4 THEN 1 WHEN channels = 3 THEN 2 ELSE 3 END AS tier FROM u WHERE user_id % 5 <> 0 AND (channels >= 3 OR channels = 2 AND trailblazers >= 5)""")
def tier_predicate(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value > 60")
    u = e.groupBy("user_id").agg(F.count_distinct("event_type").alias("channels"), F.count_if(F.col("event_type") == "purchase").alias("trailblazers"))
    return desk.tier_rows(u, "channels", "trailblazers", F.col("user_id") % 5 == 0)


@query("""
    SELECT o_orderpriority, count(*) AS n, min(o_orderdate) AS oldest, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o FROM orders GROUP BY ALL""")
def class_status(spark, sf_dir):
    return desk.class_status(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderdate", "o_orderstatus", ("F", "O"))


@query(r"""
    WITH c AS (SELECT doc_id, length(regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}]', '', 'g')) AS a, length(regexp_replace(coalesce(text, ''), '[\s\p{Z}]', '', 'g')) AS s FROM documents)
    SELECT doc_id, s > 0 AND a >= 200 AND a >= 0.97 * s AS passes FROM c""")
def text_quality(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", rules.passes_quality(F.col("text"), 200, 0.97).alias("passes"))


@query("""
    SELECT event_id, CAST(ts AS DATE) BETWEEN DATE '2024-01-11' AND DATE '2024-01-15' AS fires, CAST(ts AS DATE) BETWEEN DATE '2024-01-14' AND DATE '2024-01-24' AS soon FROM events""")
def trigger_window(spark, sf_dir):
    day, now = F.to_date("ts"), _now("2024-01-15 02:00:00")
    return table(spark, sf_dir, "events").select("event_id", rules.in_trigger_window(day, now, 1, 3).alias("fires"), rules.upcoming(day, F.lit("2024-01-14").cast("date"), 10).alias("soon"))


@query("""
    SELECT event_id, event_id % 4 > 0 AND event_id % 3 < 2 AND (event_id % 5 = 0 OR epoch(TIMESTAMP '2024-01-20') - floor(epoch(ts)) >= CASE event_id % 3 WHEN 0 THEN 86400 ELSE 604800 END) AS due FROM events""")
def cadence_due(spark, sf_dir):
    i = F.col("event_id")
    cadence = F.when(i % 3 == 0, "Daily").when(i % 3 == 1, "weekly").otherwise("manual")
    last = F.when(i % 10 == 0, "never").when(i % 5 > 0, F.col("ts").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", rules.is_due(i % 4 > 0, cadence, last, _now("2024-01-20")).alias("due"))


@query("""
    SELECT user_id, CASE WHEN p >= 1 OR c >= 2 THEN 'high' WHEN c = 1 THEN 'medium' WHEN s > 0 THEN 'low' ELSE 'none' END AS severity FROM (
        SELECT user_id, count(*) FILTER (event_type = 'error' AND value > 150) AS p, count(*) FILTER (event_type = 'click' AND value > 120) AS c, count(*) FILTER (event_type = 'view') AS s FROM events GROUP BY ALL)""")
def conflict_severity(spark, sf_dir):
    t, v = F.col("event_type"), F.col("value")
    counts = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count_if((t == "error") & (v > 150)).alias("p"), F.count_if((t == "click") & (v > 120)).alias("c"), F.count_if(t == "view").alias("s")
    )
    return counts.select("user_id", rules.severity(F.col("p"), F.col("c"), F.col("s")).alias("severity"))


@query("""
    WITH s AS (SELECT user_id, count(DISTINCT event_type) AS n, max(CASE WHEN value > 200 THEN 3 WHEN value > 180 THEN 2 ELSE 1 END) AS best FROM events WHERE value > 150 GROUP BY ALL),
    c AS (SELECT c_custkey AS user_id, coalesce(n, 0) AS publishers, CASE WHEN n IS NULL THEN 0 WHEN n = 1 THEN 1 WHEN n >= 3 AND best >= 3 THEN 3 ELSE 2 END AS own, c_custkey % 5 AS k FROM customer LEFT JOIN s ON user_id = c_custkey)
    SELECT user_id, publishers, (['none', 'thin', 'moderate', 'strong'])[least(own, CASE k WHEN 4 THEN 3 ELSE k END) + 1] AS credibility FROM c""")
def claim_credibility(spark, sf_dir):
    e, v = table(spark, sf_dir, "events").where("value > 150"), F.col("value")
    sources = e.select("user_id", "event_type", F.when(v > 200, "primary").when(v > 180, "Secondary").otherwise("blog").alias("tier"))
    said = F.get(F.array(*[F.lit(s) for s in ("none", "thin", "moderate", "strong", "decisive")]), (F.col("c_custkey") % 5).cast("int"))
    claims = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast(e.schema["user_id"].dataType).alias("user_id"), said.alias("said"))
    return desk.claim_credibility(claims, "user_id", "said", sources, "event_type", "tier")


@query("""
    WITH p AS (SELECT l_orderkey, l_linenumber, (l_extendedprice - l_quantity * p_retailprice) / (l_quantity * p_retailprice) * 100 AS pct FROM lineitem JOIN part ON l_partkey = p_partkey)
    SELECT l_orderkey, l_linenumber, CASE WHEN pct > 1 THEN 'up' WHEN pct < -1 THEN 'down' ELSE 'flat' END AS band FROM p""")
def forecast_bands(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select("l_orderkey", "l_linenumber", rules.delta_band(F.col("l_extendedprice"), F.col("l_quantity") * F.col("p_retailprice")).alias("band"))


@query("""
    WITH f AS (SELECT DISTINCT source AS q, doc_id AS p FROM documents WHERE source IS NOT NULL AND doc_id % 3 > 0), d AS (SELECT DISTINCT source AS q, doc_id AS p FROM documents WHERE source IS NOT NULL AND doc_id % 2 = 0),
    b AS (SELECT coalesce(f.q, d.q) AS q, f.p AS a, d.p AS c FROM f FULL JOIN d ON f.q = d.q AND f.p = d.p)
    SELECT q AS source, count(a) AS n_fast, count(c) AS n_deep, count(*) FILTER (a IS NOT NULL AND c IS NOT NULL) AS n_both, count(*) FILTER (c IS NULL) AS n_only_fast, count(*) FILTER (a IS NULL) AS n_only_deep FROM b GROUP BY ALL""")
def recall_delta(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("source is not null")
    return desk.recall_delta(docs.where("doc_id % 3 > 0"), docs.where("doc_id % 2 = 0"), "source", "doc_id")


@query("SELECT event_id, event_type FROM events WHERE lower(trim(event_type)) = 'purchase'")
def name_timeline(spark, sf_dir):
    return desk.timeline(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", " Purchase ")


_ASKED = ("AAPL earnings last week", "compare MSFT and AAPL books since May 2026", "GDP growth 2025", "notes lately", "aapl outlook")


@query("""
    SELECT event_id, (['AAPL', 'MSFT,AAPL', '', '', ''])[k] AS tickers, (['filing', 'book,book_chapter', '', 'note', ''])[k] AS kinds,
           ([DATE '2026-05-01', DATE '2026-05-01', DATE '2025-01-01', DATE '2026-04-15', NULL])[k] AS since FROM (SELECT event_id, CAST(event_id % 5 + 1 AS INT) AS k FROM events)""")
def query_anchors(spark, sf_dir):
    asked = F.get(F.array(*[F.lit(q) for q in _ASKED]), (F.col("event_id") % 5).cast("int"))
    a = notes.anchors(F.col("asked"), ("AAPL", "MSFT"), F.lit("2026-05-15").cast("date"))
    rows = table(spark, sf_dir, "events").select("event_id", asked.alias("asked")).select("event_id", a.alias("a"))
    return rows.select("event_id", F.array_join("a.tickers", ",").alias("tickers"), F.array_join("a.kinds", ",").alias("kinds"), F.col("a.since").alias("since"))


@query("""
    WITH r AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC NULLS LAST, doc_id DESC) - 1 AS p FROM documents),
    w AS (SELECT doc_id, CAST(p AS INT) AS place, CASE WHEN doc_id % 50 = 0 OR source IS NULL THEN 1 WHEN lang = 'de' THEN CASE p WHEN 0 THEN 1 WHEN 1 THEN 0.5 ELSE 0 END
          WHEN p < 5 THEN ([1.0, 0.6, 0.45, 0.35, 0.25])[p + 1] ELSE 0.2 END::DOUBLE AS weight FROM r) SELECT * FROM w WHERE weight > 0""")
def kind_decay(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    got = notes.decayed(docs, "source", [F.desc_nulls_last("n_chars"), F.desc("doc_id")], "lang", F.col("doc_id") % 50 == 0, 0.2, {"de": ((1.0, 0.5), 0.0)})
    return got.select("doc_id", "place", "weight")


@query(f"""
    WITH fields AS (SELECT doc_id, concat_ws(' ', lang, source, text) AS text FROM documents), {documents._bm25_sql().replace("FROM documents", "FROM fields")}
    SELECT doc_id, round(score, 4) AS score, round(1 / (1 + score), 4) AS lexical_score FROM bm""")
def lexical_fields(spark, sf_dir):
    got = notes.lexical(table(spark, sf_dir, "documents"), "doc_id", ["lang", "source", "text"], documents._TERMS)
    return got.select("doc_id", F.round("score", 4).alias("score"), F.round("lexical_score", 4).alias("lexical_score"))


@query("SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC NULLS LAST, doc_id DESC) AS r FROM documents) WHERE r = 1")
def best_chunk(spark, sf_dir):
    return notes.best_per(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "source", "n_chars", "doc_id")


@query("SELECT doc_id, item_id FROM documents d, benchmark b WHERE length(substr(b.text, 1, 40)) >= 3 AND contains(lower(d.text), lower(substr(b.text, 1, 40)))")
def title_mentions(spark, sf_dir):
    titles = table(spark, sf_dir, "benchmark").select("item_id", F.substring("text", 1, 40).alias("title"))
    return notes.mentions(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", titles, "item_id", "title")


@query("SELECT o_orderstatus AS kind, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus)")
def edge_counts(spark, sf_dir):
    return notes.edge_counts(table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("kind")), "kind")


@query("""
    SELECT count(*) AS n_nodes, count(DISTINCT CASE WHEN c_custkey % 4 > 0 THEN c_nationkey END) AS n_clusters, count(CASE WHEN c_custkey % 3 > 0 THEN 1 END) AS n_ranked,
           (SELECT count(*) FROM orders) AS n_edges FROM customer""")
def graph_health(spark, sf_dir):
    nodes = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 4 > 0, F.col("c_nationkey")).alias("cluster_id"), F.when(F.col("c_custkey") % 3 > 0, 1.0).alias("citation_rank"))
    return notes.graph_health(nodes, table(spark, sf_dir, "orders"))


@query("""
    WITH s AS (SELECT user_id, event_type, sum(length(props)) AS w FROM events GROUP BY ALL)
    SELECT user_id, event_type AS mode FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY w DESC, event_type DESC) = 1""")
def weighted_mode(spark, sf_dir):
    return notes.weighted_mode(table(spark, sf_dir, "events"), ["user_id"], "event_type", F.length("props"))


@query()
def sentence_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(notes.sentences(F.col("text"))).alias("at", "sentence"))


@query()
def heading_chunks(spark, sf_dir):
    body = F.concat(F.lit("# "), F.coalesce("source", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n## End\nthe end"))
    return notes.heading_chunks(table(spark, sf_dir, "documents").select("doc_id", body.alias("body")), "doc_id", "body")
